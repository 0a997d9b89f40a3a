"""Files written and read back: layouts, rejects with their reasons, and what a second write replaces."""

from pyspark.sql import functions as F

from contrada.sources import payload, records, texts
from contrada.sources.stored import discard, stored

POINT = "citta string, zona string, position int, id string, name string, lat double, lon double, osm_tags string, terminus_class string"


def test_layouts_and_reasons(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "pretty.json").write_text('{\n "run_id": "a",\n "metrics": {"latency_ms": 7}\n}\n')
    (tmp_path / "deep" / "lines.json").write_text('{"run_id": "b", "metrics": 5}\n\n{"run_id": "c"\n[1]\n{"run_id": null}\n{"n_poi": "x", "run_id": "d"}\n')
    (tmp_path / "blank.json").write_text(" \n")
    good = {r.run_id: r for r in records.read_runs(spark, str(tmp_path)).collect()}
    assert set(good) == {"a", "b", "d"} and good["a"].metrics.latency_ms == 7 and good["b"].metrics is None and good["d"].n_poi is None and good["d"].file_order == "d.json"
    bad = sorted((r.reason, r.value) for r in records.rejected_runs(spark, str(tmp_path)).collect())
    assert bad == [("no JSON", '{"run_id": "c"'), ("no object", "[1]"), ("no run_id", '{"run_id": null}')]
    assert texts.read_texts(spark, str(tmp_path / "blank.json"))[0].count() == 0


def test_a_record_is_parsed_once(spark, tmp_path):
    """Filters on the record do not bring parsers of their own, and the part behind the files is compiled whole."""
    (tmp_path / "a.json").write_bytes(b' \n\t\r\n {"run_id": "a",\r"n_poi": 1}\r\n{"run_id": "b"}\r\n')
    (tmp_path / "b.json").write_text('\n\n{\n"run_id":\n"c"}\n\n')
    (tmp_path / "c.json").write_text("\n" * 50_000 + ' {"run_id": "d"}\n[2]\n')
    runs = records.read_runs(spark, str(tmp_path))
    assert sorted((r.run_id, r.n_poi) for r in runs.collect()) == [("a", 1), ("b", None), ("c", None), ("d", None)]
    plan = runs._jdf.queryExecution().executedPlan().toString()
    # Of each line once; besides, of each file the first line and, where that is no JSON, the whole.
    assert plan.count("parseJson(") == 3 and "lambda" not in plan, plan


def test_a_second_write_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([(f"{e}{i}", e, "old") for e in "xy" for i in range(1500)], "run_id string, experiment string, status string")
    records.write_runs(rows, path)
    records.write_runs(rows.filter("experiment = 'x'").withColumn("status", F.lit("new")).limit(1200), path)
    counts = {(r.experiment, r.status): r["count"] for r in records.read_runs(spark, path).groupBy("experiment", "status").count().collect()}
    assert counts == {("x", "new"): 1200, ("y", "old"): 1500}
    assert records.read_runs(spark, path, "x").count() == 1200

    path = str(tmp_path / "snapshots")
    points = spark.createDataFrame([("c", z, p, f"{z}{p}", "n", 1.5, 2.5, "t", "Bank") for z in ("u", "v w") for p in (2, 1)], POINT)
    told = points.select("citta", "zona").distinct().withColumn("provenienza", F.struct(F.col("zona").alias("zona"), F.array(F.lit(1.0)).alias("bbox")))
    payload.write_snapshots(points, told, path)
    payload.write_snapshots(points.filter("zona = 'u' and position = 1"), told, path)
    (tmp_path / "snapshots" / "spoilt.json").write_text('{"poi": 5}')
    good, bad = payload.read_snapshots(spark, path)
    assert sorted((r.provenienza.zona, r.position, r.id, r.lat) for r in good.collect()) == [("u", 1, "u1", 1.5), ("v w", 1, "v w1", 1.5), ("v w", 2, "v w2", 1.5)]
    assert [(r.reason, r.value) for r in bad.collect()] == [("no list of points", '{"poi": 5}')]


def test_run_files_are_packed(spark, tmp_path):
    path = tmp_path / "runs"
    rows = spark.range(20_000).selectExpr("concat('r', id) AS run_id", "'x' AS experiment", "concat('testo ', id) AS narrativa", "named_struct('latency_ms', id) AS metrics").coalesce(1)
    records.write_runs(rows, str(path))
    files = [f for f in path.rglob("*") if f.name.startswith("part-")]
    # A record has some 80 bytes.
    assert len(files) == 2 and sum(f.stat().st_size for f in files) < 20_000 * 25
    read = records.read_runs(spark, str(path)).selectExpr("count(*)", "sum(metrics.latency_ms)", "min(file_order)").first()
    assert tuple(read) == (20_000, 199_990_000, "r0.json") and records.rejected_runs(spark, str(path)).isEmpty()


def test_elements_of_odd_payloads(spark):
    odd = ['{"elements": [{"id": 1, "tags": {"a": 5, "b": null}, "lat": "x"}, [], "s", {}, {"id": 2.0, "center": {"lat": 1, "lon": 2}}]}', '{"elements": {}}', "[]", "", "{", None, '{"elements": []}']
    df = spark.createDataFrame(list(enumerate(odd)), "k int, payload string")
    got = [(r.k, r.id, r.tags, r.lat, r.center.lon if r.center else None, r.emit_pos) for r in payload.elements(df, "payload", ["k"]).orderBy("emit_pos").collect()]
    assert got == [(0, 1, {"a": "5", "b": None}, None, None, 0), (0, None, None, None, None, 3), (0, 2, None, None, 2.0, 4)]
    assert sorted(r.k for r in payload.rejects(df, "payload").collect()) == [1, 2, 3, 4, 5]


def test_discarded_tables_are_gone(spark):
    table = stored(spark.range(5), "gone")
    assert table.count() == 5
    path = table.stored_at
    discard(table, spark.range(3))
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(fs_path)
