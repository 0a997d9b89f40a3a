import pytest
from pyspark.sql import functions as F

from contrada.operators import coverage, evaluation, grounding, ontology
from contrada.plans import registry
from contrada.sources import payload, records

RUN = "run_id string, experiment string, citta string, zona string, status string, grounding double, hallucination double, latency_ms long, cost_usd double, narrativa string, snapshot_id string"


def run(i, status="ok", g=0.7, h=0.3, lat=1000, cost=0.0004, text="x", exp="e"):
    return (f"r{i}", exp, "c", "z", status, g, h, lat, cost, text, "s")


def test_fold(spark):
    rows = [run(1, g=0.6, h=0.4, lat=1000, cost=0.0004), run(2, g=0.7, h=0.3, lat=1100, cost=0.0006, text="y"), run(3, g=0.8, h=0.2, lat=1200, cost=0.0008), run(0, "error", 0.0, 0.0, 0, 0.0, " ")]
    r = evaluation.folded(spark.createDataFrame(rows, RUN)).first()
    assert (r.grounding, r.hallucination, r.latency_ms, r.cost_usd) == pytest.approx((0.7, 0.3, 1100, 0.0006))
    assert r.std_grounding == pytest.approx(0.081649658) and r.std_latency_ms == pytest.approx(81.6496580927726) and (r.n_reps, r.n_dropped, r.narrativa) == (3, 1, "x")
    r = evaluation.folded(spark.createDataFrame([run(1)], RUN)).first()
    assert (r.std_grounding, r.std_hallucination, r.std_latency_ms, r.std_cost_usd) == (0, 0, 0, 0)
    r = evaluation.folded(spark.createDataFrame([run(1, "error")], RUN)).first()
    assert (r.status, r.grounding, r.narrativa, r.snapshot_id) == ("error", 0, "", "s")
    assert evaluation.folded(spark.createDataFrame([], RUN)).count() == 0


@pytest.mark.parametrize("a, b, who, axis, n", [((0.1, 0.9, 100, 0.1), (0.1, 0.9, 100, 0.1), None, None, 4), ((0.1013, 0.5, 100, 0.1), (0.1014, 0.6, 90, 0.1), "b", "grounding", 2), ((0.101, 0.1, 1, 1.0), (0.104, 0.9, 0, 0.0), "a", "hallucination", 1)])
def test_verdict(spark, a, b, who, axis, n):
    cols = [f"{m}_{s}" for s in "ab" for m in ("hallucination", "grounding", "latency_ms", "cost_usd")]
    row = spark.createDataFrame([(*map(float, a), *map(float, b), False)], [*cols, "withheld"])
    r = evaluation.verdict(row).first()
    assert (r.winner, r.deciding_axis, len(r.chain), r.applicable) == (who, axis, n, True)
    r = evaluation.verdict(row.withColumn("withheld", F.lit(True))).first()
    assert (r.winner, r.applicable) == (None, False)


def test_arms_verdict(spark):
    rows = lambda exp, *zones: evaluation.folded(spark.createDataFrame([(f"r{i}", exp, "c", z, st, g, 1 - g, 100, 0.1, text, "s") for i, (z, st, g, text) in enumerate(zones)], RUN))
    good = rows("a", ("z1", "ok", 0.9, "t"), ("z2", "ok", 0.5, "t"), ("z3", "error", 0.0, ""), ("only a", "ok", 0.0, "t"))
    other = rows("b", ("z1", "ok", 0.6, "t"), ("z2", "ok", 0.6, "t"), ("z3", "ok", 1.0, "t"))
    r = evaluation.arms_verdict(good, other).first()  # means of z1 and z2: 0.7 and 0.6
    assert (r.winner, r.deciding_axis, r.applicable) == ("a", "hallucination", True)
    silent = rows("b", ("z1", "ok", 0.6, "t"), ("z2", "ok", 0.9, " "))
    r = evaluation.arms_verdict(good, silent).first()
    assert (r.winner, r.deciding_axis, r.applicable) == (None, None, False)
    mute = rows("b", ("z1", "error", 0.6, ""))
    assert not evaluation.arms_verdict(good, mute).first().applicable and evaluation.arms_verdict(good, good.limit(0)).first().applicable
    failed = evaluation.failed_zones(evaluation.paired(good, other)).collect()
    assert [(r.zona, r.status_a, r.status_b) for r in failed] == [("z3", "error", "ok")]


def test_tabs(spark):
    hazards = spark.createDataFrame([("c", "z", None, 2, "b"), ("c", "z", "", 1, "a"), ("c", "z", "ALTRO", 3, "x")], "citta string, zona string, tag string, position int, hazard string")
    prose = spark.createDataFrame([("c", "z", "ONTOLOGIA", " p\n"), ("c", "z", "CONTESTO", "\x1c \n"), ("c", "z", "NUOVO", "q")], "citta string, zona string, tag string, text string")
    got = [(r.tag, r.text, r.hazards) for r in grounding.tabs(grounding.by_tag(hazards), prose).orderBy("tab_rank").collect()]
    assert got == [("ONTOLOGIA", "p", []), ("SPECULATIVO", "", ["a", "b"])]


def test_anchors_and_citations(spark):
    points = spark.createDataFrame([("c", "z", "Banca A"), ("c", "z", " "), ("c", "z", None)], "citta string, zona string, name string")
    hazards = spark.createDataFrame([("c", "z", "Theft", "Furto", "")], "citta string, zona string, hazard string, label_it string, label_en string")
    assert evaluation.anchor_sets(points, hazards).first().anchors == ["banca a", "furto", "theft"]
    cited = spark.createDataFrame([("Bank", "hazards", "Theft", "known")], "terminus_class string, axis string, filler string, source string")
    risks = spark.createDataFrame([("Bank", "Theft"), ("Bank", "Fire")], "terminus_class string, filler string")
    assert {r.filler: r.source for r in grounding.cited_risks(risks, cited, "hazards", "havingHazard").collect()} == {"Theft": "known", "Fire": "Bank → havingHazard → Fire"}


def test_boundaries_either_way(spark):
    sq = lambda a, b: [{"lon": a, "lat": a}, {"lon": b, "lat": a}, {"lon": b, "lat": b}, {"lon": a, "lat": b}]
    shapes = spark.createDataFrame([("a", [[sq(0.0, 4.0), sq(1.0, 3.0)], []]), ("b", None)], "citta string, polygons array<array<array<struct<lon: double, lat: double>>>>")
    points = spark.createDataFrame([(c, i / 7, i / 7) for c in ("a", "b", "none") for i in range(40)], "citta string, lat double, lon double")
    rows = lambda df: sorted(map(tuple, df.select("citta", "lat", "inside").collect()))
    assert rows(coverage.inside(points, shapes)) == rows(coverage.inside_vectorised(points, shapes)) == rows(coverage.inside_vectorised(points, shapes, most=3))


def test_agreement(spark):
    df = lambda rows: spark.createDataFrame(rows, "proxy double, gold double")
    r = evaluation.agreement(df([(0.0, 0.2), (0.4, 0.6), (0.8, 1.0), (0.5, None)])).first()
    assert (r.pearson, r.mae, r.mean_proxy, r.mean_gold, r.n, r.n_total) == pytest.approx((1, 0.2, 0.4, 0.6, 3, 4))
    assert evaluation.agreement(df([(0.5, 0.1), (0.5, 0.9)])).first().pearson is None
    assert evaluation.agreement(df([(0.5, 0.1)])).first().pearson is None and evaluation.agreement(df([])).first().mae == 0
    r = evaluation.confusion(df([(0.9, 0.9), (0.9, 0.1), (0.1, 0.9), (0.1, 0.1)]), 0.5).first()
    assert tuple(r) == (1, 1, 1, 1)


@pytest.mark.parametrize("said, want", [("intro\nX [ONTOLOGIA]\nBanca A presenta rischio rapina.\nY [CONTESTO]\nIl Museo X.", 1.0), ("i\n[ONTOLOGIA]\nIl Museo X presenta rischio incendio.", 0.0), ("  ", 1.0), ("nothing to cite", 0.0)])
def test_grading(spark, said, want):
    runs = spark.createDataFrame([("c", "z", said)], "citta string, zona string, narrativa string")
    anchors = spark.createDataFrame([("c", "z", ["Banca A", " "])], "citta string, zona string, anchors array<string>")
    r = evaluation.graded(runs, anchors).first()
    assert (r.grounding, r.hallucination) == (want, 1 - want)
    assert evaluation.graded(runs, anchors.filter("false")).first().grounding == 1.0


def test_cost(spark):
    prices = spark.createDataFrame([("m", 3.0, 15.0)], "model_id string, price_in double, price_out double")
    rows = spark.createDataFrame([("m", 1_000_000, 1_000_000), ("", 5, 5), ("x", 1, 1)], "model_id string, tokens_input long, tokens_output long")
    known, unknown = evaluation.priced(rows, prices)
    assert {r.model_id: r.cost_usd for r in known.collect()} == {"m": 18.0, "": 0.0} and [r.model_id for r in unknown.collect()] == ["x"]


def triples(spark):
    n = "http://example.org/x#"
    rows = []
    for c, p in (("Petrol_station", "System"), ("Banknote_acceptor_theft", "Theft"), ("A", "B"), ("B", "A")):
        rows += [(n + c, "rdf:type", "owl:Class", "iri", "iri"), (n + c, "rdfs:subClassOf", n + p, "iri", "iri")]
    for k, (c, p, f, kind) in enumerate([("Petrol_station", "havingHazard", "Banknote_acceptor_theft", "iri"), ("B", "havingHazard", "H", "iri"), ("B", "isVulnerableTo", "V", "iri"), ("B", "havingVulnerability", "V", "iri"), ("B", "havingHazard", "x1", "bnode")]):
        node = f"_:{k}"
        rows += [(n + c, "rdfs:subClassOf", node, "iri", "bnode"), (node, "rdf:type", "owl:Restriction", "bnode", "iri"), (node, "owl:onProperty", n + p, "bnode", "iri"), (node, "owl:someValuesFrom", n + f, "bnode", kind)]
    return spark.createDataFrame(rows, "s string, p string, o string, s_kind string, o_kind string")


def test_restrictions_of_odd_nodes(spark):
    rows = [("A", "rdfs:subClassOf", "n"), ("B", "rdfs:subClassOf", "n"), ("n", "rdf:type", "owl:Restriction"), ("n", "rdf:type", "owl:Restriction"), ("n", "rdf:type", "owl:Thing")]
    rows += [("n", "owl:onProperty", f"x#{p}") for p in ("havingHazard", "havingPerformer", "havingHazard", "other")] + [("n", "owl:someValuesFrom", f"x#{f}") for f in "FGF"]
    rows += [("A", "rdfs:subClassOf", "untyped"), ("untyped", "owl:onProperty", "x#havingHazard"), ("untyped", "owl:someValuesFrom", "x#F")]
    rows += [("A", "rdfs:subClassOf", "bare"), ("bare", "rdf:type", "owl:Restriction"), ("bare", "owl:onProperty", "x#other"), ("bare", "owl:someValuesFrom", "x#F"), ("A", "rdfs:subClassOf", "B"), (None, "rdf:type", "owl:Restriction")]
    t = spark.createDataFrame([(*r, "iri", "iri") for r in rows], "s string, p string, o string, s_kind string, o_kind string")
    found = ontology.restriction_rows(t)
    assert sorted(map(tuple, found.collect())) == sorted((c, p, f, True) for c in "AB" for p in ("havingHazard", "havingPerformer") for f in "FG")
    for side in ontology.restrictions(t):
        assert "BroadcastHashJoin" not in (plan := side._jdf.queryExecution().executedPlan().toString()) and plan.count("SortMergeJoin") == 2, plan


def test_profiles(spark):
    t = triples(spark)
    own, dropped = ontology.restrictions(t)
    classes = spark.createDataFrame([("Petrol_station",), ("A",), ("Unknown",)], "terminus_class string")
    fillers = ontology.inherited(ontology.ancestors(t), own)
    got = {r.terminus_class: r for r in ontology.profiles(fillers, classes).collect()}
    assert got["Petrol_station"].hazards == ["Banknote_acceptor_theft"] and got["Unknown"].hazards == [] and got["Unknown"].sparql_paths == []
    assert got["A"].vulnerabilities == ["V"] and got["A"].sparql_paths == ["A → havingHazard → H", "A → isVulnerableTo → V"]
    assert [r.filler for r in dropped.collect()] == ["x1"]
    points = spark.createDataFrame([("c", "z", "node", 1, " ", "A"), ("c", "z", "way", 1, "n", "Other")], "citta string, zona string, type string, id long, name string, terminus_class string")
    r = {x.type: x for x in grounding.nested(points, fillers).collect()}
    assert r["node"].confidence == "da_confermare" and r["node"].sparql_path == "A → havingHazard → H" and r["way"].risks == [] and r["way"].confidence is None


def test_coverage(spark):
    points = spark.createDataFrame([("c", k, True) for k in ("Bank", "Prison", "GenericUrbanPOI")], "citta string, terminus_class string, inside boolean")
    declared = spark.createDataFrame([("Bank",), ("Museum",)], "terminus_class string")
    captures = spark.sql("SELECT c AS citta, 10 AS switch_ms, named_struct('min_lat', 0.0D, 'min_lon', 0.0D, 'max_lat', 1.0D, 'max_lon', 0.0D) AS bbox FROM VALUES ('c'), ('empty') AS t(c)")
    r = {x.citta: x for x in coverage.city_records(points, declared, captures).collect()}
    assert (r["c"].verbatim, r["c"].derived, r["c"].boundary, r["c"].bbox_valid) == pytest.approx((1 / 3, 2 / 3, 1.0, False)) and r["empty"].derived == 0


def test_sources(spark, tmp_path):
    texts = spark.createDataFrame([("a", '{"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2, "tags": {"amenity": "bank"}}, 7, null]}'), ("b", '{"x": 1}'), ("c", None)], "citta string, payload string")
    assert [(r.id, r.lat, r.tags) for r in payload.elements(texts, "payload", ["citta"]).collect()] == [(1, 1.5, {"amenity": "bank"})]
    assert sorted(r.citta for r in payload.rejects(texts, "payload").collect()) == ["b", "c"]
    (tmp_path / "v1.json").write_text('[{"id": "1", "name": "n", "lat": 1.0, "lon": 2.0, "osm_tags": "", "terminus_class": "Bank", "citta": "c"}]')
    (tmp_path / "v2.json").write_text('{"formato": 2, "provenienza": {"citta": "c", "bbox": [1, 2, 3, 4]}, "poi": [{"id": "2", "name": "", "lat": 1.0, "lon": 2.0, "osm_tags": "", "terminus_class": "Bank", "citta": "c"}]}')
    (tmp_path / "bad.json").write_text('{"other": 1}')
    good, bad = payload.read_snapshots(spark, str(tmp_path))
    assert sorted(r.id for r in good.collect()) == ["1", "2"] and bad.count() == 1
    points = good.withColumn("zona", F.lit("z"))
    payload.write_snapshots(points, points.select("citta", "zona", F.struct(F.lit("now").alias("catturato_il")).alias("provenienza")).distinct(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().formato == 2
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs" / "a.json").write_text('{"run_id": "e__1",\n "experiment": "e", "metrics": {"grounding": 1.0}}')
    assert records.read_runs(spark, str(tmp_path / "runs"), "e").first().file_order == "e__1.json" and records.read_runs(spark, str(tmp_path / "runs"), "f").count() == 0
    records.write_runs(records.read_runs(spark, str(tmp_path / "runs")), str(tmp_path / "written"))
    assert records.read_runs(spark, str(tmp_path / "written")).count() == 1
    assert records.read_vocabulary(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t.nt").write_text('<a#b> <p> _:x .\n<a> <p> "l\\"it"@it .\n')
    assert [(r.s, r.s_kind, r.o_kind) for r in records.read_triples(spark, str(tmp_path / "t.nt")).collect()] == [("a#b", "iri", "bnode"), ("a", "iri", "literal")]
    (tmp_path / "empty.nt").write_text("\n")
    with pytest.raises(ValueError):
        records.read_triples(spark, str(tmp_path / "empty.nt"))
    (tmp_path / "outcomes").mkdir()
    (tmp_path / "outcomes" / "a.json").write_text('{"status": "ok", "citta": "c", "capture": {"switch_ms": 7, "bbox": [1, 2, 3, 4], "pois": [{"id": "1"}]}}')
    (tmp_path / "outcomes" / "b.json").write_text('{"status": "failed",\n "citta": "d", "error_type": "Timeout"}')
    assert sorted((r.citta, r.status, r.error_type, r.capture.switch_ms if r.capture else None) for r in records.read_outcomes(spark, str(tmp_path / "outcomes")).collect()) == [("c", "ok", None, 7), ("d", "failed", "Timeout", None)]
    records.write_report(spark.createDataFrame([("c", 0.12345, 1.5)], "citta string, grounding_a double, latency_ms_a double"), str(tmp_path / "report"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()] == [("c", "0.123", "2.0")]
    assert records.rounded(spark.createDataFrame([(0.12345, 0.5)], "grounding_a double, latency_ms double")).first() == (0.123, 0.0)


def test_long_chains_and_cycles_close(spark, monkeypatch):
    from contrada.sources.stored import stored

    n = 1000
    edges = [(f"c{i}", f"c{i + 1}") for i in range(n - 1)]
    edges += [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r3", "c990"), ("self", "self"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
    table = stored(spark.createDataFrame(edges, "`from` string, `to` string"), "edges")
    rounds = []
    monkeypatch.setattr(ontology, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    seeds = spark.createDataFrame([(x, x) for x in ("c0", "c500", "r0", "self", "a", "lone")], "terminus_class string, ancestor string")
    got = {}
    for r in ontology.closed(stored(seeds, "seeds"), table).collect():
        got.setdefault(r.terminus_class, set()).add(r.ancestor)
    assert rounds.count("closure") == 4  # each goes eight times as far
    tail = {f"c{i}" for i in range(990, n)}
    assert got == {"c0": {f"c{i}" for i in range(n)}, "c500": {f"c{i}" for i in range(500, n)}, "r0": {f"r{i}" for i in range(7)} | tail, "self": {"self"}, "a": set("abcd"), "lone": {"lone"}}
    whole = ontology.closed(stored(spark.createDataFrame([(f"c{i}", f"c{i}") for i in range(n)], seeds.schema), "seeds"), table)
    assert whole.count() == n * (n + 1) // 2


def test_as_of_equals_the_loop(spark):
    import datetime
    import random

    from contrada.operators import context

    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    when = lambda: start + datetime.timedelta(seconds=rng.choice([rng.randrange(9000), 900 * rng.randrange(10), 1800]))
    # One zone has over a third of all rows; times tie within and across sides.
    zone = lambda: rng.choice(["hot", "hot", "z1", "z2", None])
    contexts = [(i, zone(), None if i == 7 else when(), str(i % 2), ["1"]) for i in range(200)]
    requests = [(i, zone(), None if i == 9 else when(), i * 1.5) for i in range(400)]
    requests += requests[:3]
    c = spark.createDataFrame(contexts, "context_id long, zone_key string, stored_at timestamp, contesto_hash string, poi_ids array<string>")
    q = spark.createDataFrame(requests, "request_id long, zone_key string, requested_at timestamp, side double")

    def plain(max_age):
        out = []
        for i, z, t, extra in requests:
            best = max(((s, k) for k, y, s, *_ in contexts if z is not None and y == z and t and s and s <= t), default=None)
            out.append((i, extra, best[1] if best and (t - best[0]).total_seconds() <= max_age else None))
        return sorted(out)

    for max_age, bucket in ((1800, 900), (1800, 60), (100, 7), (10**7, 1)):
        got = context.as_of(q, c, max_age, bucket)
        assert got.columns == [*q.columns, "context"]
        assert sorted((r.request_id, r.side, r.context.context_id if r.context else None) for r in got.collect()) == plain(max_age)
    assert "zone_key" in (plan := context.as_of(q, c)._jdf.queryExecution().executedPlan().toString()) and "hashpartitioning(zone_key" in plan.replace("#", " #") and ", bucket" in plan


def test_lines_are_shuffled_once(spark):
    """Customers meet orders first: what is dealt by customer has no lines in it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = registry.evaluation_queries.runs(spark, "/root/testdata/sf0.001").select("run_id", "zona", "narrativa")
        plan = rows._jdf.queryExecution().executedPlan().treeString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    at = next(i for i, x in enumerate(plan) if "Exchange hashpartitioning(o_custkey" in x)
    below = [x for x in plan[at + 1 :] if depth(x) > depth(plan[at])][: next((k for k, x in enumerate(plan[at + 1 :]) if depth(x) <= depth(plan[at])), None)]
    assert below and not any("l_orderkey" in x for x in [plan[at], *below]) and sum("l_orderkey" in x and "Exchange" in x for x in plan) == 1, plan
