"""Queries that write the driver's rows as files of records, some of them twice, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import payload, records
from ..sources.stored import folder_of, stored
from . import views
from .evaluation_queries import RU, runs
from .poi_queries import ALL, named, selection
from .registry import query


@query(ALL + "SELECT citta, zona, CAST(position AS INT) AS position, type || '/' || id AS id, name, round_even(lat, 9) AS lat, round_even(lon, 9) AS lon, CASE WHEN citta = 'ASIA' THEN 'Stale' ELSE cls END AS terminus_class FROM gr")
def s2_s3_snapshots(spark, sf_dir):
    """Snapshots of all zones, written again for the zones of all cities but one, whose first ones stay."""
    path = folder_of(spark, "snapshots")
    points = stored(named(selection(spark, sf_dir)).withColumn("osm_tags", F.coalesce("osm_tags", F.lit(""))), "selection")
    provenance = points.select("citta", "zona").distinct().select("citta", "zona", F.struct(F.lit("2024-01-01").alias("catturato_il"), "citta", "zona").alias("provenienza"))
    payload.write_snapshots(points.withColumn("terminus_class", F.lit("Stale")), provenance, path)
    payload.write_snapshots(points.filter("citta <> 'ASIA'"), provenance, path)
    read, _ = payload.read_snapshots(spark, path)
    return read.select("provenienza.citta", "provenienza.zona", F.col("position").cast("int"), "id", "name", F.bround("lat", 9).alias("lat"), F.bround("lon", 9).alias("lon"), "terminus_class")


@query(f"WITH {RU} SELECT run_id, experiment, citta, zona, CASE WHEN experiment = 'O' THEN status ELSE 'stale' END AS status, round_even(grounding, 9) AS grounding, latency_ms, round_even(cost_usd, 9) AS cost_usd, narrativa, snapshot_id, run_id || '.json' AS file_order FROM ru")
def s4_s5_runs(spark, sf_dir):
    """Run records of both arms, of which one is written again and replaces its own only."""
    path = folder_of(spark, "runs")
    rows = runs(spark, sf_dir)
    own = rows.select("run_id", "experiment", "citta", "zona", "model_id", "status", F.struct("grounding", "hallucination", "latency_ms", "cost_usd").alias("metrics"), "narrativa", F.struct("snapshot_id", "model_id").alias("provenance"))
    records.write_runs(own.withColumn("status", F.lit("stale")), path)
    records.write_runs(own.filter("experiment = 'O'"), path)
    read = records.read_runs(spark, path)
    return read.select("run_id", "experiment", "citta", "zona", "status", F.bround("metrics.grounding", 9).alias("grounding"), "metrics.latency_ms", F.bround("metrics.cost_usd", 9).alias("cost_usd"), "narrativa", "provenance.snapshot_id", "file_order")


@query("""SELECT n_name AS zona, CASE WHEN k IN (5, 6) OR k = 4 THEN NULL ELSE r_name END AS citta, CASE k WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN k = 0 THEN 'Timeout' END AS error_type,
  CASE WHEN k IN (1, 2, 3) THEN n_nationkey * 100 END AS switch_ms, CASE WHEN k IN (1, 2, 3) THEN k END AS n_pois, CASE k WHEN 4 THEN 'no status' WHEN 5 THEN 'no JSON' WHEN 6 THEN 'no object' END AS reason
FROM (SELECT *, n_nationkey % 7 AS k FROM nation) n JOIN region ON r_regionkey = n_regionkey""")
def s6_capture_outcomes(spark, sf_dir):
    """Outcomes of captures, good and failed, and the reasons why the rest are none."""
    path = folder_of(spark, "outcomes")
    nation = views.view(spark, sf_dir, "SELECT n.n_name AS zona, r.r_name AS citta, CAST(n.n_nationkey AS BIGINT) AS n, CAST(n.n_nationkey % 7 AS INT) AS k FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey")
    k = F.col("k")
    poi = F.struct(F.lit("node/1").alias("id"), F.lit(41.5).alias("lat"), F.lit(12.5).alias("lon"))
    capture = F.struct("citta", "zona", (F.col("n") * 100).alias("switch_ms"), F.array(*[F.lit(x) for x in (1.0, 2.0, 3.0, 4.0)]).alias("bbox"), F.array_repeat(poi, k).alias("pois"))
    good = F.to_json(F.struct("zona", "citta", F.when(k == 0, "failed").otherwise("ok").alias("status"), F.when(k == 0, "Timeout").alias("error_type"), F.when(k > 0, capture).alias("capture")))
    bare = F.to_json(F.struct("zona"))
    told = F.when(k == 4, bare).when(k == 5, F.substring(good, 1, 40)).when(k == 6, F.concat(F.lit("["), bare, F.lit("]"))).otherwise(good)
    nation.select(told.alias("value")).write.text(path)
    read = records.read_outcomes(spark, path).select("zona", "citta", "status", "error_type", "capture.switch_ms", F.when(F.col("capture").isNotNull(), F.size("capture.pois")).alias("n_pois"))
    rejected = records.rejected_outcomes(spark, path).select(F.regexp_extract("value", r'"zona":"([^"]*)"', 1).alias("zona"), "reason")
    return read.unionByName(rejected, allowMissingColumns=True)
