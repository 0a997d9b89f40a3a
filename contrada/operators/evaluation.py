"""Grading of narratives, folding of repetitions, comparison of two arms, verdict, agreement with human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

METRICS = ("grounding", "hallucination", "latency_ms", "cost_usd")
#: Axes of the verdict in turn: decimals, and whether more is better.
AXES = {"hallucination": (3, False), "grounding": (3, True), "latency_ms": (0, False), "cost_usd": (6, False)}
ZONE = ["citta", "zona"]


def excluded(status) -> Column:
    """Runs in error and fallback never enter means."""
    return status.isin("error", "fallback")


def repeated(run_id) -> Column:
    return run_id.rlike(r"__rep\d{2,}$")


def graded(runs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds grounding and hallucination to runs (citta, zona, narrativa): the share of the ontology block's sentences that name an anchor of the zone (anchors: citta, zona, anchors; lower case, blanks removed here).

    A blank narrative, or a zone without anchors, is 1 and 0; a narrative without ontology sentences where there are anchors is 0 and 1.
    """
    own = runs.join(anchors, ZONE, "left").withColumn("anchors", F.filter(F.array_distinct(F.transform(F.coalesce("anchors", F.array().cast("array<string>")), F.lower)), text.filled))
    said = own.withColumn("__s", F.transform(text.sentences(text.blocks(F.col("narrativa"))["ontologia"]), F.lower))
    hits = F.size(F.filter("__s", lambda s: F.exists("anchors", lambda a: s.contains(a))))
    n = F.size("__s")
    vacuous = ~text.filled(F.col("narrativa")) | (F.size("anchors") == 0)
    share = F.when(vacuous, 1.0).when(n == 0, 0.0).otherwise(F.try_divide(hits.cast("double"), n))
    miss = F.when(vacuous, 0.0).when(n == 0, 1.0).otherwise(F.try_divide((n - hits).cast("double"), n))
    return said.withColumn("grounding", share).withColumn("hallucination", miss).drop("__s", "anchors")


def anchor_sets(points: DataFrame, hazards: DataFrame) -> DataFrame:
    """Anchors of each zone: names of its points, and its hazards' identifiers and labels (hazard, label_it, label_en), in lower case without blanks."""
    both = points.select(*ZONE, F.lower("name").alias("a")).union(hazards.select(*ZONE, F.explode(F.array(F.lower("hazard"), F.lower("label_it"), F.lower("label_en"))).alias("a")))
    return both.filter(text.filled(F.col("a"))).groupBy(*ZONE).agg(F.array_sort(F.collect_set("a")).alias("anchors"))


def priced(runs: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs (model_id, tokens_input, tokens_output) with cost_usd, by prices (price_in, price_out) of a million tokens; no model costs nothing. And the runs whose model has no price."""
    joined = runs.join(prices, "model_id", "left")
    cost = F.when(F.coalesce("model_id", F.lit("")) == "", 0.0).otherwise((F.col("tokens_input") * F.col("price_in") + F.col("tokens_output") * F.col("price_out")) / 1e6)
    unknown = (F.coalesce("model_id", F.lit("")) != "") & F.col("price_in").isNull()
    return joined.filter(~unknown).withColumn("cost_usd", cost).drop("price_in", "price_out"), joined.filter(unknown).drop("price_in", "price_out")


def run_metrics(graded_runs: DataFrame) -> DataFrame:
    """Metrics of a run as recorded: fallback where flagged; a run in error has zeros."""
    status = F.when(F.col("status") == "error", "error").when(F.col("fallback"), "fallback").otherwise("ok")
    out = graded_runs.withColumn("status", status)
    for m in METRICS:
        out = out.withColumn(m, F.when(F.col("status") == "error", F.lit(0).cast(out.schema[m].dataType)).otherwise(F.col(m)))
    return out


def folded(runs: DataFrame) -> DataFrame:
    """One row for each experiment and zone of repeated runs (run_id, status, the metrics, narrativa, snapshot_id): means and population deviations of the valid ones, their number and the others'.

    Latency is rounded half to even; without a valid run the status is error and all is zero. The narrative is the first filled one of the
    valid runs by file name, other fields those of the first valid run, or of the first run.
    """
    ok = ~excluded(F.col("status"))
    order = F.concat("run_id", F.lit(".json"))
    aggs = []
    for m in METRICS:
        mean, std = F.avg(F.when(ok, F.col(m).cast("double"))), F.stddev_pop(F.when(ok, F.col(m).cast("double")))
        aggs += [F.coalesce(F.bround(mean, 0) if m == "latency_ms" else mean, F.lit(0.0)).alias(m), F.coalesce(std, F.lit(0.0)).alias(f"std_{m}")]
    first = F.coalesce(F.min_by("snapshot_id", F.when(ok, order)), F.min_by("snapshot_id", order))
    return runs.groupBy("experiment", *ZONE).agg(
        *aggs, F.count_if(ok).alias("n_reps"), F.count_if(~ok).alias("n_dropped"), F.count_if(F.col("status") == "fallback").alias("n_fallback"),
        F.when(F.count_if(ok) > 0, "ok").otherwise("error").alias("status"), first.alias("snapshot_id"),
        F.coalesce(F.min_by("narrativa", F.when(ok & text.filled(F.col("narrativa")), order)), F.lit("")).alias("narrativa"),
    )


def twice(runs: DataFrame) -> DataFrame:
    """Zones with more than one record in an arm."""
    return runs.groupBy("experiment", *ZONE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def unpaired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Zones of one arm only: citta, zona, side."""
    za, zb = a.select(*ZONE).distinct(), b.select(*ZONE).distinct()
    return za.join(zb, ZONE, "left_anti").withColumn("side", F.lit("a")).union(zb.join(za, ZONE, "left_anti").withColumn("side", F.lit("b")))


def _side(arm: DataFrame, s: str) -> DataFrame:
    return arm.select(*ZONE, *[F.col(c).alias(f"{c}_{s}") for c in arm.columns if c not in ZONE])


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Zones of both arms: every column of a and b but the zone with _a and _b, same_input, compared (no arm's run is excluded), vacuous (arms that are silent though compared)."""
    both = _side(a, "a").join(_side(b, "b"), ZONE)
    out = both.withColumn("same_input", F.col("snapshot_id_a").eqNullSafe(F.col("snapshot_id_b"))).withColumn("compared", ~excluded(F.col("status_a")) & ~excluded(F.col("status_b")))
    silent = [F.when(F.col("compared") & ~text.filled(F.col(f"narrativa_{s}")), s) for s in "ab"]
    out = out.withColumn("vacuous", F.array_compact(F.array(*silent)))
    for m in METRICS:
        out = out.withColumn(f"delta_{m}", F.when(F.col("compared"), F.col(f"{m}_a") - F.col(f"{m}_b")))
    return out


def failed_zones(pairs: DataFrame) -> DataFrame:
    """Pairs that are not compared, with both statuses."""
    return pairs.filter("not compared").select(*ZONE, "status_a", "status_b")


def comparison(pairs: DataFrame) -> DataFrame:
    """The compared zones' metrics and deltas, and their means in a row MEDIA."""
    rows = pairs.filter("compared")
    cols = [f"{m}_{s}" for m in METRICS for s in "ab"] + [f"delta_{m}" for m in METRICS]
    agg = rows.groupingSets([["citta", "zona"], []], "citta", "zona").agg(F.grouping_id().alias("g"), *[F.avg(c).alias(c) for c in cols])
    return agg.select(F.when(F.col("g") > 0, "MEDIA").otherwise(F.col("citta")).alias("citta"), F.when(F.col("g") > 0, "").otherwise(F.col("zona")).alias("zona"), *cols)


def vacuous_arms(runs: DataFrame) -> DataFrame:
    """Arms none of whose runs, excluded ones too, has a narrative."""
    return runs.groupBy("experiment").agg(F.bool_or(text.filled(F.col("narrativa"))).alias("t")).filter("not t").select("experiment")


def repetition_range(folds: DataFrame) -> DataFrame:
    k = F.col("n_reps") + F.col("n_dropped")
    return folds.agg(F.min(k).alias("k_min"), F.max(k).alias("k_max"), F.min("n_reps").alias("valid_min"), F.max("n_reps").alias("valid_max"), (F.min(k) != F.max(k)).alias("heterogeneous"))


def verdict(means: DataFrame, label_a: str = "a", label_b: str = "b", keys: tuple[str, ...] = ()) -> DataFrame:
    """From each row of means (keys, metric_a, metric_b, withheld): winner, deciding_axis, chain and applicable. Means are compared at print precision, axis by axis; the first that is no tie decides."""
    outcome = {}
    for m, (digits, more) in AXES.items():
        a, b = F.bround(f"{m}_a", digits), F.bround(f"{m}_b", digits)
        outcome[m] = F.when(a == b, "tie").when((a > b) if more else (a < b), "a").otherwise("b")
    deciding = F.coalesce(*[F.when(o != "tie", m) for m, o in outcome.items()])
    steps = F.array(*[F.concat(F.lit(f"{m}:"), o) for m, o in outcome.items()])
    at = F.coalesce(*[F.when(o != "tie", i + 1) for i, o in enumerate(outcome.values())], F.lit(len(AXES)))
    who = F.coalesce(*[F.when(o != "tie", F.when(o == "a", label_a).otherwise(label_b)) for o in outcome.values()])
    hold = F.coalesce("withheld", F.lit(False))
    return means.select(*keys, F.when(~hold, who).alias("winner"), F.when(~hold, deciding).alias("deciding_axis"), F.slice(steps, F.lit(1), at).alias("chain"), (~hold).alias("applicable"))


def arms_verdict(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (), label_a: str = "a", label_b: str = "b") -> DataFrame:
    """The verdict on two arms of records (a zone's columns among keys give one for each of them): their means over the compared zones decide.

    It is withheld where an arm of a compared zone is silent, or where no record of a whole arm, excluded and unpaired ones too, has a
    narrative; an arm without records is not silent.
    """
    both = _side(a, "a").join(_side(b, "b"), ZONE, "full_outer")
    compared = F.coalesce(~excluded(F.col("status_a")) & ~excluded(F.col("status_b")), F.lit(False))
    told = {s: text.filled(F.col(f"narrativa_{s}")) for s in "ab"}
    mute = [(F.count(f"status_{s}") > 0) & ~F.bool_or(told[s]) for s in "ab"]
    mean = [F.coalesce(F.avg(F.when(compared, F.col(f"{m}_{s}"))), F.lit(0.0)).alias(f"{m}_{s}") for m in METRICS for s in "ab"]
    means = both.groupBy(*keys).agg(*mean, (F.coalesce(F.bool_or(compared & ~(told["a"] & told["b"])), F.lit(False)) | mute[0] | mute[1]).alias("withheld"))
    return verdict(means, label_a, label_b, keys)


def agreement(rows: DataFrame) -> DataFrame:
    """Of rows (proxy, gold; null: not annotated): n, n_total, Pearson's r (null for fewer than two or constant ones), mean absolute error, means."""
    p, g = F.when(F.col("gold").isNotNull(), F.col("proxy")), F.when(F.col("proxy").isNotNull(), F.col("gold"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    n = F.count(F.when(p.isNotNull() & g.isNotNull(), 1))
    r = F.when(n >= 2, F.try_divide(F.covar_pop(p, g), F.stddev_pop(p) * F.stddev_pop(g)))
    return rows.agg(n.alias("n"), F.count(F.lit(1)).alias("n_total"), r.alias("pearson"), zero(F.avg(F.abs(p - g))).alias("mae"), zero(F.avg(p)).alias("mean_proxy"), zero(F.avg(g)).alias("mean_gold"))


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    p, g = F.col("proxy") > threshold, F.col("gold") > threshold
    return rows.agg(F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn"))
