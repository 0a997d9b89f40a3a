"""Queries over runs, narratives, human marks, boundaries and requests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import context, coverage, evaluation, grounding, ontology
from ..operators.requests import rejected
from ..sources import records
from . import views
from .poi_queries import ALL, EL, ENGLISH, LABEL, US, ZO, boxes, points, risks, stored_risks, tagged_hazards
from .registry import query
from .views import for_duckdb

RU = f"ru AS ({for_duckdb(views.RUN)})"
FO = RU + """, fo AS (SELECT experiment, citta, zona, coalesce(avg(grounding) FILTER (WHERE status = 'ok'), 0) AS grounding, coalesce(avg(hallucination) FILTER (WHERE status = 'ok'), 0) AS hallucination,
  coalesce(round_even(avg(latency_ms) FILTER (WHERE status = 'ok'), 0), 0) AS latency_ms, coalesce(avg(cost_usd) FILTER (WHERE status = 'ok'), 0) AS cost_usd,
  coalesce(stddev_pop(grounding) FILTER (WHERE status = 'ok'), 0) AS std_grounding, coalesce(stddev_pop(latency_ms) FILTER (WHERE status = 'ok'), 0) AS std_latency_ms,
  count(*) FILTER (WHERE status = 'ok') AS n_reps, count(*) FILTER (WHERE status <> 'ok') AS n_dropped, count(*) FILTER (WHERE status = 'fallback') AS n_fallback,
  CASE WHEN count(*) FILTER (WHERE status = 'ok') > 0 THEN 'ok' ELSE 'error' END AS status, coalesce(arg_min(snapshot_id, run_id || '.json') FILTER (WHERE status = 'ok'), arg_min(snapshot_id, run_id || '.json')) AS snapshot_id,
  coalesce(arg_min(narrativa, run_id || '.json') FILTER (WHERE status = 'ok' AND regexp_matches(narrativa, '[^\\s]')), '') AS narrativa FROM ru GROUP BY ALL)"""
_M = ("grounding", "hallucination", "latency_ms", "cost_usd")
PA = FO + ", pa AS (SELECT a.citta, a.zona, " + ", ".join(f"a.{m} AS {m}_a, b.{m} AS {m}_b, a.{m} - b.{m} AS delta_{m}" for m in _M) + ", a.snapshot_id = b.snapshot_id AS same_input, a.status = 'ok' AND b.status = 'ok' AS compared, a.narrativa = '' OR b.narrativa = '' AS silent FROM fo a JOIN fo b USING (citta, zona) WHERE a.experiment = 'O' AND b.experiment = 'F')"
_R = {"grounding": 6, "hallucination": 6, "latency_ms": 3, "cost_usd": 9}


def runs(spark, sf_dir):
    return views.view(spark, sf_dir, views.RUN_BY_ORDER)


def pairs(spark, sf_dir):
    f = evaluation.folded(runs(spark, sf_dir))
    return evaluation.paired(f.filter("experiment = 'O'"), f.filter("experiment = 'F'"))


def bround(digits):
    return [F.bround(c, d).alias(c) for c, d in digits.items()]


@query(f"WITH {RU} SELECT experiment, status IN ('error', 'fallback') AS excluded, regexp_matches(run_id, '__rep\\d{{2,}}$') AS repeated, regexp_matches(narrativa, '[^\\s]') AS has_text, count(*) AS n FROM ru GROUP BY ALL")
def p14_p15_p16_predicates(spark, sf_dir):
    """Excluded statuses, filled narratives, repetition marks."""
    return runs(spark, sf_dir).groupBy("experiment", evaluation.excluded(F.col("status")).alias("excluded"), evaluation.repeated(F.col("run_id")).alias("repeated"), text.filled(F.col("narrativa")).alias("has_text")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FO} SELECT experiment, citta, zona, round_even(grounding, 6) AS grounding, round_even(hallucination, 6) AS hallucination, latency_ms, round_even(cost_usd, 9) AS cost_usd, round_even(std_grounding, 6) AS std_grounding, round_even(std_latency_ms, 3) AS std_latency_ms, n_reps, n_dropped, n_fallback, status, snapshot_id, narrativa FROM fo")
def a14_a15_folded(spark, sf_dir):
    """Repetitions folded by zone, with the representative narrative and snapshot."""
    f = evaluation.folded(runs(spark, sf_dir))
    return f.select("experiment", "citta", "zona", *bround({"grounding": 6, "hallucination": 6}), "latency_ms", *bround({"cost_usd": 9, "std_grounding": 6, "std_latency_ms": 3}), "n_reps", "n_dropped", "n_fallback", "status", "snapshot_id", "narrativa")


@query(f"WITH {RU} SELECT experiment, citta, zona, count(*) AS n FROM ru GROUP BY ALL HAVING count(*) > 1")
def a16_duplicate_zones(spark, sf_dir):
    """Zones with several records in an arm."""
    return evaluation.twice(runs(spark, sf_dir))


@query(f"WITH {RU}, z AS (SELECT DISTINCT experiment, citta, zona FROM ru) SELECT citta, zona, CASE WHEN count(*) FILTER (WHERE experiment = 'O') = 1 THEN 'a' ELSE 'b' END AS side FROM z GROUP BY citta, zona HAVING count(*) = 1")
def j10_u1_unpaired(spark, sf_dir):
    """Zones of one arm only."""
    r = runs(spark, sf_dir)
    return evaluation.unpaired(r.filter("experiment = 'O'"), r.filter("experiment = 'F'"))


@query(f"WITH {PA} SELECT citta, zona, same_input, compared, compared AND silent AS vacuous, " + ", ".join(f"CASE WHEN compared THEN round_even(delta_{m}, {_R[m]}) END AS delta_{m}" for m in _M) + " FROM pa")
def j11_a17_a20_a21_pairs(spark, sf_dir):
    """Paired zones, input check, deltas, failed and vacuous ones."""
    return pairs(spark, sf_dir).select("citta", "zona", "same_input", "compared", (F.size("vacuous") > 0).alias("vacuous"), *bround({f"delta_{m}": d for m, d in _R.items()}))


@query(f"WITH {RU}, o AS (SELECT *, row_number() OVER (PARTITION BY experiment, citta, zona ORDER BY run_id, status) AS rep FROM ru) SELECT citta, zona || '__rep' || rep AS zona, a.status AS status_a, b.status AS status_b FROM o a JOIN o b USING (citta, zona, rep) WHERE a.experiment = 'O' AND b.experiment = 'F' AND (a.status <> 'ok' OR b.status <> 'ok')")
def a20_failed_zones(spark, sf_dir):
    """Of all runs, repetition by repetition of a zone in both arms, those of which either is excluded, with both statuses."""
    rep = F.row_number().over(Window.partitionBy("experiment", "citta", "zona").orderBy("run_id", "status"))
    rows = runs(spark, sf_dir).withColumn("zona", F.concat("zona", F.lit("__rep"), rep.cast("string")))
    return evaluation.failed_zones(evaluation.paired(rows.filter("experiment = 'O'"), rows.filter("experiment = 'F'")))


_COLS = [(f"{m}_{s}", _R[m]) for m in _M for s in "ab"] + [(f"delta_{m}", _R[m]) for m in _M]


@query(f"WITH {PA} SELECT coalesce(citta, 'MEDIA') AS citta, coalesce(zona, '') AS zona, " + ", ".join(f"round_even(avg({c}), {d}) AS {c}" for c, d in _COLS) + " FROM pa WHERE compared GROUP BY GROUPING SETS ((citta, zona), ())")
def a18_a19_w10_comparison(spark, sf_dir):
    """The comparison table with its row of means, sorted."""
    return evaluation.comparison(pairs(spark, sf_dir)).select("citta", "zona", *bround(dict(_COLS))).orderBy("citta", "zona")


@query(f"WITH {PA} SELECT experiment, vacuous, k_min, k_max, valid_min, valid_max, k_min <> k_max AS heterogeneous FROM (SELECT experiment, NOT bool_or(regexp_matches(narrativa, '[^\\s]')) AS vacuous FROM ru GROUP BY experiment), (SELECT min(n_reps + n_dropped) AS k_min, max(n_reps + n_dropped) AS k_max, min(n_reps) AS valid_min, max(n_reps) AS valid_max FROM fo)")
def a21_a22_arms(spark, sf_dir):
    """Vacuous arms and the range of repetitions."""
    r = runs(spark, sf_dir)
    arms = r.select("experiment").distinct().join(evaluation.vacuous_arms(r).withColumn("v", F.lit(True)), "experiment", "left").select("experiment", F.coalesce("v", F.lit(False)).alias("vacuous"))
    return arms.join(F.broadcast(evaluation.repetition_range(evaluation.folded(r))), F.lit(True))


_OUT = {m: f"CASE WHEN round_even({m}_a, {d}) = round_even({m}_b, {d}) THEN 'tie' WHEN round_even({m}_a, {d}) {op} round_even({m}_b, {d}) THEN 'a' ELSE 'b' END" for m, d, op in (("hallucination", 3, "<"), ("grounding", 3, ">"), ("latency_ms", 0, "<"), ("cost_usd", 6, "<"))}


_MEAN = ", ".join(f"coalesce(avg(a.{m}) FILTER (WHERE {{ok}}), 0) AS {m}_a, coalesce(avg(b.{m}) FILTER (WHERE {{ok}}), 0) AS {m}_b" for m in _M).format(ok="coalesce(a.status = 'ok' AND b.status = 'ok', false)")


@query(f"WITH {FO}, a AS (SELECT * FROM fo WHERE experiment = 'O'), b AS (SELECT * FROM fo WHERE experiment = 'F'), m AS (SELECT coalesce(citta, 'tutte') AS citta, {_MEAN}, coalesce(bool_or(a.status = 'ok' AND b.status = 'ok' AND (a.narrativa = '' OR b.narrativa = '')), false) OR (count(a.status) > 0 AND max(a.narrativa) = '') OR (count(b.status) > 0 AND max(b.narrativa) = '') AS hold FROM a FULL JOIN b USING (citta, zona) GROUP BY GROUPING SETS ((citta), ())), z AS (SELECT citta, hold, " + ", ".join(f"{x} AS o{i}" for i, x in enumerate(_OUT.values())) + """ FROM m)
SELECT citta, CASE WHEN NOT hold THEN CASE WHEN o0 <> 'tie' THEN o0 WHEN o1 <> 'tie' THEN o1 WHEN o2 <> 'tie' THEN o2 WHEN o3 <> 'tie' THEN o3 END END AS winner,
CASE WHEN NOT hold THEN CASE WHEN o0 <> 'tie' THEN 'hallucination' WHEN o1 <> 'tie' THEN 'grounding' WHEN o2 <> 'tie' THEN 'latency_ms' WHEN o3 <> 'tie' THEN 'cost_usd' END END AS deciding_axis,
'hallucination:' || o0 || CASE WHEN o0 = 'tie' THEN ',grounding:' || o1 || CASE WHEN o1 = 'tie' THEN ',latency_ms:' || o2 || CASE WHEN o2 = 'tie' THEN ',cost_usd:' || o3 ELSE '' END ELSE '' END ELSE '' END AS chain, NOT hold AS applicable FROM z""")
def a23_a24_verdicts(spark, sf_dir):
    """The verdict on the arms' means, over all zones and over each city's; withheld where a compared zone or a whole arm is silent."""
    f = evaluation.folded(runs(spark, sf_dir))
    a, b = f.filter("experiment = 'O'"), f.filter("experiment = 'F'")
    every = evaluation.arms_verdict(a, b).withColumn("citta", F.lit("tutte"))
    return evaluation.arms_verdict(a, b, ("citta",)).unionByName(every).select("citta", "winner", "deciding_axis", F.array_join("chain", ",").alias("chain"), "applicable")


@query(f"WITH g AS ({for_duckdb(views.GOLD)}) SELECT count(gold) AS n, count(*) AS n_total, round_even(covar_pop(proxy, gold) / nullif(stddev_pop(proxy) FILTER (WHERE gold IS NOT NULL) * stddev_pop(gold), 0), 6) AS pearson, round_even(avg(abs(proxy - gold)), 6) AS mae, round_even(avg(proxy) FILTER (WHERE gold IS NOT NULL), 6) AS mean_proxy, round_even(avg(gold), 6) AS mean_gold FROM g")
def a25_a26_agreement(spark, sf_dir):
    """Correlation and error of a proxy against human marks, unmarked documents counted."""
    a = evaluation.agreement(views.view(spark, sf_dir, views.GOLD))
    return a.select("n", "n_total", *bround({"pearson": 6, "mae": 6, "mean_proxy": 6, "mean_gold": 6}))


@query(f"WITH g AS ({for_duckdb(views.GOLD)}) SELECT count(*) FILTER (WHERE proxy > 0.25 AND gold > 0.25) AS tp, count(*) FILTER (WHERE proxy > 0.25 AND gold <= 0.25) AS fp, count(*) FILTER (WHERE proxy <= 0.25 AND gold > 0.25) AS fn, count(*) FILTER (WHERE proxy <= 0.25 AND gold <= 0.25) AS tn FROM g")
def a27_confusion(spark, sf_dir):
    """Confusion matrix at a strict threshold."""
    return evaluation.confusion(views.view(spark, sf_dir, views.GOLD), 0.25)


@query(f"WITH {RU}, p(model_id, pin, pout) AS (VALUES ('model-a', 3.0, 15.0), ('model-b', 1.0, 2.0)) SELECT experiment, model_id, model_id <> '' AND pin IS NULL AS unpriced, count(*) AS n, CASE WHEN model_id = '' OR pin IS NOT NULL THEN round_even(sum(CASE WHEN model_id = '' THEN 0 ELSE (tokens_input * pin + tokens_output * pout) / 1e6 END), 6) END AS cost FROM ru LEFT JOIN p USING (model_id) GROUP BY experiment, model_id, pin, pout")
def j14_f14_costs(spark, sf_dir):
    """Cost of runs by model; models without a price apart."""
    prices = spark.createDataFrame([("model-a", 3.0, 15.0), ("model-b", 1.0, 2.0)], "model_id string, price_in double, price_out double")
    known, unknown = evaluation.priced(runs(spark, sf_dir).drop("cost_usd"), prices)
    count = F.count(F.lit(1)).alias("n")
    a = known.groupBy("experiment", "model_id").agg(count, F.bround(F.sum("cost_usd"), 6).alias("cost")).withColumn("unpriced", F.lit(False))
    return a.unionByName(unknown.groupBy("experiment", "model_id").agg(count).withColumn("cost", F.lit(None).cast("double")).withColumn("unpriced", F.lit(True)))


NA = f"na AS ({for_duckdb(views.NARRATIVE)})"
_TOKENS = (("ontologia", "[ONTOLOGIA]"), ("contesto", "[CONTESTO]"), ("speculativo", "[SPECULATIVO]"))
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
BL = NA + ", tk AS (SELECT conv_id, t.name, t.k, t.mark, instr(narrativa, t.mark) AS mk, narrativa FROM na, (VALUES ('ontologia', 1, '[ONTOLOGIA]'), ('contesto', 2, '[CONTESTO]'), ('speculativo', 3, '[SPECULATIVO]')) AS t(name, k, mark) WHERE instr(narrativa, t.mark) > 0), ls AS (SELECT *, length(regexp_extract(substr(narrativa, 1, mk - 1), '^(?s:.*)\\n')) AS line, CASE WHEN instr(substr(narrativa, mk), chr(10)) = 0 THEN length(narrativa) ELSE mk - 1 + instr(substr(narrativa, mk), chr(10)) END AS body FROM tk), bl AS (SELECT conv_id, name, line, body, " + _STRIP.format(x="substr(narrativa, body + 1, greatest(coalesce(lead(line) OVER (PARTITION BY conv_id ORDER BY line, k), length(narrativa)) - body, 0))") + " AS content FROM ls)"


def narratives(spark, sf_dir):
    return views.view(spark, sf_dir, views.NARRATIVE)


@query(f"WITH {BL} SELECT n.conv_id, {_STRIP.format(x='substr(n.narrativa, 1, coalesce((SELECT min(line) FROM bl b WHERE b.conv_id = n.conv_id), length(n.narrativa)))')} AS overview, " + ", ".join(f"coalesce((SELECT content FROM bl b WHERE b.conv_id = n.conv_id AND b.name = '{k}'), '') AS {k}" for k, _ in _TOKENS) + " FROM na n")
def f8_source_blocks(spark, sf_dir):
    """F8: a narrative's overview and blocks."""
    return narratives(spark, sf_dir).select("conv_id", text.blocks(F.col("narrativa")).alias("b")).select("conv_id", "b.*")


def anchors(spark, sf_dir):
    """Of each zone: names of the selected points, and their hazards with both labels."""
    r = stored_risks(spark, sf_dir)
    hazards = r.select("citta", "zona", F.explode("risks.hazard").alias("hazard")).distinct()
    both = ontology.labelled(hazards, "hazard", views.vocabulary(spark)).withColumn("label_en", text.english(F.col("hazard")))
    return evaluation.anchor_sets(r, both)


AN = f"ha AS (SELECT DISTINCT g.citta, g.zona, ci.filler AS hazard FROM gr g JOIN ci ON ci.cls = g.cls AND axis = 'hazards'), an AS (SELECT citta, zona, list(DISTINCT a) AS an FROM (SELECT citta, zona, lower(name) AS a FROM gr UNION ALL SELECT citta, zona, unnest([lower(hazard), lower({LABEL.format(x='hazard')}), lower({ENGLISH.format(x='hazard')})]) FROM ha) WHERE regexp_matches(a, '[^\\s]') GROUP BY citta, zona)"


@query(ALL + f", {AN} SELECT citta, zona, array_to_string(list_sort(an), '|') AS anchors FROM an")
def u5_anchor_sets(spark, sf_dir):
    """The anchor set of each zone."""
    return anchors(spark, sf_dir).select("citta", "zona", F.array_join("anchors", "|").alias("anchors"))


@query(ALL + f", {AN}, {BL}, s AS (SELECT n.conv_id, n.narrativa, coalesce(an.an, []) AS an, list_filter(list_transform(regexp_split_to_array(coalesce((SELECT content FROM bl b WHERE b.conv_id = n.conv_id AND b.name = 'ontologia'), ''), '[.\\n]'), lambda x: lower({_STRIP.format(x='x')})), lambda x: x <> '') AS se FROM na n LEFT JOIN an USING (citta, zona)), h AS (SELECT *, NOT regexp_matches(narrativa, '[^\\s]') OR len(an) = 0 AS vacuous, len(list_filter(se, lambda x: len(list_filter(an, lambda a: contains(x, a))) > 0)) AS hits FROM s) SELECT conv_id, round_even(CASE WHEN vacuous THEN 1.0 WHEN len(se) = 0 THEN 0.0 ELSE hits / len(se) END, 6) AS grounding, round_even(CASE WHEN vacuous THEN 0.0 WHEN len(se) = 0 THEN 1.0 ELSE (len(se) - hits) / len(se) END, 6) AS hallucination FROM h")
def f7_u5_a29_graded(spark, sf_dir):
    """Shares of ontology sentences that name an anchor of their zone, and that do not."""
    return evaluation.graded(narratives(spark, sf_dir), anchors(spark, sf_dir)).select("conv_id", F.bround("grounding", 6).alias("grounding"), F.bround("hallucination", 6).alias("hallucination"))


@query(ALL + f", t AS (SELECT s.citta, s.zona, CASE WHEN s.position % 4 = 0 THEN 'ALTRO' WHEN s.position % 3 = 0 THEN 'SPECULATIVO' WHEN s.position % 3 = 1 THEN 'CONTESTO' ELSE 'ONTOLOGIA' END AS tag, s.position * 100 + row_number() OVER (PARTITION BY s.citta, s.zona, s.position ORDER BY ci.filler) AS p, ci.filler AS hazard FROM gr s JOIN ci ON ci.cls = s.cls AND axis = 'hazards'), g AS (SELECT citta, zona, tag, string_agg(hazard, ',' ORDER BY p) AS hazards FROM t GROUP BY citta, zona, tag), {BL}, gn AS (SELECT g.*, na.conv_id FROM g LEFT JOIN na USING (citta, zona)), pr3 AS (SELECT n.citta, n.zona, n.conv_id, upper(b.name) AS tag, content AS prose FROM bl b JOIN na n USING (conv_id)) SELECT citta, zona, conv_id, tag, coalesce({_STRIP.format(x='prose')}, '') AS text, coalesce(hazards, '') AS hazards, CASE tag WHEN 'ONTOLOGIA' THEN 1 WHEN 'CONTESTO' THEN 2 ELSE 3 END AS tab_rank FROM gn FULL JOIN pr3 USING (citta, zona, conv_id, tag) WHERE tag <> 'ALTRO' AND (regexp_matches(coalesce(prose, ''), '[^\\s]') OR hazards IS NOT NULL)")
def a9_source_tabs(spark, sf_dir):
    """Of every narrative the tabs of the three tags that have prose in its blocks, or hazards in its zone; prose of white space is none, other tags have no tab."""
    b = narratives(spark, sf_dir).select("citta", "zona", "conv_id", "narrativa", text.blocks(F.col("narrativa")).alias("b"))
    has = lambda mark: F.instr("narrativa", mark) > 0
    rows = b.select("citta", "zona", "conv_id", F.explode(F.array_compact(F.array(*[F.when(has(mark), F.struct(F.lit(k.upper()).alias("tag"), F.col(f"b.{k}").alias("text"))) for k, mark in _TOKENS]))).alias("x"))
    hazards = tagged_hazards(spark, sf_dir).join(b.select("citta", "zona", "conv_id"), ["citta", "zona"], "left")
    tabs = grounding.tabs(hazards, rows.select("citta", "zona", "conv_id", "x.*"), ("citta", "zona", "conv_id"))
    return tabs.select("citta", "zona", "conv_id", "tag", "text", F.array_join("hazards", ",").alias("hazards"), "tab_rank")


@query(f"WITH {RU} SELECT run_id, CASE WHEN status = 'error' THEN 'error' WHEN status = 'fallback' THEN 'fallback' ELSE 'ok' END AS status, CASE WHEN status = 'error' THEN 0 ELSE round_even(grounding, 6) END AS grounding, CASE WHEN status = 'error' THEN 0 ELSE round_even(hallucination, 6) END AS hallucination, CASE WHEN status = 'error' THEN 0 ELSE latency_ms END AS latency_ms, CASE WHEN status = 'error' THEN 0 ELSE round_even(cost_usd, 9) END AS cost_usd FROM ru")
def a30_run_metrics(spark, sf_dir):
    """Metrics as recorded; a run in error has zeros."""
    r = evaluation.run_metrics(runs(spark, sf_dir).withColumn("fallback", F.col("status") == "fallback"))
    return r.select("run_id", "status", *bround({"grounding": 6, "hallucination": 6}), "latency_ms", *bround({"cost_usd": 9}))


_SLUG = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_FLAT = "regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g'), '-{{2,}}', '- -', 'g')"


@query(f"WITH {RU}, d AS (SELECT DISTINCT experiment, citta, zona, model_id, ' ' || replace(model_id, '-', ' ---' || chr(9)) AS question, chr(9) || zona || ' ' AS typed FROM ru) SELECT experiment, citta, zona, model_id, {_SLUG.format(x='experiment')} || '__' || {_SLUG.format(x='citta')} || '__' || {_SLUG.format(x='zona')} || '__rep0' || CAST(length(zona) % 10 AS VARCHAR) AS run_id, CASE WHEN regexp_matches(question, '[^\\s]') THEN sha256(zona || chr(30) || {_FLAT.format(x='question')}) ELSE zona END AS prompt_hash, lower({_STRIP.format(x='typed')}) AS zone_key FROM d")
def f11_f13_f16_keys(spark, sf_dir):
    """Run ids of slugs, prompt hash with and without a question, zone key."""
    r = runs(spark, sf_dir).select("experiment", "citta", "zona", "model_id").distinct()
    question = F.concat(F.lit(" "), F.replace(F.col("model_id"), F.lit("-"), F.lit(" ---\t")))
    return r.select("experiment", "citta", "zona", "model_id", text.run_id(F.col("experiment"), F.col("citta"), F.col("zona"), F.length("zona") % 10).alias("run_id"), context.prompt_hash(F.col("zona"), question).alias("prompt_hash"), text.key(F.concat(F.lit("\t"), "zona", F.lit(" "))).alias("zone_key"))


@query(f"WITH {EL} SELECT DISTINCT poi_name, {_FLAT.format(x='poi_name')} AS flat, CAST(ceil(length(poi_name) / 3.0) AS BIGINT) AS tokens FROM el WHERE poi_name IS NOT NULL UNION ALL SELECT text, {_FLAT.format(x='text')}, CAST(ceil(length(text) / 3.0) AS BIGINT) FROM conversations")
def f9_f10_flattened(spark, sf_dir):
    """names and turns on one line without runs of hyphens, and their estimate in tokens."""
    names = views.view(spark, sf_dir, views.ELEMENT).select("poi_name").filter("poi_name is not null").distinct()
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("text").alias("poi_name"))
    return names.union(turns).select("poi_name", text.flattened(F.col("poi_name")).alias("flat"), text.tokens(F.col("poi_name")).alias("tokens"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 OR c_name IS NULL THEN 'citta vuota' WHEN c_custkey % 7 = 0 THEN 'zona vuota' WHEN length(c_name) * (c_custkey % 13) > 100 THEN 'citta troppo lunga' WHEN length(c_name) * (c_custkey % 17) > 200 THEN 'zona troppo lunga' WHEN c_custkey % 600 > 500 THEN 'domanda troppo lunga' END AS reason FROM customer")
def f17_validated(spark, sf_dir):
    """inputs and the first reason why they are rejected."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.col("c_custkey").cast("int").alias("k"))
    citta = F.when(F.col("k") % 11 == 0, " \t").otherwise(F.repeat("c_name", F.col("k") % 13))
    zona = F.when(F.col("k") % 7 == 0, "").otherwise(F.repeat("c_name", F.col("k") % 17))
    citta, zona = (F.when((F.col("k") % m == 0) & (F.col("k") % d != 0), F.col("c_name")).otherwise(x) for x, m, d in ((citta, 13, 11), (zona, 17, 7)))
    return c.select("c_custkey", rejected(citta, zona, F.repeat(F.lit("x"), F.col("k") % 600)).alias("reason"))


CX = f"cx AS ({for_duckdb(views.CONTEXT)}), rq AS ({for_duckdb(views.REQUEST)})"


@query(f"WITH {CX}, x AS (SELECT lower(trim(zone_name)) AS z, stored_at, arg_max(context_id, context_id) AS context_id, arg_max(contesto_hash, context_id) AS h, arg_max(m, context_id) AS m FROM cx GROUP BY ALL), j AS (SELECT r.request_id, r.contesto_hash, r.poi_id, r.requested_at, x.context_id, x.stored_at, x.h, x.m FROM rq r ASOF LEFT JOIN x ON lower(trim(r.zone_name)) = x.z AND r.requested_at >= x.stored_at) SELECT request_id, CASE WHEN fresh THEN context_id END AS context_id, CASE WHEN NOT fresh THEN 'not_found' WHEN contesto_hash <> h THEN 'conflict' WHEN CAST(poi_id AS BIGINT) <= m THEN 'ok' ELSE 'not_found' END AS outcome FROM (SELECT *, stored_at IS NOT NULL AND epoch_us(requested_at) - epoch_us(stored_at) <= 1800000000 AS fresh FROM j)")
def j16_j17_as_of(spark, sf_dir):
    """The context of each request as of its time, and the outcome."""
    contexts = views.view(spark, sf_dir, views.CONTEXT).withColumn("zone_key", text.key(F.col("zone_name"))).withColumn("poi_ids", F.transform(F.sequence(F.lit(0), F.col("m").cast("int")), lambda x: x.cast("string")))
    requests = views.view(spark, sf_dir, views.REQUEST).withColumn("zone_key", text.key(F.col("zone_name")))
    return context.outcomes(context.as_of(requests, contexts)).select("request_id", F.col("context.context_id").alias("context_id"), "outcome")


def _sql_ring(ring):
    n = len(ring)
    sides = [f"CAST(CASE WHEN ({ring[i][1]} > lat) <> ({ring[i - 1][1]} > lat) AND lon < ({ring[i - 1][0]} - {ring[i][0]}) * (lat - {ring[i][1]}) / nullif({ring[i - 1][1]} - {ring[i][1]}, 0) + {ring[i][0]} THEN 1 ELSE 0 END AS INT)" for i in range(n)]
    return f"(({' + '.join(sides)}) % 2 = 1)"


_IN = "CASE citta " + " ".join(f"WHEN '{c}' THEN " + " OR ".join("(" + _sql_ring(rings[0]) + "".join(f" AND NOT {_sql_ring(h)}" for h in rings[1:]) + ")" for rings in polygons) for c, polygons in views.POLYGONS.items()) + " ELSE false END"


@query(f"WITH {ZO}, b AS (SELECT n.n_nationkey % 5 AS k, zb.* FROM zb JOIN nation n ON n.n_name = zb.zona), g AS (SELECT citta, zona, k IN (0, 1, 4) AS accepted, CASE k WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 1 THEN 2 END AS n_polygons, CASE k WHEN 0 THEN 4 WHEN 4 THEN 4 WHEN 1 THEN 8 END AS n_points, CASE WHEN k IN (0, 1, 4) THEN round_even(x0, 6) END AS min_lon, CASE WHEN k IN (0, 4) THEN round_even(y1, 6) WHEN k = 1 THEN round_even(y1 + 1, 6) END AS max_lat FROM b) SELECT * FROM g")
def f5_geojson_polygons(spark, sf_dir):
    """polygons of GeoJSON texts; other types, and points that are none, are rejected."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("zona"), (F.col("n_nationkey") % 5).cast("int").alias("k"))
    b = boxes(spark, sf_dir).join(nation, "zona").select("citta", "zona", "k", "bbox.*")

    def ring(up):
        corner = lambda x, y: F.format_string("[%.9f, %.9f]", F.col(x), F.col(y) + up)
        return F.concat(F.lit("[["), F.concat_ws(", ", corner("min_lon", "min_lat"), corner("max_lon", "min_lat"), corner("max_lon", "max_lat"), corner("min_lon", "max_lat")), F.lit("]]"))

    shape = lambda kind, coordinates: F.concat(F.lit(f'{{"type": "{kind}", "coordinates": '), coordinates, F.lit("}"))
    two = shape("MultiPolygon", F.concat(F.lit("["), ring(0), F.lit(", "), ring(1), F.lit("]")))
    k = F.col("k")
    geometry = F.when(k == 1, two).when(k == 2, shape("Point", F.lit("[12.0, 41.0]"))).when(k == 3, shape("Polygon", F.regexp_replace(ring(0), "41", "x"))).otherwise(shape("Polygon", ring(0)))
    read = b.select("citta", "zona", geo.polygons_of(geometry).alias("p"))
    corners = F.flatten(F.flatten("p"))
    return read.select("citta", "zona", F.col("p").isNotNull().alias("accepted"), F.when(F.col("p").isNotNull(), F.size("p")).alias("n_polygons"), F.when(F.col("p").isNotNull(), F.size(corners)).alias("n_points"), F.bround(F.array_min(F.transform(corners, lambda c: c["lon"])), 6).alias("min_lon"), F.bround(F.array_max(F.transform(corners, lambda c: c["lat"])), 6).alias("max_lat"))


@query(f"WITH {US} SELECT citta, zona, type, id, {_IN} AS inside FROM po")
def j13_f6_in_boundary(spark, sf_dir):
    """Points within their city's boundary."""
    return coverage.inside(points(spark, sf_dir), views.boundaries(spark)).select("citta", "zona", "type", "id", "inside")


@query(f"WITH {US} SELECT citta, zona, type, id, {_IN} AS inside FROM po")
def j13_f6_vectorised(spark, sf_dir):
    """J13 with the helper for boundaries of many vertices."""
    return coverage.inside_vectorised(points(spark, sf_dir), views.boundaries(spark)).select("citta", "zona", "type", "id", "inside")


_DECL = "('Bank', 'Museum', 'School', 'Petrol_station', 'Railway_station')"
CI = US + f""", {ZO}, sh AS (SELECT citta, count(*) AS n_pois, avg(CASE WHEN cls IN {_DECL} THEN 1.0 ELSE 0 END) AS verbatim, avg(CASE WHEN cls <> 'GenericUrbanPOI' THEN 1.0 ELSE 0 END) AS derived, avg(CASE WHEN {_IN} THEN 1.0 ELSE 0 END) AS boundary FROM po GROUP BY citta),
bx AS (SELECT citta, min(y0) AS y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM zb GROUP BY citta),
rc AS (SELECT r_name AS citta, r_regionkey * 2000 AS switch_ms, y1 > y0 AND CASE WHEN r_regionkey = 3 THEN x0 ELSE x1 END > x0 AS bbox_valid, coalesce(n_pois, 0) AS n_pois, coalesce(verbatim, 0) AS verbatim, coalesce(derived, 0) AS derived, coalesce(boundary, 0) AS boundary FROM region LEFT JOIN sh ON sh.citta = r_name JOIN bx ON bx.citta = r_name WHERE r_regionkey < 4),
rp AS (SELECT citta, switch_ms, bbox_valid, n_pois, round_even(verbatim, 6) AS verbatim, round_even(derived, 6) AS derived, round_even(boundary, 6) AS boundary, verbatim >= 0.5 AND derived >= 0.7 AND boundary >= 0.9 AND switch_ms < 5000 AS pass_all, false AS failed FROM rc UNION ALL SELECT r_name, NULL, NULL, NULL, NULL, NULL, NULL, false, true FROM region WHERE r_regionkey = 4)"""


def city_report(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    extent = boxes(spark, sf_dir).groupBy("citta").agg(*[f(f"bbox.{c}").alias(c) for c, f in (("min_lat", F.min), ("min_lon", F.min), ("max_lat", F.max), ("max_lon", F.max))])
    east = F.when(F.col("r_regionkey") == 3, F.col("min_lon")).otherwise(F.col("max_lon"))  # one city's box has no width
    box = geo.box(F.col("min_lat"), F.col("min_lon"), F.col("max_lat"), east)
    captures = region.filter("r_regionkey < 4").withColumnRenamed("r_name", "citta").join(extent, "citta").select("citta", (F.col("r_regionkey") * 2000).alias("switch_ms"), box.alias("bbox"))
    declared = spark.createDataFrame([(c.strip("'"),) for c in _DECL.strip("()").split(", ")], "terminus_class string")
    records_ = coverage.city_records(coverage.inside(points(spark, sf_dir), views.boundaries(spark)), declared, captures)
    return coverage.city_report(records_, region.filter("r_regionkey = 4").select(F.col("r_name").alias("citta")))


@query(f"WITH {CI} SELECT * FROM rp")
def a10_a11_a12_u3_city_report(spark, sf_dir):
    """Coverage shares, pass marks, failed cities."""
    return city_report(spark, sf_dir).select("citta", "switch_ms", "bbox_valid", "n_pois", *bround({"verbatim": 6, "derived": 6, "boundary": 6}), "pass_all", "failed")


@query(f"WITH {CI} SELECT count(*) AS n_cities, count(*) FILTER (WHERE pass_all) AS n_pass_all, count(*) FILTER (WHERE failed) AS n_failed FROM rp")
def a13_city_summary(spark, sf_dir):
    """Cities, passes and failures."""
    return coverage.report_summary(city_report(spark, sf_dir))


@query(f"WITH {PA} SELECT citta, zona, round_even(grounding_a, 3) AS grounding_a, round_even(hallucination_a, 3) AS hallucination_a, round_even(latency_ms_a, 0) AS latency_ms_a, round_even(cost_usd_a, 6) AS cost_usd_a FROM pa WHERE compared")
def s9_report_digits(spark, sf_dir):
    """Measures at print precision."""
    return records.rounded(pairs(spark, sf_dir).filter("compared").select("citta", "zona", "grounding_a", "hallucination_a", "latency_ms_a", "cost_usd_a"))
