"""Inputs of the registered queries, derived from the driver's tables by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mapping import CLASS_OF, FAMILIES, GENERIC, SELECTORS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")
NS = "http://example.org/risk#"

_SELECTOR_ROWS = ", ".join(f"({i}, '{s}', '{s.split('=')[0]}', '{s.split('=')[1]}', {FAMILIES.index(s.split('=')[0]) if s in CLASS_OF else 99}, '{CLASS_OF.get(s, GENERIC)}')" for i, s in enumerate((*SELECTORS, "amenity=ice_cream", "leisure=park")))
SELECTOR = f"SELECT * FROM (VALUES {_SELECTOR_ROWS}) AS m(i, selector, family, val, family_rank, cls)"

#: V1. Elements: customers as nodes and suppliers as ways, so ids overlap; copies, missing coordinates, middles, names and tags by remainders.
ELEMENT = f"""
SELECT r.r_name AS citta, n.n_name AS zona, b.type, b.k AS id, c.copy, b.k * 2 + c.copy AS emit_pos,
  CASE WHEN b.k % 11 = 0 OR b.type = 'way' OR b.k % 13 = 1 THEN NULL ELSE 41 + ((b.k * 7919) % 10007) / 1e6 + c.copy * 5e-4 END AS lat,
  CASE WHEN b.k % 11 = 0 OR b.type = 'way' OR b.k % 13 = 1 THEN NULL ELSE 12 + ((b.k * 104729) % 10009) / 1e6 END AS lon,
  CASE WHEN b.k % 11 = 0 THEN NULL WHEN b.type = 'way' OR b.k % 13 = 1 THEN 41 + ((b.k * 7919) % 10007) / 1e6 + c.copy * 5e-4 END AS mid_lat,
  CASE WHEN b.k % 11 = 0 THEN NULL WHEN b.type = 'way' OR b.k % 13 = 1 THEN 12 + ((b.k * 104729) % 10009) / 1e6 END AS mid_lon,
  NOT (b.k % 26 = 0 AND c.copy = 0) AS tagged, s1.family AS f1, s1.val AS v1,
  CASE WHEN b.k % 3 = 0 AND s2.family <> s1.family THEN s2.family END AS f2, CASE WHEN b.k % 3 = 0 AND s2.family <> s1.family THEN s2.val END AS v2,
  CASE WHEN b.k % 5 = 0 THEN NULL WHEN b.k % 7 = 0 THEN '  ' ELSE concat('POI  --', CAST(b.k % 97 AS VARCHAR(9))) END AS poi_name
FROM (SELECT 'node' AS type, CAST(c_custkey AS BIGINT) AS k, c_nationkey AS nk FROM {{customer}} UNION ALL SELECT 'way', CAST(s_suppkey AS BIGINT), s_nationkey FROM {{supplier}}) b
JOIN (SELECT * FROM (VALUES (0), (1)) AS c(copy)) c ON c.copy = 0 OR b.k % 13 = 0
JOIN {{nation}} n ON n.n_nationkey = b.nk JOIN {{region}} r ON r.r_regionkey = n.n_regionkey
JOIN ({SELECTOR}) s1 ON s1.i = b.k % 67 JOIN ({SELECTOR}) s2 ON s2.i = (b.k * 7 + 3) % 67
"""

#: V1z. Zones with their raw boxes in the geocoder's order, and centers.
_degrees = lambda m: f"CAST(CAST(({m}) / 1e6 AS DECIMAL(10, 6)) AS VARCHAR(20))"
_LAT, _LON = "41001000 + 2000 * (n.n_nationkey % 5)", "12001000 + 2000 * CAST(floor(n.n_nationkey / 5) AS INT)"
ZONE = f"""
SELECT r.r_name AS citta, n.n_name AS zona, n.n_nationkey AS z, {_degrees(_LAT + " - 700")} AS s_lat, {_degrees(_LAT + " + 700")} AS n_lat,
  CASE WHEN n.n_nationkey = 24 THEN 'oops' ELSE {_degrees(_LON + " - 700")} END AS w_lon, {_degrees(_LON + " + 700")} AS e_lon
FROM {{nation}} n JOIN {{region}} r ON r.r_regionkey = n.n_regionkey
"""

#: V2. Triples: a hand-made sample, and parts below their brand below their type; fillers by size, some of them blank nodes; one cycle.
# Names of the ontology's classes, properties and fillers.
_SUB = [("Bank", "System"), ("Bank_branch", "System_aspect"), ("Archaeological_site", "System"), ("Petrol_station", "System"), ("Museum", "Public_building"), ("Public_building", "System"), ("Banknote_acceptor_theft", "Theft"), ("Theft", "Anthropic_hazard"), ("Loop_a", "Loop_b"), ("Loop_b", "Loop_a"), ("Railway_station", "Loop_a"), ("Historical_monument", "Archaeological_site"), ("School", "Public_building"), ("Kindergarten", "School")]
_REST = [
    ("Bank", "havingHazard", "Bank_robbery"), ("Bank", "havingHazard", "Customer_robbery"), ("Bank", "havingCriticalEvent", "Hostages"), ("Bank", "havingPerformer", "Bank_customer"), ("Bank", "isVulnerableTo", "Poor_surveillance"), ("Bank", "isVulnerableTo", "Bank_in_isolated_area"), ("Bank", "havingVulnerability", "Poor_surveillance"),
    ("Bank_branch", "havingVulnerability", "Poor_surveillance"), ("Archaeological_site", "havingHazard", "Terrorist_attack"), ("Archaeological_site", "havingHazard", "Theft_of_ancient_artifacts"), ("Archaeological_site", "havingPerformer", "Visitor"), ("Archaeological_site", "isVulnerableTo", "Archaeological_site_in_isolated_area"),
    ("Petrol_station", "havingHazard", "Banknote_acceptor_theft"), ("Public_building", "havingHazard", "Vandalism"), ("Public_building", "havingVulnerability", "Open_access"), ("Loop_b", "havingHazard", "Pickpocketing"), ("Loop_b", "havingCriticalEvent", "Overcrowding"), ("System", "havingPerformer", "Citizen"), ("School", "havingHazard", "Buiding_damage"),
]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)
SUBCLASS_ROW = f"""
SELECT * FROM (VALUES {_values(_SUB)}) AS s(cls, parent)
UNION ALL SELECT concat('P', CAST(p_partkey AS VARCHAR(12))), replace(p_brand, '#', '_') FROM {{part}} UNION ALL SELECT DISTINCT replace(p_brand, '#', '_'), p_type FROM {{part}}
"""
RESTRICTION_ROW = f"""
SELECT cls, prop, filler, 'iri' AS kind FROM (VALUES {_values(_REST)}) AS s(cls, prop, filler)
UNION ALL SELECT DISTINCT concat('P', CAST(p_partkey AS VARCHAR(12))), CASE p_size % 5 WHEN 0 THEN 'havingHazard' WHEN 1 THEN 'havingCriticalEvent' WHEN 2 THEN 'isVulnerableTo' WHEN 3 THEN 'havingVulnerability' ELSE 'havingPerformer' END,
  concat('F', CAST(p_size % 11 AS VARCHAR(12))), CASE WHEN p_size % 17 = 0 THEN 'bnode' ELSE 'iri' END FROM {{part}}
UNION ALL SELECT DISTINCT p_type, 'havingHazard', concat('Type_hazard_', CAST(p_size % 3 AS VARCHAR(12))), 'iri' FROM {{part}}
"""

#: V3. Runs: one for each line item; the arm is the line's status, the zone the customer's nation.
_RUN = """
SELECT concat(lower(l.l_linestatus), '__', lower(n.n_name), '__rep', lpad(CAST(l.l_orderkey AS VARCHAR(12)), 9, '0'), CAST(l.l_linenumber AS VARCHAR(4))) AS run_id, l.l_linestatus AS experiment, r.r_name AS citta, n.n_name AS zona,
  CASE l.l_returnflag WHEN 'A' THEN 'error' WHEN 'N' THEN 'ok' ELSE 'fallback' END AS status,
  1 - least(1.0, l.l_discount * 10) AS grounding, least(1.0, l.l_discount * 10) AS hallucination,
  CAST(floor(l.l_extendedprice) AS BIGINT) % 5000 AS latency_ms, l.l_tax / 100 AS cost_usd,
  CASE WHEN l.l_linenumber = 7 THEN '  ' ELSE concat('testo ', CAST(l.l_orderkey AS VARCHAR(12))) END AS narrativa,
  CASE WHEN n.n_nationkey = 3 THEN concat('snap_', l.l_linestatus) ELSE n.n_name END AS snapshot_id,
  CASE l.l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN 'model-a' WHEN 2 THEN 'model-b' ELSE 'model-x' END AS model_id, CAST(l.l_quantity * 1000 AS BIGINT) AS tokens_input, CAST(l.l_quantity * 100 AS BIGINT) AS tokens_output
FROM LINES JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
WHERE NOT (n.n_nationkey = 5 AND l.l_linestatus = 'F')
"""
RUN = _RUN.replace("LINES", "{lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey")
#: The same rows for Spark, which joins in the order written: customers meet orders first, so lines, of which there are most, are shuffled once.
RUN_BY_ORDER = _RUN.replace("LINES", "{lineitem} l JOIN (SELECT o.o_orderkey, k.c_nationkey FROM {orders} o JOIN {customer} k ON k.c_custkey = o.o_custkey) c ON c.o_orderkey = l.l_orderkey")

#: V4. Narratives: all turns of a conversation in order, the first, the odd and the other even ones under header lines; the zone is a nation's, and some name a hazard or a point.
NARRATIVE = """
SELECT c.conv_id, r.r_name AS citta, n.n_name AS zona,
  concat(coalesce(c.first_turn, ''), CASE WHEN c.conv_id % 5 = 0 THEN '' ELSE '\nRischi da ontologia [ONTOLOGIA]\n' END, coalesce(c.odd, ''),
    CASE c.conv_id % 4 WHEN 0 THEN '. Qui vandalism e altro' WHEN 1 THEN concat('.\nPresso POI  --', CAST(c.conv_id % 97 AS VARCHAR(9)), ' di sera') ELSE '' END,
    CASE WHEN c.conv_id % 3 = 0 THEN '\nRischi [SPECULATIVO] e [CONTESTO] insieme\n' ELSE '\nRischi dal contesto [CONTESTO]\n' END, coalesce(c.even, '')) AS narrativa
FROM (SELECT conv_id, {first_turn} AS first_turn, {odd} AS odd, {even} AS even FROM {conversations} GROUP BY conv_id) c
JOIN {nation} n ON n.n_nationkey = c.conv_id % 25 JOIN {region} r ON r.r_regionkey = n.n_regionkey
"""
_TURNS = {"first_turn": "turn = 0", "odd": "turn % 2 = 1", "even": "turn % 2 = 0 AND turn > 0"}
_SPARK_TURNS = {k: f"array_join(transform(array_sort(collect_list(CASE WHEN {c} THEN struct(turn, text) END)), x -> x.text), ' ')" for k, c in _TURNS.items()}
_DUCKDB_TURNS = {k: f"string_agg(text, ' ' ORDER BY turn, text) FILTER (WHERE {c})" for k, c in _TURNS.items()}

#: V5. Proxy and human marks of documents; unlabelled ones are not annotated.
GOLD = """
SELECT d.doc_id, least(1.0, d.n_chars / 5000.0E0) AS proxy, CAST(l.q AS DOUBLE) AS gold
FROM {documents} d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM {labels} GROUP BY doc_id) l ON l.doc_id = d.doc_id
"""

#: V7. Contexts (views) and requests (clicks) of users; the hash is the parity of the event's property.
_PROP = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
CONTEXT = f"SELECT event_id AS context_id, concat(' User_', CAST(user_id AS VARCHAR(12)), ' ') AS zone_name, ts AS stored_at, CAST({_PROP} % 2 AS VARCHAR(2)) AS contesto_hash, event_id % 3 AS m FROM {{events}} WHERE event_type = 'view'"
REQUEST = f"SELECT event_id AS request_id, concat('user_', CAST(user_id AS VARCHAR(12))) AS zone_name, ts AS requested_at, CAST({_PROP} % 2 AS VARCHAR(2)) AS contesto_hash, CAST(event_id % 4 AS VARCHAR(2)) AS poi_id FROM {{events}} WHERE event_type = 'click'"


def for_duckdb(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES}, **_DUCKDB_TURNS)


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.format(**{t: "{" + t + "}" for t in TABLES}, **_SPARK_TURNS) if "{odd}" in sql else sql, **used)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1 as elements: citta, zona, type, id, lat, lon, center, tags, emit_pos."""
    v = view(spark, sf_dir, ELEMENT)
    pairs = F.array_compact(F.array(*[F.when(k.isNotNull() & x.isNotNull(), F.struct(k.alias("k"), x.alias("v"))) for k, x in ((F.col("f1"), F.col("v1")), (F.col("f2"), F.col("v2")), (F.lit("name"), F.col("poi_name")))]))
    return v.select("citta", "zona", "type", "id", "lat", "lon", F.struct(F.col("mid_lat").alias("lat"), F.col("mid_lon").alias("lon")).alias("center"), F.when(F.col("tagged"), F.map_from_entries(pairs)).alias("tags"), "emit_pos")


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1z: citta, zona, boundingbox."""
    return view(spark, sf_dir, ZONE).select("citta", "zona", F.array("s_lat", "n_lat", "w_lon", "e_lon").alias("boundingbox"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: s, p, o, s_kind, o_kind."""
    sub, rest = view(spark, sf_dir, SUBCLASS_ROW), view(spark, sf_dir, RESTRICTION_ROW)
    ns = lambda c: F.concat(F.lit(NS), F.col(c))
    node = F.concat(F.lit("_:"), F.concat_ws("-", "cls", "prop", "filler"))
    row = lambda df, s, p, o, sk="iri", ok="iri": df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(sk).alias("s_kind"), (ok if not isinstance(ok, str) else F.lit(ok)).alias("o_kind"))
    names = sub.select("cls").union(sub.select("parent")).distinct()
    out = row(names.filter("cls <> 'System_aspect'"), ns("cls"), "rdf:type", F.lit("owl:Class")).unionAll(row(sub, ns("cls"), "rdfs:subClassOf", ns("parent")))
    out = out.unionAll(row(rest, ns("cls"), "rdfs:subClassOf", node, ok="bnode")).unionAll(row(rest, node, "rdf:type", F.lit("owl:Restriction"), sk="bnode"))
    return out.unionAll(row(rest, node, "owl:onProperty", ns("prop"), sk="bnode")).unionAll(row(rest, node, "owl:someValuesFrom", ns("filler"), sk="bnode", ok=F.col("kind")))


#: V6. Boundaries: squares over the patch of V1, with a hole, in two parts, and one far away.
def _ring(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


POLYGONS = {
    "AFRICA": [[_ring(12.0005, 41.0005, 12.0095, 41.0095), _ring(12.004, 41.004, 12.006, 41.006)]],
    "AMERICA": [[_ring(11.9, 40.9, 12.1, 41.1)]],
    "ASIA": [[_ring(12.0, 41.0, 12.004, 41.01)], [_ring(12.006, 41.0, 12.0101, 41.01)]],
    "EUROPE": [[_ring(13.0, 45.0, 13.1, 45.1)]],
}


def boundaries(spark: SparkSession) -> DataFrame:
    rows = [(c, [[[{"lon": x, "lat": y} for x, y in ring] for ring in rings] for rings in polygons]) for c, polygons in POLYGONS.items()]
    return spark.createDataFrame(rows, "citta string, polygons array<array<array<struct<lon: double, lat: double>>>>")


LABELS = [("Bank_robbery", "Bank robbery", "Rapina in banca", "hazard"), ("Customer_robbery", "Customer robbery", "", "hazard"), ("Vandalism", "", "", "hazard"), ("Pickpocketing", "Pickpocketing", "Borseggio", "hazard"), ("Bank", "Bank", "Banca", "poi"), ("Museum", "Museum", "", "poi"), ("Poor_surveillance", "", "Sorveglianza scarsa", "vulnerability")]


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "identifier string, label_en string, label_it string, category string")
