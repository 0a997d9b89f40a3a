"""Queries over elements, zones and triples: reading, selecting, grounding, counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.mapping import GENERIC, mapping
from ..operators import context, grounding, nearest, ontology, poi
from ..sources import payload
from ..sources.stored import stored
from . import views
from .registry import query
from .views import for_duckdb

_HAV = "2 * 6371008.8 * asin(sqrt(least(1.0, power(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * power(sin((radians({b_lon} - {a_lon})) / 2), 2))))"

#: Common table expressions of the SQL side.
EL = f"el AS ({for_duckdb(views.ELEMENT)}), sel AS ({views.SELECTOR})"
ZO = f"zo AS (SELECT citta, zona, TRY_CAST(s_lat AS DOUBLE) AS y0, TRY_CAST(n_lat AS DOUBLE) AS y1, TRY_CAST(w_lon AS DOUBLE) AS x0, TRY_CAST(e_lon AS DOUBLE) AS x1 FROM ({for_duckdb(views.ZONE)})), zb AS (SELECT citta, zona, least(y0, (y0 + y1) / 2 - 0.0045) AS y0, least(x0, (x0 + x1) / 2 - 0.0045) AS x0, greatest(y1, (y0 + y1) / 2 + 0.0045) AS y1, greatest(x1, (x0 + x1) / 2 + 0.0045) AS x1 FROM zo WHERE x0 IS NOT NULL)"
US = EL + f""", us AS (
  SELECT citta, zona, type, id, emit_pos, coalesce(lat, mid_lat) AS lat, coalesce(lon, mid_lon) AS lon, coalesce(poi_name, '') AS name,
    coalesce((SELECT arg_min(s.selector, s.family_rank) FROM sel s WHERE s.family_rank < 99 AND s.selector IN (f1 || '=' || v1, f2 || '=' || v2)), '') AS osm_tags, f1 || '=' || v1 AS s1, f2 || '=' || v2 AS s2
  FROM el WHERE tagged AND coalesce(lat, mid_lat) IS NOT NULL),
po AS (SELECT u.*, coalesce(s.cls, '{GENERIC}') AS cls FROM (SELECT *, row_number() OVER (PARTITION BY citta, zona, type, id ORDER BY emit_pos) AS r FROM us) u LEFT JOIN sel s ON s.selector = u.osm_tags AND s.family_rank < 99 WHERE r = 1)"""
DI = f"""di AS (SELECT p.*, {_HAV.format(a_lat="(z.y0 + z.y1) / 2", a_lon="(z.x0 + z.x1) / 2", b_lat="p.lat", b_lon="p.lon")} AS dist FROM po p JOIN zb z USING (citta, zona)),
sl AS (SELECT *, row_number() OVER (PARTITION BY citta, zona ORDER BY dist, CAST(id AS VARCHAR), type, emit_pos) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY citta, zona ORDER BY k > 3, dist, CAST(id AS VARCHAR), type, emit_pos) AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY citta, zona, cls ORDER BY dist, CAST(id AS VARCHAR), type, emit_pos) AS k FROM di)) WHERE q <= 20)"""
RE = f"""sb AS (SELECT DISTINCT * FROM ({for_duckdb(views.SUBCLASS_ROW)})), rr AS (SELECT DISTINCT * FROM ({for_duckdb(views.RESTRICTION_ROW)})),
cl AS (SELECT cls AS c, cls AS a FROM (SELECT cls FROM sb UNION SELECT parent FROM sb) UNION SELECT cl.c, sb.parent FROM cl JOIN sb ON sb.cls = cl.a),
pr(prop, k, axis) AS (VALUES ('havingHazard', 1, 'hazards'), ('havingCriticalEvent', 2, 'critical_events'), ('isVulnerableTo', 3, 'vulnerabilities'), ('havingVulnerability', 4, 'vulnerabilities'), ('havingPerformer', 5, 'stakeholders')),
fi AS (SELECT DISTINCT cl.c AS cls, rr.prop, rr.filler FROM cl JOIN rr ON rr.cls = cl.a WHERE rr.kind = 'iri'),
ci AS (SELECT f.cls, p.axis, f.filler, min(p.k) AS k, f.cls || ' → ' || arg_min(f.prop, p.k) || ' → ' || f.filler AS source FROM fi f JOIN pr p USING (prop) GROUP BY f.cls, p.axis, f.filler)"""
GR = f"""gr AS (SELECT s.*, coalesce((SELECT count(*) FROM ci WHERE ci.cls = s.cls AND axis = 'hazards'), 0) AS n_risks, CASE WHEN regexp_matches(name, '[^\\s]') THEN 'verificato' ELSE 'da_confermare' END AS conf FROM sl s)"""
ALL = f"WITH RECURSIVE {US}, {ZO}, {DI}, {RE}, {GR} "


def points(spark, sf_dir):
    """Classified points of all zones, one for each element."""
    return poi.classified(poi.first_of_each(poi.usable(views.elements(spark, sf_dir))))


def boxes(spark, sf_dir):
    z = views.zones(spark, sf_dir)
    parsed = z.select("citta", "zona", geo.parsed_box(F.col("boundingbox")).alias("raw")).filter("raw is not null")
    return parsed.select("citta", "zona", geo.least_box(F.col("raw")).alias("bbox"))


def selection(spark, sf_dir):
    lat, lon = geo.center(F.col("bbox"))
    return poi.selected(points(spark, sf_dir), boxes(spark, sf_dir).select("citta", "zona", lat.alias("lat0"), lon.alias("lon0")))


def fillers(spark, sf_dir, classes=None):
    t = stored(views.triples(spark, sf_dir), "triples")
    return ontology.inherited(ontology.ancestors(t, classes), ontology.restrictions(t)[0])


def profiled(spark, sf_dir):
    """Selected points, and the fillers of their classes only."""
    chosen = stored(selection(spark, sf_dir), "selection")
    return chosen, fillers(spark, sf_dir, chosen.select("terminus_class").distinct())


def risks(spark, sf_dir):
    return grounding.nested(*profiled(spark, sf_dir))


def stored_risks(spark, sf_dir):
    """For queries that use them more than once."""
    return stored(risks(spark, sf_dir), "risks")


def labels_of(rows, column, spark):
    """Italian labels of an array of identifiers, by a small map."""
    known = {r["identifier"]: r["label_it"] or r["label_en"] for r in views.vocabulary(spark).collect() if r["label_it"] or r["label_en"]}
    lookup = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return rows.withColumn("labels", F.transform(column, lambda h: F.coalesce(lookup[h], text.display(h))))


LABEL = "CASE {x} " + " ".join(f"WHEN '{i}' THEN '{it or en}'" for i, en, it, _ in views.LABELS if it or en) + " ELSE upper(substr(trim(replace({x}, '_', ' ')), 1, 1)) || substr(trim(replace({x}, '_', ' ')), 2) END"


ENGLISH = "CASE {x} WHEN 'Brank_branch' THEN 'Branch robbery' WHEN 'Buiding_damage' THEN 'Building damage' ELSE upper(substr(trim(replace({x}, '_', ' ')), 1, 1)) || substr(trim(replace({x}, '_', ' ')), 2) END"


@query(f"WITH {EL} SELECT citta, zona, type, id, emit_pos, coalesce(lat, mid_lat) AS lat, coalesce(lon, mid_lon) AS lon, coalesce(poi_name, '') AS name FROM el WHERE tagged AND coalesce(lat, mid_lat) IS NOT NULL")
def s1_p1_p2_payload_elements(spark, sf_dir):
    """Payload texts to usable elements; an element that is no object is skipped."""
    return poi.usable(payload.elements(payloads(views.elements(spark, sf_dir)), "payload", ["citta", "zona"])).select("citta", "zona", "type", "id", "emit_pos", "lat", "lon", "name")


def payloads(elements):
    """Texts of a zone's elements of a thousand ids each, so that none grows with the table."""
    return elements.groupBy("citta", "zona", F.expr("id div 1000").alias("part")).agg(F.to_json(F.struct(F.collect_list(F.struct("type", "id", "lat", "lon", "center", "tags", "emit_pos")).alias("elements"))).alias("payload"))


@query(f"WITH {EL} SELECT DISTINCT citta, zona, id // 1000 AS part FROM el WHERE (id // 1000) % 3 <> 0")
def s1_rejected_payloads(spark, sf_dir):
    """Payload texts without a list of elements are put aside."""
    part = F.col("part")
    spoilt = F.when(part % 3 == 1, F.concat(F.lit('{"elementi": '), F.get_json_object("payload", "$.elements"), F.lit("}"))).when(part % 3 == 2, F.substring("payload", 2, 40)).otherwise(F.col("payload"))
    return payload.rejects(payloads(views.elements(spark, sf_dir)).withColumn("payload", spoilt), "payload").select("citta", "zona", "part")


@query(f"WITH {US} SELECT citta, zona, type, id, osm_tags, cls AS terminus_class FROM po")
def p3_p4_w1_classified(spark, sf_dir):
    """Representative tag, class, first usable occurrence."""
    return points(spark, sf_dir).select("citta", "zona", "type", "id", "osm_tags", "terminus_class")


_PRINT = "sha256(string_agg(selector, chr(10) ORDER BY selector)) AS selectors_hash, count(*) AS n_selectors"


@query(f"WITH {EL}, b AS (SELECT selector FROM sel WHERE family_rank < 99), u AS (SELECT DISTINCT selector FROM (SELECT f1 || '=' || v1 AS selector FROM el UNION ALL SELECT f2 || '=' || v2 FROM el) JOIN b USING (selector)) SELECT 'binding' AS of, {_PRINT} FROM b UNION ALL SELECT 'used' AS of, {_PRINT} FROM u")
def p5_selector_fingerprint(spark, sf_dir):
    """P5: hash of the binding's selectors, and of those of them that elements carry in any of their tags."""
    tags = views.elements(spark, sf_dir).filter("tags is not null").select(F.explode("tags").alias("k", "v")).union(views.view(spark, sf_dir, views.ELEMENT).filter("not tagged").select(F.explode(F.map_from_arrays(F.array("f1", F.coalesce("f2", F.lit("-"))), F.array("v1", F.coalesce("v2", F.lit("-")))))))
    binding = mapping(spark).select("selector")
    used = tags.select(F.concat_ws("=", "k", "v").alias("selector")).distinct().join(binding, "selector", "left_semi")
    one = lambda rows, name: poi.fingerprint_of_selectors(rows).select(F.lit(name).alias("of"), "selectors_hash", "n_selectors")
    return one(binding, "binding").union(one(used, "used"))


@query(f"WITH {US} SELECT CASE WHEN regexp_matches(name, '[^\\s]') THEN 'verificato' ELSE 'da_confermare' END AS level, cls AS terminus_class, count(*) AS n FROM po WHERE cls = 'Bank' GROUP BY ALL")
def p6_p8_levels_of_class(spark, sf_dir):
    """Evidence level by name, one class."""
    return poi.of_class(points(spark, sf_dir), " Bank ").groupBy(poi.evidence(F.col("name")).alias("level"), "terminus_class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ZO} SELECT citta, zona, round_even(y0, 6) AS min_lat, round_even(x0, 6) AS min_lon, round_even(y1, 6) AS max_lat, round_even(x1, 6) AS max_lon, round_even((y0 + y1) / 2, 6) AS lat, round_even((x0 + x1) / 2, 6) AS lon, true AS valid, x1 > 12.0049 AS flat_valid FROM zb")
def p10_p13_boxes(spark, sf_dir):
    """Parsed, widened boxes, their middles and validity, also of boxes of which some have no height; a box that is no box is dropped."""
    b = F.col("bbox")
    flat = geo.box(b["min_lat"], b["min_lon"], F.when(b["max_lon"] > 12.0049, b["max_lat"]).otherwise(b["min_lat"]), b["max_lon"])
    lat, lon = geo.center(b)
    return boxes(spark, sf_dir).select("citta", "zona", *[F.bround(b[c], 6).alias(c) for c in ("min_lat", "min_lon", "max_lat", "max_lon")], F.bround(lat, 6).alias("lat"), F.bround(lon, 6).alias("lon"), geo.valid_box(b).alias("valid"), geo.valid_box(flat).alias("flat_valid"))


@query(f"WITH {US}, {ZO} SELECT z.citta, z.zona, p.type, p.id FROM po p JOIN zb z ON p.lat BETWEEN z.y0 AND z.y1 AND p.lon BETWEEN z.x0 AND z.x1")
def j1_points_in_boxes(spark, sf_dir):
    """Every point with every zone whose box holds it."""
    p = points(spark, sf_dir).select("type", "id", "lat", "lon")
    return poi.in_boxes(p, boxes(spark, sf_dir)).select("citta", "zona", "type", "id")


@query(f"WITH {US}, x AS (SELECT citta, zona, type, id, unnest([s1, s2]) AS selector FROM us), y AS (SELECT DISTINCT * FROM x WHERE selector IS NOT NULL) SELECT DISTINCT citta, zona, type, id FROM (SELECT *, row_number() OVER (PARTITION BY citta, zona, selector ORDER BY type, id) AS r FROM y) WHERE r <= 10")
def w2_capped_by_selector(spark, sf_dir):
    """At most ten of a selector in a zone; any selector may keep a point."""
    e = poi.first_of_each(poi.usable(views.elements(spark, sf_dir)))
    own = F.filter(F.transform(F.map_entries("tags"), lambda t: F.concat_ws("=", t["key"], t["value"])), lambda s: ~s.startswith("name="))
    return poi.capped_by_selector(e.withColumn("selectors", own))


@query(f"WITH {US}, {ZO}, {DI} SELECT citta, zona, type, id, cls AS terminus_class, position, round_even(dist, 3) AS dist FROM sl")
def w3_f1_p19_selected(spark, sf_dir):
    """The nearest points under the class cap, numbered by distance."""
    return selection(spark, sf_dir).select("citta", "zona", "type", "id", "terminus_class", "position", F.bround("dist", 3).alias("dist"))


@query(f"WITH RECURSIVE {RE} SELECT cls AS terminus_class, prop, filler, kind = 'iri' AS used FROM rr")
def s7_j2_j3_restrictions(spark, sf_dir):
    """Restrictions out of triples, and those that are dropped."""
    return ontology.restriction_rows(views.triples(spark, sf_dir))


@query(f"WITH RECURSIVE {RE} SELECT c AS terminus_class, a AS ancestor FROM cl")
def j4_ancestors(spark, sf_dir):
    """Reflexive, transitive ancestors; a cycle ends."""
    return ontology.ancestors(views.triples(spark, sf_dir))


@query(f"WITH RECURSIVE {RE} SELECT cls AS terminus_class, prop, filler FROM fi")
def j5_inherited(spark, sf_dir):
    """Fillers of each class and its ancestors."""
    return fillers(spark, sf_dir)


_AXIS = "coalesce((SELECT list(filler ORDER BY filler) FROM ci WHERE ci.cls = n.cls AND axis = '{a}'), [])"


@query(f"WITH RECURSIVE {RE}, n AS (SELECT cls FROM sb UNION SELECT parent FROM sb) SELECT cls AS terminus_class, array_to_string({_AXIS.format(a='hazards')}, ',') AS hazards, array_to_string({_AXIS.format(a='critical_events')}, ',') AS critical_events, array_to_string({_AXIS.format(a='vulnerabilities')}, ',') AS vulnerabilities, array_to_string({_AXIS.format(a='stakeholders')}, ',') AS stakeholders, array_to_string(coalesce((SELECT list(source ORDER BY k, filler) FROM ci WHERE ci.cls = n.cls), []), ',') AS sparql_paths FROM n")
def a6_u2_n12_profiles(spark, sf_dir):
    """Wide profiles, empty for classes without restrictions; paths by property."""
    t = views.triples(spark, sf_dir)
    names = views.view(spark, sf_dir, views.SUBCLASS_ROW)
    classes = names.select(F.col("cls").alias("terminus_class")).union(names.select("parent"))
    wide = ontology.profiles(fillers(spark, sf_dir), classes)
    return wide.select("terminus_class", *[F.array_join(c, ",").alias(c) for c in wide.columns[1:]])


@query(f"WITH RECURSIVE {RE}, {US}, n AS (SELECT cls FROM sb UNION SELECT parent FROM sb) SELECT cls AS terminus_class, cls IN (SELECT cls FROM sel WHERE family_rank < 99) AS mapped FROM n WHERE cls <> 'System_aspect'")
def p17_u4_declared(spark, sf_dir):
    """Declared classes, and whether a selector maps to them."""
    d = ontology.declared(views.triples(spark, sf_dir))
    return d.join(poi.uncovered(d).withColumn("un", F.lit(True)), "terminus_class", "left").select("terminus_class", F.col("un").isNull().alias("mapped"))


@query(ALL + "SELECT s.citta, s.zona, s.type, s.id, ci.axis, ci.filler, ci.source, s.conf AS confidence FROM gr s LEFT JOIN ci ON ci.cls = s.cls")
def j6_j7_f4_grounded(spark, sf_dir):
    """Points with their class's fillers, each with its citation."""
    g = grounding.grounded(*profiled(spark, sf_dir))
    return g.select("citta", "zona", "type", "id", "axis", "filler", "source", "confidence")


@query(ALL + ", t AS (SELECT DISTINCT cls FROM gr), x AS (SELECT t.cls, h.filler FROM t, (VALUES ('Vandalism'), ('Type_hazard_0'), ('Bank_robbery')) AS h(filler)) SELECT x.cls AS terminus_class, x.filler, coalesce(ci.source, x.cls || ' → havingHazard → ' || x.filler) AS source FROM x LEFT JOIN ci ON ci.cls = x.cls AND ci.filler = x.filler AND ci.axis = 'hazards'")
def j7_cited_risks(spark, sf_dir):
    """Risks named for a class with the path of its profile, else one made of the axis' first property."""
    chosen, own = profiled(spark, sf_dir)
    named_risks = chosen.select("terminus_class").distinct().withColumn("filler", F.explode(F.array(*map(F.lit, ("Vandalism", "Type_hazard_0", "Bank_robbery")))))
    return grounding.cited_risks(named_risks, grounding.citations(own), "hazards", "havingHazard").select("terminus_class", "filler", "source")


@query(ALL + "SELECT citta, zona, type, id, n_risks, CASE WHEN n_risks > 0 THEN conf END AS confidence, coalesce((SELECT string_agg(filler || '|' || source, ',' ORDER BY filler) FROM ci WHERE ci.cls = gr.cls AND axis = 'hazards'), '') AS risks, coalesce((SELECT string_agg(filler, ',' ORDER BY filler) FROM ci WHERE ci.cls = gr.cls AND axis = 'vulnerabilities'), '') AS vulnerabilities, (SELECT arg_min(source, filler) FROM ci WHERE ci.cls = gr.cls AND axis = 'hazards') AS sparql_path FROM gr")
def a7_p7_nested(spark, sf_dir):
    """Risks nested by point, its path and level."""
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return risks(spark, sf_dir).select("citta", "zona", "type", "id", F.size("risks").cast("long").alias("n_risks"), "confidence", joined("risks", lambda r: F.concat_ws("|", r["hazard"], r["source"])).alias("risks"), joined("vulnerabilities", lambda v: v["name"]).alias("vulnerabilities"), "sparql_path")


@query(ALL + "SELECT citta, zona, count(*) AS n_pois, count(DISTINCT cls) AS n_classes FROM gr GROUP BY ALL")
def a1_retrieval_stats(spark, sf_dir):
    """A1: points and classes of each zone."""
    return grounding.retrieval_stats(selection(spark, sf_dir))


@query(ALL + "SELECT citta, zona, CAST(sum(CASE WHEN conf = 'verificato' THEN n_risks ELSE 0 END) AS BIGINT) AS verificato, CAST(sum(CASE WHEN conf = 'da_confermare' THEN n_risks ELSE 0 END) AS BIGINT) AS da_confermare, CAST(sum(CASE WHEN position % 4 = 0 THEN 0 ELSE n_risks END) AS BIGINT) AS anchored, CAST(sum(n_risks) AS BIGINT) AS total, count(*) FILTER (WHERE n_risks > 0 AND conf = 'verificato') AS pois_verificato, count(*) FILTER (WHERE n_risks > 0 AND conf = 'da_confermare') AS pois_da_confermare FROM gr GROUP BY ALL")
def a2_a3_a4_confidence(spark, sf_dir):
    """A2 to A4: risks and points by level; anchored ones, where every fourth point's are tagged as context."""
    retagged = F.when(F.col("position") % 4 == 0, F.transform("risks", lambda r: r.withField("tag", F.lit(grounding.CONTEXT)))).otherwise(F.col("risks"))
    return grounding.confidence_summary(risks(spark, sf_dir).withColumn("risks", retagged))


@query(ALL + "SELECT citta, zona, count(*) AS shown, any_value(total) - count(*) AS hidden FROM (SELECT *, count(*) OVER (PARTITION BY citta, zona) AS total FROM gr) WHERE n_risks > 0 AND conf = 'verificato' GROUP BY citta, zona")
def p9_confidence_filter(spark, sf_dir):
    """Points of one level, and how many are hidden."""
    r = stored_risks(spark, sf_dir)
    n = r.groupBy("citta", "zona").agg(F.count(F.lit(1)).alias("n"))
    return grounding.with_confidence(r, "verificato").groupBy("citta", "zona").agg(F.count(F.lit(1)).alias("shown")).join(n, ["citta", "zona"]).select("citta", "zona", "shown", (F.col("n") - F.col("shown")).alias("hidden"))


@query(ALL + "SELECT s.citta, s.zona, s.type, s.id, s.name, ci.filler AS hazard, 'tc:' || s.cls AS category, s.conf AS confidence FROM gr s JOIN ci ON ci.cls = s.cls AND axis = 'hazards'")
def p18_j9_base_table(spark, sf_dir):
    """One row for each point and hazard, joined back by id."""
    r = stored_risks(spark, sf_dir)
    return grounding.risks_of_points(grounding.base_table(r).drop("name"), r).select("citta", "zona", "type", "id", "name", "hazard", "category", "confidence")


@query(ALL + ", t AS (SELECT s.citta, s.zona, CASE WHEN s.position % 4 = 0 THEN 'ALTRO' WHEN s.position % 3 = 0 THEN 'SPECULATIVO' WHEN s.position % 3 = 1 THEN 'CONTESTO' ELSE 'ONTOLOGIA' END AS tag, s.position * 100 + row_number() OVER (PARTITION BY s.citta, s.zona, s.position ORDER BY ci.filler) AS p, ci.filler AS hazard FROM gr s JOIN ci ON ci.cls = s.cls AND axis = 'hazards') SELECT citta, zona, tag, string_agg(hazard, ',' ORDER BY p) AS hazards, CASE tag WHEN 'ONTOLOGIA' THEN 1 WHEN 'CONTESTO' THEN 2 WHEN 'SPECULATIVO' THEN 3 ELSE 4 END AS tag_rank FROM t GROUP BY citta, zona, tag")
def a8_by_tag(spark, sf_dir):
    """Hazards by source tag, a missing tag is speculative."""
    return tagged_hazards(spark, sf_dir).select("citta", "zona", "tag", F.array_join("hazards", ",").alias("hazards"), "tag_rank")


def tagged_hazards(spark, sf_dir):
    r = risks(spark, sf_dir).select("citta", "zona", "position", F.posexplode("risks").alias("k", "r"))
    p = F.col("position")
    tag = F.when(p % 4 == 0, "ALTRO").when(p % 3 == 0, F.when(p % 2 == 0, "").otherwise(None)).when(p % 3 == 1, "CONTESTO").otherwise("ONTOLOGIA")
    return grounding.by_tag(r.select("citta", "zona", tag.alias("tag"), (p * 100 + F.col("k") + 1).alias("position"), F.col("r.hazard").alias("hazard")))


@query(ALL + "SELECT citta, zona, round_even(min(lat), 6) AS min_lat, round_even(max(lat), 6) AS max_lat, round_even(min(lon), 6) AS min_lon, round_even(max(lon), 6) AS max_lon FROM gr GROUP BY ALL")
def a28_envelope(spark, sf_dir):
    """Extent of a zone's points."""
    return poi.envelope(selection(spark, sf_dir)).select("citta", "zona", *[F.bround(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


_PID = "a.type || '/' || a.id"


@query(ALL + f", pr2 AS (SELECT a.citta, a.zona, a.type || '/' || a.id AS poi_id, b.type || '/' || b.id AS neighbour_id, {_HAV.format(a_lat='a.lat', a_lon='a.lon', b_lat='b.lat', b_lon='b.lon')} AS d FROM gr a JOIN gr b ON a.citta = b.citta AND a.zona = b.zona AND (a.type, a.id) <> (b.type, b.id)) SELECT citta, zona, poi_id, r AS rank, neighbour_id, CAST(round_even(d, 0) AS BIGINT) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY citta, zona, poi_id ORDER BY d, neighbour_id) AS r FROM pr2) WHERE r <= 5")
def j12_w4_neighbours(spark, sf_dir):
    """The five nearest of each selected point."""
    return context.neighbours(named(selection(spark, sf_dir)))


@query(f"WITH {US}, pr2 AS (SELECT a.citta, a.zona, a.type || '/' || a.id AS poi_id, b.type || '/' || b.id AS neighbour_id, {_HAV.format(a_lat='a.lat', a_lon='a.lon', b_lat='b.lat', b_lon='b.lon')} AS d FROM po a JOIN po b ON a.citta = b.citta AND a.zona = b.zona AND (a.type, a.id) <> (b.type, b.id)) SELECT citta, zona, poi_id, r AS rank, neighbour_id, CAST(round_even(d, 0) AS BIGINT) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY citta, zona, poi_id ORDER BY d, neighbour_id) AS r FROM pr2) WHERE r <= 5")
def j12_w4_unselected(spark, sf_dir):
    """The five nearest of each of all a zone's points."""
    return nearest.neighbours_of_many(named(points(spark, sf_dir)))


def named(points):
    return points.withColumn("id", F.concat_ws("/", "type", F.col("id").cast("string")))


@query(ALL + f", lb AS (SELECT citta, zona, {LABEL.format(x='cls')} AS label, count(*) AS n, sum(count(*)) OVER (PARTITION BY citta, zona) AS total FROM gr GROUP BY citta, zona, label), tp AS (SELECT *, row_number() OVER (PARTITION BY citta, zona ORDER BY n DESC, label) AS r FROM lb) SELECT z.citta, z.zona, coalesce(any_value(CAST(CAST(total AS BIGINT) AS VARCHAR)) || ' punti di interesse selezionati fra i piu'' vicini al centro della zona; classi piu'' frequenti fra questi: ' || string_agg(label || ' (' || n || ')', ', ' ORDER BY r) || '.', '0 punti di interesse selezionati nel contesto della zona.') AS summary FROM (SELECT r_name AS citta, n_name AS zona FROM nation JOIN region ON r_regionkey = n_regionkey) z LEFT JOIN (SELECT * FROM tp WHERE r <= 3) t USING (citta, zona) GROUP BY z.citta, z.zona")
def a5_w5_j8_composition(spark, sf_dir):
    """A zone's commonest labels in a sentence."""
    labelled = ontology.labelled(selection(spark, sf_dir), "terminus_class", views.vocabulary(spark), "label")
    return context.composition(labelled, views.zones(spark, sf_dir))


@query(ALL + ", f AS (SELECT citta, zona, position, unnest([CAST(id AS VARCHAR), name, cls, printf('%.6f', lat), printf('%.6f', lon)]) AS x, unnest([1, 2, 3, 4, 5]) AS k FROM gr), g AS (SELECT citta, zona, position, string_agg(length(x) || ':' || x, '' ORDER BY k) AS row FROM f GROUP BY ALL) SELECT citta, zona, sha256(string_agg(row, chr(10) ORDER BY position)) AS contesto_hash FROM g GROUP BY ALL")
def f12_fingerprint(spark, sf_dir):
    """hash of a zone's ordered points."""
    return context.fingerprint(selection(spark, sf_dir))


@query(f"WITH RECURSIVE {RE}, sd AS (SELECT cls FROM (VALUES ('Bank'), ('Museum'), ('Railway_station'), ('Kindergarten')) AS s(cls)), a AS (SELECT cls AS identifier, 'poi' AS category, cls AS seed, 0 AS k FROM sd UNION ALL SELECT filler, CASE fi.prop WHEN 'havingHazard' THEN 'hazard' WHEN 'havingCriticalEvent' THEN 'critical_event' WHEN 'havingPerformer' THEN 'poi' ELSE 'vulnerability' END, fi.cls, pr.k FROM fi JOIN pr USING (prop) JOIN sd USING (cls)), v AS (SELECT identifier, arg_min(category, (seed, k)) AS category FROM a GROUP BY identifier) SELECT identifier, category, {LABEL.format(x='identifier')} AS label_it, {ENGLISH.format(x='identifier')} AS label_en FROM v")
def w9_j15_s8_vocabulary(spark, sf_dir):
    """Vocabulary of seed classes and their fillers, with curated labels kept, and English labels without misspellings."""
    seeds = spark.createDataFrame([("Bank",), ("Museum",), ("Railway_station",), ("Kindergarten",)], "terminus_class string")
    found = ontology.vocabulary(seeds, fillers(spark, sf_dir, seeds)).select("identifier", "category", F.lit("").alias("label_it"))
    kept = ontology.merged_labels(views.vocabulary(spark), found).withColumn("label_en", F.lit(""))
    return ontology.labelled(kept.select("identifier", "category"), "identifier", kept.select("identifier", "label_it", "label_en").unionByName(views.vocabulary(spark).filter("label_it = ''").select("identifier", "label_it", "label_en")).groupBy("identifier").agg(F.max("label_it").alias("label_it"), F.max("label_en").alias("label_en"))).withColumn("label_en", text.english(F.col("identifier")))


@query(ALL + "SELECT gr.citta, gr.zona, gr.type, gr.id, row_number() OVER (PARTITION BY citta, zona ORDER BY n_risks DESC, CASE WHEN n_risks = 0 THEN 3 WHEN conf = 'verificato' THEN 0 ELSE 1 END, position) AS relevance FROM gr")
def w6_relevance(spark, sf_dir):
    """Points by relevance."""
    return context.relevance(risks(spark, sf_dir)).select("citta", "zona", "type", "id", "relevance")


_NL = "chr(10)"
_LINES = f"""'  POI: ' || name || ' (' || cls || ')' || {_NL} || CASE WHEN n_risks > 0 THEN '{context.HAZARDS}' || {_NL} || array_to_string(list_transform(list_zip(hs, ls), lambda x: '    - [ONTOLOGIA] ' || x[1] || ' / ' || x[2] || ' (' || conf || ')'), {_NL}) ELSE '{context.NO_HAZARDS}' END || {_NL}
  || CASE WHEN v IS NOT NULL THEN '  Vulnerabilita'': ' || v || {_NL} ELSE '' END || CASE WHEN path IS NOT NULL THEN '  Path ontologico: ' || path || {_NL} ELSE '' END"""
_TEXT = f"""'ZONA: ' || zona || {_NL} || {_NL} || CASE WHEN len(ws) > 0 THEN '{context.HAZARD_TERMS}' || {_NL} || '  ' || array_to_string(ws, '; ') || {_NL} || {_NL} ELSE '' END || {{note}} || '{context.POINTS}' || {_NL}
  || CASE WHEN length(zona) % 2 = 0 THEN bs || {_NL} || '{context.QUESTION[0]}' || {_NL} || 'E'' sicura ' || zona || ' - - di notte?' || {_NL} || '{context.QUESTION[1]}' ELSE rtrim(bs, ' ' || {_NL}) END || {_NL}"""
_NOTE = "'" + "' || {n} || '".join(x.replace("'", "''") for x in context.NOTE) + "'"
_SEVERAL = "list_filter({l}, lambda x, i: list_position({l}, x) = i) AS ws"
BUDGET = f"""hz AS (SELECT cls, list(filler ORDER BY filler) AS hs, list({LABEL.format(x='filler')} ORDER BY filler) AS ls, arg_min(source, filler) AS path FROM ci WHERE axis = 'hazards' GROUP BY cls),
vu AS (SELECT cls, string_agg(filler, ', ' ORDER BY filler) AS v FROM ci WHERE axis = 'vulnerabilities' GROUP BY cls),
rl AS (SELECT citta, zona, position, {_LINES} AS block, coalesce(ls, []) AS ls, count(*) OVER (PARTITION BY citta, zona) AS m, row_number() OVER (PARTITION BY citta, zona ORDER BY n_risks DESC, CASE WHEN n_risks = 0 THEN 3 WHEN conf = 'verificato' THEN 0 ELSE 1 END, position) AS k FROM gr LEFT JOIN hz USING (cls) LEFT JOIN vu USING (cls)),
wh AS (SELECT citta, zona, any_value(m) AS m, any_value(m) AS n, string_agg(block, {_NL} ORDER BY position) AS bs, flatten(list(ls ORDER BY position)) AS l FROM rl GROUP BY citta, zona),
wt AS (SELECT citta, zona, m, n, {_TEXT.format(note="''")} AS context FROM (SELECT *, {_SEVERAL.format(l='l')} FROM wh)),
pf AS (SELECT a.citta, a.zona, any_value(a.m) AS m, a.k AS n, string_agg(b.block, {_NL} ORDER BY b.k) AS bs, flatten(list(b.ls ORDER BY b.k)) AS l FROM rl a JOIN rl b ON a.citta = b.citta AND a.zona = b.zona AND b.k <= a.k GROUP BY a.citta, a.zona, a.k),
pt AS (SELECT citta, zona, m, n, {_TEXT.format(note=f"{_NOTE.replace('{n}', 'n', 1).replace('{n}', 'm', 1)} || {_NL} || {_NL}")} AS context FROM (SELECT *, {_SEVERAL.format(l='l')} FROM pf)),
tk AS (SELECT *, CAST(ceil(length(context) / 3.0) AS BIGINT) AS tokens FROM pt), ft AS (SELECT citta, zona, greatest(1, count(*) FILTER (WHERE tokens <= 500)) AS n FROM tk GROUP BY citta, zona)"""


@query(ALL + f", {BUDGET}, w AS (SELECT *, CAST(ceil(length(context) / 3.0) AS BIGINT) AS tokens FROM wt) SELECT citta, zona, n AS n_included, m AS n_total, tokens, context FROM w WHERE tokens <= 500 OR m <= 1 UNION ALL SELECT t.citta, t.zona, t.n, t.m, t.tokens, t.context FROM tk t JOIN ft USING (citta, zona, n) JOIN w ON w.citta = t.citta AND w.zona = t.zona AND w.tokens > 500 AND w.m > 1")
def w7_w8_f10_f15_budgeted_context(spark, sf_dir):
    """A zone's context text within a budget of tokens, some with a question."""
    questions = views.zones(spark, sf_dir).select("citta", "zona", F.when(F.length("zona") % 2 == 0, F.concat(F.lit(" E' sicura  "), "zona", F.lit(" --- di notte?\n"))).alias("domanda"))
    return context.budgeted(labels_of(stored_risks(spark, sf_dir), F.transform("risks", lambda r: r["hazard"]), spark), 500, questions).select("citta", "zona", F.col("n_included").cast("long"), F.col("n_total").cast("long"), "tokens", "context")


_Q = lambda x: "'" + x.replace("'", "''") + "'"
_FLAT = "regexp_replace(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g'), '-{{2,}}', '- -', 'g')"
_DISPLAY = "upper(substr(trim(replace({x}, '_', ' ')), 1, 1)) || substr(trim(replace({x}, '_', ' ')), 2)"
_POINT = f"""'Citta'': ' || citta || {_NL} || 'Zona: ' || zona || {_NL} || {_NL} || CASE WHEN len(ws) > 0 THEN {_Q(context.RISK_TERMS)} || {_NL} || '  ' || array_to_string(ws, '; ') || {_NL} || {_NL} ELSE '' END
  || 'PUNTO SELEZIONATO: ' || {_FLAT.format(x='name')} || ' (classe: ' || label || ')' || {_NL} || CASE WHEN path IS NOT NULL THEN 'Percorso ontologico: ' || path || {_NL} ELSE '' END
  || CASE WHEN n_risks > 0 THEN {_Q(context.RISKS)} || {_NL} || array_to_string(list_transform(list_zip(hs, ls, ss), lambda x: '  - ' || x[1] || ' / ' || x[2] || ' [ONTOLOGIA] (confidence: ' || conf || ', fonte: ' || x[3] || ')'), {_NL}) ELSE {_Q(context.NO_RISKS)} END || {_NL}
  || CASE WHEN vs IS NOT NULL THEN 'Vulnerabilita'': ' || array_to_string(list_transform(list_zip(vs, vl), lambda x: x[1] || ' / ' || x[2]), '; ') || {_NL} ELSE '' END
  || {_NL} || {_Q(context.NEAR)} || {_NL} || coalesce(near, {_Q(context.NO_NEAR)}) || {_NL} || {_NL} || 'COMPOSIZIONE DELLA ZONA: ' || summary || {_NL}"""
POINT = f"""hz AS (SELECT cls, list(filler ORDER BY filler) AS hs, list({LABEL.format(x='filler')} ORDER BY filler) AS ls, list(source ORDER BY filler) AS ss, arg_min(source, filler) AS path FROM ci WHERE axis = 'hazards' GROUP BY cls),
vu AS (SELECT cls, list(filler ORDER BY filler) AS vs, list({_DISPLAY.format(x='filler')} ORDER BY filler) AS vl FROM ci WHERE axis = 'vulnerabilities' GROUP BY cls),
pr2 AS (SELECT a.citta, a.zona, a.type || '/' || a.id AS id, b.type || '/' || b.id AS other, b.name, {LABEL.format(x='b.cls')} AS label, {_HAV.format(a_lat='a.lat', a_lon='a.lon', b_lat='b.lat', b_lon='b.lon')} AS d FROM gr a JOIN gr b ON a.citta = b.citta AND a.zona = b.zona AND (a.type, a.id) <> (b.type, b.id)),
nb AS (SELECT citta, zona, id, string_agg('  - ' || {_FLAT.format(x='name')} || ' (' || label || '), ' || CAST(CAST(round_even(d, 0) AS BIGINT) AS VARCHAR) || ' m', {_NL} ORDER BY r) AS near FROM (SELECT *, row_number() OVER (PARTITION BY citta, zona, id ORDER BY d, other) AS r FROM pr2) WHERE r <= 5 GROUP BY citta, zona, id),
lb AS (SELECT citta, zona, {LABEL.format(x='cls')} AS label, count(*) AS n, sum(count(*)) OVER (PARTITION BY citta, zona) AS total FROM gr GROUP BY citta, zona, label),
su AS (SELECT citta, zona, any_value(CAST(CAST(total AS BIGINT) AS VARCHAR)) || {_Q(context.SUMMARY)} || string_agg(label || ' (' || n || ')', ', ' ORDER BY r) || '.' AS summary FROM (SELECT *, row_number() OVER (PARTITION BY citta, zona ORDER BY n DESC, label) AS r FROM lb) WHERE r <= 3 GROUP BY citta, zona),
pw AS (SELECT g.citta, g.zona, g.type || '/' || g.id AS id, g.name, g.n_risks, g.conf, {LABEL.format(x='g.cls')} AS label, hz.hs, hz.ls, hz.ss, hz.path, vu.vs, vu.vl, nb.near, su.summary, coalesce(hz.ls, []) || coalesce(vu.vl, []) AS l FROM gr g LEFT JOIN hz USING (cls) LEFT JOIN vu USING (cls) LEFT JOIN nb ON nb.citta = g.citta AND nb.zona = g.zona AND nb.id = g.type || '/' || g.id LEFT JOIN su ON su.citta = g.citta AND su.zona = g.zona)"""


@query(ALL + f", {POINT} SELECT citta, zona, id, {_POINT} AS context FROM (SELECT *, {_SEVERAL.format(l='l')} FROM pw)")
def f9_f15_poi_context(spark, sf_dir):
    """the context text of each selected point."""
    r = named(labels_of(stored_risks(spark, sf_dir), F.transform("risks", lambda r: r["hazard"]), spark))
    r = ontology.labelled(r, "terminus_class", views.vocabulary(spark), "label").withColumn("vulnerability_labels", F.transform("vulnerabilities", lambda v: text.display(v["name"])))
    near = context.neighbours(r).join(r.select("citta", "zona", F.col("id").alias("neighbour_id"), "name", "label"), ["citta", "zona", "neighbour_id"])
    return context.poi_context(r, near, context.composition(r, views.zones(spark, sf_dir)))
