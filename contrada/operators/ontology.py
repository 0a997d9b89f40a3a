"""Class risk profiles from a table of triples: restrictions, ancestors, inheritance, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stored import discard, stored

# The predicates read, and the properties of a profile by rank.
SUBCLASS, TYPE, ON, SOME = "rdfs:subClassOf", "rdf:type", "owl:onProperty", "owl:someValuesFrom"
RESTRICTION, CLASS = "owl:Restriction", "owl:Class"
PROPERTIES = ("havingHazard", "havingCriticalEvent", "isVulnerableTo", "havingVulnerability", "havingPerformer")
AXES = {"havingHazard": "hazards", "havingCriticalEvent": "critical_events", "isVulnerableTo": "vulnerabilities", "havingVulnerability": "vulnerabilities", "havingPerformer": "stakeholders"}
CATEGORIES = {"havingHazard": "hazard", "havingCriticalEvent": "critical_event", "isVulnerableTo": "vulnerability", "havingVulnerability": "vulnerability", "havingPerformer": "poi"}


def rank_of(prop):
    return F.array_position(F.array(*[F.lit(p) for p in PROPERTIES]), prop)


def restriction_rows(triples: DataFrame) -> DataFrame:
    """(terminus_class, prop, filler, used) of the existential restrictions on the profile's properties; used: class and filler are IRIs.

    Each predicate is cut out first. What a node is and its properties, five at most, are one row of it, so that two joins on the node are
    left. They sort: by the size of the files behind the triples Spark may broadcast a side that has a row for each of them.
    """
    t = triples
    sub = t.filter(F.col("p") == SUBCLASS).select("s", "s_kind", F.col("o").alias("node"))
    prop = F.when(F.col("p") == ON, text.local_name(F.col("o")))
    said = t.filter(((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)) | (F.col("p") == ON)).select(F.col("s").alias("node"), prop.alias("prop")).filter("prop is null or " + " or ".join(f"prop = '{p}'" for p in PROPERTIES))
    on = [F.bool_or(F.coalesce(F.col("prop") == p, F.lit(False))).alias(p) for p in PROPERTIES]
    node = said.groupBy("node").agg(F.bool_or(F.col("prop").isNull()).alias("restricts"), *on).filter("restricts")
    props = F.array_compact(F.array(*[F.when(F.col(p), F.lit(p)) for p in PROPERTIES]))
    some = t.filter(F.col("p") == SOME).select(F.col("s").alias("node"), "o", "o_kind")
    met = sub.hint("merge").join(node.select("node", props.alias("props")), "node").hint("merge").join(some, "node")
    return met.select(text.local_name(F.col("s")).alias("terminus_class"), F.explode("props").alias("prop"), text.local_name(F.col("o")).alias("filler"), ((F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).alias("used")).distinct()


def restrictions(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(terminus_class, prop, filler) of the existential restrictions on the profile's properties; and those dropped because class or filler is no IRI."""
    rows = restriction_rows(triples)
    return rows.filter("used").drop("used"), rows.filter("not used").drop("used")


def ancestors(triples: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(terminus_class, ancestor): subClassOf, reflexive and transitive, over IRIs; cycles end. Of all classes, or of those named (terminus_class) only.

    Paths are doubled: with the pairs reached so far and the ends of all walks of exactly n steps, one join reaches twice as far, so the
    rounds are the logarithm of the depth. Walks of n steps are at most as many as pairs, and those round a cycle go on round it. Each
    table is written once; three doublings make a job.
    """
    edges = stored(triples.filter((F.col("p") == SUBCLASS) & (F.col("s_kind") == "iri") & (F.col("o_kind") == "iri")).select(text.local_name(F.col("s")).alias("from"), text.local_name(F.col("o")).alias("to")).distinct(), "edges")
    if classes is None:
        named = triples.filter((F.col("p") == TYPE) & (F.col("o") == CLASS) & (F.col("s_kind") == "iri")).select(text.local_name(F.col("s")).alias("c"))
        seeds = named.union(edges.select("from")).union(edges.select("to"))
    else:
        seeds = classes.select("terminus_class")
    own = seeds.toDF("c").distinct().select(F.col("c").alias("terminus_class"), F.col("c").alias("ancestor"))
    return closed(stored(own, "closure"), edges)


def closed(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (terminus_class, ancestor; written, and deleted here) and all that edges (from, to; written) lead to from their ancestors; written."""

    def further(reached: DataFrame, walks: DataFrame, step: int) -> DataFrame:
        new = reached.join(walks, F.col("ancestor") == F.col("from")).select("terminus_class", F.col("to").alias("ancestor"), F.lit(step).alias("step"))
        return reached.union(new).groupBy("terminus_class", "ancestor").agg(F.min("step").alias("step"))

    def doubled(walks: DataFrame) -> DataFrame:
        return walks.join(walks.select(F.col("from").alias("to"), F.col("to").alias("end")), "to").select("from", F.col("end").alias("to")).distinct()

    reached, walks, spent = pairs, edges, []
    while True:
        # Walks of n steps, then of 2n and 4n: with them pairs up to 8n - 1 steps apart are reached. If the last found none, none is left.
        twice = doubled(walks)
        four = doubled(twice)
        start = reached.select("terminus_class", "ancestor", F.lit(0).alias("step"))
        before, reached = reached, stored(further(further(further(start, walks, 1), twice, 2), four, 3), "closure")
        discard(before)
        if reached.filter("step = 3").isEmpty():
            discard(*spent)
            return reached.drop("step")
        walks = stored(doubled(four), "walks")
        discard(*spent)
        spent = [walks]


def inherited(closure: DataFrame, own: DataFrame) -> DataFrame:
    """(terminus_class, prop, filler) of each class and its ancestors; fillers' own superclasses do not count."""
    return closure.join(own.select(F.col("terminus_class").alias("ancestor"), "prop", "filler"), "ancestor").select("terminus_class", "prop", "filler").distinct()


def profiles(fillers: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Wide profiles: sorted hazards, critical_events, vulnerabilities (of two properties), stakeholders, and paths by property and filler. Classes without fillers have empty lists."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("prop").isin(*[p for p, a in AXES.items() if a == axis]), F.col("filler")))).alias(axis) for axis in ("hazards", "critical_events", "vulnerabilities", "stakeholders")]
    rank = rank_of(F.col("prop"))
    path = F.struct(rank.alias("k"), F.col("filler").alias("f"), text.citation(F.col("terminus_class"), F.col("prop"), F.col("filler")).alias("path"))
    # A filler under both vulnerability properties is cited once, under the first.
    named = fillers.groupBy("terminus_class", "filler", F.when(rank == 4, 3).otherwise(rank).alias("__a")).agg(F.min_by("prop", rank).alias("prop"))
    wide = named.groupBy("terminus_class").agg(*lists, F.transform(F.array_sort(F.collect_list(path)), lambda x: x["path"]).alias("sparql_paths"))
    if classes is None:
        return wide
    empty = F.array().cast("array<string>")
    out = classes.select("terminus_class").distinct().join(wide, "terminus_class", "left")
    return out.select("terminus_class", *[F.coalesce(c, empty).alias(c) for c in ("hazards", "critical_events", "vulnerabilities", "stakeholders", "sparql_paths")])


def declared(triples: DataFrame) -> DataFrame:
    """Classes declared as such (terminus_class)."""
    return triples.filter((F.col("p") == TYPE) & (F.col("o") == CLASS) & (F.col("s_kind") == "iri")).select(text.local_name(F.col("s")).alias("terminus_class")).distinct()


def vocabulary(seeds: DataFrame, fillers: DataFrame) -> DataFrame:
    """identifier and category of the seed classes (terminus_class) and their fillers, by category and identifier; the first category assigned, by seed and property, stays."""
    own = seeds.select(F.col("terminus_class").alias("identifier"), F.lit("poi").alias("category"), F.col("terminus_class").alias("seed"), F.lit(0).alias("k"))
    category = F.create_map(*[F.lit(x) for p, c in CATEGORIES.items() for x in (p, c)])
    found = fillers.join(seeds.select("terminus_class").distinct(), "terminus_class", "left_semi").select(F.col("filler").alias("identifier"), category[F.col("prop")].alias("category"), F.col("terminus_class").alias("seed"), rank_of(F.col("prop")).cast("int").alias("k"))
    first = own.union(found).groupBy("identifier").agg(F.min_by("category", F.struct("seed", "k")).alias("category"))
    return first.withColumn("category_rank", F.array_position(F.array(*[F.lit(c) for c in ("poi", "hazard", "critical_event", "vulnerability")]), F.col("category")))


def labelled(rows: DataFrame, identifier: str, labels: DataFrame, name: str = "label_it") -> DataFrame:
    """Adds the Italian label: label_it, else label_en, else the identifier made readable. labels may be empty."""
    known = labels.select(F.col("identifier").alias(identifier), F.coalesce(F.expr("nullif(label_it, '')"), F.expr("nullif(label_en, '')")).alias("__l"))
    return rows.join(known, identifier, "left").withColumn(name, F.coalesce("__l", text.display(F.col(identifier)))).drop("__l")


def merged_labels(curated: DataFrame, new: DataFrame) -> DataFrame:
    """New vocabulary rows with the curated label_it where the new one is empty."""
    old = curated.select("identifier", F.col("label_it").alias("__old"))
    return new.join(old, "identifier", "left").withColumn("label_it", F.coalesce(F.expr("nullif(label_it, '')"), F.col("__old"), F.lit(""))).drop("__old")
