"""Points joined to the risks of their class, with citation and evidence level, and the counts over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ontology import AXES, rank_of
from .poi import evidence

ONTOLOGY, CONTEXT, SPECULATIVE = "ONTOLOGIA", "CONTESTO", "SPECULATIVO"
KEY = ("citta", "zona", "type", "id")


def citations(fillers: DataFrame) -> DataFrame:
    """(terminus_class, axis, filler, source): the first path of an axis by property; fillers are those of profiles."""
    axis = F.create_map(*[F.lit(x) for p, a in AXES.items() for x in (p, a)])
    path = text.citation(F.col("terminus_class"), F.col("prop"), F.col("filler"))
    return fillers.withColumn("axis", axis[F.col("prop")]).groupBy("terminus_class", "axis", "filler").agg(F.min_by(path, rank_of(F.col("prop"))).alias("source"))


def cited_risks(risks: DataFrame, cited: DataFrame, axis: str, first_property: str) -> DataFrame:
    """Adds source to rows (terminus_class, filler): the profile's path, else one made of the axis' first property."""
    known = cited.filter(F.col("axis") == axis).select("terminus_class", "filler", "source")
    made = text.citation(F.col("terminus_class"), F.lit(first_property), F.col("filler"))
    return risks.join(known, ["terminus_class", "filler"], "left").withColumn("source", F.coalesce("source", made))


def grounded(points: DataFrame, fillers: DataFrame) -> DataFrame:
    """Long form: a row for each point and filler of its class, axis and source; a point of a class without a profile has one row with null axis. Points meet profiles by class, which Spark broadcasts where it is small."""
    return points.join(citations(fillers), "terminus_class", "left").withColumn("confidence", evidence(F.col("name"))).withColumn("tag", F.when(F.col("axis") == "hazards", ONTOLOGY))


def nested(points: DataFrame, fillers: DataFrame) -> DataFrame:
    """A row for each point with its risks (hazard, tag, confidence, source), critical_events and vulnerabilities (name, source), by name, the first hazard's source as sparql_path, and the point's own confidence: null without risks. Profiles are nested once for each class, so points are not shuffled."""
    c = citations(fillers)
    pick = lambda axis, *cols: F.array_sort(F.collect_list(F.when(F.col("axis") == axis, F.struct(*cols))))
    of_class = c.groupBy("terminus_class").agg(
        pick("hazards", F.col("filler").alias("hazard"), "source").alias("__h"),
        pick("critical_events", F.col("filler").alias("name"), "source").alias("critical_events"),
        pick("vulnerabilities", F.col("filler").alias("name"), "source").alias("vulnerabilities"),
    )
    joined = points.join(of_class, "terminus_class", "left")
    level = evidence(F.col("name"))
    risks = F.transform("__h", lambda h: F.struct(h["hazard"].alias("hazard"), F.lit(ONTOLOGY).alias("tag"), level.alias("confidence"), h["source"].alias("source")))
    none = "array<struct<name: string, source: string>>"
    out = joined.withColumn("risks", F.coalesce(risks, F.array().cast("array<struct<hazard: string, tag: string, confidence: string, source: string>>")))
    for c in ("critical_events", "vulnerabilities"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast(none)))
    return out.drop("__h").withColumn("sparql_path", F.try_element_at("risks", F.lit(1))["source"]).withColumn("confidence", F.when(F.size("risks") > 0, level))


def retrieval_stats(points: DataFrame) -> DataFrame:
    return points.groupBy("citta", "zona").agg(F.count(F.lit(1)).alias("n_pois"), F.countDistinct("terminus_class").alias("n_classes"))


def confidence_summary(points: DataFrame) -> DataFrame:
    """Of each zone of nested(): risks by level, risks with an ontology tag and all, points by their own level; zones without risks have zeros."""
    level = lambda v: F.sum(F.size(F.filter("risks", lambda r: r["confidence"] == v))).cast("long")
    return points.groupBy("citta", "zona").agg(
        level("verificato").alias("verificato"), level("da_confermare").alias("da_confermare"),
        F.sum(F.size(F.filter("risks", lambda r: r["tag"] == ONTOLOGY))).cast("long").alias("anchored"), F.sum(F.size("risks")).cast("long").alias("total"),
        F.count_if(F.col("confidence") == "verificato").alias("pois_verificato"), F.count_if(F.col("confidence") == "da_confermare").alias("pois_da_confermare"),
    )


def with_confidence(points: DataFrame, level: str | None) -> DataFrame:
    """Points of a level; None: all. A point without a level never matches."""
    return points if level is None else points.filter(F.col("confidence") == level)


def base_table(points: DataFrame) -> DataFrame:
    """One row for each point and hazard, category tc: and the class."""
    return points.select(*KEY, "name", F.explode("risks").alias("r"), F.concat(F.lit("tc:"), "terminus_class").alias("category")).select(*KEY, "name", "r.hazard", "category", "r.confidence")


def risks_of_points(risks: DataFrame, points: DataFrame) -> DataFrame:
    """Risks (with KEY) joined to points by id, never by name, which may repeat or be missing."""
    return risks.join(points.select(*KEY, "name"), list(KEY))


def by_tag(risks: DataFrame) -> DataFrame:
    """Hazards of each zone and tag (a missing one is SPECULATIVO), duplicates kept, by position; tag_rank orders ONTOLOGIA, CONTESTO, SPECULATIVO, others."""
    tag = F.coalesce(F.expr("nullif(tag, '')"), F.lit(SPECULATIVE))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, (ONTOLOGY, CONTEXT, SPECULATIVE))), F.col("tag")), F.lit(0)), F.lit(4))
    return risks.withColumn("tag", tag).groupBy("citta", "zona", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "hazard"))), lambda x: x["hazard"]).alias("hazards")).withColumn("tag_rank", rank)


def tabs(grouped: DataFrame, prose: DataFrame, keys: tuple[str, ...] = ("citta", "zona")) -> DataFrame:
    """Tabs of each key (a zone, or a narrative of it), tab_rank in their order: of the three known tags those that have prose (keys, tag, text) beyond white space, stripped here, or a hazard (by_tag)."""
    order = F.array(*map(F.lit, (ONTOLOGY, CONTEXT, SPECULATIVE)))
    joined = grouped.select(*keys, "tag", "hazards").join(prose.select(*keys, "tag", text.stripped(F.col("text")).alias("text")), [*keys, "tag"], "full_outer")
    out = joined.select(*keys, "tag", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("hazards", F.array().cast("array<string>")).alias("hazards"), F.array_position(order, F.col("tag")).cast("int").alias("tab_rank"))
    return out.filter((F.col("tab_rank") > 0) & ((F.col("text") != "") | (F.size("hazards") > 0)))
