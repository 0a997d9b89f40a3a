"""Payload texts of map elements, and snapshots of points in either form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import read_texts, typed

ELEMENT = "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>, emit_pos bigint"
POI = "id string, name string, lat double, lon double, osm_tags string, terminus_class string, citta string"
PROVENANCE = "catturato_il string, bbox array<double>, citta string, zona string, configurazione_canonica struct<selettori_hash: string, n_selettori: int, max_pois: int, per_selector_cap: int, per_class_cap: int>"


def _list(column: str) -> Column:
    """The elements of a payload text; null without a list of them. The text is parsed once, to a variant."""
    return F.try_variant_get(F.try_parse_json(column), "$.elements", "array<variant>")


def elements(texts: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Elements of payload texts, a row each, with the keys; emit_pos is their place where they have none. Elements that are no objects are skipped."""
    rows = texts.select(*keys, F.posexplode(_list(column)).alias("__p", "__e")).filter(F.schema_of_variant("__e").startswith("OBJECT"))
    return rows.select(*keys, *typed("__e", ELEMENT), "__p").withColumn("emit_pos", F.coalesce("emit_pos", F.col("__p").cast("bigint"))).drop("__p")


def rejects(texts: DataFrame, column: str) -> DataFrame:
    """Payload texts without a list of elements."""
    return texts.filter(_list(column).isNull())


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points of snapshot files, a bare list or {"poi": [...]} with provenance: path, provenienza, position from 1, and the point's fields; and the records of neither form (path, value, reason)."""
    texts, broken = read_texts(spark, path)
    bare = F.try_variant_get("record", "$", "array<variant>")
    own = F.coalesce(bare, F.try_variant_get("record", "$.poi", "array<variant>"))
    rows = texts.withColumn("points", own).withColumn("provenienza", F.try_variant_get("record", "$.provenienza", f"struct<{_struct(PROVENANCE)}>"))
    good = rows.select("path", "provenienza", F.posexplode("points").alias("position", "p"))
    out = good.select("path", "provenienza", (F.col("position") + 1).alias("position"), *typed("p", POI))
    return out, broken.unionByName(rows.filter("points is null").select("path", "value", F.lit("no list of points").alias("reason")))


def _struct(ddl: str) -> str:
    depth, out = 0, []
    for part in ddl.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)


def write_snapshots(points: DataFrame, provenance: DataFrame, path: str) -> None:
    """One JSON object for each zone (citta, zona): formato 2, provenienza (a struct of provenance) and its points by position; folders by city and zone. Zones that are there already are replaced, others stay."""
    cols = [c.split()[0] for c in POI.split(", ")]
    listed = points.groupBy("citta", "zona").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*cols).alias("p")))), lambda x: x["p"]).alias("poi"))
    out = listed.join(provenance, ["citta", "zona"]).select("citta", "zona", F.lit(2).alias("formato"), "provenienza", "poi")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("citta", "zona").json(path)
