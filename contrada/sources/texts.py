"""JSON files as records, whatever their layout, with those that cannot be read put aside.

Files come through Spark's own reader, so any store that Spark reads will do (a data source in Python would have to open them itself);
each is parsed once, to a variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Records of a written file: files are read whole, and small ones cost more to open than to read.
RECORDS = 10_000


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(path, value, record) of JSON files under a path, and (path, value, reason) of what is no JSON.

    A file whose first line is no JSON by itself, but which is as a whole, is one record over many lines; any other has a record on each line. Blank ones are none.
    """
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").filter(F.col("value").rlike(r"\S"))
    whole = F.try_parse_json(F.substring_index(F.ltrim("value", F.lit(" \t\n\x0b\f\r")), "\n", 1)).isNull() & F.try_parse_json("value").isNotNull()
    lines = files.select("path", F.explode(F.when(whole, F.array("value")).otherwise(F.split("value", r"\r?\n"))).alias("value")).filter(F.col("value").rlike(r"\S"))
    # Parsed in a generator: as a plain column the optimizer would write the parser into each filter that asks for the record.
    one = lines.select("path", "value", F.explode(F.array(F.try_parse_json("value"))).alias("record"))
    return one.filter("record is not null"), one.filter("record is null").select("path", "value", F.lit("no JSON").alias("reason"))


def typed(variant: str, ddl: str) -> list[Column]:
    """The fields of a variant object by a schema; one that is missing or of another kind is null."""
    return [F.try_variant_get(variant, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in StructType.fromDDL(ddl)]


def read_records(spark: SparkSession, path: str, ddl: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON files by a schema, with path; and what is no JSON, no object, or has no `key` (path, value, reason)."""
    texts, broken = read_texts(spark, path)
    # Of texts that are JSON.
    is_object = F.ltrim("value", F.lit(" \t\r\n")).startswith("{")
    reason = F.when(~is_object, "no object").when(F.try_variant_get("record", f"$.{key}", "string").isNull(), F.lit(f"no {key}"))
    judged = texts.withColumn("reason", reason)
    return judged.filter("reason is null").select("path", *typed("record", ddl)), broken.unionByName(judged.filter("reason is not null").select("path", "value", "reason"))
