"""Run records, capture outcomes, triples, vocabulary and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .texts import RECORDS, read_records

RUN = "run_id string, experiment string, citta string, zona string, mode string, model_id string, status string, metrics struct<grounding: double, hallucination: double, latency_ms: bigint, cost_usd: double>, narrativa string, n_poi bigint, annotazione_manuale struct<grounding: double, hallucination: double, annotator: string, note: string>, provenance struct<code_commit: string, ontology_hash: string, snapshot_id: string, model_id: string, prompt_hash: string, temperature: double, seed: bigint, experiment: string>"
OUTCOME = "status string, citta string, zona string, error_type string, error string, capture struct<citta: string, zona: string, lat: double, lon: double, bbox: array<double>, switch_ms: bigint, pois: array<struct<id: string, name: string, lat: double, lon: double, osm_tags: string, terminus_class: string, citta: string>>>"
VOCABULARY = "identifier string, label_en string, label_it string, category string"
#: Decimals that reports print.
DIGITS = {"grounding": 3, "hallucination": 3, "latency_ms": 0, "cost_usd": 6}


def read_runs(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    """Run records of JSON files, with file_order, the key by which files sort; of an experiment, or all. What is no record is in rejected_runs()."""
    rows = read_records(spark, path, RUN, "run_id")[0].drop("path").withColumn("file_order", F.concat("run_id", F.lit(".json")))
    return rows if experiment is None else rows.filter(F.col("experiment") == experiment)


def rejected_runs(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, reason) of what is no run record."""
    return read_records(spark, path, RUN, "run_id")[1]


def write_runs(runs: DataFrame, path: str) -> None:
    """JSON records by experiment, whose column stays in them. Experiments that are there already are replaced, others stay.

    Both are there while they are replaced, and names of fields are most of a record: files are gzipped, at its fastest level."""
    rows = runs.withColumn("of", F.col("experiment"))
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
    rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", maxRecordsPerFile=RECORDS, **packed).partitionBy("of").json(path)


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """Capture outcomes of JSON files, good and failed ones. What is no outcome is in rejected_outcomes()."""
    return read_records(spark, path, OUTCOME, "status")[0].drop("path")


def rejected_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(path, value, reason) of what is no capture outcome."""
    return read_records(spark, path, OUTCOME, "status")[1]


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples lines as s, p, o, s_kind, o_kind; no triple at all is an error."""
    term = r"(<[^>]*>|_:\S+|\"(?:[^\"\\]|\\.)*\"\S*)"
    line = rf"^\s*{term}\s+{term}\s+{term}\s*\.\s*$"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    kind = lambda x: F.when(x.startswith("<"), "iri").when(x.startswith("_:"), "bnode").otherwise("literal")
    out = rows.select(*[F.regexp_replace(part(k), "^<|>$", "").alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))], kind(part(1)).alias("s_kind"), kind(part(3)).alias("o_kind"))
    if out.isEmpty():
        raise ValueError(f"no triples in {path}")
    return out


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The label vocabulary; an absent file is an empty one."""
    try:
        return spark.read.schema(VOCABULARY).option("multiLine", True).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], VOCABULARY)


def rounded(rows: DataFrame, digits: dict[str, int] = DIGITS) -> DataFrame:
    """Measures at print precision, half to even; columns named after a measure with a suffix take its decimals."""
    of = {c: next((d for m, d in digits.items() if m in c), None) for c, t in rows.dtypes if t == "double"}
    return rows.withColumns({c: F.bround(c, d) for c, d in of.items() if d is not None})


def write_report(rows: DataFrame, path: str) -> None:
    rounded(rows).write.option("header", True).csv(path)
