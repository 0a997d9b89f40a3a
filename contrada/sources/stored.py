"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder_of(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir, or where that is unset in the session's warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/contrada-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table, read back: it is computed once, and lineage ends here."""
    spark = df.sparkSession
    path = folder_of(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing reads any more; others are left alone."""
    for t in tables:
        if hasattr(t, "stored_at"):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
