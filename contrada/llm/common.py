"""Reading tables and cutting lineage, shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import mixed

#: Bytes of an Arrow batch that goes to a Python worker, at most: texts may be long, and memory is shared with the JVM.
BATCH_BYTES = 2 << 20
#: The most bits of a bitmap of ids, as a power of two: 16 MB.
MARK_BITS = 27


def even_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    even_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own, or where neither is set the session's warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    even_batches(spark)
    path = f"{shared_dir(spark)}/contrada-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more: what was made of them is written itself."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(t.written_at)
        path.getFileSystem(conf).delete(path, True)


def lower_ascii(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def partitions(df: DataFrame) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def tidy(run: Callable) -> Callable:
    """run, for mapInArrow, after whose end the worker, which Spark keeps for later tasks, gives memory that it no longer uses back to the system."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """A name that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Marks:
    """A bitmap of ids (the first column, distinct longs), sent to the workers: 32 bits for each id up to 2^MARK_BITS in all. It has every id and few others; their part grows where MARK_BITS is the limit, so what it lets through is checked by a join."""

    def __init__(self, ids: DataFrame):
        bits = 1 << min(MARK_BITS, max(15, math.ceil(math.log2(32 * ids.count() + 1))))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array((mixed(np.asarray(b.column(0)).view(np.uint64)) & np.uint64(bits - 1)).astype(np.int64) + 1)], names=["bit"])  # Spark's bitmaps count bits from 1

        own = ids.select(ids.columns[0]).mapInArrow(place, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m"))
        bitmap = np.zeros(max(1, bits >> 15) << 12, np.uint8)
        for r in own.collect():  # bits / 2^15 rows of 4 KB at most
            at = (r["k"] - 1) << 12
            bitmap[at : at + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
        self.sent, self.bits = ids.sparkSession.sparkContext.broadcast(bitmap.tobytes()), bits

    def has(self, ids: np.ndarray) -> np.ndarray:
        bit = (mixed(ids.view(np.uint64)) & np.uint64(self.bits - 1)).astype(np.int64)
        return (np.frombuffer(self.sent.value, np.uint8)[bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1

    def among(self, column: str) -> Column:
        """Whether the ids of a column may be among them; a null may be. Only the ids go to Python, the row's other columns wait in the JVM."""
        has = self.has

        @F.pandas_udf("boolean")
        def may(x: pd.Series) -> pd.Series:
            out = np.ones(len(x), bool)
            real = x.notna().to_numpy()
            out[real] = has(x[real].to_numpy().astype(np.int64))
            return pd.Series(out)

        return may(F.col(column).cast("long"))


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose doc_id is certainly not among ids, and the others (those, a few more, and rows without a doc_id): so that only the others, with their texts, need to be shuffled for a join."""
    name = unused(docs, "maybe")
    flagged = docs.withColumn(name, Marks(ids).among("doc_id"))
    return flagged.filter(~F.col(name)).drop(name), flagged.filter(F.col(name)).drop(name)
