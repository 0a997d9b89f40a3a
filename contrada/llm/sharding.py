"""Contiguous shards of near equal bytes: global prefix sums of sizes, cut at equal targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import discard, unused, written
from .order import placed

SHARDS = 8
#: A group of equal texts is kept in one shard if its bytes are at most so many percent of a shard's.
WHOLE_PERCENT = 1


def _digest(text):
    return F.md5(F.coalesce(text, F.lit("")))


@dataclass
class Cut:
    """The first row of a shard: its number, and its place in the order by digest of the text and doc_id (None where the shard begins behind the last row)."""

    row: int
    digest: str | None = None
    doc_id: int | None = None


def cuts_of(at: DataFrame, shards: int, percent: int = WHOLE_PERCENT) -> list[Cut]:
    """Cuts between shards, of placed rows (digest, doc_id, size, row, before). Only the rows and groups that hold a target come to the driver: shards - 1 at most.

    A target lies in a row, and that in its group of equal texts. The cut goes to the nearer edge of the group, or where that is over
    `percent` of a shard, of the row; of equally near edges to the first.
    """
    total = at.agg(F.max(F.col("before") + F.col("size"))).first()[0]
    if total is None:
        return []
    wide = f"cast({shards} as decimal(38, 0))"
    first = F.expr(f"({wide} * before + {total - 1}) div {total}")
    last = F.expr(f"({wide} * (before + size) + {total - 1}) div {total} - 1")
    held = at.withColumn("k1", F.greatest(first, F.lit(1))).withColumn("k2", F.least(last, F.lit(shards - 1))).filter("k1 <= k2").collect()
    same = at.join(F.broadcast(at.sparkSession.createDataFrame([(d,) for d in {r["digest"] for r in held}], "digest string")), "digest")
    edges = same.groupBy("digest").agg(F.min("before").alias("a"), F.max(F.col("before") + F.col("size")).alias("b"), F.min("row").alias("i"), (F.max("row") + 1).alias("j"))
    groups = {g["digest"]: g for g in edges.collect()}
    rows = [0] * (shards - 1)
    for r in held:
        g = groups[r["digest"]]
        a, b, i, j = g["a"], g["b"], g["i"], g["j"]
        if (b - a) * shards * 100 > total * percent:
            a, b, i, j = r["before"], r["before"] + r["size"], r["row"], r["row"] + 1
        for k in range(r["k1"], r["k2"] + 1):
            rows[k - 1] = i if 2 * k * total <= shards * (a + b) else j
    known = {r["row"]: r for r in at.join(F.broadcast(at.sparkSession.createDataFrame([(x,) for x in sorted(set(rows))], "row long")), "row").collect()} if rows else {}
    return [Cut(x, known[x]["digest"], known[x]["doc_id"]) if x in known else Cut(x) for x in rows]


def sharded(docs: DataFrame, shards: int = SHARDS, percent: int = WHOLE_PERCENT) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard (from 0), slot (from 0 in its shard), grown_shard (null: the law is not one of keys).

    Shards are contiguous in the order of the text's digest, then doc_id, so equal texts lie side by side: a group of them is divided only
    where it is over `percent` of a shard, and a shard is off its target by half a row or half such a group. A row larger than a
    shard has one of its own, and others may then be empty. A null text counts as an empty one, a null doc_id comes first of its group,
    rows that repeat have a slot each, an empty table gives none. Texts are read once and not shuffled; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), _digest(F.col("text")).alias("digest"))
    at = placed(rows, ["digest", "doc_id"], F.col("size"), "shards")
    starts = [0, *[c.row for c in cuts_of(at, shards, percent)]]
    begun = F.filter(F.array(*[F.lit(x).cast("long") for x in starts]), lambda x: x <= F.col("row"))
    numbered = at.withColumn("begun", begun)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), (F.size("begun") - 1).alias("shard"), (F.col("row") - F.array_max("begun")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 1, percent: int = WHOLE_PERCENT) -> DataFrame:
    """Writes whole rows of docs as Parquet, a folder for each shard (shard=0, ...) of about `files` files in the shard's order, and reads them back with that column.

    A row's shard is told by comparing its digest and doc_id with the cuts, without a join; of rows that repeat across a cut all go behind
    it. A column named shard of docs is kept as shard_.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"), _digest(F.col("text")).alias("digest"))
    at = placed(rows, ["digest", "doc_id"], F.col("size"), "shards")
    cuts = cuts_of(at, shards, percent)
    discard(at)
    docs = docs.withColumnsRenamed({c: unused(docs, "shard_") for c in docs.columns if c.lower() == "shard"})
    digest = unused(docs, "digest")
    place = lambda d, i: F.struct(d.alias("d"), i.isNotNull().alias("n"), F.coalesce(i, F.lit(0)).cast("long").alias("i"))
    own = place(F.col(digest), F.col("doc_id").cast("long"))
    behind = [own >= place(F.lit(c.digest), F.lit(c.doc_id).cast("long")) for c in cuts if c.digest is not None]
    number = sum((F.when(x, 1).otherwise(0) for x in behind), F.lit(0))
    dealt = docs.withColumn(digest, _digest(F.col("text"))).withColumn("shard", number).repartitionByRange(shards * files, "shard", digest, "doc_id").sortWithinPartitions("shard", digest, "doc_id")
    dealt.drop(digest).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(docs.schema.add("shard", IntegerType())).parquet(path)
