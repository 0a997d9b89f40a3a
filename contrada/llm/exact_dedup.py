"""Exact dedup: static binary-fuse filters screen new digests, positives meet exact buckets, new copies are grouped by themselves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mixed
from .common import Marks, lower_ascii, parted, unused, written

#: Distinct digests of a snapshot that one filter holds, about.
KEYS_PER_FILTER = 100_000


class BinaryFuseFilter:
    """An immutable 3-wise binary-fuse filter with 16-bit fingerprints: no false negatives, 2^-16 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    @staticmethod
    def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        """Three slots of each key, in three neighbouring segments, and its fingerprint."""
        h = mixed(keys + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        first = (h >> np.uint64(32)).astype(np.int64) % segments
        h2 = mixed(h)
        within = np.stack([(h & np.uint64(0xFFFFFFFF)), (h2 >> np.uint64(32)), (h2 & np.uint64(0xFFFFFFFF))]).astype(np.int64) % segment
        return (first + np.arange(3)[:, None]) * segment + within, (mixed(h2) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuseFilter:
        """Keys are unsigned 64-bit, repeats allowed. Slots that only one key uses are peeled until none is left; prints are set in reverse order. A seed that leaves a core is followed by the next."""
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 1)
        segment = 1 << max(2, int(math.log(n) / math.log(3.33) + 2.25))
        spread = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
        segments = max(1, math.ceil(n * spread / segment) - 2)
        seed = 0
        while True:
            seed += 1
            slots, prints = cls._slots(keys, seed, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            total = np.zeros(size, np.int64)
            for row in slots:
                np.add.at(total, row, np.arange(len(keys)))
            order, own, left = [], [], len(keys)
            ready = np.flatnonzero(count == 1)
            while len(ready):
                peeled, at = np.unique(total[ready], return_index=True)
                order.append(peeled)
                own.append(ready[at])
                left -= len(peeled)
                gone = slots[:, peeled].ravel()
                np.subtract.at(count, gone, 1)
                np.subtract.at(total, gone, np.tile(peeled, 3))
                touched = np.unique(gone)
                ready = touched[count[touched] == 1]
            if left == 0:
                break
            if seed % 10 == 0:
                segments += 1
        table = np.zeros(size, np.uint16)
        for peeled, at in zip(reversed(order), reversed(own), strict=True):
            three = slots[:, peeled]
            value = prints[peeled] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
            table[at] ^= value
        return cls(seed, segment, segments, table)

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key], np.uint64))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = self._slots(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.prints[slots[0]] ^ self.prints[slots[1]] ^ self.prints[slots[2]]) == prints


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """One immutable filter for each shard of a snapshot's digests (column key, long): shard, seed, segment, segments, prints. shards bounds what a task holds: keys / shards."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = BinaryFuseFilter.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "prints": [f.prints.tobytes()]})

    return digests.select(F.pmod("key", F.lit(shards)).alias("shard"), "key").groupBy("shard").applyInPandas(one, "shard long, seed long, segment long, segments long, prints binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Rows of incoming (column key, one row for each digest) that a snapshot's filters may hold; no held key is missed."""
    kinds = incoming.schema
    names = incoming.columns

    def one(own: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(pdf):
            return pdf[names].iloc[:0]
        r = own.iloc[0]
        f = BinaryFuseFilter(int(r["seed"]), int(r["segment"]), int(r["segments"]), np.frombuffer(r["prints"], np.uint16))
        return pdf[names][f.has(pdf["key"].to_numpy(np.int64).view(np.uint64))]

    keyed = incoming.withColumn("shard", F.pmod("key", F.lit(shards)))
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(one, kinds)


def exact_groups(docs: DataFrame, in_snapshot=None, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, in_snapshot.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest doc_id stays. in_snapshot: which rows are the
    immutable snapshot (default: half of them, by a hash of doc_id); the others come in against its filters. A null text counts as
    empty; a very long one is hashed whole in the JVM. Rows that repeat a doc_id and its text are one document and are marked alike;
    group_size counts them all. A null doc_id is below any other; a group of such only has a null keep_id and all its rows are kept.
    An empty table gives none. Other columns of docs are not read.
    """
    snap = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    text = lower_ascii(F.coalesce("text", F.lit("")))
    rows = written(docs.select("doc_id", snap.alias("in_snapshot"), F.sha2(text, 256).alias("text_sha256"), F.octet_length(text).alias("n")), "digests")
    # Copies within the snapshot and within the new batch are grouped separately; partial sums come before the shuffle.
    groups = written(rows.groupBy("text_sha256", "n", "in_snapshot").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size")).withColumn("key", F.xxhash64("text_sha256", "n")), "groups")
    old, new = groups.filter("in_snapshot"), groups.filter("not in_snapshot")
    shards = max(1, math.ceil(old.count() / keys_per_filter))
    maybe = screen(new, written(build_filters(old, shards), "filters"), shards)
    pairs = written(maybe.select("text_sha256", "n", F.col("top").alias("new_top"), F.col("size").alias("new_size")).join(old.select("text_sha256", "n", F.col("top").alias("old_top"), F.col("size").alias("old_size")), ["text_sha256", "n"]), "pairs")
    # The bytes of one document from either side of a pair are compared; only texts of these documents are shuffled.
    sides = pairs.select("text_sha256", "n", F.explode(F.array("new_top", "old_top")).alias("doc_id")).filter("doc_id is not null").distinct()
    few = docs.select("doc_id", "text").filter(Marks(sides.select(F.col("doc_id").cast("long")).distinct()).among("doc_id")).filter("doc_id is not null")
    texts = few.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("t")).join(sides, "doc_id").filter(F.sha2("t", 256) == F.col("text_sha256"))
    differ = texts.groupBy("text_sha256", "n").agg(F.min("t").alias("low"), F.max("t").alias("high")).filter("low <> high").select("text_sha256", "n")
    both = pairs.join(differ, ["text_sha256", "n"], "left_anti").select("text_sha256", "n", F.greatest("new_top", "old_top").alias("all_top"), (F.col("new_size") + F.col("old_size")).alias("all_size"))
    # Only groups of several rows are joined back; a text that stands alone keeps itself.
    final = groups.join(both, ["text_sha256", "n"], "left").select("text_sha256", "n", "in_snapshot", F.coalesce("all_top", "top").alias("keep_id"), F.coalesce("all_size", "size").alias("group_size")).filter("group_size > 1").withColumn("several", F.lit(True))
    out = rows.join(final, ["text_sha256", "n", "in_snapshot"], "left").withColumn("keep_id", F.when(F.col("several"), F.col("keep_id")).otherwise(F.col("doc_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "in_snapshot")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs without copies: of equal texts the row with the largest doc_id stays, all columns as they were.

    Of rows that repeat a doc_id and its text one stays. Null and empty texts are equal; rows without a doc_id stay one for each text where
    no row with a doc_id has it. Columns of any names pass through. Texts of doc_ids of which every row stays are not shuffled.
    """
    rows = written(exact_groups(docs, **how).select("doc_id", "kept", "text_sha256"), "kept")
    odd = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and("kept").alias("all")).filter("n > 1 or not all").select(F.col("doc_id").cast("long"))
    sure, rest = parted(docs, written(odd, "odd"))
    sha, key, of = (unused(docs, n) for n in ("sha", "key", "of"))
    stay = rows.filter("kept").select(F.col("doc_id").alias(of), F.col("text_sha256").alias(key)).distinct()
    named = rest.withColumn(sha, F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    return sure.unionByName(named.join(stay, named["doc_id"].eqNullSafe(stay[of]) & (named[sha] == stay[key]), "left_semi").dropDuplicates(["doc_id", sha]).drop(sha))
