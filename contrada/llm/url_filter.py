"""URL filters: explicit rules, and for the rest a cascade of Bloom filters that knows the listed hosts of the whole corpus exactly.

Level 0 encodes the listed keys; level 1 those unlisted keys of the universe that level 0 lets through; level 2 the listed ones that
level 1 lets through; and so on until none is. The first level that lacks a key of the universe tells whether it is listed.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import mixed
from .common import lower_ascii, written

#: Keys of the universe in a shard, about; bytes of all cascades up to which they are broadcast.
SHARD_KEYS, BROADCAST_BYTES = 200_000, 32 << 20

#: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _places(k1: np.ndarray, k2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    a = mixed(k1 + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mixed(k2 ^ a) | np.uint64(1)
    return ((a + np.arange(hashes, dtype=np.uint64)[:, None] * b) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """levels: (bits, hashes, bitmap) in turn."""

    def __init__(self, levels: list[tuple[int, int, np.ndarray]]):
        self.levels = levels

    @classmethod
    def build(cls, listed: tuple[np.ndarray, np.ndarray], others: tuple[np.ndarray, np.ndarray]) -> Cascade:
        """Of the listed keys and all other keys of the universe, each as two hashes of 64 bits; no key is in both."""
        inside, outside, levels = listed, others, []
        while len(inside[0]):
            n = len(inside[0])
            rate = min(0.5, max(1e-6, n * math.sqrt(0.5) / max(1, len(outside[0])))) if not levels else 0.5
            hashes = max(1, round(-math.log2(rate)))
            bits = max(8, math.ceil(n * hashes / math.log(2)))
            bitmap = np.zeros(-(-bits // 8), np.uint8)
            at = np.unique(_places(*inside, len(levels), bits, hashes))
            np.bitwise_or.at(bitmap, at >> 3, (1 << (at & 7)).astype(np.uint8))
            levels.append((bits, hashes, bitmap))
            hit = cls._has(levels[-1], len(levels) - 1, *outside)
            inside, outside = (outside[0][hit], outside[1][hit]), inside
        return cls(levels)

    @staticmethod
    def _has(level, number: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        bits, hashes, bitmap = level
        at = _places(k1, k2, number, bits, hashes)
        return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed; of other keys the answer is a guess."""
        out, open_ = np.full(len(k1), len(self.levels) % 2 == 1), np.arange(len(k1))
        for i, level in enumerate(self.levels):
            hit = self._has(level, i, k1[open_], k2[open_])
            out[open_[~hit]] = i % 2 == 1
            open_ = open_[hit]
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<i", len(self.levels)) + b"".join(struct.pack("<qi", b, h) + m.tobytes() for b, h, m in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Cascade:
        (n,), at, levels = struct.unpack_from("<i", raw), 4, []
        for _ in range(n):
            bits, hashes = struct.unpack_from("<qi", raw, at)
            levels.append((bits, hashes, np.frombuffer(raw, np.uint8, -(-bits // 8), at + 12)))
            at += 12 + -(-bits // 8)
        return cls(levels)


def _keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return pdf["k1"].to_numpy(np.int64).view(np.uint64), pdf["k2"].to_numpy(np.int64).view(np.uint64)


def cascades(universe: DataFrame, shards: int) -> DataFrame:
    """One cascade for each shard of the universe (key, listed: distinct keys): shard, cascade."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf["listed"].to_numpy(bool)
        built = Cascade.build(_keys(pdf[on]), _keys(pdf[~on]))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "cascade": [built.to_bytes()]})

    return hashed(universe, "key", shards).select("shard", "k1", "k2", "listed").groupBy("shard").applyInPandas(one, "shard long, cascade binary")


def hashed(df: DataFrame, key: str, shards: int) -> DataFrame:
    return df.withColumn("k1", F.xxhash64(key)).withColumn("k2", F.xxhash64(F.lit("second"), F.col(key))).withColumn("shard", F.pmod("k1", F.lit(shards)))


def member(df: DataFrame, key: str, built: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a column listed, by the cascades; key is a column of df, of the universe. Cascades of up to broadcast_bytes in all go to every task; larger ones go to their shard, whose rows are salted into even parts."""
    built = written(built, "cascades")
    size = built.agg(F.sum(F.octet_length("cascade"))).first()[0] or 0
    keyed = hashed(df, key, shards)
    fields = T.StructType([*df.schema.fields, T.StructField("listed", T.BooleanType())])
    names = df.columns
    if size <= broadcast_bytes:
        sent = df.sparkSession.sparkContext.broadcast({r["shard"]: r["cascade"] for r in built.collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by = {s: Cascade.from_bytes(raw) for s, raw in sent.value.items()}
            for b in batches:
                k1, k2, shard = (np.asarray(b.column(len(names) + i)) for i in range(3))
                listed = np.zeros(len(b), bool)
                for s in np.unique(shard).tolist():
                    own = shard == s
                    if s in by:
                        listed[own] = by[s].has(k1[own].view(np.uint64), k2[own].view(np.uint64))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(listed)], names=[*names, "listed"])

        return keyed.mapInArrow(run, fields)
    salts = max(1, -(-df.count() // (shards * SHARD_KEYS)))

    def own(cascade: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[names].copy()
        out["listed"] = Cascade.from_bytes(cascade["cascade"].iloc[0]).has(*_keys(pdf)) if len(cascade) and len(pdf) else False
        return out

    salted = keyed.withColumn("salt", F.floor(F.rand(1) * salts).cast("long"))
    copies = built.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return copies.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInPandas(own, fields)


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    tail = F.coalesce(F.substr(url, F.length(rest) + 4), F.lit(""))
    host = F.regexp_extract(tail, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(tail, F.length(host) + 1), r"^[^?#]*", 0)


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    A rule fits its host and all subdomains, if the path starts with the rule's; the longest (host and path together, then the first
    given) wins. Pages that no rule fits are blocked if their host is listed, else allowed. A host is listed if rules block more of its
    pages than they allow; the list is looked up in cascades over all hosts of pages. A null url, or one without ://, has an empty host
    and path, which no rule fits; a very long url is like others. Rows that repeat are judged alike and each counts; an empty table gives
    none. Other columns are not read.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    ruled = parts.withColumn("rule", rule).withColumn("ruled", verdict)
    # Partial sums before the shuffle: a host with a third of all pages is one row of each task.
    universe = written(ruled.groupBy(F.col("host").alias("key")).agg((F.count_if(F.col("ruled") == "block") > F.count_if(F.col("ruled") == "allow")).alias("listed")), "hosts")
    shards = max(1, math.ceil(universe.count() / SHARD_KEYS))
    known = member(ruled, "host", cascades(universe, shards), shards)
    return known.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
