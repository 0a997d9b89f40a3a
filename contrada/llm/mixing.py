"""Mixing sources to target weights: fixed-length blocks, multinomial counts for each output shard, keyed index permutations, one join by index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import chunks, mixed, words
from .common import partitions, tidy, unused, written

BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 1024, 20250101
#: Weights of the sources by code point, repeating; and the most that a document is taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents whose places are summed up in one window, about; rows of sums that one window sums up; and slots that are worked on together.
_BUCKET, _GROUP, _SLOTS = 1024, 1024, 1 << 17


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of the sum of sizes by weight; a share above most * size stops there, the excess is dealt to the others by weight until none is above."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """index under a keyed pseudorandom permutation of 0..size-1, elementwise: a four-round Feistel network, walked until the value is within."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.int64)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(4):
            left, right = right, left ^ (mixed(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r * 0x2545F4914F6CDD1D % (1 << 64))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _before(sums: DataFrame, key: str, index: str, value: str, name: str) -> DataFrame:
    """sums (key, index, value: one row each) with `name`, the sum of value over the smaller indexes of the key: running sums of groups of _GROUP indexes, and within each, so that no key is in one task as a whole."""
    rows = sums.withColumn("group", F.expr(f"{index} div {_GROUP}"))
    groups = rows.groupBy(key, "group").agg(F.sum(value).alias("all"))
    so_far = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = groups.select(F.col(key).alias("of"), F.col("group").alias("g"), F.coalesce(F.sum("all").over(so_far(key).orderBy("group")), F.lit(0)).alias("base"))
    placed = rows.join(first, rows[key].eqNullSafe(first["of"]) & (rows["group"] == first["g"]))
    return placed.withColumn(name, F.col("base") + F.coalesce(F.sum(value).over(so_far(key, "group").orderBy(index)), F.lit(0))).drop("group", "of", "g", "base")


def laid_out(docs: DataFrame) -> tuple[DataFrame, list]:
    """Each row's size in words and its place in its source's stream, and the sources (one row each, on the driver: name, size)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    buckets = max(1, math.ceil(sized.count() / _BUCKET))
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    sums = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "sums")
    sources = sorted(((r["source"], r["words"]) for r in sums.groupBy("source").agg(F.sum("words").alias("words")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    bases = _before(sums, "source", "bucket", "words", "from").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "from")
    placed = sized.join(bases, sized["source"].eqNullSafe(bases["s"]) & (sized["bucket"] == bases["b"]))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "source", "size", (F.col("from") + F.coalesce(F.sum("size").over(within), F.lit(0))).alias("start")), sources


def slots(spark, sizes: list[int], wanted: list[float], block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix: one row for each slot of each output shard: shard, slot, src (number of the source), block (its index in the source).

    A source of n blocks gets about target / mean block size slots in all. Each shard's counts are one multinomial draw; a source's
    running number beyond its share goes to sources still below theirs, so totals hold whatever was drawn. The running number picks the
    block by a permutation, a new one each time round.
    """
    blocks = np.array([-(-x // block) for x in sizes], np.int64)
    share = np.array([round(t * n / x) if x else 0 for t, n, x in zip(wanted, blocks.tolist(), sizes, strict=True)], np.int64)
    total = int(share.sum())
    shards = -(-total // shard_slots)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for m in pdf["id"]:
                n = min(shard_slots, total - m * shard_slots)
                c = np.random.default_rng([seed, m]).multinomial(n, share / total)
                s = np.flatnonzero(c)
                rows.append(pd.DataFrame({"shard": m, "src": s, "n": c[s], "slot": np.cumsum(c[s]) - c[s]}))
            if rows:
                yield pd.concat(rows)

    drawn = written(spark.range(shards).mapInPandas(draw, "shard long, src int, n long, slot long"), "draws")
    sums = np.zeros(len(sizes), np.int64)
    for r in drawn.groupBy("src").agg(F.sum("n").alias("n")).collect():  # one row for each source
        sums[r["src"]] = r["n"]
    excess, lack = np.maximum(sums - share, 0), np.maximum(share - sums, 0)
    first_excess, lack_ends = np.cumsum(excess) - excess, np.cumsum(lack)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            part = np.cumsum(pdf["n"].to_numpy()) // _SLOTS
            for p in np.unique(part):
                yield expanded(pdf[part == p])

    def expanded(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        at = np.repeat(np.arange(len(pdf)), n)
        k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        src, j = pdf["src"].to_numpy()[at].astype(np.int64), pdf["before"].to_numpy()[at] + k
        over = np.flatnonzero(j >= share[src])
        if len(over):
            rank = first_excess[src[over]] + j[over] - share[src[over]]
            to = np.searchsorted(lack_ends, rank, "right")
            src[over], j[over] = to, sums[to] + rank - (lack_ends[to] - lack[to])
        size = blocks[src]
        key = mixed((src.astype(np.uint64) << np.uint64(8)) + (j // size).astype(np.uint64) + np.uint64(seed))
        return pd.DataFrame({"shard": pdf["shard"].to_numpy()[at], "slot": pdf["slot"].to_numpy()[at] + k, "src": src, "block": permuted(j % size, size, key)})

    # Draws are few bytes and many slots: they are dealt to as many tasks as their slots ask for.
    tasks = max(partitions(drawn), -(-total // (8 * _SLOTS)))
    running = _before(drawn, "src", "shard", "n", "before").select("shard", "src", "n", "slot", "before")
    return running.repartition(tasks, "shard").mapInPandas(tidy(assign), "shard long, slot long, src int, block long")


class Mix:
    """The mix of docs (doc_id, text, source): documents, pieces (of documents, by block) and slots (of output shards)."""

    def __init__(self, docs: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        spark = docs.sparkSession
        placed, sources = laid_out(docs)
        sizes = [w for _, w in sources]
        wanted = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(sizes))], most)
        # As an Arrow table it goes to the JVM as it is; rows of Python would need workers of another kind, with a daemon of their own, which stay.
        columns = [range(len(sizes)), [s for s, _ in sources], sizes, wanted]
        kinds = pa.schema([("src", pa.int32()), ("name", pa.string()), ("source_size", pa.int64()), ("target", pa.float64())])
        about = spark.createDataFrame(pa.table([pa.array(x, f.type) for x, f in zip(columns, kinds, strict=True)], schema=kinds))
        #: doc_id, source, size, start (its first word's place in the source's stream), src, source_size, target.
        self.documents = written(placed.join(about, placed["source"].eqNullSafe(about["name"])).drop("name"), "placed")
        ends = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
        begins = F.greatest("start", F.col("block") * block)
        cut = self.documents.filter("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
        #: src, block and the document's words in it: doc_id, source, size, start, first (word of the document, from 0), words.
        self.pieces = cut.select("src", "block", "doc_id", "source", "size", "start", (begins - F.col("start")).alias("first"), (ends - begins).alias("words"))
        #: shard, slot, src, block.
        self.slots = slots(spark, sizes, wanted, block, shard_slots, seed)

    def used(self) -> DataFrame:
        """pieces with uses: how many slots have their block. The planner would judge the slots' size by the few draws that they come from, and broadcast them."""
        uses = self.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
        return self.pieces.join(uses.hint("merge"), ["src", "block"])

    def rows(self) -> DataFrame:
        """The mix itself: for each slot of each output shard the pieces of documents in its block, in order: shard, slot, src, block, part (from 0), doc_id, first, words."""
        part = (F.row_number().over(Window.partitionBy("shard", "slot").orderBy("start")) - 1).alias("part")
        return self.slots.hint("merge").join(self.pieces, ["src", "block"]).select("shard", "slot", "src", "block", part, "doc_id", "first", "words")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size, source, source_size, target, taken.

    size: words (a null or empty text has none, very long ones are counted whole). Sources by code point, null last, weigh `weights` in
    turn; see targets() for their targets and slots() for the mix. taken: words of the document in the blocks that the mix takes, repeats
    counted; never above most * size. The same rows give the same mix, in whatever order and partitions. Rows that repeat take part as
    documents of their own. One row for each source comes to the driver. An empty table gives none; other columns are not read.
    """
    mix = Mix(docs, **how)
    taken = mix.used().groupBy("src", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = mix.documents.join(taken, ["src", "start"], "left")
    return out.select("doc_id", "size", "source", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs: the words that it takes of a document, as often as it takes them, in runs without a gap; a document that it takes whole is one row with the whole text. All other columns are as they were.

    Documents without words are not in the mix. Rows with one doc_id, source and size (and so repeated rows, or those without a doc_id)
    cannot be told apart: each takes what the first of them would. An empty table gives none; columns of any names pass through.
    """
    key = ("doc_id", "source", "size")
    used = Mix(docs, **how).used()
    firsts = used.groupBy(*key).agg(F.min("start").alias("low"))
    own = used.join(firsts.select(*[F.col(c).alias(f"k_{c}") for c in key], "low"), F.col("doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("source").eqNullSafe(F.col("k_source")) & (F.col("size") == F.col("k_size"))).filter("start = low")
    listed = own.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("first", "words", "uses"))).alias("runs"))  # of one document
    n, a, b, c, runs = (unused(docs, x) for x in ("n", "a", "b", "c", "runs"))
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = docs.withColumn(n, size)
    side = listed.select(F.col("doc_id").alias(a), F.col("source").alias(b), F.col("size").alias(c), F.col("runs").alias(runs))
    joined = sized.join(side, sized["doc_id"].eqNullSafe(side[a]) & sized["source"].eqNullSafe(side[b]) & (sized[n] == side[c])).select(*docs.columns, runs)
    names = docs.columns
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, texts = [], []
            lists = batch.column(len(batch.columns) - 1).to_pylist()
            for r0, _, data, offsets in chunks(batch.column(at)):
                s, e, first = words(data, offsets)
                raw = data.tobytes()
                for r in range(len(offsets) - 1):
                    total = int(first[r + 1] - first[r])
                    for time in range(1, max(x["uses"] for x in lists[r0 + r]) + 1):
                        spans = []
                        for x in lists[r0 + r]:
                            if x["uses"] >= time:
                                if spans and spans[-1][1] == x["first"]:
                                    spans[-1][1] += x["words"]
                                else:
                                    spans.append([x["first"], x["first"] + x["words"]])
                        for f, t in spans:
                            whole = f == 0 and t == total
                            texts.append(raw[offsets[r] : offsets[r + 1]] if whole else raw[s[first[r] + f] : e[first[r] + t - 1]])
                            owner.append(r0 + r)
            index = pa.array(owner, pa.int64())
            cols = [c.take(index) for c in batch.columns[:-1]]
            cols[at] = pa.array([x.decode() for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(tidy(cut), docs.schema)
