"""N-gram Jaccard join: documents that share enough word shingles, by a blocked sparse product of the document by n-gram incidence.

A document's row of the incidence matrix is its set of shingle hashes, rarest first. Two sets with a Jaccard similarity of t or more
share one of their first |s| - ceil(t |s|) + 1 columns in that order, so the product is first taken over these columns only: pairs that
meet in a column are discarded where their sizes and places in the order leave too small an overlap, those that meet otherwise where the
count of all columns that their prefixes share does. For the pairs that are left the product is completed over the whole rows, and its
counts decide which of them link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import mixed, shingle_sets
from .common import Marks, discard, parted, partitions, tidy, written
from .components import components

#: Words of a shingle, and the similarity from which documents link, in hundredths.
WORDS, PERCENT = 5, 80
#: The commonness of shingles is counted in 2^SKETCH_BITS counters: a fixed size, for the order only, never for a result.
SKETCH_BITS = 20
_PART = 1 << 16
#: Rows and cells of a block of the product, about, and columns that are multiplied together.
BLOCK, CELLS, _SLICE = 512, 1 << 19, 1024
#: Pairs of rows of a product up to which they are compared one by one, together with those of other products.
_PAIRS = 64


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """Of each row: doc_id, n (shingles), h1 and h2 (128 bits of the set); besides, of each task its counters in parts (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        seen = False
        for b in batches:
            seen = True
            rows = len(b)
            n, h = np.zeros(rows, np.int64), np.zeros((2, rows), np.uint64)
            held, cells = [], 0
            for i, own in shingle_sets(b.column(1), words):
                n[i] = len(own)
                h[0, i], h[1, i] = mixed(own).sum(dtype=np.uint64), mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                held.append(own & mask)
                cells += len(own)
                if cells >= len(counts) // 2:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                    held, cells = [], 0
            if held:
                counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            none = pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), *none], names=["doc_id", "n", "h1", "h2", "part", "counts"])
        if seen:
            parts = [np.minimum(counts[at : at + _PART], 65535).astype(np.uint16).tobytes() for at in range(0, len(counts), _PART)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.int64())] * 3, pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "n", "h1", "h2", "part", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, n long, h1 long, h2 long, part int, counts binary")


def _commonness(parts: DataFrame) -> bytes:
    """The tasks' counters, summed in a tree; as one byte each: the binary logarithm. 2^SKETCH_BITS bytes in all, whatever the input."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(_PART, np.float64)
        for c in table.column("counts").to_pylist():
            a = np.frombuffer(c, np.uint16 if len(c) == 2 * _PART else np.float64)
            total[: len(a)] += a
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "salt": pa.array([table.column("salt")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    for fan in (4096, 64, 1):
        parts = parts.withColumn("salt", (F.monotonically_increasing_id() if fan == 4096 else F.col("salt")) % fan).withColumn("salt", F.col("salt").cast("int")) if fan > 1 else parts.withColumn("salt", F.lit(0))
        parts = parts.groupBy("part", "salt").applyInArrow(add, "part int, salt int, counts binary")
    whole = np.zeros(1 << SKETCH_BITS, np.float64)
    for r in parts.collect():  # 2^SKETCH_BITS / 2^16 rows
        whole[r["part"] * _PART : (r["part"] + 1) * _PART] = np.frombuffer(r["counts"], np.float64)
    return np.log2(whole + 1).astype(np.uint8).tobytes()


def _entries(docs: DataFrame, ids: DataFrame, words: int, percent: int, common) -> DataFrame:
    """The columns in which partners of the rows named by ids (id, distinct) must meet them: gram, id, place (n * 2^32 + position in the order, rarest first). Rows that the bitmap lets through besides have entries too."""
    marks = Marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(common.value, np.uint8)
        mask = np.uint64(len(level) - 1)
        for b in batches:
            b = b.filter(pa.array(marks.has(np.asarray(b.column(0)))))
            at, lists, sizes = [], [], []
            for i, own in shingle_sets(b.column(1), words):
                if len(own):
                    keep = len(own) - -(-percent * len(own) // 100) + 1
                    order = np.argsort(level[(own & mask).astype(np.int64)], kind="stable")[:keep]
                    at.append(i)
                    lists.append(own[order].view(np.int64))
                    sizes.append(len(own))
            if at:
                count = np.array([len(x) for x in lists])
                ends = np.cumsum(count)
                place = np.arange(ends[-1]) - np.repeat(ends - count, count) + (np.repeat(np.array(sizes, np.int64), count) << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), b.column(0).take(pa.array(np.repeat(at, count))), pa.array(place)], names=["gram", "id", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null").mapInArrow(tidy(run), "gram long, id long, place long")


def _reaches(na, nb, ia, ib, percent: int):
    """Whether sets of na and nb that meet first at places ia and ib of the order can still overlap enough: o * (100 + p) >= p * (na + nb)."""
    return (1 + np.minimum(na - ia - 1, nb - ib - 1)) * (100 + percent) >= percent * (na + nb)


def _most(shared, na, nb, percent: int):
    """The largest overlap of sets of na and nb whose prefixes share so many columns: of two rows the one whose prefix ends first in the common order shares no more columns outside the prefixes than its remainder has."""
    return shared + np.maximum(-(-percent * na // 100), -(-percent * nb // 100)) - 1


def _shared(dealt: DataFrame, percent: int) -> DataFrame:
    """The entries of columns with at least two rows, from sorted columns, each with the first of its column (the hub) and whether sizes and places let the two link. One entry waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = (0, 0, 0)  # gram, id and place of the column that goes on from the batch before
        wait, before = None, None
        for b in batches:
            if not len(b):
                continue
            if wait is not None:
                b = pa.Table.from_batches([wait, b]).combine_chunks().to_batches()[0]
            gram, doc, place = (np.asarray(b.column(i)) for i in range(3))
            same = gram[1:] == gram[:-1]
            goes_on = before is not None and gram[0] == before
            at = np.maximum.accumulate(np.where(np.concatenate(([not goes_on], ~same)), np.arange(len(gram)), -1))
            h, hp = (np.where(at >= 0, x[np.maximum(at, 0)], old) for x, old in ((doc, hub[1]), (place, hub[2])))
            keep = np.concatenate(([goes_on], same)) | np.concatenate((same, [False]))
            last = len(gram) - 1
            keep[last] = False
            if last:
                before = gram[last - 1]
                hub = (before, h[last - 1], hp[last - 1])
            wait = b.slice(last)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, doc, place, h, _reaches(hp >> 32, place >> 32, hp & 0xFFFFFFFF, place & 0xFFFFFFFF, percent) & (h != doc))], names=["gram", "id", "place", "hub", "near"])
        if wait is not None and before is not None and wait.column(0)[0].as_py() == before:
            p = wait.column(2)[0].as_py()
            near = bool(_reaches(hub[2] >> 32, p >> 32, hub[2] & 0xFFFFFFFF, p & 0xFFFFFFFF, percent)) and hub[1] != wait.column(1)[0].as_py()
            yield pa.RecordBatch.from_arrays([*wait.columns, pa.array([hub[1]], pa.int64()), pa.array([near])], names=["gram", "id", "place", "hub", "near"])

    return dealt.select("gram", "id", "place").mapInArrow(tidy(run), "gram long, id long, place long, hub long, near boolean")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The columns that each row of x shares with each row of y: the product of two sparse blocks, summed up over slices of _SLICE columns."""
    sides = [(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)) for rows in (x, y)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    counts = np.zeros((len(x), len(y)), np.float32)
    cells = []
    for row, gram in sides:
        at = np.minimum(np.searchsorted(both, gram), max(0, len(both) - 1))
        real = both[at] == gram if len(both) else np.zeros(len(gram), bool)
        cells.append((row[real], at[real]))
    for low in range(0, len(both), _SLICE):
        dense = []
        for rows, (row, at) in zip((x, y), cells, strict=True):
            own = (at >= low) & (at < low + _SLICE)
            m = np.zeros((len(rows), min(_SLICE, len(both) - low)), np.float32)
            m[row[own], at[own] - low] = 1
            dense.append(m)
        counts += dense[0] @ dense[1].T
    return counts.astype(np.int64)


def _dealt(placed: DataFrame, percent: int) -> DataFrame:
    """The rows (id, comp, n, cells, block) for each pair of blocks, block_a and block_b, their own with itself too, where they may have partners of another component.

    The other block has a column of theirs from which sizes and places let two link, and as many of their columns as a partner of one of its
    sizes must share (see _most); and it has rows of which the same holds the other way round. So a column that two rows share by chance
    brings neither of them to the other's block.
    """
    cells = placed.select("id", "comp", "n", "block", F.explode("cells").alias("c")).select("id", "comp", "n", "block", "c.gram", "c.rest")
    columns = cells.groupBy("gram", F.col("block").alias("other")).agg(F.max("rest").alias("rest_b"), F.min("n").alias("n_b"), F.max("n").alias("most_b"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    reach = (1 + F.least("rest", "rest_b")) * (100 + percent) >= percent * (F.col("n") + F.col("n_b"))
    found = cells.join(columns, "gram").filter((F.col("low") != F.col("comp")) | (F.col("high") != F.col("comp")))
    met = found.groupBy("id", "n", "block", "other").agg(F.bool_or(reach).alias("reaches"), F.count(F.lit(1)).alias("c"), F.min("n_b").alias("low"), F.max("most_b").alias("high")).filter("reaches")
    # _most is convex in the partner's size, so it is largest at an end; rounded up by at most 99 hundredths.
    enough = [(100 * (F.col("c") - 1) + percent * F.greatest("n", end) + 99) * (100 + percent) >= 100 * percent * (F.col("n") + F.col(end)) for end in ("low", "high")]
    both = met.filter(enough[0] | enough[1]).withColumns({"block_a": F.least("block", "other"), "block_b": F.greatest("block", "other")}).groupBy("block_a", "block_b")
    sides = both.agg(F.collect_list("id").alias("ids"), *[F.bool_or(F.col("block") == F.col(c)).alias(f"of_{c}") for c in ("block_a", "block_b")]).filter("of_block_a and of_block_b and size(ids) > 1")
    return sides.select("block_a", "block_b", F.explode("ids").alias("id")).join(placed.select("id", "comp", "n", "cells", "block"), "id")


def _few(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, gram: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows x and y (numbers of rows whose columns are at `offsets` of gram and rest): the columns that they share, and what the first of these leaves of both (-1: they share none)."""
    shared, first = np.zeros(len(x), np.int64), np.full(len(x), -1, np.int64)
    width = np.diff(offsets)
    names, code = np.unique(gram, return_inverse=True)
    keys = np.repeat(np.arange(len(width)), width) * len(names) + code
    order = np.argsort(keys)
    keys, left = keys[order], rest[order]
    x, y = np.where(width[x] <= width[y], (x, y), (y, x))
    ends = np.cumsum(width[x])
    low = 0
    while low < len(x):
        # Some pairs at a time, for their columns are laid out.
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CELLS, "right")))
        size = width[x[low:high]]
        starts = np.cumsum(size) - size
        cell = np.repeat(offsets[x[low:high]] - starts, size) + np.arange(size.sum())
        key = np.repeat(y[low:high], size) * len(names) + code[cell]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        same = keys[at] == key
        shared[low:high] = np.add.reduceat(same, starts, dtype=np.int64)
        first[low:high] = np.maximum.reduceat(np.where(same, np.minimum(rest[cell], left[at]), -1), starts)
        low = high
    return shared, first


def _many(a: np.ndarray, b: np.ndarray, offsets: np.ndarray, gram: np.ndarray, rest: np.ndarray, ok) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of rows a and b those that ok(columns shared) lets stay, as places in a and b, and what the first shared column leaves of both."""
    grams, rests = ([v[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)] for v in (gram, rest))
    x, y = np.nonzero(ok(_overlaps([grams[i] for i in a], [grams[i] for i in b])))
    first = np.zeros(len(x), np.int64)
    for i in np.unique(x).tolist():
        here = np.flatnonzero(x == i)
        own, to = a[i], b[y[here]]
        order = np.argsort(grams[own])
        theirs, left = (np.concatenate([v[j] for j in to]) for v in (grams, rests))
        at = order[np.minimum(np.searchsorted(grams[own], theirs, sorter=order), len(order) - 1)]
        both = np.where(grams[own][at] == theirs, np.minimum(rests[own][at], left), -1)
        sizes = np.array([len(grams[j]) for j in to])
        first[here] = np.maximum.reduceat(both, np.cumsum(sizes) - sizes)
    return x, y, first


def _multiplied(t: pa.Table, percent: int) -> pa.RecordBatch:
    """The pairs (block: the number of their blocks' product, hub, id, cells) that can still link, of whole pairs of blocks whose rows lie side by side: those of few rows all at once, larger ones by the product of their blocks."""
    ids, comp, n, blocks, block_a, block_b = (t.column(c).to_numpy() for c in ("id", "comp", "n", "block", "block_a", "block_b"))
    cells = t.column("cells").combine_chunks()
    offsets = np.asarray(cells.offsets).astype(np.int64)
    gram, rest = (np.asarray(cells.values.field(k))[offsets[0] : offsets[-1]] for k in (0, 1))
    offsets = offsets - offsets[0]
    starts = np.flatnonzero(np.concatenate(([True], (block_a[1:] != block_a[:-1]) | (block_b[1:] != block_b[:-1]))))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
    a, b = np.flatnonzero(blocks == block_a), np.flatnonzero(blocks == block_b)
    (from_a, count_a), (from_b, count_b) = ((np.searchsorted(group[v], np.arange(len(starts))), np.bincount(group[v], minlength=len(starts))) for v in (a, b))
    pairs = count_a * count_b

    def can(x, y, shared):
        once = (block_a[x] != block_b[x]) | (x < y)
        return once & (comp[x] != comp[y]) & (shared > 0) & (_most(shared, n[x], n[y], percent) * (100 + percent) >= percent * (n[x] + n[y]))

    per = np.where(pairs <= _PAIRS, pairs, 0)
    of = np.repeat(np.arange(len(starts)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    x, y = a[from_a[of] + k // count_b[of]], b[from_b[of] + k % count_b[of]]
    maybe = can(x, y, len(gram)) & (np.minimum(n[x], n[y]) * (100 + percent) >= percent * (n[x] + n[y]))
    x, y = x[maybe], y[maybe]
    shared, first = _few(x, y, offsets, gram, rest)
    stay = can(x, y, shared) & ((1 + first) * (100 + percent) >= percent * (n[x] + n[y]))
    found = [(x[stay], y[stay])]
    for g in np.flatnonzero(pairs > _PAIRS).tolist():
        low, high = starts[g], starts[g] + np.count_nonzero(group == g)
        own, to = (v[s[g] : s[g] + c[g]] for v, s, c in ((a, from_a, count_a), (b, from_b, count_b)))
        x, y, first = _many(own - low, to - low, offsets[low : high + 1] - offsets[low], gram[offsets[low] : offsets[high]], rest[offsets[low] : offsets[high]], lambda shared, own=own, to=to: can(own[:, None], to[None], shared))
        x, y = own[x], to[y]
        stay = (1 + first) * (100 + percent) >= percent * (n[x] + n[y])
        found.append((x[stay], y[stay]))
    x, y = (np.concatenate(v) for v in zip(*found, strict=True))
    product = (mixed(block_a[x].view(np.uint64)) + mixed(block_b[x].view(np.uint64) * np.uint64(3))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (product, np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), n[x] + n[y])], names=["block", "hub", "id", "cells"])


def _product(entries: DataFrame, percent: int, block: int = BLOCK, most_cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """Of the columns' entries (gram, id, place, hub, comp): hub < id, the pairs of different components that can still link, with the number of the blocks' product; and the table of blocks that they are made from.

    Rows are put into blocks of up to about `block`, or `most_cells` cells, by the hub that they have most columns with, so that likely partners are together.
    Two blocks meet in a task where a column has rows of both whose sizes and places let two link; of each block only those rows are sent
    there that have such a column and enough columns of the other's, so that rows travel by the partners that they may have and not by those of
    their block. The overlaps of the rows sent are counted over all columns, and pairs whose count, or whose place in the first column that they
    share, leaves too small an overlap are discarded (see _most and _reaches). Only pairs that are left leave the task, so a group of near
    copies that do not link costs products, not rows. Small products are taken many at a time.
    """
    several = entries.groupBy("gram").agg((F.min("comp") != F.max("comp")).alias("several")).filter("several")
    own = entries.join(several, "gram", "left_semi").withColumn("n", F.expr("place >> 32"))
    rows = own.groupBy("id").agg(F.max("comp").alias("comp"), F.max("n").alias("n"), F.mode("hub", True).alias("home"), F.collect_set(F.struct("gram", (F.col("n") - F.expr("place & 4294967295") - 1).alias("rest"))).alias("cells"))
    rows = rows.withColumn("width", F.size("cells"))
    rows = written(rows, "prefix_rows")
    parts = rows.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("width") / most_cells)).alias("parts"))
    placed = written(rows.join(parts, "home").select("id", "comp", "n", "cells", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")), "blocks")
    discard(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in batches:
            if not len(b):
                continue
            block_a, block_b = (np.asarray(b.column(c)) for c in ("block_a", "block_b"))
            cut = int(np.flatnonzero((block_a == block_a[-1]) & (block_b == block_b[-1]))[0])
            now = block_a[-1], block_b[-1]
            # The last pair of blocks may go on in the next batch.
            if held and (cut or last != now):
                yield _multiplied(pa.Table.from_batches([*held, b.slice(0, cut)]), percent)
                held = []
            elif cut:
                yield _multiplied(pa.Table.from_batches([b.slice(0, cut)]), percent)
            held.append(b.slice(cut))
            last = now
        if held:
            yield _multiplied(pa.Table.from_batches(held), percent)

    sent = _dealt(placed, percent).select("block_a", "block_b", "block", "id", "comp", "n", "cells")
    return sent.repartition("block_a", "block_b").sortWithinPartitions("block_a", "block_b").mapInArrow(tidy(run), "block long, hub long, id long, cells long"), placed


def _rows_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """The whole incidence rows of the documents named by ids (id, distinct), and of few others that the bitmap of the ids, which is sent to the scan, lets through; texts stay where they are."""
    marks = Marks(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(marks.has(np.asarray(b.column(0)))))
            if len(b):
                lists = [np.sort(own.view(np.int64)) for _, own in shingle_sets(b.column(1), words)]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists)))], names=["id", "grams"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null").mapInArrow(tidy(run), "id long, grams array<long>")


def near_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, class_id.

    Words are runs of bytes other than white space after lower-casing A-Z; a set holds the distinct runs of `words` words, or the whole
    sequence of a shorter text as one. A shingle is known by a 64-bit hash, equality of sets by 128 bits and the size. Documents link when
    100 * intersection >= percent * union of their sets; component_id is the smallest doc_id that links reach. A null, empty or blank text
    has no shingles and links with nothing; very long texts are taken whole. class_id: the smallest doc_id with the same set; only
    classes are compared, so copies never multiply. Rows that repeat a doc_id with other texts are one document where the doc_id
    is the smallest of one of these texts: the links of all its texts count. A row without a doc_id cannot be named: it takes no part and its ids are null. An empty table gives none; other columns are not read.

    Each column's first entry (its hub) is compared with the others, so that a group of near copies is joined by about as many pairs as it
    has members; then blocks of rows are multiplied for what is left between components that share a column.
    """
    spark = docs.sparkSession
    profiles = written(_profiles(docs, words), "profiles")
    common = spark.sparkContext.broadcast(_commonness(profiles.filter("part is not null").select("part", "counts")))
    rows = profiles.filter("part is null").select("doc_id", "n", "h1", "h2")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    members = written(rows.join(classes, ["h1", "h2", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id")), "members")
    discard(profiles)
    named = members.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("id"), "class_id")
    first = named.filter("id = class_id").select("id").distinct()

    # The columns: an entry for each class and each shingle of its prefix, dealt by shingle; the likeliest centre of a group comes first.
    dealt = _entries(docs, first, words, percent, common).repartition("gram").sortWithinPartitions("gram", F.expr("place & 4294967295"), "place", "id")
    shared = written(_shared(dealt, percent), "columns")
    prefixes = written(shared.groupBy("id").agg(F.array_sort(F.collect_set("gram")).alias("grams"), F.max(F.expr("place >> 32")).alias("n")), "prefixes")
    met = written(shared.filter("near").groupBy("hub", "id").agg(F.count(F.lit(1)).alias("c")), "met")
    star = written(_in_blocks(met, prefixes.select("id", "n")), "star_blocks")
    near = written(_enough(star, prefixes, percent), "star")
    links = _completed(docs, near, words, percent, "links")
    discard(prefixes, met, star, near)
    comp = written(components(links.select(F.col("hub").alias("a"), F.col("id").alias("b"))), "comp")
    # Copies that the bitmap let through end here.
    known = shared.select("gram", "id", "place", "hub").join(first, "id", "left_semi").join(comp, "id", "left").select("gram", "id", "place", "hub", F.coalesce("root", "id").alias("comp"))
    left, blocks = _product(known, percent)
    left = written(left, "left")
    discard(shared, blocks)
    # Links between components join these, as edges of their roots.
    bundles = written(_in_bundles(left), "left_blocks")
    more = _completed(docs, bundles, words, percent, "more")
    root = lambda c, name: comp.select(F.col("id").alias(c), F.col("root").alias(name))
    edges = more.join(root("hub", "x"), "hub", "left").join(root("id", "y"), "id", "left").select(F.coalesce("x", "hub").alias("a"), F.coalesce("y", "id").alias("b"))
    joined = components(edges)
    discard(links, left, bundles, more)
    joined = joined.select(F.col("id").alias("top"), F.col("root").alias("over"))
    found = members.join(root("class_id", "root"), "class_id", "left").withColumn("top", F.coalesce("root", "class_id")).join(joined, "top", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("over", "top").alias("component_id"), "class_id")


def _bundled(sizes: DataFrame, key: str, most_cells: int = CELLS) -> DataFrame:
    """Of blocks (key, cells): key, parts (in which a block has no more than `most_cells` cells) and bundle, the block that small ones share: a block for each few rows would cost more to hand over than to count."""
    total = sizes.agg(F.ceil(F.greatest(F.lit(partitions(sizes)), 2 * F.sum("cells") / most_cells)).alias("bundles"))
    return sizes.crossJoin(F.broadcast(total)).select(key, F.ceil(F.col("cells") / most_cells).alias("parts"), F.pmod(F.xxhash64(key), "bundles").alias("bundle"))  # total: one row


def _in_blocks(star: DataFrame, sizes: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """Pairs (hub, id, c: columns that they share) with a block each: those of an id are in one, and ids with the same likeliest hub are together while their whole rows (sizes: id, n) have no more than `most_cells` cells."""
    home = star.groupBy("id").agg(F.max_by("hub", F.struct("c", "hub")).alias("home")).join(sizes, "id")
    parts = _bundled(home.groupBy("home").agg(F.sum("n").alias("cells")), "home", most_cells)
    block = F.when(F.col("parts") > 1, F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(F.col("bundle")).alias("block")
    return star.join(home.join(parts, "home").select("id", block), "id").select("block", "hub", "id")


def _in_bundles(pairs: DataFrame, most_cells: int = CELLS) -> DataFrame:
    """Pairs (block, hub, id, cells: those of both rows) with small blocks bundled; a large block is kept as it is."""
    parts = _bundled(pairs.groupBy("block").agg(F.sum("cells").alias("cells")), "block", most_cells)
    return pairs.join(parts, "block").select(F.when(F.col("parts") > 1, F.col("block")).otherwise(F.col("bundle")).alias("block"), "hub", "id")


def _counted(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs (block, hub, id) with the columns that their rows (id, grams in order, n) share: block, hub, id, c, n1, n2. A row is sent to a block once, however many pairs it has there."""
    needs = pairs.select(F.col("block").alias("at"), F.explode(F.array("hub", "id")).alias("id")).distinct()
    dealt = needs.join(rows.select("id", "grams", "n"), "id").select("at", "id", "n", "grams")

    def count(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, n = own.column("id").to_numpy(), own.column("n").to_numpy()
        grams = own.column("grams").combine_chunks()
        offsets, flat = np.asarray(grams.offsets).astype(np.int64), np.asarray(grams.values)
        order = np.argsort(ids, kind="stable")
        hub, to = (asked.column(c).to_numpy() for c in ("hub", "id"))
        # A doc_id that repeats with other texts has several rows: all of them count.
        ends = [[np.searchsorted(ids, x, side, sorter=order) for side in ("left", "right")] for x in (hub, to)]
        (low_h, high_h), (low, high) = ends
        several = (high_h - low_h) * (high - low)
        pair = np.repeat(np.arange(len(hub)), several)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(several) - several, several)
        per = (high - low)[pair]
        at_hub, at = order[low_h[pair] + k // np.maximum(per, 1)], order[low[pair] + k % np.maximum(per, 1)]
        hub, to = hub[pair], to[pair]
        shared = np.zeros(len(hub), np.int64)
        for i, (x, y) in enumerate(zip(at_hub.tolist(), at.tolist(), strict=True)):
            mine, theirs = flat[offsets[x] : offsets[x + 1]], flat[offsets[y] : offsets[y + 1]]
            if len(mine):
                place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                shared[i] = np.count_nonzero(mine[place] == theirs)
        block = asked.column("block")[0].as_py() if len(asked) else 0
        return pa.table({"block": pa.array(np.full(len(hub), block, np.int64)), "hub": pa.array(hub), "id": pa.array(to), "c": pa.array(shared), "n1": pa.array(n[at_hub]), "n2": pa.array(n[at])})

    return dealt.groupBy("at").cogroup(pairs.groupBy("block")).applyInArrow(count, "block long, hub long, id long, c long, n1 long, n2 long")


def _enough(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """The pairs (block, hub, id) that can still link by the count of columns that their prefixes share (prefixes: id, grams, n)."""
    longest = F.greatest(*[F.floor((percent * F.col(n) + 99) / 100) - 1 for n in ("n1", "n2")])  # as in _most
    return _counted(pairs, prefixes).filter((F.col("c") + longest) * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))).select("block", "hub", "id")


def _completed(docs: DataFrame, pairs: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """The pairs (block, hub, id) that link, by the product of their whole rows: 100 * overlap >= percent * union."""
    ids = pairs.select(F.explode(F.array("hub", "id")).alias("id")).distinct()
    rows = _rows_of(docs, ids, words).withColumn("n", F.size("grams").cast("long"))
    linked = _counted(pairs, rows).filter(F.col("c") * (100 + percent) >= percent * (F.col("n1") + F.col("n2")))
    return written(linked.select("hub", "id").distinct(), name)


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, the one of the smallest doc_id; all columns as they were.

    Null, empty and blank texts all stay, and so do rows without a doc_id. Rows that repeat a doc_id, with one text or several, stay or go
    together. Columns of any names pass through. Only the texts that may go are shuffled.
    """
    found = near_components(docs, words, percent).filter("doc_id is not null")
    gone = written(found.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).filter("not stays").select("doc_id"), "gone")
    sure, rest = parted(docs, gone)
    return sure.unionByName(rest.join(gone, "doc_id", "left_anti").select(*docs.columns))
