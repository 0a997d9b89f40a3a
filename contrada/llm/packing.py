"""Packing token ids into windows: repeat counts of length combinations by non-negative least squares, the rest greedily.

A combination is a few lengths that fill the window to the last id, so that documents in it stay whole. What no combination takes is laid
end to end and cut at window ends.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, written
from .tokens import encoder

WINDOW = 1024
#: Ids that are packed together, about: what a task holds at a time. The last window of each such shard may be padded.
SHARD_TOKENS = 2_000_000
#: Bytes of texts that are encoded at a time: arrays over their characters take some 45 times as much.
ENCODED_BYTES = 1 << 17
#: Tasks up to which their sequence numbers are broadcast: 16 bytes each.
BROADCAST_TASKS = 500_000
#: Combinations that are drawn, their lengths at most, and plans that are made, each for what the one before left.
DRAWS, DEPTH, PLANS = 2000, 64, 4
#: Distinct lengths up to which combinations of four are enumerated too: about its cube / 24, as many as there are of three of any lengths.
FOUR_OF = 128


def filling(counts: np.ndarray, window: int, depth: int) -> np.ndarray:
    """All combinations of depth (2 or more) lengths that fill the window and do not hold a length more often than it occurs, as rows of lengths, longest first."""
    have = np.flatnonzero(counts[: window + 1])
    have = have[have > 0]
    heads = [()]
    for _ in range(depth - 2):
        heads = [(*h, v) for h in heads for v in have[(have >= (h[-1] if h else 1))].tolist() if sum(h) + (depth - len(h)) * v <= window]
    made = [np.zeros((0, depth), np.int64)]
    for h in heads:
        rest = window - sum(h)
        v = have[np.searchsorted(have, h[-1] if h else 1) : np.searchsorted(have, rest // 2, "right")]
        v = v[rest - v < len(counts)]
        v = v[counts[rest - v] > 0]
        made.append(np.column_stack([rest - v, v, *(np.full(len(v), x) for x in reversed(h))]))
    out = np.concatenate(made)
    often = (out[:, :, None] == out[:, None, :]).sum(2)
    return out[(often <= counts[out]).all(1)]


def combinations(counts: np.ndarray, window: int, seed: int = 0) -> np.ndarray:
    """Combinations of lengths that occur and fill the window, as rows of lengths (0: none), longest first: all of two and three lengths, all of four where up to FOUR_OF lengths occur, and deeper ones that are drawn as often as their lengths occur, until a length that occurs fills the rest."""
    have = np.flatnonzero(counts)
    shallow = [filling(counts, window, k) for k in ((2, 3, 4) if len(have) <= FOUR_OF else (2, 3))]
    drawn = np.random.default_rng(seed).choice(have, (DRAWS, DEPTH), p=counts[have] / counts[have].sum()) if len(have) else np.zeros((0, DEPTH), np.int64)
    rest = window - np.cumsum(drawn, 1)  # after each length
    closes = (rest > 0) & (rest < len(counts)) & (counts[np.clip(rest, 0, len(counts) - 1)] > 0)
    closes[:, : len(shallow)] = False  # such are among the shallow ones
    rows, at = np.flatnonzero(closes.any(1)), closes.argmax(1)
    rows = rows[at[rows] + 1 < DEPTH]
    deep = np.where(np.arange(DEPTH) <= at[rows][:, None], drawn[rows], 0)
    deep[np.arange(len(rows)), at[rows] + 1] = rest[rows, at[rows]]
    deep = np.unique(-np.sort(-deep, axis=1), axis=0)
    width = max(len(shallow) + 1, int((deep > 0).sum(1).max(initial=0)))
    out = np.zeros((sum(len(x) for x in shallow) + len(deep), width), np.min_scalar_type(window))  # narrow, as there are many rows
    at = 0
    for x in (*shallow, deep[:, :width]):
        out[at : at + len(x), : x.shape[1]] = x
        at += len(x)
    return out


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 of the least |A x - target|, where column j of A counts the lengths in columns[j]; accelerated projected gradient over columns scaled to sum 1."""
    real = columns > 0
    flat, size = columns[real].astype(np.int64), real.sum(1)
    first = np.cumsum(size) - size

    def product(x):
        return np.bincount(flat, weights=np.repeat(x / size, size), minlength=len(target))

    step = 1.0 / max(1e-9, product(np.ones(len(size))).max())  # a column's sum is 1, this is the largest of a row
    x = y = np.zeros(len(size))
    t = 1.0
    goal = np.where(np.arange(len(target)) > 0, target, 0).astype(float)
    for _ in range(rounds):
        rest = product(y) - goal
        new = np.maximum(0.0, y - step * np.add.reduceat(rest[flat], first) / size)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x / size


def plan(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of the combinations to use; no more of a length than counts has. The solution is rounded, then combinations are used as long as lengths are left for them, the likeliest first."""
    left, out = counts.copy(), []
    for again in range(PLANS):
        columns = combinations(left, window, again)
        if not len(columns):
            break
        x = nnls(columns, left)
        order = np.argsort(-x, kind="stable")
        for wanted in (np.rint(x).astype(np.int64), np.full(len(x), int(left.sum()))):
            have = left > 0
            have[0] = True
            able = (wanted > 0) & have[columns].all(1)
            for j in order[able[order]].tolist():
                each = Counter(columns[j][columns[j] > 0].tolist())
                times = min(int(wanted[j]), *(int(left[v]) // n for v, n in each.items()))
                if times > 0:
                    for v, n in each.items():
                        left[v] -= n * times
                    out.append((tuple(each.elements()), times))
    return out


def pack(sizes: np.ndarray, window: int = WINDOW) -> tuple[dict[str, np.ndarray], int]:
    """Pieces (doc, start, length, sequence, offset) of documents of so many ids, by doc and start; and the number of sequences."""
    full, rest = sizes // window, sizes % window
    docs = np.repeat(np.arange(len(sizes)), full)
    k = np.arange(len(docs)) - np.repeat(np.cumsum(full) - full, full)
    made = [(docs, k * window, np.full(len(docs), window), np.arange(len(docs)), np.zeros(len(docs), np.int64))]
    at = len(docs)
    order = np.argsort(rest, kind="stable")
    counts = np.bincount(rest, minlength=window + 1)
    head = np.concatenate(([0], np.cumsum(counts)))[:-1].copy()
    ends = head + counts
    for lengths, times in plan(counts * (np.arange(len(counts)) > 0), window):
        offset = 0
        for v in lengths:
            own = order[head[v] : head[v] + times]
            head[v] += times
            made.append((own, full[own] * window, np.full(times, v), at + np.arange(times), np.full(times, offset)))
            offset += v
        at += times
    left = np.concatenate([order[head[v] : ends[v]] for v in range(window - 1, 0, -1)])
    if len(left):
        size = rest[left]
        place = np.cumsum(size) - size
        room = window - place % window
        cut = size > room
        made.append((left, full[left] * window, np.minimum(size, room), at + place // window, place % window))
        own = left[cut]
        made.append((own, full[own] * window + room[cut], (size - room)[cut], at + place[cut] // window + 1, np.zeros(len(own), np.int64)))
        at += -(-int(size.sum()) // window)
    doc, start, length, sequence, offset = (np.concatenate(x).astype(np.int64) for x in zip(*made, strict=True))
    by = np.lexsort((start, doc))
    return {"doc": doc[by], "start": start[by], "length": length[by], "sequence": sequence[by], "offset": offset[by]}, at


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 0) -> DataFrame:
    """The pieces of all docs (doc_id, text): doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    A document is its ids and then end_id; a null or empty text is end_id alone, a very long one is encoded and cut whole. Whole windows stand alone; what is left of a document is
    combined with others, in shards of about SHARD_TOKENS ids within a task, so nothing is shuffled but one number for each task. Each id
    is in exactly one piece. A sequence holds up to `window` ids; only the last of a shard can hold fewer. sequence_id counts from 0.
    Rows that repeat, or whose doc_id is null, are packed as documents of their own. An empty table gives none; other
    columns are not read.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, local long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, base = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, lists, sizes, held = [], [], [], 0

        def close():
            nonlocal base
            n = np.concatenate(sizes)
            pieces, made = pack(n, window)
            ids = np.concatenate(lists).astype("<u4")
            ends = np.concatenate(([0], np.cumsum(pieces["length"]))) * 4
            doc_ids = pa.chunked_array(names).combine_chunks()
            for a in range(0, len(pieces["doc"]), 10_000):  # by document and start, so the ids are there in order
                s = slice(a, a + 10_000)
                cut = ends[a : a + 10_001]
                binary = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut - cut[0]).astype(np.int32)), pa.py_buffer(ids[cut[0] // 4 : cut[-1] // 4])])
                d = pieces["doc"][s]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(d)), pa.array(pieces["start"][s]), pa.array(pieces["length"][s]), binary, pa.array(n[d]), pa.array(np.full(len(d), part)), pa.array(base + pieces["sequence"][s]), pa.array(pieces["offset"][s])], names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "local", "offset"])
            base += made
            for x in (names, lists, sizes):
                x.clear()

        for b in batches:
            for at, end, ids, first, _, _ in enc.column(b.column(1), ENCODED_BYTES):
                n = np.diff(first)
                names.append(b.column(0).slice(at, end - at))
                lists.append(np.insert(ids, first[1:], np.uint32(end_id)))
                sizes.append(n + 1)
                held += len(lists[-1])
                if held >= SHARD_TOKENS:
                    yield from close()
                    held = 0
        if names:
            yield from close()

    pieces = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema), "pieces")
    made = pieces.groupBy("part").agg(F.max("local").alias("last"))
    bases = made.select("part", (F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("base"))
    small = made.count() <= BROADCAST_TASKS  # one row for each task; else the pieces are shuffled by task
    return pieces.join(F.broadcast(bases) if small else bases, "part").select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset")
