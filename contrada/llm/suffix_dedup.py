"""Suffix-array dedup: bytes covered by strings of a set length that start more than once in the corpus go.

A repeat is found where its anchor is: the least hash among its short grams, which is the same wherever the repeat stands. Stretches whose
windows share an anchor are dealt by it; stretches that two 64-bit hashes of all their bytes tell to be equal, besides the anchor's own, are
repeats as they are. Of the others every window holds the same core (known by a 64-bit hash), which becomes one symbol, so that a shard's suffix array, built by induced sorting, is over the core's
neighbourhood only; suffixes whose permuted common prefix with the one before them in the array is a window long are repeats.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import chunks, mixed, span_hashes
from .common import tidy, written

LENGTH, GRAM, WIDTH = 200, 32, 16
#: Symbols of a shard's suffix array, about; of a core with more rows each window is known by a hash, and these are counted: the same result without an array that would not fit.
SHARD_SYMBOLS, HOT_ROWS = 200_000, 50_000
#: Longest string length: sizes and places of stretches are kept in so many bits.
MOST_LENGTH, _BITS = 16_384, 15
_PIECE = 1 << 23
#: Another numbering of the bytes, by the squares of odd numbers modulo a prime: hashes of bytes so numbered do not collide where others do.
_OTHER = np.argsort(np.arange(1, 512, 2) ** 2 % 65_537 * 40_503 % 65_537).astype(np.uint8)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of text (whole numbers), by induced sorting: suffixes are classed, leftmost-smaller substrings sorted and named, recursively where names repeat, and all others induced from them in two passes."""
    s = np.append(np.unique(text, return_inverse=True)[1] + 1, 0) if len(text) else np.zeros(1, np.int64)
    return np.array(_induced(s.astype(np.int64)), np.int64)[1:]


def _induced(s: np.ndarray) -> list[int]:
    n = len(s)
    if n == 1:
        return [0]
    # A suffix is smaller (True) than the next one where its first differing symbol is.
    differs = np.flatnonzero(s[:-1] != s[1:])
    following = differs[np.searchsorted(differs, np.arange(n - 1))]
    small = np.append(s[following] < s[following + 1], True)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    sym, is_small = s.tolist(), small.tolist()

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = tails.copy()
        for i in reversed(order):
            c = sym[i]
            tail[c] -= 1
            sa[tail[c]] = i
        head = heads.copy()
        for k in range(n):
            j = sa[k] - 1
            if j >= 0 and not is_small[j]:
                c = sym[j]
                sa[head[c]] = j
                head[c] += 1
        tail = tails.copy()
        for k in range(n - 1, -1, -1):
            j = sa[k] - 1
            if j >= 0 and is_small[j]:
                c = sym[j]
                tail[c] -= 1
                sa[tail[c]] = j
        return sa

    sa = np.array(induce(lms.tolist()))
    flag = np.zeros(n, bool)
    flag[lms] = True
    by = sa[flag[sa]]
    # Names: substrings from one leftmost-smaller place to the next, equal ones alike.
    end = np.append(lms[1:], n - 1)
    stop = np.zeros(n, np.int64)
    stop[lms] = end
    size = stop[by] - by + 1
    size[by == n - 1] = 1
    same = np.zeros(len(by), bool)
    rows = np.flatnonzero(size[1:] == size[:-1]) + 1
    same[rows] = True
    k = 0
    while len(rows):
        rows = rows[size[rows] > k]
        equal = (s[by[rows] + k] == s[by[rows - 1] + k]) & (small[by[rows] + k] == small[by[rows - 1] + k])
        same[rows[~equal]] = False
        rows = rows[equal]
        k += 1
    name = np.cumsum(~same) - 1
    named = np.zeros(n, np.int64)
    named[by] = name
    if name[-1] + 1 < len(by):
        order = lms[np.array(_induced(named[lms]))].tolist()
    else:
        order = by.tolist()
    return induce(order)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, in the order of the text, the suffix before it in the array (-1: none) and how many symbols above 0 both begin with, up to `most`: from one suffix to the next that number falls by one at most."""
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    sym, out, h = [*text.tolist(), 0], [0] * len(text), 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        while h < most and sym[i + h] == sym[j + h] and sym[i + h] > 0:
            h += 1
        out[i] = h
        h = max(0, h - 1)
    return before, np.array(out, np.int64)


def repeated_windows(strings: list[np.ndarray], window: int) -> list[np.ndarray]:
    """Of strings of whole numbers from 1: for each the starts of its windows that are also elsewhere in any of them; permuted common prefixes, up to the window, tell."""
    sizes = np.array([len(x) for x in strings], np.int64)
    text = np.concatenate([y for x in strings for y in (x, [0])]) if strings else np.zeros(0, np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    before, common = permuted_common_prefixes(text, suffix_array(text), window)
    hit = np.zeros(len(text) + 1, bool)
    long_ = common >= window
    hit[np.flatnonzero(long_)] = hit[before[long_]] = True
    return [np.flatnonzero(hit[f : f + n]) for f, n in zip(first.tolist(), sizes.tolist(), strict=True)]


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w numbers in a row, by running minima of blocks from either side."""
    n = len(x) - w + 1
    y = np.concatenate((x, np.full(-len(x) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    left = np.minimum.accumulate(y, 1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def _stretches(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(row, start, size, anchor place, anchor, content, second hash of the content) of the stretches of windows with one anchor; starts within the row's bytes."""
    w = length - gram + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    at = np.arange(len(data) - gram + 1)
    hashes = span_hashes(data, at, at + gram)
    low = np.uint64((1 << 24) - 1)
    least = _least((hashes & ~low) | at.astype(np.uint64), w)
    anchor = (least & low).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    p = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[row + 1])
    anchor, row = anchor[p], row[p]
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (p[1:] != p[:-1] + 1))) if len(p) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p))[: len(first)] - 1
    start, end, anchor, row = p[first], p[last] + length, anchor[first], row[first]
    content = mixed(span_hashes(data, start, end) + (anchor - start).astype(np.uint64))
    return row, start - offsets[row], end - start, anchor - start, hashes[anchor].view(np.int64), content.view(np.int64), span_hashes(_OTHER[data], start, end).view(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """A piece of text as it is, or a very long document in parts that overlap by a window but one."""
    if len(data) <= _PIECE:
        yield data, offsets, 0
        return
    for r in range(len(offsets) - 1):
        for a in range(int(offsets[r]), max(int(offsets[r]) + 1, int(offsets[r + 1]) - length + 1), _PIECE - length + 1):
            z = min(a + _PIECE, int(offsets[r + 1]))
            own = np.full(len(offsets), 0, np.int64)
            own[r + 1 :] = z - a
            yield data[a:z], own, a - int(offsets[r])


def _packed(start, size, place):
    return (start << (2 * _BITS)) | (size << _BITS) | place


def _unpacked(at):
    return at >> (2 * _BITS), (at >> _BITS) & ((1 << _BITS) - 1), at & ((1 << _BITS) - 1)


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The stretches of docs (id, text): anchor, content, second, id, at (start, size and the anchor's place) and copies: 0, or of stretches that a batch holds more than once 1 for one of them, which goes on to meet other batches', and 2 for the rest, which are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for at, _, data, offsets in chunks(b.column(1)):
                for part, own, before in _pieces(data, offsets, length):
                    row, start, size, place, anchor, content, second = _stretches(part, own, length, gram)
                    made.append((anchor, content, second, at + row, _packed(start + before, size, place)))
            if not made:
                continue
            anchor, content, second, row, at = (np.concatenate(x) for x in zip(*made, strict=True))
            if len(row):
                order = np.lexsort((second, content, anchor))
                same = np.concatenate(([False], np.all([x[order[1:]] == x[order[:-1]] for x in (anchor, content, second)], 0)))
                copies = np.zeros(len(row), np.int8)
                copies[order] = np.where(same, 2, np.where(np.append(same[1:], False), 1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(second), b.column(0).take(pa.array(row)), pa.array(at), pa.array(copies)], names=["anchor", "content", "second", "id", "at", "copies"])

    return docs.mapInArrow(tidy(run), "anchor long, content long, second long, id long, at long, copies tinyint")


def _sorted_runs(dealt: DataFrame) -> DataFrame:
    """Of stretches sorted by anchor and content, that is by both its hashes: those with an equal one (full), and those whose anchor may have unequal ones (check: each single one, and the last of equal ones). Equal stretches are in one partition, but its first and last anchor may go on in others. One row waits for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, before, opening = None, None, None  # before: anchor and both hashes of the content of the row before the waiting one, and whether its anchor had another content by then

        def judged(b: pa.RecordBatch, after) -> pa.RecordBatch:
            nonlocal before, opening
            anchor, content, second = (np.asarray(b.column(k)) for k in range(3))
            opening = anchor[0] if opening is None else opening
            pa_, pc, ps, pe = before if before is not None else (None, None, None, False)
            same_a = np.concatenate(([before is not None and anchor[0] == pa_], anchor[1:] == anchor[:-1]))
            same_c = same_a & np.concatenate(([before is not None and content[0] == pc and second[0] == ps], (content[1:] == content[:-1]) & (second[1:] == second[:-1])))
            next_a = np.append(same_a[1:], after is not None and after[0] == anchor[-1])
            next_c = np.append(same_c[1:], after is not None and after == (anchor[-1], content[-1], second[-1]))
            i = np.arange(len(anchor))
            run_first = np.maximum.accumulate(np.where(~same_c, i, -1))
            earlier = np.where(run_first >= 0, same_a[np.maximum(run_first, 0)], pe) | (anchor == opening)
            full = same_c | next_c | (np.asarray(b.column(5)) > 0)
            check = ~next_c & (earlier | next_a)
            check[-1] |= after is None
            before = (anchor[-1], content[-1], second[-1], bool(earlier[-1]))
            keep = pa.array(full | check)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(full), pa.array(check)], names=["anchor", "id", "at", "full", "check"]).filter(keep)

        for b in batches:
            if not len(b):
                continue
            if wait is not None:
                b = pa.Table.from_batches([wait, b]).combine_chunks().to_batches()[0]
            last = len(b) - 1
            wait = b.slice(last)
            if last:
                yield judged(b.slice(0, last), tuple(wait.column(k)[0].as_py() for k in range(3)))
        if wait is not None:
            yield judged(wait, None)

    return dealt.select("anchor", "content", "second", "id", "at", "copies").mapInArrow(tidy(run), "anchor long, id long, at long, full boolean, check boolean")


def _cores(joined: DataFrame, length: int, width: int) -> DataFrame:
    """Of texts with the stretches to check: for each class of `width` window starts before the anchor, the core that all its windows hold (key) and the bytes on either side: key, left, right, id, start of left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            counts = np.diff(np.asarray(lists.offsets))
            at_all = np.asarray(lists.flatten())
            first = np.concatenate(([0], np.cumsum(counts)))
            for at, end, data, offsets in chunks(b.column(1)):
                packed = at_all[first[at] : first[end]]
                row = np.repeat(np.arange(at, end), counts[at:end])
                start, size, place = _unpacked(packed)
                low, high = -place, size - length - place  # window starts, from the anchor
                c0, c1 = low // width, high // width
                n = c1 - c0 + 1
                i = np.repeat(np.arange(len(packed)), n)
                c = c0[i] + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                anchor = offsets[row - at][i] + start[i] + place[i]
                lo, hi = np.maximum(low[i], c * width), np.minimum(high[i], c * width + width - 1)
                core_s, core_e = anchor + c * width + width - 1, anchor + c * width + length
                key = mixed(span_hashes(data, core_s, core_e) + (c + 1024).astype(np.uint64))
                left_s, right_e = anchor + lo, anchor + hi + length
                raw = data.tobytes()
                left = [raw[x:y] for x, y in zip(left_s.tolist(), core_s.tolist(), strict=True)]
                right = [raw[x:y] for x, y in zip(core_e.tolist(), right_e.tolist(), strict=True)]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(left, pa.binary()), pa.array(right, pa.binary()), b.column(0).take(pa.array(row[i])), pa.array(left_s - offsets[row - at][i])], names=["key", "left", "right", "id", "start"])

    return joined.mapInArrow(tidy(run), "key long, left binary, right binary, id long, start long")


def _arrays(dealt: DataFrame, length: int, width: int) -> DataFrame:
    """Of rows sorted by core: runs of windows (id, start, end) that are elsewhere, by the suffix arrays of shards of whole cores; of a core with too many rows its windows, to be counted (id, start, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            strings: dict[tuple, list[tuple]] = {}
            for key, left, right, doc, start in rows:
                strings.setdefault((key, left, right), []).append((doc, start))
            # A core with one distinct string needs no array: its rows are equal or alone.
            many = Counter(k for k, _, _ in strings)
            keys = {k: 257 + i for i, k in enumerate(k for k, n in many.items() if n > 1)}
            ordered = sorted(strings.items(), key=lambda x: x[0][0] not in keys)
            arrays = [np.array([*(x + 1 for x in left), keys[k], *(x + 1 for x in right)], np.int64) for (k, left, right), _ in ordered if k in keys]
            hits = repeated_windows(arrays, width) if arrays else []
            hits += [np.zeros(0, np.int64)] * (len(ordered) - len(hits))
            docs, starts, ends = [], [], []
            for ((_, left, right), places), hit in zip(ordered, hits, strict=True):
                if len(places) > 1:
                    hit = np.arange(len(left) + len(right) + 2 - width)
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) > 1)
                    a, z = hit[np.concatenate(([0], cut + 1))].tolist(), hit[np.append(cut, len(hit) - 1)].tolist()
                    for doc, start in places:
                        for x, y in zip(a, z, strict=True):
                            docs.append(doc)
                            starts.append(start + x)
                            ends.append(start + y + length)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.nulls(len(docs), pa.binary())], names=["id", "start", "end", "window"])

        def counted(rows: list[tuple]) -> pa.RecordBatch:
            out = [(doc, start + i, (key, left[i:], right[: width - 1 - len(left) + i])) for key, left, right, doc, start in rows for i in range(len(left) + len(right) + 2 - width)]
            names = [hashlib.blake2b(repr(w).encode(), digest_size=16).digest() for _, _, w in out]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.nulls(len(out), pa.int64()), pa.array(names, pa.binary())], names=["id", "start", "end", "window"])

        shard, core, hot, symbols = [], [], None, 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if core and core[0][0] != r[0] or hot is not None and hot != r[0]:
                    if hot is not None:
                        if core:
                            yield counted(core)
                    elif len(core) > 1:
                        shard += core
                        symbols += sum(len(x[1]) + len(x[2]) + 2 for x in core)
                    core, hot = [], None
                    if symbols >= SHARD_SYMBOLS:
                        yield from found(shard)
                        shard, symbols = [], 0
                core.append(r)
                if len(core) >= HOT_ROWS or hot is not None and len(core) >= 1000:
                    hot = r[0]
                    yield counted(core)
                    core = []
        if hot is not None and core:
            yield counted(core)
        elif len(core) > 1:
            shard += core
        if shard:
            yield from found(shard)

    return dealt.mapInArrow(tidy(run), "id long, start long, end long, window binary")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (id, start, end: bytes, end exclusive; they may overlap) of docs (doc_id, text) that cover exactly the bytes of strings of `length` bytes, up to MOST_LENGTH, that start elsewhere too, in the same or another document."""
    if not 1 <= length <= MOST_LENGTH:
        raise ValueError(f"strings of 1 to {MOST_LENGTH} bytes, not {length}")
    gram, width = min(GRAM, max(1, length // 4)), min(WIDTH, max(1, length // 4))
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id is not null")
    scan = written(_scan(own, length, gram), "scan")
    # By ranges: stretches of one anchor but unequal contents may be in several tasks, equal ones never.
    single = scan.filter("copies < 2").repartitionByRange("anchor", "content").sortWithinPartitions("anchor", "content", "second")
    runs = written(_sorted_runs(single), "stretches")
    checks = runs.filter("check").groupBy("id").agg(F.collect_set("at").alias("at"))  # of one document
    cores = _cores(own.join(checks, "id").select("id", "text", "at"), length, width)
    found = written(_arrays(cores.repartition("key").sortWithinPartitions("key"), length, width), "repeats")
    counted = found.filter("window is not null")
    often = counted.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rest = counted.join(often, "window").select("id", "start", (F.col("start") + length).alias("end"))
    whole = runs.filter("full").select("id", "at").union(scan.filter("copies = 2").select("id", "at"))
    start, size = F.shiftright("at", 2 * _BITS), F.shiftright("at", _BITS).bitwiseAND(F.lit((1 << _BITS) - 1))
    return whole.select("id", start.alias("start"), (start + size).alias("end")).union(found.filter("window is null").select("id", "start", "end")).union(rest)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Each byte of the UTF-8 text that a repeated string of `length` bytes covers goes; all are judged on the input. A null or empty text
    has no bytes, one of many megabytes is scanned in overlapping pieces. A row without a doc_id takes no part and is kept whole; rows that
    repeat are copies of each other, so all they hold in strings of that length goes. An empty table gives none; other columns are not read.
    """
    spans = repeated_spans(docs, length).groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one document
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(spans, rows["doc_id"] == spans["id"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            counts = np.diff(np.asarray(lists.offsets)) * np.asarray(lists.is_valid())
            flat = lists.flatten()
            a, z = (np.asarray(flat.field(k)) for k in (0, 1)) if len(flat) else (np.zeros(0, np.int64),) * 2
            first = np.concatenate(([0], np.cumsum(counts)))
            n_bytes, removed, runs, kept = [], [], [], []
            for at, end, data, offsets in chunks(b.column(1)):
                for r in range(at, end):
                    own = data[offsets[r - at] : offsets[r - at + 1]]
                    n_bytes.append(len(own))
                    if not counts[r]:
                        removed.append(0)
                        runs.append(0)
                        kept.append(own.tobytes())
                        continue
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, a[first[r] : first[r + 1]], 1)
                    np.add.at(edge, z[first[r] : first[r + 1]], -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                    kept.append(own[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
