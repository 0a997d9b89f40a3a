"""Cross-tokenizer alignment: groups of two vocabularies' tokens between common ends, and how often ids are linked in the corpus.

Any stretch of a text is a fragment: tokens before its first common end (open), groups between common ends (closed), tokens behind the
last (open). Two neighbours compose by closing what their open sides make together, which is associative. A document is one fragment
where it is read; a very long one is cut into byte ranges, whose fragments are made in tasks of their own and composed in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import chunks, column_bytes
from .common import discard, partitions, tidy, written
from .pieces import PieceEncoder, piece_encoder
from .tokens import Encoder

#: Documents of more bytes are cut into ranges of about PART bytes.
LONG, PART = 1 << 16, 1 << 15
#: Fragments that are composed at once.
FAN = 16
#: Most frequent pairs of ids whose counts are sent to the workers, 17 bytes each; the others' are joined.
SENT_PAIRS = 1 << 20
#: Links of a group up to which they are laid out one by one; of larger ones ids are counted first.
PLAIN_LINKS = 4096

_COUNTS = "n_a long, n_b long, n_groups long, n_links long"
_ROW = f"row_key long, doc_id long, {_COUNTS}, groups_sha256 string, pairs array<long>, times array<long>"


@lru_cache(2)
def _byte_encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """Digits of the numbers below 2^16 as bytes, and how many each has."""
    x = np.arange(1 << 16)
    size = 1 + (x >= 10) + (x >= 100) + (x >= 1000) + (x >= 10000)
    out = np.zeros((1 << 16, 5), np.uint8)
    for k in range(5):
        out[:, k] = 48 + x // 10 ** np.maximum(size - 1 - k, 0) % 10
    return out, size


@dataclass
class Groups:
    """Groups of rows of tokens: counts of each row, the text of its groups, and its distinct linked pairs (a * 2^16 + b) with how many links each has."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: bytes
    text_at: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    pairs_at: np.ndarray

    def text_of(self, row: int) -> bytes:
        """A row's groups as `a1,a2|b1;a3|b2,b3`."""
        return self.text[self.text_at[row] : max(self.text_at[row], self.text_at[row + 1] - 1)]

    def pairs_of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.pairs_at[row], self.pairs_at[row + 1])
        return self.pairs[own], self.times[own]


def grouped(a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray, stops: np.ndarray) -> Groups:
    """Groups of tokens a and b, whose ends ascend over all rows; every row's end (stops) is an end of both, that of a row without tokens is the one before."""
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    n, rows = len(common), len(stops)
    of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    size_a, size_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    row = np.searchsorted(stops, common)
    per_row = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.searchsorted(row, np.arange(rows + 1))])
    # The text: a's numbers of a group, then b's, each followed by the sign that its place asks for.
    before_a, before_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
    order = np.empty(len(a) + len(b), np.uint32)
    sign = np.full(len(order), ord(","), np.uint8)
    at_a, at_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + before_a[of_b]
    order[at_a], order[at_b] = a, b
    sign[at_a[before_a - 1]] = ord("|")
    sign[at_b[before_b + size_b - 1]] = ord(";")
    digits, length = _decimals()
    size = length[order]
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.empty(begin[-1], np.uint8)
    for k in range(5):
        has = size > k
        text[begin[:-1][has] + k] = digits[order[has], k]
    text[begin[1:] - 1] = sign
    tokens = per_row(size_a + size_b)
    # Links of small groups one by one; of large ones each distinct id by its count.
    small = size_a * size_b <= PLAIN_LINKS
    first_b = before_b
    rep = np.where(small[of_a], size_b[of_a], 0)
    from_a = np.repeat(np.arange(len(a)), rep)
    within = np.arange(len(from_a)) - np.repeat(np.cumsum(rep) - rep, rep)
    keys = [(row[of_a[from_a]].astype(np.int64) << 32) | (a[from_a].astype(np.int64) << 16) | b[first_b[of_a[from_a]] + within].astype(np.int64)]
    weights = [np.ones(len(from_a), np.int64)]
    for g in np.flatnonzero(~small).tolist():
        own_a, times_a = np.unique(a[before_a[g] - size_a[g] : before_a[g]], return_counts=True)
        own_b, times_b = np.unique(b[before_b[g] : before_b[g] + size_b[g]], return_counts=True)
        keys.append((np.int64(row[g]) << 32) | (np.repeat(own_a.astype(np.int64) << 16, len(own_b)) | np.tile(own_b.astype(np.int64), len(own_a))))
        weights.append(np.repeat(times_a, len(own_b)) * np.tile(times_b, len(own_a)))
    key, times = summed(np.concatenate(keys), np.concatenate(weights))
    return Groups(per_row(size_a), per_row(size_b), per_row(np.ones(n, np.int64)), per_row(size_a * size_b), text.tobytes(), begin[np.concatenate(([0], np.cumsum(tokens)))], key & 0xFFFFFFFF, times, np.searchsorted(key >> 32, np.arange(rows + 1)))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(weights, first)


@dataclass
class Side:
    """Tokens of both vocabularies that follow each other: ids and ends in the document."""

    a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end_a: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end_b: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def then(self, other: Side) -> Side:
        return Side(*[np.concatenate(x) for x in zip(self.columns(), other.columns(), strict=True)])

    def cut(self, end: int) -> tuple[Side, Side]:
        """Tokens that end up to a place, and those behind."""
        i, j = np.searchsorted(self.end_a, end, "right"), np.searchsorted(self.end_b, end, "right")
        return Side(self.a[:i], self.end_a[:i], self.b[:j], self.end_b[:j]), Side(self.a[i:], self.end_a[i:], self.b[j:], self.end_b[j:])

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.a, self.end_a, self.b, self.end_b


@dataclass
class Fragment:
    """Open tokens before the first common end (it is their last), whether there is one, open tokens behind the last common end, and closed stretches between, in order. Without a common end all is in `before`."""

    before: Side
    closed: list[Side]
    behind: Side
    has: bool


def fragment(tokens: Side) -> Fragment:
    common = np.intersect1d(tokens.end_a, tokens.end_b, assume_unique=True)
    if not len(common):
        return Fragment(tokens, [], Side(), False)
    before, rest = tokens.cut(common[0])
    inner, behind = rest.cut(common[-1])
    return Fragment(before, [inner] if len(inner.a) else [], behind, True)


def composed(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two that follow each other. Associative; a fragment of no tokens changes nothing."""
    middle = fragment((x.behind if x.has else x.before).then(y.before))
    if not x.has:
        behind = y.behind if y.has else middle.behind
        return Fragment(middle.before, middle.closed + y.closed, behind, middle.has)
    if not middle.has:
        return Fragment(x.before, x.closed, middle.before, True)
    # The open side of x begins at a common end, so what the middle has before its first is a group too.
    whole = middle.before.then(middle.closed[0]) if middle.closed else middle.before
    return Fragment(x.before, [*x.closed, whole, *y.closed], y.behind if y.has else middle.behind, True)


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a space before each that is not empty."""
    size = np.diff(offsets)
    out = np.concatenate(([0], np.cumsum(size + (size > 0))))
    text = np.ones(out[-1], bool)
    text[out[:-1][size > 0]] = False
    spaced = np.full(out[-1], 0x20, np.uint8)
    spaced[text] = data
    return spaced, out


def _tokens(a: Encoder, b: PieceEncoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a's ids, first of each row, b's, first of each row, whether both spell the row) of rows that begin with a space."""
    col = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    parts = [(ids, first) for _, _, ids, first, _, _ in a.column(col)]
    ids_a = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint32)
    counts = np.concatenate([np.diff(p[1]) for p in parts]) if parts else np.zeros(0, np.int64)
    first_a = np.concatenate(([0], np.cumsum(counts)))
    ids_b, first_b, wrong = b.rows(data, offsets)
    spelled = np.concatenate(([0], np.cumsum(a.lengths[ids_a])))[first_a]
    return ids_a, first_a, ids_b, first_b, ~wrong & (np.diff(spelled) == np.diff(offsets))


def _only(ids: np.ndarray, first: np.ndarray, good: np.ndarray) -> np.ndarray:
    return ids if good.all() else ids[np.repeat(good, np.diff(first))]


def aligned_rows(a: Encoder, b: PieceEncoder, data: np.ndarray, offsets: np.ndarray) -> Groups:
    """Groups of texts; one that is empty, or that either vocabulary does not spell, has none."""
    data, offsets = _spaced(data, offsets)
    ids_a, first_a, ids_b, first_b, good = _tokens(a, b, data, offsets)
    ids_a, ids_b = _only(ids_a, first_a, good), _only(ids_b, first_b, good)
    return grouped(ids_a, np.cumsum(a.lengths[ids_a]), ids_b, np.cumsum(b.lengths[ids_b]), np.cumsum(np.where(good, np.diff(offsets), 0)))


def ranges(data: np.ndarray, part: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges (a's start and end, b's) of a long text with its space, of about `part` bytes: each begins at the first place from a multiple of `part` on where that vocabulary's tokens surely begin.

    The byte-level one never has a visible ASCII sign before a space or newline in a token, the other no sign before a space.
    """
    seen = (data[:-1] > 0x20) & (data[:-1] < 0x7F)
    safe_a = np.flatnonzero(seen & ((data[1:] == 0x20) | (data[1:] == 0x0A))) + 1
    safe_b = np.flatnonzero((data[:-1] != 0x20) & (data[1:] == 0x20)) + 1
    marks = np.arange(part, len(data), part)
    edges = [np.concatenate(([0], np.append(s, len(data))[np.searchsorted(s, marks)], [len(data)])).tolist() for s in (safe_a, safe_b)]
    return [x for x in zip(edges[0][:-1], edges[0][1:], edges[1][:-1], edges[1][1:], strict=True) if x[0] < x[1] or x[2] < x[3]]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64), pa.int64()))


_SCAN = f"{_ROW}, chunk long, a0 long, a1 long, b0 long, b1 long, piece binary"


def _encoders(byte_path: str, piece_path: str) -> tuple[Encoder, PieceEncoder]:
    a, b = _byte_encoder(byte_path), piece_encoder(piece_path)
    if max(len(a.lengths) - 1, len(b.lengths)) > 1 << 16:
        raise ValueError("a pair of ids has 16 bits for each")
    return a, b


def _scanned(docs: DataFrame, byte_path: str, piece_path: str, long: int, part: int) -> DataFrame:
    """Short documents aligned, with chunk null; of long ones a row for each range, with the bytes of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _encoders(byte_path, piece_path)
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            size = np.diff(at)
            key = pa.array(n + np.arange(len(size)))
            n += len(size)
            short = batch.filter(pa.array(size <= long))
            keys = key.filter(pa.array(size <= long))
            for i, j, data, offsets in chunks(short.column(1)):
                g = aligned_rows(a, b, data, offsets)
                digest = [hashlib.sha256(t).hexdigest() if (t := g.text_of(r)) else "" for r in range(j - i)]
                lists = [pa.ListArray.from_arrays(pa.array(g.pairs_at.astype(np.int32)), pa.array(x)) for x in (g.pairs, g.times)]
                none = [pa.nulls(j - i, pa.int64())] * 5 + [pa.nulls(j - i, pa.binary())]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), short.column(0).slice(i, j - i), *[pa.array(x.astype(np.int64)) for x in (g.n_a, g.n_b, g.n_groups, g.n_links)], pa.array(digest, pa.string()), *lists, *none], names=_NAMES)
            for r in np.flatnonzero(size > long).tolist():
                data, _ = _spaced(raw[at[r] : at[r + 1]], np.array([0, size[r]]))
                for k, (a0, a1, b0, b1) in enumerate(ranges(data, part)):
                    text = data[min(a0, b0) : max(a1, b1)].tobytes()
                    none = [pa.nulls(1, pa.int64())] * 4 + [pa.nulls(1, pa.string())] + [pa.nulls(1, pa.list_(pa.int64()))] * 2
                    yield pa.RecordBatch.from_arrays([key.slice(r, 1), batch.column(0).slice(r, 1), *none, *[pa.array([x], pa.int64()) for x in (k, a0, a1, b0, b1)], pa.array([text], pa.binary())], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), _SCAN)


_NAMES = [c.split()[0] for c in _SCAN.split(", ")]
_SIDES = [f"{side}_{x}" for side in ("before", "behind") for x in ("a", "end_a", "b", "end_b")]
#: A row is a fragment (chunk not null), a closed stretch (n_a not null), or both.
_FRAGMENT = f"row_key long, doc_id long, chunk long, good boolean, has boolean, {', '.join(f'{x} array<long>' for x in _SIDES)}, stop long, {_COUNTS}, groups binary, pairs array<long>, times array<long>"
_FRAGMENT_NAMES = [c.split()[0] for c in _FRAGMENT.split(", ")]


def _stretch(tokens: Side) -> list:
    """End, counts, text and pairs of a closed stretch."""
    g = grouped(*tokens.columns(), tokens.end_a[-1:])
    return [int(tokens.end_a[-1]), int(g.n_a[0]), int(g.n_b[0]), int(g.n_groups[0]), int(g.n_links[0]), g.text_of(0), *g.pairs_of(0)]


_NO_STRETCH = [None] * 8


def _fragment_rows(row_key, doc_id, chunk, good: bool, f: Fragment) -> list[list]:
    """A fragment's row, and one for each of its closed stretches but the first, which is in the same row."""
    stretches = [_stretch(t) for t in f.closed]
    own = [row_key, doc_id, chunk, good, f.has, *f.before.columns(), *f.behind.columns(), *(stretches[0] if stretches else _NO_STRETCH)]
    return [own, *[[row_key, doc_id, None, good, None, *[None] * 8, *s] for s in stretches[1:]]]


def _fragments(chunk_rows: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The fragment of each byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _encoders(byte_path, piece_path)
        kinds = [pa.int64()] * 3 + [pa.bool_()] * 2 + [pa.list_(pa.int64())] * 8 + [pa.int64()] * 5 + [pa.binary()] + [pa.list_(pa.int64())] * 2
        for batch in batches:
            for r in batch.to_pylist():
                data = np.frombuffer(r["piece"], np.uint8)
                base = min(r["a0"], r["b0"])
                own_a, own_b = data[r["a0"] - base : r["a1"] - base], data[r["b0"] - base : r["b1"] - base]
                ids_a = next((ids for _, _, ids, _, _, _ in a.column(pa.array([own_a.tobytes()], pa.binary()))), np.zeros(0, np.uint32))
                ids_b, _, wrong = b.rows(own_b, np.array([0, len(own_b)]))
                good = not wrong[0] and int(a.lengths[ids_a].sum()) == len(own_a)
                wide = lambda x: x.astype(np.int64)
                tokens = Side(wide(ids_a), r["a0"] + np.cumsum(a.lengths[ids_a]), wide(ids_b), r["b0"] + np.cumsum(b.lengths[ids_b])) if good else Side()
                rows = _fragment_rows(r["row_key"], r["doc_id"], r["chunk"], good, fragment(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_FRAGMENT_NAMES)

    return chunk_rows.select("row_key", "doc_id", "chunk", "a0", "a1", "b0", "b1", "piece").mapInArrow(tidy(run), _FRAGMENT)


def _as_fragment(r) -> Fragment:
    sides = [np.asarray(r[x], np.int64) for x in _SIDES]
    return Fragment(Side(*sides[:4]), [], Side(*sides[4:]), bool(r["has"]))


def _composed(fragments: DataFrame, last: bool) -> DataFrame:
    """One fragment for every FAN neighbours, with the stretches that they close; last: a document's only one, which begins and ends at common ends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk").to_dict("records")
        whole, good = _as_fragment(rows[0]), all(r["good"] for r in rows)
        for r in rows[1:]:
            whole = composed(whole, _as_fragment(r))
        chunk = int(rows[0]["chunk"]) // FAN
        if last and good:
            whole = Fragment(Side(), [whole.before, *whole.closed], Side(), True)
        return pd.DataFrame(_fragment_rows(rows[0]["row_key"], rows[0]["doc_id"], chunk, good, whole), columns=_FRAGMENT_NAMES).astype({c: "Int64" for c in ("doc_id", "chunk", "stop", "n_a", "n_b", "n_groups", "n_links")})

    own = fragments.filter("chunk is not null").select("row_key", "doc_id", "chunk", "good", "has", *_SIDES)
    return own.groupBy("row_key", F.floor(F.col("chunk") / FAN).alias("node")).applyInPandas(run, _FRAGMENT)


def _assembled(stretches: DataFrame) -> DataFrame:
    """Rows of _ROW of long documents from their closed stretches, which a task streams in order: a document's hash is taken piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done():
            counts, digest, pairs, times, good, doc_id, any_text = state
            known, n = summed(np.concatenate(pairs), np.concatenate(times)) if good and pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            return [key, doc_id, *(counts if good else [0] * 4), digest.hexdigest() if good and any_text else "", known, n]

        def batch_of(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.string()), _lists(list(cols[7])), _lists(list(cols[8]))], names=_NAMES[:9])

        for batch in batches:
            out = []
            pairs, times = batch.column(9), batch.column(10)
            for i, r in enumerate(batch.select(list(range(9))).to_pylist()):
                if r["row_key"] != key:
                    if state:
                        out.append(done())
                    key, state = r["row_key"], [[0] * 4, hashlib.sha256(), [], [], True, r["doc_id"], False]
                state[4] &= r["good"]
                if r["n_a"] is None:
                    continue
                state[0] = [x + r[c] for x, c in zip(state[0], ("n_a", "n_b", "n_groups", "n_links"), strict=True)]
                state[1].update(b";" * state[6] + r["groups"])
                state[6] = True
                state[2].append(np.asarray(pairs[i].values))
                state[3].append(np.asarray(times[i].values))
                if len(state[2]) > 64:
                    known, n = summed(np.concatenate(state[2]), np.concatenate(state[3]))
                    state[2], state[3] = [known], [n]
            if out:
                yield batch_of(out)
        if state:
            yield batch_of([done()])

    own = stretches.select("row_key", "doc_id", "stop", "good", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times")
    return own.repartition(partitions(stretches), "row_key").sortWithinPartitions("row_key", "stop").mapInArrow(tidy(run), _ROW)


def document_groups(docs: DataFrame, byte_path: str, piece_path: str, long: int = LONG, part: int = PART) -> DataFrame:
    """One written row for each of docs (doc_id, text): row_key (distinct), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct linked ids, a * 2^16 + b) and times (links of each)."""
    scan = written(_scanned(docs, byte_path, piece_path, long, part), "aligned")
    rows = scan.filter("chunk is null").select(*_NAMES[:9])
    rows.written_at = scan.written_at
    cut = scan.filter("chunk is not null")
    if cut.isEmpty():
        return rows
    n = partitions(docs)
    level = written(_fragments(cut.repartition(n, "row_key", "chunk"), byte_path, piece_path), "fragments")
    levels = [level]
    while True:
        last = level.agg(F.max("chunk")).first()[0] < FAN
        level = written(_composed(level, last), "fragments")
        levels.append(level)
        if last:
            break
    stretches = levels[0]
    for x in levels[1:]:
        stretches = stretches.unionByName(x)
    out = written(rows.unionByName(_assembled(stretches)), "groups")
    discard(scan, *levels)
    return out


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n (how many rows of document_groups() have it), best (whether no other pair of its a has more); written. Counts are summed within tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)]
        counts: list[np.ndarray] = [np.zeros(0, np.int64)]
        held = 0

        def out():
            known, n = summed(np.concatenate(kept), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(known), pa.array(n)], names=["pair", "n"])

        for batch in batches:
            known, n = np.unique(np.asarray(batch.column(0).flatten()), return_counts=True)
            kept.append(known)
            counts.append(n)
            held += len(known)
            if held > 1 << 20:
                known, n = summed(np.concatenate(kept), np.concatenate(counts))
                kept[:], counts[:], held = [known], [n], len(known)
                if held > 1 << 19:
                    yield out()
                    kept[:], counts[:], held = [known[:0]], [n[:0]], 0
        yield out()

    counted = rows.select("pairs").mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.shiftright("pair", 16))  # at most as many rows as the other vocabulary has ids
    return written(counted.withColumn("best", F.col("n") == F.max("n").over(own)), "pair-counts")


def _frequent(counts: DataFrame, most: int):
    """A condition on n that holds for `most` pairs at most, the most frequent ones; from a histogram of some hundred rows."""
    bin_of = F.floor(F.log2("n") * 8)
    at, total = None, 0
    for r in sorted(counts.groupBy(bin_of.alias("bin")).count().collect(), key=lambda r: -r["bin"]):
        total += r["count"]
        if total > most:
            break
        at = r["bin"]
    return F.lit(False) if at is None else bin_of >= at


def aligned(docs: DataFrame, byte_path: str, piece_path: str, long: int = LONG, part: int = PART, sent: int = SENT_PAIRS) -> DataFrame:
    """One row for each of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_path is a byte-level BPE file of `tokenizers`, which gets a space before the text; piece_path a sentencepiece model, which adds it
    itself. Strings of special tokens are plain text. Tokens' common ends cut a text into groups; every a and b token of a group are
    linked. A pair of ids counts the documents that hold it linked: n_best are the links whose count is the highest of their a, ties
    included, count_sum the sum of counts over links. A text that is null, empty, or not spelled by the tokens has zeros and ''.

    Documents over `long` bytes are cut into ranges of about `part`, made and composed in tasks of their own; one without a space is
    one range. Rows that repeat count each, an empty table gives none, other columns are not read. Counts of the `sent` most frequent
    pairs are sent to the workers, so no pair of the join that the others take is frequent; the result is the same for any `sent`.
    Beyond 64-bit hashes of words, by which those that were encoded before are known, all is exact.
    """
    rows = document_groups(docs, byte_path, piece_path, long, part)
    counts = pair_counts(rows)
    frequent = _frequent(counts, sent)
    top = counts.filter(frequent).select("pair", "n", "best").toArrow()
    order = np.argsort(np.asarray(top["pair"]))
    known = docs.sparkSession.sparkContext.broadcast(tuple(np.asarray(top[c].to_numpy())[order] for c in ("pair", "n", "best")))

    def of_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        pairs, times = np.asarray(batch.column("pairs").flatten()), np.asarray(batch.column("times").flatten())
        offsets = np.asarray(batch.column("pairs").offsets).astype(np.int64)
        own = known.value[0]
        at = np.minimum(np.searchsorted(own, pairs), max(0, len(own) - 1))
        return pairs, times, offsets - offsets[0], at, own[at] == pairs if len(own) else np.zeros(len(pairs), bool)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, offsets, at, has = of_rows(batch)
            _, n, best = known.value
            values = [np.where(has, times * best[at], 0), np.where(has, times * n[at], 0)] if len(n) else [np.zeros(len(pairs), np.int64)] * 2
            per = [np.concatenate(([0], np.cumsum(v)))[offsets] for v in values]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in _NAMES[:7]], *[pa.array(np.diff(x)) for x in per]], names=[*_NAMES[:7], "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times, offsets, _, has = of_rows(batch)
            owner = np.repeat(np.asarray(batch.column("row_key")), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(x[~has]) for x in (owner, pairs, times)], names=["row_key", "pair", "times"])

    scored = rows.mapInArrow(tidy(score), f"row_key long, doc_id long, {_COUNTS}, groups_sha256 string, n_best long, count_sum long")
    rare = counts.filter(~frequent)
    if not rare.isEmpty():
        rest = rows.select("row_key", "pairs", "times").mapInArrow(tidy(others), "row_key long, pair long, times long").join(rare, "pair")
        more = rest.groupBy("row_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
        plus = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        scored = scored.join(more, "row_key", "left").select(*scored.columns[:7], plus("n_best", "more_best"), plus("count_sum", "more_sum"))
    out = written(scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), "alignment")
    known.destroy()
    discard(rows, counts)
    return out
