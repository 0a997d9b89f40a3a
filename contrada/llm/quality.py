"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, SPACE, chunks, span_hashes, words
from .common import Marks, discard, tidy, written

THRESHOLD = 0.3
#: Share of the class covariance that gives way to the pooled one, and then to its diagonal; and a variance that is added to all.
TO_POOLED, TO_DIAGONAL, FLOOR = 0.2, 0.3, 0.02

_CLASS = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 sentence marks, 5 other signs, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[SPACE] = 3
_CLASS[[0x2C, 0x2E, 0x27, 0x22, 0x2D, 0x3A, 0x3B, 0x3F, 0x28, 0x29]] = 4

NAMES = ("log_bytes", "log_words", "upper", "digit", "white", "marks", "signs", "beyond", "word_length", "word_length_spread", "sign_words", "upper_words", "capital_words", "mark_words", "distinct_words", "top_word", "repeated_next", "log_line_words", "repeated_lines", "distinct_trigrams", "long_words", "short_words")


def statistics(col: pa.Array) -> np.ndarray:
    """A row of transformed statistics for each text: logs of sizes, square roots of shares. An empty or null text has zeros."""
    out = np.zeros((len(col), len(NAMES)))
    for at, end, data, offsets in chunks(col):
        rows = end - at
        n = np.diff(offsets)
        if not len(data):
            continue
        kind = _CLASS[data]
        share = np.zeros((7, rows))
        for k in range(7):
            sums = np.concatenate(([0], np.cumsum(kind == k)))
            share[k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)
        s, e, first = words(data, offsets)
        count = np.diff(first)
        some = np.maximum(count, 1)
        length = (e - s).astype(float)

        def per_doc(x):
            sums = np.concatenate(([0.0], np.cumsum(x)))
            return (sums[first[1:]] - sums[first[:-1]]) / some

        def within(k):
            sums = np.concatenate(([0], np.cumsum(kind == k)))
            return sums[e] - sums[s]

        mean = per_doc(length)
        spread = np.sqrt(np.maximum(per_doc(length * length) - mean * mean, 0))
        hashes = span_hashes(LOWER[data], s, e)
        line = np.flatnonzero(data == 0x0A)
        line_s = np.unique(np.concatenate((offsets[:-1], line + 1)))
        line_s = line_s[line_s < len(data)]
        line_e = np.append(line_s[1:], len(data))
        line_hash = span_hashes(data, line_s, line_e)
        line_first = np.searchsorted(line_s, offsets)
        three = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(5) + hashes[2:] * np.uint64(7) if len(hashes) > 2 else np.zeros(0, np.uint64)
        distinct, top, nexts, lines, trigrams = np.ones(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
        for i in range(rows):
            w = hashes[first[i] : first[i + 1]]
            if len(w):
                c = np.unique(w, return_counts=True)[1]
                distinct[i], top[i], nexts[i] = len(c) / len(w), c.max() / len(w), (w[1:] == w[:-1]).mean() if len(w) > 1 else 0
            own = line_hash[line_first[i] : line_first[i + 1]]
            if len(own) > 1:
                lines[i] = 1 - len(set(own.tolist())) / len(own)
            t = three[first[i] : max(first[i], first[i + 1] - 2)]
            if len(t) > 1:
                trigrams[i] = len(np.unique(t)) / len(t)
        sq = np.sqrt
        lines_n = np.maximum(np.diff(line_first), 1)
        out[at:end] = np.stack([
            np.log1p(n), np.log1p(count), sq(share[1]), sq(share[2]), sq(share[3]), sq(share[4]), sq(share[5]), sq(share[6]),
            np.log1p(mean), np.log1p(spread), sq(per_doc(within(5) > 0)), sq(per_doc((within(1) == length) & (length > 0))), sq(per_doc(kind[s] == 1)), sq(per_doc(within(4) > 0)),
            np.log(distinct) / np.maximum(np.log1p(count), 1), sq(top), sq(nexts), np.log1p(count / lines_n), sq(lines), trigrams, sq(per_doc(length > 20)), sq(per_doc(length < 3)),
        ], 1)
        out[at:end][count == 0] = 0
    return out


class Discriminant:
    """Two Gaussian classes; the Cholesky factors of their shrunk covariances are kept, a score costs two triangular products."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        """Of classes 0 and 1: rows, sums of the statistics and of their products. A class without rows takes the other's shape."""
        d = sums.shape[1]
        n = np.maximum(counts, 1)[:, None]
        self.known = counts > 0
        mean = sums / n
        cov = squares / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * counts[:, None, None]).sum(0) / max(counts.sum(), 1)
        total = sums.sum(0) / max(counts.sum(), 1)
        spread = squares.sum(0) / max(counts.sum(), 1) - np.outer(total, total)
        self.scale = np.sqrt(np.maximum(np.diag(spread), 1e-4))
        self.mean, self.factor, self.log_det = mean / self.scale, [], []
        for k in range(2):
            c = cov[k] if self.known[k] else pooled
            c = ((1 - TO_POOLED) * c + TO_POOLED * pooled) / np.outer(self.scale, self.scale)
            c = (1 - TO_DIAGONAL) * c + TO_DIAGONAL * np.diag(np.diag(c)) + FLOOR * np.eye(d)
            values, vectors = np.linalg.eigh(c)  # sums are rounded: nearly constant statistics may come out below zero
            low = np.linalg.cholesky((vectors * np.maximum(values, FLOOR)) @ vectors.T)
            self.factor.append(np.linalg.inv(low))
            self.log_det.append(2 * np.log(np.diag(low)).sum())
        self.prior = float(np.log((counts[1] + 1) / (counts[0] + 1)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: the difference of the log densities, by Mahalanobis distances, and of the priors."""
        if not self.known.all():
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        z = x / self.scale
        dist = [(((z - self.mean[k]) @ self.factor[k].T) ** 2).sum(1) + self.log_det[k] for k in range(2)]
        return 1 / (1 + np.exp(-np.clip(self.prior + (dist[0] - dist[1]) / 2, -500, 500)))


def statistics_table(docs: DataFrame, among: Marks | None = None) -> DataFrame:
    """doc_id and statistics of all rows, or of those that a bitmap of ids has."""
    has = among.has if among else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if has:
                b = b.filter(pa.array(has(np.asarray(b.column(0).fill_null(0)))))
            x = statistics(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


def held_out(doc_id):
    """Rows that are never learned from: crc32 of the doc_id as text is a multiple of 5. So is a row without a doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def fitted(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Learned from all labelled rows that are not held out. Sums of statistics and of products are partial in each task and added in a tree; a few numbers come to the driver. A document labelled more than once counts once, by its highest label; null labels do not count."""
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    rows = stats.join(marks, "doc_id").filter(~held_out("doc_id"))
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            x = np.asarray(b.column(0).flatten()).reshape(-1, d)
            y = np.asarray(b.column(1))
            for k in range(2):
                own = x[y == k]
                count[k] += len(own)
                sums[k] += own.sum(0)
                squares[k] += own.T @ own
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part % 64], pa.int32()), pa.array([np.concatenate((count, sums.ravel(), squares.ravel())).tobytes()], pa.binary())], names=["part", "sums"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in sorted(t.column("sums").to_pylist()))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("x", "y").mapInArrow(tidy(run), "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()  # 64 rows at most
    total = sum((np.frombuffer(r["sums"], np.float64) for r in sorted(parts, key=lambda r: r["part"])), np.zeros(2 + 2 * d + 2 * d * d))
    total = np.round(total, 6)
    return Discriminant(total[:2], total[2 : 2 + 2 * d].reshape(2, d), total[2 + 2 * d :].reshape(2, d, d))


def _scores(docs: DataFrame, model: Discriminant, kinds: str) -> DataFrame:
    """docs (statistics x last) with x replaced by its score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return docs.mapInArrow(tidy(run), kinds)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 if score >= threshold).

    Only the text is an input of the score. A null or empty text, or one of white space, has statistics of zero and is scored by them; a
    very long one is read whole. Without labels of both classes the score is the classes' share. Rows that repeat are scored alike, a row
    without a doc_id counts as held out, and an empty table gives none; other columns are not read.
    """
    stats = written(statistics_table(docs), "statistics")
    model = fitted(stats, labels)
    out = _scores(stats, model, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that the classifier rejects, all columns as they were; nothing is shuffled but what fits the model.

    Statistics are taken of all texts to filter, and before of the labelled ones that are learned from, which a bitmap of their ids (16 MB at most) picks.
    Null, empty and very long texts, repeated rows and those without a doc_id are scored like others (see scored()), by their text alone.
    An empty table stays empty; columns of any names pass through.
    """
    marked = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long")).distinct()
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out("doc_id"))
    # Of a few more too, which the join drops. Written, as the sums are taken in Python again: in one stage each task would hold two workers, which Spark keeps.
    stats = written(statistics_table(known, Marks(marked)), "labelled")
    model = fitted(stats, labels)
    discard(stats)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.scores(statistics(b.column(at))) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
