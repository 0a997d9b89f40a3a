"""Token counts of sections: a document is encoded once, its tokens' spans are joined to the sections' intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import encoder


def allocate(begin: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token [begin, end) among [edges[k], edges[k + 1]). rule "start": the one that holds its first byte; "most": the one that holds most of its bytes, of equals the first."""
    first = np.searchsorted(edges, begin, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(edges, end - 1, "right") - 1
    out = first.copy()
    for i in np.flatnonzero(last > first):
        k = np.arange(first[i], last[i] + 1)
        out[i] = k[np.argmax(np.minimum(end[i], edges[k + 1]) - np.maximum(begin[i], edges[k]))]
    return out


def line_counts(docs: DataFrame, tokenizer: str, rule: str = "start") -> DataFrame:
    """One row for each line of each of docs (doc_id, text): doc_id, section (from 0), start and end (code points, end exclusive), n_tokens.

    A line goes up to its newline, which it holds; a text that ends in one has no empty line after it. The whole text is encoded once, so
    tokens may cross lines; `rule` says which line such a token counts for, and the lines' counts add up to the document's tokens. An
    empty or null text has one section of no tokens, a very long one is encoded whole. Rows that repeat give their rows again, an empty
    table gives none. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for at, end, ids, first, data, offsets in enc.column(b.column(1)):
                rows = end - at
                breaks = np.flatnonzero(data == 0x0A) + 1
                # An edge at every row's start and after every newline; of an empty row both its edges are the same place.
                inner = breaks[~np.isin(breaks, offsets)]
                places = np.concatenate((offsets[:-1], inner))
                owner = np.concatenate((np.arange(rows), np.searchsorted(offsets, inner, "right") - 1))
                order = np.lexsort((places, owner))
                places, owner = places[order], owner[order]
                ends = np.append(places[1:], len(data))
                stops = np.cumsum(enc.lengths[ids])
                begins = stops - enc.lengths[ids]
                real = ends > places
                edges = np.append(places[real], len(data))
                section = np.flatnonzero(real)[allocate(begins, stops, edges, rule)] if len(ids) else np.zeros(0, np.int64)
                counts = np.bincount(section, minlength=len(places))
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                row_start = chars[offsets[:-1]][owner]
                number = np.arange(len(places)) - np.searchsorted(owner, owner)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, rows).take(pa.array(owner)), pa.array(number), pa.array(chars[places] - row_start), pa.array(chars[ends] - row_start), pa.array(counts)], names=["doc_id", "section", "start", "end", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, section long, start long, end long, n_tokens long")


def field_counts(rows: DataFrame, keys: list[str], fields: list[str], tokenizer: str, separator: str = "\n", rule: str = "start") -> DataFrame:
    """One row for each row and field: keys, field, n_tokens. The fields, joined by the separator, are encoded as one text; a separator counts for the field before it. A null field is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            parts = [b.column(len(keys) + k).to_pylist() for k in range(len(fields))]
            texts, edges = [], []
            for values in zip(*parts, strict=True):
                own = [(v or "") + (separator if k + 1 < len(fields) else "") for k, v in enumerate(values)]
                texts.append("".join(own))
                edges.append(np.concatenate(([0], np.cumsum([len(x.encode()) for x in own]))))
            counts = np.zeros((len(texts), len(fields)), np.int64)
            for at, end, ids, first, _, offsets in enc.column(pa.array(texts, pa.string())):
                stops = np.cumsum(enc.lengths[ids])
                for r in range(end - at):
                    s = stops[first[r] : first[r + 1]] - offsets[r]
                    e = edges[at + r]
                    real = np.flatnonzero(np.diff(e))
                    if len(s):
                        counts[at + r] = np.bincount(real[allocate(np.concatenate(([0], s[:-1])), s, np.append(e[real], e[-1]), rule)], minlength=len(fields))
            n = len(texts)
            index = pa.array(np.repeat(np.arange(n), len(fields)))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(index) for k in range(len(keys))], pa.array(fields * n), pa.array(counts.ravel())], names=[*keys, "field", "n_tokens"])

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.select(*keys, *[F.col(f).cast("string") for f in fields]).mapInArrow(tidy(run), f"{kinds}, field string, n_tokens long")
