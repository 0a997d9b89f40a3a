"""Token ids of whole texts by a sentencepiece BPE vocabulary, many texts at once.

No piece of the vocabulary has a word start behind another sign (checked when it is read), so merges never cross the place between a sign
and a space: text is cut there, each distinct part is encoded once, and ids equal those of the whole text.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np

from .bytetext import span_hashes

#: The sign that stands for a space in pieces.
SPACE_SIGN = "▁"
#: Distinct parts that a worker remembers before it starts anew.
_REMEMBERED = 250_000


class PieceEncoder:
    """Of a model file, kept by each worker. Texts are given with the space that the vocabulary adds at their start."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(a != SPACE_SIGN and b == SPACE_SIGN for p in pieces for a, b in itertools.pairwise(p)):
            raise ValueError(f"{path}: pieces go beyond the start of a word, so texts cannot be cut there")
        self.spelled = [b"" if self.model.is_control(i) or self.model.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE_SIGN, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(x) for x in self.spelled], np.int64)
        self.space = self.model.piece_to_id(SPACE_SIGN)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.begin, self.size, self.bad = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        """Encodes parts that are not known; each begins with a space, which the model adds itself. keys are in order."""
        lists = self.model.encode([x[1:].decode() for x in parts], num_threads=1)
        lists = [[self.space] if x == b" " else ids for x, ids in zip(parts, lists, strict=True)]
        bad = [b"".join([self.spelled[i] for i in ids]) != x for x, ids in zip(parts, lists, strict=True)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(size.sum())
        if self.filled + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.filled], np.zeros(self.filled + 2 * total, np.uint32)))
        self.flat[self.filled : self.filled + total] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, total)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.bad = np.insert(self.keys, at, keys), np.insert(self.bad, at, bad)
        self.begin = np.insert(self.begin, at, self.filled + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.filled += total

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each row, whether a row's ids do not spell its bytes). A row that is not empty begins with a space."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64), np.zeros(n, bool)
        space = data == 0x20
        start = np.zeros(len(data) + 1, bool)
        start[offsets] = True
        start[1:-1] |= space[1:] & ~space[:-1]
        cut = np.flatnonzero(start[:-1])
        stop = np.append(cut[1:], len(data))
        distinct, where, which = np.unique(span_hashes(data, cut, stop), return_index=True, return_inverse=True)
        if len(self.keys) > _REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            raw = data.tobytes()
            self._learn(distinct[new], [raw[b:e] for b, e in zip(cut[where[new]].tolist(), stop[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        at = at[which]
        per = self.size[at]
        total = np.concatenate(([0], np.cumsum(per)))
        ids = self.flat[np.repeat(self.begin[at] - total[:-1], per) + np.arange(total[-1])]
        first = np.searchsorted(cut, offsets)
        wrong = np.concatenate(([0], np.cumsum(self.bad[at])))
        return ids, total[first], wrong[first[1:]] > wrong[first[:-1]]


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
