"""Token ids of whole texts by a public byte-level BPE vocabulary, many texts at once.

A text is cut into pre-tokens (words, numbers, signs and white space) by character class, each distinct pre-token of a piece of text is
encoded once, and ids are laid out by numpy. A text with characters whose class libraries may read differently goes whole to the
tokenizer of the same file, and so does one that holds the string of an added token, which is one id. Ids equal those of `tokenizers`
with add_special_tokens=False. An Encoder with added=False reads added tokens' strings as ordinary text (encode_special_tokens).
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytetext import chunks, span_hashes

#: The vocabulary's pre-token pattern and its endings after an apostrophe.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, LONG = "stmd", ("re", "ve", "ll")

_BLANK, _WHITE, _LETTER, _NUMBER, _SIGN, _ODD = range(6)
#: Distinct pre-tokens that a worker remembers before it starts anew.
_REMEMBERED = 250_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point of the basic plane; control and unassigned ones are odd, and so are all others."""
    out = np.full(0x10001, _ODD, np.uint8)
    for c in range(0x10000):
        kind = unicodedata.category(chr(c))
        if c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) or kind in ("Zs", "Zl", "Zp"):
            out[c] = _WHITE
        elif kind[0] == "L":
            out[c] = _LETTER
        elif kind[0] == "N":
            out[c] = _NUMBER
        elif kind[0] in "PSM":
            out[c] = _SIGN
    out[0x20] = _BLANK
    return out


@lru_cache(1)
def _byte_letters() -> dict[str, int]:
    """The vocabulary file writes byte b as a printable letter: itself where printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Of a tokenizer file, kept by each worker."""

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        special = {x["content"] for x in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self.ordinary = path, not added
        self.added = [x["content"].encode() for x in spec["added_tokens"]] if added else []
        known = [*ranks.items(), *((x["content"].encode(), x["id"]) for x in spec["added_tokens"])]
        self.lengths = np.zeros(max(i for _, i in known) + 2, np.int64)
        for t, i in known:
            self.lengths[i] = len(t)
        self._forget()

    def _whole(self, text: str) -> list[int]:
        """The ids of a text by the tokenizer itself."""
        if not hasattr(self, "tokenizer"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
            self.tokenizer.encode_special_tokens = self.ordinary
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _added_at(self, raw: bytes) -> np.ndarray:
        """Where the strings of added tokens are."""
        at = []
        for token in self.added:
            p = raw.find(token)
            while p >= 0:
                at.append(p)
                p = raw.find(token, p + 1)
        return np.array(at, np.int64)

    def _forget(self) -> None:
        """No pre-token is known: hashes in order, where their ids begin in flat and how many they are."""
        self.keys, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.filled = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Encodes pre-tokens that are not known; keys are in order."""
        lists = [self.plain.encode_ordinary(x.decode()) for x in pieces]  # a pre-token by itself is cut as it was
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(size.sum())
        if self.filled + total > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.filled], np.zeros(self.filled + 2 * total, np.uint32)))
        self.flat[self.filled : self.filled + total] = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, total)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, self.filled + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.filled += total

    def column(self, col: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end, ids, first id of each row, bytes, byte offsets) of runs of rows (see chunks()); a null text is empty."""
        for at, end, data, offsets in chunks(col, size):
            yield at, end, *self._chunk(data, offsets), data, offsets

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        raw = data.tobytes()
        cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(byte_at, offsets)  # each row's first character
        kind = _classes()[np.minimum(cp, 0x10000)]
        new = np.zeros(len(cp) + 1, bool)
        new[first] = True
        white = kind <= _WHITE
        run = np.where(white, np.uint8(_WHITE), kind)
        start = new[:-1].copy()
        after_blank = np.zeros(len(cp), bool)
        after_blank[1:] = kind[:-1] == _BLANK
        differs = np.ones(len(cp), bool)
        differs[1:] = run[1:] != run[:-1]
        before_word = np.zeros(len(cp), bool)
        before_word[:-1] = ~white[1:] & ~new[1:-1]
        # A sign, letter or number begins where its class does, one blank before it included; of white space the last before a word stands alone.
        start |= np.where(white, differs | before_word, differs & ~after_blank)
        quotes = np.flatnonzero((cp == 0x27) & start)
        if len(quotes):
            limit = first[np.searchsorted(first, quotes, "right")]
            for q, stop in zip(quotes.tolist(), limit.tolist(), strict=True):
                tail = "".join(map(chr, cp[q + 1 : min(q + 3, stop)]))
                size = 1 if tail[:1] and tail[0] in SHORT else 2 if tail in LONG else 0
                if size:
                    start[q + 1 : q + 1 + size] = False
                    if q + 1 + size < stop:
                        start[q + 1 + size] = True
        cut = np.flatnonzero(start)
        begin = byte_at[cut]
        stop = np.append(begin[1:], len(data))
        distinct, where, which = np.unique(span_hashes(data, begin, stop), return_index=True, return_inverse=True)
        if len(self.keys) > _REMEMBERED:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != distinct
        if new.any():
            self._learn(distinct[new], [raw[b:e] for b, e in zip(begin[where[new]].tolist(), stop[where[new]].tolist(), strict=True)])
            at = np.searchsorted(self.keys, distinct)
        at = at[which]
        per = self.size[at]
        total = np.concatenate(([0], np.cumsum(per)))
        ids = self.flat[np.repeat(self.begin[at] - total[:-1], per) + np.arange(total[-1])]
        row_first = total[np.searchsorted(cut, first)]
        odd = np.unique(np.append(np.searchsorted(first, np.flatnonzero(kind == _ODD), "right") - 1, np.searchsorted(offsets, self._added_at(raw), "right") - 1))
        if len(odd):
            parts, at = [], 0
            counts = np.diff(row_first)
            for r in odd.tolist():
                own = np.array(self._whole(raw[offsets[r] : offsets[r + 1]].decode("utf-8")), np.uint32)
                parts += [ids[at : row_first[r]], own]
                at, counts[r] = row_first[r + 1], len(own)
            ids = np.concatenate([*parts, ids[at:]])
            row_first = np.concatenate(([0], np.cumsum(counts)))
        return ids, row_first


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path, added=True)
