"""Secret scans: exact patterns, and a linear-chain conditional random field over words that adds what they miss.

Words are tagged secret begin, inside or outside from their shape, the words beside them and features of the file, decoded by Viterbi. A
word of letters only is outside by definition unless a keyword stands just before it, so a text falls into chains of other words, each
decoded by itself. The field learns from the patterns' matches, from the other words of the same documents, and from surroundings of these
documents into which secrets of other shapes are written, so that it knows more than the patterns.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import LOWER, chunks, mixed, span_hashes, words
from .common import tidy, written

#: The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
_LEAST = {"assign": 6, "access": 20, "hex": 24}
_CLUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Documents of which the field is learned, at most about: SAMPLE_DOCS are scanned, CHAINS chains of each kind are taken (with a match, without one, and with a made secret), each of CHAIN_WORDS words at most.
SAMPLE_DOCS, CHAINS, CHAIN_WORDS = 12_000, 1500, 24
OUTSIDE, BEGIN, INSIDE = range(3)

_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 sentence marks, 4 other signs; bytes beyond ASCII are letters
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 0
_KIND[[0x2C, 0x2E, 0x27, 0x22, 0x3A, 0x3B, 0x3F, 0x21, 0x28, 0x29]] = 3
_HEXADECIMAL = np.zeros(256, bool)
_HEXADECIMAL[[*range(48, 58), *range(97, 103)]] = True
_KEYWORDS = ("password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "api-key", "key", "pwd", "pass", "auth", "bearer", "credential", "credentials", "pin", "private_key", "access_key", "client_secret", "access_token", "auth_token", "secret_key")
#: Least length of a word of letters only that a keyword makes a candidate.
_LETTERS = 6

#: Values of each feature: length, digits and mixed case; how often the kind of letter changes; signs inside; hexadecimal; the word before; a keyword near; the word after; the file.
SIZES = (40, 4, 6, 2, 4, 4, 3, 6)
_FIRST = np.concatenate(([0], np.cumsum(SIZES)))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches, leftmost and non-overlapping within a kind, in code points; too short ones are dropped after matching."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end() - m.start() >= _LEAST[kind]]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a piece of text that a base pattern may match."""
    at = []
    for raw, clues in ((LOWER[data].tobytes(), _CLUES), (data.tobytes(), (b"AKIA",))):
        for clue in clues:
            p = raw.find(clue)
            while p >= 0:
                at.append(p)
                p = raw.find(clue, p + 1)
    # Runs of hexadecimal signs end with their document.
    on, edge = np.concatenate(([False], _HEXADECIMAL[data], [False])), np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = np.flatnonzero(on[1:-1] & (~on[:-2] | edge[:-1])), np.flatnonzero(on[1:-1] & (~on[2:] | edge[1:])) + 1
    at = np.concatenate((np.array(at, np.int64), start[end - start >= _LEAST["hex"]]))
    return np.unique(np.searchsorted(offsets, at, "right") - 1)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words that are candidates, the number of the chain of each, and its feature values (a column each)."""
    s, e, first = words(data, offsets)
    none = np.zeros(0, np.int64)
    if not len(s):
        return none, none, none, np.zeros((0, len(SIZES)), np.int64)
    kind = _KIND[data]

    def counted(flags):
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int32)))
        return lambda a, b: sums[b] - sums[a]

    upper, digit, sign = (counted(kind == k)(s, e) for k in (1, 2, 4))
    length = e - s
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    # Words without their marks and signs at either end, two at the end at most.
    trim = e - (kind[e - 1] >= 3)
    trim = np.maximum(trim - (kind[np.maximum(trim - 1, s)] >= 3), s)
    begin = np.minimum(s + (kind[s] >= 3), trim)
    known = np.isin(span_hashes(LOWER[data], begin, trim), _keyword_hashes()) & (trim - begin >= 3)

    def before(flags, k):
        out = np.zeros(len(s), bool)
        out[k:] = flags[:-k] & (doc[k:] == doc[:-k])
        return out

    near = np.where(before(known, 1), 1, np.where(before(known, 2) | before(known, 3), 2, 0))
    odd = (digit > 0) | (sign > 0) | ((near > 0) & (trim - begin >= _LETTERS) & ~known)
    pick = np.flatnonzero(odd)
    if not len(pick):
        return none, none, none, np.zeros((0, len(SIZES)), np.int64)
    own = doc[pick]
    chain = np.concatenate(([0], np.cumsum((np.diff(pick) > 1) | (np.diff(own) > 0))))
    a, b = begin[pick], np.maximum(trim[pick], begin[pick] + 1)
    n = b - a
    lower = counted(kind == 0)(a, b)
    mixed_case = (upper[pick] > 0) & (lower > 0)
    shape = np.searchsorted([6, 12, 20, 32], n, "right") * 8 + np.searchsorted([1e-9, 0.3, 0.999], digit[pick] / n, "right") * 2 + mixed_case
    changes = counted(np.concatenate((kind[1:] != kind[:-1], [False])))(a, b - 1)
    change = np.searchsorted([0.08, 0.25, 0.45], changes / n, "right")
    has = lambda chars: counted(np.isin(data, [ord(c) for c in chars]))(a, b) > 0
    at, equal, path, dash = has("@"), has("=:"), has("/.,"), has("-_")
    signs = np.where(at, 3, np.where(equal, 4, np.where(path, 2, np.where(dash, 1, np.where(sign[pick] - counted(kind == 4)(s[pick], a) - counted(kind == 4)(b, e[pick]) > 0, 5, 0)))))
    pure = counted(_HEXADECIMAL[data])(a, b) >= n
    last, previous = pick - 1, np.maximum(pick - 1, 0)
    mark = np.isin(data[e[previous] - 1], [0x3D, 0x3A, 0x3E]) | ((length[previous] == 2) & (data[s[previous]] == 0x69) & (data[e[previous] - 1] == 0x73))  # ends in = : > or is "is"
    prior = np.where(last < first[own], 0, np.where(mark, 1, np.where(~odd[previous], 2, 3)))
    # A keyword within the word, before an equals sign or a colon: the part up to it is looked up.
    inner = np.zeros(len(pick), bool)
    for i in np.flatnonzero(equal).tolist():
        raw = data[a[i] : b[i]].tobytes().lower()
        cut = min(p for p in (raw.find(b"="), raw.find(b":")) if p >= 0)
        inner[i] = any(raw[:cut].endswith(k.encode()) for k in _KEYWORDS) and len(raw) - cut > 5
    keyword = np.where(inner, 3, near[pick])
    after = np.minimum(pick + 1, len(s) - 1)
    following = np.where(pick + 1 >= first[own + 1], 0, np.where(odd[after], 2, 1))
    some = np.concatenate(([0], np.cumsum(odd)))
    share = (some[first[1:]] - some[first[:-1]]) / np.maximum(np.diff(first), 1)
    long_ = np.concatenate(([0], np.cumsum(length >= 40)))
    file = np.searchsorted([0.05, 0.4], share, "right") * 2 + (long_[first[1:]] > long_[first[:-1]])
    return s[pick], e[pick], chain, np.stack([shape, change, signs, pure, prior, keyword, following, file[own]], 1).astype(np.int64)


_keywords: list[np.ndarray] = []


def _keyword_hashes() -> np.ndarray:
    if not _keywords:
        raw = np.frombuffer("".join(_KEYWORDS).encode(), np.uint8)
        ends = np.cumsum([len(k) for k in _KEYWORDS])
        _keywords.append(span_hashes(raw, ends - [len(k) for k in _KEYWORDS], ends))
    return _keywords[0]


class Field:
    """weights: a row of three (outside, begin, inside) for each value of each feature; move: from tag to tag. A chain starts and ends outside, and inside never follows outside."""

    def __init__(self, weights: np.ndarray, move: np.ndarray):
        self.weights, self.move = weights, move.copy()
        self.move[OUTSIDE, INSIDE] = -1e9

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features + _FIRST[:-1]].sum(1)

    def decoded(self, features: np.ndarray, chain: np.ndarray) -> np.ndarray:
        """The best tags, by Viterbi over all chains at once, a step for each place in a chain."""
        e = self.emissions(features)
        starts = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
        sizes = np.diff(np.append(starts, len(chain)))
        by = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[by], sizes[by]
        score = self.move[OUTSIDE] + e[starts]
        back = np.zeros((len(e), 3), np.int8)
        final = np.zeros((len(starts), 3))
        open_ = len(starts)
        for t in range(1, int(sizes[0]) + 1):
            left = int(np.searchsorted(-sizes, -t, "left"))  # chains longer than t
            final[left:open_] = score[left:open_]
            open_ = left
            if not left:
                break
            step = score[:left, :, None] + self.move[None]
            at = starts[:left] + t
            back[at] = step.argmax(1)
            score = step.max(1) + e[at]
        tags = np.zeros(len(e), np.int8)
        now = (final + self.move[:, OUTSIDE]).argmax(1).astype(np.int8)
        for t in range(int(sizes[0]) - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -t, "left"))
            at = starts[:live] + t
            tags[at] = now[:live]
            now[:live] = back[at, now[:live]]
        return tags

    @classmethod
    def learned(cls, chains: list[tuple[np.ndarray, np.ndarray]], rounds: int = 45, decay: float = 1e-3, start: Field | None = None) -> Field:
        """By maximum likelihood with a quadratic penalty, from (features, tags) of chains, and from the weights of another field where one is given; without chains nothing is ever tagged.

        Chains are laid out place by place, the longest first, so that each step of the sums over taggings takes all chains that are long
        enough; sums are scaled to one at each place.
        """
        weights, move = (start.weights.copy(), start.move.copy()) if start else (np.zeros((int(_FIRST[-1]), 3)), np.zeros((3, 3)))
        if not chains:
            weights[: SIZES[0], OUTSIDE] = 1.0
            return cls(weights, move)
        chains = sorted(chains, key=lambda c: -len(c[1]))
        size, n = np.array([len(t) for _, t in chains]), len(chains)
        longest = int(size[0])
        alive = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains longer than t
        place = np.concatenate(([0], np.cumsum(alive[:-1])))
        every = np.concatenate([np.arange(k) for k in size])
        at = place[every] + np.repeat(np.arange(n), size)  # where each word of each chain is
        x = np.empty((int(size.sum()), len(SIZES)), np.int64)
        y = np.empty(len(x), np.int64)
        x[at], y[at] = np.concatenate([f for f, _ in chains]) + _FIRST[:-1], np.concatenate([t for _, t in chains])
        last = place[size - 1] + np.arange(n)
        step = [slice(place[t], place[t] + alive[t]) for t in range(longest)]
        onehot = np.eye(3)[y]
        pairs = np.zeros((3, 3))
        for now, then in zip(step, step[1:], strict=False):
            pairs += np.bincount(3 * y[now][: then.stop - then.start] + y[then], minlength=9).reshape(3, 3)
        pairs[OUTSIDE] += np.bincount(y[step[0]], minlength=3)
        pairs[:, OUTSIDE] += np.bincount(y[last], minlength=3)
        flat = x.ravel()
        speed = [np.full_like(weights, 1e-6), np.full_like(move, 1e-6)]
        for _ in range(rounds):
            m = np.exp(cls(weights, move).move)
            e = sum(weights[x[:, k]] for k in range(len(SIZES)))
            e = np.exp(e - e.max(1, keepdims=True))
            alpha, beta = np.empty_like(e), np.empty_like(e)
            beta[last] = m[:, OUTSIDE]
            alpha[step[0]] = m[OUTSIDE] * e[step[0]]
            for now, then in zip(step, step[1:], strict=False):
                alpha[now] /= alpha[now].sum(1, keepdims=True)
                alpha[then] = (alpha[now][: then.stop - then.start] @ m) * e[then]
            expected = np.zeros((3, 3))
            for now, then in zip(step[-2::-1], step[:0:-1], strict=True):
                ahead = e[then] * beta[then]
                k = slice(now.start, now.start + then.stop - then.start)
                back = ahead @ m.T
                edge = alpha[k].T @ (ahead / np.maximum((alpha[k] * back).sum(1, keepdims=True), 1e-300)) * m
                expected += edge
                beta[k] = back / back.sum(1, keepdims=True)
            node = alpha * beta
            node /= node.sum(1, keepdims=True)
            expected[OUTSIDE] += node[step[0]].sum(0)
            expected[:, OUTSIDE] += node[last].sum(0)
            diff = onehot - node
            slope = np.stack([np.bincount(flat, weights=np.repeat(diff[:, tag], len(SIZES)), minlength=len(weights)) for tag in range(3)], 1)
            for p, g, v in ((weights, slope / n - decay * weights, speed[0]), (move, (pairs - expected) / n - decay * move, speed[1])):
                v += g * g
                p += 0.5 * g / np.sqrt(v)
        return cls(weights, move)


def made_secret(rng: np.random.Generator) -> str:
    """A secret of a shape drawn at random."""
    letters, lower, upper, digits = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijkmnopqrstuvwxyz", "ABCDEFGHJKLMNPQRSTUVWXYZ", "0123456789"
    some = lambda chars, n: "".join(chars[i] for i in rng.integers(0, len(chars), n))
    kind = int(rng.integers(0, 7))
    if kind == 0:
        return some(letters, int(rng.integers(10, 44)))
    if kind == 1:
        return some(letters + "+/", int(rng.integers(20, 60))) + "=" * int(rng.integers(0, 3))
    if kind == 2:
        return "-".join(some(lower + digits if rng.random() < 0.5 else upper + digits, int(rng.integers(4, 7))) for _ in range(int(rng.integers(3, 6))))
    if kind == 3:
        return some(lower, int(rng.integers(2, 5))) + "_" + some(letters, int(rng.integers(14, 36)))
    if kind == 4:
        return some(upper, 1) + some(lower, int(rng.integers(3, 8))) + some(digits, int(rng.integers(2, 5))) + some("!#$%&*?", int(rng.integers(0, 2)))
    if kind == 5:
        return some(upper + digits, int(rng.integers(14, 28)))
    return some(lower, int(rng.integers(8, 16)))


def made_ordinary(rng: np.random.Generator) -> str:
    """A word with digits or signs that is no secret: an address, a date, a number, a path, a name of a thing."""
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda chars, least, most: "".join(chars[i] for i in rng.integers(0, len(chars), int(rng.integers(least, most))))
    name, n = some(lower, 3, 12), lambda k: some(digits, k, k + 1)
    forms = (
        f"{name}.{n(2)}@{some(lower, 3, 8)}{n(1)}.example.com", f"{name}_{some(lower, 2, 9)}@{some(lower, 3, 9)}.org", f"http://{name}.{some(lower, 2, 4)}/{some(lower, 2, 8)}{n(1)}/{some(lower, 1, 9)}",
        f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}:{n(2)}", f"{n(3)}-{n(3)}-{n(4)}", f"+{n(2)}", some(digits, 1, 19), f"{n(1)},{n(3)}.{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"/{some(lower, 3, 6)}/{some(lower, 3, 9)}/{name}{n(1)}.txt",
        f"{name}-{n(2)}", f"{name.title()}/{some(lower, 3, 9)}", f"({n(1)}{name[:1]})", f"{name}={n(1)}", f"#{n(4)}", f"{name.upper()}{n(1)}",
    )
    return forms[int(rng.integers(0, len(forms)))]


#: How made secrets stand among words: with a keyword, or by themselves where they are long.
_FORMS = ("{k}: {v}", "{k} = {v}", "{k} is {v}", "{k} {v}", "{k} -> {v}", "{k}={v}", "{k}: \"{v}\"", "my {k} here: {v}", "--{k} {v}")


def made_text(before: str, after: str, rng: np.random.Generator) -> tuple[str, str | None]:
    """Words around a secret that is made up, and the word that holds it; or, half of the times, an ordinary word or a keyword among them and no secret."""
    keyword = _KEYWORDS[int(rng.integers(0, len(_KEYWORDS)))]
    keyword = keyword.upper() if rng.random() < 0.3 else keyword
    luck = rng.random()
    if luck < 0.5:
        return f"{before} {keyword if luck < 0.15 else made_ordinary(rng)} {after}", None
    value = made_secret(rng)
    plain = value.isalpha() and value.islower()
    if len(value) >= 20 and not plain and rng.random() < 0.3:
        return f"{before} {value} {after}", value
    # A secret of letters only is told by the sign before it, else it would be a word like others.
    form = _FORMS[int(rng.integers(0, 2 if plain else len(_FORMS)))]
    text = form.format(k=keyword, v=value)
    return f"{before} {text} {after}", text.split()[-1]


def _chains_of(docs: DataFrame, made: int = 1) -> DataFrame:
    """Chains of docs with their tags: kind (match of a base pattern, plain or made: `made` texts for each document), features (flat), tags, luck (by the text and the chain's place in it); CHAIN_WORDS words at most, around the first secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []

            def take(kind, x, y, seed, place):
                own = np.flatnonzero(y)
                a = max(0, int(own[0]) - CHAIN_WORDS // 2) if len(own) else 0
                luck = int(mixed(np.array([(seed + place * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64))[0] >> np.uint64(1))
                out.append((kind, x[a : a + CHAIN_WORDS].ravel().tolist(), y[a : a + CHAIN_WORDS].tolist(), luck))

            for _, _, data, offsets in chunks(b.column(0)):
                s, e, chain, x = word_features(data, offsets)
                seeds = span_hashes(data, offsets[:-1], offsets[1:])
                y = np.zeros(len(s), np.int64)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for r in candidates(data, offsets).tolist():
                    base = chars[offsets[r]]
                    for a, z, kind in base_spans(data[offsets[r] : offsets[r + 1]].tobytes().decode()):
                        inside = np.flatnonzero((chars[s] < base + z) & (chars[e] > base + a))
                        if kind == "assign":
                            inside = inside[-1:]
                        y[inside] = np.maximum(y[inside], INSIDE)
                        if len(inside):
                            y[inside[0]] = BEGIN
                starts = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1]))) if len(s) else np.zeros(0, np.int64)
                doc = np.searchsorted(offsets, s, "right") - 1
                for a, z in zip(starts.tolist(), np.append(starts[1:], len(chain))[: len(starts)].tolist(), strict=True):
                    take("match" if y[a:z].any() else "plain", x[a:z], y[a:z], int(seeds[doc[a]]), a)
                ws, we, first = words(data, offsets)
                file = dict(zip(doc.tolist(), x[:, -1].tolist(), strict=True))
                for r, k in ((r, k) for r in np.flatnonzero(np.diff(first) >= 4).tolist() for k in range(made)):
                    rng = np.random.default_rng([int(seeds[r]), k])
                    at = int(rng.integers(first[r] + 1, first[r + 1]))
                    part = lambda i, j: data[ws[i] : we[j - 1]].tobytes().decode()  # noqa: B023, E731
                    text, held = made_text(part(max(first[r], at - 5), at), part(at, min(first[r + 1], at + 5)), rng)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ms, me, mchain, mx = word_features(raw, np.array([0, len(raw)]))
                    mx[:, -1] = file.get(r, 0)
                    tags = np.zeros(len(ms), np.int64)
                    for i in range(len(ms)):
                        tags[i] = BEGIN if held and raw[ms[i] : me[i]].tobytes().decode() == held else OUTSIDE
                    for c in np.unique(mchain):
                        if not held or tags[mchain == c].any():
                            take("made", mx[mchain == c], tags[mchain == c], int(seeds[r]), (1 << 40) + k)
            kinds, xs, ys, luck = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(xs, pa.list_(pa.int64())), pa.array(ys, pa.list_(pa.int64())), pa.array(luck, pa.int64())], names=["kind", "x", "y", "luck"])

    return docs.mapInArrow(tidy(run), "kind string, x array<long>, y array<long>, luck long")


def learned(docs: DataFrame) -> Field:
    """The field, from a sample of docs chosen by a hash of doc_id and text (at most about SAMPLE_DOCS of them): tags are those of the base patterns, and of secrets made up in the sample's own surroundings. Without texts nothing is ever tagged.

    Words that no pattern matches count as outside, but for those that a first field, learned without them, takes for secrets beside a
    keyword or by their length: they may be secrets that patterns miss.
    """
    n = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, math.ceil(n / SAMPLE_DOCS)))) == 0).select("text")
    chains = written(_chains_of(sample, max(1, min(16, 2 * CHAINS // max(1, n)))), "chains")

    # The CHAINS of each kind that luck sets first, in one job; a kind's limit is taken within tasks before it is shuffled.
    lucky = F.row_number().over(Window.partitionBy("kind").orderBy("luck", "x"))
    kinds: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in sorted(chains.withColumn("r", lucky).filter(F.col("r") <= CHAINS).collect(), key=lambda r: r["r"]):
        kinds.setdefault(r["kind"], []).append((np.array(r["x"]).reshape(-1, len(SIZES)), np.array(r["y"])))
    known, plain = kinds.get("match", []) + kinds.get("made", []), kinds.get("plain", [])
    first = Field.learned(known)

    def doubtful(x: np.ndarray) -> bool:
        tagged = first.decoded(x, np.zeros(len(x), np.int64)) != OUTSIDE
        return bool((tagged & ((x[:, 5] > 0) | (x[:, 0] >= 24))).any())

    return Field.learned(known + [(x, y) for x, y in plain if not doubtful(x)], 30, start=first)


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id and spans, an array of (start, end, kind) by start, then kind as in KINDS.

    Code points, end exclusive. Base matches (assign, access, hex) always stay; a "crf" span is a run of words that the field tags, without
    sentence marks at its ends, where no base match overlaps it. A null or empty text has no spans, a very long one is scanned whole; rows
    that repeat are scanned alike, and an empty table gives none. field: learned() of docs unless given. Other columns are not read.
    """
    model = field or learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans: list[list] = [[] for _ in range(len(b))]
            for at, _, data, offsets in chunks(b.column(1)):
                if not len(data):
                    continue
                for r in candidates(data, offsets).tolist():
                    spans[at + r] = base_spans(data[offsets[r] : offsets[r + 1]].tobytes().decode())
                s, e, chain, x = word_features(data, offsets)
                if not len(s):
                    continue
                tags = model.decoded(x, chain)
                begins = np.flatnonzero(tags == BEGIN)
                if not len(begins):
                    continue
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                for i in begins.tolist():
                    j = i
                    while j + 1 < len(tags) and tags[j + 1] == INSIDE and chain[j + 1] == chain[i]:
                        j += 1
                    a, z = int(s[i]), int(e[j])
                    while a < z - 1 and _KIND[data[a]] == 3:
                        a += 1
                    while z > a + 1 and _KIND[data[z - 1]] == 3:
                        z -= 1
                    r = int(np.searchsorted(offsets, a, "right")) - 1
                    base = chars[offsets[r]]
                    a, z = int(chars[a] - base), int(chars[z] - base)
                    if not any(u < z and a < v for u, v, k in spans[at + r] if k != "crf"):
                        spans[at + r].append((a, z, "crf"))
            out = [[{"start": a, "end": z, "kind": k} for a, z, k in sorted(x, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))] for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, spans array<struct<start: long, end: long, kind: string>>")
