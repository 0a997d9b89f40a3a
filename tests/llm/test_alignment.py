"""Cross-tokenizer alignment, held against whole texts encoded by the tokenizers themselves."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from contrada.llm import alignment
from contrada.llm.pieces import PieceEncoder
from contrada.llm.queries import PIECES, tokenizer_path

A, B = tokenizer_path(), tokenizer_path(PIECES)
BYTE_LETTERS = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
BYTE_LETTERS |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in BYTE_LETTERS.values())}


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_of(tokenizers, text):
    """[(id, end)] of both, or two empty lists."""
    a, b = tokenizers
    if not text:
        return [], []
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled_a = [bytes(BYTE_LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    spelled_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
    want = (" " + text).encode()
    if b"".join(spelled_a) != want or b"".join(spelled_b) != want:
        return [], []
    return [list(zip(ids, np.cumsum([len(x) for x in s]).tolist())) for ids, s in ((ids_a, spelled_a), (ids_b, spelled_b))]


def plain(tokenizers, texts):
    links, rows = [], []
    for text in texts:
        a, b = tokens_of(tokenizers, text)
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, last = [], 0
        for c in cuts:
            groups.append(([i for i, e in a if last < e <= c], [i for i, e in b if last < e <= c]))
            last = c
        own = defaultdict(int)
        for x, y in groups:
            for i in x:
                for j in y:
                    own[i, j] += 1
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        links.append(own)
        rows.append([len(a), len(b), len(groups), sum(own.values()), hashlib.sha256(said.encode()).hexdigest() if said else ""])
    counts, best = defaultdict(int), defaultdict(int)
    for own in links:
        for p in own:
            counts[p] += 1
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [(*r[:4], sum(m for p, m in own.items() if counts[p] == best[p[0]]), sum(m * counts[p] for p, m in own.items()), r[4]) for r, own in zip(rows, links)]


TEXTS = [
    None, "", " ", "  ", "a", " lead", "two  spaces and trail  ", "Line one\nline two\n\n\tindented", "<s> text </s> <|endoftext|> <unk> <0x41>", "sign ▁ of pieces",
    "Überraschung für façade naïve 日本語のテキスト 한국어 مرحبا", "emoji 😀👍🏽 joined", "é combining   nbsp   wide", "\x00 nul", "don't we'll they've 12345.678 $9,99", "x" * 700, "ab" * 500 + " " + "0123456789" * 80, "日" * 900, "same text twice", "same text twice",
]


def long_text(n, seed):
    r = random.Random(seed)
    words = ["alpha", "beta-gamma", "don't", "日本", "x\ny", "1234567", "été", "  wide", "new\n", "<s>", "q" * 40]
    return " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(n))


TEXTS += [long_text(40, k) for k in range(30)] + [long_text(3000, 100), "z" * 5000, "word\n" * 4000, "sign ▁ " * 3000, long_text(2500, 101)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("long", "part", "sent"), [(1 << 16, 1 << 15, 1 << 20), (300, 64, 200), (2000, 500, 0)])
def test_as_whole_texts_encoded_by_the_tokenizers(spark, tokenizers, long, part, sent):
    rows = [(None if i % 9 == 4 else i, t, 1, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int, row_key string").repartition(4)
    want = [(i, *w[:6], w[6]) for (i, *_), w in zip(rows, plain(tokenizers, TEXTS))]
    assert got(alignment.aligned(docs, A, B, long, part, sent)) == sorted(want, key=str)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, A, B).count() == 0


def test_fragments_compose_in_any_grouping():
    r = random.Random(5)
    for trial in range(200):
        n = r.randrange(2, 60)
        ends = [sorted({*r.sample(range(1, n + 1), r.randrange(1, n + 1)), n}) for _ in "ab"]
        whole = alignment.Side(*[np.array(x, np.int64) for e in ends for x in (range(len(e)), e)])
        # Cuts of a and b at places of their own.
        parts, last = [], (0, 0)
        for _ in range(r.randrange(1, 6)):
            cut = tuple(sorted(r.randrange(last[s], len(ends[s]) + 1) for _ in "x")[0] for s in (0, 1))
            parts.append(alignment.Side(whole.a[last[0] : cut[0]], whole.end_a[last[0] : cut[0]], whole.b[last[1] : cut[1]], whole.end_b[last[1] : cut[1]]))
            last = cut
        parts.append(alignment.Side(whole.a[last[0] :], whole.end_a[last[0] :], whole.b[last[1] :], whole.end_b[last[1] :]))

        def tree(fs):
            if len(fs) == 1:
                return fs[0]
            k = r.randrange(1, len(fs))
            return alignment.composed(tree(fs[:k]), tree(fs[k:]))

        pieces = [alignment.fragment(p) for p in parts]
        seen = []
        for f in (tree(pieces), tree(pieces), alignment.fragment(whole)):
            assert f.has and not len(f.behind.a) and not len(f.behind.b)
            both = f.before
            for c in f.closed:
                assert c.end_a[-1] == c.end_b[-1]
                both = both.then(c)
            seen.append((f.before.end_a.tolist(), f.before.end_b.tolist(), [x.tolist() for x in both.columns()]))
        assert seen[0] == seen[1] == seen[2], trial


def test_ids_of_pieces_are_those_of_whole_texts(tokenizers):
    enc = PieceEncoder(B)
    texts = [t for t in TEXTS if t and "▁" not in t]
    data = [(" " + t).encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    ids, first, wrong = enc.rows(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, t in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == tokenizers[1].encode(t), t[:40]
    assert not wrong.any()


def test_large_groups_are_counted_not_laid_out():
    a, b = np.array([1, 2] * 100, np.int64), np.array([7] * 50 + [8], np.int64)
    g = alignment.grouped(a, np.arange(1, 201) * 3 + np.where(np.arange(200) == 199, 0, 0), b, np.append(np.arange(1, 51) * 3 + 1, 600), np.array([600]))
    assert g.n_groups.tolist() == [1] and g.n_links.tolist() == [200 * 51]
    assert dict(zip(g.pairs.tolist(), g.times.tolist())) == {(1 << 16) | 7: 5000, (1 << 16) | 8: 100, (2 << 16) | 7: 5000, (2 << 16) | 8: 100}
