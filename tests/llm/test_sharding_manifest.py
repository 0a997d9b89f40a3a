"""Sharding and the Merkle manifest, held against plain recomputation."""

import hashlib
import random
import zlib

from contrada.llm import manifest, order, sharding
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(n, seed=0):
    rng = random.Random(seed)
    texts = ["", None, "same text of many", "x" * 3000, "été œuvre " * 40]
    rows = []
    for i in range(n):
        text = texts[i % 5] if rng.random() < 0.3 else " ".join(rng.choice("alfa beta gamma delta".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 60)))
        lang = rng.choice(["en", "en", "en", "de", "", None])
        rows.append((None if i % 37 == 5 else rng.randrange(1 << 60) if i % 2 else i, text, lang, rng.choice(["a", None, "b"]), rng.choice([None, len(text or "")])))
    return rows + rows[:3] + rows[5:6]


def as_docs(spark, rows, parts=5):
    return spark.createDataFrame(rows, DOCS).repartition(parts).withColumns({"part": F.lit(1), "row": F.lit("x"), "size": F.lit(None).cast("int"), "tree": F.lit("y")})


def plain_shards(rows, shards, percent=1):
    sized = sorted((hashlib.md5((t or "").encode()).hexdigest(), -1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    total, at, ends, begins = sum(x[2] for x in sized), 0, {}, {}
    for k, (d, _, size, _) in enumerate(sized):
        begins.setdefault(d, (at, k))
        at += size
        ends[d] = (at, k + 1)
    cuts = []
    for s in range(1, shards):
        at = 0
        for k, (d, _, size, _) in enumerate(sized):
            if shards * at <= s * total < shards * (at + size):
                (a, i), (b, j) = begins[d], ends[d]
                if (b - a) * shards * 100 > total * percent:
                    a, i, b, j = at, k, at + size, k + 1
                cuts.append(i if 2 * s * total <= shards * (a + b) else j)
            at += size
    out = []
    for k, (_, i, size, crc) in enumerate(sized):
        shard = sum(c <= k for c in cuts)
        out.append((None if i < 0 else i, size, crc, "bytes", shard, k - ([0, *cuts][shard]), None))
    return out


def key(row):
    return tuple(map(str, row))


def test_shards_as_recomputed(spark):
    rows = rows_of(400)
    docs = as_docs(spark, rows)
    for shards, percent in ((8, 1), (3, 40), (1, 1), (700, 1)):
        got = [tuple(r) for r in sharding.sharded(docs, shards, percent).collect()]
        assert sorted(got, key=key) == sorted(plain_shards(rows, shards, percent), key=key)


def test_shards_are_near_equal_and_gapless(spark):
    rows = [(i, "hot text" * 20 if i % 3 == 0 else f"own text {i} " * (i % 9 + 1), "en", "s", 1) for i in range(3000)]
    got = sharding.sharded(as_docs(spark, rows)).collect()
    sizes = {}
    slots = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Reruns, and other partitions, agree.
    assert sorted(map(key, sharding.sharded(as_docs(spark, rows, 13)).collect())) == sorted(map(key, got))


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert sharding.sharded(empty).count() == 0
    assert manifest.proven(empty).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i % 150} " * (i % 11 + 1), "en", "s", i) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("Shard", F.lit(7))
    told = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs).collect()}
    back = sharding.write_shards(docs, str(tmp_path / "shards"))
    found = {r["doc_id"]: r["shard"] for r in back.collect()}
    assert found == told and "shard_" in back.columns
    assert back.filter("shard = 3").select("doc_id", "text").count() == sum(s == 3 for s in told.values())


def test_places_in_order(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 5 + 1).alias("w"))
    got = order.placed(rows, ["k"], F.col("w")).orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(1000)) and [r["k"] for r in got] == sorted(r["k"] for r in got)
    at = 0
    for r in got:
        assert r["before"] == at
        at += r["w"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_leaf(i, text, lang, source, n):
    return sha("".join(map(field, (i, source, lang, n, text))))


def climb(nodes):
    """Levels by the contract's own words."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def plain_proofs(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    trees = {}
    for lang, own in langs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = climb([plain_leaf(*r) for r in own])
    order_ = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    top = climb([trees[x][-1][0] for x in order_])
    out = []
    for lang in langs:
        for k, r in enumerate(langs[lang]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = plain_leaf(*r[:4], r[4] + 1) if tampered else plain_leaf(*r)
            siblings = []
            for tree, place in ((trees[lang], k), (top, order_.index(lang))):
                for level in tree[:-1]:
                    run = level[place // 2 * 2 : place // 2 * 2 + 2]
                    siblings += [x for j, x in enumerate(run) if j != place % 2]
                    run[place % 2] = node
                    node = sha("".join(run))
                    place //= 2
            out.append((r[0], plain_leaf(*r), trees[lang][-1][0], top[-1][0], sha("".join(siblings)), node, node == top[-1][0]))
    return out


def test_proofs_as_recomputed(spark):
    for n, height in ((300, 2), (300, 10), (1, 1), (17, 1)):
        rows = rows_of(n, n)
        docs = as_docs(spark, rows)
        got = [tuple(r) for r in manifest.proven(docs, height, with_path=False).collect()]
        want = plain_proofs(rows)
        assert sorted(map(key, got)) == sorted(map(key, want))
        assert n < 100 or (any(not r[-1] for r in got) and any(r[-1] for r in got))


def test_paths_fold_to_the_root(spark):
    for r in manifest.proven(as_docs(spark, rows_of(60)), 3).collect():
        assert manifest.folded(r["leaf"], r["path"]) == r["root"]
        assert hashlib.sha256("".join(s[1:] for s in r["path"]).encode()).hexdigest() == r["proof_sha256"]
