"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, manifest, mixing, neighbours, ngram_join, packing, quality, secrets, sharding, suffix_dedup, token_counts, url_filter
from .common import table

#: The vocabulary file that token operators read; its path is a parameter of theirs.
TOKENIZER = "byte_bpe_50k.json"
#: The other vocabulary of the alignment.
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of near-duplicates: 5-word shingles, similarity 0.8 or more."""
    return ngram_join.near_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that fits it and the verdict."""
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = r"""
WITH t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
h AS (SELECT page_id, tail, regexp_extract(tail, '^[^/?#]*') AS raw FROM t),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(tail, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
l AS (SELECT host, count(*) FILTER (WHERE ruled = 'block') > count(*) FILTER (WHERE ruled = 'allow') AS listed FROM v GROUP BY host)
SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN l ON l.host = v.host
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of at most 1024 ids."""
    pieces = packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets' spans."""
    found = secrets.scanned(table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    joined = lambda spans: F.array_join(F.transform(spans, text), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it."""
    return mixing.mixed_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that start elsewhere too."""
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with the tokens that count for it."""
    return token_counts.line_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard of near equal bytes and its slot there."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


# CRC-32 of a list of bytes, by the table of its polynomial.
_CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS tab)"


def _crc(text: str) -> str:
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])))"


OP11_SQL = f"""
WITH {_CRC_TABLE},
s AS (SELECT doc_id, strlen(t) + 1 AS size, {_crc("t")} AS text_crc32, md5(t) AS digest FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d, crc_table),
r AS (SELECT *, row_number() OVER w - 1 AS nr, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS before FROM s WINDOW w AS (ORDER BY digest, doc_id NULLS FIRST)),
a AS (SELECT sum(size) AS total FROM s),
g AS (SELECT digest, min(before) AS a, max(before + size) AS b, min(nr) AS i, max(nr) + 1 AS j FROM r GROUP BY digest),
c AS (
  SELECT CASE WHEN (g.b - g.a) * 8 * 100 > total THEN CASE WHEN 2 * k * total <= 8 * (2 * before + size) THEN nr ELSE nr + 1 END
              WHEN 2 * k * total <= 8 * (g.a + g.b) THEN g.i ELSE g.j END AS cut
  FROM range(1, 8) AS t(k), a, r JOIN g ON g.digest = r.digest WHERE k * total >= 8 * before AND k * total < 8 * (before + size))
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST((SELECT count(*) FROM c WHERE cut <= nr) AS INT) AS shard, nr - coalesce((SELECT max(cut) FROM c WHERE cut <= nr), 0) AS slot, CAST(NULL AS INT) AS grown_shard FROM r
"""


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the groups of two vocabularies' tokens and their links."""
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, its language's root, the root, its proof, and whether the tried leaf folds to the root."""
    return manifest.proven(table(spark, sf_dir, "documents"), with_path=False)


def _fields(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")) + ")"


_UP = "SELECT tree, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY tree, h, i // 2, n"
_STEP = """SELECT p.id, p.tree, p.h + 1, p.i // 2, (p.n + 1) // 2, sha256(CASE WHEN s.node IS NULL THEN p.node WHEN p.i % 2 = 1 THEN s.node || p.node ELSE p.node || s.node END), p.proof || coalesce(s.node, '')
  FROM {p} p LEFT JOIN {t} s ON s.tree = p.tree AND s.h = p.h AND s.i = xor(p.i, 1) WHERE p.n > 1"""

OP13_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_fields("n_chars")} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_fields("(n_chars + 1)")} END AS tampered FROM documents, crc_table),
e AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv(tree, h, i, n, node) AS (SELECT tree, 0, i, n, leaf FROM e UNION ALL {_UP.format(t="lv")}),
su AS (SELECT '' AS tree, 0 AS h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, node, tree AS lang FROM lv WHERE n = 1),
up(tree, h, i, n, node) AS (SELECT tree, h, i, n, node FROM su UNION ALL {_UP.format(t="up")}),
lo(id, tree, h, i, n, node, proof) AS (SELECT id, tree, 0, i, n, coalesce(tampered, leaf), '' FROM e UNION ALL {_STEP.format(p="lo", t="lv")}),
hi(id, tree, h, i, n, node, proof) AS (SELECT lo.id, su.tree, 0, su.i, su.n, lo.node, lo.proof FROM lo JOIN su ON su.lang = lo.tree WHERE lo.n = 1 UNION ALL {_STEP.format(p="hi", t="up")})
SELECT e.doc_id, e.leaf, su.node AS subroot, t.node AS root, sha256(hi.proof) AS proof_sha256, hi.node AS folded_root, hi.node = t.node AS verified
FROM e JOIN su ON su.lang = e.tree JOIN hi ON hi.id = e.id AND hi.n = 1, (SELECT node FROM up WHERE n = 1) t
"""


OP6_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.x = d.doc_id GROUP BY d.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_quality_classifier, op4_packing, op5_secret_scan, op6_ngram_jaccard_join, op7_source_mixing, op8_nearest_neighbours, op9_suffix_dedup, op10_token_counts, op11_sharding, op12_cross_tokenizer_alignment, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op11_sharding": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
