"""A Merkle manifest of a dataset: leaves of rows, a tree for each language, one root, and every row's proof.

Trees are climbed by superblocks of consecutive nodes: each reduces its own nodes to one, those are the nodes of the next round, and on
the way down the nodes of a superblock are cogrouped with the one row of outer nodes that they need. Every round is written.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import even_batches, written
from .order import placed

#: Nodes of a superblock are 2 to this power.
HEIGHT = 10
#: One row out of so many, by its number's checksum, is tampered with in the manifest's own trial.
TRIAL = 7

_NODES = "tree string, idx long, n long, node string"
_PATHS = "tree string, idx long, root string, path array<string>"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def levels(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """Levels from the nodes upwards: every two consecutive ones give one, a last single one its own. Up to one node, or where a height is given up to that."""
    out = [nodes]
    while len(out[-1]) > 1 if height is None else len(out) <= height:
        now = out[-1]
        out.append([_hash("".join(now[i : i + 2])) for i in range(0, len(now), 2)])
    return out


def path_of(above: list[list[str]], i: int) -> list[str]:
    """A node's siblings from the bottom to below the top: L or R and the node, or - where it is alone."""
    out = []
    for level in above[:-1]:
        other = i ^ 1
        out.append("-" if other >= len(level) else ("L" if other < i else "R") + level[other])
        i >>= 1
    return out


def folded(node: str, path: list[str]) -> str:
    """The root that a node and its siblings give."""
    for step in path:
        node = _hash(node if step == "-" else step[1:] + node if step[0] == "L" else node + step[1:])
    return node


def _block_levels(rows: pd.DataFrame, height: int) -> list[list[str]]:
    """Levels of a superblock: the only one of its tree ends at one node, of several each is as high."""
    whole = int(rows["n"].iloc[0]) > 1 << height
    return levels(rows["node"].tolist(), height if whole else None)


def climbed(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Of nodes (tree, idx from 0, n of the tree, node): tree, idx, root of the tree, and path, the node's siblings up to it. A task holds superblocks one at a time; rounds are the logarithm of the largest tree."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    dealt = nodes.withColumn("block", F.shiftright("idx", height))
    if most <= 1 << height:

        def finish(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("idx")
            above = _block_levels(rows, height)
            return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "root": above[-1][0], "path": [path_of(above, i) for i in range(len(rows))]})

        return written(dealt.groupBy("tree", "block").applyInPandas(finish, _PATHS), "merkle-paths")
    outer = climbed(_reduced(dealt, height), height)

    def descend(rows: pd.DataFrame, above_rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        above, top = _block_levels(rows, height), above_rows.iloc[0]
        return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "root": top["root"], "path": [path_of(above, i) + list(top["path"]) for i in range(len(rows))]})

    sides = dealt.groupBy("tree", "block").cogroup(outer.withColumnRenamed("idx", "block").groupBy("tree", "block"))
    return written(sides.applyInPandas(descend, _PATHS), "merkle-paths")


def _reduced(dealt: DataFrame, height: int) -> DataFrame:
    """One node for each superblock of nodes (tree, block, idx, n, node), as nodes of the next round."""

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        size = 1 << height
        return pd.DataFrame({"tree": rows["tree"].iloc[:1], "idx": rows["block"].iloc[:1], "n": -(-rows["n"].iloc[:1] // size), "node": _block_levels(rows, height)[-1]})

    return written(dealt.select("tree", "block", "idx", "n", "node").groupBy("tree", "block").applyInPandas(reduce, _NODES), "merkle-nodes")


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (a name of lang that is never null and sorts like it, null first), leaf, and tampered: the leaf with one more in n_chars where the row is of the trial (the same where n_chars is null), else null."""
    text = lambda c: F.col(c).cast("string")
    row = lambda n: F.sha2(F.concat(*[_field(x) for x in (text("doc_id"), text("source"), text("lang"), n, text("text"))]), 256)
    more = (F.col("n_chars").cast("decimal(20, 0)") + 1).cast("string")
    tried = F.crc32(text("doc_id")) % TRIAL == 0
    tree = F.coalesce(F.concat(F.lit("="), text("lang")), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), row(text("n_chars")).alias("leaf"), F.when(tried, row(more)).alias("tampered"))


def proven(docs: DataFrame, height: int = HEIGHT, with_path: bool = True) -> DataFrame:
    """One row for each of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot (of its lang), root, proof_sha256, folded_root, verified, and with_path path, the siblings up to the root.

    A leaf is the hash of the row's five fields, - for a null, else byte count and value. Leaves of a lang stand by doc_id (null first),
    equal ones by their hash, so the result is the same for any order of rows; subroots stand by lang, null first and apart from an
    empty one, and give the root. A proof is the siblings from the leaf to the root. folded_root is recomputed from the tampered leaf
    where the row is of the trial, else from the leaf, with the untampered siblings; verified tells whether it is the root. Rows that
    repeat are leaves of their own, texts of any length are hashed whole, an empty table has no root. Other columns are not read.

    Texts are hashed where they are read and never shuffled. A lang may have any share of the rows: places in it come from totals of
    ranges by lang and doc_id, and superblocks spread it over tasks. One row for each lang (a category) is joined as Spark's size check decides.
    """
    even_batches(docs.sparkSession)
    at = placed(leaves(docs), ["tree", "doc_id", "leaf"], name="leaves")
    trees = written(at.groupBy("tree").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    nodes = at.join(trees, "tree").select("tree", (F.col("row") - F.col("first")).alias("idx"), "n", F.col("leaf").alias("node"), F.col("doc_id").cast("string").alias("doc_id"), "tampered")  # pandas would make longs beside a null doubles
    nodes = nodes.withColumn("block", F.shiftright("idx", height))
    tops = _reduced(nodes, height)
    climb = climbed(tops, height)  # superblocks up to their lang's subroot
    subroots = climb.select("tree", F.col("root").alias("node")).distinct()
    langs = placed(subroots, ["tree"], name="subroots")
    counted = langs.select(F.lit("").alias("tree"), F.col("row").alias("idx"), F.lit(langs.count()).cast("long").alias("n"), "node", F.col("tree").alias("lang"))
    above = counted.join(climbed(counted.select("tree", "idx", "n", "node"), height).select("idx", F.col("root").alias("top"), F.col("path").alias("upper")), "idx").select(F.col("lang").alias("tree"), "top", "upper")
    outer = climb.join(above, "tree").select("tree", F.col("idx").alias("block"), F.col("root").alias("subroot"), F.col("top").alias("root"), F.concat("path", "upper").alias("path"))

    def prove(rows: pd.DataFrame, outer_rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        own, top = _block_levels(rows, height), outer_rows.iloc[0]
        beyond = list(top["path"])
        paths = [path_of(own, i) + beyond for i in range(len(rows))]
        starts = [t if isinstance(t, str) else leaf for t, leaf in zip(rows["tampered"], rows["node"], strict=True)]
        roots = [folded(s, p) for s, p in zip(starts, paths, strict=True)]
        proofs = [_hash("".join(s[1:] for s in p)) for p in paths]
        out = pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["node"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": proofs, "folded_root": roots, "verified": [r == top["root"] for r in roots]})
        return out.assign(path=paths) if with_path else out

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", path array<string>" if with_path else "")
    rows = nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(prove, schema)
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
