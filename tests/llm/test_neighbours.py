"""Recall and reachability of the neighbour graphs on vectors of several kinds."""

from collections import defaultdict

import numpy as np
import pytest
from contrada.llm import neighbours
from pyspark.sql import functions as F


def vectors(kind, n, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if kind == "uniform":
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "shifted":
        return x + 10_000
    centres = rng.normal(size=(20, dim)) * 10
    return centres[rng.integers(20, size=n)] + x * {"clustered": 0.5, "near duplicates": 1e-4}[kind]


KINDS = ("uniform", "clustered", "near duplicates", "shifted")


@pytest.mark.parametrize("kind", KINDS)
def test_every_node_is_reached_and_found(kind):
    x = vectors(kind, 1500)
    middle, scale, near = neighbours._centred(x)
    assert near.all()
    y = (x - middle) / scale
    graph, starts = neighbours.build(y)
    assert neighbours.reached(graph, starts).all()
    found, _ = neighbours.beam_search(y, (y * y).sum(1), graph, starts, y, 32)
    assert np.mean(found[:, 0] == np.arange(len(x))) >= 0.99


def test_parts_are_connected():
    x = np.concatenate([np.random.default_rng(k).normal(size=(50, 3)) + 100 * k for k in range(4)])
    lonely = np.full((200, 2), -1, np.int32)  # no edges at all
    graph = neighbours.connected(x, (x * x).sum(1), lonely, np.array([0]))
    assert neighbours.reached(graph, np.array([0])).all()


@pytest.mark.parametrize("kind", KINDS)
def test_recall_in_one_shard_and_nine(spark, kind):
    x = vectors(kind, 1800)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for size in (1800, 200):
        got = defaultdict(set)
        for r in neighbours.nearest(df, F.col("vec_id") % 40 == 0, shard_vectors=size).collect():
            got[r.query_id].add(r.vec_id)
        hits = []
        for q in range(0, 1800, 40):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            hits.append(len(got[q] & set(np.argsort(d)[:10].tolist())) / 10)
        assert np.mean(hits) >= 0.95, (size, np.mean(hits))
