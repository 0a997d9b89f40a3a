"""Approximate nearest neighbours: robust-pruned directed graphs, one for each shard, searched with a beam.

A shard's graph grows in batches: greedy searches over the graph so far propose neighbours, all nodes that they visit, relaxed distance
pruning keeps the diverse ones, edges are made both ways and pruned again where there are too many. Points are put in twice, the second
time with the relaxation. Searches start at the nearest of some far apart nodes, and every node can be reached from those.
Every step works on a whole batch of points, in double precision round the shard's middle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Edges of a node, beam of building, relaxation of pruning; distinct vectors in a shard, about.
DEGREE, BUILD_BEAM, ALPHA, SHARD_VECTORS = 32, 64, 1.2, 16384
#: The beam of a search in each shard.
SEARCH_BEAM = 128
#: Nodes far apart among which a search looks for its first ones, and how many of them it takes.
ENTRIES, FIRST = 64, 4
#: Queries that meet a shard in one task, about.
QUERY_BLOCK = 4096
#: Vectors so many times as far from a shard's middle as the median would cost the others their precision: they are compared one by one.
FAR = 1000.0
#: Points that are worked on together, and nodes of each beam that are expanded at once.
_BATCH, _WIDE = 256, 4


def beam_search(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, starts, q: np.ndarray, beam: int, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest nodes found for each row of q (ids, -1: none; squared distances), nearest first. A list gets (rows, ids) of the nodes that were visited."""
    n, starts = len(q), np.atleast_1d(starts)
    qn = (q * q).sum(1)
    ids = np.full((n, beam), -1, np.int32)
    dist = np.full((n, beam), np.inf)
    done = np.ones((n, beam), bool)
    first = qn[:, None] + norms[starts] - 2 * (q @ x[starts].T)
    few = min(FIRST, beam, len(starts))
    order = np.argsort(first, 1, kind="stable")[:, :few]
    ids[:, :few], dist[:, :few], done[:, :few] = starts[order], np.take_along_axis(first, order, 1), False
    rows = np.arange(n)
    while len(rows):
        open_dist = np.where(done[rows], np.inf, dist[rows])
        pick = np.argpartition(open_dist, _WIDE, 1)[:, :_WIDE] if beam > _WIDE else np.argsort(open_dist, 1)
        alive = np.isfinite(np.take_along_axis(open_dist, pick, 1))
        live = alive.any(1)
        rows, pick, alive = rows[live], pick[live], alive[live]
        if not len(rows):
            break
        done[rows[:, None], pick] |= alive
        at = np.where(alive, ids[rows[:, None], pick], -1)
        if visited is not None:
            visited.append((rows, at))
        near = np.where(alive[:, :, None], graph[np.maximum(at, 0)], -1).reshape(len(rows), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near[:, :, None] == ids[rows][:, None, :]).any(2)] = -1
        at = np.maximum(near, 0)
        d = np.where(near >= 0, qn[rows][:, None] + norms[at] - 2 * np.einsum("ijk,ik->ij", x[at], q[rows]), np.inf)
        all_d, all_ids = np.concatenate((dist[rows], d), 1), np.concatenate((ids[rows], near), 1)
        all_done = np.concatenate((done[rows], near < 0), 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[rows], ids[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (all_d, all_ids, all_done))
    return ids, dist


def _table(visited: list, n: int) -> np.ndarray:
    """Visited nodes as a row of ids for each of n searches, -1 beyond their number."""
    row = np.concatenate([np.repeat(r, at.shape[1]) for r, at in visited])
    node = np.concatenate([at.ravel() for _, at in visited])
    row, node = row[node >= 0], node[node >= 0]
    order = np.argsort(row, kind="stable")
    row, node = row[order], node[order]
    count = np.bincount(row, minlength=n)
    out = np.full((n, int(count.max())), -1, np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = node
    return out


def far_apart(x: np.ndarray, norms: np.ndarray, most: int = ENTRIES) -> np.ndarray:
    """Nodes of which each is farthest from those before it; the first is nearest to the middle."""
    out = [int(np.argmin(norms - 2 * (x @ x.mean(0))))]
    least = np.full(len(x), np.inf)
    while len(out) < min(most, len(x)):
        least = np.minimum(least, norms + norms[out[-1]] - 2 * (x @ x[out[-1]]))
        least[out[-1]] = -1
        out.append(int(np.argmax(least)))
    return np.array(out)


def reached(graph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which nodes can be reached from the starts."""
    seen = np.zeros(len(graph), bool)
    now = np.unique(starts)
    seen[now] = True
    while len(now):
        near = np.unique(graph[now])
        now = near[near >= 0]
        now = now[~seen[now]]
        seen[now] = True
    return seen


def connected(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The graph with an edge more, from the nearest node that can be reached, to one of every part that cannot."""
    seen = reached(graph, starts)
    while not seen.all():
        lost, known = np.flatnonzero(~seen), np.flatnonzero(seen)
        best, least = (0, 0), np.inf
        for a in range(0, len(lost), _BATCH):
            own = lost[a : a + _BATCH]
            d = norms[own][:, None] + norms[known] - 2 * (x[own] @ x[known].T)
            at = np.unravel_index(np.argmin(d), d.shape)
            if d[at] < least:
                best, least = (int(own[at[0]]), int(known[at[1]])), d[at]
        node, near = best
        free = np.flatnonzero(graph[near] < 0)
        if not len(free):
            graph = np.concatenate((graph, np.full((len(graph), 4), -1, graph.dtype)), 1)
            free = np.flatnonzero(graph[near] < 0)
        graph[near, free[0]] = node
        seen |= reached(graph, np.array([node]))
    return graph


def robust_prune(x: np.ndarray, norms: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to degree of the candidates (rows of ids, -1: none) of each point: the nearest, then without all that it is alpha times as near to as the point is, and so on."""
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    cand[cand == points[:, None]] = -1
    at = np.maximum(cand, 0)
    v = x[at]
    d = norms[points][:, None] + norms[at] - 2 * np.einsum("ijk,ik->ij", v, x[points])
    d = np.where(cand >= 0, np.maximum(d, 0), np.inf)
    order = np.argsort(d, 1)
    cand, d, v = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    vn = norms[np.maximum(cand, 0)]
    between = vn[:, :, None] + vn[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    rows = np.arange(len(points))
    alive = np.isfinite(d)
    out = np.full((len(points), degree), -1, np.int32)
    for k in range(degree):
        best = np.argmax(alive, 1)
        some = alive[rows, best]
        if not some.any():
            break
        out[some, k] = cand[rows, best][some]
        alive &= alpha * alpha * np.maximum(between[rows, best], 0) > d
        alive[rows, best] = False
    return out


def _with_back_edges(x: np.ndarray, norms: np.ndarray, graph: np.ndarray, batch: np.ndarray, alpha: float) -> None:
    """The batch's edges the other way too; nodes that then have too many are pruned."""
    degree = graph.shape[1]
    own = graph[batch]
    src, dst = np.repeat(batch, degree)[own.ravel() >= 0], own.ravel()[own.ravel() >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    targets, first, count = np.unique(dst, return_index=True, return_counts=True)
    width = int(count.max()) if len(count) else 0
    for a in range(0, len(targets), _BATCH):
        t, f, c = targets[a : a + _BATCH], first[a : a + _BATCH], count[a : a + _BATCH]
        k = np.arange(width)
        new = np.where(k < c[:, None], src[np.minimum(f[:, None] + k, len(src) - 1)], -1)
        new[(new[:, :, None] == graph[t][:, None, :]).any(2)] = -1
        both = np.concatenate((graph[t], new), 1).astype(np.int32)
        over = (both >= 0).sum(1) > degree
        if (~over).any():
            graph[t[~over]] = np.take_along_axis(both[~over], np.argsort(both[~over] < 0, 1, kind="stable"), 1)[:, :degree]
        if over.any():
            graph[t[over]] = robust_prune(x, norms, t[over], both[over], degree, alpha)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """The graph (out-edges of each node, -1: none) and the nodes where searches start. Every node can be reached from them."""
    n = len(x)
    norms = (x * x).sum(1)
    graph = np.full((n, degree), -1, np.int32)
    starts = far_apart(x, norms)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate((starts, order[~np.isin(order, starts)]))
    for relaxed in (1.0, alpha):
        at = 1 if relaxed == 1.0 else 0
        while at < n:
            batch = order[at : at + (min(_BATCH, max(1, at)) if relaxed == 1.0 else _BATCH)]
            known = starts[: max(1, min(at, len(starts)))] if relaxed == 1.0 else starts
            at += len(batch)
            visited: list = []
            beam_search(x, norms, graph, known, x[batch], beam // 2 if relaxed == 1.0 else beam, visited)
            graph[batch] = robust_prune(x, norms, batch, np.concatenate((_table(visited, len(batch)), graph[batch]), 1), degree, relaxed)
            _with_back_edges(x, norms, graph, batch, relaxed)
    return connected(x, norms, graph, starts), starts


def _centred(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """A shard's middle (medians of components), the median distance from it, and which vectors are near enough to it for one precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = np.median(x, 0)
        size = np.abs(x - middle).max(1)
    scale = float(np.median(size)) or float(size.max()) or 1.0
    return middle, scale, size <= FAR * scale


def nearest(vectors: DataFrame, is_query, k: int = 10, shard_vectors: int = SHARD_VECTORS, beam: int = SEARCH_BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest found of each query, by Euclidean distance: query_id, rank (from 1), vec_id, score (in double precision).

    vectors: vec_id and embedding; is_query: a condition on its rows; candidates are all rows but the query's own. Nearest first, ties to
    the smaller vec_id; fewer if there are fewer. Vectors that are null, zero, or hold null or non-finite components, and rows without a
    vec_id, take no part; vectors of different lengths never meet. An empty table gives none. Equal vectors are one node of a graph that
    stands for their k + 1 smallest ids, so copies cost nothing and lose nothing. Every distinct vector is in one shard, whose graph is
    written once, and every query searches every shard with the same beam. Vectors that
    dwarf the others of a shard stay out of its graph and are compared with every query, and queries that do with every vector.
    Shards and the blocks of queries that meet them are of a set size, so what a task holds does not grow. Other columns are not read.
    """
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks")).filter("vec_id is not null and v is not null").filter(~bad & F.exists("v", lambda c: c != 0)).withColumn("key", F.xxhash64("v"))
    by = Window.partitionBy("key", "v").orderBy("vec_id")
    first = rows.dropDuplicates(["vec_id", "key"]).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    nodes = written(first.groupBy("key", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    shards = max(1, math.ceil(nodes.count() / shard_vectors))
    width = max(beam, 2 * k)
    groups = nodes.select(F.size("v").alias("dim"), F.pmod("key", F.lit(shards)).alias("shard"), "ids", "v")
    asked = written(rows.filter("asks").select(F.size("v").alias("dim"), F.col("vec_id").alias("query_id"), "v"), "queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    matrix = lambda t: np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(t), -1)

    def grown(own: pa.Table) -> pa.Table:
        x = matrix(own)
        middle, scale, near = _centred(x)
        order = np.argsort(~near, kind="stable")  # those of the graph first
        own, inner = own.take(pa.array(order)), int(near.sum())
        graph, starts = build((x[order[:inner]] - middle) / scale)
        flat = np.concatenate((graph, np.full((len(x) - inner, graph.shape[1]), -1, np.int32)))
        edges = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * graph.shape[1], pa.int32()), pa.array(flat.ravel()))
        first = np.isin(np.arange(len(x)), starts)
        return own.append_column("node", pa.array(np.arange(len(x)), pa.int32())).append_column("edges", edges).append_column("first", pa.array(first))

    graphs = written(groups.groupBy("dim", "shard").applyInArrow(grown, "dim int, shard long, ids array<long>, v array<double>, node int, edges array<int>, first boolean"), "graphs")

    def search(own: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(own) and len(queries):
            own = own.sort_by("node")
            x, q = matrix(own), matrix(queries)
            middle, scale, near = _centred(x)
            inner = int(near.sum())
            graph, starts = np.asarray(own.column("edges").combine_chunks().flatten()).reshape(len(own), -1)[:inner], np.flatnonzero(own.column("first").to_numpy())
            centred = (x[:inner] - middle) / scale
            norms = (centred * centred).sum(1)
            names, ids = queries.column("query_id").to_numpy(), own.column("ids").to_pylist()
            with np.errstate(over="ignore", invalid="ignore"):
                plain = np.abs(q - middle).max(1) <= FAR * scale
            outer, every = np.arange(inner, len(x)), np.arange(len(x))
            for a in range(0, len(q), _BATCH):
                at = np.arange(a, min(a + _BATCH, len(q)))
                found = dict(zip(at[plain[at]].tolist(), beam_search(centred, norms, graph, starts, (q[at[plain[at]]] - middle) / scale, width)[0], strict=True)) if plain[at].any() else {}
                for i in at.tolist():
                    some = np.concatenate((found[i][found[i] >= 0], outer)) if i in found else every
                    with np.errstate(over="ignore"):
                        d = np.sqrt(((x[some] - q[i]) ** 2).sum(1))
                    # All nodes as near as the (k + 1)-th: of equal distances the smaller vec_ids are asked for.
                    best = np.flatnonzero(d <= np.partition(d, k)[k]) if len(d) > k else np.arange(len(d))
                    pairs = sorted((float(d[j]), v) for j in best for v in ids[some[j]] if v != names[i])[:k]
                    out["query_id"] += [int(names[i])] * len(pairs)
                    out["vec_id"] += [v for _, v in pairs]
                    out["score"] += [s for s, _ in pairs]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    dealt = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks))).select("dim", numbers(shards).alias("shard"), "block", "query_id", "v")
    hits = graphs.withColumn("block", numbers(blocks)).groupBy("dim", "shard", "block").cogroup(dealt.groupBy("dim", "shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
