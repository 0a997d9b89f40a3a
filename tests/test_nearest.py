"""Nearest points of crowded zones, and the retrieval join with boxes of all sizes, against plain loops."""

import math
import random

import numpy as np

from contrada.operators import nearest, poi

POINT = "citta string, zona string, id string, lat double, lon double"


def crowded(n, seed):
    """One zone: a third at one place, a third within metres, the rest spread over the globe, some by the date line and the poles."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = i % 6
        if kind < 2:
            at = (41.9, 12.5)
        elif kind < 4:
            at = (41.9 + r.uniform(-1e-4, 1e-4), 12.5001 + r.uniform(-1e-4, 1e-4))
        elif kind == 4:
            at = (r.uniform(-90, 90), r.choice([r.uniform(-180, 180), 179.9999 - r.random() * 1e-3, -179.9999 + r.random() * 1e-3]))
        else:
            at = (round(41 + r.random(), 2), round(12 + r.random(), 2))
        out.append(("c", "z", f"p{i:05}", *at))
    return out


def plain(rows, k):
    lat, lon = (np.radians(np.array([p[j] for p in rows])) for j in (3, 4))
    ids = np.array([p[2] for p in rows])
    out = set()
    for i in range(len(rows)):
        h = np.sin((lat - lat[i]) / 2) ** 2 + math.cos(lat[i]) * np.cos(lat) * np.sin((lon - lon[i]) / 2) ** 2
        h[i] = np.inf
        d = np.round(h, 18)
        order = np.lexsort((ids, d))[: k + 3]
        out.add((rows[i][2], tuple((ids[j], float(2 * 6371008.8 * math.asin(math.sqrt(min(1, h[j]))))) for j in order if j != i)[:k]))
    return dict(out)


def test_nearest_in_a_crowd_equal_the_loop(spark):
    rows = crowded(1800, 3)
    df = spark.createDataFrame([*rows, ("c", "z", "lost", None, 1.0), ("c", "other", "alone", 1.0, 1.0), ("c", "pair", "a", 1.0, 1.0), ("c", "pair", "b", -89.0, 170.0)], POINT).repartition(7)
    got = {}
    for r in nearest.neighbours_of_many(df).orderBy("zona", "poi_id", "rank").collect():
        got.setdefault((r.zona, r.poi_id), []).append((r.neighbour_id, r.distance_m, r["rank"]))
    want = plain(rows, 5)
    assert len(got) == len(rows) + 2 and got["pair", "a"][0][0] == "b" and got["pair", "b"][0][0] == "a"
    at = {p[2]: p[3:] for p in rows}

    def metres(a, b):
        (y1, x1), (y2, x2) = (map(math.radians, at[i]) for i in (a, b))
        return 2 * 6371008.8 * math.asin(math.sqrt(min(1, math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))

    for i, near in want.items():
        mine = got["z", i]
        assert [x[2] for x in mine] == [1, 2, 3, 4, 5]
        # Ids are equal, but where two distances differ by less than the libraries' sines do.
        for a, b in zip(mine, near):
            assert a[0] == b[0] or abs(metres(i, a[0]) - metres(i, b[0])) < 1e-6 * max(1.0, b[1] / 1e6), (i, a, b)


def test_pairs_do_not_grow_with_the_square(spark, monkeypatch):
    pairs = []
    real = nearest._looked_up
    monkeypatch.setattr(nearest, "_looked_up", lambda *a: pairs.append(real(*a).cache()) or pairs[-1])
    monkeypatch.setattr(nearest, "discard", lambda *a: None)
    counts = []
    for n in (3000, 9000):
        rows = crowded(n, 5)
        assert nearest.neighbours_of_many(spark.createDataFrame(rows, POINT).repartition(8)).count() == 5 * n
        counts.append(pairs[-1].count())
    assert counts[1] < 4.5 * counts[0] and counts[1] < 0.1 * 6000**2, counts  # some 6000 places; squares would be nine times as many


def test_cells_visited_hold_the_ball(spark):
    r = random.Random(4)
    turns = [(math.radians(r.uniform(-90, 90)), math.radians(r.uniform(-180, 180))) for _ in range(400)]
    globe = [(math.cos(a) * math.cos(b), math.cos(a) * math.sin(b), math.sin(a)) for a, b in turns]
    rows = [("c", "z", float(i), 0.0, *p, own) for i, p in enumerate(globe) for own in (2, 4)]
    asking = spark.createDataFrame(rows, "citta string, zona string, lat double, lon double, x double, y double, z double, own int").repartition(3)
    places = spark.createDataFrame([("c", "z", float(i), 0.0, *p, [str(i)]) for i, p in enumerate(globe)], "citta string, zona string, lat double, lon double, x double, y double, z double, ids array<string>")
    near = nearest._looked_up(places, asking, [2, 4])
    assert "BroadcastHashJoin" not in (plan := near._jdf.queryExecution().executedPlan().toString()) and plan.count("floor") < 20, plan
    got = {(x.level, x.qlat, x.lat) for x in near.collect()}
    for own in (2, 4):
        for i, p in enumerate(globe):
            for j, q in enumerate(globe):
                if math.dist(p, q) <= 2.0 ** (1 - own) * math.sqrt(3):
                    assert (own, float(i), float(j)) in got


def test_no_points(spark):
    empty = spark.createDataFrame([], POINT)
    assert nearest.neighbours_of_many(empty).collect() == []


def test_boxes_of_all_sizes(spark):
    r = random.Random(8)
    boxes = [("c", f"z{i}", la, lo, la + h, lo + w) for i, (la, lo, h, w) in enumerate(map(float, x) for x in [(41, 12, 0.01, 0.02), (35, 5, 10, 10), (-90, -180, 180, 360), (41.005, 12.005, 0, 0), (40, 11, 3, 0.0001), (42, 13, -1, 1)])]
    zones = spark.createDataFrame(boxes, "citta string, zona string, a double, b double, c double, d double").selectExpr("citta", "zona", "named_struct('min_lat', a, 'min_lon', b, 'max_lat', c, 'max_lon', d) AS bbox")
    rows = [(i, *(r.choice([(41.005, 12.005), (r.uniform(41, 41.02), r.uniform(12, 12.03)), (r.uniform(-90, 90), r.uniform(-180, 180))])), {"k": "v"}) for i in range(900)] + [(-1, None, 1.0, None)]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, tags map<string, string>")
    want = sorted((i, z) for i, y, x, _ in rows if y is not None for _, z, a, b, c, d in boxes if a <= y <= c and b <= x <= d)
    for hot in (1_000_000, 10):
        got = poi.in_boxes(points, zones, hot)
        assert got.columns == ["id", "lat", "lon", "tags", "citta", "zona"]
        assert sorted((p.id, p.zona) for p in got.collect()) == want
    assert poi.in_boxes(points, zones.limit(0)).collect() == [] and poi.in_boxes(points.limit(0), zones).collect() == []
