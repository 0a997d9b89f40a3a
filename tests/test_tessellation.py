"""Tessellated boundaries against whole rings, for shapes that are large, odd or lie on cell borders."""

import math
import random

import pytest
from pyspark.sql import functions as F

from contrada.functions import geo
from contrada.operators import coverage, tessellation

SHAPE = "citta string, polygons array<array<array<struct<lon: double, lat: double>>>>"


def ring(points):
    return [{"lon": float(x), "lat": float(y)} for x, y in points]


def circle(n, radius, cx=12.0, cy=41.0, wave=0.0, k=7):
    return ring((cx + (radius + wave * math.sin(k * t)) * math.cos(t), cy + (radius + wave * math.sin(k * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n)))


def square(a, b):
    return ring([(a, a), (b, a), (b, b), (a, b)])


def spikes(n, r):
    return ring((12 + (0.2 if i % 2 else 0.001 + r.random() * 1e-3) * math.cos(2 * math.pi * i / n), 41 + (0.2 if i % 2 else 0.002) * math.sin(2 * math.pi * i / n)) for i in range(n))


r = random.Random(4)
SHAPES = {
    "holes": [[square(0.0, 4.0), square(1.0, 3.0), square(3.25, 3.5)], [square(10.0, 12.0)]],
    "overlapping": [[square(0.0, 4.0)], [square(2.0, 6.0), square(2.5, 3.5)]],
    "wavy": [[circle(5000, 0.1, wave=0.02, k=61), circle(800, 0.02)]],
    "spikes": [[spikes(301, r)]],
    "star": [[ring((12 + 0.1 * math.cos(4 * math.pi * i / 5), 41 + 0.1 * math.sin(4 * math.pi * i / 5)) for i in range(5))]],
    "thin": [[ring([(0, 0), (50, 0.0001), (50, 0.0002), (0, 0.0001)])]],
    "line": [[ring([(0, 0), (1, 1)])]],
    "dot": [[ring([(1, 1)])], []],
    "bow": [[ring([(0, 0), (1, 1), (1, 0), (0, 1)])]],
    "random": [[ring((r.uniform(0, 1), r.uniform(0, 1)) for _ in range(60)), ring((r.uniform(0, 1), r.uniform(0, 1)) for _ in range(20))]],
    "far": [[ring([(-170.5, -80.25), (179.75, -79), (170, 85), (-100, 60.5)])]],
    "stairs": [[ring([(i // 2 / 8, (i + 1) // 2 / 8) for i in range(64)] + [(4, 0)])]],
    "nothing": None,
    "empty": [],
}


def points_of(name, polygons):
    corners = [(q["lon"], q["lat"]) for p in polygons or [] for one in p for q in one]
    out = [(0.0, 0.0), (0.5, 0.5), (2.0, 2.0), (12.0, 41.0), (500.0, 500.0), (None, 1.0), (1.0, None)]
    if corners:
        xs, ys = [c[0] for c in corners], [c[1] for c in corners]
        some = r.sample(corners, min(60, len(corners)))
        out += some + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(some, some[1:])] + [(x, y) for x, _ in some[:12] for _, y in some[-12:]]
        out += [(math.nextafter(x, 1e9), math.nextafter(y, -1e9)) for x, y in some]
        out += [(r.uniform(min(xs) - 0.01, max(xs) + 0.01), r.uniform(min(ys) - 0.01, max(ys) + 0.01)) for _ in range(400)]
        out += [(i / 8, j / 8) for i in range(-2, 40, 3) for j in range(-2, 40, 3)]
    return [(name, i, x, y) for i, (x, y) in enumerate(out)]


@pytest.fixture(scope="module")
def shapes(spark):
    return spark.createDataFrame(list(SHAPES.items()), SHAPE)


def test_equal_to_whole_rings(spark, shapes):
    rows = [p for n, s in SHAPES.items() for p in points_of(n, s)] + [("no city", 1, 0.5, 0.5), (None, 2, 0.5, 0.5)]
    points = spark.createDataFrame(rows, "citta string, i long, lon double, lat double").repartition(5)
    whole = points.join(shapes, "citta", "left").select("citta", "i", F.coalesce(geo.in_polygons(F.col("polygons"), F.col("lat"), F.col("lon")), F.lit(False)).alias("inside"))
    key = lambda row: (str(row[0]), row[1])
    want, got = (sorted(map(tuple, df.select("citta", "i", "inside").collect()), key=key) for df in (whole, coverage.inside(points, shapes)))
    null = {(p[0], p[1]) for p in rows if p[2] is None or p[3] is None}  # whole rings: undefined there
    assert [w for w in want if w[:2] not in null] == [g for g in got if g[:2] not in null]
    assert all(not g[2] for g in got if g[:2] in null) and len(got) == len(rows) and any(g[2] for g in got)


def test_a_large_boundary_is_small_in_every_cell(spark):
    n = 100_000
    shape = spark.createDataFrame([("c", [[circle(n, 0.2, wave=0.01, k=301), circle(20_000, 0.05)]])], SHAPE)
    cells = tessellation.tessellated(shape)
    per = cells.select(F.coalesce(F.aggregate("rings", F.lit(0), lambda k, x: k + F.size(x["sides"])), F.lit(0)).alias("k")).agg(F.max("k"), F.sum("k"), F.count(F.lit(1))).first()
    assert per[0] <= 3000 and per[1] <= 8 * 1.2 * n + 4096 and per[2] <= 8 * n
    rows = [("c", i, 12 + r.uniform(-0.25, 0.25), 41 + r.uniform(-0.25, 0.25)) for i in range(3000)]
    points = spark.createDataFrame(rows, "citta string, i long, lon double, lat double")
    got = {x.i: x.inside for x in tessellation.placed_in(points, cells).collect()}
    want = {x.i: x.inside for x in coverage.inside_vectorised(points, shape).collect()}
    assert got == want and 500 < sum(got.values()) < 2500
    share = cells.filter("rings is null").count() / cells.count()
    assert share > 0.3  # much of the area is decided without a side


def test_one_city_is_many_keys(spark, shapes):
    rows = [("wavy", i, 12 + r.uniform(-0.1, 0.1), 41 + r.uniform(-0.1, 0.1)) for i in range(2000)]
    points = spark.createDataFrame(rows, "citta string, i long, lon double, lat double")
    plan = tessellation.placed_in(points, tessellation.tessellated(shapes).hint("shuffle_hash"))._jdf.queryExecution().executedPlan().toString()
    assert "__c" in plan.split("ShuffledHashJoin")[1][:200]
