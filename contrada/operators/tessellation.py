"""Polygons cut into grid cells, so that a point meets the few sides near it and not its city's whole boundary.

A point is inside a ring where an odd number of sides lie to its right (geo.in_polygons' rule). For a point of a cell, sides fall into
those left of its column (never counted), those that reach into it (kept in the cell and tested), and those right of it, of which only
the parity matters. As a ring is closed, that parity is the number, modulo 2, of corners above the point where a side right of
the column meets one that is not: corners in rows above the cell are counted into its `base`, those in its own row are kept as `turns`.
So the answer is the one of the whole ring, at every point and for every floating-point tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Sides in cells, and cells, that a boundary may have for each of its vertices (and FREE more): finer grids are not taken.
SIDES, CELLS, FREE = 8, 4, 4096
#: Cell sizes tried from the finest on, each twice the one before.
SIZES = 13
#: A side reaches so far beyond its ends, in its own coordinates' size: more than rounding can move a crossing.
MARGIN = 1e-9
#: Boundaries whose grids (a city and a size each) are sent to all workers; more are joined as Spark decides.
SENT_GRIDS = 200_000

_KEY = ["citta", "__c", "__b"]


def _cell(x: Column, size) -> Column:
    return F.floor(x / size).cast("long")


def sides(boundaries: DataFrame) -> DataFrame:
    """One row for each side of each ring of boundaries (citta, polygons): polygon p, ring r (0 is the outer one), corner (x, y), the one before (px, py) and the one after (nx)."""
    at = lambda ring, i: F.get(ring, F.pmod(i, F.size(ring)))
    rings = boundaries.select("citta", F.posexplode("polygons").alias("p", "polygon")).select("citta", "p", F.posexplode("polygon").alias("r", "ring"))
    corners = F.transform("ring", lambda q, i: F.struct(q["lon"].alias("x"), q["lat"].alias("y"), at(F.col("ring"), i - 1).alias("a"), at(F.col("ring"), i + 1)["lon"].alias("nx")))
    return rings.select("citta", "p", "r", F.inline(corners)).select("citta", "p", "r", "x", "y", F.col("a.lon").alias("px"), F.col("a.lat").alias("py"), "nx")


def _reach(s: DataFrame, size) -> dict[str, Column]:
    """Columns and rows that a side reaches: c0 to c1, b0 to b1; and d0, the first column of the side after it."""
    x, y, px, py, nx = (F.col(c) for c in ("x", "y", "px", "py", "nx"))
    room = lambda *v: F.greatest(F.lit(1.0), *[F.abs(k) for k in v]) * MARGIN
    return {
        "c0": _cell(F.least(x, px) - room(x, px), size), "c1": _cell(F.greatest(x, px) + room(x, px), size),
        "b0": _cell(F.least(y, py), size), "b1": _cell(F.greatest(y, py), size), "d0": _cell(F.least(x, nx) - room(x, nx), size),
    }


def grids(s: DataFrame) -> DataFrame:
    """Of each city's sides the size of its cells: the finest of SIZES powers of two whose cells hold at most SIDES sides for each vertex in all."""
    span = lambda c: F.max(c) - F.min(c)
    box = s.groupBy("citta").agg(F.count(F.lit(1)).alias("n"), span("x").alias("w"), span("y").alias("h"))
    cells = F.col("n") * CELLS + 64
    least = F.greatest(F.sqrt(F.col("w") * F.col("h") / cells), F.greatest("w", "h") / cells, F.lit(2.0**-40))
    finest = box.select("citta", "n", F.pow(F.lit(2.0), F.ceil(F.log2(least))).alias("finest"))
    joined = s.join(finest, "citta")

    def cost(d: int) -> Column:
        r = _reach(joined, F.col("finest") * float(1 << d))
        return F.sum((r["c1"] - r["c0"] + 1).cast("double") * (r["b1"] - r["b0"] + 1))

    costs = joined.groupBy("citta", "n", "finest").agg(*[cost(d).alias(f"cost{d}") for d in range(SIZES)])
    fits = [F.when(F.col(f"cost{d}") <= F.col("n") * SIDES + FREE, F.col("finest") * float(1 << d)) for d in range(SIZES)]
    return costs.select("citta", F.coalesce(*fits, F.col("finest") * float(1 << (SIZES - 1))).alias("__size"))


def _odd(ring: Column, lat: Column, lon: Column) -> Column:
    """Whether a point of the cell is inside a ring (base, turns, sides)."""

    def crosses(q):
        x = (q["px"] - q["x"]) * F.try_divide(lat - q["y"], q["py"] - q["y"]) + q["x"]
        return ((q["y"] > lat) != (q["py"] > lat)) & F.coalesce(lon < x, F.lit(False))

    above = F.size(F.filter(ring["turns"], lambda v: v > lat))
    return (ring["base"] + above + F.size(F.filter(ring["sides"], crosses))) % 2 == 1


def within(rings: Column, lat: Column, lon: Column) -> Column:
    """Whether a point is in any polygon of a cell's rings: inside an outer ring and in none of its holes."""
    odd = F.filter(rings, lambda ring: _odd(ring, lat, lon))
    return F.exists(odd, lambda a: (a["r"] == 0) & ~F.exists(odd, lambda b: (b["p"] == a["p"]) & (b["r"] > 0)))


def tessellated(boundaries: DataFrame) -> DataFrame:
    """Cells of boundaries (citta, polygons; finite coordinates): citta, __size, __c, __b, rings (null where the whole cell is inside). Cells that are wholly outside have no row. Written: it is computed once.

    Rows, and sides in them, are at most some tens for each vertex, whatever the shapes. The largest group is the sides of one cell.
    """
    s = sides(boundaries)
    placed = s.join(grids(s), "citta")
    reach = placed.withColumns(_reach(placed, F.col("__size")))
    near = reach.filter("y <> py").select("citta", "__size", "p", "r", F.struct("x", "y", "px", "py").alias("side"), F.explode(F.sequence("c0", "c1")).alias("__c"), "b0", "b1")
    near = near.select("citta", "__size", "p", "r", "side", "__c", F.explode(F.sequence("b0", "b1")).alias("__b"))
    turns = reach.filter("c0 <> d0").select("citta", "__size", "p", "r", F.col("y").alias("turn"), _cell(F.col("y"), F.col("__size")).alias("__b"), F.explode(F.sequence(F.least("c0", "d0"), F.greatest("c0", "d0") - 1)).alias("__c"))
    ring = ["citta", "__size", "p", "r", "__c"]
    between = turns.groupBy(*ring).agg(F.min("__b").alias("lo"), F.max("__b").alias("hi")).select(*ring, F.explode(F.sequence("lo", "hi")).alias("__b"))
    every = near.unionByName(turns, allowMissingColumns=True).unionByName(between, allowMissingColumns=True)
    own = every.groupBy(*ring, "__b").agg(F.collect_list("side").alias("sides"), F.collect_list("turn").alias("turns"))
    above = Window.partitionBy(*ring).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    counted = own.withColumn("base", F.coalesce(F.sum(F.size("turns")).over(above), F.lit(0)) % 2)
    kept = counted.filter((F.col("base") == 1) | (F.size("sides") > 0) | (F.size("turns") > 0))
    cells = kept.groupBy("citta", "__size", "__c", "__b").agg(F.collect_list(F.struct("p", "r", "base", "turns", "sides")).alias("rings"))
    constant = ~F.exists("rings", lambda x: (F.size(x["sides"]) > 0) | (F.size(x["turns"]) > 0))
    whole = within(F.col("rings"), F.lit(0.0), F.lit(0.0))  # without sides and turns any point will do
    return stored(cells.withColumn("__k", constant).filter(~F.col("__k") | whole).select("citta", "__size", "__c", "__b", F.when(~F.col("__k"), F.col("rings")).alias("rings")), "cells")


def placed_in(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds inside to points (citta, lat, lon), from tessellated() cells: points meet cells by city, column and row, so a city of many points is many keys. A city's cell size is looked up first, in a table of two numbers a city."""
    sizes = cells.select("citta", "__size").distinct()
    if sizes.count() <= SENT_GRIDS:
        sizes = F.broadcast(sizes)
    at = points.join(sizes, "citta", "left").withColumns({"__c": _cell(F.col("lon"), F.col("__size")), "__b": _cell(F.col("lat"), F.col("__size"))}).drop("__size")
    met = at.join(cells.select(*_KEY, "rings", F.lit(True).alias("__in")), _KEY, "left")
    inside = F.when(F.col("__in").isNull(), False).when(F.col("rings").isNull(), True).otherwise(within(F.col("rings"), F.col("lat"), F.col("lon")))
    return met.withColumn("inside", F.coalesce(inside, F.lit(False))).drop("__c", "__b", "__in", "rings")
