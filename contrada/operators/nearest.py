"""The k nearest of each point of a zone that holds any number of them, without pairs of all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.stored import discard, stored

ZONE = ["citta", "zona"]
PLACE = [*ZONE, "lat", "lon"]
#: Levels of the grid: at level n the cube round the globe is 2^n cells wide, at 30 some centimetres.
LEVELS = tuple(range(31))
CELL = ["level", "cx", "cy", "cz"]
#: Cells of more places than this are left out where only small cells are looked for.
CROWDED = 1000
VISIT = "citta string, zona string, level int, qlat double, qlon double, qx double, qy double, qz double, cx long, cy long, cz long, radius double"
#: Places that are looked at together, each with its 125 cells.
_SLICE = 1000


def _globe(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A place on the unit globe: distances along the chord grow with those on the ground, at the date line and the poles too."""
    a, b = F.radians(lat), F.radians(lon)
    return F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)


def _at_levels(places: DataFrame, levels) -> DataFrame:
    """A row for each place and level, with the cell that holds it."""
    out = places.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    scale = F.pow(F.lit(2.0), F.col("level") - 1)
    return out.withColumns({c: F.floor((F.col(x) + 1) * scale).cast("long") for c, x in (("cx", "x"), ("cy", "y"), ("cz", "z"))})


def _visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells of its own level that the ball round each asking place meets, as VISIT. Whole columns at a time: as one expression over 125 cells a place it was most of the work."""
    # Cells from two before to two behind: the diagonal is 1.74 cells long. Of them those that the ball meets and that touch the globe.
    around = np.stack([d.ravel() for d in np.meshgrid(*[np.arange(-2, 3)] * 3, indexing="ij")])
    room = 1e-9
    for whole in batches:
        for at in range(0, len(whole), _SLICE):
            b = whole.slice(at, _SLICE)
            place = np.stack([np.asarray(b.column(v)) for v in ("x", "y", "z")])
            size = np.exp2(1.0 - np.asarray(b.column("own")))
            radius = size * math.sqrt(3) * (1 + room) + room * room
            cells = np.floor((place + 1) / size)[:, :, None] + around[:, None]
            low = cells * size[:, None] - 1
            high = low + size[:, None]
            gap = np.maximum(np.maximum(low - place[:, :, None], place[:, :, None] - high), 0)
            least, most = np.maximum(np.maximum(low, -high), 0), np.maximum(np.abs(low), np.abs(high))
            meets = ((gap * gap).sum(0) <= (radius * radius)[:, None]) & ((least * least).sum(0) <= 1 + room) & ((most * most).sum(0) >= 1 - room)
            row, cell = np.nonzero(meets)
            own = b.take(pa.array(row))
            asked = [own.column(c) for c in ("citta", "zona", "own", "lat", "lon", "x", "y", "z")]
            columns = [*asked, *[pa.array(c[row, cell].astype(np.int64)) for c in cells], pa.array(radius[row])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in VISIT.split(", ")])


def _looked_up(places: DataFrame, asking: DataFrame, used: list[int]) -> DataFrame:
    """Places (lat, lon, x, y, z, ids) in the cells that the ball round an asking place (qlat, ...) meets, with the ball's radius."""
    asked = asking.select(*[F.col(c).cast("string") for c in ZONE], F.col("own").cast("int"), *[F.col(c).cast("double") for c in ("lat", "lon", "x", "y", "z")]).mapInArrow(_visits, VISIT)
    held = _at_levels(places, used)
    # Sorted on both sides: by its size on disk Spark may take the visits, some twenty for each place, for small enough to broadcast.
    return asked.hint("merge").join(held, [*ZONE, *CELL])


def neighbours_of_many(points: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest others of each point of its zone (citta, zona, id, lat, lon): citta, zona, poi_id, rank, neighbour_id, distance_m; by distance, then id. Points without coordinates are left out.

    Points at one place share a list, to which a place gives its k + 1 smallest ids. A place looks in the grid of its own level, the
    finest whose cell there holds more than k places of the zone: the k nearest are then within the cell's diagonal, and only cells that
    this ball meets are visited. So pairs grow with the points, and where a crowd lies beside a few, with few of them at each level.
    """
    zoned = points.filter("lat is not null and lon is not null").select(*ZONE, "id", "lat", "lon")
    first = Window.partitionBy(*PLACE).orderBy("id")
    few = zoned.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    x, y, z = _globe(F.col("lat"), F.col("lon"))
    places = stored(few.groupBy(*PLACE).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumns({"x": x, "y": y, "z": z}), "places")
    keys = [*ZONE, *CELL]
    spread = _at_levels(places.drop("ids"), LEVELS)
    counts = stored(spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "place-counts")
    # A small cell in a larger one of more than k places: its places look at the larger one's level. At the finest level all have that.
    enough = (F.col("n") > k) | (F.col("level") == 0)
    step = LEVELS[1] - LEVELS[0]
    inner = counts.filter(~enough).select(*keys, *[F.shiftright(c, step).alias(f"p{c}") for c in CELL[1:]])
    outer = counts.filter(enough).select(*ZONE, (F.col("level") + step).alias("level"), *[F.col(c).alias(f"p{c}") for c in CELL[1:]])
    small = inner.join(outer, [*ZONE, "level", *[f"p{c}" for c in CELL[1:]]]).select(*keys, (F.col("level") - step).alias("own"))
    finest = counts.filter(enough & (F.col("level") == LEVELS[-1])).select(*keys, F.col("level").alias("own"))
    crowded = counts.filter((F.col("n") > CROWDED) & (F.col("level") < LEVELS[-1])).select(*keys)
    levelled = spread.join(crowded, keys, "left_anti").join(small.union(finest), keys).select(*PLACE, "x", "y", "z", "own")
    asking = stored(levelled, "place-levels")
    used = sorted(r["own"] for r in asking.select("own").distinct().collect())  # at most as many as levels
    if not used:
        discard(places, counts, asking)
        return _no_rows(points)
    near = _looked_up(places, asking, used)
    chord = sum(((F.col(v) - F.col(f"q{v}")) * (F.col(v) - F.col(f"q{v}")) for v in ("x", "y", "z")), F.lit(0.0))
    near = near.filter(chord <= F.col("radius") * F.col("radius"))
    listed = near.select(*ZONE, "qlat", "qlon", geo.haversine(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")).alias("d"), F.explode("ids").alias("neighbour_id"))
    best = Window.partitionBy(*ZONE, "qlat", "qlon").orderBy("d", "neighbour_id")
    lists = listed.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).groupBy(*ZONE, F.col("qlat").alias("lat"), F.col("qlon").alias("lon")).agg(F.array_sort(F.collect_list(F.struct("d", "neighbour_id"))).alias("near"))
    others = F.slice(F.filter("near", lambda n: n["neighbour_id"] != F.col("id")), 1, k)
    rows = zoned.join(stored(lists, "nearest"), PLACE).select(*ZONE, F.col("id").alias("poi_id"), F.posexplode(others).alias("p", "n"))
    discard(places, counts, asking)
    return rows.select(*ZONE, "poi_id", (F.col("p") + 1).alias("rank"), "n.neighbour_id", F.bround("n.d", 0).cast("long").alias("distance_m"))


def _no_rows(points: DataFrame) -> DataFrame:
    return points.filter("false").select(*ZONE, F.col("id").alias("poi_id"), F.lit(1).alias("rank"), F.col("id").alias("neighbour_id"), F.lit(0).cast("long").alias("distance_m"))
