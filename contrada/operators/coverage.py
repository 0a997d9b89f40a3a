"""Coverage of a city: declared classes, boundary, pass marks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.mapping import GENERIC
from . import tessellation

VERBATIM, DERIVED, BOUNDARY, SWITCH_MS = 0.50, 0.70, 0.90, 5000
#: Vertices of all boundaries up to which they are sent to every worker: some 32 MB.
SENT_VERTICES = 2_000_000


def inside(points: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Adds inside: whether a point is within its own city's boundary (citta, polygons); false without one, and without coordinates. The boundaries are cut into cells once; a point is tested against the sides near it."""
    return tessellation.placed_in(points, tessellation.tessellated(boundaries))


def inside_vectorised(points: DataFrame, boundaries: DataFrame, most: int = SENT_VERTICES) -> DataFrame:
    """inside() for boundaries of many vertices: the same rule over batches of points in numpy. Boundaries go to each worker once; where they have over `most` vertices in all, inside() and its cells take their place."""
    ring = lambda polygon: F.aggregate(polygon, F.lit(0), lambda n, r: n + F.size(r))
    vertices = boundaries.agg(F.sum(F.aggregate("polygons", F.lit(0), lambda n, polygon: n + ring(polygon)))).first()[0] or 0
    if vertices > most:
        return inside(points, boundaries)
    corners = lambda r: (np.array([p["lon"] for p in r], float), np.array([p["lat"] for p in r], float))
    shapes = {b["citta"]: [[corners(r) for r in polygon] for polygon in b["polygons"] or () if polygon] for b in boundaries.select("citta", "polygons").collect()}
    sent = points.sparkSession.sparkContext.broadcast(shapes)

    def holds(ring, x, y):
        px, py = ring
        qx, qy = np.roll(px, 1), np.roll(py, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = (qx - px) * (y[:, None] - py) / (qy - py) + px
        return (((py > y[:, None]) != (qy > y[:, None])) & (x[:, None] < cross)).sum(1) % 2 == 1

    @F.pandas_udf("boolean")
    def within(lat: pd.Series, lon: pd.Series, city: pd.Series) -> pd.Series:
        out = np.zeros(len(lat), bool)
        for c in city.dropna().unique():
            for own in np.array_split(rows := np.flatnonzero((city == c).to_numpy()), max(1, len(rows) // 256)):
                y, x = lat.to_numpy(float)[own], lon.to_numpy(float)[own]
                for outer, *holes in sent.value.get(c, ()):
                    out[own] |= holds(outer, x, y) & ~np.any([holds(h, x, y) for h in holes], axis=0)
        return pd.Series(out)

    return points.withColumn("inside", within("lat", "lon", "citta"))


def city_records(points: DataFrame, declared: DataFrame, captures: DataFrame) -> DataFrame:
    """One row for each captured city (captures: citta, switch_ms, bbox): shares of points of declared classes, of mapped ones and within the boundary (inside), and the pass marks; without points the shares are 0."""
    known = points.join(declared.select("terminus_class").withColumn("__d", F.lit(True)), "terminus_class", "left")
    share = lambda flag: F.avg(flag.cast("double"))
    verbatim = F.coalesce("__d", F.lit(False)) & (F.col("terminus_class") != GENERIC)
    shares = known.groupBy("citta").agg(F.count(F.lit(1)).alias("n_pois"), share(verbatim).alias("verbatim"), share(F.col("terminus_class") != GENERIC).alias("derived"), share(F.col("inside")).alias("boundary"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("verbatim", "derived", "boundary")]
    rows = captures.join(shares, "citta", "left").select("citta", "switch_ms", geo.valid_box(F.col("bbox")).alias("bbox_valid"), F.coalesce("n_pois", F.lit(0)).alias("n_pois"), *zero)
    marks = {"pass_verbatim": F.col("verbatim") >= VERBATIM, "pass_derived": F.col("derived") >= DERIVED, "pass_boundary": F.col("boundary") >= BOUNDARY, "pass_switch": F.col("switch_ms") < SWITCH_MS}
    return rows.withColumns(marks).withColumn("pass_all", F.col("pass_verbatim") & F.col("pass_derived") & F.col("pass_boundary") & F.col("pass_switch"))


def city_report(records: DataFrame, failed: DataFrame) -> DataFrame:
    """Records and the failed captures (citta), whose measures are null and which do not pass."""
    return records.withColumn("failed", F.lit(False)).unionByName(failed.select("citta").withColumn("pass_all", F.lit(False)).withColumn("failed", F.lit(True)), allowMissingColumns=True)


def report_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("n_cities"), F.count_if("pass_all").alias("n_pass_all"), F.count_if("failed").alias("n_failed"))
