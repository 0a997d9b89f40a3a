"""Columns of coordinates, boxes and polygons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius in metres.
RADIUS = 6_371_008.8
#: Least half side of a zone's box, in degrees.
HALF_SPAN = 0.0045


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def box(min_lat, min_lon, max_lat, max_lon) -> Column:
    return F.struct(min_lat.alias("min_lat"), min_lon.alias("min_lon"), max_lat.alias("max_lat"), max_lon.alias("max_lon"))


def parsed_box(texts) -> Column:
    """Of four numbers as texts, lat_min, lat_max, lon_min, lon_max: a box; null where there are not four or one is no number."""
    x = F.transform(texts, lambda t: t.try_cast("double"))
    whole = (F.size(x) == 4) & ~F.exists(x, lambda v: v.isNull())
    return F.when(whole, box(F.get(x, 0), F.get(x, 2), F.get(x, 1), F.get(x, 3)))


def least_box(b, half_span: float = HALF_SPAN) -> Column:
    """The box, widened around its middle where a side is below twice half_span; never narrowed."""
    lat, lon = (b["min_lat"] + b["max_lat"]) / 2, (b["min_lon"] + b["max_lon"]) / 2
    return F.when(b.isNotNull(), box(F.least(b["min_lat"], lat - half_span), F.least(b["min_lon"], lon - half_span), F.greatest(b["max_lat"], lat + half_span), F.greatest(b["max_lon"], lon + half_span)))


def center(b) -> tuple[Column, Column]:
    return (b["min_lat"] + b["max_lat"]) / 2, (b["min_lon"] + b["max_lon"]) / 2


def valid_box(b) -> Column:
    return (b["max_lat"] > b["min_lat"]) & (b["max_lon"] > b["min_lon"])


def polygons_of(geojson) -> Column:
    """Polygons (rings of points lon, lat) of a GeoJSON geometry's text, a Polygon or a MultiPolygon; null for other types, and where any point has fewer than two coordinates or one that is no number."""
    kind, written = F.get_json_object(geojson, "$.type"), F.get_json_object(geojson, "$.coordinates")
    raw = F.from_json(F.when(kind == "Polygon", F.concat(F.lit("["), written, F.lit("]"))).when(kind == "MultiPolygon", written), "array<array<array<array<string>>>>")
    point = lambda p: F.struct(F.get(p, 0).try_cast("double").alias("lon"), F.get(p, 1).try_cast("double").alias("lat"))
    shapes = F.transform(raw, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    bad = lambda p: p["lon"].isNull() | p["lat"].isNull()
    broken = F.exists(shapes, lambda polygon: polygon.isNull() | F.exists(polygon, lambda ring: ring.isNull() | F.exists(ring, bad)))
    return F.when(F.coalesce(~broken, F.lit(False)), shapes)


def in_polygons(polygons, lat, lon) -> Column:
    """Whether a point is in any of the polygons (rings of points lon, lat; the first ring is the outer one, the others are holes), by the even-odd rule: sides are half open."""

    def crossings(ring):
        n = F.size(ring)

        def crosses(p, i):
            q = F.get(ring, F.pmod(i - 1, n))
            x = (q["lon"] - p["lon"]) * F.try_divide(lat - p["lat"], q["lat"] - p["lat"]) + p["lon"]
            return ((p["lat"] > lat) != (q["lat"] > lat)) & F.coalesce(lon < x, F.lit(False))

        return F.size(F.filter(ring, crosses)) % 2 == 1

    inside = lambda rings: crossings(F.get(rings, 0)) & ~F.exists(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), crossings)
    return F.exists(F.filter(polygons, lambda rings: F.size(rings) > 0), inside)
