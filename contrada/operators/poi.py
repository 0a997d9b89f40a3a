"""Points of interest: reading elements, class, dedup, caps, retrieval in a box and selection, for all zones at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.mapping import FAMILIES, GENERIC, SELECTORS, mapping
from ..sources.stored import stored

MAX_POIS, PER_CLASS, PER_SELECTOR = 20, 3, 10
#: Cells that a box is wide at most (one more where it begins within one), and points of a cell for one task of the retrieval join.
SPAN, HOT_CELL = 8, 1_000_000


def coordinates(lat, lon, mid) -> tuple[Column, Column]:
    """An element's own coordinates, else both of its middle; else null."""
    own = lat.isNotNull() & lon.isNotNull()
    whole = mid["lat"].isNotNull() & mid["lon"].isNotNull()
    return (F.when(own, a).when(whole, b) for a, b in ((lat, mid["lat"]), (lon, mid["lon"])))


def representative_tag(tags) -> Column:
    """The first family's tag that the binding has, as key=value; else ''. A lookup among literals: no join."""
    options = F.transform(F.array(*map(F.lit, FAMILIES)), lambda f: F.concat(f, F.lit("="), tags[f]))
    return F.coalesce(F.get(F.filter(options, lambda s: F.array_contains(F.array(*map(F.lit, SELECTORS)), s)), 0), F.lit(""))


def usable(elements: DataFrame) -> DataFrame:
    """Elements (type, id, lat, lon, center, tags) with tags and coordinates, as points: name ('' if none), lat, lon, osm_tags; other columns stay."""
    lat, lon = coordinates(F.col("lat"), F.col("lon"), F.col("center"))
    rows = elements.select(*[c for c in elements.columns if c not in ("lat", "lon", "center", "tags")], lat.alias("lat"), lon.alias("lon"), "tags")
    kept = rows.filter("tags is not null and lat is not null and lon is not null")
    return kept.withColumn("name", F.coalesce(F.col("tags")["name"], F.lit(""))).withColumn("osm_tags", representative_tag(F.col("tags")))


def first_of_each(points: DataFrame, keys: tuple[str, ...] = ("citta", "zona", "type", "id"), order: str = "emit_pos") -> DataFrame:
    """Of points with the same keys the first one; after usable(), so an unusable copy does not hide a usable one."""
    w = Window.partitionBy(*keys).orderBy(order)
    return points.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def classified(points: DataFrame) -> DataFrame:
    """Adds terminus_class; tags outside the binding are of the generic class. The binding is a table of fixed size."""
    binding = F.broadcast(mapping(points.sparkSession).select(F.col("selector").alias("osm_tags"), F.col("terminus_class").alias("__c")))
    return points.join(binding, "osm_tags", "left").withColumn("terminus_class", F.coalesce("__c", F.lit(GENERIC))).drop("__c")


def fingerprint_of_selectors(selectors: DataFrame) -> DataFrame:
    """sha256 of the sorted selectors, a line each, and their number."""
    return selectors.agg(F.sha2(F.array_join(F.array_sort(F.collect_set("selector")), "\n"), 256).alias("selectors_hash"), F.countDistinct("selector").alias("n_selectors"))


def capped_by_selector(points: DataFrame, cap: int = PER_SELECTOR) -> DataFrame:
    """Points that any of their selectors keeps: of each zone and selector (an array column) the first `cap` by type and id."""
    w = Window.partitionBy("citta", "zona", "selector").orderBy("type", "id")
    kept = points.withColumn("selector", F.explode("selectors")).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap)
    return kept.select("citta", "zona", "type", "id").distinct()


def in_boxes(points: DataFrame, zones: DataFrame, hot: int = HOT_CELL) -> DataFrame:
    """Points (lat, lon) with the zones (citta, zona, bbox) whose box holds them; a point may be in several.

    A box is covered by cells of its own size, a power of two of degrees of which it is at most SPAN wide, so a country's box has no more
    cells than a street's; a point is looked up once for each size in use. Cells of over `hot` points are dealt to several tasks by a
    hash of the point's columns, their boxes to each. Then the box decides. A box whose ends are the wrong way round holds nothing.
    """
    b = F.col("bbox")
    grid = lambda x: F.floor(x / F.col("__s")).cast("long")
    side = F.greatest(b["max_lat"] - b["min_lat"], b["max_lon"] - b["min_lon"], F.lit(2.0**-20))
    sized = zones.select("citta", "zona", "bbox").filter((b["min_lat"] <= b["max_lat"]) & (b["min_lon"] <= b["max_lon"])).withColumn("__s", F.pow(F.lit(2.0), F.ceil(F.log2(side / SPAN))))
    cells = (
        sized.withColumn("__y", F.explode(F.sequence(grid(b["min_lat"]), grid(b["max_lat"]))))
        .withColumn("__x", F.explode(F.sequence(grid(b["min_lon"]), grid(b["max_lon"]))))
    )
    sizes = [r["__s"] for r in sized.select("__s").distinct().collect()]  # powers of two between a metre and the globe: some thirty at most
    if not sizes:
        return points.join(cells.limit(0).drop("__s", "__y", "__x"), F.lit(True)).drop("bbox")
    key = ["__s", "__y", "__x"]
    placed = points.withColumn("__s", F.explode(F.array(*[F.lit(s) for s in sorted(sizes)]))).withColumn("__y", grid(F.col("lat"))).withColumn("__x", grid(F.col("lon")))
    full = stored(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("__n")), "hot-cells")
    if not full.isEmpty():
        parts = F.coalesce("__n", F.lit(1))
        told = [c for c, t in points.dtypes if "map<" not in t and "variant" not in t]
        placed = placed.join(full, key, "left").withColumn("__p", F.pmod(F.xxhash64(*told), parts).cast("int")).drop("__n")
        cells = cells.join(full, key, "left").withColumn("__p", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__n")
        key = [*key, "__p"]
    inside = F.col("lat").between(b["min_lat"], b["max_lat"]) & F.col("lon").between(b["min_lon"], b["max_lon"])
    return placed.join(cells, key).filter(inside).drop(*key, "bbox")


def selected(points: DataFrame, centers: DataFrame, max_pois: int = MAX_POIS, per_class: int = PER_CLASS) -> DataFrame:
    """Of each zone the nearest points to its center (lat0, lon0), at most max_pois: first those within the cap of their class, then the nearest of the rest; position is by distance, from 1.

    Ties go to the smaller id as text, then type and emit_pos. A row beyond max_pois of its own class is never chosen, so it goes before
    the window over the whole zone.
    """
    order = ["dist", F.col("id").cast("string"), "type", "emit_pos"]
    near = points.join(centers, ["citta", "zona"]).withColumn("dist", geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))).drop("lat0", "lon0")
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy("citta", "zona", "terminus_class").orderBy(*order))).filter(F.col("__r") <= max_pois)
    zone = Window.partitionBy("citta", "zona")
    kept = ranked.withColumn("__k", F.row_number().over(zone.orderBy(F.col("__r") > per_class, *order))).filter(F.col("__k") <= max_pois)
    return kept.withColumn("position", F.row_number().over(zone.orderBy(*order))).drop("__r", "__k")


def evidence(name) -> Column:
    """verificato for a point with a name, else da_confermare."""
    return F.when(text.filled(name), F.lit("verificato")).otherwise(F.lit("da_confermare"))


def of_class(points: DataFrame, wanted: str | None) -> DataFrame:
    """Points of a class; blank or None: all."""
    wanted = (wanted or "").strip()
    return points.filter(F.col("terminus_class") == wanted) if wanted else points


def envelope(points: DataFrame) -> DataFrame:
    """Of each zone the least and largest coordinates."""
    return points.groupBy("citta", "zona").agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def uncovered(classes: DataFrame) -> DataFrame:
    """Declared classes (terminus_class) that no selector maps to."""
    return classes.select("terminus_class").distinct().join(F.broadcast(mapping(classes.sparkSession).select("terminus_class").distinct()), "terminus_class", "left_anti")
