"""The fixed binding of map tags to ontology classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class of a tag that the binding does not cover.
GENERIC = "GenericUrbanPOI"

# Selectors and their classes, as a dimension table would hold them.
CLASS_OF = {
    "amenity=bank": "Bank", "amenity=atm": "Bank", "amenity=bureau_de_change": "Bank", "amenity=hospital": "Hospital", "amenity=clinic": "Hospital",
    "amenity=pharmacy": "Pharmacy", "amenity=police": "National_police", "amenity=fire_station": "Fire_station", "amenity=townhall": "Town_hall",
    "amenity=courthouse": "Government_office", "amenity=embassy": "Government_office", "amenity=prison": "Prison", "amenity=school": "School",
    "amenity=college": "School", "amenity=kindergarten": "Kindergarten", "amenity=library": "Public_building", "amenity=community_centre": "Public_building",
    "amenity=place_of_worship": "Place_of_worship", "amenity=marketplace": "Marketplace", "amenity=fuel": "Petrol_station", "amenity=bus_station": "Bus_stops",
    "amenity=post_office": "Post_office", "amenity=cinema": "Cinema",
    "shop=mall": "Shopping_center", "shop=department_store": "Shopping_center", "shop=supermarket": "Shopping_center", "shop=jewelry": "Jewellery",
    "shop=tobacco": "Tobacco_store", "shop=gas": "Gas_cylinder_dealer", "shop=fireworks": "Pyrotechnic_material_for_sale",
    "tourism=museum": "Museum", "tourism=gallery": "Museum", "tourism=attraction": "Historical_monument",
    "historic=archaeological_site": "Archaeological_site", "historic=monument": "Historical_monument", "historic=memorial": "Historical_monument",
    "historic=castle": "Historical_monument", "historic=fort": "Historical_monument", "historic=ruins": "Historical_monument",
    "leisure=playground": "Playground", "leisure=beach_resort": "Beach_resort", "leisure=grandstand": "Grandstand",
    "aeroway=helipad": "Helipad", "aeroway=heliport": "Helipad",
    "railway=station": "Railway_station", "railway=halt": "Railway_station", "railway=subway_entrance": "Railway_station",
    "man_made=pier": "Pier", "man_made=lighthouse": "Lighthouse", "man_made=pipeline": "Pipeline", "man_made=silo": "Silo",
    "man_made=storage_tank": "Storage_tank", "man_made=tank": "Storage_tank", "man_made=water_works": "Drinking_water_system", "man_made=water_tower": "Drinking_water_system",
    "power=substation": "Electrical_substation", "power=generator": "Electric_generator", "power=line": "Transmission_line", "power=tower": "Transmission_line",
    "building=warehouse": "Warehouse", "office=government": "Government_office",
    "highway=bus_stop": "Bus_stops", "highway=motorway_junction": "Highways_and_junctions",
    "natural=wood": "Wooded_area", "landuse=forest": "Wooded_area",
}

# Families of tags, the most telling first.
FAMILIES = ("amenity", "shop", "tourism", "historic", "leisure", "aeroway", "railway", "man_made", "power", "building", "office", "highway", "natural", "landuse")

SELECTORS = tuple(CLASS_OF)


def mapping(spark: SparkSession) -> DataFrame:
    """selector, family, family_rank, terminus_class: one row for each selector of the binding."""
    rows = [(s, s.split("=")[0], FAMILIES.index(s.split("=")[0]), c) for s, c in CLASS_OF.items()]
    return spark.createDataFrame(rows, "selector string, family string, family_rank int, terminus_class string")
