"""Source elements (id, type, tags map, ring) to routed and typed features. Projections and filters: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L

# Tag values that route an element to a category.
HIGHWAYS = tuple(L.ROADS)
WATERWAYS = ("river", "stream", "canal", "ditch", "drain")
LAND_USES = (
    "farmland", "meadow", "orchard", "vineyard", "residential", "industrial", "commercial", "retail", "quarry", "cemetery", "allotments",
    "recreation_ground", "military", "farmyard",
)
LEISURE = ("park", "garden", "pitch", "playground", "golf_course")
BARE = ("beach", "sand", "bare_rock", "scree", "grassland", "fell")
CATEGORIES = ("roads", "water", "forests", "buildings", "land_use")
# Building heights (m) and asset categories.
BUILDING_HEIGHTS = {
    "apartments": 15.0, "commercial": 12.0, "industrial": 8.0, "warehouse": 6.0, "church": 20.0, "residential": 6.0, "house": 6.0,
    "garage": 3.0, "shed": 3.0, "barn": 6.0,
}
BUILDING_ASSETS = {
    "residential": "Building_Residential", "house": "Building_House", "apartments": "Building_Apartments", "detached": "Building_House",
    "church": "Building_Church", "chapel": "Building_Church", "commercial": "Building_Commercial", "industrial": "Building_Industrial",
    "warehouse": "Building_Industrial", "garage": "Building_Garage", "garages": "Building_Garage", "barn": "Building_Barn",
    "farm": "Building_Barn", "farm_auxiliary": "Building_Shed", "shed": "Building_Shed", "school": "Building_Commercial",
    "hospital": "Building_Commercial", "office": "Building_Commercial", "retail": "Building_Commercial", "yes": "Building_Generic",
}
# Hydrography line types.
HYDRO_LINES = {"vattendrag": "stream", "stomlinje": "stream", "stomlinje, otydlig": "stream"}
HYDRO_STANDING = {"sjö": "lake"}


def tag(name: str, default: str = "") -> Column:
    """A tag's value, or a default."""
    return F.coalesce(F.try_element_at("tags", F.lit(name)), F.lit(default))


def route_elements(elements: DataFrame) -> DataFrame:
    """One row for each category an element belongs to; relations only where they are allowed."""
    way = F.col("type") == "way"
    either = F.col("type").isin("way", "relation")
    natural, landuse = tag("natural"), tag("landuse")
    tests = {
        "roads": way & tag("highway").isin(*HIGHWAYS),
        "water": (either & natural.isin("water", "wetland")) | (way & ((natural == "coastline") | tag("waterway").isin(*WATERWAYS))),
        "forests": (either & ((natural == "wood") | (landuse == "forest"))) | (way & natural.isin("scrub", "heath", "tree_row")),
        "buildings": either & (tag("building") != ""),
        "land_use": (either & landuse.isin(*LAND_USES)) | (way & (tag("leisure").isin(*LEISURE) | natural.isin(*BARE))),
    }
    hits = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return elements.withColumn("category", F.explode(hits))


def road_features(elements: DataFrame) -> DataFrame:
    """Roads with their eight properties and defaults."""
    plain = [tag(n).alias(n) for n in ("surface", "width", "name", "lanes")]
    return elements.select(
        "id", tag("highway", "unclassified").alias("highway"), *plain, tag("bridge", "no").alias("bridge"), tag("tunnel", "no").alias("tunnel")
    )


def water_features(elements: DataFrame, points: Column, closed: Column) -> DataFrame:
    """Water type and geometry: areas are closed water or wetland rings of more than three points."""
    natural, waterway = tag("natural"), tag("waterway")
    area = natural.isin("water", "wetland") & (points > 3) & closed
    kind = (
        F.when(natural == "water", tag("water", "lake"))
        .when(waterway != "", waterway)
        .when(natural.isin("coastline", "wetland"), natural)
        .otherwise("unknown")
    )
    return elements.select("id", kind.alias("water_type"), F.when(area, "Polygon").otherwise("LineString").alias("geometry"), tag("intermittent", "no").alias("intermittent"))


def area_features(elements: DataFrame, points: Column) -> DataFrame:
    """Areas of four points or more; the type is the first tag that is set."""
    first = F.coalesce(*[F.nullif(tag(n), F.lit("")) for n in ("landuse", "natural", "leisure")], F.lit("unknown"))
    return elements.where(points >= 4).select("id", first.alias("kind"), tag("leaf_type", "").alias("leaf_type"))


def building_features(elements: DataFrame, points: Column) -> DataFrame:
    """Buildings (ways of four points or more) with type and height; plain ones take a type from amenity, shop or office."""
    plain = tag("building") == "yes"
    kind = (
        F.when(plain & (tag("amenity") == "place_of_worship"), "church")
        .when(plain & (tag("shop") != ""), "commercial")
        .when(plain & (tag("office") != ""), "office")
        .otherwise(tag("building"))
    )
    height = C.building_height(tag("height"), tag("building:levels"))
    return elements.where((F.col("type") == "way") & (points >= 4)).select("id", kind.alias("building_type"), height.alias("height_m"))


def classify_buildings(buildings: DataFrame) -> DataFrame:
    """Default heights by type where the height is 0, and the asset category."""
    height = F.when(F.col("height_m") == 0, L.looked_up(F.col("building_type"), BUILDING_HEIGHTS, 6.0)).otherwise(F.col("height_m"))
    return buildings.withColumn("height_m", height).withColumn("asset", L.looked_up(F.col("building_type"), BUILDING_ASSETS, "Building_Generic"))


def closed_ring(ring: Column) -> Column:
    """The ring with its first point repeated at the end, if it is open."""
    open_ = (F.size(ring) > 0) & (F.element_at(ring, 1) != F.element_at(ring, -1))
    return F.when(open_, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def outer_rings(members: Column) -> Column:
    """Closed outer rings of a relation: role outer, more than three points."""
    kept = F.filter(members, lambda m: (m["role"] == "outer") & (F.size(m["ring"]) > 3))
    return F.transform(kept, lambda m: closed_ring(m["ring"]))


def hydro_line_type(local_type: Column, origin: Column) -> Column:
    """Watercourses: man-made ones are canals, others go by a table, streams by default."""
    made = F.lower(F.trim(F.coalesce(origin, F.lit("")))) == "manmade"
    return F.when(made, "canal").otherwise(L.looked_up(F.lower(F.trim(F.coalesce(local_type, F.lit("")))), HYDRO_LINES, "stream"))


def hydro_standing_type(local_type: Column) -> Column:
    return L.looked_up(F.lower(F.trim(F.coalesce(local_type, F.lit("")))), HYDRO_STANDING, "lake")


def intermittent_flag(persistence: Column) -> Column:
    return F.when(F.lower(persistence).isin("intermittent", "ephemeral"), "yes").otherwise("no")


def numeric_id(id_: Column, inspire: Column, other: Column) -> Column:
    """A whole-number id, else a stable hash of the long one, else the other, else 0."""
    whole = F.when(id_.rlike(r"^\s*-?[0-9]+\s*$"), F.trim(id_).cast("long"))
    hashed = F.when(inspire.isNotNull(), F.pmod(F.xxhash64(inspire), F.lit(10_000_000_000)))
    return F.coalesce(whole, hashed, other, F.lit(0).cast("long"))


def accepted_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots with an ISO time that are not empty with a remark."""
    dated = F.try_to_timestamp("base_time").isNotNull()
    return snapshots.where(dated & ~((F.col("elements") == 0) & (F.coalesce("remark", F.lit("")) != "")))


def polygon_verdict(points: Column, west: Column, south: Column, east: Column, north: Column, longest: float = 32_768.0 + 256.0) -> Column:
    """Why an area is refused, or ok."""
    width = (east - west) * 111_320.0 * F.cos(F.radians((south + north) / 2))
    return (
        F.when(points < 4, "too few points")
        .when((west < -180) | (east > 180) | (south < -90) | (north > 90), "out of range")
        .when((east - west < 0.001) | (north - south < 0.001), "too small")
        .when((width > longest) | ((north - south) * 110_540.0 > longest), "too large")
        .otherwise("ok")
    )


def raster_assets(assets: DataFrame) -> DataFrame:
    """Assets that are GeoTIFF by name or by media type."""
    href = F.lower("href")
    return assets.where(href.endswith(".tif") | href.endswith(".tiff") | F.lower(F.coalesce("media", F.lit(""))).contains("tiff"))


def first_available(candidates: DataFrame, key: str = "area") -> DataFrame:
    """The available source of the best priority for each area."""
    ranked = F.min_by(F.struct("source", "priority"), "priority")
    return candidates.where("available").groupBy(key).agg(ranked.alias("p")).select(key, "p.source", "p.priority")


def feature_name(names: Column, plain: Column, nested: Column, name: Column) -> Column:
    """A name from an array of structs (text), an array of strings, a struct's list, or a plain column; else empty."""
    return F.coalesce(F.get(names, 0)["text"], F.get(plain, 0), F.get(nested["text"], 0), name, F.lit(""))


def constant_water(features: DataFrame, kind: str) -> DataFrame:
    """Features of one water type: river polygons or wetlands."""
    return features.withColumn("water_type", F.lit(kind))


def type_counts(features: DataFrame) -> DataFrame:
    """Rows by category and type."""
    return features.groupBy("category", "kind").agg(F.count("*").alias("n"))
