"""Classification rules for roads, water, forests, terrain sizes and sources: columns in, columns out (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lookups as L


def road_surface(highway: Column, tag: Column, country: Column, in_forest: Column, in_urban: Column) -> Column:
    """A surface tag decides (unknown tags: gravel); else class, country and surroundings do."""
    urban = F.when(in_urban, "asphalt").otherwise("gravel")
    by_class = (
        F.when(highway.isin(*L.MAJOR_ROADS), "asphalt")
        .when(highway == "residential", F.when(in_urban, "asphalt").otherwise(L.looked_up(country, L.RURAL, "asphalt")))
        .when(highway.isin("unclassified", "service", "cycleway"), urban)
        .when(highway == "track", F.when(in_forest, L.looked_up(country, L.FOREST_ROAD, "gravel")).otherwise("gravel"))
        .when(highway.isin("path", "footway", "bridleway"), "dirt")
        .otherwise("gravel")
    )
    return F.when(F.coalesce(tag, F.lit("")) != "", L.looked_up(tag, L.SURFACE_TAGS, "gravel")).otherwise(by_class)


def road_width(highway: Column, width: Column, lanes: Column, surface: Column) -> Column:
    """A width tag, else lanes, else the class, else 4 m; values that are no numbers fall through."""
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"
    bare = F.regexp_replace(F.coalesce(width, F.lit("")), "m", "")
    tagged = F.when(bare.rlike(number), F.trim(bare).cast("double"))
    whole = F.coalesce(lanes, F.lit(""))
    by_lanes = F.when(whole.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(whole).cast("int") * F.when(surface == "asphalt", 3.5).otherwise(2.5))
    by_class = L.looked_up(highway, {k: v[0] for k, v in L.ROADS.items()}, L.DEFAULT_WIDTH)
    return F.coalesce(tagged, by_lanes, by_class)


def width_class(width: Column) -> Column:
    return F.when(width >= 7, "wide").when(width >= 4, "medium").otherwise("narrow")


def road_prefab(highway: Column, surface: Column, width: Column) -> Column:
    """The class's asset, else that of surface and width, else a narrow asphalt one."""
    pairs = {f"{a}|{b}": v for (a, b), v in L.ASSETS.items()}
    return F.coalesce(
        L.looked_up(highway, {k: v[2] for k, v in L.ROADS.items()}),
        L.looked_up(F.concat_ws("|", surface, width_class(width)), pairs),
        F.lit(L.DEFAULT_ASSET),
    )


def asset_folder(asset: Column) -> Column:
    """Sub-folder of a road asset."""
    return F.when(asset.contains("Asphalt"), "Asphalt").when(asset.contains("Cobblestone"), "Cobblestone").otherwise("Dirt")


def road_rank(highway: Column) -> Column:
    return L.looked_up(highway, L.RANKS, L.DEFAULT_RANK)


def water_class(water_type: Column, geometry: Column) -> Column:
    """lake, river, coastline, wetland or null."""
    return (
        F.when(water_type.isin(*L.LAKES) & geometry.isin("Polygon", "MultiPolygon"), "lake")
        .when(water_type.isin("river", "stream", "canal") & (geometry == "LineString"), "river")
        .when(water_type.isin("coastline", "wetland"), water_type)
    )


def river_width(water_type: Column) -> Column:
    return L.looked_up(water_type, L.RIVER_WIDTHS, 5.0)


def forest_type(leaf: Column, area: Column, country: Column) -> Column:
    return (
        F.when(leaf == "needleleaved", "coniferous")
        .when(leaf == "broadleaved", "deciduous")
        .when(leaf == "mixed", "mixed")
        .when(area.isin("scrub", "heath"), area)
        .otherwise(L.looked_up(country, L.FOREST_DEFAULT, "mixed"))
    )


def forest_density(kind: Column) -> Column:
    return L.looked_up(kind, L.DENSITY, 0.65)


def forest_species(kind: Column, country: Column) -> Column:
    """Species (array) by type and country, else by type, else a generic tree."""
    return F.split(
        F.coalesce(L.looked_up(F.concat_ws("|", kind, country), L.SPECIES), L.looked_up(kind, L.SPECIES_BY_TYPE), F.lit("generic_tree")), ","
    )


# Southern and northern latitude, treeline at each.
NORTH = {"NO": (58.0, 71.0, 1200, 800), "SE": (55.5, 69.0, 1100, 800), "FI": (60.0, 70.0, 700, 400)}


def treeline(country: Column, lat: Column) -> Column:
    """A country's treeline; in NO, SE and FI it falls evenly with latitude, cut to whole metres."""
    north = F.lit(None).cast("int")
    for code, (south_lat, north_lat, south, far) in NORTH.items():
        share = F.least(F.greatest((lat - south_lat) / (north_lat - south_lat), F.lit(0.0)), F.lit(1.0))
        north = F.when(country == code, (F.lit(float(south)) + share * float(far - south)).cast("int")).otherwise(north)
    return F.coalesce(north, L.looked_up(country, L.TREELINES, L.DEFAULT_TREELINE))


def terrain_faces(metres: Column, cell: float = 2.0) -> Column:
    """Faces of an axis: half-even rounding to a multiple of 128 within 128 and 16384."""
    faces = F.bround(metres / cell, 0)
    return F.least(F.greatest(F.bround(faces / 128, 0) * 128, F.lit(128)), F.lit(16384)).cast("int")


def imagery_size(axis: Column) -> Column:
    return F.greatest(F.least(F.lit(8192), axis * 4), axis)


def height_scale(low: Column, high: Column) -> Column:
    """The first step whose band, a tenth below zero, holds the span; else the span's own."""
    out = F.greatest(F.lit(0.03125), F.greatest(high - low, F.lit(0.01)) / 65535.0)
    for s in reversed(L.HEIGHT_SCALES):
        out = F.when((high <= s * 65535.0 * (1.0 - 0.10)) & (low >= -s * 65535.0 * 0.10), s).otherwise(out)
    return out


def expected_surface(kind: Column, surface: Column, forest: Column) -> Column:
    """Ground surface that a named feature rides on; null for kinds without one."""
    return (
        F.when(kind == "Road", F.when(surface.isin("gravel", "dirt"), surface).otherwise("asphalt"))
        .when(kind == "Forest", F.when(forest == "coniferous", "pine_floor").otherwise("forest_floor"))
        .when(kind.isin("Lake", "River"), "water_edge")
    )


def building_height(height: Column, levels: Column) -> Column:
    """A height tag (bad values: 0) else three metres for each level (bad values: 0) else 0."""
    number = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"
    bare = F.regexp_replace(F.coalesce(height, F.lit("")), "m", "")
    floors = F.coalesce(levels, F.lit(""))
    by_tag = F.when(bare.rlike(number), F.trim(bare).cast("double")).otherwise(0.0)
    by_floor = F.when(floors.rlike(number), F.trim(floors).cast("double") * 3).otherwise(0.0)
    return F.when(F.coalesce(height, F.lit("")) != "", by_tag).when(floors != "", by_floor).otherwise(0.0)
