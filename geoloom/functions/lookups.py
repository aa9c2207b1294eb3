"""Fixed values of the terrain rules, as plain tables, and columns that look them up."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Road classes with width (m), surface and asset.
ROADS = {
    "motorway": (14.0, "asphalt", "RG_Road_Asphalt_E_03"),
    "motorway_link": (8.0, "asphalt", "RG_Road_Asphalt_E_02"),
    "trunk": (10.0, "asphalt", "RG_Road_Asphalt_E_02"),
    "trunk_link": (7.0, "asphalt", "RG_Road_Asphalt_E_02"),
    "primary": (8.0, "asphalt", "RG_Road_Asphalt_E_02"),
    "primary_link": (6.0, "asphalt", "RG_Road_Asphalt_E_01"),
    "secondary": (7.0, "asphalt", "RG_Road_Asphalt_E_01"),
    "secondary_link": (5.0, "asphalt", "RG_Road_Asphalt_E_01_Narrow"),
    "tertiary": (6.0, "asphalt", "RG_Road_Asphalt_E_01"),
    "tertiary_link": (5.0, "asphalt", "RG_Road_Asphalt_E_01_Narrow"),
    "residential": (5.0, "asphalt", "RG_Road_Asphalt_E_01_DashedLine"),
    "unclassified": (4.0, "asphalt", "RG_Road_Asphalt_E_01_DashedLine"),
    "service": (3.5, "asphalt", "RG_Road_Asphalt_E_01_Narrow"),
    "living_street": (4.0, "asphalt", "RG_Road_Asphalt_E_01_Narrow"),
    "cycleway": (2.0, "asphalt", "RG_Road_Asphalt_E_01_Narrow"),
    "track": (3.0, "gravel", "RG_TrailGravel_01"),
    "path": (1.5, "dirt", "RG_TrailDirt_01"),
    "footway": (1.5, "dirt", "RG_TrailDirt_01"),
    "bridleway": (2.0, "dirt", "RG_TrailDirt_01"),
}
DEFAULT_WIDTH = 4.0
# Assets by surface and width class.
ASSETS = {
    ("asphalt", "wide"): "RG_Road_Asphalt_E_03",
    ("asphalt", "medium"): "RG_Road_Asphalt_E_01",
    ("asphalt", "narrow"): "RG_Road_Asphalt_E_01_Narrow",
    ("gravel", "wide"): "RG_Road_Forest_01",
    ("gravel", "medium"): "RG_TrailGravel_01",
    ("gravel", "narrow"): "RG_TrailGravel_01",
    ("dirt", "wide"): "RG_Road_Dirt_02",
    ("dirt", "medium"): "RG_Road_Dirt_01",
    ("dirt", "narrow"): "RG_TrailDirt_01",
    ("cobblestone", "wide"): "RG_Road_Cobblestone_01",
    ("cobblestone", "medium"): "RG_Road_Cobblestone_01",
    ("cobblestone", "narrow"): "RG_Road_Cobblestone_01",
}
DEFAULT_ASSET = "RG_Road_Asphalt_E_01_Narrow"
# Surface tags.
SURFACE_TAGS = {
    "asphalt": "asphalt", "paved": "asphalt", "concrete": "asphalt", "concrete:plates": "asphalt", "concrete:lanes": "asphalt",
    "sett": "asphalt", "cobblestone": "asphalt", "paving_stones": "asphalt", "gravel": "gravel", "fine_gravel": "gravel",
    "compacted": "gravel", "dirt": "dirt", "earth": "dirt", "ground": "dirt", "mud": "dirt", "sand": "dirt", "grass": "dirt",
    "unpaved": "gravel",
}
MAJOR_ROADS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
)
# Surfaces of rural residential and of forest roads by country.
RURAL = {"NO": "gravel", "SE": "asphalt", "FI": "gravel", "DK": "asphalt", "EE": "gravel", "LV": "gravel", "LT": "asphalt"}
FOREST_ROAD = {"NO": "gravel", "SE": "gravel", "FI": "gravel", "DK": "gravel", "EE": "dirt", "LV": "dirt", "LT": "gravel"}
# Importance of road classes, smaller first.
RANKS = {
    "motorway": 0, "trunk": 0, "motorway_link": 1, "trunk_link": 1, "primary": 2, "primary_link": 3, "secondary": 4, "secondary_link": 5,
    "tertiary": 6, "tertiary_link": 7, "unclassified": 8, "residential": 8, "living_street": 9, "service": 10, "track": 11,
    "path": 12, "footway": 12, "cycleway": 12, "bridleway": 12,
}
DEFAULT_RANK = 8
# Projected systems and treelines (m) by country.
CRS = {
    "SE": "EPSG:3006", "NO": "EPSG:25833", "DK": "EPSG:25832", "FI": "EPSG:3067", "EE": "EPSG:3301", "LV": "EPSG:3059", "LT": "EPSG:3346",
    "DE": "EPSG:25832", "PL": "EPSG:2180", "GB": "EPSG:27700", "FR": "EPSG:2154", "ES": "EPSG:25830", "IT": "EPSG:32632",
    "AT": "EPSG:31287", "CH": "EPSG:2056",
}
TREELINES = {"NO": 1100, "SE": 1000, "FI": 600, "DK": 9999, "EE": 9999, "LV": 9999, "LT": 9999, "PL": 1400}
DEFAULT_TREELINE = 1200
# Forests.
FOREST_DEFAULT = {"NO": "coniferous", "SE": "coniferous", "FI": "coniferous", "DK": "deciduous", "EE": "mixed", "LV": "mixed", "LT": "mixed"}
DENSITY = {"scrub": 0.3, "heath": 0.3, "coniferous": 0.7, "deciduous": 0.6, "mixed": 0.65}
SPECIES = {
    "coniferous|NO": "spruce,pine,juniper", "coniferous|SE": "spruce,pine", "coniferous|FI": "spruce,pine,birch",
    "deciduous|NO": "birch,oak,elm", "deciduous|SE": "birch,beech,oak", "deciduous|FI": "birch,aspen", "deciduous|DK": "beech,oak,ash",
    "mixed|NO": "spruce,pine,birch", "mixed|SE": "spruce,pine,birch,oak", "mixed|FI": "spruce,pine,birch",
    "mixed|EE": "pine,spruce,birch,aspen", "mixed|LV": "pine,spruce,birch", "mixed|LT": "pine,spruce,oak,birch",
}
SPECIES_BY_TYPE = {
    "coniferous": "spruce,pine", "deciduous": "birch,oak,beech", "mixed": "spruce,pine,birch", "scrub": "juniper,willow", "heath": "heather",
}
# Water.
RIVER_WIDTHS = {"river": 15.0, "stream": 3.0, "canal": 8.0, "ditch": 1.5, "drain": 2.0}
LAKES = ("lake", "pond", "reservoir", "water", "basin")
# Surfaces from most to least specific.
IMPORT_ORDER = ("rock", "pine_floor", "forest_floor", "asphalt", "gravel", "crop", "dirt", "sand", "water_edge")
HEIGHT_SCALES = (0.03125, 0.0625, 0.125, 0.25, 0.5, 1.0)


def looked_up(key: Column, table: dict, default=None) -> Column:
    """The value of ``key`` in a small fixed table: a map literal, so no join and no broadcast."""
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    value = F.try_element_at(pairs, key)
    return F.coalesce(value, F.lit(default)) if default is not None else value


def sql_case(key: str, table: dict, default: object = None) -> str:
    """The same as a DuckDB CASE expression."""

    def text(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    body = " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items())
    return f"CASE {key} {body} ELSE {'NULL' if default is None else text(default)} END"
