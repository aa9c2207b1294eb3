"""Queries of the chains that a terrain project takes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import spatial
from ..operators import terrain as T
from ..operators.staging import written
from . import networks, rules
from .derive import GRID, derived
from .rules import box_ring

QUERIES, SQL = {}, {}
col, lit = F.col, F.lit
#: The terrain's box and its size in metres.
BOX, WIDTH, DEPTH = (16.0, 59.0, 16.04, 59.03), 2280.0, 3340.0


def query(f):
    QUERIES[f.__name__] = f
    return f


def _terrain(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    return T.Terrain(BOX, WIDTH, DEPTH, dem, dem.agg(F.max("r") + 1).first()[0] or 1, GRID)


def _name(every: int):
    return F.when(col("id") % every == 0, F.concat(lit("Gamla V"), (col("id") % 5).cast("string"))).otherwise("")


def _roads(spark, sf_dir):
    roads = rules.classified_roads(spark, sf_dir).select("id", _name(4).alias("name"), "surface", "prefab")
    return T.road_splines(derived(spark, sf_dir, "line_points"), roads, _terrain(spark, sf_dir))


@query
def m1_road_splines(spark, sf_dir):
    rows = _roads(spark, sf_dir)
    return rows.select("line_id", "chunk", "entity", "prefab", "ground", F.size("vertices").alias("n"), F.get("vertices", 0)["z"].alias("z"))


def _areas(spark, sf_dir):
    """Boxes of some hundred metres with their edges in local metres."""
    boxes = derived(spark, sf_dir, "boxes").withColumns({"x": (col("id") * 37 % 2280).cast("double"), "y": (col("id") * 53 % 3340).cast("double"), "w": col("w") * 60000, "h": col("h") * 60000})
    ring = boxes.select(col("id").alias("pid"), F.array(box_ring()).alias("rings"))
    return boxes.withColumn("name", _name(3)), T.P.polygon_edges(ring)


def _forests(spark, sf_dir):
    boxes, edges = _areas(spark, sf_dir)
    return T.forest_outlines(boxes.select("id", "name", "leaf_type", "area_type", "country"), edges, _terrain(spark, sf_dir))


def _lakes(spark, sf_dir):
    boxes, edges = _areas(spark, sf_dir)
    return T.lake_outlines(boxes.select("id", "name", "water_type"), edges, _terrain(spark, sf_dir))


@query
def m2_forest_outlines(spark, sf_dir):
    return _forests(spark, sf_dir).select("entity", "category", F.size("vertices").alias("n"))


@query
def m3_lake_outlines(spark, sf_dir):
    return _lakes(spark, sf_dir).select("entity", F.size("vertices").alias("n"))


def _rivers(spark, sf_dir):
    rivers = derived(spark, sf_dir, "boxes").select("id", _name(3).alias("name"), "water_type", lit("LineString").alias("geometry"))
    return T.river_lines(derived(spark, sf_dir, "line_points"), rivers, _terrain(spark, sf_dir))


@query
def m4_river_lines(spark, sf_dir):
    return _rivers(spark, sf_dir).select("line_id", "entity", "width", F.size("vertices").alias("n"))


def _buildings(spark, sf_dir):
    buildings = networks.QUERIES["b5_building_features"](spark, sf_dir).select(
        "id", "building_type", "height_m", (16.0 + col("id") % 997 * 0.00005).alias("x"), (59.0 + col("id") % 991 * 0.00004).alias("y"), (col("id") % 11 * 0.01).alias("angle"), _name(7).alias("name")
    )
    roads = rules.classified_roads(spark, sf_dir).where("surface = 'asphalt'").select("id", (col("width_m") / 2 + 1.5).alias("reach"))
    terrain = _terrain(spark, sf_dir)
    after = Window.partitionBy("line_id").orderBy("seq")
    ends = terrain.local(derived(spark, sf_dir, "line_points")).withColumn("bx", F.lead("x").over(after)).withColumn("by", F.lead("y").over(after)).where("bx IS NOT NULL")
    segments = ends.join(roads, ends["line_id"] == roads["id"]).select(col("x").alias("ax"), col("y").alias("ay"), "bx", "by", "reach")
    kept = spatial.drop_near_lines(terrain.local(buildings.select("id", "x", "y")).select("id", "x", "y"), segments, "reach", 100.0)
    return T.building_placements(buildings, kept, terrain)


@query
def m5_building_placements(spark, sf_dir):
    return _buildings(spark, sf_dir)


@query
def m5_skip_reasons(spark, sf_dir):
    return T.skip_reasons(_buildings(spark, sf_dir))


@query
def m6_surface_assignments(spark, sf_dir):
    return T.surface_assignments(*(f(spark, sf_dir) for f in (_roads, _forests, _lakes, _rivers)))


@query
def g19_ten_surfaces(spark, sf_dir):
    dem = written(derived(spark, sf_dir, "dem").select("r", "c", "z"), "dem")
    masks = derived(spark, sf_dir, "masks").where("weight > 128 AND surface NOT IN ('sand', 'water_edge', 'rock', 'grass')").select("surface", "r", "c")
    water = dem.where("r % 29 < 6 AND c % 31 < 7").select(lit("water").alias("surface"), "r", "c")
    height = dem.agg(F.max("r") + 1).first()[0] or 1
    weights = T.surface_weights(dem, masks.unionByName(water), 5.0, 400.0, height, GRID)
    return weights.select("r", "c", *[F.round(s, 4).alias(s) for s in weights.columns if s not in ("r", "c", "water")])


@query
def g25_height_map(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    height = dem.agg(F.max("r") + 1).first()[0] or 1
    roads = spark.range(2 * height).select(col("id").alias("r"), lit(11).cast("long").alias("c"))
    water = spark.range(2 * height * 20).select(F.floor(col("id") / 20).alias("r"), (60 + col("id") % 20).alias("c"), lit("lake").alias("kind")).where("r % 50 < 20")
    return T.height_map(dem, (height, GRID), roads, water, 2.0, 2 * height, 160)
