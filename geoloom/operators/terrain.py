"""What a terrain project takes: roads, forests, lakes, rivers and buildings in its local metres, named, with heights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import classify as C
from ..functions.geometry import to_local
from ..functions.lookups import RIVER_WIDTHS, looked_up
from . import composites as M
from . import lines as N
from . import polygons as P
from . import raster as R
from .features import classify_buildings
from .naming import name_features, shown
from .staging import shuffled, written

#: Points of a road part, of a river and of an outline at most.
ROAD_POINTS, NATURAL_POINTS = 200, 120
#: Lakes that get an outline, and how far it is pushed outward (m).
LAKES, LAKE_PUSH = ("lake", "pond", "reservoir", "water"), 5.0


@dataclass(frozen=True)
class Terrain:
    """The terrain: its box in degrees, its size in metres, and the elevation grid (r, c, z; row 0 in the north)."""

    box: tuple[float, float, float, float]
    width: float
    depth: float
    cells: DataFrame
    rows: int
    cols: int

    def local(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """``points`` with x (east) and y (north) in local metres and z, the height there."""
        p = to_local(F.col(x), F.col(y), *(F.lit(v) for v in self.box), F.lit(self.width), F.lit(self.depth))
        moved = points.withColumn("_p", p).withColumn("u", F.col("_p.x") / self.width).withColumn("v", F.col("_p.z") / self.depth)
        moved = moved.withColumn(x, F.col("_p.x")).withColumn(y, F.col("_p.z")).drop("_p")
        return R.sample_raster(moved, self.cells.select("r", "c", "z"), self.rows, self.cols).drop("u", "v")


def road_splines(points: DataFrame, roads: DataFrame, terrain: Terrain, most: int = ROAD_POINTS) -> DataFrame:
    """One row per road part: line_id, chunk, entity, prefab, ground, vertices (x, y, z) in order.

    ``points``: line_id, seq, x, y in degrees; ``roads``: id, name, surface, prefab and, where known, ref. Lines are
    brought to the terrain, cut to it, simplified on sideways and height error, and cut
    into parts of ``most`` points whose names end in _partN where there are several.
    """
    local = terrain.local(points.select("line_id", "seq", "x", "y"))
    parts = N.road_parts(local.where(F.col("x").between(0.0, terrain.width) & F.col("y").between(0.0, terrain.depth)), most)
    ref = (F.col("ref") if "ref" in roads.columns else F.lit(None).cast("string")).alias("ref")
    first = F.get("vertices", 0)
    start = parts.where("chunk = 0").select("line_id", first["x"].alias("x"), first["y"].alias("z"))
    start = start.join(shuffled(roads.select(F.col("id").alias("line_id"), "name", ref, "surface", "prefab")), "line_id")
    ground = C.expected_surface(F.lit("Road"), F.col("surface"), F.lit(""))
    known = written(start.select(F.col("line_id").alias("id"), F.lit("Road").alias("kind"), shown("Road", F.col("surface")).alias("category"), "name", "ref", "x", "z", "prefab", ground.alias("ground")), "roads")
    named = name_features(known.drop("prefab", "ground"), terrain.width, terrain.depth).join(shuffled(known.select("id", "prefab", "ground")), "id").withColumnRenamed("id", "line_id")
    entity = F.when(F.col("parts") > 1, F.concat("entity", F.lit("_part"), (F.col("chunk") + 1).cast("string"))).otherwise(F.col("entity"))
    return parts.join(shuffled(named), "line_id").select("line_id", "chunk", entity.alias("entity"), "prefab", "ground", "vertices")


def river_lines(points: DataFrame, rivers: DataFrame, terrain: Terrain, most: int = NATURAL_POINTS) -> DataFrame:
    """One row per river: line_id, entity, width, vertices. ``rivers``: id, name, water_type, geometry; lines of types without a width go."""
    wide = rivers.withColumn("width", looked_up(F.col("water_type"), RIVER_WIDTHS)).where((F.col("geometry") == "LineString") & F.col("width").isNotNull())
    own = points.select("line_id", "seq", "x", "y").join(shuffled(wide.select(F.col("id").alias("line_id"))), "line_id", "left_semi")
    inside = N.in_bounds(terrain.local(N.drop_hairpins(own)), 0.0, 0.0, terrain.width, terrain.depth)
    slim = N.simplify_schedule(inside, most).select("line_id", "seq").join(shuffled(inside), ["line_id", "seq"])
    rows = slim.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y", "z"))).alias("vertices"))
    rows = rows.join(shuffled(wide.select(F.col("id").alias("line_id"), "name", "water_type", "width")), "line_id")
    first = F.get("vertices", 0)
    named = name_features(
        rows.select(F.col("line_id").alias("id"), F.lit("River").alias("kind"), shown("River", F.col("water_type")).alias("category"), "name", first["x"].alias("x"), first["y"].alias("z")), terrain.width, terrain.depth
    )
    return rows.join(shuffled(named.withColumnRenamed("id", "line_id")), "line_id").select("line_id", "entity", "width", "vertices")


def outlines(areas: DataFrame, edges: DataFrame, terrain: Terrain, kind: str, push: float = 0.0, most: int = NATURAL_POINTS, sliver: float = 100.0) -> DataFrame:
    """One row per outer ring of dissolved areas: group, ring, entity, category, vertices.

    ``areas``: id, name, category and, where names show another class, label (that of the
    smallest id of those that became one); ``edges``: their outer rings (pid, ax, ay, bx, by) in local
    metres. Areas of one category that overlap or touch become one; holes are dropped;
    outlines are pushed outward, clipped to the terrain and a metre around it, simplified;
    rings of under three points and those that cross themselves go.
    """
    if areas.isEmpty():
        return areas.sparkSession.createDataFrame([], "group long, ring long, entity string, category string, vertices array<struct<seq:int,x:double,y:double>>")
    box = (-1.0, -1.0, terrain.width + 1, terrain.depth + 1)
    twice = F.abs(F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay"))) / 2
    sized = areas.join(shuffled(edges.groupBy("pid").agg(twice.alias("area"))), areas["id"] == F.col("pid"))
    own = sized.select("id", "name", "area", F.coalesce(F.concat(F.lit("="), "category"), F.lit("")).alias("class"))
    features, rings = P.dissolve(own, edges, 64.0, sliver, by=("class",))
    outer = rings.where("area > 0").select("group", F.col("ring").alias("line_id"), "seq", "x", "y")
    moved = M.buffer_rings(outer.drop("group"), push) if push else outer.drop("group")
    slim = N.simplify_schedule(N.clip_polygon(moved, *box), most, closed=True, rising=(1.0, 2.0, 5.0, 10.0, 20.0, 50.0))
    full = slim.withColumn("_n", F.count("*").over(Window.partitionBy("line_id"))).where("_n >= 3").drop("_n")
    good = full.join(shuffled(M.simple_rings(full)), "line_id", "left_semi")
    rows = good.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("vertices"))
    owner = outer.select("line_id", "group").distinct().join(shuffled(features.select("group", "name")), "group")
    labels = areas.select(F.col("id").alias("group"), "category", (F.col("label") if "label" in areas.columns else F.col("category")).alias("label"))
    start = written(rows.join(shuffled(owner), "line_id").join(shuffled(labels), "group").withColumn("id", F.struct("category", "group", "line_id")), "outlines")
    first = F.get("vertices", 0)
    named = name_features(start.select("id", F.lit(kind).alias("kind"), shown(kind, F.col("label")).alias("category"), "name", first["x"].alias("x"), first["y"].alias("z")), terrain.width, terrain.depth)
    return start.join(shuffled(named), "id").select("group", F.col("line_id").alias("ring"), "entity", "category", "vertices")


def forest_outlines(forests: DataFrame, edges: DataFrame, terrain: Terrain) -> DataFrame:
    """Outlines of forests (id, name, leaf_type, area_type, country) by class."""
    kind = C.forest_type(F.col("leaf_type"), F.col("area_type"), F.col("country"))
    return outlines(forests.select("id", "name", kind.alias("category")), edges, terrain, "Forest")


def lake_outlines(waters: DataFrame, edges: DataFrame, terrain: Terrain) -> DataFrame:
    """Outlines of standing water (id, name, water_type), pushed LAKE_PUSH metres outward."""
    lakes = waters.where(F.col("water_type").isin(*LAKES)).select("id", "name", F.lit("lake").alias("category"), F.col("water_type").alias("label"))
    return outlines(lakes, edges.join(lakes.select(F.col("id").alias("pid")), "pid", "left_semi"), terrain, "Lake", LAKE_PUSH)


def building_placements(buildings: DataFrame, kept: DataFrame, terrain: Terrain) -> DataFrame:
    """Buildings (id, name, x, y in degrees, building_type, height_m, angle) with their reason: placed, or why they go.

    ``kept``: the ids that stand clear of asphalt roads. Placed ones have an entity, asset,
    local x, y, z and a yaw (0 where the angle is 0.05 degrees at most).
    """
    rows = terrain.local(classify_buildings(buildings)).join(kept.select("id", F.lit(True).alias("_kept")), "id", "left")
    inside = F.col("x").between(-1.0, terrain.width + 1) & F.col("y").between(-1.0, terrain.depth + 1)
    reason = F.when(F.col("_kept").isNull(), "near road").when(~inside, "outside").when(F.col("asset").isNull(), "no asset").otherwise("placed")
    rows = rows.withColumn("reason", reason)
    named = name_features(
        rows.where("reason = 'placed'").select("id", F.lit("Building").alias("kind"), shown("Building", F.col("building_type")).alias("category"), "name", "x", F.col("y").alias("z")), terrain.width, terrain.depth
    )
    yaw = F.when(F.abs("angle") <= 0.05, 0.0).otherwise(F.col("angle"))
    return rows.join(named, "id", "left").select("id", "entity", "asset", "x", "y", "z", yaw.alias("yaw"), "reason")


def skip_reasons(placements: DataFrame) -> DataFrame:
    """How many buildings were placed and how many went for each reason."""
    return placements.groupBy("reason").agg(F.count("*").alias("n"))


def surface_assignments(roads: DataFrame, forests: DataFrame, lakes: DataFrame, rivers: DataFrame) -> DataFrame:
    """Entities of the four tables above with the ground they lie on, in the order of their kinds: place, entity, ground."""

    def rows(df: DataFrame, place: int, ground: Column) -> DataFrame:
        return df.select(F.lit(place).alias("place"), "entity", ground.alias("ground"))

    ground = lambda kind, forest: C.expected_surface(F.lit(kind), F.lit(""), forest)
    every = (
        rows(roads, 1, F.col("ground")).unionByName(rows(forests, 2, ground("Forest", F.col("category"))))
        .unionByName(rows(lakes, 3, ground("Lake", F.lit("")))).unionByName(rows(rivers, 4, ground("River", F.lit(""))))
    )
    return every.where("ground IS NOT NULL")


def surface_weights(cells: DataFrame, masks: DataFrame, cell_m: float, line: float, height: int, width: int, tile: int = 256) -> DataFrame:
    """Weights of the ten surfaces (r, c): every mask (surface, r, c) gets a soft edge by its distance transform.

    Rock is slope or height above the treeline, smoothed; forest floors stop at the
    treeline; sand and water's edge are rings around the mask ``water``, as wide as the
    shore's transition; grass takes what is left. All of this reaches a bounded number of cells far, so
    each tile of the grid settles its own cells from those in reach; a NaN height counts as none.
    """
    sigma = max(1.0, 2.0 * (cell_m / 2.0))
    edge, shore = max(3, int(20.0 / cell_m)), max(2, int(10.0 / cell_m))
    # surface: (cells of transition, factor, whether it ends at the treeline)
    recipes = {
        "forest_floor": (edge, 1.0, True), "pine_floor": (edge, 1.0, True), "asphalt": (2, 1.0, False), "gravel": (2, 0.8, False),
        "crop": (8, 0.7, False), "dirt": (2, 1.0, False), "sand": (shore, 1.0, False), "water_edge": (shore, 0.7, False),
    }
    reach = max(int(4 * sigma + 0.5) + 1, *(t for t, *_ in recipes.values()), 3 * shore)
    given = ["water", *[s for s in recipes if s not in ("sand", "water_edge")]]
    bit = looked_up(F.col("surface"), {s: 1 << k for k, s in enumerate(given)})
    r, c = (F.col(k).cast("long").alias(k) for k in "rc")
    own = cells.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    own = own.select(r, c, F.col("z").cast("double").alias("z"), R.above_treeline(F.col("z"), F.lit(line)).alias("high"), F.lit(-1).alias("bits"))
    marks = masks.where(F.col("surface").isin(*given) & F.col("r").isNotNull() & F.col("c").isNotNull()).groupBy(r, c).agg(F.bit_or(bit.cast("int")).alias("bits"))
    marks = marks.select("r", "c", F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("high"), "bits")

    def work(pdf, rows, cols):
        y, x, bits = pdf["r"].to_numpy() - rows[0], pdf["c"].to_numpy() - cols[0], pdf["bits"].to_numpy()
        cell = bits < 0
        y, x, yy, xx = y[cell], x[cell], y[~cell], x[~cell]
        shape = len(rows), len(cols)
        z, high, real, marked = np.full(shape, np.nan), np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, int)
        z[y, x], high[y, x], real[y, x], marked[yy, xx] = pdf["z"].to_numpy()[cell], pdf["high"].to_numpy()[cell], True, bits[~cell]
        ramp = np.clip((R.window_slope(z, cell_m) - 25.0) / 15.0, 0.0, 1.0)
        rock = R.window_gaussian(np.where(real, np.maximum(ramp, high), 0.0), rows, cols, sigma, height, width)
        on = {s: marked & (1 << k) > 0 for k, s in enumerate(given)}
        on["forest_floor"] &= ~on["pine_floor"]
        near, far = R.window_dilate(on["water"], shore), R.window_dilate(on["water"], 2 * shore)
        on["sand"], on["water_edge"] = near & ~on["water"], far & ~near
        mine = (y >= reach) & (y < shape[0] - reach) & (x >= reach) & (x < shape[1] - reach)
        y, x = y[mine], x[mine]
        out = {"r": rows[y], "c": cols[x], "rock": rock[y, x], "water": on["water"][y, x]}
        for name, (t, factor, ends) in recipes.items():
            out[name] = R.window_edge(on[name], real, t)[y, x] * factor * (1 - high[y, x] if ends else 1.0)
        return pd.DataFrame(out)

    schema = ", ".join(["r long, c long, rock double, water boolean", *(f"{s} double" for s in recipes)])
    return R.normalize_weights(R.by_tiles(own.unionByName(marks), reach, work, schema, tile), ["rock", *recipes])


def height_map(source: DataFrame, size: tuple[int, int], roads: DataFrame, water: DataFrame, cell_m: float, height: int, width: int) -> DataFrame:
    """The height map from an elevation grid of another size: resampled by cubic weights to the terrain's cells, then as ``terrain``."""
    cells = written(R.resample(source, *size, height, width, cubic=True), "resampled")
    return M.terrain(cells, roads, water, cell_m, height, width)
