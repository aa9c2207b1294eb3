"""Chains of operators whose result is one table a user asks for: terrain, surfaces, roads, outlines, placements, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import point_segment, project_tm
from ..functions.lookups import LAKES, RIVER_WIDTHS, looked_up
from . import lines as N
from . import raster as R
from .staging import written

# Land-cover codes with target, category or water type, kind and leaf type.
LAND_COVER = {
    2631: ("water", "coastline", "water", ""), 2632: ("water", "lake", "water", ""), 2633: ("water", "river", "water", ""),
    2634: ("water", "reservoir", "water", ""), 2635: ("land_use", "natural", "bare_rock", ""), 2636: ("land_use", "landuse", "residential", ""),
    2637: ("land_use", "landuse", "residential", ""), 2638: ("land_use", "landuse", "residential", ""), 2639: ("land_use", "landuse", "industrial", ""),
    2640: ("land_use", "natural", "grassland", ""), 2641: ("land_use", "landuse", "retail", ""), 2642: ("land_use", "landuse", "farmland", ""),
    2643: ("land_use", "landuse", "orchard", ""), 2644: ("land_use", "natural", "bare_rock", ""), 2645: ("forests", "forest", "forest", "needleleaved"),
    2646: ("forests", "forest", "forest", "broadleaved"), 2647: ("forests", "forest", "forest", "broadleaved"),
}
# Water kinds in carving order with greatest depth (m) and steepness.
BEDS = (("river", 2.0, 0.3), ("wetland", 1.0, 0.3), ("sea", 30.0, 0.3), ("lake", 15.0, 0.5))


def land_cover(features: DataFrame) -> DataFrame:
    """Land-cover features by code to target tables; null, odd and unknown codes are skipped. A small broadcast table."""
    rows = [(k, *v) for k, v in LAND_COVER.items()]
    table = features.sparkSession.createDataFrame(rows, "code int, target string, category string, kind string, leaf_type string")
    code = F.when(F.col("code").rlike(r"^\s*[0-9]+\s*$"), F.trim("code").cast("int"))
    return features.withColumn("code", code).join(F.broadcast(table), "code")


def source_status(configs: DataFrame) -> DataFrame:
    """available without a key, configured with one, api_key_required without, not_implemented for other kinds."""
    keyed = F.col("auth").isin("token", "api_key")
    status = F.when(F.col("auth") == "none", "available").when(keyed & F.col("has_key"), "configured").when(keyed, "api_key_required").otherwise("not_implemented")
    return configs.withColumn("status", status)


def ambient_asset(codes: Column, table: dict[str, str], default: str) -> Column:
    """The entry of the first listed country that has one."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.filter(F.transform(codes, lambda c: F.try_element_at(pairs, c)), lambda v: v.isNotNull())
    return F.coalesce(F.get(found, 0), F.lit(default))


def chunk_ranges(boxes: DataFrame, longest: float) -> DataFrame:
    """Boxes split into the fewest equal parts whose sides are at most ``longest``."""
    for low, high, k in (("west", "east", "i"), ("south", "north", "j")):
        parts = F.greatest(F.ceil((F.col(high) - F.col(low)) / longest), F.lit(1)).cast("int")
        boxes = boxes.withColumn("_n", parts).withColumn(k, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        side = (F.col(high) - F.col(low)) / F.col("_n")
        boxes = boxes.withColumns({low: F.col(low) + F.col(k) * side, high: F.col(low) + (F.col(k) + 1) * side}).drop("_n")
    return boxes


def buffer_rings(rings: DataFrame, distance: float) -> DataFrame:
    """Rings (line_id, seq, x, y; open, counter-clockwise) pushed outward with mitred corners."""
    window = Window.partitionBy("line_id").orderBy("seq")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = {c: F.coalesce(F.lag(c).over(window), F.last(c).over(whole)) for c in ("x", "y")}
    after = {c: F.coalesce(F.lead(c).over(window), F.first(c).over(whole)) for c in ("x", "y")}
    rows = rings.select("*", *[before[c].alias("_p" + c) for c in "xy"], *[after[c].alias("_n" + c) for c in "xy"])
    ax, ay, bx, by = F.col("x") - F.col("_px"), F.col("y") - F.col("_py"), F.col("_nx") - F.col("x"), F.col("_ny") - F.col("y")
    la, lb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    nx, ny = ay / la + by / lb, -ax / la - bx / lb
    size = nx * nx + ny * ny
    moved = [F.when(size > 1e-9, F.col(c) + 2 * distance * n / size).otherwise(F.col(c)).alias(c) for c, n in (("x", nx), ("y", ny))]
    return rows.select("line_id", "seq", *moved)


def simple_rings(rings: DataFrame) -> DataFrame:
    """Ids of rings (open, in order) whose edges do not cross: edges of one ring are paired, neighbours apart."""
    window = Window.partitionBy("line_id").orderBy("seq")
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy("line_id"))
    nxt = [F.coalesce(F.lead(c).over(window), F.first(c).over(whole)).alias("_" + c) for c in ("x", "y")]
    edges = rings.select("line_id", F.row_number().over(window).alias("k"), n.alias("n"), "x", "y", *nxt)
    a, b = edges.alias("a"), edges.alias("b")

    def side(p: str, q: str, x: str, y: str) -> Column:
        return F.signum((F.col(f"{p}._x") - F.col(f"{p}.x")) * (F.col(f"{q}.{y}") - F.col(f"{p}.y")) - (F.col(f"{p}._y") - F.col(f"{p}.y")) * (F.col(f"{q}.{x}") - F.col(f"{p}.x")))

    apart = (F.col("b.k") > F.col("a.k") + 1) & ~((F.col("a.k") == 1) & (F.col("b.k") == F.col("b.n")))
    crossing = (side("a", "b", "x", "y") * side("a", "b", "_x", "_y") < 0) & (side("b", "a", "x", "y") * side("b", "a", "_x", "_y") < 0)
    bad = a.join(b, F.col("a.line_id") == F.col("b.line_id")).where(apart & crossing).select(F.col("a.line_id").alias("line_id")).distinct()
    return rings.select("line_id").distinct().join(bad, "line_id", "left_anti")


def any_tag(any_of: dict[str, list[str]]) -> Column:
    """Whether any of the named columns has one of its listed values; without names, always."""
    hit = F.lit(not any_of)
    for name, values in any_of.items():
        hit = hit | F.coalesce(F.col(name).isin(*values), F.lit(False))
    return hit


def burn_areas(features: DataFrame, edges: DataFrame, cell: float, height: int, width: int, any_of: dict[str, list[str]] | None = None, buffer: int = 0) -> DataFrame:
    """Cells (r, c) of the features (id and tags) that ``any_tag`` lets pass, inside the grid, widened by ``buffer`` cells; ``edges``: all their rings."""
    chosen = features.where(any_tag(any_of or {})).select("id").distinct()
    burned = rasterize_polygons(edges.join(chosen, "id", "left_semi"), cell).select("r", "c").distinct()
    burned = burned.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    return R.dilate(burned, buffer, height, width) if buffer else burned


def rasterize_polygons(edges: DataFrame, cell: float) -> DataFrame:
    """Scan-line burn of edges (id, ax, ay, bx, by) of all rings of a feature: holes come out by parity.

    Each edge gives a crossing for every row centre it spans; sorted crossings of a
    feature's row pair up; the columns between a pair are burned.
    """
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    first, last = F.ceil(low / cell - 0.5).cast("long"), (F.ceil(high / cell - 0.5) - 1).cast("long")
    rows = edges.where(first <= last).withColumn("r", F.explode(F.sequence(first, last)))
    y = (F.col("r") + 0.5) * cell
    rows = rows.withColumn("x", F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    order = Window.partitionBy("id", "r").orderBy("x")
    pairs = rows.select("id", "r", "x", F.lead("x").over(order).alias("x2"), F.row_number().over(order).alias("k")).where("k % 2 = 1 AND x2 IS NOT NULL")
    a, b = F.ceil(F.col("x") / cell - 0.5).cast("long"), (F.ceil(F.col("x2") / cell - 0.5) - 1).cast("long")
    return pairs.where(a <= b).select("id", "r", F.explode(F.sequence(a, b)).alias("c")).distinct()


def rasterize_lines(segments: DataFrame, half: int | Column, height: int | None = None, width: int | None = None) -> DataFrame:
    """Cells within ``half`` + 0.5 of a segment given in cell units (ax, ay, bx, by); ``half`` may be a column, a width for each feature.

    A row of cells meets a stroke in one interval, the hull of what its two round ends and its
    straight part meet there, so a segment emits the cells of its stroke and one beside each end,
    whatever its bounding box; the exact distance decides. With ``height`` and ``width``
    nothing outside the grid is emitted. Segments with a null end or width burn nothing.
    """
    half = F.lit(half) if isinstance(half, int) else half
    ax, ay, bx, by, reach = (F.col(c) for c in ("ax", "ay", "bx", "by", "_reach"))
    first, last = F.floor(F.least(ay, by) - reach), F.ceil(F.greatest(ay, by) + reach)
    if height is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(height - 1))
    rows = segments.select(*[F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")], (half + 0.5).alias("_reach")).withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long"))
    rows = rows.where("_first <= _last").withColumn("r", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    dx, dy = bx - ax, by - ay
    span = F.sqrt(dx * dx + dy * dy)

    def between(at: Column, rise: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """Where low <= at + rise * x <= high, as the least and greatest x; without rise everywhere or nowhere."""
        p, q = (low - at) / F.nullif(rise, F.lit(0.0)), (high - at) / F.nullif(rise, F.lit(0.0))
        held = at.between(low, high)
        ends = [F.when(rise != 0, pick(p, q)).when(held, F.lit(all_)).otherwise(F.lit(none)) for pick, all_, none in ((F.least, -1e18, 1e18), (F.greatest, 1e18, -1e18))]
        return ends[0], ends[1]

    up = F.col("r") - ay
    along = between(up * dy, dx, F.lit(0.0), span * span)
    beside = between(-up * dx, dy, -reach * span, reach * span)
    flat = (F.greatest(along[0], beside[0]), F.least(along[1], beside[1]))
    straight = (span > 0) & (flat[0] <= flat[1])
    lows, highs = [F.when(straight, ax + flat[0])], [F.when(straight, ax + flat[1])]
    for x, y in ((ax, ay), (bx, by)):
        left = reach * reach - (F.col("r") - y) * (F.col("r") - y)
        lows.append(F.when(left >= 0, x - F.sqrt(left)))
        highs.append(F.when(left >= 0, x + F.sqrt(left)))
    start, end = F.floor(F.least(*lows)) - 1, F.ceil(F.greatest(*highs)) + 1
    if width is not None:
        start, end = F.greatest(start, F.lit(0)), F.least(end, F.lit(width - 1))
    strokes = rows.withColumn("_start", start.cast("long")).withColumn("_end", end.cast("long")).where("_start <= _end")
    cells = strokes.withColumn("c", F.explode(F.sequence("_start", "_end")))
    return cells.where(point_segment(F.col("c"), F.col("r"), ax, ay, bx, by) <= reach).select("r", "c").distinct()


def flatten_roads(cells: DataFrame, roads: DataFrame, height: int, width: int, sigma: float = 1.0) -> DataFrame:
    """Heights under roads blended with their smoothed form, by the smoothed and widened road mask."""
    wide = R.dilate(roads, 1, height, width).withColumn("_on", F.lit(1.0))
    mask = cells.select("r", "c").join(wide, ["r", "c"], "left").select("r", "c", F.coalesce("_on", F.lit(0.0)).alias("b"))
    blend = R.gaussian(mask, sigma, height, width, "b")
    smooth = R.gaussian(cells.select("r", "c", "z"), sigma, height, width).withColumnRenamed("z", "s")
    b = F.least(F.greatest("b", F.lit(0.0)), F.lit(1.0))
    return cells.join(blend, ["r", "c"]).join(smooth, ["r", "c"]).select("r", "c", (F.col("z") * (1 - b) + F.col("s") * b).alias("z"))


def carve_all(cells: DataFrame, water: DataFrame, cell_m: float, height: int, width: int, ring: int = 0) -> DataFrame:
    """Beds of every water kind in order, later kinds win where they overlap; ``ring`` cells of shore are blended."""
    for kind, deepest, steepness in BEDS:
        mask = written(water.where(F.col("kind") == kind).select("r", "c").distinct(), "mask")
        if not mask.isEmpty():
            cells = written(R.carve_water(cells, mask, cell_m, deepest, steepness, height, width, ring), "carved")
    return cells


def water_masks(cells: DataFrame, areas: DataFrame, edges: DataFrame, lines: DataFrame, cell_m: float, height: int, width: int) -> DataFrame:
    """Cells of every water kind (kind, r, c) from features; a cell may have several.

    ``areas`` (id, natural, water_type) with all rings' ``edges`` (id, ax, ay, bx, by) give lakes,
    by either tag, and wetlands; segments ``lines`` (water_type, ax, ay, bx, by) give rivers as wide as
    their type, one cell to each side at least, and the coast, from which the sea is flooded over
    low cells. All in cell units, rows from the north. Other and null types give nothing.
    """
    type_ = F.col("water_type")
    half = F.greatest(F.bround(looked_up(type_, RIVER_WIDTHS) / (2.0 * cell_m), 0).cast("int"), F.lit(1))
    rivers = rasterize_lines(lines.where(type_.isin(*RIVER_WIDTHS)), half, height, width)
    coast = rasterize_lines(lines.where(type_ == "coastline"), 0, height, width)
    masks = {
        "river": rivers,
        "wetland": burn_areas(areas, edges, 1.0, height, width, {"water_type": ["wetland"]}),
        "sea": R.sea_cells(cells, coast, height, width),
        "lake": burn_areas(areas, edges, 1.0, height, width, {"natural": ["water"], "water_type": list(LAKES)}),
    }
    every = [m.select(F.lit(k).alias("kind"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")) for k, m in masks.items()]
    return written(reduce(DataFrame.unionByName, every), "water")


def carve_features(cells: DataFrame, areas: DataFrame, edges: DataFrame, lines: DataFrame, cell_m: float, height: int, width: int, ring: int = 3) -> DataFrame:
    """Beds of rivers, wetlands, the sea and lakes from their features (see ``water_masks``), with blended shores."""
    return carve_all(cells, water_masks(cells, areas, edges, lines, cell_m, height, width), cell_m, height, width, ring)


def surface_weights(cells: DataFrame, masks: DataFrame, cell_m: float, line: float) -> DataFrame:
    """Rock from slope and treeline, forests below it, the other surfaces by their factor; grass takes the rest."""
    rock = R.slope(cells, cell_m).join(cells, ["r", "c"]).select(
        "r", "c", F.greatest(R.slope_ramp(F.col("slope")), R.above_treeline(F.col("z"), F.lit(line))).alias("rock"), R.above_treeline(F.col("z"), F.lit(line)).alias("_high")
    )
    factor = {"asphalt": 1.0, "gravel": 0.8, "crop": 0.7, "dirt": 1.0}
    on = masks.groupBy("r", "c").agg(*[F.max((F.col("surface") == s).cast("double")).alias(s) for s in (*factor, "forest_floor", "water")])
    wide = rock.join(on, ["r", "c"], "left")
    got = [(F.coalesce(s, F.lit(0.0)) * f).alias(s) for s, f in factor.items()]
    forest = (F.coalesce("forest_floor", F.lit(0.0)) * (1 - F.col("_high"))).alias("forest_floor")
    wet = (F.coalesce("water", F.lit(0.0)) > 0).alias("water")
    return R.normalize_weights(wide.select("r", "c", "rock", *got, forest, wet), ["rock", *factor, "forest_floor"])


def mosaic(tiles: DataFrame, west: float, south: float, cell: float, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Cells (tile_id, x, y, z) snapped to one grid; of cells at one place the first tile's counts, empty ones only where there is no other.

    With ``rows`` and ``cols`` the grid is cropped to that size and keeps its empty cells; without, they go.
    """
    placed = tiles.select(F.floor((F.col("y") - south) / cell).cast("long").alias("r"), F.floor((F.col("x") - west) / cell).cast("long").alias("c"), "tile_id", "z")
    if rows is None or cols is None:
        placed = placed.where("z IS NOT NULL")
    else:
        placed = placed.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1))
    return placed.groupBy("r", "c").agg(F.min_by("z", F.struct(F.col("z").isNull().alias("empty"), "tile_id", "z")).alias("z"))


def tile_windows(tiles: DataFrame, west: float, south: float, cell: float, width: int, height: int) -> DataFrame:
    """Each tile's window in target cells; tiles that miss the target are left out."""
    low = {"c0": ("xmin", west), "r0": ("ymin", south)}
    high = {"c1": ("xmax", west, width), "r1": ("ymax", south, height)}
    cols = [F.greatest(F.floor((F.col(c) - o) / cell), F.lit(0)).cast("long").alias(n) for n, (c, o) in low.items()]
    cols += [F.least(F.ceil((F.col(c) - o) / cell), F.lit(m)).cast("long").alias(n) for n, (c, o, m) in high.items()]
    return tiles.select("tile_id", *cols).where("c0 < c1 AND r0 < r1")


def terrain(cells: DataFrame, roads: DataFrame, water: DataFrame, cell_m: float, height: int, width: int) -> DataFrame:
    """The height map: flatten under roads, carve water, smooth, move the lowest land to zero, quantise."""
    from .coverage import land_datum

    flat = written(flatten_roads(cells, roads, height, width), "flat")
    smooth = written(R.gaussian(carve_all(flat, water, cell_m, height, width), 0.5, height, width), "smooth")
    datum = land_datum(smooth, water.select("r", "c").distinct())
    level = smooth.crossJoin(F.broadcast(datum)).select("r", "c", (F.col("z") - F.col("datum")).alias("z"))
    return R.quantize(level)


def run_summary(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """One JSON row: features by category and the elevation range."""
    by = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("features"))
    span = cells.agg(F.count("*").alias("cells"), F.min("z").alias("low"), F.max("z").alias("high"))
    return by.crossJoin(span).select(F.to_json(F.struct("features", "cells", "low", "high")).alias("summary"))


def reproject(cells: DataFrame, targets: DataFrame, cell_m: float, east0: float, north0: float, central: float) -> DataFrame:
    """Bilinear values at geographic targets (r, c, lon, lat) from a projected grid (r from the south, c, z).

    Every target is projected, joins its two by two source cells by key and sums them by weight.
    """
    at = targets.withColumn("_p", project_tm(F.col("lon"), F.col("lat"), central))
    at = at.select("r", "c", ((F.col("_p.x") - east0) / cell_m).alias("_x"), ((F.col("_p.y") - north0) / cell_m).alias("_y"))
    near = at.withColumn("_dy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_dx", F.explode(F.array(F.lit(0), F.lit(1))))
    sy, sx = F.floor("_y") + F.col("_dy"), F.floor("_x") + F.col("_dx")
    weight = (1 - F.abs(F.col("_y") - sy)) * (1 - F.abs(F.col("_x") - sx))
    near = near.select("r", "c", sy.cast("long").alias("_r"), sx.cast("long").alias("_c"), weight.alias("_w")).where("_w > 0")
    source = cells.select(F.col("r").cast("long").alias("_r"), F.col("c").cast("long").alias("_c"), "z")
    return near.join(source, ["_r", "_c"]).groupBy("r", "c").agg((F.sum(F.col("z") * F.col("_w")) / F.sum("_w")).alias("z"))


def mosaic_grid(tiles: DataFrame) -> DataFrame:
    """One row: the coarsest resolution, bounds snapped outward to its multiples, the size; tiles under three bands are skipped."""
    used = tiles.where("bands >= 3")
    span = used.agg(F.max(F.greatest("dx", "dy")).alias("cell"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.count("*").alias("tiles"))
    low, high = (lambda c: F.floor(F.col(c) / F.col("cell")).cast("long")), (lambda c: F.ceil(F.col(c) / F.col("cell")).cast("long"))
    total = tiles.agg(F.count("*").alias("all"))
    lost = F.col("all") - F.col("tiles")
    return span.crossJoin(total).select(
        "cell", low("xmin").alias("c0"), low("ymin").alias("r0"), (high("xmax") - low("xmin")).alias("width"), (high("ymax") - low("ymin")).alias("height"),
        (lost > F.greatest(F.lit(1), F.floor(F.col("all") / 3))).alias("failed"),
    )
