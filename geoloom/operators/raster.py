"""Raster operators on cell tables (r, c, value): windows along rows and columns, offset equi-joins, grouped sums.

Rows are counted from the north. Cells that are missing are no data. ``by`` names extra
key columns, so many grids go through one plan.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .staging import numbered, shuffled, written

Keys = tuple[str, ...]


def along(axis: str, by: Keys = ()):
    """A window along a row (axis ``c``) or a column (axis ``r``)."""
    return Window.partitionBy(*by, "r" if axis == "c" else "c").orderBy(axis)


def both_ways(column: str, by: Keys = ()):
    """Windows down and up a column. A frame that grows takes time linear in the column; one that ends at its end is run anew for each row."""
    keys = Window.partitionBy(*by, column)
    return keys.orderBy("r"), keys.orderBy(F.desc("r"))


def neighbour(value: str, axis: str, step: int, by: Keys = ()) -> Column:
    """The value ``step`` cells along an axis, null where that cell is missing."""
    return F.first(value).over(along(axis, by).rangeBetween(step, step))


def slope(cells: DataFrame, cell_m: float, value: str = "z", by: Keys = ()) -> DataFrame:
    """Degrees of slope: central differences, one-sided beside missing cells."""

    def gradient(axis: str) -> Column:
        before, after = neighbour(value, axis, -1, by), neighbour(value, axis, 1, by)
        one = F.coalesce(after - F.col(value), F.col(value) - before, F.lit(0.0)) / cell_m
        return F.coalesce((after - before) / (2 * cell_m), one)

    gx, gy = gradient("c"), gradient("r")
    return cells.select(*by, "r", "c", gx.alias("_x"), gy.alias("_y")).select(
        *by, "r", "c", F.degrees(F.atan(F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))).alias("slope")
    )


def slope_ramp(degrees: Column, start: float = 25.0, full: float = 40.0) -> Column:
    """0 below ``start``, 1 from ``full`` on, linear between; a step where they meet."""
    if full <= start:
        return (degrees >= start).cast("double")
    return F.least(F.greatest((degrees - start) / (full - start), F.lit(0.0)), F.lit(1.0))


def above_treeline(z: Column, line: Column, over: float = 200.0) -> Column:
    return F.least(F.greatest((z - line) / over, F.lit(0.0)), F.lit(1.0))


def dilate(mask: DataFrame, n: int, height: int, width: int, by: Keys = ()) -> DataFrame:
    """Cells within ``n`` steps (north, south, east, west) of the mask, inside the grid."""
    spread = mask.withColumn("_d", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    spread = spread.withColumn("_e", F.explode(F.sequence(F.abs("_d") - n, n - F.abs("_d"))))
    moved = spread.select(*by, (F.col("r") + F.col("_d")).alias("r"), (F.col("c") + F.col("_e")).alias("c"))
    return moved.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).distinct()


def gaussian(cells: DataFrame, sigma: float, height: int, width: int, value: str = "z", by: Keys = ()) -> DataFrame:
    """Separable Gaussian with radius int(4 sigma + 0.5) and mirrored borders.

    Each pass sends a cell's weighted value to the cells in reach and sums there; borders
    send from their mirrored places too. Two passes of 2 radius + 1, never a square; cells are
    shuffled once a pass by their line, what they send is summed in place.
    """
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    table = F.array(*[F.lit(w / sum(weights)) for w in weights])

    def one_pass(df: DataFrame, axis: str, size: int) -> DataFrame:
        other = "c" if axis == "r" else "r"
        place = F.explode(F.array(F.col(axis), -1 - F.col(axis), 2 * size - 1 - F.col(axis)))
        sent = df.repartition(*by, other).select(*by, other, value, place.alias("_p")).where(F.col("_p").between(-radius, size - 1 + radius))
        low, high = F.greatest(F.col("_p") - radius, F.lit(0)), F.least(F.col("_p") + radius, F.lit(size - 1))
        got = sent.where(low <= high).withColumn(axis, F.explode(F.sequence(low, high)))
        share = F.col(value) * F.get(table, (F.col(axis) - F.col("_p") + radius).cast("int"))
        return got.groupBy(*by, other, axis).agg(F.sum(share).alias(value))

    return one_pass(one_pass(cells, "r", height), "c", width).select(*by, "r", "c", value)


def by_tiles(cells: DataFrame, reach: int, work, schema: str, tile: int = 256) -> DataFrame:
    """``work(pdf, rows, cols)`` on square tiles of the grid; a tile gets its own cells and all within ``reach`` steps of it.

    ``rows`` and ``cols`` are the numbers of the tile's window, with the ``reach`` around it. One shuffle; cells near a border go to both tiles.
    """
    tile = max(tile, 2 * reach)

    def tiles(axis: str) -> Column:
        return F.explode(F.sequence(*[F.floor((F.col(axis) + k) / tile) for k in (-reach, reach)]))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return work(pdf, *[np.arange(k * tile - reach, (k + 1) * tile + reach) for k in key])

    return cells.withColumn("_ty", tiles("r")).withColumn("_tx", tiles("c")).groupBy("_ty", "_tx").applyInPandas(one, schema)


def shifted(plane: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """At each place the value ``dy`` rows and ``dx`` columns on; 0 beyond the window."""
    out = np.zeros_like(plane)
    h, w = plane.shape
    out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def window_slope(z: np.ndarray, cell_m: float) -> np.ndarray:
    """``slope`` of a window's heights (NaN: none)."""
    known, high = ~np.isnan(z), np.nan_to_num(z)

    def gradient(dy: int, dx: int) -> np.ndarray:
        (b, has_b), (a, has_a) = ((shifted(high, k * dy, k * dx), shifted(known, k * dy, k * dx)) for k in (-1, 1))
        return np.select([has_a & has_b, has_a & known, has_b & known], [(a - b) / (2 * cell_m), (a - high) / cell_m, (high - b) / cell_m], 0.0)

    return np.degrees(np.arctan(np.hypot(gradient(0, 1), gradient(1, 0))))


def window_gaussian(plane: np.ndarray, rows: np.ndarray, cols: np.ndarray, sigma: float, height: int, width: int) -> np.ndarray:
    """``gaussian`` of a window (0: no cell), right for places int(4 sigma + 0.5) and more steps inside it."""
    radius = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    for axis, at, size in ((0, rows, height), (1, cols, width)):
        mirrored = np.where(at < 0, -1 - at, np.where(at >= size, 2 * size - 1 - at, at))
        held = (mirrored >= 0) & (mirrored < size) & (mirrored >= at[0]) & (mirrored <= at[-1])
        lines = np.moveaxis(plane, axis, 0)
        full = np.where(held[:, None], lines[np.where(held, mirrored - at[0], 0)], 0.0)
        done = np.zeros_like(full)
        inner = len(at) - 2 * radius
        for k, w in enumerate(weights / weights.sum()):
            done[radius : radius + inner] += w * full[k : k + inner]
        plane = np.moveaxis(done, 0, axis)
    return plane


def window_edge(mask: np.ndarray, real: np.ndarray, t: int) -> np.ndarray:
    """``soft_edge`` of a mask by its ``distance_transform``, right for places ``t`` and more steps inside the window.

    Only other cells nearer than ``t`` count, since from there on the edge is 1.
    """
    out = mask.astype(float)
    if mask.any():
        back = real & ~mask
        near = [(math.sqrt(y * y + x * x) / t, y, x) for y in range(-t, t + 1) for x in range(-t, t + 1) if 0 < y * y + x * x < t * t]
        for share, y, x in sorted(near, reverse=True):
            out[shifted(back, y, x) & mask] = share
    return out


def window_dilate(mask: np.ndarray, n: int) -> np.ndarray:
    """``dilate`` of a window, right for places ``n`` and more steps inside it."""
    for _ in range(n):
        mask = mask | shifted(mask, 0, 1) | shifted(mask, 0, -1) | shifted(mask, 1, 0) | shifted(mask, -1, 0)
    return mask


def row_starts(pdf: pd.DataFrame, keys: list[str]) -> list[int]:
    """Where the rows of a sorted frame begin, and its end."""
    values = pdf[keys]
    new = (values.iloc[1:].to_numpy() != values.iloc[:-1].to_numpy()).any(axis=1) if len(pdf) else np.zeros(0, bool)
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(pdf)] if len(pdf) else [0]


def whole_rows(frames, keys: list[str]):
    """Frames of whole grid rows from sorted frames that may part one: the last row waits for the next frame."""
    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        at = row_starts(pdf, keys)[-2]
        held = pdf.iloc[at:].reset_index(drop=True)
        if at:
            yield pdf.iloc[:at].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def distance_transform(grid: DataFrame, by: Keys = ()) -> DataFrame:
    """``grid`` (r, c, mask boolean; every cell) with ``distance`` of mask cells to the nearest other cell.

    Along columns, windows find the nearest background above and below; along rows, each
    row takes the lower envelope of the parabolas that the columns left. Exact and
    unbounded; tasks stream whole rows. Without background the distance is null.
    """
    back = F.when(~F.col("mask"), F.col("r"))
    above, below = (F.last(back, True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in both_ways("c", by))
    gap = F.least(F.col("r") - above, below - F.col("r")).cast("double")

    def row(c, f):
        """Distances along one row, from the columns' gaps (NaN: none)."""
        seen = np.flatnonzero(~np.isnan(f))
        if not len(seen):
            return np.full(len(c), np.nan)
        hull, cuts = [], []
        height = (f**2 + c**2).tolist()
        for k in seen.tolist():
            while hull:
                j = hull[-1]
                x = (height[k] - height[j]) / (2 * (c[k] - c[j]))
                if cuts and x <= cuts[-1]:
                    hull.pop()
                    cuts.pop()
                    continue
                cuts.append(x)
                break
            hull.append(k)
        owner = np.array(hull)[np.searchsorted(np.array(cuts), c, side="left")]
        return np.sqrt((c - c[owner]) ** 2 + f[owner] ** 2)

    def work(frames):
        for pdf in whole_rows(frames, [*by, "r"]):
            c, f = pdf["c"].to_numpy(float), pdf["_gap"].to_numpy(float)
            cuts = row_starts(pdf, [*by, "r"])
            out = [row(c[a:b], f[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pdf.drop(columns="_gap").assign(distance=np.concatenate(out))

    kinds = dict(grid.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in (*by, "r", "c")), "mask boolean, distance double"])
    marked = grid.select(*by, "r", "c", "mask", gap.alias("_gap"))
    found = marked.repartition(*by, "r").sortWithinPartitions(*by, "r", "c").mapInPandas(work, schema)
    return found.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def soft_edge(distance: Column, t: float, mask: Column) -> Column:
    """Distance over ``t`` clipped to 0..1; the mask itself for t <= 0 or without background."""
    hard = mask.cast("double")
    return hard if t <= 0 else F.coalesce(F.least(F.greatest(distance / t, F.lit(0.0)), F.lit(1.0)), hard)


def vertex_to_face(cells: DataFrame, value: str = "z", by: Keys = ()) -> DataFrame:
    """Mean of the four corners of every face: one row and one column fewer."""
    east = F.first(value).over(along("c", by).rangeBetween(1, 1))
    pair = cells.withColumn("_e", east).where(F.col("_e").isNotNull())
    pair = pair.select(*by, "r", "c", (F.col(value) + F.col("_e")).alias("_s"))
    south = F.first("_s").over(along("r", by).rangeBetween(1, 1))
    return pair.withColumn("_t", south).where(F.col("_t").isNotNull()).select(*by, "r", "c", ((F.col("_s") + F.col("_t")) / 4).alias(value))


def resample(cells: DataFrame, height: int, width: int, new_height: int, new_width: int, value: str = "z", cubic: bool = False) -> DataFrame:
    """Resampling to an exact size: every target cell takes its two by two source cells (cubic: four by four) by weight.

    ``cubic`` weighs by Keys' kernel; sources beyond the border are those at it. Weights are products, so rows
    and columns are summed one after the other: each pass shuffles cells by their line, a row for each, and
    what a cell sends to the targets in reach is summed in place.
    """
    low, high = (-1, 2) if cubic else (0, 1)

    def kernel(d: Column) -> Column:
        if not cubic:
            return 1 - d
        return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)

    def one_pass(df: DataFrame, axis: str, size: int, new: int) -> DataFrame:
        other, scale = "c" if axis == "r" else "r", float(size - 1) / max(1, new - 1)
        first, last = F.when(F.col(axis) == 0, F.lit(low)).otherwise(F.col(axis)), F.when(F.col(axis) == size - 1, F.lit(size - 1 + high)).otherwise(F.col(axis))
        sent = df.repartition(other).withColumn("_p", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
        ends = F.lit(0), F.lit(new - 1)
        if scale:
            ends = F.greatest(F.floor((F.col("_p") - high) / scale) - 1, ends[0]), F.least(F.ceil((F.col("_p") - low + 1) / scale) + 1, ends[1])
        at = F.col("_t") * scale
        got = sent.where(ends[0] <= ends[1]).withColumn("_t", F.explode(F.sequence(*[e.cast("long") for e in ends])))
        got = got.where((F.col("_p") - F.floor(at)).between(low, high)).withColumn("_k", kernel(F.abs(at - F.col("_p")))).where("_k <> 0")
        return got.groupBy(other, F.col("_t").alias(axis)).agg(F.sum(F.col("_v") * F.col("_k")).alias("_v"), F.sum(F.col("_w") * F.col("_k")).alias("_w"))

    own = cells.where(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    own = own.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).alias("_v"), F.lit(1.0).alias("_w"))
    return one_pass(one_pass(own, "r", height, new_height), "c", width, new_width).select("r", "c", (F.col("_v") / F.col("_w")).alias(value))


def tile_labels(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each of some cells the index of the first cell, by row and column, of its 4-connected region among them."""
    wide = int(c.max()) - int(c.min()) + 2
    keys, at, copy = np.unique((r - r.min()) * wide + (c - c.min()), return_index=True, return_inverse=True)
    r, c, place = r[at], c[at], np.arange(len(keys))
    beside = np.flatnonzero((np.diff(c) == 1) & (np.diff(r) == 0))
    under = np.minimum(np.searchsorted(keys, keys + wide), len(keys) - 1)
    down = np.flatnonzero(keys[under] == keys + wide)
    # a run's cells start at its first cell, so links join runs
    head = np.ones(len(keys), bool)
    head[beside + 1] = False
    label = np.maximum.accumulate(np.where(head, place, 0))
    a, b = label[down], label[under[down]]
    while True:
        p, q = label[a], label[b]
        if (p == q).all():
            break
        low, high = np.minimum(p, q), np.maximum(p, q)
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return at[label][copy]


def label_regions(mask: DataFrame, tile: int = 256) -> DataFrame:
    """4-connected regions of mask cells: r, c, region (the smallest run number, that of the region's first cell).

    Each square tile of the grid labels its own cells; only cells along the tiles' borders
    link labels, so the graph that the rounds rewrite has a few nodes for each tile, however
    long and winding a region is. Cells without a place are in no region.
    """
    kinds = dict(mask.dtypes)
    placed = mask.where("r IS NOT NULL AND c IS NOT NULL").select("r", "c")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["r"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64)
        first = tile_labels(r, c)
        return pdf[["r", "c"]].assign(node=r[first] * (1 << 31) + c[first])

    keyed = placed.withColumn("_y", F.floor(F.col("r") / tile)).withColumn("_x", F.floor(F.col("c") / tile))
    cells = written(keyed.groupBy("_y", "_x").applyInPandas(work, f"r {kinds['r']}, c {kinds['c']}, node long"), "tiles")
    links = None
    for axis in ("r", "c"):
        last = cells.where(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).select("r", "c", F.col("node").alias("a"))
        first = cells.where(F.pmod(F.col(axis), F.lit(tile)) == 0).withColumn(axis, F.col(axis) - 1).select("r", "c", F.col("node").alias("b"))
        met = last.join(first, ["r", "c"]).select("a", "b")
        links = met if links is None else links.unionByName(met)
    found = components(links.distinct()).withColumnRenamed("node", "_node")
    return cells.join(found, cells["node"] == found["_node"], "left").select("r", "c", F.coalesce("component", "node").alias("region"))


def flood_from(seeds: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of the mask's regions that hold a seed."""
    regions = label_regions(mask)
    hit = regions.join(seeds.select("r", "c").distinct(), ["r", "c"], "left_semi").select("region").distinct()
    return regions.join(hit, "region", "left_semi").select("r", "c")


def sea_cells(cells: DataFrame, coast: DataFrame, height: int, width: int, level: float = 0.5, near: int = 50) -> DataFrame:
    """Cells of the sea: low cells (z up to ``level``) joined to low cells of the grid's border within ``near`` steps of the coast.

    Where the coast reaches no low border cell, all low border cells start; without a coast there is
    no sea. A coast cell marks an interval on each border in reach, so no area is spread. Empty
    heights are not low.
    """
    low = cells.where(F.col("z") <= level).select("r", "c")
    border = low.where(F.col("r").isin(0, height - 1) | F.col("c").isin(0, width - 1))
    reached = None
    for axis, other, size, across in (("r", "c", height, width), ("c", "r", width, height)):
        for side in (0, size - 1):
            left = near - F.abs(F.col(axis) - side)
            ends = F.greatest(F.col(other) - left, F.lit(0)), F.least(F.col(other) + left, F.lit(across - 1))
            close = coast.where(left >= 0).withColumn("_o", F.explode(F.sequence(*[e.cast("long") for e in ends])))
            rows = close.select(F.lit(side).cast("long").alias(axis), F.col("_o").alias(other)).select("r", "c")
            reached = rows if reached is None else reached.unionByName(rows)
    marked = border.join(reached.distinct().withColumn("_near", F.lit(True)), ["r", "c"], "left")
    found = marked.agg(F.coalesce(F.bool_or("_near"), F.lit(False)).alias("_some"))
    shores = coast.agg((F.count("*") > 0).alias("_coast"))  # one row each
    seeds = marked.crossJoin(F.broadcast(found)).crossJoin(F.broadcast(shores)).where("_coast AND (_near OR NOT _some)")
    return flood_from(seeds, low)


def region_levels(own: DataFrame, part: float = 0.1, value: str = "z") -> DataFrame:
    """Each region's quantile (linear between ranks): region, level. Ranks come from a sort over all tasks, so a sea is no single task's."""
    ranked = numbered(own.select("region", value), ["region"], [value], "_k", 0)
    sizes = own.groupBy("region").agg(((F.count("*") - 1) * part).alias("_at"))
    near = ranked.join(sizes, "region").where((F.col("_k") >= F.floor("_at")) & (F.col("_k") <= F.ceil("_at")))
    share = F.when(F.floor("_at") == F.ceil("_at"), 1.0).otherwise(1 - F.abs(F.col("_k") - F.col("_at")))
    return near.groupBy("region").agg(F.sum(F.col(value) * share).alias("level"))


def carve_water(
    cells: DataFrame, mask: DataFrame, cell_m: float, ceiling: float, steepness: float, height: int, width: int, ring: int = 0, ceilings: DataFrame | None = None
) -> DataFrame:
    """Beds of water regions: the region's 10th percentile minus a depth that grows from the shore.

    The greatest depth is the ceiling (a region's own, where ``ceilings``, region and
    ceiling, has one), or what the steepness allows at the point farthest from the shore.
    With ``ring``, land within so many cells of water is blended towards the water surface,
    not the bed, by the smoothed mask.
    """
    regions = written(label_regions(mask), "regions")
    marks = mask.select("r", "c", F.lit(True).alias("mask"))
    grid = cells.select("r", "c").join(marks, ["r", "c"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))
    far = distance_transform(grid).where("mask").select("r", "c", F.coalesce("distance", F.lit(1.0)).alias("d"))
    own = written(regions.join(cells, ["r", "c"]).join(far, ["r", "c"]), "own")
    shape = own.groupBy("region").agg(F.max("d").alias("most")).join(region_levels(own), "region")
    top = F.lit(ceiling)
    if ceilings is not None:
        shape = shape.join(ceilings.select("region", F.col("ceiling").alias("_top")), "region", "left")
        top = F.coalesce("_top", top)
    depth = F.least(top, F.col("most") * cell_m * steepness)
    bed = own.join(shape, "region").select("r", "c", (F.col("level") - depth * F.col("d") / F.col("most")).alias("_bed"), "level")
    if not ring:
        return cells.join(bed, ["r", "c"], "left").select("r", "c", F.coalesce("_bed", "z").alias("z"))
    wet = cells.join(written(bed, "bed"), ["r", "c"], "left").select("r", "c", "z", "_bed", F.coalesce("level", "z").alias("_surface"), F.col("_bed").isNotNull().cast("double").alias("_wet"))
    blend = gaussian(wet.select("r", "c", "_wet"), float(ring), height, width, "_wet").withColumnRenamed("_wet", "_b")
    smooth = gaussian(wet.select("r", "c", "_surface"), float(ring), height, width, "_surface").withColumnRenamed("_surface", "_s")
    shore = dilate(mask, ring, height, width).join(mask, ["r", "c"], "left_anti").withColumn("_shore", F.lit(True))
    rows = wet.join(blend, ["r", "c"]).join(smooth, ["r", "c"]).join(shore, ["r", "c"], "left")
    b = F.least(F.greatest("_b", F.lit(0.0)), F.lit(1.0))
    z = F.when(F.col("_shore"), F.col("z") * (1 - b) + F.col("_s") * b).otherwise(F.coalesce("_bed", "z"))
    return rows.select("r", "c", z.alias("z"))


def nearest_sources(c: np.ndarray, gap: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each cell of a row the index of the column whose source is nearest (-1: there is none); ties by the source's row, then column.

    ``c``: whole column numbers in order, ``gap``: rows between the cell and its column's
    source (NaN: none), ``row``: that source's row. The lower envelope of the columns' parabolas
    takes time linear in the row; parabolas that only touch it stay, since they tie there.
    """
    seen = np.flatnonzero(~np.isnan(gap))
    if not len(seen):
        return np.full(len(c), -1)
    hull, cuts = [], []
    height, at = (gap**2 + c**2).tolist(), c.tolist()
    for k in seen.tolist():
        while hull:
            j = hull[-1]
            x = (height[k] - height[j]) / (2 * (at[k] - at[j]))
            if not cuts or x >= cuts[-1]:
                cuts.append(x)
                break
            hull.pop()
            cuts.pop()
        hull.append(k)
    first, last = np.searchsorted(cuts, c, side="left"), np.searchsorted(cuts, c, side="right")
    owner = np.array(hull)[first]
    for x in np.flatnonzero(first < last).tolist():
        owner[x] = min(hull[first[x] : last[x] + 1], key=lambda k: (row[k], at[k]))
    return owner


def fill_nodata(cells: DataFrame, value: str = "z") -> DataFrame:
    """Null (or NaN) cells take the value of the nearest valid one; ties by row, then column.

    Along columns windows find the nearest valid cells above and below, also for places that
    have no cell; along rows the lower envelope of the nearer ones tells the best: tasks stream
    whole rows, each in time linear in its width. A grid without valid cells stays empty.
    """
    window, back = both_ways("c")
    up, (down, after) = window.rowsBetween(Window.unboundedPreceding, 0), (back.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    own = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    kinds = dict(cells.dtypes)
    span = cells.agg(F.min("r").alias("_top"), F.max("r").alias("_bottom"))  # one row
    source = F.when(F.col(value).isNotNull(), F.struct(F.col("r").cast("double").alias("r"), F.col(value).alias("v")))
    seen = cells.select("r", "c", own.alias(value)).select(
        "r", "c", F.last(source, True).over(up).alias("_up"), F.last(source, True).over(down).alias("_down"), F.last(source, True).over(after).alias("_after"),
        F.lag("r").over(window).alias("_before"), F.lead("r").over(window).alias("_next"),
    )
    places = F.sequence(F.when(F.col("_before").isNull(), F.col("_top")).otherwise(F.col("r")), F.coalesce(F.col("_next") - 1, F.col("_bottom")))
    every = seen.crossJoin(F.broadcast(span)).withColumn("_at", F.explode(places))
    above, below = F.when(F.col("_at") >= F.col("r"), F.col("_up")), F.when(F.col("_at") > F.col("r"), F.col("_after")).otherwise(F.col("_down"))
    best = F.when(above.isNull() | (below["r"] - F.col("_at") < F.col("_at") - above["r"]), below).otherwise(above)  # the smaller row where both are as near
    marked = every.select(F.col("_at").alias("r"), "c", (F.col("_at") == F.col("r")).alias("_real"), best.alias("_s")).select("r", "c", "_real", "_s.r", "_s.v").toDF("r", "c", "_real", "_row", "_best")

    def work(frames):
        for pdf in whole_rows(frames, ["r"]):
            r, c, row, best, real = (pdf[k].to_numpy(t) for k, t in (("r", float), ("c", float), ("_row", float), ("_best", float), ("_real", bool)))
            out, cuts = [], row_starts(pdf, ["r"])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                owner = nearest_sources(c[a:b], np.abs(r[a:b] - row[a:b]), row[a:b])
                out.append(np.where(owner < 0, np.nan, best[a:b][owner]))
            yield pdf[["r", "c"]].assign(**{value: np.concatenate(out)})[real]

    found = marked.repartition("r").sortWithinPartitions("r", "c").mapInPandas(work, f"r {kinds['r']}, c {kinds['c']}, {value} double")
    return found.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def quantize(cells: DataFrame, value: str = "z") -> DataFrame:
    """16-bit codes over the grid's range (0.01 at least); the range is one broadcast row."""
    span = cells.agg(F.min(value).alias("_low"), F.greatest(F.max(value) - F.min(value), F.lit(0.01)).alias("_span"))
    code = ((F.col(value) - F.col("_low")) / F.col("_span") * 65535).cast("int")
    return cells.crossJoin(F.broadcast(span)).select("r", "c", code.alias("code"), F.floor(code / 256).cast("int").alias("preview"))


def mask_bytes(weight: Column) -> Column:
    """A weight from 0 to 1 as a byte, cut to a whole number; beyond the ends: 0 or 255."""
    return F.least(F.greatest(weight * 255, F.lit(0.0)), F.lit(255.0)).cast("int")


def height_range(cells: DataFrame, value: str = "z") -> DataFrame:
    """One row: the lowest value and the scale of a 16-bit code."""
    span = F.greatest(F.max(value) - F.min(value), F.lit(0.01))
    return cells.agg(F.min(value).alias("low"), (span / 65535).alias("scale"))


def normalize_weights(wide: DataFrame, surfaces: list[str]) -> DataFrame:
    """Weights 0 on water, scaled to 1 where they exceed it; grass takes the rest on land."""
    total = sum((F.col(s) for s in surfaces[1:]), F.col(surfaces[0]))
    scaled = [F.when(F.col("water"), 0.0).when(total > 1, F.col(s) / total).otherwise(F.col(s)).alias(s) for s in surfaces]
    out = wide.select("r", "c", "water", *scaled)
    rest = F.when(F.col("water"), 0.0).otherwise(F.greatest(1 - sum((F.col(s) for s in surfaces[1:]), F.col(surfaces[0])), F.lit(0.0)))
    return out.withColumn("grass", rest)


# Colour of each surface in the preview.
COLOURS = {
    "grass": (80, 120, 50), "rock": (130, 130, 130), "forest_floor": (40, 80, 30), "asphalt": (60, 60, 60), "gravel": (160, 150, 130),
}


def preview_rgb(wide: DataFrame) -> DataFrame:
    """Colours blended by weight, cut to whole numbers."""
    mixed = [sum((F.col(s) * float(rgb[k]) for s, rgb in COLOURS.items()), F.lit(0.0)) for k in range(3)]
    return wide.select("r", "c", *[F.least(F.lit(255), F.floor(m).cast("int")).alias(n) for m, n in zip(mixed, ("red", "green", "blue"), strict=True)])


def newest_first(pixels: DataFrame) -> DataFrame:
    """The first pixel that is not empty, newest tile first, then by tile id."""
    seen = pixels.where("red + green + blue > 0")
    return seen.groupBy("r", "c").agg(
        F.max_by(F.struct("tile_id", "red", "green", "blue"), F.struct("acquired_at", -F.col("tile_id"))).alias("p")
    ).select("r", "c", "p.*")


def sample_raster(points: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """Height of each local point (x, z in 0..1) from its truncated cell, row 0 in the north; one equi-join."""
    col_ = F.least(F.greatest((F.col("u") * (width - 1)).cast("long"), F.lit(0)), F.lit(width - 1))
    row = height - 1 - F.least(F.greatest((F.col("v") * (height - 1)).cast("long"), F.lit(0)), F.lit(height - 1))
    return points.withColumn("c", col_).withColumn("r", row).join(shuffled(cells), ["r", "c"], "left").drop("r", "c").withColumn("z", F.round("z", 3))
