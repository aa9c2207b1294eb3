"""Spatial joins on grid-cell keys: each side emits its cells, an equi-join pairs them, an exact test decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dist_equirect, point_segment
from .staging import drop_stages, stage

#: Rounds of segments near points: parts told apart by hash, segments of the first round, growth of the rounds.
PARTS, FIRST, GROWTH = 1 << 20, 4000, 16
#: Narrow cells in a side of a wide one; cells that are broadcast at most.
FAN, FEW_CELLS = 8, 500_000


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def box_cells(boxes: DataFrame, size: float, west="xmin", south="ymin", east="xmax", north="ymax") -> DataFrame:
    """A row for each cell that a box touches."""
    across = F.explode(F.sequence(cell(F.col(west), size), cell(F.col(east), size)))
    up = F.explode(F.sequence(cell(F.col(south), size), cell(F.col(north), size)))
    return boxes.withColumn("cx", across).withColumn("cy", up)


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, reach: float = 0.25) -> DataFrame:
    """The containing box of each point (smallest code on ties), else the nearest within ``reach`` degrees, else null.

    Boxes are spread over cells with their reach, so one equi-join finds both.
    """
    wide = boxes.selectExpr("code", "xmin", "ymin", "xmax", "ymax", f"xmin - {reach} AS x0", f"ymin - {reach} AS y0", f"xmax + {reach} AS x1", f"ymax + {reach} AS y1")
    cells = box_cells(wide, size, "x0", "y0", "x1", "y1")
    keyed = points.withColumn("cx", cell(F.col("lon"), size)).withColumn("cy", cell(F.col("lat"), size))
    dx = F.greatest(F.col("xmin") - F.col("lon"), F.lit(0.0), F.col("lon") - F.col("xmax"))
    dy = F.greatest(F.col("ymin") - F.col("lat"), F.lit(0.0), F.col("lat") - F.col("ymax"))
    near = keyed.join(cells, ["cx", "cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach)
    best = near.groupBy("id").agg(F.min_by("code", F.struct("d", "code")).alias("code"))
    return points.join(best, "id", "left")


def box_overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Overlapping boxes (id, code, area of the overlap) through shared cells."""
    a = box_cells(left, size)
    b = box_cells(right, size).select("cx", "cy", "code", *[F.col(c).alias("_" + c) for c in ("xmin", "ymin", "xmax", "ymax")])
    width = F.least("xmax", "_xmax") - F.greatest("xmin", "_xmin")
    height = F.least("ymax", "_ymax") - F.greatest("ymin", "_ymin")
    pairs = a.join(b, ["cx", "cy"]).select("id", "code", width.alias("w"), height.alias("h")).where("w > 0 AND h > 0").distinct()
    return pairs.select("id", "code", (F.col("w") * F.col("h")).alias("area"))


def largest_overlap(overlaps: DataFrame) -> DataFrame:
    """The code with the largest overlap of each box; ties to the first code; all codes in order beside it."""
    return overlaps.groupBy("id").agg(
        F.min_by("code", F.struct(-F.round("area", 9), "code")).alias("first"), F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("codes")
    )


def stroke_cells(strokes: DataFrame, size: float, name: str, inside: str | None = None) -> DataFrame:
    """A row for each cell (``name`` x and y) that a stroke (ax, ay, bx, by, _reach) may touch: its rows of cells, in each the columns that its part there reaches.

    ``inside`` names cells FAN times as wide; then only their own cells come.
    """
    ax, ay, bx, by, reach = (F.col(c) for c in ("ax", "ay", "bx", "by", "_reach"))
    x, y, wide = f"{name}x", f"{name}y", reach + 1e-6
    ends = [cell(F.least(ay, by) - wide, size), cell(F.greatest(ay, by) + wide, size)]
    if inside:
        ends = [F.greatest(ends[0], F.col(f"{inside}y") * FAN), F.least(ends[1], F.col(f"{inside}y") * FAN + FAN - 1)]
    rows = strokes.withColumn("_a", ends[0]).withColumn("_b", ends[1]).where("_a <= _b").withColumn(y, F.explode(F.sequence("_a", "_b")))
    rise = F.nullif(by - ay, F.lit(0.0))
    p, q = ((F.col(y) + k) * size + sign * wide for k, sign in ((0, -1), (1, 1)))
    t = [F.coalesce((v - ay) / rise, F.lit(d)) for v, d in ((p, 0.0), (q, 1.0))]
    across = [ax + F.least(F.greatest(f(*t), F.lit(0.0)), F.lit(1.0)) * (bx - ax) for f in (F.least, F.greatest)]
    ends = [cell(F.least(*across) - wide, size), cell(F.greatest(*across) + wide, size)]
    if inside:
        ends = [F.greatest(ends[0], F.col(f"{inside}x") * FAN), F.least(ends[1], F.col(f"{inside}x") * FAN + FAN - 1)]
    return rows.withColumn("_a", ends[0]).withColumn("_b", ends[1]).where("_a <= _b").withColumn(x, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")


def drop_near_lines(points: DataFrame, segments: DataFrame, reach: str, size: float) -> DataFrame:
    """Points (id, x, y) farther than a segment's ``reach`` from every segment (ax, ay, bx, by).

    Segments come in rounds, in the order of a hash, FIRST at first and then ever more, all in
    the end: most points that lie near some segment go by the first few, so their pairs with all
    others never meet. Strokes go to the cells of ``size`` where points are left and there
    to cells FAN times as narrow, which an equi-join pairs.
    """
    spark, fine = points.sparkSession, size / FAN
    part = F.pmod(F.xxhash64("ax", "ay", "bx", "by", "_reach"), F.lit(PARTS))
    strokes, path = stage(segments.select("ax", "ay", "bx", "by", F.col(reach).alias("_reach")).withColumn("_part", part), "strokes")
    n = strokes.count()
    left, left_path = stage(points, "left")
    low, high = -1, max(1, PARTS * FIRST // max(n, 1))
    while low < PARTS - 1:
        high = min(high, PARTS - 1)
        keyed = left.select("id", "x", "y", cell(F.col("x"), fine).alias("fx"), cell(F.col("y"), fine).alias("fy")).where("fx IS NOT NULL AND fy IS NOT NULL")
        narrow, narrow_path = stage(keyed.select("fx", "fy").distinct(), "cells")
        few = narrow.count() <= FEW_CELLS
        near = lambda cells: F.broadcast(cells) if few else cells  # noqa: B023, E731
        broad = narrow.select(F.floor(F.col("fx") / FAN).alias("cx"), F.floor(F.col("fy") / FAN).alias("cy")).distinct()
        now = strokes.where((F.col("_part") > low) & (F.col("_part") <= high)).drop("_part")
        now = stroke_cells(now, size, "c").join(near(broad), ["cx", "cy"], "left_semi")
        now = stroke_cells(now, fine, "f", "c").join(near(narrow), ["fx", "fy"], "left_semi")
        d = point_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
        hit = now.join(keyed, ["fx", "fy"]).where(d <= F.col("_reach")).select("id").distinct()
        after, new = stage(left.join(hit, "id", "left_anti").select(*points.columns), "left")
        drop_stages(spark, left_path, narrow_path)
        left, left_path, low, high = after, new, high, (high + 1) * GROWTH
    drop_stages(spark, path)
    return left


def snap_ends(ends: DataFrame, vertices: DataFrame, reach: float = 12.0) -> DataFrame:
    """Each end (id, lon, lat, rank) with the nearest vertex (vid, vlon, vlat, vrank) of a more important line within ``reach`` metres.

    Vertices go to the cells around them, so one equi-join replaces a search; a cell is
    wider than the reach at the latitudes of use.
    """
    size = 0.0005
    around = vertices.withColumn("_i", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).withColumn("_j", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)])))
    around = around.select("vid", "vlon", "vlat", "vrank", (cell(F.col("vlon"), size) + F.col("_i")).alias("cx"), (cell(F.col("vlat"), size) + F.col("_j")).alias("cy"))
    keyed = ends.withColumn("cx", cell(F.col("lon"), size)).withColumn("cy", cell(F.col("lat"), size))
    d = dist_equirect(F.col("lon"), F.col("lat"), F.col("vlon"), F.col("vlat"))
    near = keyed.join(around, ["cx", "cy"]).where("vrank < rank").withColumn("d", d).where((F.col("d") <= reach) & (F.col("d") > 0))
    return near.groupBy("id").agg(F.min_by(F.struct("vid", "vlon", "vlat", "d"), F.struct(F.round("d", 6), "vid")).alias("to")).select("id", "to.*")
