"""Line operators on vertex rows (line_id, seq, x, y): windows along each line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.geometry import LON_M, dist_equirect, point_segment, turn_angle
from .components import components
from .staging import drop_stages, stage


#: Lines of up to so many vertices are simplified whole in a task, longer ones by rounds over all tasks.
LONG = 20_000


def order():
    return Window.partitionBy("line_id").orderBy("seq")


def measures(points: DataFrame) -> DataFrame:
    """Segment length from the vertex before, running length and the line's total, in metres."""
    step = F.coalesce(dist_equirect(F.lag("x").over(order()), F.lag("y").over(order()), F.col("x"), F.col("y")), F.lit(0.0))
    out = points.withColumn("step", step)
    return out.withColumn("run", F.sum("step").over(order().rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("step").over(Window.partitionBy("line_id")))


def drop_hairpins(points: DataFrame, angle: float = 150.0, reach: float = 20.0, passes: int = 5) -> DataFrame:
    """Inner vertices that turn back sharply between near neighbours go; each pass judges its own start; short lines go."""
    for _ in range(passes):
        before, after = [F.lag(c).over(order()) for c in ("x", "y")], [F.lead(c).over(order()) for c in ("x", "y")]
        sharp = turn_angle(before[0], before[1], F.col("x"), F.col("y"), after[0], after[1]) >= angle
        close = dist_equirect(before[0], before[1], after[0], after[1]) <= reach
        points = points.withColumn("_drop", F.coalesce(sharp & close, F.lit(False))).where(~F.col("_drop")).drop("_drop")
    return points.withColumn("_n", F.count("*").over(Window.partitionBy("line_id"))).where("_n >= 2").drop("_n")


def densify(points: DataFrame, spacing: float = 8.0, most: int = 5000) -> DataFrame:
    """Longer segments get evenly spaced inner points, with the spacing widened so that a line keeps below ``most`` points."""
    lead = {c: F.lead(c).over(order()) for c in ("x", "y")}
    rows = measures(points).withColumn("_n", F.count("*").over(Window.partitionBy("line_id")))
    rows = rows.withColumn("_x", lead["x"]).withColumn("_y", lead["y"]).withColumn("_len", F.lead("step").over(order()))
    wide = F.greatest(F.lit(spacing), F.col("total") / F.greatest(F.lit(most) - F.col("_n"), F.lit(1)))
    inner = F.coalesce(F.floor(F.col("_len") / wide).cast("int"), F.lit(0))
    rows = rows.withColumn("_k", inner).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_k"))))
    part = F.col("_i") / (F.col("_k") + 1)
    moved = [F.when(F.col("_i") == 0, F.col(c)).otherwise(F.col(c) + (F.col("_" + c) - F.col(c)) * part).alias(c) for c in ("x", "y")]
    return rows.select("line_id", F.col("seq").alias("_s"), "_i", *moved).select(
        "line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("_s", "_i")).alias("seq"), "x", "y"
    )


def chunk_line(points: DataFrame, n: int = 200) -> DataFrame:
    """Pieces of at most ``n`` vertices; neighbours share their border vertex."""
    i = F.row_number().over(order()) - 1
    last = F.count("*").over(Window.partitionBy("line_id")) - 1
    rows = points.withColumn("_i", i).withColumn("_last", last)
    here = F.floor(F.col("_i") / (n - 1)).cast("int")
    border = (F.col("_i") % (n - 1) == 0) & (F.col("_i") > 0)
    pieces = F.when(border & (F.col("_i") == F.col("_last")), F.array(here - 1)).when(border, F.array(here - 1, here)).otherwise(F.array(here))
    return rows.withColumn("chunk", F.explode(pieces)).drop("_i", "_last")


def in_bounds(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Vertices within the box; lines with fewer than two left go."""
    kept = points.where(F.col("x").between(west, east) & F.col("y").between(south, north))
    return kept.withColumn("_n", F.count("*").over(Window.partitionBy("line_id"))).where("_n >= 2").drop("_n")


def relative_points(points: DataFrame, closed: bool = False) -> DataFrame:
    """Vertices relative to their line's first; ``closed`` repeats the first at the end."""
    first = {c: F.first(c).over(order()) for c in ("x", "y")}
    rows = points.select("line_id", "seq", *[(F.col(c) - first[c]).alias(c) for c in ("x", "y")])
    if not closed:
        return rows
    ends = rows.groupBy("line_id").agg((F.max("seq") + 1).alias("seq"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return rows.unionByName(ends.withColumn("seq", F.col("seq").cast(rows.schema["seq"].dataType)))


def _offset(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Metres from p to the line through a and b (to a, where they coincide)."""
    scale = LON_M * F.cos(F.radians(ay))
    dx, dy = (bx - ax) * scale, (by - ay) * LON_M
    ux, uy = (px - ax) * scale, (py - ay) * LON_M
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size == 0, F.sqrt(ux * ux + uy * uy)).otherwise(F.abs(dx * uy - dy * ux) / size)


def _along(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Share of the way from a to b at p's foot, 0 to 1."""
    scale = F.cos(F.radians(ay))
    dx, dy, ux, uy = (bx - ax) * scale, by - ay, (px - ax) * scale, py - ay
    size = dx * dx + dy * dy
    return F.when(size == 0, 0.0).otherwise(F.least(F.greatest((ux * dx + uy * dy) / size, F.lit(0.0)), F.lit(1.0)))


def _whole_lines(batches):
    """Arrow tables of whole lines from sorted batches (``_i``: place in its line) that may part one: the last line waits for the next batch."""
    held = []
    for batch in batches:
        starts = np.flatnonzero(batch["_i"].to_numpy() == 1)
        if len(starts):
            done = [b for b in (*held, batch.slice(0, starts[-1])) if b.num_rows]
            if done:
                yield pa.Table.from_batches(done).combine_chunks()
            held = [batch.slice(starts[-1])]
        elif batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Laid:
    """Lines laid end to end as arrays: values with their nulls, the lines' first places and sizes."""

    def __init__(self, table: pa.Table):
        self.size = table.num_rows
        self.starts = np.flatnonzero(table["_i"].to_numpy() == 1)
        self.counts = np.diff(np.append(self.starts, self.size))
        self.line = np.repeat(np.arange(len(self.starts)), self.counts)
        names = [n for n in ("x", "y", "z") if n in table.column_names]
        self.void = {n: pc.is_null(table[n]).to_numpy() for n in names}
        self.gone = self.void["x"] | self.void["y"]
        self.value = {n: pc.fill_null(table[n].cast("double"), 0.0).to_numpy() for n in names}

    def split(self, lines: np.ndarray, far, closed: bool = False) -> np.ndarray:
        """The places that Douglas-Peucker keeps of the chosen lines (true by line), level by level for all at once.

        ``far(a, b, p, line)`` tells how far vertices are from their segments, in tolerances. A closed line ends in its first vertex.
        """
        at = np.flatnonzero(lines[self.line])
        last = np.cumsum(self.counts[lines])
        first = last - self.counts[lines]
        if closed:
            first, last, at = first + np.arange(len(first)), last + 1 + np.arange(len(last)), np.insert(at, last, at[first])
        kept = np.zeros(len(at), bool)
        kept[first], kept[last - 1] = True, True
        todo = np.flatnonzero(~kept)
        with np.errstate(all="ignore"):
            while len(todo):
                ends = np.flatnonzero(kept)
                after = np.searchsorted(ends, todo)
                a, b, p = at[ends[after - 1]], at[ends[after]], at[todo]
                d = np.round(far(a, b, p, self.line[p]), 9)
                d = np.where(np.isnan(d), np.inf, d)
                cuts = np.flatnonzero(np.append(True, after[1:] != after[:-1]))
                segment = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(p))))
                top = np.maximum.reduceat(d, cuts)
                best = np.flatnonzero(d == top[segment])
                best = best[np.unique(segment[best], return_index=True)[1]]  # the first of the farthest
                kept[todo[best[top > 1]]] = True
                todo = todo[(top > 1)[segment]]
                todo = todo[~kept[todo]]
        if closed:
            kept[last - 1] = False
        out = np.zeros(self.size, bool)
        out[at[kept]] = True
        return out

    def sideways(self, a, b, p):
        """Distance of p from the segment between a and b (-1 where a place is null) and the share of the way at its foot (then as SQL's least and greatest tell)."""
        x, y = self.value["x"], self.value["y"]
        dx, dy, ux, uy = x[b] - x[a], y[b] - y[a], x[p] - x[a], y[p] - y[a]
        size = dx * dx + dy * dy
        t = np.where(size == 0, 0.0, np.maximum(0.0, np.minimum(1.0, (ux * dx + uy * dy) / size)))
        gone = self.gone[a] | self.gone[b]
        t = np.where(gone | self.gone[p] & (size != 0), 1.0, t)
        return np.where(gone | self.gone[p], -1.0, np.sqrt((ux - t * dx) ** 2 + (uy - t * dy) ** 2)), t

    def offset(self, a, b, p):
        """The same in degrees, as metres from the line through a and b (to a, where they coincide)."""
        x, y = self.value["x"], self.value["y"]
        shrink = np.cos(np.radians(y[a]))
        scale = LON_M * shrink
        dx, dy, ux, uy = (x[b] - x[a]) * scale, (y[b] - y[a]) * LON_M, (x[p] - x[a]) * scale, (y[p] - y[a]) * LON_M
        size = np.sqrt(dx * dx + dy * dy)
        away = np.where(size == 0, np.sqrt(ux * ux + uy * uy), np.abs(dx * uy - dy * ux) / size)
        dx, dy, ux, uy = (x[b] - x[a]) * shrink, y[b] - y[a], (x[p] - x[a]) * shrink, y[p] - y[a]
        size = dx * dx + dy * dy
        gone = self.gone[a] | self.gone[b] | self.gone[p]
        return np.where(gone, -1.0, away), np.where((size == 0) | gone, 0.0, np.minimum(np.maximum((ux * dx + uy * dy) / size, 0.0), 1.0))

    def above(self, a, b, p, t):
        """Height of p off the segment at ``t``; -1 where one has no height."""
        z = self.value["z"]
        return np.where(self.void["z"][a] | self.void["z"][b] | self.void["z"][p], -1.0, np.abs(z[p] - z[a] - t * (z[b] - z[a])))


def _counted(points: DataFrame, names: list[str]) -> DataFrame:
    """Vertices in order with ``_i``, the place in the line, and ``_n``, the line's size: counted after the places, so that one sort serves both."""
    return points.select(*names, F.row_number().over(order()).alias("_i")).withColumn("_n", F.count("*").over(Window.partitionBy("line_id")))


def _short(batches, long: int, apart: list):
    """The batches without lines of over ``long`` vertices, which go to ``apart``."""
    for batch in batches:
        over = pc.greater(batch["_n"], long)
        if pc.any(over).as_py():
            apart.append(batch.filter(over))
            batch = batch.filter(pc.invert(over))
        yield batch


def _by_line(points: DataFrame, names: list[str], fit, rounds) -> DataFrame:
    """``points`` simplified: ``fit`` tells which vertices of whole lines in a task stay, ``rounds`` does the lines of over LONG vertices.

    One shuffle by line; tasks stream their lines. Written to the shared folder.
    """
    rows = _counted(points, names)
    long, fields = LONG, rows.select(*names).schema.fields

    def marked(table, open_):
        return table.select(names).append_column("_open", pa.array(np.full(table.num_rows, open_)))

    def work(batches):
        apart = []
        for table in _whole_lines(_short(batches, long, apart)):
            yield from marked(table.filter(pa.array(fit(_Laid(table)))), False).to_batches()
            while apart:
                yield from marked(pa.Table.from_batches([apart.pop()]), True).to_batches()
        while apart:
            yield from marked(pa.Table.from_batches([apart.pop()]), True).to_batches()

    out, path = stage(rows.mapInArrow(work, StructType([*fields, StructField("_open", BooleanType())])), "lines")
    rest = out.where("_open").drop("_open")
    if rest.isEmpty():
        return out.drop("_open")
    full, _ = stage(out.where("NOT _open").drop("_open").unionByName(rounds(rest)), "lines")
    drop_stages(points.sparkSession, path)
    return full


def _split_rounds(points: DataFrame, names: list[str], far) -> DataFrame:
    """Douglas-Peucker, level by level: every open segment of every line splits at its farthest vertex at once.

    ``far(a, b)`` tells how far a vertex is from the segment between a and b, in tolerances.
    A round is one window over (line, segment); a line of n vertices needs as many rounds
    as its split tree is deep. Rounds are written to the shared folder.
    """
    last = F.count("*").over(Window.partitionBy("line_id"))
    rows = points.select(*names, F.row_number().over(order()).alias("_i"))
    rows, path = stage(rows.withColumn("keep", (F.col("_i") == 1) | (F.col("_i") == last)), "simplify")
    kept = -1
    while True:
        now = rows.where("keep").count()
        if now == kept:
            return rows.where("keep").drop("_i", "keep")
        kept = now
        whole = Window.partitionBy("line_id")
        ahead, behind = (whole.orderBy(i).rowsBetween(Window.unboundedPreceding, 0) for i in (F.col("_i"), F.desc("_i")))
        ends = {n: F.when(F.col("keep"), F.col(n)) for n in ("_i", *names[2:])}
        a = {n: F.last(e, True).over(ahead) for n, e in ends.items()}
        b = {n: F.last(e, True).over(behind) for n, e in ends.items()}
        seen = rows.select("*", a["_i"].alias("_seg"), F.round(far(a, b), 9).alias("_d"))
        segment = Window.partitionBy("line_id", "_seg")
        pick = F.first("_i").over(segment.orderBy(F.col("keep"), F.desc("_d"), "_i"))
        split = ~F.col("keep") & (F.col("_d") > 1) & (F.col("_i") == pick)
        rows, new = stage(seen.select(*names, "_i", (F.col("keep") | split).alias("keep")), "simplify")
        drop_stages(points.sparkSession, path)
        path = new


def simplify(points: DataFrame, tolerance: float, rise: float | None = None) -> DataFrame:
    """Lines in degrees simplified to a tolerance in metres.

    With ``rise``, rows have a z, and a vertex is as far as the larger of its sideways
    distance over ``tolerance`` and its height off the segment over ``rise``.
    """
    names = ["line_id", "seq", "x", "y", *(["z"] if rise else [])]

    def fit(laid: _Laid):
        def far(a, b, p, line):
            away, t = laid.offset(a, b, p)
            return np.maximum(away / tolerance, laid.above(a, b, p, t) / rise) if rise else away / tolerance

        return laid.split(np.ones(len(laid.starts), bool), far)

    def far(a, b):
        place = (a["x"], a["y"], b["x"], b["y"], F.col("x"), F.col("y"))
        sideways = _offset(*place) / tolerance
        return F.greatest(sideways, F.abs(F.col("z") - a["z"] - (b["z"] - a["z"]) * _along(*place)) / rise) if rise else sideways

    return _by_line(points, names, fit, lambda rest: _split_rounds(rest, names, far))


def _local_far(rise: Column | None):
    """How far a vertex in metres is from a segment: its distance over ``_tol``, or its height off it over ``rise``, if larger."""

    def far(a, b):
        px, py = F.col("x"), F.col("y")
        sideways = point_segment(px, py, a["x"], a["y"], b["x"], b["y"]) / F.col("_tol")
        if rise is None:
            return sideways
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        size = dx * dx + dy * dy
        t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / size)))
        return F.greatest(sideways, F.abs(F.col("z") - a["z"] - t * (b["z"] - a["z"])) / rise)

    return far


def _sized(points: DataFrame, names: list[str]) -> DataFrame:
    return points.select(*names, F.count("*").over(Window.partitionBy("line_id")).alias("_n"))


def simplify_schedule(points: DataFrame, most: int, closed: bool = False, rising: tuple[float, ...] = (1.0, 2.0, 5.0, 10.0, 20.0)) -> DataFrame:
    """Lines or rings (open, in order) in metres with at most ``most`` points.

    The first tolerance is half a percent of the box's diagonal, from 1 to 5 m; lines that
    keep more points take the larger ones of ``rising`` in turn, and at last every n-th
    point (lines keep their end as well). Rings of under four points stay as they are.
    """
    least = 3 if closed else 2

    def fit(laid: _Laid):
        span = []
        for c in "xy":
            low, high = (f.reduceat(np.where(laid.void[c], -k, laid.value[c]), laid.starts) for f, k in ((np.minimum, -np.inf), (np.maximum, np.inf)))
            span.append(high - low)
        base = np.maximum(1.0, np.fmin(5.0, 0.005 * np.sqrt(span[0] ** 2 + span[1] ** 2)))
        todo = laid.counts > least
        out = ~todo[laid.line]
        for step in (None, *rising):
            now, tol = (todo, base) if step is None else (todo & (base < step), np.full(len(base), step))
            if not now.any():
                continue
            kept = laid.split(now, lambda a, b, p, line: laid.sideways(a, b, p)[0] / tol[line], closed)  # noqa: B023
            n = np.add.reduceat(kept.astype(int), laid.starts)
            good = now & (n >= least) & (n <= most)
            out |= kept & good[laid.line]
            todo = todo & ~good
        i, step = np.arange(laid.size) - laid.starts[laid.line], -(-laid.counts // most)[laid.line]
        thin = (i % step == 0) & (i // step < most) | (i == laid.counts[laid.line] - 1) & (not closed)
        return out | thin & todo[laid.line]

    return _by_line(points, ["line_id", "seq", "x", "y"], fit, lambda rest: _schedule_rounds(rest, most, closed, rising))


def _schedule_rounds(points: DataFrame, most: int, closed: bool, rising: tuple[float, ...]) -> DataFrame:
    """``simplify_schedule`` by rounds over all tasks."""
    spark, names, least = points.sparkSession, ["line_id", "seq", "x", "y"], 3 if closed else 2
    size = Window.partitionBy("line_id")
    wide, high = (F.max(c).over(size) - F.min(c).over(size) for c in ("x", "y"))
    base = F.greatest(F.lit(1.0), F.least(F.lit(5.0), 0.005 * F.sqrt(wide * wide + high * high)))
    rows, path = stage(points.select(*names, base.alias("_base"), F.count("*").over(size).alias("_all")), "scheduled")
    done = rows.where("_all < 4").select(*names) if closed else rows.where("_all < 3").select(*names)
    todo, paths = rows.where("_all >= 4" if closed else "_all >= 3"), [path]
    for step in (None, *rising):
        now = todo.withColumn("_tol", F.col("_base") if step is None else F.lit(step))
        now = now if step is None else now.where(F.col("_base") < step)
        if closed:  # the ring's first point closes it
            first = F.min_by(F.struct("x", "y"), "seq")
            ends = now.groupBy("line_id").agg(first.alias("p"), (F.max("seq") + 1).alias("seq"), F.max("_tol").alias("_tol"))
            now = now.select(*names, "_tol", F.lit(False).alias("_end")).unionByName(ends.select("line_id", "seq", "p.x", "p.y", "_tol", F.lit(True).alias("_end")))
        slim = _split_rounds(now, [*names, "_tol", *(["_end"] if closed else [])], _local_far(None))
        sized = _sized(slim.where("NOT _end") if closed else slim, names).where((F.col("_n") >= least) & (F.col("_n") <= most))
        good, path = stage(sized.select(*names), "slim")
        done = done.unionByName(good)
        rest, rest_path = stage(todo.join(good.select("line_id").distinct(), "line_id", "left_anti"), "thick")
        paths.append(rest_path)
        todo = rest
        if todo.isEmpty():
            break
    i, step = F.row_number().over(order()) - 1, F.ceil(F.col("_all") / most)
    thin = todo.withColumn("_i", i).where((F.col("_i") % step == 0) & (F.col("_i") / step < most) | (F.lit(not closed) & (F.col("_i") == F.col("_all") - 1)))
    out, _ = stage(done.unionByName(thin.select(*names)), "simplified")
    drop_stages(spark, *paths)
    return out


def _road_fit(most: int, across: float, rise: float):
    """Which vertices ``simplify_roads`` keeps of whole lines in a task."""

    def fit(laid: _Laid):
        todo, out = np.ones(len(laid.starts), bool), np.zeros(laid.size, bool)
        for scale in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
            def far(a, b, p, line):
                away, t = laid.sideways(a, b, p)
                return np.maximum(away / (across * scale), laid.above(a, b, p, t) / (rise * scale))  # noqa: B023

            kept = laid.split(todo, far)
            good = todo & ((np.add.reduceat(kept.astype(int), laid.starts) <= most) | (scale == 32.0))
            out |= kept & good[laid.line]
            todo = todo & ~good
            if not todo.any():
                break
        return out

    return fit


def simplify_roads(points: DataFrame, most: int = 200, across: float = 1.0, rise: float = 0.25) -> DataFrame:
    """Roads in metres (with z) simplified on sideways and height error together; tolerances double, up to 32 times, while over ``most`` points."""
    return _by_line(points, ["line_id", "seq", "x", "y", "z"], _road_fit(most, across, rise), lambda rest: _road_rounds(rest, most, across, rise))


def road_parts(points: DataFrame, most: int = 200, across: float = 1.0, rise: float = 0.25) -> DataFrame:
    """Roads of two vertices and more, simplified as by ``simplify_roads`` and cut as by ``chunk_line``: line_id, chunk, parts (of the line), vertices (seq, x, y, z).

    Both are done in the task that holds the line: one shuffle and one sort by line. Written to the shared folder.
    """
    names, long, fit = ["line_id", "seq", "x", "y", "z"], LONG, _road_fit(most, across, rise)
    rows = _counted(points, names)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    vertex = StructType([StructField(n, kinds[n]) for n in names[1:]])
    schema = StructType([StructField("line_id", kinds["line_id"]), StructField("chunk", IntegerType()), StructField("parts", IntegerType()), StructField("vertices", ArrayType(vertex)), StructField("_open", BooleanType())])
    laid_out = to_arrow_schema(schema)

    def pieces(table, first, size, chunk, parts, open_):
        """A row for each run of ``size`` vertices from place ``first`` on; runs may share vertices."""
        ends = np.cumsum(size)
        flat = table.take(pa.array(np.repeat(first - ends + size, size) + np.arange(size.sum())))
        points = pa.StructArray.from_arrays([flat[n].combine_chunks() for n in names[1:]], names=names[1:])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), points)
        columns = [table["line_id"].take(pa.array(first)), pa.array(chunk), pa.array(parts), lists, pa.array(np.full(len(first), open_))]
        return pa.table([c.cast(f.type) for c, f in zip(columns, laid_out, strict=True)], schema=laid_out).to_batches()

    def work(batches):
        apart = []

        def loose():
            while apart:
                table = pa.Table.from_batches([apart.pop()])
                one = np.ones(table.num_rows, int)
                yield from pieces(table, np.arange(table.num_rows), one, one, one, True)

        for table in _whole_lines(_short(batches, long, apart)):
            laid = _Laid(table)
            kept = fit(laid) & (laid.counts > 1)[laid.line]
            size = np.add.reduceat(kept.astype(int), laid.starts)
            start, last, n = np.cumsum(size) - size, np.cumsum(size), -(-(size - 1) // (most - 1))
            n = np.where(size > 0, n, 0)
            line = np.repeat(np.arange(len(n)), n)
            chunk = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            first = start[line] + chunk * (most - 1)
            if len(first):
                yield from pieces(table.filter(pa.array(kept)), first, np.minimum(first + most, last[line]) - first, chunk, n[line], False)
            yield from loose()
        yield from loose()

    out, path = stage(rows.mapInArrow(work, schema), "parts")
    rest = out.where("_open")
    if rest.isEmpty():
        return out.drop("_open")
    slim = chunk_line(_road_rounds(rest.select("line_id", F.inline("vertices")), most, across, rise), most)
    cut = slim.groupBy("line_id", "chunk").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("vertices"))
    cut = cut.withColumn("parts", F.count("*").over(Window.partitionBy("line_id")).cast("int"))
    full, _ = stage(out.where("NOT _open").drop("_open").unionByName(cut), "parts")
    drop_stages(points.sparkSession, path)
    return full


def _road_rounds(points: DataFrame, most: int, across: float, rise: float) -> DataFrame:
    """``simplify_roads`` by rounds over all tasks."""
    spark, names = points.sparkSession, ["line_id", "seq", "x", "y", "z"]
    todo, done, paths = points.select(*names), None, []
    for scale in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        slim = _sized(_split_rounds(todo.withColumn("_tol", F.lit(across * scale)), [*names, "_tol"], _local_far(F.lit(rise * scale))), names)
        sized, path = stage(slim, "slim")
        good = sized.where(F.col("_n") <= most) if scale < 32.0 else sized
        done = good.select(*names) if done is None else done.unionByName(good.select(*names))
        rest, rest_path = stage(todo.join(good.select("line_id").distinct(), "line_id", "left_anti"), "thick")
        paths.append(rest_path)
        todo = rest
        if todo.isEmpty():
            break
    out, _ = stage(done, "simplified")
    drop_stages(spark, *paths)
    return out


def clip_polygon(rings: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rings clipped to a rectangle: four half-planes in turn, each keeps inner vertices and adds crossings."""
    for axis, bound, sign in (("x", west, 1), ("x", east, -1), ("y", south, 1), ("y", north, -1)):
        other = "y" if axis == "x" else "x"
        window = Window.partitionBy("line_id").orderBy("seq")
        whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rings.select(
            "*", *[F.coalesce(F.lead(c).over(window), F.first(c).over(whole)).alias("_" + c) for c in ("x", "y")]
        )
        inside, after = (F.col(axis) - bound) * sign >= 0, (F.col("_" + axis) - bound) * sign >= 0
        t = (bound - F.col(axis)) / (F.col("_" + axis) - F.col(axis))
        cross = F.struct(
            *[(F.lit(float(bound)) if c == axis else F.col(other) + t * (F.col("_" + other) - F.col(other))).alias(c) for c in ("x", "y")]
        )
        own = F.struct("x", "y")
        made = F.when(inside & after, F.array(own)).when(inside, F.array(own, cross)).when(after, F.array(cross)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
        rows = rows.select("line_id", F.col("seq").alias("_s"), F.posexplode(made).alias("_i", "p"))
        rings = rows.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("_s", "_i")).alias("seq"), "p.x", "p.y")
    return rings


def stitch_ways(ways: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Ways (id, a, b: nodes) joined through nodes with exactly two way ends whose attributes agree: id, road.

    A node's ends are counted once; a pair at a free node is a link; the roads are the
    links' components, named by their smallest way.
    """
    ends = ways.select("id", *keys, F.explode(F.array("a", "b")).alias("node"))
    pairs = ends.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("id", *keys)).alias("p"), F.max(F.struct("id", *keys)).alias("q")).where("n = 2")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}"))
    links = pairs.where(same & (F.col("p.id") != F.col("q.id"))).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    found = components(links)
    return ways.join(found, ways["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("road"))


def dissolve(boxes: DataFrame, touches: DataFrame) -> DataFrame:
    """Groups of touching features (a, b): group, members, and the name of the named, then largest, member."""
    found = components(touches)
    rows = boxes.join(found, boxes["id"] == found["node"], "left").withColumn("group", F.coalesce("component", "id"))
    best = F.max_by("name", F.struct((F.coalesce("name", F.lit("")) != "").alias("named"), F.round("area", 9).alias("area"), (-F.col("id")).alias("first")))
    return rows.groupBy("group").agg(F.count("*").alias("members"), best.alias("name"))


def cleanup_stats(boxes: DataFrame, touches: DataFrame, sliver: float) -> DataFrame:
    """One row: features in, groups of several, slivers below ``sliver`` and features that stand alone."""
    found = components(touches)
    rows = boxes.join(found, boxes["id"] == found["node"], "left").withColumn("group", F.coalesce("component", "id"))
    sizes = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("area").alias("area"))
    return sizes.agg(
        F.sum("n").alias("polygons"), F.count_if(F.col("n") > 1).alias("merged"), F.count_if(F.col("area") < sliver).alias("slivers"), F.count_if(F.col("n") == 1).alias("alone")
    )
