"""Road networks as vertex rows (line_id, seq, x, y): fragments joined into roads, loose ends moved onto better roads."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import LAT_M, LON_M, dist_equirect, node_key
from .components import batches, components
from .staging import drop_stages, stage

#: A road stops growing once it has more points.
MOST_POINTS = 5000
#: Metres below which a segment counts as collapsed.
LEAST_SEGMENT = 1.0


def line_ends(points: DataFrame) -> DataFrame:
    """One row per line: line_id, n, a and b (node keys of its first and last vertex)."""
    first, last = F.min_by(F.struct("x", "y"), "seq"), F.max_by(F.struct("x", "y"), "seq")
    ends = points.groupBy("line_id").agg(F.count("*").alias("n"), first.alias("p"), last.alias("q"))
    return ends.where("n >= 2").select("line_id", "n", node_key(F.col("p.x"), F.col("p.y")).alias("a"), node_key(F.col("q.x"), F.col("q.y")).alias("b"))


def _joints(ends: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Pairs of line ends at nodes with exactly two of them whose attributes agree: p and q are (line_id, end)."""
    flat = ends.select("line_id", *keys, F.posexplode(F.array("a", "b")).alias("end", "node"))
    one = F.struct("line_id", "end", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys])
    met = flat.groupBy("node").agg(F.count("*").alias("n"), F.min(one).alias("p"), F.max(one).alias("q")).where("n = 2")
    same = F.col("p.line_id") != F.col("q.line_id")
    for k in keys:
        same = same & (F.col(f"p.{k}") == F.col(f"q.{k}"))
    return met.where(same)


def jumped(copy: np.ndarray, at: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers (copy to at, ``far`` steps) led along those among them as far as they go; there are no rings."""
    order = np.argsort(copy)
    place = np.minimum(np.searchsorted(copy, at, sorter=order), len(copy) - 1)
    after = np.where(copy[order[place]] == at, order[place], -1)
    while (live := np.flatnonzero(after >= 0)).size:
        to = after[live]
        moved, steps, further = at[to], far[to], after[to]
        at, far, after = at.copy(), far.copy(), after.copy()
        at[live], far[live], after[live] = moved, far[live] + steps, further
    return at, far


def _near_jumps(steps: DataFrame) -> DataFrame:
    """Pointers (copy, at, far) in the order of their copies, led as far as each task's batches know them."""

    def work(frames):
        for pdf in batches(frames):
            at, far = jumped(*(pdf[c].to_numpy(np.int64) for c in ("copy", "at", "far")))
            yield pdf[["copy"]].assign(at=at, far=far)

    tasks = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return steps.repartitionByRange(tasks, "copy").mapInPandas(work, "copy long, at long, far long")


def _walks(joints: DataFrame, ends: DataFrame) -> DataFrame:
    """For every line the walk that reaches it: home (the walk's first line), place (1, 2 ... past its tail, -1, -2 ... before its head) and turned.

    Every line has two directed copies, numbered 2 * line_id for the way it is given
    and one more for its reverse. A copy's predecessor leaves the node where the copy
    begins; tasks lead pointers along near ones, then doubled pointers lead each copy to its
    walk's start: a logarithmic number of rounds. The lowest line of a chain starts its walks, so its copies have no predecessor.
    """
    spark = ends.sparkSession
    both = joints.select("p", "q").unionByName(joints.select(F.col("q").alias("p"), F.col("p").alias("q")))
    copy, before = 2 * F.col("p.line_id") + F.col("p.end"), 2 * F.col("q.line_id") + 1 - F.col("q.end")
    chains, chain_path = stage(components(joints.select(F.col("p.line_id").alias("a"), F.col("q.line_id").alias("b"))), "chains")
    starts = chains.select(F.col("component").alias("line_id")).distinct()
    steps = both.select(copy.alias("copy"), before.alias("at")).join(starts.select(F.explode(F.array(2 * F.col("line_id"), 2 * F.col("line_id") + 1)).alias("copy")), "copy", "left_anti")
    rows, path = stage(_near_jumps(steps.select(F.col("copy").cast("long"), F.col("at").cast("long"), F.lit(1).cast("long").alias("far"))), "walks")
    while True:
        # where the pointer's target has a pointer too, jump along it
        further = rows.select(F.col("copy").alias("at"), F.col("at").alias("_next"), F.col("far").alias("_more"))
        jumped = rows.join(further, "at", "left").withColumn("_moved", F.col("_next").isNotNull())
        after, new = stage(jumped.select("copy", F.coalesce("_next", "at").alias("at"), (F.col("far") + F.coalesce("_more", F.lit(0))).alias("far"), "_moved"), "walks")
        drop_stages(spark, path)
        moved = not after.where("_moved").isEmpty()
        rows, path = after.drop("_moved"), new
        if not moved:
            break
    home = F.floor(F.col("at") / 2)
    reached = rows.join(starts.select(F.col("line_id").alias("_home")), home == F.col("_home")).select(
        F.floor(F.col("copy") / 2).alias("line_id"), F.col("_home").alias("home"), (F.col("copy") % 2 == 1).alias("turned"), "far", (F.col("at") % 2 == 0).alias("ahead")
    )
    # in a ring both walks reach a line; the one past the tail comes first
    best = reached.groupBy("line_id").agg(F.min_by(F.struct("home", "turned", "far", "ahead"), F.struct(~F.col("ahead"), "far")).alias("w"))
    walked = best.select("line_id", "w.home", F.when(F.col("w.ahead"), F.col("w.far")).otherwise(-F.col("w.far")).alias("place"), (F.col("w.turned") == F.col("w.ahead")).alias("turned"))
    out, _ = stage(walked, "walked")
    drop_stages(spark, path, chain_path)
    return out


def stitch_lines(points: DataFrame, attributes: DataFrame, keys: tuple[str, ...], most: int = MOST_POINTS) -> tuple[DataFrame, DataFrame]:
    """Lines that continue each other become roads, oriented like their lowest line.

    ``points``: line_id, seq, x, y; ``attributes``: line_id and ``keys``, which must agree
    (null counts as empty). Lines join where a node has exactly two line ends; a closed
    line counts twice. A road grows past its tail, then before its head; each way it
    stops once the road has more than ``most`` points, and what is left of the chain makes
    further roads. Returns the vertices (line_id: the road, seq from 1, x, y) and the roads
    (line_id, ids in the order of the walk, n). Lines with fewer than two points go.
    """
    spark = points.sparkSession
    ends, path = stage(line_ends(points).join(attributes.select("line_id", *keys), "line_id", "left"), "ends")
    joints, joint_path = stage(_joints(ends, keys), "joints")
    left, roads, old = ends, [], [joint_path]
    while True:
        open_ = joints.join(left.select(F.col("line_id").alias("_p")), F.col("p.line_id") == F.col("_p")).join(left.select(F.col("line_id").alias("_q")), F.col("q.line_id") == F.col("_q"))
        walks = _walks(open_.select("p", "q"), left)
        alone = left.select("line_id", "n").join(walks, "line_id", "left")
        placed = alone.select("line_id", "n", F.coalesce("home", "line_id").alias("home"), F.coalesce("place", F.lit(0).cast("long")).alias("place"), F.coalesce("turned", F.lit(False)).alias("turned"))
        head = F.max(F.when(F.col("place") == 0, F.col("n"))).over(Window.partitionBy("home"))
        ahead = Window.partitionBy("home", F.col("place") > 0).orderBy(F.abs("place")).rowsBetween(Window.unboundedPreceding, -1)
        run = placed.withColumn("_head", head).withColumn("_sum", F.coalesce(F.sum(F.when(F.col("place") != 0, F.col("n") - 1)).over(ahead), F.lit(0)))
        # a line joins while the road before it has at most ``most`` points; the next neighbour always does
        tail = run.withColumn("_in", (F.col("place") <= 0) | (F.col("place") == 1) | (F.col("_head") + F.col("_sum") <= most))
        grown = F.sum(F.when((F.col("place") > 0) & F.col("_in"), F.col("n") - 1).otherwise(0)).over(Window.partitionBy("home"))
        whole = tail.withColumn("_grown", grown).withColumn("_in", F.col("_in") & ((F.col("place") >= -1) | (F.col("_head") + F.col("_grown") + F.col("_sum") <= most)))
        done, done_path = stage(whole.where("_in").select("line_id", "home", "place", "turned"), "stitched")
        roads.append(done)
        rest, rest_path = stage(left.join(done.select("line_id"), "line_id", "left_anti"), "unstitched")
        if rest.isEmpty():
            old.append(rest_path)
            break
        left = rest
        old.append(rest_path)
    found = roads[0]
    for more in roads[1:]:
        found = found.unionByName(more)
    size = Window.partitionBy("line_id")
    number = F.row_number().over(size.orderBy("seq"))
    rows = points.join(found, "line_id").withColumn("_i", number).withColumn("_n", F.count("*").over(size))
    along = F.when(F.col("turned"), F.col("_n") + 1 - F.col("_i")).otherwise(F.col("_i"))
    # the node that a line shares with the one before it (seen from the road's first line) is kept once
    shared = ((F.col("place") > 0) & (F.col("_k") == 1)) | ((F.col("place") < 0) & (F.col("_k") == F.col("_n")))
    kept = rows.withColumn("_k", along).where(~shared)
    seq = F.row_number().over(Window.partitionBy("home").orderBy("place", "_k"))
    vertices = kept.select(F.col("home").alias("line_id"), seq.alias("seq"), "x", "y")
    walk = F.struct((F.col("place") < 0).alias("back"), F.abs("place").alias("far"), "line_id")
    ids = F.transform(F.array_sort(F.collect_list(walk)), lambda w: w["line_id"])
    summary = found.groupBy("home").agg(ids.alias("ids")).select(F.col("home").alias("line_id"), "ids", F.size("ids").alias("n"))
    drop_stages(spark, path, *old)
    return vertices, summary


def _band_width(band, reach: float):
    """Degrees of longitude that surely hold ``reach`` metres in a band of latitude and its neighbours."""
    high = reach / LAT_M
    edge = F.least((F.greatest(F.abs(band), F.abs(band + 1)) + 1) * high, F.lit(89.9))
    return reach / (LON_M * 0.99 * F.cos(F.radians(edge)))


def nearest_better(ends: DataFrame, vertices: DataFrame, reach: float) -> DataFrame:
    """Each end (key, line_id, x, y, rank) with the nearest vertex (line_id, x, y, rank) of a better (lower) rank within ``reach`` metres.

    Vertices go to the cells around them; a cell is as high as the reach and, in its own
    band of latitude, as wide, so one equi-join finds all in reach at any latitude.
    """
    high = reach / LAT_M
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    spread = vertices.select(F.col("line_id").alias("_line"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("rank").alias("_rank"), F.explode(around).alias("_dy"))
    spread = spread.withColumn("cy", F.floor(F.col("vy") / high) + F.col("_dy"))
    spread = spread.withColumn("_dx", F.explode(around)).withColumn("cx", F.floor(F.col("vx") / _band_width(F.col("cy"), reach)) + F.col("_dx"))
    keyed = ends.withColumn("cy", F.floor(F.col("y") / high)).withColumn("cx", F.floor(F.col("x") / _band_width(F.col("cy"), reach)))
    near = keyed.join(spread.drop("_dx", "_dy"), ["cx", "cy"]).where((F.col("_rank") < F.col("rank")) & (F.col("_line") != F.col("line_id")))
    near = near.withColumn("d", dist_equirect(F.col("x"), F.col("y"), F.col("vx"), F.col("vy"))).where(F.col("d") <= reach)
    best = F.min_by(F.struct("vx", "vy", "d"), F.struct(F.round("d", 6), "_line", "vx", "vy"))
    return near.groupBy("key").agg(best.alias("to")).select("key", "to.*")


def snap_lines(points: DataFrame, ranks: DataFrame, reach: float = 12.0) -> DataFrame:
    """Vertices with loose ends moved onto the nearest vertex of a more important line within ``reach`` metres; ``moved`` marks them.

    All ends are judged against the lines as given. An end that lies on the vertex already
    stays, and so does one whose move would leave a last segment of under a metre.
    """
    order = Window.partitionBy("line_id").orderBy("seq")
    size = Window.partitionBy("line_id")
    rows = points.join(ranks.select("line_id", "rank"), "line_id").withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(size)).where("_n >= 2")
    ends = rows.where("_i = 1 OR _i = _n").withColumn("key", F.struct("line_id", "_i"))
    found = nearest_better(ends.select("key", "line_id", "x", "y", "rank"), rows.select("line_id", "x", "y", "rank"), reach).where("d > 0")
    met = rows.withColumn("key", F.struct("line_id", "_i")).join(found, "key", "left")

    def far(c):
        return dist_equirect(F.col("vx"), F.col("vy"), c["x"], c["y"]) >= LEAST_SEGMENT

    own = F.struct("x", "y")
    after, before = F.lead(own).over(order), F.lag(own).over(order)
    met = met.withColumn("_first", (F.col("_i") == 1) & F.col("vx").isNotNull() & far(after))
    moved_first = F.when(F.lag("_first").over(order), F.struct(F.lag("vx").over(order).alias("x"), F.lag("vy").over(order).alias("y"))).otherwise(before)
    anchor = F.when(F.col("_n") == 2, moved_first).otherwise(before)
    met = met.withColumn("_anchor", anchor).withColumn("moved", F.coalesce(F.col("_first") | ((F.col("_i") == F.col("_n")) & F.col("vx").isNotNull() & far(F.col("_anchor"))), F.lit(False)))
    return met.select("line_id", "seq", *[F.when(F.col("moved"), F.col("v" + c)).otherwise(F.col(c)).alias(c) for c in ("x", "y")], "moved")


def network_stats(points: DataFrame, vertices: DataFrame, snapped: DataFrame) -> DataFrame:
    """One row: lines in, roads out, ends moved, points before and after, nodes with three ends or more."""
    ends = line_ends(points)
    nodes = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
    parts = (
        ends.agg(F.count("*").alias("ways")),
        vertices.agg(F.count_distinct("line_id").alias("roads"), F.count("*").alias("points_after")),
        snapped.agg(F.count_if("moved").alias("moved")),
        points.agg(F.count("*").alias("points_before")),
        nodes.agg(F.count_if(F.col("c") >= 3).alias("junctions"), F.count_if(F.col("c") == 1).alias("dead_ends")),
    )
    out = parts[0]
    for more in parts[1:]:
        out = out.crossJoin(more)  # one row each
    return out
