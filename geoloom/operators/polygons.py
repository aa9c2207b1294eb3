"""Polygons of any shape as edge rows (pid, ax, ay, bx, by; all rings, holes too): containment, nearest, overlaps, dissolved outlines.

A polygon's inside is told by parity, so holes need no mark. Joins are equi-joins on cells
or on bands of y; a polygon's whole ring never travels with a point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import point_segment
from .components import components
from .composites import rasterize_polygons
from .spatial import box_cells, cell
from .staging import drop_stages, shuffled, stage, written


def polygon_edges(polygons: DataFrame, pid: str = "pid", rings: str = "rings") -> DataFrame:
    """Edge rows of polygons (pid, rings: array of closed rings of points)."""
    ring = polygons.select(F.col(pid).alias("pid"), F.posexplode(rings).alias("part", "ring"))
    points = ring.select("pid", "part", F.posexplode("ring").alias("seq", "p"))
    after = F.lead("p").over(Window.partitionBy("pid", "part").orderBy("seq"))
    rows = points.select("pid", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), after.alias("q")).where("q IS NOT NULL")
    return rows.select("pid", "ax", "ay", F.col("q.x").alias("bx"), F.col("q.y").alias("by")).where("ax <> bx OR ay <> by")


def _bounds(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    low, high = (lambda c: F.min(F.least("a" + c, "b" + c))), (lambda c: F.max(F.greatest("a" + c, "b" + c)))
    return edges.groupBy("pid", *by).agg(low("x").alias("xmin"), low("y").alias("ymin"), high("x").alias("xmax"), high("y").alias("ymax"))


def inside(points: DataFrame, edges: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id, pid) of points (id, x, y) and the polygons that hold them.

    Points meet the boxes of polygons in cells, then the polygon's edges in bands of y;
    edges right of the point are counted. Only what agrees in the columns ``by`` of both meets.
    """
    boxes = box_cells(_bounds(edges, by), size).select("pid", *by, "cx", "cy", "xmin", "ymin", "xmax", "ymax")
    keyed = points.select("id", *by, "x", "y").withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    may = keyed.join(shuffled(boxes), [*by, "cx", "cy"]).where("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax").select("id", "pid", "x", "y", F.col("cy").alias("band"))
    spread = edges.where("ay <> by").withColumn("band", F.explode(F.sequence(cell(F.least("ay", "by"), size), cell(F.greatest("ay", "by"), size))))
    met = may.join(shuffled(spread), ["pid", "band"]).where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y")))
    cross = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    return met.groupBy("id", "pid").agg(F.count_if(cross > F.col("x")).alias("_k")).where("_k % 2 = 1").select("id", "pid")


def near_edges(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """Pairs (id, pid) of points and polygons whose edges lie within ``reach``, with the distance ``d``."""
    wide = edges.select(
        "*", (F.least("ax", "bx") - reach).alias("xmin"), (F.least("ay", "by") - reach).alias("ymin"),
        (F.greatest("ax", "bx") + reach).alias("xmax"), (F.greatest("ay", "by") + reach).alias("ymax"),
    )
    size = 4 * reach
    keyed = points.select("id", "x", "y").withColumn("cx", cell(F.col("x"), size)).withColumn("cy", cell(F.col("y"), size))
    d = point_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = keyed.join(box_cells(wide, size), ["cx", "cy"]).where("x BETWEEN xmin AND xmax AND y BETWEEN ymin AND ymax")
    return met.withColumn("d", d).where(F.col("d") <= reach).groupBy("id", "pid").agg(F.min("d").alias("d"))


def points_in_polygons(points: DataFrame, edges: DataFrame, codes: DataFrame, size: float, reach: float = 0.25) -> DataFrame:
    """The code of the polygon (pid, code) that holds each point, the smallest on ties, else of the nearest within ``reach``, else null."""
    held = inside(points, edges, size).withColumn("d", F.lit(-1.0))
    near = near_edges(points.join(held.select("id").distinct(), "id", "left_anti"), edges, reach)
    best = held.unionByName(near).join(codes.select("pid", "code"), "pid").groupBy("id").agg(F.min_by("code", F.struct(F.round("d", 9), "code")).alias("code"))
    return points.join(best, "id", "left")


def crossing(left: DataFrame, right: DataFrame, size: float, skipped: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of edges (a: left, b: right) that meet or touch, in shared cells: both edges' columns, ``t`` along a and ``u`` along b; null where parallel.

    Pairs that only meet in the cells ``skipped`` (cx, cy) may be left out. Edges meet, and cells count,
    only where the columns ``by`` agree.
    """

    def spread(edges: DataFrame, name: str) -> DataFrame:
        rows = edges.select(*[F.col(c).alias(f"{name}_{c}") for c in ("pid", "ax", "ay", "bx", "by")], *by)
        box = rows.select("*", *[f(f"{name}_a{c}", f"{name}_b{c}").alias(n) for f, c, n in ((F.least, "x", "xmin"), (F.least, "y", "ymin"), (F.greatest, "x", "xmax"), (F.greatest, "y", "ymax"))])
        rows = box_cells(box, size).drop("xmin", "ymin", "xmax", "ymax")
        return rows if skipped is None else rows.join(shuffled(skipped.select(*by, "cx", "cy")), [*by, "cx", "cy"], "left_anti")

    met = spread(left, "a").join(shuffled(spread(right, "b")), [*by, "cx", "cy"]).drop(*by, "cx", "cy")
    dx, dy, ex, ey = (F.col(f"{n}_b{c}") - F.col(f"{n}_a{c}") for n, c in (("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")))
    gx, gy = F.col("b_ax") - F.col("a_ax"), F.col("b_ay") - F.col("a_ay")
    cross = dx * ey - dy * ex
    t, u = (gx * ey - gy * ex) / F.nullif(cross, F.lit(0.0)), (gx * dy - gy * dx) / F.nullif(cross, F.lit(0.0))
    close = F.lit(0.0)
    flat = cross == 0
    on_line = F.abs(gx * dy - gy * dx) == 0
    overlap = (F.greatest("a_ax", "a_bx") >= F.least("b_ax", "b_bx")) & (F.greatest("b_ax", "b_bx") >= F.least("a_ax", "a_bx"))
    overlap = overlap & (F.greatest("a_ay", "a_by") >= F.least("b_ay", "b_by")) & (F.greatest("b_ay", "b_by") >= F.least("a_ay", "a_by"))
    rows = met.withColumn("t", t).withColumn("u", u)
    return rows.where((flat & on_line & overlap) | (F.col("t").between(close, 1.0) & F.col("u").between(close, 1.0))).distinct()


def intersecting(areas: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Pairs (id, pid) of areas and polygons (both as edges) that share a point: edges meet, or one holds the other."""
    met = crossing(areas, edges, size).select(F.col("a_pid").alias("id"), F.col("b_pid").alias("pid"))
    corner = F.min(F.struct("ax", "ay"))
    mine = areas.groupBy("pid").agg(corner.alias("p")).select(F.col("pid").alias("id"), "p.ax", "p.ay").toDF("id", "x", "y")
    theirs = edges.groupBy("pid").agg(corner.alias("p")).select(F.col("pid").alias("id"), "p.ax", "p.ay").toDF("id", "x", "y")
    holds = inside(theirs, areas, size).select(F.col("pid").alias("id"), F.col("id").alias("pid"))
    return met.unionByName(inside(mine, edges, size)).unionByName(holds).distinct()


def countries_of(areas: DataFrame, edges: DataFrame, codes: DataFrame, size: float, reach: float = 0.25) -> DataFrame:
    """Each area's codes (id, codes: sorted): all that it touches, else the nearest within ``reach``, else none."""
    met = intersecting(areas, edges, size).withColumn("d", F.lit(-1.0))
    alone = areas.join(met.select(F.col("id").alias("pid")).distinct(), "pid", "left_anti")
    corner = lambda e: e.select(F.col("pid").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    near = near_edges(corner(alone), edges, reach)
    back = near_edges(corner(edges), alone, reach).select(F.col("pid").alias("id"), F.col("id").alias("pid"), "d")
    nearest = near.unionByName(back).join(codes.select("pid", "code"), "pid").groupBy("id").agg(F.min_by("pid", F.struct(F.round("d", 9), "code")).alias("pid"))
    every = met.select("id", "pid").unionByName(nearest.select("id", "pid")).join(codes.select("pid", "code"), "pid")
    found = every.groupBy("id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return areas.select(F.col("pid").alias("id")).distinct().join(found, "id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def overlap_areas(areas: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """Areas of the intersections (id, pid, area), exactly, for polygons of any shape.

    Between neighbouring heights at which either has a corner or their edges cross, the
    common width changes linearly, so its value in the middle times the height is exact.
    """
    pairs = written(intersecting(areas, edges, size), "pairs")
    mine = areas.withColumnRenamed("pid", "id").join(pairs, "id").select("id", "pid", F.lit(0).alias("side"), "ax", "ay", "bx", "by")
    theirs = edges.join(pairs, "pid").select("id", "pid", F.lit(1).alias("side"), "ax", "ay", "bx", "by")
    span = areas.groupBy("pid").agg(F.min(F.least("ay", "by")).alias("low"), F.max(F.greatest("ay", "by")).alias("high")).withColumnRenamed("pid", "id")
    theirs = theirs.join(span, "id").where(F.greatest("ay", "by").between(F.col("low"), 1e300) & (F.least("ay", "by") <= F.col("high"))).drop("low", "high")
    both = mine.unionByName(theirs)
    cuts = crossing(areas, edges, size).where("t IS NOT NULL").select(F.col("a_pid").alias("id"), F.col("b_pid").alias("pid"), (F.col("a_ay") + F.col("t") * (F.col("a_by") - F.col("a_ay"))).alias("y"))
    heights = both.select("id", "pid", F.explode(F.array("ay", "by")).alias("y")).unionByName(cuts).distinct()
    above = F.lead("y").over(Window.partitionBy("id", "pid").orderBy("y"))
    bands = heights.withColumn("top", above).where("top IS NOT NULL").withColumn("mid", (F.col("y") + F.col("top")) / 2)
    met = both.where("ay <> by").join(bands, ["id", "pid"]).where((F.col("ay") > F.col("mid")) != (F.col("by") > F.col("mid")))
    x = F.col("ax") + (F.col("mid") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    line = Window.partitionBy("id", "pid", "mid").orderBy("x", "side")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = met.select("id", "pid", "mid", (F.col("top") - F.col("y")).alias("h"), x.alias("x"), "side")
    rows = rows.select("*", F.lead("x").over(line).alias("_next"), F.sum(1 - F.col("side")).over(so_far).alias("_mine"), F.sum("side").over(so_far).alias("_theirs"))
    common = rows.where("_mine % 2 = 1 AND _theirs % 2 = 1 AND _next IS NOT NULL")
    return common.groupBy("id", "pid").agg(F.sum((F.col("_next") - F.col("x")) * F.col("h")).alias("area"))


def primary_country(areas: DataFrame, edges: DataFrame, codes: DataFrame, size: float) -> DataFrame:
    """Each area's code with the largest overlap, all parts of a code together; ties to the first; UNKNOWN without any."""
    sums = overlap_areas(areas, edges, size).join(codes.select("pid", "code"), "pid").groupBy("id", "code").agg(F.sum("area").alias("area"))
    best = sums.where("area > 0").groupBy("id").agg(F.min_by("code", F.struct(-F.round("area", 9), "code")).alias("code"))
    return areas.select(F.col("pid").alias("id")).distinct().join(best, "id", "left").withColumn("code", F.coalesce("code", F.lit("UNKNOWN")))


def choose_crs(rings: DataFrame, areas: DataFrame, edges: DataFrame, codes: DataFrame, table: dict[str, str], size: float) -> DataFrame:
    """The reference system of areas (id, ring: closed): the one country's, or of several that with the largest overlap, else UTM.

    The UTM zone is that of the mean of the ring's vertices, the closing one counted.
    """
    from ..functions.geometry import utm_epsg
    from ..functions.lookups import looked_up

    found = countries_of(areas, edges, codes, size).join(primary_country(areas, edges, codes, size), "id")
    one = F.when(F.size("codes") == 1, F.get("codes", 0)).when(F.size("codes") > 1, F.col("code"))
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda acc, p: acc + p[c]) / F.size("ring")
    crs = F.coalesce(looked_up(one, table, None), utm_epsg(mean("x"), mean("y")))
    return rings.join(found, "id", "left").select("id", crs.alias("crs"))


def cell_lookup(points: DataFrame, mask: DataFrame, bounds: tuple[float, float, float, float], height: int, width: int) -> DataFrame:
    """Points (id, x, y) with ``hit``: whether the mask (r, c; row 0 in the north) has the cell they lie in. Outside the bounds: no."""
    west, south, east, north = bounds
    within = F.col("x").between(west, east) & F.col("y").between(south, north)
    c = F.least(((F.col("x") - west) / (east - west) * width).cast("long"), F.lit(width - 1))
    r = F.least(((north - F.col("y")) / (north - south) * height).cast("long"), F.lit(height - 1))
    marked = points.withColumn("r", F.when(within, r)).withColumn("c", F.when(within, c))
    on = mask.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).distinct().withColumn("hit", F.lit(True))
    return marked.join(on, ["r", "c"], "left").drop("r", "c").withColumn("hit", F.coalesce("hit", F.lit(False)))


def middle_vertices(points: DataFrame) -> DataFrame:
    """The vertex of each line (line_id, seq, x, y) at half its number, counted from 0: id, x, y."""
    order, size = Window.partitionBy("line_id").orderBy("seq"), Window.partitionBy("line_id")
    rows = points.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(size))
    return rows.where((F.col("_n") >= 2) & (F.col("_i") == F.floor(F.col("_n") / 2))).select(F.col("line_id").alias("id"), "x", "y")


def _directed(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges of simple polygons of one outer ring, turned so that the inside is on the left."""
    twice = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")).over(Window.partitionBy("pid"))
    rows = edges.withColumn("_s", twice)
    turn = lambda a, b: F.when(F.col("_s") >= 0, F.col(a)).otherwise(F.col(b))
    return rows.select("pid", *by, turn("ax", "bx").alias("ax"), turn("ay", "by").alias("ay"), turn("bx", "ax").alias("bx"), turn("by", "ay").alias("by"))


def _copies(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each polygon (pid) with the smallest id (first) of those that have the same edges and ``by``; sets of edges are told apart by their number and 128 bits of sums."""
    one = [F.xxhash64(F.lit(k), "ax", "ay", "bx", "by").cast("decimal(38,0)") for k in (1, 2)]
    marks = edges.groupBy("pid", *by).agg(F.count("*").alias("n"), *[F.sum(h).alias(f"s{k}") for k, h in enumerate(one)])
    least = marks.groupBy(*by, "n", "s0", "s1").agg(F.min("pid").alias("first"))
    return marks.join(shuffled(least), [*by, "n", "s0", "s1"]).select("pid", "first")


def _meets_cell(size: float) -> Column:
    """Whether an edge meets the cell (cx, cy), one of those that its box touches."""
    low, high = [F.lit(0.0)], [F.lit(1.0)]
    for axis in "xy":
        start, way = F.col("a" + axis), F.col("b" + axis) - F.col("a" + axis)
        t = [((F.col("c" + axis) + k) * size - start) / F.nullif(way, F.lit(0.0)) for k in (0, 1)]
        low.append(F.least(*t))  # null, and passed over, where the edge runs along the other axis
        high.append(F.greatest(*t))
    return F.greatest(*low) <= F.least(*high)


def _outside(points: DataFrame, covered: DataFrame, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Points (x, y) that are in none of the covered cells of their ``by``."""
    same = (cell(F.col("x"), size) == F.col("_cx")) & (cell(F.col("y"), size) == F.col("_cy"))
    for k in by:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return points.join(shuffled(covered.select(*[F.col(k).alias(f"_{k}") for k in (*by, "cx", "cy")])), same, "left_anti")


def _covered(edges: DataFrame, size: float, margin: float, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cells that lie inside a polygon, none of whose edges comes within ``margin``: cx, cy, cover (the smallest such pid), for each ``by``.

    Also links (a: pid, b: cover) of all polygons that meet such a cell; and the folders of both.
    """
    inner, inner_path = stage(rasterize_polygons(edges.withColumnRenamed("pid", "id"), size).select(F.col("id").alias("pid"), F.col("c").alias("cx"), F.col("r").alias("cy")), "inner")
    known = inner.join(shuffled(edges.select("pid", *by).distinct()), "pid") if by else inner
    ends = [(f(f"a{c}", f"b{c}") + k * margin).alias(n) for f, k, c, n in ((F.least, -1, "x", "xmin"), (F.least, -1, "y", "ymin"), (F.greatest, 1, "x", "xmax"), (F.greatest, 1, "y", "ymax"))]
    touched = box_cells(edges.select("*", *ends), size)
    own = known.join(shuffled(touched), ["pid", "cx", "cy"], "left_anti")
    covered, path = stage(own.groupBy(*by, "cx", "cy").agg(F.min("pid").alias("cover")), "covered")
    passing = touched.where(_meets_cell(size)).select("pid", *by, "cx", "cy")
    links, link_path = stage(known.select("pid", *by, "cx", "cy").unionByName(passing).join(shuffled(covered), [*by, "cx", "cy"]).select(F.col("pid").alias("a"), F.col("cover").alias("b")).distinct(), "links")
    return covered, links, [inner_path, path, link_path]


def dissolve(polygons: DataFrame, edges: DataFrame, size: float, sliver: float, scale: float = 1.0, digits: int = 9, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Overlapping and touching polygons (id, name, area) become one feature, with the outline of their union.

    ``edges``: the polygons' outer rings (pid: the id). One polygon stands for its exact copies. Edges are cut where they meet others
    of their group; pieces inside another member go, pieces on a common border stay once
    or cancel out; the rest is the outline, whose pieces chain into rings. Nothing in a cell that
    lies inside one polygon is on an outline: there polygons are linked with that one, and edges meet only
    in the other cells, so heaps of polygons cost what they show of their rim. Parts below
    ``sliver`` (in units of area times ``scale``) go. Returns the features (group, members,
    name, area: of the union) and the outline pieces (group, ring, seq, x, y; holes run
    clockwise). A feature's name is that of the named, then largest, then first member. Polygons that
    differ in their columns ``by`` (none of them null) never meet, so many classes are dissolved at once.
    """
    spark = polygons.sparkSession
    if by:
        edges = edges.join(shuffled(polygons.select(F.col("id").alias("pid"), *by).distinct()), "pid")
    every, every_path = stage(_directed(edges, by), "directed")
    copies, copies_path = stage(_copies(every, by), "copies")
    turned, turned_path = stage(every.join(shuffled(copies.where("pid = first").select("pid")), "pid", "left_semi"), "turned")
    covered, links, cover_paths = _covered(turned, size, max(size * 1e-6, 2 * 10.0**-digits), by)
    met, met_path = stage(crossing(turned, turned, size, covered, by).where("a_pid <> b_pid"), "met")
    corners = turned.groupBy("pid", *by).agg(F.min(F.struct("ax", "ay")).alias("p")).select(F.col("pid").alias("id"), *by, F.col("p.ax").alias("x"), F.col("p.ay").alias("y"))
    held = inside(_outside(corners, covered, size, by), turned, size, by)
    touching = links.unionByName(met.select(F.col("a_pid").alias("a"), F.col("b_pid").alias("b"))).unionByName(held.select(F.col("id").alias("a"), F.col("pid").alias("b")))
    groups = components(touching.where("a <> b").distinct())
    known = polygons.join(shuffled(copies.withColumnRenamed("pid", "id")), "id", "left")
    grouped, group_path = stage(known.join(shuffled(groups), known["first"] == groups["node"], "left").select("id", *by, "name", "area", F.coalesce("component", "first", "id").alias("group")), "groups")
    own = ["pid", "ax", "ay", "bx", "by"]
    # cut: at crossings with other members, and at ends of others that lie on the edge
    dx, dy = F.col("a_bx") - F.col("a_ax"), F.col("a_by") - F.col("a_ay")
    along = lambda n: ((F.col(f"b_{n}x") - F.col("a_ax")) * dx + (F.col(f"b_{n}y") - F.col("a_ay")) * dy) / (dx * dx + dy * dy)
    places = F.when(F.col("t").isNotNull(), F.array("t")).otherwise(F.array(along("a"), along("b")))
    cuts = met.select(*[F.col(f"a_{c}").alias(c) for c in own], F.explode(places).alias("t")).where("t > 0 AND t < 1")
    stops = turned.select(*own, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t")).unionByName(cuts).withColumn("t", F.round("t", 12)).distinct()
    after = F.lead("t").over(Window.partitionBy(*own).orderBy("t"))
    at = lambda c, t: F.round(F.col("a" + c) + t * (F.col("b" + c) - F.col("a" + c)), digits)
    pieces = stops.withColumn("_u", after).where("_u IS NOT NULL")
    pieces = pieces.select("pid", *[at(c, F.col(t)).alias(n) for t, c, n in (("t", "x", "px"), ("t", "y", "py"), ("_u", "x", "qx"), ("_u", "y", "qy"))]).where("px <> qx OR py <> qy")
    pieces = pieces.join(shuffled(grouped.select(F.col("id").alias("pid"), *by, "group")), "pid")
    pieces = _outside(pieces.withColumn("x", (F.col("px") + F.col("qx")) / 2).withColumn("y", (F.col("py") + F.col("qy")) / 2), covered, size, by).drop("x", "y")
    # common borders: pieces in one direction stay once, pieces in both directions cancel
    p, q = (F.struct(F.col(f"{n}x").alias("x"), F.col(f"{n}y").alias("y")) for n in "pq")
    line = F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    way = (p < q).cast("int")
    merged = pieces.withColumn("_line", line).withColumn("_way", way).groupBy("group", *by, "_line").agg(F.min("_way").alias("_low"), F.max("_way").alias("_high"), F.min(F.struct("pid", "px", "py", "qx", "qy")).alias("e"), F.collect_set("pid").alias("owners"))
    # numbered in the order of their places: a ring begins at its leftmost corner, however pieces are dealt
    merged = merged.where("_low = _high").select("group", *by, "owners", "e.*").repartitionByRange("px", "py", "qx", "qy", "group")
    merged = merged.sortWithinPartitions("px", "py", "qx", "qy", "group").withColumn("id", F.monotonically_increasing_id())
    merged, merged_path = stage(merged, "pieces")
    middles = merged.select("id", *by, ((F.col("px") + F.col("qx")) / 2).alias("x"), ((F.col("py") + F.col("qy")) / 2).alias("y"))
    held = inside(middles, turned, size, by).join(shuffled(merged.select("id", "owners")), "id").where(~F.array_contains("owners", F.col("pid"))).select("id").distinct()
    rim, rim_path = stage(merged.join(shuffled(held), "id", "left_anti").select("id", "group", "px", "py", "qx", "qy"), "rim")
    # chain: a piece follows the one that ends where it begins; of several, the sharpest left turn's, so rings that touch stay apart
    nxt = rim.select(F.col("group"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("id").alias("_next"), F.col("qx").alias("_x"), F.col("qy").alias("_y"))
    turn = F.pmod(F.atan2(F.col("_y") - F.col("qy"), F.col("_x") - F.col("qx")) - F.atan2(F.col("py") - F.col("qy"), F.col("px") - F.col("qx")), F.lit(6.283185307179586))
    linked, linked_path = stage(rim.join(shuffled(nxt), ["group", "qx", "qy"]).groupBy("id").agg(F.min_by("_next", F.struct(F.round(-turn, 9), "_next")).alias("next")), "linked")
    rings, ring_path = stage(components(linked.select(F.col("id").alias("a"), F.col("next").alias("b"))), "rings")
    # places along each ring: pointers doubled from every piece to the ring's first
    first = rings.select("component").distinct().select(F.col("component").alias("id"))
    rows, path = stage(linked.join(shuffled(first), linked["next"] == first["id"], "left_anti").select("id", F.col("next").alias("at"), F.lit(1).cast("long").alias("far")), "places")
    for _ in range(63):
        further = rows.select(F.col("id").alias("at"), F.col("at").alias("_to"), F.col("far").alias("_more"))
        jumped = rows.join(shuffled(further), "at", "left").select("id", F.coalesce("_to", "at").alias("at"), (F.col("far") + F.coalesce("_more", F.lit(0))).alias("far"), F.col("_to").isNotNull().alias("_moved"))
        after_, new = stage(jumped, "places")
        drop_stages(spark, path)
        rows, path = after_.drop("_moved"), new
        if after_.where("_moved").isEmpty():
            break
    placed = rim.join(shuffled(rings.withColumnRenamed("node", "id")), "id").join(shuffled(rows.select("id", "far")), "id", "left")
    ring = Window.partitionBy("group", "component")
    area = F.sum(F.col("px") * F.col("qy") - F.col("qx") * F.col("py")).over(ring) / 2
    outline = placed.select("group", F.col("component").alias("ring"), F.row_number().over(ring.orderBy(F.desc_nulls_last("far"), "id")).alias("seq"), F.col("px").alias("x"), F.col("py").alias("y"), area.alias("area"))
    outline, _ = stage(outline, "outline")
    sizes = outline.where("seq = 1").groupBy("group").agg(F.sum("area").alias("area"))
    best = F.max_by("name", F.struct((F.trim(F.coalesce("name", F.lit(""))) != "").alias("named"), F.round("area", 9).alias("area"), (-F.col("id")).alias("first")))
    features = grouped.groupBy("group").agg(F.count("*").alias("members"), best.alias("name")).join(sizes, "group").where(F.col("area") * scale >= sliver)
    features, _ = stage(features, "features")
    drop_stages(spark, *cover_paths, met_path, every_path, copies_path, turned_path, group_path, merged_path, rim_path, linked_path, ring_path, path)
    return features, outline.join(features.select("group"), "group", "left_semi").select("group", "ring", "seq", "x", "y", "area")
