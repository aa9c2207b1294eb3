"""Queries of road topology and of polygons that are no boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import lookups as L
from ..operators import polygons as P
from ..operators import topology as T
from . import rules
from .derive import _COUNTRIES, derived, pick, real, with_tables

QUERIES, SQL = {}, {}
col, lit = F.col, F.lit


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Diamonds |x - cx| + |y - cy| <= r: countries by nation, areas by supplier; in u = x + y, v = x - y they are squares.
_COUNTRY = (
    "nation",
    ["CAST(n_nationkey AS BIGINT) AS pid", f"{pick('n_nationkey', *_COUNTRIES)} AS code", f"(n_nationkey % 5) * {real(10)} + {real(5)} AS cx", f"CAST((n_nationkey - n_nationkey % 5) / 5 AS BIGINT) * {real(10)} + {real(5)} AS cy", f"{real(6)} AS r"],
)
_AREA = (
    "supplier",
    ["CAST(s_suppkey AS BIGINT) AS pid", f"(s_suppkey * 37 % 560) * {real(0.1)} - {real(2.987)} AS cx", f"(s_suppkey * 53 % 560) * {real(0.1)} - {real(2.993)} AS cy", f"(1 + s_suppkey % 7) * {real(0.5)} AS r"],
)
_PLACES = f"SELECT CAST(c_custkey AS BIGINT) AS id, (c_custkey * 17 % 1103) * {real(0.05)} - {real(2.487)} AS x, (c_custkey * 29 % 1109) * {real(0.05)} - {real(2.493)} AS y FROM customer"
_DIAMONDS = "WITH " + ", ".join(f"{n} AS (SELECT *, cx + cy AS cu, cx - cy AS cv FROM (SELECT {', '.join(e)} FROM {t}))" for n, (t, e) in (("k", _COUNTRY), ("a", _AREA))) + f", p AS ({_PLACES}) "


def _diamonds(spark, sf_dir, which):
    """The table with its ring, and its edges."""
    base, expressions = which
    rows = spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*expressions)
    corner = lambda x, y: F.struct((col("cx") + x * col("r")).alias("x"), (col("cy") + y * col("r")).alias("y"))
    rows = rows.withColumn("ring", F.array(*[corner(x, y) for x, y in ((1, 0), (0, 1), (-1, 0), (0, -1), (1, 0))]))
    return rows, P.polygon_edges(rows.select("pid", F.array("ring").alias("rings")))


_GAP = "sqrt(pow(greatest(abs({0}u - cu) - {1}, 0), 2) + pow(greatest(abs({0}v - cv) - {1}, 0), 2)) / sqrt(2::DOUBLE)"


@query(
    _DIAMONDS
    + f", d AS (SELECT p.id, code, {_GAP.format('p.', 'r')} AS d FROM (SELECT id, x + y AS u, x - y AS v FROM p) p, k) SELECT p.id, min_by(code, (round(d, 9), code)) AS code FROM p LEFT JOIN (SELECT * FROM d WHERE d <= 0.25) d USING (id) GROUP BY p.id"
)
def d1_points_in_polygons(spark, sf_dir):
    places = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*_PLACES.removeprefix("SELECT ").removesuffix(" FROM customer").replace(" AS id, ", " AS id|").replace(" AS x, ", " AS x|").split("|"))
    countries, edges = _diamonds(spark, sf_dir, _COUNTRY)
    return P.points_in_polygons(places, edges, countries, 5.0).select("id", "code")


_PAIRS = _DIAMONDS + ", ak AS (SELECT a.pid AS id, code, least(a.cu + a.r, k.cu + k.r) - greatest(a.cu - a.r, k.cu - k.r) AS ou, least(a.cv + a.r, k.cv + k.r) - greatest(a.cv - a.r, k.cv - k.r) AS ov FROM a, k), "
_LISTS = (
    "near AS (SELECT id, min_by(code, (round(d, 9), code)) AS code FROM (SELECT *, sqrt(pow(greatest(-ou, 0), 2) + pow(greatest(-ov, 0), 2)) / sqrt(2::DOUBLE) AS d FROM ak) WHERE d <= 0.25 GROUP BY id), "
    "hit AS (SELECT id, list_sort(list(DISTINCT code)) AS codes FROM ak WHERE ou > 0 AND ov > 0 GROUP BY id), "
    "found AS (SELECT a.pid AS id, coalesce(hit.codes, CASE WHEN near.code IS NULL THEN [] ELSE [near.code] END) AS codes FROM a LEFT JOIN hit ON hit.id = a.pid LEFT JOIN near ON near.id = a.pid), "
    "sums AS (SELECT id, code, sum(ou * ov / 2) AS area FROM ak WHERE ou > 0 AND ov > 0 GROUP BY ALL) "
)


@query(_PAIRS + _LISTS + "SELECT id, array_to_string(codes, ',') AS codes FROM found")
def d2_polygon_countries(spark, sf_dir):
    countries, edges = _diamonds(spark, sf_dir, _COUNTRY)
    _, areas = _diamonds(spark, sf_dir, _AREA)
    return P.countries_of(areas, edges, countries, 5.0).select("id", F.concat_ws(",", "codes").alias("codes"))


@query(_PAIRS + _LISTS + "SELECT id, code, round(area, 6) AS area FROM sums")
def d2_polygon_overlaps(spark, sf_dir):
    countries, edges = _diamonds(spark, sf_dir, _COUNTRY)
    _, areas = _diamonds(spark, sf_dir, _AREA)
    found = P.overlap_areas(areas, edges, 5.0).join(countries.select("pid", "code"), "pid")
    return found.groupBy("id", "code").agg(F.round(F.sum("area"), 6).alias("area"))


@query(_PAIRS + _LISTS + "SELECT a.pid AS id, coalesce(s.code, 'UNKNOWN') AS code FROM a LEFT JOIN (SELECT id, min_by(code, (-round(area, 9), code)) AS code FROM sums GROUP BY id) s ON s.id = a.pid")
def d3_primary_country(spark, sf_dir):
    countries, edges = _diamonds(spark, sf_dir, _COUNTRY)
    _, areas = _diamonds(spark, sf_dir, _AREA)
    return P.primary_country(areas, edges, countries, 5.0)


@query(
    _PAIRS
    + _LISTS
    + f""", best AS (SELECT id, min_by(code, (-round(area, 9), code)) AS code FROM sums GROUP BY id), one AS (SELECT f.id, CASE WHEN len(codes) = 1 THEN codes[1] WHEN len(codes) > 1 THEN best.code END AS code FROM found f LEFT JOIN best USING (id))
SELECT id, coalesce({L.sql_case('code', L.CRS)}, CASE WHEN y >= 0 THEN 'EPSG:326' ELSE 'EPSG:327' END || lpad(CAST(CAST(floor((x + 180) / 6) AS INTEGER) + 1 AS VARCHAR), 2, '0')) AS crs
FROM (SELECT pid AS id, (((((cx + r) + cx) + (cx - r)) + cx) + (cx + r)) / 5 AS x, ((((cy + (cy + r)) + cy) + (cy - r)) + cy) / 5 AS y FROM a) JOIN one USING (id)"""
)
def c10_choose_crs(spark, sf_dir):
    countries, edges = _diamonds(spark, sf_dir, _COUNTRY)
    rings, areas = _diamonds(spark, sf_dir, _AREA)
    return P.choose_crs(rings.select(col("pid").alias("id"), "ring"), areas, edges, countries, L.CRS, 5.0)


#: A mask of 30 x 40 cells over the terrain of the lines.
_BOX = (16.0, 59.0, 16.04, 59.03)
_MASK = "(SELECT CAST((p_partkey - p_partkey % 40) / 40 AS BIGINT) % 30 AS r, p_partkey % 40 AS c FROM part GROUP BY 1, 2 HAVING sum(p_partkey) % 5 < 2)"
_MIDDLE = with_tables("roads", "line_points") + f""", m AS (SELECT line_id AS id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY line_id) AS n FROM line_points) WHERE n >= 2 AND i = n // 2),
h AS (SELECT m.*, least(CAST(trunc((59.03::DOUBLE - y) / (59.03::DOUBLE - 59.0::DOUBLE) * 30) AS BIGINT), 29) AS r, least(CAST(trunc((x - 16.0::DOUBLE) / (16.04::DOUBLE - 16.0::DOUBLE) * 40) AS BIGINT), 39) AS c FROM m),
hit AS (SELECT id, h.x BETWEEN 16.0::DOUBLE AND 16.04::DOUBLE AND h.y BETWEEN 59.0::DOUBLE AND 59.03::DOUBLE AND k.r IS NOT NULL AS hit FROM h LEFT JOIN {_MASK} k ON k.r = h.r AND k.c = h.c) """


def _middle_hits(spark, sf_dir):
    cells = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", "CAST((p_partkey - p_partkey % 40) / 40 AS BIGINT) % 30 AS r", "p_partkey % 40 AS c")
    mask = cells.groupBy("r", "c").agg(F.sum("p_partkey").alias("all")).where("all % 5 < 2").select("r", "c")  # every part bears on its cell
    return P.cell_lookup(P.middle_vertices(derived(spark, sf_dir, "line_points")), mask, _BOX, 30, 40)


@query(_MIDDLE + "SELECT id, hit FROM hit")
def d4_cell_lookup(spark, sf_dir):
    return _middle_hits(spark, sf_dir).select("id", "hit")


@query(
    _MIDDLE
    + ", ctx AS (SELECT roads.* EXCLUDE (in_forest, in_urban), false AS in_forest, coalesce(hit, false) AS in_urban FROM roads LEFT JOIN hit USING (id))"
    + rules._ROADS[len(with_tables("roads")) - 1 :].replace("FROM roads)", "FROM ctx)")
    + "SELECT id, surface, width_m, greatest(1, CAST(round_even(width_m / 2 / 2, 0) AS INTEGER)) AS half_px FROM done"
)
def b28_road_surface_in_context(spark, sf_dir):
    """B18 with the urban mask under the road's middle vertex in place of a given mark, and the half width in cells of 2 m."""
    roads = derived(spark, sf_dir, "roads").drop("in_urban", "in_forest").join(_middle_hits(spark, sf_dir).select("id", "hit"), "id", "left")
    urban = F.coalesce("hit", lit(False))
    rows = roads.withColumn("surface", C.road_surface(col("highway"), col("surface_tag"), col("country"), lit(False), urban))
    rows = rows.withColumn("width_m", C.road_width(col("highway"), col("width_tag"), col("lanes_tag"), col("surface")))
    return rows.select("id", "surface", "width_m", F.greatest(lit(1), F.bround(col("width_m") / 2 / 2, 0).cast("int")).alias("half_px"))


def _way_points(spark, sf_dir, shift: str = "0"):
    ways = derived(spark, sf_dir, "ways")
    first = ways.selectExpr("id AS line_id", "0 AS seq", "ax AS x", f"ay + {shift} AS y")
    return ways, first.unionByName(ways.selectExpr("id AS line_id", "1 AS seq", "bx AS x", "by_ AS y"))


_RUNS = with_tables("ways") + """, o AS (SELECT *, lag(id) OVER (ORDER BY id) AS before, lag(highway) OVER (ORDER BY id) AS kind FROM ways),
s AS (SELECT *, sum(CASE WHEN before = id - 1 AND kind = highway THEN 0 ELSE 1 END) OVER (ORDER BY id) AS run FROM o),
r AS (SELECT *, min(id) OVER (PARTITION BY run) AS road FROM s) """


@query(
    _RUNS
    + "SELECT road AS line_id, CAST(row_number() OVER (PARTITION BY road ORDER BY k) AS INTEGER) AS seq, round(x, 7) AS x, round(y, 7) AS y FROM (SELECT road, id - 1 AS k, ax AS x, ay AS y FROM r WHERE id = road UNION ALL SELECT road, id, bx, by_ FROM r)"
)
def d8_stitched_lines(spark, sf_dir):
    ways, points = _way_points(spark, sf_dir)
    vertices, _ = T.stitch_lines(points, ways.select(col("id").alias("line_id"), "highway"), ("highway",))
    return vertices.select("line_id", "seq", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


@query(_RUNS + "SELECT road AS line_id, string_agg(id, ',' ORDER BY id) AS ids, CAST(count(*) AS INTEGER) AS n FROM r GROUP BY road")
def d8_stitched_roads(spark, sf_dir):
    ways, points = _way_points(spark, sf_dir)
    _, roads = T.stitch_lines(points, ways.select(col("id").alias("line_id"), "highway"), ("highway",))
    return roads.select("line_id", F.concat_ws(",", col("ids").cast("array<string>")).alias("ids"), "n")


def _ranked(ways):
    return ways.select(col("id").alias("line_id"), F.when(col("highway") == "primary", 2).when(col("highway") == "residential", 8).otherwise(11).alias("rank"))


_M = "6371000 * sqrt(pow(radians({1}x - {0}x) * cos(radians(({0}y + {1}y) / 2)), 2) + pow(radians({1}y - {0}y), 2))"
_SNAP = (
    with_tables("ways")
    + f""", v AS (SELECT *, CASE highway WHEN 'primary' THEN 2 WHEN 'residential' THEN 8 ELSE 11 END AS rank FROM (SELECT id AS line, highway, 0 AS seq, ax AS x, ay + (id % 3) * {real(0.00005)} AS y FROM ways UNION ALL SELECT id, highway, 1, bx, by_ FROM ways)),
m AS (SELECT e.line, e.seq, min_by(struct_pack(x := b.x, y := b.y, d := {_M.format('e.', 'b.')}), (round({_M.format('e.', 'b.')}, 6), b.line, b.x, b.y)) AS t FROM v e JOIN v b ON b.rank < e.rank AND b.line <> e.line AND b.x BETWEEN e.x - 0.0003 AND e.x + 0.0003 AND b.y BETWEEN e.y - 0.0003 AND e.y + 0.0003
  WHERE {_M.format('e.', 'b.')} <= 12 GROUP BY e.line, e.seq),
f AS (SELECT v.*, m.t FROM v LEFT JOIN m ON m.line = v.line AND m.seq = v.seq AND m.t.d > 0),
p AS (SELECT a.line, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy, a.t AS s, b.t AS t FROM f a JOIN f b ON a.line = b.line AND a.seq = 0 AND b.seq = 1),
g AS (SELECT *, s IS NOT NULL AND {_M.format('s.', 'q')} >= 1 AS m0 FROM p),
n AS (SELECT *, CASE WHEN m0 THEN s.x ELSE px END AS nx, CASE WHEN m0 THEN s.y ELSE py END AS ny FROM g),
w AS (SELECT *, t IS NOT NULL AND {_M.format('n', 't.')} >= 1 AS m1 FROM n) """
)


@query(_SNAP + "SELECT line AS line_id, 0 AS seq, round(nx, 7) AS x, round(ny, 7) AS y, m0 AS moved FROM w UNION ALL SELECT line, 1, round(CASE WHEN m1 THEN t.x ELSE qx END, 7), round(CASE WHEN m1 THEN t.y ELSE qy END, 7), m1 FROM w")
def d6_snapped_lines(spark, sf_dir):
    ways, points = _way_points(spark, sf_dir, f"(id % 3) * {real(0.00005)}")
    moved = T.snap_lines(points, _ranked(ways))
    return moved.select("line_id", "seq", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"), "moved")


@query(
    _RUNS
    + f""", j AS (SELECT node, count(*) AS c FROM (SELECT a AS node FROM ways UNION ALL SELECT b FROM ways) GROUP BY node)
SELECT (SELECT count(*) FROM ways) AS ways, (SELECT count(DISTINCT road) FROM r) AS roads, (SELECT count(*) + count(DISTINCT road) FROM r) AS points_after, 2 * (SELECT count(*) FROM ways) AS points_before,
  (SELECT count(*) FROM j WHERE c >= 3) AS junctions, (SELECT count(*) FROM j WHERE c = 1) AS dead_ends"""
)
def e15_network_report(spark, sf_dir):
    """Stitching and snapping in figures; the parts have their own oracles."""
    ways, points = _way_points(spark, sf_dir)
    vertices, _ = T.stitch_lines(points, ways.select(col("id").alias("line_id"), "highway"), ("highway",))
    stats = T.network_stats(points, vertices, T.snap_lines(points, _ranked(ways)))
    return stats.drop("moved")  # d6_snapped_lines has the moves one by one


@query(
    """WITH RECURSIVE c AS (SELECT CAST(s_suppkey AS BIGINT) AS id, s_suppkey * 7 % 41 AS x, s_suppkey * 11 % 31 AS y, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS name FROM supplier),
g(id, other) AS (SELECT id, id FROM c UNION SELECT g.id, b.id FROM g JOIN c a ON a.id = g.other JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
m AS (SELECT c.*, w.grp FROM c JOIN (SELECT id, min(other) AS grp FROM g GROUP BY id) w USING (id))
SELECT grp AS "group", count(*) AS members, min_by(name, (CASE WHEN coalesce(name, '') = '' THEN 1 ELSE 0 END, id)) AS name, CAST(count(DISTINCT (x, y)) AS DOUBLE) AS area FROM m GROUP BY grp"""
)
def d9_dissolved_features(spark, sf_dir):
    features, _ = _dissolved(spark, sf_dir)
    return features.withColumn("area", F.round("area", 6))


def _dissolved(spark, sf_dir):
    """Unit squares on a grid: those that share a side or a corner are one."""
    k = col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        k.cast("long").alias("id"), F.when(k % 3 == 0, col("s_name")).alias("name"), lit(1.0).alias("area"), (k * 7 % 41).cast("double").alias("x"), (k * 11 % 31).cast("double").alias("y")
    )
    corner = lambda a, b: F.struct((col("x") + a).alias("x"), (col("y") + b).alias("y"))
    rings = rows.select(col("id").alias("pid"), F.array(F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])).alias("rings"))
    return P.dissolve(rows.select("id", "name", "area"), P.polygon_edges(rings), 2.0, 0.5)


@query(
    """WITH c AS (SELECT DISTINCT s_suppkey * 7 % 41 AS x, s_suppkey * 11 % 31 AS y FROM supplier),
e AS (SELECT x AS px, y AS py, x + 1 AS qx, y AS qy FROM c WHERE (x, y - 1) NOT IN (SELECT (x, y) FROM c) UNION ALL SELECT x + 1, y + 1, x, y + 1 FROM c WHERE (x, y + 1) NOT IN (SELECT (x, y) FROM c)
  UNION ALL SELECT x + 1, y, x + 1, y + 1 FROM c WHERE (x + 1, y) NOT IN (SELECT (x, y) FROM c) UNION ALL SELECT x, y + 1, x, y FROM c WHERE (x - 1, y) NOT IN (SELECT (x, y) FROM c))
SELECT CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, CAST(qx AS DOUBLE) AS qx, CAST(qy AS DOUBLE) AS qy FROM e"""
)
def d9_dissolved_outlines(spark, sf_dir):
    """The sides of all outlines, each from a vertex to the next of its ring."""
    from pyspark.sql.window import Window

    _, outline = _dissolved(spark, sf_dir)
    ring = Window.partitionBy("group", "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = [F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)).alias("q" + c) for c in ("x", "y")]
    return outline.select(col("x").alias("px"), col("y").alias("py"), *after)
