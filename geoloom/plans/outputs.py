"""Queries of composite outputs and of the operators they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import composites as M
from ..operators import raster as R
from ..operators import spatial
from . import networks
from .derive import GRID, derived, with_tables
from .rules import box_ring

QUERIES, SQL = {}, {}
col, lit = F.col, F.lit


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COVER = ", ".join(f"({k}, '{t}', '{c}', '{kind}', '{leaf}')" for k, (t, c, kind, leaf) in M.LAND_COVER.items())


@query(f"SELECT id, target, category, kind, leaf_type FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 2625 + c_custkey % 26 END AS code FROM customer) JOIN (VALUES {_COVER}) v(code, target, category, kind, leaf_type) USING (code)")
def b13_land_cover(spark, sf_dir):
    k = col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(k.alias("id"), F.when(k % 9 != 0, F.concat(lit(" "), (2625 + k % 26).cast("string"))).otherwise("n/a").alias("code"))
    return M.land_cover(rows).select("id", "target", "category", "kind", "leaf_type")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'available' WHEN 3 THEN 'not_implemented' ELSE CASE WHEN s_suppkey % 3 = 0 THEN 'configured' ELSE 'api_key_required' END END AS status FROM supplier")
def b33_source_status(spark, sf_dir):
    k = col("s_suppkey")
    kinds = F.array(lit("none"), lit("token"), lit("api_key"), lit("oauth2"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("id"), F.get(kinds, (k % 4).cast("int")).alias("auth"), (k % 3 == 0).alias("has_key"))
    return M.source_status(rows).select("id", "status")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'b' WHEN 1 THEN 'a' ELSE 'd' END AS asset FROM nation")
def b34_ambient(spark, sf_dir):
    k = col("n_nationkey")
    codes = F.when(k % 3 == 0, F.array(lit("XX"), lit("SE"), lit("NO"))).when(k % 3 == 1, F.array(lit("NO"), lit("SE"))).otherwise(F.array(lit("XX")))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("id"), M.ambient_asset(codes, {"NO": "a", "SE": "b"}, "d").alias("asset"))


@query(
    with_tables("boxes")
    + """, n AS (SELECT id, x, y, w * 100 AS w, h * 100 AS h, greatest(CAST(ceil((x + w * 100 - x) / 0.15::DOUBLE) AS BIGINT), 1) AS p, greatest(CAST(ceil((y + h * 100 - y) / 0.15::DOUBLE) AS BIGINT), 1) AS q FROM boxes)
SELECT id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(x + i * w / p, 6) AS west, round(y + j * h / q, 6) AS south FROM n, range(0, 10) a(i), range(0, 10) b(j) WHERE i < p AND j < q"""
)
def c24_chunk_ranges(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").select("id", col("x").alias("west"), col("y").alias("south"), (col("x") + col("w") * 100).alias("east"), (col("y") + col("h") * 100).alias("north"))
    return M.chunk_ranges(boxes, 0.15).select("id", "i", "j", F.round("west", 6).alias("west"), F.round("south", 6).alias("south"))


def _rings(spark, sf_dir, by: float = 1.0):
    boxes = derived(spark, sf_dir, "boxes").withColumns({"x": (col("x") - 16) * by, "y": (col("y") - 59) * by, "w": col("w") * by, "h": col("h") * by})
    return boxes.select(col("id").alias("line_id"), F.posexplode(F.slice(box_ring(), 1, 4)).alias("seq", "p")).select("line_id", "seq", "p.x", "p.y")


@query(with_tables("boxes") + "SELECT id, round((w * 1000 + 1) * (h * 1000 + 1), 4) AS area FROM boxes")
def c21_buffer_rings(spark, sf_dir):
    wide = M.buffer_rings(_rings(spark, sf_dir, 1000.0), 0.5)
    span = wide.groupBy("line_id").agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h"))
    return span.select(col("line_id").alias("id"), F.round(col("w") * col("h"), 4).alias("area"))


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0")
def c22_simple_rings(spark, sf_dir):
    rings = _rings(spark, sf_dir, 1000.0)
    bow = F.when((col("line_id") % 3 == 0) & (col("seq") == 1), 2).when((col("line_id") % 3 == 0) & (col("seq") == 2), 1).otherwise(col("seq"))
    return M.simple_rings(rings.withColumn("seq", bow)).select(col("line_id").alias("id"))


_BOX = with_tables("boxes") + ", b AS (SELECT id, (x - 16) * 1000 AS x0, (y - 59) * 1000 AS y0, (x - 16) * 1000 + w * 3000 + 0.25 AS x1, (y - 59) * 1000 + h * 3000 + 0.25 AS y1 FROM boxes) "


@query(_BOX + "SELECT id, count(*) AS cells FROM b, range(0, 910) r(r), range(0, 910) c(c) WHERE r + 0.5 >= y0 AND r + 0.5 < y1 AND c + 0.5 >= x0 AND c + 0.5 < x1 GROUP BY id")
def g1_rasterize_polygons(spark, sf_dir):
    return M.rasterize_polygons(_box_edges(spark, sf_dir), 1.0).groupBy("id").agg(F.count("*").alias("cells"))


@query(
    _BOX
    + """, m AS (SELECT DISTINCT r, c FROM b JOIN boxes USING (id), range(0, 700) r(r), range(0, 700) c(c) WHERE (leaf_type = 'mixed' OR water_type IN ('lake', 'pond')) AND r + 0.5 >= y0 AND r + 0.5 < y1 AND c + 0.5 >= x0 AND c + 0.5 < x1)
SELECT DISTINCT r + i AS r, c + j AS c FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) d(i, j) WHERE r + i BETWEEN 0 AND 699 AND c + j BETWEEN 0 AND 699"""
)
def g1_burn_by_tags(spark, sf_dir):
    """Areas that either tag lets pass, widened by one cell."""
    boxes = derived(spark, sf_dir, "boxes").select("id", "leaf_type", "water_type")
    return M.burn_areas(boxes, _box_edges(spark, sf_dir), 1.0, 700, 700, {"leaf_type": ["mixed"], "water_type": ["lake", "pond"]}, 1)


def _box_edges(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").withColumns({"w": col("w") * 3000 + 0.25, "h": col("h") * 3000 + 0.25, "x": (col("x") - 16) * 1000, "y": (col("y") - 59) * 1000})
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    ends = [F.struct((col("x") + a * col("w")).alias("ax"), (col("y") + b * col("h")).alias("ay"), (col("x") + c * col("w")).alias("bx"), (col("y") + d * col("h")).alias("by")) for (a, b), (c, d) in zip(corners, corners[1:])]
    return boxes.select("id", F.explode(F.array(*ends)).alias("e")).select("id", "e.*")


@query(
    with_tables("boxes")
    + """, s AS (SELECT (id % 50) AS ax, (id % 30) AS ay, (id % 50) + id % 7 AS bx, (id % 30) + id % 5 AS by_ FROM boxes)
SELECT DISTINCT r, c FROM (SELECT r, c, sqrt(pow(c - ax - t * (bx - ax), 2) + pow(r - ay - t * (by_ - ay), 2)) AS d FROM (SELECT *, CASE WHEN bx = ax AND by_ = ay THEN 0 ELSE greatest(0, least(1, ((c - ax) * (bx - ax) + (r - ay) * (by_ - ay))::DOUBLE / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS t FROM s, range(-5, 60) c(c), range(-5, 60) r(r))) WHERE d <= 1.5"""
)
def g2_rasterize_lines(spark, sf_dir):
    k = col("id")
    segments = derived(spark, sf_dir, "boxes").select((k % 50).cast("double").alias("ax"), (k % 30).cast("double").alias("ay"), (k % 50 + k % 7).cast("double").alias("bx"), (k % 30 + k % 5).cast("double").alias("by"))
    return M.rasterize_lines(segments, 1)


_WIDE = with_tables("boxes") + """, s AS (SELECT id % 300 AS ax, id % 170 AS ay, id % 300 + id % 37 AS bx, id % 170 + id % 23 AS by_, id % 4 + 0.5::DOUBLE AS reach FROM boxes),
t AS (SELECT *, CASE WHEN bx = ax AND by_ = ay THEN 0 ELSE greatest(0, least(1, ((c - ax) * (bx - ax) + (r - ay) * (by_ - ay))::DOUBLE / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) END AS t FROM s, range(0, 180) r(r), range(0, 320) c(c) WHERE r BETWEEN ay - 4 AND by_ + 4 AND c BETWEEN ax - 4 AND bx + 4) """


@query(_WIDE + "SELECT DISTINCT r, c FROM t WHERE sqrt(pow(c - ax - t * (bx - ax), 2) + pow(r - ay - t * (by_ - ay), 2)) <= reach")
def g2_strokes_by_width(spark, sf_dir):
    """Strokes of one, three, five and seven cells, cut to a grid of 180 by 320."""
    k, real = col("id"), lambda c: c.cast("double")
    segments = derived(spark, sf_dir, "boxes").select(real(k % 300).alias("ax"), real(k % 170).alias("ay"), real(k % 300 + k % 37).alias("bx"), real(k % 170 + k % 23).alias("by"), (k % 4).cast("int").alias("half"))
    return M.rasterize_lines(segments, col("half"), 180, 320)


_SEA = """WITH RECURSIVE z AS (SELECT CAST((p_partkey - p_partkey % 64) / 64 AS BIGINT) AS r, CAST(p_partkey % 64 AS BIGINT) AS c, p_size / 66.0::DOUBLE AS z FROM part),
low AS (SELECT r, c FROM z WHERE z <= 0.5), h AS (SELECT max(r) AS h FROM z), coast AS (SELECT DISTINCT CAST(s_suppkey % 5 AS BIGINT) AS r, CAST(20 + s_suppkey % 3 AS BIGINT) AS c FROM supplier),
border AS (SELECT r, c, EXISTS (SELECT 1 FROM coast k WHERE abs(k.r - low.r) + abs(k.c - low.c) <= 8) AS near FROM low, h WHERE r IN (0, h) OR c IN (0, 63)),
sea AS (SELECT r, c FROM border WHERE near OR NOT (SELECT bool_or(near) FROM border)
  UNION SELECT low.r, low.c FROM sea, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(i, j), low WHERE low.r = sea.r + i AND low.c = sea.c + j)
SELECT r, c FROM sea"""


@query(_SEA)
def g13_sea(spark, sf_dir):
    """Low cells that the coast's low border cells reach; heights by part size."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("CAST((p_partkey - p_partkey % 64) / 64 AS BIGINT) AS r", "CAST(p_partkey % 64 AS BIGINT) AS c", "p_size / 66D AS z")
    coast = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr("CAST(s_suppkey % 5 AS BIGINT) AS r", "CAST(20 + s_suppkey % 3 AS BIGINT) AS c").distinct()
    return R.sea_cells(parts, coast, _height(parts), 64, near=8)


def _height(dem):
    return dem.agg(F.max("r") + 1).first()[0]


def _roads(dem):
    return dem.where("c % 17 = 0").select("r", "c")


def _water(dem):
    kinds = F.array(*[lit(k) for k, _, _ in M.BEDS])
    return dem.where("r % 29 < 6 AND c % 31 < 7").select("r", "c", F.get(kinds, ((F.floor(col("r") / 29) + F.floor(col("c") / 31)) % 4).cast("int")).alias("kind"))


@query()
def g16_flatten_roads(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    return M.flatten_roads(dem, _roads(dem), _height(dem), GRID).withColumn("z", F.round("z", 3))


@query()
def g15_carve_features(spark, sf_dir):
    """Beds of lakes and wetlands from boxes and of rivers and the sea from lines, of every supplier, in the grid of the orders."""
    dem, k = derived(spark, sf_dir, "dem").select("r", "c", "z"), col("id")
    boxes = derived(spark, sf_dir, "boxes")
    lines = boxes.select("water_type", *[(e % n).cast("double").alias(c) for c, e, n in (("ax", k * 7, GRID), ("ay", k * 11, 400), ("bx", k * 7 + k % 13, GRID), ("by", k * 11 + k % 17, 400))])
    areas = boxes.select("id", F.when(k % 9 == 0, "water").alias("natural"), "water_type")
    return M.carve_features(dem, areas, _box_edges(spark, sf_dir), lines, 2.0, _height(dem), GRID).withColumn("z", F.round("z", 3))


@query()
def g15_carve_all(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    return M.carve_all(dem, _water(dem), 2.0, _height(dem), GRID).withColumn("z", F.round("z", 3))


@query()
def g25_terrain(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    return M.terrain(dem, _roads(dem), _water(dem), 2.0, _height(dem), GRID)


@query()
def g19_surface_weights(spark, sf_dir):
    masks = derived(spark, sf_dir, "masks").where("weight > 128").select("surface", "r", "c")
    weights = M.surface_weights(derived(spark, sf_dir, "dem").select("r", "c", "z"), masks, 10.0, 400.0)
    return weights.select("r", "c", *[F.round(s, 4).alias(s) for s in ("rock", "asphalt", "gravel", "crop", "dirt", "forest_floor", "grass")])


@query(
    with_tables("dem")
    + """, t AS (SELECT r * 1.5::DOUBLE + 0.25::DOUBLE AS y, c * 1.5::DOUBLE + 0.25::DOUBLE AS x, r % 3 AS tile_id, CASE WHEN c % 4 > 0 THEN z END AS z FROM dem)
SELECT r, c, z FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY tile_id, z) AS k FROM (SELECT CAST(floor(y / 4) AS BIGINT) AS r, CAST(floor(x / 4) AS BIGINT) AS c, tile_id, z FROM t WHERE z IS NOT NULL)) WHERE k = 1"""
)
def g22_mosaic(spark, sf_dir):
    tiles = derived(spark, sf_dir, "dem").selectExpr("r * 1.5D + 0.25D AS y", "c * 1.5D + 0.25D AS x", "r % 3 AS tile_id", "CASE WHEN c % 4 > 0 THEN z END AS z")
    return M.mosaic(tiles, 0.0, 0.0, 4.0)


@query(
    with_tables("dem")
    + """, t AS (SELECT r * 1.5::DOUBLE + 0.25::DOUBLE AS y, c * 1.5::DOUBLE + 0.25::DOUBLE AS x, r % 3 AS tile_id, CASE WHEN c % 4 > 0 AND r % 5 > 0 THEN z END AS z FROM dem)
SELECT r, c, z FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY z IS NULL, tile_id, z) AS k FROM (SELECT CAST(floor((y - 3) / 2) AS BIGINT) AS r, CAST(floor((x - 5) / 2) AS BIGINT) AS c, tile_id, z FROM t)) WHERE k = 1 AND r BETWEEN 0 AND 9 AND c BETWEEN 0 AND 79"""
)
def g22_cropped_mosaic(spark, sf_dir):
    tiles = derived(spark, sf_dir, "dem").selectExpr("r * 1.5D + 0.25D AS y", "c * 1.5D + 0.25D AS x", "r % 3 AS tile_id", "CASE WHEN c % 4 > 0 AND r % 5 > 0 THEN z END AS z")
    return M.mosaic(tiles, 5.0, 3.0, 2.0, 10, 80)


@query(
    with_tables("boxes")
    + """, w AS (SELECT id AS tile_id, greatest(CAST(floor((x - 16.2) / 0.01::DOUBLE) AS BIGINT), 0) AS c0, greatest(CAST(floor((y - 59.2) / 0.01::DOUBLE) AS BIGINT), 0) AS r0, least(CAST(ceil((x + w * 50 - 16.2) / 0.01::DOUBLE) AS BIGINT), 40) AS c1, least(CAST(ceil((y + h * 50 - 59.2) / 0.01::DOUBLE) AS BIGINT), 40) AS r1 FROM boxes) SELECT * FROM w WHERE c0 < c1 AND r0 < r1""".replace("- 16.2)", "- 16.2003::DOUBLE)").replace("- 59.2)", "- 59.2003::DOUBLE)")
)
def d10_tile_windows(spark, sf_dir):
    tiles = derived(spark, sf_dir, "boxes").select(col("id").alias("tile_id"), col("x").alias("xmin"), col("y").alias("ymin"), (col("x") + col("w") * 50).alias("xmax"), (col("y") + col("h") * 50).alias("ymax"))
    return M.tile_windows(tiles, 16.2003, 59.2003, 0.01, 40, 40)


@query()
def a9_run_summary(spark, sf_dir):
    return M.run_summary(networks.QUERIES["e2_feature_counts"](spark, sf_dir), derived(spark, sf_dir, "dem"))


@query(with_tables("points") + "SELECT id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM points")
def c12_round_trip(spark, sf_dir):
    from ..functions.geometry import project_tm, unproject_tm

    there = derived(spark, sf_dir, "points").select("id", project_tm(col("lon"), col("lat"), 15.0).alias("p"))
    back = unproject_tm(col("p.x"), col("p.y"), 15.0)
    return there.select("id", F.round(back["lon"], 7).alias("lon"), F.round(back["lat"], 7).alias("lat"))


@query()
def c13_projected_envelope(spark, sf_dir):
    from ..functions.geometry import projected_envelope

    x, y = 500000 + col("id") * 100.0, 6500000 + col("id") * 50.0
    return derived(spark, sf_dir, "boxes").select("id", projected_envelope(x, y, x + 20000, y + 20000, 15.0).alias("b")).select("id", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")])


@query(with_tables("boxes") + "SELECT id, round(x + 1, 6) AS x0, round(y - 1, 6) AS y0, 5 AS n FROM boxes")
def c14_transform_features(spark, sf_dir):
    from ..functions.geometry import transformed

    parts = F.array(F.array(box_ring()))
    moved = transformed(parts, lambda p: F.struct((p["x"] + 1).alias("x"), (p["y"] - 1).alias("y")))
    rows = derived(spark, sf_dir, "boxes").select("id", F.get(F.get(moved, 0), 0).alias("ring"))
    return rows.select("id", F.round(F.get("ring", 0)["x"], 6).alias("x0"), F.round(F.get("ring", 0)["y"], 6).alias("y0"), F.size("ring").alias("n"))


@query()
def g23_reproject(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    targets = dem.select("r", "c", (15.001 + col("c") * 0.0002).alias("lon"), (58.6401 + col("r") * 0.0001).alias("lat"))
    return M.reproject(dem, targets, 20.0, 500000.0, 6500000.0, 15.0).withColumn("z", F.round("z", 3))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'wetland' ELSE 'river' END AS water_type FROM supplier")
def b9_b14_constant_water(spark, sf_dir):
    from ..operators.features import constant_water

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(col("s_suppkey").alias("id"))
    return constant_water(rows.where("id % 2 = 0"), "wetland").unionByName(constant_water(rows.where("id % 2 <> 0"), "river"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN 'p' || s_suppkey WHEN 2 THEN 'n' || s_suppkey WHEN 3 THEN s_name ELSE '' END AS name FROM supplier")
def b10_feature_name(spark, sf_dir):
    from ..operators.features import feature_name

    k, text = col("s_suppkey"), col("s_suppkey").cast("string")
    names = F.when(k % 5 == 0, F.array(F.struct(F.concat(lit("s"), text).alias("text"))))
    plain = F.when(k % 5 == 1, F.array(F.concat(lit("p"), text)))
    nested = F.when(k % 5 == 2, F.struct(F.array(F.concat(lit("n"), text)).alias("text")))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("id"), feature_name(names, plain, nested, F.when(k % 5 == 3, col("s_name"))).alias("name"))


@query(with_tables("boxes") + "SELECT geom_type AS category, water_type AS kind, count(*) AS n FROM boxes GROUP BY ALL")
def e3_type_counts(spark, sf_dir):
    from ..operators.features import type_counts

    return type_counts(derived(spark, sf_dir, "boxes").select(col("geom_type").alias("category"), col("water_type").alias("kind")))


@query()
def e16_cleanup_stats(spark, sf_dir):
    from ..operators.lines import cleanup_stats

    boxes = derived(spark, sf_dir, "boxes").select("id", (col("w") * col("h")).alias("area"), col("x").alias("xmin"), col("y").alias("ymin"), (col("x") + col("w") * 4).alias("xmax"), (col("y") + col("h") * 4).alias("ymax"))
    others = boxes.select(col("id").alias("code"), "xmin", "ymin", "xmax", "ymax")
    touches = spatial.box_overlaps(boxes.select("id", "xmin", "ymin", "xmax", "ymax"), others, 0.02).where("id > code").select(col("id").alias("a"), col("code").alias("b"))
    return cleanup_stats(boxes, touches, 0.000004)


@query(
    with_tables("boxes")
    + """, t AS (SELECT CAST(1 + id % 3 AS DOUBLE) AS cell, id % 7 AS bands, id * 3 + 0.5::DOUBLE AS x0, id * 2 + 0.5::DOUBLE AS y0, id * 3 + 10.25::DOUBLE AS x1, id * 2 + 12.25::DOUBLE AS y1 FROM boxes), g AS (SELECT max(cell) AS cell, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM t WHERE bands >= 3)
SELECT cell, CAST(floor(x0 / cell) AS BIGINT) AS c0, CAST(floor(y0 / cell) AS BIGINT) AS r0, CAST(ceil(x1 / cell) - floor(x0 / cell) AS BIGINT) AS width, CAST(ceil(y1 / cell) - floor(y0 / cell) AS BIGINT) AS height, (SELECT count(*) FROM t) - n > greatest(1, (SELECT count(*) FROM t) // 3) AS failed FROM g"""
)
def g21_mosaic_grid(spark, sf_dir):
    k = col("id")
    cell = (1 + k % 3).cast("double")
    tiles = derived(spark, sf_dir, "boxes").select(cell.alias("dx"), cell.alias("dy"), (k % 7).alias("bands"), (k * 3 + 0.5).alias("xmin"), (k * 2 + 0.5).alias("ymin"), (k * 3 + 10.25).alias("xmax"), (k * 2 + 12.25).alias("ymax"))
    return M.mosaic_grid(tiles)


@query()
def c17_simplify_3d(spark, sf_dir):
    from ..operators.lines import simplify

    points = derived(spark, sf_dir, "line_points").withColumn("z", (col("line_id") * 7 + col("seq") * 13) % 50 * 0.1)
    return simplify(points, 800.0, 2.0).select("line_id", "seq")
