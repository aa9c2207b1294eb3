"""Queries of the raster operators and of mask statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lookups as L
from ..operators import coverage as V
from ..operators import raster as R
from .derive import GRID, derived, with_tables

QUERIES, SQL = {}, {}
col = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Rows of the smaller window on which quadratic oracles run; the queries take the whole grid.
_DEM = with_tables("dem")
_SLOPE = """, g AS (SELECT d.r, d.c, d.z, w.z AS w, e.z AS e, n.z AS n, s.z AS s FROM dem d LEFT JOIN dem w ON w.r = d.r AND w.c = d.c - 1 LEFT JOIN dem e ON e.r = d.r AND e.c = d.c + 1
  LEFT JOIN dem n ON n.c = d.c AND n.r = d.r - 1 LEFT JOIN dem s ON s.c = d.c AND s.r = d.r + 1),
slopes AS (SELECT r, c, degrees(atan(sqrt(pow(coalesce((e - w) / 20.0::DOUBLE, (e - z) / 10.0::DOUBLE, (z - w) / 10.0::DOUBLE, 0), 2) + pow(coalesce((s - n) / 20.0::DOUBLE, (s - z) / 10.0::DOUBLE, (z - n) / 10.0::DOUBLE, 0), 2)))) AS slope FROM g) """


@query(_DEM + _SLOPE + "SELECT r, c, round(slope, 4) AS slope FROM slopes")
def f7_slope(spark, sf_dir):
    return R.slope(derived(spark, sf_dir, "dem"), 10.0).withColumn("slope", F.round("slope", 4))


@query(_DEM + _SLOPE + "SELECT r, c, round(least(greatest((slope - 25) / 15, 0), 1), 4) AS ramp FROM slopes")
def g7_slope_ramp(spark, sf_dir):
    return R.slope(derived(spark, sf_dir, "dem"), 10.0).select("r", "c", F.round(R.slope_ramp(col("slope")), 4).alias("ramp"))


@query(_DEM + "SELECT r, c, round(least(greatest((z - 100) / 200, 0), 1), 5) AS above FROM dem")
def g8_treeline_mask(spark, sf_dir):
    return derived(spark, sf_dir, "dem").select("r", "c", F.round(R.above_treeline(col("z"), F.lit(100.0)), 5).alias("above"))


@query(
    _DEM
    + f""", h AS (SELECT max(r) + 1 AS h FROM dem), o AS (SELECT i AS dr, j AS dc FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE abs(i) + abs(j) <= 2)
SELECT DISTINCT r + dr AS r, c + dc AS c FROM dem, o, h WHERE z < -10 AND r + dr BETWEEN 0 AND h - 1 AND c + dc BETWEEN 0 AND {GRID - 1}"""
)
def g3_dilate(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem")
    height = dem.agg(F.max("r") + 1).first()[0]
    return R.dilate(dem.where("z < -10").select("r", "c"), 2, height, GRID)




@query(
    _DEM
    + f""", h AS (SELECT max(r) + 1 AS h FROM dem), k AS (SELECT i, exp(-0.5::DOUBLE * i * i) AS e FROM range(-4, 5) t(i)), n AS (SELECT i, e / (SELECT sum(e) FROM k) AS w FROM k),
m AS (SELECT r, c, z FROM dem UNION ALL SELECT -1 - r, c, z FROM dem WHERE r < 4 UNION ALL SELECT 2 * h - 1 - r, c, z FROM dem, h WHERE r >= h - 4),
a AS (SELECT m.r + i AS r, c, sum(z * w) AS z FROM m, n GROUP BY 1, 2), b AS (SELECT a.* FROM a, h WHERE r BETWEEN 0 AND h - 1),
x AS (SELECT r, c, z FROM b UNION ALL SELECT r, -1 - c, z FROM b WHERE c < 4 UNION ALL SELECT r, {2 * GRID - 1} - c, z FROM b WHERE c >= {GRID - 4})
SELECT r, c, round(z, 4) AS z FROM (SELECT r, x.c + i AS c, sum(z * w) AS z FROM x, n GROUP BY 1, 2) WHERE c BETWEEN 0 AND {GRID - 1}"""
)
def g4_gaussian(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    height = dem.agg(F.max("r") + 1).first()[0]
    return R.gaussian(dem, 1.0, height, GRID).withColumn("z", F.round("z", 4))


def _low_mask(spark, sf_dir):
    return derived(spark, sf_dir, "dem").select("r", "c", (col("z") < 400).alias("mask"))


@query(
    _DEM
    + """, h AS (SELECT max(r) + 1 AS h FROM dem), o AS (SELECT i AS dr, j AS dc, sqrt(i * i + j * j) AS d FROM range(-9, 10) a(i), range(-9, 10) b(j))
SELECT m.r, m.c, round(min(CASE WHEN b.z >= 400 THEN d END), 4) AS distance FROM dem m, o, dem b WHERE b.r = m.r + dr AND b.c = m.c + dc GROUP BY m.r, m.c"""
)
def g5_distance(spark, sf_dir):
    return R.distance_transform(_low_mask(spark, sf_dir)).select("r", "c", F.round("distance", 4).alias("distance"))


@query(
    _DEM
    + """, o AS (SELECT i AS dr, j AS dc, sqrt(i * i + j * j) AS d FROM range(-9, 10) a(i), range(-9, 10) b(j))
SELECT m.r, m.c, round(least(1, min(CASE WHEN b.z >= 400 THEN d END) / 3), 4) AS edge FROM dem m, o, dem b WHERE b.r = m.r + dr AND b.c = m.c + dc GROUP BY m.r, m.c"""
)
def g6_soft_edge(spark, sf_dir):
    far = R.distance_transform(_low_mask(spark, sf_dir))
    return far.select("r", "c", F.round(R.soft_edge(col("distance"), 3.0, col("mask")), 4).alias("edge"))


@query(
    _DEM
    + "SELECT a.r, a.c, round((a.z + b.z + x.z + d.z) / 4, 4) AS z FROM dem a JOIN dem b ON b.r = a.r AND b.c = a.c + 1 JOIN dem x ON x.r = a.r + 1 AND x.c = a.c JOIN dem d ON d.r = a.r + 1 AND d.c = a.c + 1"
)
def g10_vertex_to_face(spark, sf_dir):
    return R.vertex_to_face(derived(spark, sf_dir, "dem")).withColumn("z", F.round("z", 4))


@query()
def g9_resample(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    height = dem.agg(F.max("r") + 1).first()[0]
    return R.resample(dem, height, GRID, 2 * height, 90).withColumn("z", F.round("z", 4))


@query()
def g12_regions(spark, sf_dir):
    return R.label_regions(derived(spark, sf_dir, "dem").where("z < 150").select("r", "c"))


@query()
def g13_flood(spark, sf_dir):
    low = derived(spark, sf_dir, "dem").where("z < 300").select("r", "c")
    return R.flood_from(low.where("r = 0"), low)


@query()
def g14_carve(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem")
    return R.carve_water(dem.select("r", "c", "z"), dem.where("water").select("r", "c"), 2.0, 15.0, 0.5, 0, GRID).withColumn("z", F.round("z", 4))


@query()
def g11_fill(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", F.when(col("z") < 450, col("z")).alias("z"))
    return R.fill_nodata(dem)


@query(
    _DEM
    + "SELECT r, c, code, CAST(floor(code / 256) AS INTEGER) AS preview FROM (SELECT r, c, CAST(trunc((z - low) / span * 65535) AS INTEGER) AS code FROM dem, (SELECT min(z) AS low, greatest(max(z) - min(z), 0.01::DOUBLE) AS span FROM dem))"
)
def g18_quantize(spark, sf_dir):
    return R.quantize(derived(spark, sf_dir, "dem"))


_WIDE = """, wide AS (SELECT r, c, water, (r % 5) * 0.2::DOUBLE AS rock, (c % 7) * 0.1::DOUBLE AS forest_floor, ((r + c) % 3) * 0.25::DOUBLE AS asphalt, (c % 2) * 0.125::DOUBLE AS gravel FROM dem),
t AS (SELECT *, rock + forest_floor + asphalt + gravel AS s FROM wide),
norm AS (SELECT r, c, water, """ + ", ".join(
    f"CASE WHEN water THEN 0 WHEN s > 1 THEN {x} / s ELSE {x} END AS {x}" for x in ("rock", "forest_floor", "asphalt", "gravel")
) + " FROM t), done AS (SELECT *, CASE WHEN water THEN 0 ELSE greatest(1 - (rock + forest_floor + asphalt + gravel), 0) END AS grass FROM norm) "


def _weights(spark, sf_dir):
    wide = derived(spark, sf_dir, "dem").selectExpr(
        "r", "c", "water", "(r % 5) * 0.2D AS rock", "(c % 7) * 0.1D AS forest_floor", "((r + c) % 3) * 0.25D AS asphalt", "(c % 2) * 0.125D AS gravel"
    )
    return R.normalize_weights(wide, ["rock", "forest_floor", "asphalt", "gravel"])


@query(_DEM + _WIDE + "SELECT r, c, " + ", ".join(f"round({x}, 4) AS {x}" for x in ("rock", "forest_floor", "asphalt", "gravel", "grass")) + " FROM done")
def g17_normalize(spark, sf_dir):
    return _weights(spark, sf_dir).select("r", "c", *[F.round(x, 4).alias(x) for x in ("rock", "forest_floor", "asphalt", "gravel", "grass")])


@query()
def g20_preview(spark, sf_dir):
    return R.preview_rgb(_weights(spark, sf_dir))


_MASKS = with_tables("masks")
_CELLS = "(SELECT count(DISTINCT (r, c)) AS n FROM masks)"


@query(
    _MASKS
    + f"SELECT surface, round(count(*) FILTER (weight > 128) * 100.0::DOUBLE / any_value(n), 1) AS dominant, round(count(*) FILTER (weight > 0) * 100.0::DOUBLE / any_value(n), 1) AS present, round(sum(weight) / any_value(n), 1) AS mean FROM masks, {_CELLS} GROUP BY surface"
)
def e6_coverage(spark, sf_dir):
    masks = derived(spark, sf_dir, "masks")
    return V.coverage(masks, masks.select("r", "c").distinct().count())


@query(
    _MASKS
    + "SELECT br AS by, bx, n, names FROM (SELECT br, bx, count(*) AS n, string_agg(surface, ',' ORDER BY surface) AS names FROM (SELECT CAST(floor(r / 8) AS BIGINT) AS br, CAST(floor(c / 8) AS BIGINT) AS bx, surface, max(weight) AS m FROM masks GROUP BY ALL) WHERE m > 10 GROUP BY br, bx) WHERE n > 5"
)
def e7_block_saturation(spark, sf_dir):
    return V.block_saturation(derived(spark, sf_dir, "masks"), 8).withColumn("names", F.concat_ws(",", "names"))


@query(
    _MASKS
    + """, b AS (SELECT CAST(floor(r / 8) AS BIGINT) AS br, CAST(floor(c / 8) AS BIGINT) AS bx, surface, max(weight) AS m FROM masks GROUP BY ALL HAVING max(weight) > 10),
k AS (SELECT *, count(*) OVER (PARTITION BY br, bx) AS n, row_number() OVER (PARTITION BY br, bx ORDER BY surface = 'grass', m, surface) AS k FROM b),
x AS (SELECT * FROM k WHERE k <= least(n - 5, 5) AND surface <> 'grass')
SELECT surface, count(*) AS cells, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT m.surface, CASE WHEN x.k IS NULL THEN m.weight ELSE 0 END AS w FROM masks m LEFT JOIN x ON x.br = CAST(floor(m.r / 8) AS BIGINT) AND x.bx = CAST(floor(m.c / 8) AS BIGINT) AND x.surface = m.surface) GROUP BY surface"""
)
def e8_relax_blocks(spark, sf_dir):
    relaxed = V.relax_blocks(derived(spark, sf_dir, "masks"), "grass", 8)
    return relaxed.groupBy("surface").agg(F.count("*").alias("cells"), F.sum("weight").alias("weight"))


@query(_MASKS + "SELECT surface, count(*) FILTER (weight >= 64) AS n FROM masks GROUP BY surface HAVING count(*) FILTER (weight >= 64) * 1000 >= (SELECT count(*) FROM masks) OR surface = 'grass'")
def e9_meaningful(spark, sf_dir):
    masks = derived(spark, sf_dir, "masks")
    return V.meaningful(masks, masks.count())


@query(_DEM + "SELECT r % 10 AS region, round(quantile_cont(z, 0.1), 4) AS level FROM dem WHERE water GROUP BY 1")
def e10_region_levels(spark, sf_dir):
    own = derived(spark, sf_dir, "dem").where("water").select((col("r") % 10).alias("region"), "z")
    return R.region_levels(own).select("region", F.round("level", 4).alias("level"))


@query(
    _DEM
    + "SELECT min(z) AS low, max(z) AS high, round(avg(CASE WHEN abs(z) < 0.5 THEN 1 ELSE 0 END), 4) AS flat, NOT (max(z) - min(z) > 5000 OR avg(CASE WHEN abs(z) < 0.5 THEN 1 ELSE 0 END) > 0.5) AS usable FROM dem"
)
def e11_dem_quality(spark, sf_dir):
    return V.dem_quality(derived(spark, sf_dir, "dem"))


@query(_DEM + "SELECT min(z) AS datum FROM dem WHERE NOT water")
def e12_land_datum(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem")
    return V.land_datum(dem.select("r", "c", "z"), dem.where("water").select("r", "c"))


@query(_MASKS + f"SELECT surface, CAST(list_position({list(L.IMPORT_ORDER)}, surface) AS INTEGER) AS place FROM masks WHERE weight > 0 AND surface <> 'grass' GROUP BY surface HAVING count(*) * 1000 >= 0")
def h2_import_order(spark, sf_dir):
    masks = derived(spark, sf_dir, "masks")
    return V.import_order(V.coverage(masks, 100), L.IMPORT_ORDER)


@query(_MASKS + "SELECT r, c FROM masks WHERE surface = 'rock' EXCEPT SELECT r, c FROM masks WHERE surface = 'sand'")
def i2_mask_minus(spark, sf_dir):
    masks = derived(spark, sf_dir, "masks")
    rock, sand = (masks.where(col("surface") == s).select("r", "c").distinct() for s in ("rock", "sand"))
    return rock.join(sand, ["r", "c"], "left_anti")


@query(_MASKS + "SELECT r, c FROM masks WHERE surface = 'rock' UNION SELECT r, c FROM masks WHERE surface = 'sand'")
def i3_mask_union(spark, sf_dir):
    return derived(spark, sf_dir, "masks").where(col("surface").isin("rock", "sand")).select("r", "c").distinct()


@query(_MASKS + "SELECT r, c FROM masks WHERE surface = 'rock' INTERSECT SELECT r, c FROM masks WHERE surface = 'gravel'")
def i4_mask_intersect(spark, sf_dir):
    masks = derived(spark, sf_dir, "masks")
    rock, gravel = (masks.where(col("surface") == s).select("r", "c").distinct() for s in ("rock", "gravel"))
    return rock.join(gravel, ["r", "c"], "left_semi")


@query(
    with_tables("points", "dem")
    + f""", h AS (SELECT max(r) + 1 AS h FROM dem), p AS (SELECT id, CAST(trunc((lon - 16) / 0.5::DOUBLE * {GRID - 1}) AS BIGINT) AS c, h - 1 - CAST(trunc((lat - 59) / 0.3::DOUBLE * (h - 1)) AS BIGINT) AS r FROM points, h)
SELECT id, round(z, 3) AS z FROM p LEFT JOIN dem USING (r, c)"""
)
def d7_sample_raster(spark, sf_dir):
    dem = derived(spark, sf_dir, "dem").select("r", "c", "z")
    height = dem.agg(F.max("r") + 1).first()[0]
    points = derived(spark, sf_dir, "points").select("id", ((col("lon") - 16) / 0.5).alias("u"), ((col("lat") - 59) / 0.3).alias("v"))
    return R.sample_raster(points, dem, height, GRID).select("id", "z")


@query(
    with_tables("dem")
    + """, px AS (SELECT r % 20 AS r, c % 20 AS c, r * 120 + c AS tile_id, CAST(z * 4 AS BIGINT) % 97 AS acquired_at, CAST(z AS BIGINT) % 3 AS red, CAST(r % 4 AS BIGINT) AS green, c % 5 AS blue FROM dem)
SELECT r, c, tile_id, red, green, blue FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY acquired_at DESC, tile_id) AS k FROM px WHERE red + green + blue > 0) WHERE k = 1""".replace("CAST(z AS BIGINT)", "CAST(floor(z) AS BIGINT)")
)
def f3_newest_first(spark, sf_dir):
    pixels = derived(spark, sf_dir, "dem").selectExpr(
        "r % 20 AS r", "c % 20 AS c", "r * 120 + c AS tile_id", "CAST(z * 4 AS BIGINT) % 97 AS acquired_at", "CAST(floor(z) AS BIGINT) % 3 AS red", "CAST(r % 4 AS BIGINT) AS green", "c % 5 AS blue"
    )
    return R.newest_first(pixels)


@query(with_tables("dem") + "SELECT CAST(max(r) + 1 AS BIGINT) AS height, CAST(max(c) + 1 AS BIGINT) AS width, max(r) + 1 = max(c) + 1 AS square, count(*) AS cells FROM dem")
def g24_raster_contract(spark, sf_dir):
    size = derived(spark, sf_dir, "dem").agg((F.max("r") + 1).alias("height"), (F.max("c") + 1).alias("width"), F.count("*").alias("cells"))
    return size.withColumn("square", col("height") == col("width"))
