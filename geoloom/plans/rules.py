"""Queries of the classification rules, string functions and geometry functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import geometry as G
from ..functions import lookups as L
from ..functions import strings as S
from .derive import derived, with_tables

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query, with its oracle where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


col, lit = F.col, F.lit


def classified_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads with surface, width and asset."""
    roads = derived(spark, sf_dir, "roads")
    surface = C.road_surface(col("highway"), col("surface_tag"), col("country"), col("in_forest"), col("in_urban"))
    return (
        roads.withColumn("surface", surface)
        .withColumn("width_m", C.road_width(col("highway"), col("width_tag"), col("lanes_tag"), col("surface")))
        .withColumn("prefab", C.road_prefab(col("highway"), col("surface"), col("width_m")))
    )


_MAJOR = ", ".join(f"'{x}'" for x in L.MAJOR_ROADS)
_ROADS = (
    with_tables("roads")
    + f""", surfaced AS (SELECT *, CASE WHEN coalesce(surface_tag, '') <> '' THEN {L.sql_case('surface_tag', L.SURFACE_TAGS, 'gravel')}
  WHEN highway IN ({_MAJOR}) THEN 'asphalt'
  WHEN highway = 'residential' THEN CASE WHEN in_urban THEN 'asphalt' ELSE {L.sql_case('country', L.RURAL, 'asphalt')} END
  WHEN highway IN ('unclassified', 'service', 'cycleway') THEN CASE WHEN in_urban THEN 'asphalt' ELSE 'gravel' END
  WHEN highway = 'track' THEN CASE WHEN in_forest THEN {L.sql_case('country', L.FOREST_ROAD, 'gravel')} ELSE 'gravel' END
  WHEN highway IN ('path', 'footway', 'bridleway') THEN 'dirt' ELSE 'gravel' END AS surface FROM roads),
wide AS (SELECT *, coalesce(TRY_CAST(trim(replace(width_tag, 'm', '')) AS DOUBLE),
  TRY_CAST(lanes_tag AS INTEGER) * CASE WHEN surface = 'asphalt' THEN CAST(3.5 AS DOUBLE) ELSE CAST(2.5 AS DOUBLE) END,
  {L.sql_case('highway', {k: v[0] for k, v in L.ROADS.items()}, 4.0)}) AS width_m FROM surfaced),
classed AS (SELECT *, CASE WHEN width_m >= 7 THEN 'wide' WHEN width_m >= 4 THEN 'medium' ELSE 'narrow' END AS width_class FROM wide),
done AS (SELECT *, coalesce({L.sql_case('highway', {k: v[2] for k, v in L.ROADS.items()})},
  {L.sql_case("(surface || '|' || width_class)", {f'{a}|{b}': v for (a, b), v in L.ASSETS.items()})}, '{L.DEFAULT_ASSET}') AS prefab FROM classed) """
)


@query(_ROADS + "SELECT id, highway, surface, width_m, width_class, prefab FROM done")
def b18_b21_road_classes(spark, sf_dir):
    return classified_roads(spark, sf_dir).select("id", "highway", "surface", "width_m", C.width_class(col("width_m")).alias("width_class"), "prefab")


@query(
    _ROADS
    + """SELECT surface, highway, count(*) AS n, round(sum(width_m), 3) AS width FROM done GROUP BY GROUPING SETS ((surface), (highway), ())"""
)
def e1_road_stats(spark, sf_dir):
    roads = classified_roads(spark, sf_dir)
    sets = roads.groupingSets([["surface"], ["highway"], []], "surface", "highway")
    return sets.agg(F.count("*").alias("n"), F.round(F.sum("width_m"), 3).alias("width"))


@query(
    _ROADS
    + """SELECT surface, highway, n, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY n DESC, highway) AS k
  FROM (SELECT surface, highway, count(*) AS n FROM done GROUP BY ALL)) WHERE k <= 5"""
)
def h1_top_types(spark, sf_dir):
    from pyspark.sql.window import Window

    counts = classified_roads(spark, sf_dir).groupBy("surface", "highway").agg(F.count("*").alias("n"))
    order = Window.partitionBy("surface").orderBy(F.desc("n"), "highway")
    return counts.withColumn("k", F.row_number().over(order)).where("k <= 5")


@query(
    _ROADS
    + "SELECT id, CASE WHEN prefab LIKE '%Asphalt%' THEN 'Asphalt' WHEN prefab LIKE '%Cobblestone%' THEN 'Cobblestone' ELSE 'Dirt' END || '/' || prefab || '.et' AS asset FROM done"
)
def b22_asset_path(spark, sf_dir):
    roads = classified_roads(spark, sf_dir)
    return roads.select("id", F.concat(C.asset_folder(col("prefab")), lit("/"), "prefab", lit(".et")).alias("asset"))


@query(with_tables("roads") + f"SELECT id, {L.sql_case('highway', L.RANKS, 8)} AS rank FROM roads")
def d12_road_rank(spark, sf_dir):
    return derived(spark, sf_dir, "roads").select("id", C.road_rank(col("highway")).alias("rank"))


_WATER = f"""CASE WHEN water_type IN ('lake', 'pond', 'reservoir', 'water', 'basin') AND geom_type IN ('Polygon', 'MultiPolygon') THEN 'lake'
  WHEN water_type IN ('river', 'stream', 'canal') AND geom_type = 'LineString' THEN 'river' WHEN water_type IN ('coastline', 'wetland') THEN water_type END"""


@query(
    with_tables("boxes")
    + f"SELECT id, class, CASE WHEN class = 'river' THEN {L.sql_case('water_type', L.RIVER_WIDTHS, 5.0)} END AS width, intermittent FROM (SELECT *, {_WATER} AS class FROM boxes) WHERE class IS NOT NULL"
)
def b23_water_classes(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").withColumn("class", C.water_class(col("water_type"), col("geom_type")))
    width = F.when(col("class") == "river", C.river_width(col("water_type")))
    return boxes.where("class IS NOT NULL").select("id", "class", width.alias("width"), "intermittent")


_FOREST = f"""CASE leaf_type WHEN 'needleleaved' THEN 'coniferous' WHEN 'broadleaved' THEN 'deciduous' WHEN 'mixed' THEN 'mixed'
  ELSE CASE WHEN area_type IN ('scrub', 'heath') THEN area_type ELSE {L.sql_case('country', L.FOREST_DEFAULT, 'mixed')} END END"""


@query(
    with_tables("boxes")
    + f"""SELECT id, kind, {L.sql_case('kind', L.DENSITY, 0.65)} AS density,
  coalesce({L.sql_case("(kind || '|' || country)", L.SPECIES)}, {L.sql_case('kind', L.SPECIES_BY_TYPE, 'generic_tree')}) AS species
  FROM (SELECT *, {_FOREST} AS kind FROM boxes) WHERE geom_type IN ('Polygon', 'MultiPolygon')"""
)
def b24_b25_forests(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").where(col("geom_type").isin("Polygon", "MultiPolygon"))
    kind = C.forest_type(col("leaf_type"), col("area_type"), col("country"))
    return boxes.select("id", kind.alias("kind"), "country").select(
        "id", "kind", C.forest_density(col("kind")).alias("density"), F.concat_ws(",", C.forest_species(col("kind"), col("country"))).alias("species")
    )


_AREA = "round(w * h * 111.32 * cos(radians(y + h / 2)) * 110.54, 4)"


def box_ring(x="x", y="y", w="w", h="h"):
    """The closed ring of a box."""
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    return F.array(*[F.struct((col(x) + a * col(w)).alias("x"), (col(y) + b * col(h)).alias("y")) for a, b in corner])


@query(with_tables("boxes") + f"SELECT id, {_AREA} AS area, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy FROM boxes")
def c4_area_centroid(spark, sf_dir):
    rings = derived(spark, sf_dir, "boxes").withColumn("ring", box_ring())
    center = G.ring_centroid(col("ring"))
    return rings.select(
        "id", F.round(G.area_km2(col("ring")), 4).alias("area"), F.round(center["x"], 6).alias("cx"), F.round(center["y"], 6).alias("cy")
    )


@query(
    with_tables("boxes")
    + f"SELECT class, count(*) AS n, round(sum(CASE WHEN class = 'lake' THEN {_AREA} ELSE 0 END), 3) AS area FROM (SELECT *, {_WATER} AS class FROM boxes) WHERE class IS NOT NULL GROUP BY class"
)
def e4_water_stats(spark, sf_dir):
    rings = derived(spark, sf_dir, "boxes").withColumn("class", C.water_class(col("water_type"), col("geom_type"))).where("class IS NOT NULL")
    area = F.round(G.area_km2(box_ring()), 4)
    return rings.groupBy("class").agg(F.count("*").alias("n"), F.round(F.sum(F.when(col("class") == "lake", area).otherwise(0.0)), 3).alias("area"))


_HOLED = "round((w * h - w * h / 16) * 111.32 * cos(radians(y + h * (0.5 - 0.125 * 0.0625 / 0.9375))) * 110.54, 4)"


@query(with_tables("boxes") + f"SELECT id, {_HOLED} AS area, round(x + w * (0.5 - 0.125 * 0.0625 / 0.9375), 6) AS cx, round(y + h * (0.5 - 0.125 * 0.0625 / 0.9375), 6) AS cy FROM boxes")
def c4_area_with_holes(spark, sf_dir):
    """Boxes with a hole of a quarter of their sides: its centre lies an eighth of a side north-east of the box's."""
    w, h = col("w") / 4, col("h") / 4
    left, low = col("x") + col("w") * 0.5, col("y") + col("h") * 0.5
    corner = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    hole = F.array(*[F.struct((left + a * w).alias("x"), (low + b * h).alias("y")) for a, b in corner])
    rings = derived(spark, sf_dir, "boxes").withColumn("rings", F.array(box_ring(), hole))
    center = G.polygon_centroid(col("rings"))
    return rings.select("id", F.round(G.polygon_area_km2(col("rings")), 4).alias("area"), F.round(center["x"], 6).alias("cx"), F.round(center["y"], 6).alias("cy"))


@query(with_tables("boxes") + """SELECT id, round(least(x, x + (w - s) / 2), 6) AS west, round(least(y, y + (h - t) / 2), 6) AS south, round(greatest(x + w, x + (w + s) / 2), 6) AS east, round(greatest(y + h, y + (h + t) / 2), 6) AS north
FROM (SELECT *, greatest(mw, mh) / (111320 * cos(radians(y + h / 2))) AS s, greatest(mw, mh) / 110540 AS t FROM (SELECT *, w * 111320 * cos(radians(y + h / 2)) AS mw, h * 110540 AS mh FROM boxes))""")
def c8_square_bbox(spark, sf_dir):
    box = G.square_bbox(col("x"), col("y"), col("x") + col("w"), col("y") + col("h"))
    return derived(spark, sf_dir, "boxes").select("id", box.alias("b")).select("id", *[F.round(f"b.{c}", 6).alias(c) for c in ("west", "south", "east", "north")])


@query(with_tables("boxes") + f"SELECT coalesce(kind, 'all') AS kind, count(*) AS n, round(sum(area), 3) AS area FROM (SELECT water_type AS kind, {_AREA} AS area FROM boxes WHERE geom_type <> 'LineString') GROUP BY GROUPING SETS ((kind), ())")
def e5_area_summary(spark, sf_dir):
    """Areas by type and all together, as for buildings and the summary."""
    boxes = derived(spark, sf_dir, "boxes").where(col("geom_type") != "LineString").select(col("water_type").alias("kind"), F.round(G.area_km2(box_ring()), 4).alias("area"))
    return boxes.rollup("kind").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area")).withColumn("kind", F.coalesce("kind", lit("all")))


@query(
    with_tables("boxes")
    + f"SELECT kind, count(*) AS n, round(sum({_AREA}), 3) AS area FROM (SELECT *, {_FOREST} AS kind FROM boxes) WHERE geom_type <> 'LineString' GROUP BY kind"
)
def e5_forest_stats(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").where(col("geom_type") != "LineString")
    kind = C.forest_type(col("leaf_type"), col("area_type"), col("country"))
    return boxes.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.round(G.area_km2(box_ring()), 4)), 3).alias("area"))


@query(
    with_tables("boxes")
    + """SELECT id, CASE country WHEN 'NO' THEN CAST(trunc(1200 + t(y, 58.0, 71.0) * -400) AS INTEGER) WHEN 'SE' THEN CAST(trunc(1100 + t(y, 55.5, 69.0) * -300) AS INTEGER)
  WHEN 'FI' THEN CAST(trunc(700 + t(y, 60.0, 70.0) * -300) AS INTEGER) WHEN 'PL' THEN 1400 WHEN 'XX' THEN 1200 ELSE 9999 END AS treeline FROM boxes""".replace(
        "t(y, 58.0, 71.0)", "least(greatest((y - CAST(58.0 AS DOUBLE)) / CAST(13.0 AS DOUBLE), 0), 1)"
    )
    .replace("t(y, 55.5, 69.0)", "least(greatest((y - CAST(55.5 AS DOUBLE)) / CAST(13.5 AS DOUBLE), 0), 1)")
    .replace("t(y, 60.0, 70.0)", "least(greatest((y - CAST(60.0 AS DOUBLE)) / CAST(10.0 AS DOUBLE), 0), 1)")
)
def b29_treeline(spark, sf_dir):
    return derived(spark, sf_dir, "boxes").select("id", C.treeline(col("country"), col("y")).alias("treeline"))


@query(
    with_tables("points")
    + """SELECT id, CAST(least(greatest(round_even(round_even(m / 2, 0) / 128, 0) * 128, 128), 16384) AS INTEGER) AS faces,
  CAST(greatest(least(8192, 4 * least(greatest(round_even(round_even(m / 2, 0) / 128, 0) * 128, 128), 16384)), least(greatest(round_even(round_even(m / 2, 0) / 128, 0) * 128, 128), 16384)) AS INTEGER) AS imagery
  FROM (SELECT id, CAST(id % 70 AS DOUBLE) * 501 AS m FROM points)"""
)
def b30_b31_sizes(spark, sf_dir):
    faces = C.terrain_faces((col("id") % 70).cast("double") * 501)
    return derived(spark, sf_dir, "points").select("id", faces.alias("faces"), C.imagery_size(faces).alias("imagery"))


@query(
    with_tables("points")
    + """SELECT id, coalesce((SELECT min(s) FROM (SELECT unnest([0.03125, 0.0625, 0.125, 0.25, 0.5, 1.0])::DOUBLE AS s) WHERE hi <= s * 65535.0::DOUBLE * (1.0::DOUBLE - 0.1::DOUBLE) AND lo >= -s * 65535.0::DOUBLE * 0.1::DOUBLE),
  greatest(0.03125, greatest(hi - lo, 0.01) / 65535.0::DOUBLE)) AS scale FROM (SELECT id, CAST(id % 13 AS DOUBLE) * -700 AS lo, CAST(id % 97 AS DOUBLE) * 650 AS hi FROM points)"""
)
def b32_height_scale(spark, sf_dir):
    low, high = (col("id") % 13).cast("double") * -700, (col("id") % 97).cast("double") * 650
    return derived(spark, sf_dir, "points").select("id", C.height_scale(low, high).alias("scale"))


@query(
    _ROADS
    + f""", kinds AS (SELECT id, {"CASE id % 5 WHEN 0 THEN 'Road' WHEN 1 THEN 'Forest' WHEN 2 THEN 'Lake' WHEN 3 THEN 'River' ELSE 'Building' END"} AS kind, surface, CASE WHEN in_forest THEN 'coniferous' ELSE 'mixed' END AS forest FROM done)
SELECT id, kind, CASE kind WHEN 'Road' THEN CASE WHEN surface IN ('gravel', 'dirt') THEN surface ELSE 'asphalt' END WHEN 'Forest' THEN CASE WHEN forest = 'coniferous' THEN 'pine_floor' ELSE 'forest_floor' END
  WHEN 'Lake' THEN 'water_edge' WHEN 'River' THEN 'water_edge' END AS ground FROM kinds"""
)
def b27_expected_surface(spark, sf_dir):
    names = F.array(*[lit(x) for x in ("Road", "Forest", "Lake", "River", "Building")])
    roads = classified_roads(spark, sf_dir).withColumn("kind", F.get(names, (col("id") % 5).cast("int")))
    return roads.select("id", "kind", C.expected_surface(col("kind"), col("surface"), F.when(col("in_forest"), "coniferous").otherwise("mixed")).alias("ground"))


_TOKEN = "regexp_replace(regexp_replace(regexp_replace(t, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"


def _sql_folded(x: str) -> str:
    for letter, plain in S.ATOMIC.items():
        x = f"replace({x}, '{letter}', '{plain}')"
    return f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"  # the texts hold no ligatures or such


_NAMES = "regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')"


@query(
    f"""SELECT doc_id, {_TOKEN.replace("(t,", "(array_to_string([upper(substr(w, 1, 1)) || substr(w, 2) FOR w IN string_split_regex(" + _sql_folded("regexp_replace(name, '[''" + '"' + "`]', '', 'g')") + ", '\\s+') IF w <> ''], ''),")} AS token
FROM (SELECT doc_id, {_NAMES} AS name FROM documents)"""
)
def j1_sanitize_token(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.sanitize_token(col("text")).alias("token"))


@query(
    f"""SELECT doc_id, CASE WHEN s = '' THEN 'Terrain' ELSE s END AS project FROM (SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace({_NAMES}, '[^A-Za-z0-9 _-]', '', 'g'), '[ ]+', ' ', 'g'), '_+', '_', 'g'), 64), '^[ _-]+|[ _-]+$', '', 'g') AS s FROM documents)"""
)
def j2_sanitize_project(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", S.sanitize_project(F.regexp_replace("text", r"\s+", " ")).alias("project"))


@query("SELECT s_suppkey AS id, upper(substr(sha256(s_name), 1, 16)) AS guid FROM supplier")
def j3_guid(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(col("s_suppkey").alias("id"), S.guid16(col("s_name")).alias("guid"))


@query(
    with_tables("boxes")
    + "SELECT id, country || '_' || CAST(round_even(abs(y - 60), 0) AS INTEGER) || CASE WHEN y - 60 >= 0 THEN 'N' ELSE 'S' END || '_' || CAST(round_even(abs(x), 0) AS INTEGER) || 'E' AS name FROM boxes"
)
def j4_auto_name(spark, sf_dir):
    return derived(spark, sf_dir, "boxes").select("id", S.auto_name(col("country"), col("y") - 60, col("x")).alias("name"))


def _sql_masked(x: str) -> str:
    """The rule as it stands: one parameter after another, with = and with %3D."""
    for name in ("api-key", "API_Key", "api_key", "apikey", "token", "access_token", "key"):
        for sign in ("=", "%3D"):
            x = f"regexp_replace({x}, '({name}{sign})[^&]+', '\\1***', 'gi')"
    return x


@query(
    rf"""SELECT page_id, {_sql_masked("u")} AS masked,
  coalesce(nullif(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1), ''), u) AS host
FROM (SELECT page_id, url || ['?Token=ab' || page_id, '&x=1&api_key%3Dzz', '', '?subscription_key=S e&mykey=T&y=2', '?accesskey%3dU&API-Key=key=V', '?key=&monkey=1&password=p'][page_id % 6 + 1] AS u FROM pages)"""
)
def j5_j6_urls(spark, sf_dir):
    tails = [F.concat(lit("?Token=ab"), col("page_id").cast("string")), *map(lit, ("&x=1&api_key%3Dzz", "", "?subscription_key=S e&mykey=T&y=2", "?accesskey%3dU&API-Key=key=V", "?key=&monkey=1&password=p"))]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", F.get(F.array(*tails), (col("page_id") % 6).cast("int"))).alias("u"))
    return pages.select("page_id", S.mask_secrets(col("u")).alias("masked"), S.host_label(col("u")).alias("host"))


@query(
    """SELECT o_orderkey AS id, printf('%.1f', n / pow(1024, p)::DOUBLE) || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] AS size
FROM (SELECT *, CASE WHEN n < 1024 THEN 0 ELSE least(4, CAST(floor(log2(n) / 10) AS INTEGER)) END AS p FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) * 7 * CAST(pow(64, o_orderkey % 7) AS BIGINT) AS n FROM orders))"""
)
def j7_human_size(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = col("o_custkey").cast("long") * 7 * F.call_function("shiftleft", lit(1).cast("long"), (col("o_orderkey") % 7 * 6).cast("int"))
    return orders.select(col("o_orderkey").alias("id"), S.human_size(n).alias("size"))


_LOGGERS = ("main", "services.dem", "uvicorn.access", "services", "servicesx", "middleware.rate", "mainly")


@query(
    with_tables("requests")
    + """SELECT id, CASE lower(l) WHEN 'critical' THEN 'error' WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'info' END AS level, regexp_replace('[job:' || key || '] did ' || action, '^\\[job:[^\\]]*\\]\\s*', '') AS message
FROM (SELECT *, ['ERROR', 'Warning', 'DEBUG', 'INFO', 'CRITICAL', 'NOTICE'][id % 6 + 1] AS l FROM requests)"""
)
def j8_log_levels(spark, sf_dir):
    level = F.get(F.array(*[lit(x) for x in ("ERROR", "Warning", "DEBUG", "INFO", "CRITICAL", "NOTICE")]), (col("id") % 6).cast("int"))
    message = F.concat(lit("[job:"), col("key").cast("string"), lit("] did "), "action")
    return derived(spark, sf_dir, "requests").select("id", S.log_level(level).alias("level"), S.strip_job_tag(message).alias("message"))


@query(
    with_tables("requests")
    + f"""SELECT id, logger IN ('main', 'services', 'middleware') OR starts_with(logger, 'main') OR starts_with(logger, 'services.') OR starts_with(logger, 'middleware.') AS app
FROM (SELECT id, {list(_LOGGERS)}[id % 7 + 1] AS logger FROM requests)"""
)
def j8_app_loggers(spark, sf_dir):
    logger = F.get(F.array(*map(lit, _LOGGERS)), (col("id") % 7).cast("int"))
    return derived(spark, sf_dir, "requests").select("id", S.app_logger(logger).alias("app"))


_HAV = "2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))"
_EQ = "6371000 * sqrt(pow(radians(x2 - x1) * cos(radians((y1 + y2) / 2)), 2) + pow(radians(y2 - y1), 2))"


@query(with_tables("points") + f"SELECT id, round({_EQ}, 2) AS flat, round({_HAV}, 2) AS great FROM (SELECT id, lon AS x1, lat AS y1, CAST(16.2 AS DOUBLE) AS x2, CAST(59.1 AS DOUBLE) AS y2 FROM points)")
def c1_c2_distances(spark, sf_dir):
    a = (col("lon"), col("lat"), lit(16.2), lit(59.1))
    return derived(spark, sf_dir, "points").select("id", F.round(G.dist_equirect(*a), 2).alias("flat"), F.round(G.dist_haversine(*a), 2).alias("great"))


@query(with_tables("points") + "SELECT CAST(round_even(lon * 1e7, 0) AS BIGINT) || ':' || CAST(round_even(lat * 1e7, 0) AS BIGINT) AS node, count(*) AS n FROM points GROUP BY 1")
def c3_node_key(spark, sf_dir):
    return derived(spark, sf_dir, "points").groupBy(G.node_key(col("lon"), col("lat")).alias("node")).agg(F.count("*").alias("n"))


@query(with_tables("boxes") + "SELECT id, CASE WHEN round(w, 6) >= round(h, 6) THEN 0.0::DOUBLE ELSE 90.0::DOUBLE END AS angle FROM boxes")
def c5_longest_edge(spark, sf_dir):
    return derived(spark, sf_dir, "boxes").select("id", F.round(G.longest_edge_angle(_exact_ring()), 3).alias("angle"))


def _exact_ring():
    """The box around the origin, so that equal edges are equal numbers."""
    w, h = F.round("w", 6), F.round("h", 6)
    zero = w * 0
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((zero, zero), (w, zero), (w, h), (zero, h), (zero, zero))])


@query(with_tables("boxes") + "SELECT id, round(x, 6) AS west, round(y, 6) AS south, round(x + w, 6) AS east, round(y + h, 6) AS north, round(w * 111320 * cos(radians(y + h / 2)), 2) AS width_m, round(h * 110540, 2) AS height_m FROM boxes")
def c8_bbox(spark, sf_dir):
    b = derived(spark, sf_dir, "boxes").select("id", G.bbox(box_ring()).alias("b")).select("id", "b.*")
    width, height = G.bbox_metres(col("west"), col("south"), col("east"), col("north"))
    return b.select("id", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")], F.round(width, 2).alias("width_m"), F.round(height, 2).alias("height_m"))


@query(with_tables("points") + "SELECT id, 'EPSG:326' || lpad(CAST(CAST(floor((lon - 16 + id % 180 + 180) / 6) AS INTEGER) + 1 AS VARCHAR), 2, '0') AS epsg FROM points")
def c9_utm(spark, sf_dir):
    return derived(spark, sf_dir, "points").select("id", G.utm_epsg(col("lon") - 16 + col("id") % 180, col("lat")).alias("epsg"))


@query(with_tables("points") + "SELECT id, round((lon - 16) / 0.5 * 4096, 3) AS x, round((lat - 59) / 0.3 * 4096, 3) AS z, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points")
def c11_local(spark, sf_dir):
    box = (lit(16.0), lit(59.0), lit(16.5), lit(59.3), lit(4096.0), lit(4096.0))
    local = derived(spark, sf_dir, "points").select("id", G.to_local(col("lon"), col("lat"), *box).alias("p"))
    back = G.to_wgs84(col("p.x"), col("p.z"), *box)
    return local.select("id", F.round("p.x", 3).alias("x"), F.round("p.z", 3).alias("z"), F.round(back["lon"], 6).alias("lon"), F.round(back["lat"], 6).alias("lat"))


@query()
def c12_projected(spark, sf_dir):
    p = G.project_tm(col("lon"), col("lat"), 15.0)
    return derived(spark, sf_dir, "points").select("id", F.round(p["x"], 2).alias("x"), F.round(p["y"], 2).alias("y"))


@query(
    with_tables("boxes")
    + """, t AS (SELECT id, unnest(range(CAST(floor(y) AS BIGINT), greatest(CAST(ceil(y + h * 300) AS BIGINT), CAST(floor(y) AS BIGINT) + 1))) AS lat, x, w FROM boxes),
u AS (SELECT id, lat, unnest(range(CAST(floor(x - 17) AS BIGINT), greatest(CAST(ceil(x - 17 + w * 300) AS BIGINT), CAST(floor(x - 17) AS BIGINT) + 1))) AS lon FROM t)
SELECT id, 'N' || lpad(CAST(lat AS VARCHAR), 2, '0') || '_00_' || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0') || '_00' AS tile FROM u"""
)
def a8_tile_catalog(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").select("id", (col("x") - 17).alias("west"), col("y").alias("south"), (col("x") - 17 + col("w") * 300).alias("east"), (col("y") + col("h") * 300).alias("north"))
    from ..sources.tiles import tile_catalog

    return tile_catalog(boxes).select("id", "tile")
