"""Queries of feature routing, spatial joins, lines, names and stateful operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from ..functions import lookups as L
from ..operators import features as E
from ..operators import lines as N
from ..operators import attribution, naming, spatial
from ..streaming import stateful as K
from ..streaming import timers
from .derive import derived, pick, with_tables
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


def elements(spark, sf_dir):
    """Tagged elements from parts."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = col("p_partkey")

    def one(by: int, *values):
        return F.get(F.array(*[lit(v) for v in values]), (k % by).cast("int"))

    tags = {
        "highway": one(7, "primary", "", "path", "", "raceway", "", ""), "natural": one(9, "", "water", "wetland", "wood", "scrub", "beach", "", "coastline", ""),
        "waterway": one(5, "", "", "river", "", "drain"), "landuse": one(11, "", "forest", "meadow", "", "", "", "quarry", "", "", "", ""),
        "leisure": one(13, "park", "", "", "", "", "", "", "", "", "", "", "", ""), "building": one(6, "", "yes", "", "house", "", ""),
        "height": one(8, "", "12", "9.5 m", "tall", "", "", "", ""), "building:levels": one(3, "2", "", "x"), "shop": one(4, "", "mall", "", ""),
        "amenity": one(10, "", "place_of_worship", "", "", "", "", "", "", "", ""), "office": one(15, "", "", "", "yes", "", "", "", "", "", "", "", "", "", "", ""),
    }
    return part.select(
        k.cast("long").alias("id"), F.when(k % 4 == 3, "relation").otherwise("way").alias("type"), F.create_map(*[x for n, v in tags.items() for x in (lit(n), v)]).alias("tags"),
        (3 + k % 4).cast("int").alias("points"), (k % 2 == 0).alias("closed"),
    )


def _pick(n: int, values: list[str]) -> str:
    return f"{values}[k % {n} + 1]"


_EL = f"""WITH el AS (SELECT k AS id, CASE WHEN k % 4 = 3 THEN 'relation' ELSE 'way' END AS type, {_pick(7, ['primary', '', 'path', '', 'raceway', '', ''])} AS highway,
  {_pick(9, ['', 'water', 'wetland', 'wood', 'scrub', 'beach', '', 'coastline', ''])} AS nat, {_pick(5, ['', '', 'river', '', 'drain'])} AS waterway,
  {_pick(11, ['', 'forest', 'meadow', '', '', '', 'quarry', '', '', '', ''])} AS landuse, {_pick(13, ['park'] + [''] * 12)} AS leisure, {_pick(6, ['', 'yes', '', 'house', '', ''])} AS building,
  {_pick(8, ['', '12', '9.5 m', 'tall', '', '', '', ''])} AS height, {_pick(3, ['2', '', 'x'])} AS levels, {_pick(4, ['', 'mall', '', ''])} AS shop,
  {_pick(10, ['', 'place_of_worship'] + [''] * 8)} AS amenity, {_pick(15, ['', '', '', 'yes'] + [''] * 11)} AS office, 3 + k % 4 AS points, k % 2 = 0 AS closed FROM (SELECT CAST(p_partkey AS BIGINT) AS k FROM part)) """
_ROUTES = """, routed AS (
SELECT id, 'roads' AS category FROM el WHERE type = 'way' AND highway IN ('primary', 'path') UNION ALL
SELECT id, 'water' FROM el WHERE nat IN ('water', 'wetland') OR (type = 'way' AND (nat = 'coastline' OR waterway IN ('river', 'drain'))) UNION ALL
SELECT id, 'forests' FROM el WHERE nat = 'wood' OR landuse = 'forest' OR (type = 'way' AND nat = 'scrub') UNION ALL
SELECT id, 'buildings' FROM el WHERE building <> '' UNION ALL
SELECT id, 'land_use' FROM el WHERE landuse IN ('meadow', 'quarry') OR (type = 'way' AND (leisure = 'park' OR nat = 'beach'))) """


@query(_EL + _ROUTES + "SELECT id, category FROM routed")
def b1_route_elements(spark, sf_dir):
    return E.route_elements(elements(spark, sf_dir)).select("id", "category")


@query(_EL + _ROUTES + "SELECT c.category, count(id) AS n, count(id) = 0 AS empty FROM (SELECT unnest(['roads', 'water', 'forests', 'buildings', 'land_use', 'railways']) AS category) c LEFT JOIN routed USING (category) GROUP BY 1")
def e2_feature_counts(spark, sf_dir):
    names = spark.createDataFrame([(c,) for c in (*E.CATEGORIES, "railways")], "category string")
    counts = E.route_elements(elements(spark, sf_dir)).groupBy("category").agg(F.count("*").alias("n"))
    n = F.coalesce("n", lit(0).cast("long"))
    return F.broadcast(names).join(counts, "category", "left").select("category", n.alias("n"), (n == 0).alias("empty"))


@query(_EL + "SELECT id, CASE WHEN highway = '' THEN '' ELSE highway END AS highway, 'no' AS bridge, 'no' AS tunnel, '' AS surface FROM el WHERE type = 'way' AND highway IN ('primary', 'path')")
def b2_road_features(spark, sf_dir):
    roads = E.route_elements(elements(spark, sf_dir)).where(col("category") == "roads")
    return E.road_features(roads).select("id", "highway", "bridge", "tunnel", "surface")


@query(
    _EL
    + """SELECT id, CASE WHEN nat = 'water' THEN 'lake' WHEN waterway <> '' THEN waterway WHEN nat IN ('coastline', 'wetland') THEN nat ELSE 'unknown' END AS water_type,
  CASE WHEN nat IN ('water', 'wetland') AND points > 3 AND closed THEN 'Polygon' ELSE 'LineString' END AS geometry FROM el"""
)
def b3_water_features(spark, sf_dir):
    return E.water_features(elements(spark, sf_dir), col("points"), col("closed")).select("id", "water_type", "geometry")


@query(_EL + "SELECT id, coalesce(nullif(landuse, ''), nullif(nat, ''), nullif(leisure, ''), 'unknown') AS kind FROM el WHERE points >= 4")
def b4_area_features(spark, sf_dir):
    return E.area_features(elements(spark, sf_dir), col("points")).select("id", "kind")


_BUILD = """, b AS (SELECT id, CASE WHEN building = 'yes' AND amenity = 'place_of_worship' THEN 'church' WHEN building = 'yes' AND shop <> '' THEN 'commercial' WHEN building = 'yes' AND office <> '' THEN 'office' ELSE building END AS building_type,
  CASE WHEN height <> '' THEN coalesce(TRY_CAST(trim(replace(height, 'm', '')) AS DOUBLE), 0) WHEN levels <> '' THEN coalesce(TRY_CAST(levels AS DOUBLE) * 3, 0) ELSE 0 END AS height_m
  FROM el WHERE type = 'way' AND points >= 4 AND building <> '') """


@query(_EL + _BUILD + "SELECT id, building_type, CAST(height_m AS DOUBLE) AS height_m FROM b")
def b5_building_features(spark, sf_dir):
    return E.building_features(elements(spark, sf_dir).where(E.tag("building") != ""), col("points"))


@query(
    _EL
    + _BUILD
    + f"SELECT id, building_type, CASE WHEN height_m = 0 THEN {L.sql_case('building_type', E.BUILDING_HEIGHTS, 6.0)} ELSE height_m END AS height_m, {L.sql_case('building_type', E.BUILDING_ASSETS, 'Building_Generic')} AS asset FROM b"
)
def b26_classify_buildings(spark, sf_dir):
    return E.classify_buildings(E.building_features(elements(spark, sf_dir).where(E.tag("building") != ""), col("points")))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 5 ELSE 4 END AS points FROM supplier")
def b6_rings(spark, sf_dir):
    ring = F.when(col("id") % 2 == 0, F.slice(box_ring(), 1, 4)).otherwise(F.slice(box_ring(), 1, 3))
    return derived(spark, sf_dir, "boxes").select("id", F.size(E.closed_ring(ring)).alias("points"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS rings, CASE WHEN s_suppkey % 2 = 0 THEN 10 ELSE 5 END AS points, CASE WHEN s_suppkey % 2 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind FROM supplier")
def b6_outer_rings(spark, sf_dir):
    """Relations with an outer ring, an inner one, an open one of either role and an outer one that is too short."""
    member = lambda role, ring: F.struct(role.alias("role"), ring.alias("ring"))
    either = F.when(col("id") % 2 == 0, "outer").otherwise("inner")
    members = F.array(member(lit("outer"), box_ring()), member(lit("inner"), box_ring()), member(either, F.slice(box_ring(), 1, 4)), member(lit("outer"), F.slice(box_ring(), 1, 3)))
    rings = derived(spark, sf_dir, "boxes").select("id", E.outer_rings(members).alias("rings"))
    points = F.aggregate("rings", lit(0), lambda n, r: n + F.size(r))
    return rings.select("id", F.size("rings").alias("n"), points.alias("points")).select("id", col("n").alias("rings"), "points", F.when(col("n") > 1, "MultiPolygon").otherwise("Polygon").alias("kind"))


@query(
    "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'canal' ELSE 'stream' END AS line, 'lake' AS standing, CASE WHEN c_custkey % 3 = 0 THEN 'yes' ELSE 'no' END AS intermittent FROM customer"
)
def b7_b11_hydro(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(col("c_custkey").alias("id"))
    origin = F.when(col("id") % 4 == 0, " ManMade ")
    local = F.when(col("id") % 2 == 0, "Vattendrag")
    persistence = F.when(col("id") % 3 == 0, "Intermittent").otherwise("perennial")
    return rows.select("id", E.hydro_line_type(local, origin).alias("line"), E.hydro_standing_type(lit("Sjö")).alias("standing"), E.intermittent_flag(persistence).alias("intermittent"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey WHEN c_custkey % 3 = 1 THEN 7 ELSE 0 END AS number FROM customer")
def b12_numeric_id(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(col("c_custkey").cast("long").alias("id"))
    text = F.when(col("id") % 3 == 0, F.concat(lit(" "), col("id").cast("string"))).otherwise("n/a")
    return rows.select("id", E.numeric_id(text, lit(None).cast("string"), F.when(col("id") % 3 == 1, lit(7).cast("long"))).alias("number"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 5 = 0 AND o_orderkey % 2 = 0)")
def b15_snapshots(spark, sf_dir):
    k = col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("id"), F.when(k % 3 == 0, "soon").otherwise("2024-05-01T12:00:00Z").alias("base_time"), F.when(k % 5 == 0, 0).otherwise(k % 9 + 1).alias("elements"), F.when(k % 2 == 0, "timeout").alias("remark")
    )
    return E.accepted_snapshots(rows).select("id")


@query(
    with_tables("boxes")
    + """SELECT id, CASE WHEN id % 6 < 2 THEN 'too few points' WHEN (y + h * s) - y < 0.001::DOUBLE OR (x + w * s) - x < 0.001::DOUBLE THEN 'too small' WHEN w * s * 111320 * cos(radians(y + h * s / 2)) > 33024 OR h * s * 110540 > 33024 THEN 'too large' ELSE 'ok' END AS verdict
  FROM (SELECT *, CASE id % 4 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 1 ELSE 120 END AS s FROM boxes)"""
)
def b16_validate(spark, sf_dir):
    s = F.when(col("id") % 4 == 0, 0.1).when(col("id") % 4 == 1, 1.0).otherwise(120.0)
    boxes = derived(spark, sf_dir, "boxes").withColumn("w", col("w") * s).withColumn("h", col("h") * s)
    verdict = E.polygon_verdict(2 + col("id") % 6, col("x"), col("y"), col("x") + col("w"), col("y") + col("h"))
    return boxes.select("id", verdict.alias("verdict"))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 5 < 2 OR p_partkey % 7 = 0")
def b17_raster_assets(spark, sf_dir):
    k = col("p_partkey")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        k.alias("id"), F.when(k % 5 == 0, "a.TIF").when(k % 5 == 1, "b.tiff").otherwise("c.json").alias("href"), F.when(k % 7 == 0, "image/TIFF; x").alias("media")
    )
    return E.raster_assets(rows).select("id")


@query("SELECT k AS area, source, priority FROM (SELECT ps.*, row_number() OVER (PARTITION BY k ORDER BY priority) AS n FROM (SELECT c_custkey AS k, s AS priority, ['national', 'global_a', 'global_b', 'srtm'][s] AS source, (c_custkey + s * 7) % 3 = 0 AS available FROM customer, range(1, 5) t(s)) ps WHERE available) WHERE n = 1")
def d11_first_available(spark, sf_dir):
    names = F.array(*[lit(x) for x in ("national", "global_a", "global_b", "srtm")])
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(col("c_custkey").alias("area"), F.explode(F.sequence(lit(1).cast("long"), lit(4).cast("long"))).alias("priority"))
    rows = rows.withColumn("source", F.get(names, (col("priority") - 1).cast("int"))).withColumn("available", (col("area") + col("priority") * 7) % 3 == 0)
    return E.first_available(rows)


_PB = with_tables("points", "countries") + ", p AS (SELECT id, (lon - 16) * 110 - 2 AS lon, (lat - 59) * 190 - 2 AS lat FROM points) "


@query(
    _PB
    + """SELECT p.id, (SELECT code FROM (SELECT code, sqrt(pow(greatest(xmin - p.lon, 0, p.lon - xmax), 2) + pow(greatest(ymin - p.lat, 0, p.lat - ymax), 2)) AS d FROM countries) WHERE d <= 0.25 ORDER BY d, code LIMIT 1) AS code FROM p"""
)
def d1_points_in_countries(spark, sf_dir):
    points = derived(spark, sf_dir, "points").select("id", ((col("lon") - 16) * 110 - 2).alias("lon"), ((col("lat") - 59) * 190 - 2).alias("lat"))
    return spatial.points_in_boxes(points, derived(spark, sf_dir, "countries"), 5.0).select("id", "code")


_OV = with_tables("boxes", "countries") + """, b AS (SELECT id, (id % 47) AS x0, (id % 43) AS y0, 3 + id % 11 AS s FROM boxes),
o AS (SELECT id, code, (least(xmax, x0 + s) - greatest(xmin, x0)) * (least(ymax, y0 + s) - greatest(ymin, y0)) AS area FROM b, countries WHERE least(xmax, x0 + s) > greatest(xmin, x0) AND least(ymax, y0 + s) > greatest(ymin, y0)) """


def _overlaps(spark, sf_dir):
    x, y, s = (col("id") % 47).cast("double"), (col("id") % 43).cast("double"), (3 + col("id") % 11).cast("double")
    boxes = derived(spark, sf_dir, "boxes").select("id", x.alias("xmin"), y.alias("ymin"), (x + s).alias("xmax"), (y + s).alias("ymax"))
    return spatial.box_overlaps(boxes, derived(spark, sf_dir, "countries"), 5.0)


@query(_OV + "SELECT id, code, round(area, 4) AS area FROM o")
def d2_overlaps(spark, sf_dir):
    return _overlaps(spark, sf_dir).withColumn("area", F.round("area", 4))


@query(_OV + "SELECT id, arg_min(code, (-area, code)) AS first, string_agg(code, ',' ORDER BY code) AS codes FROM o GROUP BY id")
def d3_largest_overlap(spark, sf_dir):
    return spatial.largest_overlap(_overlaps(spark, sf_dir))


@query(
    with_tables("points", "boxes")
    + """, p AS (SELECT id, (lon - 16) * 1000 AS x, (lat - 59) * 1000 AS y FROM points), s AS (SELECT (x - 16) * 500 AS ax, (y - 59) * 300 AS ay, (x - 16) * 500 + 20 AS bx, (y - 59) * 300 + (id % 3) * 5 AS by_, 2 + id % 3 AS reach FROM boxes)"""
    + """ SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, greatest(0, least(1, ((p.x - ax) * (bx - ax) + (p.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM s)
  WHERE sqrt(pow(p.x - ax - t * (bx - ax), 2) + pow(p.y - ay - t * (by_ - ay), 2)) <= reach)"""
)
def d5_drop_near_lines(spark, sf_dir):
    points = derived(spark, sf_dir, "points").select("id", ((col("lon") - 16) * 1000).alias("x"), ((col("lat") - 59) * 1000).alias("y"))
    ax, ay = (col("x") - 16) * 500, (col("y") - 59) * 300
    segments = derived(spark, sf_dir, "boxes").select(
        ax.alias("ax"), ay.alias("ay"), (ax + 20).alias("bx"), (ay + (col("id") % 3) * 5).alias("by"), (2 + col("id") % 3).cast("double").alias("reach")
    )
    return spatial.drop_near_lines(points, segments, "reach", 10.0).select("id")


@query()
def d6_snap_junctions(spark, sf_dir):
    ways = derived(spark, sf_dir, "ways").withColumn("rank", F.when(col("highway") == "primary", 2).when(col("highway") == "residential", 8).otherwise(11))
    ends = ways.select("id", col("ax").alias("lon"), (col("ay") + 0.00005).alias("lat"), "rank")
    vertices = ways.select(col("b").alias("vid"), col("bx").alias("vlon"), col("by_").alias("vlat"), col("rank").alias("vrank"))
    return spatial.snap_ends(ends, vertices).withColumn("d", F.round("d", 3))


_WAYS = with_tables("ways") + """, e AS (SELECT id, highway, a AS node FROM ways UNION ALL SELECT id, highway, b FROM ways),
n AS (SELECT node, count(*) AS c, count(DISTINCT highway) AS h FROM e GROUP BY node) """


@query(
    _WAYS
    + """SELECT id, min(id) FILTER (first) OVER (PARTITION BY run) AS road FROM (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (ORDER BY id) AS run FROM (SELECT w.id, NOT coalesce(n.c = 2 AND n.h = 1, false) AS first FROM ways w JOIN n ON n.node = w.a))"""
)
def d8_stitch_ways(spark, sf_dir):
    return N.stitch_ways(derived(spark, sf_dir, "ways"), ("highway",))


@query(
    _WAYS
    + "SELECT (SELECT count(*) FROM ways) AS ways, (SELECT count(*) FROM n WHERE c >= 3) AS junctions, (SELECT count(*) FROM n WHERE c = 1) AS dead_ends"
)
def e15_network_stats(spark, sf_dir):
    ends = derived(spark, sf_dir, "ways").select("id", F.explode(F.array("a", "b")).alias("node"))
    nodes = ends.groupBy("node").agg(F.count("*").alias("c"))
    stats = nodes.agg(F.count_if(col("c") >= 3).alias("junctions"), F.count_if(col("c") == 1).alias("dead_ends"))
    return stats.crossJoin(derived(spark, sf_dir, "ways").agg(F.count("*").alias("ways"))).select("ways", "junctions", "dead_ends")


_LP = with_tables("line_points")
_EQ = "6371000 * sqrt(pow(radians(x - px) * cos(radians((y + py) / 2)), 2) + pow(radians(y - py), 2))"


@query(
    _LP
    + f", s AS (SELECT line_id, seq, coalesce({_EQ}, 0) AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY seq))) SELECT line_id, seq, round(step, 2) AS step, round(sum(step) OVER (PARTITION BY line_id ORDER BY seq), 2) AS run, round(sum(step) OVER (PARTITION BY line_id), 2) AS total FROM s"
)
def f5_line_measures(spark, sf_dir):
    rows = N.measures(derived(spark, sf_dir, "line_points"))
    return rows.select("line_id", "seq", *[F.round(c, 2).alias(c) for c in ("step", "run", "total")])


@query()
def c7_drop_hairpins(spark, sf_dir):
    return N.drop_hairpins(derived(spark, sf_dir, "line_points"), 150.0, 4000.0).select("line_id", "seq")


@query()
def c15_densify(spark, sf_dir):
    return N.densify(derived(spark, sf_dir, "line_points"), 400.0).groupBy("line_id").agg(F.count("*").alias("points"))


@query()
def c16_simplify(spark, sf_dir):
    return N.simplify(derived(spark, sf_dir, "line_points"), 800.0).select("line_id", "seq")


def _local_lines(spark, sf_dir):
    """Lines in metres with a height."""
    points = derived(spark, sf_dir, "line_points")
    return points.select("line_id", "seq", ((col("x") - 16) * 10000).alias("x"), ((col("y") - 59) * 10000).alias("y"), ((col("line_id") * 7 + col("seq") * 13) % 50 * 0.1).alias("z"))


@query()
def c16_simplify_schedule(spark, sf_dir):
    """Tolerances by the size of each line, rising until three points at most are left, else every n-th point."""
    return N.simplify_schedule(_local_lines(spark, sf_dir).drop("z"), 3).select("line_id", "seq")


@query()
def c17_simplify_roads(spark, sf_dir):
    """Sideways and height error together, with tolerances doubled while over four points."""
    return N.simplify_roads(_local_lines(spark, sf_dir), 4).select("line_id", "seq")


@query(_LP + ", r AS (SELECT line_id, seq, x - first_value(x) OVER w AS x, y - first_value(y) OVER w AS y FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY seq)) SELECT line_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM r UNION ALL SELECT line_id, max(seq) + 1, 0, 0 FROM r GROUP BY line_id")
def c23_relative_closed(spark, sf_dir):
    return N.relative_points(derived(spark, sf_dir, "line_points"), closed=True).select("line_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    _LP
    + ", i AS (SELECT line_id, seq - 1 AS i, count(*) OVER (PARTITION BY line_id) - 1 AS last FROM line_points) SELECT line_id, i + 1 AS seq, CAST(unnest(CASE WHEN i % 2 = 0 AND i > 0 AND i = last THEN [i // 2 - 1] WHEN i % 2 = 0 AND i > 0 THEN [i // 2 - 1, i // 2] ELSE [i // 2] END) AS INTEGER) AS chunk FROM i"
)
def c18_chunk_line(spark, sf_dir):
    return N.chunk_line(derived(spark, sf_dir, "line_points"), 3).select("line_id", "seq", "chunk")


@query(_LP + ", k AS (SELECT *, count(*) OVER (PARTITION BY line_id) AS n FROM line_points WHERE x BETWEEN 16.01::DOUBLE AND 16.03::DOUBLE AND y BETWEEN 59 AND 59.02::DOUBLE) SELECT line_id, seq FROM k WHERE n >= 2")
def c19_in_bounds(spark, sf_dir):
    return N.in_bounds(derived(spark, sf_dir, "line_points"), 16.01, 59.0, 16.03, 59.02).select("line_id", "seq")


@query(_LP + "SELECT line_id, seq, round(x - first_value(x) OVER w, 6) AS x, round(y - first_value(y) OVER w, 6) AS y FROM line_points WINDOW w AS (PARTITION BY line_id ORDER BY seq)")
def c23_relative(spark, sf_dir):
    return N.relative_points(derived(spark, sf_dir, "line_points")).select("line_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    with_tables("boxes")
    + """, q AS (SELECT id, greatest(x, 16.1::DOUBLE) AS x0, greatest(y, 59.1::DOUBLE) AS y0, least(x + w * 100, 16.6::DOUBLE) AS x1, least(y + h * 100, 59.6::DOUBLE) AS y1 FROM boxes)
SELECT id, round((x1 - x0) * (y1 - y0), 6) AS area FROM q WHERE x1 > x0 AND y1 > y0"""
)
def c20_clip_polygon(spark, sf_dir):
    from ..functions.geometry import ring_area

    boxes = derived(spark, sf_dir, "boxes").withColumn("w", col("w") * 100).withColumn("h", col("h") * 100)
    rows = boxes.select(col("id").alias("line_id"), F.posexplode(F.slice(box_ring(), 1, 4)).alias("seq", "p")).select("line_id", "seq", "p.x", "p.y")
    clipped = N.clip_polygon(rows, 16.1, 59.1, 16.6, 59.6)
    rings = clipped.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    ring = E.closed_ring(F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))))
    return rings.select(col("line_id").alias("id"), F.round(ring_area(ring), 6).alias("area")).where("area > 0")


@query(
    with_tables("boxes")
    + """, f AS (SELECT id, CASE id % 3 WHEN 0 THEN 'Road' WHEN 1 THEN 'Lake' ELSE 'Building' END AS kind, CASE id % 3 WHEN 0 THEN 'Asphalt' WHEN 1 THEN 'Lake' ELSE 'House' END AS category, CASE WHEN id % 4 = 0 THEN 'Gamla ' || 'V' || id % 5 ELSE '' END AS name, CASE WHEN x >= 16.4::DOUBLE THEN 'E' ELSE 'W' END AS ew, CASE WHEN y >= 59.4::DOUBLE THEN 'N' ELSE 'S' END AS ns FROM boxes),
b AS (SELECT *, CASE WHEN name = '' THEN CASE WHEN kind = category THEN kind ELSE kind || '_' || category END || '_' || ns || ew || '_' || lpad(CAST(row_number() OVER (PARTITION BY kind, category, ns, ew, name = '' ORDER BY id) AS VARCHAR), 3, '0')
  WHEN kind = 'Building' THEN kind || '_' || category || '_' || replace(name, ' ', '') WHEN kind = 'Lake' THEN kind || '_' || replace(name, ' ', '') ELSE kind || '_' || replace(name, ' ', '') || '_' || category END AS base FROM f)
SELECT id, CASE WHEN k = 1 THEN base ELSE base || '_' || lpad(CAST(k AS VARCHAR), 3, '0') END AS entity FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY id) AS k FROM b)"""
)
def f2_name_features(spark, sf_dir):
    three = (col("id") % 3).cast("int")
    kind = F.get(F.array(lit("Road"), lit("Lake"), lit("Building")), three)
    category = F.get(F.array(lit("Asphalt"), lit("Lake"), lit("House")), three)
    name = F.when(col("id") % 4 == 0, F.concat(lit("Gamla V"), (col("id") % 5).cast("string"))).otherwise("")
    rows = derived(spark, sf_dir, "boxes").select("id", kind.alias("kind"), category.alias("category"), name.alias("name"), (col("x") - 16).alias("x"), (col("y") - 59).alias("z"))
    return naming.name_features(rows.withColumn("x", F.when(derived_x(), 0.9).otherwise(0.1)).withColumn("z", F.when(derived_z(), 0.9).otherwise(0.1)), 1.0, 1.0)


def derived_x():
    return (col("id") % 89) * 0.01 + 16.0 >= 16.4


def derived_z():
    return (col("id") % 83) * 0.01 + 59.0 >= 59.4


@query(with_tables("boxes") + "SELECT id, CASE WHEN y >= 59.4::DOUBLE THEN 'N' ELSE 'S' END || CASE WHEN x >= 16.4::DOUBLE THEN 'E' ELSE 'W' END AS quadrant FROM boxes")
def f1_quadrant(spark, sf_dir):
    from ..functions.strings import quadrant

    return derived(spark, sf_dir, "boxes").select("id", quadrant(F.when(derived_x(), 0.9).otherwise(0.1), F.when(derived_z(), 0.9).otherwise(0.1), lit(1.0), lit(1.0)).alias("quadrant"))


@query("SELECT s_suppkey AS id, s_nationkey AS pool, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 0 DESC, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal ELSE s_suppkey END, s_suppkey) AS INTEGER) AS rank FROM supplier")
def f4_rank_sources(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        col("s_suppkey").alias("id"), col("s_nationkey").alias("pool"), (col("s_suppkey") % 3 != 0).alias("healthy"), col("s_acctbal").alias("latency"), col("s_suppkey").alias("place")
    )
    return K.rank_sources(rows).select("id", "pool", "rank")


_RQ = with_tables("requests")


@query(_RQ + "SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS k FROM requests) WHERE k <= 20")
def f6_last_logs(spark, sf_dir):
    return K.last_logs(derived(spark, sf_dir, "requests"), 20).select("key", "id")


@query(_RQ + "SELECT key, id, CAST(n AS INTEGER) AS n, total FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n, count(*) OVER (PARTITION BY key) AS total FROM requests) WHERE n > 30")
def f6_logs_since(spark, sf_dir):
    return K.logs_since(derived(spark, sf_dir, "requests"), 30).select("key", "id", "n", "total")


@query()
def k1_rate_limit(spark, sf_dir):
    return K.rate_limit(derived(spark, sf_dir, "requests"), 10, 86400.0)


@query()
def k1_rate_limits(spark, sf_dir):
    """Both limits over API calls: keys by session or address, exempt paths left out."""
    k = col("id")
    pick = lambda n, *values: F.get(F.array(*[lit(v).cast("string") for v in values]), (k % n).cast("int"))
    calls = derived(spark, sf_dir, "requests").select(
        "id", "ts", pick(7, "/api/generate", "/api/status", "/static/a.js", "/api/health", "/api/job/7/preview/h", "/api/job/7", "/api/generate").alias("path"),
        pick(3, "POST", "POST", "GET").alias("method"), F.when(k % 4 == 0, F.concat(lit("s"), (col("key") % 40).cast("string"))).alias("session"),
        F.when(k % 5 == 0, F.concat(lit("10.0.0."), (col("key") % 9).cast("string"), lit(", 1.1.1.1"))).alias("forwarded"), F.when(k % 3 == 0, "10.0.1.1").alias("real_ip"), F.when(k % 2 == 0, "10.0.2.2").alias("peer"),
    )
    return K.rate_limits(K.api_calls(calls), (10, 86400.0), (3, 604800.0))


@query(
    _RQ
    + """, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY key ORDER BY ts, id)) <= 43200000000 THEN 0 ELSE 1 END AS f FROM requests), s AS (SELECT *, sum(f) OVER (PARTITION BY key ORDER BY ts, id) AS session FROM g)
SELECT key, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2"""
)
def k2_sessions(spark, sf_dir):
    return K.sessions(derived(spark, sf_dir, "requests"), 12)


@query(_RQ + "SELECT id, min(ts) AS begin_ts FROM (SELECT id // 2 AS id, id % 2 AS e, ts FROM requests WHERE key % 5 <> 0 OR id % 2 = 0) GROUP BY id HAVING count(*) FILTER (e = 0) > 0 AND (count(*) FILTER (e = 1) = 0 OR epoch_us(min(ts) FILTER (e = 1)) - epoch_us(min(ts) FILTER (e = 0)) > 60000000)".replace("min(ts) AS begin_ts", "min(ts) FILTER (e = 0) AS begin_ts"))
def k4_stalled(spark, sf_dir):
    rows = derived(spark, sf_dir, "requests").where("key % 5 <> 0 OR id % 2 = 0")
    rows = rows.select(F.floor(col("id") / 2).cast("long").alias("id"), F.when(col("id") % 2 == 0, "begin").otherwise("end").alias("kind"), "ts")
    return K.stalled(rows).select("id", col("begin").alias("begin_ts"))


@query(_RQ + "SELECT key, count(*) FILTER (e IS NOT NULL) AS done, count(*) FILTER (e IS NULL AND b + INTERVAL 600 SECOND > now_) AS in_flight, count(*) FILTER (e IS NULL AND b + INTERVAL 600 SECOND <= now_) AS failed, count(*) FILTER (coalesce(e, now_) > b + INTERVAL 60 SECOND) AS warned FROM (SELECT id // 2 AS id, min(key) AS key, min(ts) FILTER (id % 2 = 0) AS b, min(ts) FILTER (id % 2 = 1) AS e FROM requests WHERE key % 5 <> 0 OR id % 2 = 0 GROUP BY 1), (SELECT max(ts) AS now_ FROM requests) WHERE b IS NOT NULL GROUP BY key")
def k4_attempt_counts(spark, sf_dir):
    rows = derived(spark, sf_dir, "requests").where("key % 5 <> 0 OR id % 2 = 0")
    rows = rows.select("key", F.floor(col("id") / 2).cast("long").alias("id"), F.when(col("id") % 2 == 0, "begin").otherwise("end").alias("kind"), "ts")
    return K.attempt_counts(rows, derived(spark, sf_dir, "requests").agg(F.max("ts").alias("now")))


@query(
    _RQ
    + """, j AS (SELECT key AS job, max(ts) AS done FROM requests GROUP BY key), n AS (SELECT max(ts) - INTERVAL 7 MINUTE AS now_ FROM requests)
SELECT job, CAST(greatest(0, ceil((epoch_us(done + INTERVAL 10 MINUTE) - epoch_us(now_)) / 60000000::DOUBLE)) AS BIGINT) AS minutes FROM j, n"""
)
def k5_minutes_left(spark, sf_dir):
    rows = derived(spark, sf_dir, "requests")
    jobs = rows.groupBy(col("key").alias("job")).agg(F.max("ts").alias("done"))
    none = rows.where("false").select(col("key").alias("job"), col("ts").alias("begin"), col("ts").alias("finish"))
    now = rows.agg((F.max("ts") - F.expr("INTERVAL 7 MINUTE")).alias("now"))
    return K.minutes_left(K.retention(jobs, none), now).select("job", "minutes")


@query(
    _RQ
    + """, j AS (SELECT key AS job, max(ts) AS done FROM requests GROUP BY key), d AS (SELECT key AS job, ts + INTERVAL 5 MINUTE AS b, ts + INTERVAL 30 MINUTE AS f FROM requests WHERE id % 3 = 0)
SELECT job, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.job = j.job AND b <= done + INTERVAL 10 MINUTE AND f > done + INTERVAL 10 MINUTE) THEN done + INTERVAL 15 MINUTE ELSE done + INTERVAL 10 MINUTE END AS expiry FROM j"""
)
def k5_retention(spark, sf_dir):
    rows = derived(spark, sf_dir, "requests")
    jobs = rows.groupBy(col("key").alias("job")).agg(F.max("ts").alias("done"))
    downloads = rows.where("id % 3 = 0").select(col("key").alias("job"), F.expr("ts + INTERVAL 5 MINUTE").alias("begin"), F.expr("ts + INTERVAL 30 MINUTE").alias("finish"))
    return K.retention(jobs, downloads).select("job", "expiry")


@query(
    _RQ
    + """, s AS (SELECT id // 2 AS id, epoch_us(min(ts) FILTER (id % 2 = 0)) // 1000 AS b, epoch_us(min(ts) FILTER (id % 2 = 1)) // 1000 AS e FROM requests WHERE key % 5 <> 0 OR id % 2 = 0 GROUP BY 1),
o AS (SELECT id, 'stalled' AS event, b + 60000 AS ms FROM s WHERE e IS NULL OR e > b + 60000
  UNION ALL SELECT id, 'done', greatest(b, e) FROM s WHERE e - b < 600000
  UNION ALL SELECT id, 'failed', b + 600000 FROM s WHERE e IS NULL OR e - b >= 600000)
SELECT id, event, ms FROM o WHERE ms <= (SELECT epoch_us(max(ts)) // 1000 FROM requests)"""
)
def k4_attempt_events(spark, sf_dir):
    rows = derived(spark, sf_dir, "requests").where("key % 5 <> 0 OR id % 2 = 0")
    rows = rows.select(F.floor(col("id") / 2).cast("long").alias("id"), F.when(col("id") % 2 == 0, "begin").otherwise("end").alias("kind"), "ts")
    until = derived(spark, sf_dir, "requests").agg(F.max("ts")).first()[0]  # one time
    return timers.attempt_events(rows, lit(until)).select("id", "event", F.unix_millis("at").alias("ms"))


@query(
    _RQ
    + """, j AS (SELECT key AS job, epoch_us(max(ts)) // 1000 AS done FROM requests WHERE key % 4 <> 0 GROUP BY key),
d AS (SELECT key AS job, epoch_us(ts) // 1000 + 300000 AS b, CASE WHEN id % 2 = 0 THEN epoch_us(ts) // 1000 + 1800000 ELSE epoch_us(ts) // 1000 + 300000 + 86400000 END AS f FROM requests WHERE id % 3 = 0)
SELECT job, done + 600000 + CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.job = j.job AND b <= done + 600000 AND f > done + 600000) THEN 300000 ELSE 0 END AS ms FROM j"""
)
def k5_expiries(spark, sf_dir):
    rows = derived(spark, sf_dir, "requests")
    job, none = col("key").alias("job"), lit(None).cast("long").alias("download")
    done = rows.where("key % 4 <> 0").groupBy(job).agg(F.max("ts").alias("ts")).select("job", lit("done").alias("kind"), none, "ts")
    some = rows.where("id % 3 = 0")
    begins = some.select(job, lit("begin").alias("kind"), col("id").alias("download"), F.expr("ts + INTERVAL 5 MINUTE").alias("ts"))
    ends = some.where("id % 2 = 0").select(job, lit("finish").alias("kind"), col("id").alias("download"), F.expr("ts + INTERVAL 30 MINUTE").alias("ts"))
    return timers.expiries(done.unionByName(begins).unionByName(ends)).select("job", F.unix_millis("expiry").alias("ms"))


@query(_RQ + "SELECT key, arg_max(action, (ts, id)) AS status, count(*) AS steps, max(ts) AS at FROM requests GROUP BY key".replace(" AS at ", ' AS "at" '))
def k6_job_progress(spark, sf_dir):
    return K.job_progress(derived(spark, sf_dir, "requests"))


@query(_RQ + "SELECT key, string_agg(DISTINCT action, ',' ORDER BY action) AS sources FROM requests GROUP BY key")
def e14_sources_used(spark, sf_dir):
    return derived(spark, sf_dir, "requests").groupBy("key").agg(F.concat_ws(",", F.array_sort(F.collect_set("action"))).alias("sources"))


#: Providers as jobs state them, by supplier and part of a line; some name two sources, some none.
_PROVIDERS = (
    "openstreetmap (Overpass)", "Lantmäteriet STAC Höjd", "Sentinel-2 cloudless by EOX", "OpenTopography COP30", "AWS terrain tiles", "ALOS AW3D30",
    "Kartverket N50", "maa-amet", "NLS Finland 2 m", "Dataforsyningen", "GUGiK NMT", "none", "Marktäcke and Hydrografi", None, "",
)
_PROVIDER = pick("(l_suppkey + l_linenumber)", *_PROVIDERS)
_LINES = ", ".join(f"({i}, '{source}', '{n}')" for i, (source, _, needles) in enumerate(attribution.LICENCES) for n in (needles or ("",)))


@query(f"SELECT DISTINCT CAST(l_orderkey AS BIGINT) AS job, CAST(place AS INTEGER) AS place, source FROM (SELECT l_orderkey, {_PROVIDER} AS provider FROM lineitem) JOIN (VALUES {_LINES}) v(place, source, needle) ON needle = '' OR contains(lower(provider), lower(needle))")
def e14_attribution(spark, sf_dir):
    """Licence lines of every order's providers."""
    used = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("CAST(l_orderkey AS BIGINT) AS job", f"{_PROVIDER} AS provider")
    return attribution.attribution(used).select("job", "place", "source")


@query("SELECT id, kind FROM (SELECT c_custkey AS id, 'national' AS kind FROM customer UNION ALL SELECT s_suppkey, 'cover' FROM supplier UNION ALL SELECT n_nationkey, 'cover' FROM nation)")
def i1_concat_features(spark, sf_dir):
    return _concat_features(spark, sf_dir)


def _concat_features(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    a = t("customer").selectExpr("CAST(c_custkey AS BIGINT) AS id", "'national' AS kind", "c_name AS name")
    b = t("supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS id", "'cover' AS kind")
    c = t("nation").selectExpr("CAST(n_nationkey AS BIGINT) AS id", "'cover' AS kind")
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True).select("id", "kind")


@query()
def d9_dissolve(spark, sf_dir):
    boxes = derived(spark, sf_dir, "boxes").select("id", "name", (col("w") * col("h")).alias("area"), col("x").alias("xmin"), col("y").alias("ymin"), (col("x") + col("w") * 4).alias("xmax"), (col("y") + col("h") * 4).alias("ymax"))
    others = boxes.select(col("id").alias("code"), "xmin", "ymin", "xmax", "ymax")
    touches = spatial.box_overlaps(boxes.select("id", "xmin", "ymin", "xmax", "ymax"), others, 0.02).where("id > code").select(col("id").alias("a"), col("code").alias("b"))
    return N.dissolve(boxes.select("id", "name", "area"), touches)
