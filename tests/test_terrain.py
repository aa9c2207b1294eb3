"""The chains of a terrain project on small hand-made tables, and every query that has no SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__
from geoloom.operators import terrain as T

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Queries without SQL whose operators no other test holds against plain loops.
NO_SQL = ["a9_run_summary", "c12_projected", "c13_projected_envelope", "e16_cleanup_stats", "g15_carve_all", "g15_carve_features", "g16_flatten_roads", "g20_preview", "m5_skip_reasons"]


@pytest.fixture(scope="module")
def terrain(spark):
    cells = spark.createDataFrame([(r, c, float(100 - r + c)) for r in range(11) for c in range(11)], "r long, c long, z double")
    return T.Terrain((10.0, 60.0, 10.01, 60.01), 1000.0, 1000.0, cells, 11, 11)


def points(spark, lines):
    """Lines given in metres, as degrees."""
    rows = [(i, k, 10.0 + x / 100_000, 60.0 + y / 100_000) for i, pts in lines.items() for k, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "line_id long, seq long, x double, y double")


def test_local_heights(spark, terrain):
    got = terrain.local(spark.createDataFrame([(1, 10.0, 60.0), (2, 10.01, 60.01), (3, 10.005, 60.0025)], "id long, x double, y double")).orderBy("id").collect()
    assert [(round(r.x, 6), round(r.y, 6), r.z) for r in got] == [(0, 0, 90.0), (1000, 1000, 110.0), (500, 250, 97.0)]


def test_roads(spark, terrain):
    zigzag = [(10 * k, 500 + 40 * (k % 2)) for k in range(1, 60)]
    lines = {1: [(-50, 5), (5, 5), (500, 5), (995, 5)], 2: zigzag, 3: [(2000, 2000), (3000, 3000)]}
    roads = spark.createDataFrame([(1, "Main", "asphalt", "A"), (2, "", "gravel", "B"), (3, "", "dirt", "C")], "id long, name string, surface string, prefab string")
    rows = {(r.line_id, r.chunk): r for r in T.road_splines(points(spark, lines), roads, terrain, 25).collect()}
    assert {k[0] for k in rows} == {1, 2}
    main = rows[(1, 0)]
    assert main.entity == "Road_Main_Asphalt" and main.prefab == "A" and main.ground == "asphalt" and main.vertices[0].x == pytest.approx(5) and main.vertices[0].z == 90.0
    parts = [rows[k] for k in sorted(rows) if k[0] == 2]
    assert [r.entity for r in parts] == [f"Road_Gravel_NW_001_part{k + 1}" for k in range(3)] and all(len(r.vertices) <= 25 for r in parts)
    assert parts[0].vertices[-1].seq == parts[1].vertices[0].seq and {r.ground for r in parts} == {"gravel"}


def test_rivers(spark, terrain):
    lines = {1: [(100, 100), (200, 100), (205, 100), (200, 100), (300, 400)], 2: [(105, 905), (205, 905)], 3: [(1, 1), (900, 2)], 4: [(5, 5), (9, 9)]}
    rivers = spark.createDataFrame([(1, "Å", "river", "LineString"), (2, "", "stream", "LineString"), (3, "", "lake", "LineString"), (4, "", "river", "Polygon")], "id long, name string, water_type string, geometry string")
    rows = {r.line_id: r for r in T.river_lines(points(spark, lines), rivers, terrain).collect()}
    assert set(rows) == {1, 2} and rows[1].entity == "River_A" and rows[2].entity.startswith("River_Stream_NW_001") and rows[1].width > rows[2].width
    assert [v.z for v in rows[2].vertices] == [100.0, 101.0]
    many = {9: [(4 * x, 500 + 300 * math.sin(x)) for x in range(1, 240)]}
    long = T.river_lines(points(spark, many), spark.createDataFrame([(9, "", "river", "LineString")], rivers.schema), terrain).first()
    assert len(long.vertices) <= 121


def squares(spark, table):
    rows = []
    for i, (x, y, s) in table.items():
        ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
        rows += [(i, float(a), float(b), float(c), float(d)) for (a, b), (c, d) in zip(ring[:-1], ring[1:], strict=True)]
    return spark.createDataFrame(rows, "pid long, ax double, ay double, bx double, by double")


def test_classes_are_dissolved_at_once(spark, terrain):
    table = {i: (20.0 * i, 300.0, 90.0) for i in range(1, 11)}
    kinds = [("needleleaved", "wood"), ("broadleaved", "wood"), ("mixed", "wood"), ("", "scrub"), ("", "heath")]
    rows = [(i, "", *kinds[i % 5], "SE") for i in table]
    forests = spark.createDataFrame(rows, "id long, name string, leaf_type string, area_type string, country string")
    started = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = started()
    got = T.forest_outlines(forests, squares(spark, table), terrain).collect()
    assert started() - before < 450  # some 280; for each class again before, over 1 000
    assert len({r.category for r in got}) == 5 and {r.group for r in got} == set(range(1, 11))  # those of one class lie apart
    for r in got:
        x, y, s = table[r.group]
        assert [(round(v.x, 6), round(v.y, 6)) for v in r.vertices] == [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_forest_and_lake_outlines(spark, terrain):
    table = {1: (100, 100, 50), 2: (150, 100, 50), 3: (100, 100, 50), 4: (980, 980, 50), 5: (700, 100, 5), 6: (160, 110, 20)}
    forests = spark.createDataFrame(
        [(1, "", "needleleaved"), (2, "Skog", "needleleaved"), (3, "", "broadleaved"), (4, "", "mixed"), (5, "", "mixed"), (6, "Inne", "needleleaved")], "id long, name string, leaf_type string"
    ).selectExpr("*", "'wood' AS area_type", "'SE' AS country")
    rows = {r.entity: r for r in T.forest_outlines(forests, squares(spark, table), terrain).collect()}
    assert set(rows) == {"Forest_Pine_SW_001", "Forest_Deciduous_SW_001", "Forest_Mixed_NE_001"}  # one sliver, one inside another
    corners = {(round(v.x), round(v.y)) for v in rows["Forest_Pine_SW_001"].vertices}
    assert corners == {(100, 100), (200, 100), (200, 150), (100, 150)}
    assert max(v.x for v in rows["Forest_Mixed_NE_001"].vertices) == 1001
    pond = T.lake_outlines(spark.createDataFrame([(2, "", "pond")], "id long, name string, water_type string"), squares(spark, table), terrain).collect()
    assert [r.entity for r in pond] == ["Lake_Pond_SW_001"]
    waters = spark.createDataFrame([(1, "Sjö", "lake"), (2, "", "pond"), (4, "", "river"), (3, "", "lake"), (5, "", "lake"), (6, "", "wetland")], "id long, name string, water_type string")
    lakes = T.lake_outlines(waters, squares(spark, table), terrain).collect()
    assert [r.entity for r in lakes] == ["Lake_Sjo"]
    assert {(round(v.x, 3), round(v.y, 3)) for v in lakes[0].vertices} == {(95, 95), (205, 95), (205, 155), (95, 155)}


def test_buildings(spark, terrain):
    rows = [(1, 500, 500, "house", 0.04), (2, 500, 500, "church", 0.2), (3, 2000, 0, "house", 0.0), (4, 10, 10, "zzz", 0.0), (5, 600, 600, "house", 0.0)]
    df = spark.createDataFrame([(i, "", 10.0 + x / 100_000, 60.0 + y / 100_000, t, 0.0, a) for i, x, y, t, a in rows], "id long, name string, x double, y double, building_type string, height_m double, angle double")
    placed = T.building_placements(df, spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), terrain)
    got = {r.id: r for r in placed.collect()}
    assert {i: r.reason for i, r in got.items()} == {1: "placed", 2: "placed", 3: "outside", 4: "placed", 5: "near road"}
    assert got[1].yaw == 0.0 and got[2].yaw == 0.2 and got[1].z == 100.0 and got[1].entity == "Building_House_NE_001" and got[5].entity is None and got[4].asset == "Building_Generic"
    assert {r.reason: r.n for r in T.skip_reasons(placed).collect()} == {"placed": 3, "outside": 1, "near road": 1}


def test_ten_surfaces(spark):
    n = 24
    cells = spark.createDataFrame([(r, c, 0.0 if c < 20 else 900.0) for r in range(n) for c in range(n)], "r long, c long, z double")
    masks = [("water", 10, 5), ("asphalt", 2, 2), ("gravel", 2, 8), ("forest_floor", 20, 3), ("pine_floor", 20, 3), ("forest_floor", 20, 6), ("forest_floor", 1, 22)]
    got = {(r.r, r.c): r for r in T.surface_weights(cells, spark.createDataFrame(masks, "surface string, r long, c long"), 5.0, 400.0, n, n).collect()}
    assert len(got) == n * n
    for r in got.values():
        total = sum(r[s] for s in ("rock", "forest_floor", "pine_floor", "asphalt", "gravel", "crop", "dirt", "sand", "water_edge", "grass"))
        assert total == pytest.approx(0.0 if r.water else 1.0)
    assert got[(2, 2)].asphalt == pytest.approx(0.5) and got[(2, 8)].gravel == pytest.approx(0.4)
    assert got[(20, 3)].pine_floor == pytest.approx(0.25) and got[(20, 3)].forest_floor == 0.0 and got[(20, 6)].forest_floor == pytest.approx(0.25) and got[(1, 22)].forest_floor == 0.0
    assert got[(10, 6)].sand > 0 and got[(10, 8)].water_edge > 0 and got[(10, 6)].water_edge == 0.0 and got[(10, 15)].sand == 0.0 and got[(3, 22)].rock > 0.5 > got[(3, 5)].rock


def test_ten_surfaces_by_tiles(spark):
    """Tiles give what the whole-grid operators give, across tile borders, holes in the grid and masks outside it; cells are not multiplied by surfaces."""
    import math
    import random

    from pyspark.sql import functions as F

    from geoloom.operators import raster as R

    rnd, n, m = random.Random(5), 150, 100
    grid = [(r, c, rnd.uniform(0, 30) if rnd.random() < 0.9 else None) for r in range(n) for c in range(m) if rnd.random() < 0.95]
    cells = spark.createDataFrame(grid, "r long, c long, z double")
    rows = [(s, r, c) for k, s in enumerate(("crop", "water")) for r in range(-2, n + 2) for c in range(m) if (r // 20 + c // 20) % 4 == k]
    masks = spark.createDataFrame(rows + rows[:50] + [("water", 70, -1), ("none", 1, 1), ("crop", None, 2)], "surface string, r long, c long")
    df = T.surface_weights(cells, masks, 5.0, 20.0, n, m, tile=32)
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.r, r.c): r for r in df.collect()}
    assert len(got) == len(grid)
    steep = R.slope(cells, 5.0).join(cells, ["r", "c"]).select("r", "c", F.greatest(R.slope_ramp(F.col("slope")), R.above_treeline(F.col("z"), F.lit(20.0))).alias("rock"))
    rock = {(r.r, r.c): r.rock for r in R.gaussian(steep, 5.0, n, m, "rock").collect()}
    real = {k[:2] for k in grid}
    water = {(r, c) for s, r, c in rows if s == "water"} | {(70, -1)}
    near, far = ({(r + d, c + e) for r, c in water for d in range(-k, k + 1) for e in range(abs(d) - k, k - abs(d) + 1)} for k in (2, 4))
    want = {}
    for s, mask, t, factor in (("crop", {(r, c) for s, r, c in rows if s == "crop"}, 8, 0.7), ("sand", near - water, 2, 1.0), ("water_edge", far - near, 2, 0.7)):
        steps = [(y, x) for y in range(-t, t + 1) for x in range(-t, t + 1)]
        back = real - mask
        away = {k: min([math.hypot(y, x) for y, x in steps if (k[0] + y, k[1] + x) in back] or [t]) for k in real & mask}
        want[s] = {k: factor * min(away.get(k, 0.0) / t, 1.0) for k in real}
    for k, r in got.items():
        every = [rock[k], want["crop"][k], want["sand"][k], want["water_edge"][k]]
        assert r.water == (k in water)
        if not r.water:
            assert [r.rock, r.crop, r.sand, r.water_edge] == pytest.approx([v / max(1.0, sum(every)) for v in every])


@pytest.mark.parametrize("name", NO_SQL)
def test_queries_without_sql_run_whole(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_region_labels_across_tiles(spark):
    """Labels by tiles are those of a flood fill, for winding regions, negative places and copies of cells."""
    import random

    from geoloom.operators import raster as R

    rnd = random.Random(3)
    cells = {(r, c) for r in range(-9, 30) for c in range(-5, 40) if rnd.random() < 0.6} | {(r, 50) for r in range(60)}
    want = {}
    for start in sorted(cells):
        todo = [start] if start not in want else []
        while todo:
            r, c = todo.pop()
            if (r, c) in cells and (r, c) not in want:
                want[r, c] = start[0] * (1 << 31) + start[1]
                todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    rows = spark.createDataFrame([*cells, (50, 50)], "r long, c long")
    got = R.label_regions(rows, 8).collect()
    assert len(got) == len(cells) + 1 and {(x.r, x.c): x.region for x in got} == want
    assert R.label_regions(rows.limit(0)).count() == 0


def test_regions_link_by_tiles(spark, monkeypatch):
    """A long region's graph has a node for each tile, not one for each row."""
    from geoloom.operators import raster as R

    sizes = []
    monkeypatch.setattr(R, "components", lambda links, real=R.components: sizes.append(links.count()) or real(links))
    column = spark.range(2000).selectExpr("id AS r", "7L AS c")
    assert R.label_regions(column).select("region").distinct().count() == 1 and sizes == [7]


def test_smoothing_sends_cells_once_a_pass(spark):
    """What a cell sends along its line is summed where the line is: no shuffle of the sent values."""
    from geoloom.operators import raster as R

    cells = spark.range(400).selectExpr("id div 20 AS r", "id % 20 AS c", "id % 7 + 0D AS z")
    plan = R.gaussian(cells, 1.0, 20, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Exchange") == 2
