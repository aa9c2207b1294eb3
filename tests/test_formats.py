import json

from geoloom.operators import raster
from geoloom.sources import formats
from geoloom.sources.tiles import tile_catalog


def test_elements_and_countries(spark, tmp_path):
    element = {"id": 1, "type": "way", "tags": {"highway": "path"}, "geometry": [{"lon": 1.0, "lat": 2.0}]}
    (tmp_path / "e.json").write_text(json.dumps({"elements": [element, {"id": 2, "type": "node"}]}, indent=1))
    rows = {r.id: r for r in formats.read_elements(spark, str(tmp_path / "e.json")).collect()}
    assert rows[1].tags == {"highway": "path"} and rows[1].geometry[0].lat == 2.0 and rows[2].tags == {}
    features = [{"properties": p, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}} for p in ({"ISO_A2_EH": "-99", "ISO_A2": "no"}, {"ISO_A2_EH": "se"}, {"ISO_A2": "-99"}, {})]
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    assert sorted(r.code for r in formats.read_countries(spark, str(tmp_path / "c.json")).collect()) == ["NO", "SE"]


def test_road_tables(spark):
    roads = spark.createDataFrame(
        [(7, 'A "B", c', "path", "dirt", 1.5, False, False, "P", [(1.23456, 2.0, 3.456)]), (2_000_007, None, "path", "dirt", 1.5, False, False, "P", [(0.0, 0.0, 0.0)])],
        "osm_id long, name string, highway string, surface string, width_m double, is_bridge boolean, is_tunnel boolean, prefab string, points array<struct<x:double,y:double,z:double>>",
    )
    feature = json.loads(formats.geojson_lines(roads.where("osm_id = 7"), local=True).first()[0])
    assert feature["geometry"]["coordinates"] == [[1.235, 2.0, 3.456]] and feature["properties"]["coordinate_system"] == "local_metres"
    assert [tuple(r) for r in formats.road_points(roads).where("road_id = 7").collect()] == [(7, "P", 'A "B", c', "dirt", 1.5, 0, 1.235, 2.0, 3.46)]
    assert [(r.road_index, r.name) for r in formats.road_reference(roads).orderBy("road_index").collect()] == [(1, "A 'B'  c"), (2, "")]


def test_ascii_grid_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, 10 * r + c) for r in range(3) for c in range(4)], "r long, c long, code int")
    lines = formats.asc_lines(cells, 4, 3, 2.0, 0.5, -1.0)
    text = "\n".join(r.value for r in lines.orderBy("n").collect()) + "\n"
    assert text.splitlines()[:2] == ["ncols 4", "nrows 3"]
    (tmp_path / "g.asc").write_text(text)
    back = {(r.r, r.c): r.z for r in formats.read_asc(spark, str(tmp_path / "g.asc")).collect()}
    assert back == {(r, c): (10 * r + c) * 0.5 - 1 for r in range(3) for c in range(4)}
    formats.write_asc(lines, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 9


def test_features_by_category(spark, tmp_path):
    formats.write_features(spark.createDataFrame([(1, "roads"), (2, "water")], "id long, category string"), str(tmp_path / "f"))
    assert formats.read_features(spark, str(tmp_path / "f")).where("category = 'water'").count() == 1


def test_tiles(spark):
    boxes = spark.createDataFrame([(1, 16.2, 59.1, 16.4, 59.2), (2, -0.5, -0.5, 0.5, 0.5), (3, 16.0, 59.0, 17.0, 60.0)], "id int, west double, south double, east double, north double")
    tiles = {}
    for r in tile_catalog(boxes).collect():
        tiles.setdefault(r.id, set()).add(r.tile)
    assert tiles[1] == tiles[3] == {"N59_00_E016_00"} and tiles[2] == {"S01_00_W001_00", "S01_00_E000_00", "N00_00_W001_00", "N00_00_E000_00"}


def _grid(spark, rows):
    return spark.createDataFrame([(r, c, float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "r long, c long, z double")


def test_distance_regions_and_fill(spark):
    from pyspark.sql import functions as F

    rows = ["11101", "11101", "00001", "11011"]
    grid = _grid(spark, rows).select("r", "c", (F.col("z") == 1).alias("mask"))
    zeros = [(r, c) for r, line in enumerate(rows) for c, v in enumerate(line) if v == "0"]
    for r in raster.distance_transform(grid).collect():
        assert abs(r.distance - min(((r.r - a) ** 2 + (r.c - b) ** 2) ** 0.5 for a, b in zeros)) < 1e-9
    regions = {}
    for r in raster.label_regions(grid.where("mask").select("r", "c")).collect():
        regions.setdefault(r.region, set()).add((r.r, r.c))
    assert sorted(map(len, regions.values())) == [2, 5, 6]
    flood = raster.flood_from(spark.createDataFrame([(3, 0)], "r long, c long"), grid.where("mask").select("r", "c"))
    assert sorted((r.r, r.c) for r in flood.collect()) == [(3, 0), (3, 1)]
    holes = _grid(spark, ["12", "30"]).withColumn("z", F.when(F.col("z") > 0, F.col("z")))
    assert {(r.r, r.c): r.z for r in raster.fill_nodata(holes).collect()}[(1, 1)] == 2.0


def test_carve_lowers_water(spark):
    grid = _grid(spark, ["999999", "955559", "955559", "955559", "999999"])
    bed = raster.carve_water(grid, grid.where("z = 5").select("r", "c"), 2.0, 15.0, 0.5, 5, 6)
    values = {(r.r, r.c): r.z for r in bed.collect()}
    assert values[(0, 0)] == 9 and values[(2, 2)] < values[(1, 1)] < 5


def plain_carve(z, mask, cell_m, ceiling, steep, ring):
    """Beds and shores by plain loops: z and mask are lists of rows."""
    import math

    import numpy as np

    z, mask = np.array(z, float), np.array(mask, bool)
    h, w = z.shape
    label, n = np.zeros((h, w), int), 0
    for r in range(h):
        for c in range(w):
            if mask[r, c] and not label[r, c]:
                n += 1
                todo = [(r, c)]
                label[r, c] = n
                while todo:
                    y, x = todo.pop()
                    for a, b in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= a < h and 0 <= b < w and mask[a, b] and not label[a, b]:
                            label[a, b] = n
                            todo.append((a, b))
    land = [(a, b) for a in range(h) for b in range(w) if not mask[a, b]]
    out, surface = z.copy(), z.copy()
    for k in range(1, n + 1):
        own = [(a, b) for a in range(h) for b in range(w) if label[a, b] == k]
        level = float(np.percentile([z[p] for p in own], 10))
        d = {p: min(math.dist(p, q) for q in land) for p in own}
        depth = min(ceiling, max(d.values()) * cell_m * steep)
        for p in own:
            surface[p], out[p] = level, level - depth * d[p] / max(d.values())

    def blur(x):
        radius = int(4 * ring + 0.5)
        g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / ring) ** 2)
        g /= g.sum()
        for axis in (0, 1):
            padded = np.pad(x, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            x = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), axis, padded)
        return x

    blend, smooth = np.clip(blur(mask.astype(float)), 0, 1), blur(surface)
    for a, b in land:
        if min(abs(a - y) + abs(b - x) for y, x in zip(*np.nonzero(mask), strict=True)) <= ring:
            out[a, b] = z[a, b] * (1 - blend[a, b]) + smooth[a, b] * blend[a, b]
    return out


def test_carving_with_a_shore_equals_plain_loops(spark):
    import random

    random.seed(3)
    h, w = 14, 15
    z = [[random.uniform(0, 30) for _ in range(w)] for _ in range(h)]
    mask = [[(3 <= r <= 7 and 2 <= c <= 8) or (10 <= r <= 11 and 11 <= c <= 13) for c in range(w)] for r in range(h)]
    cells = spark.createDataFrame([(r, c, z[r][c]) for r in range(h) for c in range(w)], "r long, c long, z double").repartition(3)
    wet = spark.createDataFrame([(r, c) for r in range(h) for c in range(w) if mask[r][c]], "r long, c long")
    want = plain_carve(z, mask, 2.0, 3.0, 0.5, 1)
    got = raster.carve_water(cells, wet, 2.0, 3.0, 0.5, h, w, ring=1).collect()
    assert len(got) == h * w and all(abs(r.z - want[r.r][r.c]) < 1e-9 for r in got)
    plain = raster.carve_water(cells, wet, 2.0, 3.0, 0.5, h, w).collect()
    assert all(abs(r.z - (want[r.r][r.c] if mask[r.r][r.c] else z[r.r][r.c])) < 1e-9 for r in plain)
    regions = raster.label_regions(wet)
    deep = raster.carve_water(cells, wet, 2.0, 3.0, 0.5, h, w, ceilings=regions.select("region").distinct().selectExpr("region", "0.5D AS ceiling"))
    levels = {r.region: r.level for r in raster.region_levels(regions.join(cells, ["r", "c"])).collect()}
    lowest = {r.region: r.z for r in deep.join(regions, ["r", "c"]).groupBy("region").agg({"z": "min"}).withColumnRenamed("min(z)", "z").collect()}
    assert all(abs(levels[k] - 0.5 - v) < 1e-9 for k, v in lowest.items()) and len(levels) == 2


def test_fill_takes_the_nearest_of_all(spark):
    import random

    random.seed(5)
    grid = {(r, c): random.choice([None, None, None, float(r * 100 + c)]) for r in range(9) for c in range(11)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in grid.items()], "r long, c long, z double").repartition(4)
    for got in raster.fill_nodata(df).collect():
        near = min(((r - got.r) ** 2 + (c - got.c) ** 2, r, c) for (r, c), v in grid.items() if v is not None)
        own = grid[(got.r, got.c)]
        assert got.z == (own if own is not None else grid[near[1:]])
    assert [r.z for r in raster.fill_nodata(df.selectExpr("r", "c", "CAST(NULL AS DOUBLE) AS z")).distinct().select("z").distinct().collect()] == [None]


def test_resampling_by_weights(spark):
    import math

    h, w, nh, nw = 5, 6, 9, 8
    z = {(r, c): math.sin(r) + c * c * 0.3 for r in range(h) for c in range(w)}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r long, c long, z double")

    def keys(d):
        d = abs(d)
        return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0.0

    for cubic, kernel, span in ((True, keys, range(-1, 3)), (False, lambda d: max(0.0, 1 - abs(d)), range(2))):
        for r in raster.resample(df, h, w, nh, nw, cubic=cubic).collect():
            y, x = r.r * (h - 1) / (nh - 1), r.c * (w - 1) / (nw - 1)
            near = [(int(y) + a, int(x) + b) for a in span for b in span]
            want = sum(kernel(y - a) * kernel(x - b) * z[(min(max(a, 0), h - 1), min(max(b, 0), w - 1))] for a, b in near)
            assert abs(r.z - want) < 1e-9
        assert raster.resample(df, h, w, nh, nw, cubic=cubic).count() == nh * nw


def test_numbers_run_over_all_tasks(spark):
    from geoloom.operators.staging import numbered

    df = spark.range(2000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id < 1500 THEN 'hot' ELSE 'cold' END AS k", "id * 7919 % 2003 AS v")
    got = {}
    for r in numbered(df, ["k"], ["v"], "n").collect():
        got.setdefault(r.k, []).append((r.v, r.n))
    assert all([n for _, n in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in got.values()) and len(got) == 3
    assert sum(map(len, got.values())) == 2000


def test_byte_masks_and_scale(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.7,), (-2.0,)], "w double")
    assert [r[0] for r in df.select(raster.mask_bytes(df.w)).collect()] == [0, 127, 255, 255, 0]
    assert tuple(raster.height_range(df, "w").first()) == (-2.0, 3.7 / 65535)
