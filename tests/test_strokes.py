"""Strokes, the sea, carving by features and nearest fills against plain loops."""

import math
import random
import time

import numpy as np
import pytest

from geoloom.operators import composites as M
from geoloom.operators import raster as R

SEGMENT = "ax double, ay double, bx double, by double"


def away(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = 0.0 if size == 0 else max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / size))
    return math.sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)


def burned(rows, height=None, width=None):
    out = set()
    for ax, ay, bx, by, half in rows:
        for r in range(math.floor(min(ay, by)) - half - 2, math.ceil(max(ay, by)) + half + 3):
            for c in range(math.floor(min(ax, bx)) - half - 2, math.ceil(max(ax, bx)) + half + 3):
                if away(c, r, ax, ay, bx, by) <= half + 0.5 and (height is None or (0 <= r < height and 0 <= c < width)):
                    out.add((r, c))
    return out


def flooded(low, seeds):
    seen, todo = set(), [s for s in seeds if s in low]
    while todo:
        r, c = todo.pop()
        if (r, c) in low and (r, c) not in seen:
            seen.add((r, c))
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return seen


def sea(z, coast, h, w, near=50):
    low = {k for k, v in z.items() if v is not None and v <= 0.5}
    border = {(r, c) for r, c in low if r in (0, h - 1) or c in (0, w - 1)}
    close = {(r, c) for r, c in border if any(abs(r - a) + abs(c - b) <= near for a, b in coast)}
    return flooded(low, (close or border) if coast else ())


def cells_of(spark, z):
    return spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "r long, c long, z double").repartition(3)


def points(df):
    return {(r.r, r.c) for r in df.select("r", "c").collect()}


def test_strokes_equal_the_bounding_box(spark):
    random.seed(1)
    rows = [tuple(random.choice([random.randrange(-5, 25), random.uniform(-5, 25)]) * 1.0 for _ in range(4)) + (random.randrange(5),) for _ in range(60)]
    rows += [(3.0, 3.0, 3.0, 3.0, 2), (1.0, 4.0, 9.0, 4.0, 1), (4.0, 1.0, 4.0, 9.0, 0), (0.0, 0.0, 20.0, 1e-9, 3), (0.0, 0.0, 1e-12, 20.0, 3)]
    df = spark.createDataFrame(rows, SEGMENT + ", half int")
    assert points(M.rasterize_lines(df, df["half"])) == burned(rows)
    assert points(M.rasterize_lines(df, df["half"], 15, 12)) == burned(rows, 15, 12)
    for one in rows:
        assert points(M.rasterize_lines(spark.createDataFrame([one[:4]], SEGMENT), one[4])) == burned([one]) if one in rows[-5:] else True
    nothing = spark.createDataFrame([(None, 1.0, 2.0, 3.0, 1), (1.0, 1.0, 2.0, 3.0, None)], SEGMENT + ", half int")
    assert M.rasterize_lines(nothing, nothing["half"]).isEmpty() and M.rasterize_lines(df.limit(0), 2).isEmpty()


def test_a_long_diagonal_costs_its_stroke(spark):
    line = spark.createDataFrame([(0.0, 0.0, 7071.0, 7071.0)], SEGMENT)
    n = M.rasterize_lines(line, 1).count()
    assert 20_000 < n < 50_000


@pytest.mark.parametrize(("seed", "near"), [(1, 6), (2, 50)])
def test_sea_equals_a_plain_flood(spark, seed, near):
    random.seed(seed)
    h, w = 17, 23
    z = {(r, c): random.choice([None, 0.5, 0.4, -3.0, 0.2, 0.1, 2.0, 0.6]) for r in range(h) for c in range(w)}
    coast = {(random.randrange(h), random.randrange(w)) for _ in range(3)}
    df = spark.createDataFrame(sorted(coast), "r long, c long")
    assert points(R.sea_cells(cells_of(spark, z), df, h, w, near=near)) == sea(z, coast, h, w, near)


def test_no_coast_no_sea(spark):
    z = {(r, c): 0.0 for r in range(3) for c in range(3)}
    assert R.sea_cells(cells_of(spark, z), spark.createDataFrame([], "r long, c long"), 3, 3).isEmpty()


def test_no_low_border_no_sea_and_all_borders_where_none_is_near(spark):
    z = {(r, c): 0.0 if 2 <= r <= 4 else 9.0 for r in range(7) for c in range(9)}
    coast = spark.createDataFrame([(0, 4)], "r long, c long")
    assert points(R.sea_cells(cells_of(spark, z), coast, 7, 9, near=1)) == {k for k, v in z.items() if v == 0.0}
    inner = {k: 9.0 if k[1] in (0, 8) else v for k, v in z.items()}
    assert R.sea_cells(cells_of(spark, inner), coast, 7, 9).isEmpty()


def test_water_by_features(spark):
    h, w = 30, 40
    random.seed(9)
    z = {(r, c): 0.0 if c > 33 else 10.0 + random.random() for r in range(h) for c in range(w)}
    boxes = {1: (2, 2, 8, 7, "water", None), 2: (12, 3, 18, 9, None, "basin"), 3: (22, 20, 27, 26, None, "wetland"), 4: (1, 20, 4, 25, "wood", "marsh"), 5: (3, 3, 5, 5, "water", "wetland")}
    rings = [(i, *map(float, e)) for i, (y0, x0, y1, x1, *_) in boxes.items() for e in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))]
    areas = spark.createDataFrame([(i, b[4], b[5]) for i, b in boxes.items()], "id long, natural string, water_type string")
    edges = spark.createDataFrame(rings, "id long, " + SEGMENT)
    lines = [("river", 0.0, 20.0, 30.0, 12.0), ("ditch", 20.0, 0.0, 25.0, 29.0), ("coastline", 33.0, 0.0, 33.0, 29.0), ("unknown", 0.0, 0.0, 30.0, 30.0), (None, 0.0, 0.0, 30.0, 30.0)]
    table = spark.createDataFrame(lines, "water_type string, " + SEGMENT)
    got = {}
    for row in M.water_masks(cells_of(spark, z), areas, edges, table, 2.0, h, w).collect():
        got.setdefault(row.kind, set()).add((row.r, row.c))
    box = lambda i: {(r, c) for r in range(boxes[i][0], boxes[i][2]) for c in range(boxes[i][1], boxes[i][3])}
    assert got["lake"] == box(1) | box(2) | box(5) and got["wetland"] == box(3) | box(5)
    assert got["river"] == burned([(*lines[0][1:], 4), (*lines[1][1:], 1)], h, w)  # 15 m and 1.5 m at 2 m a cell; 3.75 is 4
    assert got["sea"] == {k for k in z if k[1] > 33}


def test_carving_by_features(spark):
    h, w = 16, 20
    z = {(r, c): 10.0 + (r * 7 + c * 3) % 5 / 10 for r in range(h) for c in range(w)}
    ring = [(3.0, 3.0), (9.0, 3.0), (9.0, 9.0), (3.0, 9.0), (3.0, 3.0)]
    edges = spark.createDataFrame([(1, *a, *b) for a, b in zip(ring[:-1], ring[1:], strict=True)], "id long, " + SEGMENT)
    areas = spark.createDataFrame([(1, None, "pond")], "id long, natural string, water_type string")
    carved = {(r.r, r.c): r.z for r in M.carve_features(cells_of(spark, z), areas, edges, spark.createDataFrame([], "water_type string, " + SEGMENT), 2.0, h, w).collect()}
    lake = {(r, c) for r in range(3, 9) for c in range(3, 9)}
    assert set(carved) == set(z) and all(carved[k] < 10.0 for k in lake) and carved[5, 5] < carved[3, 3]
    far = {k for k in z if all(abs(k[0] - r) + abs(k[1] - c) > 3 for r, c in lake)}
    assert far and all(carved[k] == z[k] for k in far)


@pytest.mark.parametrize("seed", range(3))
def test_fills_with_many_ties(spark, seed):
    random.seed(seed)
    z = {(r, c): float(r * 100 + c) if random.random() < (0.5, 0.15, 0.05)[seed] else random.choice([None, float("nan")]) for r in range(13) for c in range(15) if random.random() < 0.9}
    good = [k for k, v in z.items() if v is not None and v == v]
    for row in R.fill_nodata(cells_of(spark, z)).collect():
        near = min(good, key=lambda k: ((k[0] - row.r) ** 2 + (k[1] - row.c) ** 2, k))
        assert row.z == z[near]


def test_a_wide_row_is_filled_in_linear_time():
    rng = np.random.default_rng(3)
    c, row = np.arange(4096.0), rng.integers(0, 60, 4096).astype(float)
    gap = np.abs(30 - row)
    began = time.time()
    owner = R.nearest_sources(c, gap, row)
    assert time.time() - began < 1
    far = gap[None, :] ** 2 + (c[None, :] - c[:, None]) ** 2
    tied = far == far.min(axis=1)[:, None]
    order = np.where(tied, row[None, :] * 10_000 + c[None, :], np.inf)
    assert (owner == order.argmin(axis=1)).all()
    assert (R.nearest_sources(c, np.full(4096, np.nan), row) == -1).all()


def test_long_columns_take_linear_time(spark):
    """A column of 60 000 cells: a frame that is run anew for each row would take minutes."""
    n = 60_000
    cells = spark.range(n).selectExpr("id AS r", "0L AS c", "CASE WHEN id IN (0, 59999) THEN CAST(id AS DOUBLE) END AS z")
    start = time.monotonic()
    far = R.distance_transform(cells.selectExpr("r", "c", "z IS NULL AS mask")).agg({"distance": "max"}).first()[0]
    filled = {tuple(r) for r in R.fill_nodata(cells).groupBy("z").count().collect()}
    assert far == (n - 1) // 2 and filled == {(0.0, n // 2), (59999.0, n // 2)}
    assert time.monotonic() - start < 30
