"""Points near lines: rounds of segments against every pair."""

import math
import random

from geoloom.operators import spatial


def test_points_near_lines_equal_every_pair(spark, monkeypatch):
    rnd = random.Random(11)
    points = [(i, rnd.uniform(-300, 900), rnd.uniform(-300, 900)) for i in range(400)] + [(400, None, 1.0)]
    lines = [(*(rnd.uniform(-200, 700) for _ in range(4)), rnd.choice([0.5, 6.0, 40.0])) for _ in range(60)]
    lines += [(10.0, 5.0, 400.0, 5.0, 3.0), (20.0, -100.0, 20.0, 500.0, 3.0), (600.0, 600.0, 600.0, 600.0, 30.0), (None, 1.0, 2.0, 3.0, 9.0)]

    def near(x, y, ax, ay, bx, by, reach):
        dx, dy = bx - ax, by - ay
        size = dx * dx + dy * dy
        t = 0.0 if size == 0 else min(1.0, max(0.0, ((x - ax) * dx + (y - ay) * dy) / size))
        return math.hypot(x - ax - t * dx, y - ay - t * dy) <= reach

    want = {i for i, x, y in points if x is None or not any(near(x, y, *line) for line in lines if line[0] is not None)}
    df, segments = spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(lines, "ax double, ay double, bx double, by double, w double")
    assert 50 < len(want) < 350
    for first, few in ((4000, 500_000), (5, 0)):
        monkeypatch.setattr(spatial, "FIRST", first)
        monkeypatch.setattr(spatial, "FEW_CELLS", few)
        got = spatial.drop_near_lines(df, segments, "w", 100.0)
        assert got.columns == df.columns and {r.id for r in got.collect()} == want


def test_lines_beside_a_crowd_meet_few_points(spark, monkeypatch):
    """Thousands of equal strokes over a crowd of points: the first ones drop it, so the others meet no cell."""
    df = spark.range(2000).selectExpr("id", "id % 50 + 0D AS x", "10D AS y")
    segments = spark.range(20000).selectExpr("0D AS ax", "10D AS ay", "50D AS bx", "id * 1e-9D + 10D AS by", "2D AS w")
    left = []
    monkeypatch.setattr(spatial, "FIRST", 100)
    monkeypatch.setattr(spatial, "stage", lambda d, name, real=spatial.stage: (lambda out: left.append(out[0].count()) or out)(real(d, name)) if name == "left" else real(d, name))
    assert spatial.drop_near_lines(df, segments, "w", 100.0).count() == 0
    assert left[0] == 2000 and left[1] == 0
