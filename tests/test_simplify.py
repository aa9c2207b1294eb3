"""Lines simplified whole in a task against the rounds over all tasks."""

import random

import pytest

from geoloom.operators import lines as N


def some_lines(spark, closed=False):
    rng, rows = random.Random(5), []
    for line in range(14):
        n = (1, 2, 3, 4, 5, 9, 12)[line % 7]
        for i in range(n):
            x, y = (rng.choice([0.0, 5.0, 40.0]), rng.choice([0.0, 3.0, 7.5])) if line % 3 else (i * 4.0, rng.uniform(-9, 9))
            rows.append((line if line else None, i * 2, None if line % 11 == 5 and i == 2 else x, y, None if line % 7 == 1 and i % 3 == 1 else rng.uniform(0, 3)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "line_id long, seq int, x double, y double, z double")


FORMS = {
    "degrees": lambda p: N.simplify(p, 800_000.0), "heights": lambda p: N.simplify(p, 800_000.0, 0.7), "schedule": lambda p: N.simplify_schedule(p, 5),
    "rings": lambda p: N.simplify_schedule(p, 6, closed=True), "roads": lambda p: N.simplify_roads(p, 6),
}


@pytest.mark.parametrize("form", FORMS)
def test_tasks_equal_rounds(spark, monkeypatch, form):
    points = some_lines(spark)
    if form in ("schedule", "rings", "roads"):
        points = points.where("line_id IS NOT NULL")  # the rounds' joins lose null ids there
    got = sorted(map(str, FORMS[form](points).collect()))
    monkeypatch.setattr(N, "LONG", 3)  # longer lines go by rounds
    assert got and got == sorted(map(str, FORMS[form](points).collect()))


@pytest.mark.parametrize("long", [20_000, 3])
def test_road_parts_equal_simplified_and_cut_vertices(spark, monkeypatch, long):
    """Parts made in the tasks, and by rounds for long lines, with one shuffle and no window after them."""
    monkeypatch.setattr(N, "LONG", long)
    rng = random.Random(2)
    more = spark.createDataFrame([(50 + k, i, float(i), rng.uniform(-50, 50), 0.0) for k, n in enumerate((7, 8, 9, 40)) for i in range(n)], "line_id long, seq int, x double, y double, z double")
    points = some_lines(spark).where("line_id IS NOT NULL").unionByName(more)
    want = {}
    for r in N.chunk_line(N.simplify_roads(points, 12), 4).collect():
        want.setdefault((r.line_id, r.chunk), []).append((r.seq, r.x, r.y, r.z))
    single = {r.line_id for r in points.groupBy("line_id").count().where("count = 1").collect()}
    want = {k: sorted(v) for k, v in want.items() if k[0] not in single}
    fit, rounds = N._road_fit, N._road_rounds
    monkeypatch.setattr(N, "_road_fit", lambda most, *rest: fit(12, *rest))
    monkeypatch.setattr(N, "_road_rounds", lambda rows, most, *rest: rounds(rows, 12, *rest))
    got = N.road_parts(points, 4)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r.line_id, r.chunk): r for r in got.collect()}
    assert {k: [tuple(v) for v in r.vertices] for k, r in rows.items()} == want
    assert all(r.parts == sum(k[0] == r.line_id for k in want) for r in rows.values()) and max(r.parts for r in rows.values()) == 4


def test_few_jobs_however_deep(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(k, i, float(i), rng.uniform(-50, 50)) for k in range(3) for i in range(400)], "line_id long, seq int, x double, y double")
    spark.sparkContext.setJobGroup("deep", "")
    kept = N.simplify_schedule(points, 20).count()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("deep"))
    spark.sparkContext.setJobGroup("", "")
    assert kept == 3 * 21 and jobs < 12
