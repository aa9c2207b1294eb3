"""Components and joins on hot keys against plain loops."""

import os
import random

import pytest

from geoloom.operators import raster, staging
from geoloom.operators.components import components


def plain(links):
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a != b and a is not None and b is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((i, root(i)) for i in parent)


@pytest.mark.parametrize("kind", ["random", "path", "hub", "odd"])
def test_components_equal_a_plain_union(spark, kind):
    random.seed(3)
    links = {
        "random": [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)],
        "path": [(i, i + 1) for i in random.sample(range(120), 120)],
        "hub": [(7, i) for i in range(700)] + [(699, 900), (900, 901)],
        "odd": [(5, 5), (None, 4), (3, None), (1, 2), (2, 1), (-4, 1)],
    }[kind]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = sorted(tuple(r) for r in components(df).collect())
    assert got == plain(links)
    assert components(df.where("false")).count() == 0


def test_hot_keys_are_dealt_and_nothing_is_lost(spark):
    rows = [("hot", i) for i in range(900)] + [(f"k{i % 50}", i) for i in range(200)] + [(None, 1), ("gone", 2)]
    left = spark.createDataFrame(rows, "k string, v long")
    right = spark.createDataFrame([("hot", 900, "H")] + [(f"k{i}", 4, f"v{i}") for i in range(50)], "k string, _n long, w string")
    got = sorted(tuple(r) for r in staging.spread_join(left, right, ["k"], len(rows)).collect())
    names = {"hot": "H"} | {f"k{i}": f"v{i}" for i in range(50)}
    assert got == sorted((k, v, names[k]) for k, v in rows if k in names)


def test_stages_are_read_and_dropped(spark):
    table, path = staging.stage(spark.range(5), "t")
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4] and os.path.isdir(path)
    staging.drop_stages(spark, path)
    assert not os.path.exists(path)


def test_rows_are_dealt_by_key_and_share(spark):
    left = spark.range(1000).selectExpr("id % 7 AS k", "id AS v")
    right = left.groupBy("k").count().withColumnRenamed("count", "_n").selectExpr("k", "k * 2 AS w", "_n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = staging.spread_join(left, right, ["k"], 1000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    shuffles = [line for line in plan.splitlines() if "hashpartitioning(" in line]
    assert sum("_deal" in line for line in shuffles) == 2


def test_growing_tables_are_not_broadcast(spark):
    cells = spark.range(100).selectExpr("id div 10 AS r", "id % 10 AS c", "CAST(id AS double) AS z")
    points = spark.range(50).selectExpr("id", "(id % 9) / 9.0 AS u", "(id % 7) / 7.0 AS v")
    for df in (raster.sample_raster(points, cells, 10, 10), staging.numbered(points, ["v"], ["id"], "n")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_resampling_sends_each_cell_once_a_pass(spark):
    cells = spark.range(100).selectExpr("id div 10 AS r", "id % 10 AS c", "CAST(id AS double) AS z").repartition(3)
    got = raster.resample(cells, 10, 10, 20, 20, cubic=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
    assert got.count() == 400 and all(abs(r.z - (10 * r.r + r.c) * 9 / 19) < 1e-9 for r in got.where("r BETWEEN 3 AND 16 AND c BETWEEN 3 AND 16").collect())
