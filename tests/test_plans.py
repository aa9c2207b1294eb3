"""Every query that SQL can express against DuckDB, on the smallest tables; plans free of nested loops; streams equal to batches."""

import os

import duckdb
import pytest

from geoloom.operators import lines
from geoloom.plans import files, networks, outputs, projects, rasters, rules, shapes
from geoloom.streaming import stateful

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()
CASES = [(plan, name) for plan in (rules, rasters, networks, outputs, shapes, files) for name in plan.SQL]


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(clean(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize(("plan", "name"), CASES, ids=[n for _, n in CASES])
def test_equals_duckdb(spark, oracle, plan, name):
    df = plan.QUERIES[name](spark, SF)
    result = oracle.execute(plan.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(result.fetchall(), columns)


@pytest.mark.parametrize("name", ["d1_points_in_countries", "d2_overlaps", "d5_drop_near_lines", "d6_snap_junctions"])
def test_spatial_joins_are_equi_joins(spark, name):
    plan = networks.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, i % 3, i * 7 % 50) for i in range(60)], "id long, key long, s int").selectExpr("id", "key", "timestamp_seconds(s) AS ts")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = (
        stateful.rate_limit_stream(stream, 4, 10.0)
        .writeStream.format("memory").queryName("limited").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("limited").collect()))
    assert got == sorted(map(tuple, stateful.rate_limit(events, 4, 10.0).collect())) and any(not r[2] for r in got)


def test_rate_limit_counts_accepted_only():
    passed, left, _ = stateful._admit([0, 1, 2, 3, 10.0, 11.5], [], 2, 10.0)
    assert passed == [True, True, False, False, True, True] and left[0] == 1


def test_lines(spark):
    points = [(1, k, 16.0 + k * 0.001, 59.0 + (0.0005 if k == 5 else 0.0)) for k in range(11)]
    points += [(2, 0, 16.0, 59.0), (2, 1, 16.001, 59.0), (2, 2, 16.0009, 59.0), (2, 3, 16.002, 59.0)]
    df = spark.createDataFrame(points, "line_id long, seq long, x double, y double")
    kept = {(r.line_id, r.seq) for r in lines.simplify(df, 5.0).collect()}
    assert kept == {(1, 0), (1, 4), (1, 5), (1, 6), (1, 10), (2, 0), (2, 3)}
    straight = {(r.line_id, r.seq) for r in lines.drop_hairpins(df, 150.0, 100.0).collect()}
    assert (2, 3) in straight and len([k for k in straight if k[0] == 2]) < 4
    dense = lines.densify(df.where("line_id = 1"), 30.0)
    assert dense.count() > 20 and dense.agg({"seq": "max"}).first()[0] == dense.count()
    chunks = lines.chunk_line(df.where("line_id = 1"), 4).groupBy("chunk").count().collect()
    assert sorted((r.chunk, r["count"]) for r in chunks) == [(0, 4), (1, 4), (2, 4), (3, 2)]


def test_stitching_turns_and_forks(spark):
    ways = [(1, 10, 11, "a"), (2, 12, 11, "a"), (3, 12, 13, "b"), (4, 13, 14, "b"), (5, 13, 15, "b"), (6, 20, 20, "a")]
    got = {r.id: r.road for r in lines.stitch_ways(spark.createDataFrame(ways, "id long, a long, b long, highway string"), ("highway",)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_whole_inputs(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(300)) + "\n\tit's \"q\" a--b__c end!"
    texts = [(1, long), (2, " - _ a  b\nc__d! - "), (3, ""), (4, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokens = {r.doc_id: r.token for r in rules.QUERIES["j1_sanitize_token"](spark, str(tmp_path)).collect()}
    assert tokens == {1: "".join(f"Word{i}" for i in range(300)) + "ItsQA_b_cEnd", 2: "ABC_d", 3: "", 4: ""}
    projects = {r.doc_id: r.project for r in rules.QUERIES["j2_sanitize_project"](spark, str(tmp_path)).collect()}
    assert projects == {1: long[:64].strip(), 2: "a b c_d", 3: "Terrain", 4: "Terrain"}


def test_reprojects_every_cell_and_unites_all_customers(spark):
    from pyspark.sql import functions as F

    from geoloom.functions.geometry import project_tm
    from geoloom.plans.derive import derived

    dem = derived(spark, SF, "dem").select("r", "c", (15.001 + F.col("c") * 0.0002).alias("lon"), (58.6401 + F.col("r") * 0.0001).alias("lat"))
    cells = dem.select("r", "c", project_tm(F.col("lon"), F.col("lat"), 15.0).alias("p")).select("r", "c", "p.x", "p.y").collect()
    known = {(r.r, r.c) for r in cells}
    near = lambda r: ((r.y - 6500000) // 20, (r.x - 500000) // 20)
    want = {(r.r, r.c) for r in cells if any((near(r)[0] + a, near(r)[1] + b) in known for a in (0, 1) for b in (0, 1))}
    got = {(r.r, r.c) for r in outputs.QUERIES["g23_reproject"](spark, SF).collect()}
    assert got == want and max(c for _, c in got) >= 60
    ids = {r.id for r in networks.QUERIES["i1_concat_features"](spark, SF).where("kind = 'national'").collect()}
    assert ids == {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}


def plain_limits(calls, most, strict):
    out, logs = {}, {}
    for i, key, t, hard in sorted(calls, key=lambda c: (c[2], c[0])):
        general, tight = logs.setdefault(key, ([], []))
        if sum(x > t - most[1] for x in general) >= most[0]:
            out[i] = (False, "general", 0)
        elif hard and sum(x > t - strict[1] for x in tight) >= strict[0]:
            out[i] = (False, "strict", 0)
        else:
            general.append(t)
            tight += [t] * hard
            out[i] = (True, None, most[0] - sum(x > t - most[1] for x in general))
    return out


def test_two_rate_limits(spark, tmp_path):
    import random

    random.seed(2)
    calls, t = [], 0
    for i in range(400):
        t += random.choice([0, 1, 1, 5, 5, 90])
        calls.append((i, f"k{random.choice([0, 0, 0, 1, 2])}", t, random.random() < 0.5))
    want = plain_limits(calls, (4, 10.0), (2, 40.0))
    df = spark.createDataFrame(calls, "id long, key string, s int, strict boolean").selectExpr("id", "key", "timestamp_seconds(s) AS ts", "strict").repartition(4)
    got = {r.id: (r.accepted, r.reason, r.remaining) for r in stateful.rate_limits(df, (4, 10.0), (2, 40.0)).collect()}
    assert got == want and {w[1] for w in want.values()} == {None, "general", "strict"}
    df.write.parquet(str(tmp_path / "in"))
    stream = stateful.rate_limits_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), (4, 10.0), (2, 40.0))
    query = stream.writeStream.format("memory").queryName("judged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.id: (r.accepted, r.reason, r.remaining) for r in spark.table("judged").collect()} == want


def test_calls_that_count(spark):
    rows = [
        (1, "/api/generate", "POST", "s1", "1.1.1.1", None, None), (2, "/api/generate", "GET", None, " 1.1.1.1 , 2.2.2.2", "3.3.3.3", "4"), (3, "/api/health", "GET", "s", None, None, None),
        (4, "/index", "GET", "s", None, None, None), (5, "/api/job/3/preview/a", "GET", "s", None, None, None), (6, "/api/job/3", "GET", "", "", "3.3.3.3", "4"), (7, "/api/x", "GET", None, None, None, "4"), (8, "/api/x", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, path string, method string, session string, forwarded string, real_ip string, peer string").selectExpr("*", "timestamp_seconds(id) AS ts")
    got = {r.id: (r.key, r.strict) for r in stateful.api_calls(df).collect()}
    assert got == {1: ("session:s1", True), 2: ("ip:1.1.1.1", False), 6: ("ip:3.3.3.3", False), 7: ("ip:4", False), 8: ("ip:unknown", False)}


def plain_dp(points, far):
    if len(points) < 3:
        return list(points)
    d, k = max((round(far(points[0], points[-1], p), 9), -k) for k, p in enumerate(points[1:-1], 1))
    if d <= 1:
        return [points[0], points[-1]]
    return plain_dp(points[: -k + 1], far)[:-1] + plain_dp(points[-k:], far)


def foot(a, b, p):
    import math

    dx, dy = b[1] - a[1], b[2] - a[2]
    size = dx * dx + dy * dy
    t = 0.0 if size == 0 else max(0.0, min(1.0, ((p[1] - a[1]) * dx + (p[2] - a[2]) * dy) / size))
    return math.hypot(p[1] - a[1] - t * dx, p[2] - a[2] - t * dy), t


def test_scheduled_simplification(spark):
    import math
    import random

    random.seed(4)
    table = {i: [(k, random.uniform(0, 60), random.uniform(0, 60), random.uniform(0, 2)) for k in range(random.choice([2, 3, 5, 9, 30]))] for i in range(12)}
    rows = [(i, *p) for i, pts in table.items() for p in pts]
    df = spark.createDataFrame(rows, "line_id long, seq long, x double, y double, z double").repartition(3)

    def scheduled(pts, most, closed):
        if len(pts) < (4 if closed else 3):
            return [p[0] for p in pts]
        diagonal = math.hypot(*(max(p[c] for p in pts) - min(p[c] for p in pts) for c in (1, 2)))
        base = max(1.0, min(5.0, 0.005 * diagonal))
        for tol in (base, *(t for t in (1.0, 2.0, 5.0, 10.0, 20.0) if t > base)):
            ring = [*pts, (10**6, *pts[0][1:])] if closed else pts
            slim = [p[0] for p in plain_dp(ring, lambda a, b, p: foot(a, b, p)[0] / tol) if p[0] < 10**6]  # noqa: B023
            if (3 if closed else 2) <= len(slim) <= most:
                return slim
        step = math.ceil(len(pts) / most)
        return [p[0] for k, p in enumerate(pts) if k % step == 0 and k / step < most or (not closed and k == len(pts) - 1)]

    for most, closed in ((4, False), (5, True)):
        got = {}
        for r in lines.simplify_schedule(df, most, closed).orderBy("line_id", "seq").collect():
            got.setdefault(r.line_id, []).append(r.seq)
        assert got == {i: scheduled(pts, most, closed) for i, pts in table.items()}
    got = {}
    for r in lines.simplify_roads(df, 6, 4.0, 0.5).orderBy("line_id", "seq").collect():
        got.setdefault(r.line_id, []).append(r.seq)
    for i, pts in table.items():
        for scale in (1, 2, 4, 8, 16, 32):
            far = lambda a, b, p: max(foot(a, b, p)[0] / (4.0 * scale), abs(p[3] - a[3] - foot(a, b, p)[1] * (b[3] - a[3])) / (0.5 * scale))  # noqa: B023, E731
            slim = [p[0] for p in plain_dp(pts, far)]
            if len(slim) <= 6:
                break
        assert got[i] == slim


def test_every_event_has_its_level(spark):
    assert rules.j8_log_levels(spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()
