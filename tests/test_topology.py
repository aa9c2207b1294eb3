"""Roads against a plain walk, loose ends against a plain search."""

import math
import random

from geoloom.operators import topology


def node(p):
    return (round(p[0] * 1e7), round(p[1] * 1e7))


def plain_stitch(lines, kinds, most):
    degree, at = {}, {}
    for i, pts in lines.items():
        for p in (pts[0], pts[-1]):
            degree[node(p)] = degree.get(node(p), 0) + 1
            at.setdefault(node(p), []).append(i)
    used, out = set(), {}

    def follow(i, n):
        if degree[n] != 2:
            return None
        for j in at[n]:
            if j != i and j not in used:
                return j if kinds[j] == kinds[i] else None
        return None

    for i in sorted(lines):
        if i in used:
            continue
        used.add(i)
        road, ids = list(lines[i]), [i]
        for forward in (True, False):
            while (j := follow(ids[0], node(road[-1] if forward else road[0]))) is not None:
                used.add(j)
                more = list(lines[j])
                if node(more[0]) != node(road[-1] if forward else road[0]):
                    more.reverse()
                ids.append(j)
                road = road + more[1:] if forward else more[:0:-1] + road
                if len(road) > most:
                    break
        out[i] = (ids, road)
    return out


def table(spark, lines):
    rows = [(i, k, float(x), float(y)) for i, pts in lines.items() for k, (x, y) in enumerate(pts)]
    return spark.createDataFrame(rows, "line_id long, seq long, x double, y double").repartition(3)


def test_stitching_equals_a_plain_walk(spark):
    random.seed(5)
    for most, rounds in ((5000, 2), (6, 2)):
        for _ in range(rounds):
            lines, kinds, number = {}, {}, iter(random.sample(range(500), 200))
            for chain in range(9):
                nodes = [(chain + 0.001 * k, 10 + 0.001 * random.randint(0, 9)) for k in range(random.randint(2, 9))]
                if chain % 3 == 0:
                    nodes.append(nodes[0])  # a ring
                for a, b in zip(nodes[:-1], nodes[1:], strict=True):
                    pts = [a, *[(a[0] + 1e-5 * k, a[1] + 1e-4) for k in range(1, random.randint(1, 3))], b]
                    i = next(number)
                    lines[i] = pts if random.random() < 0.5 else pts[::-1]
                    kinds[i] = random.choice("aaaab")
            a = lines[min(lines)][0]
            lines[900], kinds[900] = [a, (a[0], a[1] + 1)], "a"  # a junction
            lines[901], kinds[901] = [(50.0, 1.0), (50.1, 1.0), (50.0, 1.1), (50.0, 1.0)], "a"  # closed by itself
            lines[902], kinds[902] = [(60.0, 1.0)], "a"  # one point only
            want = plain_stitch({i: p for i, p in lines.items() if len(p) > 1}, kinds, most)
            attributes = spark.createDataFrame([(i, k) for i, k in kinds.items()], "line_id long, kind string")
            vertices, roads = topology.stitch_lines(table(spark, lines), attributes, ("kind",), most)
            got = {}
            for r in sorted(vertices.collect(), key=lambda r: (r.line_id, r.seq)):
                got.setdefault(r.line_id, []).append((r.x, r.y))
            assert {r.line_id: r.ids for r in roads.collect()} == {i: ids for i, (ids, _) in want.items()}
            assert got == {i: road for i, (_, road) in want.items()}
    empty = spark.createDataFrame([], "line_id long, seq long, x double, y double")
    assert topology.stitch_lines(empty, attributes, ("kind",))[0].count() == 0


def metres(p, q):
    dx = math.radians(q[0] - p[0]) * math.cos(math.radians((p[1] + q[1]) / 2))
    return 6371000 * math.hypot(dx, math.radians(q[1] - p[1]))


def test_snapping_equals_a_plain_search(spark):
    random.seed(6)
    for lat, reach in ((0.0, 12.0), (68.0, 12.0), (-45.0, 60.0)):
        lines = {i: [(random.random() * 0.004, lat + random.random() * 0.002) for _ in range(random.choice([2, 2, 3, 6]))] for i in range(40)}
        ranks = {i: random.randint(1, 4) for i in lines}
        got = {(r.line_id, r.seq): (r.x, r.y, r.moved) for r in topology.snap_lines(table(spark, lines), spark.createDataFrame(list(ranks.items()), "line_id long, rank int"), reach).collect()}
        moves = 0
        for i, pts in lines.items():
            new = list(pts)
            for k in (0, len(pts) - 1):
                near = [(metres(pts[k], q), q) for j, other in lines.items() if ranks[j] < ranks[i] for q in other]
                near = [x for x in near if x[0] <= reach]
                if near and min(near)[0] > 0 and metres(new[1] if k == 0 else new[-2], min(near)[1]) >= 1:
                    new[k] = min(near)[1]
                    moves += 1
            assert [got[(i, k)][:2] for k in range(len(pts))] == new
        assert moves == sum(v[2] for v in got.values()) and moves > 3


def test_near_lines_walk_in_tasks(spark, monkeypatch):
    """A chain of near numbers takes no round of the links, and few of the walks, however long it is; batches that part it change nothing."""
    from geoloom.operators import components as K
    from geoloom.operators import topology as T

    ids = [*range(400), *range(1000, 1003)]
    points = spark.createDataFrame([(i, s, 0.001 * (i + s), 0.0) for i in ids for s in (0, 1)], "line_id long, seq long, x double, y double")
    kinds = points.select("line_id").distinct().selectExpr("line_id", "'track' AS highway")
    rounds, written = [], []
    monkeypatch.setattr(K, "_rounds", lambda links, real=K._rounds: rounds.append(links.count()) or real(links))
    monkeypatch.setattr(T, "stage", lambda df, name, real=T.stage: written.append(name) or real(df, name))
    monkeypatch.setattr(T, "MOST_POINTS", 1000)
    for parts in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        _, roads = T.stitch_lines(points, kinds, ("highway",))
        assert {(r.line_id, tuple(r.ids)) for r in roads.collect()} == {(0, tuple(range(400))), (1000, (1000, 1001, 1002))}
        assert (rounds == []) == (parts == "1") and written.count("walks") <= 5
        written.clear()
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_links_settled_in_tasks(spark):
    import random

    from geoloom.operators import components as K

    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(0, 300) if i % 50] + [(rnd.randrange(300), rnd.randrange(300)) for _ in range(5)] + [(1000, x) for x in range(1001, 1100)]
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = K.components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()
    assert len(got) == len(linked) and {r.node: r.component for r in got} == {x: find(x) for x in linked}
