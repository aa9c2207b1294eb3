"""Containment joins and attribution lines against every pair."""

import random

from geoloom.operators import attribution as A


def test_containment_equals_every_pair(spark):
    random.seed(4)
    word = lambda n: "".join(random.choice("abAB é") for _ in range(n))
    texts = [word(random.randrange(0, 14)) for _ in range(120)] + ["", "a", "ab", None, "NLS Finland", "NLS Finland"]
    needles = [word(random.randrange(1, 6)) for _ in range(40)] + ["ab", "aba", "abab", "É", "", None, "nls"]
    pairs = {(t, n) for t in texts for n in needles if t is not None and n and n.lower() in t.lower()}
    got = A.contained(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), spark.createDataFrame([(n,) for n in needles], "needle string")).collect()
    assert len(got) == len(pairs) and {tuple(r) for r in got} == pairs


def test_lines_of_jobs(spark):
    used = [(1, "stac höjd (lantmäteriet)"), (1, "Lantmäteriet Hydrografi"), (2, "OpenTopography COP30"), (3, None), (4, "unknown"), (4, "unknown"), (5, "AWS openstreetmap mirror"), (None, "ALOS")]
    rows = spark.createDataFrame(used, "job long, provider string").selectExpr("*", "'x' AS source", "0 AS place")
    got = {}
    for r in A.attribution(rows).collect():
        got.setdefault(r.job, []).append(r.source)
    want = {
        1: ["Lantmäteriet"], 2: ["Copernicus DEM GLO-30", "OpenTopography"], 3: [], 4: [], 5: ["Copernicus DEM GLO-30", "OpenStreetMap"], None: ["ALOS World 3D 30 m"],
    }
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted([*v, "Natural Earth"]) for k, v in want.items()}
    assert A.attribution(rows.limit(0)).isEmpty()


def test_a_job_gathers_bits_not_providers(spark):
    """One aggregation by job of fixed width; tables of more lines than a number has bits too."""
    licences = tuple((f"s{i}", f"l{i}", (f"<{i}>",) if i % 50 else ()) for i in range(130))
    used = spark.createDataFrame([(1, "<3> <61> <62>"), (1, "<129><3>"), (2, None), (3, "<63>")], "job long, provider string")
    out = A.attribution(used, licences)
    assert sorted((r.job, r.place) for r in out.collect()) == sorted([(j, k) for j in (1, 2, 3) for k in (0, 50, 100)] + [(1, k) for k in (3, 61, 62, 129)] + [(3, 63)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(job" in plan and not [x for x in plan.splitlines() if "hashpartitioning(job" in x and "," in x.split("hashpartitioning(")[1].split(", 4)")[0]]
