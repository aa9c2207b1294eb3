"""Names against a plain allocator that gives them out one by one."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators import naming


def allotted(rows):
    """id to entity: a taken name gets the smallest free suffix."""
    seen, out = set(), {}
    for i, base in sorted(rows):
        name, n = base, 2
        while name in seen:
            name, n = f"{base}_{n:03d}", n + 1
        seen.add(name)
        out[i] = name
    return out


def found(spark, rows):
    return {r.id: r.entity for r in naming.unique_names(spark.createDataFrame(rows, "id long, base string")).collect()}


def test_names_that_look_like_suffixes(spark):
    for rows in (
        [(1, "A"), (2, "A"), (3, "A_002"), (4, "A_002")],
        [(1, "A_002"), (2, "A"), (3, "A"), (4, "A"), (5, "A_002_002"), (6, "A_002")],
        [(1, "A"), (2, "B"), (3, "A"), (4, "A"), (5, "A_003"), (6, "A_003_002"), (7, "A_003")],
    ):
        assert found(spark, rows) == allotted(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_input_gets_the_allocators_names(spark, seed):
    rng = random.Random(seed)
    tails = ["", "", "", "_002", "_003", "_004", "_002_002", "_003_002", "_1000", "_0002", "_001", "_02"]
    rows = [(i, rng.choice("AB") + rng.choice(tails)) for i in rng.sample(range(1000), 120)]
    got = found(spark, rows)
    assert got == allotted(rows) and len(set(got.values())) == len(rows)


def test_more_than_999_of_one_name(spark):
    rows = [(i, "N") for i in range(1100)] + [(500_000, "N_1101"), (-1, "N_1005")]
    assert found(spark, rows) == allotted(rows)


def test_refs_and_display_names(spark):
    rows = [
        (1, "Road", "asphalt", "Storgatan", "E 4"), (2, "Road", None, "Storgatan", None), (3, "Forest", "coniferous", "Skog", None), (4, "Lake", "pond", None, None),
        (5, "Building", "yes", None, None), (6, "Building", "APARTMENTS", "St. Mary", None), (7, "River", "stream", "", None), (8, "River", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id long, kind string, value string, name string, ref string")
    category = F.coalesce(*[F.when(F.col("kind") == k, naming.shown(k, F.col("value"))) for k in ("Road", "Forest", "Lake", "Building", "River")])
    got = naming.name_features(df.withColumn("category", category).withColumn("x", F.lit(0.9)).withColumn("z", F.lit(0.1)), 1.0, 1.0).collect()
    assert {r.id: r.entity for r in got} == {
        1: "Road_E4_Asphalt", 2: "Road_Storgatan_Asphalt", 3: "Forest_Pine_SE_001", 4: "Lake_Pond_SE_001", 5: "Building_Generic_SE_001",
        6: "Building_Apartments_St_Mary", 7: "River_Stream_SE_001", 8: "River_SE_001",
    }
