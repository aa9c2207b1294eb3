"""Geometry columns: an expression computes each value once."""

from pyspark.sql import functions as F

from geoloom.functions import geometry as G


def test_area_with_holes_computes_each_ring_once(spark):
    """Rings beside holes: the whole expression names the rings a few times, not once for each use of a value."""
    ring = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    rows = spark.createDataFrame([(1, [ring(0.0, 0.0, 4.0), ring(1.0, 1.0, 1.0)]), (2, None), (3, [ring(0.0, 0.0, 1.0)])], "id int, rings array<array<struct<x:double,y:double>>>")
    center = G.polygon_centroid(F.col("rings"))
    assert str(center).count("rings") < 20 and str(G.polygon_area_km2(F.col("rings"))).count("rings") < 20
    got = {r.id: (r.x, r.y) for r in rows.select("id", center["x"].alias("x"), center["y"].alias("y")).collect()}
    assert abs(got[1][0] - (32 - 1.5) / 15) < 1e-12 and got[1][0] == got[1][1] and abs(got[3][0] - 0.5) < 1e-12
    assert rows.select(G.polygon_area_km2(F.col("rings"))).collect()[1][0] == 0.0
