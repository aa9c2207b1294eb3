"""Readers and writers: element JSON, GeoJSON, road tables, ASCII grids and feature dumps. All go through Spark's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .jsonsplit import json_objects

POINT = "struct<lon:double,lat:double>"
ELEMENT = f"struct<id:bigint,type:string,tags:map<string,string>,geometry:array<{POINT}>,members:array<struct<role:string,geometry:array<{POINT}>>>>"


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Element JSON ({"elements": [...]}) as typed rows, read in splits; missing tags are an empty map."""
    rows = json_objects(spark, path, "elements").select(F.from_json("value", ELEMENT).alias("e")).select("e.*")
    return rows.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """Country features of a FeatureCollection, read in splits: upper-case code and geometry as JSON; codes missing or -99 are dropped."""
    feature = "struct<properties:struct<ISO_A2:string,ISO_A2_EH:string,NAME:string>,geometry:struct<type:string,coordinates:string>>"
    rows = json_objects(spark, path, "features").select(F.from_json("value", feature).alias("f"))

    def given(name: str):
        return F.nullif(F.nullif(F.trim(F.col(f"f.properties.{name}")), F.lit("-99")), F.lit(""))

    code = F.upper(F.coalesce(given("ISO_A2_EH"), given("ISO_A2")))
    return rows.select(code.alias("code"), F.col("f.properties.NAME").alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates")).where(
        "code IS NOT NULL"
    )


def geojson_lines(roads: DataFrame, local: bool = False) -> DataFrame:
    """One GeoJSON feature per road (points: array<struct<x,y,z>>); the local form rounds to millimetres and names its system."""
    digits = 3 if local else 8
    pairs = F.transform("points", lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits), F.round(p["z"], digits)))
    props = F.struct("osm_id", "name", "highway", "surface", "width_m", "is_bridge", "is_tunnel", "prefab", *([F.lit("local_metres").alias("coordinate_system")] if local else []))
    geometry = F.struct(F.lit("LineString").alias("type"), pairs.alias("coordinates"))
    return roads.select(F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), geometry.alias("geometry"))).alias("value"))


def road_points(roads: DataFrame) -> DataFrame:
    """One row per control point, rounded for a table: x, z to millimetres, elevation to centimetres."""
    rows = roads.select("osm_id", "prefab", "name", "surface", "width_m", F.posexplode("points").alias("point_index", "p"))
    return rows.select(
        F.col("osm_id").alias("road_id"), "prefab", "name", "surface", "width_m", "point_index",
        F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("z"), F.round("p.z", 2).alias("elevation"),
    )


def road_reference(roads: DataFrame) -> DataFrame:
    """One row per road with a running number; quotes and commas leave the name.

    Numbers are partition counts plus places, so no task sees all roads: ranges of ids
    are counted, and each row adds its place to the counts before its range.
    """
    ranged = roads.withColumn("_range", F.floor(F.col("osm_id") / 1_000_000))
    counts = ranged.groupBy("_range").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("osm_id"))
    clean = F.translate(F.translate(F.coalesce("name", F.lit("")), '"', "'"), ",", " ")
    return ranged.withColumn("_place", place).join(before.select("_range", "_before"), "_range").select(
        (F.col("_before") + F.col("_place")).alias("road_index"), "osm_id", clean.alias("name"), "prefab", "surface", "width_m"
    )


def asc_lines(codes: DataFrame, width: int, height: int, cell_m: float, scale: float, offset: float, west: float = 0.0, south: float = 0.0) -> DataFrame:
    """An ESRI ASCII grid as lines (n, value): six header lines, then rows from the north, three decimals."""
    spark = codes.sparkSession
    head = [f"ncols {width}", f"nrows {height}", f"xllcorner {west}", f"yllcorner {south}", f"cellsize {cell_m}", "NODATA_value -9999"]
    header = spark.createDataFrame([(k - 6, v) for k, v in enumerate(head)], "n long, value string")
    value = F.format_string("%.3f", F.col("code") * scale + offset)
    cells = F.array_sort(F.collect_list(F.struct("c", value.alias("v"))))
    body = codes.groupBy("r").agg(cells.alias("cells")).select(F.col("r").cast("long").alias("n"), F.concat_ws(" ", F.transform("cells", lambda x: x["v"])).alias("value"))
    return header.unionByName(body)


def write_asc(lines: DataFrame, path: str) -> None:
    """The lines in order, as text: ranges of rows in sorted files."""
    lines.repartitionByRange("n").sortWithinPartitions("n").select("value").write.text(path)


def read_asc(spark: SparkSession, path: str) -> DataFrame:
    """An ASCII grid file as cells (r, c, z); its header says how many columns there are.

    Lines are read in splits and numbered by the splits' places and counts, so no task holds the grid.
    """
    lines = spark.read.text(path).select("value", F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id")).where("trim(value) <> ''")
    counts = lines.groupBy("block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    zero = counts.select("block", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first")).alias("zero"))
    place = Window.partitionBy("block").orderBy("id")
    counted = lines.withColumn("k", F.row_number().over(place) - 1).join(zero.join(counts.select("block", "first"), "block"), "block")
    rows = counted.select("value", (F.col("zero") + F.col("first") + F.col("k")).alias("n"))
    width = int(rows.where("n = 0").first()["value"].split()[-1])
    cells = rows.where("n >= 6").select((F.col("n") - 6).cast("long").alias("r"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "v"))
    return cells.where(F.col("c") < width).select("r", F.col("c").cast("long").alias("c"), F.col("v").cast("double").alias("z"))


def write_features(features: DataFrame, path: str) -> None:
    """Features by category, as Parquet: a reader of one category prunes the others."""
    features.write.partitionBy("category").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
