"""Queries of sources and sinks: files written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.staging import shared_folder
from ..sources import formats, jsonsplit


QUERIES, SQL = {}, {}
col, lit = F.col, F.lit


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id AS id, 'way' AS type, md5(coalesce(text, '')) AS text_md5, CAST(1 + CAST(lang IS NOT NULL AS INTEGER) AS BIGINT) AS n_tags, CAST(doc_id % 5 AS BIGINT) AS n_points FROM documents")
def a1_elements(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    point = F.struct((col("doc_id") % 360 - 180).cast("double").alias("lon"), lit(60.5).alias("lat"))
    tags = F.struct(F.coalesce("text", lit("")).alias("text"), "lang")
    element = F.struct(col("doc_id").alias("id"), lit("way").alias("type"), tags.alias("tags"), F.array_repeat(point, (col("doc_id") % 5).cast("int")).alias("geometry"))
    path = shared_folder(spark, "elements")
    jsonsplit.json_documents(docs.select(F.to_json(element).alias("value")), "elements", path)
    rows = formats.read_elements(spark, path)
    return rows.select("id", "type", F.md5(F.col("tags")["text"].cast("binary")).alias("text_md5"), F.size("tags").cast("long").alias("n_tags"), F.size("geometry").cast("long").alias("n_points"))


@query("SELECT upper(substr(n_name, 1, 2)) AS code, n_name AS name, 'Polygon' AS kind FROM nation WHERE n_nationkey % 4 <> 3")
def a2_countries(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = col("n_nationkey") % 4
    code = F.lower(F.substring("n_name", 1, 2))
    first = F.when(k == 0, code).when(k == 1, "-99").when(k == 3, " -99 ")
    other = F.when(k != 3, F.concat(lit(" "), code)).otherwise("")
    feature = F.struct(
        lit("Feature").alias("type"), F.struct(first.alias("ISO_A2_EH"), other.alias("ISO_A2"), col("n_name").alias("NAME"), lit("a, \"b\" [{,").alias("NOTE")).alias("properties"),
        F.struct(lit("Polygon").alias("type"), F.array(F.array(F.array(lit(1.5), lit(2.5)))).alias("coordinates")).alias("geometry"),
    )
    path = shared_folder(spark, "countries")
    jsonsplit.json_documents(nation.select(F.to_json(feature).alias("value")), "features", path)
    return formats.read_countries(spark, path).select("code", "name", "kind")


def _roads(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.when(col("o_orderkey") % 3 == 0, F.concat(lit('Old "A", '), "o_orderstatus")).when(col("o_orderkey") % 3 == 1, col("o_orderstatus"))
    return orders.select(col("o_orderkey").cast("long").alias("osm_id"), name.alias("name"), lit("P").alias("prefab"), "o_orderpriority", lit(4.5).alias("width_m")).withColumnRenamed("o_orderpriority", "surface")


@query(
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS road_index, CAST(o_orderkey AS BIGINT) AS osm_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'Old ''A''  ' || o_orderstatus WHEN 1 THEN o_orderstatus ELSE '' END AS name, o_orderpriority AS surface FROM orders"""
)
def a5_road_reference(spark, sf_dir):
    return formats.road_reference(_roads(spark, sf_dir)).select("road_index", "osm_id", "name", "surface")


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'roads' WHEN 1 THEN 'water' ELSE 'forests' END AS category, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1")
def a7_feature_dump(spark, sf_dir):
    k = col("c_custkey") % 3
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(col("c_custkey").cast("long").alias("id"), F.when(k == 0, "roads").when(k == 1, "water").otherwise("forests").alias("category"))
    path = shared_folder(spark, "features")
    formats.write_features(rows, path)
    back = formats.read_features(spark, path).where(col("category").isin("roads", "water"))
    return back.groupBy("category").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
