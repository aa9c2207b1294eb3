"""Tables between steps, in the folder that all executors share; joins on keys that may hold most rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key with this share of all rows is hot (so there are HOT_SHARE hot keys at most); fewer than HOT_LEAST rows never are.
HOT_SHARE = 1000
HOT_LEAST = 100


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place on one machine; a cluster's
    executors would not see it, so there the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="geoloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back; the table and its folder.

    The lineage ends there: a lost executor costs no earlier step.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``stage`` for a table that stays."""
    return stage(df, name)[0]


def drop_stages(spark: SparkSession, *paths: str) -> None:
    """Remove staged folders that nothing reads any more, through the store's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins between tables that both grow: never broadcast.

    Spark takes a file's compressed size for a table's, so a few MB of numbers may be a hundred
    times that in the driver, which holds what it broadcasts.
    """
    return df.hint("merge")


def spread_join(rows: DataFrame, by_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``by_key`` (a row for each key; ``_n``: how many of the ``total`` rows it holds).

    Hot keys, HOT_SHARE at most, are broadcast, and their rows are dealt by a hash of
    the whole row; the rest meets in an equi-join. So no task gets all rows of a key.
    Rows whose key is null or missing in ``by_key`` go.
    """
    values = [c for c in by_key.columns if c not in (*keys, "_n")]
    of = F.struct(*values)
    hot = by_key.where(F.col("_n") >= max(HOT_LEAST, total // HOT_SHARE)).select(*keys, of.alias("_hot"))
    # 0, but no literal: the optimizer would fold it away and deal the rows by the key alone
    cold = by_key.select(*keys, F.least("_n", F.lit(0).cast("long")).alias("_deal"), of.alias("_cold"))
    deal = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)))
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", deal)
    met = marked.join(cold, [*keys, "_deal"], "left").withColumn("_met", F.coalesce("_hot", "_cold")).where("_met is not null")
    return met.select(*rows.columns, *[F.col("_met").getField(c).alias(c) for c in values])


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, start: int = 1) -> DataFrame:
    """``rows`` with ``name``: the running number within each key, in ``order``.

    Rows are sorted by range over all tasks and written with their places; places are
    counted by key and task, so no task sees all rows of a key, as a window would.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(tasks, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = written(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)), "numbered")
    ahead = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    zero = F.col("_first") - F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - start
    counts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_task").alias("_at"), zero.alias("_zero"))
    same = F.col("_task") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return shuffled(placed).join(counts, same).select(*rows.columns, (F.col("_id") - F.col("_zero")).alias(name))
