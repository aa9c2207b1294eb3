"""Statistics of surface masks (r, c, surface, weight 0..255) and of elevation grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def coverage(masks: DataFrame, cells: int) -> DataFrame:
    """Per surface: percent of cells over 128 and over 0, and the mean weight (one decimal)."""
    share = lambda c: F.round(F.count_if(c) * 100.0 / cells, 1)
    return masks.groupBy("surface").agg(
        share(F.col("weight") > 128).alias("dominant"), share(F.col("weight") > 0).alias("present"), F.round(F.sum("weight") / cells, 1).alias("mean")
    )


def default_surface(stats: DataFrame) -> DataFrame:
    """The most dominant surface, unless rock covers over 40 % or else grass over 50 %."""
    best = stats.agg(
        F.max_by("surface", F.struct("dominant", "surface")).alias("best"),
        F.max(F.when(F.col("surface") == "rock", F.col("dominant"))).alias("rock"),
        F.max(F.when(F.col("surface") == "grass", F.col("dominant"))).alias("grass"),
    )
    return best.select(F.when(F.col("rock") > 40, "rock").when(F.col("grass") > 50, "grass").otherwise(F.col("best")).alias("surface"))


def block_surfaces(masks: DataFrame, block: int = 32) -> DataFrame:
    """Largest weight of each surface in each block."""
    by, bx = F.floor(F.col("r") / block).cast("long"), F.floor(F.col("c") / block).cast("long")
    return masks.groupBy(by.alias("by"), bx.alias("bx"), "surface").agg(F.max("weight").alias("most"))


def block_saturation(masks: DataFrame, block: int = 32, limit: int = 5, threshold: int = 10) -> DataFrame:
    """Blocks with more surfaces over the threshold than an engine allows, and their names."""
    seen = block_surfaces(masks, block).where(F.col("most") > threshold)
    counts = seen.groupBy("by", "bx").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("surface")).alias("names"))
    return counts.where(F.col("n") > limit)


def relax_blocks(masks: DataFrame, default: str, block: int = 32, limit: int = 5, threshold: int = 10) -> DataFrame:
    """Weakest surfaces of crowded blocks set to zero (never the default, five at most)."""
    seen = block_surfaces(masks, block).where(F.col("most") > threshold)
    crowd = F.count("*").over(Window.partitionBy("by", "bx"))
    weak = Window.partitionBy("by", "bx").orderBy(F.col("surface") == default, "most", "surface")
    drop = (
        seen.withColumn("n", crowd)
        .withColumn("k", F.row_number().over(weak))
        .where((F.col("k") <= F.least(F.col("n") - limit, F.lit(5))) & (F.col("surface") != default))
        .select("by", "bx", "surface", F.lit(True).alias("_gone"))
    )
    placed = masks.withColumn("by", F.floor(F.col("r") / block).cast("long")).withColumn("bx", F.floor(F.col("c") / block).cast("long"))
    return placed.join(drop, ["by", "bx", "surface"], "left").select(
        "surface", "r", "c", F.when(F.col("_gone"), 0).otherwise(F.col("weight")).alias("weight")
    )


def meaningful(masks: DataFrame, cells: int) -> DataFrame:
    """Surfaces with a tenth of a percent of their cells at 64 or more; grass always."""
    counts = masks.groupBy("surface").agg(F.count_if(F.col("weight") >= 64).alias("n"))
    return counts.where((F.col("n") * 1000 >= cells) | (F.col("surface") == "grass"))


def dem_quality(cells: DataFrame) -> DataFrame:
    """One row: range, share near zero, and the verdict."""
    near = F.abs("z") < 0.5
    stats = cells.agg(
        F.min("z").alias("low"),
        F.max("z").alias("high"),
        F.avg(near.cast("double")).alias("flat"),
        F.avg((~near).cast("double")).alias("land"),
        F.stddev_pop(F.when(~near, F.col("z"))).alias("spread"),
    )
    bad = (F.col("high") - F.col("low") > 5000) | ((F.col("flat") > 0.5) & ~((F.col("land") >= 0.1) & (F.coalesce("spread", F.lit(0.0)) > 0.5)))
    return stats.select("low", "high", F.round("flat", 4).alias("flat"), (~bad).alias("usable"))


def land_datum(cells: DataFrame, water: DataFrame) -> DataFrame:
    """Lowest land; the lowest cell where all is water."""
    dry = cells.join(water.select("r", "c", F.lit(True).alias("_wet")), ["r", "c"], "left")
    return dry.agg(F.coalesce(F.min(F.when(F.col("_wet").isNull(), F.col("z"))), F.min("z")).alias("datum"))


def import_order(stats: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Surfaces that are present, with their place in a fixed order."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("surface"))
    return stats.where("present > 0").select("surface", place.cast("int").alias("place")).where("place > 0")
