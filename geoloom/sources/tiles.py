"""Tile catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import tile_id


def tile_catalog(boxes: DataFrame) -> DataFrame:
    """One row for each one-degree tile of each box (west, south, east, north): at least one per axis."""

    def whole(low: str, high: str):
        first = F.floor(low).cast("long")
        return F.explode(F.sequence(first, F.greatest(F.ceil(high).cast("long") - 1, first)))

    rows = boxes.withColumn("tile_lat", whole("south", "north")).withColumn("tile_lon", whole("west", "east"))
    return rows.withColumn("tile", tile_id(F.col("tile_lat"), F.col("tile_lon")))
