"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import drop_stages, spread_join, stage

#: Links that a task settles among themselves at a time.
BATCH = 200_000


def _settled(edges: DataFrame) -> bool:
    """True if the links are stars: no node hangs on two others or on one that hangs itself."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of some links, in order, and for each the smallest one that these links reach."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    p, q, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        x, y = label[p], label[q]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def batches(frames):
    """Frames joined to BATCH rows or somewhat more; the last may be shorter."""
    held, n = [], 0
    for pdf in chain(frames, [None]):
        if pdf is not None:
            held.append(pdf)
            n += len(pdf)
        if n and (pdf is None or n >= BATCH):
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0


def _stars(links: DataFrame) -> DataFrame:
    """Links in the order of their smaller ends, settled BATCH by BATCH: node, head (the smallest node its batch reaches, heads too).

    Nodes that several batches hold come once for each.
    """

    def work(frames):
        for pdf in batches(frames):
            nodes, heads = least_reached(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
            yield pd.DataFrame({"node": nodes, "head": heads})

    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return links.repartitionByRange(tasks, "b", "a").sortWithinPartitions("b", "a").mapInPandas(work, "node long, head long")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long) to one row per linked node: node, component (the smallest node reachable).

    Tasks settle neighbouring links among themselves; only heads that share a node go
    through the rounds, so links between near numbers leave a small graph. A hub's links
    are dealt over tasks. Links with a null end count for nothing.
    """
    spark = links.sparkSession
    down = links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    stars, path = stage(_stars(down), "stars")
    met = stars.groupBy("node").agg(F.min("head").alias("low"), F.max("head").alias("high"), F.count("*").alias("_n"))
    shared, shared_path = stage(met.where("low < high").select("node", "low", "_n"), "shared")
    if shared.isEmpty():
        drop_stages(spark, shared_path)
        return stars.select("node", F.col("head").alias("component")).distinct()
    n = stars.count()
    between, link_path = stage(spread_join(stars, shared, ["node"], n).where("head <> low").select(F.col("head").alias("a"), F.col("low").alias("b")).distinct(), "heads")
    found = _rounds(between)
    by_head = stars.groupBy("head").agg(F.count("*").alias("_n")).join(found.select(F.col("node").alias("head"), "component"), "head", "left")
    by_head, head_path = stage(by_head.select("head", F.coalesce("component", "head").alias("component"), "_n"), "settled")
    out, _ = stage(spread_join(stars, by_head, ["head"], n).select("node", "component").distinct(), "components")
    drop_stages(spark, path, shared_path, link_path, head_path)
    return out


def _rounds(links: DataFrame) -> DataFrame:
    """``components`` by rounds over all tasks.

    Each round groups the links by one end and hangs the neighbours on the smallest; a
    logarithmic number of rounds settles it, which is tested exactly. A hub's links are
    dealt over tasks. The driver sees a count and a truth value; rounds before the last
    are removed. Links with a null end count for nothing.
    """
    spark = links.sparkSession
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, path = stage(down.distinct(), "links")
    while not _settled(edges):
        n = edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).select("a", F.least("a", "m").alias("m"), "_n")
        large = spread_join(both.where("b > a"), least, ["a"], n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
        hung = spread_join(large, lower, ["a"], n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new = stage(hung.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop_stages(spark, path)
        edges, path = after, new
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads).distinct()
