"""Unique names of features: a running number for anonymous ones, a suffix for names that are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lookups import looked_up
from ..functions.strings import quadrant, sanitize_token
from .staging import numbered, shuffled, written

# How classes are shown in names.
FORESTS = {"coniferous": "Pine", "deciduous": "Deciduous", "mixed": "Mixed", "scrub": "Scrub", "heath": "Heath"}
LAKES = {"lake": "Lake", "pond": "Pond", "reservoir": "Reservoir", "water": "Water"}
BUILDINGS = {"yes": "Generic"}


def shown(kind: str, value: Column) -> Column:
    """A class as names show it: forests and lakes by their tables (else Mixed, Lake), the rest capitalised, with a default for none."""
    low = F.lower(F.coalesce(value, F.lit("")))
    if kind == "Forest":
        return F.coalesce(looked_up(low, FORESTS), F.lit("Mixed"))
    if kind == "Lake":
        return F.coalesce(looked_up(low, LAKES), F.lit("Lake"))
    default = {"Road": "asphalt", "River": "river", "Building": "yes"}[kind]
    low = F.when(low == "", default).otherwise(low)
    plain = F.concat(F.upper(F.left(low, F.lit(1))), F.substr(low, F.lit(2)))
    return F.coalesce(looked_up(low, BUILDINGS), plain) if kind == "Building" else plain


def _suffixed(base: Column, n: Column) -> Column:
    return F.concat(base, F.lit("_"), F.format_string("%03d", n))


def _taken_numbers(placed: DataFrame, bases: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Where suffixes meet bases that look like them: bases whose plain name is taken, and numbers that are left out.

    ``placed``: id, base, k (occurrence); ``bases``: base, first (smallest id), n. The base
    ``X_002`` is a child of ``X`` if both occur. A number that is a child's base is left
    out if the child came first; else the child finds its name taken, and all its
    occurrences get suffixes. Which occurrence of ``X`` reaches a number depends on the numbers
    left out before it, so these are settled by rounds to a fixed point, parents before children.
    Returns None where no base is a child.
    """
    number = F.regexp_extract("base", "_([0-9]{3}|[1-9][0-9]{3,17})$", 1)
    own = bases.select("base", "first", number.alias("digits")).where("digits <> ''")
    own = own.select(F.regexp_replace("base", "_[0-9]+$", "").alias("parent"), F.col("base").alias("child"), "first", F.col("digits").cast("long").alias("num"))
    edges = written(own.where("num >= 2").join(shuffled(bases.select(F.col("base").alias("parent"))), "parent"), "names")
    if edges.isEmpty():
        return None
    taken, left_out = bases.limit(0).select("base"), bases.limit(0).select("base", F.col("n").alias("at"))
    now = edges.join(shuffled(edges.select(F.col("child").alias("parent"))), "parent", "left_anti")
    while not now.isEmpty():
        shift = F.when(F.col("_taken"), 1).otherwise(0)
        by_parent = taken.select(F.col("base").alias("parent"), F.lit(True).alias("_taken"))
        now = written(now.join(shuffled(by_parent), "parent", "left").select("parent", "child", "first", "num", shift.alias("shift"), F.lit(0).cast("long").alias("before")), "names")
        at = placed.select(F.col("base").alias("parent"), F.col("k").alias("_k"), F.col("id").alias("_id"))
        while True:
            reached = now.withColumn("_k", F.col("num") - F.col("shift") - F.col("before")).join(shuffled(at), ["parent", "_k"], "left")
            skips = F.coalesce(F.col("_id") > F.col("first"), F.lit(False))
            ahead = Window.partitionBy("parent").orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
            after = reached.select("parent", "child", "first", "num", "shift", "before", "_id", skips.alias("skips"))
            after = written(after.withColumn("_new", F.coalesce(F.sum(F.col("skips").cast("long")).over(ahead), F.lit(0))), "names")
            if after.where("_new <> before").isEmpty():
                break
            now = after.select("parent", "child", "first", "num", "shift", F.col("_new").alias("before"))
        left_out = left_out.unionByName(after.where("skips").select(F.col("parent").alias("base"), (F.col("num") - 1 - F.col("before")).alias("at")))
        lost = F.col("_id").isNotNull() & ~F.col("skips")
        taken = taken.unionByName(after.where(lost).select(F.col("child").alias("base")))
        now = edges.join(shuffled(after.select(F.col("child").alias("parent"))), "parent", "left_semi")
    return taken, left_out


def unique_names(rows: DataFrame) -> DataFrame:
    """id and entity of ``rows`` (id, base): the first id of a base gets it, each further one the smallest free suffix from 002 on.

    The ids' order decides, as if names were given out one by one: a base that an earlier
    suffix has taken gets suffixes itself, a suffix that an earlier base is gets left out.
    So entities differ, whatever the bases are. Rows are numbered over all tasks; only bases
    that look like suffixes of other bases are looked at again.
    """
    placed = written(numbered(rows.select("id", "base"), ["base"], ["id"], "k"), "names")
    bases = written(placed.groupBy("base").agg(F.min("id").alias("first"), F.count("*").alias("n")), "names")
    found = _taken_numbers(placed, bases)
    if found is None:
        return placed.select("id", F.when(F.col("k") == 1, F.col("base")).otherwise(_suffixed(F.col("base"), F.col("k"))).alias("entity"))
    taken, left_out = found
    by_base = left_out.groupBy("base").agg(F.collect_list("at").alias("_at"))
    marked = placed.join(shuffled(taken.withColumn("_taken", F.lit(True))), "base", "left").join(shuffled(by_base), "base", "left")
    s = F.col("k") - F.when(F.col("_taken"), 0).otherwise(1)
    more = F.coalesce(F.size(F.filter("_at", lambda x: x <= s)), F.lit(0))
    return marked.select("id", F.when(s == 0, F.col("base")).otherwise(_suffixed(F.col("base"), s + 1 + more)).alias("entity"))


def name_features(features: DataFrame, width: float, depth: float, longest: int = 48) -> DataFrame:
    """id and entity of features (id, kind, category, name, x, z and, for roads, ref), in the order of ids.

    A road is named by its ref, else its name; forests have no names of their own.
    """
    token = sanitize_token(F.col("name"))
    if "ref" in features.columns:
        ref = sanitize_token(F.col("ref"))
        token = F.when((F.col("kind") == "Road") & (ref != ""), ref).otherwise(token)
    token = F.when(F.col("kind") == "Forest", "").otherwise(token)
    place = quadrant(F.col("x"), F.col("z"), F.lit(width), F.lit(depth))
    rows = features.withColumn("_token", token).withColumn("_place", place).withColumn("_named", F.col("_token") != "")
    named = (
        F.when(F.col("kind") == "Building", F.concat_ws("_", "kind", "category", "_token"))
        .when(F.col("kind").isin("Lake", "River"), F.concat_ws("_", "kind", "_token"))
        .otherwise(F.concat_ws("_", "kind", "_token", "category"))
    )
    parts = F.when(F.col("kind") == F.col("category"), F.concat_ws("_", "kind", "_place")).otherwise(F.concat_ws("_", "kind", "category", "_place"))
    rows = numbered(rows, ["kind", "category", "_place", "_named"], ["id"], "_n")
    base = F.btrim(F.regexp_replace(F.when(F.col("_named"), named).otherwise(_suffixed(parts, F.col("_n"))), "_+", "_"), F.lit("_"))
    return unique_names(rows.select("id", F.rtrim(F.left(base, F.lit(longest)), F.lit("_")).alias("base")))
