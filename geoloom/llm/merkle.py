"""Merkle manifest of a corpus: a leaf for each row, a tree for each language, a root over the trees.

Coordinates come from bitmap ranks, not from a sort. A group's ids are bits of 64-bit
words; only words with a bit are kept, tasks merge theirs with ``bit_or``, and each word
carries its popcount. The directory above counts in nodes of 512 children, level by
level, up to one node for the group: a word's base is what stands before it in its own
node, in its parent, and so on. An id's rank is its word's base and the popcount of the
word's bits below it. So the work is equi-joins on evenly filled keys, for ids of any
density. Rows that repeat an id, or have none, are numbered apart (``staging.numbered``)
and their extra rows are counted in the bases.

Slots then reduce the levels: the coordinates' high bits name an array of ``WIDTH``
slots, its levels are folded in place, and the arrays' heads are the next array's slots.
A tree of 10^11 leaves takes four such steps. On the way back each array gives its slots
the siblings in it and what its own head has above.

H is the lowercase hex sha256 of its inputs side by side, digests as hex. A leaf is H of
doc_id, source, lang, n_chars and text, each ``-`` if null, else UTF-8 byte count, ``:``
and value. In a group leaves ascend by doc_id, null first; rows of one id by their leaf.
Groups ascend by lang, null first. Rows that repeat in full are leaves of their own, with
proofs of their own. An empty table has no root and gives no rows. Further columns are
not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.staging import numbered, spread_join, written

#: Levels folded in one array of slots, which holds 2 ** LEVELS of them.
LEVELS = 9
#: Bits of a word's number for each step of the directory.
STEP = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """H of a row's fields: each ``-`` if null, else its byte count, a colon and its value."""

    def told(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(told, fields)).cast("binary"), 256)


def node_hash(*digests: Column) -> Column:
    """H of digests side by side; null ones are left out."""
    return F.sha2(F.concat(*[F.coalesce(d, F.lit("")) for d in digests]).cast("binary"), 256)


def _directory(words: DataFrame, totals: DataFrame) -> DataFrame:
    """For each bitmap word (g, w): ``start``, the group's rows before it, and ``total``, the group's rows."""
    low, high = words.agg(F.min("w"), F.max("w")).first()
    if low is None:
        return words.join(totals, "g").select("g", "w", F.lit(0).cast("long").alias("start"), "total")
    up = F.shiftright("w", STEP)
    before = F.coalesce(F.sum("c").over(Window.partitionBy("g", up).orderBy("w").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # upwards: the rows of a node's children, and what stands before each child in its node
    node, levels = words.select("g", (F.col("w") - low).alias("w"), F.col("n").alias("c")), []
    while True:
        levels.append(node.select("g", "w", "c", up.alias("up"), before.alias("before")))
        if (high - low) >> STEP * len(levels) == 0:
            break
        node = written(node.groupBy("g", up.alias("w")).agg(F.sum("c").alias("c")), "directory")
    # downwards: what stands before a node stands before its children; rows without an id are first of all
    placed = levels.pop().join(totals, "g").select("g", "w", (F.col("nulls") + F.col("before")).alias("start"), "total")
    for level in reversed(levels):
        placed = level.join(placed.withColumnRenamed("w", "up"), ["g", "up"]).select("g", "w", (F.col("start") + F.col("before")).alias("start"), "total")
    return placed.withColumn("w", F.col("w") + low)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` (g: string, id: long, leaf: string, ...) with ``pos``, each row's place in its group, and ``total``, the group's rows.

    ``g`` holds no null; null ids are first, rows of one id follow in the order of their leaves.
    """

    bit, one = F.col("id").bitwiseAND(63).cast("int"), F.lit(1).cast("long")
    ids = written(rows.groupBy("g", "id").agg(F.count("*").alias("n")), "ids")
    more = F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("more")))
    bits = F.bit_or(F.call_function("shiftleft", one, bit)).alias("bits")
    words = ids.where("id is not null").groupBy("g", F.shiftright("id", 6).alias("w")).agg(bits, F.sum("n").alias("n"), F.collect_list(more).alias("more"))
    words = written(words, "bitmaps")
    sums = F.sum("n").alias("total"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nulls")
    totals = written(ids.groupBy("g").agg(*sums), "groups")
    index = words.select("g", "w", "bits", "more").join(_directory(words, totals), ["g", "w"])
    smaller = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", -one, bit))))
    repeats = F.aggregate(F.filter("more", lambda e: e["bit"] < bit), F.lit(0).cast("long"), lambda s, e: s + e["more"])
    found = rows.where("id is not null").withColumn("w", F.shiftright("id", 6)).join(index, ["g", "w"])
    found = found.select(*rows.columns, (F.col("start") + smaller + repeats).alias("pos"), "total", F.exists("more", lambda e: e["bit"] == bit).alias("tied"))
    bare = rows.where("id is null")
    if not totals.where("nulls > 0").isEmpty():
        by_group = totals.where("nulls > 0").select("g", "total", F.col("nulls").alias("_n"))
        bare = spread_join(bare, by_group, ["g"], totals.agg(F.sum("nulls")).first()[0])
        found = found.unionByName(bare.select(*rows.columns, F.lit(0).cast("long").alias("pos"), "total", F.lit(True).alias("tied")))
    found = written(found, "ranked")
    if ids.where("n > 1").isEmpty():
        return found.drop("tied")
    tied = numbered(found.where("tied"), ["g", "id"], ["leaf"], "_k", 0)
    tied = tied.withColumn("pos", F.col("pos") + F.col("_k")).drop("_k", "tied")
    return found.where("NOT tied").drop("tied").unionByName(tied)


def _height(total: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    return F.when(total > 1, F.length(F.bin(total - 1))).otherwise(0)


def _reduced(slots: Column, steps: Column) -> Column:
    """The slots' digests and the levels above them, ``steps`` of them, as arrays."""

    def above(nodes: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) + 1, 1) - 1)
        return F.transform(pairs, lambda i: node_hash(F.get(nodes, 2 * i), F.get(nodes, 2 * i + 1)))

    rounds = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, F.array(slots), lambda held, _: F.concat(held, F.array(above(F.element_at(held, -1)))))


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays from the leaves to the heads of all groups, and the heads (g, root).

    ``nodes``: g, pos, total, leaf and whatever a leaf carries. An array row has g, chunk,
    total, slots (pos, leaf, carried columns) in order and levels.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    carried = [c for c in nodes.columns if c not in ("g", "total", "pos", "leaf")]
    arrays: list[DataFrame] = []
    while True:
        slot = F.struct("pos", "leaf", *(carried if not arrays else []))
        chunk = F.shiftright("pos", LEVELS).alias("chunk")
        held = nodes.groupBy("g", chunk).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(slot)).alias("slots"))
        steps = F.least(F.lit(LEVELS), _height(F.col("total")) - LEVELS * len(arrays))
        arrays.append(written(held.withColumn("levels", _reduced(F.col("slots.leaf"), steps)), "slots"))
        head = F.get(F.element_at("levels", -1), F.lit(0))
        nodes = arrays[-1].select("g", F.col("chunk").alias("pos"), "total", head.alias("leaf"))
        if most <= 1 << LEVELS * len(arrays):
            return arrays, nodes.select("g", F.col("leaf").alias("root"))


def descend(arrays: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Each leaf with ``path``: its siblings (digest, left), level by level, then what ``tops`` has above its group.

    ``tops``: g, above and columns that every leaf of the group gets. A digest is null where a
    run has no sibling.
    """
    given = [c for c in tops.columns if c not in ("g", "above")]
    at = tops.withColumn("chunk", F.lit(0).cast("long"))
    for k in reversed(range(len(arrays))):
        met = arrays[k].join(at, ["g", "chunk"])

        def path(slot: Column) -> Column:
            place = slot["pos"].bitwiseAND((1 << LEVELS) - 1).cast("int")

            def sibling(level: Column, j: Column) -> Column:
                here = F.call_function("shiftright", place, j)
                return F.struct(F.get(level, here.bitwiseXOR(F.lit(1))).alias("digest"), (here.bitwiseAND(1) == 1).alias("left"))

            inside = F.transform(F.slice("levels", F.lit(1), F.size("levels") - 1), sibling)
            return F.concat(inside, F.col("above"))

        leaves = F.transform("slots", lambda s: F.struct(s.alias("slot"), path(s).alias("above")))
        at = met.select("g", *given, F.inline(leaves)).select("g", *given, "above", F.col("slot.pos").alias("chunk"), "slot")
        if k:
            at = at.drop("slot")
    return at.select("g", "slot.*", *given, F.col("above").alias("path"))


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """Each row's leaf, the root of its language's tree, the root over all and the path between them.

    Returns doc_id, lang, place (in its language, from 0), leaf, subroot, root, path (array of
    digest and whether it stands left; a null digest where a run has one node) and the columns ``carried``.
    """
    carried = carried or {}
    leaf = leaf_hash([F.col(c) for c in FIELDS])
    group = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))  # the order of lang, null first
    rows = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), *[c.alias(n) for n, c in carried.items()])
    arrays, heads = climb(ranked(written(rows, "leaves")))
    heads = written(heads, "heads")
    n = heads.count()
    top = numbered(heads.withColumnRenamed("root", "leaf"), [], ["g"], "pos", 0)
    top = top.select(F.lit("").alias("g"), "pos", F.lit(n).cast("long").alias("total"), "leaf", F.col("g").alias("group"))
    over, root = climb(top)
    none = F.array().cast("array<struct<digest: string, left: boolean>>")
    tops = descend(over, root.withColumn("above", none))
    tops = tops.select(F.col("group").alias("g"), F.col("leaf").alias("subroot"), "root", F.col("path").alias("above"))
    found = descend(arrays, written(tops, "tops"))
    lang = F.when(F.col("g") != "", F.substr("g", F.lit(2))).alias("lang")
    return found.select(F.col("id").alias("doc_id"), lang, F.col("pos").alias("place"), "leaf", "subroot", "root", "path", *carried)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""

    def step(node: Column, sibling: Column) -> Column:
        return F.when(sibling["left"], node_hash(sibling["digest"], node)).otherwise(node_hash(node, sibling["digest"]))

    return F.aggregate(path, leaf, step)


def proof_report(docs: DataFrame) -> DataFrame:
    """Per row: leaf, subroot, root, a digest of its proof, the root folded from it, and whether that is the root.

    Where 7 divides the crc32 of the decimal doc_id the fold starts from a leaf whose
    n_chars is one more (a null one stays); a null doc_id is never tampered with.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    odd = leaf_hash([more if c == "n_chars" else F.col(c) for c in FIELDS])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, {"tampered": F.when(hit, odd)})
    siblings = F.array_join(F.transform("path", lambda s: s["digest"]), "")
    again = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = F.sha2(siblings.cast("binary"), 256).alias("proof_sha256")
    return again.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_TOLD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_TOLD.format(c) for c in FIELDS) + ")"
_TAMPERED = "sha256(" + " || ".join(_TOLD.format("(n_chars + 1)" if c == "n_chars" else c) for c in FIELDS) + ")"
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF} AS leaf, {_TAMPERED} AS odd, flatten(list_transform(
    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS bits
  FROM documents),
c AS (
  SELECT doc_id, g, leaf, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bits),
      lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295) % 7 = 0 THEN odd ELSE leaf END AS start
  FROM d),
tree AS (
  SELECT 0 AS level, g, pos, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM c
  UNION ALL
  SELECT level + 1, g, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY level, g, pos // 2, n),
subroots AS (SELECT g, digest AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT digest AS root, level AS height FROM top WHERE n = 1),
fold AS (
  SELECT c.doc_id, c.g, c.leaf, c.pos, 0 AS level, c.start AS node, '' AS proof FROM c
  UNION ALL
  SELECT f.doc_id, f.g, f.leaf, f.pos // 2, f.level + 1,
    sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(t.digest, '') || f.node ELSE f.node || coalesce(t.digest, '') END), f.proof || coalesce(t.digest, '')
  FROM fold f JOIN subroots s ON s.g = f.g AND f.level < s.height
  LEFT JOIN tree t ON t.g = f.g AND t.level = f.level AND t.pos = xor(f.pos, 1)),
over AS (
  SELECT f.doc_id, f.leaf, s.subroot, s.pos, 0 AS level, f.node, f.proof FROM fold f JOIN subroots s ON s.g = f.g AND f.level = s.height
  UNION ALL
  SELECT o.doc_id, o.leaf, o.subroot, o.pos // 2, o.level + 1,
    sha256(CASE WHEN o.pos % 2 = 1 THEN coalesce(t.digest, '') || o.node ELSE o.node || coalesce(t.digest, '') END), o.proof || coalesce(t.digest, '')
  FROM over o JOIN root r ON o.level < r.height LEFT JOIN top t ON t.level = o.level AND t.pos = xor(o.pos, 1))
SELECT o.doc_id, o.leaf, o.subroot, r.root, sha256(o.proof) AS proof_sha256, o.node AS folded_root, o.node = r.root AS verified
FROM over o JOIN root r ON o.level = r.height
"""
