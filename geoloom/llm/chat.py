"""Chat formatting by perspective rotation.

A conversation of several parties is rendered once for every participant: that
speaker's turns become the assistant's, all others are users under their own names,
and the training mask covers the assistant's words alone. ``system`` turns keep
their role in every rendering and get no rendering of their own.

A rendering is cut into chunks of ``CHUNK_TURNS`` numbers, so the turns of a long
conversation do not meet in one task: chunk sizes are summed first, over short rows
without text and in spans of ``SPAN`` chunks, then every chunk is rendered on its own
with the offset of its first character. Turns are ordered by number (null last), then
role and text. A chunk whose turns share a number, or have none, can hold any number of
them, so it is cut into parts of ``PART_TURNS`` by their rank, which a sort over all
tasks gives. Null roles count as ``unknown``, null texts as empty. Offsets and masks are
in characters of the whole rendering, end exclusive.

Rows without a conversation's id belong to no conversation and give no rendering.
Repeated rows are repeated turns. Texts and names are not escaped: one that holds a
marker such as ``<|end|>`` stands as it is, and the masks, not the markers, tell the parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

CHUNK_TURNS = 64
#: Turns of a part at most.
PART_TURNS = 1024
#: Chunks of several parts are broadcast up to this number, else joined by a shuffle.
BROADCAST_CHUNKS = 1_000_000
#: Chunks whose lengths are summed in one task.
SPAN = 256
SYSTEM = "system"
#: Chunk of the turns without a number: after all others.
LAST = 1 << 40


def with_parts(turns: DataFrame) -> DataFrame:
    """``turns`` with ``part``: 0, and in chunks of over PART_TURNS turns the turn's rank by PART_TURNS.

    Only the turns of such chunks are sorted: by range over all tasks, written with their
    places, and counted by task, so no task sees a whole chunk.
    """
    key = ["conv_id", "chunk"]
    large, _ = stage(turns.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > PART_TURNS).select(*key), "large-chunks")
    n = large.count()
    if not n:
        return turns.withColumn("part", F.lit(0).cast("long"))
    few = n <= BROADCAST_CHUNKS
    known = F.broadcast(large) if few else large
    order = [*key, "turn", "role", "text"]
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = turns.join(known, key, "left_semi").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed, _ = stage(dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33)), "large-turns")
    ahead = Window.partitionBy(*key).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*key, "_task").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    counts = counts.select(*key, "_task", (F.col("_first") - F.coalesce(F.sum("_n").over(ahead), F.lit(0))).alias("_zero"))
    ranked = placed.join(F.broadcast(counts) if n + tasks <= BROADCAST_CHUNKS else counts, [*key, "_task"])
    parted = ranked.select(*turns.columns, F.floor((F.col("_id") - F.col("_zero")) / PART_TURNS).alias("part"))
    return turns.join(known, key, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(parted)


def chunk_starts(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, part, speaker and start: the offset of every part of a chunk in every participant's rendering.

    A part's length is that of all turns under their names, less what the speaker's own
    turns save by the assistant's head. Lengths are summed in spans of SPAN chunks, then
    over the spans, in rows without text.
    """
    name = F.when(F.col("role") == SYSTEM, F.lit(len("<|system|>\n"))).otherwise(F.char_length("role") + len("<|user name=|>\n"))
    roles = turns.groupBy("conv_id", F.floor(F.col("chunk") / SPAN).alias("span"), "chunk", "part", "role").agg(
        F.count(F.lit(1)).alias("own"), F.sum((F.char_length("text") + name + len("<|end|>\n")).cast("long")).alias("length")
    )
    speakers = turns.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct()
    saved = F.coalesce("own", F.lit(0)) * (F.char_length("speaker") + len("<|user name=|>\n") - len("<|assistant|>\n"))

    def before(keys: list[str], *by: str):
        ahead = Window.partitionBy(*keys, "speaker").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(F.col("length") - saved).over(ahead), F.lit(0).cast("long"))

    def summed(keys: list[str]) -> tuple[DataFrame, DataFrame]:
        own = roles.groupBy(*keys, F.col("role").alias("speaker")).agg(F.sum("own").alias("own"))
        return roles.groupBy(*keys).agg(F.sum("length").alias("length")), own

    wide, own = summed(["conv_id", "span"])
    spans = wide.join(speakers, "conv_id").join(own, ["conv_id", "span", "speaker"], "left")
    spans = spans.select("conv_id", "span", "speaker", before(["conv_id"], "span").alias("_ahead"))
    parts = ["conv_id", "span", "chunk", "part"]
    short, own = summed(parts)
    chunks = short.join(spans, ["conv_id", "span"]).join(own, [*parts, "speaker"], "left")
    start = F.col("_ahead") + before(["conv_id", "span"], "chunk", "part")
    return chunks.select("conv_id", "chunk", "part", "speaker", start.alias("start"))


def rotate(conversations: DataFrame) -> DataFrame:
    """One row per conversation, participant, chunk and part: start, rendered, masks (array of start, end) and n_turns.

    Map-side partial sums give lengths and participants; the parts are grouped by
    (conversation, chunk, part) and meet their offsets there.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(LAST)).alias("chunk"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST * CHUNK_TURNS)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = with_parts(turns)
    blocks = turns.groupBy("conv_id", "chunk", "part").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"),
    )
    views = blocks.join(chunk_starts(turns), ["conv_id", "chunk", "part"])

    def head(t):
        return F.when(t["role"] == SYSTEM, F.lit("<|system|>\n")).when(
            t["role"] == F.col("speaker"), F.lit("<|assistant|>\n")
        ).otherwise(F.concat(F.lit("<|user name="), t["role"], F.lit("|>\n")))

    parts = F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit("<|end|>\n")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc, t):
        begin = acc["at"] + F.char_length(head(t))
        end = begin + F.char_length(t["text"])
        own = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(
            (end + 8).alias("at"),
            F.when(t["role"] == F.col("speaker"), F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"),
        )

    placed = views.select(
        "conv_id",
        "speaker",
        "chunk",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        "start",
        F.concat_ws("", parts).alias("rendered"),
        F.aggregate("turns", start, step, lambda acc: acc["out"]).alias("_masks"),
    )
    return placed.select(
        "conv_id",
        "speaker",
        "chunk",
        "part",
        "n_turns",
        "start",
        "rendered",
        F.transform(
            "_masks", lambda m: F.struct((m["start"] + F.col("start")).alias("start"), (m["end"] + F.col("start")).alias("end"))
        ).alias("masks"),
    )


def rotation_report(conversations: DataFrame) -> DataFrame:
    """``rotate`` with the masks as text (start:end, comma-joined)."""
    return rotate(conversations).withColumn(
        "masks", F.concat_ws(",", F.transform("masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))))
    )


SQL = f"""
WITH n AS (
  SELECT conv_id, coalesce(turn // {CHUNK_TURNS}, {LAST}) AS chunk, coalesce(turn, {LAST * CHUNK_TURNS}) AS turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, chunk ORDER BY turn, role, text) - 1) // {PART_TURNS} AS part FROM n),
v AS (
  SELECT t.*, s.role AS speaker,
         CASE WHEN t.role = '{SYSTEM}' THEN '<|system|>' WHEN t.role = s.role THEN '<|assistant|>' ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head
  FROM t JOIN (SELECT DISTINCT conv_id, role FROM t WHERE role <> '{SYSTEM}') s USING (conv_id)
),
p AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS piece,
         coalesce(sum(length(head || text) + 8) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM v
)
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, CAST(part AS BIGINT) AS part, count(*) AS n_turns, CAST(min(pos) AS BIGINT) AS "start", string_agg(piece, '' ORDER BY turn, role, text) AS rendered,
       coalesce(string_agg(CAST(pos + length(head) AS BIGINT) || ':' || CAST(pos + length(head) + length(text) AS BIGINT), ',' ORDER BY turn, role, text)
                FILTER (role = speaker), '') AS masks
FROM p GROUP BY conv_id, speaker, chunk, part
"""
