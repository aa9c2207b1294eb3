"""What five filters remove together: each filter's share in every order of the five.

A table-driven transducer reads the UTF-8 bytes of a slice of texts once: NEXT gives the
state after a byte, OUT what a byte adds in a state (a word begins, a capital, a code
point, a symbol). The table's outputs for all bytes of a slice are looked up by numpy; no
byte depends on more than the state before it. Spans of words go into a hash table with
open addressing, all words of a slice at once; a word meets an entry only if document,
length and bytes are equal, else it moves on to the next place. So distinct words are exact.

Filters (a text fails): A under 50 words; B ``100 * distinct words < 65 * words``; C
``100 * capitals > 5 * code points``; D any of ``#$%&*|``; E a smaller doc_id has the same
text. Words are maximal runs without ASCII white space, case-sensitive.

Null text counts as empty, so all null and empty texts are one text. Rows that repeat an id
are rows of their own, and none removes the other. A null id has no smaller id and is none.
Of several labels of one document the largest counts; null labels are none. A null source
is the empty one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.staging import spread_join, written
from .common import map_batches, renamed

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Rows and bytes of text that go through the transducer at once; a longer text goes alone.
SLICE_ROWS = 2_000
SLICE_BYTES = 4 << 20
SYMBOLS = b"#$%&*|"
WORD, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """NEXT (state after each byte: 0 between words, 1 within one) and OUT (flags by state and byte)."""
    after, out = np.ones(256, np.uint8), np.zeros((2, 256), np.uint8)
    after[[*range(9, 14), 32]] = 0
    out[0, after == 1] |= WORD
    out[:, ord("A") : ord("Z") + 1] |= CAPITAL
    out[:, [b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
    out[:, list(SYMBOLS)] |= SYMBOL
    return after, out


NEXT, OUT = transducer()


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and document, from running sums of a polynomial."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(raw), odd)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        h = (sums[ends] - sums[starts]) * powers[len(raw) - starts]
        h ^= docs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= odd
        return h ^ (h >> np.uint64(29))


def _same(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the stretches at ``a`` and at ``b``, of ``sizes`` bytes, hold the same bytes."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, bool)
    inner = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
    equal = raw[np.repeat(a, sizes) + inner] == raw[np.repeat(b, sizes) + inner]
    return np.logical_and.reduceat(equal, ends - sizes)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """How many different words each of ``n`` documents holds, by a hash table of spans."""
    size = 1 << int(2 * len(starts) + 1).bit_length()
    table = np.full(size, -1)
    place = (_hashes(raw, starts, ends, docs) & np.uint64(size - 1)).astype(np.int64)
    lengths, waiting = ends - starts, np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    while len(waiting):
        at = place[waiting]
        free = table[at] < 0
        table[at[free]] = waiting[free]  # of several words for one free place the last stays
        owner = table[at]
        new[waiting[owner == waiting]] = True
        alike = (docs[owner] == docs[waiting]) & (lengths[owner] == lengths[waiting])
        met = np.zeros(len(waiting), bool)
        met[alike] = _same(raw, starts[owner[alike]], starts[waiting[alike]], lengths[waiting[alike]])
        waiting = waiting[~met]
        place[waiting] = (place[waiting] + 1) & (size - 1)
    return np.bincount(docs[new], minlength=n)


def scan(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, code points and symbols (columns) of each text (rows)."""
    n = len(offsets) - 1
    state = np.zeros(len(raw), np.uint8)
    state[1:] = NEXT[raw[:-1]]
    firsts = offsets[:-1]
    state[firsts[firsts < len(raw)]] = 0  # each text starts between words
    out = OUT[state, raw]

    def counted(flag: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum((out & flag) > 0)])[offsets])

    starts = np.flatnonzero(out & WORD)
    # a word ends where the next byte is white space or belongs to another text
    last = NEXT[raw] == 1
    following = np.append(NEXT[raw[1:]] == 0, True)
    following[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(last & following) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    words = np.bincount(docs, minlength=n)
    return np.stack([words, distinct_words(raw, starts, ends, docs, n), counted(CAPITAL), counted(POINT), counted(SYMBOL)], 1)


def _pieces(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of bounded text."""
    first = held = 0
    for k, size in enumerate(sizes.tolist()):
        if k > first and held + size > SLICE_BYTES:
            yield first, k
            first, held = k, 0
        held += size
    if len(sizes) > first:
        yield first, len(sizes)


def text_counts(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``counts``: n_words, n_distinct, n_capitals, n_points, n_symbols of each whole text.

    An older column of that name is replaced. Rows stay where they are: no shuffle.
    """
    docs = docs.drop("counts")
    at = docs.columns.index(text)
    kept = [k for k in range(len(docs.columns)) if keep_text or k != at]
    names = [*(docs.columns[k] for k in kept), "counts"]
    fields = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.compute.fill_null(batch.column(at), "").cast(pa.large_binary())
            sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
            for first, stop in _pieces(batch, sizes):
                raw = np.frombuffer(b"".join(texts[first:stop].to_pylist()), np.uint8)
                found = scan(raw, np.concatenate([[0], np.cumsum(sizes[first:stop])]).astype(np.int64))
                counts = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found.T], names=list(fields))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, stop - first) for k in kept), counts], names=names)

    inner = ", ".join(f"{f}: bigint" for f in fields)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema.fields[k] for k in kept)), f"counts struct<{inner}>"])
    return map_batches(docs, work, schema, SLICE_ROWS)


def failing(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (doc_id, text, ...) with ``fails``: bit k is set if the text fails filter k of ABCDE.

    A text's digest meets the smallest id with it; digests that hold many rows are dealt
    over tasks. Texts themselves are not shuffled.
    """
    plain, names = renamed(docs)
    digest = F.sha2(F.coalesce(F.col(names["text"]), F.lit("")).cast("binary"), 256)
    read = text_counts(plain.select(*dict.fromkeys(names[c] for c in (*keep, "doc_id", "text"))).withColumn("_text", digest), names["text"], False)
    c = F.col("counts")
    tests = (
        c["n_words"] < 50,
        100 * c["n_distinct"] < 65 * c["n_words"],
        100 * c["n_capitals"] > 5 * c["n_points"],
        c["n_symbols"] > 0,
    )
    bits = sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))
    kept = {names[c]: c for c in keep}
    rows = written(read.select(*kept, F.col(names["doc_id"]).alias("_id"), F.unhex("_text").alias("_text"), bits.alias("_bits")), "filters")
    first = rows.groupBy("_text").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    met = spread_join(rows, first, ["_text"], rows.count())
    copy = F.coalesce(F.col("_id") > F.col("_first"), F.lit(False)).cast("int") * 16
    return met.select(*[F.col(n).alias(c) for n, c in kept.items()], (F.col("_bits") + copy).alias("fails"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (``source``), order of the filters and step in it; see the module for the counts' cases.

    kept: failing none of the filters up to this step. removed: failing this step's, none
    before. redundant: failing it, removed before. unique_fails: failing this one alone.
    good_lost, toxic_lost: removed here with quality 1, toxic 1. shapley: what the step's
    filter removes, summed over all orders. Documents are counted by part and failing
    filters first, so all else works on 32 rows for each part.
    """
    found = failing(docs, ["doc_id", "source"])
    marks = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    part = F.coalesce("source", F.lit("")).alias("part")
    one = F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic")
    sums = found.join(marks, "doc_id", "left").groupBy(part, "fails").agg(*one)
    # what a filter does depends on the set of those before it alone: 16 sets for each filter
    states = [(1 << f, before) for f in range(5) for before in range(32) if not before >> f & 1]
    state = F.explode(F.array(*[F.struct(F.lit(own).alias("own"), F.lit(before).alias("before")) for own, before in states])).alias("s")
    own, before, fails = F.col("s.own"), F.col("s.before"), F.col("fails")
    passed, hit = fails.bitwiseAND(before) == 0, fails.bitwiseAND(own) > 0

    def total(value: str, which) -> Column:
        return F.sum(F.when(which, F.col(value)).otherwise(0)).alias(value)

    by_state = sums.select("*", state).groupBy("part", own.alias("own"), before.alias("before")).agg(
        total("n", passed & ~hit).alias("kept"),
        total("n", passed & hit).alias("removed"),
        total("n", ~passed & hit).alias("redundant"),
        total("n", fails == own).alias("unique_fails"),
        total("good", passed & hit).alias("good_lost"),
        total("toxic", passed & hit).alias("toxic_lost"),
    )
    # filter k stands after a given set of s others in s! (4 - s)! of the 120 orders
    size = F.bit_count("before")
    share = F.col("removed") * F.factorial(size) * F.factorial(4 - size)
    shapley = by_state.groupBy("part", "own").agg(F.sum(share).alias("shapley"))
    steps = [(o, k + 1, 1 << FILTERS.index(o[k]), sum(1 << FILTERS.index(x) for x in o[:k])) for o in ORDERS for k in range(5)]
    wanted = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, own int, before int")
    found = by_state.join(shapley, ["part", "own"]).join(F.broadcast(wanted), ["own", "before"])
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.select("part", "filter_order", "step", *counts)


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, quality, toxic,
    CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks USING (doc_id)),
g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic
  FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, '[' || substr(filter_order, 1, step - 1) || ']' AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, step > 1 AND regexp_matches(fails, CASE WHEN step > 1 THEN before ELSE 'none' END) AS gone, contains(fails, own) AS hit FROM g, steps)
  GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""
