"""Secret scan, with DataFrame functions alone.

Two searches run over every whole text. Fixed patterns find assignments, access
keys and hex strings. Beside them, candidate strings (20 or more characters of
the base64 alphabets with at least one digit) get a Shannon entropy for every
window of 20 characters: one fold over the candidate keeps the count of each
character of its class, adds the entering and removes the leaving one, and
updates the sum of c*log2(c) by the difference of the two counts. A candidate
whose highest window passes its class's limit is a span, unless an allow-list
pattern covers it.

Null and empty texts give no spans. Repeated rows give equal results. Spans are
in code points, end exclusive. No shuffle: each row is judged alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
# Candidate strings, their classes and the limits in bits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_CLASS = r"^[0-9A-Fa-f]+$"
WINDOW = 20
HEX_BITS = 3.0
BASE64_BITS = 3.9
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Strings that look random and are no secrets.
ALLOWED = (
    r"^[0-9]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^sha(256|384|512)-",
    r"(?i)(example|placeholder|changeme|dummy|xxxxxx)",
    r"(?i)(abcdefghijklmnop|0123456789abcdef)",
)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
_SPAN = "array<struct<start:int,end:int,kind:int>>"


def running(values: Column, join) -> Column:
    """Running totals of an array by ``join``: in log n rounds each value meets the one 1, 2, 4, ... places before it.

    A fold that grows its result would copy it at every step.
    """
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    back = lambda i, r: i - F.call_function("shiftleft", F.lit(1), r)

    def doubled(held: Column, r: Column) -> Column:
        return F.transform(held, lambda x, i: F.coalesce(join(F.get(held, back(i, r)), x), x))

    return F.aggregate(rounds, values, doubled)


def _located(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the matches of ``pattern``; ``keep``: the group that needs MIN_ASSIGNED characters.

    The pieces between matches and the matches alternate, so running lengths place them.
    """
    p = F.lit(pattern)
    matches = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.char_length)
    if keep:
        matches = F.zip_with(
            matches,
            F.regexp_extract_all(text, p, F.lit(keep)),
            lambda n, part: F.struct(n.alias("n"), (F.char_length(part) >= MIN_ASSIGNED).alias("good")),
        )
    else:
        matches = F.transform(matches, lambda n: F.struct(n.alias("n"), F.lit(True).alias("good")))
    pairs = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.char_length),
        matches,
        lambda gap, hit: F.struct(gap.alias("gap"), hit["n"].alias("hit"), hit["good"].alias("good")),
    )
    ends = running(F.transform(pairs, lambda x: x["gap"] + F.coalesce(x["hit"], F.lit(0))), lambda a, b: a + b)

    def placed(x: Column, end: Column) -> Column:
        begin = end - F.coalesce(x["hit"], F.lit(0))
        return F.when(x["good"], F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))

    found = F.filter(F.zip_with(pairs, ends, placed), lambda s: s.isNotNull())
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def highest_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of the candidate's windows; null if it is shorter than one."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    leaving = F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes)
    moves = F.zip_with(codes, leaving, lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("double").alias("least"),
    )

    def step(acc: Column, x: Column) -> Column:
        new, old = x["new"], x["old"]
        plus, minus = F.get(acc["counts"], new), F.get(acc["counts"], old)
        still = new.eqNullSafe(old)
        total = F.when(still, acc["sum"]).otherwise(
            acc["sum"]
            + F.get(table, plus + 1)
            - F.get(table, plus)
            + F.coalesce(F.get(table, minus - 1) - F.get(table, minus), F.lit(0.0))
        )
        counts = F.when(still, acc["counts"]).otherwise(
            F.transform(acc["counts"], lambda v, k: F.when(k == new, v + 1).when(k == old, v - 1).otherwise(v))
        )
        n = acc["n"] + 1
        least = F.when(n >= window, F.least(acc["least"], total)).otherwise(acc["least"])
        # the lagged codes are longer by one window: nothing enters there any more
        return F.when(new.isNull(), acc).otherwise(
            F.struct(counts.alias("counts"), n.alias("n"), total.alias("sum"), least.alias("least"))
        )

    return F.aggregate(moves, zero, step, lambda acc: F.round(F.lit(math.log2(window)) - acc["least"] / window, 9))


def _entropy_spans(text: Column, allowed: tuple[str, ...]) -> Column:
    """Candidates over their class's limit, without those that ``allowed`` covers."""
    spans = _located(text, CANDIDATE, 3)

    def judged(s: Column, piece: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), piece.alias("piece"), piece.rlike(HEX_CLASS).alias("hex"))

    def likely(s: Column) -> Column:
        ok = s["piece"].rlike("[0-9]")
        for pattern in allowed:
            ok = ok & ~s["piece"].rlike(pattern)
        return ok

    def random(s: Column) -> Column:
        return highest_entropy(s["piece"]) >= F.when(s["hex"], HEX_BITS).otherwise(BASE64_BITS)

    kept = F.filter(F.filter(F.zip_with(spans, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), judged), likely), random)
    return F.transform(
        kept,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["hex"], 3).otherwise(4).alias("kind")),
    )


def find_secrets(docs: DataFrame, text: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with ``_base`` and ``_secrets``: arrays of (start, end, kind number), sorted by start, then kind.

    Older columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(_located(whole, ASSIGN, 0, keep=2), _located(whole, ACCESS, 1), _located(whole, HEX, 2))
    by_place = F.transform(
        F.array_sort(
            F.transform(F.concat(F.col("_base"), _entropy_spans(whole, allowed)), lambda s: F.struct(s["start"], s["kind"], s["end"]))
        ),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return docs.withColumn("_base", base).withColumn("_secrets", by_place)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(
            ordered,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
    )


def scan_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))

    def count(kind: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"),
        spans_text(F.col("_secrets")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones joined) replaced by ``mark``; ``n_chars`` follows the text."""
    def bound(value: Column, body) -> Column:
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def cut(wide: Column, begin: Column, n: Column) -> Column:
        return F.decode(F.substring(wide, 4 * begin + 1, 4 * n), "UTF-32")

    def joined(wide: Column, until: Column) -> Column:
        """Each span that ends a gap: the text since the furthest end before it, and the mark."""

        def piece(s: Column, k: Column) -> Column:
            at = F.coalesce(F.get(until, k - 1), F.lit(0))
            return F.when(s["start"] >= at, F.concat(cut(wide, at, s["start"] - at), F.lit(mark)))

        pieces = F.array_join(F.transform("_secrets", piece), "")
        return F.concat(pieces, cut(wide, F.element_at(until, -1), F.char_length("text")))

    # four bytes a character, so a cut costs its own length wherever it is
    ends = running(F.transform("_secrets", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    rest = bound(F.encode("text", "UTF-32"), lambda wide: bound(ends, lambda until: joined(wide, until)))
    found = find_secrets(docs.select(F.struct("*").alias("row"), "text"))
    found = found.select("row", F.when(F.size("_secrets") > 0, rest).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    return found.select(
        *[
            F.when(F.col("clean").isNotNull(), new[c]).otherwise(F.col("row").getField(c)).alias(c) if c in new else F.col("row").getField(c).alias(c)
            for c in docs.columns
        ]
    )


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, 0 AS kind, string_split_regex(t, '{ASSIGN.replace("'", "''").replace("(password|passwd|secret|token|api_?key)", "(?:password|passwd|secret|token|api_?key)").replace("([A-Za-z0-9+/_.=-]+)", "(?:[A-Za-z0-9+/_.=-]+)")}') AS gaps,
         regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 0) AS hits,
         [length(x) >= {MIN_ASSIGNED} FOR x IN regexp_extract_all(t, '{ASSIGN.replace("'", "''")}', 2)] AS good FROM d
  UNION ALL
  SELECT doc_id, 1, string_split_regex(t, '{ACCESS}'), regexp_extract_all(t, '{ACCESS}', 0), [true FOR x IN regexp_extract_all(t, '{ACCESS}', 0)] FROM d
  UNION ALL
  SELECT doc_id, 2, string_split_regex(t, '{HEX}'), regexp_extract_all(t, '{HEX}', 0), [true FOR x IN regexp_extract_all(t, '{HEX}', 0)] FROM d
  UNION ALL
  SELECT doc_id, 3, string_split_regex(t, '{CANDIDATE}'), regexp_extract_all(t, '{CANDIDATE}', 0),
         [regexp_matches(x, '[0-9]') {" ".join(f"AND NOT regexp_matches(x, '{p}')" for p in ALLOWED)}
          AND list_max([round(list_aggregate(string_split(substr(x, i, {WINDOW}), ''), 'entropy'), 9) FOR i IN range(1, length(x) - {WINDOW} + 2)])
              >= CASE WHEN regexp_matches(x, '{HEX_CLASS}') THEN {HEX_BITS} ELSE {BASE64_BITS} END
          FOR x IN regexp_extract_all(t, '{CANDIDATE}', 0)] FROM d
),
spans AS (
  SELECT doc_id, CASE WHEN kind = 3 AND NOT regexp_matches(hits[i], '{HEX_CLASS}') THEN 4 ELSE kind END AS kind, good[i] AS good,
         coalesce(list_sum([length(x) FOR x IN gaps[1:i]]), 0) + coalesce(list_sum([length(x) FOR x IN hits[1:i-1]]), 0) AS b,
         length(hits[i]) AS n
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM parts)
),
named AS (SELECT *, ['{"','".join(KINDS)}'][kind + 1] || ':' || CAST(b AS BIGINT) || ':' || CAST(b + n AS BIGINT) AS name FROM spans WHERE good)
SELECT d.doc_id,
       count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(name, ',' ORDER BY b, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(name, ',' ORDER BY b, kind), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""
