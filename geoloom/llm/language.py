"""Language identification by cross-parsing.

Each language has a suffix automaton of labelled text. A text is parsed against it
from left to right into the longest phrases that the training text contains; a byte
that occurs nowhere in it is a phrase of its own. The language whose phrases are
fewest, each weighed by the bits that point to a phrase in its training text, wins.

Texts are lower-cased, runs of all but letters become one blank, and UTF-8
bytes are the symbols, so an automaton's transitions fit a dense table of
states x used bytes. Whole texts are parsed, in blocks of ``BLOCK`` bytes that start
anew; numpy carries all blocks of a batch side by side.

What is learned is bounded: ``SAMPLE_ROWS`` rows of a language at most, in the order
of a hash of their ids, and ``SAMPLE_BYTES`` bytes of them. Every language is learned;
a worker holds the automata of ``AT_ONCE`` languages, and with more of them it takes
its texts in blocks of ``HELD_BYTES`` through one group of languages after the other.
Rows without a label, or held out, teach nothing. Texts that are null or have no letter
(of Unicode's category L) get ``und`` and score 0. Ties go to the first language by
name. Without any labelled row all is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held_out, map_batches, renamed

SAMPLE_ROWS = 200
SAMPLE_BYTES = 60_000
BLOCK = 512
#: Languages whose automata a worker holds together, and bytes of rows that wait for each group of them.
AT_ONCE = 16
HELD_BYTES = 32 << 20
UNKNOWN = "und"
BLANK = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")


def normal(text: str) -> bytes:
    """The bytes to parse."""
    return BLANK.sub(" ", text.lower()).encode("utf-8", "replace")


class Parser:
    """Suffix automaton of one byte string as a dense transition table."""

    def __init__(self, data: bytes):
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in data:
            new = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[new] = copy
            last = new
        used = sorted(set(data))
        self.symbol = np.full(256, len(used), np.int32)
        self.symbol[used] = np.arange(len(used))
        self.width = len(used) + 1
        table = np.full((len(nxt), self.width), -1, np.int32)
        for s, moves in enumerate(nxt):
            for c, t in moves.items():
                table[s, self.symbol[c]] = t
        self.first = np.maximum(table[0], 0)
        self.table = table.ravel()
        self.bits = float(np.log2(max(2, len(data))))

    def phrases(self, columns: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Phrases of each block: ``columns`` has a row for each place, a column for each block, longest first."""
        symbols = self.symbol[columns]
        n = np.ones(columns.shape[1], np.int32)
        state = np.zeros(columns.shape[1], np.int32)
        for k in range(columns.shape[0]):
            m = alive[k]
            s = symbols[k, :m]
            move = self.table[state[:m] * self.width + s]
            ended = move < 0
            if k:  # a phrase begins here; the start state means that an unknown byte has just ended one
                n[:m] += ended | (state[:m] == 0)
            state[:m] = np.where(ended, self.first[s], move)
        return n


def _columns(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all texts side by side, longest first; how many reach each place; each block's text."""
    blocks = [(t[i : i + BLOCK], k) for k, t in enumerate(texts) for i in range(0, len(t), BLOCK)]
    blocks.sort(key=lambda b: -len(b[0]))
    size = np.array([len(b) for b, _ in blocks])
    grid = np.frombuffer(b"".join(b.ljust(BLOCK, b"\0") for b, _ in blocks), np.uint8).reshape(-1, BLOCK)
    alive = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")
    return np.ascontiguousarray(grid.T[: len(alive)]), alive, np.array([k for _, k in blocks], np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """Training text of each language: a bounded sample in hash order (SAMPLE_ROWS rows, SAMPLE_BYTES bytes)."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out())
    # three times the rows wanted, so that a sample short of them is not to be expected
    limits = labelled.groupBy(lang).agg((1 + F.lit(3 * SAMPLE_ROWS * (1 << 32)) / F.count("*")).cast("long").alias("_limit"))
    place = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 32))
    order = Window.partitionBy("lang").orderBy("_place", "doc_id", "text")
    rows = (
        labelled.join(F.broadcast(limits), lang)  # a row for each language
        .where(place < F.col("_limit"))
        .select(F.col(lang).alias("lang"), F.substring(text, 1, SAMPLE_BYTES).alias("text"), "doc_id", place.alias("_place"))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= SAMPLE_ROWS)
        .withColumn("_before", F.sum(F.octet_length("text")).over(order) - F.octet_length("text"))
        .where(F.col("_before") < SAMPLE_BYTES)
        .select("lang", "_n", "text")
        .orderBy("lang", "_n")
        .collect()
    )
    out: dict[str, list[bytes]] = {}
    for name, _, t in rows:
        out.setdefault(name, []).append(normal(t))
    return [(name, b" ".join(parts)[:SAMPLE_BYTES]) for name, parts in sorted(out.items()) if any(parts)]


def bits_of(texts: list[bytes], parsers: list[Parser]) -> np.ndarray:
    """Bits of every text under every parser: phrases times the bits that point to one."""
    columns, alive, owner = _columns(texts)
    return np.array([np.bincount(owner, p.phrases(columns, alive), len(texts)) * p.bits for p in parsers]).reshape(len(parsers), len(texts))


def predict(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """``docs`` with ``_lang`` and ``_score``: one minus the winner's share of bits against the second's. No shuffle.

    Older columns of these names are replaced.
    """
    docs = docs.drop("_lang", "_score")
    names = docs.columns
    at = names.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_BYTES for each language at most

    def judged(batch: pa.RecordBatch, groups) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        wanted = [k for k, t in enumerate(texts) if t and LETTER.search(t)]
        if sent.value and wanted:
            data = [normal(texts[k]) for k in wanted]
            bits = np.concatenate([bits_of(data, group) for group in groups()])
            best = bits.argmin(axis=0)
            least = bits[best, np.arange(len(wanted))]
            bits[best, np.arange(len(wanted))] = np.inf
            second = bits.min(axis=0)
            langs[wanted] = [sent.value[b][0] for b in best]
            scores[wanted] = np.where(np.isfinite(second), 1 - least / np.maximum(least + second, 1e-9), 1.0)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs.tolist(), pa.string()), pa.array(scores)], names=[*names, "_lang", "_score"])

    def work(batches):
        parts = [sent.value[k : k + AT_ONCE] for k in range(0, len(sent.value), AT_ONCE)]
        if len(parts) <= 1:
            one = [Parser(data) for part in parts for _, data in part]
            for batch in batches:
                yield judged(batch, lambda: [one])
            return
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= HELD_BYTES:
                yield from all_judged(held, parts)
                held = []
        yield from all_judged(held, parts)

    def all_judged(held, parts):
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches() if held else ():
            yield judged(batch, lambda: ([Parser(data) for _, data in part] for part in parts))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, work, f"{schema}, _lang string, _score double")


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: whether it was held out, the predicted language and a score."""
    model = learn(docs)
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose text has a letter; a missing ``lang`` becomes the predicted one, all else is unchanged.

    Null texts and texts without a letter go. Where nothing can be learned, no language
    is predicted and all other documents stay.
    """
    rows, name = renamed(docs)
    found = predict(rows, learn(docs), name["text"]).where(F.col(name["text"]).isNotNull() & F.col(name["text"]).rlike(r"\p{L}"))
    lang = F.coalesce(F.col(name["lang"]), F.nullif(F.col("_lang"), F.lit(UNKNOWN)))
    return found.select(*[lang.alias(c) if c == "lang" else F.col(n).alias(c) for c, n in name.items()])


def brute_force_phrases(data: bytes, text: bytes) -> int:
    """Phrases of the parse by plain substring search."""
    n = 0
    for i in range(0, len(text), BLOCK):
        block, at = text[i : i + BLOCK], 0
        while at < len(block):
            end = at + 1
            while end <= len(block) and block[at:end] in data:
                end += 1
            at = max(at + 1, end - 1)
            n += 1
    return n
