"""Byte-level BPE with a rank file: higher-order functions fold ranked merges over byte arrays.

Texts are cut into words by the vocabulary's pattern in slices of some thousand rows;
a slice is one row that holds its distinct words once and each text as numbers of
words. Spark's higher-order functions encode the distinct words. Literal maps of the
tokens, hashed into buckets so that a lookup reads few entries, name each stretch of
a word's bytes that is a token: an entry for the first bytes at a place gives all short
tokens there and the lengths that longer ones may have. A slice holds these first bytes
once and its words' places as their numbers. ``aggregate`` folds over the found
merges in the order of their ranks, from the word's single bytes on, each piece one
character: a merge joins its two parts wherever they stand side by side, from left to
right. Decoding joins the literal pieces of the ids.
Nothing is shuffled, and a slice bounds the memory, whatever the number of texts.

The fold needs each token to be made from two parts by merges of lower rank alone, as
in every trained rank file: then no merge can bring forth one of a lower rank, and the
order of ranks is the order of the merges. ``merges`` tests this for the file at hand.

Words of over ``LONG`` bytes take the same merges through a heap in the worker.

Null text counts as empty: no ids. Null ids decode to null; null or unknown ids among
others stand for nothing. Rows that repeat are encoded alike; an empty table stays empty.
"""

from __future__ import annotations

import base64
import heapq
import json
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .bpe import LATIN_WORD, ODD, WORD
from .common import file_text

#: Longest word, in bytes, that is folded.
LONG = 2048
#: Rows and bytes of text in a slice; a longer text is a slice of its own.
SLICE_ROWS = 20_000
SLICE_BYTES = 14 << 20
#: Buckets of a literal map.
BUCKETS = 1 << 16
#: Bytes of a place in a word that are looked up at once, and places that are numbered at once.
HEAD, BLOCK = 4, 1 << 20
#: The character of rank 0 in the fold; those below 256 are single bytes.
FIRST = 1 << 16


def rank_table(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file: a token in base64 and its rank on every line."""
    lines = (line.split() for line in file_text(path).splitlines())
    return {base64.b64decode(token): int(rank) for token, rank in (x for x in lines if x)}


def merges(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Where each token of more than one byte is joined: the length of its left part.

    A token must come from two parts by merges of lower rank than its own.
    """
    joints = {}
    for token, rank in ranks.items():
        ends = [*range(1, len(token) + 1)]
        while len(ends) > 2:
            starts = [0, *ends]
            least, k = min((ranks.get(token[starts[k] : ends[k + 1]], rank), k) for k in range(len(ends) - 1))
            if least >= rank:
                raise ValueError(f"token {rank} does not come from two parts of lower rank: not a merge order")
            del ends[k]
        if len(ends) == 2:
            joints[token] = ends[0]
    return joints


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once for however many uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(value: list, kind: str) -> Column:
    """A literal of nested arrays, which the optimizer folds; bytes travel as base64."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _read(value: list, kind: str) -> Column:
    """``_literal`` for rows that hold a whole slice: its text is read once a row.

    A folded array of all tokens would be hashed with every expression around it.
    """
    return _let(F.lit(json.dumps(value, separators=(",", ":"))), lambda text: F.from_json(text, kind))


def _literal_map(values: dict[bytes, object], kind: str) -> Column:
    """Values by bytes as a literal map: the low bits of crc32 name the bucket with an entry."""
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for key, value in values.items():
        buckets[zlib.crc32(key) & (BUCKETS - 1)].append({"k": base64.b64encode(key).decode(), "v": value})
    return F.transform(_read(buckets, f"array<array<struct<k: binary, v: {kind}>>>"), F.map_from_entries)


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks of tokens longer than ``HEAD`` by their bytes."""
    return _literal_map({t: r for t, r in ranks.items() if len(t) > HEAD}, "int")


def heads(ranks: dict[bytes, int]) -> dict[bytes, dict]:
    """For each two to ``HEAD`` bytes that a token starts with: ``found``, the ranks of tokens these bytes start with
    (single bytes aside), and ``longer``, the lengths of tokens beyond ``HEAD`` that start with them all, or null."""
    known: dict[bytes, dict] = {}
    for token in ranks:
        for n in range(2, min(HEAD, len(token)) + 1):
            head = token[:n]
            if head not in known:
                known[head] = {"found": [ranks[head[:k]] for k in range(2, n + 1) if head[:k] in ranks], "longer": set()}
        if len(token) > HEAD:
            known[token[:HEAD]]["longer"].add(len(token))
    return {head: entry | {"longer": sorted(entry["longer"]) or None} for head, entry in known.items()}


def head_map(ranks: dict[bytes, int]) -> Column:
    """``heads`` as a literal map."""
    return _literal_map(heads(ranks), "struct<found: array<int>, longer: array<int>>")


def byte_ranks(ranks: dict[bytes, int]) -> Column:
    """The ranks of single bytes as a literal array; bytes that are no token are null."""
    return _literal([ranks.get(bytes([b])) for b in range(256)], "array<int>")


def _shown(piece: bytes, ranks: dict[bytes, int]) -> str:
    """A piece as the fold writes it: one character, so that no match crosses a boundary."""
    return chr(piece[0] if len(piece) == 1 else FIRST + ranks[piece])


def merge_lists(ranks: dict[bytes, int]) -> list[Column]:
    """The merges by rank as two literal arrays: the two parts side by side, and their wholes."""
    size = max(ranks.values(), default=-1) + 1
    if FIRST + size > sys.maxunicode:
        raise ValueError(f"rank {size - 1} has no character of its own")
    parts: list[str | None] = [None] * size
    wholes: list[str | None] = [None] * size
    for token, k in merges(ranks).items():
        parts[ranks[token]] = _shown(token[:k], ranks) + _shown(token[k:], ranks)
        wholes[ranks[token]] = _shown(token, ranks)
    return [_read(parts, "array<string>"), _read(wholes, "array<string>")]


def piece_list(ranks: dict[bytes, int]) -> Column:
    """The pieces by id as a literal array; numbers no token has are null."""
    pieces: list[str | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = base64.b64encode(piece).decode()
    return _literal(pieces, "array<binary>")


def _held(held: Column, key: Column) -> Column:
    """A literal map's value for some bytes; null where it has none."""
    return F.try_element_at(F.get(held, F.crc32(key).bitwiseAND(BUCKETS - 1).cast("int")), key)


def head_entry(headed: Column, head: Column) -> Column:
    """The entry in ``head_map`` of the most of some first bytes (binary) that has one; else an empty one."""
    none = F.array().cast("array<int>")
    known = [_held(headed, head), *[_held(headed, F.substring(head, 1, n)) for n in range(HEAD - 1, 1, -1)]]
    return F.coalesce(*known, F.struct(none.alias("found"), F.lit(None).cast("array<int>").alias("longer")))


def fold_word(known: Column, held: Column, parts: Column, wholes: Column, single: Column, word: Column, heads: Column) -> Column:
    """The ids (array<int>) of one word (binary) and the numbers of its places' heads by the heads' entries,
    ``rank_map``, ``merge_lists`` and ``byte_ranks``."""

    def longer(head: Column, before: Column) -> Column:
        lengths = F.filter(F.get(known, head)["longer"], lambda n: n <= F.octet_length(word) - before)
        return F.transform(lengths, lambda n: _held(held, F.substring(word, before + 1, n)))

    def step(state: Column, rank: Column) -> Column:
        return F.replace(state, F.get(parts, rank), F.get(wholes, rank))

    def number(piece: Column) -> Column:
        code = F.ascii(piece)  # the whole character's number
        return F.when(code < FIRST, F.get(single, code)).otherwise(code - FIRST)

    short = F.flatten(F.transform(heads, lambda head: F.get(known, head)["found"]))
    long = F.filter(F.flatten(F.filter(F.transform(heads, longer), F.isnotnull)), F.isnotnull)
    ranked = F.sort_array(F.array_union(short, long))
    return F.transform(F.split(F.aggregate(ranked, F.decode(word, "ISO-8859-1"), step), ""), number)


def heap_word(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """The same merges for one very long word: a heap of (rank, place) over linked pieces."""
    n = len(word)
    end, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        for k in (before[i], i):
            if k >= 0 and end[k] < n and (r := ranks.get(word[k : end[end[k]]])) is not None:
                heapq.heappush(heap, (r, k, end[end[k]]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Rows cut into slices of bounded text."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_pylist()
        first = held = 0
        for k, size in enumerate(sizes):
            if k > first and (held + size > SLICE_BYTES or k - first == SLICE_ROWS):
                yield batch.take(pa.array(range(first, k), pa.int64()))
                first, held = k, 0
            held += size
        if len(sizes) > first:
            yield batch.take(pa.array(range(first, len(sizes)), pa.int64()))


def _headed(words: list[bytes]) -> tuple[pa.Array, pa.ListArray]:
    """The distinct first ``HEAD`` bytes of all places in words, fewer at a word's end, and for each word their numbers."""
    flat = np.frombuffer(b"".join(words) + bytes(HEAD), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes)
    blocks = []
    for first in range(0, len(left), BLOCK):
        n = min(BLOCK, len(left) - first)
        bytes_ = np.minimum(left[first : first + n] - np.arange(first, first + n), HEAD)
        key = bytes_ << 8 * HEAD
        for k in range(HEAD):
            key |= np.where(k < bytes_, flat[first + k : first + k + n].astype(np.int64) << 8 * k, 0)
        blocks.append(pa.array(key))
    coded = pa.chunked_array(blocks, pa.int64()).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    heads = [key.to_bytes(HEAD + 1, "little")[: key >> 8 * HEAD] for key in coded.dictionary.to_pylist()]
    return pa.array(heads, pa.binary()), pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), coded.indices)


def _worded(docs: DataFrame, text: str, ranks: dict[bytes, int], keep: list[str]) -> DataFrame:
    """A row for each slice: ``words`` (w, ``heads`` of its places by number, and ids of very long ones), ``docs`` (columns
    ``keep`` and places among the words) and ``heads`` (distinct first bytes of the words' places)."""
    names, at = docs.columns, docs.columns.index(text)
    inner = ", ".join([*(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in keep), "`_places`: array<int>"])
    frame = docs.sparkSession.createDataFrame([], f"words array<struct<w: binary, heads: array<int>, ids: array<int>>>, docs array<struct<{inner}>>, heads array<binary>")
    kinds = to_arrow_schema(frame.schema)
    row, word = kinds.field("docs").type.value_type, kinds.field("words").type.value_type

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = regex.compile(WORD)
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:  # what a slice needs is free before the next one
            numbers: defaultdict[str, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            places, ends = array("i"), [0]
            for value in batch.column(at):
                value = value.as_py() or ""
                places.extend(map(numbers.__getitem__, (odd if ODD.search(value) else LATIN_WORD).findall(value)))
                ends.append(len(places))
            words = [w.encode() for w in numbers]
            long = pa.array([heap_word(ranks, w) if len(w) > LONG else None for w in words], word.field("ids").type)
            heads, marks = _headed([w if len(w) <= LONG else b"" for w in words])
            words = pa.StructArray.from_arrays([pa.array(words, word.field("w").type), marks.cast(word.field("heads").type), long], fields=list(word))
            numbers.clear()
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(places, np.int32)))
            columns = [batch.column(names.index(c)).cast(row.field(c).type) for c in keep]
            rows = pa.StructArray.from_arrays([*columns, lists.cast(row.field("_places").type)], fields=list(row))
            one_row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, rows, heads)]
            return pa.RecordBatch.from_arrays([x.cast(k.type) for x, k in zip(one_row, kinds)], schema=kinds)

        yield from map(one, _slices(batches, at))

    return docs.mapInArrow(work, frame.schema)


def encode_texts(docs: DataFrame, path: str, text: str = "text", out: str = "ids", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``out``: the ids (array<int>) of each whole text by the rank file at ``path``.

    An older column of that name is replaced. Rows stay where they are: no shuffle.
    """
    docs = docs.drop(out)
    ranks = rank_table(path)
    keep = [c for c in docs.columns if keep_text or c != text]
    inside = {c: f"c{k}" for k, c in enumerate(keep)}  # no name of a caller meets a name of ours
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()], F.col(f"`{text}`").alias("_text"))
    sliced = _worded(plain, "_text", ranks, [*inside.values()])

    def rows(ids: Column) -> Column:
        def one(doc: Column) -> Column:
            return F.struct(*[doc[n].alias(n) for n in inside.values()], F.flatten(F.transform(doc["_places"], lambda k: F.get(ids, k))).alias("_ids"))

        return F.transform("docs", one)

    def encoded(t: Column) -> Column:
        tables = [t["known"], t["held"], t["parts"], t["wholes"], byte_ranks(ranks)]
        return F.transform("words", lambda w: F.coalesce(w["ids"], fold_word(*tables, w["w"], w["heads"])))

    known = _let(head_map(ranks), lambda headed: F.transform("heads", lambda head: head_entry(headed, head)))
    parts, wholes = merge_lists(ranks)
    tables = F.struct(known.alias("known"), rank_map(ranks).alias("held"), parts.alias("parts"), wholes.alias("wholes"))
    found = sliced.select("docs", _let(tables, encoded).alias("ids")).select(F.inline(rows(F.col("ids"))))
    return found.select(*[F.col(n).alias(c) for c, n in inside.items()], F.col("_ids").alias(out))


def decode_ids(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the bytes (binary) that ``ids`` stand for. An older column of that name is replaced."""
    pieces = piece_list(rank_table(path))

    def joined(held: Column) -> Column:
        # a string here is its bytes, whether or not they are UTF-8
        return F.array_join(F.transform(F.col(f"`{ids}`"), lambda i: F.get(held, i).cast("string")), "").cast("binary")

    return docs.withColumn(out, _let(pieces, joined))


def byte_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the decoded bytes)."""
    ids = encode_texts(docs.select("doc_id", "text"), path, keep_text=False)
    both = decode_ids(ids, path)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
