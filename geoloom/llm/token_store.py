"""Token-id files with a minimal perfect hash index.

A store is a Parquet data set of shards, so any store that Spark writes can hold
it. A shard holds the documents of one range of keys, in ascending key order:

* ``part``, ``seq``: the range partition and the shard's number in it; ``part_start``:
  ids of the partition's earlier shards; ``first_key``, ``last_key``: the shard's fences
* ``payload``: the ids, little endian, ``width`` bytes each (2 where the vocabulary allows)
* ``keys``: the document keys in file order, with ``nulls`` null keys before them
* the index over the shard's distinct keys: ``seeds`` (one displacement for each
  bucket), then by slot ``prints`` (32-bit fingerprints), ``starts``, ``sizes`` and
  ``copies`` (where a document's ids begin, how many, and how many rows share the key)

A key's slot takes two hashes and one displacement, whatever the shard's size; the
fingerprint rejects keys that are not there. Shards close at ``SHARD_IDS`` ids, so
a task holds one shard at a time.

Null text counts as empty (one id, the end). Rows with a null key come first.
Rows that share a key stay in the payload, ordered by text; the index points at the
first and counts them.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunked, file_text, gathered, map_batches, shared_folder, task_number

SHARD_IDS = 1 << 20
#: Keys for each bucket of the index, on average.
BUCKET = 2
#: Words kept with their ids, in each of two generations.
KNOWN_WORDS = 400_000
#: Rows encoded together: a word that they share is looked up once.
ENCODED_ROWS = 2000
#: Most keys of one lookup: each becomes a filter on the shards' fences.
LOOKUP_KEYS = 1000
SHARD_SCHEMA = (
    "part int, seq int, part_start long, first_key long, last_key long, nulls int, n_docs int, n_ids long, width int,"
    "payload binary, keys binary, null_sizes binary, later_sizes binary, seeds binary, prints binary, starts binary, sizes binary, copies binary"
)
# Where a text may be cut without changing its ids. Spaces always; beside
# them the borders between plain Latin letters and ASCII marks other than the apostrophe.
_L = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įı-ſ"
_P = r'.,;:!?"#$%&*()\[\]{}/\\+=@^~`_'
WORD = re.compile(rf"[{_L}]+")
PIECE = re.compile(rf"[{_L}]+(?=[{_P} \t\n\r]|$)|[{_P}]+(?=[{_L} \t\n\r]|$)|[^ \t\n\r]+")


class WordEncoder:
    """The tokenizers library behind a memory of chunks whose ids stand alone."""

    def __init__(self, content: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        suffix = json.loads(content)["model"].get("end_of_word_suffix") or None
        self.word_end = np.array([bool(suffix) and (self.tokenizer.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain Latin letters: the library takes a thousand at once, their last tokens part them."""
        out = []
        for k in range(0, len(words), 1000):
            some = words[k : k + 1000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) != len(some):
                out += self.encode_alone(some)
                continue
            packed, at, size = ids.astype(self.type).tobytes(), 0, self.type.itemsize
            for end in (ends * size).tolist():
                out.append(packed[at:end])
                at = end
        return out

    def encode_alone(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, one by one."""
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, self.type).tobytes() for e in found]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk."""
        if len(self.known) > KNOWN_WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        out = list(map(known.get, chunks))
        whole, split, new = [], {}, set()
        for k in [k for k, ids in enumerate(out) if ids is None]:
            chunk = chunks[k]
            if (ids := older.get(chunk)) is not None:
                out[k] = known[chunk] = ids
            elif WORD.fullmatch(chunk):
                whole.append(k)
            else:
                split[k] = pieces = PIECE.findall(chunk)
                new.update(pieces)
        for k, ids in zip(whole, self.encode_words([chunks[k] for k in whole]), strict=True):
            out[k] = known[chunks[k]] = ids
        new = [p for p in new if p not in known]
        words = [p for p in new if WORD.fullmatch(p)]
        known.update(zip(words, self.encode_words(words), strict=True))
        rest = [p for p in new if p not in known]
        known.update(zip(rest, self.encode_alone(rest), strict=True))
        for k, pieces in split.items():
            out[k] = known[chunks[k]] = b"".join([known[p] for p in pieces])
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, packed."""
        offsets, numbers, chunks = chunked(texts)
        ids = self.learn(chunks)
        sizes = np.array([len(x) for x in ids], np.int64) // self.type.itemsize
        flat = gathered(numbers, sizes, np.frombuffer(b"".join(ids), self.type))
        ends = np.concatenate([[0], np.cumsum(sizes[numbers])])[offsets].tolist()
        return [flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


@functools.cache
def encoder_of(content: str) -> WordEncoder:
    """One encoder for each worker process: what it knows serves that worker's later tasks too."""
    return WordEncoder(content)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each key; a bijection for a fixed seed."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(second: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """Slots of keys (by their second hash) under displacements."""
    x = second ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and every key's slot: distinct keys get the slots 0 to n-1, one each.

    Buckets go by size, largest first; each takes the first displacement that puts its
    keys on free slots. Single keys at the end take displacements past 2**31, which name
    a free slot outright.
    """
    n = len(keys)
    m = max(1, n // BUCKET)
    bucket = (mixed(keys, 1) % np.uint64(m)).astype(np.int64)
    second = mixed(keys, 2)
    seeds, slots, free = np.zeros(m, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(m + 1))
    size = np.diff(bounds)
    open_slots: list[int] | None = None
    for b in np.argsort(-size, kind="stable").tolist():
        if size[b] == 0:
            break
        own = order[bounds[b] : bounds[b + 1]]
        if size[b] == 1:
            if open_slots is None:
                open_slots = np.flatnonzero(free).tolist()
            slots[own[0]] = open_slots.pop()
            seeds[b] = (1 << 31) + slots[own[0]]
            continue
        d = 0
        while True:
            tries = _place(second[own], np.arange(d, d + 32)[:, None], n)
            good = free[tries].all(axis=1)
            if size[b] > 1:
                ranked = np.sort(tries, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                break
            d += 32
        k = int(good.argmax())
        seeds[b], slots[own], free[tries[k]] = d + k, tries[k], False
    return seeds, slots


def find_slots(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key, by two hashes and one displacement."""
    d = seeds[(mixed(keys, 1) % np.uint64(len(seeds))).astype(np.int64)]
    direct = d >= np.uint32(1 << 31)
    return np.where(direct, d.astype(np.int64) - (1 << 31), _place(mixed(keys, 2), np.where(direct, 0, d), n))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 3) >> np.uint64(32)).astype(np.uint32)


def _shard(part: int, seq: int, part_start: int, keys: list, packed: list[bytes], width: int) -> dict:
    nulls = sum(k is None for k in keys)
    sizes = np.array([len(x) // width for x in packed], np.int64)
    starts = np.cumsum(sizes) - sizes
    held = np.array(keys[nulls:], np.int64)
    distinct, first, copies = np.unique(held, return_index=True, return_counts=True)
    seeds, slots = build_index(distinct) if len(distinct) else (np.zeros(1, np.uint32), np.zeros(0, np.int64))
    by_slot = np.empty(len(slots), np.int64)
    by_slot[slots] = np.arange(len(slots))
    later = np.delete(sizes[nulls:], first)
    first = first[by_slot] + nulls
    return {
        "part": part, "seq": seq, "part_start": part_start,
        "first_key": int(held[0]) if len(held) else None, "last_key": int(held[-1]) if len(held) else None,
        "nulls": nulls, "n_docs": len(keys), "n_ids": int(sizes.sum()), "width": width,
        "payload": b"".join(packed), "keys": held.astype("<i8").tobytes(), "null_sizes": sizes[:nulls].astype("<i4").tobytes(),
        "later_sizes": later.astype("<i4").tobytes(),
        "seeds": seeds.astype("<u4").tobytes(), "prints": fingerprint(distinct[by_slot]).astype("<u4").tobytes(),
        "starts": starts[first].astype("<i8").tobytes(), "sizes": sizes[first].astype("<i4").tobytes(), "copies": copies[by_slot].astype("<i4").tobytes(),
    }


def write_store(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append ``end_id`` and write the shards in ascending ``doc_id`` order.

    One shuffle: texts go to ranges of keys before they are encoded, so each is encoded once.
    """
    content = file_text(vocabulary_path)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        encoder = encoder_of(content)
        width = encoder.type.itemsize
        end = np.array([end_id], encoder.type).tobytes()
        part, seq, done, keys, packed, ids = task_number(), 0, 0, [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([_shard(part, seq, done, keys, packed, width)], schema=arrow)

        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                keys.append(key)
                packed.append(x + end)
                ids += len(x) // width + 1
                if ids >= shard_ids:
                    yield row()
                    seq, done, keys, packed, ids = seq + 1, done + ids, [], [], 0
        if keys:
            yield row()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in SHARD_SCHEMA.split(","))])
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    map_batches(ranged, work, SHARD_SCHEMA, rows=ENCODED_ROWS).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(path)


def _documents(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of a shard's documents in file order, each found by its key."""
    nulls = np.frombuffer(shard["null_sizes"], "<i4").astype(np.int64)
    keys = np.frombuffer(shard["keys"], "<i8")
    starts, sizes, good = look_up(shard, keys)
    if not good.all():
        raise ValueError("a stored key is missing from its shard's index")
    repeat = np.concatenate([[False], keys[1:] == keys[:-1]]) if len(keys) else np.zeros(0, bool)
    if repeat.any():
        sizes = sizes.copy()
        sizes[repeat] = np.frombuffer(shard["later_sizes"], "<i4")
        starts = nulls.sum() + np.cumsum(sizes) - sizes
    return np.concatenate([np.cumsum(nulls) - nulls, starts]), np.concatenate([nulls, sizes]), keys


def look_up(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each key's (first) document in the shard, and whether its fingerprint agrees."""
    prints = np.frombuffer(shard["prints"], "<u4")
    if not len(prints) or not len(keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    slot = find_slots(keys, np.frombuffer(shard["seeds"], "<u4"), len(prints))
    good = prints[slot] == fingerprint(keys)
    return np.frombuffer(shard["starts"], "<i8")[slot], np.frombuffer(shard["sizes"], "<i4")[slot].astype(np.int64), good


def _starts_of_parts(shards: DataFrame) -> dict[int, int]:
    """Ids before each range partition. One number for each partition of the write, however long the data."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    out, at = {}, 0
    for r in totals:
        out[r["part"]] = at
        at += r["n"]
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every document of a store, from its files: doc_id, start (ids before it), ids (packed as 32-bit)."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    before = _starts_of_parts(shards)
    names = [x.split()[0] for x in SHARD_SCHEMA.split(",")]

    def work(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                starts, sizes, keys = _documents(shard)
                base = before[shard["part"]] + shard["part_start"]
                ids = np.frombuffer(shard["payload"], f"<u{shard['width']}").astype("<u4").tobytes()
                cut = np.concatenate([starts, [len(ids) // 4]]).tolist()
                rows = [ids[4 * a : 4 * (a + n)] for a, n in zip(cut, sizes.tolist(), strict=False)]
                ids_of = [None] * shard["nulls"] + keys.tolist()
                for k in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(ids_of[k : k + 500], pa.int64()), "start": pa.array(base + starts[k : k + 500], pa.int64()), "ids": pa.array(rows[k : k + 500], pa.binary())}
                    )

    return map_batches(shards.select(*names), work, "doc_id long, start long, ids binary", rows=1)


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """Keyed access: the shards whose fences hold a key are read, and each key's slot in them. At most LOOKUP_KEYS keys."""
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"a lookup takes {LOOKUP_KEYS} keys at most; join read_documents() for more")
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    within = F.lit(False)
    for key in keys:
        within = within | ((F.col("first_key") <= key) & (F.col("last_key") >= key))
    wanted = np.array(sorted(set(keys)), np.int64)

    def work(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                starts, sizes, good = look_up(shard, wanted)
                good &= (wanted >= shard["first_key"]) & (wanted <= shard["last_key"])
                ids = np.frombuffer(shard["payload"], f"<u{shard['width']}")
                rows = [ids[a : a + n].tolist() for a, n in zip(starts[good].tolist(), sizes[good].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(wanted[good]), "ids": pa.array(rows, pa.list_(pa.int64()))})

    return map_batches(shards.where(within), work, "doc_id long, ids array<long>", rows=1)


def store_report(docs: DataFrame, vocabulary_path: str, end_id: int = 1) -> DataFrame:
    """Write a store in the shared folder and report each document from its files."""
    path = shared_folder(docs.sparkSession, "token-store")
    write_store(docs, path, vocabulary_path, end_id)
    read = read_documents(docs.sparkSession, path)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def crc(ids: list[int]) -> int:
    """The checksum of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
