"""Byte-level BPE encoding and decoding.

A text is cut at special tokens, then into words by the vocabulary's pattern; a
word's ids depend on the word alone. The words of a batch that are not yet known
are encoded together: words of equal length form a matrix of part ids beside a
matrix of the ranks of adjacent parts. Each round takes every row's smallest
rank (the leftmost on ties), deletes that boundary and looks up the ranks next to
it anew. Words of over ``SHORT`` bytes use the same rule with a heap, so a very
long run of letters stays cheap. Known words are kept up to ``KNOWN_WORDS`` in
two generations, which bounds memory and never changes a result.

Null text counts as empty: no ids, empty decoded text. Decoding replaces bytes
that are not UTF-8, which only foreign id sequences can hold.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import file_text, map_batches

#: Longest word, in bytes, that goes through the matrices.
SHORT = 48
#: Words kept with their ids, in each of two generations.
KNOWN_WORDS = 120_000
# White space as the vocabulary's pattern understands it, and that pattern.
SPACE = r"\t-\r \x85\xa0  -     　"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
# The same pattern for texts whose letters are all plain Latin ones; other texts have an odd character.
LATIN = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u017f"
ODD = re.compile(rf"[^\t-\r\x20-\x7e\xab\xbb\u2013\u2014\u2018-\u201e{LATIN}]")
LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^\t-\r 0-9{LATIN}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Ids of single bytes, ranks of mergeable pairs and the bytes of every id."""

    def __init__(self, text: str):
        raw = json.loads(text)
        letters, ids = byte_letters(), raw["model"]["vocab"]
        special = {x["content"]: x["id"] for x in raw["added_tokens"]}
        self.size = max([*ids.values(), *special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in special.items():
            self.bytes_of[i] = token.encode()
        self.special = special
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in raw["model"]["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        self.word = regex.compile(WORD)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or _NONE."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def encode_equal(self, parts: np.ndarray) -> list[bytes]:
        """32-bit ids of words of one length: a row of ``parts`` holds the ids of a word's bytes."""
        n, width = parts.shape
        out = [b""] * n
        rows, held = np.arange(n), np.full(n, width)

        def finish(which: np.ndarray) -> None:
            raw, step = parts[which].astype(np.int32).tobytes(), 4 * parts.shape[1]
            for k, (row, m) in enumerate(zip(rows[which].tolist(), held[which].tolist(), strict=True)):
                out[row] = raw[k * step : k * step + 4 * m]

        if width == 1:
            finish(rows)
            return out
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(rows):
            least = ranks.argmin(axis=1)
            going = ranks[np.arange(len(rows)), least] < _NONE
            finish(np.flatnonzero(~going))
            rows, held, parts, ranks, least = rows[going], held[going] - 1, parts[going], ranks[going], least[going]
            if not len(rows):
                break
            each = np.arange(len(rows))
            parts[each, least] = self.merged[ranks[each, least]]
            # delete the boundary: what stands right of it moves one place left
            columns = np.arange(parts.shape[1] - 1)
            after = columns + (columns > least[:, None])
            parts = np.take_along_axis(parts, after, axis=1)
            if parts.shape[1] == 1:
                finish(each)
                break
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= least[:, None]), axis=1)
            # refresh the ranks left and right of the merged part
            for side in (least - 1, least):
                good = (side >= 0) & (side + 1 < held)
                k = each[good]
                ranks[k, side[good]] = self.ranks(parts[k, side[good]], parts[k, side[good] + 1])
            gone = held - 1
            k = each[gone < ranks.shape[1]]
            ranks[k, gone[k]] = _NONE
        return out

    def encode_long(self, word: bytes) -> np.ndarray:
        """The same rule for one long word: a heap of (rank, place) over linked parts."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        nxt, prev = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r < _NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = int(self.merged[r]), False, nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                y = nxt[x] if x >= 0 else -1
                if y >= 0:
                    new = int(self.ranks(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if new < _NONE:
                        heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive, strict=True) if ok], np.int32)

    def learn(self, words: set[str]) -> None:
        """Make the ids of ``words`` known."""
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if (ids := self.older.get(w)) is not None:
                self.known[w] = ids
                continue
            b = w.encode("utf-8", "surrogatepass")
            if len(b) > SHORT:
                self.known[w] = self.encode_long(b).tobytes()
            else:
                by_length.setdefault(len(b), []).append((w, b))
        for n, some in by_length.items():
            raw = np.frombuffer(b"".join(b for _, b in some), np.uint8).reshape(len(some), n)
            self.known.update(zip([w for w, _ in some], self.encode_equal(self.byte_id[raw]), strict=True))

    def words(self, text: str) -> list[str]:
        """A text's words by the pattern; texts of plain Latin letters take its faster twin."""
        return (self.word if ODD.search(text) else LATIN_WORD).findall(text)

    def pieces(self, text: str) -> list[str]:
        """A text's words and special tokens."""
        if self.cut is None or not self.cut.search(text):
            return self.words(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.words(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as 32-bit integers."""
        pieces = [self.pieces(text or "") for text in texts]
        if len(self.known) > KNOWN_WORDS:
            self.older, self.known = self.known, {}
        for token, i in self.special.items():
            self.known[token] = np.int32(i).tobytes()
        self.learn(set().union(*pieces) - self.known.keys())
        return [b"".join(map(self.known.__getitem__, some)) for some in pieces]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return ""
        place = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.joined[place].tobytes().decode("utf-8", "replace")


def encode_texts(docs: DataFrame, vocabulary_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: the ids (array<int>) of each whole text. Rows stay where they are: no shuffle."""
    content = file_text(vocabulary_path)
    docs = docs.drop(out)  # an older column of that name is replaced
    at = docs.columns.index(text)

    def work(batches):
        vocabulary = Vocabulary(content)
        for batch in batches:
            ids = vocabulary.encode(batch.column(at).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, out])

    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` array<int>"])
    return map_batches(docs, work, schema)


def decode_ids(docs: DataFrame, vocabulary_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out``: the text that ``ids`` stand for."""
    content = file_text(vocabulary_path)
    docs = docs.drop(out)
    at = docs.columns.index(ids)

    def work(batches):
        vocabulary = Vocabulary(content)
        for batch in batches:
            column = batch.column(at)
            flat = column.values.to_numpy(zero_copy_only=False)
            offsets = column.offsets.to_numpy()
            texts = [vocabulary.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, out])

    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{out}` string"])
    return map_batches(docs, work, schema)


def round_trip(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` of each whole text, ``n_tokens``, ``ids_sha256`` (of the decimal ids, comma-joined) and ``decoded_sha256``.

    Both ways in one pass: ids are decoded where they are made. Older columns of these
    names are replaced.
    """
    return _passed(docs, vocabulary_path, text, True)


def _passed(docs: DataFrame, vocabulary_path: str, text: str, with_ids: bool) -> DataFrame:
    content = file_text(vocabulary_path)
    docs = docs.drop("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    names = docs.columns
    at = names.index(text)
    new = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string"), *([("ids", "array<int>")] if with_ids else [])]

    def work(batches):
        vocabulary = Vocabulary(content)
        digits = [str(i) for i in range(vocabulary.size)]
        for batch in batches:
            packed = vocabulary.encode(batch.column(at).to_pylist())
            hashes, decoded = [], []
            for x in packed:
                ids = np.frombuffer(x, np.int32)
                hashes.append(hashlib.sha256(",".join([digits[i] for i in ids.tolist()]).encode()).hexdigest())
                decoded.append(hashlib.sha256(vocabulary.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            sizes = [len(x) // 4 for x in packed]
            columns = [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *[n for n, _ in new]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"{n} {k}" for n, k in new)])
    return map_batches(docs, work, schema)


def token_report(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per document: number of ids, a digest of the ids, a digest of the decoded text."""
    found = _passed(docs.select("doc_id", "text"), vocabulary_path, "text", False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
