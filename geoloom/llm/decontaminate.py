"""Benchmark decontamination with a generalised suffix automaton over words.

The automaton holds every item's word sequence. Document words stream through it;
after each word the state tells the longest run of words, ending there, that some
item contains. A run of ``window`` words or more hits its words; the state's link
chain leads to the runs of exactly ``window`` words, which know their items. An item
shorter than a window is one window of its own: its end state is marked.

The items of one automaton hold at most ``BLOCK_WORDS`` words, so what travels to
the tasks is bounded. A larger item table is cut into blocks; each block's automaton
passes over all documents, and the hits of a document are united by its row.

Null texts have no words and no hits. Items without words are never found. Repeated
item ids count once. An item without an id hits words like any other, but has no name
to count or list. Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, map_batches, renamed

WINDOW = 13
BLOCK_WORDS = 500_000
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    """The normalised words of a whole text."""
    return WORDS.findall(lower_ascii(text)) if text else []


def named(item: str | None) -> tuple[str, ...]:
    """The item's name, if it has one."""
    return () if item is None else (item,)


class Automaton:
    """Suffix automaton of several word sequences, each added from the start state anew."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        #: by state: items that contain its runs of exactly ``window`` words, or that it spells whole
        self.whole: dict[int, set[str]] = {}
        self.windows: dict[int, set[str]] = {}
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for name, words in items:
            if not words:
                continue
            state, held = 0, 0
            for w in words:
                state, held = self.step(state, held, w)
                if held >= window:
                    self.windows.setdefault(self.at_length(state, window), set()).update(named(name))
            if len(words) < window:
                self.whole.setdefault(state, set()).update(named(name))
        self.short_lengths = {s: {} for s in self.whole}
        for name, words in items:
            if 0 < len(words) < window:
                self.short_lengths[self._walk(words)].setdefault(len(words), set()).update(named(name))
        # every window's longest word: a document without any of them holds no window
        self.keys = {
            max(words[i : i + window], key=lambda w: (len(w), w)) for _, words in items for i in range(max(1, len(words) - window + 1)) if words
        }
        # the nearest marked state on the way of links, itself included
        self.marked = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.marked[s] = s if s in self.whole else self.marked[self.link[s]]

    def _walk(self, words: list[str]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def _extend(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, q, w)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _clone(self, p: int, q: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def step(self, state: int, held: int, w: str) -> tuple[int, int]:
        """State and longest match after one more word."""
        while state and w not in self.next[state]:
            state = self.link[state]
            held = self.length[state]
        if w in self.next[state]:
            return self.next[state][w], held + 1
        return 0, 0

    def at_length(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a longer match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word spans (end exclusive, joined) and the items whose windows occur."""
        if self.keys.isdisjoint(words):
            return [], set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        first, marked = nxt[0], self.marked
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = held = 0
        for i, w in enumerate(words):
            if state:
                move = nxt[state].get(w)
                while move is None and state:
                    state = link[state]
                    held = length[state]
                    move = nxt[state].get(w)
                if move is None:
                    held = 0
                    continue
                state, held = move, held + 1
            else:
                move = first.get(w)
                if move is None:
                    continue
                state, held = move, 1
            begin = i + 1
            if held >= window:
                begin = i + 1 - window
                items |= self.windows[self.at_length(state, window)]
            m = marked[state]
            while m > 0:
                for n, names in self.short_lengths[m].items():
                    if n <= held:
                        begin = min(begin, i + 1 - n)
                        items |= names
                m = marked[link[m]]
            if begin <= i:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i + 1))
        return spans, items


def _blocks(benchmark: DataFrame, item: str, text: str):
    """Items in blocks of BLOCK_WORDS words, streamed: the driver holds one block at a time."""
    block, held = [], 0
    for r in benchmark.select(F.col(item).cast("string"), F.col(text)).distinct().toLocalIterator():
        words = words_of(r[1])
        if not words:
            continue
        if block and held + len(words) > BLOCK_WORDS:
            yield block
            block, held = [], 0
        block.append((r[0], words))
        held += len(words)
    yield block


def find_overlap(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with ``_n_words``, ``_hits`` (word spans) and ``_items`` (ids whose windows occur). No shuffle for one block.

    Older columns of these names are replaced.
    """
    docs = docs.drop("_n_words", "_hits", "_items")
    names = docs.columns
    at = names.index(text)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{own}, _n_words long, _hits array<struct<start:int,end:int>>, _items array<string>"

    def scanned(block: list) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)  # at most BLOCK_WORDS words

        def work(batches):
            automaton = Automaton(sent.value, window)
            for batch in batches:
                n, hits, items = [], [], []
                for t in batch.column(at).to_pylist():
                    words = words_of(t)
                    spans, found = automaton.scan(words)
                    n.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in spans])
                    items.append(sorted(found))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                    names=[*names, "_n_words", "_hits", "_items"],
                )

        return map_batches(docs, work, schema)

    found = [scanned(block) for block in _blocks(benchmark, item, text)]
    if len(found) == 1:
        return found[0]
    # many blocks: unite the hits of equal rows (they hit alike), then give every row its hits
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    united = (
        every.where(F.size("_hits") > 0)
        .select(key.alias("_key"), F.explode("_hits").alias("_hit"), "_items")
        .groupBy("_key")
        .agg(F.collect_set("_hit").alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"))
    )
    merged = F.aggregate(
        F.array_sort("_all"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    counted = found[0].select(*names, "_n_words").withColumn("_key", key)
    return counted.join(united.withColumn("_hits", merged).select("_key", "_hits", "_items"), "_key", "left").select(
        *names,
        "_n_words",
        F.coalesce("_hits", F.array().cast("array<struct<start:int,end:int>>")).alias("_hits"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("_items"),
    )


def _n_hit():
    return F.aggregate("_hits", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def contaminated(coverage: int = 20):
    """The rule: a word is hit and the hit words are at least one in ``coverage``."""
    return (_n_hit() > 0) & (_n_hit() * coverage >= F.col("_n_words"))


def overlap_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items found and the verdict."""
    found = find_overlap(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        _n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that the rule leaves, unchanged."""
    rows, name = renamed(docs)
    found = find_overlap(rows, benchmark.select(F.col("item_id").alias("_item"), F.col("text").alias(name["text"])), "_item", name["text"])
    return found.where(~contaminated()).select(*[F.col(n).alias(c) for c, n in name.items()])


def remove_spans(docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """Texts without their hit spans of ``longest`` words or more; rows with over ``coverage`` of their words hit go."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = find_overlap(rows, benchmark).where(_n_hit() <= F.col("_n_words") * coverage).select("row", "text", "_hits")

    def work(batches):
        for batch in batches:
            texts = []
            for t, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if t and hits:
                    places = [m.span() for m in WORDS.finditer(lower_ascii(t))]
                    for s in reversed(hits):
                        if s["end"] - s["start"] >= longest:
                            t = t[: places[s["start"]][0]] + t[places[s["end"] - 1][1] :]
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "clean"])

    kind = found.schema["row"].dataType.simpleString()
    out = map_batches(found, work, f"row {kind}, clean string")
    size = F.char_length("clean").cast("long")
    new = {"text": F.col("clean"), "n_chars": size}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def brute_force(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The report by comparing every window with every place."""
    windows: dict[tuple, set[str]] = {}
    for name, text in items:
        words = words_of(text)
        n = min(WINDOW, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).update(named(name if name is None else str(name)))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, names = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (found := windows.get(tuple(words[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return out
