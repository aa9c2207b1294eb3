"""Licence scan: short notices found despite small edits.

Texts are reduced to normalised words joined by one blank. A notice with up to k
edits allowed is split into k + 1 pieces: by the pigeonhole principle one of them
stands unchanged in every match. The pieces of all notices form one Aho-Corasick
automaton whose hits locate candidates; around each, the regex library matches the whole
notice with at most k character edits and gives the span and the number of edits. A
notice's key words (its name, its version) have limits of their own: each must stand in
the span with no more edits than that. Phrases with no edits allowed (k = 0) are their
own seed; they count only between word borders.

Null texts have no words and no labels. The score is the largest share of a notice
that a match leaves unedited (exact phrases: 1), 0 without a match.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, map_batches

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short notices, their labels, the edits allowed, and their key words with the edits allowed in each.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0", 4, {"apache": 2, "2": 0, "0": 0}),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6, {"permission": 2, "granted": 2, "copy": 1}),
    ("released under the mit license", "mit", 3, {"mit": 0}),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8, {"redistribution": 3, "permitted": 3}),
    ("licensed under the gnu general public license version 3", "gpl-3.0", 4, {"gnu": 1, "general": 2, "public": 2, "3": 0}),
    ("licensed under the gnu general public license version 2", "gpl-2.0", 4, {"gnu": 1, "general": 2, "public": 2, "2": 0}),
    ("gnu lesser general public license", "lgpl", 3, {"gnu": 1, "lesser": 2, "public": 2}),
    ("creative commons attribution", "cc-by", 3, {"creative": 2, "commons": 2, "attribution": 3}),
    ("creative commons attribution sharealike", "cc-by-sa", 4, {"creative": 2, "attribution": 3, "sharealike": 3}),
    ("mozilla public license", "mpl", 2, {"mozilla": 2, "public": 1}),
    ("all rights reserved", "proprietary", 2, {"all": 0, "rights": 0, "reserved": 2}),
)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length, each with its place in the notice."""
    n = edits + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def within(key: str, edits: int, flags: int = 0) -> regex.Pattern:
    """Texts that are ``key`` but for so many edits."""
    plain = regex.escape(key, special_only=True)
    return regex.compile(f"(?:{plain}){{e<={edits}}}" if edits else plain, flags)


def apart(near: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of stretches (edits, first, end) of one notice that overlap, those with the fewest edits, then the first, stay."""
    firsts: list[int] = []
    ends: dict[int, int] = {}
    kept = []
    for edits, first, end in sorted(set(near)):
        at = bisect_left(firsts, first)
        if (at < len(firsts) and firsts[at] < end) or (at and ends[firsts[at - 1]] > first):
            continue
        firsts.insert(at, first)
        ends[first] = end
        kept.append((edits, first, end))
    return kept


class Scanner:
    """Seed automaton and verifiers for phrases and notices."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.entries = [(p, label, 0, {}) for p, label in phrases.items()] + list(notices)
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (text, _, edits, _) in enumerate(self.entries):
            for place, piece in seeds(text, edits):
                at.setdefault(piece, []).append((k, place + len(piece) - 1))
        self.seeds = ahocorasick.Automaton()
        for piece, where in at.items():
            self.seeds.add_word(piece, where)
        self.seeds.make_automaton()
        self.verify = [within(text, edits, regex.BESTMATCH) if edits else None for text, _, edits, _ in self.entries]
        self.keys = [[within(key, edits) for key, edits in keys.items()] for _, _, _, keys in self.entries]
        #: words that a match can span
        self.longest = max(text.count(" ") + 1 + edits for text, _, edits, _ in self.entries)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, str, int, int]]]:
        """Number of words, and matches: first word, end word (exclusive), label, edits, entry number."""
        words = WORDS.findall(lower_ascii(text)) if text else []
        line = f" {' '.join(words)} "
        starts: list[int] = []
        found, windows = [], {}
        for last, hits in self.seeds.iter(line):
            for k, place in hits:
                windows.setdefault(k, []).append(last - place)
        if windows:
            at = 1
            for w in words:
                starts.append(at)
                at += len(w) + 1
        for k, begins in windows.items():
            notice, label, edits, _ = self.entries[k]
            if not edits:
                for begin in begins:
                    if line[begin - 1] == " " and line[begin + len(notice)] == " ":
                        first = bisect_left(starts, begin)
                        found.append((first, first + notice.count(" ") + 1, label, 0, k))
                continue
            near = []
            for begin in sorted(set(begins)):
                # wide enough for a notice that shifted by its edits; no window grows with its neighbours
                for m in self.verify[k].finditer(line, max(0, begin - 2 * edits), min(len(line), begin + len(notice) + 2 * edits)):
                    a, b = m.span()
                    a += len(m.group()) - len(m.group().lstrip())
                    first = max(0, bisect_right(starts, a) - 1)
                    last = min(max(first + 1, bisect_left(starts, b)), len(words))
                    if all(any(key.fullmatch(w) for w in words[first:last]) for key in self.keys[k]):
                        near.append((sum(m.fuzzy_counts), first, last))
            found += [(first, last, label, e, k) for e, first, last in apart(near)]
        return len(words), self.fittest(sorted(set(found)))

    def fittest(self, found: list[tuple]) -> list[tuple]:
        """Of overlapping notices with different labels those with the fewest edits stay. Each looks at its neighbours alone."""
        fuzzy = [m for m in found if self.entries[m[4]][2]]
        firsts = [m[0] for m in fuzzy]

        def beaten(m: tuple) -> bool:
            near = fuzzy[bisect_left(firsts, m[0] - self.longest) : bisect_left(firsts, m[1])]
            return any(x[3] < m[3] and x[2] != m[2] and m[0] < x[1] for x in near)

        return [m for m in found if not self.entries[m[4]][2] or not beaten(m)]


def find_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_n_words`` and ``_matches``: first word, end word, label, edits, exact phrase or not, share unedited. No shuffle.

    Older columns of these names are replaced.
    """
    docs = docs.drop("_n_words", "_matches")
    names = docs.columns
    at = names.index(text)
    match = pa.struct(
        [("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("exact", pa.bool_()), ("share", pa.float64())]
    )

    def work(batches):
        scanner = Scanner()
        for batch in batches:
            counts, matches = [], []
            for t in batch.column(at).to_pylist():
                n, found = scanner.scan(t)
                counts.append(n)
                matches.append(
                    [
                        {"first": a, "end": b, "label": label, "edits": e, "exact": k < len(PHRASES), "share": 1 - e / len(scanner.entries[k][0])}
                        for a, b, label, e, k in found
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(matches, pa.list_(match))], names=[*names, "_n_words", "_matches"]
            )

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(
        docs, work, f"{own}, _n_words long, _matches array<struct<first:long,end:long,label:string,edits:int,exact:boolean,share:double>>"
    )


def license_report(docs: DataFrame) -> DataFrame:
    """Per document: words, exact phrase places, their first and last word, labels and a score."""
    base = F.filter("_matches", lambda m: m["exact"])

    def labels(matches):
        return F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))))

    return find_licenses(docs.select("doc_id", "text")).select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("_matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("_matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )


def brute_force(text: str | None) -> tuple:
    """The exact part of the report by comparing words place by place."""
    words = WORDS.findall(lower_ascii(text)) if text else []
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
