"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon, a weighted transducer of one state, reads words and writes symbols: insult,
threat, target, link word, negation, verb of speech, other. Small sequential transducers,
each a table of states and arcs, then rewrite the offences among the symbols: negation
(denied within three words after one), reported speech (quoted after a verb of speech),
targets (an insult or threat within four words of one is aimed), phrases (an insult
within four words of a link word is named) and piling (an insult beside other offences of
its clause). They are composed into two machines, one that reads a clause from the
left and one that reads what the first wrote from the right, where a target may
follow. An offence that no pattern takes up counts for nothing: no word scores by itself.
Only clauses with an offence are run; others cost a lookup for each word.

The insults of the lexicon are a fixed list, of weight 1, and word stems learned from
labelled rows, weighed by how much more often toxic rows have them; the weights of the
patterns are a logistic regression on the same rows. What is learned is bounded:
``SAMPLE`` rows of each label at most, in the order of a hash of their ids, held-out
rows never; stems ``STEMS`` at most. Their counts are summed by Spark.

Null and empty texts match nothing and get the score of a text without matches.
Labels of ids that occur twice count once (the larger), and so do labelled rows whose
whole texts are equal; an id with several texts teaches by the least. Without labels of
both kinds the score is 0. Rows are scored where they are: no shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.staging import drop_stages
from .common import held_out, lower_ascii, map_batches, stage

SAMPLE = 4000
STEMS = 400
STEM = 5
#: A learned stem stands this many times in toxic rows, in so many of them, in so much more of them than of others.
STEM_COUNT, STEM_ROWS, STEM_RATIO, STEM_Z = 8, 5, 4.0, 4.0
THRESHOLD = 0.3
CLAUSE = re.compile(r"[.!?;\n]+")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words after a negation that it denies, words from an offence to its target, and from an insult to a link word.
NEGATED, AIMED, NAMED = 3, 4, 4
# The word classes of the lexicon.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb pathetic worthless disgusting scum trash garbage loser losers clown clowns "
    "fool fools imbecile cretin vermin filth jerk coward liar freak ugly useless".split()
)
THREATS = frozenset("kill hurt destroy burn beat punish strangle shoot stab murder crush".split())
TARGETS = frozenset(
    "you your yours u ur they them their he his him she her we us tu te toi vous il elle ils elles lui leur "
    "du dich dir ihr euch er sie ihn ihm usted ustedes ellos ellas su sus".split()
)
LINKS = frozenset(
    "the a an this that these those such is are was were and or of to for with in on by as at from "
    "le la les un une des ce cette est sont et de du en à au aux pour par dans sur avec que qui "
    "der die das den dem ein eine einen ist sind und von mit auf zu für im nicht auch "
    "el los las una este esta es son y por para con del al no".split()
)
NEGATIONS = frozenset("not no never nobody isn aren wasn don doesn didn without nicht kein keine ne pas jamais nunca".split())
SPEECH = frozenset("said says wrote called calls reported quoted claimed told stated sagte dit dijo".split())
#: Symbols of the lexicon: insult, threat, target, link word, negation, verb of speech, other words.
INSULT, THREAT, TARGET, LINK, NEGATION, SAID, OTHER = SYMBOLS = "IKTLNSO"
#: What the machines write for an offence: its pattern. Offences left as they are match nothing.
PATTERNS = {"a": "aimed", "n": "named", "p": "piled", "t": "threat", "d": "denied", "q": "quoted"}


class Transducer:
    """A sequential transducer as a table: ``arcs[state][symbol]`` is (next state, symbol written). State 0 is the start."""

    def __init__(self, arcs: list[dict[str, tuple[int, str]]]):
        self.arcs = arcs

    @classmethod
    def of(cls, start, symbols: str, step) -> Transducer:
        """The table of all states that ``step(state, symbol)`` reaches from ``start``."""
        states, arcs = {start: 0}, []
        todo = [start]
        for state in todo:
            row = {}
            for symbol in symbols:
                after, written = step(state, symbol)
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row[symbol] = (states[after], written)
            arcs.append(row)
        return cls(arcs)

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes, the other reads."""

        def step(state, symbol):
            mine, written = self.arcs[state[0]][symbol]
            theirs, out = other.arcs[state[1]][written]
            return (mine, theirs), out

        return Transducer.of((0, 0), "".join(self.arcs[0]), step)

    def run(self, symbols) -> list[str]:
        """What it writes, symbol by symbol."""
        arcs, state, out = self.arcs, 0, []
        for symbol in symbols:
            state, written = arcs[state][symbol]
            out.append(written)
        return out


def negation() -> Transducer:
    """Offences within NEGATED words after a negation are denied."""
    return Transducer.of(0, SYMBOLS, lambda left, x: (NEGATED if x == NEGATION else max(0, left - 1), "d" if left and x in (INSULT, THREAT) else x))


def reported_speech() -> Transducer:
    """Offences after a verb of speech in the clause are quoted."""
    return Transducer.of(False, SYMBOLS + "d", lambda said, x: (said or x == SAID, "q" if said and x in (INSULT, THREAT, "d") else x))


def near(symbols: str, reads: str, mark: str, within: int, writes: str) -> Transducer:
    """An offence ``reads`` at most ``within`` words after a ``mark`` is written as ``writes``."""
    return Transducer.of(0, symbols, lambda left, x: (within if x in mark else max(0, left - 1), writes if left and x == reads else x))


def piling(symbols: str) -> Transducer:
    """An insult that follows a pattern or another insult of its clause piles on."""
    return Transducer.of(False, symbols, lambda before, x: (before or x in "Iapnt", "p" if before and x == INSULT else x))


def grammar() -> tuple[Transducer, Transducer]:
    """The composed machines: one reads a clause from the left, the other what the first wrote, from the right."""
    known = SYMBOLS + "dq"
    aimed = known + "a"
    left = negation().then(reported_speech())
    left = left.then(near(known, INSULT, TARGET, AIMED, "a")).then(near(aimed, THREAT, TARGET, AIMED, "t"))
    left = left.then(near(aimed + "t", INSULT, LINK, NAMED, "n")).then(piling(aimed + "tn"))
    every = aimed + "tnp"
    right = near(every, INSULT, TARGET, AIMED, "a").then(near(every, THREAT, TARGET, AIMED, "t"))
    right = right.then(near(every, INSULT, LINK, NAMED, "n")).then(piling(every))
    return left, right


class Grammar:
    """The lexicon, a weighted transducer of one state from words to symbols, before the composed machines."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.left, self.right = grammar()
        self.symbols = {}
        for words, symbol in ((LINKS, LINK), (TARGETS, TARGET), (NEGATIONS, NEGATION), (SPEECH, SAID), (THREATS, THREAT), (INSULTS, INSULT)):
            self.symbols |= dict.fromkeys(words, symbol)

    def read(self, word: str) -> str:
        """The symbol of a word; learned stems are insults."""
        return self.symbols.get(word) or (INSULT if word[:STEM] in self.stems else OTHER)

    def weight(self, word: str) -> float:
        """The weight of an offence: a learned stem's own, else 1."""
        return self.stems.get(word[:STEM], 1.0)

    def clause(self, words: list[str]) -> list[tuple[str, float]]:
        """Patterns and weights of one clause."""
        written = self.left.run(map(self.read, words))
        written = self.right.run(reversed(written))[::-1]
        return [(PATTERNS[x], self.weight(w)) for w, x in zip(words, written, strict=True) if x in PATTERNS]

    def features(self, text: str | None) -> list[float]:
        """1, then for each pattern the logarithms of its count and weight, then of matched clauses and of their share."""
        counts, weights, n, matched = Counter(), Counter(), 0, 0
        if text:
            offends = INSULTS | THREATS
            for clause in CLAUSE.split(lower_ascii(text)):
                words = WORDS.findall(clause)
                n += len(words)
                if any((w in offends or w[:STEM] in self.stems) for w in words):
                    found = self.clause(words)
                    for pattern, w in found:
                        counts[pattern] += 1
                        weights[pattern] += w
                    matched += any(p not in ("denied", "quoted") for p, _ in found)
        own = [v for p in PATTERNS.values() for v in (math.log1p(counts[p]), math.log1p(weights[p]))]
        return [1.0, *own, math.log1p(matched), math.log1p(100.0 * matched / max(1, n))]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of SAMPLE rows of each label at most; the ids travel as a broadcast of that bounded size."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("toxic") > 0).alias("kind")).count().collect()}
    placed, chosen = known.withColumn("_place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))), known.where("false")
    for kind, n in sorted(counts.items()):
        # half as many again as wanted lie below the limit, so that a sample short of them is not to be expected
        near = placed.where(((F.col("toxic") > 0) == kind) & (F.col("_place") < min(1 << 32, 1 + SAMPLE * (3 << 31) // n)))
        chosen = chosen.unionByName(near.orderBy("_place", "doc_id").limit(SAMPLE).select("doc_id", "toxic"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    # copies teach once: whole texts that are equal are one row, toxic where any of them is
    own = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return own.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic")


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Stems that stand out in toxic rows, with the logarithm of how much."""
    schema = "stem string, toxic_n long, toxic_rows long, clean_rows long"

    def work(batches):
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for stem, n in Counter(w[:STEM] for w in WORDS.findall(lower_ascii(text)) if len(w) >= STEM).items():
                    c = counts.setdefault(stem, [0, 0, 0])
                    c[0] += n if toxic else 0
                    c[1 if toxic else 2] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), *(pa.array([counts[k][i] for k in keys], pa.int64()) for i in range(3))],
            names=["stem", "toxic_n", "toxic_rows", "clean_rows"],
        )

    size = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    if len(size) < 2:
        return {}
    summed = map_batches(sample, work, schema).groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic_n", "toxic_rows", "clean_rows")))
    ratio = F.log((F.col("toxic_rows") + 0.5) / size[True]) - F.log((F.col("clean_rows") + 0.5) / size[False])
    spread = F.sqrt(1 / (F.col("toxic_rows") + 0.5) + 1 / (F.col("clean_rows") + 0.5))
    found = (
        summed.where((F.col("toxic_n") >= STEM_COUNT) & (F.col("toxic_rows") >= STEM_ROWS))
        .select("stem", F.round(ratio, 9).alias("r"), F.round(ratio / spread, 9).alias("z"))
        .where((F.col("r") >= math.log(STEM_RATIO)) & (F.col("z") >= STEM_Z))
        .orderBy(F.desc("z"), "stem")
        .limit(STEMS)
        .collect()
    )
    return {r["stem"]: float(r["r"]) for r in found}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0, *[ridge] * (x.shape[1] - 1)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grow = x.T @ (y - p) - penalty @ w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-6 * np.eye(len(w))
        move = np.linalg.solve(curve, grow)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], list[float]] | None:
    """Stems and pattern weights; None without labels of both kinds. The sample is written once, so every step sees the same rows."""
    sample, path = stage(_sample(docs, labels), "toxic-sample")
    stems = learn_stems(sample)

    def work(batches):
        grammar = Grammar(stems)
        for batch in batches:
            rows = [grammar.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = map_batches(sample, work, "toxic int, x array<double>").collect()  # at most 2 x SAMPLE rows of fifteen numbers
    drop_stages(docs.sparkSession, path)
    if len({r["toxic"] > 0 for r in rows}) < 2:
        return None
    rows = sorted((r["toxic"], r["x"]) for r in rows)
    x, y = np.array([r[1] for r in rows]), np.array([float(r[0] > 0) for r in rows])
    return stems, fit(x, y).tolist()


def score(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """``docs`` with ``_score`` and ``_clauses``, the number of matches of each of PATTERNS; older columns of these names go."""
    docs = docs.drop("_score", "_clauses")
    names = docs.columns
    at = names.index(text)

    def work(batches):
        grammar = Grammar(model[0] if model else {})
        weights = np.array(model[1]) if model else None
        for batch in batches:
            x = np.array([grammar.features(t) for t in batch.column(at).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) if model and len(x) else np.zeros(len(x))
            counts = [[round(math.expm1(v)) for v in row[1 : 1 + 2 * len(PATTERNS) : 2]] for row in x.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(counts, pa.list_(pa.int32()))], names=[*names, "_score", "_clauses"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, work, f"{own}, _score double, _clauses array<int>")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out, a score and the verdict."""
    return score(docs.select("doc_id", "text"), learn(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted")
    )
