"""Large JSON documents read in splits: the objects of one array below the root, wherever the splits fall.

``{"elements": [...]}`` is one value, so a JSON reader gives a whole file to one task.
Here Spark's text source cuts files at commas, which it can do from any byte range on. Most
commas lie within an object or a string, so each split is read twice. First each split
tells what it does to whatever stands open before it: the brackets it closes and opens, and
whether a string is open after it, both for a split that starts within a string and for
one that does not. Those few words for each split compose along a file to what is open at the start of
each. Then each split yields the objects it holds whole, and at most two fragments of
objects that cross its borders, which meet by file. No task reads more than its splits,
whatever the size of a file; nothing but a row for each split is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.staging import written

_MARK = re.compile(r'\\.|["\[\]{}]', re.DOTALL)


class Brackets:
    """What stands open while text is read: ``stack`` holds {, [ and E for the array in question; ``closed`` counts what was open before."""

    def __init__(self, key: str, quoted: bool, stack: str = ""):
        self.entry = re.compile(rf'"{re.escape(key)}"\s*:\s*$')
        self.quoted, self.stack, self.closed = quoted, list(stack), 0

    def marks(self, text: str) -> Iterator[tuple[str, int]]:
        """Brackets outside strings, and their places."""
        begun = 0
        for m in _MARK.finditer(text):
            mark = m.group()
            if mark == '"':
                self.quoted = not self.quoted
            elif not self.quoted and mark in "{[":
                self.stack.append("E" if mark == "[" and self.entry.search(text, begun, m.start()) else mark)
                begun = m.end()
                yield mark, m.start()
            elif not self.quoted and mark in "}]":
                if self.stack:
                    self.stack.pop()
                else:
                    self.closed += 1
                yield mark, m.start()


def _summaries(key: str):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, both = None, ()

        def told() -> pd.DataFrame:
            return pd.DataFrame([(*now, s, b.quoted, b.closed, "".join(b.stack)) for s, b in zip((False, True), both, strict=True)], columns=["file", "block", "starts", "quoted", "closed", "opened"])

        for pdf in frames:
            for file, block, text in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
                if (file, block) != now:
                    if now:
                        yield told()
                    now, both = (file, block), (Brackets(key, False), Brackets(key, True))
                for b in both:
                    for _ in b.marks(text):
                        pass
        if now:
            yield told()

    return work


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """What is open at the start of each split of one file: a fold over one row for each split."""
    quoted, stack, out = False, "", []
    by_block = {(r.block, r.starts): r for r in pdf.itertuples()}
    for block in sorted(set(pdf["block"])):
        out.append((pdf["file"].iloc[0], block, quoted, stack))
        r = by_block[block, quoted]
        stack = stack[: max(0, len(stack) - r.closed)] + r.opened
        quoted = r.quoted
    return pd.DataFrame(out, columns=["file", "block", "quoted", "stack"])


def _objects(key: str):
    """Whole objects of each split (part 1), and fragments: the end of one begun before (0), the start of one that goes on (2), or all of a split within one (0, open)."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["file", "block", "part", "open", "value"]
        now, b, held, inside, first = None, None, [], False, True

        def ended() -> list:
            return [(*now, 0 if first else 2, True, ",".join(held))] if now and inside else []

        for pdf in frames:
            out = []
            for file, block, text, quoted, stack in zip(pdf["file"], pdf["block"], pdf["value"], pdf["quoted"], pdf["stack"], strict=True):
                if (file, block) != now:
                    out += ended()
                    now, b, held = (file, block), Brackets(key, bool(quoted), stack), []
                    inside = first = len(stack) > 2 and stack[:2] == "{E"
                at = 0
                for mark, place in b.marks(text):
                    depth = len(b.stack)
                    if not inside and mark == "{" and depth == 3 and b.stack[:2] == ["{", "E"]:
                        inside, first, at = True, False, place
                    elif inside and mark == "}" and depth == 2:
                        held.append(text[at : place + 1])
                        out.append((*now, 0 if first else 1, False, ",".join(held)))
                        inside, first, held = False, False, []
                if inside:
                    held.append(text[at:])
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(ended(), columns=columns)

    return work


def json_objects(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``value``: the text of each object in the array ``key`` of each document at ``path`` (a file, a folder or a pattern).

    A document is one file; its array stands at the root's ``key`` and holds objects. Other
    members of the root, and arrays of the same name further down, are passed over.
    Documents without the array, or with an empty one, give nothing.
    """
    pieces = spark.read.text(path, lineSep=",").select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value")
    told = pieces.mapInPandas(_summaries(key), "file string, block long, starts boolean, quoted boolean, closed int, opened string")
    starts = written(told.groupBy("file").applyInPandas(_starts, "file string, block long, quoted boolean, stack string"), "splits")
    found = pieces.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "value", "quoted", "stack")  # a row for each split
    found = written(found.mapInPandas(_objects(key), "file string, block long, part int, open boolean, value string"), "objects")
    crossing = found.where("part <> 1")
    # a fragment that goes on, and is not itself a continuation, begins an object; those after it belong to it
    order = Window.partitionBy("file").orderBy("block", "part")
    owner = F.last(F.when(F.col("part") == 2, F.col("block")), ignorenulls=True).over(order)
    joined = crossing.withColumn("owner", owner).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "part", "value"))).alias("parts"))
    return found.where("part = 1").select("value").unionByName(joined.select(F.array_join(F.col("parts.value"), ",").alias("value")))


def json_documents(rows: DataFrame, key: str, path: str) -> None:
    """Write objects (``value``: JSON text) as documents with the array ``key``, one a partition, as they come."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = f'{{"version": 1, "{key}": ['
        for pdf in frames:
            if len(pdf):
                lines = pdf["value"].tolist()
                yield pd.DataFrame({"value": [before + lines[0], *("," + x for x in lines[1:])]})
                before = ","
        yield pd.DataFrame({"value": ["]}" if before == "," else before + "]}"]})

    rows.select("value").mapInPandas(work, "value string").write.text(path)
