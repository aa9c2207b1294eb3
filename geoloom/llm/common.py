"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_folder, stage  # noqa: F401
from ..operators.staging import written as staged  # noqa: F401

#: Rows of whole texts handed to a Python worker at once.
TEXT_ROWS = 500
#: ASCII letters A-Z to a-z, all else unchanged.
LOWER_ASCII = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark from whatever store ``sf_dir`` names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z alone."""
    return text.lower() if text.isascii() else text.translate(LOWER_ASCII)


def map_batches(
    df: DataFrame,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    rows: int = TEXT_ROWS,
) -> DataFrame:
    """``mapInArrow`` in slices of ``rows`` rows, so a worker holds few whole texts beside what Spark sends it.

    Spark bounds what it sends by bytes; the session's settings are left as they are. A
    slice is a copy, so what was sent is free before more is read, and the system's
    allocator gives freed buffers back.
    """

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        for batch in batches:
            n = batch.num_rows
            for k in range(0, n, rows):
                yield batch.take(pa.array(range(k, min(k + rows, n)), pa.int64()))
            del batch

    return df.mapInArrow(lambda batches: work(sliced(batches)), schema)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with none of an operator's, and each column's new name."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def task_number() -> int:
    """The partition number of the running task (0 outside a task)."""
    context = TaskContext.get()
    return context.partitionId() if context else 0


def held_out(doc_id="doc_id"):
    """True for the rows no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def file_text(path: str) -> str:
    """A vocabulary file, read on the driver once; its content travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def chunked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut at ASCII white space, by Arrow: offsets of each text's chunks, their numbers, the distinct chunks."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def gathered(numbers: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenated values of the numbered items; item k owns ``sizes[k]`` values, in order."""
    starts = np.cumsum(sizes) - sizes
    n = sizes[numbers]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts[numbers] - (ends - n), n) + np.arange(ends[-1])]
