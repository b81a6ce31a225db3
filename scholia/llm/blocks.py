"""A stated query set against all rows, in blocks: rows are packed into blocks of bounded size, and each block of rows meets
each block of queries once, as a pair of byte strings."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import map_arrow


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as found:
        return {k: found[k] for k in found.files}


def pairs(rows: DataFrame, queries: DataFrame, run: Callable[[dict, dict], pa.RecordBatch | None], schema: str,
        end: Callable[[], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """`run` on each pair of a row block and a query block (both: payload binary), and `end` when a task has had its pairs. A
    block of rows is unpacked once for the query blocks that follow it."""
    both = rows.select(F.col("payload").alias("r"), F.xxhash64("payload").alias("k")).crossJoin(queries.select(F.col("payload").alias("q")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, block = None, {}
        for batch in batches:
            for r, k, q in zip(*batch.columns, strict=True):
                if k.as_py() != last:
                    last, block = k.as_py(), load(r.as_py())
                if (out := run(block, load(q.as_py()))) is not None and out.num_rows:
                    yield out
        if end is not None:
            yield from end()

    return map_arrow(both, each, schema)
