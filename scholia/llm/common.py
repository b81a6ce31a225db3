"""What the training-data operators share: reading tables, shared storage, Arrow-batch mapping."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scholia.sources.stored import shared_folder

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package from where it lies. On a cluster the package comes with
    the job (--py-files, or installed on the executors)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and written to the shared folder, so that a lost executor costs a re-read only."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict] | dict]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: `make()` runs once a task, what it returns gets each batch and gives columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                columns = step(batch)
                yield pa.RecordBatch.from_arrays([_array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, struct)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
