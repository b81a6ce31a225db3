"""A library: keyed tables of which several change at once, so that a reader sees all of a change or nothing of it.

A table lies in parts, by a hash of its key, each of which is a few Parquet folders. A version is one line of the log; it
names the folders of all tables. A change writes new folders and then its line, so what a failed change leaves is never
read. Only the parts that a change touches are read and written. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholia.operators import logs
from scholia.sources.stored import stored

#: Parts of a table, unless its library says otherwise. A library's number never changes.
PARTS = 64
#: The tables of a library and their keys.
KEYS = {"papers": ["paper_id"], "figures": ["paper_id", "file"], "words": ["headword"], "reviews": ["uid"], "marks": ["uid"]}


def _last(spark: SparkSession, path: str) -> tuple[int, int, dict]:
    """(number, parts, tables) of the last version: a table is its schema and a list of folders for each part."""
    try:
        row = spark.read.schema("number long, parts int, tables string").json(f"{path}/log").orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        row = None
    return (row.number, row.parts, json.loads(row.tables)) if row else (0, 0, {})


def _read(spark: SparkSession, path: str, table: dict, parts: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(table["schema"])
    found = [f"{path}/{f}" for k, fs in table["folders"].items() if parts is None or int(k) in parts for f in fs]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the last version, by name; none where there is no library."""
    return {name: _read(spark, path, table) for name, table in _last(spark, path)[2].items()}


def change(spark: SparkSession, path: str, rows: dict[str, DataFrame], keep: tuple[str, ...] = ("reviews",), parts: int = PARTS) -> int:
    """Puts rows into the tables of the same names, all as one version, whose number is given back. A row replaces that with its
    key, but in the tables of `keep`, append-only logs, the row that is there stays. Rows that lack a part of their key are
    passed over; of rows that share one, one counts. Tables that a library lacks begin with these rows and their columns."""
    number, had, tables = _last(spark, path)
    parts, home = had or parts, f"{number + 1:08d}-{uuid.uuid4().hex}"
    for name, df in rows.items():
        key = KEYS[name]
        table = tables.setdefault(name, {"schema": json.loads(df.schema.json()), "folders": {}})
        columns = StructType.fromJson(table["schema"]).names
        part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
        new = stored(df.select(*columns).dropna(subset=key).dropDuplicates(key).withColumn("_part", part))
        old = _read(spark, path, table, _numbers(new))
        if name in keep:
            new = stored(new.join(old.select(*key), key, "left_anti"))
            written, before = new, table["folders"]
        else:
            written, before = new.unionByName(old.join(new.select(*key), key, "left_anti").withColumn("_part", part)), {}
        written.select(*columns, "_part").write.partitionBy("_part").parquet(f"{path}/{home}/{name}")
        for k in map(str, _numbers(new)):
            table["folders"][k] = [*before.get(k, []), f"{home}/{name}/_part={k}"]
    line = spark.createDataFrame([(number + 1, parts, json.dumps(tables))], "number long, parts int, tables string")
    line.coalesce(1).write.mode("append").json(f"{path}/log")
    return number + 1



def _numbers(rows: DataFrame) -> list[int]:
    return [r._part for r in rows.select("_part").distinct().collect()]  # as many as a library has parts, at most


def ingest(spark: SparkSession, path: str, bundle: dict[str, DataFrame], here: str = "phone", there: str = "mac", parts: int = PARTS) -> int:
    """Takes a bundle's tables into a library, as one version. Papers (paper_id, ...) and figures (paper_id, file, ...) replace
    those with their keys; words (headword, ..., first_seen, last_seen, origin) too, but come from both where the library has
    them from `here`, else from `there`, and keep the time at which they were last seen; of reviews (uid, ...) only new ones
    are added; marks (uid, updated_at, event_id, deleted, ...) replace older ones only (see `logs.merge_state`)."""
    had, rows = read(spark, path), dict(bundle)
    if "words" in rows:
        w = rows["words"].withColumn("origin", F.lit(there)).withColumn("last_seen", F.col("first_seen"))
        if "words" in had:
            old = had["words"].select("headword", F.col("origin").alias("_from"), F.col("last_seen").alias("_seen"))
            both = F.coalesce(F.col("_from") == here, F.lit(False))
            w = w.join(old, "headword", "left").withColumns({"origin": F.when(both, "both").otherwise(there),
                "last_seen": F.coalesce("_seen", "first_seen")}).drop("_from", "_seen")
        rows["words"] = w
    if "marks" in rows:
        rows["marks"] = logs.merge_state(had.get("marks", rows["marks"].limit(0)), rows["marks"], "uid", [])
    return change(spark, path, rows, parts=parts)
