"""Incremental artefacts: fingerprints of documents, content-addressed caches, what is left to do and what can go."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.sources.stored import shared_folder


def fingerprint(items: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, items_hash): SHA-1 of a document's ordered items. Items are hashed first, so that the array holds 40 characters
    an item whatever its length; a document's items are what bounds it."""
    rows = items.select(key, order, F.sha1(F.col(text).cast("binary")).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct(order, "h")))
    return rows.groupBy(key).agg(F.sha1(F.array_join(F.transform(ordered, lambda x: x["h"]), ",").cast("binary")).alias("items_hash"))


def stale(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Keys whose stored fingerprint is missing or differs."""
    return now.join(stored.select(key, F.col("items_hash").alias("old")), key,
        "left").filter(~F.col("items_hash").eqNullSafe(F.col("old"))).select(key, "items_hash")


def current(now: DataFrame, stored: DataFrame, key: str, version: str) -> DataFrame:
    """(key, upgraded) of what is up to date: fingerprints (now: key, items_hash) that stored (key, items_hash, state, version,
    manual) has; or what was done by this version before fingerprints were kept, and not edited since, which gets its
    fingerprint now."""
    both = now.join(stored.select(key, F.col("items_hash").alias("old"), "state", "version", "manual"), key)
    legacy = F.col("old").isNull() & (F.col("state") == "done") & (F.col("version") == version) & ~F.coalesce("manual", F.lit(False))
    return both.filter((F.col("items_hash") == F.col("old")) | legacy).select(key, F.col("old").isNull().alias("upgraded"))


def translated(items: DataFrame, cache: DataFrame, translator) -> DataFrame:
    """(text, translated) of the distinct texts of items: from the cache (text, translated), and what it lacks by the translator,
    a function of a Column (a vectorised UDF, say). A text that comes back as it was has no translation."""
    new = _called(todo(items, cache, "text"), translator)
    return in_use(cache.select("text", "translated"), items, "text").unionByName(new)


def translate_kept(items: DataFrame, path: str, translator, chunks: int = 8) -> int:
    """Translates the distinct texts of items that the cache at path (Parquet: text, translated) lacks, in chunks by a hash of the
    text, each added to the cache as it is done. Where a chunk fails, the error is raised and what was done before stays: the
    next run finds it in the cache and calls the translator only for the rest. Gives the number of chunks done. A chunk is
    a Spark job over its share of the texts; items without a text are passed over, and as in `translated` a text that
    comes back as it was has no translation."""
    spark = items.sparkSession
    try:
        cache = spark.read.schema("text string, translated string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], "text string, translated string")
    rest = todo(items.filter(F.col("text").isNotNull()), cache, "text").withColumn("chunk", chunk_of(F.col("text"), chunks))
    rest.write.partitionBy("chunk").parquet(place := f"{shared_folder(spark)}/todo-{uuid.uuid4().hex}")
    rest = spark.read.schema("text string, chunk int").parquet(place)
    numbers = sorted(r.chunk for r in rest.select("chunk").distinct().collect())  # `chunks` at most
    for n in numbers:
        _called(rest.filter(F.col("chunk") == n).select("text"), translator).write.mode("append").parquet(path)
    return len(numbers)


def chunk_of(text: Column, chunks: int) -> Column:
    """A text's chunk: the first eight hex digits of its MD5 modulo the number of chunks."""
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(chunks)).cast("int")


def _called(texts: DataFrame, translator) -> DataFrame:
    new = texts.select("text", translator(F.col("text")).alias("translated"))
    return new.withColumn("translated", F.when(F.lower(F.trim("translated")) != F.lower(F.trim("text")), F.col("translated")).otherwise(""))


def todo(items: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """Distinct texts that the cache (text) lacks."""
    return items.select(text).distinct().join(cache.select(text), text, "left_anti")


def in_use(cache: DataFrame, items: DataFrame, text: str) -> DataFrame:
    """The cache without what no item uses."""
    return cache.join(items.select(text), text, "left_semi")
