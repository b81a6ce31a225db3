"""Bundles as stored zip archives: a data source that reads entries by the archives' directories, and a writer that commits.

    register(spark)
    rows.write.format("scholia_bundle").mode("append").save(folder)   # archive, entry, content
    spark.read.format("scholia_bundle").load(folder)                  # archive, entry, content, reason
    spark.read.format("scholia_bundle").option("archives", "a.zip,b.zip").option("entries", "papers/").load(folder)

The folder is one that the driver and all executors can open, as spark.checkpoint.dir is. Each archive is a partition, so
executors read their own. The options choose archives by name and entries by how they begin: others aren't opened or read.
(Conditions pushed down would, but in Spark 4.1 two scans of one Python source in a plan share what was pushed to either.) All of an archive's
entries are written by one task (`by_archive` deals them out), to a file of its own beside the old one; the commit puts all
new files in place of the old, and where a task fails all old ones stay.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "archive string, entry string, content binary, reason string"
#: What a bundle's manifest says it is, and its version.
KIND, VERSION, MANIFEST = "scholia_bundle", 1, "manifest.json"


def _local(path: str) -> str:
    """A path without file:, which Python doesn't know."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


@dataclass(frozen=True)
class Archive(InputPartition):
    name: str


@dataclass(frozen=True)
class Written(WriterCommitMessage):
    files: tuple[tuple[str, str], ...]  # where a file lies, and its archive


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scholia_bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> BundleReader:
        names = self.options.get("archives")
        return BundleReader(_local(self.options["path"]), frozenset(names.split(",")) if names else None, self.options.get("entries", ""))

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(_local(self.options["path"]), schema.names)


class BundleReader(DataSourceReader):
    def __init__(self, folder: str, archives: frozenset[str] | None = None, entries: str = ""):
        self.folder, self.archives, self.entries = folder, archives, entries

    def partitions(self) -> list[Archive]:
        names = sorted(x for x in os.listdir(self.folder) if x.endswith(".zip") and not x.startswith((".", "_")))
        return [Archive(x) for x in names if self.archives is None or x in self.archives]

    def read(self, partition: Archive) -> Iterator[tuple]:
        """Entry by entry; what can't be read gives a row with a reason: directory (of the archive; no entry), compressed (only
        stored entries are read) or checksum."""
        try:
            with zipfile.ZipFile(f"{self.folder}/{partition.name}") as archive:
                for info in archive.infolist():
                    if not info.filename.startswith(self.entries):
                        continue
                    if info.compress_type != zipfile.ZIP_STORED:
                        yield partition.name, info.filename, None, "compressed"
                        continue
                    try:
                        yield partition.name, info.filename, archive.read(info), None
                    except (zipfile.BadZipFile, EOFError, zlib.error):
                        yield partition.name, info.filename, None, "checksum"
        except (zipfile.BadZipFile, OSError):
            yield partition.name, None, None, "directory"


class BundleWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.at = folder, [names.index(c) for c in ("archive", "entry", "content")]
        os.makedirs(folder, exist_ok=True)

    def write(self, iterator: Iterator) -> Written:
        """Rows of one archive after the other; a task that fails leaves nothing."""
        done: list[tuple[str, str]] = []
        archive, last = None, None
        try:
            for row in iterator:
                name, entry, content = (row[i] for i in self.at)
                if name != last:
                    if archive is not None:
                        archive.close()
                    if any(name == had for _, had in done):
                        raise ValueError(f"the entries of {name} don't come together")
                    done.append((f"{self.folder}/.{uuid.uuid4().hex}.part", name))
                    archive, last = zipfile.ZipFile(done[-1][0], "w", zipfile.ZIP_STORED), name
                archive.writestr(zipfile.ZipInfo(entry), bytes(content or b""))
            if archive is not None:
                archive.close()
        except BaseException:
            _remove(done)
            raise
        return Written(tuple(done))

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        if len({name for _, name in files}) < len(files):
            self.abort(messages)
            raise ValueError("two tasks wrote one archive")
        for at, name in files:
            os.replace(at, f"{self.folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                _remove(m.files)


def _remove(files) -> None:
    for at, _ in files:
        if os.path.exists(at):
            os.remove(at)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(BundleSource)


def by_archive(rows: DataFrame) -> DataFrame:
    """rows (archive, entry, content) dealt out and sorted as the writer needs them."""
    return rows.select("archive", "entry", "content").repartition("archive").sortWithinPartitions("archive", "entry")


def with_manifests(rows: DataFrame, created_at: str) -> DataFrame:
    """rows (archive, entry, content) and for each archive a manifest that names its papers: one archive's papers bound it."""
    paper = F.regexp_extract("entry", r"^papers/([^/]+)/", 1)
    named = rows.groupBy("archive").agg(F.array_sort(F.collect_set(F.nullif(paper, F.lit("")))).alias("papers"))
    body = F.to_json(F.struct(F.lit(KIND).alias("kind"), F.lit(VERSION).alias("version"), F.lit(created_at).alias("created_at"), "papers"))
    return rows.select("archive", "entry", "content").unionByName(named.select("archive", F.lit(MANIFEST).alias("entry"), body.cast("binary").alias("content")))


def rejects(found: DataFrame) -> DataFrame:
    """(archive, entry, reason) of what is wrong with the archives that were read: directory, compressed, checksum, manifest (none,
    or one that isn't JSON), kind, version, paper (one that the manifest names has no entry)."""
    archives = found.select("archive").distinct()
    manifest = found.filter((F.col("entry") == MANIFEST) & F.col("content").isNotNull()).select("archive", F.from_json(F.col("content").cast("string"), "kind string, version int, papers array<string>").alias("m"))
    each = archives.join(manifest, "archive", "left").join(found.filter("reason = 'directory'").select("archive"), "archive", "left_anti")
    reason = F.when(F.col("m.kind").isNull() & F.col("m.version").isNull(), "manifest").when(~F.col("m.kind").eqNullSafe(F.lit(KIND)), "kind").when(~F.col("m.version").eqNullSafe(F.lit(VERSION)), "version")
    whole = each.select("archive", F.lit(MANIFEST).alias("entry"), reason.alias("reason")).filter("reason is not null")
    paper = F.regexp_extract("entry", r"^papers/([^/]+)/", 1)
    has = found.filter("content is not null").select("archive", paper.alias("paper")).distinct()
    gone = each.select("archive", F.explode("m.papers").alias("paper")).join(has, ["archive", "paper"], "left_anti")
    gone = gone.select("archive", F.concat(F.lit("papers/"), "paper", F.lit("/")).alias("entry"), F.lit("paper").alias("reason"))
    return found.filter("reason is not null").select("archive", "entry", "reason").unionByName(whole).unionByName(gone)
