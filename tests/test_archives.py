"""Bundle archives: round trip, pruning, damage, and writes that fail."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from scholia.sources import archives, adapters

ROWS = "archive string, entry string, content binary"


@pytest.fixture
def folder(spark, sf, tmp_path):
    adapters.table(spark, sf, "region")  # lets Python workers import the package
    archives.register(spark)
    return str(tmp_path / "bundles")


def put(spark, folder, rows):
    df = archives.with_manifests(spark.createDataFrame(rows, ROWS), "now")
    archives.by_archive(df).write.format("scholia_bundle").mode("append").save(folder)


def load(spark, folder):
    return spark.read.format("scholia_bundle").load(folder)


FIRST = [("a.zip", "papers/p1/meta.json", b"{}"), ("a.zip", "papers/p2/meta.json", b"[1]"), ("b.zip", "papers/p3/meta.json", b""), ("b.zip", "vocab.json", None)]


def test_round_trip_and_pruning(spark, folder):
    put(spark, folder, FIRST)
    got = {(r.archive, r.entry): bytes(r.content) for r in load(spark, folder).filter(f"entry <> '{archives.MANIFEST}'").collect()}
    assert got == {(a, e): c or b"" for a, e, c in FIRST}
    assert sorted(os.listdir(folder)) == ["a.zip", "b.zip"]
    assert zipfile.ZipFile(f"{folder}/a.zip").testzip() is None
    open(f"{folder}/c.zip", "wb").write(b"no archive")  # with the options below it is never opened
    few = spark.read.format("scholia_bundle").option("archives", "a.zip,d.zip").option("entries", "papers/p2").load(folder)
    assert [(r.entry, bytes(r.content)) for r in few.collect()] == [("papers/p2/meta.json", b"[1]")]
    assert few.rdd.getNumPartitions() == 1
    assert archives.rejects(load(spark, folder)).collect() == [("c.zip", None, "directory")]


def test_rejects(spark, folder):
    put(spark, folder, FIRST)
    data = open(f"{folder}/a.zip", "rb").read()
    open(f"{folder}/cut.zip", "wb").write(data[:-30])
    at = data.index(b"[1]")
    open(f"{folder}/flipped.zip", "wb").write(data[:at] + b"[2]" + data[at + 3 :])
    for name, body in (("other.zip", '{"kind":"x","version":1}'), ("new.zip", '{"kind":"scholia_bundle","version":9}'), ("less.zip", '{"kind":"scholia_bundle","version":1,"papers":["q"]}'), ("bad.zip", "{")):
        with zipfile.ZipFile(f"{folder}/{name}", "w") as z:
            z.writestr(archives.MANIFEST, body)
    with zipfile.ZipFile(f"{folder}/none.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("vocab.json", "{}" * 99)
    got = {tuple(r) for r in archives.rejects(load(spark, folder)).collect()}
    assert got == {
        ("cut.zip", None, "directory"), ("flipped.zip", "papers/p2/meta.json", "checksum"), ("flipped.zip", "papers/p2/", "paper"), ("other.zip", "manifest.json", "kind"), ("new.zip", "manifest.json", "version"),
        ("less.zip", "papers/q/", "paper"), ("bad.zip", "manifest.json", "manifest"), ("none.zip", "vocab.json", "compressed"), ("none.zip", "manifest.json", "manifest"),
    }


def test_failed_write_leaves_the_old_bundle(spark, folder):
    put(spark, folder, FIRST)
    before = {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder)}
    fail = F.udf(lambda e: 1 / 0 if "p9" in e else e.encode(), "binary")
    rows = spark.createDataFrame([("a.zip", "papers/p1/new.json"), ("b.zip", "papers/p9/meta.json")], "archive string, entry string")
    with pytest.raises(Exception):  # noqa: B017  Spark's, of whatever kind
        archives.by_archive(rows.withColumn("content", fail("entry"))).write.format("scholia_bundle").mode("append").save(folder)
    assert {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder)} == before
    apart = spark.createDataFrame([("a.zip", "x", b"1"), ("b.zip", "y", b"1"), ("a.zip", "z", b"1")], ROWS).repartition(1)
    with pytest.raises(Exception, match="together"):
        apart.write.format("scholia_bundle").mode("append").save(folder)
    assert {f: open(f"{folder}/{f}", "rb").read() for f in os.listdir(folder)} == before
    put(spark, folder, [("a.zip", "papers/p4/meta.json", b"{}")])
    assert {r.entry for r in load(spark, folder).filter("archive = 'a.zip'").collect()} == {"papers/p4/meta.json", archives.MANIFEST}
