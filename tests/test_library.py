import datetime as dt
import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scholia.operators import artefacts
from scholia.sources import files, library

AT = dt.datetime(2024, 1, 1)
WORDS = "headword string, meaning string, first_seen timestamp"


def counted(spark, path):
    return {n: sorted(map(tuple, t.collect())) for n, t in library.read(spark, path).items()}


def test_bundle_becomes_visible_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "library")
    assert library.read(spark, path) == {}
    words = spark.createDataFrame([("a", "x", AT), ("b", "x", AT), (None, "lost", AT)], WORDS)
    papers = spark.createDataFrame([("p", "one"), ("q", "two")], "paper_id string, title string")
    assert library.ingest(spark, path, {"words": words, "papers": papers}, parts=4) == 1
    before = counted(spark, path)
    assert [w[0] for w in before["words"]] == ["a", "b"]

    fails = F.udf(lambda t: 1 / 0, "string")
    with pytest.raises(PySparkException):  # papers are written, words aren't, and nobody sees either
        library.ingest(spark, path, {"papers": papers.withColumn("title", F.lit("new")), "words": words.withColumn("meaning", fails("meaning"))})
    assert counted(spark, path) == before

    marks = "uid string, updated_at timestamp, event_id long, note string, deleted int"
    bundle = {
        "papers": papers.filter("paper_id = 'p'").withColumn("title", F.lit("new")),
        "figures": spark.createDataFrame([("p", "f.png", 3), ("p", "f.png", 3)], "paper_id string, file string, size long"),
        "words": spark.createDataFrame([("b", "y", AT + dt.timedelta(1)), ("c", "z", AT)], WORDS),
        "reviews": spark.createDataFrame([("u1", "a", 3), ("u2", "b", 4)], "uid string, headword string, rating int"),
        "marks": spark.createDataFrame([("m", AT, 1, "n", 0), ("m", AT, 2, "later, but a tie", 0)], marks),
    }
    for number in (2, 3):  # once more changes nothing
        assert library.ingest(spark, path, bundle) == number
        got = counted(spark, path)
        assert got["papers"] == [("p", "new"), ("q", "two")]
        assert got["figures"] == [("p", "f.png", 3)]
        assert [(w[0], w[1], w[-1]) for w in got["words"]] == [("a", "x", AT), ("b", "y", AT), ("c", "z", AT)]
        assert got["reviews"] == [("u1", "a", 3), ("u2", "b", 4)]
        assert [m[3] for m in got["marks"]] == ["n"]
    old = bundle["marks"].limit(1).withColumn("updated_at", F.lit(AT - dt.timedelta(1)))
    again = bundle["reviews"].withColumn("rating", F.lit(1)).union(spark.createDataFrame([("u3", "a", 2)], bundle["reviews"].schema))
    library.ingest(spark, path, {"reviews": again, "marks": old})
    got = counted(spark, path)
    assert got["reviews"] == [("u1", "a", 3), ("u2", "b", 4), ("u3", "a", 2)] and [m[3] for m in got["marks"]] == ["n"]


def test_only_touched_parts_are_written(spark, tmp_path):
    path = str(tmp_path / "library")
    rows = spark.range(400).select(F.col("id").cast("string").alias("paper_id"), F.lit("t").alias("title"))
    library.change(spark, path, {"papers": rows}, parts=16)
    first = library._last(spark, path)[2]["papers"]["folders"]
    library.change(spark, path, {"papers": rows.filter("paper_id = '7'").withColumn("title", F.lit("u"))})
    number, parts, tables = library._last(spark, path)
    moved = [k for k, f in tables["papers"]["folders"].items() if f != first[k]]
    assert (number, parts, len(first), len(moved)) == (2, 16, 16, 1)
    got = library.read(spark, path)["papers"]
    assert got.count() == 400 and [r.title for r in got.filter("paper_id = '7'").collect()] == ["u"]


def test_words_of_both(spark, tmp_path):
    path = str(tmp_path / "library")
    here = spark.createDataFrame([("a", "x", AT, AT, "phone"), ("b", "x", AT, None, "mac")], WORDS + ", last_seen timestamp, origin string")
    library.change(spark, path, {"words": here}, parts=2)
    library.ingest(spark, path, {"words": spark.createDataFrame([("a", "y", AT + dt.timedelta(2)), ("b", "y", AT)], WORDS)})
    got = {r.headword: (r.meaning, r.last_seen, r.origin) for r in library.read(spark, path)["words"].collect()}
    assert got == {"a": ("y", AT, "both"), "b": ("y", AT, "mac")}


def test_progress_of_one_learner_in_several_files(spark, tmp_path):
    reviews = spark.range(1000).select(F.when(F.col("id") < 900, 1).when(F.col("id") < 990, 2).alias("learner"),
        F.col("id").cast("string").alias("uid"), F.lit("w").alias("headword"), F.lit(3).alias("rating"), F.lit("2024-01-01").alias("reviewed_at"),
        F.when(F.col("id") % 10 > 0, "here").otherwise("there").alias("device"))
    docs = files.progress_documents({"reviews": reviews}, "learner", most=100)
    sizes = sorted((r.learner, len(r.reviews)) for r in docs.collect())
    assert sum(n for _, n in sizes) == 990 and [k for k, _ in sizes] == [1] * 9 + [2] and max(n for _, n in sizes) < 200
    lookups = reviews.filter("id % 100 = 5").select("learner", "uid", "headword", F.lit("m").alias("meaning"), F.col("reviewed_at").alias("looked_at"))
    files.write_progress("here", {"lookups": lookups, "reviews": reviews}, "learner", "2024-02-01", str(tmp_path / "p"))
    good, bad = files.read_progress(spark, str(tmp_path / "p"))
    assert bad.count() == 0 and good.count() == 2
    assert good.select(F.explode("reviews")).count() == 891 and good.select(F.explode("lookups")).count() == 10


def test_translations_are_kept_when_a_chunk_fails(spark, tmp_path):
    path, items = str(tmp_path / "cache"), spark.createDataFrame([(t,) for t in [*"abcdefghijklmnop", "a", "", None]], "text string")
    chunk = {r.text: r.c for r in items.select("text", artefacts.chunk_of(F.col("text"), 4).alias("c")).dropna().collect()}
    stop = sorted(set(chunk.values()))[2]
    with pytest.raises(PySparkException, match="away"):
        artefacts.translate_kept(items, path, lambda t: F.when(artefacts.chunk_of(t, 4) >= stop, F.raise_error(F.lit("away"))).otherwise(F.concat(t, t)), 4)
    kept = {r.text for r in spark.read.parquet(path).collect()}
    assert kept == {t for t, c in chunk.items() if c < stop} and kept
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def second(t):
        asked.add(1)
        return f"2{t}"

    assert artefacts.translate_kept(items, path, second, 4) == len({c for c in chunk.values() if c >= stop})
    assert asked.value == len(chunk) - len(kept)
    got = {r.text: r.translated for r in spark.read.parquet(path).collect()}
    assert got == {t: (t + t if t else "") if t in kept else f"2{t}" for t in chunk}
    assert artefacts.translate_kept(items, path, second, 4) == 0


@pytest.mark.parametrize("most", [500, 1])
def test_originals(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(files, "MOST_SIZES", most)
    root = tmp_path / ".papers"
    for name, content, age in [("new/a.pdf", "one", 30), ("old/b.PDF", "one", 10), ("c.pdf", "two", 5), (".d/e.pdf", "one", 1), ("f.pdf", "other", 2)]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
        os.utime(root / name, (1_700_000_000 + age, 1_700_000_000 + age))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    papers = [("p", 3, sha("one")), ("q", 3, sha("six")), ("r", 4, sha("two")), ("s", 5, sha("other")), ("t", None, None)]
    got = files.originals(spark, str(root), spark.createDataFrame(papers, "paper_id string, size long, sha string"))
    assert sorted((r.paper_id, r.path.rsplit("/", 1)[1], r.files) for r in got.collect()) == [("p", "b.PDF", 2), ("s", "f.pdf", 1)]
    none = spark.createDataFrame([], "paper_id string, size long, sha string")
    assert files.originals(spark, str(root), none).collect() == []
