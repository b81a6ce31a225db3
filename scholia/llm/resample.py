"""Target-distribution importance resampling, without exploding a text's features where it is scored.

A document's features, runs of one and two words, are hashed into buckets by higher-order functions that turn its text into
one array, which is stored. Corpus and target are counted by bucket: each task adds up its own counts first, so that only totals are shuffled,
at most a row a bucket from each task. The gains of all buckets (their number is fixed) become one literal array, in which
a document's buckets are looked up while its gains are summed. A draw without replacement is made by the Gumbel trick: a
score is the document's mean gain plus noise from a hash of its id, and the highest scores are drawn.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import cut, table
from scholia.operators.papers import ranked
from scholia.sources.stored import stored

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: A word: digits, ASCII letters, and all beyond ASCII.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)  # there lower() is the same, and faster
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def buckets(found: Column) -> Column:
    """The buckets of all features of an array of words: those of single words, then those of neighbours."""
    bucket = lambda x: (F.crc32(x) % BUCKETS).cast("int")
    but_last = F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0)))
    return F.concat(F.transform(found, bucket), F.transform(but_last, lambda x, i: bucket(F.concat(x, F.lit(" "), F.get(found, i + 1)))))


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x: (n_words, buckets)) of docs (doc_id, text). The words are bound by a transform over an array of one, or
    they would be found again for each use."""
    each = F.transform(F.array(words(F.col("text"))), lambda w: F.struct(F.size(w).alias("n_words"), buckets(w).alias("buckets")))
    return docs.select("doc_id", each[0].alias("x"))


def counts(features: DataFrame) -> DataFrame:
    """(bucket, n) over all of features; buckets without a feature are missing. Tasks add up their own counts first."""
    return features.select(F.explode("x.buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> list[int]:
    """The gain of each bucket, from the counts of corpus and target: the logarithm of how much more of the target's features
    fall into it, with one more feature in each bucket, in thousandths and rounded down."""
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    every = corpus.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    held = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    sums = F.broadcast(total(corpus).select(F.col("n").alias("all_s")).join(total(target).select(F.col("n").alias("all_t"))))  # one row
    more = lambda c, k: F.coalesce(c, F.lit(0)).cast("double") + k
    ratio = more(F.col("t"), 1) * more(F.col("all_s"), BUCKETS) / (more(F.col("s"), 1) * more(F.col("all_t"), BUCKETS))
    rows = held.join(sums).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows, key=lambda r: r.bucket)]


def scored(features: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of features."""
    by_bucket = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    total = F.aggregate("x.buckets", F.lit(0).cast("long"), lambda x, b: x + F.element_at(by_bucket, b + 1)).cast("double")
    n, id_ = F.size("x.buckets").cast("long"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    weight = F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), id_), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((place + 0.5) / 4294967296.0)))
    rows = features.select("doc_id", F.col("x.n_words").cast("long").alias("n_words"), n.alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    return rows.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): docs (doc_id, text) scored by how like target's texts (text) they are; of the N
    rows with at least least_words words the floor(percent * N / 100) with the highest scores have a rank, from 1.

    Null and empty texts have no features and weigh 0; a null id takes its noise from the empty string and comes last
    among equal scores. Repeated rows are each scored, counted and drawn; rows of one id and one score are ordered by their
    features and weight. Empty tables give no rows; without a target all its counts are 0. Other columns are never read.
    Scores are whole numbers of a bounded range: their counts find the score at the cut, and only rows at or above it
    are sorted, by a range exchange.
    """
    features = stored(featured(docs))  # texts are read and hashed once
    rows = cut(scored(features, gains(cut(counts(features)), cut(counts(featured(target.select(F.lit(0).alias("doc_id"), "text")))))))
    able = rows.filter(F.col("n_words") >= least_words)
    by_score = able.groupBy("score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("score")))
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    at = by_score.select("score", above.alias("above"), drawn.alias("drawn")).filter("above >= drawn").orderBy(F.desc("score")).first()
    names = ["doc_id", "n_features", "weight", "score"]
    if at is None or not at.drawn:
        return rows.select(*names, F.lit(None).cast("long").alias("rank"))
    high = F.coalesce((F.col("n_words") >= least_words) & (F.col("score") >= at.score), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]
    top = ranked(rows.filter(high).select(*names), *order).withColumn("place", F.col("place").cast("long"))
    top = top.select(*names, F.when(F.col("place") <= at.drawn, F.col("place")).alias("rank"))
    return top.union(rows.filter(~high).select(*names, F.lit(None).cast("long")))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by likeness to the benchmark, a quarter of the longer ones drawn. Nulls, empty and long texts,
    ties, repeated rows, empty tables and further columns are as `resample` defines them."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a string's UTF-8 bytes, four bits at a time by a table of 16 made from the polynomial."""
    entries = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        entries.append(x)
    step = lambda x: f"xor(({x}) >> 4, {entries}[((({x}) & 15) + 1)::INT])"
    codes = f"list_transform(range(1, length(hex({text})) + 1, 2), lambda i: CAST('0x' || substr(hex({text}), i, 2) AS BIGINT))"
    folded = f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {step(step('xor(c, b)'))})"
    return f"xor({folded}, 4294967295::BIGINT)"


def _features_sql(name: str) -> str:
    rows = {"documents": "SELECT row_number() OVER () AS r, doc_id, text FROM documents", "benchmark": "SELECT row_number() OVER () AS r, text FROM benchmark"}[name]
    lower = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    split = rf"list_filter(regexp_split_to_array({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"SELECT * EXCLUDE (text), w, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT *, {split} AS w FROM ({rows}))"


ORACLE = rf"""
WITH d AS MATERIALIZED ({_features_sql("documents")}), t AS MATERIALIZED ({_features_sql("benchmark")}),
df AS MATERIALIZED (SELECT r, unnest(f) AS x FROM d), tf AS MATERIALIZED (SELECT unnest(f) AS x FROM t),
hashed AS MATERIALIZED (SELECT x, {crc32_sql("x")} % {BUCKETS} AS b FROM (SELECT x FROM df UNION SELECT x FROM tf)),
s AS (SELECT b, count(*) AS n FROM df JOIN hashed USING (x) GROUP BY b), u AS (SELECT b, count(*) AS n FROM tf JOIN hashed USING (x) GROUP BY b),
g AS MATERIALIZED (SELECT b.b, floor(1000 * ln((coalesce(u.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM s), 0) + {BUCKETS})::DOUBLE
  / ((coalesce(s.n, 0) + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM u), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT unnest(range({BUCKETS})) AS b) b LEFT JOIN s ON s.b = b.b LEFT JOIN u ON u.b = b.b),
w AS (SELECT r, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN hashed USING (x) JOIN g USING (b) GROUP BY r),
z AS (SELECT doc_id, len(w) AS n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
q AS (SELECT *, n_words >= {LEAST_WORDS} AS able, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT {PERCENT} * count(*) // 100 FROM z WHERE n_words >= {LEAST_WORDS}) THEN place END::BIGINT AS rank FROM q
"""
