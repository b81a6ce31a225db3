"""URL filters: rules by host and path, and for URLs that none fits logistic regression on hashed character n-grams.

A URL's features are the n-grams of its host and of its path, with marks where each begins and ends, hashed to a fixed number
of buckets; each counts once a URL. The model is trained on the driver from a small labelled table, of at most a stated number
of distinct URLs a verdict; its weights go to the tasks, and their number is fixed. Where no labelled table is given, the
URLs that rules fit are one.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import cut, map_rows, table

#: The query's rules: host and the beginning of the path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Distinct labelled URLs of each verdict that the model sees, taken by the least hash.
SAMPLE = 4_000
GRAMS, BITS, RIDGE, STEPS, RATE = (2, 3, 4, 5), 18, 1.0, 200, 0.3


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits, null if none does. Rules are looked up by each domain
    that the host lies in, so their number doesn't count; of rules that are equally long the first in code-point order wins."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for rule_host, rule_path, verdict in rules:
        by_host.setdefault(rule_host, []).append((rule_path, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda h, p, v: F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
    known = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*[entry(h, *f) for f in found]))])
    labels = F.split(host, r"\.")
    domains = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    fitting = F.flatten(F.filter(F.transform(domains, lambda d: F.try_element_at(known, d)), lambda x: x.isNotNull()))
    best = F.array_min(F.filter(fitting, lambda x: F.startswith(path, x["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def grams(host: str, path: str) -> list[int]:
    """The buckets of a URL's n-grams, each once, in ascending order."""
    mask, found = (1 << BITS) - 1, set()
    for text in (f"h^{host}$", f"p^{path}$"):
        mark, data = text[:1].encode(), text[1:]
        for n in GRAMS:
            found.update(zlib.crc32(data[i : i + n].encode(), mark[0]) & mask for i in range(len(data) - n + 1))
    return sorted(found)


@dataclass(frozen=True)
class Model:
    """Weights of buckets, the last one the constant, for block."""

    weights: np.ndarray

    def blocked(self, host: str, path: str) -> float:
        return float(1 / (1 + np.exp(-self.weights[[*grams(host, path), len(self.weights) - 1]].sum())))


def fit(rows: list[tuple[str, str, str]]) -> Model:
    """Ridge logistic regression on (host, path, verdict), each verdict with half of the weight, by gradient steps scaled for
    each bucket. Without a row of each verdict all weights are 0, but the constant takes the side of the one there is."""
    size = (1 << BITS) + 1
    weights, block = np.zeros(size), np.array([v == "block" for *_, v in rows], float)
    if not len(rows) or block.min() == block.max():
        weights[-1] = 0.0 if not len(rows) else 1.0 if block[0] else -1.0
        return Model(weights)
    at = [[*grams(h, p), size - 1] for h, p, _ in rows]
    used, column = np.unique(np.concatenate(at), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
    share = np.where(block > 0, 0.5 / block.sum(), 0.5 / (1 - block).sum())
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-8)
    free = (used != size - 1) * RIDGE / len(rows)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.bincount(row, w[column], len(rows))))
        slope = np.bincount(column, ((p - block) * share)[row], len(used)) + free * w
        squares += slope**2
        w -= RATE * slope / np.sqrt(squares)
    weights[used] = w
    return Model(weights)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of labelled (host, path, verdict). Of each verdict `sample` distinct URLs at most are taken, those with the least
    hashes, so that a host with most of the rows has no more of the sample than of the distinct URLs."""
    rows = labelled.filter(F.col("verdict").isin("allow", "block")).select("host", "path", "verdict").distinct()
    order = Window.partitionBy("verdict", F.pmod("h", F.lit(64))).orderBy("h", "host", "path")
    rows = rows.withColumn("h", F.xxhash64("host", "path"))
    # the least hashes of 64 parts of each verdict, then of those the least: no task sorts a whole verdict
    least = cut(rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).drop("r"))
    last = Window.partitionBy("verdict").orderBy("h", "host", "path")
    found = least.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= sample).select("host", "path", "verdict").collect()
    return fit(sorted((r.host, r.path, r.verdict) for r in found))


def predicted(rows: DataFrame, model: Model) -> DataFrame:
    """rows (id, host, path) as (id, blocked), the probability that a URL is to be blocked."""
    weights = rows.sparkSession.sparkContext.broadcast(model.weights.astype(np.float64))

    def make():
        own = Model(weights.value)

        def step(batch: pa.RecordBatch) -> dict:
            hosts, paths = (batch.column(c).to_pylist() for c in ("host", "path"))
            return {"id": batch.column("id"), "host": batch.column("host"), "path": batch.column("path"), "blocked": [own.blocked(h, p) for h, p in zip(hosts, paths, strict=True)]}

        return step

    return map_rows(rows.select("id", "host", "path"), make, "id long, host string, path string, blocked double")


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked): each URL of pages (page_id, url) by the longest rule that fits, else by the
    model: block if its probability, `blocked` (null where a rule decides), is over a half.

    The model learns from labelled (url, verdict), or else from the URLs that rules fit. A null URL, or one without ://, has
    an empty host and path, which no rule fits; the model judges it by its constant and the marks. Repeated rows and null ids
    are judged each; without labels everything is allowed; an empty table gives no rows. URLs are read whole, however long.
    Other columns are never read.
    """
    rows = pages.select(F.col("page_id").alias("id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = cut(rows.withColumn("x", rule_for(F.col("host"), F.col("path"), rules)))
    if labelled is None:
        labelled = rows.filter(F.col("x").isNotNull()).select("host", "path", "x.verdict")
    else:
        labelled = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
    ruled = rows.filter(F.col("x").isNotNull()).select(F.col("id").alias("page_id"), "host", "path", "x.rule", "x.verdict", F.lit(None).cast("double").alias("blocked"))
    other = predicted(rows.filter(F.col("x").isNull()), train(labelled, sample))
    verdict = F.when(F.col("blocked") > 0.5, "block").otherwise("allow")
    return ruled.union(other.select("id", "host", "path", F.lit(None).cast("string"), verdict, "blocked"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL. Nulls, empty and long URLs, ties, repeated rows, empty tables and further columns are as
    `judge` defines them."""
    return judge(table(spark, sf_dir, "pages"))
