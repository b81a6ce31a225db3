"""Toxicity: severity by a cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - t_k): one weight vector for all grades and rising thresholds t_1 < t_2 < ...; the
severity is the expected grade, the sum of these probabilities. x counts a text's distinct words by hashed features: the
word itself and its first four to six letters, so that other endings of a word are known by its stem. Features that tell
for and against alike take part; a ridge and a lasso penalty choose among them.

The labels are 0 and 1. A toxic text's grade, 1 or 2, comes from a model that hasn't seen it: the sample is halved, each
half is scored by a binary model of the other, and grade 2 is a margin above the median of the half's toxic texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import map_arrow, map_rows, table
from scholia.sources.stored import stored

#: Hashed features, and texts of a class that must have one for it to take part: five, and this share.
SPACE, LEAST, SHARE = 1 << 22, 5, 0.005
#: Labelled rows that the fit reads of each class, at most.
SAMPLE = {1: 2000, 0: 2000}
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself, and its beginnings of 4 to 6 letters."""
    parts = ["=" + word] + [word[:n] for n in (4, 5, 6) if len(word) >= n]
    return [zlib.crc32(p.encode()) % SPACE for p in parts]


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class OrdinalModel:
    """Weights by feature and the thresholds of grades 1, 2, ...; without thresholds every severity is 0."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, z: float) -> list[float]:
        return [1 / (1 + float(np.exp(np.clip(t - z, -40, 40)))) for t in self.thresholds]


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 150, ridge: float = 1.0, lasso: float = 1.0) -> OrdinalModel:
    """Fits weights and thresholds to feature lists (a feature repeats for each word that has it) and whole grades from 0.

    The lowest grade weighs as much as all others. The penalties are those of a log loss summed over the rows. Fewer than two grades give the empty
    model.
    """
    grades = np.asarray(grades)
    if len(grades) == 0 or grades.min() == grades.max():
        return OrdinalModel()
    own = [np.unique(r, return_counts=True) for r in rows]
    ids, col = np.unique(np.concatenate([u for u, _ in own]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(u) for u, _ in own])
    value = np.log1p(np.concatenate([n for _, n in own]))
    by_col = np.argsort(col, kind="stable")  # the same entries in the order of features
    row_of, value_of = row[by_col], value[by_col]
    row_at, col_at = np.searchsorted(row, np.arange(len(rows))), np.searchsorted(col[by_col], np.arange(len(ids)))
    filled = np.array([len(u) > 0 for u, _ in own])
    steps, total = int(grades.max()), len(rows)
    at_least = grades[:, None] >= np.arange(1, steps + 1)
    clean = (grades == grades.min()).mean()
    weight = np.where(grades == grades.min(), 0.5 / clean, 0.5 / (1 - clean))[:, None]
    w, first, gaps = np.zeros(len(ids)), 0.0, np.zeros(steps - 1)  # thresholds: first, then rising by exp(gaps)
    state = [np.zeros(len(ids) + steps), np.zeros(len(ids) + steps)]
    for k in range(1, rounds + 1):  # proximal Adam on the mean log loss of the binary events grade >= k
        t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = np.where(filled, np.add.reduceat(np.append(w[col] * value, 0.0), row_at), 0.0)[:, None] - t
        e = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - at_least) / total
        gt = -e.sum(0)
        gg = np.exp(gaps) * np.array([gt[i + 1 :].sum() for i in range(steps - 1)])
        g = np.concatenate([np.add.reduceat(e.sum(1)[row_of] * value_of, col_at) + ridge * w / total, [gt.sum()], gg])
        state = [0.9 * state[0] + 0.1 * g, 0.999 * state[1] + 0.001 * g * g]
        pace = 0.1 / (np.sqrt(state[1] / (1 - 0.999**k)) + 1e-9)
        move = pace * state[0] / (1 - 0.9**k)
        w, first, gaps = w - move[: len(ids)], first - move[len(ids)], gaps - move[len(ids) + 1 :]
        w = np.sign(w) * np.maximum(np.abs(w) - pace[: len(ids)] * lasso / total, 0)
    t = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    return OrdinalModel({f: x for f, x in zip(ids.tolist(), w.tolist(), strict=True) if x}, t.tolist())


def margin(model: OrdinalModel, row: np.ndarray) -> float:
    """w . x of a feature list."""
    return sum(model.weights.get(f, 0.0) * float(np.log1p(n)) for f, n in zip(*(x.tolist() for x in np.unique(row, return_counts=True)), strict=True))


def grade(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Severity grades from 0/1 labels: clean 0; a toxic text 2 where a binary model of the other half of the rows gives it a
    margin above the median of its half's toxic texts, else 1."""
    toxic = np.asarray(toxic)
    half, out = np.arange(len(rows)) % 2, toxic.copy()
    for h in (0, 1):
        mine = np.flatnonzero((half == h) & (toxic == 1))
        other = np.flatnonzero(half != h)
        if len(mine):
            model = fit([rows[i] for i in other], toxic[other])
            z = np.array([margin(model, rows[i]) for i in mine])
            out[mine[z > np.median(z)]] = 2
    return out


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] = SAMPLE) -> OrdinalModel:
    """Fits the model on at most sample[c] labelled documents of each class c, chosen by a hash of the id; a document with both
    labels is toxic, and texts with equal words count once. Features are counted where the texts are; those of the chosen
    texts that have support reach the driver. Null labels, ids and texts are passed over."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    places, chosen = 1_000_003, F.lit(False)
    for c, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == c) & (F.pmod(F.xxhash64("doc_id"), F.lit(places)) < int(places * min(1.0, sample[c] / n)) + 1))
    # written first, so that Spark knows how small it is
    rows = docs.select("doc_id", "text").filter("text is not null").join(stored(labels.filter(chosen)), "doc_id")

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            found = [sorted(f for w in words(t) for f in word_features(w)) for t in batch.column("text").to_pylist()]
            return {"toxic": batch.column("toxic"), "x": found}

        return step

    found = map_rows(rows.select("text", "toxic"), make, "toxic int, x array<int>").withColumn("key",
        F.xxhash64("x")).dropDuplicates(["toxic", "key"])
    found = stored(found)
    rows = found.filter("toxic = 1").orderBy("key").limit(sample[1]).union(found.filter("toxic = 0").orderBy("key").limit(sample[0]))
    rows = stored(rows)
    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return OrdinalModel()
    seen = rows.select("toxic", F.explode(F.array_distinct("x")).alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"),
        F.sum(1 - F.col("toxic")).alias("b"))
    often = (F.col("a") >= max(LEAST, SHARE * total[1])) | (F.col("b") >= max(LEAST, SHARE * total[0]))
    kept = np.sort(seen.filter(often).select("f").toArrow()["f"].to_numpy().astype(np.int64))

    def only(batches):
        known = np.zeros(SPACE, bool)
        known[kept] = True
        for batch in batches:
            lists = [np.asarray(x.values) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[known[x]].astype("<i4").tobytes()
                for x in lists], pa.binary())], names=["toxic", "key", "x"])

    got = map_arrow(rows.select("toxic", "x", "key"), only, "toxic int, key long, x binary").toArrow().sort_by([("toxic",
         "ascending"), ("key", "ascending")])
    x = [np.frombuffer(b.as_py(), "<i4").astype(np.int64) for b in got["x"]]
    return fit(x, grade(x, got["toxic"].to_numpy().astype(np.int64)))


def _scorer(model: OrdinalModel, keep: int = 500_000):
    """What gives a text's probabilities. Words are looked at once: those with a weighed feature and those without are kept
    apart, so that most words of a text cost a set operation."""
    features: dict[str, list[int]] = {}
    live: set[str] = set()
    dead: set[str] = set()

    def score(text: str | None) -> list[float]:
        own = words(text)
        for w in own - dead - live:  # sets on both sides: what is iterated is the smaller one
            if found := [f for f in word_features(w) if f in model.weights]:
                features[w] = found
                live.add(w)
            else:
                dead.add(w)
        counts: dict[int, int] = {}
        for w in own & live:
            for f in features[w]:
                counts[f] = counts.get(f, 0) + 1
        if len(dead) + len(live) > keep:
            dead.clear()
            live.clear()
            features.clear()
        return model.probabilities(sum(model.weights[f] * float(np.log1p(n)) for f, n in sorted(counts.items())))

    return score


def severity(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """doc_id, severity (the expected grade), p_toxic (of grade 1 or more) and toxic (p_toxic over 0.5) for each row of docs
    (doc_id, text), of which no other column is read, whatever its name. Texts are read whole, their distinct words once."""

    def make():
        score = _scorer(model)

        def step(batch: pa.RecordBatch) -> dict:
            p = [score(t) for t in batch.column("text").to_pylist()]
            any_p = [x[0] if x else 0.0 for x in p]
            return {"doc_id": batch.column("doc_id"), "severity": [float(sum(x)) for x in p], "p_toxic": any_p, "toxic": [x > 0.5 for x in any_p]}

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, severity double, p_toxic double, toxic boolean")


def keep_clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The rows of docs (columns of documents) that the model doesn't find toxic."""

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            keep = [not ((p := score(t)) and p[0] > 0.5) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return map_arrow(docs, run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's severity. Texts are scored whole, however long; further columns aren't read. Null and empty texts have the severity of a text without words; repeated rows are each
    scored; without labels of both classes all severities are 0; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return severity(docs, train(docs, table(spark, sf_dir, "labels")))
