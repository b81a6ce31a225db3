"""Exact top-k search by BM25 over an inverted index with block-max WAND pruning.

The index is cut into shards of bounded size. Within a shard, documents are ordered so that like ones stand together, and
passed in order, SPAN blocks of BLOCK documents at a time. A span has a matrix of scores of the terms that are frequent
in it, as most postings are of few terms and each language has its own, and their maxima by block; the other postings are
kept by terms. A block of queries goes through a shard together: the rare terms' postings give a part of each score, and
what the frequent ones can add to it in a block bounds the score there. Pivots are the queries for which some block of the
span reaches their k-th best score so far; for all others the span is skipped and its matrix not read. The score to reach
rises with the pivots' scores, and is carried from shard to shard within a task. Term weights use the statistics of the
whole corpus, so the shards' best k, merged, are exactly the best k of all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm import blocks
from scholia.llm.common import cut, map_arrow, table

K1, B, TOP = 1.2, 0.75, 10
#: Documents and postings that end a shard, documents of a block, blocks of a span, queries of a block, those of it that go
#: through a shard together, and the share of a span's documents from which a term is frequent and has a row of scores.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, SPAN, QUERIES, TOGETHER, DENSE = 1 << 12, 1 << 20, 32, 16, 1024, 64, 1 / 8
#: Shards and blocks of queries that meet in a task, at most. A shard is made ready once for the blocks that it meets there.
SHARDS, BLOCKS = 16, 8
#: Scores count to six decimals: what is less than this below the score to reach may still tie with it.
SLACK = 1.1e-6
_TERM = re.compile(r"\w+")


def terms(text: str | None) -> Counter:
    """How often each term's 64-bit hash occurs in the whole text."""
    return Counter(_TERM.findall((text or "").lower()))


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), 0) - (1 << 63)


class Builder:
    """Gathers documents into a shard. What it holds of a posting are a number of the term and a count."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.tops, self.local, self.tf, self.postings = [], [], [], [], 0

    def add(self, doc: int | None, counts: Counter) -> None:
        self.ids.append(doc)
        self.tops.append((max(counts, key=counts.get) if counts else "", counts.total()))
        self.local.append(np.fromiter((self.vocabulary.setdefault(t, len(self.vocabulary)) for t in counts), np.int32, len(counts)))
        self.tf.append(np.fromiter(counts.values(), np.int64, len(counts)).astype(np.min_scalar_type(max(counts.values(), default=0))))
        self.postings += len(counts)

    def build(self) -> dict[str, np.ndarray]:
        """The shard's index, documents with the same leading term together, short ones first. A null id is -1 with its flag."""
        by = sorted(range(len(self.ids)), key=self.tops.__getitem__)
        local, tf = np.concatenate([self.local[i] for i in by]), np.concatenate([self.tf[i] for i in by])
        doc = np.repeat(np.arange(len(by), dtype=np.uint16), [len(self.local[i]) for i in by])
        hashes = np.fromiter(map(_hash, self.vocabulary), np.int64, len(self.vocabulary))
        rank = np.argsort(hashes, kind="stable")
        place = np.empty_like(rank)
        place[rank] = np.arange(len(rank))
        order = np.argsort(place[local], kind="stable")
        df = np.bincount(place[local], minlength=len(rank))
        ids = [self.ids[i] for i in by]
        return {
            "ids": np.array([-1 if i is None else i for i in ids], np.int64), "null": np.array([i is None for i in ids]),
                "length": np.array([self.tops[i][1] for i in by], np.int64),
            "terms": hashes[rank], "starts": np.concatenate([[0], np.cumsum(df)]).astype(np.int32), "doc": doc[order], "tf": tf[order],
        }


def build_shard(docs: list[tuple[int | None, Counter]]) -> dict[str, np.ndarray]:
    b = Builder()
    for d in docs:
        b.add(*d)
    return b.build()


def index(docs: DataFrame) -> DataFrame:
    """(payload, terms array, dfs array, docs, length): a row for each shard of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = Builder()

        def flush() -> pa.RecordBatch:
            s = b.build()
            return pa.RecordBatch.from_pydict({"payload": [blocks.dump(**s)], "terms": [s["terms"]],
                "dfs": [np.diff(s["starts"]).astype(np.int64)], "docs": [len(s["ids"])], "length": [int(s["length"].sum())]})

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b.add(i, terms(t.as_py()))
                if len(b.ids) >= SHARD_DOCS or b.postings >= SHARD_POSTINGS:
                    yield flush()
                    b = Builder()
        if b.ids:
            yield flush()

    return map_arrow(docs.select("doc_id", "text"), run, "payload binary, terms array<long>, dfs array<long>, docs long, length long")


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


class Best:
    """The best k scores of each query so far, in rows; those that aren't there yet are 0."""

    def __init__(self, k: int):
        self.k, self.row, self.scores = k, {}, np.zeros((0, k))

    def rows(self, queries: list[int]) -> np.ndarray:
        for q in queries:
            self.row.setdefault(q, len(self.row))
        if len(self.row) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((len(self.row) - len(self.scores), self.k))])
        return np.array([self.row[q] for q in queries], np.int64)

    def reach(self, rows: np.ndarray) -> np.ndarray:
        """The least score that may still be among a query's best."""
        return self.scores[rows].min(1) - SLACK

    def add(self, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """`reach` after more scores of queries, a row each."""
        if scores.shape[1] > self.k:
            scores = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k :]
        both = np.concatenate([self.scores[rows], scores], axis=1)
        self.scores[rows] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        return self.reach(rows)


class Found:
    """The k best rows of each query of those that were added, as (query, id, score to 6 decimals)."""

    def __init__(self, k: int):
        self.k, self.kept, self.new = k, 0, []

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.new.append((query, ids, np.round(score, 6)))
        if sum(len(x[0]) for x in self.new) > 2 * self.kept + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, score = (np.concatenate(x) for x in zip(*self.new, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.kept, self.new = int(keep.sum()), [(query[keep], ids[order][keep], score[order][keep])]
        return self.new[0]


class Shard:
    """A shard with its BM25 parts: for each posting, what the term's weight is multiplied by. A span has a matrix of the
    terms that are frequent in it, with the maxima of its blocks; what is left of the postings is kept by terms.
    `read` and `skipped` count the postings of queries' terms that were scored and that weren't."""

    def __init__(self, data: dict[str, np.ndarray], mean: float):
        self.ids, self.terms, self.n = data["ids"], data["terms"], len(data["ids"])
        norm = K1 * (1 - B + B * data["length"] / max(mean, 1e-9))
        doc, part = data["doc"].astype(np.int32), data["tf"].astype(np.float64)
        part *= (K1 + 1) / (part + norm[doc])
        self.df = np.diff(data["starts"])
        self.width = BLOCK * SPAN
        self.spans = -(-self.n // self.width)
        self.size = self.spans * self.width
        self.null = np.concatenate([data["null"], np.ones(self.size - self.n, bool)])
        # groups of postings of one term in one span; those of many postings go into the span's matrix
        of = np.repeat(np.arange(len(self.df), dtype=np.int32) * self.spans, self.df) + doc // self.width
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        many = np.diff(np.append(first, len(of)))
        term, span = np.divmod(of[first], self.spans)
        frequent = many >= DENSE * self.width
        some = np.repeat(frequent, many)
        self.doc, self.part = doc[~some], part[~some]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, np.where(frequent, 0, many), len(self.df)).astype(np.int64))])
        inside = np.flatnonzero(frequent)
        inside = inside[np.argsort(span[inside], kind="stable")]
        ends = np.searchsorted(span[inside], np.arange(self.spans + 1))
        # terms that are in any matrix have a column of queries' weights
        heavy = np.unique(term[inside])
        self.column = np.full(len(self.df), -1)
        self.column[heavy] = np.arange(len(heavy))
        self.rows, self.dense, self.most, self.counts = [], [], [], []
        for s in range(self.spans):
            g = inside[ends[s] : ends[s + 1]]
            at, row = _ranges(first[g], many[g]), np.repeat(np.arange(len(g)), many[g])
            dense = np.zeros((len(g), self.width))
            dense[row, doc[at] - s * self.width] = part[at]
            self.rows.append(self.column[term[g]])
            self.dense.append(dense)
            self.most.append(dense.reshape(len(g), SPAN, BLOCK).max(2))
            self.counts.append(many[g])
        self.heavy = len(heavy)
        self.read = self.skipped = 0

    def search(self, q: dict[str, np.ndarray], best: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, document, score) of the documents with an id that may be among a query's best so far."""
        known, place = (q["known"], q["place"]) if "known" in q else np.unique(q["terms"], return_inverse=True)
        at = np.searchsorted(self.terms, known)
        at[at == len(self.terms)] = 0
        at = np.where(self.terms[at] == known, at, -1)[place] if len(self.terms) else np.full(len(place), -1)
        found = []
        for a in range(0, len(q["ids"]), TOGETHER):
            starts = q["starts"][a : a + TOGETHER + 1]
            mine = slice(starts[0], starts[-1])
            here = at[mine] >= 0
            of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[here]
            found.append(self._some(q["ids"][a : a + TOGETHER], of, at[mine][here], q["weights"][mine][here], best))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _some(self, ids: np.ndarray, of: np.ndarray, at: np.ndarray, weight: np.ndarray, best: Best) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`search` of queries whose terms are `at` in the shard's, each with its query and its weight there."""
        n, some = len(ids), self.column[at] >= 0
        heavy = np.zeros((n, self.heavy))
        heavy[of[some], self.column[at[some]]] = weight[some]
        # scores of what is rare
        start, many = self.starts[at], self.starts[at + 1] - self.starts[at]
        posting = _ranges(start, many)
        cell = np.repeat(of * self.size, many)
        cell += self.doc[posting]
        own = np.repeat(weight, many)
        own *= self.part[posting]
        scores = np.bincount(cell, own, n * self.size).reshape(n, self.size)
        self.read += len(posting)
        rows = best.rows(ids.tolist())
        reach, found = best.reach(rows), []
        for s in range(self.spans):
            columns = slice(s * self.width, (s + 1) * self.width)
            weights, rare = heavy[:, self.rows[s]], scores[:, columns]
            top = (weights @ self.most[s] + rare.reshape(n, SPAN, BLOCK).max(2)).max(1) * (1 + 1e-12)
            pivots = np.flatnonzero((top > 0) & (top >= reach))
            postings = (weights > 0) @ self.counts[s].astype(np.float64)
            read = int(postings[pivots].sum())
            self.read += read
            self.skipped += int(postings.sum()) - read
            if not len(pivots):
                continue
            span = weights[pivots] @ self.dense[s]
            span += rare[pivots]
            span[:, self.null[columns]] = 0  # without an id: can't be found, nor raise what is to be reached
            better = np.flatnonzero(span.max(1) >= reach[pivots])
            pivots, span = pivots[better], span[better]
            reach[pivots] = best.add(rows[pivots], span)
            who, doc = np.nonzero((span >= reach[pivots, None]) & (span > 0))
            found.append((pivots[who], doc + s * self.width, span[who, doc]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        who, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = score >= reach[who]
        return ids[who[keep]], doc[keep], score[keep]


def query_blocks(docs: DataFrame, df: DataFrame, n_docs: int, at_a_time: int = QUERIES) -> DataFrame:
    """(payload): blocks of queries (doc_id, text), each query's terms weighted by idf and their counts in it."""
    queries = docs.select("doc_id", "text").filter("doc_id is not null")
    n = max(1, -(-queries.count() // at_a_time))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if c := terms(t.as_py()):
                    yield pa.RecordBatch.from_pydict({"query": pa.array([i] * len(c), pa.int64()), "term": pa.array([_hash(x)
                        for x in c], pa.int64()), "qtf": pa.array(list(c.values()), pa.int64())})

    rows = cut(map_arrow(queries.distinct(), explode, "query long, term long, qtf long")).join(df, "term")
    idf = F.log1p((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = rows.select(F.pmod(F.xxhash64("query"), F.lit(n)).alias("block"), "query", "term", (idf * F.col("qtf")).alias("weight"), "df")

    def gather(group: pa.Table) -> pa.Table:
        g = group.sort_by([("query", "ascending"), ("df", "ascending"), ("term", "ascending")])
        q = g["query"].to_numpy()
        ids, starts = np.unique(q, return_index=True)
        known, place = np.unique(g["term"].to_numpy(), return_inverse=True)
        return pa.table({"payload": pa.array([blocks.dump(ids=ids, starts=np.append(starts, len(q)), known=known,
             place=place.astype(np.int32), weights=g["weight"].to_numpy())], pa.binary())})

    return rows.groupBy("block").applyInArrow(gather, "payload binary")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best rows of docs (doc_id, text) for each of queries (doc_id, text), itself
    included. Equal scores (to 6 decimals) rank by id. Rows without an id can't be queries nor be found, but count in the
    statistics; repeated rows are each found; queries without a term, or with none that a document has, give no rows.
    Texts are indexed and asked whole; other columns, whatever their names, aren't read.

    A block of queries meets every shard, a task going through several of both: what a task holds is a shard, the packed
    blocks of its queries, one of them unpacked, and k rows for each query, which it gives when it has seen all.
    """
    shards = cut(index(docs))
    stats = shards.agg(F.count("*"), F.sum("docs"), F.sum("length")).first()
    n_docs, mean = stats[1] or 0, (stats[2] or 0) / max(stats[1] or 0, 1)
    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.dfs").alias("df"))
    asked = cut(query_blocks(queries, df, n_docs))
    state: list = [None, None]
    best, rows = Best(k), Found(k)

    def run(block: dict, q: dict) -> None:
        if state[0] is not block:
            state[:] = [block, Shard(block, mean)]
        query, doc, score = state[1].search(q, best)
        rows.add(query, state[1].ids[doc], score)

    def end() -> Iterator[pa.RecordBatch]:
        if rows.new:
            query, ids, score = rows.cut()
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())],
                names=["query_id", "doc_id", "score"])

    tasks = max(-(-stats[0] // SHARDS), min(stats[0], 4 * docs.sparkSession.sparkContext.defaultParallelism), 1)
    found = blocks.pairs(shards.coalesce(tasks), asked.coalesce(max(1, -(-asked.count() // BLOCKS))), run,
        "query_id long, doc_id long, score double", end)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def op6_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each document whose id is divisible by 100, asked by its whole text. An empty table, or
    one without such ids, gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.filter("doc_id % 100 = 0"))
