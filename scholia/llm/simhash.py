"""SimHash near-dedup by a self-join of binary tries.

Fingerprints within the budget of 3 of 64 bits agree wholly in one of four 16-bit blocks. Every distinct fingerprint goes
to the four groups that its blocks name. A group with more than GROUP of them is dealt again by four blocks of the bits
that its members needn't share, and so on until groups are small or their bits used up: each step is exact, as a budget of
n bits leaves one of n + 1 blocks alone, and splits a group by more than it repeats its members. Within a group, a binary
trie (path compressed) is joined with itself: pairs of nodes descend together, differing bits add up as prefixes get
longer, and a pair goes as soon as they exceed the budget, or when its leaves are known to be linked already. A group
gives a star for each set that it links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import cut, map_arrow, map_rows, table
from scholia.llm.components import components

BITS, SHINGLE, SEED, GROUP = 3, 3, 42, 512
#: Pairs of nodes that are expanded at a time, and fingerprints whose groups are joined together.
FRONTIER, TOGETHER = 1 << 19, 1 << 14
_BYTES = np.array([sum(((b >> i) & 1) << 8 * i for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half of the shingles' XXH64."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else iter([b" ".join(words)])
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    lanes = _BYTES[h.view(np.uint8).reshape(n, 8)]  # eight counters of a byte each; up to 255 rows add up without a carry
    counts = np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys (long columns) and fp, the fingerprint as a signed long; null text counts as empty."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            fps = np.fromiter((fingerprint(t or "") for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            return {**{k: batch.column(k) for k in keys}, "fp": fps.view(np.int64)}

        return step

    return map_rows(docs.select(*keys, "text"), make, "".join(f"{k} long, " for k in keys) + "fp long")


class Tries:
    """Path-compressed binary tries over sorted groups of fingerprints: node j < n is a leaf, node n + i the inner node
    that splits its leaves before leaf i."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        n = len(fp)
        x = np.zeros(n, np.uint64)
        x[1:] = fp[1:] ^ fp[:-1]
        self.n, self.fp = n, fp
        high = np.full(n, -1)
        for shift in range(64):  # the highest differing bit of neighbours
            high[(x >> np.uint64(shift)) != 0] = shift
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        left, right, lo, hi = [-1] * n, [-1] * n, [0] * n, [0] * n
        stack: list[int] = []  # splits on the right edge, bits falling
        tops = high.tolist()

        def close(below: int) -> int:
            """Ends the splits whose bit is below; the node that covers their leaves, or -1."""
            last = -1
            while stack and tops[stack[-1]] < below:
                i = stack.pop()
                right[i] = i if last < 0 else last
                hi[i] = i + 1 if last < 0 else hi[last - n]
                last = n + i
            return last

        for i, first in enumerate(new.tolist()):
            if first:
                close(99)
                continue
            last = close(tops[i])
            left[i] = i - 1 if last < 0 else last
            lo[i] = i - 1 if last < 0 else lo[last - n]
            stack.append(i)
        close(99)
        own = np.arange(n)
        self.left, self.right = np.array(left), np.array(right)
        self.lo, self.hi = np.concatenate([own, lo]), np.concatenate([own + 1, hi])
        self.bit = np.concatenate([np.full(n, -1), high])
        self.inner = np.flatnonzero(~new)
        self.label = own.copy()

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Leaves a and b get the least label of what they now connect."""
        label = self.label
        while True:
            x, y = label[a], label[b]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label[:] = label[label]

    def join(self, budget: int = BITS) -> None:
        """Links all leaves of a group within `budget` bits of each other."""
        near = self.inner[np.bitwise_count(self.fp[self.inner] ^ self.fp[self.inner - 1]) <= budget]
        self._link(near, near - 1)
        n = len(self.inner)
        stack = [(self.left[self.inner], self.right[self.inner], np.zeros(n, np.int64), np.zeros(n, np.uint64))]
        while stack:  # pairs of nodes, the bits that differ so far, and the prefix in which they were counted
            a, b, differ, seen = stack.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack += [(a[:half], b[:half], differ[:half], seen[:half]), (a[half:], b[half:], differ[half:], seen[half:])]
                continue
            top = np.maximum(self.bit[a], self.bit[b])
            known = ~((np.uint64(2) << np.maximum(top, 0).astype(np.uint64)) - np.uint64(1))
            known[top < 0] = ~np.uint64(0)
            differ = differ + np.bitwise_count((self.fp[self.lo[a]] ^ self.fp[self.lo[b]]) & known & ~seen)
            changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
            one = (changes[self.hi[a] - 1] == changes[self.lo[a]]) & (changes[self.hi[b] - 1] == changes[self.lo[b]])
            linked = one & (self.label[self.lo[a]] == self.label[self.lo[b]])
            keep = (differ <= budget) & ~linked
            a, b, top, differ, known = a[keep], b[keep], top[keep], differ[keep], known[keep]
            leaves = top < 0
            if leaves.any():
                self._link(a[leaves], b[leaves])
            a, b, differ, known = a[~leaves], b[~leaves], differ[~leaves], known[~leaves]
            if len(a):
                turn = self.bit[b] > self.bit[a]
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                stack.append((np.concatenate([self.left[a - self.n], self.right[a - self.n]]), np.concatenate([b, b]),
                    np.concatenate([differ, differ]), np.concatenate([known, known])))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        other = np.flatnonzero(self.label != np.arange(self.n))
        return self.fp[other], self.fp[self.label[other]]


def link_groups(rows: DataFrame, budget: int = BITS) -> DataFrame:
    """Edges (a, b), a star for each linked set, from rows (key, fp) dealt by key and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            order = np.lexsort((fp, key))
            key, fp = key[order], fp[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
            key, fp = key[fresh], fp[fresh]
            tries = Tries(key, fp)
            tries.join(budget)
            a, b = tries.stars()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]) if len(a) else None

        keys, fps, size = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            size += batch.num_rows
            if size >= TOGETHER:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                ends = np.flatnonzero(key[1:] != key[:-1]) + 1  # the last group may go on in the next batch
                ready, at = (int(ends[-1]) if len(ends) else 0), 0
                for end in [*ends[np.searchsorted(ends, np.arange(TOGETHER, ready, TOGETHER))].tolist(), ready]:
                    if end > at and (out := joined(key[at:end], fp[at:end])) is not None:
                        yield out
                    at = max(at, end)
                keys, fps, size = [key[ready:]], [fp[ready:]], len(key) - ready
        if size and (out := joined(np.concatenate(keys), np.concatenate(fps))) is not None:
            yield out

    return map_arrow(rows, run, "a long, b long")


def grouped(fps: DataFrame, most: int = GROUP, budget: int = BITS) -> DataFrame:
    """Rows (key, fp) such that fingerprints within `budget` bits share a key, and no key has more than `most`, unless so many
    differ in no more than its last few bits.

    The counts of large groups are written before they are joined: both sides of each join are plain exchanges then.
    """
    parts = budget + 1
    rows, width, done = fps.select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("rest")), 64, None
    while True:  # rest: the bits that members of a key needn't share
        n = width // parts
        low = lambda k: F.lit((1 << k) - 1 if k < 64 else -1).cast("long")
        block = lambda t: F.shiftrightunsigned("rest", t * n).bitwiseAND(low(n))  # noqa: E731, B023
        left = lambda t: F.shiftleft(F.shiftrightunsigned("rest", (t + 1) * n) if (t + 1) * n < 64 else F.lit(0).cast("long"),
            t * n).bitwiseOR(F.col("rest").bitwiseAND(low(t * n)))  # noqa: E731, B023
        dealt = F.explode(F.array(*[F.struct(F.xxhash64("key", F.lit(t), block(t)).alias("key"), left(t).alias("rest"))
            for t in range(parts)])).alias("x")
        rows, width = rows.select("fp", dealt).select("x.key", "fp", "x.rest"), width - n
        large = None if width < parts else cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key",
             F.lit(True).alias("large")))
        if large is None or large.isEmpty():
            found = rows.select("key", "fp")
            return found if done is None else done.union(found)
        marked = rows.join(large, "key", "left")
        found = marked.filter("large is null").select("key", "fp")
        done = found if done is None else done.union(found)
        rows = cut(marked.filter("large").select("key", "fp", "rest"))


def edges_of(fps: DataFrame) -> DataFrame:
    """Edges between the distinct fingerprints of fps (fp) that are within BITS of each other, as stars."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return link_groups(grouped(fps.select("fp")).repartition(n, "key").sortWithinPartitions("key"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs (doc_id, text).

    Null and empty texts have fingerprint zero; rows without an id take part in links but never name a component (it is
    null where no row has an id); repeated rows are each returned; an empty table gives no rows.
    """
    by_doc = cut(fingerprints(docs))
    firsts = cut(by_doc.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = edges_of(firsts)
    linked = cut(components(edges).join(firsts, F.col("v") == F.col("fp")).select("fp", "root", "first"))
    least = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(linked.join(least, "root").select("fp", "component_id"))
    named = cut(firsts.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")))
    return by_doc.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame) -> DataFrame:
    """(row) of the one row of docs (row, doc_id, text) that stays of each component: that with the least id, null ids last,
    and of these the least row. Rows are told apart by `row`, a whole number of its own for each."""
    by_row = cut(fingerprints(docs, ("row", "doc_id")))
    place = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")
    firsts = cut(by_row.groupBy("fp").agg(F.min(place).alias("first")))
    linked = cut(components(edges_of(firsts)).join(firsts, F.col("v") == F.col("fp")).select("fp", "root", "first"))
    alone = firsts.join(linked.select("fp"), "fp", "left_anti").select("first.row")
    return linked.groupBy("root").agg(F.min("first").alias("first")).select("first.row").union(alone)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and component of every document. Null and empty texts have fingerprint zero, texts are read whole, rows
    without an id never name a component, repeated rows are each returned, an empty table gives no rows; further columns,
    whatever their names, aren't read."""
    return near_groups(table(spark, sf_dir, "documents"))
