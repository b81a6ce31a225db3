"""The review log as a stream: an addition to the batch operators, which stay the definition of every result.

Answers arrive late, twice and out of order. A late answer changes the state just as it does in a batch: `logs` gives each
touched headword's whole log; `states` keeps the log in segments with the state before each, and folds again only from
the segment in which the earliest new answer lies; `merge_into` merges into a log in files.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState

from scholia.functions.srs import replay, step

SCHEMA = "headword long, uids array<long>, ratings array<int>, times array<long>, n long"


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The stream without repeated uids, as far back as the delay; merges without that bound go through `merge_into`."""
    return stream.withWatermark("reviewed_at", delay).dropDuplicatesWithinWatermark(["uid"])


def logs(stream: DataFrame) -> DataFrame:
    """Each touched headword's whole log in order of time, ties by uid, after every batch: (headword, uids, ratings, times,
    n). A uid that was seen before changes nothing."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = dict(zip(state.get[0], zip(state.get[1], state.get[2], strict=True), strict=True)) if state.exists else {}
        for f in frames:
            for uid, rating, at in zip(f["uid"], f["rating"], f["reviewed_at"], strict=True):
                kept.setdefault(int(uid), (int(rating), int(pd.Timestamp(at).value // 1_000_000_000)))
        state.update((list(kept), [r for r, _ in kept.values()], [t for _, t in kept.values()]))
        order = sorted(kept, key=lambda u: (kept[u][1], u))
        yield pd.DataFrame([{"headword": key[0], "uids": order, "ratings": [kept[u][0] for u in order], "times": [kept[u][1]
            for u in order], "n": len(order)}])

    return stream.groupBy("headword").applyInPandasWithState(fold, SCHEMA,
         "uids array<long>, ratings array<int>, times array<long>", "update", "NoTimeout")


#: What `states` gives; refolded is the number of answers that a batch folded for the headword.
STATES = "headword long, phase long, step long, stability double, difficulty double, due long, last long, n long, refolded long"
#: Answers of a segment at most.
SEGMENT = 64
#: The state store that `states` needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(rows: list[tuple]) -> bytes:
    """Rows of whole numbers as bytes: a state store's client goes through arrays one number at a time."""
    return np.array(rows, np.int64).tobytes()


def _unpacked(data: bytes, width: int) -> list[tuple]:
    return list(map(tuple, np.frombuffer(data, np.int64).reshape(-1, width).tolist()))


class Segments(StatefulProcessor):
    """One headword's log, cut into segments by (time, uid). `head` has the segments in order (number, time and uid of the first
    answer, and how many there are) and the last one's answers (time, uid, rating) and the state before it, so that a short
    log takes one read and one write; `segments` has those of the others. Each call to the store is a message of its own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        before = "phase long, step long, s double, d double, due long, last long"
        self.head = handle.getValueState("head", f"index binary, answers binary, {before}")
        self.segments = handle.getMapState("segments", "id long", f"answers binary, {before}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        new = sorted({(r["t"], r["uid"], r["rating"]) for r in rows})
        index, *last = self.head.get() or (_packed([(0, *new[0][:2], 0)]), b"", 0, 0, 0.0, 0.0, 0, 0)
        index = _unpacked(index, 4)
        starts = [i[1:3] for i in index]
        place = lambda x: max(bisect_right(starts, x[:2]) - 1, 0)
        load = lambda i: self._load(last if i == len(index) - 1 else self.segments.getValue((index[i][0],)))
        into: dict[int, list[tuple]] = {}
        for x in new:
            into.setdefault(place(x), []).append(x)
        loaded: dict[int, tuple[list, tuple]] = {}
        for i, xs in into.items():
            answers, before = load(i)
            known = {a[1] for a in answers}
            for x in xs:
                if x[1] not in known:
                    known.add(x[1])
                    insort(answers, x)
            if len(answers) > index[i][3]:
                loaded[i] = answers, before
        if loaded:
            yield self._refold(key, index, loaded, load)

    def _load(self, value: tuple) -> tuple[list, tuple]:
        answers, *before = value
        return _unpacked(answers, 3), tuple(before)

    def _refold(self, key, index: list[tuple], loaded: dict[int, tuple[list, tuple]], load: Callable[[int], tuple[list, tuple]]) -> Row:
        """Folds from the first changed segment on; segments that grew too long are cut."""
        first, fresh = min(loaded), max(i[0] for i in index) + 1
        kept, state, folded, value = index[:first], loaded[first][1], 0, None
        for i in range(first, len(index)):
            answers = loaded[i][0] if i in loaded else load(i)[0]
            size = SEGMENT // 2 if len(answers) > SEGMENT else SEGMENT
            for k in range(0, len(answers), size):
                part, number = answers[k : k + size], index[i][0] if k == 0 else fresh
                fresh += k > 0
                if value:
                    self.segments.updateValue((kept[-1][0],), value)
                value = _packed(part), *state
                kept.append((number, *part[0][:2], len(part)))
                for t, _, r in part:
                    state = step(state, r, t)
                folded += len(part)
        self.head.update((_packed(kept), *value))
        phase, at, s, d, due, last = state
        return Row(headword=key[0], phase=phase, step=at, stability=s, difficulty=d, due=due, last=last, n=sum(k[3] for k in kept),
            refolded=folded)


def states(stream: DataFrame) -> DataFrame:
    """STATES of the headwords whose log a batch changes, for a stream of reviews (uid, headword, rating, reviewed_at): after
    any number of batches, in any order of arrival, the row of a headword with the largest n is what `replay` gives for
    all answers that came. A uid stands for one answer, so its repeats are equal and change nothing. Rows that `replay` passes
    over are passed over. A headword's log is what bounds its state; a batch reads the segments from its earliest answer on.
    Needs ROCKSDB as spark.sql.streaming.stateStore.providerClass."""
    seconds = F.floor(F.unix_micros(F.col("reviewed_at").cast("timestamp")) / 1_000_000)
    valid = stream.filter("rating between 1 and 4 and reviewed_at is not null and headword is not null and uid is not null")
    rows = valid.select(F.col("headword").cast("long").alias("headword"), F.col("uid").cast("long").alias("uid"),
        F.col("rating").cast("long").alias("rating"), seconds.cast("long").alias("t"))
    return rows.groupBy("headword").transformWithState(Segments(), STATES, "Update", "None")


def run_states(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Folds what is there into the checkpoint's state and writes each batch's rows to a folder of its own, so that a batch that
    is done again after a failure replaces its rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        run = states(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, had)


def latest(written: DataFrame) -> DataFrame:
    """The last row of each headword of what `run_states` wrote, in the columns of `replay`."""
    last = written.groupBy("headword").agg(F.max_by(F.struct("phase", "step", "stability", "difficulty", "due", "last", "n"),
        "n").alias("x"))
    return last.select("headword", "x.phase", "x.step", F.round("x.stability", 5).alias("stability"), F.round("x.difficulty",
        5).alias("difficulty"), "x.due", "x.last", "x.n")


#: Parts of the stored log, by a hash of the headword: a batch reads those that its headwords are in.
PARTS = 64


def merge_into(batch: DataFrame, path: str, parts: int = PARTS) -> DataFrame:
    """Adds a batch's new answers to the Parquet log at path (by its own anti-join, so repeats of any age change nothing) and
    gives the new state of the headwords that it touches. For foreachBatch. A uid belongs to one headword, so only the
    parts of the log that the batch's headwords are in are read."""
    spark, schema = batch.sparkSession, batch.schema
    part = F.pmod(F.xxhash64("headword"), F.lit(parts)).cast("int")
    rows = batch.dropDuplicates(["uid"]).withColumn("part", part)
    touched = [r.part for r in rows.select("part").distinct().collect()]  # `parts` numbers at most

    def log() -> DataFrame:
        return spark.read.schema(_ddl(schema)).parquet(path).filter(F.col("part").isin(touched))

    try:
        old = log()
        old.schema  # noqa: B018
    except Exception as e:  # noqa: BLE001  no log yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], schema).withColumn("part", F.lit(0))
    new = rows.join(old.select("uid"), "uid", "left_anti").select(*batch.columns, "part")
    new.write.partitionBy("part").mode("append").parquet(path)
    return replay(log().join(batch.select("headword").distinct(), "headword", "left_semi"))


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", part int"
