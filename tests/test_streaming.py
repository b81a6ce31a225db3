import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from scholia.functions.srs import replay, step
from scholia.sources import adapters
from scholia.streaming import reviews


def test_stream_gives_the_batch_state(spark, sf, tmp_path):
    rows = adapters.reviews(spark, sf).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows.union(rows.limit(50)).repartition(3).write.parquet(path)
    seen = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    stream.writeStream.foreachBatch(lambda b, i: seen.extend((i, *r) for r in reviews.merge_into(b,
        log).collect())).option("checkpointLocation", str(tmp_path / "c1")).start().processAllAvailable()
    last = {r[1]: r[1:] for r in sorted(seen)}
    want = {r.headword: tuple(r) for r in replay(rows).collect()}
    assert last == want
    q = reviews.logs(stream).writeStream.outputMode("update").format("memory").queryName("logs").option("checkpointLocation",
        str(tmp_path / "c2")).start()
    q.processAllAvailable()
    got = spark.table("logs").groupBy("headword").agg(F.max("n").alias("n")).collect()
    assert {r.headword: r.n for r in got} == {w: x[-1] for w, x in want.items()}
    for s in spark.streams.active:
        s.stop()


def test_states_fold_only_the_tail_and_survive_a_restart(spark, sf, tmp_path):
    rnd = random.Random(5)
    answers = [(u, u % 2, rnd.randint(1, 4), 1_700_000_000 + rnd.randint(0, 400) * 43200) for u in range(600)]
    answers += [(1000, 1, 9, 1_700_000_000), (1001, None, 3, 1_700_000_000), (1002, 1, 3, None)]
    order = sorted(answers[:600], key=lambda x: (x[3], x[0]))
    middle = order.pop(300)
    batches = [order[:200] + answers[600:], order[150:400], order[400:], order[590:] + order[:5], [middle]]
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    schema = "uid long, headword long, rating int, t long"
    for rows in batches:  # each a run of its own, from the checkpoint of the last
        df = spark.createDataFrame(rows, schema).select("uid", "headword", "rating", F.timestamp_seconds("t").alias("reviewed_at"))
        df.coalesce(1).write.mode("append").parquet(source)
        reviews.run_states(spark.readStream.schema(df.schema).parquet(source), out, state)
    every = spark.createDataFrame(answers, schema).withColumn("reviewed_at", F.timestamp_seconds("t"))
    got = spark.read.parquet(out)
    assert sorted(map(tuple, reviews.latest(got).collect())) == sorted(map(tuple, replay(every).collect()))
    rows = sorted((r.batch, r.headword, r.n, r.refolded) for r in got.collect())
    assert {r[0] for r in rows} == {0, 1, 2, 4}  # repeats alone give no row
    tail = [r for r in rows if r[0] == 4]
    assert len(tail) == 1 and tail[0][2] == 300 and 150 <= tail[0][3] <= 150 + reviews.SEGMENT
    assert all(r[3] < 180 for r in rows if r[0] == 2)  # about 100 new ones of 300, and a segment


def test_step_is_the_fold(spark):
    rnd, logs = random.Random(3), []
    for k in range(60):
        t = 1_700_000_000
        for i in range(rnd.randint(1, 12)):
            t += rnd.choice([0, 30, 700, 90_000, 4_000_000])
            logs.append((k * 100 + i, k, rnd.randint(1, 4), t))
    df = spark.createDataFrame(logs, "uid long, headword long, rating int, t long").withColumn("reviewed_at", F.timestamp_seconds("t"))
    for r in replay(df).collect():
        state = (0, 0, 0.0, 0.0, 0, 0)
        for _, _, rating, t in (x for x in logs if x[1] == r.headword):
            state = step(state, rating, t)
        assert (r.phase, r.step, r.due, r.last) == (*state[:2], *state[4:])
        assert abs(r.stability - state[2]) < 1e-4 and abs(r.difficulty - state[3]) < 1e-4


class Store:
    """A state store's client that counts its messages; for each name the values by key."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def _of(self, name):
        def call(f):
            def counted(*x):
                self.calls += 1
                return f(*x)
            return counted
        held = self.values.setdefault(name, {})
        methods = {"get": lambda: held.get(()), "update": lambda v: held.__setitem__((), v), "exists": lambda: () in held,
            "getValue": held.get, "updateValue": held.__setitem__, "containsKey": held.__contains__}
        return type("State", (), {k: staticmethod(call(f)) for k, f in methods.items()})

    def getValueState(self, name, schema):  # noqa: N802
        return self._of(name)

    def getMapState(self, name, key, schema):  # noqa: N802
        return self._of(name)


def test_a_short_log_takes_one_read_and_one_write_of_the_store():
    rnd, store, fold = random.Random(9), Store(), reviews.Segments()
    fold.init(store)
    answers = [(1_700_000_000 + rnd.randint(0, 900) * 43200, u, rnd.randint(1, 4)) for u in range(500)]
    seen: list = []
    for a, b in ((0, 20), (20, 45), (45, 64), (64, 300), (0, 30), (300, 500)):
        calls = store.calls
        got = list(fold.handleInputRows((7,), iter([Row(t=t, uid=u, rating=r) for t, u, r in answers[a:b]]), None))
        if len(seen) < 64 and b <= 64:
            assert store.calls - calls <= 2
        seen = sorted({*seen, *answers[a:b]})
        if a or not b == 30:
            state = (0, 0, 0.0, 0.0, 0, 0)
            for t, _, r in seen:
                state = step(state, r, t)
            assert [tuple(x)[:8] for x in got] == [(7, *state, len(seen))]
        else:
            assert not got  # repeats
