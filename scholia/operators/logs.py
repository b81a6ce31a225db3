"""Event logs: idempotent merges, last-write-wins registers, tombstones, toggles, undo, queues and ring buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import times


def merge_new(existing: DataFrame, incoming: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Rows of incoming whose uid existing lacks, once each (the earliest); with known (headword), only of known headwords.
    Rows without a uid or a headword are passed over. Applying the result and merging again gives nothing: merges are
    idempotent."""
    incoming = incoming.filter("uid is not null and headword is not null")
    if known is not None:
        incoming = incoming.join(known.select("headword"), "headword", "left_semi")
    columns = [c for c in incoming.columns if c != "uid"]
    once = incoming.groupBy("uid").agg(F.min(F.struct("reviewed_at", *[c for c in columns
        if c != "reviewed_at"])).alias("x")).select("uid", "x.*").select(*incoming.columns)
    return once.join(existing.select("uid"), "uid", "left_anti")


def last_write(log: DataFrame, key: str, at: str = "updated_at", tie: str = "event_id") -> DataFrame:
    """The newest row of each key; on a tie the one that came first stays. A partial aggregate: a hot key is no hot task."""
    rest = [c for c in log.columns if c not in (key, at, tie)]
    newest = F.max(F.struct(at, (-F.col(tie)).alias("_tie"), *rest)).alias("x")
    return log.groupBy(key).agg(newest).select(key, F.col(f"x.{at}").alias(at), (-F.col("x._tie")).alias(tie),
        *[F.col(f"x.{c}").alias(c) for c in rest])


def merge_state(existing: DataFrame, incoming: DataFrame, key: str, needed: list[str], defaults: dict | None = None) -> DataFrame:
    """Rows of incoming that replace existing ones or are new: the newest of each key (updated_at, a tie keeps the one with the
    least event_id), if it is strictly newer than what existing has. Rows that lack the key, updated_at or what is needed are
    passed over; nulls take their defaults, `deleted` is 0 or 1."""
    valid = incoming
    for name in [key, "updated_at", *needed]:
        valid = valid.filter(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    for name, value in (defaults or {}).items():
        valid = valid.withColumn(name, F.coalesce(name, value if isinstance(value, Column) else F.lit(value)))
    if "deleted" in valid.columns:
        valid = valid.withColumn("deleted", F.coalesce(F.col("deleted").cast("int") != 0, F.lit(False)).cast("int"))
    newest = last_write(valid, key)
    old = existing.groupBy(key).agg(F.max("updated_at").alias("_had"))
    return newest.join(old, key, "left").filter(F.col("_had").isNull() | (F.col("updated_at") > F.col("_had"))).drop("_had").select(*newest.columns)


def merged(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """existing with the rows of changes (see `merge_state`) in place of its own of the same key."""
    return existing.join(changes.select(key), key, "left_anti").select(*existing.columns).unionByName(changes.select(*existing.columns))


def toggle_marks(marks: DataFrame, taps: DataFrame) -> DataFrame:
    """The marks (uid, paper, sentence, updated_at, deleted) after taps (uid, paper, sentence, at), one for each place: a live
    mark of the place becomes a tombstone, and where none lives, a new mark with the tap's uid begins."""
    place = ["paper", "sentence"]
    hit = marks.filter("deleted = 0").join(taps.select(*place, "at"), place)
    gone = hit.select(*[F.col("at").alias("updated_at") if c == "updated_at" else F.lit(1).alias("deleted") if c == "deleted"
        else F.col(c) for c in marks.columns])
    fresh = taps.join(marks.filter("deleted = 0").select(*place), place, "left_anti").select("uid", *place,
        F.col("at").alias("updated_at"), F.lit(0).alias("deleted"))
    return marks.join(hit.select("uid"), "uid", "left_anti").select(*marks.columns).unionByName(gone).unionByName(fresh,
         allowMissingColumns=True).select(*marks.columns)


def with_notes(marks: DataFrame, notes: DataFrame, most: int = 2000) -> DataFrame:
    """marks (uid, note, updated_at, ...) with the notes of notes (uid, new, at), trimmed and cut to `most` characters."""
    n = notes.select("uid", F.substring(F.trim("new"), 1, most).alias("_new"), F.col("at").alias("_at"))
    rows = marks.join(n, "uid", "left")
    return rows.select(*[F.coalesce("_new", c).alias(c) if c == "note" else F.coalesce("_at", c).alias(c) if c == "updated_at"
         else F.col(c) for c in marks.columns])


def without_words(words: DataFrame, lookups: DataFrame, reviews: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the headwords of gone, and all that belongs to them."""
    return tuple(t.join(gone.select("headword"), "headword", "left_anti").select(*t.columns) for t in (words, lookups, reviews))


def throttled(log: DataFrame, key: str, gap: int) -> DataFrame:
    """(key, kept: array of seconds): of each key's saves (key, at: seconds) those that a throttle lets through: the first, then
    each that comes at least `gap` after the last one that it let through. A key's log is what bounds the array."""
    ordered = F.array_sort(F.collect_list("at"))
    late = lambda kept, at: (F.size(kept) == 0) | (at - F.element_at(kept, -1) >= gap)
    keep = lambda kept, at: F.when(late(kept, at), F.array_append(kept, at)).otherwise(kept)
    rows = log.filter(F.col("at").isNotNull()).groupBy(key).agg(ordered.alias("at"))
    first = F.array(F.col("at")[0])
    return rows.select(key, F.aggregate("at", first, keep).alias("kept"))


def live(log: DataFrame, key: str) -> DataFrame:
    """Last-write-wins rows without tombstones."""
    return last_write(log, key).filter("deleted = 0")


def toggled(log: DataFrame, *keys: str) -> DataFrame:
    """Keys that an odd number of toggles leaves on, with how many there were."""
    return log.groupBy(*keys).agg(F.count("*").alias("n")).filter("n % 2 = 1")


def undo_last(reviews: DataFrame, device: int) -> DataFrame:
    """reviews without the newest one of the device."""
    last = reviews.filter(F.col("device") == device).agg(F.max_by("uid", F.struct("reviewed_at", "uid")).alias("uid"))
    return reviews.join(F.broadcast(last), "uid", "left_anti")


def tail(log: DataFrame, key: str, n: int, order: list[Column]) -> DataFrame:
    """The last n rows of each key, a ring buffer. Spark cuts each task's rows to n of a key before the shuffle."""
    return log.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("back") <= n)


def queue_counts(state: DataFrame, words: DataFrame, reviews: DataFrame, now: int, quota: int = 20, zone: str = "UTC") -> DataFrame:
    """One row: new, learning, review, total, new_waiting and next_due of the review queue at `now` (seconds).

    state has (headword, phase, due); words (headword); a new word's place in the day's quota is used up by its first
    answer on or after the local midnight before now.
    """
    midnight = times.local_midnight(F.lit(now), zone)
    firsts = reviews.groupBy("headword").agg(F.min(F.floor(F.unix_micros(F.col("reviewed_at").cast("timestamp")) / 1_000_000)).alias("first"))
    used = firsts.agg(F.count_if((F.col("first") >= midnight) & (F.col("first") <= now)).alias("used"))
    cards = words.join(state, "headword", "left")
    counts = cards.agg(
        F.count_if(F.col("phase").isNull()).alias("new_waiting"), F.count_if((F.col("due") <= now) & (F.col("phase") != 2)).alias("learning"),
        F.count_if((F.col("due") <= now) & (F.col("phase") == 2)).alias("review"), F.count("*").alias("total"),
            F.min(F.when(F.col("due") > now, F.col("due"))).alias("next_due"),
    )
    return counts.join(F.broadcast(used)).select(F.least("new_waiting", F.greatest(quota - F.col("used"), F.lit(0))).alias("new"),
         "learning", "review", "total", "new_waiting", "next_due")
