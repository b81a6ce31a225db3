"""Learning: graded answers, level advice, blanks, examples, the word list and the review queue's next card."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import srs, times
from scholia.operators import logs

#: Names of a card's phases; how many answers of a level advice looks at, and how many it needs.
PHASES = ["New", "Learning", "Review", "Relearning"]
LAST, NEEDED, LEVELS = 20, 10, 5
#: Words that no blank is made of.
COMMON = (
    "a an the of to in on at by for from with and or but as is are was were be been being it its this that "
         "these those we our they their he his she her which who whom "
    "whose what when where how than then so such not no can could may might will would shall should must do "
         "does did has have had into onto over under about also there "
    "here if while both each"
).split()


def dictation_scores(graded: DataFrame, key: str) -> DataFrame:
    """(key, n, score) of graded answers (key, grade): exact ones count 1, near ones and other forms a half."""
    points = F.when(F.col("grade").isin("exact", "ok"), 1.0).when(F.col("grade").isin("wrong", "ng"), 0.0).otherwise(0.5)
    return graded.groupBy(key).agg(F.count("*").alias("n"), F.avg(points).alias("score"))


def level_advice(history: DataFrame, key: str) -> DataFrame:
    """(key, level, n, rate, advice) of history (key, level, score, at, uid): the mean of the last scores of a level, and whether
    to go up (over 0.9), down (under 0.5) or neither; with fewer than ten scores, neither."""
    w = Window.partitionBy(key, "level").orderBy(F.desc("at"), F.desc("uid"))
    last = history.withColumn("_back", F.row_number().over(w)).filter(F.col("_back") <= LAST)
    rate = last.groupBy(key, "level").agg(F.count("*").alias("n"), F.avg("score").alias("rate"))
    up, down = (F.col("rate") > 0.9) & (F.col("level") < LEVELS), (F.col("rate") < 0.5) & (F.col("level") > 1)
    return rate.withColumn("advice", F.when(F.col("n") < NEEDED, "none").when(up, "up").when(down, "down").otherwise("none"))


def blanks(words: DataFrame, key: list[str], level: int, seed: int = 7) -> DataFrame:
    """The words (key..., pos, word) of each sentence that are left out at a level: one (1), a fifth (2) or two fifths (3) of
    its content words, all of them (4), or every word (5). A sentence without content words gives any of its words.
    Which ones is chosen by a hash of seed, key and place."""
    own, n = Window.partitionBy(*key), F.length("word")
    acronym = F.col("word").rlike("^[A-Z0-9]{2,}s?$")
    content = ~F.lower("word").isin(COMMON) & (n >= 3) & (F.lit(level >= 4) | ~acronym)
    rows = words.withColumn("_content", content | F.lit(level >= 5))
    rows = rows.withColumn("_any", F.count_if("_content").over(own)).filter(F.col("_content") | (F.col("_any") == 0))
    if level >= 4:
        return rows.select(*key, "pos", "word")
    by = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.col("pos").cast("string")))
    place, size = F.row_number().over(own.orderBy("_by", "pos")), F.count("*").over(own)
    share = F.floor({1: 0.0, 2: 0.2, 3: 0.4}[level] * size + 0.5)
    rows = rows.withColumn("_by", by).withColumn("_most", F.greatest(F.lit(2 if level == 3 else 1), share)).withColumn("_place", place)
    return rows.filter(F.col("_place") <= F.col("_most")).select(*key, "pos", "word")


def latest_examples(lookups: DataFrame, most: int = 3) -> DataFrame:
    """(headword, back, uid, sentence, ...): the newest lookups (uid, headword, looked_at, sentence) of each word that have a
    sentence, at most so many, numbered back from 1."""
    return logs.tail(lookups.filter(F.col("sentence").isNotNull()), "headword", most, [F.desc("looked_at"), F.desc("uid")])


def word_list(words: DataFrame, lookups: DataFrame, most: int = 500) -> DataFrame:
    """The words (headword, last_seen, ...) that were seen last, newest first (then by headword), at most so many, each with the
    sentence of its newest lookup, which may be null. Only what is listed is joined with the lookups."""
    listed = words.orderBy(F.desc("last_seen"), "headword").limit(most)
    newest = lookups.join(listed.select("headword"), "headword", "left_semi").groupBy("headword").agg(F.max_by("sentence",
        F.struct("looked_at", "uid")).alias("example"))
    return listed.join(newest, "headword", "left").orderBy(F.desc("last_seen"), "headword")


def next_card(words: DataFrame, reviews: DataFrame, now: int, quota: int = srs.NEW_PER_DAY, zone: str = "UTC") -> DataFrame:
    """The card to answer at `now`, or no row: (headword, phase, reviews, again, hard, good, easy), the last four being the
    seconds until it is due again after each rating. Of words (headword, first_seen) that with the earliest due time that
    has come, else, if the day's quota isn't used up, the new one that was seen first; ties go by headword."""
    states = srs.states(reviews)
    midnight = times.local_midnight(F.lit(now), zone)
    firsts = reviews.groupBy("headword").agg(F.min(times.seconds(F.col("reviewed_at"))).alias("first"))
    used = firsts.agg(F.count_if((F.col("first") >= midnight) & (F.col("first") <= now)).alias("used"))
    cards = words.select("headword", "first_seen").join(states, "headword", "left")
    due, new = cards.filter(F.col("x.due") <= now), cards.filter(F.col("x").isNull()).join(F.broadcast(used.filter(F.col("used") < quota)))
    order = lambda rank, by: F.struct(F.lit(rank).alias("rank"), by.alias("by"), F.col("headword"))
    both = due.select("headword", "x", "n", order(0, F.col("x.due")).alias("o")).union(new.select("headword", "x", "n", order(1,
         times.seconds(F.col("first_seen"))).alias("o")))
    first = both.orderBy("o").limit(1).withColumn("x", F.coalesce("x", F.expr(srs.state_sql(*srs.NEW, True))))
    names = F.array(*[F.lit(x) for x in PHASES])
    waits = [F.expr(sql).alias(name) for sql, name in zip(srs.preview_sql("x", f"{now}L", True), ("again", "hard", "good", "easy"), strict=True)]
    return first.select("headword", F.get(names, F.col("x.phase").cast("int")).alias("phase"), F.coalesce("n", F.lit(0)).alias("reviews"), *waits)


def undo(reviews: DataFrame, device: int) -> tuple[DataFrame, DataFrame]:
    """reviews without the newest one of the device, and the state (see `srs.replay`) of the headword that it was of: that
    headword alone is folded again. A headword without answers left has no state."""
    last = reviews.filter(F.col("device") == device).orderBy(F.desc("reviewed_at"), F.desc("uid")).limit(1)
    left = reviews.join(F.broadcast(last.select("uid")), "uid", "left_anti")
    return left, srs.replay(left.join(F.broadcast(last.select("headword")), "headword", "left_semi"))


def merge_progress(known: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a progress file (lookups, reviews, positions, marks) adds to the tables of the same names: lookups and reviews whose
    uid is new, reviews only of words that are known (headword) or looked up in the same file, positions by paper and
    marks by uid that are newer."""
    lookups = logs.merge_new(old["lookups"], new["lookups"].withColumn("reviewed_at", F.col("looked_at"))).drop("reviewed_at")
    words = known.select("headword").union(lookups.select("headword"))
    return {
        "lookups": lookups, "reviews": logs.merge_new(old["reviews"], new["reviews"], words),
        "positions": logs.merge_state(old["positions"], new["positions"], "paper", ["sentence"]),
        "marks": logs.merge_state(old["marks"], new["marks"], "uid", ["paper", "sentence"], {"note": ""}),
    }


def merge_counts(added: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows of each table a merge adds."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in added.items()]
    rows = each[0]
    for x in each[1:]:
        rows = rows.union(x)
    return rows.groupBy().pivot("name", list(added)).agg(F.first("n"))
