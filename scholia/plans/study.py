"""Queries on learning: the review queue, merges of devices' records, marks and notes, blanks, the word list."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import srs, text, times
from scholia.operators import logs, papers, study
from scholia.plans import views as v
from scholia.plans.catalog import NOW, _as_long, query
from scholia.sources import adapters as a
from scholia.sources.stored import shared_folder
from scholia.streaming import reviews

LOOKUPS = """lookups AS (SELECT event_id AS uid, user_id AS headword, ts AS looked_at,
  CASE WHEN event_id % 3 > 0 THEN substr(props, 1, 20) END AS sentence FROM events)"""
WORDS = "words AS (SELECT c_custkey AS headword, TIMESTAMP '2024-01-01' + to_minutes(c_custkey) AS first_seen FROM customer)"


def lookups(spark: SparkSession, d: str) -> DataFrame:
    """(uid, headword, looked_at, sentence): the events as words looked up; every third has no sentence."""
    sentence = F.when(F.col("event_id") % 3 > 0, F.substring("props", 1, 20))
    return a.table(spark, d, "events").select(
        F.col("event_id").alias("uid"), F.col("user_id").alias("headword"), F.col("ts").alias("looked_at"), sentence.alias("sentence")
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    """(headword, first_seen): the customers as words, seen a minute after each other."""
    first = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("c_custkey").cast("int"))
    return a.table(spark, d, "customer").select(F.col("c_custkey").alias("headword"), first.alias("first_seen"))


@query(v.sql(v.REVIEWS, "past AS (SELECT * FROM reviews WHERE headword IS NOT NULL)", v.replay(), query=v.STATE))
def review_states_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The answers as a stream of files in two runs, the second from the first one's checkpoint: one device's, and then the
    other's, which are late as often as not, with the first one's again."""
    rows = a.reviews(spark, d)
    root = f"{shared_folder(spark)}/reviews-{uuid.uuid4().hex}"
    source, out, state = (f"{root}/{name}" for name in ("source", "states", "checkpoint"))
    for part in (rows.filter("device = 0"), rows):
        part.write.mode("append").parquet(source)
        reviews.run_states(spark.readStream.schema(rows.schema).parquet(source), out, state)
    return reviews.latest(spark.read.schema(reviews.STATES).parquet(out))


# --- the review queue ------------------------------------------------------------------------------------------------

def _next_sql(past: str, quota: int) -> str:
    """Each rating is tried as a further answer of the card's log, and that log is folded from its start."""
    waits = ", ".join(f"(SELECT due FROM after WHERE headword = {k}) - {NOW} AS {n}" for k, n in enumerate(("again", "hard", "good", "easy"), 1))
    return v.sql(
        v.REVIEWS, WORDS, f"past AS (SELECT * FROM reviews WHERE headword IS NOT NULL AND {past})", v.replay(),
        "cards AS (SELECT w.headword, w.first_seen, phase, due, n FROM words w LEFT JOIN states USING (headword))",
        f"used AS (SELECT count(*) AS used FROM (SELECT min(floor(epoch(reviewed_at))) AS f FROM past GROUP BY headword) WHERE f BETWEEN {NOW - NOW % 86400} AND {NOW})",
        f"""picks AS (SELECT headword, phase, n, 0 AS kind, due AS came FROM cards WHERE due <= {NOW}
  UNION ALL SELECT headword, 0, 0, 1, CAST(epoch(first_seen) AS BIGINT) FROM cards, used WHERE phase IS NULL AND used < {quota})""",
        "best AS (SELECT * FROM picks ORDER BY kind, came, headword LIMIT 1)",
        f"""tried AS (SELECT k AS headword, uid, rating, reviewed_at FROM past JOIN best USING (headword), range(1, 5) AS t(k)
  UNION ALL SELECT k, 1000000000000000, k, TIMESTAMP '1970-01-01' + to_seconds({NOW}) FROM range(1, 5) AS t(k))""",
        v.replay("tried", "after"),
        query=f"SELECT headword, ['New', 'Learning', 'Review', 'Relearning'][phase + 1] AS phase, n AS reviews, {waits} FROM best",
    )


def _past(spark: SparkSession, d: str) -> DataFrame:
    return a.reviews(spark, d).filter(times.seconds(F.col("reviewed_at")) <= NOW)


@query(_next_sql(f"floor(epoch(reviewed_at)) <= {NOW}", 20))
def review_next(spark: SparkSession, d: str) -> DataFrame:
    return study.next_card(words(spark, d), _past(spark, d), NOW)


@query(_next_sql("headword % 7 = 0 AND floor(epoch(reviewed_at)) <= 1704070000", 20))
def review_next_new(spark: SparkSession, d: str) -> DataFrame:
    """As it was when few words had been answered, none of them due before the new ones."""
    early = _past(spark, d).filter((F.col("headword") % 7 == 0) & (times.seconds(F.col("reviewed_at")) <= 1704070000))
    return study.next_card(words(spark, d), early, NOW)


@query(v.sql(v.REVIEWS, "gone AS (SELECT uid, headword FROM reviews WHERE device = 1 ORDER BY reviewed_at DESC, uid DESC LIMIT 1)",
    "past AS (SELECT * FROM reviews WHERE headword = (SELECT headword FROM gone) AND uid <> (SELECT uid FROM gone))", v.replay(),
    query=v.STATE))
def review_undo(spark: SparkSession, d: str) -> DataFrame:
    return study.undo(a.reviews(spark, d), 1)[1]


# --- merges ----------------------------------------------------------------------------------------------------------

#: What two devices recorded: device 0's is there, device 1's comes in, some of it without a key or a sentence.
_INCOMING = """progress_lookups AS (SELECT CASE WHEN uid % 11 > 0 THEN uid END AS uid, headword, looked_at, sentence FROM lookups WHERE uid % 4 > 0),
progress_reviews AS (SELECT CASE WHEN uid % 13 > 0 THEN uid END AS uid, CASE WHEN uid % 17 > 0 THEN headword END AS headword, rating, reviewed_at, device FROM reviews WHERE uid % 5 > 0),
progress_marks AS (SELECT uid, CASE WHEN event_id % 19 > 0 THEN paper END AS paper, CASE WHEN event_id % 3 > 0 THEN 's' || uid ELSE '' END AS sentence, CASE WHEN event_id % 2 > 0 THEN note END AS note, updated_at, deleted, device, event_id FROM marks WHERE device = 1),
known AS (SELECT c_custkey AS headword FROM customer WHERE c_custkey % 2 = 0)"""
_NEWER = """newest_{k} AS (SELECT * FROM progress_marks WHERE {k} IS NOT NULL AND {need} QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY updated_at DESC, event_id) = 1),
newer_{k} AS (SELECT n.* FROM newest_{k} n LEFT JOIN (SELECT {k}, max(updated_at) AS had FROM marks WHERE device = 0 GROUP BY 1) o USING ({k}) WHERE had IS NULL OR n.updated_at > had)"""
_BY_PAPER, _BY_UID = _NEWER.format(k="paper", need="sentence <> ''"), _NEWER.format(k="uid", need="paper IS NOT NULL AND sentence <> ''")


def _progress(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    seen, rows = lookups(spark, d), a.reviews(spark, d)
    marks = a.marks(spark, d).withColumn("sentence", F.concat(F.lit("s"), F.col("uid").cast("string")))
    new = marks.filter("device = 1").withColumns({
        "paper": F.when(F.col("event_id") % 19 > 0, F.col("paper")), "sentence": F.when(F.col("event_id") % 3 > 0,
            F.col("sentence")).otherwise(""), "note": F.when(F.col("event_id") % 2 > 0, F.col("note")),
    })
    uid = F.col("uid")
    old = {"lookups": seen.filter("uid % 3 = 0"), "reviews": rows.filter("device = 0"), "positions": marks.filter("device = 0"),
         "marks": marks.filter("device = 0")}
    incoming = {
        "lookups": seen.filter("uid % 4 > 0").withColumn("uid", F.when(uid % 11 > 0, uid)),
        "reviews": rows.filter("uid % 5 > 0").select(F.when(uid % 13 > 0, uid).alias("uid"), F.when(uid % 17 > 0,
            F.col("headword")).alias("headword"), "rating", "reviewed_at", "device"),
        "positions": new, "marks": new,
    }
    return old, incoming


@query(v.sql(v.REVIEWS, v.MARKS, LOOKUPS, _INCOMING, _BY_PAPER, _BY_UID,
    "new_lookups AS (SELECT DISTINCT uid, headword FROM progress_lookups WHERE uid IS NOT NULL AND headword IS NOT NULL AND uid % 3 > 0)",
    query="""SELECT (SELECT count(*) FROM new_lookups) AS lookups,
  (SELECT count(DISTINCT uid) FROM progress_reviews WHERE uid IS NOT NULL AND uid % 2 > 0 AND headword IN (SELECT headword FROM known UNION SELECT headword FROM new_lookups)) AS reviews,
  (SELECT count(*) FROM newer_paper) AS positions, (SELECT count(*) FROM newer_uid) AS marks"""))  # fmt: skip
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    known = a.table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("headword"))
    return study.merge_counts(study.merge_progress(known, *_progress(spark, d)))


@query(v.sql(v.MARKS, LOOKUPS, v.REVIEWS, _INCOMING, _BY_UID, query="""SELECT uid, paper, coalesce(note, '') AS note, updated_at, deleted, device FROM newer_uid
  UNION ALL SELECT uid, paper, note, updated_at, deleted, device FROM marks WHERE device = 0 AND uid NOT IN (SELECT uid FROM newer_uid)"""))
def marks_merged(spark: SparkSession, d: str) -> DataFrame:
    old, new = _progress(spark, d)
    changes = logs.merge_state(old["marks"], new["marks"], "uid", ["paper", "sentence"], {"note": ""})
    return logs.merged(old["marks"], changes, "uid").select("uid", "paper", "note", "updated_at", "deleted", "device")


@query(v.sql(v.MARKS,
     "stamped AS (SELECT *, CAST(floor(epoch(updated_at)) AS BIGINT) - CASE WHEN event_id % 3 = 0 THEN 0 ELSE 32400 "
     "END AS moment FROM marks)",
    query="SELECT uid, moment, event_id, note FROM stamped QUALIFY row_number() OVER (PARTITION BY uid ORDER BY "
         "moment DESC, event_id) = 1"))  # fmt: skip
def lww_across_zones(spark: SparkSession, d: str) -> DataFrame:
    """Versions stamped in UTC, with an offset, and in a device's local time without any."""
    local = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss")
    zone = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+09:00").otherwise("")
    rows = a.marks(spark, d).select("uid", times.seconds(times.instant(F.concat(local, zone), "Asia/Tokyo")).alias("moment"), "event_id", "note")
    return logs.last_write(rows, "uid", "moment")


@query(v.sql(v.REVIEWS, query="""SELECT uid, strftime(reviewed_at + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') AS local_time,
  CAST(floor((epoch(reviewed_at) + 32400) / 86400) * 86400 - 32400 AS BIGINT) AS midnight FROM reviews"""))
def phone_times(spark: SparkSession, d: str) -> DataFrame:
    at = times.seconds(F.col("reviewed_at"))
    return a.reviews(spark, d).select("uid", times.local_stamp(at, "Asia/Tokyo").alias("local_time"), times.local_midnight(at,
         "Asia/Tokyo").alias("midnight"))


# --- marks, notes, saves ---------------------------------------------------------------------------------------------

_PLACED = """placed AS (SELECT uid, paper, uid % 7 AS sentence, updated_at, deleted FROM marks QUALIFY row_number() OVER (PARTITION BY uid ORDER BY updated_at DESC, event_id) = 1),
taps AS (SELECT 1000000 + p * 7 + s AS uid, p AS paper, s AS sentence FROM (SELECT DISTINCT event_id % 50 AS p FROM events), (SELECT unnest(range(0, 7)) AS s) WHERE (p + s) % 3 = 0)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_write(a.marks(spark, d), "uid").select("uid", "paper", (F.col("uid") % 7).alias("sentence"), "updated_at", "deleted")


@query(v.sql(v.MARKS, _PLACED, query="""SELECT p.uid, p.paper, p.sentence, CASE WHEN t.uid IS NOT NULL AND deleted = 0 THEN TIMESTAMP '2024-02-01' ELSE updated_at END AS updated_at, CASE WHEN t.uid IS NOT NULL THEN 1 ELSE deleted END AS deleted
  FROM placed p LEFT JOIN taps t ON t.paper = p.paper AND t.sentence = p.sentence
  UNION ALL SELECT uid, paper, sentence, TIMESTAMP '2024-02-01', 0 FROM taps t WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.paper = t.paper AND p.sentence = t.sentence AND deleted = 0)"""))
def marks_toggled(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    p = a.table(spark, d, "events").select((F.col("event_id") % 50).alias("paper")).distinct()
    taps = p.select("paper", F.explode(F.sequence(F.lit(0).cast("long"),
        F.lit(6).cast("long"))).alias("sentence")).filter("(paper + sentence) % 3 = 0")
    taps = taps.select((1_000_000 + F.col("paper") * 7 + F.col("sentence")).alias("uid"), "paper", "sentence", at.alias("at"))
    return _as_long(logs.toggle_marks(_placed(spark, d), taps), "deleted")


@query(v.sql(v.MARKS,
     "m AS (SELECT uid, note, updated_at FROM marks QUALIFY row_number() OVER (PARTITION BY uid ORDER BY updated_at "
     "DESC, event_id) = 1)",
    query="SELECT uid, CASE WHEN uid % 4 = 0 THEN substr(repeat('n' || uid, 600), 1, 2000) WHEN uid % 4 = 1 THEN "
         "'short' ELSE note END AS note, CASE WHEN uid % 4 < 2 THEN TIMESTAMP '2024-02-01' ELSE updated_at END AS "
         "updated_at FROM m"))  # fmt: skip
def marks_noted(spark: SparkSession, d: str) -> DataFrame:
    m = logs.last_write(a.marks(spark, d), "uid").select("uid", "note", "updated_at")
    uid = F.col("uid").cast("string")
    new = F.when(F.col("uid") % 4 == 0, F.concat(F.lit("  "), F.repeat(F.concat(F.lit("n"), uid), 600))).otherwise(" short ")
    return logs.with_notes(m, m.filter("uid % 4 < 2").select("uid", new.alias("new"), F.lit("2024-02-01").cast("timestamp_ntz").alias("at")))


@query(v.sql(v.MARKS, "saves AS (SELECT paper, CAST(floor(epoch(updated_at)) AS BIGINT) AS moment FROM marks)",
    query="SELECT paper, unnest(list_reduce(list_transform(list(moment ORDER BY moment), lambda x: [x]), lambda "
         "kept, x: CASE WHEN x[1] - kept[-1] >= 21600 THEN list_append(kept, x[1]) ELSE kept END)) AS moment FROM "
         "saves GROUP BY paper"))  # fmt: skip
def position_throttle(spark: SparkSession, d: str) -> DataFrame:
    saves = a.marks(spark, d).select("paper", times.seconds(F.col("updated_at")).alias("at"))
    return logs.throttled(saves, "paper", 21_600).select("paper", F.explode("kept").alias("moment"))


@query(v.sql(v.REVIEWS, LOOKUPS, WORDS, "gone AS (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150 AND user_id IS NOT NULL)",
    query="SELECT 'words' AS name, count(*) AS n FROM words WHERE headword NOT IN (FROM gone) UNION ALL SELECT "
         "'lookups', count(*) FROM lookups WHERE headword NOT IN (FROM gone) UNION ALL SELECT 'reviews', count(*) "
         "FROM reviews WHERE headword NOT IN (FROM gone)"))  # fmt: skip
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = a.table(spark, d, "events").filter("event_type = 'error' and value > 150").select(F.col("user_id").alias("headword"))
    left = logs.without_words(words(spark, d), lookups(spark, d), a.reviews(spark, d), gone)
    return reduce(DataFrame.union, [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in zip(("words",
         "lookups", "reviews"), left, strict=True)])


# --- practice --------------------------------------------------------------------------------------------------------

_SCORED = """scored AS (SELECT headword, uid % 5 + 1 AS level, CASE WHEN rating >= 3 THEN 1.0 WHEN rating = 2 THEN 0.5 ELSE 0.0 END AS score, reviewed_at, uid FROM reviews),
last20 AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY headword, level ORDER BY reviewed_at DESC, uid DESC) <= 20),
rates AS (SELECT headword, level, count(*) AS n, avg(score) AS rate FROM last20 GROUP BY 1, 2)"""


@query(v.sql(v.REVIEWS, _SCORED,
    query="SELECT headword, level, n, round(rate, 6) AS rate, CASE WHEN n < 10 THEN 'none' WHEN rate > 0.9 AND level < 5 "
     "THEN 'up' WHEN rate < 0.5 AND level > 1 THEN 'down' ELSE 'none' END AS advice FROM rates"))
def level_advice(spark: SparkSession, d: str) -> DataFrame:
    score = F.when(F.col("rating") >= 3, 1.0).when(F.col("rating") == 2, 0.5).otherwise(0.0)
    history = a.reviews(spark, d).select("headword", (F.col("uid") % 5 + 1).alias("level"), score.alias("score"),
        F.col("reviewed_at").alias("at"), "uid")
    return study.level_advice(history, "headword").withColumn("rate", F.round("rate", 6))


_COMMON = ", ".join(f"'{w}'" for w in study.COMMON)
_SHOWN = """shown AS (SELECT conv_id, turn, pos - 1 AS pos, w[pos] AS word FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS pos
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z](?:[A-Za-z''’-]*[A-Za-z])?') AS w FROM conversations)))"""
_BLANKS = f"""levels AS (SELECT unnest(range(1, 6)) AS level),
pool AS (SELECT *, lower(word) NOT IN ({_COMMON}) AND length(word) >= 3 AND (level >= 4 OR NOT regexp_matches(word, '^[A-Z0-9]{{2,}}s?$')) OR level = 5 AS good FROM shown, levels),
fit AS (SELECT *, md5('7:' || conv_id || ':' || turn || ':' || pos) AS h FROM pool QUALIFY good OR count(*) FILTER (good) OVER (PARTITION BY level, conv_id, turn) = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY level, conv_id, turn ORDER BY h, pos) AS place, count(*) OVER (PARTITION BY level, conv_id, turn) AS size FROM fit)"""


def _shown(spark: SparkSession, d: str) -> DataFrame:
    rows = a.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(text.shown_words(F.col("text"))))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("col").alias("word"))


@query(v.sql(_SHOWN, query="SELECT word, count(*) AS n, min(conv_id) AS first_conv FROM shown GROUP BY 1"))
def shown_words(spark: SparkSession, d: str) -> DataFrame:
    return _shown(spark, d).groupBy("word").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


@query(v.sql(_SHOWN, _BLANKS, query="""SELECT level, conv_id, turn, pos, word FROM placed
  WHERE level >= 4 OR place <= CASE level WHEN 1 THEN 1 WHEN 2 THEN greatest(1, floor(0.2 * size + 0.5)) ELSE greatest(2, floor(0.4 * size + 0.5)) END"""))
def blank_selection(spark: SparkSession, d: str) -> DataFrame:
    rows = _shown(spark, d)
    each = [study.blanks(rows, ["conv_id", "turn"], level).select(F.lit(level).cast("long").alias("level"), "conv_id", "turn",
         "pos", "word") for level in range(1, 6)]
    return reduce(DataFrame.union, each)


@query(v.sql(LOOKUPS,
    query="SELECT headword, uid, row_number() OVER (PARTITION BY headword ORDER BY looked_at DESC, uid DESC) AS back "
     "FROM lookups WHERE sentence IS NOT NULL QUALIFY back <= 3"))
def vocab_top_examples(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(study.latest_examples(lookups(spark, d)).select("headword", "uid", "back"), "back")


@query(v.sql(LOOKUPS,
     "seen AS (SELECT headword, max(looked_at) AS last_seen, count(*) AS lookups, arg_max(uid, (looked_at, uid)) AS "
     "newest FROM lookups GROUP BY 1)",
    query="SELECT s.headword, last_seen, lookups, l.sentence AS example FROM (SELECT * FROM seen ORDER BY last_seen "
         "DESC, headword LIMIT 500) s LEFT JOIN lookups l ON l.uid = newest"))  # fmt: skip
def vocab_list(spark: SparkSession, d: str) -> DataFrame:
    seen = lookups(spark, d)
    known = seen.groupBy("headword").agg(F.max("looked_at").alias("last_seen"), F.count("*").alias("lookups"))
    return study.word_list(known, seen)


@query(v.sql(v.REVIEWS, "e AS (SELECT headword, uid, CASE WHEN uid % 4 = 0 THEN 't' || uid END AS translated, row_number() OVER "
     "(PARTITION BY headword ORDER BY reviewed_at DESC, uid DESC) AS back, count(*) OVER (PARTITION BY headword) AS "
     "n FROM reviews QUALIFY back <= 3)",
    "pools AS (SELECT headword, any_value(n) AS n, CASE WHEN count(translated) > 0 THEN list(uid ORDER BY "
         "back) FILTER (translated IS NOT NULL) ELSE list(uid ORDER BY back) END AS pool FROM e GROUP BY 1)",
    query="SELECT headword, pool[CAST(n % len(pool) AS INT) + 1] AS example FROM pools"))
def example_rotation(spark: SparkSession, d: str) -> DataFrame:
    rows = a.reviews(spark, d)
    last = logs.tail(rows, "headword", 3, [F.desc("reviewed_at"), F.desc("uid")])
    translated = F.when(F.col("uid") % 4 == 0, F.concat(F.lit("t"), F.col("uid").cast("string")))
    cards = last.groupBy("headword").agg(F.array_sort(F.collect_list(F.struct("back", "uid", translated.alias("translated")))).alias("examples"))
    n = rows.groupBy("headword").agg(F.count("*").alias("n"))
    return cards.join(n, "headword").select("headword", text.example_at(F.col("examples"), F.col("n"))["uid"].alias("example"))


@query("""SELECT rule_id, find, put, find <> lower(find) AS whole_case FROM (SELECT p_partkey AS rule_id, trim(p_name, ' ') AS find, repeat(p_name, CAST(p_partkey % 9 AS INT)) AS put FROM part)
  WHERE find <> '' AND trim(put, ' ') <> '' AND length(find) <= 60 AND length(trim(put, ' ')) <= 120 QUALIFY row_number() OVER (PARTITION BY find ORDER BY rule_id) = 1""")
def rule_dedup(spark: SparkSession, d: str) -> DataFrame:
    rules = a.table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("find"),
        F.expr("repeat(p_name, cast(p_partkey % 9 as int))").alias("put"), F.lit(None).cast("boolean").alias("whole_case"))
    return papers.kept_rules(rules)
