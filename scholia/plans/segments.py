"""Queries on sentence boundaries that the texts themselves teach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.align import WORD
from scholia.operators import segments
from scholia.plans import views as v
from scholia.plans.catalog import query
from scholia.sources import adapters as a

_KEYS = ["doc_id", "n"]
_WORD, _TRIM = WORD.replace("'", "''"), f"^{segments._OPENS}|{segments._CLOSES}$".replace("'", "''")
_CAPITAL = f"regexp_matches({{}}, '^[{segments.CAPITAL}]')"
_LETTER = f"[{segments.SMALL}{segments.CAPITAL}]"
_TYPE = rf"CASE WHEN regexp_matches({{0}}, '{_LETTER}') THEN lower(regexp_replace({{0}}, '\.$', '')) END"
_WORDS = rf"""split AS (SELECT doc_id, n, list_transform(regexp_extract_all(body, '({_WORD})'), lambda w: regexp_replace(w, '{_TRIM}', '', 'g')) AS ws FROM annotated),
words AS MATERIALIZED (SELECT doc_id, n, i - 1 AS k, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS before, ws[i + 1] AS after FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM split)),
typed AS MATERIALIZED (SELECT *, {_TYPE.format("word")} AS type, {_TYPE.format("after")} AS next, ends_with(word, '.') AS stop, coalesce({_CAPITAL.format("after")}, false) AS next_capital FROM words),
types AS MATERIALIZED (SELECT type, count(*) AS n, count(*) FILTER (stop) AS n_stop, count(*) FILTER (NOT {_CAPITAL.format("word")}) AS n_small,
  count(*) FILTER ({_CAPITAL.format("word")} AND NOT regexp_matches(before, '[.!?:]$')) AS n_capital FROM typed WHERE type IS NOT NULL GROUP BY type),
totals AS (SELECT sum(n)::DOUBLE AS words, sum(n_stop)::DOUBLE AS stops FROM types),
weighed AS (SELECT type, -2 * ((n_stop * ln(stops / words) + (n - n_stop) * ln(1 - stops / words)) - (n_stop * ln(0.99) + (n - n_stop) * ln(0.01))) * exp(-l) * (length(type) - l + 1) * pow(l, n_stop - n) AS score
  FROM (SELECT *, length(replace(type, '.', '')) AS l FROM types), totals WHERE n_stop > 0 AND l > 0 AND stops < words),
short AS MATERIALIZED (SELECT * FROM weighed WHERE score >= {segments.ABBREVIATION})"""


def _ratio(a: str, b: str, both: str, n: str) -> str:
    """Twice the mutual information of the two-by-two table of counts."""
    cells = [(both, a, b), (f"({a} - {both})", a, f"({n} - {b})"), (f"({b} - {both})", f"({n} - {a})", b), (f"({n} - {a} - {b} + {both})", f"({n} - {a})", f"({n} - {b})")]
    return "2 * (" + " + ".join(f"CASE WHEN {k} > 0 THEN {k} * ln({k}::DOUBLE * {n} / ({r}::DOUBLE * {c})) ELSE 0 END" for k, r, c in cells) + ")"


_STARTERS = f"""starts AS (SELECT next AS type, count(*) AS first FROM typed WHERE stop AND next_capital AND length(type) > 1 AND next IS NOT NULL AND type NOT IN (SELECT type FROM short) GROUP BY next),
starters AS MATERIALIZED (SELECT type, ratio FROM (SELECT s.type, {_ratio("ends", "n", "first", "words")} AS ratio, n / words < first / ends AS often
  FROM starts s JOIN types USING (type), totals, (SELECT sum(first) AS ends FROM starts)) WHERE often AND ratio >= {segments.STARTER})"""
_TOGETHER = f"""together AS MATERIALIZED (SELECT type, after, ratio FROM (SELECT p.type, p.next AS after, {_ratio("x.n", "y.n", "p.c", "words")} AS ratio, p.c / x.n > y.n / words AS often
  FROM (SELECT type, next, count(*) AS c FROM typed WHERE stop AND next IS NOT NULL AND type IN (SELECT type FROM short) GROUP BY ALL) p JOIN types x ON x.type = p.type JOIN types y ON y.type = p.next, totals)
  WHERE often AND ratio >= {segments.COLLOCATION})"""
_FROM = v.PAPERS, v.LINES, v.ANNOTATED, _WORDS


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return a.annotated(spark, d).select("doc_id", "n", F.col("body").alias("text"))


@query(v.sql(*_FROM, query="SELECT s.type, n, n_stop, n_small, n_capital, round(score, 4) AS score FROM short s JOIN types USING (type)"))
def abbreviations_learned(spark: SparkSession, d: str) -> DataFrame:
    types = segments.stored(segments.type_counts(segments.word_counts(segments.word_rows(_texts(spark, d), _KEYS))))
    return segments.abbreviations(types).join(types, "type").select("type", "n", "n_stop", "n_small", "n_capital", F.round("score", 4).alias("score"))


@query(v.sql(*_FROM, _STARTERS, _TOGETHER, query="SELECT 'starter' AS kind, type, NULL AS after, round(ratio, 4) AS ratio FROM starters UNION ALL SELECT 'collocation', type, after, round(ratio, 4) FROM together"))
def starters_learned(spark: SparkSession, d: str) -> DataFrame:
    model = segments.learn(_texts(spark, d), _KEYS)
    first = model.starters.select(F.lit("starter").alias("kind"), "type", F.lit(None).cast("string").alias("after"), F.round("ratio", 4).alias("ratio"))
    return first.union(model.collocations.select(F.lit("collocation"), "type", "after", F.round("ratio", 4)))


@query(v.sql(*_FROM, _STARTERS, _TOGETHER,
    query="""SELECT doc_id, t.n, k, t.type, next AS after, next_capital AND g.type IS NULL AND (s.type IS NOT NULL OR coalesce(y.n_small > 0 AND y.n_capital = 0, false)) AS ends
  FROM typed t JOIN short USING (type) LEFT JOIN starters s ON s.type = next LEFT JOIN together g ON g.type = t.type AND g.after = next LEFT JOIN types y ON y.type = next WHERE stop AND t.after IS NOT NULL"""))  # fmt: skip
def stops_decided(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return segments.decided(texts, _KEYS, segments.learn(texts, _KEYS))


@query()
def sentences_learned(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return segments.sentences(texts, _KEYS, segments.learn(texts, _KEYS))
