"""More queries of the catalog: layout, quizzes, vocabulary checks, fallbacks and log upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import layout, papers
from scholia.plans import views as v
from scholia.plans.catalog import _as_long, query
from scholia.sources import adapters as a
from scholia.sources.stored import stored

_BOXES = "boxes AS (SELECT l_orderkey AS page, min(l_linenumber) AS box, min(l_quantity) AS x0, min(l_quantity) + 20 AS x1, min(l_discount) AS y0, min(l_discount) + 0.03 AS y1 FROM lineitem GROUP BY 1)"
_LINES = "marks AS (SELECT l_orderkey AS page, l_partkey AS line, min(l_quantity) AS x, min(l_discount) AS y, max(l_extendedprice) AS width FROM lineitem GROUP BY 1, 2)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic boxes on pages (orders): one each, from its smallest quantity and discount."""
    return a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(F.min("l_linenumber").alias("box"),
        F.min("l_quantity").alias("x0"), (F.min("l_quantity") + 20).alias("x1"), F.min("l_discount").alias("y0"),
        (F.min("l_discount") + 0.03).alias("y1"))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return a.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"),
        F.col("l_partkey").alias("line")).agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"),
        F.max("l_extendedprice").alias("width"))


@query(v.sql(_BOXES, _LINES,
    query="SELECT page, line, x, y FROM marks m WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = m.page AND m.x "
     "BETWEEN x0 AND x1 AND m.y BETWEEN y0 AND y1)"))
def lines_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    return layout.outside(_marks(spark, d), _boxes(spark, d)).select("page", "line", "x", "y")


@query(v.sql(_LINES,
    query="SELECT page, round(avg(CASE WHEN width >= 40000 THEN 1.0 ELSE 0.0 END), 6) AS wide_share, avg(CASE WHEN width "
     ">= 40000 THEN 1.0 ELSE 0.0 END) >= 0.35 AS single FROM marks GROUP BY 1"))
def single_column_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.single_column(_marks(spark, d), 40000).withColumn("wide_share", F.round("wide_share", 6))


@query(v.sql(_LINES, query="SELECT page, line, row_number() OVER (PARTITION BY page ORDER BY line % 2, round(y * 100), x, line) AS place FROM marks"))
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    rows = _marks(spark, d).select("page", "line", "x", (F.col("y") * 100).alias("y"), (F.col("line") % 2).alias("col"))
    return _as_long(layout.reading_order(rows).select("page", "line", "place"), "place")


@query(v.sql(v.REVIEWS,
    query="SELECT headword, count(*) AS n, max(c) / sum(c) > 0.6 AND sum(c) >= 6 AS skewed FROM (SELECT headword, "
     "rating, count(*) AS c FROM reviews GROUP BY 1, 2) GROUP BY 1"))
def answer_position_skew(spark: SparkSession, d: str) -> DataFrame:
    c = a.reviews(spark, d).groupBy("headword", "rating").agg(F.count("*").alias("c"))
    return c.groupBy("headword").agg(F.count("*").alias("n"), ((F.max("c") / F.sum("c") > 0.6) & (F.sum("c") >= 6)).alias("skewed"))


@query(v.sql(v.REVIEWS,
    query="SELECT headword, device, rating FROM reviews QUALIFY row_number() OVER (PARTITION BY headword, device ORDER "
     "BY reviewed_at DESC, uid DESC) = 1"))
def last_attempt(spark: SparkSession, d: str) -> DataFrame:
    return a.reviews(spark, d).groupBy("headword", "device").agg(F.max_by("rating", F.struct("reviewed_at", "uid")).alias("rating"))


@query("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events "
     "UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations")
def table_cardinalities(spark: SparkSession, d: str) -> DataFrame:
    one = lambda n: a.table(spark, d, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")).select("name", "n")
    return one("documents").union(one("events")).union(one("pages")).union(one("conversations"))


# --- references, ids, labels -----------------------------------------------------------------------------------------


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, v.REFERENCES, v.FIRST_REFERENCE,
    "labels AS (SELECT doc_id, key, min(n) AS label_n FROM first_refs WHERE n % 4 > 0 GROUP BY 1, 2)",
    query="SELECT doc_id, n, key, label_n FROM refs LEFT JOIN labels USING (doc_id, key)"))
def references_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Each reference with the first line that the figure's label is on; synthetic: three lines of four are read as labels."""
    lines = stored(a.annotated(spark, d).select("doc_id", "n", text.figure_keys(F.col("body")).alias("keys")).filter(F.size("keys") > 0))
    labels = lines.filter("n % 4 > 0").select("doc_id", "n", F.get("keys", F.lit(0)).alias("key"))
    refs = lines.select("doc_id", "n", F.explode("keys").alias("key"))
    return _as_long(papers.resolved(refs, labels), "n", "label_n")


@query(v.sql(v.PAPERS, """asked AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(paper_id) WHEN 1 THEN paper_id || '0' WHEN 2 THEN '../' || paper_id WHEN 3 THEN substr(paper_id, 2) || chr(10) ELSE paper_id END AS id FROM papers)""",
    query="SELECT doc_id, length(id) = 8 AND length(replace(translate(id, '0123456789abcdef', '0000000000000000'), '0', '')) = 0 AS valid FROM asked"))
def paper_ids_valid(spark: SparkSession, d: str) -> DataFrame:
    """Ids as they may come in a request: in capitals, too long, as a path, with a line feed, and right ones."""
    m, i = F.col("doc_id") % 5, F.col("paper_id")
    asked = F.when(m == 0, F.upper(i)).when(m == 1, F.concat(i, F.lit("0"))).when(m == 2, F.concat(F.lit("../"), i)).when(m == 3,
        F.concat(F.substring(i, 2, 7), F.lit("\n"))).otherwise(i)
    return a.papers(spark, d).select("doc_id", text.valid_id(asked).alias("valid"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'open /Users/~/a b.log ' WHEN 1 THEN 'at /home/~ and /home/~/' WHEN 2 THEN 'C:' || chr(92) || 'Users' || chr(92) || '~' || chr(92) ELSE '/var/home of u' || user_id || ' ' END || event_type AS line FROM events""")
def log_lines_scrubbed(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    forms = ["open /Users/#/a b.log ", "at /home/# and /home/#/", "C:\\Users\\#\\", "/var/home of # "]
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("event_id") % 4).cast("int"))
    line = F.concat(F.replace(form, F.lit("#"), name), F.col("event_type"))
    return a.table(spark, d, "events").select("event_id", text.scrub(line).alias("line"))


@query(v.sql(v.PAPERS, v.LINES, query=r"SELECT doc_id, n, regexp_replace(line, '(?i)\b(de[a-z0-9_]*)', '<mark>\1</mark>', 'g') AS marked FROM lines"))
def review_highlights(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(a.lines(spark, d).select("doc_id", "n", text.highlighted(F.col("line"), F.lit("De")).alias("marked")), "n")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d') ELSE 'unknown' END AS label FROM events""")
def date_labels(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 3
    at = F.when(m == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, "")
    return a.table(spark, d, "events").select("event_id", text.date_label(at).alias("label"))


@query("""SELECT event_id, n || ' ' || unit || CASE WHEN n = 1 OR unit = 'min' THEN '' ELSE 's' END AS label FROM (SELECT event_id, unit, CAST(CASE unit WHEN 'min' THEN greatest(1, (s + 30) // 60) WHEN 'hour' THEN round_even(s / 3600, 0) WHEN 'day' THEN days
    WHEN 'month' THEN round_even(days / 30, 0) ELSE round_even(days / 365, 0) END AS BIGINT) AS n
  FROM (SELECT *, CASE WHEN s < 3600 THEN 'min' WHEN s < 86400 THEN 'hour' WHEN days < 30 THEN 'day' WHEN days < 365 THEN 'month' ELSE 'year' END AS unit
    FROM (SELECT *, round_even(s / 86400, 0) AS days FROM (SELECT event_id, (event_id * 7919 % 10007) * [1, 30, 900, 43200][event_id % 4 + 1] AS s FROM events))))""")
def interval_labels(spark: SparkSession, d: str) -> DataFrame:
    unit = F.get(F.array(*[F.lit(x) for x in (1, 30, 900, 43200)]), (F.col("event_id") % 4).cast("int"))
    return a.table(spark, d, "events").select("event_id", text.human(F.col("event_id") * 7919 % 10007 * unit).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 2 THEN 1 WHEN event_id % 5 = 2 OR event_id % 7 = 0 THEN 2 ELSE 3 END AS rating FROM events")
def rating_suggested(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 5
    grade = F.when(m < 2, "wrong").when(m == 2, "near").when(m == 3, "exact").otherwise("base")
    return a.table(spark, d, "events").select("event_id", text.suggested_rating(grade, F.col("event_id") % 7 == 0).alias("rating"))
