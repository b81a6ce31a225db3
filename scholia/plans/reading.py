"""Queries on papers as they are read: marks in order, speech plans, chapters, quizzes, loading, comparison, the glossary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators import logs, papers, quality, reading, terms
from scholia.plans import views as v
from scholia.plans.catalog import _COUNTS, _LOOKUP, _WORDS, _as_long, query
from scholia.plans.papers import _PAPER
from scholia.sources import adapters as a
from scholia.sources.stored import stored


def spoken_sql(x: str) -> str:
    """`text.speech` as a chain of patterns."""
    rules = [
        (r"\s*\([^()]*\b(19|20)\d\d[a-z]?\b[^()]*\)", ""), (r"\s*\[\d+(\s*[,–-]\s*\d+)*\]", ""),
        ("([A-Za-z]{4}|[.,;:)\\]])[⁰¹²³⁴⁵⁶⁷⁸⁹]+([˒⁻,–-][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*", r"\1"), (r"\s+([.,;:])", r"\1"),
    ]
    for find, put in rules:
        x = f"regexp_replace({x}, '{find}', '{put}', 'g')"
    return f"trim({x}, ' ')"


_NUMBER = r"regexp_extract(title, '^(\d+(?:\.\d+)*)\.?\s', 1)"


def headed_sql(number: str, title: str) -> str:
    words = f"array_to_string(list_transform(string_split(lower({title}), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
    said = f"CASE WHEN upper({title}) = {title} AND lower({title}) <> {title} THEN {words} ELSE {title} END"
    return f"CASE WHEN {number} <> '' THEN 'Section ' || {number} || '. ' ELSE '' END || {said} || '.'"


# --- marks -----------------------------------------------------------------------------------------------------------

_MARKED = """live AS (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY uid ORDER BY updated_at DESC, event_id) = 1),
picked AS (SELECT l.uid, l.paper AS doc_id, CASE WHEN l.uid % 5 > 0 THEN s.text ELSE 'gone' END AS sentence, 'kept ' || l.uid % 3 AS section, l.note, l.updated_at
  FROM live l LEFT JOIN sentences s ON s.doc_id = l.paper AND s.section = l.uid % 4 + 1 AND s.k = 1 WHERE l.deleted = 0),
firsts AS (SELECT doc_id, text, section, k, title FROM sentences JOIN (SELECT doc_id, n AS section, title FROM sections) USING (doc_id, section) QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY section, k) = 1),
placed AS (SELECT p.*, f.section AS s, f.k, f.title, CASE WHEN f.section % 3 > 0 THEN 't' || f.section || '_' || f.k END AS translated, row_number() OVER w AS place FROM picked p LEFT JOIN firsts f ON f.doc_id = p.doc_id AND f.text = p.sentence
  WINDOW w AS (PARTITION BY p.doc_id ORDER BY coalesce(f.section, 1000000000), coalesce(f.k, 1000000000), p.updated_at, p.uid))"""


@query(v.sql(*_PAPER, v.MARKS, _MARKED, query="""SELECT doc_id AS paper_id, uid, place, coalesce(title, section) AS section, sentence, translated, note,
  coalesce(coalesce(title, section) IS DISTINCT FROM lag(coalesce(title, section)) OVER (PARTITION BY doc_id ORDER BY place), true) OR place = 1 AS new_header FROM placed"""))
def marks_export_rows(spark: SparkSession, d: str) -> DataFrame:
    sections, sentences = a.outlined(spark, d)
    live = logs.live(a.marks(spark, d), "uid").withColumn("at", F.col("uid") % 4 + 1)
    said = sentences.filter("k = 1").select(F.col("doc_id").alias("paper"), F.col("section").alias("at"), "text")
    marks = live.join(said, ["paper", "at"], "left").select(
        "uid", F.col("paper").alias("paper_id"), F.when(F.col("uid") % 5 > 0, F.col("text")).otherwise("gone").alias("sentence"),
        F.concat(F.lit("kept "), (F.col("uid") % 3).cast("string")).alias("section"), "note", F.col("updated_at").alias("created_at"),
    )
    translated = F.concat(F.lit("t"), F.col("section").cast("string"), F.lit("_"), F.col("k").cast("string"))
    translations = sentences.filter("section % 3 > 0").select("doc_id", "section", "k", translated.alias("translated"))
    return _as_long(reading.marks_in_order(marks, sections, sentences, translations), "place")


# --- speech ----------------------------------------------------------------------------------------------------------

_ITEMS = f"""items AS (SELECT doc_id, section, k, 's' || section || '_' || k AS item_id, {spoken_sql('text')} AS said FROM sentences JOIN (SELECT doc_id, n AS section FROM sections WHERE kind <> 'back') USING (doc_id, section)
  UNION ALL SELECT doc_id, n, 0, 's' || n || '_h', {headed_sql('number', 'title')} FROM sections WHERE kind <> 'back')"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    sections, sentences = a.outlined(spark, d)
    return reading.spoken_items(sections, sentences.withColumn("spoken", text.speech(F.col("text"))), skip_back=True)


@query(v.sql(*_PAPER, _ITEMS,
     "kept AS (SELECT sha1('v|175|' || said) [1:20] AS key, max(length(said)) / 10.0 AS seconds FROM items WHERE "
     "said <> '' AND doc_id % 2 = 0 GROUP BY 1)",
    query="SELECT doc_id, item_id, i.key, seconds IS NOT NULL AS reused, round(seconds, 3) AS seconds FROM (SELECT "
         "*, sha1('v|175|' || said)[1:20] AS key FROM items WHERE said <> '') i LEFT JOIN kept USING (key)"))  # fmt: skip
def speech_plan(spark: SparkSession, d: str) -> DataFrame:
    items = _items(spark, d)
    cache = items.filter("doc_id % 2 = 0").select(reading.cache_key(F.col("said"), "v", 175).alias("key"), (F.length("said") / 10).alias("seconds"))
    return reading.speech_plan(items, cache, "v", 175).select("doc_id", "item_id", "key", "reused", F.round("seconds", 3).alias("seconds"))


@query(v.sql(*_PAPER, _ITEMS.replace("WHERE kind <> 'back'", ""), query="SELECT doc_id, section, k, item_id, said FROM items WHERE k = 0 OR said <> ''"))
def playlist_with_back(spark: SparkSession, d: str) -> DataFrame:
    """All that is read of the papers, back matter too."""
    sections, sentences = a.outlined(spark, d)
    return _as_long(reading.spoken_items(sections, sentences.withColumn("spoken", text.speech(F.col("text")))), "section")


_CHAPTERS = """kept AS (SELECT *, level = 1 OR row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1 AS opens FROM sections WHERE kind <> 'back'),
counted AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY n) AS chapter FROM kept)"""


@query(v.sql(*_PAPER, _CHAPTERS, query="SELECT doc_id, n, chapter, lpad(chapter::VARCHAR, 2, '0') || '_' || "
     "coalesce(nullif(substr(array_to_string(regexp_extract_all(first_value(title) OVER (PARTITION BY doc_id, "
     "chapter ORDER BY n), '[A-Za-z0-9]+'), '_'), 1, 60), ''), 'section') || '.m4a' AS file FROM counted"))
def chapter_files(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(reading.chapters(a.outlined(spark, d)[0]).select("doc_id", "n", "chapter", "file"), "chapter")


@query(v.sql(*_PAPER,
    query=rf"SELECT doc_id, count(*) AS n FROM sentences JOIN (SELECT doc_id, n AS section FROM sections WHERE kind <> 'back') USING (doc_id, section) WHERE {spoken_sql('text')} <> '' AND len(regexp_extract_all(text, '[A-Za-z](?:[A-Za-z''’-]*[A-Za-z])?')) >= 4 GROUP BY 1"))
def practice_eligible(spark: SparkSession, d: str) -> DataFrame:
    sections, sentences = a.outlined(spark, d)
    kept = sections.filter("kind <> 'back'").select("doc_id", F.col("n").alias("section"))
    rows = sentences.join(kept, ["doc_id", "section"], "left_semi").filter((text.speech(F.col("text")) != "")
        & (F.size(text.shown_words(F.col("text"))) >= 4))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"))


# --- quizzes ---------------------------------------------------------------------------------------------------------

_QUIZZES = """quiz AS (SELECT s.doc_id, n * 10 AS question, title AS chapter, CASE WHEN n % 5 > 0 THEN 'Why ' || n || '?' END AS q, [x.text, y.text, 'nowhere'] AS evidence FROM sections s
  JOIN sentences x ON x.doc_id = s.doc_id AND x.section = n AND x.k = 1 JOIN sentences y ON y.doc_id = s.doc_id AND y.section = n AND y.k = 2 WHERE s.doc_id % 3 = 0),
firsts AS (SELECT doc_id, text, section, k FROM sentences QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY section, k) = 1),
quoted AS (SELECT doc_id, chapter, question, i, 's' || section || '_' || k AS id FROM (SELECT doc_id, chapter, question, unnest(range(1, 4)) AS i, unnest(evidence) AS text FROM quiz WHERE q IS NOT NULL) JOIN firsts USING (doc_id, text)),
asked AS (SELECT doc_id, chapter, count(*) AS questions FROM quiz WHERE q IS NOT NULL GROUP BY 1, 2)"""


def _quizzes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A question on each section with two sentences of every third paper; those on every fifth section are not asked."""
    sections, sentences = a.outlined(spark, d)
    both = sentences.filter("doc_id % 3 = 0").groupBy("doc_id", F.col("section").alias("n")).agg(F.max(F.when(F.col("k") == 1,
        F.col("text"))).alias("x"), F.max(F.when(F.col("k") == 2,
        F.col("text"))).alias("y")).filter("x is not null and y is not null")
    q = F.when(F.col("n") % 5 > 0, F.concat(F.lit("Why "), F.col("n").cast("string"), F.lit("?")))
    rows = sections.join(both, ["doc_id", "n"]).select("doc_id", (F.col("n") * 10).alias("question"),
        F.col("title").alias("chapter"), q.alias("q"), F.array("x", "y", F.lit("nowhere")).alias("evidence"))
    return rows, sections, sentences


@query(v.sql(*_PAPER, _QUIZZES,
    query="SELECT s.doc_id, n AS section, questions, coalesce((SELECT string_agg(id, ',' ORDER BY question, i) FROM "
     "quoted q WHERE q.doc_id = s.doc_id AND q.chapter = s.title), '') AS evidence FROM sections s JOIN asked c ON "
     "c.doc_id = s.doc_id AND c.chapter = s.title"))
def quiz_view(spark: SparkSession, d: str) -> DataFrame:
    return reading.quiz_view(*_quizzes(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query(v.sql(*_PAPER, _QUIZZES, query="SELECT doc_id, count(DISTINCT chapter) AS chapters, count(*) AS questions FROM quiz GROUP BY 1"))
def quiz_counts(spark: SparkSession, d: str) -> DataFrame:
    return reading.quiz_counts(_quizzes(spark, d)[0])


# --- loading ---------------------------------------------------------------------------------------------------------


def _stored_papers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, json, extractor_version): the papers as JSON, six of seven with a fault: cut off, without sections, with a blank
    title, an odd kind, no sentences, or a sentence without text. Every second level is left out."""
    sections, sentences = a.outlined(spark, d)
    m, odd = F.col("doc_id") % 7, F.col("k") % 2 == 1
    said = F.to_json(F.struct(F.when((m == 6) & (F.col("section") == 1) & (F.col("k") == 1), None).otherwise(F.col("text")).alias("t")))
    plain = F.substring(said, F.lit(6), F.length(said) - 6)
    sentence = F.when(odd, said).otherwise(plain)
    texts = sentences.groupBy("doc_id", F.col("section").alias("n")).agg(F.array_sort(F.collect_list(F.struct("k", sentence.alias("j")))).alias("j"))
    rows = sections.join(texts, ["doc_id", "n"], "left")
    title = F.when((m == 3) & (F.col("n") == 1), " ").otherwise(F.col("title"))
    kind = F.when((m == 4) & (F.col("n") == 1), "odd").otherwise(F.col("kind"))
    head = F.to_json(F.struct(title.alias("title"), kind.alias("kind"), F.when(F.col("n") % 2 == 1, F.col("level")).alias("level")))
    listed = F.concat(F.lit(', "sentences": ['), F.array_join(F.coalesce(F.transform("j", lambda x: x["j"]),
        F.array().cast("array<string>")), ", "), F.lit("]"))
    section = F.concat(F.regexp_replace(head, "}$", ""), F.when((m == 5) & (F.col("n") == 1), "").otherwise(listed), F.lit("}"))
    docs = rows.select("doc_id", "n", section.alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("x"))
    whole = F.concat(F.lit('{"title": "T", '), F.when(F.col("doc_id") % 9 == 0, '"manual": {"by": "x"}, ').otherwise(""),
        F.lit('"sections": ['), F.array_join(F.transform("x", lambda i: i["s"]), ", "), F.lit("]}"))
    json = F.when(m == 1, F.regexp_replace(whole, r"\]}$", "")).when(m == 2, '{"title": "T"}').otherwise(whole)
    return docs.select("doc_id", json.alias("json"), F.when(F.col("doc_id") % 4 == 0, "v2").otherwise("v3").alias("extractor_version"))


@query(v.sql(*_PAPER, query="""SELECT doc_id, '' AS "at", CASE doc_id % 7 WHEN 1 THEN 'json' ELSE 'sections' END AS code FROM (SELECT DISTINCT doc_id FROM sections) WHERE doc_id % 7 IN (1, 2)
  UNION ALL SELECT doc_id, '0', ['title', 'kind', 'sentences'][doc_id % 7 - 2] FROM sections WHERE n = 1 AND doc_id % 7 IN (3, 4, 5)
  UNION ALL SELECT doc_id, '0.0', 't' FROM sentences WHERE section = 1 AND k = 1 AND doc_id % 7 = 6"""))
def document_errors(spark: SparkSession, d: str) -> DataFrame:
    return reading.loaded(_stored_papers(spark, d))[2]


@query(v.sql(*_PAPER,
     rf"n AS (SELECT *, {_NUMBER} AS x FROM sections WHERE doc_id % 7 = 0 OR doc_id % 7 = 6 AND NOT EXISTS (SELECT 1 FROM sentences t WHERE t.doc_id = sections.doc_id AND t.section = 1 AND t.k = 1))",
    query=rf"SELECT doc_id, n, title, x AS number, CASE WHEN n % 2 = 1 THEN level WHEN x <> '' THEN len(string_split(x, '.')) ELSE 1 END AS level, kind, 1 AS page, {headed_sql('x', chr(39).join(['regexp_replace(title, ', r'^\d+(?:\.\d+)*\.?\s+', ', ', '', ')']))} AS speech_title FROM n"))
def document_sections(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(reading.loaded(_stored_papers(spark, d))[0], "n", "level", "page")


@query(v.sql(*_PAPER,
    query=f"SELECT s.doc_id, section, row_number() OVER (PARTITION BY s.doc_id, section ORDER BY k) AS k, text, {spoken_sql('text')} AS spoken FROM sentences s WHERE s.doc_id % 7 = 0 OR s.doc_id % 7 = 6 AND NOT EXISTS (SELECT 1 FROM sentences t WHERE t.doc_id = s.doc_id AND t.section = 1 AND t.k = 1)"))
def document_sentences(spark: SparkSession, d: str) -> DataFrame:
    return reading.loaded(_stored_papers(spark, d))[1]


@query(v.sql(*_PAPER, query="SELECT DISTINCT doc_id FROM sections WHERE doc_id % 4 = 0 AND (doc_id % 9 <> 0 OR doc_id % 7 = 2)"))
def document_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return reading.needs_rebuild(_stored_papers(spark, d), "v3")


_EDITED = "kept AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'New ' || title ELSE title END AS name, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS new FROM sections WHERE n % 3 > 0)"
_NAMED = "regexp_extract(name, '^(\\d+(?:\\.\\d+)*)\\.?\\s', 1)"


def _edited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Papers of which every third section was taken out, every second one renamed, and every third sentence taken out."""
    sections, sentences = a.outlined(spark, d)
    kept = sections.filter("n % 3 > 0").withColumn("title", F.when(F.col("n") % 2 == 0, F.concat(F.lit("New "), "title")).otherwise(F.col("title")))
    return reading.edited(kept, sentences.filter("(section + k) % 3 > 0"), "x", "2024-02-01")


@query(v.sql(*_PAPER, _EDITED, query=f"SELECT doc_id, new AS n, name AS title, {_NAMED} AS number, {headed_sql(_NAMED, 'regexp_replace(name, ' + chr(39) + '^[0-9]+(?:[.][0-9]+)*[.]?[ ]+' + chr(39) + ', ' + chr(39) * 2 + ')')} AS speech_title FROM kept"))
def edited_sections(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(_edited(spark, d)[0].select("doc_id", "n", "title", "number", "speech_title"), "n")


@query(v.sql(*_PAPER, _EDITED, query=f"SELECT s.doc_id, new AS section, row_number() OVER (PARTITION BY s.doc_id, new ORDER BY s.k) AS k, text, {spoken_sql('text')} AS spoken FROM sentences s JOIN kept ON kept.doc_id = s.doc_id AND kept.n = s.section WHERE (s.section + s.k) % 3 > 0"))
def edited_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(_edited(spark, d)[1], "section", "k")


_FIGURES = """figs AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS item, CASE p_partkey % 6 WHEN 0 THEN '../x.png' WHEN 1 THEN NULL ELSE 'f' || p_partkey || '.png' END AS file,
  ['figure', 'table', 'equation', 'image', 'odd'][p_partkey % 5 + 1] AS kind, CASE WHEN p_partkey % 4 > 0 THEN 'Fig. ' || p_size ELSE '' END AS label FROM part), names AS (SELECT p_partkey % 50 AS doc_id, 'f' || p_partkey || '.png' AS file FROM part WHERE p_partkey % 7 > 0)"""


@query(v.sql(_FIGURES,
     "j AS (SELECT f.*, coalesce(regexp_matches(f.file, '^[A-Za-z0-9_-]+\\.png$'), false) AS named, n.file IS NOT "
     "NULL AS there FROM figs f LEFT JOIN names n USING (doc_id, file))",
    query="""SELECT doc_id, item, 'error' AS level, 'file' AS code FROM j WHERE NOT named UNION ALL SELECT doc_id, item, 'error', 'missing' FROM j WHERE named AND NOT there UNION ALL SELECT doc_id, item, 'error', 'kind' FROM j WHERE named AND there AND kind = 'odd'
  UNION ALL SELECT doc_id, item, 'warning', 'label' FROM j WHERE named AND there AND label = '' AND kind IN ('figure', 'table', 'equation') UNION ALL SELECT doc_id, item, 'warning', 'image' FROM j WHERE named AND there AND kind = 'image'"""))  # fmt: skip
def figure_issues(spark: SparkSession, d: str) -> DataFrame:
    i, p = F.col("p_partkey"), a.table(spark, d, "part")
    name = F.concat(F.lit("f"), i.cast("string"), F.lit(".png"))
    kinds = F.array(*[F.lit(x) for x in ("figure", "table", "equation", "image", "odd")])
    items = p.select((i % 50).alias("doc_id"), i.alias("item"), F.when(i % 6 == 0, "../x.png").when(i % 6 > 1,
        name).alias("file"), F.get(kinds, (i % 5).cast("int")).alias("kind"), F.when(i % 4 > 0, F.concat(F.lit("Fig. "),
        F.col("p_size").cast("string"))).otherwise("").alias("label"))
    return reading.figure_issues(items, p.filter(i % 7 > 0).select((i % 50).alias("doc_id"), name.alias("file")))


# --- comparison ------------------------------------------------------------------------------------------------------

_HEADS = r"""heads AS (SELECT doc_id, n, regexp_replace(regexp_replace(trim(lower(regexp_replace(title, '\s+', ' ', 'g')), ' '), '[:.]+$', ''), '^(\d+(?:\.\d+)*)\.?\s+', '\1 ') AS key FROM sections WHERE kind <> 'front')"""
_SCORES = """x AS (SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, count(t.key) AS nt, count(f.key) AS nf, count(*) FILTER (t.key IS NOT NULL AND f.key IS NOT NULL) AS hits FROM t FULL JOIN f ON t.doc_id = f.doc_id AND t.key = f.key GROUP BY 1),
scores AS (SELECT doc_id, hits, round(hits / greatest(nf, 1), 3) AS "precision", round(hits / greatest(nt, 1), 3) AS recall, round(CASE WHEN hits > 0 THEN 2 * (hits / greatest(nf, 1)) * (hits / greatest(nt, 1)) / (hits / greatest(nf, 1) + hits / greatest(nt, 1)) ELSE 0.0 END, 3) AS f1 FROM x)"""
_HEAD_SETS = "t AS (SELECT DISTINCT doc_id, key FROM heads WHERE n % 4 < 3), f AS (SELECT DISTINCT doc_id, key FROM heads WHERE n % 5 > 0)"


def _head_scores(spark: SparkSession, d: str) -> DataFrame:
    sections = a.outlined(spark, d)[0].filter("kind <> 'front'")
    other = F.concat(F.trim(F.regexp_replace("title", r"^(\d+(?:\.\d+)*) ", "$1.  ")), F.lit(":"))
    truth = sections.filter("n % 4 < 3").select("doc_id", reading.head_key(F.col("title")).alias("key"))
    return quality.set_scores(truth, sections.filter("n % 5 > 0").select("doc_id", reading.head_key(other).alias("key")), "doc_id")


@query(v.sql(*_PAPER, _HEADS, _HEAD_SETS, _SCORES, query="SELECT * FROM scores"))
def heading_scores(spark: SparkSession, d: str) -> DataFrame:
    """Headings against themselves, with other spaces, full stops and colons, some missing on either side."""
    return _head_scores(spark, d)


@query(v.sql(*_PAPER, _HEADS, _HEAD_SETS, _SCORES,
    query='SELECT count(*) AS papers, round(avg("precision"), 3) AS "precision", round(avg(recall), 3) AS recall, '
     'round(avg(f1), 3) AS f1 FROM scores'))
def heading_scores_mean(spark: SparkSession, d: str) -> DataFrame:
    return reading.macro(_head_scores(spark, d), "precision", "recall", "f1")


@query(v.sql(*_PAPER,
     r"keys AS (SELECT s.doc_id, section, k, trim(lower(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS key FROM "
     r"sentences s JOIN sections h ON h.doc_id = s.doc_id AND h.n = section WHERE kind <> 'back')",
    "t AS (SELECT DISTINCT doc_id, key FROM keys), f AS (SELECT DISTINCT doc_id, key FROM keys WHERE (section " "+ k) % 4 > 0)",
         _SCORES, query="SELECT * FROM scores"))
def sentence_scores(spark: SparkSession, d: str) -> DataFrame:
    sections, sentences = a.outlined(spark, d)
    kept = sections.filter("kind <> 'back'").select("doc_id", F.col("n").alias("section"))
    rows = sentences.join(kept, ["doc_id", "section"], "left_semi")
    found = rows.filter("(section + k) % 4 > 0").select("doc_id", reading.squeezed(F.replace("text", F.lit(" "), F.lit("  "))).alias("key"))
    return quality.set_scores(rows.select("doc_id", reading.squeezed(F.col("text")).alias("key")), found, "doc_id")


@query(v.sql(*_PAPER, "t AS (SELECT DISTINCT doc_id, key FROM refs)",
     "f AS (SELECT doc_id, key FROM refs WHERE n % 3 > 0 UNION ALL SELECT doc_id, NULL FROM papers WHERE doc_id % 4 " "= 0)",
    "ft AS (SELECT doc_id, count(*) AS auto, count(*) FILTER (key IS NULL) AS unlabeled FROM f GROUP BY 1)",
         "hit AS (SELECT doc_id, count(*) AS hits FROM t SEMI JOIN f USING (doc_id, key) GROUP BY 1)",
         "tt AS (SELECT doc_id, count(*) AS truth FROM t GROUP BY 1)",
    query="SELECT doc_id, coalesce(truth, 0) AS truth, coalesce(auto, 0) AS auto, round(coalesce(hits, 0) / "
         "greatest(coalesce(truth, 0), 1), 3) AS recall, coalesce(unlabeled, 0) AS unlabeled FROM tt FULL JOIN ft "
         "USING (doc_id) LEFT JOIN hit USING (doc_id)"))  # fmt: skip
def figure_recall(spark: SparkSession, d: str) -> DataFrame:
    refs = a.annotated(spark, d).select("doc_id", "n", F.explode(text.figure_keys(F.col("body"))).alias("key"))
    none = a.papers(spark, d).filter("doc_id % 4 = 0").select("doc_id", F.lit(None).cast("string"))
    return reading.figure_recall(refs, refs.filter("n % 3 > 0").select("doc_id", "key").union(none))


@query(v.sql(*_PAPER, "missing AS (SELECT DISTINCT doc_id, key FROM refs WHERE key NOT IN ('figure:1', 'figure:2', 'figure:3', 'figure:4'))",
    query=r"SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY split_part(key, ':', 1), "
         r"TRY_CAST(regexp_extract(key, '\d+', 0) AS BIGINT), key) AS place FROM missing QUALIFY place <= 10"))  # fmt: skip
def missing_figures_first(spark: SparkSession, d: str) -> DataFrame:
    cited = a.annotated(spark, d).select("doc_id", F.explode(text.figure_keys(F.col("body"))).alias("key"))
    there = a.papers(spark, d).select("doc_id", F.explode(F.array(*[F.lit(f"figure:{i}") for i in range(1, 5)])).alias("key"))
    return _as_long(quality.first_missing(quality.missing_figures(cited, there)), "place")


# --- catalog ---------------------------------------------------------------------------------------------------------

_METAS = """metas AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN title ELSE '' END AS title, CASE WHEN doc_id % 7 > 0 THEN length(text) // 1000 END AS pages, DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS imported,
  CASE WHEN doc_id % 3 > 0 THEN DATE '2020-01-01' + CAST(doc_id % 900 AS INT) END AS created, CASE WHEN doc_id % 4 = 1 THEN DATE '2022-01-01' + CAST(doc_id % 77 AS INT) END AS downloaded FROM papers)"""
_SORTS = " UNION ALL ".join(
    f"SELECT '{key}' AS sort, {desc} AS newest, doc_id, row_number() OVER (ORDER BY {value} {'DESC' if desc == 'true' else 'ASC'} NULLS LAST, doc_id) AS place FROM metas"
    for key, value in (("imported", "imported"), ("created", "created"), ("downloaded", "downloaded"), ("title",
         "nullif(lower(title), '')"), ("pages", "pages"))
    for desc in ("true", "false")
)


@query(v.sql(v.PAPERS, _METAS, query=_SORTS))
def paper_sorts(spark: SparkSession, d: str) -> DataFrame:
    """Every order of the catalog: by five keys, both ways; what is unknown comes last either way."""
    i = F.col("doc_id")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (i % n).cast("int"))
    metas = a.papers(spark, d).select(
        "doc_id", F.when(i % 5 > 0, F.col("title")).otherwise("").alias("title"), F.when(i % 7 > 0,
            F.floor(F.length("text") / 1000)).alias("pages"), day("2024-01-01", 300).alias("imported"),
        F.when(i % 3 > 0, day("2020-01-01", 900)).alias("created"), F.when(i % 4 == 1, day("2022-01-01", 77)).alias("downloaded"),
    )
    return papers.sorted_every_way(metas)


@query(v.sql(v.PAPERS, v.LINES, v.MARKS,
     "saved AS (SELECT paper, updated_at AS read_at, event_id % 10 AS done FROM marks QUALIFY row_number() OVER "
     "(PARTITION BY paper ORDER BY updated_at DESC, event_id) = 1)",
    query="""SELECT p.paper_id, coalesce(p.folder, '') AS folder, coalesce(l.n, 0) AS n_lines, coalesce(m.n, 0) AS n_marks, s.read_at, s.done FROM papers p LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY 1) l USING (doc_id)
  LEFT JOIN (SELECT paper, count(*) AS n FROM marks WHERE deleted = 0 GROUP BY 1) m ON m.paper = p.doc_id LEFT JOIN saved s ON s.paper = p.doc_id"""))  # fmt: skip
def paper_catalog_join(spark: SparkSession, d: str) -> DataFrame:
    """Papers with their folders, lines, marks and last positions."""
    marks = a.marks(spark, d)
    n = a.lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    m = marks.filter("deleted = 0").groupBy(F.col("paper").alias("doc_id")).agg(F.count("*").alias("n_marks"))
    saved = logs.last_write(marks.select("paper", "updated_at", "event_id"), "paper").select(F.col("paper").alias("doc_id"),
        F.col("updated_at").alias("read_at"), (F.col("event_id") % 10).alias("done"))
    p = a.papers(spark, d).select("paper_id", "doc_id", F.coalesce("folder", F.lit("")).alias("folder"))
    rows = reduce(lambda x, y: x.join(y, "doc_id", "left"), [n, m, saved], p)
    return rows.select("paper_id", "folder", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_marks",
        F.lit(0)).alias("n_marks"), "read_at", "done")


@query(v.sql(v.PAPERS, v.LINES,
     "p AS (SELECT doc_id, n, CASE n % 3 WHEN 1 THEN CASE n % 2 WHEN 0 THEN '[' || n || '] ' ELSE n || '. ' END || "
     "line ELSE line END AS line FROM lines WHERE trim(line, ' ') <> '')",
    r"g AS (SELECT *, count(*) FILTER (regexp_matches(line, '^(\[\d+\]|\d{1,3}\.\s|\d{1,3}\s+[A-Z])')) OVER "
         r"(PARTITION BY doc_id ORDER BY n) AS entry, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM " r"p)",
    query="SELECT doc_id, entry, count(*) AS n_lines, string_agg(line, ' ' ORDER BY n) AS text FROM (SELECT * "
         "REPLACE (greatest(entry, 1) AS entry) FROM g) GROUP BY 1, 2"))  # fmt: skip
def reference_grouping(spark: SparkSession, d: str) -> DataFrame:
    """Lines as references, of which every third begins one."""
    n = F.col("n").cast("string")
    head = F.when(F.col("n") % 3 == 1, F.when(F.col("n") % 2 == 0, F.concat(F.lit("["), n, F.lit("] "))).otherwise(F.concat(n,
        F.lit(". ")))).otherwise("")
    return _as_long(papers.references(a.lines(spark, d).select("doc_id", "n", F.concat(head,
        "line").alias("line")).filter("trim(line) <> ''")), "entry")


# --- the glossary behind the dictionary ------------------------------------------------------------------------------

_ASKED = """lookups AS (SELECT DISTINCT doc_id, token AS word FROM tokens WHERE pos % 3 = 0),
index AS (SELECT CASE WHEN length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN substr(word, 1, length(word) - 1) ELSE word END AS key, doc_id, word AS term, n FROM words),
entries AS (SELECT * FROM index QUALIFY row_number() OVER (PARTITION BY key, doc_id ORDER BY n DESC, term DESC) = 1),
keyed AS (SELECT l.*, CASE WHEN length(k) > 3 AND k LIKE '%s' AND k NOT LIKE '%ss' THEN substr(k, 1, length(k) - 1) ELSE k END AS key FROM (SELECT l.*, lower(regexp_replace(regexp_replace(word, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '[''’]s$', '')) AS k FROM lookups l) l),
own AS (SELECT k.doc_id, k.word, e.term FROM keyed k JOIN entries e ON e.key = k.key AND e.doc_id = k.doc_id),
most AS (SELECT key, arg_max(term, (n, -doc_id)) AS term FROM entries GROUP BY 1)"""


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _COUNTS, _WORDS, _LOOKUP, _ASKED, query="""SELECT k.doc_id, k.word, CASE WHEN weak AND coalesce(o.term, m.term) IS NOT NULL THEN coalesce(o.term, m.term) ELSE f.headword END AS headword,
  CASE WHEN weak AND coalesce(o.term, m.term) IS NOT NULL THEN 'term' ELSE f."match" END AS "match", CASE WHEN weak AND coalesce(o.term, m.term) IS NOT NULL THEN f.headword END AS also
  FROM (SELECT keyed.*, coalesce(l."match" IN ('near', 'part'), true) AS weak FROM keyed LEFT JOIN looked l USING (word)) k LEFT JOIN looked f USING (word) LEFT JOIN own o ON o.doc_id = k.doc_id AND o.word = k.word LEFT JOIN most m ON m.key = k.key
  WHERE f.headword IS NOT NULL OR coalesce(o.term, m.term) IS NOT NULL"""))
def glossary_fallback(spark: SparkSession, d: str) -> DataFrame:
    tokens, dictionary = a.tokens(spark, d), a.dictionary(spark, d)
    asked = stored(tokens.filter("pos % 3 = 0").select("doc_id", F.col("token").alias("word")).distinct())
    index = terms.glossary_index(terms.glossary_words(tokens, dictionary))
    return terms.with_glossary(asked, terms.ranked_lookup(asked.select("word").distinct(), dictionary), index)


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, v.SECTIONS, v.TOKENS, v.DICTIONARY, _COUNTS, _WORDS,
    f"said AS (SELECT doc_id, section, k, lower(unnest(regexp_extract_all(text, '{a.TOKEN}'))) AS t FROM sentences)",
    "keys AS (SELECT doc_id, section, k, CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN "
         "substr(t, 1, length(t) - 1) ELSE t END AS key FROM said)",
    "asked AS (SELECT doc_id, word, CASE WHEN length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN "
         "substr(word, 1, length(word) - 1) ELSE word END AS key FROM words)",
    query="SELECT doc_id, word, section, k FROM asked JOIN keys USING (doc_id, key) QUALIFY row_number() OVER "
         "(PARTITION BY doc_id, word ORDER BY section, k) = 1"))  # fmt: skip
def glossary_places(spark: SparkSession, d: str) -> DataFrame:
    words = terms.glossary_words(a.tokens(spark, d), a.dictionary(spark, d))
    return _as_long(terms.first_places_of(words, a.outlined(spark, d)[1], a.TOKEN), "section", "k")
