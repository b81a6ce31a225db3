"""All queries by name, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import align, srs, text
from scholia.operators import artefacts, logs, outline, quality, study, terms
from scholia.plans import views as v
from scholia.sources import adapters as a

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The review queue's "now": within the test tables' month.
NOW = 1705320000


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# --- sources and catalog ---------------------------------------------------------------------------------------------


@query(v.sql(v.PAPERS, query="SELECT paper_id, doc_id, folder, lang, title, length(text) AS chars FROM papers"))
def import_dedup(spark: SparkSession, d: str) -> DataFrame:
    return a.papers(spark, d).select("paper_id", "doc_id", "folder", "lang", "title", F.length("text").cast("long").alias("chars"))


@query(v.sql(v.PAPERS, v.LINES,
    query="SELECT doc_id, n, 'p' || n || '_' || length(line) AS item_id, trim(line, ' ') AS spoken FROM lines WHERE "
     "trim(line, ' ') <> '' UNION ALL SELECT doc_id, 0, 'h', title || '.' FROM papers"))
def sentence_items(spark: SparkSession, d: str) -> DataFrame:
    rows = a.lines(spark, d).filter("trim(line) <> ''").select("doc_id", F.col("n").cast("long").alias("n"), F.concat(F.lit("p"),
         F.col("n").cast("string"), F.lit("_"), F.length("line").cast("string")).alias("item_id"), F.trim("line").alias("spoken"))
    return rows.unionByName(a.papers(spark, d).select("doc_id", F.lit(0).cast("long").alias("n"), F.lit("h").alias("item_id"),
        F.concat("title", F.lit(".")).alias("spoken")))


# --- terms -----------------------------------------------------------------------------------------------------------


_COUNTS = """counts AS (SELECT doc_id, lower(token) AS word, count(*) AS n, count(*) FILTER (substr(token, 1, 1) = substr(lower(token), 1, 1)) AS lower_n, min(pos) AS first_pos FROM tokens
  WHERE NOT regexp_matches(regexp_replace(token, 's$', ''), '^[A-Z][A-Z0-9]{1,6}$') GROUP BY 1, 2)"""
_FOLD = """pairs AS (SELECT c.*, coalesce(y.word, e.word, s.word, c.word) AS one FROM counts c
  LEFT JOIN counts y ON y.doc_id = c.doc_id AND y.word = CASE WHEN c.word LIKE '%ies' THEN substr(c.word, 1, length(c.word) - 3) || 'y' END
  LEFT JOIN counts e ON e.doc_id = c.doc_id AND e.word = CASE WHEN regexp_matches(c.word, '[sxz]es$') THEN substr(c.word, 1, length(c.word) - 2) END
  LEFT JOIN counts s ON s.doc_id = c.doc_id AND s.word = CASE WHEN c.word LIKE '%s' AND c.word NOT LIKE '%ss' THEN substr(c.word, 1, length(c.word) - 1) END),
folded AS (SELECT doc_id, one AS word, CAST(sum(n) AS BIGINT) AS n, CAST(sum(lower_n) AS BIGINT) AS lower_n, min(first_pos) AS first_pos FROM pairs GROUP BY 1, 2)"""


_TECHNICAL = f"""forms AS (SELECT word, unnest({v.undone('word', text.INFLECTIONS)}) AS form FROM (SELECT DISTINCT word FROM folded WHERE regexp_matches(word, '^[a-z][a-z-]*$'))),
sure AS (SELECT DISTINCT word FROM forms WHERE length(form) >= 2 AND form IN (SELECT lower FROM dictionary)),
technical AS (SELECT * FROM folded WHERE length(word) >= 4 AND n >= CASE WHEN length(word) <= 5 THEN 3 ELSE 2 END AND lower_n > 0 AND word NOT IN ({v.STOPS}) AND word NOT IN (SELECT word FROM sure))"""
_WORDS = f"""{_FOLD}, {_TECHNICAL},
words AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos, word) AS rank FROM technical QUALIFY rank <= 40)"""


@query(v.sql(v.PAPERS, v.TOKENS, _COUNTS, query="SELECT doc_id, word, n, lower_n, first_pos FROM counts"))
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return terms.word_counts(a.tokens(spark, d)).select("doc_id", "word", "n", "lower_n", F.col("first_pos").cast("long").alias("first_pos"))


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _COUNTS, _WORDS, query="SELECT doc_id, rank, word, n FROM words"))
def glossary_words(spark: SparkSession, d: str) -> DataFrame:
    return terms.glossary_words(a.tokens(spark, d), a.dictionary(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query(v.sql(v.PAPERS, v.TOKENS, query="""SELECT doc_id, acronym, n FROM (SELECT doc_id, CASE WHEN regexp_matches(token, '^[A-Z][A-Z0-9]{1,6}s$') THEN regexp_replace(token, 's$', '') ELSE token END AS acronym, count(*) AS n, min(pos) AS first_pos FROM tokens GROUP BY 1, 2)
  WHERE regexp_matches(acronym, '^[A-Z][A-Z0-9]{1,6}$') AND n >= 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos, acronym) <= 25"""))
def glossary_acronyms(spark: SparkSession, d: str) -> DataFrame:
    return terms.acronyms(a.tokens(spark, d))


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _COUNTS, _FOLD, _TECHNICAL,
     f"""w AS (SELECT doc_id, pos, lower(token) AS t, length(token) >= 3 AND lower(token) NOT IN ({v.STOPS}) AND NOT contains(token, '-') AS ok FROM tokens)""",
    "g AS (SELECT doc_id, t AS t1, ok AS o1, lead(t, 1) OVER x AS t2, lead(ok, 1) OVER x AS o2, lead(t, 2) "
         "OVER x AS t3, lead(ok, 2) OVER x AS o3 FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos))",
    "grams AS (SELECT doc_id, t1 AS head, t2 AS last, 2 AS k FROM g WHERE o1 AND o2 UNION ALL SELECT doc_id, "
         "t1 || ' ' || t2, t3, 3 FROM g WHERE o1 AND o2 AND o3)",
    f"""named AS (SELECT s.doc_id, k, head || ' ' || coalesce(p.one, last) AS phrase FROM grams s LEFT JOIN pairs p ON p.doc_id = s.doc_id AND p.word = s.last WHERE split_part(head, ' ', 1) NOT IN ({", ".join(f"'{u}'" for u in terms.UNITS)}))""",
    """c AS (SELECT doc_id, k, phrase, count(*) AS n FROM named GROUP BY 1, 2, 3 HAVING count(*) >= 3)""",
    "rare AS (SELECT DISTINCT x.doc_id, x.phrase FROM (SELECT doc_id, phrase, unnest(string_split(phrase, ' "
         "')) AS word FROM c WHERE n = 3) x JOIN technical USING (doc_id, word))",
    query="""SELECT doc_id, phrase, n FROM c WHERE (n >= 4 OR (doc_id, phrase) IN (SELECT (doc_id, phrase) FROM rare)) AND (k = 3 OR NOT EXISTS (SELECT 1 FROM c t WHERE t.k = 3 AND t.doc_id = c.doc_id AND t.n = c.n AND contains(t.phrase, c.phrase)))
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(phrase) DESC, phrase) <= 25"""))  # fmt: skip
def glossary_phrases(spark: SparkSession, d: str) -> DataFrame:
    return terms.phrases(a.papers(spark, d), a.TOKEN, a.dictionary(spark, d))


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _COUNTS, _WORDS, query="""SELECT key, doc_id, term, n FROM (SELECT CASE WHEN length(word) > 3 AND word LIKE '%s' AND word NOT LIKE '%ss' THEN substr(word, 1, length(word) - 1) ELSE word END AS key, doc_id, word AS term, n FROM words)
  QUALIFY row_number() OVER (PARTITION BY key, doc_id ORDER BY n DESC, term DESC) = 1"""))
def glossary_index(spark: SparkSession, d: str) -> DataFrame:
    return terms.glossary_index(terms.glossary_words(a.tokens(spark, d), a.dictionary(spark, d)))


#: Candidates of a word by rank, as `terms.ranked_lookup` tries them, and the first that the dictionary has.
_DERIVED_SQL = ", ".join(f"CASE WHEN key LIKE '%{s_}' AND length(key) - {len(s_)} >= 3 THEN substr(key, 1, length(key) - {len(s_)}) || '{p}' END"
     for s_, p in text.DERIVED)
_LOOKUP = rf"""asked AS (SELECT *, lower(regexp_replace(regexp_replace(word, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g'), '[''’]s$', '')) AS key FROM (SELECT DISTINCT token AS word FROM tokens)),
usable AS (SELECT * FROM asked WHERE regexp_matches(key, '^[a-z][a-z''-]*$')),
base AS (SELECT word, unnest({v.undone('key', text.INFLECTIONS)}) AS form, generate_subscripts({v.undone('key', text.INFLECTIONS)}, 1) AS rank FROM usable),
near AS (SELECT word, key, unnest([{_DERIVED_SQL}]) AS form, generate_subscripts([{_DERIVED_SQL}], 1) + 100 AS rank FROM usable),
parts AS (SELECT word, unnest(list_reverse(string_split(key, '-'))) AS form, generate_subscripts(string_split(key, '-'), 1) + 1000 AS rank FROM usable WHERE contains(key, '-')),
found AS (SELECT word, arg_min(form, rank) AS headword, min(rank) AS rank FROM (SELECT word, form, rank FROM base WHERE length(form) >= 2 UNION ALL SELECT word, form, rank FROM near WHERE form <> key UNION ALL SELECT * FROM parts) WHERE form IN (SELECT lower FROM dictionary) GROUP BY word),
looked AS (SELECT word, headword, CASE WHEN rank = 1 THEN 'exact' WHEN rank < 100 THEN 'base' WHEN rank < 1000 THEN 'near' ELSE 'part' END AS "match" FROM found)"""


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _LOOKUP, query="SELECT * FROM looked"))
def dictionary_ranked_lookup(spark: SparkSession, d: str) -> DataFrame:
    return terms.ranked_lookup(a.tokens(spark, d).select(F.col("token").alias("word")).distinct(), a.dictionary(spark, d))


_ENTRIES = f"entries AS (SELECT DISTINCT lower(w) AS lower, 'm' || item_id AS mean, item_id AS id FROM (SELECT item_id, unnest(regexp_extract_all(text, '{a.TOKEN}')) AS w FROM benchmark))"


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _LOOKUP, _ENTRIES,
    query='SELECT word, headword, "match", mean, place FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY id, '
     'mean) AS place FROM looked JOIN entries ON lower = headword) WHERE place <= 5'))
def dictionary_entries(spark: SparkSession, d: str) -> DataFrame:
    words = a.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(a.TOKEN), F.lit(0))).alias("w"),
        F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("mean"), F.col("item_id").alias("id"))
    return _as_long(terms.entries(dictionary_ranked_lookup(spark, d), words.select(F.lower("w").alias("lower"), "mean", "id").distinct()), "place")


@query(v.sql(v.PAPERS, v.TOKENS, v.DICTIONARY, _LOOKUP, _ENTRIES, query="""SELECT word, headword, string_agg(mean, chr(10) ORDER BY place) AS meaning
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY id, mean) AS place FROM looked JOIN entries ON lower = headword) WHERE place <= 2 GROUP BY 1, 2"""))
def recorded_meanings(spark: SparkSession, d: str) -> DataFrame:
    return terms.meanings(dictionary_entries(spark, d))


#: Every fourth line with its last three words' initials after it, as an acronym is defined.
_DEFINED = """defined AS (SELECT doc_id, n, line || ' (' || upper(array_to_string(list_transform(w[-3:], lambda x: x[1]), '')) || ')' AS text FROM (SELECT *, regexp_extract_all(line, '[A-Za-z]+') AS w FROM lines) WHERE n % 4 = 0)"""
_EXPANDED = rf"""told AS (SELECT doc_id, n, regexp_extract_all(text, '\(\s*{text.ACRONYM}s?\s*\)|[A-Za-z][A-Za-z-]*') AS w FROM defined),
hits AS (SELECT doc_id, n, w, i, regexp_replace(w[i], '^\(\s*|s?\s*\)$', '', 'g') AS acronym FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM told) WHERE w[i] LIKE '(%'),
tries AS (SELECT doc_id, n, i, acronym, k, list_transform(w[i - k : i - 1], lambda x: regexp_replace(x, '[^A-Za-z-]', '', 'g')) AS run FROM (SELECT *, unnest(range(1, least(length(acronym) + 1, i - 1) + 1)) AS k FROM hits)),
fits AS (SELECT * FROM tries WHERE length(run[1]) > 1 AND lower(run[1]) NOT IN ({v.STOPS})
  AND regexp_matches(array_to_string(list_transform(list_filter(string_split(lower(array_to_string(run, '-')), '-'), lambda x: x <> ''), lambda x: x[1]), ''), '^' || array_to_string(string_split(lower(acronym), ''), '.*') || '$')),
best AS (SELECT doc_id, n, i, acronym, array_to_string(arg_max(run, k), ' ') AS expansion FROM fits GROUP BY 1, 2, 3, 4)"""


@query(v.sql(v.PAPERS, v.LINES, _DEFINED, _EXPANDED, query="SELECT doc_id, acronym, arg_min(expansion, (n, i)) AS expansion FROM best GROUP BY 1, 2"))
def acronym_expansion(spark: SparkSession, d: str) -> DataFrame:
    initials = F.transform(F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), F.regexp_extract_all("line",
        F.lit("[A-Za-z]+"), F.lit(0))), -3, 3), lambda w: F.substring(w, 1, 1))
    defined = a.lines(spark, d).filter("n % 4 = 0").select("doc_id", "n", F.concat("line", F.lit(" ("),
        F.upper(F.array_join(initials, "")), F.lit(")")).alias("text"))
    return terms.expanded(defined, a.STOP)


# --- logs ------------------------------------------------------------------------------------------------------------


@query(v.sql(v.REVIEWS, "past AS (SELECT * FROM reviews WHERE headword IS NOT NULL)", v.replay(), query=v.STATE))
def review_replay_state(spark: SparkSession, d: str) -> DataFrame:
    return srs.replay(a.reviews(spark, d))


@query(v.sql(v.REVIEWS, query="SELECT headword, min(reviewed_at) AS first_at, count(*) AS n FROM reviews GROUP BY 1"))
def review_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return a.reviews(spark, d).groupBy("headword").agg(F.min("reviewed_at").alias("first_at"), F.count("*").alias("n"))


@query(v.sql(v.REVIEWS, "words AS (SELECT c_custkey AS headword FROM customer)",
    "past AS (SELECT * FROM reviews WHERE headword IS NOT NULL AND floor(epoch(reviewed_at)) <= 1705320000)", v.replay(),
    "cards AS (SELECT w.headword, phase, due FROM words w LEFT JOIN states USING (headword))",
    "used AS (SELECT count(*) AS used FROM (SELECT min(floor(epoch(reviewed_at))) AS f FROM past GROUP BY headword) WHERE f >= 1705276800)",
    query="""SELECT least(new_waiting, greatest(20 - used, 0)) AS new, learning, review, total, new_waiting, next_due FROM
  (SELECT count(*) FILTER (phase IS NULL) AS new_waiting, count(*) FILTER (due <= 1705320000 AND phase <> 2) AS learning,
    count(*) FILTER (due <= 1705320000 AND phase = 2) AS review, count(*) AS total, min(due) FILTER (due > 1705320000) AS next_due FROM cards), used"""))
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    past = a.reviews(spark, d).filter(F.floor(F.unix_micros(F.col("reviewed_at").cast("timestamp")) / 1_000_000) <= NOW)
    words = a.table(spark, d, "customer").select(F.col("c_custkey").alias("headword"))
    return logs.queue_counts(srs.replay(past).select("headword", "phase", "due"), words, past, NOW)


@query(v.sql(v.REVIEWS, "known AS (SELECT c_custkey AS headword FROM customer)",
    "old AS (SELECT * FROM reviews WHERE device = 0)",
     "incoming AS (SELECT * FROM reviews WHERE uid % 3 <> 0 UNION ALL SELECT * FROM reviews WHERE uid % 4 = 1)",
    query="SELECT DISTINCT uid, headword, rating, reviewed_at, device FROM incoming WHERE headword IN (SELECT "
         "headword FROM known) AND uid NOT IN (SELECT uid FROM old)"))  # fmt: skip
def merge_reviews_idempotent(spark: SparkSession, d: str) -> DataFrame:
    rows = a.reviews(spark, d)
    incoming = rows.filter("uid % 3 <> 0").union(rows.filter("uid % 4 = 1"))
    return logs.merge_new(rows.filter("device = 0"), incoming, a.table(spark, d,
        "customer").select(F.col("c_custkey").alias("headword"))).select("uid", "headword", "rating", "reviewed_at", "device")


@query(v.sql(v.MARKS, query="SELECT uid, updated_at, event_id, paper, note, deleted, device FROM marks QUALIFY row_number() OVER "
     "(PARTITION BY uid ORDER BY updated_at DESC, event_id) = 1"))
def marks_lww(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_write(a.marks(spark, d), "uid")


@query(v.sql(v.MARKS, query="SELECT paper, updated_at, event_id, uid, note, deleted, device FROM marks QUALIFY row_number() OVER "
     "(PARTITION BY paper ORDER BY updated_at DESC, event_id) = 1"))
def positions_lww(spark: SparkSession, d: str) -> DataFrame:
    return logs.last_write(a.marks(spark, d), "paper")


@query(v.sql(v.MARKS, query="SELECT paper, device, uid % 7 AS sentence, count(*) AS n FROM marks GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1"))
def marks_toggle_parity(spark: SparkSession, d: str) -> DataFrame:
    return logs.toggled(a.marks(spark, d).withColumn("sentence", F.col("uid") % 7), "paper", "device", "sentence")


@query(v.sql(v.REVIEWS,
    query="SELECT device, count(*) AS n, max(reviewed_at) AS last_at FROM reviews WHERE uid <> (SELECT uid FROM reviews "
     "WHERE device = 1 ORDER BY reviewed_at DESC, uid DESC LIMIT 1) GROUP BY 1"))
def undo_last_device_event(spark: SparkSession, d: str) -> DataFrame:
    return logs.undo_last(a.reviews(spark, d), 1).groupBy("device").agg(F.count("*").alias("n"), F.max("reviewed_at").alias("last_at"))


@query(v.sql(v.REVIEWS,
    query="SELECT device, uid, row_number() OVER (PARTITION BY device ORDER BY reviewed_at DESC, uid DESC) AS back FROM "
     "reviews QUALIFY back <= 80"))
def ring_buffer_tail(spark: SparkSession, d: str) -> DataFrame:
    return logs.tail(a.reviews(spark, d), "device", 80, [F.desc("reviewed_at"), F.desc("uid")]).select("device", "uid",
        F.col("back").cast("long").alias("back"))


# --- outlines --------------------------------------------------------------------------------------------------------


_SECTIONS = "sections AS (SELECT doc_id, n, number, level FROM annotated WHERE opens)"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return a.annotated(spark, d).filter("opens").select("doc_id", "n", "number", "level")


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, _SECTIONS,
    query="SELECT doc_id, n, level, max(CASE WHEN level <= 1 THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS "
     "chapter FROM sections"))
def chapter_of(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(outline.chapter_of(_sections(spark, d)).select("doc_id", "n", "level", "chapter"), "n", "chapter")


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, _SECTIONS,
    query="SELECT doc_id, n, level, (SELECT min(y.n) FROM sections y WHERE y.doc_id = x.doc_id AND y.n > x.n AND y.level "
     "<= x.level) AS until FROM sections x"))
def section_subtree(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(outline.subtree_end(_sections(spark, d)).select("doc_id", "n", "level", "until"), "n", "until")


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, _SECTIONS,
     "x AS (SELECT *, list_transform(string_split(number, '.'), lambda y: CAST(y AS INT)) AS p, lag(number) OVER w "
     "AS previous, list_transform(string_split(lag(number) OVER w, '.'), lambda y: CAST(y AS INT)) AS q FROM "
     "sections WINDOW w AS (PARTITION BY doc_id ORDER BY n))",
    query="SELECT doc_id, n, number, previous FROM x WHERE q IS NOT NULL AND (p <= q OR (len(p) = len(q) AND len(p) "
         "> 1 AND p[1] = q[1] AND p[-1] - q[-1] > 1) OR p[1] - q[1] > 1)"))  # fmt: skip
def numbering_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(outline.numbering_gaps(_sections(spark, d)), "n")


@query(v.sql("i AS (SELECT l_orderkey, l_linenumber AS item, sum(l_quantity) AS secs FROM lineitem GROUP BY 1, 2)",
    query="SELECT l_orderkey, item, secs, coalesce(sum(secs) OVER (PARTITION BY l_orderkey ORDER BY item ROWS BETWEEN "
     "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS starts, sum(secs) OVER (PARTITION BY l_orderkey) AS total FROM i"))
def playlist_timeline(spark: SparkSession, d: str) -> DataFrame:
    items = a.table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("item")).agg(F.sum("l_quantity").alias("secs"))
    return outline.offsets(items, "l_orderkey", ["item"], "secs").select("l_orderkey", "item", "secs", "starts", "total")


@query(v.sql("i AS (SELECT l_orderkey, l_linenumber AS item, sum(l_quantity) AS secs FROM lineitem GROUP BY 1, 2)",
     "t AS (SELECT *, coalesce(sum(secs) OVER (PARTITION BY l_orderkey ORDER BY item ROWS BETWEEN UNBOUNDED "
     "PRECEDING AND 1 PRECEDING), 0) AS starts FROM i)",
    query="SELECT l_orderkey, item, starts FROM t WHERE starts <= 60 QUALIFY row_number() OVER (PARTITION BY "
         "l_orderkey ORDER BY starts DESC, item DESC) = 1"))  # fmt: skip
def seek_item(spark: SparkSession, d: str) -> DataFrame:
    return outline.seek(playlist_timeline(spark, d), "l_orderkey", F.lit(60))


def _as_long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- text functions --------------------------------------------------------------------------------------------------


_SAID = "said AS (SELECT doc_id, n, body || CASE WHEN n % 6 = 0 THEN ' At the Observatory⁴˒⁵, 0.15 rad² (equation).' ELSE '' END AS body FROM annotated)"
_SPOKEN = r"spoken AS (SELECT doc_id, n, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '\s*\([^()]*\b(19|20)\d\d[a-z]?\b[^()]*\)', '', 'g'), '\s*\[\d+(\s*[,–-]\s*\d+)*\]', '', 'g'), '([A-Za-z]{4}|[.,;:)\]])[⁰¹²³⁴⁵⁶⁷⁸⁹]+([˒⁻,–-][⁰¹²³⁴⁵⁶⁷⁸⁹]+)*', '\1', 'g'), '\s+([.,;:])', '\1', 'g'), ' ') AS spoken FROM said)"


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """What is read aloud of the annotated lines, some with raised citations, an exponent and an equation added."""
    said = F.concat("body", F.when(F.col("n") % 6 == 0, " At the Observatory⁴˒⁵, 0.15 rad² (equation).").otherwise(""))
    return _as_long(a.annotated(spark, d).select("doc_id", "n", text.speech(said).alias("spoken")), "n")


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, _SAID, _SPOKEN, query="SELECT doc_id, n, spoken FROM spoken"))
def speech_text(spark: SparkSession, d: str) -> DataFrame:
    return _spoken(spark, d)


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, v.REFERENCES, query="SELECT doc_id, n, key FROM refs"))
def figure_refs(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(a.annotated(spark, d).select("doc_id", "n", F.explode(text.figure_keys(F.col("body"))).alias("key")), "n")


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, v.REFERENCES,
    query="SELECT DISTINCT doc_id, key FROM refs WHERE key NOT IN ('figure:1', 'figure:2', 'figure:3', 'figure:4')"))
def missing_figures(spark: SparkSession, d: str) -> DataFrame:
    cited = figure_refs(spark, d).select("doc_id", "key")
    available = a.papers(spark, d).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("i")).select("doc_id",
        F.concat(F.lit("figure:"), F.col("i").cast("string")).alias("key"))
    return quality.missing_figures(cited, available)


#: Sentences with what a voice can't read; # stands for a number.
_HARD = [
    "Peak of ±# V at 3 K, λ/# and 3nm.", "Fluence # J/cm² and 20 °C over 10 m/s.",
         "An error of 0.15 rad² in the 1990s, a # s run.", "Stroke of #μm, 10 MHz, 3 × 10⁴ m, 5 cm⁻².",
    "Δφ of 2 × 10⁻⁶ with Ω and (x)³ at 90°.", "# N-type parts of 7 kg, T⁴ and # h at # W/m².",
]


def _hard_sql() -> str:
    return "CASE n % 6 " + " ".join(f"WHEN {i} THEN replace('{x}', '#', n::VARCHAR)" for i, x in enumerate(_HARD)) + " END"


def _said_sql(x: str) -> str:
    """The readings as a chain of replacements, rule by rule: another way than that of `text.pronounce`."""
    r, end = "[⁰¹²³⁴⁵⁶⁷⁸⁹]+", "([^A-Za-z0-9-]|$)"
    rules = [(rf"(\d)\s?×\s?10⁻({r})", r"\1 times 10 to the minus \2"), (rf"(\d)\s?×\s?10({r})", r"\1 times 10 to the \2"),
        (r"([A-Za-z²³])/(cm|mm|m|s|h|K|Hz|W|J|kg|g|min)([²³⁻\s.,;:)]|$)", r"\1 per \2\3")]
    rules += [(rf"per {u}²", f"per square {w}") for u, w in text.PER_SQUARE.items()] + [(r"([A-Za-zα-ω])\s?/\s?(\d+)",
         r"\1 over \2"), ("rad²", "radians²"), ("cm⁻", "centimeters⁻")]
    rules += [(r"([A-Za-z0-9)])²", r"\1 squared"), (r"([A-Za-z0-9)])³", r"\1 cubed"), (rf"([A-Za-z0-9)])⁻({r})",
         r"\1 to the minus \2"), (rf"([A-Za-z0-9)])({r})", r"\1 to the \2")]
    rules += [(rf"(\d)\s{'?' if len(u) > 1 or u == '°' else ''}{u}{end}", rf"\1 {text.UNITS[u]}\2") for u in sorted(text.UNITS,
         key=len, reverse=True)]
    rules += [(rf"\bper {u}\b", f"per {w}") for u, w in text.PER.items()] + [(r"\s?×\s?", " times "), (r"±\s?(\d)",
         r" plus or minus \1")] + [(g, f" {w} ") for g, w in text.GREEK.items()] + [(r"\s{2,}", " ")]
    for find, put in rules:
        x = f"regexp_replace({x}, '{find}', '{put}', 'g')"
    return f"trim(translate({x}, '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'), ' ')"


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, query=f"SELECT doc_id, n, {_said_sql(_hard_sql())} AS spoken FROM annotated"))
def pronunciation_builtin(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in _HARD])
    said = F.replace(F.get(kinds, (F.col("n") % len(_HARD)).cast("int")), F.lit("#"), F.col("n").cast("string"))
    return _as_long(a.annotated(spark, d).select("doc_id", "n", text.pronounce(said).alias("spoken")), "n")


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED,
    query="SELECT doc_id, n, " + _said_sql(f"replace(replace(replace({_hard_sql()}, 'Peak of', 'Summit of'), 'Stroke', 'Way'), 'run', '2 h')") + " AS spoken FROM annotated"))
def spoken_composed(spark: SparkSession, d: str) -> DataFrame:
    """A paper's rules, then the user's, who changes what the paper's made, then the readings of numbers and units."""
    said = F.replace(F.get(F.array(*[F.lit(x) for x in _HARD]), (F.col("n") % len(_HARD)).cast("int")), F.lit("#"), F.col("n").cast("string"))
    spoken = text.spoken_form(said, [("peak", "Top", False), ("Stroke", "Way", True), ("RUN", "no run", True)], [("top", "Summit", False), ("run", "2 h", True)])
    return _as_long(a.annotated(spark, d).select("doc_id", "n", spoken.alias("spoken")), "n")


_STEMS = text.INFLECTIONS[: text.SAME_WORD]
#: Words of the papers, and what a learner typed for them: right, in another form, with a letter too much, or nothing like it.
_TYPED = f"""typed AS (SELECT *, CASE WHEN t = a THEN 'exact' WHEN list_has_any({v.undone('t', _STEMS)}, {v.undone('a', _STEMS)}) THEN 'form'
    WHEN levenshtein(t, a) <= CASE WHEN length(a) >= 8 THEN 2 ELSE 1 END THEN 'near' ELSE 'wrong' END AS grade
  FROM (SELECT doc_id, pos, lower(token) AS a, CASE pos % 4 WHEN 0 THEN lower(token) WHEN 1 THEN 'x' || lower(token) WHEN 2 THEN lower(token) || 'ing' ELSE 'qqqqqqqqqqqq' END AS t FROM tokens WHERE length(token) >= 4))"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    w = F.lower("token")
    typed = F.when(F.col("pos") % 4 == 0, w).when(F.col("pos") % 4 == 1, F.concat(F.lit("x"), w)).when(F.col("pos") % 4 == 2,
        F.concat(w, F.lit("ing"))).otherwise("qqqqqqqqqqqq")
    rows = a.tokens(spark, d).filter(F.length("token") >= 4).select("doc_id", "pos", w.alias("asked"), typed.alias("typed"))
    return rows.select("doc_id", "pos", text.cloze_grade(F.col("typed"), F.col("asked"), F.col("asked")).alias("grade"))


@query(v.sql(v.PAPERS, v.TOKENS, _TYPED, query="SELECT doc_id, pos, grade FROM typed"))
def cloze_grade(spark: SparkSession, d: str) -> DataFrame:
    return _as_long(_typed(spark, d), "pos")


@query(v.sql(v.PAPERS, v.TOKENS, _TYPED,
    query="SELECT doc_id, count(*) AS n, round(avg(CASE grade WHEN 'exact' THEN 1.0 WHEN 'wrong' THEN 0.0 ELSE 0.5 END), "
     "6) AS score FROM typed GROUP BY 1"))
def dictation_score(spark: SparkSession, d: str) -> DataFrame:
    return study.dictation_scores(_typed(spark, d), "doc_id").withColumn("score", F.round("score", 6))


@query()
def sentence_grade_lcs(spark: SparkSession, d: str) -> DataFrame:
    typed = F.regexp_replace(F.col("text"), r"\b(the|of)\b ", "")
    rows = a.table(spark, d, "conversations").select("conv_id", "turn", align.sentence_grade_udf("text", typed).alias("x"))
    return rows.select("conv_id", "turn", F.round("x.score", 6).alias("score"), F.size("x.extra").alias("extra"))


@query()
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return a.papers(spark, d).select("doc_id", F.posexplode(align.sentences_udf("text"))).select("doc_id",
        F.col("pos").cast("long").alias("k"), F.col("col").alias("sentence"))


_KNOWN = ["AO", "DM", "USA"]
_HITS = r"""w AS (SELECT doc_id, n, unnest(regexp_extract_all(spoken, '[A-Za-z0-9_À-ÿ]+')) AS x FROM spoken),
hits AS (SELECT doc_id, 'equation' AS risk, '(equation)' AS x, n FROM (SELECT doc_id, n, unnest(regexp_extract_all(spoken, '\(equation\)')) FROM spoken)
  UNION ALL SELECT doc_id, 'symbol', unnest(regexp_extract_all(spoken, '[_^=<>≈~√∑∫∂/\\|²³⁰¹⁴⁵⁶⁷⁸⁹⁻⁺₀₁₂₃₄₅₆₇₈₉]')), n FROM spoken
  UNION ALL SELECT doc_id, 'mixed', x, n FROM w WHERE regexp_matches(x, '^[A-Za-z0-9]+$') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]') AND NOT regexp_matches(x, '^[0-9]+s$')
  UNION ALL SELECT doc_id, 'acronym', x, n FROM w WHERE regexp_matches(x, '^[A-Z][A-Z0-9]{1,6}s?$') AND x NOT IN ('AO', 'DM', 'USA'))"""


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, _SAID, _SPOKEN, _HITS, query="SELECT doc_id, risk, count(*) AS n FROM hits GROUP BY 1, 2"))
def speech_risk_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.speech_risks(_spoken(spark, d), _KNOWN).groupBy("doc_id", "risk").agg(F.count("*").alias("n"))


@query(v.sql(v.PAPERS, v.LINES, v.ANNOTATED, _SAID, _SPOKEN, _HITS,
    query="SELECT doc_id, risk, x AS example, min(n) AS first_n FROM hits GROUP BY 1, 2, 3 QUALIFY row_number() OVER "
     "(PARTITION BY doc_id, risk ORDER BY min(n), x) <= 12"))
def speech_risk_examples(spark: SparkSession, d: str) -> DataFrame:
    firsts = quality.speech_risks(_spoken(spark, d), _KNOWN).groupBy("doc_id", "risk", "example").agg(F.min("n").alias("first_n"))
    return firsts.withColumn("r", F.row_number().over(a.over("doc_id", "risk", order=[F.col("first_n"),
        F.col("example")]))).filter("r <= 12").drop("r")


# --- quality and artefacts -------------------------------------------------------------------------------------------


@query(v.sql(v.PAPERS, v.TOKENS, "t AS (SELECT DISTINCT doc_id, lower(token) AS key FROM tokens WHERE pos % 2 = 0)",
     "f AS (SELECT DISTINCT doc_id, lower(token) AS key FROM tokens WHERE pos % 3 = 0)",
    "x AS (SELECT coalesce(t.doc_id, f.doc_id) AS doc_id, count(t.key) AS nt, count(f.key) AS nf, count(*) "
         "FILTER (t.key IS NOT NULL AND f.key IS NOT NULL) AS hits FROM t FULL JOIN f ON t.doc_id = f.doc_id AND "
         "t.key = f.key GROUP BY 1)",
    query='SELECT doc_id, hits, round(hits / greatest(nf, 1), 3) AS "precision", round(hits / greatest(nt, 1), 3) AS '
         'recall, round(CASE WHEN hits > 0 THEN 2 * (hits / greatest(nf, 1)) * (hits / greatest(nt, 1)) / (hits / '
         'greatest(nf, 1) + hits / greatest(nt, 1)) ELSE 0.0 END, 3) AS f1 FROM x'))  # fmt: skip
def set_eval_prf(spark: SparkSession, d: str) -> DataFrame:
    t = a.tokens(spark, d).select("doc_id", "pos", F.lower("token").alias("key"))
    return quality.set_scores(t.filter("pos % 2 = 0"), t.filter("pos % 3 = 0"), "doc_id")


@query(v.sql(v.PAPERS, v.LINES,
    query="SELECT doc_id, sha1(string_agg(sha1(line), ',' ORDER BY n)) AS items_hash FROM lines WHERE doc_id % 3 <> 0 OR "
     "doc_id % 2 = 1 GROUP BY 1"))
def fingerprint_stale(spark: SparkSession, d: str) -> DataFrame:
    now = artefacts.fingerprint(a.lines(spark, d), "doc_id", "n", "line")
    return artefacts.stale(now, now.filter("doc_id % 3 = 0 and doc_id % 2 = 0"), "doc_id")


@query("SELECT DISTINCT text FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)")
def translation_todo(spark: SparkSession, d: str) -> DataFrame:
    c = a.table(spark, d, "conversations")
    return artefacts.todo(c.filter("text is not null"), c.filter("role = 'assistant'"), "text")


@query("SELECT DISTINCT text, CASE WHEN text IN (SELECT text FROM conversations WHERE role = 'assistant') THEN 'kept' "
     "WHEN reverse(text) = text THEN '' ELSE reverse(text) END AS translated FROM conversations WHERE text IS NOT " "NULL")
def translation_run(spark: SparkSession, d: str) -> DataFrame:
    """A run of a translator that says texts backwards; what assistants said is translated already."""
    c = a.table(spark, d, "conversations").filter("text is not null")
    cache = c.filter("role = 'assistant'").select("text").distinct().withColumn("translated", F.lit("kept"))
    return artefacts.translated(c, cache, F.reverse)


@query(v.sql(v.PAPERS, v.LINES, "now AS (SELECT doc_id, sha1(string_agg(sha1(line), ',' ORDER BY n)) AS h FROM lines GROUP BY 1)",
     query="SELECT doc_id, doc_id % 4 = 1 AS upgraded FROM now WHERE doc_id % 4 = 0 OR doc_id % 4 = 1 AND doc_id % 3 > 0 "
     "AND doc_id % 5 > 0"))
def artefacts_current(spark: SparkSession, d: str) -> DataFrame:
    """Of four papers one has its fingerprint, one was made before these were kept, one has another and one none."""
    now, m = artefacts.fingerprint(a.lines(spark, d), "doc_id", "n", "line"), F.col("doc_id") % 4
    kept = F.when(m == 0, F.col("items_hash")).when(m == 2, "other")
    stored = now.filter("doc_id % 4 < 3").select("doc_id", kept.alias("items_hash"), F.lit("done").alias("state"),
        F.when(F.col("doc_id") % 3 == 0, "v1").otherwise("v2").alias("version"), (F.col("doc_id") % 5 == 0).alias("manual"))
    return artefacts.current(now, stored, "doc_id", "v2")


@query("SELECT DISTINCT text FROM conversations WHERE role = 'assistant' AND text IN (SELECT text FROM conversations WHERE turn % 2 = 1)")
def cache_gc(spark: SparkSession, d: str) -> DataFrame:
    c = a.table(spark, d, "conversations")
    return artefacts.in_use(c.filter("role = 'assistant'").select("text").distinct(), c.filter("turn % 2 = 1"), "text")
