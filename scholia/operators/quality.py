"""Rule checks on documents: filters and partial aggregates, one row for each issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.sources.stored import stored

#: Characters that only appear where decoding went wrong, the private-use area, abbreviations of references.
GARBLED, PRIVATE = r"[ðÞ\x{FFFD}\x{0700}-\x{0DFF}]|1⁄4|1⁄2", r"[\x{E000}-\x{F8FF}]"
REFERENCE = r"\b(Opt|Soc|Proc|Phys|Astron|Appl|Rev|Lett|Eng|Instrum|J|Vol|vol|pp)\."
#: Signs that a voice reads wrongly or not at all.
SYMBOLS = r"[_^=<>≈~√∑∫∂/\\|²³⁰¹⁴⁵⁶⁷⁸⁹⁻⁺₀₁₂₃₄₅₆₇₈₉]"

#: Whole words of letters and digits, times like "90s" apart, and acronyms; words are runs of LETTER.
LETTER = "[A-Za-z0-9_À-ÿ]"
MIXED = f"(?<!{LETTER})(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])(?![0-9]+s(?!{LETTER}))[A-Za-z0-9]++(?!{LETTER})"
ACRONYMS = f"(?<!{LETTER})[A-Z][A-Z0-9]{{1,6}}s?(?!{LETTER})"
#: A word of two letters or more, and after one sign another that begins with its last letter.
DOUBLED = "(?<![A-Za-z])([A-Za-z]+([A-Za-z]))[^A-Za-z](?=((?i:\\2)[A-Za-z]+))"


def doubled(texts: DataFrame) -> DataFrame:
    """(doc_id, id, x, y) for texts (doc_id, id, text): adjacent words, one sign apart, where a word was split with its letter
    doubled ("Actua ator"): x ends as y begins, joined less that letter they are a word of the document, and x or y stands
    in it twice at most."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    vocabulary = stored(texts.select("doc_id", F.explode(words).alias("w")).groupBy("doc_id", F.lower("w").alias("w")).agg(F.count("*").alias("c")))
    of = lambda k: F.regexp_extract_all("text", F.lit(DOUBLED), F.lit(k))
    both = texts.filter(F.col("text").rlike(DOUBLED)).select("doc_id", "id", F.explode(F.arrays_zip(of(1).alias("x"), of(3).alias("y"))).alias("t"))
    x, y = F.lower("t.x"), F.lower("t.y")
    pairs = both.select("doc_id", "id", x.alias("x"), y.alias("y"), F.concat(x, F.substring(y, F.lit(2), F.length(y))).alias("whole"))
    for word, count in (("whole", "cw"), ("x", "cx"), ("y", "cy")):
        pairs = pairs.join(vocabulary.select("doc_id", F.col("w").alias(word), F.col("c").alias(count)), ["doc_id", word])
        pairs = stored(pairs) if word == "whole" else pairs  # few are left
    return pairs.filter(F.least("cx", "cy") <= 2).select("doc_id", "id", "x", "y")


def inspect(sections: DataFrame, sentences: DataFrame, figures: DataFrame, gaps: DataFrame, doubles: DataFrame, cited: DataFrame) -> DataFrame:
    """(doc_id, level, code, section, n): issues of papers; section is null where an issue is the paper's, n how often.

    sections (doc_id, n, kind: front, body or back, title), sentences (doc_id, section, text), figures (doc_id, key, kind);
    gaps are `outline.numbering_gaps`, doubles (doc_id, section, heading: boolean, id) split words in titles and sentences,
    cited (doc_id, key) the figures that the body refers to.
    """
    kind = sections.select("doc_id", F.col("n").alias("section"), "kind")
    rows = sentences.join(kind, ["doc_id", "section"])
    body, size = F.col("kind") == "body", F.length("text")
    per = rows.groupBy("doc_id", "section", "kind").agg(
        F.count("*").alias("size"), F.count_if(F.col("text").rlike(PRIVATE)).alias("pua"),
            F.count_if(F.col("text").rlike(GARBLED)).alias("garbled"), F.sum(F.size(F.regexp_extract_all("text", F.lit(REFERENCE),
             F.lit(0)))).alias("refs"),
        F.count_if(size > 450).alias("long"), F.count_if(size < 15).alias("short"), F.sum(F.size(F.regexp_extract_all("text",
            F.lit("[A-Za-z]{25,}"), F.lit(0)))).alias("glued"),
    )
    every = kind.join(per.drop("kind"), ["doc_id", "section"], "left").fillna(0, ["size", "pua", "garbled", "refs", "long", "short", "glued"])
    of = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    front = F.col("kind") == "front"
    paper = every.groupBy("doc_id").agg(
        F.count_if(body).alias("sections"), of("size", body).alias("sentences"), F.sum("pua").alias("pua"),
            F.sum("garbled").alias("garbled"), of("refs", front).alias("refs"), of("size", front).alias("abstract"),
        of("long", body).alias("long"), of("short", body).alias("short"), of("glued", body).alias("glued"), F.min(F.when(body,
            F.col("section"))).alias("first_body"),
    )
    many = doubles.join(kind.filter(body), ["doc_id", "section"],
        "left_semi").filter("not heading").groupBy("doc_id").agg(F.countDistinct("id").alias("doubled"))
    paper = paper.join(many, "doc_id", "left").fillna(0, ["doubled"])
    rules = [
        ("few_sections", "major", "sections <= 3 and sentences >= 120", "sentences"), ("doubled_text", "major",
             "sentences > 0 and doubled / sentences > 0.05", "doubled"), ("pua", "major", "pua > 0", "pua"),
        ("garbled", "major", "garbled >= 3", "garbled"), ("garbled", "minor", "garbled between 1 and 2", "garbled"),
            ("abstract_refs", "major", "refs >= 4", "refs"),
        ("no_abstract", "minor", "abstract = 0", "abstract"), ("abstract_long", "major", "abstract > 20", "abstract"),
            ("long_sentences", "minor", "long >= 3", "long"),
        ("short_sentences", "minor", "short >= 5", "short"), ("glued", "minor", "glued > 0", "glued"),
    ]
    each = F.array(*[F.when(F.expr(test), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"),
        F.lit(None).cast("long").alias("section"), F.col(n).cast("long").alias("n"))) for code, level, test, n in rules])
    out = [paper.select("doc_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("i")).select("doc_id", "i.*")]

    def add(df: DataFrame, level: str, code: str, section, n) -> None:
        out.append(df.select("doc_id", F.lit(level).alias("level"), F.lit(code).alias("code"),
            section.cast("long").alias("section"), n.cast("long").alias("n")))

    abstracts = sections.filter(F.lower("title").rlike(r"^abstract\b")).join(paper.select("doc_id", "first_body"), "doc_id")
    add(abstracts.filter(F.col("n") > F.col("first_body")), "major", "abstract_order", F.col("n"), F.lit(1))
    add(gaps, "major", "numbering", F.col("n"), F.lit(1))
    add(every.filter(body & (F.col("size") > 70)), "minor", "long_section", F.col("section"), F.col("size"))
    add(doubles.filter("heading").groupBy("doc_id", "section").agg(F.count("*").alias("n")), "major", "doubled_heading", F.col("section"), F.col("n"))
    add(missing_figures(cited, figures).groupBy("doc_id").agg(F.count("*").alias("n")), "minor", "missing_figures", F.lit(None), F.col("n"))
    add(figures.filter("kind = 'image'").groupBy("doc_id").agg(F.count("*").alias("n")), "minor", "unlabeled_images", F.lit(None), F.col("n"))
    return reduce(DataFrame.union, out)


def summary(issues: DataFrame) -> DataFrame:
    """(doc_id, major, minor, recommend): issues by level; repair is recommended on any major one."""
    out = issues.groupBy("doc_id").agg(F.count_if(F.col("level") == "major").alias("major"), F.count_if(F.col("level") == "minor").alias("minor"))
    return out.withColumn("recommend", F.col("major") > 0)


def top_issues(issues: DataFrame, most: int = 8) -> DataFrame:
    """The first issues of each paper, major ones first."""
    w = Window.partitionBy("doc_id").orderBy("level", "code", F.col("section").asc_nulls_first())
    return issues.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


#: Characters of a sentence that broken fonts leave, letters from which a word is two, characters below which
#: a sentence is short, and how a caption begins.
BROKEN, GLUED, SHORT, CAPTIONS = ["ð", "Þ", "\ufffd", "1⁄4", "1⁄2"], 25, 15, ["Fig.", "Figure", "Table"]


def sentence_warnings(sentences: DataFrame) -> DataFrame:
    """(doc_id, section, k, warning) for sentences (doc_id, section, k, text, spoken): what looks cut, glued or left over."""
    t, s = F.col("text"), F.col("spoken")
    first = F.substring(t, 1, 1)
    named = F.regexp_extract(t, r"^(\p{L}+\.?)\s*(\d+)(.?)", 1), F.regexp_extract(t, r"^(\p{L}+\.?)\s*(\d+)(.?)", 3)
    said = F.split(s, r"\s+")
    et_al = lambda w: F.exists(F.sequence(F.lit(0), F.size(w)), lambda i: (F.get(w, i) == "et") & F.get(w, i + 1).isin("al.",
         "al.,") & F.get(w, i + 2).rlike("^[0-9]{4}"))
    rules = {
        "glued": F.exists(F.split(t, "[^A-Za-z]+"), lambda w: F.length(w) >= GLUED), "short": F.length(t) < SHORT,
            "starts_small": (F.lower(first) == first) & (F.upper(first) != first),
        "garbled": reduce(lambda x, y: x | y, [F.contains(s, F.lit(c)) for c in BROKEN]),
        "citation_left": F.exists(text.pieces(s, text.BRACKETS), text.is_numbers) | text.let(said, et_al),
        "caption": F.coalesce(named[0].isin(CAPTIONS) & named[1].isin(".", ":", "|"), F.lit(False)),
    }
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return sentences.select("doc_id", "section", "k", F.explode(found).alias("warning"))


def quiz_issues(questions: DataFrame, titles: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, question, level, code) for questions (doc_id, question, chapter, q, choices, answer, explain, evidence), the
    paper's titles (doc_id, title) and texts (doc_id, text)."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    four = (F.size("choices") == 4) & F.forall("choices", lambda c: ~blank(c))
    rules = [("question", "error", blank(F.col("q"))), ("choices", "error", ~F.coalesce(four, F.lit(False))), ("answer", "error",
         ~F.coalesce(F.col("answer").between(0, 3), F.lit(False))), ("explain", "warning", blank(F.col("explain"))), ("evidence",
         "warning", F.coalesce(F.size("evidence"), F.lit(0)) <= 0)]
    found = F.filter(F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, level,
         test in rules]), lambda x: x.isNotNull())
    out = questions.select("doc_id", "question", F.explode(found).alias("i")).select("doc_id", "question", "i.*")
    strangers = questions.join(titles.select("doc_id", F.col("title").alias("chapter")), ["doc_id", "chapter"],
        "left_anti").select("doc_id", "question", F.lit("error"), F.lit("chapter"))
    quoted = questions.select("doc_id", "question", F.explode("evidence").alias("text")).join(texts.select("doc_id", "text"),
        ["doc_id", "text"], "left_anti").select("doc_id", "question", F.lit("warning"), F.lit("evidence_unknown")).distinct()
    c = questions.filter("answer between 0 and 3").groupBy("doc_id",
        "answer").agg(F.count("*").alias("c")).groupBy("doc_id").agg(F.sum("c").alias("all"), F.max("c").alias("most"))
    skewed = c.filter("all >= 6 and most > 0.6 * all").select("doc_id", F.lit(None).cast("int"), F.lit("warning"), F.lit("skewed"))
    return out.union(strangers).union(quoted).union(skewed)


def speech_risks(spoken: DataFrame, known: list[str]) -> DataFrame:
    """(doc_id, n, risk, example), a row for each place in texts (doc_id, n, spoken) that a voice may misread: equations,
    symbols, words of letters and digits, and acronyms other than the known ones."""
    found = lambda pattern: F.regexp_extract_all("spoken", F.lit(pattern), F.lit(0))
    acronym = F.filter(found(ACRONYMS), lambda x: ~x.isin(known))
    kinds = {"equation": found(r"\(equation\)"), "symbol": found(SYMBOLS), "mixed": found(MIXED), "acronym": acronym}

    def named(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("risk"), x.alias("example"))

    hits = F.concat(*[F.transform(found, named(kind)) for kind, found in kinds.items()])
    return spoken.select("doc_id", "n", F.explode(hits).alias("h")).select("doc_id", "n", "h.risk", "h.example")


def missing_figures(cited: DataFrame, available: DataFrame) -> DataFrame:
    """(doc_id, key) that are cited but not available."""
    return cited.distinct().join(available.select("doc_id", "key"), ["doc_id", "key"], "left_anti")


def first_missing(missing: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, key, place): the first missing figures of each paper, by kind and number."""
    number = F.regexp_extract("key", r"\d+", 0).try_cast("long")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.substring_index("key", ":", 1), number, "key"))
    return missing.withColumn("place", place).filter(F.col("place") <= most).select("doc_id", "key", "place")


def set_scores(truth: DataFrame, found: DataFrame, by: str) -> DataFrame:
    """Precision, recall and F1 to three places of sets of (by, key)."""
    t, f = truth.select(by, "key").distinct().withColumn("t", F.lit(1)), found.select(by, "key").distinct().withColumn("f", F.lit(1))
    both = t.join(f, [by, "key"], "full").groupBy(by).agg(F.sum("t").alias("nt"), F.sum("f").alias("nf"),
        F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("hits"))
    p, r = F.col("hits") / F.greatest(F.coalesce("nf", F.lit(0)), F.lit(1)), F.col("hits") / F.greatest(F.coalesce("nt", F.lit(0)), F.lit(1))
    return both.select(by, "hits", F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(F.when(p + r > 0,
        2 * p * r / (p + r)).otherwise(0.0), 3).alias("f1"))
