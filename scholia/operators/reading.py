"""Papers as they are read: marks in order, speech plans, chapters, quizzes, loading with checks, comparison with a truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators.papers import first_places

#: Kinds of sections and of figures, how a figure's file is named, and where marks go whose sentence is gone.
KINDS, FIGURE_KINDS, FILE, GONE = ["front", "body", "back"], ["figure", "table", "equation", "image"], r"^[A-Za-z0-9_\-]+\.png$", 1_000_000_000


def marks_in_order(marks: DataFrame, sections: DataFrame, sentences: DataFrame, translations: DataFrame) -> DataFrame:
    """(paper_id, uid, place, section, new_header, sentence, translated, note) of live marks (uid, paper_id, sentence, section,
    note, created_at) in the order of their papers, from place 1: by the first place where a paper (sections: doc_id, n,
    title; sentences: doc_id, section, k, text) has the sentence, those that it lacks last. The section is the one of
    that place, else the one that was kept with the mark. translations are (doc_id, section, k, translated)."""
    first = first_places(sentences).select("doc_id", "text", F.col("section").alias("at_section"), F.col("k").alias("at_k"))
    named = first.join(sections.select("doc_id", F.col("n").alias("at_section"), "title"), ["doc_id", "at_section"], "left")
    spoken = named.join(translations.select("doc_id", F.col("section").alias("at_section"), F.col("k").alias("at_k"),
        "translated"), ["doc_id", "at_section", "at_k"], "left")
    where = spoken.select(F.col("doc_id").alias("paper_id"), F.col("text").alias("sentence"), "at_section", "at_k", "title", "translated")
    rows = marks.join(where, ["paper_id", "sentence"], "left")
    w = Window.partitionBy("paper_id").orderBy(F.coalesce("at_section", F.lit(GONE)), F.coalesce("at_k", F.lit(GONE)), "created_at", "uid")
    section = F.coalesce("title", "section")
    rows = rows.withColumn("section", section).withColumn("place", F.row_number().over(w))
    changed = F.coalesce(~F.col("section").eqNullSafe(F.lag("section").over(w)), F.lit(True)) | (F.col("place") == 1)
    return rows.select("paper_id", "uid", "place", "section", changed.alias("new_header"), "sentence", "translated", "note")


def spoken_items(sections: DataFrame, sentences: DataFrame, skip_back: bool = False) -> DataFrame:
    """(doc_id, section, k, item_id, said): what is read of a paper, each section's heading (k 0, id s<n>_h) and its sentences
    that have anything to say (k from 1, id s<n>_<k>); without back matter if asked."""
    kept = sections.filter(F.coalesce(F.col("kind") != "back", F.lit(True))) if skip_back else sections
    heads = kept.select("doc_id", F.col("n").alias("section"), F.lit(0).cast("long").alias("k"),
        text.heading_speech(F.col("number"), F.col("title")).alias("said"))
    said = sentences.join(kept.select("doc_id", F.col("n").alias("section")), ["doc_id", "section"], "left_semi")
    rows = said.select("doc_id", "section", F.col("k").cast("long").alias("k"), F.col("spoken").alias("said")).filter("said <> ''").unionByName(heads)
    part = F.when(F.col("k") == 0, "h").otherwise(F.col("k").cast("string"))
    return rows.select("doc_id", "section", "k", F.concat(F.lit("s"), F.col("section").cast("string"), F.lit("_"), part).alias("item_id"), "said")


def cache_key(said: Column, voice: str, rate: int) -> Column:
    """The name under which a spoken text is kept: the first 20 hex digits of the SHA-1 of voice, rate and text."""
    return F.substring(F.sha1(F.concat(F.lit(f"{voice}|{rate}|"), said).cast("binary")), 1, 20)


def speech_plan(items: DataFrame, cache: DataFrame, voice: str, rate: int) -> DataFrame:
    """items with their cache key and reused, whether the cache (key, seconds) has it already; seconds are those of the cache."""
    keyed = items.withColumn("key", cache_key(F.col("said"), voice, rate))
    kept = cache.groupBy("key").agg(F.max("seconds").alias("seconds"))
    return keyed.join(kept, "key", "left").withColumn("reused", F.col("seconds").isNotNull())


def chapters(sections: DataFrame) -> DataFrame:
    """sections (doc_id, n, level, kind, title) without back matter, with chapter: which group of a section of level 1 and those
    that follow it each is in (a paper's first section always opens one), and file, the group's file name."""
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = sections.filter("kind <> 'back'")
    opens = (F.col("level") == 1) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("opens", opens).withColumn("chapter", F.count_if("opens").over(w))
    head = F.last(F.when(F.col("opens"), F.col("title")), ignorenulls=True).over(w)
    name = F.concat(F.lpad(F.col("chapter").cast("string"), 2, "0"), F.lit("_"), text.slug(head), F.lit(".m4a"))
    return rows.withColumn("file", name).drop("opens")


def quiz_view(questions: DataFrame, sections: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id, section, questions, evidence: ids of the sentences quoted, in order): quiz chapters, by title, at the sections of
    their papers that have it; chapters without a question don't show. An id is s<n>_<k> of a text's first place."""
    asked = questions.filter(F.col("q").isNotNull())
    count = asked.groupBy("doc_id", "chapter").agg(F.count("*").alias("questions"))
    quoted = asked.select("doc_id", "chapter", "question", F.posexplode("evidence").alias("pos",
        "text")).join(first_places(sentences), ["doc_id", "text"])
    sid = F.concat(F.lit("s"), F.col("section").cast("string"), F.lit("_"), F.col("k").cast("string"))
    ids = quoted.groupBy("doc_id", "chapter").agg(F.array_sort(F.collect_list(F.struct("question", "pos", sid.alias("id")))).alias("x"))
    rows = sections.select("doc_id", F.col("n").alias("section"), F.col("title").alias("chapter")).join(count, ["doc_id",
         "chapter"]).join(ids, ["doc_id", "chapter"], "left")
    return rows.select("doc_id", "section", "questions", F.coalesce(F.transform("x", lambda i: i["id"]),
        F.array().cast("array<string>")).alias("evidence"))


def quiz_counts(questions: DataFrame) -> DataFrame:
    """(doc_id, chapters, questions) of each paper's quiz."""
    return questions.groupBy("doc_id").agg(F.countDistinct("chapter").alias("chapters"), F.count("*").alias("questions"))


# --- loading ---------------------------------------------------------------------------------------------------------

#: A paper as JSON. Sentences are kept as they are: a text, or an object with t (the text) and s (what is spoken).
PAPER = "title string, manual string, sections array<struct<title:string,number:string,level:string,kind:string,page:string,sentences:string>>"
SENTENCE = "t string, s string"


def edited(sections: DataFrame, sentences: DataFrame, by: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(sections, sentences) after an edit by hand of sections (doc_id, n, title, level, kind) and sentences (doc_id, section, k,
    text): what follows from titles and texts (number, speech_title, spoken) is made anew, sections and sentences are
    counted from 1 again, and the edit is stamped in `manual`."""
    w, own = Window.partitionBy("doc_id").orderBy("n"), Window.partitionBy("doc_id", "section").orderBy("k")
    number = F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\.?\s", 1)
    bare = F.when(number != "", F.regexp_replace("title", r"^\d+(?:\.\d+)*\.?\s+", "")).otherwise(F.col("title"))
    stamp = F.struct(F.lit(by).alias("by"), F.lit(at).alias("at"))
    rows = sections.withColumn("new", F.row_number().over(w))
    heads = rows.select("doc_id", F.col("new").alias("n"), "title", number.alias("number"), "level", "kind",
                        text.heading_speech(number, bare).alias("speech_title"), stamp.alias("manual"))
    moved = sentences.join(rows.select("doc_id", F.col("n").alias("section"), "new"), ["doc_id", "section"])
    said = moved.select("doc_id", F.col("new").alias("section"), F.row_number().over(own).alias("k"), "text",
                        text.speech(F.col("text")).alias("spoken"))
    return heads, said


def needs_rebuild(meta: DataFrame, version: str) -> DataFrame:
    """Papers (doc_id, json, extractor_version) whose content must be made anew: there is none, or another version made it and
    nobody edited it by hand."""
    edited = F.coalesce(F.contains("json", F.lit('"manual"')), F.lit(False))
    return meta.filter(~edited & (F.col("json").isNull() | ~F.col("extractor_version").eqNullSafe(F.lit(version)))).select("doc_id")


def loaded(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, sentences, errors) of papers (doc_id, json).

    sections (doc_id, n, title, number, level, kind, page, speech_title) and sentences (doc_id, section, k, text, spoken)
    have what the JSON lacks filled in: numbers and levels from titles, speech from texts. errors (doc_id, at, code) name
    what can't be mended: json, sections, title, kind, sentences, t; `at` is the section, or section.sentence. Papers with
    an error give no rows.
    """
    parsed = raw.select("doc_id", F.from_json("json", PAPER).alias("x"), F.from_json("json", "sections string").alias("y"),
        F.try_parse_json("json").isNull().alias("broken"))
    listed = F.coalesce(F.ltrim(F.col("y.sections")).startswith("["), F.lit(False))
    top = parsed.filter(F.col("broken") | ~listed).select("doc_id", F.lit("").alias("at"), F.when(F.col("broken"),
        "json").otherwise("sections").alias("code"))
    s = parsed.filter(~F.col("broken") & listed).select("doc_id", F.posexplode("x.sections").alias("i", "s")).select("doc_id",
        F.col("i").cast("long").alias("i"), "s.*")
    untitled, unlisted = F.trim(F.coalesce("title", F.lit(""))) == "", ~F.coalesce(F.ltrim("sentences").startswith("["), F.lit(False))
    odd = ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))
    found = F.array(F.when(untitled, "title"), F.when(~untitled & odd, "kind"), F.when(~untitled & unlisted, "sentences"))
    flawed = s.select("doc_id", F.col("i").cast("string").alias("at"), F.explode(F.array_compact(found)).alias("code"))
    each = s.filter(~untitled & ~unlisted).select("doc_id", "i", F.posexplode(F.from_json("sentences", "array<string>")).alias("k", "j"))
    plain = ~F.coalesce(F.ltrim("j").startswith("{"), F.lit(False))
    each = each.withColumn("o", F.from_json("j", SENTENCE)).withColumn("text", F.when(plain, F.col("j")).otherwise(F.col("o.t")))
    mute = each.filter(F.col("text").isNull()).select("doc_id", F.concat_ws(".", F.col("i").cast("string"),
        F.col("k").cast("string")).alias("at"), F.lit("t").alias("code"))
    errors = top.union(flawed).union(mute)
    bad = errors.select("doc_id").distinct()
    number = F.coalesce("number", F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\.?\s", 1))
    level = F.coalesce(F.when(F.col("level").try_cast("int") >= 1, F.col("level").try_cast("int")), F.when(number != "",
        F.size(F.split(number, r"\."))).otherwise(1))
    bare = F.when(number != "", F.regexp_replace("title", r"^\d+(?:\.\d+)*\.?\s+", "")).otherwise(F.col("title"))
    sections = s.join(bad, "doc_id", "left_anti").select("doc_id", (F.col("i") + 1).alias("n"), "title", number.alias("number"),
         level.alias("level"), "kind", F.coalesce(F.col("page").try_cast("int"), F.lit(1)).alias("page"),
        text.heading_speech(number, bare).alias("speech_title"))
    spoken = F.coalesce(F.when(~plain, F.col("o.s")), text.speech(F.col("text")))
    sentences = each.join(bad, "doc_id", "left_anti").select("doc_id", (F.col("i") + 1).alias("section"),
        (F.col("k") + 1).cast("long").alias("k"), "text", spoken.alias("spoken"))
    return sections, sentences, errors


def figure_issues(items: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, item, level, code) of figure lists (doc_id, item, file, kind, label) and the files that there are (doc_id,
    file): errors file (its name), missing (no such file), kind; warnings label (it lacks one) and image (of unknown kind)."""
    named = F.coalesce(F.col("file").rlike(FILE), F.lit(False))
    there = items.join(files.select("doc_id", "file", F.lit(True).alias("there")).distinct(), ["doc_id", "file"], "left").withColumn("named", named)
    fine, kind = F.col("named") & F.coalesce("there", F.lit(False)), F.col("kind")
    rules = [
        ("error", "file", ~F.col("named")), ("error", "missing", F.col("named") & ~F.coalesce("there", F.lit(False))), ("error",
             "kind", fine & ~F.coalesce(kind.isin(FIGURE_KINDS), F.lit(False))),
        ("warning", "label", fine & kind.isin("figure", "table", "equation") & (F.coalesce("label", F.lit("")) == "")),
            ("warning", "image", fine & (kind == "image")),
    ]
    found = F.array(*[F.when(test, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, test in rules])
    return there.select("doc_id", "item", F.explode(F.array_compact(found)).alias("i")).select("doc_id", "item", "i.level", "i.code")


# --- comparison with a truth -----------------------------------------------------------------------------------------


def squeezed(said: Column) -> Column:
    """A text for comparison: lower case, single spaces."""
    return F.trim(F.lower(F.regexp_replace(said, r"\s+", " ")))


def head_key(title: Column) -> Column:
    """A heading for comparison: also without a final colon or full stop, and without the full stop after its number."""
    return F.regexp_replace(F.regexp_replace(squeezed(title), "[:.]+$", ""), r"^(\d+(?:\.\d+)*)\.?\s+", "$1 ")


def macro(scores: DataFrame, *names: str) -> DataFrame:
    """One row: how many papers, and the means of their scores to three places."""
    return scores.agg(F.count("*").alias("papers"), *[F.round(F.avg(n), 3).alias(n) for n in names])


def figure_recall(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, truth, auto, recall, unlabeled) of figure keys (doc_id, key): how many keys the truth has, how many figures were
    found, the share of the truth's keys among theirs, and how many have none."""
    t = truth.filter("key is not null").select("doc_id", "key").distinct().withColumn("t", F.lit(1))
    f = found.groupBy("doc_id", "key").agg(F.count("*").alias("f"))
    hit = F.col("t").isNotNull() & F.col("f").isNotNull()
    both = t.join(f, ["doc_id", "key"], "full").groupBy("doc_id").agg(F.count("t").alias("truth"), F.coalesce(F.sum("f"),
        F.lit(0)).alias("auto"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("f"))),
        F.lit(0)).alias("unlabeled"))
    return both.select("doc_id", "truth", "auto", F.round(F.col("hits") / F.greatest("truth", F.lit(1)), 3).alias("recall"), "unlabeled")
