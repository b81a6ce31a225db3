"""Papers as tables of sections and sentences: pasted text, first-match joins, edits of sections, words looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.align import sentences_udf
from scholia.functions.text import compounds, join_lines, speech, term_key
from scholia.sources.stored import stored


#: Characters of a pronunciation rule's two sides at most.
MOST_FIND, MOST_PUT = 60, 120


def joined(lines: DataFrame, group: str, mend: bool = True) -> DataFrame:
    """(doc_id, <group>, text): lines (doc_id, n, <group>, line) joined with their hyphens undone, or as they are unless `mend`.
    Compounds are those of the whole document; a document's own lines are what bounds both arrays."""
    if not mend:
        pieces = lines.groupBy("doc_id", group).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
        return pieces.select("doc_id", group, F.array_join(F.transform("x", lambda i: i["line"]), " ").alias("text"))
    words = lines.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(compounds(F.col("line"))))).alias("compounds"))
    ordered = lines.groupBy("doc_id", group).agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return ordered.join(words, "doc_id").select("doc_id", group, join_lines(F.transform("x", lambda i: i["line"]), F.col("compounds")).alias("text"))


def joined_parts(parts: DataFrame, mend: bool = True) -> DataFrame:
    """`joined` for lines that lie together already: parts (doc_id, ..., x: their lines in order) with text in the place of x."""
    rest = [c for c in parts.columns if c != "x"]
    if not mend:
        return parts.select(*rest, F.array_join("x", " ").alias("text"))
    words = parts.select("doc_id", F.explode("x").alias("line")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_set(compounds(F.col("line"))))).alias("compounds"))
    return parts.join(words, "doc_id").select(*rest, join_lines(F.col("x"), F.col("compounds")).alias("text"))


def pasted_paragraphs(headed: DataFrame) -> DataFrame:
    """(doc_id, section, paragraph, text) of lines with their heading level (see `files.headings`): a heading opens a section,
    a blank line a paragraph."""
    w = Window.partitionBy("doc_id").orderBy("n")
    opens = F.col("level").isNotNull()
    marked = headed.withColumn("section", F.count_if(opens).over(w)).withColumn("paragraph", F.count_if((F.trim("line") == "")
        | opens).over(w)).filter(~opens & (F.trim("line") != ""))
    both = marked.withColumn("place", F.struct("section", "paragraph")).withColumn("line", F.trim("line"))
    return joined(both, "place").select("doc_id", "place.section", "place.paragraph", "text")


def pasted_sentences(headed: DataFrame) -> DataFrame:
    """(doc_id, section, k, text, spoken): the sentences of pasted paragraphs, counted through each section from 1."""
    rows = pasted_paragraphs(headed).select("doc_id", "section", "paragraph", F.posexplode(sentences_udf("text")))
    place = F.row_number().over(Window.partitionBy("doc_id", "section").orderBy("paragraph", "pos"))
    return rows.select("doc_id", "section", place.alias("k"), F.col("col").alias("text"), speech(F.col("col")).alias("spoken"))


def first_places(sentences: DataFrame) -> DataFrame:
    """(doc_id, text, section, k): where each text of a document first stands. A partial aggregate, so repeats of a text
    never multiply rows of a join."""
    return sentences.groupBy("doc_id", "text").agg(F.min(F.struct("section", "k")).alias("at")).select("doc_id", "text", "at.section", "at.k")


def with_examples(lookups: DataFrame, sentences: DataFrame, translations: DataFrame) -> DataFrame:
    """lookups (uid, doc_id, sentence) with audio_ref, the item of the first sentence with that text that is spoken, and
    translated, what the first one with that text, spoken or not, is in translations (doc_id, section, k, translated)."""
    text = F.col("sentence")
    heard = first_places(sentences.filter("spoken <> ''")).select("doc_id", F.col("text").alias("sentence"),
        F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("section").cast("string"), F.lit("_"),
        F.col("k").cast("string")).alias("audio_ref"))
    seen = first_places(sentences).join(translations, ["doc_id", "section", "k"]).select("doc_id", F.col("text").alias("sentence"), "translated")
    return lookups.filter(text.isNotNull()).join(heard, ["doc_id", "sentence"], "left").join(seen, ["doc_id", "sentence"],
        "left").unionByName(lookups.filter(text.isNull()), allowMissingColumns=True)


def translated_items(items: DataFrame, stored: DataFrame, cache: DataFrame, current: DataFrame) -> DataFrame:
    """items (doc_id, item_id, text) with translated: of documents that are current (doc_id) by item from stored (doc_id,
    item_id, translated), of the others by text from cache (text, translated)."""
    up = items.join(current.select("doc_id", F.lit(True).alias("current")).distinct(), "doc_id", "left")
    up = up.join(stored.select("doc_id", "item_id", F.col("translated").alias("by_item")), ["doc_id", "item_id"],
        "left").join(cache.select("text", F.col("translated").alias("by_text")), "text", "left")
    return up.select("doc_id", "item_id", "text", F.when(F.col("current"), F.col("by_item")).otherwise(F.col("by_text")).alias("translated"))


def resume(items: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc_id, at, exact): where reading goes on. items (doc_id, n, item_id, text, heading), positions (doc_id, text,
    item_id): the first item with the text that is a heading just if the position's id ends in h; else the first with the
    text; else that with the id; else 0. exact is whether the text was found."""
    p = positions.select("doc_id", F.col("text").alias("said"), F.col("item_id").alias("id"))
    found = items.join(p, "doc_id")
    same, by_id = F.col("text") == F.col("said"), F.col("item_id") == F.col("id")
    first = lambda where: F.min(F.when(where, F.col("n")))
    at = found.groupBy("doc_id").agg(first(same & (F.col("heading") == F.col("id").endswith("h"))).alias("a"),
        first(same).alias("b"), first(by_id).alias("c"))
    return at.select("doc_id", F.coalesce("a", "b", "c", F.lit(0)).cast("long").alias("at"), F.col("b").isNotNull().alias("exact"))


def term_marks(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, token) that are a form of one of their document's terms (doc_id, word), plurals included."""
    keys = terms.select("doc_id", term_key(F.lower("word")).alias("key")).distinct()
    return tokens.withColumn("key", term_key(F.lower("token"))).join(keys, ["doc_id", "key"], "left_semi").select("doc_id", "pos", "token")


def record_words(words: DataFrame, lookups: DataFrame, known: DataFrame) -> DataFrame:
    """words (headword, lookups, first_seen, last_seen) after new lookups (uid, headword, looked_at): those whose uid is known
    count no more, the others once."""
    new = lookups.dropDuplicates(["uid"]).join(known.select("uid"), "uid", "left_anti")
    more = new.groupBy("headword").agg(F.count("*").alias("lookups"), F.min("looked_at").alias("first_seen"), F.max("looked_at").alias("last_seen"))
    both = words.select("headword", "lookups", "first_seen", "last_seen").union(more)
    return both.groupBy("headword").agg(F.sum("lookups").alias("lookups"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"))


def registered(results: DataFrame, words: DataFrame) -> DataFrame:
    """results (headword) with whether the word list has them."""
    return results.join(words.select("headword", F.lit(True).alias("hit")).distinct(), "headword",
        "left").withColumn("registered", F.coalesce("hit", F.lit(False))).drop("hit")


def resolved(references: DataFrame, labels: DataFrame) -> DataFrame:
    """references (doc_id, n, key) with label_n, the first n of labels (doc_id, n, key) that has their key in their document; null
    where none has. Labels without a key are passed over."""
    first = labels.filter(F.col("key").isNotNull()).groupBy("doc_id", "key").agg(F.min("n").alias("label_n"))
    return references.join(first, ["doc_id", "key"], "left").select("doc_id", "n", "key", "label_n")


def first_labels(figures: DataFrame, key: Column) -> DataFrame:
    """figures (doc_id, n) of which those with a label's key are kept once a key, the first; those without one all stay."""
    keyed = figures.withColumn("key", key)
    return keyed.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", F.coalesce("key",
        F.col("n").cast("string"))).orderBy("n"))).filter("r = 1").drop("r")


def rule_chains(rules: DataFrame, gap: float = 260) -> DataFrame:
    """rules (page, n, y) with chain: a new one where the rule above is further than the gap."""
    w = Window.partitionBy("page").orderBy("y", "n")
    return rules.withColumn("chain", F.sum(F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0)).over(w))


def merge_section(sentences: DataFrame, sections: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(sentences, sections) after the sections that `at` names (a condition on n and doc_id, no two adjacent, never a
    document's first) are merged into the one before: their heading follows as a sentence, then their sentences. Numbers
    (section, k) stay dense and start at 1."""
    w = Window.partitionBy("doc_id").orderBy("n")
    gone = sections.withColumn("gone", at & (F.row_number().over(w) > 1)).withColumn("new", F.count_if(~F.col("gone")).over(w))
    heads = gone.filter("gone").select("doc_id", F.col("new").alias("section"), F.col("n").alias("old"), F.lit(0).alias("k"),
        F.col("title").alias("text"))
    moved = sentences.join(gone.select("doc_id", F.col("n").alias("section"), "new"), ["doc_id", "section"]).select("doc_id",
        F.col("new").alias("section"), F.col("section").alias("old"), "k", "text")
    again = Window.partitionBy("doc_id", "section").orderBy("old", "k")
    rows = moved.union(heads).withColumn("k", F.row_number().over(again)).select("doc_id", "section", "k", "text")
    return rows, gone.filter("not gone").select(*[c for c in sections.columns if c != "n"], F.col("new").alias("n")).select(*sections.columns)


def rename_sections(sections: DataFrame, names: DataFrame) -> DataFrame:
    """sections (doc_id, n, title) with the titles of names (doc_id, n, new) that aren't blank."""
    new = F.trim("new")
    return sections.join(names, ["doc_id", "n"], "left").withColumn("title", F.when(new != "",
        new).otherwise(F.col("title"))).select(*sections.columns)


#: Fixed value: how a reference begins.
REFERENCE = r"^(\[\d+\]|\d{1,3}\.\s|\d{1,3}\s+[A-Z])"


def references(lines: DataFrame) -> DataFrame:
    """(doc_id, entry, n_lines, text): the references of lines (doc_id, n, line), from 1. A line that doesn't begin one goes on
    with the last; the first begins one in any case."""
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = lines.withColumn("entry", F.greatest(F.count_if(F.col("line").rlike(REFERENCE)).over(w), F.lit(1)))
    return joined(rows, "entry").join(rows.groupBy("doc_id", "entry").agg(F.count("*").alias("n_lines")), ["doc_id",
        "entry"]).select("doc_id", "entry", "n_lines", "text")


#: The keys that papers are sorted by.
SORTS = ["imported", "created", "downloaded", "title", "pages"]


def sorted_every_way(metas: DataFrame) -> DataFrame:
    """(sort, newest, doc_id, place): papers (doc_id, imported, created, downloaded, title, pages) in the order of each key, both
    ways; unknown values come last either way, titles compare without case. All orders are made by one sort."""
    number = lambda c: F.unix_date(c).cast("double") if c not in ("title", "pages") else F.col(c).cast("double")
    value = [F.struct(F.lit(k).alias("sort"), (F.lit(None).cast("double") if k == "title" else number(k)).alias("number"),
        (F.nullif(F.lower("title"), F.lit("")) if k == "title" else F.lit(None).cast("string")).alias("word")) for k in SORTS]
    rows = metas.select("doc_id", F.explode(F.array(*value)).alias("v"), ).select("doc_id", "v.*").withColumn("newest",
        F.explode(F.array(F.lit(True), F.lit(False))))
    way = lambda c, up: F.when(F.col("newest") != F.lit(up), F.col(c))
    order = [F.col("sort"), F.col("newest"), (F.col("number").isNull() & F.col("word").isNull()), way("number", True).asc(),
        way("number", False).desc(), way("word", True).asc(), way("word", False).desc(), F.col("doc_id")]
    placed = ranked(rows, *order)
    starts = placed.groupBy("sort", "newest").agg((F.min("place") - 1).alias("before"))
    return placed.join(F.broadcast(starts), ["sort", "newest"]).select("sort", "newest", "doc_id", (F.col("place") - F.col("before")).alias("place"))


def kept_rules(rules: DataFrame) -> DataFrame:
    """The pronunciation rules (rule_id, find, put, whole_case) that can be used: trimmed, not blank, not too long, the first
    for what it finds. Whether case counts is as said, or else by whether there is a capital."""
    find, put = F.trim("find"), F.trim("put")
    good = rules.withColumn("find", find).withColumn("put", put).filter((F.length("find").between(1, MOST_FIND))
        & F.length("put").between(1, MOST_PUT))
    case = F.coalesce("whole_case", F.col("find") != F.lower("find"))
    first = good.groupBy("find").agg(F.min(F.struct("rule_id", "put", case.alias("whole_case"))).alias("x"))
    return first.select("x.rule_id", "find", "x.put", "x.whole_case")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with place, from 1, in one order over the whole table and without a single task for all rows: a range exchange
    sorts, each part counts its rows, and the few counts give each part's start."""
    parts = stored(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = parts.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding,
        -1)), F.lit(0)).alias("_start"))
    return parts.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place",
        F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_start")
