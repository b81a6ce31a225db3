"""Document outlines: chapters, subtrees, numbering gaps, runs, timelines and edits of sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chapter_of(sections: DataFrame) -> DataFrame:
    """Adds chapter: of each section (doc_id, n, level) the nearest one up to it with level 1, an as-of lookup by window."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn("chapter", F.last(F.when(F.col("level") <= 1, F.col("n")), ignorenulls=True).over(w))


def subtree_end(sections: DataFrame) -> DataFrame:
    """Adds until: the n of the first later section whose level isn't deeper, null at the end. A document's sections are few;
    each level's next place is a window minimum, so no section is joined with all later ones."""
    w = Window.partitionBy("doc_id").orderBy("n").rowsBetween(1, Window.unboundedFollowing)
    at = [F.min(F.when(F.col("level") <= k, F.col("n"))).over(w) for k in (1, 2, 3)]
    return sections.withColumn("until", F.when(F.col("level") == 1, at[0]).when(F.col("level") == 2, at[1]).otherwise(at[2]))


def numbering_gaps(sections: DataFrame) -> DataFrame:
    """Numbered sections (doc_id, n, number) that don't follow the last number: not above it, a sibling that skips one, or a
    top number that does."""
    w = Window.partitionBy("doc_id").orderBy("n")
    parts = sections.withColumn("a", F.split("number", r"\.").cast("array<int>")).withColumn("b", F.lag("a").over(w))
    top = F.element_at("a", 1) - F.element_at("b", 1)
    sibling = (F.size("a") == F.size("b")) & (F.size("a") > 1) & (top == 0) & (F.element_at("a", -1) - F.element_at("b", -1) > 1)
    bad = F.col("b").isNotNull() & ((F.col("a") <= F.col("b")) | sibling | (top > 1))
    return parts.filter(bad).select("doc_id", "n", "number", F.array_join("b", ".").alias("previous"))


def offsets(items: DataFrame, key: str, order: list[str], length: str) -> DataFrame:
    """Adds starts, the sum of the lengths before, and total, that of all, within each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return items.withColumn("starts", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).withColumn("total", F.sum(length).over(Window.partitionBy(key)))


def seek(timeline: DataFrame, key: str, at: Column) -> DataFrame:
    """The item of each key that plays at a time: the last whose start isn't later."""
    return timeline.filter(F.col("starts") <= at).groupBy(key).agg(F.max(F.struct("starts", "item")).alias("x")).select(key, "x.item", "x.starts")


def runs(lines: DataFrame, breaks: Column) -> DataFrame:
    """Adds run: how many breaks a document has had up to each line; the first line opens run 1."""
    w = Window.partitionBy("doc_id").orderBy("n")
    return lines.withColumn("run", F.sum(F.when(breaks | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))


def shifted(sections: DataFrame, moves: DataFrame) -> DataFrame:
    """sections (doc_id, n, level, ...) after moves (doc_id, n, by), one a document: the section and all that hangs below it one
    level deeper (by 1) or higher (by -1). A move that isn't allowed changes nothing: deeper for a document's first
    section, for one that is deeper than the one before it, or where something would pass level 3; higher at level 1."""
    w = Window.partitionBy("doc_id").orderBy("n")
    root = subtree_end(sections).withColumn("before", F.lag("level").over(w)).join(moves, ["doc_id", "n"])
    root = root.select("doc_id", F.col("n").alias("_n"), F.col("until").alias("_until"), F.col("level").alias("_level"),
        F.col("before").alias("_before"), F.col("by").alias("_by"))
    rows = sections.join(root, "doc_id", "left")
    inside = F.coalesce((F.col("n") >= F.col("_n")) & (F.col("_until").isNull() | (F.col("n") < F.col("_until"))), F.lit(False))
    rows = rows.withColumn("_in", inside).withColumn("_deepest", F.max(F.when(F.col("_in"), F.col("level"))).over(Window.partitionBy("doc_id")))
    deeper = F.col("_before").isNotNull() & (F.col("_level") <= F.col("_before")) & (F.col("_deepest") < 3)
    legal = F.when(F.col("_by") > 0, deeper).otherwise(F.col("_level") > 1)
    level = F.when(F.col("_in") & legal, F.col("level") + F.col("_by")).otherwise(F.col("level"))
    return rows.withColumn("level", level).select(*sections.columns)


def indent(sections: DataFrame, doc_id: int, n: int, by: int) -> DataFrame:
    """`shifted` by one move."""
    return shifted(sections, sections.sparkSession.createDataFrame([(doc_id, n, by)], "doc_id long, n long, by int"))


def split_sections(sections: DataFrame, sentences: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, sentences) after splits (doc_id, section, at, title, take), one a document: the sentences from `at` on follow in
    a section of their own, of the same level and kind. It has the given title; with take, the sentence at `at` becomes
    the heading and goes, and without a title its text is it, less a final full stop or colon. A split without take that
    is at the first sentence or has no title changes nothing. sections are (doc_id, n, level, kind, title), sentences
    (doc_id, section, k, text), k from 1."""
    s = splits.select("doc_id", F.col("section").alias("_s"), F.col("at").alias("_at"), F.trim(F.coalesce("title",
        F.lit(""))).alias("_title"), F.coalesce("take", F.lit(False)).alias("_take"))
    s = s.filter(F.col("_take") | ((F.col("_at") > 1) & (F.col("_title") != "")))
    there = sentences.select("doc_id", F.col("section").alias("_s"), F.col("k").alias("_at"), F.col("text").alias("_text"))
    s = s.join(there, ["doc_id", "_s", "_at"])  # the sentence must be there
    rows = sentences.join(s, "doc_id", "left")
    own = F.coalesce((F.col("section") == F.col("_s")) & (F.col("k") >= F.col("_at")), F.lit(False))
    later = F.coalesce(F.col("section") > F.col("_s"), F.lit(False))
    rows = rows.filter(~(own & F.col("_take") & (F.col("k") == F.col("_at"))))
    k = F.when(own, F.col("k") - F.col("_at") + F.when(F.col("_take"), 0).otherwise(1)).otherwise(F.col("k"))
    moved = rows.select("doc_id", (F.col("section") + F.when(own | later, 1).otherwise(0)).alias("section"), k.alias("k"), "text")
    heads = sections.join(s, "doc_id", "left")
    kept = heads.select("doc_id", (F.col("n") + F.when(F.coalesce(F.col("n") > F.col("_s"), F.lit(False)),
        1).otherwise(0)).alias("n"), "level", "kind", "title")
    title = F.coalesce(F.nullif("_title", F.lit("")), F.regexp_replace("_text", "[.:]$", ""))
    new = heads.filter(F.col("n") == F.col("_s")).select("doc_id", (F.col("n") + 1).alias("n"), "level", "kind", title.alias("title"))
    return kept.unionByName(new), moved
