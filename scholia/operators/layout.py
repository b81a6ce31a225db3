"""Page geometry: rows of fragments, lines in tables, captions near graphics, reading order, and papers made of laid-out lines.
All joins are within a page."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text
from scholia.operators.papers import joined, joined_parts
from scholia.sources.stored import stored

#: How much smaller than the body small print is; how far from a page's ends a margin reaches, and on how many
#: pages a line must stand there; by how much a run's size and height may change; how much of a row is mathematics.
SMALL, MARGIN, TIMES, SIZE_STEP, MATH = 0.4, 0.08, 3, 0.3, 0.5


def outside(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines (page, line, x, y: centres) whose centre is in none of the page's boxes (page, x0, y0, x1, y1)."""
    b = boxes.select(F.col("page").alias("p"), "x0", "y0", "x1", "y1")
    inside = (F.col("page") == F.col("p")) & F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return lines.join(b, inside, "left_anti")


def nearest_graphic(captions: DataFrame, boxes: DataFrame, band: float) -> DataFrame:
    """(page, line, box, gap): for each caption (page, line, x0, x1, y0, y1) the closest box (page, box, x0, x1, y0, y1) above or
    below it within the band that it shares some width with."""
    b = boxes.select(F.col("page").alias("p"), "box", *[F.col(c).alias(f"b{c}") for c in ("x0", "x1", "y0", "y1")])
    gap = F.greatest(F.col("y0") - F.col("by1"), F.col("by0") - F.col("y1"))
    near = captions.join(b, (F.col("page") == F.col("p")) & (F.col("x0") <= F.col("bx1")) & (F.col("bx0") <= F.col("x1")) & gap.between(0, band))
    return near.groupBy("page", "line").agg(F.min(F.struct(gap.alias("gap"), "box")).alias("b")).select("page", "line", "b.box", "b.gap")


def equation_rows(rows: DataFrame) -> DataFrame:
    """Rows (page, n, y0, y1, math: share of mathematical signs) that are equations: mathematics, and no prose beside them."""
    prose = rows.filter(F.col("math") < MATH).select(F.col("page").alias("p"), F.col("y0").alias("py0"), F.col("y1").alias("py1"))
    beside = (F.col("page") == F.col("p")) & (F.col("y0") < F.col("py1")) & (F.col("py0") < F.col("y1"))
    return rows.filter(F.col("math") >= MATH).join(prose, beside, "left_anti")


def rows_of_fragments(fragments: DataFrame, height: float, gap: float) -> DataFrame:
    """(page, row, y, x0, x1, text): fragments (page, n, x0, x1, y, text) of one height joined from left to right, with a space
    where at least `gap` is free between them. A fragment that is printed over the same one doesn't count again."""
    w = Window.partitionBy("page").orderBy("y", "x0", "n")
    rows = fragments.withColumn("row", F.count_if(F.coalesce(F.col("y") - F.lag("y").over(w) > height, F.lit(True))).over(w))
    in_row = Window.partitionBy("page", "row").orderBy("x0", "n")
    again = (F.lag("text").over(in_row) == F.col("text")) & (F.col("x0") < F.lag("x1").over(in_row))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False))).filter("not again")
    space = F.when(F.col("x0") - F.lag("x1").over(in_row) >= gap, " ").otherwise("")
    rows = rows.withColumn("piece", F.concat(space, "text"))
    parts = rows.groupBy("page", "row").agg(F.min("y").alias("y"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.array_sort(F.collect_list(F.struct("x0", "n", "piece"))).alias("p"))
    return parts.select("page", "row", "y", "x0", "x1", F.trim(F.array_join(F.transform("p", lambda i: i["piece"]), "")).alias("text"))


def single_column(lines: DataFrame, wide: float, share: float = 0.35) -> DataFrame:
    """(page, wide_share, single): pages of which at least a share of the lines (width) are wide."""
    out = lines.groupBy("page").agg(F.avg(F.when(F.col("width") >= wide, 1.0).otherwise(0.0)).alias("wide_share"))
    return out.withColumn("single", F.col("wide_share") >= share)


def reading_order(lines: DataFrame) -> DataFrame:
    """Adds place: by column, rounded height, then x."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy("col", F.round("y"), "x", "line")))


# --- papers of laid-out lines ----------------------------------------------------------------------------------------


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, size, chars): the size that most characters of lines (doc_id, size, text) have; of equals the smaller."""
    sizes = lines.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("size"), F.max("chars").alias("chars"))


def margins(lines: DataFrame) -> DataFrame:
    """(doc_id, mark, n): what stands in a document's upper or lower margin three times or more, digits counting alike. Heights
    y of lines (doc_id, y, text) go from 0 to 1."""
    near = lines.filter((F.col("y") < MARGIN) | (F.col("y") > 1 - MARGIN))
    return near.groupBy("doc_id", margin_mark().alias("mark")).agg(F.count("*").alias("n")).filter(F.col("n") >= TIMES)


def margin_mark():
    return F.regexp_replace("text", r"\d+", "#")


def line_runs(lines: DataFrame, gap: float) -> DataFrame:
    """lines (doc_id, n, page, size, y) with run: a new one on a new page, at another size, or after a gap."""
    w = Window.partitionBy("doc_id").orderBy("n")
    page, size, up = F.col("page") != F.lag("page").over(w), F.abs(F.col("size") - F.lag("size").over(w)) >= SIZE_STEP, F.col("y") - F.lag("y").over(w) > gap
    return lines.withColumn("run", F.count_if(F.coalesce(page | size | up, F.lit(True))).over(w))


def abstract_run(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, run): of the first page's runs (see `line_runs`, with text) the one that is the abstract: one that says so first,
    else one of the body's size (sizes: doc_id, size), else any; of several the longest, then the first."""
    first = runs.filter("page = 1").join(sizes.select("doc_id", F.col("size").alias("body")), "doc_id")
    own = first.groupBy("doc_id", "run").agg(F.sum(F.length("text")).alias("chars"), F.min_by("text", "n").alias("head"),
        F.bool_and(F.abs(F.col("size") - F.col("body")) < SIZE_STEP).alias("plain"))
    labelled = F.lower("head").startswith("abstract")
    return own.groupBy("doc_id").agg(F.max_by("run", F.struct(labelled, "plain", "chars", -F.col("run"))).alias("run"))


def paper(lines: DataFrame, mend: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sections, texts) of a document's lines (doc_id, n, page, size, bold, y, text) in reading order.

    Lines that repeat in margins and small print go. A heading opens a section; a heading line that follows another of its
    size on the page goes on with it. sections are (doc_id, n, title, number, level, kind, page): "Abstract" is front, what
    follows a back-matter name is back, all else body; what stands before the first heading is section 0, without title.
    texts are (doc_id, section, text), lines joined, with words that hyphens break mended unless `mend` says no.
    """
    sizes = body_size(lines).select("doc_id", F.col("size").alias("body"))
    kept = lines.withColumn("mark", margin_mark())
    edge = (F.col("y") < MARGIN) | (F.col("y") > 1 - MARGIN)
    repeated = margins(lines).select("doc_id", "mark", F.lit(True).alias("repeated"))
    kept = kept.join(repeated, ["doc_id", "mark"], "left").filter(~(edge & F.coalesce("repeated", F.lit(False)))).join(sizes,
         "doc_id").filter(F.col("size") >= F.col("body") - SMALL)
    w = Window.partitionBy("doc_id").orderBy("n")
    heads = kept.withColumn("head", text.page_heading(F.col("text"), F.col("size"), F.col("bold"), F.col("body")))
    goes_on = F.col("head") & F.lag("head").over(w) & (F.lag("page").over(w) == F.col("page")) & (F.lag("size").over(w) == F.col("size")) & ~F.col("text").rlike(r"^\d+(\.\d+)*\.?\s")
    opened = heads.withColumn("opens", F.col("head") & ~F.coalesce(goes_on, F.lit(False)))
    placed = opened.withColumn("section", F.count_if("opens").over(w))
    titles = placed.filter("head").groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("n",
        "text"))).alias("t"), F.min("page").alias("page"))
    title = F.array_join(F.transform("t", lambda i: i["text"]), " ")
    number = F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\.?\s", 1)
    bare = F.regexp_replace("title", r"^\d+(?:\.\d+)*\.?\s+", "")
    order = Window.partitionBy("doc_id").orderBy("section")
    rows = titles.select("doc_id", "section", title.alias("title"), "page").withColumn("back", F.max(text.is_back_matter(bare)).over(order))
    kind = F.when(F.lower("title").startswith("abstract"), "front").when(F.col("back"), "back").otherwise("body")
    sections = rows.select("doc_id", F.col("section").alias("n"), "title", number.alias("number"),
        text.section_level(number).alias("level"), kind.alias("kind"), "page")
    body = placed.filter("not head").select("doc_id", "n", "section", F.col("text").alias("line"))
    return sections, joined(body, "section", mend)


# --- papers of two-column pages --------------------------------------------------------------------------------------

#: A page is of one column if this share of its long lines crosses the middle by the slack on both sides; where
#: the right column begins; how much larger than the body a title is; how small an abstract's print may be; characters of a long
#: line and of a heading at most; the stamp of a preprint server; names of what follows an abstract; what stands beside one.
WIDE_SHARE, SLACK, RIGHT, TITLE, ABSTRACT_SMALL, LONG_LINE, LONG_HEAD = 0.35, 0.05, 0.45, 1.4, 2.1, 25, 120
STAMP = r"^arXiv:\d{4}\.\d{4,5}(v\d+)?\s+\[[^\]]+\]\s+\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}$"
AFTER_ABSTRACT = r"^(keywords?|index terms|ocis codes?)\b"
NUMBER = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"


def in_columns(rows: DataFrame) -> DataFrame:
    """rows (doc_id, page, line, x0, x1, y0, width, text) with col and n, the place in the document's reading order. On a page of
    which WIDE_SHARE of the long lines cross the middle all are in column 0, else those that begin right of RIGHT in 1. Rows that
    lie by documents don't move."""
    mid, slack = F.col("width") / 2, F.col("width") * SLACK
    long_, wide = F.length("text") >= LONG_LINE, (F.col("x0") < mid - slack) & (F.col("x1") > mid + slack)
    whole = Window.partitionBy("doc_id", "page")
    pages = rows.withColumns({"long": F.count_if(long_).over(whole), "wide": F.count_if(long_ & wide).over(whole)})
    single = (F.col("long") > 0) & (F.col("wide") >= WIDE_SHARE * F.col("long"))
    placed = pages.withColumn("col", F.when(single, 0).otherwise((F.col("x0") >= F.col("width") * RIGHT).cast("int")))
    order = Window.partitionBy("doc_id").orderBy("page", "col", F.round("y0"), "x0", "line")
    return placed.withColumn("n", F.row_number().over(order).cast("long")).drop("long", "wide")


def heading_line(body: Column) -> Column:
    """Whether a line (text, size, bold, italic, ocr) of at most LONG_HEAD characters is a heading: read from a picture if it is
    numbered and short; set in italics if it has a number of two levels and the body's size; bold if it is larger, or of about
    the body's size and numbered or named like a section."""
    line, size = F.col("text"), F.col("size")
    number, name = F.regexp_extract("text", NUMBER, 1), F.regexp_extract("text", NUMBER, 2)
    capital, stop = name.rlike("^[A-Z]"), line.endswith(".")
    seen = (number != "") & capital & ~stop & (F.length("text") < 70)
    slanted = F.col("italic") & number.contains(".") & capital & ~stop & (F.length("text") < 80) & (F.abs(size - body) < 0.6)
    named = F.lower(F.when(number != "", name).otherwise(line)).rlike(rf"^({text.SECTION_NAMES})\s*:?$")
    level = (size >= body - 1.5) & (F.length("text") < 80) & ~stop & (((number != "") & capital) | named)
    bold = (size >= body + 0.9) | level
    return (F.length("text") <= LONG_HEAD) & F.when(F.col("ocr"), seen).when(F.col("bold"), bold).otherwise(slanted)


def laid_out_paper(rows: DataFrame, mend: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(titles, sections, texts) of pages' rows (doc_id, page, line, x0, x1, y0, y1, width, height, text, size, bold, italic, ocr,
    math), pages from 1.

    Repeated margins and preprint stamps go. The largest print of the first page is the title, if it is large enough. Before
    the first heading all is front: the lines under a heading "Abstract", up to the keywords, are the abstract. After it small
    print and mathematics go, a heading opens a section, and one close below another of its size goes on with it. A section
    named like back matter is back, and all after it, once there was a body; one that comes before the body is moved behind
    all. titles are (doc_id, title); sections (doc_id, n, title, number, level, kind, page), the abstract being n 0, front;
    texts (doc_id, n, paragraph, text): lines joined (broken words mended unless `mend` says no), a bullet opens a paragraph. Pages without text give nothing.
    All is found by windows within documents, so that rows that lie by documents don't move, and is stored once, as the
    lines of each title, heading and paragraph.
    """
    placed = in_columns(rows).withColumn("mark", margin_mark())
    edge = (F.col("y0") < MARGIN * F.col("height")) | (F.col("y1") > (1 - MARGIN) * F.col("height"))
    doc, printed = Window.partitionBy("doc_id"), ~F.col("ocr")
    often = F.count_if(edge).over(Window.partitionBy("doc_id", "mark"))
    kept = placed.withColumn("times", often).filter((F.col("times") < TIMES) & ~F.trim("text").rlike(STAMP))
    chars = F.sum(F.when(printed, F.length("text"))).over(Window.partitionBy("doc_id", "size"))
    most = F.max(F.when(printed, F.struct("chars", (-F.col("size")).alias("smaller"), "size"))).over(doc)
    top = F.max(F.when(printed & (F.col("page") == 1), F.col("size"))).over(doc)
    kept = kept.withColumn("chars", chars).withColumns({"body": F.coalesce(most["size"], F.lit(0.0)), "top": top})
    is_title = F.coalesce((F.col("page") == 1) & printed & (F.col("size") == F.col("top")) & (F.col("top") >= TITLE * F.col("body")), F.lit(False))
    kept = kept.withColumn("is_title", is_title)

    w = Window.partitionBy("doc_id").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number, name = F.regexp_extract("text", NUMBER, 1), F.regexp_extract("text", NUMBER, 2)
    lines = kept.withColumn("head", ~F.col("is_title") & heading_line(F.col("body")))
    says = F.col("head") & F.lower("text").rlike(r"^abstract\b")
    started = F.coalesce(F.bool_or(F.col("head") & ~F.lower("text").rlike(r"^abstract\b")).over(upto), F.lit(False))
    lines = lines.withColumn("started", started).withColumn("said", F.coalesce(F.bool_or(says & ~started).over(upto), F.lit(False)))
    closing = F.col("said") & ~F.col("head") & ~F.col("is_title") & F.lower("text").rlike(AFTER_ABSTRACT)
    lines = lines.withColumn("closed", F.coalesce(F.bool_or(closing & ~F.col("started")).over(upto), F.lit(False)))
    large = F.col("ocr") | (F.col("size") >= F.col("body") - ABSTRACT_SMALL)
    abstract = ~F.col("is_title") & ~F.col("started") & F.col("said") & ~F.col("closed") & printed & large
    print_ = F.col("head") | ((F.col("ocr") | (F.col("size") >= F.col("body") - SMALL)) & (F.col("math") < 0.6))
    lines = lines.withColumns({"abstract": abstract, "rest": F.coalesce(~F.col("is_title") & F.col("started") & print_, F.lit(False))})
    among = Window.partitionBy("doc_id", "rest").orderBy("n")
    last = lambda c: F.lag(c).over(among)
    gap = F.col("y0") - last("y1")
    close = (last("page") == F.col("page")) & (last("col") == F.col("col")) & (F.abs(F.col("size") - last("size")) < 0.2) & (gap >= 0) & (gap < 0.9 * F.col("size"))
    opens = F.col("head") & ~F.coalesce(last("head") & close & (number == ""), F.lit(False))
    lines = lines.withColumn("opens", opens).withColumn("section", F.count_if("opens").over(among.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lines = lines.withColumn("paragraph", F.count_if(F.col("text").startswith("•")).over(Window.partitionBy("doc_id", "rest", "section").orderBy("n")))

    part = F.when(F.col("is_title"), "title").when(F.col("abstract"), "abstract").when(F.col("rest") & F.col("head"), "head").when(F.col("rest") & ~F.col("head"), "text")
    line = F.when(F.col("part") == "text", F.regexp_replace("text", r"^[•\s]+", "")).when((F.col("part") == "abstract") & F.col("head"),
        F.regexp_replace("text", r"(?i)^abstract\s*[:.—-]?\s*", "")).otherwise(F.col("text"))
    lines = lines.withColumn("part", part).withColumn("line", line).filter("part in ('title', 'head') or part in ('abstract', 'text') and line <> ''")
    inner, said = F.col("part").isin("head", "text"), F.col("part") == "text"
    lines = lines.select("doc_id", "n", "page", "line", "part", F.when(inner, F.col("section")).otherwise(0).alias("section"), F.when(said, F.col("paragraph")).otherwise(0).alias("paragraph"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "line", "page"))).alias("x")
    parts = lines.groupBy("doc_id", "part", "section", "paragraph").agg(ordered)
    parts = parts.select("doc_id", "part", "section", "paragraph", F.col("x")[0]["page"].cast("long").alias("page"), F.transform("x", lambda i: i["line"]).alias("x")).withColumn("text", F.col("x")[0])

    head = F.col("part") == "head"
    parts = parts.withColumn("number", F.when(head, number)).withColumn("back", F.when(head, text.is_back_matter(F.when(number != "", name).otherwise(F.col("text"))))).drop("text")
    alike = Window.partitionBy("doc_id", "part")
    s = alike.orderBy("section")
    parts = parts.withColumn("had_body", F.coalesce(F.bool_or(~F.col("back")).over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    late = F.coalesce(F.bool_or(F.col("back") & F.col("had_body")).over(s.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(False))
    parts = parts.withColumn("kind", F.when(F.col("back") | late, "back").otherwise("body"))
    early = (F.col("kind") == "back") & ~F.col("had_body") & F.bool_or(F.col("kind") == "body").over(alike)
    parts = parts.withColumn("early", early).withColumn("new", F.row_number().over(alike.orderBy("early", "section")).cast("long"))
    new = F.max(F.when(head, F.col("new"))).over(Window.partitionBy("doc_id", "section"))
    parts = stored(parts.withColumn("new", F.when(inner, new).otherwise(0)).select("doc_id", "part", F.col("new").alias("n"), "paragraph", "page", "number", "kind", "x"))

    front = parts.filter("part = 'abstract'").select("doc_id", F.lit(0).cast("long").alias("n"), F.lit("Abstract").alias("title"), F.lit("").alias("number"), F.lit(1).alias("level"), F.lit("front").alias("kind"), F.lit(1).cast("long").alias("page"))
    named = parts.filter(head).select("doc_id", "n", F.array_join("x", " ").alias("title"), "number", text.section_level(F.col("number")).alias("level"), "kind", "page")
    titles = joined_parts(parts.filter("part = 'title'").select("doc_id", "x"), mend).select("doc_id", F.col("text").alias("title"))
    texts = joined_parts(parts.filter("part in ('abstract', 'text')").select("doc_id", "n", "paragraph", "x"), mend)
    return titles, front.unionByName(named), texts


# --- regions of figures, tables and equations ------------------------------------------------------------------------

#: Fixed values, in points: what a page leaves free above and below; how far a caption's band reaches beyond it on both sides;
#: slack where boxes meet; the least area of a graphic; the part of a table that must lie in the band; how far from the caption
#: a table's first rule is at most, and a rule from the next; lines of the body that an equation's rows may be away.
PAGE_EDGE, BESIDE, WIDE_CAPTION, TOUCH, LEAST_AREA, OF_TABLE, FIRST_RULE, NEXT_RULE, EQUATION_ROWS = 20, 25, 0.6, 2, 400, 0.6, 40, 260, 1.6
EQUATION_NUMBER = r"\(\s*(\d{1,3})\s*\)\s*$"
_BOX = ["x0", "x1", "y0", "y1"]


def _box(df: DataFrame, name: str, *more: str) -> DataFrame:
    """df (page, x0, x1, y0, y1, more) with page as it is and the rest behind a prefix."""
    return df.select("page", *[F.col(c).alias(f"{name}_{c}") for c in (*_BOX, *more)])


def _share(a: str, b: str, slack: float = 0) -> Column:
    return (F.col(f"{a}x0") - slack < F.col(f"{b}x1")) & (F.col(f"{b}x0") - slack < F.col(f"{a}x1"))


def figure_regions(captions: DataFrame, blocks: DataFrame, graphics: DataFrame, tables: DataFrame, width: float, height: float) -> DataFrame:
    """(page, n, way, of, x0, x1, y0, y1): the region that each caption (page, n, box, below: whether it stands above its figure)
    speaks of.

    Above and below the caption a band reaches to the next paragraph or caption of blocks (page, n, box, kind: para, caption,
    small or other) that shares its width, or to the page's edge. A ruled table (page, box) most of which lies in the band is
    the region; else it is the box around all graphics (page, box) in the band, if one of them is large enough, and around
    the small blocks in it beside them. The caption's own way is looked at first. Captions without either have no row. All
    joins are within a page, and aggregates give each band and box.
    """
    c = captions.select("page", F.col("n").alias("cap"), *_BOX, "below")
    stops = _box(blocks.filter(F.col("kind").isin("para", "caption")), "b", "n")
    near = c.join(stops, "page", "left").withColumn("meets", F.coalesce(_share("b_", "") & (F.col("b_n") != F.col("cap")), F.lit(False)))
    up, down = F.col("meets") & (F.col("b_y1") <= F.col("y0") + 1), F.col("meets") & (F.col("b_y0") >= F.col("y1") - 1)
    bounds = near.groupBy("page", "cap", *_BOX, "below").agg(F.max(F.when(up, F.col("b_y1"))).alias("top"), F.min(F.when(down, F.col("b_y0"))).alias("bottom"))
    top, bottom = F.greatest(F.lit(float(PAGE_EDGE)), "top"), F.least(F.lit(float(height - PAGE_EDGE)), "bottom")
    wide = F.col("x1") - F.col("x0") > WIDE_CAPTION * width
    bounds = bounds.select(
        "page", "cap", "below", F.col("y0").alias("c_y0"), F.col("y1").alias("c_y1"),
        F.when(wide, F.least("x0", F.lit(30.0))).otherwise(F.col("x0") - BESIDE).alias("x0"), F.when(wide, F.greatest("x1", F.lit(width - 30.0))).otherwise(F.col("x1") + BESIDE).alias("x1"),
        F.explode(F.array(F.struct(F.lit("up").alias("way"), top.alias("lo"), (F.col("y0") + TOUCH).alias("hi")), F.struct(F.lit("down").alias("way"), (F.col("y1") - TOUCH).alias("lo"), bottom.alias("hi")))).alias("w"),
    )
    bands = stored(bounds.select("page", "cap", "below", "c_y0", "c_y1", "x0", "x1", "w.*"))
    key = ["page", "cap", "way"]

    t = bands.join(_box(tables, "t"), "page").filter(_share("t_", ""))
    inside = F.least("hi", "t_y1") - F.greatest("lo", "t_y0")
    ruled = t.filter(inside > OF_TABLE * (F.col("t_y1") - F.col("t_y0")))
    ruled = ruled.groupBy(*key).agg(F.min(F.struct("t_y0", "t_x0", "t_x1", "t_y1")).alias("t"))
    ruled = ruled.select(*key, F.lit("table").alias("of"), *[F.col(f"t.t_{x}").alias(x) for x in _BOX])

    g, middle = bands.join(_box(graphics, "g"), "page").filter(_share("g_", "")), (F.col("g_y0") + F.col("g_y1")) / 2
    above = (F.col("g_y0") >= F.col("lo") - TOUCH) & (F.col("g_y0") < F.col("c_y0")) & (middle <= F.col("c_y1"))
    under = (F.col("g_y1") <= F.col("hi") + TOUCH) & (F.col("g_y1") > F.col("c_y1")) & (middle >= F.col("c_y0"))
    drawn = g.filter(F.when(F.col("way") == "up", above).otherwise(under))
    around = lambda p: [F.min(f"{p}_x0").alias("x0"), F.max(f"{p}_x1").alias("x1"), F.min(f"{p}_y0").alias("y0"), F.max(f"{p}_y1").alias("y1")]
    area = F.max((F.col("g_x1") - F.col("g_x0")) * (F.col("g_y1") - F.col("g_y0"))).alias("area")
    drawn = drawn.groupBy(*key, "lo", "hi").agg(area, *around("g")).filter(F.col("area") >= LEAST_AREA)
    labels = drawn.join(_box(blocks.filter(F.col("kind").isin("small", "other")), "l"), "page")
    labels = labels.filter(_share("l_", "", 10) & (F.col("l_y0") >= F.col("lo") - TOUCH) & (F.col("l_y1") <= F.col("hi") + TOUCH))
    both = drawn.select(*key, *_BOX).unionByName(labels.select(*key, *[F.col(f"l_{x}").alias(x) for x in _BOX]))
    both = both.groupBy(*key).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")).withColumn("of", F.lit("graphics"))

    found = ruled.unionByName(both).join(captions.select("page", F.col("n").alias("cap"), "below"), ["page", "cap"])
    own = (F.col("way") == "down") == F.col("below")
    best = F.row_number().over(Window.partitionBy("page", "cap").orderBy(F.desc(own), F.desc("of")))
    return found.withColumn("r", best).filter("r = 1").select("page", F.col("cap").alias("n"), "way", "of", *_BOX)


def rule_tables(captions: DataFrame, rules: DataFrame, height: float) -> DataFrame:
    """(page, n, rules, x0, x1, y0, y1): the table below each caption (page, n, box) that only horizontal rules (page, box) draw: the
    first rules below it, as long as each is near the next. At least two, the first near the caption."""
    under = captions.select("page", F.col("n").alias("cap"), *_BOX).join(_box(rules, "r"), "page")
    under = under.filter((F.col("r_y0") > F.col("y1") - TOUCH) & (F.col("r_y0") < F.col("y1") + 0.7 * height) & _share("r_", "", 30))
    w = Window.partitionBy("page", "cap").orderBy("r_y0", "r_x0", "r_x1")
    chain = F.count_if(F.coalesce(F.col("r_y0") - F.lag("r_y0").over(w) > NEXT_RULE, F.lit(False))).over(w)
    first = under.withColumn("chain", chain).filter("chain = 0").groupBy("page", F.col("cap").alias("n"), "y1").agg(
        F.count("*").alias("rules"), F.min("r_x0").alias("a"), F.max("r_x1").alias("b"), F.min("r_y0").alias("c"), F.max("r_y1").alias("d"))
    near = first.filter((F.col("rules") >= 2) & (F.col("c") - F.col("y1") <= FIRST_RULE))
    return near.select("page", "n", "rules", F.col("a").alias("x0"), F.col("b").alias("x1"), F.col("c").alias("y0"), F.col("d").alias("y1"))


def equation_regions(lines: DataFrame, width: float, body: float) -> DataFrame:
    """(page, n, number, x0, x1, y0, y1): one box for each numbered equation of lines (page, n, box, text, math: whether it is
    mathematics, prose): around the line with the number at its right end and the mathematics at its height, up to some lines
    above and below, that no prose stands beside. Lines that hold nothing but the number need such rows, left of it."""
    said = lines.withColumn("number", F.regexp_extract("text", EQUATION_NUMBER, 1))
    numbered = said.filter((F.col("number") != "") & (F.col("x1") >= 0.6 * width) & (F.length("text") <= 160))
    alone = F.trim(F.regexp_replace("text", EQUATION_NUMBER, "")) == ""
    numbered = numbered.select("page", "n", "number", *_BOX, alone.alias("alone"), (~alone & F.col("math")).alias("own"))
    prose = _box(lines.filter("prose"), "p")
    rows = _box(lines.filter(F.col("math") & (F.col("x1") - F.col("x0") <= 0.75 * width)), "e", "n")
    beside = F.least("e_y1", "p_y1") - F.greatest("e_y0", "p_y0") > 0.5 * F.least(F.col("e_y1") - F.col("e_y0"), F.col("p_y1") - F.col("p_y0"))
    rows = rows.join(prose, [rows["page"] == prose["page"], beside, _share("p_", "e_", 30)], "left_anti")
    reach = EQUATION_ROWS * body
    at_height = (F.col("e_y1") > F.col("y0") - reach) & (F.col("e_y0") < F.col("y1") + reach)
    left = ~F.col("alone") | (F.col("e_x1") <= F.col("x0") + TOUCH)
    parts = numbered.join(rows, "page", "left").withColumn("part", F.coalesce(at_height & left & (F.col("e_n") != F.col("n")), F.lit(False)))
    only = lambda c: F.when(F.col("part"), F.col(c))
    each = parts.groupBy("page", "n", "number", *_BOX, "own").agg(F.count_if("part").alias("parts"), F.min(only("e_x0")).alias("a"), F.max(only("e_x1")).alias("b"), F.min(only("e_y0")).alias("c"), F.max(only("e_y1")).alias("d"))
    found = each.filter(F.col("own") | (F.col("parts") > 0))
    return found.select("page", "n", "number", F.least("x0", "a").alias("x0"), F.greatest("x1", "b").alias("x1"), (F.least("y0", "c") - 0.3 * body).alias("y0"), (F.greatest("y1", "d") + 0.45 * body).alias("y1"))


# --- lines of glyphs -------------------------------------------------------------------------------------------------

#: Fixed values, of a glyph's size: the gap from which there is a space; how close glyphs of one row are in height and by how many
#: points in size; how small and how high raised digits are; what can be raised, and what it becomes.
GLYPH_GAP, ROW_HEIGHT, ROW_SIZE, RAISED_SIZE, RAISED_HEIGHT = 0.1, 0.35, 1.5, 0.8, 0.2
CAN_BE_RAISED, IS_RAISED = "0123456789+-−,()", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻˒⁽⁾"


def _higher(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The greatest x so far in each group, groups being sorted: complex numbers compare by their real parts first."""
    both = np.empty(len(x), complex)
    both.real, both.imag = group, x
    return np.maximum.accumulate(both).imag


def _begins(group: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones(min(len(group), 1), bool), group[1:] != group[:-1]))


def _lines_of_page(page: pa.Table) -> pa.Table:
    """The lines of one page's glyphs, by sorts alone: see `lines_of_glyphs`."""
    c = page["c"].combine_chunks().dictionary_encode()
    known = {chr(k): v for k, v in text.SYMBOL.items()}
    codes: dict[str, int] = {"": 0}
    shown = [known.get(x, "") if re.search("[\ue000-\uf8ff]", x) else x for x in c.dictionary.to_pylist()]
    code = np.array([codes.setdefault(x, len(codes)) for x in shown], np.int64)[c.indices.to_numpy()]
    glyphs = [page[k].to_numpy() for k in ("n", "x0", "x1", "y", "size")]

    n, x0, x1, y, size = glyphs
    order = np.lexsort((n, x0, y))
    code, n, x0, x1, y, size = (v[order] for v in (code, *glyphs))
    row = np.cumsum(np.concatenate(([True], y[1:] - y[:-1] >= ROW_HEIGHT * np.maximum(size[1:], size[:-1]))))

    order = np.lexsort((n, x0, row))
    order = order[code[order] != 0]
    code, row, x0, x1, y, size = (v[order] for v in (code, row, x0, x1, y, size))
    alike = row * len(codes) + code
    same = np.argsort(alike, kind="stable")
    alike, left, right = alike[same], x0[same], x1[same]
    again = np.zeros(len(same), bool)
    again[same[1:]] = (alike[1:] == alike[:-1]) & (_higher(alike, right)[:-1] - left[1:] > 0.5 * (right[1:] - left[1:]))
    code, row, x0, x1, y, size = (v[~again] for v in (code, row, x0, x1, y, size))

    new = _begins(row)
    first, line = np.flatnonzero(new), np.cumsum(new) - 1
    by_size = np.lexsort((size, row))
    group = np.flatnonzero(_begins(row[by_size]) | _begins(size[by_size]))
    count, low = np.diff(np.append(group, len(row))), np.maximum.reduceat(y[by_size], group) if len(group) else y
    of, sizes = row[by_size][group], size[by_size][group]
    best = np.lexsort((sizes, count, of))
    best = best[np.append(of[1:] != of[:-1], np.ones(min(len(of), 1), bool))]
    main, base = sizes[best][line], low[best][line]

    words = list(codes)
    can_be = np.array([x in CAN_BE_RAISED for x in words])
    raised = can_be[code] & (size < RAISED_SIZE * main) & (y < base - RAISED_HEIGHT * main)
    drawn = code != codes.get(" ", -1)
    blank = np.zeros(len(row), bool)
    blank[1:] = ~new[1:] & ~raised[1:] & drawn[1:] & drawn[:-1] & (x0[1:] - _higher(row, x1)[:-1] > GLYPH_GAP * size[1:])
    spelt = words + [" " + x for x in words] + [x.translate(str.maketrans(CAN_BE_RAISED, IS_RAISED)) for x in words]
    pieces = np.array(spelt, object)[code + len(words) * (blank + 2 * raised)].tolist()
    ends = np.append(first[1:], len(row)) if len(first) else first
    texts = ["".join(pieces[i:j]).strip(" ") for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
    farthest = np.maximum.reduceat(x1, first) if len(first) else x1
    columns = [row[first], x0[first], farthest, sizes[best], pa.array(texts, pa.string())]
    return pa.Table.from_arrays([page["page"].slice(0, len(first)), *[pa.array(v) for v in columns]], ["page", "row", "x0", "x1", "size", "text"])


def lines_of_glyphs(glyphs: DataFrame) -> DataFrame:
    """(page, row, x0, x1, size, text): the lines that a page's glyphs (page, n, x0, x1, y, size, c; y grows downward) spell from
    left to right.

    A row begins where a glyph lies lower than the one before it in height by ROW_HEIGHT of the larger size; raised glyphs are
    close enough to theirs. A glyph printed again over the same one, by more than half of its width, counts once, in whatever
    order they come. There is a space where the gap to all that stands before is over GLYPH_GAP of the size, unless one is drawn. A line's size is
    that of most of its glyphs, of equals the larger; small digits and signs above its middle are raised, and without space
    before them. Private letters of the Symbol font become what they show, other private ones go. Glyphs without character, place
    or size have no part. Pages are grouped, so that glyphs move once at most; a task holds the glyphs of one page, some 60 bytes
    each, as vectors, and takes a few sorts for them, however long the lines are.
    """
    numbers = ["x0", "x1", "y", "size"]
    whole = glyphs.select("page", F.col("n").cast("long").alias("n"), *[F.col(k).cast("double").alias(k) for k in numbers], "c")
    whole = whole.filter(" and ".join(f"{k} is not null" for k in ("n", *numbers, "c")))
    kind = glyphs.schema["page"].dataType.simpleString()
    return whole.groupBy("page").applyInArrow(_lines_of_page, f"page {kind}, row long, x0 double, x1 double, size double, text string")
