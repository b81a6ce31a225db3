"""Columns, papers, regions and glyphs on small made pages."""

from scholia.operators import layout

ROW = "doc_id long, page long, line long, x0 double, x1 double, y0 double, y1 double, width double, height double, text string, size double, bold boolean, italic boolean, ocr boolean, math double"


def row(doc, page, line, x0, y0, text, size=10.0, bold=False, italic=False, ocr=False, math=0.0, x1=None):
    return doc, page, line, float(x0), float(x1 or x0 + 240), float(y0), y0 + size, 600.0, 800.0, text, size, bold, italic, ocr, math


LONG = "words enough for a line that is long "


def test_two_columns_and_one(spark):
    rows = [row(1, 1, i, 50 if i % 2 else 320, 100 + 20 * i, f"{LONG}{i}") for i in range(6)]
    rows += [row(1, 2, i, 50, 100 + 20 * i, f"{LONG}{i}", x1=550) for i in range(3)] + [row(1, 2, 9, 280, 90, "Centred")]
    got = layout.in_columns(spark.createDataFrame(rows, ROW)).collect()
    assert [r.line for r in sorted(got, key=lambda r: r.n)] == [1, 3, 5, 0, 2, 4, 9, 0, 1, 2]
    assert {r.col for r in got if r.page == 2} == {0}


def test_paper(spark):
    rows = [
        row(1, 1, 0, 50, 70, "A Title", 18.0, True), row(1, 1, 1, 50, 90, "of Two Lines", 18.0, True), row(1, 1, 2, 50, 120, "A. Author and B. Author"),
        row(1, 1, 3, 50, 140, "Abstract", 12.0, True), row(1, 1, 4, 50, 160, f"{LONG}first", 8.0), row(1, 1, 5, 50, 180, f"{LONG}second", 8.0),
        row(1, 1, 6, 50, 200, "Keywords: a, b", 8.0), row(1, 1, 7, 50, 220, "more of them", 8.0), row(1, 1, 8, 50, 240, "References and links", 12.0, True),
        row(1, 1, 9, 50, 260, "[1] An entry"), row(1, 1, 10, 50, 280, "1. A Heading That", 12.0, True), row(1, 1, 11, 50, 293, "Goes On", 12.0, True),
        row(1, 1, 12, 50, 310, f"{LONG}body-"), row(1, 1, 13, 50, 330, "work on"), row(1, 1, 14, 50, 350, "x = y + z", math=0.9), row(1, 1, 15, 50, 370, "a small note", 7.0),
        row(1, 1, 16, 50, 390, "1.1 In Italics", italic=True), row(1, 1, 17, 50, 410, "• one"), row(1, 1, 18, 50, 430, "• two"), row(1, 1, 19, 320, 100, "2.2 Small and Bold", 9.5, True),
        row(1, 1, 20, 320, 120, "right column"), row(1, 2, 21, 50, 100, "3 Seen by a Machine", 0.0, ocr=True), row(1, 2, 22, 50, 120, "of a picture", 0.0, ocr=True),
        row(1, 2, 23, 50, 140, "Acknowledgment", 12.0, True), row(1, 2, 24, 50, 160, "thanks"), row(1, 2, 25, 50, 180, "4 After All", 12.0, True), row(1, 2, 26, 50, 200, "is back too"),
        row(1, 1, 27, 5, 300, "arXiv:1901.00001v2 [cs.CL] 3 Feb 2019", 20.0),
    ] + [row(1, p, 99, 50, 20, f"Journal {p}") for p in (1, 2, 3)]
    titles, sections, texts = layout.laid_out_paper(spark.createDataFrame(rows, ROW))
    assert [tuple(r) for r in titles.collect()] == [(1, "A Title of Two Lines")]
    got = [(r.n, r.title, r.number, r.level, r.kind, r.page) for r in sorted(sections.collect(), key=lambda r: r.n)]
    assert got == [
        (0, "Abstract", "", 1, "front", 1), (1, "1. A Heading That Goes On", "1", 1, "body", 1), (2, "1.1 In Italics", "1.1", 2, "body", 1),
        (3, "2.2 Small and Bold", "2.2", 2, "body", 1), (4, "3 Seen by a Machine", "3", 1, "body", 2), (5, "Acknowledgment", "", 1, "back", 2),
        (6, "4 After All", "4", 1, "back", 2), (7, "References and links", "", 1, "back", 1),
    ]
    said = {(r.n, r.paragraph): r.text for r in texts.collect()}
    assert said == {(0, 0): f"{LONG}first {LONG}second".replace("  ", " "), (1, 0): f"{LONG}bodywork on", (2, 1): "one", (2, 2): "two", (3, 0): "right column", (4, 0): "of a picture",
        (5, 0): "thanks", (6, 0): "is back too", (7, 0): "[1] An entry"}
    none = layout.laid_out_paper(spark.createDataFrame([], ROW))
    assert [df.collect() for df in none] == [[], [], []]


BOX = "page long, n long, x0 double, x1 double, y0 double, y1 double"


def test_figure_regions(spark):
    captions = spark.createDataFrame([(1, 1, 100.0, 300.0, 400.0, 410.0, False), (1, 2, 100.0, 300.0, 700.0, 710.0, True), (2, 1, 50.0, 550.0, 100.0, 110.0, True), (3, 1, 50.0, 90.0, 50.0, 60.0, False)], BOX + ", below boolean")
    blocks = spark.createDataFrame(
        [(1, 1, 100.0, 300.0, 400.0, 410.0, "caption"), (1, 2, 100.0, 300.0, 700.0, 710.0, "caption"), (1, 3, 90.0, 310.0, 100.0, 200.0, "para"), (1, 4, 305.0, 318.0, 250.0, 260.0, "small"), (1, 5, 340.0, 350.0, 250.0, 260.0, "small")], BOX + ", kind string",
    )
    graphics = spark.createDataFrame([(1, 1, 110.0, 200.0, 210.0, 300.0), (1, 2, 190.0, 300.0, 280.0, 390.0), (1, 3, 110.0, 200.0, 120.0, 190.0), (1, 4, 120.0, 125.0, 600.0, 602.0), (3, 1, 50.0, 60.0, 20.0, 30.0)], BOX)
    tables = spark.createDataFrame([(2, 1, 40.0, 560.0, 130.0, 300.0)], BOX)
    got = {(r.page, r.n): tuple(r)[2:] for r in layout.figure_regions(captions, blocks, graphics, tables, 600.0, 800.0).collect()}
    assert got == {(1, 1): ("up", "graphics", 110.0, 318.0, 210.0, 390.0), (2, 1): ("down", "table", 40.0, 560.0, 130.0, 300.0)}


def test_rule_tables_and_equations(spark):
    captions = spark.createDataFrame([(1, 1, 50.0, 300.0, 100.0, 110.0), (2, 1, 50.0, 300.0, 100.0, 110.0)], BOX)
    rules = spark.createDataFrame([(1, 1, 50.0, 300.0, 130.0, 131.0), (1, 2, 55.0, 310.0, 200.0, 201.0), (1, 3, 50.0, 300.0, 470.0, 471.0), (2, 1, 50.0, 300.0, 180.0, 181.0), (2, 2, 50.0, 300.0, 190.0, 191.0)], BOX)
    assert [tuple(r) for r in layout.rule_tables(captions, rules, 800.0).collect()] == [(1, 1, 2, 50.0, 310.0, 130.0, 201.0)]
    lines = [(1, 1, 480.0, 500.0, 200.0, 210.0, "(3)", False, False), (1, 2, 100.0, 300.0, 198.0, 206.0, "a = b", True, False), (1, 3, 120.0, 280.0, 215.0, 223.0, "∑ c", True, False),
        (1, 4, 100.0, 300.0, 400.0, 410.0, "x = y", True, False), (1, 5, 310.0, 390.0, 400.0, 410.0, "some words beside an equation here", False, True), (1, 6, 380.0, 400.0, 401.0, 409.0, "(4)", False, False)]
    got = layout.equation_regions(spark.createDataFrame(lines, BOX + ", text string, math boolean, prose boolean"), 600.0, 10.0).collect()
    assert [tuple(r) for r in got] == [(1, 1, "3", 100.0, 500.0, 195.0, 227.5)]


def test_glyphs(spark):
    glyph = lambda n, c, x0, y=100.0, size=10.0, width=4.8: (1, n, float(x0), x0 + width, y, size, c)
    rows = [glyph(0, "T", 5), glyph(1, "T", 5.5), glyph(2, "o", 10), glyph(3, "o", 15), glyph(4, "l", 21.5), glyph(5, "2", 26.5, 97.0, 6.0, 2), glyph(6, "x", 40), glyph(7, "", 45), glyph(8, "", 50)]
    rows += [glyph(9, "n", 5, 112.0), glyph(10, " ", 10, 112.0), glyph(11, "e", 15, 112.0), (1, 12, 5.0, 9.0, 112.0, 10.0, None)]
    df = spark.createDataFrame(rows, "page long, n long, x0 double, x1 double, y double, size double, c string")
    assert sorted(r.text for r in layout.lines_of_glyphs(df).collect()) == ["Too l² xμ", "n e"]
    assert layout.lines_of_glyphs(df.limit(0)).collect() == []
