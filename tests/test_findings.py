"""Queries on odd tables against their SQL, and what a finding asked for of the operators."""

import duckdb
from pyspark.sql import functions as F
from test_catalog import TABLES, plain

from scholia.functions import text
from scholia.plans import files, more, pages, papers, reading  # noqa: F401  register their queries
from scholia.operators import layout, quality, segments, terms
from scholia.plans.catalog import ORACLES, QUERIES
from scholia.sources import adapters
from scholia.sources import files as sources


def folder(spark, path, documents):
    """A folder with documents (doc_id, text), and the other tables of the smallest size."""
    for name in TABLES:
        if name != "documents":
            (path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    rows = [(i, t, "en", "web", len(t)) for i, t in documents]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def same(spark, d, name):
    """The rows of a query, which are those of its SQL."""
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    want, got = c.sql(ORACLES[name]).df(), QUERIES[name](spark, d).toPandas()
    columns = sorted(want.columns)
    assert plain(got, columns).equals(plain(want, columns))
    return got


def test_texts_that_share_an_id_are_all_imported(spark, tmp_path):
    d = folder(spark, tmp_path, [(1, "text 33021"), (3, "text 72425"), (5, "text 72425"), (6, "text 72425")])
    assert sorted(same(spark, d, "text_import")["id"])[-2:] == ["f1e11f86"] * 2


def test_papers_that_share_an_id_stay_apart(spark, tmp_path):
    d = folder(spark, tmp_path, [(3, "text 859"), (51, "text 4460"), (5, "other"), (6, "more")])
    assert list(same(spark, d, "library_papers")["paper_id"]).count("b30a892c") == 2
    assert sorted(same(spark, d, "bundle_manifests")["papers"]) == [1, 2]
    assert len(same(spark, d, "bundle_archives")) == 4


def test_a_heading_cut_at_a_hyphen_is_joined_as_it_is(spark, tmp_path):
    d = folder(spark, tmp_path, [(1, "a text under the terms of the CC old BY-NC 4")])
    assert any("- and more of it" in t for t in same(spark, d, "page_texts")["text"])
    same(spark, d, "laid_out_texts")


def test_only_ascii_capitals_open_pasted_sections(spark, tmp_path):
    d = folder(spark, tmp_path, [(1, "first\\n12 Été\\n13 Ete\\nfour\\nfive\\n\\nÜber uns\\nand so on".replace("\\n", "\n"))])
    same(spark, d, "pasted_outline")
    same(spark, d, "pasted_paragraphs")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_glyphs_that_lie_by_pages_do_not_move(spark):
    glyphs = spark.range(20).selectExpr("id % 2 as page", "id as n", "id * 5D as x0", "id * 5D + 4 as x1", "1D as y", "10D as size", "'c' as c")
    assert shuffles(layout.lines_of_glyphs(glyphs.repartition(3, "page"))) <= 1


def test_laid_out_pages_read_their_lines_once(spark, sf):
    for rows in (adapters.page_rows(spark, sf), adapters.page_lines(spark, sf)):
        assert rows._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 2  # of texts, and of their hashes


def test_words_that_lie_by_documents_do_not_move(spark):
    tokens = spark.createDataFrame([(1, i, w) for i, w in enumerate("lasers laser lasers glasses glass runs runs".split())], "doc_id long, pos int, token string")
    found = terms.glossary_words(tokens.repartition(3, "doc_id"), spark.createDataFrame([("run",)], "lower string"))
    assert sorted((r.word, r.n) for r in found.collect()) == [("laser", 3)]
    assert shuffles(terms.glossary_words(tokens.repartition(3, "doc_id"), spark.createDataFrame([("run",)], "lower string").coalesce(1))) <= 2


def test_many_learners_share_a_file(spark, tmp_path):
    answers = spark.range(300).selectExpr("id as learner", "string(id) as uid", "'w' as headword", "3 as rating", "'2024-01-01' as reviewed_at", "'here' as device")
    sources.write_progress("here", {"lookups": answers.selectExpr("learner", "uid", "headword", "'m' as meaning", "reviewed_at as looked_at"), "reviews": answers},
        "learner", "2024-02-01", str(tmp_path / "p"), packed=True)
    assert len(list((tmp_path / "p").glob("*.parquet"))) < 30
    good, bad = sources.checked_progress(spark.read.parquet(str(tmp_path / "p")))
    assert (good.count(), bad.count()) == (300, 0)
    assert good.filter("file = '/learner=7/_file=0'").count() == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plurals_fold_without_sorting_words(spark):
    counts = spark.createDataFrame([(1, "lasers", 2), (1, "laser", 1), (1, "glasses", 4), (1, "glasse", 8), (1, "bodies", 3), (1, "body", 1), (2, "lasers", 5), (2, "s", 1)], "doc_id long, word string, n long")
    found = terms._with_singulars(counts)
    assert sorted((r.doc_id, r.word, r.n, r.one) for r in found.collect()) == [(1, "bodies", 3, "body"), (1, "body", 1, "body"), (1, "glasse", 8, "glasse"),
        (1, "glasses", 4, "glasse"), (1, "laser", 1, "laser"), (1, "lasers", 2, "laser"), (2, "lasers", 5, "lasers"), (2, "s", 1, "s")]
    assert "Window" not in plan(found) and "SortAggregate" not in plan(found)


def test_words_are_learned_from_counts(spark):
    texts = spark.createDataFrame([(1, "We saw approx. five (cf. Table) and approx. six.")], "doc_id long, text string")
    counts = segments.word_counts(segments.word_rows(texts, ["doc_id"]))
    assert {(r.word, r.after): r.n for r in counts.collect()}["approx.", "five"] == 1
    assert {r.type: (r.n, r.n_stop) for r in segments.type_counts(counts).collect()}["approx"] == (2, 2)
    assert sorted((r.type, r.after) for r in segments.followed(counts).collect()) == [("approx", "five"), ("approx", "six"), ("cf", "table")]
    assert [r.word for r in segments.word_rows(texts, ["doc_id"], stops=True).orderBy("k").collect()] == ["approx.", "cf.", "approx."]


def test_grades_are_compiled(spark):
    df = spark.createDataFrame([("Makes", "making"), ("xlaser", "laser"), ("qqqq", "laser"), ("", "laser"), ("bodies", "body")], "typed string, answer string")
    found = df.select(text.cloze_grade(F.col("typed"), F.col("answer"), F.col("answer")).alias("g"))
    assert [r.g for r in found.collect()] == ["form", "near", "wrong", "wrong", "form"]
    assert "lambda" not in plan(found)


def test_risks_are_found_whole(spark):
    said = spark.createDataFrame([(1, 1, "90s ABs xABC Àb2 a_B2 M4 4a AO DMs A1 (equation)")], "doc_id long, n long, spoken string")
    found = quality.speech_risks(said, ["AO"])
    assert sorted((r.risk, r.example) for r in found.collect()) == [("acronym", "A1"), ("acronym", "ABs"), ("acronym", "DMs"), ("acronym", "M4"), ("equation", "(equation)"),
        ("mixed", "4a"), ("mixed", "A1"), ("mixed", "M4"), ("symbol", "_")]
    assert plan(found).count("lambda") < 20


def test_figures_are_read_where_they_are_named(spark, sf):
    said = "XFig. 1, see Figs. 2, A3 and B-4(c) to 5. 6 of Eq. (7)–(8b) and9 or 10, TABLE 1a. 2 éFig 3Tab.4 Table A"
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(text.figure_keys(F.col("t"))).first()[0] == ["figure:2", "figure:A-3", "figure:B-4", "figure:5", "equation:7", "equation:8", "equation:9", "table:1", "figure:3", "table:4"]
    assert plan(QUERIES["references_resolved"](spark, sf)).count("documents.parquet") == 0  # keys are made once and stored


def test_split_words_are_found_in_their_text(spark):
    split = quality.doubled(spark.createDataFrame([(1, 1, "Actua ator of the Actuator, an No one"), (1, 2, "noone")], "doc_id long, id long, text string"))
    assert sorted((r.x, r.y) for r in split.collect()) == [("actua", "ator")]
    assert plan(split).count("regexp_extract_all") == 0  # texts are read before, once for words and once for pairs


def test_glyphs_are_spelt_by_pages(spark, tmp_path):
    glyphs = spark.createDataFrame([(1, i, i * 5.0, i * 5.0 + 4.8, 1.0, 10.0, c) for i, c in enumerate("laser")] + [(None, 1, 0.0, 1.0, 1.0, 10.0, "fi"), (2, 1, 0.0, 1.0, 1.0, 10.0, "")],
        "page long, n long, x0 double, x1 double, y double, size double, c string")
    found = layout.lines_of_glyphs(glyphs)
    assert sorted((r.page or 0, r.row, r.x0, r.x1, r.size, r.text) for r in found.collect()) == [(0, 1, 0.0, 1.0, 10.0, "fi"), (1, 1, 0.0, 24.8, 10.0, "laser")]
    assert "Window" not in plan(found)
    d = folder(spark, tmp_path, [(1, "a\n\nbb  laser  \nünï 𝒳 co\n x \n\nend " * 9), (2, "one"), (3, "\n\n x"), (7, "word " * 4000)])
    same(spark, d, "glyph_lines")  # empty lines have no glyphs, and so no rows


def test_only_phrases_seen_three_times_are_stored(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(terms, "stored", lambda df, put=terms.stored: kept.append(put(df)) or kept[-1])
    d = folder(spark, tmp_path, [(1, "one DE two DES laser de laser des laser des smart work shop art work " * 4), (2, "mm laser laser khz bodies body ladies glasses glass BODYs body bodies " * 3), (3, "a text of its own"), (4, "\n 1 2")])
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet{'/*.parquet' if name == 'documents' else ''}')")
    want, got = c.sql(ORACLES["glossary_phrases"]).df(), QUERIES["glossary_phrases"](spark, d).toPandas()
    assert len(got) and plain(got, ["doc_id", "n", "phrase"]).equals(plain(want, ["doc_id", "n", "phrase"]))
    assert [(df.columns, df.filter("n < 3").count()) for df in kept] == [(["doc_id", "phrase", "n", "size", "words"], 0)]


def test_laid_out_rows_that_lie_by_documents_do_not_move(spark, sf, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(layout, "stored", lambda df, put=layout.stored: kept.append(shuffles(df)) or put(df))
    rows = adapters.page_rows(spark, sf).localCheckpoint()
    titles, sections, texts = layout.laid_out_paper(rows.repartition(3, "doc_id"), mend=False)
    assert kept == [1]  # the one above
    assert shuffles(titles) + shuffles(sections) + shuffles(texts) == 0
    d = folder(spark, tmp_path, [(2, "\n".join(f"line {i} of a text that is long enough to count" for i in range(60))), (4, "• one\n\n12 Été\n" * 9), (5, "References\nAbstract\n" * 8), (6, "x")])
    for name in ("laid_out_texts", "laid_out_sections", "columns_in_order"):
        same(spark, d, name)
