import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scholia.functions import align, register, srs, text, times
from scholia.operators import folders, layout, logs, outline, papers, quality, reading, study, terms
from scholia.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())],
        ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k,
        v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("said", "want"), [
    ("The stroke is 7 μm at 300 K.", "The stroke is 7 micrometers at 300 kelvin."), ("Fluence 5 J/cm² and 20 °C.",
         "Fluence 5 joules per square centimeter and 20 degrees Celsius."),
    ("The error was 0.15 rad² at λ/14.", "The error was 0.15 radians squared at lambda over 14."), ("In the 1990s a 3 s run.",
         "In the 1990s a 3 seconds run."),
    ("Peak of ±5 V.", "Peak of plus or minus 5 volts."), ("Section 2 N-type.", "Section 2 N-type."),
    ("Stroke of 7μm, 10 MHz, 3 × 10⁴ m, 5 cm⁻²", "Stroke of 7 micrometers, 10 megahertz, 3 times 10 to the 4 m, 5 centimeters to the minus 2"),
    ("A load of 3 N at 2 × 10⁻³ m/s, 90° and 5 kHz-wide", "A load of 3 newtons at 2 times 10 to the minus 3 m per second, 90 degrees and 5 kHz-wide"),
    ("x² + (a)³ + T⁴, 4 h", "x squared + (a) cubed + T to the 4, 4 hours"), ("Δ of 5 mN", "delta of 5 millinewtons"),
])
def test_pronounce(spark, said, want):
    assert one(spark, text.pronounce(F.col("t")), t=said) == want


@pytest.mark.parametrize(("said", "keys"), [
    ("as shown in Fig. 3(a) and Figs. 4 and 5.", ["figure:3", "figure:4", "figure:5"]), ("Figure A-1 shows it.", ["figure:A-1"]),
    ("see Table 2 and Eq. (3).", ["table:2", "equation:3"]), ("the figure shows", []),
    ("Figs. 3-5 and 7, 8", ["figure:3", "figure:5", "figure:7", "figure:8"]), ("Fig. 3, and 4", ["figure:3"]),
        ("Eqs. (1)–(3a) & (4) hold for 5.", ["equation:1", "equation:3", "equation:4"]),
    ("Fig. 3. Then 4 and Fig. 3", ["figure:3"]), ("FIGURE 2 | B1 Tables A1, 2", ["figure:2", "table:A-1", "table:2"]),
])
def test_figure_keys(spark, said, keys):
    assert one(spark, text.figure_keys(F.col("t")), t=said) == keys


@pytest.mark.parametrize(("label", "key"), [("Fig. 3", "figure:3"), ("FIGURE 2 |", "figure:2"), ("Table 1", "table:1"),
    ("Eq. (3)", "equation:3"), ("Fig. A-1", "figure:A-1"), ("fig. A1", "figure:A-1"), ("Eq. (unnumbered)", None), ("", None)])
def test_label_key(spark, label, key):
    assert one(spark, text.label_key(F.col("t")), t=label) == key


@pytest.mark.parametrize(("typed", "grade"), [("actuators", "exact"), ("Actuator", "form"), ("actuater", "near"), ("mirror",
     "wrong"), ("", "wrong"), ("stopped", "wrong")])
def test_cloze(spark, typed, grade):
    assert one(spark, text.cloze_grade(F.col("t"), F.lit("actuators"), F.lit("actuator")), t=typed) == grade


@pytest.mark.parametrize(("seconds", "words"), [(60, "1 min"), (330, "6 min"), (600, "10 min"), (3 * 86400, "3 days"),
    (90 * 86400, "3 months"), (730 * 86400, "2 years")])
def test_human(spark, seconds, words):
    assert one(spark, text.human(F.col("t")), t=seconds) == words


def test_lookup(spark):
    words = spark.createDataFrame([(w,) for w in ["mirror", "satellite", "measure", "run", "deform", "actuate", "flown", "study"]], "lower string")
    asked = ["Mirror,", "flown", "satellite's", "satellites", "measured", "running", "studies", "deformable", "actuators",
         "tip-mirror", "wavefront", "12"]
    got = {r.word: (r.headword, r.match) for r in terms.ranked_lookup(spark.createDataFrame([(w,) for w in asked], "word string"), words).collect()}
    assert got["Mirror,"] == ("mirror", "exact")
    assert got["flown"] == ("flown", "exact")
    assert got["satellite's"] == ("satellite", "exact")
    assert {w: got[w] for w in ("satellites", "measured", "running", "studies")} == {w: (h, "base") for w,
        h in {"satellites": "satellite", "measured": "measure", "running": "run", "studies": "study"}.items()}
    assert {w: got[w] for w in ("deformable", "actuators")} == {"deformable": ("deform", "near"), "actuators": ("actuate", "near")}
    assert got["tip-mirror"] == ("mirror", "part")
    assert "wavefront" not in got
    assert "12" not in got


def test_sentences():
    said = "It is presented in Fig. 2. The material properties are listed in Table 1. In vector form, Eq. (1) can be rewritten. Modes are shown in Figs. 5(a) and 5(b)."
    assert [s.split()[-1] for s in align.split_sentences(said)] == ["2.", "1.", "rewritten.", "5(b)."]
    assert align.split_sentences("It was cooled to 300 K. The end came at 5 nm. We stop.") == ["It was cooled to 300 K.",
         "The end came at 5 nm.", "We stop."]
    assert align.split_sentences("It was better. [4] An idea follows. [6, 11] Another, by J. Doe et al. Then (b) and (c).") == ["It was better. [4]",
         "An idea follows. [6, 11]", "Another, by J. Doe et al. Then (b) and (c)."]
    assert align.split_sentences('He said "Stop." Then it ended ( ). X.') == ['He said "Stop."', "Then it ended ( ). X."]
    assert align.split_sentences(None) == []


def test_sentence_grade():
    assert [align.word_grade(t, "mirrors") for t in ("Mirrors", "mirror", "xx", "")] == ["ok", "near", "ng", "ng"]
    assert align.word_grade("stopped", "stop") == "near"
    assert align.sentence_grade("The mirrors are deformed by the actuator",
        "the mirror ar deformed an actuator quickly") == (["ok", "near", "near", "ok", "ng", "ng", "ok"], ["an", "quickly"],
        4 / 7)
    assert align.sentence_grade("a bc dd e", "a bc e more") == (["ok", "ok", "ng", "ok"], ["more"], 0.75)
    assert align.sentence_grade("", "x") == ([], ["x"], 0.0)


def test_expansions(spark):
    said = "They are micro-electro-mechanical systems ( MEMSs ). We use a deformable mirror (DM). With no such words (AO); the adaptive (AO) one. " + "far " * 100 + "of the Optical Path Difference (OPD)"
    found = one(spark, text.expansions(F.col("t"), ["the", "of"]), t=said)
    assert [(r.acronym, r.expansion) for r in found] == [("MEMS", "micro-electro-mechanical systems"), ("DM",
        "deformable mirror"), ("OPD", "Optical Path Difference")]
    assert one(spark, text.expansions(F.col("t"), []), t="") == []


def slow_replay(answers):
    """The fold in plain Python, from (seconds, rating) in order."""
    w, phase, step, s, d, last, due = srs.W, 0, 0, 0.0, 0.0, 0, 0
    clamp = lambda x: min(max(x, 1.0), 10.0)
    d0 = lambda r: w[4] - 2.718281828459045 ** (w[5] * (r - 1)) + 1
    for t, r in answers:
        if phase == 0:
            s2, d2 = max(w[r - 1], 0.001), clamp(d0(r))
        else:
            days = max(0, t - last) // 86400
            recall = (1 + srs.FACTOR * days / s) ** srs.DECAY
            d2 = clamp(w[7] * d0(4) + (1 - w[7]) * (d + (10 - d) * -w[6] * (r - 3) / 9))
            if days < 1:
                g = 2.718281828459045 ** (w[17] * (r - 3 + w[18])) * s ** -w[19]
                s2 = s * (max(g, 1) if r >= 2 else g)
            elif r == 1:
                s2 = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * 2.718281828459045 ** ((1 - recall) * w[14]),
                    s / 2.718281828459045 ** (w[17] * w[18]))
            else:
                s2 = s * (1 + 2.718281828459045 ** w[8] * (11 - d) * s ** -w[9] * (2.718281828459045 ** ((1 - recall) * w[10]) - 1) * {2: w[15],
                     4: w[16]}.get(r, 1))
            s2 = max(s2, 0.001)
        s, d, interval = s2, d2, min(max(round(s2), 1), 36500) * 86400
        steps = [600] if phase == 3 else [60, 600]
        if phase == 2:
            phase, step, wait = (3, 0, 600) if r == 1 else (2, 0, interval)
        elif r == 1:
            phase, step, wait = phase or 1, 0, steps[0]
        elif r == 4 or step >= len(steps) or (r == 3 and step + 1 >= len(steps)):
            phase, step, wait = 2, 0, interval
        elif r == 2:
            phase, wait = phase or 1, 900 if len(steps) == 1 else 330 if step == 0 else steps[step]
        else:
            phase, step, wait = phase or 1, step + 1, steps[step + 1]
        last, due = t, t + wait
    return phase, step, round(s, 5), round(d, 5), due


def test_replay_random(spark):
    rnd, rows, want = random.Random(11), [], {}
    for word in range(120):
        t, answers = 1_700_000_000, []
        for k in range(rnd.randint(1, 14)):
            t += rnd.choice([30, 700, 40_000, 90_000, 400_000, 4_000_000])
            answers.append((t, rnd.randint(1, 4)))
            rows.append((word * 100 + k, word, answers[-1][1], dt.datetime.fromtimestamp(t, dt.UTC)))
        want[word] = slow_replay(answers)
    rows += rows[:20]  # repeats change nothing, nor does the order
    rnd.shuffle(rows)
    got = srs.replay(spark.createDataFrame(rows, "uid long, headword long, rating int, reviewed_at timestamp")).collect()
    for r in got:
        phase, step, s, d, due = want[r.headword]
        assert (r.phase, r.step, r.due) == (phase, step, due)
        assert r.stability == pytest.approx(s, abs=2e-5)
        assert r.difficulty == pytest.approx(d, abs=2e-5)
    assert len(got) == 120


def test_merge_is_idempotent(spark):
    schema = "uid long, headword string, rating int, reviewed_at timestamp"
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    old = spark.createDataFrame([(1, "a", 3, at)], schema)
    new = spark.createDataFrame([(1, "a", 3, at), (2, "a", 1, at), (2, "a", 1, at), (3, "zz", 1, at)], schema)
    known = spark.createDataFrame([("a",)], "headword string")
    first = logs.merge_new(old, new, known)
    assert [r.uid for r in first.collect()] == [2]
    assert logs.merge_new(old.union(first.select(old.columns)), new, known).count() == 0


def test_last_write_keeps_existing_on_ties(spark):
    rows = spark.createDataFrame([("k", 5, 1, "old", 0), ("k", 5, 2, "tie", 0), ("k", 4, 0, "late", 1), ("z", 1, 3, "gone", 1)],
         "uid string, updated_at int, event_id int, note string, deleted int")
    assert {r.uid: r.note for r in logs.last_write(rows, "uid").collect()} == {"k": "old", "z": "gone"}
    assert [r.uid for r in logs.live(rows, "uid").collect()] == ["k"]


def test_outline(spark):
    s = spark.createDataFrame([(1, i, level) for i, level in enumerate([1, 1, 2, 1, 1])], "doc_id int, n int, level int")
    levels = lambda df: [r.level for r in df.orderBy("n").collect()]
    once = outline.indent(s, 1, 3, 1)
    assert levels(once) == [1, 1, 2, 2, 1]
    assert levels(outline.indent(once, 1, 1, 1)) == [1, 2, 3, 3, 1]
    assert levels(outline.indent(s, 1, 0, 1)) == [1, 1, 2, 1, 1]
    assert levels(outline.indent(s, 1, 0, -1)) == [1, 1, 2, 1, 1]
    assert [r.until for r in outline.subtree_end(s).orderBy("n").collect()] == [1, 3, 3, 4, None]


def test_folders(spark):
    row = spark.createDataFrame([(["a", "b"], {"p": "a", "q": "b"})], "f array<string>, m map<string,string>")
    f, m = F.col("f"), F.col("m")
    assert row.select(*folders.rename(f, m, "a", "x")).first()[:] == (["x", "b"], {"p": "x", "q": "b"})
    assert row.select(*folders.delete(f, m, "a")).first()[:] == (["b"], {"q": "b"})
    assert row.select(folders.move(f, "b", -1), folders.move(f, "b", 1), folders.add(f, "c")).first()[:] == (["b", "a"], ["a", "b"], ["a", "b", "c"])


def issues_of(spark, sections, sentences, cited=()):
    sec = spark.createDataFrame(sections, "doc_id long, n long, kind string, title string, number string")
    sent = spark.createDataFrame(sentences, "doc_id long, section long, k long, text string")
    figures = spark.createDataFrame([(1, "figure:1", "figure"), (2, None, "image")], "doc_id long, key string, kind string")
    texts = sec.select("doc_id", (F.col("n") * 1000).alias("id"), F.col("title").alias("text")).union(sent.select("doc_id",
        F.col("section") * 1000 + F.col("k"), "text"))
    doubles = quality.doubled(texts).withColumn("section", F.floor(F.col("id") / 1000)).withColumn("heading", F.col("id") % 1000 == 0)
    gaps = outline.numbering_gaps(sec.filter("kind = 'body' and number is not null").select("doc_id", "n", "number"))
    return quality.inspect(sec, sent, figures, gaps, doubles, spark.createDataFrame(list(cited), "doc_id long, key string"))


def test_quality(spark):
    bad = [(1, 1, "front", "Abstract", None), (1, 2, "body", "1 Start", "1"), (1, 3, "body", "3 Actua ator", "3"), (1, 4, "front",
         "Abstract again", None)]
    said = [(1, 1, 1, "Opt. Soc. Proc. Phys. stand here."), (1, 2, 1, "An actuator has a private sign \uf06d and ð here."), (1, 3,
         1, "x" * 30 + " glued words stand here.")]
    said += [(1, 2, k, "w " * 230) for k in range(2, 5)] + [(1, 2, k, "Short.") for k in range(5, 10)] + [(1, 2, k,
         f"A plain sentence, number {k}.") for k in range(10, 125)]
    good = [(2, 1, "front", "Abstract", None), (2, 2, "body", "1 Start", "1"), (2, 3, "body", "2 End", "2")]
    fine = [(2, 1, 1, "It sums the work up."), (2, 2, 1, "A plain sentence that is fine."), (2, 3, 1, "Another one of that kind.")]
    found = issues_of(spark, bad + good, said + fine, [(1, "figure:2")])
    got = {(r.doc_id, r.level, r.code) for r in found.collect()}
    major, minor = ("abstract_order", "numbering", "few_sections", "doubled_heading", "pua", "abstract_refs"), ("long_section",
         "garbled", "long_sentences", "short_sentences", "glued", "missing_figures")
    assert got == {(1, "major", c) for c in major} | {(1, "minor", c) for c in minor} | {(2, "minor", "unlabeled_images")}
    assert sorted(tuple(r) for r in quality.summary(found).collect()) == [(1, 6, 6, True), (2, 0, 1, False)]
    assert quality.top_issues(found).filter("doc_id = 1").count() == 8
    assert {r.code for r in issues_of(spark, good, []).filter("doc_id = 2").collect()} == {"no_abstract", "unlabeled_images"}
    assert issues_of(spark, [], []).filter("doc_id = 1").count() == 0


def test_quiz(spark):
    kind = "doc_id int, question int, chapter string, q string, choices array<string>, answer int, explain string, evidence array<string>"
    quiz = spark.createDataFrame([(1, 1, "A", "Why?", ["a", "b", "c", "d"], 0, "x", ["Seen."]), (1, 2, "B", " ", ["a", "b", "c"],
         4, None, None), (1, 3, "A", "What?", ["a", "b", "c", "d"], 1, "x", ["Not there."])], kind)
    titles, texts = spark.createDataFrame([(1, "A")], "doc_id int, title string"), spark.createDataFrame([(1, "Seen.")], "doc_id int, text string")
    got = {tuple(r)[1:] for r in quality.quiz_issues(quiz, titles, texts).collect()}
    assert got == {(2, "error", "question"), (2, "error", "choices"), (2, "error", "answer"), (2, "error", "chapter"), (2,
         "warning", "explain"), (2, "warning", "evidence"), (3, "warning", "evidence_unknown")}


def test_speech_risks(spark):
    said = spark.createDataFrame([(1, 1, "The M4 in (equation) has rad² for ADS and AO in the 1990s.")], "doc_id int, n int, spoken string")
    assert {(r.risk, r.example) for r in quality.speech_risks(said, ["AO"]).collect()} == {("mixed", "M4"), ("equation",
         "(equation)"), ("symbol", "²"), ("acronym", "M4"), ("acronym", "ADS")}


@pytest.mark.parametrize(("raw", "want"), [("seen (Smith et al., 2020; Lee 2019a) [3, 4] .", "seen."),
    ("the Observatory⁴˒⁵, of 0.15 rad²", "the Observatory, of 0.15 rad²"), ("tests⁴ and (not a cite)", "tests and (not a cite)"),
     ("open ( in 2020 [3–5] [a] (x (2020) y)", "open ( in 2020 [a] (x y)"), ("", ""), ("a [ 3 ] b", "a [ 3 ] b")])
def test_speech(spark, raw, want):
    assert one(spark, text.speech(F.col("t")), t=raw) == want


def test_text_functions(spark):
    assert one(spark, text.clean(F.col("t")), t="5 \uf06dm \u0711\u0712x") == "5 μm x"
    assert one(spark, align.nfkc_udf("t"), t="ﬁeld ｘ m²") == "field x m²"
    assert [one(spark, text.title(F.lit(None), F.col("t")), t=x) for x in ("\n A  title \nmore", "Ends here.\nx", "",
         "a b c d e f g h i j k l m")] == ["A  title", "Ends here.", "Untitled", "a b c d e f g h"]
    assert one(spark, text.title(F.lit(None), F.col("t")), t="## A heading ##\nmore") == "A heading"
    assert [one(spark, text.section_level(F.col("t")), t=x) for x in ("", "2", "2.1", "2.1.3.4")] == [1, 1, 2, 3]
    assert [one(spark, text.is_back_matter(F.col("t")), t=x) for x in ("References", "Acknowledgments", "Referencess",
        "Results")] == [True, True, False, False]
    assert [one(spark, text.page_heading(F.col("t"), F.lit(size), F.lit(bold), F.lit(10.0)), t=x) for x, size, bold in (("Big",
         11.0, True), ("Big", 11.0, False), ("2. Results", 9.0, True), ("plain words", 9.5, True))] == [True, False, True, False]
    assert [one(spark, text.slug(F.col("t")), t=x) for x in ("2.1 A/B test!", "日本", "x" * 70)] == ["2_1_A_B_test", "section", "x" * 60]
    assert [one(spark, text.heading_speech(F.col("n"), F.col("t")), n=n, t=t) for n, t in (("2.1", "BIG THINGS"), ("",
        "Small"))] == ["Section 2.1. Big Things.", "Small."]
    assert one(spark, text.scrub(F.col("t")), t="at /home/ann/x and /Users/bo/y") == "at /home/~/x and /Users/~/y"
    assert [one(spark, text.clock(F.col("t")), t=x) for x in (5, 65, 3600, 3725)] == ["0:05", "1:05", "1:00:00", "1:02:05"]
    assert one(spark, text.apply_rules(F.col("t"), [("DM", "mirror", True), ("DMs", "mirrors", False), ("x", "$1", True)]),
        t="The DM and dms, a DM-x, dm, x.") == "The mirror and mirrors, a DM-x, dm, $1."


def test_cloze_parts(spark):
    rows = spark.createDataFrame([("The actuators move.", "actuator", None), ("It was deformed.", "deform", "was"),
        ("A c++ (x) here", "c++", None), ("Studies go on.", "study", None), ("None", "zz", None),
        ("a" * 5 + " w" * 60 + " mirror", "mirror", None)], "s string, h string, q string")
    got = [r.p for r in rows.select(text.cloze_parts(F.col("s"), F.col("h"), F.col("q")).alias("p")).collect()]
    assert [p and p.answer for p in got] == ["actuators", "was", "c++", "Studies", None, "mirror"]
    assert got[0][:] == ("The ", "actuators", " move.")
    assert one(spark, text.example_at(F.from_json("t", "array<struct<s:string,translated:string>>"), F.lit(3))["s"],
        t='[{"s":"a"},{"s":"b","translated":"x"},{"s":"c","translated":"y"}]') == "c"
    assert one(spark, text.raised(F.col("t")), t="-1,2") == "⁻¹˒²"
    long = rows.filter("h = 'mirror'").select(text.cloze_context(text.cloze_parts(F.col("s"), F.col("h"), F.col("q"))).alias("c")).first().c
    assert long.before.startswith("… w w")
    assert len(long.before) <= 92


def test_papers(spark):
    page = spark.createDataFrame([(1, 1, "# Top", 1), (1, 2, "A print-through is a de-", None), (1, 3,
         "formable thing; the print-", None), (1, 4, "through of G-", None), (1, 5, "release.", None), (1, 6, "", None), (1, 7,
         "Next.", None), (1, 8, "", None), (1, 9, "the print-", None), (1, 10, "through-", None), (1, 11, "control", None)],
         "doc_id int, n int, line string, level int")
    assert [r.text for r in papers.pasted_paragraphs(page).orderBy("section",
        "paragraph").collect()] == ["A print-through is a deformable thing; the print-through of G-release.", "Next.",
         "the print-throughcontrol"]
    sections = spark.createDataFrame([(1, i, f"H{i}") for i in range(1, 4)], "doc_id int, n int, title string")
    sentences = spark.createDataFrame([(1, i, 1, f"s{i}") for i in range(1, 4)], "doc_id int, section int, k int, text string")
    rows, left = papers.merge_section(sentences, sections, F.col("n").isin(1, 2))
    assert [(r.section, r.k, r.text) for r in rows.orderBy("section", "k").collect()] == [(1, 1, "s1"), (1, 2, "H2"), (1, 3, "s2"), (2, 1, "s3")]
    assert [(r.n, r.title) for r in left.orderBy("n").collect()] == [(1, "H1"), (2, "H3")]
    placed = papers.ranked(spark.range(1000).withColumn("x", F.col("id") % 7), F.desc("x"), F.col("id")).collect()
    assert {r.id: r.place for r in placed} == {i: p for p, i in enumerate(sorted(range(1000), key=lambda i: (-(i % 7), i)), 1)}
    lookups = spark.createDataFrame([("u", 1, "s1"), ("w", 1, None), ("x", 2, "s1")], "uid string, doc_id int, sentence string")
    twice = sentences.union(sentences).withColumn("spoken", F.col("text"))
    found = papers.with_examples(lookups, twice, spark.createDataFrame([(1, 1, 1, "t")],
         "doc_id int, section int, k int, translated string")).collect()
    assert sorted((r.uid, r.audio_ref, r.translated) for r in found) == [("u", "1/1_1", "t"), ("w", None, None), ("x", None, None)]


def test_files(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("run, runs\tto move\nno tab\nÉtat\tstate\n")
    words = files.read_dictionary(spark, str(tmp_path / "d.tsv"))
    assert sorted(r.word for r in words.collect()) == ["run", "runs", "État"]
    files.write_dictionary_shards(words, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).filter("initial = 'r'").count() == 2
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text('{"kind":"progress","version":1,"reviews":[{"uid":"u","headword":"a","rating":3,"reviewed_at":"2026-01-01"}]}')
    (tmp_path / "p/b.json").write_text('{"kind":"progress","version":1,"reviews":[{"uid":"u","headword":"a","rating":9,"reviewed_at":"2026-01-01"}]}')
    good, bad = files.read_progress(spark, str(tmp_path / "p"))
    assert (good.count(), [r.reason for r in bad.collect()]) == (1, ["reviews"])
    (tmp_path / "large").mkdir()
    (tmp_path / "large/a.json").write_text('{"kind":"progress","version":1,"device":"' + "x" * files.MOST_PROGRESS + '"}')
    (tmp_path / "large/b.json").write_text('{"kind":"progress","version":1}')
    good, bad = files.read_progress(spark, str(tmp_path / "large"))
    assert (good.count(), [(r.file[-6:], r.reason) for r in bad.collect()]) == (1, [("a.json", "size")])
    files.write_bundle({"words": words}, str(tmp_path / "bundle"))
    assert files.read_bundle(spark, str(tmp_path / "bundle"))["words"].count() == 3
    texts = spark.createDataFrame([("t", " body "), ("t", "body"), (None, "  "), (None, None)], "title string, text string")
    found = files.import_texts(texts, spark.createDataFrame([], "id string"))
    assert found.count() == 1
    assert files.import_texts(texts, found).count() == 0
    d = spark.createDataFrame([("D:20240203040506",), ("D:2024",), ("x",)], "d string").select(files.pdf_date(F.col("d"))).collect()
    assert [r[0] for r in d] == [dt.datetime(2024, 2, 3, 4, 5, 6), dt.datetime(2024, 1, 1), None]
    marks = spark.createDataFrame([("p", 2, "B", "second", None, ""), ("p", 1, "A", "first", "erst", "why")],
         "paper_id string, place int, section string, sentence string, translated string, note string")
    assert files.marks_markdown(marks).first().markdown == "## A\n\n> first\n>\n> erst\n\nwhy\n\n## B\n\n> second"
    assert [r.lower for r in files.read_shard(spark, str(tmp_path / "shards"), ["RUN", "zz"]).collect()] == ["run"]
    files.write_bundle({"words": words.limit(1)}, str(tmp_path / "bundle"))
    assert files.read_bundle(spark, str(tmp_path / "bundle"))["words"].count() == 1
    for name in ("a.pdf", ".b.pdf", "x/c.PDF", ".h/d.pdf", "x/e.txt"):
        (tmp_path / ".w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / ".w" / name).write_text("x")
    assert sorted(r.path[-5:] for r in files.find_pdfs(spark, str(tmp_path / ".w")).collect()) == ["a.pdf"[-5:], "c.PDF"[-5:]]
    page = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# Top", "", "2.1 Setup", "Some longer text follows here.", "",
         "Results", ""])], "doc_id int, n int, line string")
    assert [r.level for r in files.headings(page).orderBy("n").collect()] == [1, None, 2, None, None, 1, None]


def test_edits_within_random():
    rnd = random.Random(3)
    for _ in range(4000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 11))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diagonal, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        most = 2 if len(a) >= 8 else 1
        assert align.edits_within(a, b, most) == (row[-1] <= most)


AT = dt.datetime(2026, 9, 24, 1, 0, tzinfo=dt.UTC)
T0 = int(AT.timestamp())
REVIEW = "uid string, headword string, rating int, reviewed_at timestamp, device string"


def card(spark, words, answers, now, quota=20):
    w = spark.createDataFrame([(h, AT + dt.timedelta(seconds=i)) for i, h in enumerate(words)], "headword string, first_seen timestamp")
    r = spark.createDataFrame([(str(i), h, rating, AT + dt.timedelta(seconds=s), "mac") for i, (h, rating, s) in enumerate(answers)], REVIEW)
    return study.next_card(w, r, now, quota).first(), r


def test_review_queue(spark):
    first, _ = card(spark, ["alpha", "beta"], [], T0 + 60)
    assert first[:] == ("alpha", "New", 0, 60, 330, 600, 8 * 86400)
    answers = [("alpha", 3, 0)]
    assert card(spark, ["alpha", "beta"], answers, T0 + 60)[0].headword == "beta"
    again, reviews = card(spark, ["alpha", "beta"], answers, T0 + 660)
    assert (again.headword, again.phase, again.reviews) == ("alpha", "Learning", 1)
    assert card(spark, ["alpha", "beta"], answers, T0 + 60, quota=1)[0] is None
    left, state = study.undo(reviews, "mac")
    assert left.count() == 0
    assert state.count() == 0
    two = spark.createDataFrame([("1", "a", 3, AT, "mac"), ("2", "a", 1, AT + dt.timedelta(days=2), "mac"), ("3", "a", 4,
        AT + dt.timedelta(days=3), "phone")], REVIEW)
    left, state = study.undo(two, "mac")
    assert sorted(r.uid for r in left.collect()) == ["1", "3"]
    assert state.first().n == 2


def test_merge_progress(spark):
    known = spark.createDataFrame([("alpha",)], "headword string")
    look, rev = "uid string, headword string, looked_at timestamp, sentence string", REVIEW
    state = "uid string, paper string, sentence string, note string, updated_at timestamp, deleted int, event_id long"
    none = lambda schema: spark.createDataFrame([], schema)
    old = {"lookups": none(look), "reviews": spark.createDataFrame([("R0", "alpha", 3, AT, "mac")], rev),
        "positions": none(state), "marks": spark.createDataFrame([("m", "p", "s", "old", AT, 0, 1)], state)}
    later = AT + dt.timedelta(minutes=10)
    new = {
        "lookups": spark.createDataFrame([("L1", "delta", AT, "A delta."), (None, "x", AT, None)], look),
        "reviews": spark.createDataFrame([("R1", "alpha", 3, later, "phone"), ("R2", "delta", 4, later, "phone"), ("R3", "gone",
            3, later, "phone"), (None, "alpha", 1, later, "phone")], rev),
        "positions": spark.createDataFrame([("x", "p", "s", None, AT, 0, 1), ("y", "p", "", None, later, 0, 2), ("z", None, "s",
             None, later, 0, 3)], state),
        "marks": spark.createDataFrame([("m", "p", "s", None, later, 7, 2), ("n", "p", "s", None, AT, None, 3)], state),
    }
    added = study.merge_progress(known, old, new)
    assert study.merge_counts(added).first().asDict() == {"lookups": 1, "reviews": 2, "positions": 1, "marks": 2}
    marks = {r.uid: r for r in logs.merged(old["marks"], added["marks"], "uid").collect()}
    assert (marks["m"].deleted, marks["m"].note, marks["n"].deleted) == (1, "", 0)
    all_ = {"lookups": added["lookups"], "reviews": old["reviews"].union(added["reviews"].select(old["reviews"].columns)),
         "positions": added["positions"], "marks": logs.merged(old["marks"], added["marks"], "uid")}
    assert set(study.merge_counts(study.merge_progress(known, all_, new)).first()) == {0}


def test_times(spark):
    stamps = ["2026-09-24T02:30:00Z", "2026-09-24T12:00:00+09:00", "2026-09-24T12:00:00", "x", None]
    rows = spark.createDataFrame([(s,) for s in stamps], "t string")
    got = [r[0] for r in rows.select(times.seconds(times.instant(F.col("t"), "Asia/Tokyo"))).collect()]
    assert got == [T0 + 5400, T0 + 7200, T0 + 7200, None, None]
    for zone, midnight, local in (("UTC", T0 - 3600, "2026-09-24T01:00:00"), ("Asia/Tokyo", T0 - 10 * 3600,
        "2026-09-24T10:00:00"), ("America/New_York", T0 - 21 * 3600, "2026-09-23T21:00:00")):
        assert rows.limit(1).select(times.local_midnight(F.lit(T0), zone), times.local_stamp(F.lit(T0), zone)).first()[:] == (midnight, local)


def test_marks_and_saves(spark):
    saves = spark.createDataFrame([("p", x) for x in (0, 3, 4, 7, 8, 20)] + [("q", 5)], "paper string, at long")
    assert {r.paper: r.kept for r in logs.throttled(saves, "paper", 4).collect()} == {"p": [0, 4, 8, 20], "q": [5]}
    marks = spark.createDataFrame([("m", "p", "s", AT, 0), ("n", "p", "t", AT, 1)],
         "uid string, paper string, sentence string, updated_at timestamp, deleted int")
    later = AT + dt.timedelta(hours=1)
    taps = spark.createDataFrame([("a", "p", "s", later), ("b", "p", "t", later)], "uid string, paper string, sentence string, at timestamp")
    got = {r.uid: r.deleted for r in logs.toggle_marks(marks, taps).collect()}
    assert got == {"m": 1, "n": 1, "b": 0}
    sections = spark.createDataFrame([("p", 1, "One"), ("p", 2, "Two")], "doc_id string, n int, title string")
    sentences = spark.createDataFrame([("p", 1, 1, "b"), ("p", 2, 1, "a"), ("p", 2, 2, "b")], "doc_id string, section int, k int, text string")
    made = spark.createDataFrame([("1", "p", "a", "x", "n", 1), ("2", "p", "b", "x", "n", 2), ("3", "p", "gone", "kept", "n", 0)],
         "uid string, paper_id string, sentence string, section string, note string, created_at int")
    found = reading.marks_in_order(made, sections, sentences, spark.createDataFrame([("p", 1, 1, "B")],
         "doc_id string, section int, k int, translated string")).orderBy("place").collect()
    assert [(r.uid, r.section, r.new_header, r.translated) for r in found] == [("2", "One", True, "B"), ("1", "Two", True, None),
         ("3", "kept", True, None)]


def test_loading(spark):
    papers_ = [
        (1, '{"title":"T","sections":[{"title":"1.2 Start","kind":"body","sentences":["It is '
             '[3].",{"t":"Two."},{"t":"Three.","s":"3"}]},{"title":"REFERENCES","kind":"back","level":2,"sentences":[]}]}'),
        (2, '{"title":'), (3, "[]"), (4, '{"sections":{}}'), (5, '{"sections":[{"title":" '
             '","kind":"x"},{"title":"A","kind":"x"},{"title":"B","kind":"body","sentences":[{"s":"no"}, 5]}]}'), (6, None),
    ]
    sections, sentences, errors = reading.loaded(spark.createDataFrame(papers_, "doc_id int, json string"))
    assert [tuple(r)[1:] for r in sections.orderBy("n").collect()] == [(1, "1.2 Start", "1.2", 2, "body", 1,
        "Section 1.2. Start."), (2, "REFERENCES", "", 2, "back", 1, "References.")]
    assert [(r.k, r.text, r.spoken) for r in sentences.orderBy("k").collect()] == [(1, "It is [3].", "It is."), (2, "Two.",
        "Two."), (3, "Three.", "3")]
    got = {(r.doc_id, r["at"], r.code) for r in errors.collect()}
    assert {x for x in got if x[0] == 5} == {(5, "0", "title"), (5, "1", "kind"), (5, "1", "sentences"), (5, "2.0", "t")}
    assert {(i, c) for i, _, c in got if i != 5} == {(2, "json"), (3, "sections"), (4, "sections"), (6, "json")}
    metas = spark.createDataFrame([(1, "{}", "v1"), (2, '{"manual":1}', "v1"), (3, None, "v2"), (4, "{}", "v2")],
         "doc_id int, json string, extractor_version string")
    assert sorted(r.doc_id for r in reading.needs_rebuild(metas, "v2").collect()) == [1, 3]


def test_sorts(spark):
    day = dt.date
    rows = [("a", day(2026, 1, 1), day(2020, 1, 1), None, "Beta", 3), ("b", day(2026, 1, 3), day(2021, 1, 1), day(2022, 1, 1),
         "alpha", 1), ("c", day(2026, 1, 2), None, day(2023, 1, 1), "Gamma", 9)]
    got = papers.sorted_every_way(spark.createDataFrame(rows,
         "doc_id string, imported date, created date, downloaded date, title string, pages int")).collect()
    order = lambda key, newest: "".join(r.doc_id for r in sorted((r for r in got if r.sort == key and r.newest == newest),
        key=lambda r: r.place))
    assert (order("imported", True), order("created", True), order("created", False), order("downloaded", True), order("title",
         False), order("pages", True)) == ("bca", "bac", "abc", "cba", "bac", "cab")


def test_glossary_behind_dictionary(spark):
    asked = spark.createDataFrame([(1, "actuators"), (2, "actuators"), (2, "mirror"), (2, "tip"), (2, "nothing")], "doc_id int, word string")
    found = spark.createDataFrame([("actuators", "actuate", "near"), ("mirror", "mirror", "exact")], "word string, headword string, match string")
    index = spark.createDataFrame([("actuator", 1, "actuator", 3), ("actuator", 3, "Actuators", 9), ("mirror", 2, "mirrors", 9),
        ("tip", 1, "tip", 1)], "key string, doc_id int, term string, n int")
    got = {(r.doc_id, r.word): tuple(r)[2:] for r in terms.with_glossary(asked, found, index).collect()}
    assert got == {(1, "actuators"): ("actuator", "term", "actuate"), (2, "actuators"): ("Actuators", "term", "actuate"), (2,
         "mirror"): ("mirror", "exact", None), (2, "tip"): ("tip", "term", None)}
    t = spark.createDataFrame([("XAO", " xao "), ("mirror", "Spiegel")], "term string, translated string")
    assert {r.term: r.translated for r in terms.translated_terms(spark.createDataFrame([("XAO",), ("mirror",), ("z",)],
         "term string"), t).collect()} == {"XAO": "", "mirror": "Spiegel", "z": ""}


def test_paper_of_pages(spark):
    rows, n = [], 0
    for page in (1, 2, 3):
        said = {1: [("Abstract", 10.0, True), ("We sum up.", 10.0, False), ("1 Long", 12.0, True), ("title", 12.0, True),
            ("Text that is bro-", 10.0, False)], 2: [("ken over pages.", 10.0, False), ("1.1 Part", 12.0, True), ("tiny", 6.0,
             False), ("More of it.", 10.0, False)], 3: [("References", 10.0, True), ("[1] X.", 10.0, False)]}[page]
        for i, (t, size, bold) in enumerate([(f"Journal {page}", 10.0, False), *said]):
            n += 1
            rows.append((1, n, page, size, bold, 0.03 + 0.1 * i, t))
    lines = spark.createDataFrame(rows, "doc_id int, n int, page int, size double, bold boolean, y double, text string")
    sections, texts = layout.paper(lines)
    assert [tuple(r)[1:] for r in sections.orderBy("n").collect()] == [(1, "Abstract", "", 1, "front", 1), (2, "1 Long title",
        "1", 1, "body", 1), (3, "1.1 Part", "1.1", 2, "body", 2), (4, "References", "", 1, "back", 3)]
    assert [r.text for r in texts.orderBy("section").collect()] == ["We sum up.", "Text that is broken over pages.", "More of it.", "[1] X."]
    pieces = spark.createDataFrame([(1, 1, 0.0, 4.0, 0.1, "The"), (1, 2, 5.0, 8.0, 0.1, "mir"), (1, 3, 8.1, 12.0, 0.101, "ror"),
        (1, 4, 8.2, 12.0, 0.102, "ror"), (1, 5, 0.0, 4.0, 0.2, "Next")],
         "page int, n int, x0 double, x1 double, y double, text string")
    assert [r.text for r in layout.rows_of_fragments(pieces, 0.01, 0.5).orderBy("row").collect()] == ["The mirror", "Next"]


def test_advice_and_blanks(spark):
    history = spark.createDataFrame([("a", 2, 0.95, i, i) for i in range(12)] + [("a", 3, 0.3, i, i) for i in range(12)] + [("b",
         2, 1.0, i, i) for i in range(5)] + [("c", 5, 1.0, i, i) for i in range(12)],
         "who string, level int, score double, at int, uid int")
    assert {(r.who, r.level): r.advice for r in study.level_advice(history, "who").collect()} == {("a", 2): "up", ("a",
        3): "down", ("b", 2): "none", ("c", 5): "none"}
    said = "The DM moves seven small mirrors and ten large actuators quickly".split()
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate(said)] + [(2, 0, "The"), (2, 1, "of")], "s int, pos int, word string")
    size = lambda level: [study.blanks(words, ["s"], level).filter(f"s = {s}").count() for s in (1, 2)]
    assert [size(level) for level in range(1, 6)] == [[1, 1], [2, 1], [3, 2], [8, 2], [11, 2]]
    picked = {study.blanks(words, ["s"], 1, seed).filter("s = 1").first().word for seed in range(40)}
    assert len(picked) >= 5
    assert not picked & {"The", "DM", "and"}


def test_register_and_rules(spark):
    assert set(register.register(spark)) == set(register.UDFS)
    assert spark.sql("select scholia_sentences('One is. Two are.') as x").first().x == ["One is.", "Two are."]
    rules = spark.createDataFrame([(1, " DM ", "D M", None), (2, "ALPAO", "al pao", False), (3, "", "x", None), (4, "DM", "again",
         None), (5, "y" * 61, "x", None)], "rule_id int, find string, put string, whole_case boolean")
    kept = papers.kept_rules(rules)
    assert sorted((r.rule_id, r.find, r.whole_case) for r in kept.collect()) == [(1, "DM", True), (2, "ALPAO", False)]
    said = spark.createDataFrame([("The DM and DMs, not ADMIN; Alpao at 5 V.",)], "text string")
    assert register.spoken(said, kept).first().spoken == "The D M and DMs, not ADMIN; al pao at 5 volts."
    assert one(spark, text.highlighted(F.col("t"), F.lit("mirror")),
        t="Mirrors and a mirror, no amirror.") == "<mark>Mirrors</mark> and a <mark>mirror</mark>, no amirror."
    assert [one(spark, text.valid_id(F.col("t")), t=x) for x in ("0123abcd", "0123ABCD", "0123abc", "0123abcde")] == [True, False, False, False]
