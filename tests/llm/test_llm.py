"""Every operator against a plain version, and on awkward tables."""

import base64
import collections
import hashlib
import math
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholia.llm import chroma, components, html, langid, mixing, packing, pii, queries, search, simhash, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "fp", "leaf", "bin", "place", "part", "payload", "copies", "toxic", "v", "u", "root", "digest", "first", "n"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with the operators' own."""
    rows = [
        (1, "same words here again and again", "en", "src1", 5), (1, "same words here again and again", "en", "src1", 5), (2,
             "same words here again and again", "en", None, None),
        (3, None, "en", "src2", None), (4, "", None, "src2", 0), (None, "text without an id", "en", "src3", 1), (5, "a" * 200_000,
             None, "src3", 1), (6, "word " * 60_000, "de", "src4", 1), (100, "x", None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(-1) for c in CLASH})


@pytest.fixture(scope="module")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


def put(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_awkward_tables(spark, odd, none, sf, tmp_path):
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, None), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "u", ""), (3, "a\r\nb",
         "<p" * 5000), (4, "u", "x" * 300), (5, "u", "x" * 300), (5, "u", "x" * 300)],
        "page_id long, url string, html string").withColumns({c: F.lit(-1) for c in CLASH})
    vectors = spark.createDataFrame([(0, [0.1] * 64, 1), (100, None, 1), (None, [0.1] * 64, 1), (5, [0.1] * 64, None), (6, [], 1),
         (7, [None, float("nan")] * 32, 1), (5, [0.1] * 64, 1)],
        "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(-1) for c in CLASH})
    target = spark.createDataFrame([(1, "same words here"), (None, None)], "item_id long, text string").withColumns({c: F.lit(-1) for c in CLASH})
    full = put(spark, tmp_path / "full", documents=odd, labels=labels, pages=pages, embeddings=vectors, benchmark=target)
    empty = put(spark, tmp_path / "empty", documents=none, labels=labels.limit(0), pages=pages.limit(0), embeddings=vectors.limit(0), benchmark=target.limit(0))
    size = {"op2_html": 8, "op9_warc": 8, "op5_chroma": 7, "op12_variants": 0, "op13_urls": 8}
    for name, query in queries.QUERIES.items():
        assert query(spark, empty).count() == 0, name
        got = query(spark, full).collect()
        if name in ("op4_packing", "op6_search"):
            assert got, name
        else:
            assert len(got) == size.get(name, 9), name
    import corpus_pipeline

    assert corpus_pipeline.run(spark, empty).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, odd, full).columns) == set(corpus_pipeline.COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd, full).collect()} == {1, 3, None, 5, 6, 100}
    corpus_pipeline.run(spark, full).collect()


def test_defined_results(spark, odd, sf, tmp_path):
    """What the operators' docstrings say of nulls, empty and long texts, repeated rows and clashing columns, by value."""
    labels = spark.createDataFrame([(1, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    at = put(spark, tmp_path, documents=odd, labels=labels)
    rows = lambda name: queries.QUERIES[name](spark, at).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]

    found = rows("op1_simhash")
    assert collections.Counter((r.doc_id, r.fingerprint) for r in found) == collections.Counter((i, f"{slow_fingerprint(t):016x}") for i, t in texts)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    assert {c for (i, _), c in by.items() if i in (1, 2)} == {1}
    assert {c for (i, _), c in by.items() if i in (3, 4)} == {3}
    assert [c for (i, _), c in by.items() if i is None] == [None]

    found = rows("op3_toxicity")
    score = {(r.doc_id, round(r.severity, 9)) for r in found}
    assert len(found) == 9
    assert len({s for i, s in score if i in (1, 2)}) == 1
    assert len({s for i, s in score if i in (3, 4)}) == 1

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = collections.Counter()
    for i, x in texts:
        want[i] += len(t.encode(x or "", add_special_tokens=False).ids) + 1
    got = collections.Counter()
    for r in rows("op4_packing"):
        got[r.doc_id] += r.length
    assert got == want

    assert {(r.query_id, r.doc_id, r["rank"]) for r in rows("op6_search")} == {(100, 100, 1)}

    found = rows("op7_pii")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in texts)
    assert all((r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (0, 0, 0, 0, "")
        and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in found)

    found = rows("op8_mixing")
    tokens = collections.Counter((r.doc_id, r.tokens) for r in found)
    assert tokens == collections.Counter((i, len((x or "").split())) for i, x in texts)
    repeated = [r.copies for r in found if r.doc_id == 1]
    assert len(repeated) == 2 and len(set(repeated)) == 1
    assert sum(r.tokens * r.copies for r in found) <= sum(r.tokens for r in found) * mixing.SHARE_PERCENT // 100

    found = rows("op10_langid")
    assert {(r.lang_pred, r.score) for r in found if r.doc_id in (3, 4)} == {("und", 0.0)}
    assert {r.held_out for r in found if r.doc_id is None} == {False}
    assert all(0 <= r.score <= 1 for r in found)

    pages = spark.createDataFrame([(1, "u", "x" * 300), (5, "u", "x" * 300), (5, "u", "x" * 300), (None, "u", "x" * 300), (2,
        None, None), (3, "u", "short"), (4, "u", "short")], "page_id long, url string, html string").withColumns({c: F.lit(-1)
        for c in CLASH})
    at = put(spark, tmp_path / "web", pages=pages)
    assert collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in rows("op9_warc")) == collections.Counter(
        [(1, "response", None, 300), (5, "revisit", 1, 300), (5, "revisit", 1, 300), (None, "revisit", 1, 300), (2, "response",
             None, 0), (3, "response", None, 5), (4, "response", None, 5)]
    )
    assert collections.Counter((r.page_id, r.text, r.n_chars) for r in rows("op2_html")) == collections.Counter([(1, "x" * 300,
         300), (5, "x" * 300, 300), (5, "x" * 300, 300), (None, "x" * 300, 300), (2, "", 0), (3, "short", 5), (4, "short", 5)])


# --- 1 -------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", ["", None, "One", "ÀB c", "a b c d", "a b c\x0bd e\x1cf", "x y z " * 700, "  lead  and trail "])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == slow_fingerprint(text)


def slow_links(fps, budget=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize(("most", "budget"), [(2, 3), (8, 3), (512, 3), (8, 1), (8, 5)])
def test_links(spark, most, budget):
    rng = np.random.default_rng(most)
    fps = [0, 2**64 - 1, 7, 15]
    for c in rng.integers(0, 2**63, 12).tolist():
        for _ in range(12):
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                c ^= 1 << int(b)
            fps.append(c)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.link_groups(simhash.grouped(df, most, budget).repartition(3, "key").sortWithinPartitions("key"), budget)
    root = {r.v % 2**64: r.root for r in components.components(edges).collect()}
    sets = collections.defaultdict(set)
    for x in fps:
        sets[root.get(x, x)].add(x)
    want = collections.defaultdict(set)
    for x, label in zip(fps, slow_links(fps, budget), strict=True):
        want[label].add(x)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, want.values()))


def test_hot_group_is_dealt_again(spark):
    """Many fingerprints that share most of their bits: groups end up small, and rows are few times the fingerprints."""
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 24, 4000) << 20 | 0x7A).tolist()
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    rows = simhash.grouped(df, 64).groupBy("key").count().toPandas()["count"]
    assert rows.max() <= 64
    assert rows.sum() < 100 * len(fps)
    edges = simhash.link_groups(simhash.grouped(df, 64).repartition(3, "key").sortWithinPartitions("key"))
    root = {r.v: r.root for r in components.components(edges).collect()}
    near = {(a, b) for a in fps[:300] for b in fps if a < b and (a ^ b).bit_count() <= 3}
    assert all(root[a] == root[b] for a, b in near)


def test_near_groups(spark, docs):
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    assert [got[i].fingerprint for i in ids] == [f"{x:016x}" for x in fps]
    label = slow_links(fps)
    first = {}
    for i, x in zip(ids, label, strict=True):
        first.setdefault(x, i)
    assert [got[i].component_id for i in ids] == [first[x] for x in label]


# --- 2 -------------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var x = "</p>";</script></head><body class="has-sidebar"><header><a href=/>Site</a></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><div class="cookie-notice">We use cookies, really.</div>
<div id="content"><div class="ad">Buy, now!</div><article><header><h1>The &amp; title</h1><span>by X</span></header><p>First, with
 a <a href=x>link</a>, and more text.<br>Next line.<p>Second &lt;b&gt; one.</p><ul><li>item one</li><li>item two</li></ul></article></div>
<aside>Side text, with commas, and length.</aside><div class="comments"><p>Nice post, really, I liked it, a lot.</p></div><form>Name <input></form><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "The & title\nFirst, with a link, and more text. Next line.\nSecond <b> one.\nitem one\nitem two"
    assert html.main_text("<div><div><p>One, two, three.</p><p>Four.</p></div><div class=menu><a>x</a></div></div>") == "One, two, three.\nFour."
    assert html.main_text("<main><article><h1>T</h1><p>Body, text.</p><section id=comments><article class=comment><p>Nice, post, "
         "this.</p></article></section></article></main><section class='comments'><article><p>More, of "
         "it.</p></article></section>") == "T\nBody, text."
    assert html.main_text("no markup  at all") == "no markup at all"
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == ""
    assert html.main_text("<p>1 < 2 & 3</p>") == "1 < 2 & 3"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"


def test_tag_ends():
    around = lambda tag: html.main_text(f"<article><p>Before it, text.</p>{tag}<p>After it, text.</p></article>")
    plain = "Before it, text.\nAfter it, text."
    for n in (1, 16, 17, 400):
        for quote in "\"'":
            assert around(f"<div data-x={quote}{'<b>x</b>' * n}{quote}></div>") == plain
            assert around(f"</i x={quote}{'<b>x</b>' * n}{quote}>") == plain
    for tag in ("<img alt='24\" screen'>", '<img alt="it\'s">', "<img alt=it's>", "<img alt=24\">", "<img alt='\">\"'>",
        "<br 'x>", '<img alt="a"">', "<img alt=>", "<img alt = 'a>b' id=\"c>d'\"/>", "<img alt='no end>", '<img alt="no end>'):
        assert around(tag) == plain, tag
    assert html.parse("<a b=\"c>'d\" e='f\"' G=h'i/ j k = l>m")[1][1].attrs == {"b": "c>'d", "e": 'f"', "g": "h'i/", "j": "", "k": "l"}
    for tag in ("<a b='", '<a b="', "<a b=", "<a b='>", "<a b=x "):  # linear: these would take hours otherwise
        html.parse(tag * 20000)


@pytest.mark.parametrize("attrs", ['class="share-price"', 'class="side-effects"', 'id="related-work"', 'id="search-methods"',
     'class="notice-period wide"', 'class="advertising-law"', 'class="menuContentsIndex7x"'])
def test_names_that_hint_at_nothing(attrs):
    for tag in ("p", "div", "section"):
        said = html.main_text(f"<article><h1>T</h1><p>First, of all.</p><{tag} {attrs}>It has, by all means, words.</{tag}><p>Last, a word.</p></article>")
        assert said == "T\nFirst, of all.\nIt has, by all means, words.\nLast, a word."


@pytest.mark.parametrize("attrs", ['class="ad"', 'class="x ad-banner"', 'id="comments-section"', 'class="relatedPosts"',
     'class="share-buttons"', 'class="newsletter-box"', 'role="navigation"', "hidden"])
def test_names_of_layout(attrs):
    assert html.main_text(f"<article><h1>T</h1><p>First, of all.</p><div {attrs}><p>Buy, subscribe, and share.</p></div><p>Last, a word.</p></article>") == "T\nFirst, of all.\nLast, a word."


def test_hints_with_links():
    page = "<article><h1>T</h1><p>First, of all.</p><div class='jp-related-posts-jx'><a href=/a>One more, of these</a> <a href=/b>Two</a></div><p class='share-x'>A <a href=/>link</a> in a longer, much longer text.</p></article>"
    assert html.main_text(page) == "T\nFirst, of all.\nA link in a longer, much longer text."
    assert html.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> "
         "holds.</p></article>") == "So x=2 holds."


BODY = "<h1>T</h1><p>First of all, there is much to say, and more of it, in a long text, with commas.</p><p>Second, as long, and with as many, commas, as the first one has.</p>"
SAID = "T\nFirst of all, there is much to say, and more of it, in a long text, with commas.\nSecond, as long, and with as many, commas, as the first one has."
LINKS = "<ul><li><a href=/a>One source</a></li><li><a href=/b>Two</a></li><li><a href=/c>Three</a></li></ul>"


@pytest.mark.parametrize("more, kept", [
    ('<section id="header"><p>A word before.</p></section>', "A word before."), ('<p class="notice">Take note.</p>', "Take note."),
    (f"<h2>Sources</h2>{LINKS}", "Sources\nOne source\nTwo\nThree"), (LINKS, "One source\nTwo\nThree"),
    ('<div id="disqus_thread"><p>Nice, post.</p></div>', ""), ('<section class="user-comments-list"><p>Nice, post.</p></section>', ""),
    ('<div class="c-Promo--large"><p>Buy, now.</p></div>', ""), ('<div class="notice"><a href=/>Read</a> this <a href=/>now</a></div>', ""),
])
def test_articles_decide_by_structure(more, kept):
    assert html.main_text(f"<body><article>{BODY}{more}</article></body>") == "\n".join(x for x in (SAID, kept) if x)


@pytest.mark.parametrize("more, kept", [
    ("<div class=s><h2>Results</h2><p>Short closing remark.</p></div>", "Results\nShort closing remark."), ("<div class=t><p>Something else.</p></div>", ""),
    (LINKS, ""), ('<div class="s" id="disqus_thread"><p>Nice, post.</p></div>', ""), ('<div class="comment-list"><p>Nice, post.</p></div>', ""),
])
def test_siblings_by_pattern(more, kept):
    assert html.main_text(f"<body><div><div class=s>{BODY}</div>{more}</div></body>") == "\n".join(x for x in (SAID, kept) if x)


def test_plain_siblings_and_link_lists():
    assert html.main_text(f"<body><div><div>{BODY}</div><div><p>Tail text.</p></div></div></body>") == f"{SAID}\nTail text."
    assert html.main_text(f"<body><div id=x>{LINKS}{BODY}<h2>Sources</h2>{LINKS}</div></body>") == f"{SAID}\nSources\nOne source\nTwo\nThree"


def slow_page(source):
    """The article of a generated page: what stands between its tags, block by block."""
    from html import unescape

    inner = source.split("<article>", 1)[1].split("</article>", 1)[0]
    blocks = re.split(r"</?(?:h1|h2|p|li|ul|div|blockquote)\b[^>]*>", inner.replace("<br>", " "))
    return "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^<>]*>", "", b)).split()) for b in blocks) if x)


def test_pages_against_plain_version(spark, sf):
    """All pages of the tables, and generated ones with all that an article is not."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html.extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(rows) == len(got) >= 50
    for r in rows:
        assert got[r.page_id] == slow_page(r.html), r.page_id
    rng = np.random.default_rng(2)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    said = lambda n: " ".join(word() + "," * (i % 6 == 5) for i in range(n))
    for _ in range(300):
        blocks = [f"<h1>{said(5)}</h1>"]
        for _ in range(rng.integers(2, 9)):
            kind = rng.integers(0, 5)
            text = f"{said(8)} <a href=/x>{word()}</a> &amp; <b>{said(rng.integers(5, 40))}</b>"
            blocks.append([f"<p>{text}</p>", f"<h2>{said(4)}</h2><p>{text}<br>{said(3)}</p>", f"<ul><li>{said(6)}<li>{text}</ul>",
                 f"<blockquote>{text}</blockquote>", f'<div class="{word()}-price"><p>{text}</p></div>'][kind])
        around = ["<nav><ul><li><a href=/>x</a></ul></nav>", f"<header><a href=/>{said(3)}</a></header>",
             f"<aside><p>{said(30)}</p></aside>", f'<div class="ad">{said(20)}</div>',
             f'<div id="comments"><p>{said(30)}</p></div>', f"<form>{said(4)}<input></form>",
             f'<div class="cookie-notice">{said(12)}</div>', f"<script>{said(9)}</script>"]
        some = [around[i] for i in rng.permutation(len(around))[: rng.integers(0, len(around))]]
        cut_at = int(rng.integers(0, len(some) + 1))
        page = f"<html><head><title>{said(3)}</title></head><body>{''.join(some[:cut_at])}<article>{''.join(blocks)}</article>{''.join(some[cut_at:])}<footer>{said(6)}</footer></body></html>"
        assert html.main_text(page) == slow_page(page), page


# --- 3 -------------------------------------------------------------------------------------------------------------------


def test_ordinal_regression():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        bad = int(rng.integers(0, 4))
        rows.append(np.concatenate([rng.integers(0, 50, 20), 100 + np.arange(bad)]))
        grades.append(min(bad, 3))
    model = toxicity.fit(rows, np.array(grades))
    assert model.thresholds == sorted(model.thresholds)
    expected = [sum(model.probabilities(sum(model.weights.get(f, 0) * math.log1p(n) for f,
        n in collections.Counter(r.tolist()).items()))) for r in rows]
    assert np.mean(np.abs(np.array(expected) - grades)) < 0.3
    assert toxicity.fit([], np.array([])).probabilities(3) == []


def test_toxicity(spark, sf, docs):
    name = lambda i: "".join(chr(97 + int(c)) for c in str(i)) + "o"
    rows = [(1000 + i, f"calm words about {name(i)} rivers and {name(i % 7)} hills") for i in range(300)] + [(2000 + i,
         f"you vilest and grubbish {name(i)} person of {name(i % 5)}") for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 2000)) for i, _ in rows if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.severity(d, toxicity.train(d, labels)).collect()}
    assert all(got[i] == (i >= 2000) for i, _ in rows)


def test_severity_against_plain_version(spark, docs):
    rng = np.random.default_rng(6)
    known = sorted({w for r in docs.limit(40).collect() for w in toxicity.words(r.text)})[::3]
    weights = {f: float(rng.normal()) for w in known for f in toxicity.word_features(w)}
    model = toxicity.OrdinalModel(weights, [-1.0, 0.5, 2.0])
    got = {r.doc_id: r for r in toxicity.severity(docs, model).collect()}
    for r in docs.collect():
        counts = collections.Counter(zlib.crc32(p.encode()) % toxicity.SPACE for w in set(re.findall(r"[^\W\d_]+", (r.text
            or "").lower())) for p in ("=" + w, *(w[:n] for n in (4, 5, 6) if len(w) >= n)))
        z = sum(weights.get(f, 0) * math.log1p(n) for f, n in counts.items())
        p = [1 / (1 + math.exp(min(max(t - z, -40), 40))) for t in (-1.0, 0.5, 2.0)]
        assert got[r.doc_id].severity == pytest.approx(sum(p), abs=1e-6)
        assert got[r.doc_id].toxic == (p[0] > 0.5)


def test_toxicity_held_out(spark):
    """Learned from the labels of two thirds of the ids, on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    mine = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0
    model = toxicity.train(docs, labels.filter(mine))
    rows = toxicity.severity(docs, model).withColumnRenamed("toxic", "found").join(labels.filter(~mine), "doc_id").collect()
    hit = [r.found for r in rows if r.toxic]
    false = [r.found for r in rows if not r.toxic]
    assert len(hit) > 50
    assert np.mean(hit) >= 0.93  # some texts that are labelled toxic are one word over and over
    assert np.mean(false) <= 0.01
    assert any(x < 0 for x in model.weights.values())
    assert len(model.thresholds) == 2


def test_toxicity_bounds(spark):
    """Neither repeated labels nor repeated ids let the fit read more than its sample."""
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} fine day") for i in range(200)] + [(7,
         f"nasty fool{chr(97 + i % 26)} {chr(97 + i // 26)}x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(200) if i != 7] + [(7, 1)] * 50 + [(7, 0)] * 50, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, {1: 100, 0: 100})
    got = {r.text: r.toxic for r in toxicity.severity(docs, model).withColumnRenamed("doc_id", "d").join(docs,
        F.col("d") == docs.doc_id).select("text", "toxic").distinct().collect() if "nasty" in r.text}
    assert any(got.values())
    assert toxicity.train(docs, labels.limit(0)).thresholds == []


# --- 4 -------------------------------------------------------------------------------------------------------------------


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    some = docs.union(spark.createDataFrame([(9001, "a <|endoftext|> b", "en", "s", 1), (9002, None, None, None, None), (9003,
         "word " * 5000, "en", "s", 1)], docs.schema))
    got = packing.pack_documents(some, packing.tokenizer_path()).collect()
    t = Tokenizer.from_file(packing.tokenizer_path())
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in some.collect()}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    for i, x in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(x)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        assert at & at - 1 == 0


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + "\n" * 5_000_000 + "b", " \n\t\r  \x1c" * 200_000, (" " * 255 + "x") * 4_000, (" " * 9_999 + "x") * 50])
def test_packing_of_white_space(text):
    """Runs of any length, on both sides of the bound from which the library takes over, give the library's ids."""
    from tokenizers import Tokenizer

    file = packing.tokenizer_path()
    assert packing.encoder(file)(text).tolist() == Tokenizer.from_file(file).encode(text, add_special_tokens=False).ids


def test_packing_of_long_white_space_in_a_job(spark, sf):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, " " * 1_500_000, "en", "s", 1), (2, "\n" * 1_000_000 + "x", "en", "s", 1)], DOCS)
    for got in (packing.pack_documents(docs, packing.tokenizer_path()), corpus_pipeline.pack(spark, docs, sf)):
        assert {r.doc_id for r in got.collect()} == {1, 2}


def test_fill_is_best():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = dict(collections.Counter(rng.integers(1, 40, rng.integers(1, 9)).tolist()))
        found = packing.fill(counts, 64)
        first, best = max(counts), {0}
        rest = [x for x, n in counts.items() for _ in range(n - (x == first))]
        for x in rest:
            best |= {b + x for b in best if b + x + first <= 64}
        assert sum(x * k for x, k in found) == first + max(best)
        assert all(k <= counts[x] for x, k in found)


# --- 5 -------------------------------------------------------------------------------------------------------------------


def played(vector, late=0, noise=0.0, seed=0):
    return chroma.sonify()({"id": seed, "vector": vector, "late": late, "noise": noise})


def test_chroma(spark):
    rng = np.random.default_rng(5)
    songs = [rng.uniform(-0.3, 0.3, 96).tolist() for _ in range(6)]
    noisy = played(songs[0], noise=0.02)
    late = played(songs[1], late=16)
    assert np.bitwise_count(chroma.fingerprint(noisy) ^ chroma.fingerprint(played(songs[0]))).mean() < 4
    rows = [(100 * i, played(s)) for i, s in enumerate(songs)] + [(1, noisy), (2, late), (3, played(rng.uniform(-0.3, 0.3, 96).tolist())), (4, None)]
    rows += [(500, played(songs[5]))] * 2 + [(700, played(songs[5])), (None, played(songs[5])), (None, played(songs[4]))]
    fps = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary"))
    found = chroma.align(fps, fps.filter("id % 100 = 0"))
    got = {r.id: r for r in fps.join(found, "fp").collect()}
    assert (got[1].query, got[1].offset) == (0, 0)
    assert (got[2].query, got[2].offset) == (100, 16)
    assert 3 not in got
    assert 4 not in got
    assert all(got[100 * i].query == 100 * i and got[100 * i].errors == 0 for i in range(6))
    assert (got[700].query, got[700].n_queries, got[0].n_queries) == (500, 2, 1)  # ids 500 and 700, the first of them twice
    assert got[None].errors == 0
    assert len(chroma.fingerprint(played([0.1] * 8))) == 0


def test_broken_recordings():
    good = played([0.1, -0.2] * 40)
    assert len(chroma.fingerprint(good)) > 40
    for bad in (b"", b"RIFF", b"x" * 100, good[:10], good[:40], good.replace(b"WAVE", b"WOVE"), good[:34] + struct.pack("<H", 24) + good[36:]):
        assert len(chroma.fingerprint(bad)) == 0
    assert len(chroma.fingerprint(good[:-1])) > 40
    wide = chroma.decode(good)[0]
    for width, dtype, scale, zero in ((1, "u1", 127, 128), (4, "<i4", 2**31 - 1, 0)):
        import io
        import wave

        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((2, width, 8000, 0, "NONE", ""))
            w.writeframes(np.repeat(wide * scale + zero, 2).astype(dtype).tobytes())
        assert np.abs(chroma.decode(out.getvalue())[0] - wide).max() < 0.02


def slow_align(a, b):
    """The least share of differing bits of two fingerprints at any offset that overlaps half of the shorter one."""
    best = (2.0, 0)
    for o in range(-len(b) + 1, len(a)):
        lo, hi = max(0, o), min(len(a), o + len(b))
        if hi - lo >= 0.5 * min(len(a), len(b)):
            best = min(best, (float(np.bitwise_count(a[lo:hi] ^ b[lo - o : hi - o]).sum()) / (32 * (hi - lo)), o))
    return best


def in_block(fps):
    return {"ids": np.arange(len(fps)), "starts": np.cumsum([0, *map(len, fps)]), "fp": np.concatenate(fps).astype(np.uint32)}


def test_alignment_recall():
    """Of the pairs that an exhaustive search aligns, `align` finds at least nine in ten; and it aligns no others."""
    rng = np.random.default_rng(12)
    songs = [rng.uniform(-0.3, 0.3, 80).tolist() for _ in range(20)]
    queries = [chroma.fingerprint(played(s)) for s in songs]
    rows = [chroma.fingerprint(played(songs[i % 20], int(rng.integers(0, 12)), float(rng.choice([0.0, 0.02, 0.05, 0.1, 0.2])), i))
         for i in range(120)]
    slow = {(i, j): slow_align(a, b) for i, a in enumerate(rows) for j, b in enumerate(queries)}
    want = {p for p, (e, _) in slow.items() if e <= chroma.MOST_ERRORS}
    got = chroma.align_block(in_block(rows), in_block(queries))
    found = {(i, q) for i, which in zip(got[0], got[5], strict=True) for q in which}
    assert len(want) >= 100
    assert found <= want
    assert len(found) >= 0.9 * len(want)
    exact = [abs(e - min(slow[i, q][0] for q in range(20))) < 1e-9 for i, e in zip(got[0], got[3], strict=True)]
    assert np.mean(exact) > 0.95


def test_queries_find_their_recordings(spark, sf):
    """Each query, late and noisy, finds the row that it was recorded from, at the right offset."""
    rows = {r.vec_id: r for r in queries.QUERIES["op5_chroma"](spark, sf).collect()}
    asked = [i for i in rows if i % 100 == 0]
    right = [rows[i].aligned_id == i and rows[i].offset == -(i // 100 % 12) for i in asked]
    assert len(asked) >= 1
    assert np.mean(right) >= 0.9
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()


def test_chroma_short_and_repeated():
    rng = np.random.default_rng(8)
    new = lambda n: rng.integers(0, 1 << 32, n, np.uint32)
    for n in (1, 2, 3):
        x = new(n)
        assert chroma.align_block(in_block([x]), in_block([new(n), x])) == ([0], [1], [0], [0.0], [1], [[1]])
    x = new(40)
    x[20:26] = x[0]  # the offsets of this run have more hits than the true one
    y = x.copy()
    y[[i for i in range(40) if i not in (0, 20, 21, 22, 23, 24, 25)]] ^= np.uint32(1 << 31)
    assert chroma.align_block(in_block([y]), in_block([x]))[:5] == ([0], [0], [0], [33 / (32 * 40)], [1])
    run = np.full(6, x[0], np.uint32)
    a, b = np.concatenate([run, x[6:20], new(3)]), np.concatenate([new(3), run, x[6:20] ^ np.uint32(1 << 31)])
    assert chroma.align_block(in_block([b]), in_block([a]))[2] == [3]


def test_offset_histograms(monkeypatch):
    """Runs give the hits that pairs of integers do, however few cells are held; and both ways to count errors agree."""
    rng = np.random.default_rng(21)
    fps = [np.repeat(rng.integers(0, 4, n, np.uint32) << np.uint32(8), rng.integers(1, 6, n)) for n in rng.integers(1, 12, 40)]
    rows, queries = fps[:20], fps[20:]
    block = chroma.Block(in_block(queries))
    for cells in (1, 200, 1 << 22):
        monkeypatch.setattr(chroma, "CELLS", cells)
        for a in rows:
            q, off = chroma.candidates(a, block)
            want = set()
            for j, b in enumerate(queries):
                hits = collections.Counter(x - y for x in range(len(a)) for y in range(len(b)) if a[x] == b[y])
                want |= {(j, o) for o, n in hits.items() if n >= min(chroma.HITS, len(a), len(b))}
            assert set(zip(q.tolist(), off.tolist(), strict=True)) == want
            few = chroma.judged(a, block, q, off)
            monkeypatch.setattr(chroma, "MANY", 0)
            assert chroma.judged(a, block, q, off) == pytest.approx(few)
            monkeypatch.setattr(chroma, "MANY", 64)
    silence = [np.zeros(20_000, np.uint32), np.zeros(15_000, np.uint32)]  # 300 million pairs of integers
    assert chroma.align_block(in_block(silence), in_block(silence))[4] == [2, 2]


# --- 6 -------------------------------------------------------------------------------------------------------------------


def test_search(spark, docs):
    rows = {r.doc_id: search.terms(r.text) for r in docs.collect()}
    n, mean = len(rows), np.mean([c.total() for c in rows.values()])
    df = collections.Counter(t for c in rows.values() for t in c)
    got = collections.defaultdict(list)
    for r in search.search(docs, docs.filter("doc_id % 20 = 0")).collect():
        got[r.query_id].append((r["rank"], r.doc_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, found in got.items():
        scores = {}
        for i, c in rows.items():
            s = sum(k * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean))
                 for t, k in rows[q].items() if t in c)
            if s:
                scores[i] = round(s, 6)
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10]
        assert [x[2] for x in sorted(found)] == pytest.approx([s for _, s in want], abs=3e-6)
        assert {x[1] for x in found} == {i for i, _ in want} or want[-1][1] == pytest.approx(want[-2][1], abs=3e-6)


@pytest.mark.parametrize("size", [4, 64])
def test_block_max_wand(monkeypatch, size):
    """Against full scoring, shard after shard: the same best, with postings skipped that can't be among them."""
    monkeypatch.setattr(search, "BLOCK", size)
    monkeypatch.setattr(search, "SPAN", 4)
    rng = np.random.default_rng(31)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    zipf = 1 / np.arange(1, 751)
    texts = []
    for i in range(4000):  # four groups of documents with words of their own, and words that all have
        own = rng.choice(vocabulary[i % 4 :: 4], rng.integers(5, 120), p=zipf / zipf.sum())
        texts.append(collections.Counter([*own.tolist(), *rng.choice(["the", "of", "and", "to", "in"], 20).tolist()]))
    n, mean = len(texts), np.mean([c.total() for c in texts])
    df = collections.Counter(t for c in texts for t in c)
    idf = {t: math.log1p((n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    shards = [search.Shard(search.build_shard([(i if i % 50 else None, texts[i]) for i in range(a, a + 1000)]), mean) for a in range(0, 4000, 1000)]
    asked = list(range(1, 4000, 97))
    terms = [sorted((search._hash(t), idf[t] * m) for t, m in texts[i].items()) for i in asked]
    q = {"ids": np.array(asked), "starts": np.cumsum([0, *map(len, terms)]), "terms": np.array([h for x in terms for h, _ in x]),
         "weights": np.array([w for x in terms for _, w in x])}
    best, found = search.Best(10), collections.defaultdict(list)
    for s in shards:
        for query, doc, score in zip(*(x.tolist() for x in s.search(q, best)), strict=True):
            found[query].append((round(score, 6), int(s.ids[doc])))
    for i in asked:
        slow = {j: round(sum(m * idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for t,
            m in texts[i].items() if c[t]), 6) for j, c in enumerate(texts) if j % 50}
        want = sorted(((s, j) for j, s in slow.items() if s), key=lambda x: (-x[0], x[1]))[:10]
        got = sorted(found[i], key=lambda x: (-x[0], x[1]))[:10]
        assert [j for _, j in got] == [j for _, j in want]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-6)
    total = [sum(int(s.df[np.searchsorted(s.terms, h)]) for x in terms for h, _ in x if h in set(s.terms.tolist())) for s in shards[:1]]
    assert shards[0].read + shards[0].skipped == total[0]
    assert size > 4 or all(s.skipped > 0.1 * s.read for s in shards)


def test_rows_of_scores_are_of_the_terms_frequent_in_their_span():
    """What is multiplied for a query follows the postings: languages that lie apart don't fill each other's rows."""
    rng = np.random.default_rng(7)
    docs = [(i, collections.Counter(f"{i % 4}w{x}" for x in rng.integers(0, 300, 60))) for i in range(4000)]
    data = search.build_shard([(i, c + collections.Counter({f"{i % 4}top": 99})) for i, c in docs])
    shard = search.Shard(data, 159.0)
    assert sum(x.size for x in shard.dense) <= 8 * len(data["doc"])


def test_found_rows_are_the_best_of_a_task():
    found, rng, every = search.Found(10), np.random.default_rng(5), collections.defaultdict(list)
    for a in range(0, 300_000, 30_000):
        q, ids, score = rng.integers(0, 50, 30_000), np.arange(a, a + 30_000), rng.integers(0, 900, 30_000) / 3
        found.add(q, ids, score)
        for x in zip(q.tolist(), (-np.round(score, 6)).tolist(), ids.tolist(), strict=True):
            every[x[0]].append(x[1:])
    got = collections.defaultdict(list)
    for q, i, x in zip(*(x.tolist() for x in found.cut()), strict=True):
        got[q].append((-x, i))
    assert got == {q: sorted(x)[:10] for q, x in every.items()}


@pytest.mark.parametrize("copies", [15, 200])
def test_search_passes_over_rows_without_id(spark, copies):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = [(i, " ".join([*words[: 1 + i % 12], *["other"] * (i // 12)])) for i in range(100, 160)]
    asked = spark.createDataFrame([(100, " ".join(words))], "doc_id long, text string")
    table = spark.createDataFrame([*rows, *[(None, " ".join(words))] * copies], "doc_id long, text string").coalesce(1)
    counts = [(i, collections.Counter(t.split())) for i, t in rows] + [(None, collections.Counter(words))] * copies
    mean, n = sum(c.total() for _, c in counts) / len(counts), len(counts)
    df = collections.Counter(w for _, c in counts for w in c)
    idf = {w: math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) for w in words}
    bm25 = lambda c: sum(idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * c.total() / mean)) for w in words if c[w])
    best = sorted(((-round(bm25(c), 6), i) for i, c in counts if i is not None))[:10]
    got = sorted(search.search(table, asked).collect(), key=lambda r: r["rank"])
    assert [r.doc_id for r in got] == [i for _, i in best]
    assert [-r.score for r in got] == pytest.approx([s for s, _ in best], abs=2e-6)


# --- 7 -------------------------------------------------------------------------------------------------------------------


def slow_base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]


def test_base_spans_random():
    rng = np.random.default_rng(7)
    alphabet = list("a@.+-% 0159()é\n")
    for _ in range(3000):
        t = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(t) == slow_base(t)
    for t in ("1.2.3.4.5.6.7.8", "a@b.c@d.e", "4897498761550726", "+1 (207) 555-2084", "é+1 (207) 555-2084 x@y.zz", "9" * 50_000,
         "a" * 50_000, "a@" * 20_000, "+" * 20_000):
        assert pii.base_spans(t) == (slow_base(t) if len(t) < 1000 else [])


def test_pii(spark, docs):
    model = pii.train(docs)
    for r in pii.find_pii(docs, model).join(docs, "doc_id").collect():
        base = slow_base(r.text)
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in pii.BASE)
        assert set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.redact("mail a@b.co now", [("email", 5, 11)]) == "mail [EMAIL] now"


def test_pii_training_sample(spark, docs):
    text = " ".join(f"token=a{i}b{i * 7919 % 1000}c9Zq key {i} and 12{i % 10}-45-678{i % 7}," for i in range(200))
    found = pii.candidates(text)
    rows = [(pii.votes(k, text, a, b), pii.features(k, text, a, b)) for k, a, b in found]
    assert len(found) > 250 and max(a for _, a, _ in found) > len(text) * 0.99
    one = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.train(one) == pii.fit(rows)  # every candidate of a text, to its end
    assert len(pii.train(one, most=5).reliability) == len(pii.LABELERS)
    assert pii.train(docs.union(docs).union(docs)) == pii.train(docs)
    hot = spark.createDataFrame([(i, text) for i in range(500)] + [(None, text)] * 50, "doc_id long, text string")
    assert pii.train(hot) == pii.train(one)  # copies of a text count once


def test_pii_fits_any_number_of_candidates(spark):
    text = " ".join(f"token=a{i}b{i * 7919 % 1000}c9Zq key {i} and 12{i % 10}-45-678{i % 7}," for i in range(40))
    found = pii.candidates(text)
    rows = [(pii.votes(k, text, a, b), pii.features(k, text, a, b)) for k, a, b in found]
    none = pii.fit([])
    assert none.weights == pytest.approx(pii.BELIEF)
    for k, a, b in found:
        assert none.accepts(k, text, a, b) == (sum(pii.votes(k, text, a, b)) >= 2)
    models = [pii.fit(rows[:n]) for n in (0, 1, 5, 19, 20, 21, 60)]
    z = [[m.weights[0] + float(np.dot(m.weights[1:], pii.features(k, text, a, b))) for k, a, b in found] for m in models]
    assert np.abs(np.diff(z[2:6], axis=0)).max() < 3  # no jump at any count
    assert pii.train(spark.createDataFrame([], "doc_id long, text string")) == none


def slow_candidates(text):
    taken, out = [(a, b) for _, a, b in pii.base_spans(text)], []
    for kind, pattern in pii._WIDE:
        for m in pattern.finditer(text):
            a, b = m.span()
            if (kind == "email" or re.search("[0-9]", m[0])) and all(b <= x or a >= y for x, y in taken):
                out.append((kind, a, b))
                taken.append((a, b))
    return out


def test_pii_candidates(docs):
    rng = np.random.default_rng(11)
    parts = ["ann (at) x.org", "ann at x dot org", "1.2.3.4", "1234 5678 9012 3456", "555-123-4567", "+1 (207) 555-2084",
         "key=ABCD1234567890AB", "a@b.co", "ghp_" + "a1" * 200, "0" * 300, "x" * 200 + "(at)y.org", ", ", " ", "=", "(", "-"]
    for _ in range(400):
        t = "".join(rng.choice(parts, rng.integers(0, 25)))
        assert pii.candidates(t) == slow_candidates(t)
    for r in docs.limit(100).collect():
        assert pii.candidates(r.text or "") == slow_candidates(r.text or "")
    assert ("secret", 4, 4 + 404) in pii.candidates("key=ghp_" + "a1" * 200)
    assert pii.candidates("x" * 200 + "(at)y.org") == [("email", 0, 209)]
    for unit in ("555-123-4567, ", "a-", "a1", "x at ", "0f", "=", "k=1234567890ab "):  # linear: these took minutes otherwise
        pii.candidates(unit * 60_000)


def test_labelers_reliability():
    rng = np.random.default_rng(9)
    truth, accuracy = rng.random(4000) < 0.5, np.array([0.95, 0.8, 0.6, 0.9])
    v = np.where((rng.random((4000, 4)) < accuracy) == truth[:, None], 1, -1) * (rng.random((4000, 4)) < 0.8)
    post, found, prior = pii.estimate(v.astype(float))
    assert ((post > 0.5) == truth).mean() > 0.93
    assert np.abs(found - accuracy).max() < 0.06


# --- 8 -------------------------------------------------------------------------------------------------------------------


def slow_share(budget, nodes):
    """nodes: (weight, capacity); whole-number water filling by repetition."""
    full, got = set(), [0] * len(nodes)
    while True:
        left = budget - sum(nodes[i][1] for i in full)
        weight = sum(w for i, (w, _) in enumerate(nodes) if i not in full)
        more = {i for i, (w, c) in enumerate(nodes) if i not in full and c * weight <= max(left, 0) * w}
        if not more:
            break
        full |= more
    for i, (w, c) in enumerate(nodes):
        got[i] = c if i in full else min(c, max(left, 0) * w // weight)
    return got


def test_mixing(spark, docs):
    got = mixing.mix(docs, mixing.domain_of(F.col("source"))).collect()
    assert len(got) == docs.count()
    cap, weights = collections.Counter(), {}
    leaves = {}
    for r in got:
        leaf = (r.domain, r.lang, r.source)
        leaves.setdefault(leaf, []).append(r)
        cap[leaf] += r.tokens
        weights[leaf] = (int(r.domain[1:]) + 1, 3 if r.lang == "en" else 1, len(r.source) - 3)
    texts = dict(docs.select("doc_id", "text").collect())
    assert all(r.tokens == len(re.split("[ \t\n\x0b\x0c\r]+", texts[r.doc_id].strip(" \t\n\x0b\x0c\r"))) for r in got if texts[r.doc_id].strip())
    alive = sorted(x for x in leaves if cap[x])
    budget = sum(cap.values()) * mixing.SHARE_PERCENT // 100
    target = {}

    def level(keys, budget, depth):
        groups = sorted({k[depth] for k in keys})
        parts = slow_share(budget, [(weights[next(k for k in keys if k[depth] == g)][depth], sum(2 * cap[k] for k in keys
            if k[depth] == g)) for g in groups])
        for g, b in zip(groups, parts, strict=True):
            own = [k for k in keys if k[depth] == g]
            if depth == 2:
                target[own[0]] = b
            else:
                level(own, b, depth + 1)

    level(alive, budget, 0)
    for leaf in alive:
        whole, part = divmod(target[leaf], cap[leaf])
        upto = 0
        for r in sorted(leaves[leaf], key=lambda r: hashlib.md5(f"{mixing.SEED}:{whole}:{r.doc_id}".encode()).hexdigest()):
            upto += r.tokens
            assert r.copies == whole + (upto <= part), (leaf, target[leaf])


def test_mixing_null_and_short_sources(spark):
    sizes = {None: 4000, "": 300, "c4": 500, "web": 700, "books": 1000, "encyclopedia": 2000}
    totals = spark.createDataFrame([("d0", "en", s, n) for s, n in sizes.items()], "domain string, lang string, source string, tokens long")
    weights = mixing.default_weights(totals)
    budget = 4000
    got = {r.source: r.target for r in mixing.budgets(totals, weights, F.lit(budget)).collect()}
    nodes = [(max(len(s or "") - 3, 1), 2 * n) for s, n in sizes.items()]
    assert got == dict(zip(sizes, slow_share(budget, nodes), strict=True))
    assert all(got.values()) and sum(got.values()) <= budget
    none = weights.withColumn("w3", F.when(F.col("source").isNotNull(), F.col("w3")))
    got = {r.source: r.target for r in mixing.budgets(totals, none, F.lit(budget)).collect()}
    assert got == dict(zip(sizes, [0, *slow_share(budget, nodes[1:])], strict=True))
    rows = [(i, "a b c d e", "en", s) for i, s in enumerate([s for s in sizes for _ in range(40)])]
    taken = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
        F.lit("d0")).groupBy("source").agg(F.sum("copies").alias("n")).collect()
    assert {r.source for r in taken if r.n} == set(sizes)


@pytest.mark.parametrize("keys", [(), ("row",)])
@pytest.mark.parametrize("ids", [None, 5])
def test_mixing_rows_that_share_an_id(spark, ids, keys):
    """Rows without an id, or of one id, are taken by a seeded order of their own: not the short ones first, not all or none."""
    rows = [(ids, "w " * (1 + i % 100), "en", "src1", i) for i in range(2000)] + [(i + 10, "w " * 7, "de", "src1", 9000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long").repartition(3)
    got = mixing.mix(df, F.lit("d1"), keys=keys, epochs=1).filter("lang = 'en'").collect()
    target = mixing.budgets(*_one_leaf(spark, rows)).filter("lang = 'en'").first()
    taken = [r.tokens for r in got if r.copies]
    assert len(got) == 2000 and target.target - 100 < sum(taken) <= target.target < target.tokens
    assert abs(sum(taken) / len(taken) - 50.5) < 4
    equal = spark.createDataFrame([(ids, "w " * 20, "en", "src1", i) for i in range(1000)], df.schema)
    assert sum(r.copies for r in mixing.mix(equal, F.lit("d1"), keys=keys).collect()) == 600


def _one_leaf(spark, rows):
    totals = spark.createDataFrame([("d1", lang, "src1", sum(len(r[1].split()) for r in rows if r[2] == lang)) for lang in ("en", "de")], "domain string, lang string, source string, tokens long")
    budget = totals.agg(F.sum("tokens")).first()[0] * mixing.SHARE_PERCENT // 100
    return totals, mixing.default_weights(totals), F.lit(budget), 1


# --- 9 -------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, sf):
    got = queries.QUERIES["op9_warc"](spark, sf).toPandas().sort_values("page_id").reset_index(drop=True)
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = c.sql(warc.ORACLE).df().sort_values("page_id").reset_index(drop=True)
    for df in (got, want):
        df["refers_to"] = df["refers_to"].astype("Int64").fillna(-1)
    assert got.astype(str).equals(want[got.columns].astype(str))


def test_warc_archives(spark, tmp_path):
    rng = np.random.default_rng(4)
    names = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(300)]
    payloads = [f"<p>some words {' '.join(rng.choice(names, 150))} {i}</p>".encode() for i in range(400)]
    records = [warc.make_record(i, "http://x/é", p, None) for i, p in enumerate(payloads)] + [warc.make_record(-5, None,
        payloads[0], 0), warc.make_record(None, "u\r\nX: y", b"", None)]
    dictionary = warc.train(payloads)
    assert dictionary
    content = warc.pack(records, dictionary)
    assert list(warc.frames(content)) == records
    assert list(warc.frames(warc.pack(records, b""))) == records
    (tmp_path / "a.warc.zst").write_bytes(content)
    back = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r.page_id for r in back] == [*range(400), -5, None]
    assert [bytes(r.payload) for r in back[:400]] == payloads
    assert (back[400].record_type, back[400].refers_to, back[400].payload_bytes) == ("revisit", 0, len(payloads[0]))
    for broken in (content[:-3], content[:4], b"x" + content, content[: len(content) // 2] + b"?" + content[len(content) // 2 + 1 :]):
        with pytest.raises(warc.WarcError):
            list(map(warc.parse, warc.frames(broken)))
    good = records[0]
    for bad in (good[:-1], good.replace(b"WARC-Date", b"WARC-Dote"), good.replace(b"words", b"wards", 1), b"WARC/9" + good[8:]):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    assert base64.b32decode(warc.parse(good)["fields"]["warc-payload-digest"][7:]).hex() == hashlib.sha256(payloads[0]).hexdigest()


@pytest.mark.parametrize("with_dictionary", [False, True])
def test_warc_frames_without_size(spark, tmp_path, with_dictionary):
    rng = np.random.default_rng(9)
    payloads = [b"", b"x", *(bytes(rng.integers(97, 105, 3000, np.uint8)) for _ in range(60)), b"long " * 200_000]
    records = [warc.make_record(i, "http://x/", p, None) for i, p in enumerate(payloads)]
    dictionary = warc.train(payloads * 4) if with_dictionary else b""
    assert bool(dictionary) == with_dictionary
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    content = warc.pack([], dictionary)
    for r in records:
        z = zstandard.ZstdCompressor(write_checksum=True, **known).compressobj()
        frame = b"".join([z.compress(r[:100]), z.compress(r[100:]), z.flush()])
        assert zstandard.get_frame_parameters(frame).content_size == zstandard.CONTENTSIZE_UNKNOWN
        content += frame
    assert list(warc.frames(content)) == records
    for broken in (content[:-3], content[:-2] + bytes([content[-2] ^ 1]) + content[-1:]):
        with pytest.raises(warc.WarcError):
            list(warc.frames(broken))
    (tmp_path / "a.warc.zst").write_bytes(content)
    back = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [bytes(r.payload) for r in back] == payloads


def foreign(kind, block, *fields, content_type="application/http; msgtype=response"):
    """A record as other writers make it: random ids, SHA-1 digests, other header orders, a folded header."""
    import uuid

    head = [("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Length", str(len(block))), ("warc-type", kind), ("WARC-Record-ID",
         f"<urn:uuid:{uuid.UUID(int=len(block) + (7 << 100))}>"), ("Content-Type", content_type), *fields]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"X-Long: one\r\n  two\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_of_other_writers(spark, tmp_path):
    page = b"<p>some page</p>"
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(page)
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(page).digest()).decode()
    records = [
        foreign("warcinfo", b"software: x\r\n", content_type="application/warc-fields"), foreign("request",
             b"GET / HTTP/1.1\r\n\r\n", content_type="application/http; msgtype=request"),
        foreign("response", http + page, ("WARC-Payload-Digest", sha1), ("WARC-Block-Digest",
            "md5:" + hashlib.md5(http + page).hexdigest())), foreign("revisit", http, ("WARC-Payload-Digest", sha1),
            ("WARC-Refers-To", "<urn:x:1>")),
        foreign("response", http + page[:4], ("WARC-Truncated", "length")), foreign("metadata", b"a: b",
            content_type="text/plain"), foreign("resource", page, ("WARC-Payload-Digest", "blake3:xyz"),
            content_type="text/html"), foreign("response", b"HTTP/1.1 204 No\r\n\r\n"),
    ]
    content = zstandard.ZstdCompressor().compress(records[0]) + b"\x50\x2a\x4d\x18\x03\0\0\0abc" + b"".join(map(zstandard.ZstdCompressor().compress,
         records[1:]))
    (tmp_path / "x.warc.zst").write_bytes(content)
    back = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r.record_type for r in back] == ["warcinfo", "request", "response", "revisit", "response", "metadata", "resource", "response"]
    assert all(r.page_id is None and r.record_id.startswith("<urn:uuid:") for r in back)
    assert [r.payload_bytes for r in back] == [13, 0, 16, 16, 4, 4, 16, 0]
    assert (back[2].payload_digest, back[2].digest_kind) == (hashlib.sha256(page).hexdigest(), "sha256")
    assert (back[3].payload_digest, back[3].digest_kind, back[3].refers_to,
        back[3].refers_to_id) == (hashlib.sha1(page).hexdigest(), "sha1", None, "<urn:x:1>")
    good = records[2]
    for bad in (good.replace(b"some page", b"same page"), good.replace(b"Content-Length: 5", b"Content-Length: -5", 1),
        good.replace(sha1.encode(), b"sha1:xyz"), foreign("response", http + page[:4]), foreign("response", http.replace(b"16",
         b"1x") + page), b"", b"\r\n\r\n"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    for bad in (b"", content[:5], struct.pack("<II", warc.SKIPPABLE, 9) + b"abc", struct.pack("<II", warc.SKIPPABLE,
        4) + struct.pack("<I", warc.FRAME) + content):
        with pytest.raises(warc.WarcError):
            list(warc.frames(bad))


def test_every_archive_carries_the_dictionary(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for n, rows in ((0, pages.limit(0)), (1, pages.limit(1)), (3, pages.limit(3)), (9, pages)):
        rows = warc.with_types(rows)
        dictionary = warc.dictionary_of(rows)
        assert 0 < len(dictionary) <= warc.DICT_BYTES
        warc.write_archives(rows, path := f"{tmp_path}/{n}", dictionary)
        back = spark.read.parquet(path)
        for r in back.collect():
            assert bytes(r.content[:8]) == struct.pack("<II", warc.SKIPPABLE, len(dictionary))
            assert bytes(r.content[8 : 8 + len(dictionary)]) == dictionary
        assert warc.read_archives(back).count() == rows.count()


def test_revisits(spark):
    same = "y" * 100
    pages = spark.createDataFrame([(3, "u", same), (1, "u", same), (2, "u", same[:-1]), (4, "u", same[:-1]), (5, "u", None)],
         "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc.with_types(pages).collect()} == {1: None, 2: None, 3: 1, 4: None, 5: None}


# --- 10 ------------------------------------------------------------------------------------------------------------------


def test_langid(spark, sf, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op10_langid"](spark, sf).collect()}
    langs = dict(docs.select("doc_id", "lang").collect())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, ["en"], np.ones((1, langid.DIM), np.float32)).collect()} == {("und", 0.0)}


def test_hypervector():
    enc = langid.Encoder(dim=64)
    want = np.zeros(64)
    for gram in (" ab", "abc", "bc "):
        want += np.roll(enc.letter(ord(gram[0])), 2) * np.roll(enc.letter(ord(gram[1])), 1) * enc.letter(ord(gram[2]))
    assert enc.vector("1 ABC!") == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    small = langid.Encoder(dim=64, keep=8)
    assert small.vector("many different letters stand here") == pytest.approx(langid.Encoder(dim=64).vector("many different letters stand here"),
         abs=1e-5)


def test_pipeline_stages(spark, sf, docs):
    import corpus_pipeline

    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == corpus_pipeline.COLUMNS
    once = corpus_pipeline.drop_near_copies(spark, docs, sf)
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert {r.doc_id for r in once.collect()} == set(groups.values())
    masked = dict(corpus_pipeline.mask_personal_data(spark, docs, sf).select("doc_id", "text").collect())
    assert all(not slow_base(t) for t in masked.values())
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, sf).collect())
    assert mixed == collections.Counter({r.doc_id: r.copies for r in queries.QUERIES["op8_mixing"](spark, sf).collect() if r.copies})
    assert isinstance(docs.schema, StructType)
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_one_row_of_each_group_stays(spark, docs):
    import corpus_pipeline

    a, b, c, d = ("".join(f"{x}{i} " for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, a), (2, a), (2, b), (None, a), (3, c), (None, c), (None, d), (None, d), (4, None), (None, ""), (4, "")]
    table = spark.createDataFrame([(i, t, "en", "src1", 1) for i, t in rows], DOCS).repartition(3)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect())
    assert sum(got.values()) == 5
    assert all(got[x] == 1 for x in [(1, a), (2, b), (3, c), (None, d)]) and got[4, None] + got[4, ""] == 1
    twice = corpus_pipeline.drop_near_copies(spark, docs.union(docs), "").groupBy("doc_id").count().collect()
    assert collections.Counter({r.doc_id: r["count"] for r in twice}) == collections.Counter(dict.fromkeys({r.component_id
        for r in simhash.near_groups(docs).collect()}, 1))


@pytest.mark.parametrize("lengths", [lambda rnd: 600, lambda rnd: rnd.integers(520, 1000), lambda rnd: rnd.integers(1, 3000),
     lambda rnd: 1024, lambda rnd: 341], ids=["600", "520-999", "1-2999", "1024", "341"])
def test_packing_window_is_bounded(lengths):
    """No lengths let a window grow, and nothing is padded or lost."""
    rnd, packer, seen, fill = np.random.default_rng(5), packing.Packer(0, 1024, 512), collections.Counter(), collections.Counter()
    want = {doc: int(lengths(rnd)) for doc in range(6000)}

    def take(rows):
        for doc, start, n, _, total, sequence, offset in rows:
            assert total == want[doc]
            assert offset == fill[sequence]
            seen[doc] += n
            fill[sequence] += n

    most = 0
    for doc, n in want.items():
        take(packer.add(doc, np.full(n, doc, "<u4")))
        most = max(most, packer.n)
        assert sum(map(len, packer.waiting.values())) == packer.n
        assert packer.more < 1024
    assert most <= 512
    take(packer.end())
    assert seen == want
    assert all(n == 1024 or n & n - 1 == 0 for n in fill.values())
    assert sum(n < 1024 for n in fill.values()) <= 10


def slow_language(texts, asked, dim=1024, seed=17):
    """Training and prediction letter by letter, without numpy's vectors."""
    letters = {}

    def letter(c):
        if c not in letters:
            letters[c] = [int(x) * 2 - 1 for x in np.random.default_rng([seed, ord(c)]).integers(0, 2, dim, np.int8)]
        return letters[c]

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else None

    def vector(text):
        words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
        said = " " + " ".join(words) + " " if words else ""
        total = [0] * dim
        for x, y, z in zip(said, said[1:], said[2:], strict=False):
            a, b, c = letter(x), letter(y), letter(z)
            for i in range(dim):
                total[i] += a[i - 2] * b[i - 1] * c[i]
        return unit(total)

    sums = {}
    for lang, text in texts:
        v = vector(text)
        if v and lang:
            sums[lang] = [p + q for p, q in zip(sums.get(lang, [0] * dim), v, strict=True)]
    langs = sorted(sums)
    units = [unit(sums[x]) for x in langs]
    mean = [sum(c) / len(units) for c in zip(*units, strict=True)]
    prototypes = [unit([p - m for p, m in zip(u, mean, strict=True)]) for u in units]
    out = {}
    for i, text in asked:
        v = vector(text)
        cosines = [sum(p * q for p, q in zip(u, v, strict=True)) for u in prototypes] if v else []
        best = max(range(len(cosines)), key=lambda j: cosines[j]) if cosines else None
        out[i] = ("und", 0.0) if best is None else (langs[best], (1 + cosines[best]) / 2)
    return out


def test_language_against_plain_version(spark, docs):
    some = docs.limit(60).select("doc_id", F.substring("text", 1, 150).alias("text"), "lang").union(spark.createDataFrame([(9001, None,
        "en"), (9002, "12 34!", "de"), (9003, "Ünïcode Straße ß ǅ İx", None), (9004, "", "fr"), (9005, "a", "en")],
         "doc_id long, text string, lang string"))
    rows = some.collect()
    langs, prototypes = langid.train(some)
    want = slow_language([(r.lang, r.text) for r in rows], [(r.doc_id, r.text) for r in rows])
    enc = langid.Encoder()
    for r in rows:
        v = enc.vector(r.text)
        cosines = prototypes @ v if v is not None else []
        got = ("und", 0.0) if v is None else (langs[int(np.argmax(cosines))], (1 + float(max(cosines))) / 2)
        assert got[1] == pytest.approx(want[r.doc_id][1], abs=1e-4), r
        near = sorted(cosines)[-2:] if v is not None else [0, 1]
        assert got[0] == want[r.doc_id][0] or near[1] - near[0] < 1e-4


# --- pipeline --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark, docs):
    """Documents with repeated rows, rows of one id with other texts, and rows without an id."""
    rows = [tuple(r) for r in docs.limit(120).collect()]
    rows += rows[:10] + [(rows[0][0], "another text of the first id", "en", "src1", 28), (None, "no id at all here", "en", "src2",
         17), (None, "no id at all here", "en", "src2", 17), (None, None, None, None, None), (7001, "", "de", "src3", 0)]
    return spark.createDataFrame(rows, docs.schema)


def counted(df):
    import corpus_pipeline

    return collections.Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


def test_stage_toxicity(spark, sf, mixed):
    import corpus_pipeline

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(mixed, labels)
    score = lambda t: sum(model.weights.get(f, 0) * math.log1p(n) for f, n in collections.Counter(f for w in toxicity.words(t)
        for f in toxicity.word_features(w)).items())
    want = collections.Counter({r: n for r, n in counted(mixed).items() if not model.thresholds or score(r[1]) <= model.thresholds[0]})
    assert counted(corpus_pipeline.drop_toxic(spark, mixed, sf)) == want


def test_stage_simhash(spark, sf, mixed):
    import corpus_pipeline

    rows = sorted(counted(mixed).elements(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    fps = [slow_fingerprint(r[1]) for r in rows]
    label = slow_links(fps)
    got = counted(corpus_pipeline.drop_near_copies(spark, mixed, sf))
    groups = collections.defaultdict(list)
    for r, x in zip(rows, label, strict=True):
        groups[x].append(r)
    assert got.total() == len(groups)
    for own in groups.values():
        least = [r for r in own if r[0] == own[0][0]]
        assert sum(got[r] for r in set(least)) == 1


def test_stage_pii(spark, sf, mixed):
    import corpus_pipeline

    model = pii.train(mixed)
    want = collections.Counter()
    for r, n in counted(mixed).items():
        text = None if r[1] is None else pii.redact(r[1], pii.all_spans(r[1], model)[1])
        want[(r[0], text, r[2], r[3], None if text is None else len(text))] += n
    assert counted(corpus_pipeline.mask_personal_data(spark, mixed, sf)) == want


def test_stage_mixing(spark, sf, mixed):
    import corpus_pipeline

    rows = mixed.withColumn("row", F.monotonically_increasing_id())
    taken = mixing.mix(rows, mixing.domain_of(F.col("source")), keys=("row",)).select("row", "copies")
    want = collections.Counter()
    for r in rows.join(taken, "row").collect():
        want[tuple(r[c] for c in corpus_pipeline.COLUMNS)] += r.copies
    assert counted(corpus_pipeline.mix_sources(spark, mixed, sf)) == +want


def test_stage_packing(spark, sf, mixed):
    import corpus_pipeline

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = corpus_pipeline.pack(spark, mixed, sf).collect()
    want = collections.Counter()
    for r, n in counted(mixed).items():
        want[r[0]] += n * (len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    got, fill = collections.Counter(), collections.defaultdict(list)
    for p in pieces:
        got[p.doc_id] += p.length
        fill[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for parts in fill.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1]
        assert ends[-1] & ends[-1] - 1 == 0 and ends[-1] <= 1024


def test_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline

    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, sf)
    assert sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) == sum(r.length for r in docs_.collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "pii", "mixing", "packing"]
