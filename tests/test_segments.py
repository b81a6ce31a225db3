"""Learned sentence boundaries against a plain version, and by planted sentences."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholia.functions import align
from scholia.operators import segments

SHORT = ["abt", "corr", "dept", "esp", "incl", "max", "obs", "temp"]  # none is in the list of `align`


def planted(seed, n=400):
    """(texts, sentences of each): made of made-up words, names, and abbreviations before names, numbers and small words; one in
    six ends its sentence."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "ru", "ten", "sho", "ba"]) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    starts = ["The", "This", "However", "It", "We", "There", "These"]
    names = ["Karo", "Lumi", "Tensho"]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(2, 7)):
            words = [rng.choice(starts)] + [rng.choice(vocabulary) for _ in range(rng.randrange(3, 9))]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(1, len(words))
                words[at:at] = [rng.choice(SHORT) + ".", rng.choice([rng.choice(names), str(rng.randrange(99)), rng.choice(vocabulary)])]
            end = rng.choice(SHORT) + "." if rng.random() < 1 / 6 else rng.choice(vocabulary) + rng.choice([".", ".", ".", "?", "!"])
            out.append(" ".join(words + [end]))
        texts.append(out)
    return texts


def plain_model(texts):
    words = []
    for t in texts:
        ws = [re.sub(f"^{segments._OPENS}|{segments._CLOSES}$", "", w) for w in re.findall(align.WORD, t or "")]
        words += [(w, ws[i - 1] if i else None, ws[i + 1] if i + 1 < len(ws) else None) for i, w in enumerate(ws)]
    type_ = lambda w: re.sub(r"\.$", "", w).lower() if w and re.search(f"[{segments.SMALL}{segments.CAPITAL}]", w) else None
    capital = lambda w: bool(w and re.match(f"[{segments.CAPITAL}]", w))
    n, stop, small, mid = Counter(), Counter(), Counter(), Counter()
    for w, b, _ in words:
        if t := type_(w):
            n[t] += 1
            stop[t] += w.endswith(".")
            small[t] += not capital(w)
            mid[t] += capital(w) and b is not None and not re.search("[.!?:]$", b)
    total, stops = sum(n.values()), sum(stop.values())
    short = {}
    for t in n:
        k, rest, letters, p = stop[t], n[t] - stop[t], len(t.replace(".", "")), stops / total
        if k and letters and p < 1:
            ratio = -2 * (k * math.log(p) + rest * math.log(1 - p) - k * math.log(0.99) - rest * math.log(0.01))
            short[t] = ratio * math.exp(-letters) * (len(t) - letters + 1) * letters**-rest
    short = {t: s for t, s in short.items() if s >= segments.ABBREVIATION}

    def likelihood(a, b, both):
        ll = lambda k, m, p: (k * math.log(p) if k else 0) + ((m - k) * math.log(1 - p) if m - k else 0)
        return 2 * (ll(both, a, both / a) + ll(b - both, total - a, (b - both) / (total - a)) - ll(both, a, b / total) - ll(b - both, total - a, b / total))

    first = Counter(type_(x) for w, _, x in words if w.endswith(".") and capital(x) and type_(w) and len(type_(w)) > 1 and type_(w) not in short)
    ends = sum(first.values())
    starters = {t for t, k in first.items() if n[t] / total < k / ends and likelihood(ends, n[t], k) >= segments.STARTER}
    pairs = Counter((type_(w), type_(x)) for w, _, x in words if w.endswith(".") and type_(w) in short and type_(x))
    together = {(t, x) for (t, x), k in pairs.items() if k / n[t] > n[x] / total and likelihood(n[t], n[x], k) >= segments.COLLOCATION}
    decide = lambda w, x: capital(x) and (type_(w), type_(x)) not in together and (type_(x) in starters or small[type_(x)] > 0 and mid[type_(x)] == 0)
    return {t: (n[t], stop[t], small[t], mid[t]) for t in n}, short, starters, together, decide


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [" ".join(x) for x in planted(4)] + [None, "", " ... ", "[1] (see). “Alone.”", "A. B. C.", "x " * 3000]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_model_plain(corpus):
    texts, df = corpus
    types, short, starters, together, decide = plain_model(texts)
    model = segments.learn(df, ["doc_id"])
    assert {r.type: tuple(r)[1:] for r in model.types.collect()} == types
    assert {r.type: round(r.score, 6) for r in model.abbreviations.collect()} == {t: round(s, 6) for t, s in short.items()}
    assert {r.type for r in model.starters.collect()} == starters
    assert {(r.type, r.after) for r in model.collocations.collect()} == together
    assert set(SHORT) <= set(short) and "the" in starters
    bare = {(r.doc_id, r.k): (r.word, r.after) for r in segments.word_rows(df, ["doc_id"]).collect()}
    got = segments.decided(df, ["doc_id"], model).collect()
    assert len(got) > 200 and all(r.ends == decide(*bare[r.doc_id, r.k]) for r in got)
    assert {r.ends for r in got} == {True, False}


def boundaries(parts):
    at, out = 0, set()
    for p in parts[:-1]:
        out.add(at := at + len(p.split()))
    return out


def f1(want, got):
    hit = sum(len(w & g) for w, g in zip(want, got, strict=True))
    return 2 * hit / max(1, sum(map(len, want)) + sum(map(len, got)))


def test_planted_boundaries(spark):
    """The model is learned from some texts and used on others."""
    seen, held = planted(7, 600), planted(8, 150)
    model = segments.learn(spark.createDataFrame([(" ".join(x), i) for i, x in enumerate(seen)], "text string, doc_id long"), ["doc_id"])
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(held)], "doc_id long, text string")
    found = {r.doc_id: [y.sentence for y in sorted(r.x)] for r in segments.sentences(df, ["doc_id"], model).groupBy("doc_id").agg(F.collect_list(F.struct("k", "sentence")).alias("x")).collect()}
    want = [boundaries(x) for x in held]
    learned = f1(want, [boundaries(found[i]) for i in range(len(held))])
    listed = f1(want, [boundaries(align.split_sentences(" ".join(x))) for x in held])
    assert learned > 0.97 > listed, (learned, listed)
    assert all(" ".join(found[i]) == " ".join(x) for i, x in enumerate(held))


def test_sentences_defined_results(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert segments.sentences(none, ["doc_id"], segments.learn(none, ["doc_id"])).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (3, "One. Two")], "doc_id long, text string")
    assert sorted(tuple(r) for r in segments.sentences(df, ["doc_id"], segments.learn(df, ["doc_id"])).collect()) == [(3, 0, "One."), (3, 1, "Two")]
    assert align.split_sentences("word. " + "[1] " * 20_000 + "Then. It ends here.")[-1] == "It ends here."  # in linear time
