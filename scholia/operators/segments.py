"""Sentence boundaries learned from the texts themselves, without labels, after Kiss and Strunk (2006).

A full stop ends a sentence or marks an abbreviation. Log-likelihood ratios over counts of the whole corpus tell which words
are abbreviations (they hardly ever stand without a stop, and are short), which words start sentences (more often after a sure
end than elsewhere), and which words follow an abbreviation within a sentence. All counts are aggregates by word, and what
is learned are tables, joined and never collected. After an abbreviation a sentence ends only where the next word is capital
and either a known starter, or a word that is else written small within sentences.

texts have key columns that name a text (`keys`) and text. Null and empty texts have no words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.align import WORD, learned_sentences_udf
from scholia.sources.stored import stored

#: Fixed values of the method: the least score of an abbreviation, the least ratios of a starter and of a collocation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
SMALL, CAPITAL = "a-zß-öø-ÿ", "A-ZÀ-ÖØ-Þ"
_OPENS, _CLOSES = "[\"“‘'(\\[]+", "[\"”’')\\]]+"
_OPEN_SIGNS, _CLOSE_SIGNS = "\"“‘'([", "\"”’')]"


@dataclass(frozen=True)
class Model:
    """What the corpus taught: types (type, n, n_stop, n_small, n_capital), abbreviations (type, score), starters (type, ratio),
    collocations (type, after, ratio)."""

    types: DataFrame
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def word_rows(texts: DataFrame, keys: list[str], stops: bool = False) -> DataFrame:
    """(*keys, k, word, before, after): the words of texts from 0, without quotes and brackets around them, beside their
    neighbours; or only those with a stop that another word follows."""
    bare = lambda w: F.rtrim(F.ltrim(w, F.lit(_OPEN_SIGNS)), F.lit(_CLOSE_SIGNS))
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(0)), bare)
    row = lambda ws, w, i: F.struct(i.alias("k"), w.alias("word"), F.get(ws, i - 1).alias("before"), F.get(ws, i + 1).alias("after"))
    asked = lambda ws, w, i: F.when(w.endswith(".") & (i + 1 < F.size(ws)), row(ws, w, i)) if stops else row(ws, w, i)
    rows = F.transform(F.array(found), lambda ws: F.transform(ws, lambda w, i: asked(ws, w, i)))
    out = texts.select(*keys, F.explode(rows[0]).alias("x")).filter("x is not null")
    return out.select(*keys, F.col("x.k").cast("long").alias("k"), "x.word", "x.before", "x.after")


def word_counts(words: DataFrame) -> DataFrame:
    """(word, inside, after, n): how often a word stands, whether within a sentence (not after a stop, and not first), and
    before which word, where it has a stop. All that is learned is sums of these, so that patterns look at each once."""
    stopped = reduce(lambda x, y: x | y, [F.col("before").endswith(c) for c in ".!?:"])
    after = F.when(F.col("word").endswith("."), F.col("after"))
    return words.groupBy("word", F.coalesce(~stopped, F.lit(False)).alias("inside"), after.alias("after")).agg(F.count("*").alias("n"))


def type_of(word: Column) -> Column:
    """A word in small letters without one stop at its end; null where there is no letter in it."""
    return F.when(word.rlike(f"[{SMALL}{CAPITAL}]"), F.lower(F.regexp_replace(word, r"\.$", "")))


def capital(word: Column) -> Column:
    return F.coalesce(word.rlike(f"^[{CAPITAL}]"), F.lit(False))


def type_counts(counts: DataFrame) -> DataFrame:
    """(type, n, n_stop, n_small, n_capital) of `word_counts`: how often a type stands, with a stop, in small letters, and capital
    within a sentence."""
    word = F.col("word")
    each = counts.groupBy("word").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("inside"))
    typed = each.select(type_of(word).alias("type"), "n", "inside", word.endswith(".").alias("stop"), capital(word).alias("capital"))
    of = lambda where, n: F.sum(F.when(where, F.col(n)).otherwise(0))
    return typed.filter("type is not null").groupBy("type").agg(F.sum("n").alias("n"), of(F.col("stop"), "n").alias("n_stop"),
        of(~F.col("capital"), "n").alias("n_small"), of(F.col("capital"), "inside").alias("n_capital"))


def followed(counts: DataFrame) -> DataFrame:
    """(type, after, capital, n) of `word_counts`: the types with a stop, the types after them, and whether these are capital."""
    pairs = counts.filter("after is not null").groupBy("word", "after").agg(F.sum("n").alias("n"))
    return pairs.select(type_of(F.col("word")).alias("type"), type_of(F.col("after")).alias("after"), capital(F.col("after")).alias("capital"), "n").filter("after is not null")


def abbreviations(types: DataFrame) -> DataFrame:
    """(type, score) of the types whose stop belongs to them."""
    total = F.broadcast(types.agg(F.sum("n_stop").alias("stops"), F.sum("n").alias("words")))  # one row
    p, with_, without = F.col("stops") / F.col("words"), F.col("n_stop"), F.col("n") - F.col("n_stop")
    ratio = -2 * ((with_ * F.log(p) + without * F.log(1 - p)) - (with_ * F.log(F.lit(0.99)) + without * F.log(F.lit(0.01))))
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    score = ratio * F.exp(-letters.cast("double")) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -without.cast("double"))
    rows = types.filter((F.col("n_stop") > 0) & (letters > 0)).join(total).filter("stops < words")
    return rows.select("type", score.alias("score")).filter(F.col("score") >= ABBREVIATION)


def likelihood(a: Column, b: Column, both: Column, n: Column) -> Column:
    """The log-likelihood ratio of two events that happen a and b times among n and `both` times together: how much better
    b's shares with and without a explain the counts than one share does."""

    def part(k: Column, of: Column, p: Column) -> Column:
        term = lambda x, q: F.when(x > 0, x * F.log(q)).otherwise(0.0)
        return term(k, p) + term(of - k, 1 - p)

    a, b, both, n = (x.cast("double") for x in (a, b, both, n))
    alone = F.when(n > a, (b - both) / (n - a)).otherwise(0.0)
    return 2 * (part(both, a, both / a) + part(b - both, n - a, alone) - part(both, a, b / n) - part(b - both, n - a, b / n))


def starters(pairs: DataFrame, types: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """(type, ratio) of the types that by `followed` stand, capital, after a sure end of a sentence (a stop after a word of two letters or more
    that is no abbreviation) more often than anywhere."""
    sure = pairs.filter(F.col("capital") & (F.length("type") > 1)).join(abbreviated, "type", "left_anti")
    first = sure.groupBy(F.col("after").alias("type")).agg(F.sum("n").alias("first"))
    first = stored(first)
    total = F.broadcast(types.agg(F.sum("n").alias("words")).join(first.agg(F.sum("first").alias("ends"))))  # one row
    rows = first.join(types.select("type", "n"), "type").join(total)
    ratio = likelihood(F.col("ends"), F.col("n"), F.col("first"), F.col("words"))
    return rows.filter(F.col("n") / F.col("words") < F.col("first") / F.col("ends")).select("type", ratio.alias("ratio")).filter(F.col("ratio") >= STARTER)


def collocations(pairs: DataFrame, types: DataFrame, abbreviated: DataFrame) -> DataFrame:
    """(type, after, ratio): abbreviations and the types that by `followed` stand after their stop more often than chance has it."""
    pairs = pairs.join(abbreviated, "type", "left_semi").groupBy("type", "after").agg(F.sum("n").alias("both"))
    of = lambda name, as_: types.select(F.col("type").alias(name), F.col("n").alias(as_))
    total = F.broadcast(types.agg(F.sum("n").alias("words")))  # one row
    counted = pairs.join(of("type", "a"), "type").join(of("after", "b"), "after").join(total)
    ratio = likelihood(F.col("a"), F.col("b"), F.col("both"), F.col("words"))
    return counted.filter(F.col("both") / F.col("a") > F.col("b") / F.col("words")).select("type", "after", ratio.alias("ratio")).filter(F.col("ratio") >= COLLOCATION)


def learn(texts: DataFrame, keys: list[str]) -> Model:
    """The model of all texts. Words are made and counted once; only counts are stored."""
    counts = stored(word_counts(word_rows(texts, keys)))
    types, pairs = stored(type_counts(counts)), stored(followed(counts))
    short = stored(abbreviations(types))
    return Model(types, short, stored(starters(pairs, types, short)), stored(collocations(pairs, types, short)))


def decided(texts: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """(*keys, k, type, after, ends): each word with an abbreviation's stop that another follows, and whether a sentence ends
    with it all the same."""
    word, after = F.col("word"), F.col("after")
    rows = word_rows(texts, keys, stops=True).select(*keys, "k", type_of(word).alias("type"), type_of(after).alias("after"), capital(after).alias("capital"))
    rows = rows.join(model.abbreviations.select("type"), "type")
    rows = rows.join(model.starters.select(F.col("type").alias("after"), F.lit(True).alias("starter")), "after", "left")
    rows = rows.join(model.collocations.select("type", "after", F.lit(True).alias("together")), ["type", "after"], "left")
    small = (F.col("n_small") > 0) & (F.col("n_capital") == 0)
    rows = rows.join(model.types.select(F.col("type").alias("after"), small.alias("small")), "after", "left")
    no = F.lit(False)
    ends = F.col("capital") & F.col("together").isNull() & (F.coalesce("starter", no) | F.coalesce("small", no))
    return rows.select(*keys, "k", "type", "after", ends.alias("ends"))


def sentences(texts: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """(*keys, k, sentence): the sentences of texts by the rules of `align.split_sentences`, where what the model decides of its
    abbreviations goes before them. Each of keys' combinations is one text."""
    marks = decided(texts, keys, model).groupBy(*keys).agg(F.collect_list(F.when(F.col("ends"), F.col("k"))).alias("yes"), F.collect_list(F.when(~F.col("ends"), F.col("k"))).alias("no"))
    none = F.array().cast("array<bigint>")
    rows = texts.select(*keys, "text").join(marks, keys, "left")
    return rows.select(*keys, F.posexplode(learned_sentences_udf("text", F.coalesce("yes", none), F.coalesce("no", none)))).select(*keys, F.col("pos").cast("long").alias("k"), F.col("col").alias("sentence"))
