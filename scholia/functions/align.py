"""Functions whose algorithms are sequential, as vectorised UDFs: sentence alignment, sentence splitting, compatibility forms."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

GRADES = ("ng", "near", "ok")
#: Words after which a full stop doesn't end a sentence, and units that may end one after a number.
SHORT = frozenset("e.g. i.e. et al. etc. vs. cf. Dr. Mr. Ms. Mrs. Prof. Fig. Figs. Eq. Eqs. Ref. Refs. Sec. Secs. Tab. No. Vol. pp. approx.".split())
UNIT_ENDS = frozenset("K V Hz nm mm cm μm µm kHz MHz s h W mW %".split())
#: Words of a citation in brackets, however many spaces it has inside; what may close a sentence after its stop.
WORD = r"\[[0-9][0-9 \t\n\r\f,–-]*\]|[^ \t\n\r\f]+"
_WORDS, _NUMBERS, _CLOSING = re.compile(WORD), re.compile(r"\[\d+(?:\s*[,–-]\s*\d+)*\]"), "\"”’')]"
_MAY_END, _NONE = frozenset(".!?" + _CLOSING), frozenset()


def _ends(word: str, before: str, after: str) -> bool:
    """Whether a sentence ends at a word, by the words around it."""
    bare = word.rstrip(_CLOSING)
    if not bare.endswith((".", "!", "?")) or bare in SHORT or re.match(r"\([a-z]\)", after):
        return False
    first = after.lstrip("(\"“‘'")[:1]
    if not (first.isupper() or after[:1] in "(\"“" and first.isdigit()):
        return False
    lone = bare[:-1]  # an initial ends a sentence only where it is a unit after a number, and a word follows
    number = re.fullmatch(r"\D*\d[\d.,]*(\D+)", lone)
    unit = number[1] in UNIT_ENDS if number else lone in UNIT_ENDS and before[-1:].isdigit()
    return not (len(lone) == 1 and lone.isupper()) or unit and after[1:2].islower()


def split_sentences(text: str | None, yes: frozenset[int] = frozenset(), no: frozenset[int] = frozenset()) -> list[str]:
    """Sentences by rule, word by word. A citation in brackets after a sentence's stop belongs to that sentence; what has
    fewer than three letters and digits is no sentence of its own. Of the words numbered in yes and no it is known already
    whether a sentence ends with them."""
    words = _WORDS.findall(text or "")
    starts = [0]
    at, last, signs, seen = 0, -2, 0, 0  # the word that citations follow; the last citation; letters and digits of the sentence's words so far
    for i in [i for i, w in enumerate(words[:-1]) if w[-1] in _MAY_END or i in yes]:  # the words that a sentence may end with, all citations among them
        w, after = words[i], words[i + 1]
        if w[0] == "[" and _NUMBERS.fullmatch(w):
            at, last = (at if last == i - 1 else i - 1) if i else 0, i
        else:
            at = i
        while signs < 3 and seen <= i:
            signs += sum(map(str.isalnum, words[seen]))
            seen += 1
        if signs < 3 or after[0] == "[" and _NUMBERS.fullmatch(after):
            continue
        if at in yes or at not in no and _ends(words[at], words[at - 1] if at else "", after):
            starts.append(i + 1)
            signs, seen = 0, i + 1
    found = [" ".join(words[a:b]) for a, b in zip(starts, [*starts[1:], len(words)], strict=True) if b]
    if len(found) > 1 and sum(map(str.isalnum, found[-1])) < 3:
        found[-2:] = [" ".join(found[-2:])]
    return found


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether at most `most` single-letter edits turn a into b. Equal ends go first, then a band of the table is enough."""
    if abs(len(a) - len(b)) > most:
        return False
    cut = len(a) // (most + 1)  # of most + 1 parts of a, one stands in b as it is
    if not (b.startswith(a[:cut]) or b.endswith(a[-cut:] if most > 1 else a[cut:]) or most > 1 and a[cut : len(a) - cut] in b):
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b) <= most
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = i if j == 0 else min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (x != b[j - 1]))
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), 99) <= most


#: Fixed value: a word as it is shown: ASCII letters, with apostrophes and hyphens inside.
SHOWN = re.compile(r"[A-Za-z](?:[A-Za-z'’-]*[A-Za-z])?")
#: Endings that leave another form of the same word, and what stands for them.
OTHER_FORMS = [("ies", "y"), ("es", ""), ("s", ""), ("ied", "y"), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e")]


def forms(word: str) -> set[str]:
    """A word and it without plural, past and -ing endings, as `text.stems` has them."""
    found = {word}
    for suffix, put in OTHER_FORMS:
        stem = word.removesuffix(suffix)
        if stem == word or suffix == "s" and word.endswith("ss"):
            continue
        found |= {x for x in (stem + put, stem[:-1] if suffix in ("ed", "ing") and len(stem) > 2 and stem[-1] == stem[-2] else "") if len(x) >= 2}
    return found


def same_case(word: str) -> str:
    return word.strip().replace("’", "'").lower()


def grades(answers: list[str], typed: list[str]) -> np.ndarray:
    """How each typed word answers each word asked for, as places in GRADES: ok, near (another form, or one edit, two from
    eight letters on) or ng. Forms are looked up by form; edits are counted only where lengths allow them."""
    a, b = [same_case(x) for x in answers], [same_case(x) for x in typed]
    out = np.zeros((len(a), len(b)), np.int8)
    by_form, by_length = defaultdict(list), defaultdict(list)
    for j, t in enumerate(b):
        by_length[len(t)].append(j)
        for f in forms(t) if t else ():
            by_form[f].append(j)
    for i, x in enumerate(a):
        most = 2 if len(x) >= 8 else 1
        for n in range(max(1, len(x) - most), len(x) + most + 1):
            out[i, [j for j in by_length[n] if edits_within(x, b[j], most)]] = 1
        for f in forms(x):
            out[i, by_form[f]] = 1
        out[i, [j for j in by_length[len(x)] if x and b[j] == x]] = 2
    return out


def word_grade(typed: str, answer: str) -> str:
    return GRADES[grades([answer], [typed])[0, 0]]


def sentence_grade(original: str | None, typed: str | None) -> tuple[list[str], list[str], float]:
    """The grade of each word of the original, by a longest common subsequence with fuzzy equality; the words typed beside it;
    and the score: the mean of 1 for ok and 0.5 for near, 0 for an original without words."""
    a, b = SHOWN.findall(original or ""), SHOWN.findall(typed or "")
    left, row_of = np.unique(a, return_inverse=True)
    right, column_of = np.unique(b, return_inverse=True)
    table = grades(left.tolist(), right.tolist())[row_of][:, column_of] if a and b else np.zeros((len(a), len(b)), np.int8)
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):  # a row at once: the best of the row below, a match, and what stands to the right
        best[i, :-1] = np.maximum.accumulate(np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (table[i] > 0))[::-1])[::-1]
    marks, extra, j = [], [], 0
    for i in range(len(a)):
        while j < len(b) and not table[i, j] and best[i + 1, j] < best[i, j + 1]:
            extra.append(b[j])
            j += 1
        hit = j < len(b) and table[i, j] > 0
        marks.append(GRADES[table[i, j]] if hit else "ng")
        j += hit
    return marks, extra + b[j:], (marks.count("ok") + marks.count("near") / 2) / len(marks) if marks else 0.0


@F.pandas_udf(ArrayType(StringType()))
def sentences_udf(text: pd.Series) -> pd.Series:
    return text.map(split_sentences)


@F.pandas_udf(ArrayType(StringType()))
def learned_sentences_udf(text: pd.Series, yes: pd.Series, no: pd.Series) -> pd.Series:
    known = lambda ks: frozenset(ks) if len(ks) else _NONE
    return pd.Series([split_sentences(t, known(y), known(n)) for t, y, n in zip(text, yes, no, strict=True)])


@F.pandas_udf(StructType([StructField("grades", ArrayType(StringType())), StructField("extra", ArrayType(StringType())),
     StructField("score", DoubleType())]))
def sentence_grade_udf(original: pd.Series, typed: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sentence_grade(a, b) for a, b in zip(original, typed, strict=True)], columns=["grades", "extra", "score"])


@F.pandas_udf(StringType())
def nfkc_udf(text: pd.Series) -> pd.Series:
    """Compatibility forms as plain characters (ligatures, full-width letters); raised and lowered digits stay."""
    return text.map(lambda t: None if t is None else re.sub(r"[^\u00b2\u00b3\u00b9\u2070-\u209c]+", lambda m: unicodedata.normalize("NFKC", m[0]), t))
