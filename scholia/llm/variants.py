"""Grouping spelling variants: words that differ by one inserted, deleted or replaced code point, found by automata.

If two words differ by one error, then from the view of either one of its halves is untouched. So words meet twice: with
those of the same first letters in a minimal acyclic automaton of the words, with those of the same last letters in one of
the reversed words. In each a word's half is matched exactly and the rest completed with one error. Perfect-hash numbers
(a state knows how many words lead on from it, an edge how many it skips) name the word that a path spells. An error is
only made where it can't be made later, so that each path spells another word; of pairs that both directions can find the
backward one is dropped.

A group of words beyond a bound is dealt again: by the length of the shorter of two words, and by whether they differ in the
first or last half of what the group's key leaves open; then the other half is equal and joins the key. Dealt to the end,
a key leaves one place open, and the alphabet bounds the group. So it is exact for any number of words.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import cut, map_arrow, table
from scholia.llm.resample import crc32_sql

RUN, SHORTEST, LEAST, TIMES, ODD = r"[A-Za-z\u00C0-\u00FF]", 7, 2, 10, 31
#: Code points that words of a group share at first: half of the shortest word, less or more the odd one.
FIRST, LAST = SHORTEST // 2, SHORTEST - SHORTEST // 2
#: Words of a group from which it is dealt again.
MOST = 4_000
#: Beyond every place in a word.
FAR = 1 << 30

State = tuple[bool, int, dict]  # final, words from here on, edges: code point to (state, words before it)


def automaton(words: list[str]) -> State:
    """The minimal acyclic automaton of sorted distinct words. A word's number, its place among them, is the sum over its
    path of the words that each edge skips."""
    register: dict[tuple, State] = {}
    open_ = [[False, []]]  # the last word's states, not yet merged: final, edges

    def close(depth: int) -> None:
        """Merges the open states beyond depth with equal ones, deepest first."""
        while len(open_) > depth + 1:
            final, edges = open_.pop()
            open_[-1][1][-1][1] = freeze(final, edges)

    def freeze(final: bool, edges: list) -> State:
        key = (final, *((c, id(s)) for c, s in edges))
        if (state := register.get(key)) is None:
            count, out = int(final), {}
            for c, s in edges:
                out[c] = (s, count)
                count += s[1]
            state = register[key] = (final, count, out)
        return state

    last = ""
    for word in words:
        same = 0
        for a, b in zip(last, word):  # noqa: B905
            if a != b:
                break
            same += 1
        close(same)
        for c in word[same:]:
            open_[-1][1].append([c, None])
            open_.append([False, []])
        open_[-1][0] = True
        last = word
    close(0)
    return freeze(*open_[0])


def follow(state: State, number: int, word: str, at: int) -> int:
    """The number of the word that the rest of `word` from `at` leads to, or -1."""
    for c in word[at:]:
        if (edge := state[2].get(c)) is None:
            return -1
        state, number = edge[0], number + edge[1]
    return number if state[0] else -1


def one_error(root: State, word: str, exact: int) -> Iterator[tuple[int, int]]:
    """(place, number) of all words that are one error from `word`, made at or after `exact`; the automaton holds `word`. The
    place is the first one in which both differ, so none comes twice."""
    state, number = root, 0
    for at in range(len(word) + 1):
        here = word[at] if at < len(word) else None
        if at >= exact:
            if here is not None and word[at + 1 : at + 2] != here and (n := follow(state, number, word, at + 1)) >= 0:
                yield at, n
            for c, (child, skips) in state[2].items():
                if c != here:
                    if (n := follow(child, number + skips, word, at)) >= 0:
                        yield at, n
                    if here is not None and (n := follow(child, number + skips, word, at + 1)) >= 0:
                        yield at, n
        if here is not None:
            edge = state[2][here]
            state, number = edge[0], number + edge[1]


def search(words: list[str], n: list[int], forward: bool, shorter: int, low: int, high: int) -> Iterator[tuple[str, int, int, str]]:
    """For each word that has any: (word, near words, the largest n among them, the word that has it), of the pairs that are
    this group's: found in its direction, the first difference in [low, high), and the shorter of `shorter` code points, if
    that isn't 0."""
    if len(words) < 2:
        return
    spelt = words if forward else [w[::-1] for w in words]
    order = sorted(range(len(words)), key=spelt.__getitem__)
    root = automaton([spelt[i] for i in order])
    for i, word in enumerate(words):
        half, found, best, form = len(word) // 2, 0, 0, ""
        for at, number in one_error(root, spelt[i], half if forward else len(word) - half):
            other = words[j := order[number]]
            if not forward:
                if other[:half] == word[:half]:
                    continue  # the forward search finds it
                at = next(k for k in range(half) if word[k : k + 1] != other[k : k + 1])
            if low <= at < high and (not shorter or min(len(word), len(other)) == shorter):
                found += 1
                if n[j] > best or n[j] == best and other < form:
                    best, form = n[j], other
        if found:
            yield word, found, best, form


def spelled(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) of at least SHORTEST code points that occur at least LEAST times. Of a run in
    ODD, chosen by a hash of document and run, one code point is left out."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"{RUN}{{{SHORTEST},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id_"), F.explode(runs).alias("run"))
    run = run.select("id_", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    run = run.select("run", F.crc32(F.concat("id_", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = run.select(F.when(F.col("h") % ODD == 0, shorter).otherwise(F.col("run")).alias("word"))
    return word.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


KEY = ["forward", "shorter", "low", "high", "last"]


def keyed(rows: DataFrame) -> DataFrame:
    """rows with the key of their group: what pairs in it have in common, and the letters that its words share."""
    return rows.withColumn("key", F.concat_ws("|", *KEY, F.substring("word", F.lit(1), F.col("low")), F.expr("right(word, last)")))


def dealt(words: DataFrame, most: int = MOST) -> DataFrame:
    """words (word, n) in each of the groups where near words meet: word, n, key and KEY. A group has at most `most` words, or
    its words differ in one place only."""
    each = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(KEY, v, strict=True)])
    start = F.array(each(True, 0, FIRST, FAR, 0), each(False, 0, 0, FAR, LAST))
    rows = keyed(words.select("word", "n", F.explode(start).alias("x")).select("word", "n", "x.*"))
    out: DataFrame | None = None
    while True:
        rows = cut(rows)
        left = F.when(F.col("shorter") > 0, F.col("shorter") - F.col("last") - F.col("low")).otherwise(2)
        big = cut(rows.filter(left > 1).groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > most).select("key"))
        if big.isEmpty():
            return rows if out is None else out.unionByName(rows)
        small = rows.join(big, "key", "left_anti")
        out = small if out is None else out.unionByName(small)
        of = F.when(F.col("shorter") > 0, F.array("shorter")).otherwise(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda s: s >= SHORTEST))
        rows = rows.join(big, "key", "left_semi").drop("key").withColumn("shorter", F.explode(of))
        middle = F.col("low") + F.ceil((F.col("shorter") - F.col("last") - F.col("low")) / 2).cast("int")
        halves = F.array(
            F.struct("low", middle.alias("high"), (F.col("shorter") - middle).alias("last")),
            F.struct(middle.alias("low"), F.col("high"), F.col("last")),
        )
        rows = keyed(rows.select("word", "n", "forward", "shorter", F.explode(halves).alias("x")).select("word", "n", "forward", "shorter", "x.*"))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best): how many words (word, n) are near each one that has any, and which of them has the largest
    n, the first in code-point order of those that tie."""
    groups = dealt(words, most).select("key", "word", "n", *KEY[:4]).repartition("key").sortWithinPartitions("key")
    names = ["word", "found", "best_n", "best"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, of = None, [], ()

        def end() -> Iterator[pa.RecordBatch]:
            if found := list(search([w for w, _ in rows], [n for _, n in rows], *of)):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            for key, word, n, *x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    if rows:
                        yield from end()
                    last, rows, of = key, [], x
                rows.append((word, n))
        if rows:
            yield from end()

    found = map_arrow(groups, run, "word string, found long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("x")
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best).select("word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), followed to the last. Each round doubles the steps followed; a form has TIMES the n
    of its word, so there are few."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("on")), "root", "left")
        on = cut(on.select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        at = on.select("word", "root")
        if on.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs (doc_id, text).

    Null and empty texts have no words; a null id counts as the empty string where code points are left out; repeated rows
    count each; of near words with equal n the first in code-point order counts; an empty table gives no rows. Texts and
    words are whole, however long. Other columns are never read.
    """
    words = cut(spelled(docs))
    near = cut(near_words(words, most))
    rows = words.join(near, "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = cut(rows)
    last = roots(rows.filter("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with their near words and forms. Nulls, empty and long texts, ties, repeated rows, empty
    tables and further columns are as `variants` defines them."""
    return variants(table(spark, sf_dir, "documents"))


def _one_error_sql() -> str:
    """Pairs of words that are one code point apart: both without the code point at one place, or one of them so."""
    return """less AS MATERIALIZED (SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pairs AS (SELECT DISTINCT a, b FROM (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y USING (rest, i) WHERE x.word <> y.word AND x.l = y.l
  UNION ALL SELECT x.word, w.word FROM less x JOIN words w ON w.word = x.rest UNION ALL SELECT w.word, x.word FROM less x JOIN words w ON w.word = x.rest))"""


ORACLE = rf"""
WITH RECURSIVE runs AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{SHORTEST},}}')) AS run FROM documents),
each AS (SELECT d, translate(run, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run, count(*) AS n FROM runs GROUP BY 1, 2),
hashed AS MATERIALIZED (SELECT run, n, h, CAST(h % length(run) AS INT) AS k FROM (SELECT *, {crc32_sql("d || ':' || run")} AS h FROM each)),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % {ODD} = 0 THEN substr(run, 1, k) || substr(run, k + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
{_one_error_sql()},
near AS (SELECT a, count(*) AS n_near, max(n) AS top FROM pairs JOIN words ON word = b GROUP BY a),
best AS (SELECT p.a, min(p.b) AS form, any_value(top) AS form_n FROM pairs p JOIN words w ON w.word = p.b JOIN near USING (a) WHERE w.n = top GROUP BY p.a),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN near ON near.a = w.word LEFT JOIN best ON best.a = w.word),
steps AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT s.word, f.form, k + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM forms f JOIN (SELECT word, max_by(root, k) AS root FROM steps GROUP BY word) s USING (word)
"""
