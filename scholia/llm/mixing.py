"""Mixing sources to target weights, by DataFrame expressions only.

Weights sit on a tree of domains, languages and sources. The budget goes down from the root: the children of a node share
what it got by weight, none gets more than its subtree can give (its tokens times the epochs allowed), and what a full
child can't take goes to its siblings by weight. So a shortage passes to siblings first, and reaches the parent's siblings
only where a whole subtree is short. A leaf repeats its documents for whole epochs, then takes a prefix of the documents
in an order seeded by the epoch, as long as the tokens fit.

The order within a leaf is never built: documents fall into bins by two hex digits of a hash of their id, the bin that the
cut falls in is divided again, and only what stands in a bin of the last level is ordered. Rows of one id (or of none) share
that hash; where the cut falls among them, they are dealt with in the same way by a hash of their own keys or number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import cut, table

LEAF = ["domain", "lang", "source"]
SEED, EPOCHS, SHARE_PERCENT = 7, 2, 60
#: The hex digits that each level of bins uses of a row's place: 32 by its id, then those by the row. The last bins hold one row.
LEVELS = ((1, 2), (3, 2), (5, 28), (33, 3), (36, 100))


def default_weights(leaves: DataFrame) -> DataFrame:
    """The query's weights: domains by number, English threefold, sources by the length of their name less 3, null and shorter
    names 1. All whole numbers above zero."""
    return leaves.select(
        *LEAF,
        (F.coalesce(F.regexp_extract("domain", r"([0-9]+)$", 1).try_cast("int"), F.lit(0)) + 1).cast("long").alias("w1"),
        F.when(F.col("lang") == "en", 3).otherwise(1).cast("long").alias("w2"),
        F.greatest(F.coalesce(F.length("source"), F.lit(0)) - 3, F.lit(1)).cast("long").alias("w3"),
    )


def tokens(text: Column) -> Column:
    """Words of a text: runs of other characters than white space; null and empty texts have none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda x: x != "")), F.lit(0)).cast("long")


def share(nodes: DataFrame, parent: list[str], weight: str, got: str, out: str) -> DataFrame:
    """Adds column `out`: of `got`, the parent's tokens, what each row gets by weight and capacity `cap`.

    Sorted by capacity for its weight, a row is full if what is left for it and all later ones would give it at least its
    capacity. The others share the rest, rounded down. Only whole numbers are used, so that every engine agrees.
    """
    w = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col(weight)).asc(), *[F.col(c).asc_nulls_first() for c in LEAF
        if c in nodes.columns and c not in parent])
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    used, weights = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.sum(weight).over(rest)
    big = "decimal(38,0)"
    nodes = nodes.withColumn("_left", F.greatest(F.col(got) - used, F.lit(0))).withColumn("_weights", weights)
    full = F.col("cap").cast(big) * F.col("_weights").cast(big) <= F.col("_left").cast(big) * F.col(weight).cast(big)
    nodes = nodes.withColumn("_full", full)
    # the first row that isn't full fixes the level for itself and all later ones
    each = Window.partitionBy(*parent)
    nodes = nodes.withColumn("_left", F.max(F.when(~F.col("_full"), F.col("_left"))).over(each)).withColumn("_weights",
        F.max(F.when(~F.col("_full"), F.col("_weights"))).over(each))
    part = F.floor(F.col("_left").cast(big) * F.col(weight).cast(big) / F.col("_weights").cast(big)).cast("long")
    return nodes.withColumn(out, F.when(F.col("_full"), F.col("cap")).otherwise(F.least(part, F.col("cap")))).drop("_left", "_weights", "_full")


def budgets(totals: DataFrame, weights: DataFrame, budget: Column, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, target) for each leaf of totals (domain, lang, source, tokens).

    weights has w1, w2, w3 for the domain, language and source of each leaf; one that is missing, null or not above zero
    gives its node nothing. A leaf without tokens gets nothing.
    """
    rows = totals.alias("t").join(weights.alias("x"), [F.col(f"t.{c}").eqNullSafe(F.col(f"x.{c}")) for c in LEAF],
        "left").select("t.*", "w1", "w2", "w3")
    rows = rows.withColumn("usable", F.coalesce((F.col("w1") > 0) & (F.col("w2") > 0) & (F.col("w3") > 0),
        F.lit(False))).withColumn("cap3", F.when(F.col("usable"), F.col("tokens") * epochs).otherwise(0)).withColumn("got0",
         budget.cast("long"))
    live = rows.filter("cap3 > 0")
    level1 = live.groupBy("domain", "got0").agg(F.sum("cap3").alias("cap"), F.max("w1").alias("w1"))
    level1 = share(level1.withColumn("root", F.lit(0)), ["root"], "w1", "got0", "got1").select("domain", "got1")
    level2 = live.groupBy("domain", "lang").agg(F.sum("cap3").alias("cap"), F.max("w2").alias("w2"))
    level2 = level2.join(level1, level2["domain"].eqNullSafe(level1["domain"])).select(level2["*"], "got1")
    level2 = share(level2, ["domain"], "w2", "got1", "got2").select("domain", "lang", "got2")
    level3 = live.join(level2, live["domain"].eqNullSafe(level2["domain"])
        & live["lang"].eqNullSafe(level2["lang"])).select(live["*"], "got2").withColumn("cap", F.col("cap3"))
    level3 = share(level3, ["domain", "lang"], "w3", "got2", "target").select(*LEAF, "target")
    return rows.alias("r").join(level3.alias("l"), [F.col(f"r.{c}").eqNullSafe(F.col(f"l.{c}")) for c in LEAF],
        "left").select("r.domain", "r.lang", "r.source", "r.tokens", F.coalesce("target", F.lit(0)).cast("long").alias("target"))


def mix(docs: DataFrame, domain: Column, weights=default_weights, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS,
    seed: int = SEED, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keys, domain, lang, source, tokens, copies): how often each row of docs is taken, 0 included.

    The budget is share_percent of all tokens. Documents without tokens are taken as often as whole epochs are. Null
    languages and sources form leaves of their own. The order is by a hash of the id, so of all rows of one id (those
    without an id count as such) all come before or after others; among themselves, whatever their tokens, by a hash of
    their keys, or where there are none by a number that each stored row gets; keys that don't tell rows apart leave these
    in the order of their numbers. So each row is taken by itself, and a leaf's target is met within one row. An empty table
    gives no rows. Texts are counted whole; columns other than doc_id, text, lang, source and keys, whatever their names,
    aren't read.
    """
    number = F.monotonically_increasing_id().alias("number_")
    narrow = cut(docs.select("doc_id", *keys, domain.alias("domain"), "lang", "source", tokens(F.col("text")).alias("tokens"), number))
    totals = cut(narrow.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")))
    budget = (totals.agg(F.sum("tokens")).first()[0] or 0) * share_percent // 100
    leaves = budgets(totals, weights(totals.select(*LEAF)), F.lit(budget), epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(0).cast("int")
    leaves = leaves.select(*LEAF, whole.alias("whole"), (F.col("target") - whole * F.col("tokens")).alias("part"),
        F.xxhash64(*LEAF, F.isnull("lang"), F.isnull("source"), F.isnull("domain")).alias("leaf"))
    leaves = cut(leaves)
    seeded = lambda *c: F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
    place = F.concat(F.md5(seeded("doc_id")), F.md5(seeded(*(keys or ["number_"]))), F.col("number_").cast("string"))
    rows = cut(narrow.withColumn("leaf", F.xxhash64(*LEAF, F.isnull("lang"), F.isnull("source"),
        F.isnull("domain"))).join(leaves.select("leaf", "whole", "part"), "leaf").withColumn("place", place))
    open_rows, parts = rows.filter("part > 0"), []
    names = ["doc_id", *keys, *LEAF, "tokens", "whole"]
    parts.append(rows.filter("part <= 0").select(*names, F.lit(0).alias("more")))
    for start, digits in LEVELS:
        binned = open_rows.withColumn("bin", F.substring("place", start, digits))
        sums = binned.groupBy("leaf", "bin").agg(F.sum("tokens").alias("n"), F.first("part").alias("part"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = cut(sums.select("leaf", "bin", "n", (F.col("part") - before).alias("left")))
        binned = binned.drop("part").join(sums, ["leaf", "bin"])
        parts.append(binned.filter("left >= n or left <= 0").select(*names, F.when(F.col("left") >= F.col("n"), 1).otherwise(0).alias("more")))
        open_rows = cut(binned.filter("left > 0 and left < n").withColumnRenamed("left", "part").withColumn("leaf",
            F.xxhash64("leaf", "bin")).drop("bin", "n"))
    parts.append(open_rows.select(*names, F.lit(0).alias("more")))  # single rows that are longer than what is left
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("doc_id", *keys, *LEAF, "tokens", (F.col("whole") + F.when(F.col("tokens") > 0,
        F.col("more")).otherwise(0)).cast("int").alias("copies"))


def domain_of(source: Column) -> Column:
    """The query's domains: four, by the number in the source's name."""
    return F.concat(F.lit("d"), F.coalesce(F.regexp_extract(source, r"([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 4)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken. Nulls, empty and long texts, ties and repeated rows, empty tables and further columns
    are as `mix` defines them."""
    return mix(table(spark, sf_dir, "documents"), domain_of(F.col("source")))


def _share_sql(parent: str, keys: str, weight: str, got: str, out: str, nodes: str) -> str:
    rows = f"""SELECT *, greatest({got} - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS l, sum({weight}) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {nodes} WINDOW w AS (PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST({weight} AS DOUBLE), {keys})"""
    full = "CAST(cap AS HUGEINT) * ws <= CAST(l AS HUGEINT) * " + weight
    return f"""SELECT *, CASE WHEN f THEN cap ELSE least(CAST((max(CASE WHEN NOT f THEN l END) OVER p) AS HUGEINT) * {weight} // max(CASE WHEN NOT f THEN ws END) OVER p, cap) END AS {out} FROM (SELECT *, {full} AS f FROM ({rows})) WINDOW p AS (PARTITION BY {parent})"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS number, 'd' || coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 4 AS domain, lang, source,
  coalesce(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')), 0) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens) AS tokens, {EPOCHS} * sum(tokens) AS cap3, CAST(substr(domain, 2) AS INT) + 1 AS w1, CASE WHEN lang = 'en' THEN 3 ELSE 1 END AS w2, length(source) - 3 AS w3 FROM d GROUP BY domain, lang, source),
live AS (SELECT *, (SELECT sum(tokens) * {SHARE_PERCENT} // 100 FROM leaves) AS got0 FROM leaves WHERE cap3 > 0 AND least(w1, w2, w3) > 0),
n1 AS (SELECT 0 AS root, domain, any_value(got0) AS got0, sum(cap3) AS cap, max(w1) AS w1 FROM live GROUP BY domain),
s1 AS ({_share_sql("root", "domain", "w1", "got0", "got1", "n1")}),
n2 AS (SELECT domain, lang, sum(cap3) AS cap, max(w2) AS w2, any_value(got1) AS got1 FROM live JOIN (SELECT domain, got1 FROM s1) USING (domain) GROUP BY domain, lang),
s2 AS ({_share_sql("domain", "lang", "w2", "got1", "got2", "n2")}),
n3 AS (SELECT domain, lang, source, tokens, cap3 AS cap, w3, got2 FROM live JOIN (SELECT domain, lang, got2 FROM s2) USING (domain, lang)),
s3 AS ({_share_sql("domain, lang", "source", "w3", "got2", "target", "n3")}),
t AS (SELECT domain, lang, source, CAST(target // tokens AS BIGINT) AS whole, CAST(target % tokens AS BIGINT) AS part FROM s3),
r AS (SELECT d.*, coalesce(whole, 0) AS whole, coalesce(part, 0) AS part FROM d LEFT JOIN t USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(whole + CASE WHEN tokens > 0 AND part > 0 AND sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), md5('{SEED}:' || whole || ':' || number), number) <= part THEN 1 ELSE 0 END AS INT) AS copies FROM r
"""
