"""A training corpus from `documents`: toxic documents go, one of each group of near copies stays, personal data is masked,
sources are mixed to their target weights, and what is left is packed into sequences.

A stage gets the documents that the last one kept, re-read from Parquet, and returns those that it keeps (the last one:
the pieces of the sequences). Of near copies one row stays, whether or not the rows have ids of their own; what becomes of
nulls, empty texts and repeated rows stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm import mixing, packing, pii, simhash, toxicity
from scholia.llm.common import new_folder, prepare, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents, and row, a number of its own for each row. Rows are stored with their numbers, so that all
    readings of them agree."""
    docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")).write.parquet(path := new_folder(spark, "rows"))
    return spark.read.parquet(path)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that op3's model, learned from the labels, doesn't find toxic. Null and empty texts stay, and all rows where
    there are no labels of both classes; of repeated rows all stay or go; further columns are left out."""
    prepare(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of op1's linked fingerprints one row stays: that with the smallest id, null ids last. Texts without
    words (null, empty) are copies of each other; of repeated rows one stays; further columns are left out."""
    prepare(spark)
    rows = numbered(spark, docs)
    return rows.join(simhash.first_rows(rows), "row", "left_semi").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with op7's spans masked in their texts and n_chars as the text then has it; null texts stay null."""
    prepare(spark)
    return pii.redact_pii(docs, pii.train(docs)).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as op8 takes it: by its leaf's epochs and prefix. Rows of one id are each decided on by themselves,
    rows without an id as well; further columns are left out."""
    rows = numbered(spark, docs)
    taken = mixing.mix(rows, mixing.domain_of(F.col("source")), keys=("row",)).filter("copies > 0").select("row", "copies")
    return rows.join(taken, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op4's pieces of all rows. A null or empty text is its end id alone; repeated rows, copies of an epoch among them, are
    packed each."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("packing", pack)]
#: The stages learn models and order by hashes: SQL can't express them. Tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of `documents`. An empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := new_folder(spark, name))
        docs = spark.read.parquet(path)
    return docs
