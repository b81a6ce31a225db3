"""The functions under SQL names, and rules that are kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import align, text

#: Pronunciation rules of a user at most: they become one expression.
MOST_RULES = 1000
UDFS = {"scholia_sentences": align.sentences_udf, "scholia_grade": align.sentence_grade_udf, "scholia_nfkc": align.nfkc_udf}


def register(spark: SparkSession) -> list[str]:
    """Makes the vectorised functions callable from SQL; their names."""
    for name, udf in UDFS.items():
        spark.udf.register(name, udf)
    return list(UDFS)


def spoken(texts: DataFrame, rules: DataFrame, column: str = "text") -> DataFrame:
    """texts with `spoken`: their column after the rules (find, put, whole_case) of a table, as `papers.kept_rules` gives them, and
    the built-in readings. Rules are settings of a user, MOST_RULES at most, which are read by the driver."""
    found = rules.select("find", "put", "whole_case").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} pronunciation rules")
    return texts.withColumn("spoken", text.spoken_form(F.col(column), [], [(r["find"], r["put"], r["whole_case"]) for r in found]))
