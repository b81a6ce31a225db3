"""Every query with SQL against DuckDB on the smallest tables, and none without rows."""

import duckdb
import pandas as pd
import pytest

from scholia.plans import files, more, pages, papers, reading, segments, study  # noqa: F401  register their queries
from scholia.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: What these queries look for doesn't occur at this size.
MAY_BE_EMPTY = {"repeated_margins"}


def plain(df, columns):
    out = df[columns].copy()
    for c in columns:
        if pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype(float).round(6)
        out[c] = out[c].astype(str).replace({"None": "nan", "NaT": "nan", "<NA>": "nan"})
    return out.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if name in ORACLES:
        c = duckdb.connect()
        c.execute("set max_temp_directory_size = '1GB'")
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = c.sql(ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        pd.testing.assert_frame_equal(plain(got, columns), plain(want, columns))
