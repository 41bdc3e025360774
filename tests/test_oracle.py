"""Every registered query of the cohort engine against DuckDB."""

import duckdb
import pandas as pd
import pytest

from stratalens.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list:
    def text(v):
        if v is None or (not isinstance(v, list) and pd.isna(v)):
            return ""
        if hasattr(v, "year"):
            return str(v)[:10]
        try:
            return f"{float(v):.6f}"
        except ValueError:
            return str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_duckdb(spark, db, sf_dir, name):
    ours, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), db.sql(registry.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) and rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
