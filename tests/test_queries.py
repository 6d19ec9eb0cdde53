"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sparkmill.plans import catalogue

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def sorted_rows(df: pd.DataFrame) -> list:
    rows = [tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else int(v) if hasattr(v, "__int__") and not isinstance(v, str | bool) else v for v in r) for r in df[sorted(df)].itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, str(SF)).toPandas(), db.sql(catalogue.SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert sorted_rows(got) == sorted_rows(want)


def test_every_query_runs(spark):
    assert set(catalogue.SQL) | {"q21_head_scores"} == set(catalogue.QUERIES)
    assert catalogue.QUERIES["q21_head_scores"](spark, str(SF)).where("p between 0 and 1").count() == 500
