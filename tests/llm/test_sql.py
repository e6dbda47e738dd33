"""Registered queries against their DuckDB form."""

import duckdb
import pytest

from lexspan.llm import catalogue

SMALL = "/root/testdata/sf0.001"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i] + 0.0) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, SMALL)
    want = con.sql(catalogue.ORACLES[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))
