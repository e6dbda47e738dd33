"""Registered queries against their DuckDB form. LEXSPAN_ALL=1 runs every query."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexspan.plans.fixtures import RAW

SOME = [
    "a4_set_fingerprint", "a5_read_draft", "a10_data_synsets", "b1_encode", "b6_round_half", "b8_prepare_query", "c1_exact_topk", "c2_list_topk", "c4_best_sense", "c7_synset_topk", "c9_neighbours",
    "d5_layout", "d10_texts_digest", "d12_synset_collapse", "d16_applied", "d17_pool_identity", "e1_content_tokens", "e6_overlap", "e18_derived_base", "f1_category_counts",
    "f15_joinable_pairs", "g5_violations", "g9_stratified_targets", "g12_merged", "h3_percentiles", "h4_mcnemar", "h9_lenient_comparison", "h22_tie_audit",
    "i4_settled_rounds", "i5_daily_awards", "i11_decisions_tight", "i12_saved_set", "j1_stream_limits", "j3_stream_ledger", "j5_stream_pairs",
]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("LEXSPAN_ALL") else SOME


def cell(v):
    return repr(v + 0.0) if isinstance(v, float) and not math.isnan(v) else str(v)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in RAW:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    want = duck.sql(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_query_is_named_once_and_has_a_form():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = set(entry.queries()) - set(entry.oracle_sql())
    assert rows_only - {n for n in rows_only if n == "pipeline" or n.startswith("op")} == set()


def test_searches_ask_for_ids_divisible_by_fifty(spark, small):
    from lexspan.plans import frames as P

    words = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id").toPandas()["vec_id"]
    wanted = {int(i) for i in words if i % 50 == 0}
    assert {int(r.qid[-6:]) for r in P.query_vectors(spark, small).collect()} == wanted
    assert {int(r.qid[-6:]) for r in P.asked(spark, small).collect()} == wanted
    assert P.queries(spark, small).count() == len(words)


def test_ids_past_four_digits_equal_sql(spark):
    """Ten thousand rows and more: the ids keep all their digits on both sides."""
    from lexspan.functions import text as X
    from lexspan.plans import oracle_parts as O

    numbers = [1, 999, 1000, 9999, 10000, 102564]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(X.row_id("authored", F.col("n"))).collect()]
    assert got == [duckdb.sql(f"SELECT {O.row_id('authored', str(n))} AS id").fetchall()[0][0] for n in numbers]
    assert got[-2:] == ["authored-10000", "authored-102564"]
    assert "lpad(CAST(n" not in entry.oracle_sql()["g1_tripwire"] and "lpad(CAST(row_number" not in entry.oracle_sql()["g2_authored"]


def test_word_sums_equal_the_plain_text_and_join_a_row_per_word(spark, small):
    """Copies of a line item, missing amounts and missing parts included; `freq` joins sums, not line items."""
    from lexspan.plans import fixtures as X

    raw = {t: X.table(spark, small, t) for t in ("embeddings", "lineitem", "part")}
    few = raw["lineitem"].limit(50).select("l_partkey", "l_quantity")
    odd = few.unionByName(few).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS l_partkey, 3.0D AS l_quantity UNION ALL SELECT 7, NULL"))
    vocab = X.table(spark, small, "vocab")
    plain = spark.sql(X.SQL["freq"], vocab=vocab, embeddings=raw["embeddings"], part=raw["part"], lineitem=odd)
    summed = X._per_word(odd, raw["embeddings"])
    got = spark.sql(X.SQL["freq"], vocab=vocab, embeddings=raw["embeddings"], part=raw["part"], lineitem=summed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert summed.count() == odd.select(F.col("l_partkey") % raw["embeddings"].count()).distinct().count()
    assert X.table(spark, small, "freq")._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") > plain._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")


def test_searches_ask_for_every_word(spark, small):
    """The whole set is searched for, in Spark and in SQL; nothing picks queries by their number."""
    from lexspan.plans import frames as P

    words = {int(r.vec_id) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id").collect()}
    assert {int(r.qid[-6:]) for r in P.query_vectors(spark, small).collect()} == words
    found = {n: entry.queries()[n](spark, small).select("qid").distinct().collect() for n in ("c1_exact_topk", "c12_answers", "f8_reachability", "h24_miss_classes")}
    assert all({int(r.qid[-6:]) for r in got} == words for got in found.values())
    assert not [n for n, text in entry.oracle_sql().items() if "qvec_id % 50" in text]
