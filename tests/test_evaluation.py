import pytest
from pyspark.sql import functions as F

from lexspan.operators import cells as C, compare as K, metrics as M, probes as B, ranks as R
from tests.conftest import rows

QUERIES = "qid string, query string, target string, acceptable array<string>"


def results(spark, data):
    """(tag, id, source, reachable, rank, lenient, echo, top1)"""
    schema = "tag string, id string, source string, reachable boolean, rank int, lenient_rank int, echo double, top1 string"
    return (spark.createDataFrame(data, schema).withColumn("query", F.lit("a b c")).withColumn("target", F.lit("t"))
            .withColumn("style", F.lit(None).cast("string")).withColumn("token_count", F.lit("single"))
            .withColumn("lexical_overlap", F.lit(None).cast("string")).withColumn("zipf", F.lit(None).cast("double")))


def test_ranks_first_match_in_any_case_and_misses_stay_null(spark):
    q = spark.createDataFrame([("1", "the rainy day", " Rain ", ["Drop"]), ("2", "x", "gone", []), ("3", "y", "none", [])], QUERIES)
    hits = spark.createDataFrame([("1", 1, "drop", 0.9), ("1", 2, "RAIN", 0.8), ("1", 3, "rain", 0.7), ("2", 1, "other", 0.5)], "qid string, rank int, word string, sim double")
    got = {r["qid"]: r for r in R.score_hits(hits, q).collect()}
    assert (got["1"]["rank"], got["1"]["lenient_rank"], got["1"]["top1"]) == (2, 1, "drop")
    assert abs(got["1"]["echo"] - 2 / 3) < 1e-12
    assert (got["2"]["rank"], got["3"]["rank"], got["3"]["echo"], got["3"]["top1"]) == (None, None, 0.0, None)


def test_metrics_of_a_small_run(spark):
    r = results(spark, [("a", str(i), "authored", True, rank, rank, 0.5, "x") for i, rank in enumerate([1, 2, 10, 11, None])])
    m = M.score(r, ["tag"]).first()
    assert (m["n"], m["recall1"], m["recall3"], m["recall10"], m["beyond10"]) == (5, 0.2, 0.4, 0.6, 0.2)
    assert abs(m["mrr10"] - (1 + 0.5 + 0.1) / 5) < 1e-12
    assert M.score(r.filter("false"), []).first()["recall1"] is None


def test_scope_falls_back_without_authored_rows(spark):
    r = results(spark, [("a", "1", "authored", True, 1, 1, 0.0, "x"), ("a", "2", "gloss_tripwire", True, 1, 1, 0.0, "x"),
                        ("b", "1", "gloss_tripwire", True, 1, 1, 0.0, "x"), ("b", "2", "gloss_tripwire", False, 1, 1, 0.0, "x")])
    assert rows(M.routed(r).filter("in_scope"), "tag", "id") == [("a", "1"), ("b", "1")]


def test_comparison_prefers_the_authored_slice_and_uses_lenient_ranks(spark):
    data = []
    for i in range(20):
        data += [("a", f"q{i:02d}", "authored", True, None, 1 if i < 2 else None, 0.2, "x"), ("b", f"q{i:02d}", "authored", True, 1, 1 if i < 12 else None, 0.1, "y")]
    data += [("a", "t", "gloss_tripwire", True, 1, 1, 0.0, "x"), ("b", "t", "gloss_tripwire", True, None, None, 0.0, "x")]
    r = results(spark, data)
    pair = spark.createDataFrame([("a", "b")], "a string, b string")
    row = K.comparison(r, pair).first()
    assert (row["slice"], row["n"], row["wins"], row["regressions"], row["strict_wins"], row["verdict"]) == ("authored", 20, 10, 0, 20, "WIN")
    leaked = K.comparison(r.filter("source <> 'authored'"), pair).first()
    assert (leaked["slice"], leaked["n"], leaked["regressions"], leaked["p"]) == ("tripwire", 1, 1, 1.0)
    listed = K.changes(r, pair, n=5)
    assert listed.filter("kind = 'win'").count() == 5 and listed.filter("kind = 'win'").first()["more"] == 15


def test_reference_choice(spark):
    runs = spark.createDataFrame([("x", "h", "s", "2"), ("baseline", "h", "s", "3"), ("y", None, "s2", "2"), ("z", None, "s2", "1")], "tag string, set_sha256 string, set_name string, ran_at string")
    assert rows(K.reference_pairs(runs)) == [("baseline", "x", "the designated reference run"), ("z", "y", "the earliest run on this set")]
    assert rows(K.reference_pairs(runs, "x"), "a", "b") == [("x", "baseline"), ("z", "y")]
    wanted = spark.createDataFrame([("x", "y"), ("x", "nope")], "a string, b string")
    assert rows(K.explicit_pairs(runs, wanted), "a", "b") == [("x", "y")]


def test_set_identity_sees_a_tampered_row(spark):
    runs = spark.createDataFrame([("a", "h1", "s"), ("b", "h1", "s"), ("c", "h2", "t"), ("d", "h3", "t"), ("e", None, "u")], "tag string, set_sha256 string, set_name string")
    current = spark.createDataFrame([("s", "h1"), ("t", "h2"), ("u", "h")], "set_name string, sha256 string")
    assert rows(K.set_identity(runs, current), "set_name", "status") == [("s", "matches"), ("t", "several hashes"), ("u", "not recorded")]
    tampered = spark.createDataFrame([("s", "other")], "set_name string, sha256 string")
    assert rows(K.set_identity(runs.filter("set_name = 's'"), tampered), "status") == [("mismatch",)]


def test_tie_gate_fails_an_order_that_sees_the_answers(spark):
    q = spark.createDataFrame([(str(i), "x", f"w{i % 4}", []) for i in range(40)], QUERIES)
    words = [f"w{i}" for i in range(4)]
    def hits(order):
        data = [(str(i), n + 1, w, 1.0) for i in range(40) for n, w in enumerate(order(i % 4))]
        data += [(str(i), 5, "far", 0.1) for i in range(40)]
        return spark.createDataFrame(data, "qid string, rank int, word string, sim double")
    blind = B.tie_audit(B.tie_groups(hits(lambda t: words), q), []).first()
    assert not blind["fails"] and blind["tied"] == 40 and blind["saturated"] == 0 and abs(blind["strict_neutral"] - 10) < 1e-9
    seeing = B.tie_audit(B.tie_groups(hits(lambda t: [f"w{t}"] + [w for w in words if w != f"w{t}"]), q), [])
    assert seeing.first()["fails"]
    with pytest.raises(C.RefusedError):
        B.require_neutral(seeing)


def test_miss_classes(spark):
    hits = spark.createDataFrame([("1", 1, "A", 0.9), ("2", 1, "x", 0.9), ("3", 1, "x", 0.9)] + [("3", n, f"y{n}", 0.8) for n in range(2, 11)] + [("4", 1, "x", 0.2)], "qid string, rank int, word string, sim double")
    targets = spark.createDataFrame([("1", "a", 0.9), ("2", "b", 0.95), ("3", "c", 0.1), ("4", "d", None)], "qid string, target string, sim double")
    got = B.miss_classes(hits, None, targets)
    assert rows(got, "qid", "kind") == [("1", "returned"), ("2", "index miss"), ("3", "ranking failure"), ("4", "unreachable")]


def test_local_runs_report_no_latency(spark):
    df = spark.createDataFrame([("db", False, float(i), 1.0) for i in range(4)] + [("file", True, 1.0, 1.0)], "tag string, is_local boolean, embed_ms double, search_ms double")
    assert rows(M.latency(df), "tag", "part", "p50", "p95") == [("db", "embed", 2.0, 3.0), ("db", "search", 1.0, 1.0), ("db", "total", 3.0, 4.0)]
