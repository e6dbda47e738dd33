import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import ledger as L, limits as M, saves as V, vocab_audit as U
from lexspan.session import freeze
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_balance_with_a_hot_user_over_many_partitions(spark):
    """One user has two thirds of all events; partitions are small, so it spans several."""
    rnd = random.Random(11)
    data = [(1 if i % 3 else rnd.randrange(2, 9), at(rnd.randrange(0, 9000)), i, "round", rnd.choice([-500, -60, -30, 5, 40, 90])) for i in range(3000)]
    df = spark.createDataFrame(data, "user_id long, ts timestamp, id long, kind string, delta long").repartition(5)
    want, balance = [], {}
    for user, ts, i, _, delta in sorted(data):
        b = balance.get(user, 100) + delta
        broke = b <= 0
        balance[user] = 25 if broke else b
        want.append((user, i, balance[user], broke))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = L.settle(df)
        assert rows(got, "user_id", "id", "balance", "bankrupt") == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_balance_map_equals_replay():
    rnd = random.Random(2)
    for _ in range(200):
        deltas = [rnd.randrange(-80, 70) for _ in range(rnd.randrange(1, 60))]
        limits, ends, shift, _ = L.balance_map(np.array(deltas), 6000)
        for start in (1, 5, 25, 60, 100, 500, 5000):
            b = start
            for d in deltas:
                b = b + d if b + d > 0 else 25
            assert L.mapped(start, limits, ends, shift) == b


def test_balance_map_of_many_equal_losses_is_short():
    limits, ends, shift, top = L.balance_map(np.full(100_000, -10), 100)
    assert len(limits) <= 11 and shift == -1_000_000 and top == 1_000_000
    for start in (1, 10, 11, 99, 100):
        b = start
        for _ in range(100_000):
            b = b - 10 if b > 10 else 25
        assert L.mapped(start, limits, ends, shift) == b


def test_a_busy_user_over_many_partitions(spark):
    n = 100_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.timestamp_seconds("id").alias("ts"), "id", F.lit("round").alias("kind"),
                               F.when(F.col("id") % 50 == 0, 200).otherwise(-10).cast("long").alias("delta"))
    b = 100
    for i in range(n):
        b += 200 if i % 50 == 0 else -10
        b = b if b > 0 else 25
    got = L.settle(df.repartition(5)).agg(F.count("*").alias("n"), F.max_by("balance", "id").alias("last")).first()
    assert (got["n"], got["last"]) == (n, b)


def test_bankruptcy_resets(spark):
    df = spark.createDataFrame([(1, at(0), 1, "round", -60), (1, at(1), 2, "round", -50)], "user_id long, ts timestamp, id long, kind string, delta long")
    assert rows(L.settle(df), "id", "balance", "bankrupt") == [(1, 40, False), (2, 25, True)]


def test_daily_award_values(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 8, 9, 20)], "n int")
    assert [r[0] for r in df.select(L.daily_award(F.col("n"))).collect()] == [15, 20, 50, 55, 60]


def test_streaks_break_on_a_missed_day_and_follow_the_zone(spark):
    day = 24 * 60
    data = [(1, at(10), 1), (1, at(20), 2), (1, at(day + 5), 3), (1, at(3 * day), 4)]
    df = spark.createDataFrame(data, "user_id long, ts timestamp, id long")
    assert rows(L.daily_awards(df), "id", "streak", "award") == [(1, 1, 15), (3, 2, 20), (4, 1, 15)]
    assert rows(L.daily_awards(df, "America/New_York"), "id", "streak") == [(1, 1), (3, 2), (4, 1)]


def test_save_awards_on_transitions_only(spark):
    acts = ["save", "save", "unsave", "save", "unsave", "unsave", "save"]
    data = [(1, 7, at(i * 45), i, a) for i, a in enumerate(acts)]
    df = spark.createDataFrame(data, "user_id long, word_id long, ts timestamp, id long, action string")
    assert rows(L.save_transitions(df), "id") == [(0,), (3,), (6,)]
    assert rows(V.saved_set(df), "saved_at") == [(at(6 * 45),)]
    again = df.unionByName(spark.createDataFrame([(1, 7, at(999), 99, "save")], df.schema))
    assert rows(V.saved_set(again), "saved_at") == [(at(6 * 45),)]


def test_awards_reject_bad_amounts(spark):
    df = spark.createDataFrame([(1, at(0), i, a) for i, a in enumerate(["5", "0", "-1", "x", None, "2.7", "NaN", "Infinity", "1e30"])], "user_id long, ts timestamp, id long, amount string")
    good, bad = L.award_events(df)
    assert rows(good, "id", "delta") == [(0, 5)] and rows(bad, "id") == [(i,) for i in range(1, 9)]


def test_bets(spark):
    df = spark.createDataFrame([(v,) for v in ["9", "10", "500", "501", "10.5", "x", None]], "b string")
    assert [r[0] for r in df.select(L.valid_bet(F.col("b"))).collect()] == [None, 10, 500, None, None, None, None]


def test_defaults_and_leaderboard(spark):
    none = spark.createDataFrame([], "user_id long, ts timestamp, id long, kind string, balance long, bankrupt boolean")
    users = spark.range(1, 13).select(F.col("id").alias("user_id"))
    credits = L.balances(none, users)
    names = spark.createDataFrame([(1, "u1", "A B"), (2, None, "C D"), (3, None, "")], "user_id long, username string, full_name string")
    got = L.leaderboard(credits, names, me=2).orderBy("rank").collect()
    assert [(r["rank"], r["name"], r["credits"], r["is_you"]) for r in got][:4] == [(1, "u1", 100, False), (2, "C D", 100, True), (3, "Anonymous", 100, False), (4, "Anonymous", 100, False)]
    assert len(got) == 10


def greedy(reqs, cap, span):
    out, state = {}, {}
    for key, t, i in sorted(reqs):
        s = [x for x in state.get(key, []) if x > t - span]
        out[i] = len(s) < cap
        state[key] = s + [t] if out[i] else s
    return sorted(out.items())


def test_limits_count_allowed_requests_only(spark):
    rnd = random.Random(8)
    reqs = [("hot" if i % 3 else f"k{i % 7}", rnd.randrange(0, 40_000), i) for i in range(900)]
    df = spark.createDataFrame(reqs, "key string, at long, id long").withColumn("cap", F.lit(4)).withColumn("message", F.lit("no"))
    got = M.decide(df.repartition(6), 3000)
    assert rows(got, "id", "allowed") == greedy(reqs, 4, 3000)
    assert got.filter("not allowed and message is null").count() == 0


def test_a_million_events_of_one_user(spark):
    """Gains and losses of equal size: the maps grow with the gains, and stay off the driver."""
    df = spark.range(1_000_000).selectExpr(
        "7 AS user_id", "timestamp_seconds(id) AS ts", "id", "'round' AS kind", "CAST(pmod(xxhash64(id), 81) - 40 AS bigint) AS delta")
    got = L.settle(df).select("id", "delta", "balance", "bankrupt").toPandas().sort_values("id")
    after, broke = L.replay(L.START_CREDITS, got["delta"].to_numpy())
    assert (got["balance"].to_numpy() == after).all() and (got["bankrupt"].to_numpy() == broke).all() and broke.sum() > 100


@pytest.mark.parametrize("gap", [0, 40, 400])
def test_stretches_of_a_busy_key_decide_as_one_stream(spark, gap):
    """Quiet times of several lengths, equal instants, and two requests at the edge of the span."""
    rnd = random.Random(gap)
    reqs, now = [], 0
    for i in range(1500):
        now += rnd.choice([0, 0, 1, 3]) if rnd.random() < 0.97 else gap
        reqs.append(("hot" if i % 5 else "other", now, i))
    reqs += [("edge", t, 2000 + i) for i, t in enumerate((0, 0, 50, 50, 100, 100, 149, 150, 151))]
    df = spark.createDataFrame(reqs, "key string, at long, id long").withColumn("cap", F.lit(3)).withColumn("message", F.lit("no"))
    assert rows(M.decide(df.repartition(5), 50), "id", "allowed") == greedy(reqs, 3, 50)


def test_a_key_with_a_million_requests_is_many_tasks(spark):
    """A day of rush and three quiet days in turn: stretches of a bounded part of the key, folded apart."""
    day = 1000
    n = 1_000_000
    at = "CAST((id DIV 25000) * 4000 + (id % 25000) * 0.04 AS long)"
    df = spark.range(n).selectExpr("'hot' AS key", f"{at} AS at", "id", "50 AS cap", "'no' AS message")
    quiet = spark.range(n, n + 5400).selectExpr("'hot' AS key", f"(id - {n}) * 30 AS at", "id", "50 AS cap", "'no' AS message")
    both = df.unionByName(quiet)
    cut = freeze(M.stretches(freeze(M.rolling_counts(both, day)), day))
    sizes = [r["count"] for r in cut.groupBy("cut").count().collect()]
    assert len(sizes) >= 40 and max(sizes) < n / 8
    assert cut.filter("known").groupBy("cut").count().agg(F.max("count")).first()[0] <= 50
    assert cut.filter("not known").count() == both.count()
    spread = cut.repartition(16, "key", "cut").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread >= 8
    times = np.sort(both.select("at").toPandas()["at"].to_numpy())
    want = int(M.allow(times, 50, day, M.deque()).sum())
    assert M.decide(both, day).filter("allowed").count() == want


def test_guest_key(spark):
    df = spark.createDataFrame([(1, at(0), None, " 1.2.3.4 , 5.6.7.8"), (2, at(0), None, None), (3, at(0), "u", None)], "id long, ts timestamp, user_id string, forwarded string")
    got = rows(M.keyed_requests(df), "id", "key", "cap")
    assert got == [(1, "guest:1.2.3.4", 50), (2, "guest:127.0.0.1", 50), (3, "user:u", 200)]


def test_pairs_within_the_span(spark):
    saves = spark.createDataFrame([(1, 1, at(10)), (2, 1, at(20)), (3, 2, at(10))], "id long, user_id long, ts timestamp")
    looks = spark.createDataFrame([(1, 1, at(5)), (2, 1, at(6)), (3, 1, at(10)), (4, 1, at(11))], "id long, user_id long, ts timestamp")
    assert rows(U.saves_after_lookup(saves, looks), "probe", "lookups") == [(1, 2), (2, 0), (3, 0)]
    assert rows(U.joinable_pairs(saves, looks), "saves", "pairs", "lookups") == [(3, 2, 4)]


def test_profiles(spark):
    profiles = spark.createDataFrame([("p1", "alpha", "noun", "text")], "id string, word string, part_of_speech string, definition string")
    vocab = spark.createDataFrame([("beta",), ("alpha",)], "word string")
    got = V.resolve_profiles(spark.createDataFrame([(" ALPHA ",), ("beta",), ("nope",)], "slug string"), profiles, vocab)
    assert rows(got, "word", "outcome", "definition") == [("alpha", "stored", "text"), ("beta", "created", ""), ("nope", "not found", None)]
    assert rows(V.new_profiles(got), "word", "obscurity_score") == [("beta", 50)]


def test_a_busy_key_is_folded_as_runs_of_times(spark, monkeypatch):
    """All requests of one key that is never quiet: its one task gets runs of times, not a row per request."""
    day, n = 86_400_000_000, 60_000
    reqs = [(i, "a", (i * 7919 % n) * 3_000_000, 50) for i in range(n)]
    keyed = spark.createDataFrame(reqs, "id long, key string, at long, cap int").withColumn("message", F.lit("no"))
    fold = M._fold

    def few_rows(span_us):
        inner = fold(span_us)

        def run(batches):
            for batch in batches:
                assert batch.num_rows * 100 < len(batch["times"].flatten())
                yield from inner([batch])
        return run

    monkeypatch.setattr(M, "_fold", few_rows)
    got = {r.id for r in M.decide(keyed, day).filter("allowed").collect()}
    times = np.array(sorted(r[2] for r in reqs))
    order = sorted(reqs, key=lambda r: (r[2], r[0]))
    assert got == {order[i][0] for i in np.flatnonzero(M.allow(times, 50, day, M.deque()))}
