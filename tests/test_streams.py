"""Streams over several micro-batches: carried state, late rows, expiry, busy keys."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import ledger as L, limits as M
from lexspan.streaming import jobs as J, state as P
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 3)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """Micro-batches in turn: each call writes one file and drains what is there."""

    def __init__(self, spark, tmp_path, schema, job):
        self.spark, self.schema, self.job = spark, schema, job
        self.path, self.out, self.state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def __call__(self, *batch):
        self.spark.createDataFrame(list(batch), self.schema).coalesce(1).write.mode("append").parquet(self.path)
        return J.drain(self.job(J.read_in_time(self.spark, self.path, self.frame().schema)), self.out, self.state)

    def frame(self):
        return self.spark.createDataFrame([], self.schema)

    def held(self, name):
        """Rows of a state variable after the last batch."""
        with J.state_store(self.spark):
            reader = self.spark.read.format("statestore").option("path", self.state).option("stateVarName", name)
            return reader.load().count()


def test_late_lookups_are_marked(spark, tmp_path):
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp, id long", J.daily_streaks)
    feed((1, at(300), 1), (1, at(360), 2))
    got = feed((1, at(-1000), 3), (1, at(1500), 4), (1, at(1440 * 4), 5))
    assert rows(got, "id", "streak", "award", "late") == [(1, 1, 15, False), (2, 1, 0, False), (3, None, 0, True), (4, 2, 20, False), (5, 1, 15, False)]


def test_streaks_over_batches_equal_the_whole_table(spark, tmp_path):
    rnd = random.Random(4)
    events = [(rnd.randrange(5), at(rnd.randrange(60 * 24 * 20)), i) for i in range(600)]
    events = sorted(events, key=lambda e: e[1])
    feed = Feed(spark, tmp_path, "user_id long, ts timestamp, id long", J.daily_streaks)
    for i in range(0, 600, 150):
        got = feed(*events[i : i + 150])
    df = spark.createDataFrame(events, "user_id long, ts timestamp, id long")
    assert rows(got.filter("award > 0"), "user_id", "id", "streak", "award") == rows(L.daily_awards(df), "user_id", "id", "streak", "award")
    assert got.filter("late").count() == 0 and got.count() == 600


def test_limits_carry_over_batches_and_late_requests_change_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key string, id long, at long, cap int", lambda s: J.limit_requests(s, 100 * 60_000_000))
    us = lambda m: int(at(m).timestamp() * 1e6)
    feed(("k", 1, us(0), 2), ("k", 2, us(10), 2), ("other", 3, us(10), 2))
    feed(("k", 4, us(20), 2), ("k", 5, us(5), 2))
    got = feed(("k", 6, us(99), 2), ("k", 7, us(100), 2), ("k", 8, us(101), 2), ("k", 9, us(111), 2))
    assert rows(got, "id", "allowed", "late") == [
        (1, True, False), (2, True, False), (3, True, False), (4, False, False), (5, None, True), (6, False, False), (7, True, False),
        (8, False, False), (9, True, False)]


def test_state_of_a_silent_key_is_dropped(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key string, id long, at long, cap int", lambda s: J.limit_requests(s, 100 * 60_000_000, "10 minutes"))
    us = lambda m: int(at(m).timestamp() * 1e6)
    feed(("silent", 1, us(0), 2), ("busy", 2, us(0), 2))
    feed(("busy", 3, us(50), 2))
    assert feed.held("state") == 2
    feed(("busy", 4, us(200), 2))
    feed(("busy", 5, us(201), 2))
    assert feed.held("state") == 1 and feed.held("times") == 2
    # What is older than the watermark comes out late, and leaves no state behind.
    got = feed(("silent", 6, us(1), 2), ("busy", 7, us(202), 2))
    assert rows(got.filter("id >= 5"), "id", "allowed", "late") == [(5, True, False), (6, None, True), (7, False, False)]
    assert feed.held("state") == 1


def test_ledger_and_saves_hand_on_late_events(spark, tmp_path):
    feed = Feed(spark, tmp_path / "l", "user_id long, id long, ts timestamp, kind string, delta long", J.credit_ledger)
    feed((1, 1, at(0), "round", -60), (1, 2, at(5), "round", -50))
    feed((1, 3, at(3), "award", 500), (1, 4, at(6), "save", 2))
    got = feed((1, 5, at(7), "round", -10), (2, 6, at(7), "round", -10))
    assert rows(got, "id", "balance", "bankrupt", "late") == [
        (1, 40, False, False), (2, 25, True, False), (3, None, None, True), (4, 27, False, False), (5, 17, False, False), (6, 90, False, False)]
    feed = Feed(spark, tmp_path / "s", "user_id long, word_id long, id long, ts timestamp, action string", J.saved_words)
    feed((1, 1, 1, at(0), "save"), (1, 1, 2, at(1), "save"))
    feed((1, 1, 3, at(2), "unsave"), (1, 1, 4, at(0), "unsave"))
    got = feed((1, 1, 5, at(3), "save"), (1, 2, 6, at(3), "unsave"))
    assert rows(got, "id", "saved", "newly", "late") == [
        (1, True, True, False), (2, True, False, False), (3, False, False, False), (4, None, False, True), (5, True, True, False), (6, False, False, False)]


def test_files_of_rising_times_are_batches_in_turn(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "pmod(id * 7919, 1000) AS at")
    path = str(tmp_path / "in")
    J.write_in_time(df, path, F.col("at"), 4)
    seen = []
    J.drain_batches(J.read_in_time(spark, path, df.schema), str(tmp_path / "state"), lambda b, i: seen.append(b.agg(F.min("at"), F.max("at"), F.count("*")).first()))
    assert len(seen) == 4 and sum(s[2] for s in seen) == 1000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(J._PROVIDER)
    with J.state_store(spark):
        assert spark.conf.get(J._PROVIDER) == J.STATE_STORE
    assert spark.conf.get(J._PROVIDER) == before


def plain_replay(start, deltas):
    out, broke = [], []
    for d in deltas:
        start += d
        broke.append(start <= 0)
        start = start if start > 0 else L.BANKRUPT_CREDITS
        out.append(start)
    return out, broke


@pytest.mark.parametrize("seed", range(6))
def test_vectorised_replay(seed):
    rng = np.random.default_rng(seed)
    deltas = rng.integers(-40, [30, 45, 41, 300, 39, 1][seed], 5000)
    after, broke = L.replay(100, deltas)
    assert (after.tolist(), broke.tolist()) == plain_replay(100, deltas.tolist())


def test_replay_of_a_million_events_is_linear():
    rng = np.random.default_rng(1)
    times = []
    for n in (100_000, 1_000_000):
        deltas = rng.integers(-40, 41, n)
        start = time.perf_counter()
        L.replay(100, deltas)
        times.append(time.perf_counter() - start)
    assert times[1] < 30 * times[0] and times[1] < 10


def test_limits_of_one_busy_batch():
    """As many requests as a busy key sends: decided by jumps, not by a list per request."""
    times = np.sort(np.random.default_rng(2).integers(0, 10 * M.DAY_US, 1_000_000))
    start = time.perf_counter()
    allowed = M.allow(times, 50, M.DAY_US, M.deque())
    assert time.perf_counter() - start < 5 and 450 <= allowed.sum() <= 550
    assert P.RequestLimiter.OUT.endswith("late boolean")


def test_rows_of_a_timed_stream_are_made_once_by_all_tasks(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(90, numPartitions=3).mapInArrow(count, "id long")
    J.write_in_time(df, str(tmp_path / "rows"), F.col("id"), 3)
    assert seen.value == 90
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "rows")).collect()) == list(range(90))


def test_saves_over_batches_equal_the_whole_table(spark, tmp_path):
    """Many pairs of few events share their calls; null users and words are pairs of their own."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(P.SavedWords):
        def handleInputRows(self, key, rows, timerValues):
            calls.add(1)
            yield from super().handleInputRows(key, rows, timerValues)

    rnd = random.Random(8)
    some = lambda n: rnd.choice([None, *range(n)])
    events = sorted(((some(6), some(60), 2**60 + i, at(rnd.randrange(60 * 24)), rnd.choice(["save", "unsave", None])) for i in range(900)), key=lambda e: e[3])
    columns = "user_id long, word_id long, id long, ts timestamp, action string"
    feed = Feed(spark, tmp_path, columns, lambda s: J.saved_words(s, shares=8))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(P, "SavedWords", Counted)
        for i in range(0, 900, 300):
            got = feed(*events[i : i + 300])
    held, want = {}, []
    for user, word, i, _, action in events:
        saved = action == "save"
        want.append((i, user, word, saved, saved and not held.get((user, word), False), False))
        held[user, word] = saved
    assert sorted((tuple(r) for r in got.select("id", "user_id", "word_id", "saved", "newly", "late").collect())) == sorted(want)
    assert 0 < calls.value <= 3 * 8 and feed.held("state") == 8
