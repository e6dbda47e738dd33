import random

import pytest
from pyspark.sql import functions as F

from lexspan.operators import scale as N
from tests.conftest import rows


def test_numbers_by_hash(spark):
    df = spark.range(500).select(F.concat(F.lit("w"), "id").alias("w")).repartition(5)
    got = [r["w"] for r in N.number_by_hash(df, F.md5("w"), ["w"]).orderBy("row").collect()]
    assert got == [r["w"] for r in df.orderBy(F.md5("w")).collect()]
    assert rows(N.number_by_hash(df, F.md5("w"), ["w"]), "row") == [(i,) for i in range(500)]


def test_numbers_by_order_with_a_hot_value(spark):
    data = [("hot" if i % 3 == 0 else f"w{i}", i) for i in range(900)]
    df = spark.createDataFrame(data, "w string, id int").repartition(7)
    got = N.number_by_order(df, ["w", "id"], "n")
    assert [(r["w"], r["id"]) for r in got.orderBy("n").collect()] == sorted(data)
    assert rows(got, "n") == [(i,) for i in range(900)]


@pytest.mark.parametrize("sketch", [10_000, 50])
def test_order_statistics(spark, monkeypatch, sketch):
    """A small sketch forces the bracketing that large groups use."""
    monkeypatch.setattr(N, "_SKETCH", sketch)
    rnd = random.Random(4)
    data = [("hot", rnd.choice([1.0, 2.0, 5.0, rnd.random() * 9])) for _ in range(2000)] + [("one", 3.0)] + [("few", float(i)) for i in range(7)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    picks = {"p50": N.percentile_pick(50), "p95": N.percentile_pick(95), "p100": N.percentile_pick(100), "third": N.part_pick(1, 3)}
    got = {r["g"]: r for r in N.order_statistics(df, ["g"], "v", picks).collect()}
    for g in ("hot", "one", "few"):
        s = sorted(v for h, v in data if h == g)
        n = len(s)
        assert got[g]["n"] == n
        for name, p in (("p50", 0.5), ("p95", 0.95), ("p100", 1.0)):
            assert got[g][name] == s[min(n - 1, int(p * n))]
        assert got[g]["third"] == s[n // 3]


def test_wide_brackets_are_narrowed_until_they_fit(spark, monkeypatch):
    """Fifty thousand different values and a hot one, with a window of 40."""
    monkeypatch.setattr(N, "_SKETCH", 200)
    monkeypatch.setattr(N, "_WINDOW", 40)
    rnd = random.Random(6)
    data = [("a", rnd.random() ** 3) for _ in range(50_000)] + [("hot", rnd.choice([0.5, rnd.random()])) for _ in range(20_000)] + [("few", 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    passes = []
    narrowed = N._narrowed
    monkeypatch.setattr(N, "_narrowed", lambda *a: passes.append(narrowed(*a)) or passes[-1])
    picks = {"p0": N.percentile_pick(0), "p50": N.percentile_pick(50), "p95": N.percentile_pick(95), "p100": N.percentile_pick(100)}
    got = {r["g"]: r for r in N.order_statistics(df, ["g"], "v", picks).collect()}
    for g in ("a", "hot", "few"):
        s = sorted(v for h, v in data if h == g)
        assert [got[g][f"p{p}"] for p in (0, 50, 95, 100)] == [s[min(len(s) - 1, int(p / 100 * len(s)))] for p in (0, 50, 95, 100)]
    values = {g: sorted({v for h, v in data if h == g}) for g in ("a", "hot")}
    for r in passes[0].select("_g.g", "lo", "hi").collect():
        assert r["g"] == "few" or sum(r["lo"] <= v <= r["hi"] for v in values[r["g"]]) <= 50


def test_counts_in_span(spark):
    rnd = random.Random(9)
    ev = [("hot" if i % 3 else f"k{i % 5}", rnd.randrange(0, 5000)) for i in range(1500)]
    pr = [(k, t, i) for i, (k, t) in enumerate(ev[:400])] + [("none", 5, 9999)]
    got = N.counts_in_span(spark.createDataFrame(ev, "k string, at long"), spark.createDataFrame(pr, "k string, at long, probe long"), ["k"], 300, 70)
    want = sorted((i, sum(1 for a, b in ev if a == k and t - 300 < b <= t)) for k, t, i in pr)
    assert rows(got, "probe", "in_span") == want
