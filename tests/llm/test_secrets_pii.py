"""Secrets by ownership and personal data."""

import re
import time

import pytest
from pyspark.sql import functions as F

from lexspan.llm import pii, secret_scan
from lexspan.llm.common import table
from llm_helpers import docs_of

HEX, KEY = "0123456789abcdef" * 3, "AKIA" + "Z9" * 8


def scanned(spark, rows):
    docs = docs_of(spark, rows).select("doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"))
    return {r.doc_id: r for r in secret_scan.digest(secret_scan.scan(docs)).collect()}


def test_base_kinds_are_found_without_retries(spark):
    found = scanned(spark, [
        (1, f'é PassWord = "{HEX}" {KEY}', "en", "a"), (2, "token: token:abcdefghij", "en", "a"), (3, "AKIA123", "en", "b"), (4, f"\U0001f600{HEX}", "en", "b"),
    ])
    assert found[1].spans == f"assign:2:{14 + 48},hex:14:62,access:64:{64 + len(KEY)}"
    assert (found[2].n_assign, found[3].n_access, found[4].spans) == (0, 0, "hex:1:49")


def test_ownership_separates_examples_from_live_values(spark):
    example, live = "ghp_" + "A1b2" * 9, "ghp_" + "Z9y8" * 9
    rows = [(i, f"key {example} here", "en", f"s{i}") for i in range(6)]
    rows += [(10, f"my {live}", "en", "s1"), (11, f"my {live}", "de", "s1"), (12, f"use {example}", "en", None)]
    found = scanned(spark, rows)
    assert found[0].spans == "" and found[0].n_copied == 1 and found[0].most_owners == 7
    assert found[10].spans == f"vendor:3:{3 + len(live)}" and found[10].n_live == 1 and found[11].most_owners == 1


def test_many_repositories_of_one_owner_make_an_example(spark):
    value = "ghp_" + "Q1w2" * 9
    rows = [(i, f"key {value}", f"r{i}", "s1") for i in range(6)]
    found = scanned(spark, rows)
    assert found[0].spans == "" and (found[0].n_copied, found[0].most_owners, found[0].most_repos) == (1, 1, 6)
    found = scanned(spark, rows[:4])
    assert found[0].n_live == 1 and found[0].most_repos == 4


def test_opaque_runs_are_looked_at_as_a_whole(spark):
    late, plain = "A" * 70 + "b" * 10 + "7" + "c" * 10, "A" * 90
    found = scanned(spark, [(1, f"x {late} y", "en", "a"), (2, f"x {plain} y", "en", "a")])
    assert found[1].spans == f"opaque:2:{2 + len(late)}" and found[2].spans == ""


def test_long_texts_of_digits_take_linear_time():
    """A megabyte of digits, of dots and digits, and twenty thousand candidates in one text."""
    start = time.perf_counter()
    assert pii.base_spans("7" * 1_000_000) == [] and pii.base_spans("0" * 5000 + ".1.2.3")[0] == (0, "ip", 5006)
    assert len(pii.base_spans("1.2.3.4 " * 40_000)) == 40_000
    crowded = "call (212) 555-0142, " * 20_000
    found = pii.candidates(crowded)
    assert len(found) >= 20_000 and len(pii.crowd(found)) == len(found)
    model = pii.Trees()
    inside = pii.Overlaps(found)
    assert sum(inside.any(s, e) for s, _, e in found) == len(found) and not inside.any(0, 5)
    assert pii.spans(crowded, model) == ([], [])
    assert time.perf_counter() - start < 20


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and pii.luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def plain_spans(text):
    return [(s, k, e) for s, _, k, e in sorted(
        (m.start(), i, k, m.end()) for i, (k, (p, ok)) in enumerate(PLAIN.items()) for m in re.finditer(p, text, re.A) if ok(m.group()))]


def test_base_spans_equal_the_patterns(spark, small):
    texts = [r.text for r in table(spark, small, "documents").collect()]
    texts += ["@a.b@c.d x@y.z", "a@b", "a..@b.c.", "1.2.3.4.5.6.7.8", "0255.001.2.3 256.1.1.1", "4111 1111-1111 1111 5", "+1 (800) 555-0199", "+12", "x@y.z@w.v", "é@b.c"]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_boosting_learns_a_rule():
    rng = pii.np.random.default_rng(0)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    p = pii.boost(x[:600], y[:600]).score(x[600:])
    assert ((p > 0.5) == (y[600:] > 0.5)).mean() > 0.95


def test_selection_keeps_base_spans_and_clean_texts(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("doc_id < 4000")
    model = pii.learn(docs)
    assert model.threshold
    texts = [r.text for r in docs.filter("doc_id < 600").collect()]
    for text in texts:
        base, every = pii.spans(text, model)
        assert set(base) <= set(every)
        if not re.search("[0-9@]", text):
            assert every == []
    hidden = "write to someone.odd [at] mail [dot] example [dot] org today"
    assert [k for _, k, _ in pii.spans(hidden, model)[1]] == ["wide_email"]
    assert pii.masked(hidden, pii.spans(hidden, model)[1]) == "write to <EMAIL> today"


def test_masking_merges_overlaps():
    assert pii.masked("ab 123456 cd", [(3, "card", 7), (5, "phone", 9)]) == "ab <CARD> cd"


def test_rare_personal_data_is_learned_beside_many_clean_documents(spark):
    """24 documents with an address beside 60,000 that hold digits only."""
    few = [(i, f"please write to {'abcdefgh'[i % 8]}oe.{'klm'[i // 8]}{i}@mail{i}.example.org before noon") for i in range(24)]
    clean = spark.range(1000, 61_000).selectExpr("id AS doc_id", "concat('count 12 345 ', id, ' 678 of the year') AS text")
    model = pii.learn(spark.createDataFrame(few, "doc_id long, text string").unionByName(clean))
    assert "wide_email" in model.threshold
    text = "please write to jane.roe [at] post [dot] example [dot] org before noon"
    assert [k for _, k, _ in pii.spans(text, model)[1]] == ["wide_email"]
