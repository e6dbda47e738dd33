"""Filter interaction and source divergence against plain forms."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexspan.llm import filter_audit, source_audit
from llm_helpers import ODD, docs_of, typed

WORDS = re.compile("[^\x20\x09-\x0d]+")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_masks(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, lang, _ in docs:
        t = text or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > first[t],
        }
        out.append((lang or "", {k for k, v in fails.items() if v}, any(d == i and q == 1 for d, q, _ in labels if i is not None),
                    any(d == i and x == 1 for d, _, x in labels if i is not None)))
    return out


def plain_audit(docs, labels):
    masks = plain_masks(docs, labels)
    rows = []
    for part in {m[0] for m in masks}:
        mine = [m[1:] for m in masks if m[0] == part]
        shapley = Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [m for m in mine if letter in m[0] and not m[0] & before]
                shapley[letter] += len(removed)
                steps.append(("".join(order), step, letter, sum(not m[0] & (before | {letter}) for m in mine), len(removed),
                              sum(letter in m[0] and bool(m[0] & before) for m in mine), sum(m[0] == {letter} for m in mine),
                              sum(m[1] for m in removed), sum(m[2] for m in removed)))
        rows += [(part, order, step, *counts, shapley[letter]) for order, step, letter, *counts in steps]
    return sorted(rows)


LONG = " ".join(f"w{i}" for i in range(150))
DOCS = [
    *ODD, (20, LONG, "en", "a"), (21, LONG, "de", "a"), (22, LONG, "en", "b"), (19, LONG.upper(), "en", None), (23, LONG + " #", None, "a"),
    (None, LONG, "en", "a"), (None, LONG, "en", "a"), (30, "A b", "en", "a"), (31, "A b" * 90, "de", "a"), (3, LONG, "en", "c"),
]
LABELS = [(20, 1, 0), (20, 0, 1), (22, 1, 1), (21, None, None), (None, 1, 1), (23, 0, 1), (999, 1, 1)]


@pytest.mark.parametrize("extra", [False, True])
def test_every_order_of_filters(spark, extra):
    docs = docs_of(spark, DOCS, extra)
    got = filter_audit.audit(filter_audit.cells(filter_audit.marked(docs), labels_of(spark, LABELS)))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(DOCS, LABELS)


def test_filters_of_an_empty_table(spark):
    counted = filter_audit.cells(filter_audit.marked(docs_of(spark, [])), labels_of(spark, []))
    assert filter_audit.audit(counted).collect() == []


def test_walk_is_bounded_by_masks(spark):
    masks = spark.range(32).selectExpr("cast(id as int) AS mask")
    assert filter_audit.walk(masks).count() == 32 * (5 + 20 + 60 + 120 + 120)


def plain_sources(docs, min_docs=3, top=200):
    count, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        others = sorted(s for g, s in groups if g == lang)

        def p_of(counts):
            words = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (words + len(kept)) for t in kept}

        mine, whole = p_of(count[lang, source]), p_of(sum((count[lang, s] for s in others), Counter()))
        f = lambda p, q: (p - q) ** 2 // q
        pairs = []
        for s in others:
            if s != source:
                theirs = p_of(count[lang, s])
                pairs.append((sum(f(mine[t], theirs[t]) for t in kept), s))
        terms = [(f(mine[t], whole[t]), t) for t in kept if count[lang, source][t] and mine[t] > whole[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def random_docs(seed, n=240):
    rng = random.Random(seed)
    names = [f"T{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["É", "été", "日本", "straße", "ſ", "K"]
    return [(i, " ".join(rng.choice(names[: rng.choice((20, len(names)))]) for _ in range(rng.randrange(60))) + "_x1y", rng.choice(["en", "de", None]),
             rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(n)]


@pytest.mark.parametrize("extra", [False, True])
def test_divergence_of_sources(spark, extra):
    rows = [*random_docs(1), *ODD, *[(100 + i, "only one term", "fr", "a") for i in range(2)], (200, "other", "fr", "b"), (201, "?", "xx", "a")]
    assert sorted(tuple(r) for r in source_audit.audit(docs_of(spark, rows, extra)).collect()) == plain_sources(rows)


def test_blocks_and_flushes_change_nothing(spark, monkeypatch):
    rows = random_docs(2)
    docs = docs_of(spark, rows)
    kept = source_audit.vocabulary(source_audit.counts(docs))
    whole, cut = source_audit.column_blocks(kept), source_audit.column_blocks(kept, 7)
    assert cut.select("lang", "block").distinct().count() > whole.select("lang", "block").distinct().count()
    monkeypatch.setattr(source_audit, "HELD_TERMS", 5)
    assert len(list(source_audit._count_terms(iter([docs.fillna("").toArrow().combine_chunks().to_batches()[0]])))) > 10
    monkeypatch.setattr(source_audit, "column_blocks", lambda k: cut)
    assert sorted(tuple(r) for r in source_audit.audit(docs).collect()) == plain_sources(rows)


def test_divergence_of_an_empty_table(spark):
    assert typed(source_audit.audit(docs_of(spark, []))) == []


def test_runs_of_two_columns():
    rng = np.random.default_rng(3)
    a, b = np.repeat(rng.integers(0, 3, 20), 5), np.repeat(rng.integers(0, 4, 10), 10)
    terms = rng.integers(1, 5, 100)
    before = np.concatenate(([0], np.cumsum(terms)))
    p, q = a * 7 + 3, b * 5 + 2
    starts, other = source_audit.run_starts(a), source_audit.run_starts(b)
    want = int(((p - q) ** 2 // q * terms).sum())
    assert source_audit.pair_value(starts, p[starts], other, q[other], before) == want
    assert source_audit.scaled(np.array([10**13]), 10**13, 5).tolist() == [1 + 10**9 * (10**13 + 1) // (10**13 + 5)]
