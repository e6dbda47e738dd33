"""Near-duplicates against all pairs, and the signature against the similarity."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexspan.llm import bag_minhash, textkit as tk
from lexspan.llm.common import table
from llm_helpers import docs_of


def bag(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def alike(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def groups_of(texts):
    """Components of equal or similar texts, by all pairs."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [bag(t) if t.split() else None for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (bags[i] and bags[j] and alike(bags[i], bags[j]) >= 0.8):
                root[find(i)] = find(j)
    found = defaultdict(set)
    for i in range(len(texts)):
        found[find(i)].add(i)
    return sorted(map(sorted, found.values()))


def classes_of(spark, texts):
    found = defaultdict(set)
    for r in bag_minhash.classes(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect():
        found[r.class_id].add(r.doc_id)
        assert r.class_id <= r.doc_id
    return sorted(map(sorted, found.values()))


def test_classes_equal_all_pairs(spark, small):
    texts = [r.text for r in table(spark, small, "documents").collect()]
    assert classes_of(spark, texts) == groups_of(texts)


@pytest.mark.parametrize("at_once", [None, 8])
def test_hot_group_around_the_threshold(spark, monkeypatch, at_once):
    """Many changed copies of one text: some linked by a chain, some not at all; also in small parts."""
    if at_once:
        for name in ("BLOCK_NODES", "PAIRS_AT_ONCE", "LABELS_AT_ONCE"):
            monkeypatch.setattr(bag_minhash, name, at_once)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        words = list(base)
        for at in rng.choice(120, rng.integers(1, 6), replace=False):
            words[at] = f"x{rng.integers(1_000_000)}"
        texts.append(" ".join(words))
    texts += [t for t in texts[:20]] + ["apart " * 3, "", "a b"]
    assert classes_of(spark, texts) == groups_of(texts)


def test_signature_is_unbiased_for_weights():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 6, 40), rng.integers(0, 6, 40)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    hits = []
    for trial in range(60):
        code = tk.mix(np.arange(40, dtype=np.uint64) + np.uint64(1000 * (trial + 1)))
        text = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
        both = bag_minhash.signatures(text, np.r_[code[a > 0], code[b > 0]], np.r_[a[a > 0], b[b > 0]], 2)
        assert (both != 0).all()
        hits.append((both[0] == both[1]).mean())
    assert abs(np.mean(hits) - want) < 0.025


def test_similarity_is_the_multiset_jaccard():
    pairs = [("a b c d e f g", "a b c d e f h"), ("x " * 30, "x " * 20), ("a b", "a b"), ("a b", "b a"), ("", "")]
    first, second = (next(tk.blocks(pa.array([p[i] for p in pairs])))[2] for i in (0, 1))
    want = [alike(bag(a), bag(b)) if a else 0.0 for a, b in pairs]
    assert np.allclose(bag_minhash.similarity(first, second), want)


def test_one_of_each_keeps_whole_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "en", "a"), (3, text, "de", "b"), (3, text, "de", "b"), (None, text + " z", "en", "c"), (9, "other words", "en", "a"), (9, "other words", "en", "a")]
    kept = bag_minhash.one_of_each(docs_of(spark, rows, extra=True)).collect()
    assert sorted((r.doc_id, r.lang, r.source, r.key) for r in kept) == [(3, "de", "b", "x"), (9, "en", "a", "x")]
