"""Quality rules, quality network and language identification."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexspan.llm import language_id, quality_network, quality_rules, textkit as tk
from lexspan.llm.common import table
from llm_helpers import docs_of, held_out

TEN = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_base_counts_equal_a_plain_count(spark, small):
    texts = [r.text for r in table(spark, small, "documents").collect()]
    texts += [None, "", " \n", "a\na\n\nb\na", "\na", "x y z x y z", "x x x x", "é|é é|é é|é", "a b c\na b c", "one\x0btwo\x0cthree", "a b c"]
    at = 0
    for i, j, block in tk.blocks(pa.array(texts), 1 << 14):
        found = quality_rules.counts(block, tk.words(block))
        for r in range(j - i):
            assert {k: int(v[r]) for k, v in found.items()} == plain_counts(texts[at]), texts[at]
            at += 1
    assert at == len(texts)


@pytest.fixture(scope="module")
def marked(spark):
    return {r.doc_id: r.quality for r in table(spark, TEN, "labels").collect()}


def test_rules_model_on_held_out_rows(spark, marked):
    docs = table(spark, TEN, "documents")
    rows = quality_rules.judge(docs, quality_rules.fit(docs, table(spark, TEN, "labels"))).collect()
    mine = [(r.score >= 0.5) == (marked[r.doc_id] == 1) for r in rows if r.doc_id in marked and held_out(r.doc_id)]
    assert len(mine) > 50 and np.mean(mine) > 0.95
    assert all(not r.kept for r in rows if r.base_failed)
    good = [r.kept for r in rows if marked.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.97


def test_platt_scales_to_the_rate():
    z = np.r_[np.full(100, 1.0), np.full(100, -1.0)]
    label = np.r_[np.ones(80), np.zeros(20), np.ones(20), np.zeros(80)]
    slope, offset = quality_rules.platt(z, label)
    p = 1 / (1 + np.exp(-(slope * np.array([1.0, -1.0]) + offset)))
    assert np.allclose(p, [0.8, 0.2], atol=0.02)


def test_network_on_held_out_rows(spark, marked):
    docs = table(spark, TEN, "documents")
    rows = quality_network.score(docs, quality_network.fit(docs, table(spark, TEN, "labels"))).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in rows)
    mine = [r.predicted == marked[r.doc_id] for r in rows if r.doc_id in marked and r.held_out]
    assert len(mine) > 50 and np.mean(mine) > 0.95


@pytest.mark.parametrize("vocabulary, own", [(1000, 5), (4, 2), (0, 0)])
def test_word_vectors_equal_a_plain_sum(spark, vocabulary, own):
    texts = ["a b c a", "b b d", None, "e", "a"]
    found = quality_network.word_vectors(docs_of(spark, [(i, t, None, None) for i, t in enumerate(texts)]), vocabulary)
    assert len(found.head) == own  # a and b occur three times, the others once
    total = np.zeros(found.table.shape)
    for text in texts:
        hashes = tk.words(next(tk.blocks(pa.array([text])))[2]).hash
        row, (place, sign) = found.rows(hashes), quality_network.index_vectors(hashes)
        for i in range(len(row)):
            for j in range(max(0, i - 2), min(len(row), i + 3)):
                if i != j:
                    np.add.at(total[row[i]], place[j], sign[j])
    total /= np.maximum(np.sqrt((total**2).sum(axis=1, keepdims=True)), 1e-12)
    assert np.allclose(found.table / quality_network.UNIT, total, atol=0.51 / quality_network.UNIT)


def test_words_are_counted_whole_in_bounded_steps(spark, small, monkeypatch):
    docs = table(spark, small, "documents")
    count = Counter(w for r in docs.collect() for w in WORD.findall(r.text or ""))
    monkeypatch.setattr(quality_network, "_HELD_WORDS", 50)
    batches = [pa.record_batch({"text": pa.array([r.text for r in docs.collect()] * 2, pa.string())})] * 2
    parts = [b.to_pydict() for b in quality_network._count_words(iter(batches))]
    assert sum(n for b in parts for n in b["n"]) == 4 * sum(count.values()) and len(parts) > 1
    assert len({w for b in parts for w in b["word"]}) == len(count)
    # Whole classes of frequency, the most frequent first.
    classes = Counter(int(np.floor(np.log2(n) * 4)) for n in count.values())
    least = [c for c in sorted(classes, reverse=True) if sum(m for d, m in classes.items() if d >= c) <= 500][-1]
    assert len(quality_network.frequent_words(docs, 500)) == sum(m for d, m in classes.items() if d >= least)


def test_packed_rows_come_back():
    rng = np.random.default_rng(6)
    rows = np.concatenate([rng.integers(-n, n + 1, (40, 64)) for n in (1, 7, 8, 127, 128, 2**31 - 1)]).astype(np.int32)
    packed = quality_network._packed(rows)
    assert {len(p) for p in packed} == {32, 64, 256}
    assert (quality_network._unpacked(pa.array(packed, pa.binary())) == rows).all()


def test_pooling_long_and_short_texts(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = quality_network.Vectors(np.zeros(0, np.uint64), rng.integers(-32767, 32768, (1 << quality_network.TAIL_BITS, 64)).astype(np.int16))
    texts = ["", "one", "a b " * 3000, None, "c d e"]
    block = next(tk.blocks(pa.array(texts)))[2]
    whole = quality_network.pool(block, vectors)
    monkeypatch.setattr(quality_network, "_ROWS_AT_ONCE", 7)
    assert np.allclose(whole, quality_network.pool(block, vectors))
    for text, got in zip(texts, whole):
        x = vectors.table[vectors.rows(tk.words(next(tk.blocks(pa.array([text])))[2]).hash)] / quality_network.UNIT
        want = np.concatenate([x.mean(axis=0), x.std(axis=0)]) if len(x) else np.zeros(128)
        assert np.allclose(got, want)


def plain_ngrams(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    line = " " + " ".join(letters) + " " if letters else ""
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)
                   if line[i : i + n] != " " and not (n == 3 and line[i + 1] == " "))


def test_language_profiles_and_distance(spark):
    ids = [i for i in range(40) if not held_out(i)]
    rows = [(ids[0], "der hund und die katze", "de", "a"), (ids[1], "the dog and the cat", "en", "a"), (ids[2], "THE end", "en", "b"), (ids[3], "x", None, "b")]
    profiles = language_id.learn(docs_of(spark, rows))
    plain = {}
    for _, text, lang, _ in rows:
        if lang:
            plain.setdefault(lang, Counter()).update(plain_ngrams(text))

    def code(gram):
        value = 0
        for c in gram:
            value = value << 21 | ord(c)
        return value

    order = {lang: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))][:300] for lang, n in plain.items()}
    text = "the hound and katze"
    mine = [g for g, _ in sorted(plain_ngrams(text).items(), key=lambda x: (-x[1], code(x[0])))][:300]
    far = {lang: sum(abs(p.index(g) - i) if g in p else 300 for i, g in enumerate(mine)) for lang, p in order.items()}
    best = min(sorted(far), key=far.get)
    lang, score = profiles.nearest(text)
    assert lang == best and score == pytest.approx(1 - far[best] / (300 * len(mine)))
    assert profiles.nearest("123 !?") == ("und", 0.0) and profiles.nearest(None) == ("und", 0.0)


def test_language_on_held_out_rows(spark):
    docs = table(spark, TEN, "documents")
    spoken = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.predict(docs, language_id.learn(docs)).filter("held_out").collect()
    assert np.mean([r.lang_pred == spoken[r.doc_id] for r in rows]) > 0.97


def test_rare_languages_are_learned_beside_many_rows(spark):
    """One learnable row each of eight languages beside 90,000 rows of another."""
    many = spark.range(1000, 91_000).selectExpr("id AS doc_id", "'the cat and the dog' AS text", "'en' AS lang")
    ids = [i for i in range(40) if not held_out(i)][:8]
    rare = {f"x{i}": "abcdefgh"[i] * 3 + " " + "stuvwxyz"[i] * 3 for i in range(8)}
    few = spark.createDataFrame([(i, text, lang) for i, (lang, text) in zip(ids, rare.items())], "doc_id long, text string, lang string")
    profiles = language_id.learn(many.unionByName(few))
    assert profiles.langs == ("en", *rare)
    assert all(profiles.nearest(text)[0] == lang for lang, text in rare.items())


def test_counts_are_whole_when_a_task_gives_them_in_parts(monkeypatch):
    rows = [("en", "the cat"), ("de", "der hund"), ("en", "a dog"), ("en", None), ("de", "die katze")] * 3
    batches = [pa.record_batch({"lang": [lang for lang, _ in rows], "text": pa.array([t for _, t in rows])})]
    seen = []
    for limit in (language_id._PENDING, 5):
        monkeypatch.setattr(language_id, "_PENDING", limit)
        monkeypatch.setattr(language_id, "_HELD", limit)
        total = Counter()
        for part in language_id._count(iter(batches)):
            for r in part.to_pylist():
                total[r["lang"], r["code"]] += r["n"]
        seen.append(total)
    assert seen[0] == seen[1] and sum(seen[0].values()) == sum(len(language_id.ngrams(t)) for _, t in rows)
