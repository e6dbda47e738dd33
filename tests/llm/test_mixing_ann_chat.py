"""Mixing, nearest neighbours, chat logs and the pipeline."""

import time
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lexspan.llm import bag_minhash, chat_format, cross_polytope, language_id, mixing, pieces, pii
from lexspan.llm.common import landed, table
from llm_helpers import docs_of


def plain_awards(targets, caps, block, blocks):
    """The sources of the blocks with the highest quotients, one block at a time."""
    held, order = dict.fromkeys(targets, 0), []
    while len(order) < blocks:
        able = [s for s in targets if held[s] < caps[s]]
        best = max(able, key=lambda s: (targets[s] / (held[s] + min(held[s] + block, caps[s])), [-ord(c) for c in s or "~"]))
        n = min(block, caps[best] - held[best])
        held[best] += n
        order.append((best, n))
    return order


def test_targets_are_reshared_and_quotas_are_highest_quotients(spark, monkeypatch):
    words = {"a": 1000, "b": 90_000, "c": 40_000, "d": 7}
    rows = [(i, "w " * (n // 10), "en", s) for s, n in words.items() for i in range(10)] + [(99, "w " * 7, "en", "d"), (100, None, "en", None)]
    sized = mixing.sizes(docs_of(spark, rows))
    goals = {r.source: r for r in mixing.targets(sized).collect()}
    total = sum(r.source_size for r in goals.values())
    caps, weights = {s: 2 * r.source_size for s, r in goals.items()}, dict(zip("abcd", (5, 2, 1, 5)), **{})
    weights[None] = 2
    want, free, left = {}, set(goals), 1.5 * total
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > caps[s]}
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            left -= caps[s]
        free -= over
    want |= {s: weights[s] * level for s in free}
    assert {s: pytest.approx(r.target) for s, r in goals.items()} == want
    monkeypatch.setattr(mixing, "PARTS", 100)
    level = min(want[s] / weights[s] for s in free)
    block = int(level / 100)
    full = [s for s in want if s not in free]
    assert block > 100 and {"a", "d"} <= set(full)
    blocks = sum(-(-caps[s] // block) for s in full) + int((1.5 * total - sum(caps[s] for s in full)) / block + 0.5)
    named = {s: t for s, t in want.items() if t}
    order = plain_awards(named, caps, block, blocks)
    plain, words = defaultdict(int), defaultdict(int)
    for place, (s, n) in enumerate(order):
        plain[place * 7 // blocks + 1, s] += 1
        words[place * 7 // blocks + 1, s] += n
    shards = mixing.quotas(mixing.targets(sized), shards=7).collect()
    assert {(r.shard, r.source): r.quota for r in shards} == plain
    assert {(r.shard, r.source): r.words for r in shards} == words


def test_shards_take_their_quotas(spark, small):
    docs = table(spark, small, "documents")
    quota = defaultdict(int, {(r.shard, r.source): r.words for r in mixing.quotas(mixing.targets(mixing.sizes(docs))).collect()})
    rows = mixing.mix(docs, shard="part").select("source", "part", "text").collect()
    assert {r.part for r in rows} == set(range(1, mixing.SHARDS + 1))
    got, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(r.text.split())
        got[r.part, r.source] += n
        longest[r.source] = max(longest[r.source], n)
    # A use that spans the end of a shard belongs to the one in which it begins.
    assert all(abs(got[k] - quota[k]) <= longest[k[1]] for k in got.keys() | quota.keys())
    with pytest.raises(ValueError):
        mixing.mix(docs, shard="text")


def test_small_sources_get_their_targets_beside_millions_of_words(spark):
    """Sources under a block, of some blocks, and many small ones, where a block has 1,024 words."""
    sizes = {"a": [5_000_000], "b": [300], "c": [100] * 7, "d": [1500, 1501], "e": [0], "f": [2_600_000], None: [77]}
    many = {f"g{i}": [500] for i in range(3000)}
    for more in ({}, many):
        rows = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in (sizes | more).items() for n in ns)]
        sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
        got, want, whole = defaultdict(int), {}, defaultdict(int)
        for r in mixing.taken(sized).collect():
            assert 0 <= r.taken <= 2 * r.size
            got[r.source] += r.taken
            want[r.source], whole[r.source] = r.target, r.source_size
        small = [s for s in want if 2 * whole[s] < 128 * 1024]
        assert {"b", "c", "d", "e", None} <= set(small) and all(abs(got[s] - want[s]) <= 0.5 for s in small)
        assert got["b"] == 600 and got["d"] == 6002
        assert all(abs(got[s] - want[s]) <= 1024 for s in want)


def test_taken_words_come_near_targets(spark, small):
    rows = mixing.take(table(spark, small, "documents")).collect()
    got, want = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
    sources = {r.doc_id: r.source for r in table(spark, small, "documents").collect()}
    for r in rows:
        got[sources[r.doc_id]] += r.taken
        want[sources[r.doc_id]] = r.target
    assert all(abs(got[s] - want[s]) <= max(20, 0.01 * want[s]) for s in want)


def test_mixed_texts_have_the_taken_words(spark, small):
    docs = table(spark, small, "documents")
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    want = {r.doc_id: r.taken for r in mixing.take(docs).collect() if r.taken}
    off = {i for i in want.keys() | taken.keys() if taken[i] != want.get(i, 0)}
    # Equal ids and sizes may be ordered by their texts; none here.
    assert not off


def test_nearest_equals_brute_force_where_found(spark, small):
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings").select("vec_id", "embedding")
    rows = vectors.collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=float)
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    found = defaultdict(list)
    for r in cross_polytope.nearest(vectors, vectors.filter("vec_id % 10 = 0")).orderBy("query_id", "rank").collect():
        found[r.query_id].append(r)
    hits = []
    for q in np.flatnonzero(ids % 10 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:5]]
        mine = found[ids[q]]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - score[ids == r.vec_id][0]) < 1e-12 for r in mine)
        hits.append(len(set(best) & {r.vec_id for r in mine}) / 5)
    assert np.mean(hits) >= 0.9


def test_nearest_with_odd_vectors_and_copies(spark, monkeypatch):
    monkeypatch.setattr(cross_polytope, "VECTORS_AT_ONCE", 50)
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000, [3.0, 2.0, 1.0]), (1001, [1e200, 2e200, 3e200]), (1002, [0.0, 0.0, 0.0]), (1003, None),
            (1004, [1.0, None, 2.0]), (1005, [nan, 1.0, 1.0]), (1006, [inf, 1.0, 1.0]), (1007, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in cross_polytope.nearest(vectors, vectors.filter("vec_id in (0, 250, 1000, 1002, 1007)"), probes=6).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[250] == [0, 1, 2, 3, 4]
    assert set(got) <= {0, 250, 1000}


def test_repeated_rows_of_one_id_leave_room_for_the_others(spark):
    """A near vec_id repeated 50 times, as equal rows or as rows that differ, takes one place."""
    def at(angle, length=1.0):
        return [length * float(np.cos(angle)), length * float(np.sin(angle))]

    others = [(i, at(0.02 * i)) for i in range(2, 10)]
    for copies in ([(1, at(0.01))] * 50, [(1, at(0.01 + 1e-5 * i)) for i in range(50)], [(1, at(0.01, 2.0**i)) for i in range(50)]):
        vectors = spark.createDataFrame([(0, at(0.0)), *copies, *others], "vec_id long, embedding array<double>")
        got = cross_polytope.nearest(vectors, vectors.filter("vec_id = 0")).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [1, 2, 3, 4, 5]
        assert got[0].score == pytest.approx(np.cos(0.01), abs=1e-12)


def test_rotation_keeps_lengths_and_first_probe_is_the_bucket():
    x = np.random.default_rng(0).normal(size=(50, 48))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    assert np.allclose((cross_polytope.rotated(x, 3) ** 2).sum(axis=1), 1)
    assert (cross_polytope.buckets(x, 1, 2, 9)[:, 0] == cross_polytope.buckets(x, 1, 2, 1)[:, 0]).all()


def test_folding_a_log(spark):
    log = spark.createDataFrame([
        (1, 1, 1, "start", "user", None), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"), (1, 1, 5, "edit", None, "Bye"), (1, 1, 6, "delta", None, "!"),
        (1, 2, 7, "start", "assistant", None), (1, 2, 8, "delta", None, "bad"), (1, 2, 9, "regenerate", None, None), (1, 2, 10, "delta", None, "good "),
        (1, 2, 11, "delta", None, None), (1, 2, 12, "delta", None, "day"), (None, 1, 1, "delta", None, "no start"),
    ], "conv_id long, message int, seq int, kind string, role string, text string")
    assert {(r.conv_id, r.message, r.role, r.text) for r in chat_format.fold(log).collect()} == {
        (1, 1, "user", "Bye!"), (1, 2, "assistant", "good day"), (None, 1, "", "no start")}


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\n <s", "[ROLE] x [=] y [/ROLE]\n", "<<s>s>", "", None, "<\\/s>"]
    rows = [(i % 3, i, role, t) for i, (t, role) in enumerate((t, r) for t in texts for r in ("user", "assistant", "system", "tool [=] x", None))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    shown = chat_format.render(chat_format.fold(chat_format.event_log(turns, delta=3))).collect()
    back = {(r.conv_id, r.message.turn): chat_format.read_turn(r.turn_text) for r in shown}
    assert back == {(c, t): (role or "", text or "") for c, t, role, text in rows}
    for r in shown:
        body = r.turn_text[r.loss_from : r.loss_to] if r.loss_from is not None else ""
        assert not any(mark in body for mark in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_long_messages_are_read_in_linear_time(spark):
    texts = ["a[INST]é\U0001f600\n\\" * 250_000, "x" * 3_000_000, "y" * 399, "y" * 400, "y" * 401, ""]
    turns = spark.createDataFrame([(1, i, r, t) for i, t in enumerate(texts) for r in ("user", "assistant")], "conv_id long, turn long, role string, text string")
    begun = time.monotonic()
    got = {(r.message.turn, r.role): r.text for r in chat_format.fold(chat_format.event_log(turns)).collect()}
    assert time.monotonic() - begun < 30
    assert got == {(i, r): t for i, t in enumerate(texts) for r in ("user", "assistant")}


def test_pipeline_equals_its_operators_one_by_one(spark, small):
    """Every stage against a plain form of it on the rows that it was given."""
    docs = table(spark, small, "documents")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(landed(stage(spark, steps[-1], small), name))
    known, apart, masked, mixed = (s.collect() for s in steps[1:])
    profiles = language_id.learn(docs)
    want = [(r.doc_id, *profiles.nearest(r.text)) for r in docs.collect()]
    assert sorted((r.doc_id, r.lang) for r in known) == sorted((i, lang) for i, lang, score in want if lang != "und" and score >= language_id.LEAST_SCORE)
    classes = defaultdict(set)
    for r in bag_minhash.classes(steps[1]).collect():
        classes[r.class_id].add(r.doc_id)
    assert sorted(r.doc_id for r in apart) == sorted(map(min, classes.values()))
    model = pii.learn(steps[2])
    before = {r.doc_id: r.text for r in apart}
    assert {r.doc_id: r.text for r in masked} == {i: pii.masked(t, pii.spans(t, model)[1]) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in masked + mixed)
    encoder = pieces.Encoder(pieces.load())
    final = corpus_pipeline.run(spark, small).collect()
    texts = sorted((r.doc_id, r.text) for r in mixed)
    assert sorted((r.doc_id, encoder.decode(np.array(r.ids, dtype=int))) for r in final) == texts
    assert all(r.n_tokens == len(r.ids) for r in final)
