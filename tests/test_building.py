import hashlib
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.operators import acceptable as A, cells as C, coverage as V, encode as E, evalset as G, fingerprint as H, frequency as Z, pool as P, vocab_audit as U
from lexspan.sources import stores as T
from tests.conftest import rows

CELL = "word string, sense_key string, row long, vec array<float>"


def test_pool_layout_and_targets(spark):
    lemmas = spark.createDataFrame([("a", "n:1"), ("b", "n:1"), ("cc", "n:2"), ("d", "n:3")], "lemma_lower string, sense_key string").withColumn("gloss", F.lit("g")).withColumn("examples", F.array(F.lit("x")))
    vocab = spark.createDataFrame([("A",), ("a",), ("b",), ("CC",), ("zz",)], "word string")
    words = P.eligible_words(vocab, lemmas)
    assert rows(words) == [("A",), ("CC",), ("a",), ("b",)]
    found = P.resolve_targets(spark.createDataFrame([("a",), ("cc",), ("none",)], "target string"), words)
    assert rows(found) == [("a", "A"), ("cc", "CC"), ("none", None)]
    picked = found.filter("word is not null").select("word").distinct()
    rest = P.distractors(words, picked, "s:")
    assert rows(rest) == [("a",), ("b",)]
    assert P.distractors(words, picked, "s:", 1).count() == 1
    pool = P.lay_out(picked, rest, "t:")
    assert rows(pool, "row") == [(0,), (1,), (2,), (3,)]
    assert rows(pool.repartition(9)) == rows(P.lay_out(picked.repartition(3), rest.repartition(2), "t:"))
    check = P.layout_check(pool).first()
    assert check["even_row"] == 1.5 and check["pool_words"] == 4
    stats = P.sense_stats(pool, P.gloss_rows(pool, lemmas)).first()
    assert (stats["gloss_rows"], stats["max_senses"], stats["example_share"]) == (4, 1, 1.0)


def test_synset_collapse_and_its_guard(spark):
    same = [("b", "k1", 0, [1.0, 2.0]), ("a", "k1", 1, [1.0, 2.0]), ("b", "k1", 2, [1.0, 2.0]), ("c", "k2", 3, [0.5, 0.5])]
    cell = spark.createDataFrame(same, CELL)
    assert rows(C.collapse_synsets(cell), "sense_key", "word", "row") == [("k1", "b", 0), ("k2", "c", 3)]
    assert rows(C.synset_members(cell)) == [("k1", "a", 1), ("k1", "b", 0), ("k2", "c", 3)]
    assert rows(C.collapse_synsets(cell)) == rows(C.collapse_synsets(cell.repartition(5)))
    bad = cell.unionByName(spark.createDataFrame([("d", "k2", 4, [0.5, 0.6])], CELL))
    with pytest.raises(C.RefusedError):
        C.collapse_synsets(bad)
    assert rows(C.divergent_rows(bad), "row") == [(3,), (4,)]
    report = C.collapse_report(bad, 384, 256).first()
    assert (report["rows"], report["synsets"], report["divergent_synsets"], report["rows_saved"]) == (5, 2, 1, 3)


def tree(texts, block=4096):
    level = [hashlib.sha256(b"".join(t.encode() + b"\0" for t in texts[i : i + block])).hexdigest() for i in range(0, len(texts), block)]
    while True:
        level = [hashlib.sha256("".join(level[i : i + block]).encode()).hexdigest() for i in range(0, len(level), block)]
        if len(level) == 1:
            return level[0]


@pytest.mark.parametrize("n, step", [(300, 1), (5000, 1), (5, 5000)])
def test_fingerprint_is_one_tree_at_any_size_and_sees_order(spark, n, step):
    texts = [f"text {i}\nwith line" for i in range(n)]
    df = spark.createDataFrame([(i * step, t) for i, t in enumerate(texts)], "row long, text string")
    found = H.texts_digest(df.repartition(7)).collect()
    assert [r[0] for r in found] == [tree(texts)]
    swapped = df.withColumn("row", F.when(F.col("row") == 3 * step, 4 * step).when(F.col("row") == 4 * step, 3 * step).otherwise(F.col("row")))
    assert H.texts_digest(swapped).first()[0] != tree(texts)


def test_fingerprint_tree(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 4)
    texts = [f"t{i}" for i in range(37)]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    assert H.texts_digest(df).first()[0] == tree(texts, 4)
    # A group's digest does not depend on how large the other groups are.
    both = df.withColumn("g", F.lit("a")).unionByName(df.filter("row < 3").withColumn("g", F.lit(None).cast("string")))
    assert {r["g"]: r["sha256"] for r in H.texts_digest(both, ["g"]).collect()} == {"a": tree(texts, 4), None: tree(texts[:3], 4)}


def test_vector_bytes_hash(spark):
    vec = [0.1, -2.5, 3.0]
    df = spark.createDataFrame([(0, vec), (1, [1.0])], "row long, vec array<float>")
    got = dict(rows(H.vector_bytes_hash(df, ["row"])))
    assert got[0] == hashlib.sha256(struct.pack("<3f", *vec)).hexdigest()
    assert got[1] == hashlib.sha256(struct.pack("<f", 1.0)).hexdigest()


def test_derived_vectors_and_drift(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(20)]
    derived = C.derive_vectors(spark.createDataFrame(data, "row long, vec array<float>"), 4)
    row = C.drift(derived).first()
    assert 0 < row["max_component_error"] < 1e-3 and 0.999999 < row["min_cosine"] <= row["mean_cosine"] <= 1 + 1e-12
    full = C.derive_vectors(spark.createDataFrame(data, "row long, vec array<float>"), 8, half=False)
    assert "rounded" not in full.columns


def test_backfill_never_overwrites_a_mismatch(spark, tmp_path):
    meta = spark.createDataFrame([("a", "gloss", "gloss", 5, None), ("b", "gloss", "gloss", 5, "w"), ("c", "gloss", "gloss", 5, "x"), ("d", "gloss", "odd", 5, None), ("e", "gloss", "gloss", 4, None)],
                                 "cell string, representation string, variant string, rows long, inputs_sha256 string")
    want = spark.createDataFrame([("gloss", "w")], "variant string, want string")
    pool = spark.createDataFrame([("gloss", 5)], "representation string, want_rows long")
    verdicts = C.backfill_verdicts(meta, want, pool)
    assert rows(verdicts, "cell", "verdict") == [("a", "backfilled"), ("b", "matches"), ("c", "mismatch"), ("d", "unknown variant"), ("e", "different pool")]
    assert rows(C.apply_backfill(verdicts), "cell", "inputs_sha256") == [("a", "w"), ("b", "w"), ("c", "x"), ("d", None), ("e", None)]
    path, vectors = str(tmp_path / "store"), spark.createDataFrame([(c, f"v{c}") for c in "abcd"], "cell string, sha256 string")
    assert T.publish_meta(meta, path) == 0
    again = C.backfill_verdicts(T.read_meta(spark, path), want, pool)
    assert T.publish_meta(C.apply_backfill(again, vectors), path) == 1
    assert rows(T.read_meta(spark, path), "cell", "inputs_sha256", "vectors_sha256") == [
        ("a", "w", "va"), ("b", "w", "vb"), ("c", "x", None), ("d", None, "vd"), ("e", None, None)]
    assert rows(T.read_meta(spark, path, 0), "cell", "inputs_sha256") == rows(meta, "cell", "inputs_sha256")
    # A write that broke off is not a version, and a second run changes nothing.
    (tmp_path / "store" / "meta_versions" / "version=7").mkdir()
    once_more = C.apply_backfill(C.backfill_verdicts(T.read_meta(spark, path).drop("verdict"), want, pool), vectors)
    assert rows(once_more, "cell", "inputs_sha256", "vectors_sha256") == rows(T.read_meta(spark, path), "cell", "inputs_sha256", "vectors_sha256")
    with pytest.raises(ValueError, match="no such version"):
        T.read_meta(spark, path, 7)


def test_self_retrieval_finds_shifted_rows(spark):
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(30, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    data = [(f"w{i}", f"k{i // 2}", i, [float(x) for x in vecs[i // 2]]) for i in range(30)]
    cell = spark.createDataFrame(data, CELL)
    samples = C.hash_sample(cell.select("word", "sense_key", F.col("vec").alias("qvec")), "7", 12)
    good = C.self_retrieval(cell, samples, True).first()
    assert (good["n"], good["rank1"], good["top10"]) == (12, 12, 12) and good["exact_word_rank1"] <= 12
    shifted = cell.withColumn("sense_key", F.concat(F.lit("k"), ((F.col("row") + 2) / 2).cast("int").cast("string")))
    assert C.self_retrieval(shifted, samples, True).first()["rank1"] < 12


def test_draft_rules(spark):
    draft = spark.createDataFrame([(1, "hat", "what you wear", "cloth"), (2, "HAT", "something for the head", "x"), (3, "dog", "a dog", "two words"), (4, "cat", "pet animal meows", "x")],
                                  "position long, target string, query string, hint string")
    assert rows(G.violations(draft), "position", "reason") == [
        (2, "duplicate target"), (3, "query contains the target"), (3, "query is only 2 words"), (3, "sense hint is 2 words, max 1")]
    with pytest.raises(C.RefusedError):
        G.check_draft(draft)
    assert G.check_draft(draft.filter("position in (1, 4)")).count() == 2


def test_empty_authored_slice_is_refused(spark):
    trip = spark.createDataFrame([("x",)], "id string")
    with pytest.raises(ValueError):
        G.assemble(trip.filter("false"), trip)
    assert G.assemble(None, trip) is trip


def test_merge_is_idempotent(spark):
    draft = spark.createDataFrame([(1, " hat ", "cap, Lid"), (2, "dog", ""), (3, "cat", "puss")], "position long, target string, acceptable string")
    props = spark.createDataFrame([("hat", 2, "bonnet"), ("hat", 1, "lid"), ("hat", 3, "Bonnet"), ("dog", 1, "hound"), ("gone", 1, "x")], "target string, position long, candidate string")
    merged = A.merge_accepted(draft, props)
    assert rows(merged, "position", "acceptable", "added", "kept") == [(1, "cap, Lid, bonnet", 1, 2), (2, "hound", 1, 0), (3, "puss", 0, 0)]
    again = A.merge_accepted(merged.select("position", "target", "acceptable"), props)
    assert rows(again, "position", "acceptable", "added") == [(1, "cap, Lid, bonnet", 0), (2, "hound", 0), (3, "puss", 0)]
    assert rows(A.unmatched_targets(draft, props)) == [("gone",)]


def test_merge_of_a_long_cell_loses_no_entry(spark, monkeypatch):
    monkeypatch.setattr(A, "MAX_CELL", 3)
    draft = spark.createDataFrame([(1, "hat", "cap"), (2, "dog", "")], "position long, target string, acceptable string")
    props = spark.createDataFrame([("hat", i, f"w{i}") for i in range(12)] + [("dog", 1, "hound")], "target string, position long, candidate string")
    merged = A.merge_accepted(draft, props)
    cell = ", ".join(["cap", *(f"w{i}" for i in range(12))])
    assert rows(merged, "position", "acceptable", "added", "kept") == [(1, cell, 12, 1), (2, "hound", 1, 0)]
    assert rows(A.merge_summary(merged)) == [(2, 13, 1)]
    assert A.overlong_entries(draft, props).count() == 13


def test_review_counts_equal_a_replay(spark):
    syn = {"k1": ["sin", "SIN", "Sin", "wickedness", "ev"], "k2": ["CD", "Cd", "candle", "sin"], "k3": ["Mar", "mar", "flaw"], "k4": ["alone"]}
    glosses = spark.createDataFrame([(k, w) for k, ws in syn.items() for w in ws], "sense_key string, word string")
    targets = ["sin", "CD", "flaw", "alone"]
    got = {(r["target"], r["sense_key"]): r for r in A.review_entries(glosses, spark.createDataFrame([(t,) for t in targets], "word string")).collect()}
    want = {}
    for t in targets:
        for k, ws in syn.items():
            if t not in ws or len(ws) < 2:
                continue
            cands = [w for w in ws if w != t]
            kept = [c for c in cands if c.lower() != t.lower()]
            groups = {}
            for c in kept:
                groups.setdefault(c.lower(), []).append(c)
            symbols = [g for b, g in groups.items() if len(b) <= 3 and all(any(ch.isupper() for ch in v) for v in g)]
            plain = [g for g in groups.values() if g not in symbols]
            want[(t, k)] = (len(cands), len(plain), len(cands) - len(kept), sum(len(g) - 1 for g in plain), len(symbols))
    assert {k: (r["before"], r["after"], r["target_case_variants"], r["case_duplicates"], r["symbol_forms"]) for k, r in got.items()} == want


def test_lemma_zipf_needs_every_token(spark):
    table = spark.createDataFrame([("red", 5.0), ("herring", 3.0)], "word string, zipf double")
    got = Z.lemma_zipf(spark.createDataFrame([("red herring",), ("Red-red",), ("red blob",), ("-",)], "word string"), table)
    assert rows(got) == [("-", None), ("Red-red", 5.0), ("red blob", None), ("red herring", 3.0)]


def test_capital_costs_and_view(spark):
    vocab = spark.createDataFrame([("Damascene",), ("damascene",), ("Peary",), ("Scotch egg",), ("a.b",), ("ok word",)], "word string")
    assert tuple(U.capital_costs(vocab).first()) == (1, 1, 1)
    U.answerable(vocab, "answerable_vocab")
    assert rows(spark.table("answerable_vocab")) == [("damascene",), ("ok word",)]


def test_orphans_and_derivations(spark):
    lemmas = spark.createDataFrame([("verb", "loiter"), ("verb", "roam"), ("verb", "x1"), ("noun", "dog")], "pos string, lemma string")
    vocab = spark.createDataFrame([("Loiterer",), ("dog",), ("wander",)], "word string")
    mates = spark.createDataFrame([("verb", "v:1", "roam"), ("verb", "v:1", "wander"), ("verb", "v:2", "loiter")], "pos string, sense_key string, lemma string")
    assert rows(V.orphans(lemmas, mates, vocab), "pos", "missing", "covered", "orphaned") == [("verb", 2, 1, 1)]
    assert rows(V.derived_without_base(lemmas, vocab)) == [("loiterer", "loiter")]


def test_encoder_is_loaded_per_task_and_gives_unit_vectors(spark):
    df = spark.createDataFrame([("a bc",), ("a bc",), ("",)], "text string").repartition(2)
    got = [r[0] for r in df.select(E.encode_column(F.col("text"), lambda: E.HashingEncoder(16))).collect()]
    lengths = sorted(round(float(np.linalg.norm(v)), 5) for v in got)
    assert lengths == [0.0, 1.0, 1.0]


def test_digest_encoder_counts_words_in_bytes():
    texts = ["", "a", "aéb c a", "日本 x1", ".", "A\0B a", "word " * 50, "x" * 3]
    got = E.DigestEncoder(8, "s").encode(texts)
    for text, vec in zip(texts, got):
        want = np.zeros(8)
        for word in re.findall("[A-Za-z0-9]+", text):
            digest = hashlib.md5(("s" + word).encode()).hexdigest()
            want[int(digest[:4], 16) % 8] += 1 if int(digest[4], 16) < 8 else -1
        want[0] = want[0] if want.any() else 1
        assert np.array_equal(vec, want / np.sqrt((want**2).sum()))
    assert E.DigestEncoder(8).encode([]).shape == (0, 8)


def test_all_cells_in_one_pass_equal_cells_one_by_one(spark):
    class Once(E.DigestEncoder):
        def encode(self, texts):
            assert len(set(texts)) == len(texts)
            return E.DigestEncoder.encode(self, texts)

    pool = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "row long, word string")
    glosses = spark.createDataFrame(
        [(i, f"w{i}", f"k{i // 3}", f"gloss {i // 3}", ["x"] if i % 4 == 0 else []) for i in range(40)] + [(40, "w", "k", None, [])],
        "row long, word string, sense_key string, gloss string, examples array<string>").coalesce(1)
    names = list(E.CELLS)
    loads = {n: (lambda n=n: Once(16, n)) for n in ("tuned", "base")}
    together = E.build_cells(names, pool, glosses, loads)
    plain = {n: (lambda n=n: E.DigestEncoder(16, n)) for n in ("tuned", "base")}
    for name in names:
        alone = E.build_cell(name, E.cell_inputs(name, pool, glosses), plain)
        key = lambda r: (r.row, r.sense_key)
        assert sorted(together.filter(F.col("cell") == name).collect(), key=key) == sorted(alone.collect(), key=key)
    assert together.columns == alone.columns
