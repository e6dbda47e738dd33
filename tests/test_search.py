import numpy as np
import pyarrow as pa
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.operators import lists as L, neighbours as N, search as S
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(spark):
    """600 rows; a third share one vector and one word holds a third of the rows."""
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(600, 16)).astype(np.float32)
    vec[:200] = vec[0]
    out = []
    for i in range(600):
        word = "hot" if i % 3 == 0 else f"w{i % 97:02d}"
        out.append((word, f"s:{i:04d}", i, [float(x) for x in vec[i]]))
    queries = [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(40)] + [(40, out[0][3])]
    return (out, queries, spark.createDataFrame(out, "word string, sense_key string, row long, vec array<float>"),
            spark.createDataFrame(queries, "qid long, qvec array<float>"))


def brute(out, queries, k, by_word=False):
    want = []
    for qid, q in queries:
        sims = []
        for word, key, row, v in out:
            total = 0.0
            for a, b in zip(v, q):
                total += a * b
            sims.append((-total, word, key, row))
        if by_word:
            best = {}
            for s, w, _, _ in sims:
                best[w] = min(s, best.get(w, s))
            ranked = sorted((s, w) for w, s in best.items())[:k]
            want += [(qid, i + 1, w, -s) for i, (s, w) in enumerate(ranked)]
        else:
            want += [(qid, i + 1, w, key, row, -s) for i, (s, w, key, row) in enumerate(sorted(sims)[:k])]
    return sorted(want)


@pytest.fixture(params=["scan", "blocks"])
def path(request, monkeypatch):
    if request.param == "blocks":
        monkeypatch.setattr(S, "BROADCAST_QUERIES", 5)
        monkeypatch.setattr(S, "QUERIES_PER_BLOCK", 16)
        monkeypatch.setattr(S, "VECTORS_PER_BLOCK", 150)


COLS = ["qid", "rank", "word", "sense_key", "row", "sim"]


@pytest.mark.parametrize("k", [1, 10, 250])
def test_rows_equal_brute_force(data, path, k):
    out, queries, v, q = data
    assert rows(S.exact_rows(q, v, k), *COLS) == brute(out, queries, k)


def test_best_sense_with_a_hot_word(data, path):
    out, queries, v, q = data
    assert rows(S.best_sense_topk(q, v, 10)) == brute(out, queries, 10, by_word=True)


def test_partitioning_does_not_matter(data):
    _, _, v, q = data
    assert rows(S.exact_rows(q, v.repartition(1), 20)) == rows(S.exact_rows(q.repartition(3), v.repartition(7), 20))


def test_all_lists_equal_exact_and_fewer_lists_are_a_subset(data, path):
    _, _, v, q = data
    centroids = L.train_centroids(v, 6)
    listed = L.assign_lists(v, centroids)
    assert rows(L.probed_topk(q, listed, centroids, 10, 6)) == rows(S.exact_topk(q, v, 10))
    some = L.probed_topk(q, listed, centroids, 10, 2)
    assert some.groupBy("qid").count().filter("count > 10").count() == 0


def test_lists_store(data, spark, tmp_path):
    _, _, v, q = data
    centroids = L.train_centroids(v, 4)
    L.write_lists(L.assign_lists(v, centroids), str(tmp_path / "lists"))
    stored = spark.read.parquet(str(tmp_path / "lists"))
    assert rows(L.probed_topk(q, stored, centroids, 5, 4)) == rows(S.exact_topk(q, v, 5))


def test_two_levels_find_the_same_lists():
    """Clustered centroids, ties, a zero vector; groups that cannot reach the bound are not compared."""
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 16))
    centres = L._unit(np.repeat(heads, 20, axis=0) + 0.1 * rng.normal(size=(240, 16)))
    centres[7] = centres[3]
    group = np.repeat(np.arange(12), 20)
    sums = np.zeros((12, 16))
    np.add.at(sums, group, centres)
    flat = L.Centroids(np.arange(240), centres, np.zeros(240, dtype=int), L._unit(centres.sum(axis=0)[None]))
    two = L.Centroids(np.arange(240), centres, group, L._unit(sums))
    x = np.concatenate([rng.normal(size=(200, 16)), np.zeros((1, 16)), 5 * heads])
    for m in (1, 3, 30, 240, 500):
        assert (L.nearest(x, two, m) == L.nearest(x, flat, m)).all()
    compared = []
    scores = L._scores
    L._scores = lambda a, b: compared.append(len(a) * len(b)) or scores(a, b)
    try:
        L.nearest(5 * heads, two, 3)
    finally:
        L._scores = scores
    assert sum(compared) < 0.6 * len(heads) * 240


def test_a_stored_index_reads_the_folders_of_its_lists_only(data, spark, tmp_path):
    _, _, v, q = data
    centroids = L.grouped(L.train_centroids(v, 9))
    L.store_lists(L.assign_lists(v, centroids), centroids, str(tmp_path / "index"))
    index = L.open_lists(spark, str(tmp_path / "index"))
    assert rows(L.stored_topk(q, index, 10, 9)) == rows(S.exact_topk(q, v, 10))
    one = L.stored_topk(q.filter("qid = 3"), index, 5, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list_id" in plan
    assert one.count() == 5
    assert L.stored_topk(q.filter("qid < 0"), index).count() == 0


def test_neighbours_leave_out_the_word_itself(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("A", [1.0, 0.0]), ("c", [0.0, 1.0])], "word string, vec array<double>")
    slugs = spark.createDataFrame([("a",), ("unknown",)], "slug string")
    assert [r["word"] for r in S.neighbours(slugs, v, 2).orderBy("rank").collect()] == ["A", "b"]


@pytest.mark.parametrize("blocks", [1, 3, 16])
def test_all_neighbours_equal_the_search(spark, monkeypatch, blocks):
    """Ties, words of several rows, words that are not asked for; few and many blocks."""
    monkeypatch.setattr(N, "BLOCK_ROWS", -(-700 // blocks))
    monkeypatch.setattr(N, "LEAST_ROWS", 10_000)
    rng = np.random.default_rng(2)
    vec = rng.normal(size=(700, 8))
    vec[:150] = vec[0]
    data = [(f"w{i % 640}", i, [float(x) for x in v]) for i, v in enumerate(vec)]
    v = spark.createDataFrame(data, "word string, row long, vec array<double>")
    slugs = spark.createDataFrame([(f"w{i}",) for i in range(0, 700, 3)], "slug string")
    # A word of several rows is asked with all of them, so only words of one row are compared.
    once = v.groupBy("word").count().filter("count = 1").select(F.col("word").alias("qid"))
    got, want = N.all_neighbours(slugs, v, 5), S.neighbours(slugs, v, 5)
    assert rows(got.join(once, "qid")) == rows(want.join(once, "qid"))
    assert rows(got.select("qid").distinct()) == rows(want.select("qid").distinct())


def test_each_pair_of_words_is_scored_once(monkeypatch):
    rng = np.random.default_rng(1)
    n, b = 3000, 2
    done = []
    product = N._product
    monkeypatch.setattr(N, "_product", lambda x, y: done.append(len(x) * len(y)) or product(x, y))
    table = pa.table({"word": [f"w{i}" for i in range(n)], "sense_key": [""] * n, "row": list(range(n)), "vec": rng.normal(size=(n, 8)).tolist(),
                      "asked": [True] * n, "own": [i % b for i in range(n)], "floor": [-np.inf] * n})
    own = np.arange(n) % b
    for pair in ([0], [1], [0, 1]):
        N.pair_hits(table.filter(pa.array(np.isin(own, pair))), 3)
    assert n * (n - 1) / 2 <= sum(done) <= 0.55 * n * n


def test_synset_expansion_stops_at_k_and_keeps_first_mention(spark):
    cell = spark.createDataFrame([("s1", "a", [1.0, 0.0]), ("s2", "b", [0.9, 0.1]), ("s3", "z", [0.1, 0.9])], "sense_key string, word string, vec array<double>")
    members = spark.createDataFrame([("s1", "a", 0), ("s1", "b", 1), ("s2", "b", 0), ("s2", "c", 1), ("s2", "d", 2), ("s3", "z", 0)], "sense_key string, word string, member_pos long")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>")
    got = S.synset_topk(q, cell, members, 3).orderBy("rank").collect()
    assert [(r["word"], r["sim"]) for r in got] == [("a", 1.0), ("b", 1.0), ("c", 0.9)]


def test_member_orders(spark):
    members = spark.createDataFrame([("s", "Bb", 0), ("s", "aa", 1), ("s", "cc", 2)], "sense_key string, word string, member_pos long")
    lexicon = spark.createDataFrame([("s", "aa", 0), ("s", "bb", 1)], "sense_key string, word string, position int")
    zipf = spark.createDataFrame([("cc", 3.0), ("bb", 2.0)], "word string, zipf double")
    order = lambda df: [r["word"] for r in df.orderBy("member_pos").collect()]
    assert order(S.member_order(members, "lexicon", lexicon=lexicon)) == ["aa", "Bb", "cc"]
    assert order(S.member_order(members, "zipf", zipf=zipf)) == ["cc", "Bb", "aa"]
    assert order(S.member_order(members, "index")) == ["Bb", "aa", "cc"]
    with pytest.raises(ValueError):
        S.member_order(members, "other")


def test_overfetch_may_return_fewer_words(spark):
    v = spark.createDataFrame([("a", str(i), i, [1.0 - i / 100, 0.0]) for i in range(4)] + [("b", "x", 9, [0.1, 0.0])], "word string, sense_key string, row long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>")
    assert rows(S.overfetched_best_sense(q, v, 2, 2), "word") == [("a",)]


def test_no_queries_no_vectors(data, spark):
    _, _, v, q = data
    assert S.exact_topk(q.filter("false"), v, 5).count() == 0
    assert S.exact_topk(q, v.filter("false"), 5).count() == 0


def test_bad_vectors_take_no_part_and_are_listed(spark):
    nan = float("nan")
    data = [(f"w{i}", [1.0, i / 100]) for i in range(60)] + [(f"n{i}", [nan, 1.0]) for i in range(6)] + [("short", [1.0]), ("none", None), ("hole", [1.0, None])]
    v = spark.createDataFrame(data, "word string, vec array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<double>")
    assert [r["word"] for r in S.exact_topk(q, v, 3).orderBy("rank").collect()] == ["w0", "w1", "w10"]
    assert sorted(tuple(r) for r in S.unusable(v, 2).collect()) == sorted(
        [(f"n{i}", "not finite") for i in range(6)] + [("short", "wrong length"), ("none", "no vector"), ("hole", "not finite")])


def test_vectors_of_unequal_length_are_never_cut_anew():
    import pyarrow as pa

    from lexspan.operators.blocks import matrix

    with pytest.raises(ValueError):
        matrix(pa.array([[1.0, 2.0, 3.0], [4.0]]))


def test_answers(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 1, "x")], "qid int, rank int, word string")
    assert rows(S.answers(hits)) == [(1, "a", ["b", "c"]), (2, "x", [])]


def test_plan_prunes_before_the_shuffle(data, spark):
    _, _, v, q = data
    plan = S.exact_topk(q, v, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("by_word", [False, True])
def test_only_rows_that_reach_the_bounds_leave_a_task(spark, monkeypatch, by_word):
    """32 tasks return a few times k rows per query, not 32 * k."""
    rng = np.random.default_rng(9)
    n, k, asked, tasks = 16_000, 10, 20, 32
    rows_ = [(f"w{i % 9000}", f"s{i}", i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, 8)))]
    v = spark.createDataFrame(rows_, "word string, sense_key string, row long, vec array<float>").repartition(tasks)
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(asked)], "qid long, qvec array<float>")
    plain = S._candidates(S._queries(q), S._vectors(v, False), k, by_word)
    assert plain.count() == tasks * k * asked
    want = rows((S.best_sense_topk if by_word else S.exact_rows)(q, v, k))
    passes = []
    monkeypatch.setattr(S, "FLOOR_ROWS", 0)
    scan = S._scan
    monkeypatch.setattr(S, "_scan", lambda *a: passes.append(scan(*a)) or passes[-1])
    got = rows((S.best_sense_topk if by_word else S.exact_rows)(q, v, k))
    assert got == want and len(passes) == len(S.SHARES)
    assert passes[-1].count() < 6 * k * asked
    assert sum(p.count() for p in passes[1:]) < 16 * k * asked


def test_bounds_with_ties_repeated_queries_and_few_rows(data, path, monkeypatch):
    """A third of all rows tie; queries without an id, and more wanted than there are."""
    monkeypatch.setattr(S, "FLOOR_ROWS", 0)
    out, queries, v, q = data
    for k in (10, 250, 1000):
        assert rows(S.exact_rows(q, v, k), *COLS) == brute(out, queries, k)
    assert rows(S.best_sense_topk(q, v, 40)) == brute(out, queries, 40, by_word=True)


def test_wide_queries_go_by_blocks(data, monkeypatch):
    out, queries, v, q = data
    monkeypatch.setattr(S, "BROADCAST_BYTES", 10)
    assert rows(S.exact_rows(q, v, 5), *COLS) == brute(out, queries, 5)
    monkeypatch.undo()
    monkeypatch.setattr(S, "HELD_ROWS", 50)
    assert rows(S.exact_rows(q, v, 5), *COLS) == brute(out, queries, 5)


def test_runs_of_one_table_share_a_scan(data, path):
    """A third of all rows tie; one run has a filter, one goes by words, one has no rows."""
    _, _, v, q = data
    some = F.col("row") % 3 != 1
    runs = {"all": (F.lit(True), False), "some": (some, False), "words": (F.lit(True), True), "none": (F.col("row") < 0, False)}
    got = S.runs_topk(q, v, runs, 10)
    want = {"all": S.exact_topk(q, v, 10), "some": S.exact_topk(q, v.filter(some), 10), "words": S.best_sense_topk(q, v, 10)}
    for tag, plain in want.items():
        assert rows(got.filter(F.col("tag") == tag), "qid", "rank", "word", "sim") == rows(plain, "qid", "rank", "word", "sim"), tag
    assert got.filter("tag = 'none'").count() == 0
    if S.BROADCAST_QUERIES > 5:
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_runs_over_shares_equal_one_scan(spark, data, monkeypatch):
    """Several runs that would send much go over growing shares, with a bound per run and query."""
    _, _, vectors, queries = data
    runs = {"rows": (F.lit(True), False), "words": (F.lit(True), True), "some": (F.col("row") % 2 == 0, False)}
    plain = rows(S.runs_topk(queries, vectors, runs, 5), "tag", "qid", "rank", "word", "sim")
    passes = []
    by_shares = S._by_shares
    monkeypatch.setattr(S, "FLOOR_ROWS", 10)
    monkeypatch.setattr(S, "_by_shares", lambda *a: passes.append(1) or by_shares(*a))
    assert rows(S.runs_topk(queries, vectors, runs, 5), "tag", "qid", "rank", "word", "sim") == plain
    assert passes


def test_many_queries_hold_bounded_scores_and_merge_seldom(monkeypatch):
    """Scores in memory do not grow with the queries, and a block alone does not sort what all queries keep."""
    from lexspan.operators import blocks as B

    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(8000, 16)).astype(np.float32), rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    x[5000:6000] = x[:1000]
    table = pa.table({"word": [f"w{i % 7000}" for i in range(len(x))], "sense_key": [f"s{i}" for i in range(len(x))],
                      "row": pa.array(np.arange(len(x))), "vec": pa.array(list(x), pa.list_(pa.float32()))})
    cells, merges, match, merge = [], [], B.TopK._match, B.TopK._merge
    monkeypatch.setattr(B.TopK, "_match", lambda self, t, x, chosen, *a: cells.append(len(x) * len(chosen)) or match(self, t, x, chosen, *a))
    monkeypatch.setattr(B.TopK, "_merge", lambda self, *a: merges.append(1) or merge(self, *a))
    top = B.TopK(B.QueryBlock(pa.array(np.arange(len(q))), q), 5, False)
    for i in range(0, len(x), 250):
        top.add(table.slice(i, 250))
    assert max(cells) <= 1 << 20 and len(merges) < 32
    got = B.TopK(B.QueryBlock(pa.array(np.arange(len(q))), q), 5, False)
    got.add(table)
    got = got.result().to_pandas().sort_values(["qid", "sim", "word", "sense_key", "row"], ascending=[True, False, True, True, True])
    for i in range(0, len(q), 97):
        exact = np.cumsum(x.astype(float) * q[i], axis=1)[:, -1]
        order = sorted(range(len(x)), key=lambda r: (-exact[r], f"w{r % 7000}", f"s{r}"))[:5]
        assert got[got["qid"] == i]["row"].tolist() == order


def test_lengths_beyond_single_precision_keep_their_order(spark):
    """Products that would overflow or vanish in single precision are made in double precision."""
    for scale in (1e-30, 1e25):
        v = spark.createDataFrame([(f"w{i}", i, [scale * (1 + i), scale]) for i in range(9)], "word string, row long, vec array<double>")
        q = spark.createDataFrame([(1, [scale, 0.0]), (2, [1.0, 0.0])], "qid long, qvec array<double>")
        assert [r["word"] for r in S.exact_topk(q, v, 2).orderBy("qid", "rank").collect()] == ["w8", "w7"] * 2


def test_many_queries_deal_a_single_partition_to_all_cores(spark):
    v = spark.range(400).select(F.concat(F.lit("w"), "id").alias("word"), F.col("id").alias("row"),
                                F.array(F.rand(1), F.rand(2)).alias("vec")).coalesce(1)
    q = spark.range(300).select(F.col("id").alias("qid"), F.array(F.rand(3), F.rand(4)).alias("qvec"))
    found = S._candidates(S._queries(q), S._vectors(v, False), 3, False)
    assert found.rdd.getNumPartitions() == S._tasks(v)
    few = S._candidates(S._queries(q.limit(5)), S._vectors(v, False), 3, False)
    assert few.rdd.getNumPartitions() == 1


def test_a_task_holds_the_rows_of_all_runs_or_each_run_has_its_scan(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vectors = spark.createDataFrame([(f"w{i % 30}", f"k{i}", i, [float(x) for x in rng.normal(size=4)]) for i in range(60)],
                                    "word string, sense_key string, row long, vec array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(8)], "qid long, qvec array<double>")
    runs = {"all": (F.lit(True), True), "even": (F.col("row") % 2 == 0, False)}
    want = sorted(map(tuple, S.runs_topk(queries, vectors, runs, 5).select("tag", "qid", "rank", "word", "sim").collect()))
    asked, alone = [], S._candidates
    monkeypatch.setattr(S, "_candidates", lambda *a: asked.append(1) or alone(*a))
    monkeypatch.setattr(S, "HELD_ROWS", 8 * 5)  # enough for one run, not for two
    got = S.runs_topk(queries, vectors, runs, 5).select("tag", "qid", "rank", "word", "sim").collect()
    assert len(asked) == 2 and sorted(map(tuple, got)) == want


@pytest.mark.parametrize("by_word", [False, True])
def test_copies_of_a_vector_are_scored_once_by_blocks(spark, monkeypatch, by_word):
    """Forty rows share each vector: a block has the vector once, and the rows found are those of a plain sort."""
    from lexspan.operators import blocks as B

    rng = np.random.default_rng(12)
    apart = rng.integers(-3, 4, size=(50, 4)).astype(float)
    apart[10] = -0.0
    data = [(f"w{(i * 7) % 90}", f"s{i % 11}", i, [float(x) for x in apart[i % 50]]) for i in range(2000)]
    asked = [(i, [float(x) for x in rng.integers(-3, 4, size=4)]) for i in range(30)]
    v = spark.createDataFrame(data, "word string, sense_key string, row long, vec array<double>").repartition(5)
    q = spark.createDataFrame(asked, "qid long, qvec array<double>")
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 5)
    for k in (3, 60):
        found = []
        for qid, qvec in asked:
            scored = [(-sum(a * b for a, b in zip(qvec, vec)), word, key, row) for word, key, row, vec in data]
            if by_word:
                best = sorted({w: min(s for s, x, *_ in scored if x == w) for w in {x[1] for x in scored}}.items(), key=lambda e: (e[1], e[0]))
                found += [(qid, rank, w, -s + 0.0) for rank, (w, s) in enumerate(best[:k], 1)]
            else:
                found += [(qid, rank, w, key, row, -s + 0.0) for rank, (s, w, key, row) in enumerate(sorted(scored)[:k], 1)]
        if by_word:
            assert rows(S.best_sense_topk(q, v, k)) == sorted(found)
        else:
            assert rows(S.exact_rows(q, v, k), "qid", "rank", "word", "sense_key", "row", "sim") == sorted(found)
        kept = S._folded(S._vectors(v, False).withColumn("list_id", F.lit(0)), k, by_word, False).collect()
        assert len(kept) == len({tuple(x + 0.0) for x in apart}) and max(len(r["rows"]) for r in kept) <= k
        assert len(S._folded(S._vectors(v, False).withColumn("list_id", F.lit(0)), k, by_word, True).collect()) == len(data)
    # Many copies in a block that sets its own floor.
    one = pa.table({"vec": pa.array([list(x) for x in apart]), "rows": pa.array([[{"word": f"w{i}", "sense_key": "", "row": i}, {"word": f"x{i}", "sense_key": "", "row": i}] for i in range(50)])})
    top = B.TopK(B.QueryBlock(pa.array([a for a, _ in asked]), np.array([b for _, b in asked])), 2, by_word)
    top.add(one)
    got = sorted(zip(*(top.result()[c].to_pylist() for c in ("qid", "sim", "word"))))
    for qid, qvec in asked:
        scored = sorted((-float(np.dot(qvec, x)) , w) for i, x in enumerate(apart) for w in (f"w{i}", f"x{i}"))[:2]
        assert sorted((s, w) for a, s, w in got if a == qid) == sorted((-s + 0.0, w) for s, w in scored)


def test_a_pair_of_blocks_keeps_bounded_rows(data, monkeypatch):
    assert S._at_once(10) == S.QUERIES_PER_BLOCK and S._at_once(10**9) == 1
    assert all(k * S._at_once(k) <= 500_000 for k in (100, 120, 1000))
    out, queries, v, q = data
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 1)
    monkeypatch.setattr(S, "KEPT_PER_BLOCK", 10)
    assert rows(S.exact_rows(q, v, 5), *COLS) == brute(out, queries, 5)
