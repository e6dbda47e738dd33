"""Registered queries: vector expressions and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.functions import text as X, vectors as V
from lexspan.operators import cells as C, encode as E, lists as L, neighbours as N, ranks as R, search as S
from lexspan.plans import frames as P, oracle_parts as O
from lexspan.plans.fixtures import table
from lexspan.plans.registry import query
from lexspan.streaming.jobs import scratch


def _q(spark, d):
    return P.query_vectors(spark, d)


def _mark(vec):
    """Every component weighted by its place: any change of one shows."""
    weighted = F.transform(vec, lambda x, i: (i + 1) * x)
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 6).alias("mark")


_PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, a.embedding AS x, b.embedding AS y FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(b, F.col("b") == F.col("a") + 1)


@query("b1_encode", f"SELECT k AS doc_id, CAST(i AS INT) AS i, CAST(x AS DOUBLE) AS x FROM {O.digest_encoding('SELECT doc_id AS k, text FROM {documents}', 'base')}")
def b1(spark, d):
    docs = table(spark, d, "documents")
    vec = E.encode_column(F.col("text"), lambda: E.DigestEncoder(64, "base"))
    parts = docs.select("doc_id", vec.alias("vec")).select("doc_id", F.posexplode("vec").alias("i", "x"))
    return parts.filter("x <> 0").select("doc_id", "i", F.col("x").cast("double").alias("x"))


@query("b2_cosine", f"SELECT a, b, round(list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])), 9) AS sim FROM ({_PAIRS})")
def b2(spark, d):
    return _pairs(spark, d).select("a", "b", F.round(V.cosine(F.col("x"), F.col("y")), 9).alias("sim"))


@query("b3_dot", f"SELECT a, b, {O.dot('x', 'y')} AS dot FROM ({_PAIRS})")
def b3(spark, d):
    return _pairs(spark, d).select("a", "b", V.dot(F.col("x"), F.col("y")).alias("dot"))


@query("b4_normalise", f"SELECT vec_id, round(sqrt({O.dot('embedding', 'embedding')}), 9) AS length, CAST(1.0 AS DOUBLE) AS unit FROM {{embeddings}}")
def b4(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 9).alias("length"),
                    F.round(V.norm(V.normalise(F.col("embedding"))), 9).alias("unit"))


def _cut(vec: str, n: int) -> str:
    v = f"CAST({vec} AS DOUBLE[])[1:{n}]"
    return f"list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"


@query("b5_truncate", f"SELECT vec_id, u.i AS dim, round(u.x, 9) AS x FROM (SELECT vec_id, unnest(list_zip(range(0, 32), {_cut('embedding', 32)})) AS p FROM {{embeddings}}) t, LATERAL (SELECT p[1] AS i, p[2] AS x) u")
def b5(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(V.truncate(F.col("embedding"), 32)).alias("dim", "x")).select(
        "vec_id", "dim", F.round("x", 9).alias("x"))


def _half(x: str) -> str:
    step = f"pow(2.0, greatest(floor(log2(abs({x}))), -14.0) - 10.0)"
    return f"CASE WHEN {x} = 0 THEN {x} ELSE round_even({x} / {step}, 0) * {step} END"


@query("b6_round_half", f"SELECT vec_id, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: {_half('x')} * 1048576)) AS total FROM {{embeddings}}")
def b6(spark, d):
    # Rounded components are multiples of 2**-24, so their sums are exact in any order.
    e = table(spark, d, "embeddings")
    total = F.aggregate(V.round_half(F.col("embedding")), F.lit(0.0), lambda a, x: a + x * 1048576)
    return e.select("vec_id", total.alias("total"))


_UNIT = "list_transform({0}, lambda x: x / sqrt(list_inner_product({0}, {0})))"


@query("b7_drift_cosines", f"""SELECT round(max(err), 12) AS max_component_error, round(avg(cos), 9) AS mean_cosine, round(min(cos), 9) AS min_cosine, count(*) AS rows FROM (
 SELECT list_max(list_transform(list_zip(q, c), lambda p: abs(p[1] - p[2]))) AS err, list_inner_product(q, c) / sqrt(list_inner_product(q, q)) AS cos FROM (
 SELECT c, list_transform(c, lambda x: {_half('x')}) AS q FROM (SELECT {_UNIT.format('v')} AS c FROM (SELECT CAST(embedding AS DOUBLE[])[1:32] AS v FROM {{embeddings}}))))""")
def b7_cosines(spark, d):
    e = table(spark, d, "embeddings").select(F.col("embedding").alias("vec"))
    drift = C.drift(C.derive_vectors(e, 32))
    return drift.select(F.round("max_component_error", 12).alias("max_component_error"), F.round("mean_cosine", 9).alias("mean_cosine"),
                        F.round("min_cosine", 9).alias("min_cosine"), "rows")


@query("b7_drift", f"""SELECT round(max(err), 12) AS max_component_error, count(*) AS rows FROM (
  SELECT list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs({_half('x')} - x))) AS err FROM {{embeddings}})""")
def b7(spark, d):
    e = table(spark, d, "embeddings")
    err = V.max_abs_diff(V.round_half(F.col("embedding")), F.col("embedding"))
    return e.agg(F.round(F.max(err), 12).alias("max_component_error"), F.count("*").alias("rows"))


_B8_CUT = "CAST(e.qvec AS DOUBLE[])[1:CASE WHEN c.label % 2 = 0 THEN 32 ELSE 64 END]"


@query("b8_prepare_query", f"""SELECT qid, label, dim, round(list_sum(list_transform(range(1, dim + 1), lambda i: i * v[i] / sqrt(list_inner_product(v, v)))), 6) AS mark FROM (
 SELECT e.id AS qid, c.label, CASE WHEN c.label % 2 = 0 THEN 32 ELSE 64 END AS dim,
  CASE WHEN c.label % 3 = 0 THEN list_transform({_B8_CUT}, lambda x: {_half('x')}) ELSE {_B8_CUT} END AS v
 FROM {{eval_set}} e JOIN (SELECT DISTINCT label FROM {{embeddings}}) c ON c.label = e.qvec_id % 10)""")
def b8(spark, d):
    q = table(spark, d, "eval_set").select("id", "qvec_id", "qvec")
    meta = table(spark, d, "embeddings").select("label").distinct().select(
        "label", F.when(F.col("label") % 2 == 0, 32).otherwise(64).alias("dim"),
        F.when(F.col("label") % 3 == 0, "float16").otherwise("float32").alias("precision"))
    rows = q.join(meta, F.col("qvec_id") % 10 == F.col("label"))
    vec = V.prepare_query(F.col("qvec"), F.col("dim"), F.col("precision"))
    return rows.select(F.col("id").alias("qid"), "label", F.size(vec).alias("dim"), _mark(vec))


@query("b9_parse_literal", """SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: i * CAST(embedding[i] AS DOUBLE))), 6) AS mark FROM {embeddings}""")
def b9(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.as_double(F.col("embedding")).alias("v"))
    text = F.concat(F.lit("["), F.array_join(F.transform("v", lambda x: x.cast("string")), ","), F.lit("]"))
    back = V.parse_literal(text)
    return e.select("vec_id", F.size(back).alias("n"), _mark(back))


@query("b10_same_vector", "SELECT sense_key, count(DISTINCT embedding) = 1 AS same FROM {senses} GROUP BY sense_key")
def b10(spark, d):
    cell = P.sense_cell(spark, d)
    from lexspan.operators.cells import synset_groups

    return synset_groups(cell).select("sense_key", (~F.col("divergent")).alias("same"))


@query("c1_exact_topk", "SELECT qid, rank, word, sim FROM {hits_lemma} WHERE rank <= 10")
def c1(spark, d):
    return S.exact_topk(_q(spark, d), P.vectors(spark, d), 10)


_STORED: dict[tuple[str, str], L.StoredLists] = {}


def stored_lists(spark, d):
    """The list index of the vocabulary, stored once per application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        listed = P.vectors(spark, d).withColumn("list_id", F.col("label").cast("long"))
        path = scratch(spark)
        L.store_lists(listed, L.mean_centroids(listed), path)
        _STORED[key] = L.open_lists(spark, path)
    return _STORED[key]


_CENTRES = """SELECT label, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS x FROM (
  SELECT label, unnest(range(1, 65)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM {embeddings}) GROUP BY label, i) GROUP BY label"""


@query("c2_list_topk", O.top(f"SELECT p.qid, v.word, {O.dot('v.embedding', 'p.qvec')} AS sim FROM {{probing}} p JOIN {{vocab}} v ON v.label = p.label", 10)
       .replace("SELECT *", "SELECT qid, rank, word, sim", 1),
       {"centres": _CENTRES, "probing": O.top("SELECT e.id AS qid, e.qvec, c.label, list_cosine_similarity(CAST(e.qvec AS DOUBLE[]), c.c) AS s FROM {eval_core} e CROSS JOIN {centres} c", 3, "s DESC, label")})
def c2(spark, d):
    return L.stored_topk(_q(spark, d), stored_lists(spark, d), 10, 3)


# All lists probed: the same as the exact search, whatever the training found.
@query("c2_trained_lists", "SELECT qid, rank, word, sim FROM {hits_lemma} WHERE rank <= 10")
def c2_trained(spark, d):
    vectors = P.vectors(spark, d)
    centroids = L.grouped(L.train_centroids(vectors, 22))
    path = scratch(spark)
    L.store_lists(L.assign_lists(vectors, centroids), centroids, path)
    return L.stored_topk(_q(spark, d), L.open_lists(spark, path), 10, 22)


@query("c2_all_lists_equal_exact", "SELECT qid, rank, word, sim FROM {hits_lemma} WHERE rank <= 10")
def c2_all(spark, d):
    return L.stored_topk(_q(spark, d), stored_lists(spark, d), 10, 10)


@query("c3_filtered_topk", "SELECT qid, rank, word, sim FROM {hits_filtered} WHERE rank <= 10")
def c3(spark, d):
    return P.run_hits(spark, d, "filtered", 10)


@query("c4_best_sense", "SELECT qid, rank, word, sim FROM {hits_sense} WHERE rank <= 10")
def c4(spark, d):
    return P.run_hits(spark, d, "sense", 10)


_OVER = O.top(O.SENSE_SCORES, 120, "sim DESC, word, sense_key, row_id")


@query("c5_overfetch", "SELECT qid, rank, word, sim FROM (" + O.top(f"SELECT qid, word, max(sim) AS sim FROM ({_OVER}) GROUP BY qid, word", 10) + ")")
def c5(spark, d):
    return S.overfetched_best_sense(_q(spark, d), P.sense_cell(spark, d), 10)


@query("c6_row_topk", "SELECT qid, rank, word, sense_key, row_id AS row, sim FROM (" + O.top(O.SENSE_SCORES, 10, "sim DESC, word, sense_key, row_id") + ")")
def c6(spark, d):
    return S.exact_rows(_q(spark, d), P.sense_cell(spark, d), 10).select("qid", "rank", "word", "sense_key", "row", "sim")


_SYN10 = "SELECT * FROM {synset_rows} WHERE rank <= 10"


@query("c7_synset_topk", O.expand(f"({_SYN10})", "{members}", 10))
def c7(spark, d):
    return P.run_hits(spark, d, "synset", 10)


_ZIPF_MEMBERS = """SELECT m.sense_key, m.word, row_number() OVER (PARTITION BY m.sense_key ORDER BY coalesce(z.zipf, 0) DESC, m.member_pos) AS member_pos
FROM {members} m LEFT JOIN {zipf} z ON z.word = lower(m.word)"""


@query("c8_expansion_zipf", O.expand(f"({_SYN10})", "{zipf_members}", 10), {"zipf_members": _ZIPF_MEMBERS})
def c8_zipf(spark, d):
    cell, members = P.synset_parts(spark, d)
    return S.synset_topk(_q(spark, d), cell, S.member_order(members, "zipf", zipf=table(spark, d, "zipf")), 10)


@query("c8_expansion_lexicon", O.expand(f"({_SYN10})", "{lexicon_members}", 10),
       {"lexicon_members": "SELECT sense_key, word, max(member_pos) AS member_pos FROM {senses} GROUP BY sense_key, word"})
def c8_lexicon(spark, d):
    cell, members = P.synset_parts(spark, d)
    lexicon = table(spark, d, "senses").select("sense_key", "word", F.col("member_pos").alias("position"))
    return S.synset_topk(_q(spark, d), cell, S.member_order(members, "lexicon", lexicon=lexicon), 10)


@query("c9_neighbours", "SELECT qid, rank, word, sim FROM (" + O.top(
    f"SELECT a.word AS qid, v.word, {O.dot('v.embedding', 'a.embedding')} AS sim FROM {{vocab}} a JOIN {{vocab}} v ON v.word <> a.word WHERE a.word = lower(trim(a.word))", 12) + ")")
def c9(spark, d):
    slugs = P.vectors(spark, d).select(X.slug(F.col("word")).alias("slug")).distinct()
    return N.all_neighbours(slugs, P.vectors(spark, d))


@query("c10_similarity_to_target", f"SELECT e.id AS qid, e.target, {O.dot('e.qvec', 'v.embedding')} AS sim FROM {{eval_set}} e LEFT JOIN {{vocab}} v ON v.word = e.target")
def c10(spark, d):
    return S.similarity_to(P.queries(spark, d), P.vectors(spark, d)).select("qid", "target", "sim")


@query("c11_target_ranks", "SELECT tag, id, rank, lenient_rank FROM {results}")
def c11(spark, d):
    return P.results(spark, d).select("tag", "id", "rank", "lenient_rank")


@query("c12_answers", """SELECT qid, max(CASE WHEN rank = 1 THEN word END) AS answer,
 array_to_string(list(word ORDER BY rank) FILTER (rank IN (2, 3)), '|') AS alternatives FROM {hits_lemma} GROUP BY qid""")
def c12(spark, d):
    hits = S.answers(P.run_hits(spark, d, "lemma", 5))
    return hits.select("qid", "answer", F.array_join("alternatives", "|").alias("alternatives"))


@query("c13_tie_order", "SELECT qid, rank, word FROM (" + O.top(O.SENSE_SCORES, 20, "sim DESC, word, sense_key, row_id") + ")")
def c13(spark, d):
    return S.exact_rows(_q(spark, d), P.sense_cell(spark, d).repartition(7), 20).select("qid", "rank", "word")


@query("c14_request_check", """SELECT doc_id AS id, 10 AS k, CASE WHEN text IS NULL OR text = '' THEN 'query is required and must be a string'
 WHEN length(text) > 500 THEN 'query too long (max 500 characters)' END AS reason FROM {documents}""")
def c14(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.lit(S.DEFAULT_K).alias("k"), X.request_rejection(F.col("text")).alias("reason"))


@query("e3_echo_rate", f"""SELECT qid, round(avg(CASE WHEN list_has_any({O.stems_w('word')}, stems) THEN 1.0 ELSE 0.0 END), 9) AS echo
 FROM {{hits_lemma}} h JOIN {{queries}} k USING (qid) WHERE rank <= 10 GROUP BY qid""")
def e3(spark, d):
    rate = R.echo_rate(P.run_hits(spark, d, "lemma", 10), P.queries(spark, d))
    return rate.select("qid", F.round("echo", 9).alias("echo"))
