"""Registered queries: metrics, comparisons, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.functions import decisions as D
from lexspan.operators import compare as K, metrics as M, probes as B, search as S
from lexspan.plans import frames as P, oracle_parts as O
from lexspan.plans.fixtures import table
from lexspan.plans.registry import SHARED, query


def _round(df, *names, digits=9):
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def _hit(rank: str, k: int) -> str:
    return f"round(avg(CASE WHEN {rank} <= {k} THEN 1.0 ELSE 0.0 END), 9)"


_METRICS = (f"count(*) AS n, {_hit('rank', 1)} AS recall1, {_hit('rank', 3)} AS recall3, {_hit('rank', 10)} AS recall10, "
            "round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0.0 END), 9) AS mrr10, "
            f"{_hit('lenient_rank', 1)} AS lenient_recall1, {_hit('lenient_rank', 3)} AS lenient_recall3, {_hit('lenient_rank', 10)} AS lenient_recall10, "
            "round(avg(echo), 9) AS echo_rate, round(avg(CASE WHEN rank > 10 THEN 1.0 ELSE 0.0 END), 9) AS beyond10")


@query("h1_score", f"SELECT tag, {_METRICS} FROM {{results}} GROUP BY tag")
def h1(spark, d):
    return _round(M.score(P.results(spark, d), ["tag"]), *M.METRIC_NAMES)


@query("h2_lenient_recall3", f"SELECT tag, source, {_hit('lenient_rank', 3)} AS lenient_recall3 FROM {{results}} GROUP BY tag, source")
def h2(spark, d):
    return _round(M.score(P.results(spark, d), ["tag", "source"]), "lenient_recall3").select("tag", "source", "lenient_recall3")


@query("h3_percentiles", """SELECT lang, n, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95,
 v[least(n - 1, CAST(floor(1.0 * n) AS BIGINT)) + 1] AS p100 FROM (SELECT lang, count(*) AS n, list_sort(list(n_chars)) AS v FROM {documents} GROUP BY lang)""")
def h3(spark, d):
    from lexspan.operators.scale import order_statistics, percentile_pick

    docs = table(spark, d, "documents")
    return order_statistics(docs, ["lang"], "n_chars", {f"p{p}": percentile_pick(p) for p in (50, 95, 100)})


@query("h4_mcnemar", f"""SELECT source, b, c, round({O.mcnemar('b', 'c')}, 8) AS p FROM (
 SELECT d.source, count(*) FILTER (l.quality = 1) AS b, count(*) FILTER (l.toxic = 1) AS c FROM {{documents}} d JOIN {{labels}} l ON l.doc_id = d.doc_id GROUP BY d.source)""")
def h4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    labels = table(spark, d, "labels")
    counts = docs.join(labels, "doc_id").groupBy("source").agg(
        F.count_if(F.col("quality") == 1).alias("b"), F.count_if(F.col("toxic") == 1).alias("c"))
    return counts.withColumn("p", F.round(D.mcnemar_p(F.col("b"), F.col("c")), 8))


SHARED["routed"] = """SELECT r.*, CASE WHEN bool_or(source = 'authored' AND reachable) OVER (PARTITION BY tag) THEN source = 'authored' AND reachable ELSE reachable END AS in_scope,
 bool_or(source = 'authored' AND reachable) OVER (PARTITION BY tag) AS has_authored FROM {results} r"""
_DIMS = {"style": "style", "length": O.length_bucket("query"), "tokens": "token_count", "overlap": "coalesce(lexical_overlap, 'none')", "band": O.band_label("zipf")}


@query("h5_slices", f"SELECT tag, 'source' AS dimension, source AS value, {_METRICS} FROM {{routed}} GROUP BY tag, source" + "".join(
    f" UNION ALL SELECT tag, '{n}', {v}, {_METRICS} FROM {{routed}} WHERE in_scope AND {v} IS NOT NULL GROUP BY tag, {v}" for n, v in _DIMS.items()))
def h5(spark, d):
    return _round(M.slices(P.saved_results(spark, d)), *M.METRIC_NAMES)


@query("h6_terciles", """SELECT r.tag, r.id, c.lo, c.hi, CASE WHEN coalesce(c.n, 0) < 3 OR r.zipf IS NULL THEN 'unknown' WHEN r.zipf < c.lo THEN 'low' WHEN r.zipf < c.hi THEN 'mid' ELSE 'high' END AS third
 FROM {routed} r LEFT JOIN (SELECT tag, count(*) AS n, list_sort(list(zipf))[count(*) // 3 + 1] AS lo, list_sort(list(zipf))[2 * count(*) // 3 + 1] AS hi FROM {routed} WHERE in_scope AND zipf IS NOT NULL GROUP BY tag) c ON c.tag = r.tag
 WHERE r.in_scope""")
def h6(spark, d):
    return M.terciles(P.saved_results(spark, d)).select("tag", "id", "lo", "hi", "third")


@query("h6_tercile_scores", f"""SELECT tag, third, {_METRICS} FROM (SELECT r.*, CASE WHEN coalesce(c.n, 0) < 3 OR r.zipf IS NULL THEN 'unknown' WHEN r.zipf < c.lo THEN 'low' WHEN r.zipf < c.hi THEN 'mid' ELSE 'high' END AS third
 FROM {{routed}} r LEFT JOIN (SELECT tag, count(*) AS n, list_sort(list(zipf))[count(*) // 3 + 1] AS lo, list_sort(list(zipf))[2 * count(*) // 3 + 1] AS hi FROM {{routed}} WHERE in_scope AND zipf IS NOT NULL GROUP BY tag) c ON c.tag = r.tag
 WHERE r.in_scope) GROUP BY tag, third""")
def h6_scores(spark, d):
    return _round(M.score(M.terciles(P.saved_results(spark, d)), ["tag", "third"]), *M.METRIC_NAMES)


_HEAD = "source = 'authored' AND reachable"
_SLICES = {"authored": _HEAD, "authored, overlap none": f"{_HEAD} AND lexical_overlap = 'none'", "authored, overlap": f"{_HEAD} AND lexical_overlap <> 'none'",
           "tripwire": "source = 'gloss_tripwire'", "unreachable": "NOT reachable"}


@query("h7_headline", " UNION ALL ".join(f"SELECT tag, '{n}' AS slice, {_METRICS} FROM {{results}} WHERE {w} GROUP BY tag" for n, w in _SLICES.items()))
def h7(spark, d):
    return _round(M.headline(P.results(spark, d)), *M.METRIC_NAMES)


def _pairs(spark, d, scored):
    return K.reference_pairs(P.runs(spark, d, scored), "lemma")


SHARED["paired"] = """SELECT a.tag AS a, b.tag AS b, a.id, a.source, a.reachable, a.target, a.rank AS rank_a, b.rank AS rank_b, a.lenient_rank AS len_a, b.lenient_rank AS len_b,
 a.echo AS echo_a, b.echo AS echo_b, a.top1 AS top1_a, b.top1 AS top1_b FROM {results} a JOIN {results} b ON b.id = a.id
 WHERE a.tag = 'lemma' AND b.tag IN ('filtered', 'sense')"""
_one = lambda c: f"coalesce({c} = 1, false)"
_W, _L = f"(NOT {_one('rank_a')} AND {_one('rank_b')})", f"({_one('rank_a')} AND NOT {_one('rank_b')})"
_LW, _LL = f"(NOT {_one('len_a')} AND {_one('len_b')})", f"({_one('len_a')} AND NOT {_one('len_b')})"


@query("h8_strict_comparison", f"""SELECT *, wins + regressions AS discordant, round({O.mcnemar('regressions', 'wins')}, 8) AS p, {O.mcnemar('regressions', 'wins')} < 0.05 AS significant FROM (
 SELECT a, b, count(*) AS n, {_hit('rank_a', 1)} AS recall1_a, {_hit('rank_b', 1)} AS recall1_b, {_hit('rank_a', 10)} AS recall10_a, {_hit('rank_b', 10)} AS recall10_b,
 count(*) FILTER ({_W}) AS wins, count(*) FILTER ({_L}) AS regressions, round(avg(echo_b) - avg(echo_a), 9) AS echo_delta FROM {{paired}} GROUP BY a, b)""")
def h8(spark, d):
    r = P.saved_results(spark, d)
    out = K.strict_comparison(r, _pairs(spark, d, r))
    return _round(_round(out, "recall1_a", "recall1_b", "recall10_a", "recall10_b", "echo_delta"), "p", digits=8)


@query("h9_lenient_comparison", f"""SELECT a, b, n, lenient_a, lenient_b, wins, regressions, strict_wins, strict_regressions, round({O.mcnemar('regressions', 'wins')}, 8) AS p, round({O.mcnemar('strict_regressions', 'strict_wins')}, 8) AS strict_p,
 CASE WHEN lenient_b - lenient_a >= 0.06 AND {O.mcnemar('regressions', 'wins')} < 0.05 THEN 'WIN' WHEN lenient_b - lenient_a >= 0.06 THEN 'above threshold, not significant'
 WHEN lenient_b - lenient_a > 0 THEN 'null result' WHEN {O.mcnemar('regressions', 'wins')} < 0.05 THEN 'significant regression' ELSE 'no difference' END AS verdict, 'authored' AS slice
 FROM (SELECT a, b, count(*) AS n, {_hit('len_a', 1)} AS lenient_a, {_hit('len_b', 1)} AS lenient_b, count(*) FILTER ({_LW}) AS wins, count(*) FILTER ({_LL}) AS regressions,
 count(*) FILTER ({_W}) AS strict_wins, count(*) FILTER ({_L}) AS strict_regressions FROM {{paired}} WHERE {_HEAD} GROUP BY a, b)""")
def h9(spark, d):
    r = P.saved_results(spark, d)
    out = _round(_round(K.comparison(r, _pairs(spark, d, r)), "lenient_a", "lenient_b"), "p", "strict_p", digits=8)
    return out.select("a", "b", "slice", "n", "lenient_a", "lenient_b", "wins", "regressions", "strict_wins", "strict_regressions", "p", "strict_p", "verdict")


_DELTA = "(avg(l.quality) - avg(l.toxic))"


@query("h10_verdicts", f"""SELECT source, CASE WHEN delta >= 0.06 AND p < 0.05 THEN 'WIN' WHEN delta >= 0.06 THEN 'above threshold, not significant' WHEN delta > 0 THEN 'null result' WHEN p < 0.05 THEN 'significant regression' ELSE 'no difference' END AS verdict
 FROM (SELECT source, delta, {O.mcnemar('b', 'c')} AS p FROM (SELECT d.source, {_DELTA} AS delta, count(*) FILTER (l.quality = 1) AS b, count(*) FILTER (l.toxic = 1) AS c FROM {{documents}} d JOIN {{labels}} l ON l.doc_id = d.doc_id GROUP BY d.source))""")
def h10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    counts = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(
        (F.avg("quality") - F.avg("toxic")).alias("delta"), F.count_if(F.col("quality") == 1).alias("b"), F.count_if(F.col("toxic") == 1).alias("c"))
    return counts.select("source", D.verdict(F.col("delta"), D.mcnemar_p(F.col("b"), F.col("c"))).alias("verdict"))


SHARED["log_pairs"] = """SELECT r.tag AS a, o.tag AS b, 'the earliest run on this set' AS why FROM (SELECT * FROM {run_log} QUALIFY row_number() OVER (PARTITION BY coalesce(set_sha256, set_name) ORDER BY ran_at, tag) = 1) r
 JOIN {run_log} o ON coalesce(o.set_sha256, o.set_name) = coalesce(r.set_sha256, r.set_name) AND o.tag <> r.tag"""


@query("h11_pairs", """SELECT * FROM {log_pairs}""")
def h11(spark, d):
    return K.reference_pairs(table(spark, d, "run_log"))


def _all_pairs(spark, d, runs):
    """The lemma run against every other run."""
    return runs.filter("tag <> 'lemma'").select(F.lit("lemma").alias("a"), F.col("tag").alias("b"))


_TIE = "CASE WHEN {0}.cell_variant = 'gloss_synset' THEN coalesce({0}.expansion_order, 'unknown') ELSE 'alphabetical' END"


@query("h12_comparability", f"""SELECT p.a, p.b, coalesce(a.pool_scale <> b.pool_scale, false) AS cross_scale, {_TIE.format('a')} <> {_TIE.format('b')} AS tie_differs
 FROM {{log_pairs}} p JOIN {{run_log}} a ON a.tag = p.a JOIN {{run_log}} b ON b.tag = p.b""")
def h12(spark, d):
    runs = table(spark, d, "run_log")
    return K.comparability(runs, K.reference_pairs(runs).select("a", "b"))


@query("h13_changes", f"""SELECT a, b, kind, place, id, target, top1_a, rank_a, top1_b, rank_b, greatest(total - 25, 0) AS more FROM (
 SELECT *, row_number() OVER (PARTITION BY a, b, kind ORDER BY id) AS place, count(*) OVER (PARTITION BY a, b, kind) AS total FROM (
 SELECT *, CASE WHEN {_W} THEN 'win' WHEN {_L} THEN 'regression' END AS kind FROM {{paired}}) WHERE kind IS NOT NULL) WHERE place <= 25""")
def h13(spark, d):
    r = P.saved_results(spark, d)
    return K.changes(r, _pairs(spark, d, r))


@query("h14_headroom", f"""SELECT tag, CASE WHEN has_authored THEN 'authored' ELSE 'tripwire' END AS slice, count(*) AS n, {_hit('rank', 1)} AS recall1, {_hit('rank', 10)} AS recall10,
 round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 9) AS gap, round(avg(CASE WHEN rank > 10 THEN 1.0 ELSE 0.0 END), 9) AS beyond10, 100 AS depth
 FROM {{routed}} WHERE in_scope GROUP BY tag, has_authored""")
def h14(spark, d):
    r = P.saved_results(spark, d)
    return _round(M.headroom(r, P.runs(spark, d, r)), "recall1", "recall10", "gap", "beyond10")


@query("h15_cross_validation", """SELECT a.tag AS a, b.tag AS b, count(*) AS shared, round(avg(CASE WHEN lower(coalesce(a.top1, '')) = lower(coalesce(b.top1, '')) THEN 1.0 ELSE 0.0 END), 9) AS agreement,
 round(abs(avg(CASE WHEN b.rank = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN a.rank = 1 THEN 1.0 ELSE 0.0 END)), 9) AS delta_r1,
 abs(avg(CASE WHEN b.rank = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN a.rank = 1 THEN 1.0 ELSE 0.0 END)) <= 0.02 AND avg(CASE WHEN lower(coalesce(a.top1, '')) = lower(coalesce(b.top1, '')) THEN 1.0 ELSE 0.0 END) >= 0.95 AS consistent
 FROM {routed} a JOIN {routed} b ON b.id = a.id WHERE a.in_scope AND b.in_scope AND a.tag IN ('lemma', 'filtered') AND b.tag = 'sense' GROUP BY a.tag, b.tag""")
def h15(spark, d):
    r = P.saved_results(spark, d)
    return _round(K.cross_validation(r, P.runs(spark, d, r)), "agreement", "delta_r1")


@query("h16_set_identity", """SELECT r.set_name, count(*) AS runs, count(DISTINCT set_sha256) AS hashes, CASE WHEN count(DISTINCT set_sha256) = 0 THEN 'not recorded' WHEN count(DISTINCT set_sha256) > 1 THEN 'several hashes'
 WHEN min(c.sha256) IS NULL THEN 'cannot check' WHEN min(set_sha256) = min(c.sha256) THEN 'matches' ELSE 'mismatch' END AS status FROM {recorded} r LEFT JOIN {current} c ON c.set_name = r.set_name GROUP BY r.set_name""", {
    "recorded": "SELECT source AS set_name, concat(source, '-', lang) AS tag, CASE WHEN source = 'src0' THEN lang WHEN source = 'src1' THEN NULL WHEN source = 'src2' THEN 'old' ELSE source END AS set_sha256 FROM {documents} GROUP BY source, lang",
    "current": "SELECT DISTINCT source AS set_name, source AS sha256 FROM {documents} WHERE source <> 'src3'"})
def h16(spark, d):
    docs = table(spark, d, "documents")
    src = F.col("source")
    runs = docs.select("source", "lang").distinct().select(
        src.alias("set_name"), F.concat_ws("-", "source", "lang").alias("tag"),
        F.when(src == "src0", F.col("lang")).when(src == "src1", None).when(src == "src2", "old").otherwise(src).alias("set_sha256"))
    current = docs.filter("source <> 'src3'").select(src.alias("set_name"), src.alias("sha256")).distinct()
    return K.set_identity(runs, current)


_PC = {"source": "source", "reachable": "CASE WHEN NOT reachable THEN 'false' ELSE 'true' END", "lexical_overlap": "coalesce(lexical_overlap, 'none')",
       "style": "coalesce(style, '(none)')", "token_count": "coalesce(token_count, '(none)')", "leakage": "'none'"}


@query("h17_pair_counts", " UNION ALL ".join(f"SELECT 'set1' AS set_name, 'run' AS taken_from, '{n}' AS dimension, {v} AS value, count(*) AS n FROM {{queries}} GROUP BY {v}" for n, v in _PC.items()))
def h17(spark, d):
    none = F.lit(None).cast("string")
    r = P.saved_results(spark, d).withColumn("leakage", none)
    sets = r.filter("false").withColumn("set_name", F.lit("gone"))
    return K.pair_counts(sets, r, P.runs(spark, d, r))


@query("h17_set_counts", " UNION ALL ".join(f"SELECT 'set1' AS set_name, 'set' AS taken_from, '{n}' AS dimension, {v} AS value, count(*) AS n FROM {{set_queries}} GROUP BY {v}" for n, v in _PC.items()))
def h17_set(spark, d):
    """Counts from the set itself; its runs are not needed then."""
    q = P.queries(spark, d).withColumn("set_name", F.lit("set1")).withColumn("leakage", F.lit(None).cast("string"))
    runs = spark.createDataFrame([("any", "set1")], "tag string, set_name string")
    return K.pair_counts(q, q.drop("set_name").withColumn("tag", F.lit("any")), runs)


@query("h18_coverage", "SELECT tag, count(*) FILTER (NOT reachable) AS unreachable, count(*) FILTER (NOT reachable AND rank IS NOT NULL) AS found FROM {results} GROUP BY tag")
def h18(spark, d):
    return M.coverage_slice(P.results(spark, d))


SHARED["timings"] = "SELECT event_type AS tag, event_type = 'error' AS is_local, value AS embed_ms, CAST(event_id % 100 AS DOUBLE) AS search_ms FROM {events}"


@query("h19_latency", """SELECT tag, part, n, v[least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) + 1] AS p50, v[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95 FROM (
 SELECT tag, part, count(*) AS n, list_sort(list(ms)) AS v FROM (SELECT tag, 'embed' AS part, embed_ms AS ms FROM {timings} WHERE NOT is_local UNION ALL
 SELECT tag, 'search', search_ms FROM {timings} WHERE NOT is_local UNION ALL SELECT tag, 'total', embed_ms + search_ms FROM {timings} WHERE NOT is_local) GROUP BY tag, part)""")
def h19(spark, d):
    e = table(spark, d, "events")
    return M.latency(e.select(F.col("event_type").alias("tag"), (F.col("event_type") == "error").alias("is_local"),
                              F.col("value").alias("embed_ms"), (F.col("event_id") % 100).cast("double").alias("search_ms")))


@query("h20_provenance", """SELECT tag, ran_at, model, index_name, CASE WHEN exact THEN 'exact scan' WHEN starts_with(index_name, 'file:') THEN 'exact (brute force)' ELSE concat('probes=', probes) END AS search,
 CASE WHEN filter_junk THEN 'junk filtered' ELSE 'unfiltered' END AS pool FROM {run_log}""")
def h20(spark, d):
    return K.provenance(table(spark, d, "run_log"))


@query("h20_warnings", "SELECT count(DISTINCT CASE WHEN note IS NOT NULL THEN coalesce(pool_scale, 'unrecorded') END) > 1 AS mixed_scales, count(DISTINCT preregistered) > 1 AS mixed_notes FROM {run_log}")
def h20_warnings(spark, d):
    return K.provenance_warnings(table(spark, d, "run_log"))


SHARED["ties"] = f"""SELECT tag, qid, source, reachable, returned, g, strict, lenient, CASE WHEN target_in > 0 THEN 1.0 / g ELSE 0.0 END AS strict_neutral, acceptable_in / g AS lenient_neutral FROM (
 SELECT h.tag, h.qid, k.source, k.reachable, count(*) AS returned, count(*) FILTER (h.sim = h.best) AS g, count(*) FILTER (h.sim = h.best AND {O.norm('h.word')} = k.t) AS target_in,
 count(*) FILTER (h.sim = h.best AND list_contains(k.ok, {O.norm('h.word')})) AS acceptable_in, max(CASE WHEN h.rank = 1 AND {O.norm('h.word')} = k.t THEN 1 ELSE 0 END) AS strict,
 max(CASE WHEN h.rank = 1 AND list_contains(k.ok, {O.norm('h.word')}) THEN 1 ELSE 0 END) AS lenient
 FROM (SELECT *, max(sim) OVER (PARTITION BY tag, qid) AS best FROM {{hits_all}} WHERE rank <= 10) h JOIN {{queries}} k ON k.qid = h.qid GROUP BY h.tag, h.qid, k.source, k.reachable)"""


def _ties(spark, d):
    """Ties of all four runs, told apart by a query key that carries the run."""
    key = F.struct("tag", "qid")
    hits = P.all_hits(spark, d, P.TAGS, 10).withColumn("qid", key)
    asked = P.queries(spark, d).withColumn("tag", F.explode(F.array(*map(F.lit, P.TAGS)))).withColumn("qid", key)
    return B.tie_groups(hits, asked).select("qid.tag", F.col("qid.qid").alias("qid"), "g", "strict", "lenient", "strict_neutral", "lenient_neutral", "tied", "saturated")


@query("h21_tie_groups", "SELECT tag, qid, g, strict, lenient, round(strict_neutral, 9) AS strict_neutral, round(lenient_neutral, 9) AS lenient_neutral, g > 1 AS tied, g = returned AS saturated FROM {ties}")
def h21(spark, d):
    return _round(_ties(spark, d), "strict_neutral", "lenient_neutral")


@query("h22_tie_audit", f"""SELECT tag, count(*) AS n, sum(strict) AS strict, round(sum(strict_neutral), 6) AS strict_neutral, sum(lenient) AS lenient, round(sum(lenient_neutral), 6) AS lenient_neutral, count(*) FILTER (g > 1) AS tied,
 count(*) FILTER (g = returned) AS saturated, round(greatest(sum(strict) - sum(strict_neutral), sum(lenient) - sum(lenient_neutral)) / count(*), 6) AS worst,
 greatest(sum(strict) - sum(strict_neutral), sum(lenient) - sum(lenient_neutral)) / count(*) > 0.05 AS fails FROM {{ties}} WHERE {_HEAD} GROUP BY tag""")
def h22(spark, d):
    head = P.queries(spark, d).filter(M.is_headline()).select("qid")
    rows = _ties(spark, d).join(head, "qid", "left_semi")
    return _round(B.tie_audit(rows, ["tag"]), "strict_neutral", "lenient_neutral", "worst", digits=6)


SHARED["target_sims"] = f"SELECT k.qid, k.target, {O.dot('k.qvec', 'v.embedding')} AS target_sim FROM {{queries}} k LEFT JOIN {{vocab}} v ON v.word = k.target"
SHARED["misses"] = """SELECT t.qid, t.target, t.target_sim, count(*) FILTER (h.sim > t.target_sim) AS beating, bool_or(lower(h.word) = lower(t.target)) AS returned, max(CASE WHEN h.rank = 1 THEN h.sim END) AS top1_sim
 FROM {target_sims} t JOIN {hits_lemma} h ON h.qid = t.qid AND h.rank <= 10 GROUP BY t.qid, t.target, t.target_sim"""


def _targets(spark, d):
    q = P.queries(spark, d)
    return q, S.similarity_to(q, P.vectors(spark, d))


@query("h23_margins", f"""SELECT round(e.echo_sim, 9) AS echo_sim, round(e.other_sim, 9) AS other_sim, round(e.top1_sim, 9) AS top1_sim, round(m.target_sim, 9) AS target_sim, round(m.mean_margin, 9) AS mean_margin,
 round(e.echo_sim - m.target_sim, 9) AS echo_gap, round(e.other_sim - m.target_sim, 9) AS other_gap, CASE WHEN e.echo_sim - m.target_sim > 0.12 THEN 'structural' WHEN e.echo_sim - m.target_sim > 0.03 THEN 'mixed' ELSE 'ordering' END AS verdict
 FROM (SELECT avg(sim) FILTER (echo) AS echo_sim, avg(sim) FILTER (NOT echo) AS other_sim, avg(sim) FILTER (rank = 1) AS top1_sim FROM (
 SELECT h.sim, h.rank, list_has_any({O.stems_w('h.word')}, k.stems) AS echo FROM {{hits_lemma}} h JOIN {{queries}} k ON k.qid = h.qid WHERE h.rank <= 10)) e
 CROSS JOIN (SELECT avg(target_sim) AS target_sim, avg(top1_sim - target_sim) AS mean_margin FROM {{misses}}) m""")
def h23(spark, d):
    q, targets = _targets(spark, d)
    out = B.margins(P.run_hits(spark, d, "lemma", 10), q, targets)
    return _round(out, *[c for c in out.columns if c != "verdict"])


@query("h24_miss_classes", """SELECT qid, target, beating, CASE WHEN target_sim IS NULL THEN 'unreachable' WHEN returned THEN 'returned' WHEN beating + 1 <= 10 THEN 'index miss' ELSE 'ranking failure' END AS kind FROM {misses}""")
def h24(spark, d):
    q, targets = _targets(spark, d)
    return B.miss_classes(P.run_hits(spark, d, "lemma", 10), q, targets).select("qid", "target", "beating", "kind")


@query("h25_margin_verdicts", "SELECT source, CASE WHEN gap > 0.12 THEN 'structural' WHEN gap > 0.03 THEN 'mixed' ELSE 'ordering' END AS verdict FROM (SELECT d.source, avg(l.quality) - avg(l.toxic) - 0.3 AS gap FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY d.source)")
def h25(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    gaps = docs.join(table(spark, d, "labels"), "doc_id").groupBy("source").agg(
        (F.avg("quality") - F.avg("toxic") - 0.3).alias("gap"))
    return gaps.select("source", D.margin_verdict(F.col("gap")).alias("verdict"))


@query("h26_representation", f"""SELECT round(min(a), 9) AS min, round(avg(a), 9) AS mean, round(max(a), 9) AS max, round(avg(b), 9) AS description_mean, round(list_sort(list(a))[count(*) // 2 + 1], 9) AS p50,
 CASE WHEN avg(a) > 0.98 THEN 'bare lemma' WHEN avg(a) < 0.7 AND avg(b) > avg(a) THEN 'not bare lemma' ELSE 'ambiguous' END AS verdict
 FROM (SELECT {O.dot('v.embedding', 'v.embedding')} AS a, {O.dot('v.embedding', 'n.embedding')} AS b FROM {{vocab}} v LEFT JOIN {{vocab}} n ON n.id = v.id + 1)""")
def h26(spark, d):
    v = table(spark, d, "vocab")
    n = v.select((F.col("id") - 1).alias("id"), F.col("embedding").alias("description_vec"))
    probe = v.select("id", F.col("embedding").alias("stored"), F.col("embedding").alias("word_vec")).join(n, "id", "left")
    out = B.representation(probe)
    return _round(out, "min", "mean", "max", "description_mean", "p50")
