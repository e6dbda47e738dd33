"""Registered queries: pools, cells and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.functions import text as X
from lexspan.operators import cells as C, encode as E, fingerprint as H, pool as P
from lexspan.plans import frames as R, oracle_parts as O
from lexspan.plans.fixtures import table
from lexspan.plans.registry import SHARED, query
from lexspan.session import freeze
from lexspan.sources import stores as T
from lexspan.streaming.jobs import scratch

SEED, LAYOUT = "7:", "8:"

SHARED["lemma_senses"] = "SELECT lower(word) AS lemma_lower, sense_key, pos, gloss, ex1, ex2 FROM {senses} WHERE gloss <> ''"
SHARED["pool_words_all"] = """SELECT v.word, t.word IS NOT NULL AS is_target FROM {vocab} v
 LEFT JOIN (SELECT DISTINCT word FROM {targets} WHERE word IS NOT NULL) t ON t.word = v.word
 WHERE lower(v.word) IN (SELECT lemma_lower FROM {lemma_senses})"""
SHARED["targets"] = """SELECT w.target, s.word FROM (SELECT DISTINCT target FROM {eval_set}) w
 LEFT JOIN (SELECT lower(word) AS l, min(word) AS word FROM {vocab} WHERE lower(word) IN (SELECT lemma_lower FROM {lemma_senses}) GROUP BY lower(word)) s
 ON s.l = lower(w.target)"""
SHARED["pool"] = f"SELECT word, is_target, row_number() OVER (ORDER BY md5(concat('{LAYOUT}', word)), word) - 1 AS row FROM {{pool_words_all}}"
SHARED["gloss_rows"] = "SELECT p.word, p.row, p.is_target, s.sense_key, s.gloss, s.ex1, s.ex2 FROM {pool} p JOIN {lemma_senses} s ON s.lemma_lower = lower(p.word)"


def lemma_senses(spark, d):
    return P.senses_by_lemma(R.synsets(spark, d))


def eligible(spark, d, lemmas=None):
    return P.eligible_words(table(spark, d, "vocab").select("word"), lemmas or lemma_senses(spark, d))


def targets(spark, d, words=None):
    return P.resolve_targets(table(spark, d, "eval_core"), words or eligible(spark, d))


def target_words(spark, d, words=None):
    return targets(spark, d, words).filter("word is not null").select("word").distinct()


def pooled(spark, d, lemmas=None):
    words = eligible(spark, d, lemmas)
    found = target_words(spark, d, words)
    return P.lay_out(found, P.distractors(words, found, SEED), LAYOUT)


def pool_with_glosses(spark, d):
    """(pool, its gloss rows)."""
    lemmas = lemma_senses(spark, d)
    pool = pooled(spark, d, lemmas)
    return pool, P.gloss_rows(pool, lemmas)


def pool_glosses(spark, d):
    return pool_with_glosses(spark, d)[1]


@query("d1_senses_by_lemma", "SELECT lemma_lower, sense_key, md5(gloss) AS gloss FROM {lemma_senses}")
def d1(spark, d):
    return lemma_senses(spark, d).select("lemma_lower", "sense_key", F.md5("gloss").alias("gloss"))


@query("d2_eligible", "SELECT word FROM {vocab} WHERE lower(word) IN (SELECT lemma_lower FROM {lemma_senses})")
def d2(spark, d):
    return eligible(spark, d)


@query("d3_targets", "SELECT target, word FROM {targets}")
def d3(spark, d):
    return targets(spark, d)


@query("d3_dropped_targets", "SELECT target FROM {targets} WHERE word IS NULL")
def d3_dropped(spark, d):
    return targets(spark, d).filter("word is null").select("target")


@query("d4_distractors", f"""SELECT word FROM {{pool_words_all}} WHERE NOT is_target ORDER BY md5(concat('{SEED}', word)), word LIMIT 50""")
def d4(spark, d):
    words = eligible(spark, d)
    return P.distractors(words, target_words(spark, d, words), SEED, 50)


@query("d5_layout", "SELECT word, is_target, row FROM {pool}")
def d5(spark, d):
    return pooled(spark, d)


@query("d6_layout_check", """SELECT min(CASE WHEN is_target THEN row END) AS first_target_row, round(avg(CASE WHEN is_target THEN row END), 6) AS mean_target_row,
 (count(*) - 1) / 2 AS even_row, count(*) AS pool_words FROM {pool}""")
def d6(spark, d):
    return P.layout_check(pooled(spark, d)).withColumn("mean_target_row", F.round("mean_target_row", 6))


@query("d7_gloss_rows", "SELECT word, row, sense_key, md5(gloss) AS gloss, array_to_string(list_filter([ex1, ex2], lambda e: e IS NOT NULL), '|') AS examples FROM {gloss_rows}")
def d7(spark, d):
    return pool_glosses(spark, d).select("word", "row", "sense_key", F.md5("gloss").alias("gloss"), F.array_join("examples", "|").alias("examples"))


@query("d8_sense_stats", """SELECT w.n AS pool_words, sum(g.n) AS gloss_rows, round(sum(g.n) / w.n, 9) AS mean_senses, max(g.n) AS max_senses,
 (SELECT word FROM (SELECT word, count(*) AS c FROM {gloss_rows} GROUP BY word) ORDER BY c DESC, word LIMIT 1) AS max_senses_word,
 sum(g.shown) AS with_examples, round(sum(g.shown) / sum(g.n), 9) AS example_share
 FROM (SELECT word, count(*) AS n, count(*) FILTER (ex1 IS NOT NULL OR ex2 IS NOT NULL) AS shown FROM {gloss_rows} GROUP BY word) g
 CROSS JOIN (SELECT count(*) AS n FROM {pool}) w GROUP BY w.n""")
def d8(spark, d):
    stats = P.sense_stats(*pool_with_glosses(spark, d))
    return stats.withColumn("mean_senses", F.round("mean_senses", 9)).withColumn("example_share", F.round("example_share", 9))


_TEXT = """CASE v.variant WHEN 'lemma' THEN s.word WHEN 'lemma_gloss' THEN concat(s.word, ': ', s.gloss)
 WHEN 'gloss_examples' THEN concat_ws('; ', s.gloss, s.ex1, s.ex2) ELSE s.gloss END"""


@query("d9_cell_texts", f"SELECT s.row_id, v.variant, md5({_TEXT}) AS text FROM {{senses}} s CROSS JOIN (SELECT unnest(['lemma', 'gloss', 'gloss_examples', 'lemma_gloss']) AS variant) v")
def d9(spark, d):
    variants = F.explode(F.array(*[F.lit(v) for v in P.VARIANTS]))
    rows = R.glosses(spark, d).withColumn("variant", variants)
    text = P.cell_text(F.col("variant"), F.col("word"), F.col("gloss"), F.col("examples"))
    return rows.select(F.col("row").alias("row_id"), "variant", F.md5(text).alias("text"))


def _tree(source: str) -> str:
    dense = f"SELECT row_number() OVER (ORDER BY row) - 1 AS row, text FROM ({source})"
    block = f"SELECT row // 4096 AS row, sha256(string_agg(text || chr(0), '' ORDER BY row)) AS piece FROM ({dense}) GROUP BY row // 4096"
    return f"SELECT sha256(string_agg(piece, '' ORDER BY row)) AS sha256 FROM ({block})"


@query("d10_texts_digest", _tree("SELECT doc_id AS row, text FROM {documents}"))
def d10(spark, d):
    return H.texts_digest(table(spark, d, "documents").select(F.col("doc_id").alias("row"), "text"))


@query("d10_texts_digest_by_language", """SELECT lang, sha256(string_agg(piece, '' ORDER BY row)) AS sha256 FROM (
 SELECT lang, pos // 4096 AS row, sha256(string_agg(text || chr(0), '' ORDER BY pos)) AS piece FROM (
 SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM {documents}) GROUP BY lang, pos // 4096) GROUP BY lang""")
def d10_lang(spark, d):
    docs = table(spark, d, "documents").select("lang", F.col("doc_id").alias("row"), "text")
    return H.texts_digest(docs, ["lang"])


# The little-endian bytes of each 32-bit float, from its bits.
_HEX = "hex(CAST(CAST(CAST(x AS FLOAT) AS BIT) AS BLOB))"
_BYTES = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"
_VECTOR_HASH = f"sha256(unhex(array_to_string(list_transform(list_transform(embedding, lambda x: {_HEX}), lambda h: {_BYTES}), '')))"


@query("d11_vectors_digest", _tree(f"SELECT id AS row, {_VECTOR_HASH} AS text FROM {{vocab}}"))
def d11(spark, d):
    return H.vectors_digest(R.vectors(spark, d))


@query("d12_synset_collapse", "SELECT sense_key, word, row_id AS row FROM {collapsed}")
def d12(spark, d):
    return C.collapse_synsets(R.sense_cell(spark, d)).select("sense_key", "word", "row")


@query("d12_synset_members", "SELECT sense_key, word, member_pos FROM {members}")
def d12_members(spark, d):
    return C.synset_members(R.sense_cell(spark, d))


@query("d12_divergent_synsets", "SELECT pos AS sense_key, count(*) AS rows, count(DISTINCT embedding) > 1 AS divergent FROM {senses} GROUP BY pos")
def d12_divergent(spark, d):
    return C.synset_groups(R.sense_cell(spark, d).withColumn("sense_key", F.col("pos")))


@query("d13_collapse_report", """SELECT rows, synsets, multi_row_synsets, divergent_synsets, rows - synsets AS rows_saved, round((rows - synsets) / rows, 9) AS saved_share,
 round(rows * 64 * 4 / 1e6, 6) AS sense_full_mb, round(rows * 64 * 2 / 1e6, 6) AS sense_half_mb, round(rows * 32 * 2 / 1e6, 6) AS sense_half_short_mb,
 round(synsets * 64 * 4 / 1e6, 6) AS synset_full_mb, round(synsets * 64 * 2 / 1e6, 6) AS synset_half_mb, round(synsets * 32 * 2 / 1e6, 6) AS synset_half_short_mb
 FROM (SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS synsets, count(*) FILTER (n > 1) AS multi_row_synsets, count(*) FILTER (dv > 1) AS divergent_synsets
 FROM (SELECT sense_key, count(*) AS n, count(DISTINCT embedding) AS dv FROM {senses} GROUP BY sense_key))""")
def d13(spark, d):
    report = C.collapse_report(R.sense_cell(spark, d), 64, 32)
    return report.select(*[F.round(c, 6).alias(c) if c.endswith("_mb") else F.round(c, 9).alias(c) if c == "saved_share" else c for c in report.columns])


@query("d14_derived_cell", """SELECT row_id AS row, round(list_inner_product(h, h), 9) AS unit, round(h[1], 9) AS first, len(h) AS dim FROM (
 SELECT row_id, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS h FROM (
 SELECT row_id, list_transform(c, lambda x: """ + "CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2.0, greatest(floor(log2(abs(x))), -14.0) - 10.0), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14.0) - 10.0) END" + """) AS q FROM (
 SELECT row_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS c FROM (SELECT row_id, CAST(embedding AS DOUBLE[])[1:32] AS v FROM {senses}))))""")
def d14(spark, d):
    from lexspan.functions import vectors as V

    cell = C.derive_vectors(R.sense_cell(spark, d), 32)
    vec = F.col("vec")
    return cell.select("row", F.round(V.dot(vec, vec), 9).alias("unit"), F.round(F.get(vec, F.lit(0)), 9).alias("first"), F.size(vec).alias("dim"))


@query("d14_derived_meta", "SELECT concat(lang, '_h32') AS cell, lang AS source_cell, 'float16' AS precision, 32 AS dim, count(*) AS rows, round(count(*) * 32 * 2 / 1e6, 6) AS payload_mb FROM {documents} GROUP BY lang")
def d14_meta(spark, d):
    docs = table(spark, d, "documents")
    meta = docs.groupBy(F.col("lang").alias("cell")).agg(F.count("*").alias("rows"))
    return C.derived_meta(meta, 32, True).withColumn("payload_mb", F.round("payload_mb", 6))


def _cell_sql(name: str) -> str:
    """Row, key and a weighted sum of the rounded components of one encoded cell."""
    encoder, representation, variant = E.CELLS[name]
    rows = "{vocab_rows}" if representation == "lemma" else "{sense_rows}"
    coded = O.digest_encoding(f"SELECT row AS k, {'word' if representation == 'lemma' else variant} AS text FROM {rows}", encoder)
    return f"""SELECT '{name}' AS cell, r.row, r.word, r.sense_key, CAST(v.mark AS BIGINT) AS mark FROM {rows} r
 JOIN (SELECT k, sum((i + 1) * round(CAST(x AS DOUBLE) * 10000)) AS mark FROM {coded} GROUP BY k) v ON v.k = r.row"""


@query("d15_encode_cells", " UNION ALL ".join(map(_cell_sql, E.CELLS)), {
    "vocab_rows": "SELECT id AS row, word, 'lemma' AS sense_key FROM {vocab}",
    "sense_rows": """SELECT row_id AS row, word, sense_key, gloss, concat_ws('; ', gloss, ex1, ex2) AS gloss_examples, concat(word, ': ', gloss) AS lemma_gloss FROM {senses}"""})
def d15(spark, d):
    words, glosses = R.vectors(spark, d).select("row", "word"), R.glosses(spark, d)
    encoders = {name: (lambda salt=name: E.DigestEncoder(64, salt)) for name in ("tuned", "base")}
    cells = E.build_cells(list(E.CELLS), words, glosses, encoders)
    mark = F.aggregate(F.transform("vec", lambda x, i: (i + 1) * F.round(x.cast("double") * 10000)), F.lit(0.0), lambda a, x: a + x)
    return cells.select("cell", "row", "word", "sense_key", mark.cast("long").alias("mark"))


# Input hashes of each language's texts stand for the expected hash of a variant.
SHARED["expected"] = """SELECT lang AS variant, sha256(string_agg(piece, '' ORDER BY block)) AS want, CAST(sum(n) AS BIGINT) AS want_rows FROM (
 SELECT lang, block, count(*) AS n, sha256(string_agg(text || chr(0), '' ORDER BY doc_id)) AS piece FROM (
 SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 4096 AS block FROM {documents}) GROUP BY lang, block) GROUP BY lang"""
SHARED["cell_meta"] = """SELECT source || '-' || lang AS cell, CASE WHEN source = 'src3' THEN 'unheard' ELSE lang END AS variant, lang AS representation,
 CASE WHEN source = 'src2' THEN n - 1 ELSE n END AS rows, CASE WHEN source = 'src1' THEN NULL WHEN source = 'src4' THEN 'tampered' ELSE want END AS inputs_sha256
 FROM (SELECT d.source, d.lang, e.want_rows AS n, e.want FROM (SELECT DISTINCT source, lang FROM {documents}) d JOIN {expected} e ON e.variant = d.lang)"""


def _expected(spark, d):
    docs = table(spark, d, "documents")
    digests = H.texts_digest(docs.select("lang", F.col("doc_id").alias("row"), "text"), ["lang"])
    counts = docs.groupBy("lang").agg(F.count("*").alias("want_rows"))
    return digests.join(counts, "lang").select(F.col("lang").alias("variant"), F.col("sha256").alias("want"), "want_rows")


def _cell_meta(spark, d, expected):
    cells = table(spark, d, "documents").select("source", "lang").distinct()
    rows = cells.join(expected, F.col("lang") == F.col("variant"))
    return rows.select(
        F.concat_ws("-", "source", "lang").alias("cell"),
        F.when(F.col("source") == "src3", "unheard").otherwise(F.col("lang")).alias("variant"),
        F.col("lang").alias("representation"),
        F.when(F.col("source") == "src2", F.col("want_rows") - 1).otherwise(F.col("want_rows")).alias("rows"),
        F.when(F.col("source") == "src1", None).when(F.col("source") == "src4", "tampered").otherwise(F.col("want")).alias("inputs_sha256"))


@query("d16_backfill_verdicts", """SELECT c.cell, CASE WHEN c.rows <> r.want_rows THEN 'different pool' WHEN e.want IS NULL THEN 'unknown variant'
 WHEN c.inputs_sha256 IS NULL THEN 'backfilled' WHEN c.inputs_sha256 = e.want THEN 'matches' ELSE 'mismatch' END AS verdict
 FROM {cell_meta} c JOIN {expected} r ON r.variant = c.representation LEFT JOIN {expected} e ON e.variant = c.variant""")
def d16(spark, d):
    expected = _expected(spark, d)
    pool_rows = expected.select(F.col("variant").alias("representation"), "want_rows")
    return C.backfill_verdicts(_cell_meta(spark, d, expected), expected.select("variant", "want"), pool_rows).select("cell", "verdict")


SHARED["doc_vectors"] = "SELECT concat(d.source, '-', d.lang) AS cell, d.doc_id AS row, e.embedding FROM {documents} d JOIN {embeddings} e ON e.vec_id = d.doc_id % (SELECT count(*) FROM {embeddings})"


def _doc_vectors(spark, d):
    """A vector for every document, by cell of source and language."""
    e = table(spark, d, "embeddings")
    docs = table(spark, d, "documents").withColumn("vec_id", F.col("doc_id") % e.agg(F.count("*")).scalar())
    return docs.join(e, "vec_id").select(F.concat_ws("-", "source", "lang").alias("cell"), F.col("doc_id").alias("row"), F.col("embedding").alias("vec"))


def _grouped_tree(source: str, key: str, alias: str) -> str:
    """Digest of `text` in the order of `row`, for each `key`."""
    dense = f"SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY row) - 1 AS pos, text FROM ({source})"
    block = f"SELECT {key}, pos // 4096 AS block, sha256(string_agg(text || chr(0), '' ORDER BY pos)) AS piece FROM ({dense}) GROUP BY {key}, pos // 4096"
    return f"SELECT {key}, sha256(string_agg(piece, '' ORDER BY block)) AS {alias} FROM ({block}) GROUP BY {key}"


_VERDICT = """CASE WHEN c.rows <> r.want_rows THEN 'different pool' WHEN e.want IS NULL THEN 'unknown variant'
 WHEN c.inputs_sha256 IS NULL THEN 'backfilled' WHEN c.inputs_sha256 = e.want THEN 'matches' ELSE 'mismatch' END"""


@query("d16_applied", f"""SELECT j.cell, j.verdict, CASE WHEN j.verdict IN ('backfilled', 'matches') THEN j.want ELSE j.inputs_sha256 END AS inputs_sha256,
 CASE WHEN j.verdict <> 'mismatch' THEN v.vectors_sha256 END AS vectors_sha256
 FROM (SELECT c.cell, c.inputs_sha256, e.want, {_VERDICT} AS verdict FROM {{cell_meta}} c JOIN {{expected}} r ON r.variant = c.representation LEFT JOIN {{expected}} e ON e.variant = c.variant) j
 JOIN ({_grouped_tree(f"SELECT cell, row, {_VECTOR_HASH} AS text FROM {{doc_vectors}}", "cell", "vectors_sha256")}) v ON v.cell = j.cell""")
def d16_applied(spark, d):
    """Cells stored with their metadata; the backfill is published as its next version and read back."""
    expected = freeze(_expected(spark, d))
    path = scratch(spark)
    T.publish_meta(_cell_meta(spark, d, expected), path)
    pool_rows = expected.select(F.col("variant").alias("representation"), "want_rows")
    verdicts = C.backfill_verdicts(T.read_meta(spark, path), expected.select("variant", "want"), pool_rows)
    filled = freeze(C.apply_backfill(verdicts, H.vectors_digest(_doc_vectors(spark, d), ["cell"])))
    T.publish_meta(filled, path)
    return T.read_meta(spark, path).select("cell", "verdict", "inputs_sha256", "vectors_sha256")


# A cell per source. Sources with an even number hold the words of src0, the others their own; src0 has no
# hash, src4 that of other texts, and all others that of their documents.
_SOURCE_WORDS = """SELECT DISTINCT c.source AS cell, v.word FROM (SELECT DISTINCT source FROM {documents}) c
 JOIN {documents} d ON d.source = CASE WHEN CAST(substr(c.source, 4) AS INT) % 2 = 0 THEN 'src0' ELSE c.source END
 JOIN {vocab} v ON v.id = d.doc_id % (SELECT count(*) FROM {embeddings})"""


@query("d17_pool_identity", """SELECT w.cell, w.words, w.pooled, p.n AS pool_words, CASE WHEN w.words <> w.pooled OR w.pooled <> p.n THEN 'stale: different pool'
 WHEN m.recorded IS NULL THEN 'stale: no input hash' WHEN m.recorded = h.want THEN 'fresh' ELSE 'stale: input hash mismatch' END AS verdict
 FROM (SELECT c.cell, count(*) AS words, count(o.word) AS pooled FROM {source_words} c LEFT JOIN (SELECT word FROM {source_words} WHERE cell = 'src0') o ON o.word = c.word GROUP BY c.cell) w
 JOIN {text_hashes} h ON h.cell = w.cell
 JOIN (SELECT cell, CASE WHEN cell = 'src4' THEN other WHEN cell <> 'src0' THEN want END AS recorded FROM {text_hashes} JOIN {upper_hashes} USING (cell)) m ON m.cell = w.cell
 CROSS JOIN (SELECT count(*) AS n FROM {source_words} WHERE cell = 'src0') p""",
       {"source_words": _SOURCE_WORDS, "text_hashes": _grouped_tree("SELECT source AS cell, doc_id AS row, text FROM {documents}", "cell", "want"),
        "upper_hashes": _grouped_tree("SELECT source AS cell, doc_id AS row, concat('x', text) AS text FROM {documents}", "cell", "other")})
def d17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "text", (F.col("doc_id") % table(spark, d, "embeddings").agg(F.count("*")).scalar()).alias("id"))
    even = F.substring("cell", F.lit(4), F.length("cell")).cast("int") % 2 == 0
    sources = docs.select(F.col("source").alias("cell")).distinct().withColumn("source", F.when(even, "src0").otherwise(F.col("cell")))
    cells = freeze(sources.join(docs, "source").join(table(spark, d, "vocab").select("id", "word"), "id").select("cell", "word").distinct())
    texts = docs.select(F.col("source").alias("cell"), F.col("doc_id").alias("row"), "text")
    want = H.texts_digest(texts, ["cell"]).withColumnRenamed("sha256", "want")
    other = H.texts_digest(texts.withColumn("text", F.concat(F.lit("x"), "text")), ["cell"]).withColumnRenamed("sha256", "other")
    recorded = F.when(F.col("cell") == "src4", F.col("other")).when(F.col("cell") != "src0", F.col("want"))
    meta = want.join(other, "cell").select("cell", recorded.alias("inputs_sha256"))
    return C.pool_identity(cells, meta, cells.filter("cell = 'src0'").select("word"), want)


@query("d17_targets_present", "SELECT count(*) AS targets, count(v.word) AS present FROM (SELECT DISTINCT target FROM {eval_set}) t LEFT JOIN {vocab} v ON v.word = t.target")
def d17_targets(spark, d):
    wanted = table(spark, d, "eval_set").select(F.col("target").alias("word")).distinct()
    return C.targets_present(wanted, table(spark, d, "vocab"))


_SELF = """SELECT s.word, s.sense_key, s.embedding FROM {senses} s ORDER BY md5(concat_ws('|', '7', s.word, s.sense_key)), s.word, s.sense_key LIMIT 60"""


@query("d18_self_retrieval", """SELECT count(*) AS n, sum(pass) AS rank1, sum(exact) AS exact_word_rank1, sum(ten) AS top10 FROM (
 SELECT q.qid, max(CASE WHEN h.rank = 1 AND h.sense_key = q.sense_key THEN 1 ELSE 0 END) AS pass, max(CASE WHEN h.rank = 1 AND h.word = q.word THEN 1 ELSE 0 END) AS exact,
 max(CASE WHEN h.sense_key = q.sense_key THEN 1 ELSE 0 END) AS ten FROM {probe} q JOIN {probe_hits} h ON h.qid = q.qid GROUP BY q.qid)""",
       {"probe": f"SELECT concat_ws('|', word, sense_key) AS qid, word, sense_key, embedding AS qvec FROM ({_SELF})",
        "probe_hits": O.top(f"SELECT p.qid, s.word, s.sense_key, s.row_id, {O.dot('s.embedding', 'p.qvec')} AS sim FROM {{probe}} p CROSS JOIN {{senses}} s", 10, "sim DESC, word, sense_key, row_id")})
def d18(spark, d):
    cell = R.sense_cell(spark, d)
    return C.self_retrieval(cell, C.hash_sample(cell.select("word", "sense_key", F.col("vec").alias("qvec")), "7"), True)
