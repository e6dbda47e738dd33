"""Registered queries: vocabulary audits, coverage, evaluation-set building."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspan.operators import acceptable as A, coverage as V, evalset as G, frequency as Z, vocab_audit as U
from lexspan.plans import frames as P, oracle_parts as O, text_queries as TQ
from lexspan.plans.fixtures import table
from lexspan.plans.pool_queries import pool_glosses, target_words
from lexspan.plans.registry import SHARED, query

SHARED["cats"] = f"SELECT id, word, {TQ._CATS} FROM {{vocab}}"
_NAMES = ["multiword", "capitalised", "digit", "hyphen", "apostrophe", "other_punct", "case_collision", "clean_single"]


@query("f1_category_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS category, count(*) FILTER ({c}) AS n, count(*) AS total, round(count(*) FILTER ({c}) / count(*), 9) AS share FROM {{cats}}" for c in _NAMES))
def f1(spark, d):
    return U.category_counts(table(spark, d, "vocab")).withColumn("share", F.round("share", 9))


@query("f2_overlaps", " UNION ALL ".join(
    f"SELECT '{a} & {b}' AS pair, count(*) FILTER ({a} AND {b}) AS n, count(*) AS total FROM {{cats}}" for a, b in U.OVERLAPS))
def f2(spark, d):
    return U.overlap_counts(table(spark, d, "vocab"))


_DROPS = ["capitalised", O.junk("word"), f"({O.junk('word')} OR multiword)", "NOT clean_single"]


@query("f3_filter_costs", " UNION ALL ".join(
    f"SELECT '{name}' AS filter, count(*) FILTER ({drop}) AS removed, count(*) FILTER (NOT {drop}) AS kept FROM {{cats}}" for name, drop in zip(U.FILTERS, _DROPS)))
def f3(spark, d):
    return U.filter_costs(table(spark, d, "vocab"))


@query("f4_case_collisions", "SELECT lower(word) AS lower_word, count(*) AS n FROM {vocab} GROUP BY lower(word) HAVING count(*) > 1")
def f4(spark, d):
    return U.collisions(table(spark, d, "vocab"))


@query("f5_capital_costs", """SELECT count(*) FILTER (twin) AS with_twin, count(*) FILTER (NOT twin AND NOT regexp_matches(word, '[ _]')) AS single_no_twin,
 count(*) FILTER (NOT twin AND regexp_matches(word, '[ _]')) AS multi_no_twin FROM (
 SELECT v.word, EXISTS (SELECT 1 FROM {vocab} u WHERE u.word = lower(v.word) AND u.word <> v.word) AS twin FROM {vocab} v WHERE regexp_matches(v.word, '^[A-Z]'))""")
def f5(spark, d):
    return U.capital_costs(table(spark, d, "vocab"))


@query("f6_category_samples", "SELECT category, place, word FROM (SELECT category, word, row_number() OVER (PARTITION BY category ORDER BY md5(word), word) AS place FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS category, word FROM {{cats}} WHERE {c}" for c in _NAMES) + ")) WHERE place <= 200")
def f6(spark, d):
    return U.category_samples(table(spark, d, "vocab")).select("category", "place", "word")


@query("f7_pollution", f"""SELECT h.qid, count(*) AS results, count(*) FILTER ({O.junk('h.word')}) AS junk,
 count(*) FILTER (list_has_any({O.stems_w('h.word')}, k.stems)) AS echo FROM {{hits_lemma}} h JOIN {{queries}} k ON k.qid = h.qid WHERE h.rank <= 10 GROUP BY h.qid""")
def f7(spark, d):
    return U.pollution(P.run_hits(spark, d, "lemma", 10), P.queries(spark, d))


@query("f8_reachability", """SELECT k.qid, k.target AS answer, min(h.rank) AS rank, CASE WHEN NOT bool_or(v.known) THEN 'not in vocab' WHEN min(h.rank) IS NULL THEN 'not in top-10' ELSE 'retrieved' END AS status
 FROM {queries} k JOIN (SELECT q.qid, lower(q.target) IN (SELECT lower(word) FROM {vocab}) AS known FROM {queries} q) v ON v.qid = k.qid
 LEFT JOIN {hits_lemma} h ON h.qid = k.qid AND h.rank <= 10 AND lower(h.word) = lower(k.target) GROUP BY k.qid, k.target""")
def f8(spark, d):
    return U.reachability(P.run_hits(spark, d, "lemma", 10), P.queries(spark, d), table(spark, d, "vocab"))


SHARED["lemmas"] = """SELECT DISTINCT pos, lemma FROM (SELECT pos, lower(word) AS lemma FROM {senses} UNION ALL
 SELECT CASE WHEN part_of_speech = 'noun' THEN 'noun' ELSE 'verb' END, lower(word) FROM {profiles})"""
SHARED["marked"] = "SELECT pos, lemma, lemma IN (SELECT lower(word) FROM {vocab}) AS present FROM {lemmas}"
_RATE = "count(*) AS lemmas, count(*) FILTER (present) AS present, count(*) FILTER (NOT present) AS missing, round(count(*) FILTER (present) / count(*), 9) AS rate"


def _vocab(spark, d):
    return table(spark, d, "vocab").select("word")


@query("f9_presence_by_pos", f"SELECT pos, {_RATE} FROM {{marked}} GROUP BY pos UNION ALL SELECT 'ALL', {_RATE} FROM (SELECT DISTINCT lemma, present FROM {{marked}})")
def f9(spark, d):
    return V.presence_by_pos(P.lemmas(spark, d), _vocab(spark, d)).withColumn("rate", F.round("rate", 9))


# The index here: the words, of all parts of speech, of synsets whose document is marked as good.
@query("f10_unlisted_words", "SELECT DISTINCT lower(word) AS word FROM {vocab} WHERE lower(word) NOT IN (SELECT lower(word) FROM {senses} WHERE row_id // 4 IN (SELECT doc_id FROM {labels} WHERE quality = 1))")
def f10(spark, d):
    good = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("syn"))
    senses = table(spark, d, "senses").withColumn("syn", F.floor(F.col("row_id") / 4))
    return V.unlisted_words(senses.join(good, "syn", "left_semi").select(F.col("word").alias("lemma")), _vocab(spark, d))


@query("f11_presence_without_digits", f"SELECT pos, {_RATE} FROM {{marked}} WHERE NOT regexp_matches(lemma, '[0-9]') GROUP BY pos")
def f11(spark, d):
    return V.presence_without_digits(P.lemmas(spark, d), _vocab(spark, d)).withColumn("rate", F.round("rate", 9))


@query("f11_missing_samples", "SELECT pos, place, lemma FROM (SELECT pos, lemma, row_number() OVER (PARTITION BY pos ORDER BY lemma) AS place FROM {marked} WHERE NOT present AND NOT contains(lemma, ' ')) WHERE place <= 30")
def f11_samples(spark, d):
    return V.missing_samples(P.lemmas(spark, d), _vocab(spark, d))


@query("f12_derived_without_base", "SELECT derived, base FROM ({base})", {
    "base": "SELECT arg_min(v.base, r.o) AS base, f.derived FROM {forms} f JOIN {rules} r ON suffix(f.derived, r.suffix) AND length(f.derived) > r.strip + 2 "
            "JOIN {verbs} v ON v.base = concat(left(f.derived, length(f.derived) - r.strip), r.plus) "
            "WHERE NOT contains(f.derived, ' ') AND NOT contains(v.base, ' ') AND v.base NOT IN (SELECT derived FROM {forms}) GROUP BY f.derived",
    "forms": "SELECT DISTINCT concat(lower(word), 'ing') AS derived FROM {profiles}",
    "verbs": "SELECT DISTINCT lower(word) AS base FROM {profiles}",
    "rules": f"SELECT * FROM (VALUES {TQ._RULES}) r(o, suffix, strip, plus)"})
def f12(spark, d):
    words = table(spark, d, "profiles").select("word")
    verbs = words.select(F.lit("verb").alias("pos"), F.lower("word").alias("lemma"))
    return V.derived_without_base(verbs, words.select(F.concat(F.lower("word"), F.lit("ing")).alias("word")))


# Synsets of the audit: each domain of the profiles, whose words the vocabulary holds in part.
@query("f13_orphans", """SELECT m.pos, count(*) AS missing, count(c.lemma) AS covered, count(*) - count(c.lemma) AS orphaned, round(count(c.lemma) / count(*), 9) AS covered_share
 FROM (SELECT DISTINCT pos, lemma FROM {marked} WHERE NOT present AND NOT regexp_matches(lemma, '[0-9]')) m
 LEFT JOIN (SELECT DISTINCT w.pos, w.lemma FROM {mates} w JOIN (SELECT DISTINCT sense_key FROM {mates} WHERE lemma IN (SELECT lower(word) FROM {vocab})) a ON a.sense_key = w.sense_key) c
 ON c.pos = m.pos AND c.lemma = m.lemma GROUP BY m.pos""", {
    "mates": "SELECT CASE WHEN part_of_speech = 'noun' THEN 'noun' ELSE 'verb' END AS pos, concat(domain, '-', num % 97) AS sense_key, translate(lower(word), '0123456789', 'abcdefghij') AS lemma FROM {profiles}",
    "marked": "SELECT DISTINCT pos, lemma, lemma IN (SELECT lower(word) FROM {vocab}) AS present FROM {mates}"})
def f13(spark, d):
    rows = table(spark, d, "profiles").select(
        F.when(F.col("part_of_speech") == "noun", "noun").otherwise("verb").alias("pos"),
        F.concat(F.col("domain"), F.lit("-"), (F.col("num") % 97).cast("string")).alias("sense_key"),
        F.translate(F.lower("word"), "0123456789", "abcdefghij").alias("lemma"))
    out = V.orphans(rows.select("pos", "lemma").distinct(), rows, _vocab(spark, d))
    return out.withColumn("covered_share", F.round("covered_share", 9))


@query("f14_pos_skew", """SELECT round(n, 9) AS noun_rate, round(v, 9) AS verb_rate, CASE WHEN n - v > 0.1 THEN 'verbs underrepresented' ELSE 'no large skew' END AS verdict
 FROM (SELECT avg(CASE WHEN present THEN 1.0 ELSE 0.0 END) FILTER (pos = 'noun') AS n, avg(CASE WHEN present THEN 1.0 ELSE 0.0 END) FILTER (pos = 'verb') AS v FROM {marked})""")
def f14(spark, d):
    out = V.skew(P.lemmas(spark, d), _vocab(spark, d))
    return out.withColumn("noun_rate", F.round("noun_rate", 9)).withColumn("verb_rate", F.round("verb_rate", 9))


_NEAR = "l.user_id = s.user_id AND l.ts <= s.ts AND l.ts > s.ts - INTERVAL 5 MINUTE"


@query("f15_saves_after_lookup", f"SELECT s.id AS probe, count(l.id) AS lookups FROM {{saves}} s LEFT JOIN {{lookups}} l ON {_NEAR} GROUP BY s.id")
def f15(spark, d):
    return U.saves_after_lookup(table(spark, d, "saves"), table(spark, d, "lookups")).select("probe", "lookups")


@query("f15_joinable_pairs", f"SELECT (SELECT count(*) FROM {{lookups}}) AS lookups, (SELECT count(*) FROM {{saves}}) AS saves, count(*) AS pairs FROM {{saves}} s JOIN {{lookups}} l ON {_NEAR}")
def f15_total(spark, d):
    return U.joinable_pairs(table(spark, d, "saves"), table(spark, d, "lookups"))


@query("f16_games", "SELECT game, count(*) AS n FROM {game_rounds} GROUP BY game")
def f16(spark, d):
    return U.games_played(table(spark, d, "game_rounds"))


_IN = "lower(word) IN (SELECT lower(word) FROM {vocab})"


@query("f17_definition_yield", f"""SELECT count(*) AS total, count(*) FILTER (definition <> '') AS with_def, count(*) FILTER (definition <> '' AND {O.word_count('definition')} >= 3) AS def_3plus_words,
 count(*) FILTER (inside) AS in_vocab, count(*) FILTER ({TQ._USABLE} AND inside) AS usable FROM (SELECT word, definition, {_IN} AS inside FROM {{profiles}})""")
def f17(spark, d):
    return U.definition_yield(table(spark, d, "profiles"), _vocab(spark, d))


@query("f18_membership", "SELECT p.word, p.word IN (SELECT word FROM {vocab}) AS hit FROM {profiles} p")
def f18(spark, d):
    return U.membership(table(spark, d, "profiles").select("word"), _vocab(spark, d))


@query("f18_vocabulary_shape", """SELECT count(*) FILTER (contains(word, ' ')) AS multiword, count(*) FILTER (regexp_matches(word, '^[A-Z]')) AS capitalised,
 (SELECT count(*) FROM (SELECT lower(word) FROM {vocab} GROUP BY 1 HAVING count(*) > 1)) AS lower_collisions FROM {vocab}""")
def f18_shape(spark, d):
    return U.vocabulary_shape(_vocab(spark, d))


@query("f19_saved_words", "SELECT p.word, p.definition = '' AS definition_empty FROM {saves} s JOIN {profiles} p ON p.num = s.word_id")
def f19(spark, d):
    return U.saved_words(table(spark, d, "saves"), table(spark, d, "profiles").withColumn("id", F.col("num")))


# -- evaluation sets ------------------------------------------------------------------------

_TRIP = f"""SELECT {O.row_id('tripwire', 'n')} AS id, trim(definition) AS query, word AS target, token_count, zipf FROM (
 SELECT p.word, p.definition, row_number() OVER (ORDER BY p.word) AS n, {O.token_class('p.word')} AS token_count, z.zipf
 FROM (SELECT * FROM {{profiles}} WHERE {TQ._USABLE} AND {_IN}) p LEFT JOIN {{zipf}} z ON z.word = lower(p.word))"""
SHARED["tripwire"] = _TRIP
SHARED["authored"] = f"""SELECT {O.row_id('authored', 'n')} AS id, query, target, zipf, {O.token_class('target')} AS token_count,
 style, {O.overlap('query', 'target')} AS lexical_overlap, reachable, {O.split_csv('acceptable_csv')} AS acceptable FROM (SELECT *, row_number() OVER (ORDER BY qvec_id) AS n FROM {{eval_set}})"""


def tripwire(spark, d):
    return G.tripwire_rows(table(spark, d, "profiles"), _vocab(spark, d), table(spark, d, "zipf"))


def draft_table(spark, d):
    """The evaluation queries as a reviewed table: text cells, position in file order."""
    q = P.queries(spark, d)
    core = table(spark, d, "eval_core").select(F.col("id").alias("qid"), "qvec_id", "acceptable_csv")
    return q.drop("acceptable", "zipf").join(core, "qid").select(
        F.col("qvec_id").alias("position"), "target", "query", "sense_hint", F.lit("").alias("zipf"), "style", "lexical_overlap",
        F.when(F.col("reachable"), "TRUE").otherwise("FALSE").alias("reachable"), F.col("acceptable_csv").alias("acceptable"))


def authored(spark, d):
    return G.authored_rows(draft_table(spark, d), table(spark, d, "zipf"))


@query("g1_tripwire", "SELECT id, md5(query) AS query, target, token_count, zipf, 'paraphrase' AS leakage FROM {tripwire}")
def g1(spark, d):
    return tripwire(spark, d).select("id", F.md5("query").alias("query"), "target", "token_count", "zipf", "leakage")


@query("g2_authored", "SELECT id, query, target, zipf, token_count, style, lexical_overlap, reachable, array_to_string(acceptable, '|') AS acceptable FROM {authored}")
def g2(spark, d):
    return authored(spark, d).select("id", "query", "target", "zipf", "token_count", "style", "lexical_overlap", "reachable",
                                     F.array_join("acceptable", "|").alias("acceptable"))


@query("g3_assembled", "SELECT id, target, 'authored' AS source FROM {authored} UNION ALL SELECT id, target, 'gloss_tripwire' FROM {tripwire}")
def g3(spark, d):
    return G.assemble(authored(spark, d), tripwire(spark, d)).select("id", "target", "source")


@query("g4_slice_summary", """SELECT 'authored' AS source, count(*) AS rows, count(*) FILTER (reachable) AS reachable, count(*) FILTER (len(acceptable) > 0) AS with_acceptable FROM {authored}
 UNION ALL SELECT 'gloss_tripwire', count(*), count(*), 0 FROM {tripwire}""")
def g4(spark, d):
    return G.slice_summary(G.assemble(authored(spark, d), tripwire(spark, d)))


SHARED["draft"] = "SELECT qvec_id AS position, CASE WHEN qvec_id % 11 = 0 THEN word ELSE target END AS target, CASE WHEN qvec_id % 13 = 0 THEN sense_hint ELSE query END AS query, sense_hint AS hint, style, NOT reachable AS expect_unreachable FROM (SELECT e.*, n.word FROM {eval_core} e JOIN {vocab} n ON n.id = e.qvec_id % 10)"


def draft(spark, d):
    """A draft with mistakes: repeated targets, short queries, hints of two words."""
    e = table(spark, d, "eval_core")
    n = table(spark, d, "vocab").select(F.col("id").alias("_i"), "word")
    rows = e.join(n, F.col("_i") == F.col("qvec_id") % 10)
    return rows.select(
        F.col("qvec_id").alias("position"), F.when(F.col("qvec_id") % 11 == 0, F.col("word")).otherwise(F.col("target")).alias("target"),
        F.when(F.col("qvec_id") % 13 == 0, F.col("sense_hint")).otherwise(F.col("query")).alias("query"), F.col("sense_hint").alias("hint"), "style",
        (~F.col("reachable")).alias("expect_unreachable"))


@query("g5_violations", f"""SELECT position, target, reason FROM (SELECT position, target, unnest([
 CASE WHEN row_number() OVER (PARTITION BY lower(target) ORDER BY position) > 1 THEN 'duplicate target' END,
 CASE WHEN {O.word_count('query')} < 3 THEN concat('query is only ', {O.word_count('query')}, ' words') END,
 CASE WHEN contains({O.padded('query')}, {O.padded('target')}) THEN 'query contains the target' END,
 CASE WHEN {O.word_count('hint')} > 1 THEN concat('sense hint is ', {O.word_count('hint')}, ' words, max 1') END]) AS reason FROM {{draft}}) WHERE reason IS NOT NULL""")
def g5(spark, d):
    return G.violations(draft(spark, d))


SHARED["annotated"] = f"""SELECT d.*, z.zipf, {O.band('z.zipf')} AS band, {O.token_class('d.target')} AS tokens, lower(d.target) IN (SELECT lower(word) FROM {{vocab}}) AS reachable,
 {O.overlap('d.query', 'd.target')} AS overlap FROM {{draft}} d LEFT JOIN {{zipf}} z ON z.word = lower(d.target)"""


def annotated(spark, d):
    return G.annotate(draft(spark, d), table(spark, d, "zipf"), _vocab(spark, d))


@query("g6_annotated", "SELECT position, target, zipf, band, tokens, reachable, overlap FROM {annotated}")
def g6(spark, d):
    return annotated(spark, d).select("position", "target", "zipf", "band", "tokens", "reachable", "overlap")


@query("g7_draft_order", """SELECT position, row_number() OVER (ORDER BY reachable DESC, CASE band WHEN 'very_common' THEN 0 WHEN 'common' THEN 1 WHEN 'mid' THEN 2 WHEN 'uncommon' THEN 3 ELSE 4 END, style, target, position) - 1 AS place FROM {annotated}""")
def g7(spark, d):
    from lexspan.functions.bands import band_rank
    from lexspan.operators.scale import number_by_order

    keyed = annotated(spark, d).select("position", (~F.col("reachable")).alias("a"), band_rank(F.col("band")).alias("b"), "style", "target")
    return number_by_order(keyed, ["a", "b", "style", "target", "position"], "place").select("position", "place")


@query("g8_surprises", "SELECT target, CASE WHEN reachable THEN 'present' ELSE 'missing' END AS surprise FROM {annotated} WHERE reachable = expect_unreachable")
def g8(spark, d):
    return G.surprises(annotated(spark, d))


@query("g8_tallies", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM {{annotated}} WHERE reachable GROUP BY {c}" for c in ("band", "style", "tokens"))
       + " UNION ALL SELECT 'overlap', overlap, count(*) FROM {annotated} GROUP BY overlap")
def g8_tallies(spark, d):
    return G.tallies(annotated(spark, d))


@query("g8_query_lengths", f"SELECT min(w) AS shortest, max(w) AS longest, list_sort(list(w))[count(*) // 2 + 1] AS p50 FROM (SELECT {O.word_count('query')} AS w FROM {{annotated}} WHERE reachable)")
def g8_lengths(spark, d):
    return G.query_lengths(annotated(spark, d))


@query("g9_stratified_targets", f"""SELECT band, tokens, place, word, pool FROM (SELECT *, row_number() OVER (PARTITION BY band, tokens ORDER BY md5(concat('{G.SAMPLE_SEED}', word)), word) AS place,
 count(*) OVER (PARTITION BY band, tokens) AS pool FROM (SELECT v.word, {O.band('z.zipf')} AS band, CASE WHEN regexp_matches(v.word, '[ _]') THEN 'multi' ELSE 'single' END AS tokens
 FROM {{vocab}} v LEFT JOIN {{zipf}} z ON z.word = v.word WHERE regexp_matches(v.word, '^[a-z]') AND lower(v.word) NOT IN (SELECT lower(word) FROM {{profiles}} WHERE definition <> ''))) WHERE place <= 20""")
def g9(spark, d):
    rows = G.stratified_targets(_vocab(spark, d), table(spark, d, "profiles"), table(spark, d, "zipf"), 20)
    return rows.select("band", "tokens", "place", "word", "pool")


SHARED["worklist"] = """SELECT m.word AS target, m.sense_key, s.n - 1 AS mates FROM (SELECT DISTINCT sense_key, word FROM {gloss_rows}) m
 JOIN (SELECT sense_key, count(DISTINCT word) AS n FROM {gloss_rows} GROUP BY sense_key HAVING count(DISTINCT word) > 1) s ON s.sense_key = m.sense_key
 WHERE m.word IN (SELECT word FROM {targets} WHERE word IS NOT NULL)"""


@query("g10_worklist", "SELECT target, sense_key, mates, CASE split_part(sense_key, ':', 1) WHEN 'noun' THEN 'n.' WHEN 'verb' THEN 'v.' WHEN 'adj' THEN 'adj.' ELSE 'adv.' END AS pos FROM {worklist}")
def g10(spark, d):
    return A.worklist_entries(pool_glosses(spark, d), target_words(spark, d))


@query("g10_worklist_members", "SELECT DISTINCT sense_key, word FROM {gloss_rows} WHERE sense_key IN (SELECT sense_key FROM {worklist})")
def g10_members(spark, d):
    glosses = pool_glosses(spark, d)
    return A.worklist_members(glosses, A.worklist_entries(glosses, target_words(spark, d)))


SHARED["mates"] = "SELECT w.target, w.sense_key, g.word FROM {worklist} w JOIN (SELECT DISTINCT sense_key, word FROM {gloss_rows}) g ON g.sense_key = w.sense_key AND g.word <> w.target"
SHARED["case_groups"] = """SELECT target, sense_key, lower(word) AS base, count(*) AS variants, coalesce(max(CASE WHEN word = lower(word) THEN word END), min(word)) AS kept,
 length(lower(word)) <= 3 AND bool_and(regexp_matches(word, '[A-Z]')) AS symbol, lower(word) = lower(target) AS own FROM {mates} GROUP BY target, sense_key, lower(word)"""


@query("g11_review", """SELECT target, sense_key, sum(variants) AS before, count(*) FILTER (NOT own AND NOT symbol) AS after,
 coalesce(sum(variants) FILTER (own), 0) AS target_case_variants, coalesce(sum(variants - 1) FILTER (NOT own AND NOT symbol), 0) AS case_duplicates,
 count(*) FILTER (NOT own AND symbol) AS symbol_forms FROM {case_groups} GROUP BY target, sense_key""")
def g11(spark, d):
    return A.review_entries(pool_glosses(spark, d), target_words(spark, d))


@query("g11_candidates", """SELECT DISTINCT sense_key, kept AS candidate FROM (SELECT sense_key, lower(word) AS base, coalesce(max(CASE WHEN word = lower(word) THEN word END), min(word)) AS kept,
 length(lower(word)) <= 3 AND bool_and(regexp_matches(word, '[A-Z]')) AS symbol FROM (SELECT DISTINCT sense_key, word FROM {gloss_rows} WHERE sense_key IN (SELECT sense_key FROM {worklist})) GROUP BY sense_key, lower(word)) WHERE NOT symbol""")
def g11_candidates(spark, d):
    return A.review_candidates(pool_glosses(spark, d), target_words(spark, d))


SHARED["synset_groups"] = """SELECT sense_key, lower(word) AS base, coalesce(max(CASE WHEN word = lower(word) THEN word END), min(word)) AS kept,
 length(lower(word)) <= 3 AND bool_and(regexp_matches(word, '[A-Z]')) AS symbol FROM {listed} GROUP BY sense_key, lower(word)"""
SHARED["listed"] = "SELECT DISTINCT sense_key, word FROM {gloss_rows} WHERE sense_key IN (SELECT sense_key FROM {worklist})"


@query("g11_removals", """SELECT m.sense_key, m.word, g.kept, CASE WHEN g.symbol THEN 'symbol form' ELSE 'case duplicate' END AS rule
 FROM {listed} m JOIN {synset_groups} g ON g.sense_key = m.sense_key AND g.base = lower(m.word) WHERE g.symbol OR m.word <> g.kept""")
def g11_removals(spark, d):
    return A.review_removals(pool_glosses(spark, d), target_words(spark, d))


@query("g11_target_variants", "SELECT target, sense_key, word FROM {mates} WHERE lower(word) = lower(target)")
def g11_target_variants(spark, d):
    return A.target_variants(pool_glosses(spark, d), target_words(spark, d))


_ONE_TARGET = "lemb"


@query("g10_mates_of_target", f"SELECT target, sense_key, word AS mate FROM {{mates}} WHERE target = '{_ONE_TARGET}'")
def g10_mates(spark, d):
    return A.mates_of(pool_glosses(spark, d), target_words(spark, d), _ONE_TARGET)


@query("g11_candidates_of_target", f"""SELECT w.target, w.sense_key, g.kept AS candidate FROM {{worklist}} w JOIN {{synset_groups}} g ON g.sense_key = w.sense_key
 WHERE w.target = '{_ONE_TARGET}' AND NOT g.symbol AND lower(g.kept) <> lower(w.target)""")
def g11_candidates_of(spark, d):
    return A.candidates_of(pool_glosses(spark, d), target_words(spark, d), _ONE_TARGET)


# Proposals: every gloss mate, offered to the draft of its target, in the order of its rows.
SHARED["proposals"] = "SELECT v.word AS target, s.row_id AS position, s.word AS candidate FROM {senses} s JOIN {vocab} v ON v.id = (s.row_id // 4) % (SELECT count(*) FROM {embeddings}) WHERE s.member_pos > 0"


def proposals(spark, d):
    rows = table(spark, d, "senses").filter("member_pos > 0")
    vocab = table(spark, d, "vocab").select(F.col("id").alias("_i"), F.col("word").alias("target"))
    syn = table(spark, d, "synsets").select(F.concat_ws(":", "pos", "off").alias("sense_key"), "vid")
    joined = rows.select("sense_key", F.col("row_id").alias("position"), F.col("word").alias("candidate")).join(syn, "sense_key")
    return joined.join(vocab, F.col("vid") == F.col("_i")).select("target", "position", "candidate")


@query("g12_merged", f"""SELECT e.id, e.target, CASE WHEN len(list_filter(p.cands, lambda c: NOT list_contains(e.low, lower(c)))) > 0
 THEN array_to_string(list_concat(e.old, list_filter(p.cands, lambda c: NOT list_contains(e.low, lower(c)))), ', ') ELSE e.acceptable_csv END AS acceptable,
 coalesce(len(list_filter(p.cands, lambda c: NOT list_contains(e.low, lower(c)))), 0) AS added, CASE WHEN p.target IS NULL THEN 0 ELSE len(e.old) END AS kept
 FROM (SELECT id, target, acceptable_csv, {O.split_csv('acceptable_csv')} AS old, list_transform({O.split_csv('acceptable_csv')}, lambda a: lower(a)) AS low FROM {{eval_core}}) e
 LEFT JOIN (SELECT target, list(candidate ORDER BY position) AS cands FROM (SELECT target, arg_min(candidate, position) AS candidate, min(position) AS position FROM {{proposals}} GROUP BY target, lower(candidate)) GROUP BY target) p ON p.target = e.target""")
def g12(spark, d):
    rows = table(spark, d, "eval_core").select("id", "target", F.col("acceptable_csv").alias("acceptable"))
    return A.merge_accepted(rows, proposals(spark, d), "id")


@query("g12_entries", f"""SELECT e.id, CAST(0 AS INT) AS part, CAST(u.i - 1 AS BIGINT) AS place, e.old[u.i] AS entry
 FROM (SELECT id, {O.split_csv('acceptable_csv')} AS old FROM {{eval_core}}) e, LATERAL (SELECT unnest(range(1, len(e.old) + 1)) AS i) u
 UNION ALL SELECT e.id, 1, p.position, p.candidate FROM (SELECT id, target, list_transform({O.split_csv('acceptable_csv')}, lambda a: lower(a)) AS low FROM {{eval_core}}) e
 JOIN (SELECT target, arg_min(candidate, position) AS candidate, CAST(min(position) AS BIGINT) AS position FROM {{proposals}} GROUP BY target, lower(candidate)) p ON p.target = e.target
 WHERE NOT list_contains(e.low, lower(p.candidate))""")
def g12_entries(spark, d):
    rows = table(spark, d, "eval_core").select("id", "target", F.col("acceptable_csv").alias("acceptable"))
    return A.merge_entries(rows, proposals(spark, d), "id")


@query("g12_unmatched", "SELECT DISTINCT target FROM {proposals} WHERE target NOT IN (SELECT target FROM {eval_core})")
def g12_unmatched(spark, d):
    return A.unmatched_targets(table(spark, d, "eval_core"), proposals(spark, d))


@query("h27_band_distribution", f"""SELECT {O.band('zipf')} AS band, count(*) AS n, round(count(*) / (SELECT count(*) FROM {{vocab}} WHERE regexp_matches(word, '^[a-z]')), 9) AS share
 FROM ({TQ._LEMMA_ZIPF}) WHERE regexp_matches(word, '^[a-z]') GROUP BY 1""")
def h27(spark, d):
    words = table(spark, d, "vocab").select("word").filter(F.col("word").rlike("^[a-z]"))
    return Z.band_distribution(Z.lemma_zipf(words, table(spark, d, "zipf"))).withColumn("share", F.round("share", 9))


@query("h28_zipf_override", "SELECT e.id, coalesce(z.zipf * 2, e.zipf) AS zipf FROM {eval_set} e LEFT JOIN (SELECT word, zipf FROM {zipf} WHERE zipf > 4) z ON z.word = lower(e.target)")
def h28(spark, d):
    new = table(spark, d, "zipf").filter("zipf > 4").select("word", (F.col("zipf") * 2).alias("zipf"))
    return Z.override_zipf(table(spark, d, "eval_set").select("id", "target", "zipf"), new).select("id", "zipf")
