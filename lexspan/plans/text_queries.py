"""Registered queries: string functions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lexspan.functions import bands as B, text as X
from lexspan.operators import coverage as V, frequency as Z
from lexspan.plans import frames as P, oracle_parts as O
from lexspan.plans.fixtures import table
from lexspan.plans.registry import query


def _docs(spark, d):
    return table(spark, d, "documents")


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


@query("e1_content_tokens", f"SELECT doc_id, len({O.content('text')}) AS n, md5(array_to_string({O.content('text')}, ' ')) AS tokens FROM {{documents}}")
def e1(spark, d):
    tokens = X.content_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(tokens).alias("n"), F.md5(_joined(tokens)).alias("tokens"))


@query("e2_echoes", f"SELECT doc_id, item_id, {O.echo('item_text', 'text')} AS echoes FROM {{doc_items}}")
def e2(spark, d):
    return table(spark, d, "doc_items").select("doc_id", "item_id", X.echoes(F.col("item_text"), F.col("text")).alias("echoes"))


@query("e4_normalise", f"SELECT doc_id, md5({O.padded('text')}) AS phrase FROM {{documents}}")
def e4(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.padded_phrase(F.col("text"))).alias("phrase"))


@query("e5_contains_phrase", f"SELECT id, contains({O.padded('query')}, {O.padded('target')}) AS given FROM {{eval_set}}")
def e5(spark, d):
    return table(spark, d, "eval_set").select("id", X.contains_phrase(F.col("query"), F.col("target")).alias("given"))


@query("e6_overlap", f"SELECT id, {O.overlap('query', 'target')} AS overlap FROM {{eval_set}}")
def e6(spark, d):
    return table(spark, d, "eval_set").select("id", X.lexical_overlap(F.col("query"), F.col("target")).alias("overlap"))


@query("e7_word_count", f"SELECT doc_id, {O.word_count('text')} AS n, {O.length_bucket('text')} AS bucket FROM {{documents}}")
def e7(spark, d):
    return _docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("n"), X.length_bucket(F.col("text")).alias("bucket"))


@query("e8_token_class", f"SELECT id, {O.token_class('word')} AS tokens FROM {{vocab}}")
def e8(spark, d):
    return table(spark, d, "vocab").select("id", X.token_class(F.col("word")).alias("tokens"))


@query("e9_bands", f"SELECT v.id, {O.band('z.zipf')} AS band, {O.band_label('z.zipf')} AS label FROM {{vocab}} v LEFT JOIN {{zipf}} z ON z.word = lower(v.word)")
def e9(spark, d):
    z = table(spark, d, "zipf")
    rows = table(spark, d, "vocab").join(z.withColumnRenamed("word", "_w"), F.lower("word") == F.col("_w"), "left")
    return rows.select("id", B.band(F.col("zipf")).alias("band"), B.band_label(F.col("zipf")).alias("label"))


@query("e10_zipf", "SELECT word, max(round(log10(n / t.total * 1e9), 9)) AS zipf FROM {freq} CROSS JOIN (SELECT CAST(sum(n) AS DOUBLE) AS total FROM {freq}) t GROUP BY word")
def e10(spark, d):
    return Z.zipf_table(table(spark, d, "freq")).select("word", F.round("zipf", 9).alias("zipf"))


_LEMMA_ZIPF = """SELECT word, CASE WHEN count(zipf) = count(*) THEN min(zipf) END AS zipf FROM (
 SELECT v.word, z.zipf FROM (SELECT word, unnest(list_filter(string_split_regex(lower(word), '[ _-]+'), lambda t: t <> '')) AS token FROM {vocab}) v
 LEFT JOIN {zipf} z ON z.word = v.token) GROUP BY word"""


@query("e11_lemma_zipf", _LEMMA_ZIPF)
def e11(spark, d):
    return Z.lemma_zipf(table(spark, d, "vocab"), table(spark, d, "zipf"))


@query("e12_norm", f"SELECT doc_id, md5({O.norm('text')}) AS text FROM {{documents}}")
def e12(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.norm(F.col("text"))).alias("text"))


_CATS = """regexp_matches(word, '[ _]') AS multiword, regexp_matches(word, '^[A-Z]') AS capitalised, regexp_matches(word, '[0-9]') AS digit,
 regexp_matches(word, '-') AS hyphen, contains(word, '''') AS apostrophe, regexp_matches(word, '[^A-Za-z0-9 _''-]') AS other_punct,
 count(*) OVER (PARTITION BY lower(word)) > 1 AS case_collision, regexp_matches(word, '^[a-z]+$') AS clean_single"""


@query("e13_categories", f"SELECT id, {_CATS} FROM {{vocab}}")
def e13(spark, d):
    from lexspan.operators.vocab_audit import with_collision

    cats = X.categories(F.col("word"), F.col("collides"))
    return with_collision(table(spark, d, "vocab")).select("id", *[c.alias(n) for n, c in cats.items()])


@query("e14_junk", f"SELECT id, word, {O.junk('word')} AS junk FROM {{vocab}}")
def e14(spark, d):
    return table(spark, d, "vocab").select("id", "word", X.junk(F.col("word")).alias("junk"))


@query("e15_split_csv", f"SELECT id, len({O.split_csv('acceptable_csv')}) AS n, array_to_string({O.split_csv('acceptable_csv')}, '|') AS parts FROM {{eval_set}}")
def e15(spark, d):
    parts = X.split_csv(F.col("acceptable_csv"))
    return table(spark, d, "eval_set").select("id", F.size(parts).alias("n"), F.array_join(parts, "|").alias("parts"))


_FLAG = "CASE doc_id % 5 WHEN 0 THEN 'FALSE' WHEN 1 THEN ' no ' WHEN 2 THEN '0' WHEN 3 THEN source END"


@query("e16_reachable_flag", f"SELECT doc_id, NOT regexp_matches(trim(coalesce({_FLAG}, '')), '(?i)^(false|0|no)$') AS reachable FROM {{documents}}")
def e16(spark, d):
    return _docs(spark, d).select("doc_id", X.reachable_flag(F.expr(_FLAG)).alias("reachable"))


_USABLE = (f"definition <> '' AND {O.word_count('definition')} >= 3 AND NOT regexp_matches(definition, concat('(?i)\\b', regexp_escape(word), '\\b'))")


@query("e17_usable_definition", f"SELECT id, {_USABLE} AS usable FROM {{profiles}}")
def e17(spark, d):
    return table(spark, d, "profiles").select("id", X.usable_definition(F.col("word"), F.col("definition")).alias("usable"))


def _derived_words(spark, d):
    """Words with derivational endings, made from vocabulary words, and the verbs they come from."""
    words = table(spark, d, "vocab").select("id", F.lower("word").alias("w"))
    ends = F.array(F.lit("er"), F.lit("ing"), F.lit("tion"), F.lit("ment"), F.lit("al"))
    forms = words.select(F.concat("w", F.element_at(ends, (F.col("id") % 5 + 1).cast("int"))).alias("word"))
    verbs = words.select(F.lit("verb").alias("pos"), F.concat("w", F.when(F.col("id") % 5 == 2, F.lit("te")).otherwise("")).alias("lemma"))
    return forms, verbs


_RULES = ", ".join(f"({i}, '{a}', {n}, '{b}')" for i, (a, n, b) in enumerate(X.DERIVATIONS))


@query("e18_derived_base", """
SELECT derived, arg_min(base, o) AS base FROM (
 SELECT f.derived, v.base, r.o FROM {forms} f
 JOIN {rules} r ON suffix(f.derived, r.suffix) AND length(f.derived) > r.strip + 2
 JOIN {verbs} v ON v.base = concat(left(f.derived, length(f.derived) - r.strip), r.plus)
 WHERE NOT contains(f.derived, ' ') AND NOT contains(v.base, ' ') AND v.base NOT IN (SELECT derived FROM {forms})) GROUP BY derived""", {
    "forms": "SELECT DISTINCT concat(lower(word), ['er', 'ing', 'tion', 'ment', 'al'][id % 5 + 1]) AS derived FROM {vocab}",
    "verbs": "SELECT DISTINCT concat(lower(word), CASE WHEN id % 5 = 2 THEN 'te' ELSE '' END) AS base FROM {vocab}",
    "rules": f"SELECT * FROM (VALUES {_RULES}) r(o, suffix, strip, plus)"})
def e18(spark, d):
    forms, verbs = _derived_words(spark, d)
    return V.derived_without_base(verbs, forms)


@query("e19_canonical_case", """SELECT sense_key, lower(word) AS base, coalesce(max(CASE WHEN word = lower(word) THEN word END), min(word)) AS kept,
 count(*) AS variants, length(lower(word)) <= 3 AND bool_and(regexp_matches(word, '[A-Z]')) AS symbol
 FROM (SELECT DISTINCT pos AS sense_key, word FROM {senses}) GROUP BY sense_key, lower(word)""")
def e19(spark, d):
    from lexspan.operators.acceptable import case_groups

    return case_groups(table(spark, d, "senses").select(F.col("pos").alias("sense_key"), "word").distinct())


@query("e20_url_component", """SELECT doc_id, md5(replace(replace(replace(replace(replace(url_encode(text), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')) AS url FROM {documents}""")
def e20(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.url_component(F.col("text"))).alias("url"))


@query("e21_hash_order", "SELECT id, word, row_number() OVER (ORDER BY md5(word), word) - 1 AS row FROM {vocab}")
def e21(spark, d):
    from lexspan.operators.scale import number_by_hash

    return number_by_hash(table(spark, d, "vocab").select("id", "word"), F.md5("word"), ["word"])


@query("e22_slug", f"SELECT id, {O.norm('word')} AS slug FROM {{vocab}}")
def e22(spark, d):
    return table(spark, d, "vocab").select("id", X.slug(F.col("word")).alias("slug"))


@query("e23_pos", "SELECT row_id, split_part(sense_key, ':', 1) AS pos, CASE pos WHEN 'noun' THEN 'n.' WHEN 'verb' THEN 'v.' WHEN 'adj' THEN 'adj.' ELSE 'adv.' END AS name FROM {senses}")
def e23(spark, d):
    return table(spark, d, "senses").select("row_id", X.pos_of_key(F.col("sense_key")).alias("pos"), X.pos_name(F.col("sense_key")).alias("name"))


@query("e24_row_ids", "SELECT word, concat('authored-', CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END) AS id FROM (SELECT word, row_number() OVER (ORDER BY word) AS n FROM {vocab})")
def e24(spark, d):
    from lexspan.operators.scale import number_by_order

    rows = number_by_order(table(spark, d, "vocab").select("word"), ["word"], "n")
    return rows.select("word", X.row_id("authored", F.col("n") + 1).alias("id"))
