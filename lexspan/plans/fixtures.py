"""Inputs derived from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SQL: dict[str, str] = {}

_LETTERS = "translate(CAST(vec_id AS STRING), '0123456789', 'abcdefghij')"

# Words of every shape the audits look for; the last digit picks the shape.
SQL["vocab"] = f"""
SELECT vec_id AS id, label, embedding,
       CASE vec_id % 10
            WHEN 3 THEN concat('Lem', translate(CAST(vec_id - 1 AS STRING), '0123456789', 'abcdefghij'))
            WHEN 4 THEN concat('Nom', {_LETTERS})
            WHEN 5 THEN concat('lem', CAST(vec_id AS STRING))
            WHEN 6 THEN concat('lem-', {_LETTERS})
            WHEN 7 THEN concat('lem.', {_LETTERS})
            WHEN 8 THEN concat('black lem', {_LETTERS})
            ELSE concat('lem', {_LETTERS}) END AS word
FROM {{embeddings}}
"""

# One synset per document: up to three words, one gloss, one vector. Documents that map to
# the same vector make ties between different synsets.
SQL["synsets"] = """
SELECT d.doc_id AS syn, d.text AS gloss,
       CASE d.lang WHEN 'en' THEN 'noun' WHEN 'fr' THEN 'verb' WHEN 'de' THEN 'adj' ELSE 'adv' END AS pos,
       lpad(CAST(d.doc_id AS STRING), 8, '0') AS off,
       CASE WHEN d.n_chars % 2 = 0 THEN concat('found in ', d.source) END AS ex1,
       CASE WHEN d.n_chars % 6 = 0 THEN concat('written in ', d.lang) END AS ex2,
       d.doc_id % 3 + 1 AS members,
       d.doc_id % (SELECT count(*) FROM {embeddings}) AS vid,
       (SELECT count(*) FROM {embeddings}) AS nv
FROM {documents} d
"""

SQL["senses"] = """
SELECT v.word AS word, v.id AS id, concat(s.pos, ':', s.off) AS sense_key, s.pos AS pos,
       m.p AS member_pos, s.gloss AS gloss, s.ex1 AS ex1, s.ex2 AS ex2, e.embedding AS embedding,
       s.syn * 4 + m.p AS row_id
FROM {synsets} s
JOIN (SELECT CAST(0 AS BIGINT) AS p UNION ALL SELECT 1 UNION ALL SELECT 2) m ON m.p < s.members
JOIN {vocab} v ON v.id = (s.vid + m.p * 37) % s.nv
JOIN {embeddings} e ON e.vec_id = s.vid
"""

SQL["freq"] = """
SELECT split_part(lower(v.word), ' ', -1) AS word,
       CAST(sum(CAST(l.l_quantity AS BIGINT) * CASE v.id % 7 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 100
            WHEN 3 THEN 1000 WHEN 4 THEN 10000 WHEN 5 THEN 100000 ELSE 1000000 END) AS BIGINT) AS n
FROM (SELECT l_quantity, l_partkey % (SELECT count(*) FROM {embeddings}) AS vid FROM {lineitem}) l
JOIN {vocab} v ON v.id = l.vid
GROUP BY split_part(lower(v.word), ' ', -1)
UNION ALL
SELECT split_part(p_name, ' ', 1) AS word, count(*) * 5000 AS n FROM {part} GROUP BY split_part(p_name, ' ', 1)
"""

SQL["zipf"] = """
SELECT word, round(log10(n / (SELECT CAST(sum(n) AS DOUBLE) FROM {freq}) * 1e9), 3) AS zipf
FROM {freq}
"""

# One query per vocabulary word. Targets: the word itself, its neighbour, or an absent word.
SQL["eval_core"] = """
SELECT concat(CASE WHEN v.id % 40 = 0 THEN 'tripwire-' ELSE 'authored-' END, lpad(CAST(v.id AS STRING), 6, '0')) AS id,
       CASE WHEN v.id % 40 = 0 THEN 'gloss_tripwire' ELSE 'authored' END AS source,
       concat('a kind of ', n.word, ' ', b.text) AS query,
       CASE WHEN v.id % 7 = 0 THEN concat('absent', CAST(v.id AS STRING))
            WHEN v.id % 3 = 0 THEN n.word ELSE v.word END AS target,
       v.id % 7 <> 0 AS reachable,
       CASE WHEN v.id % 6 = 0 THEN concat(' ', v.word, ',,', n.word) ELSE '' END AS acceptable_csv,
       CASE v.id % 4 WHEN 0 THEN 'abstract' WHEN 1 THEN 'concrete' WHEN 2 THEN 'functional' ELSE 'narrative' END AS style,
       CASE v.id % 5 WHEN 0 THEN 'animal' WHEN 1 THEN 'two words' ELSE 'tool' END AS sense_hint,
       v.id AS qvec_id, v.embedding AS qvec
FROM (SELECT w.id, w.word, w.embedding, (w.id + 1) % (SELECT count(*) FROM {embeddings}) AS nid,
             w.id % (SELECT count(*) FROM {benchmark}) AS bid FROM {vocab} w) v
JOIN {vocab} n ON n.id = v.nid
JOIN {benchmark} b ON b.item_id = v.bid
"""

SQL["eval_set"] = """
SELECT c.*, z.zipf FROM {eval_core} c LEFT JOIN {zipf} z ON z.word = lower(c.target)
"""

# Each document next to one benchmark text.
SQL["doc_items"] = """
SELECT d.doc_id, d.text, b.item_id, b.text AS item_text
FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM {benchmark}) AS bid FROM {documents}) d
JOIN {benchmark} b ON b.item_id = d.bid
"""

# Word profiles: one per document; the words past the vocabulary are not indexed.
SQL["profiles"] = """
SELECT concat('p', CAST(d.doc_id AS STRING)) AS id, coalesce(v.word, concat('term', CAST(d.doc_id AS STRING))) AS word,
       CASE d.lang WHEN 'en' THEN 'noun' ELSE '' END AS part_of_speech, d.source AS domain,
       CASE WHEN l.quality = 1 AND d.doc_id % 4 = 1 THEN concat(d.text, ' ', coalesce(v.word, ''))
            WHEN l.quality = 1 THEN d.text WHEN l.quality = 0 THEN 'too short' ELSE '' END AS definition,
       d.doc_id AS num
FROM {documents} d
LEFT JOIN {vocab} v ON v.id = d.doc_id
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

SQL["lookups"] = "SELECT event_id AS id, user_id, ts FROM {events} WHERE event_type = 'click'"

SQL["saves"] = """
SELECT event_id AS id, user_id, (event_id * 7919 + user_id) % (SELECT count(*) FROM {documents}) AS word_id,
       CASE WHEN event_type = 'view' THEN 'save' ELSE 'unsave' END AS action, ts
FROM {events} WHERE event_type IN ('view', 'error')
"""

SQL["shares"] = "SELECT event_id AS id, user_id, ts FROM {events} WHERE event_type = 'signup'"

SQL["game_rounds"] = """
SELECT event_id AS id, user_id,
       CASE event_id % 5 WHEN 0 THEN 'word-roulette' WHEN 1 THEN 'definition-bluff' WHEN 2 THEN 'lexical-slots'
                         WHEN 3 THEN 'higher-lower' ELSE 'speed-round' END AS game,
       CAST(5 + event_id % 520 AS INT) AS bet,
       CAST(CASE WHEN event_id % 3 = 0 THEN 2 * (5 + event_id % 520) ELSE 0 END AS INT) AS win_amount, ts
FROM {events} WHERE event_type = 'purchase'
"""

# Awards as callers send them: amounts as text, some of them no valid amount.
SQL["awards"] = """
SELECT event_id AS id, user_id, ts,
       CASE event_id % 6 WHEN 0 THEN CAST(event_id % 50 AS STRING) WHEN 1 THEN '-5' WHEN 2 THEN event_type WHEN 3 THEN '2.5'
                         WHEN 4 THEN 'NaN' ELSE '7' END AS amount
FROM {events}
"""

# One logged run per source of the documents, its configuration from what the source holds.
SQL["run_log"] = """
SELECT source AS tag, CASE WHEN max(doc_id) % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('hash', CAST(min(n_chars) % 3 AS STRING)) END AS set_sha256,
       concat('set', CAST(count(*) % 2 AS STRING)) AS set_name, concat(CASE WHEN min(doc_id) % 2 = 0 THEN 'file:' ELSE '' END, min(lang), '_cell') AS index_name,
       min(doc_id) % 3 = 0 AS exact, CASE max(doc_id) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'sampled' END AS pool_scale,
       CASE WHEN count(*) % 3 = 0 THEN 'gloss_synset' ELSE 'lemma' END AS cell_variant, CASE WHEN min(n_chars) % 2 = 0 THEN 'wordnet' END AS expansion_order,
       concat(max(lang), ' (served)') AS model, concat('2024-01-', lpad(CAST(1 + max(n_chars) % 28 AS STRING), 2, '0')) AS ran_at,
       CASE WHEN min(n_chars) % 5 > 0 THEN concat('n', CAST(min(n_chars) % 2 AS STRING)) END AS preregistered,
       CASE WHEN max(doc_id) % 2 = 0 THEN 'note' END AS note, max(n_chars) % 2 = 0 AS filter_junk, 5 + count(*) % 10 AS probes
FROM {documents} GROUP BY source
"""

# Lookup requests: signed-in users by id, guests by the forwarded addresses they came through.
SQL["requests"] = """
SELECT event_id AS id, ts,
       CASE WHEN event_type = 'click' THEN CAST(user_id AS STRING) END AS user_id,
       CASE WHEN event_type = 'view' THEN concat(' 10.0.0.', CAST(user_id % 20 AS STRING), ' , 10.1.1.1') END AS forwarded
FROM {events}
"""


def _deps(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", SQL[name])


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table or a derived input as a DataFrame.

    Plans are kept by application: reading a schema costs a job, and many queries start
    from the same inputs. No rows are kept.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        if name in RAW:
            _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            inputs = {d: table(spark, sf_dir, d) for d in set(_deps(name))}
            if name == "freq":
                inputs["lineitem"] = _per_word(inputs["lineitem"], inputs["embeddings"])
            _TABLES[key] = spark.sql(SQL[name], **inputs)
    return _TABLES[key]


def _per_word(lineitem: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Line items with the whole quantities of each word summed up: `freq` has the same sums, and joins and shuffles a row per word."""
    return lineitem.sparkSession.sql(
        "SELECT vid AS l_partkey, sum(CAST(l_quantity AS BIGINT)) AS l_quantity FROM (SELECT l_quantity, l_partkey % (SELECT count(*) FROM {embeddings}) AS vid FROM {lineitem}) GROUP BY vid",
        lineitem=lineitem, embeddings=embeddings)


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the inputs a body names in braces come first as CTEs."""
    extra = extra or {}
    names: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\{(\w+)\}", text):
            if name in RAW or name in names:
                continue
            visit(extra[name] if name in extra else SQL[name])
            if name not in names:
                names.append(name)

    visit(body)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text).strip()
    ctes = [f"{n} AS ({plain(extra.get(n) or SQL[n])})" for n in names]
    recursive = "RECURSIVE " if any(re.search(rf"\b(FROM|JOIN) {n}\b", extra.get(n, "")) for n in names) else ""
    return (f"WITH {recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + plain(body)
