"""SQL fragments for the DuckDB side."""

from __future__ import annotations

from lexspan.functions.text import STOPWORDS
from lexspan.plans.frames import CONFIG_SQL, DEPTH
from lexspan.plans.registry import SHARED


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP = "[" + ", ".join(q(w) for w in STOPWORDS) + "]"


def norm(x: str) -> str:
    return f"lower(trim({x}, ' ' || chr(9) || chr(10) || chr(13)))"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z]+'), lambda t: t <> '')"


def content(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z]+'), lambda t: length(t) >= 3 AND NOT list_contains({STOP}, t))"


def stems_q(x: str) -> str:
    return f"list_distinct(list_transform(list_filter({content(x)}, lambda t: length(t) >= 4), lambda t: t[1:4]))"


def stems_w(x: str) -> str:
    return f"list_transform(list_filter({tokens(x)}, lambda t: length(t) >= 4), lambda t: t[1:4])"


def echo(w: str, query: str) -> str:
    return f"list_has_any({stems_w(w)}, {stems_q(query)})"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda t: t <> '')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


def padded(x: str) -> str:
    return f"concat(' ', trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' ')"


def overlap(query: str, target: str) -> str:
    parts = f"string_split(trim({padded(target)}), ' ')"
    return (
        f"CASE WHEN len({parts}) > 1 AND len(list_filter({parts}, lambda p: length(p) >= 3 AND contains({padded(query)}, concat(' ', p, ' ')))) > 0 "
        f"THEN 'head_noun' WHEN {echo(target, query)} THEN 'stem_shared' ELSE 'none' END"
    )


def split_csv(x: str) -> str:
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda t: trim(t)), lambda t: t <> '')"


def token_class(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[ _-]') THEN 'multi' ELSE 'single' END"


def band(z: str) -> str:
    return (f"CASE WHEN {z} IS NULL THEN 'rare' WHEN {z} >= 5 THEN 'very_common' WHEN {z} >= 4 THEN 'common' "
            f"WHEN {z} >= 3 THEN 'mid' WHEN {z} >= 2 THEN 'uncommon' ELSE 'rare' END")


def band_label(z: str) -> str:
    return (f"CASE WHEN {z} IS NULL THEN 'unknown' WHEN {z} >= 5 THEN 'very_common (>=5)' WHEN {z} >= 4 THEN 'common (4-5)' "
            f"WHEN {z} >= 3 THEN 'mid (3-4)' WHEN {z} >= 2 THEN 'uncommon (2-3)' ELSE 'rare (<2)' END")


def length_bucket(x: str) -> str:
    n = word_count(x)
    return f"CASE WHEN {n} <= 8 THEN '<=8 words' WHEN {n} <= 12 THEN '9-12 words' WHEN {n} <= 16 THEN '13-16 words' ELSE '17+ words' END"


def junk(x: str) -> str:
    return (f"(regexp_matches({x}, '^[A-Z]') OR regexp_matches({x}, '[0-9]') OR regexp_matches({x}, '[^A-Za-z0-9 _''-]'))")


def dot(a: str, b: str) -> str:
    return f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def top(source: str, k: int, order: str = "sim DESC, word", by: str = "qid") -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM ({source})) "
            f"WHERE rank <= {k}")


def mcnemar(b: str, c: str) -> str:
    term = f"exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) + ({b} + {c}) * ln(0.5))"
    return (f"CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), "
            f"lambda i: {term}))) END")


SCORES = f"SELECT e.id AS qid, v.word AS word, {dot('v.embedding', 'e.qvec')} AS sim FROM {{eval_core}} e CROSS JOIN {{vocab}} v"
SENSE_SCORES = (f"SELECT e.id AS qid, s.word AS word, s.sense_key AS sense_key, s.row_id AS row_id, {dot('s.embedding', 'e.qvec')} AS sim "
                "FROM {eval_core} e CROSS JOIN {senses} s")

_PREPARED = f"""
SELECT id AS qid, id, source, query, target, reachable, style, sense_hint, zipf, qvec, {split_csv('acceptable_csv')} AS acceptable,
       {token_class('target')} AS token_count, {overlap('query', 'target')} AS lexical_overlap,
       {norm('target')} AS t, list_concat([{norm('target')}], list_transform({split_csv('acceptable_csv')}, lambda a: {norm('a')})) AS ok,
       {stems_q('query')} AS stems
FROM """
SHARED["set_queries"] = SHARED["queries"] = _PREPARED + "{eval_set}"
SHARED["hits_lemma"] = top(SCORES, DEPTH)
SHARED["hits_filtered"] = top(SCORES + f" WHERE NOT {junk('v.word')}", DEPTH)
SHARED["best_sense"] = f"SELECT qid, word, max(sim) AS sim FROM ({SENSE_SCORES}) GROUP BY qid, word"
SHARED["hits_sense"] = top("SELECT * FROM {best_sense}", DEPTH)
SHARED["members"] = "SELECT sense_key, word, min(row_id) AS member_pos FROM {senses} GROUP BY sense_key, word"
SHARED["collapsed"] = "SELECT sense_key, word, row_id, embedding FROM {senses} WHERE row_id % 4 = 0"
SHARED["synset_rows"] = top(
    f"SELECT e.id AS qid, c.word AS word, c.sense_key AS sense_key, {dot('c.embedding', 'e.qvec')} AS sim "
    "FROM {eval_core} e CROSS JOIN {collapsed} c", DEPTH, "sim DESC, word, sense_key")


def expand(rows: str, members: str, k: int) -> str:
    return (
        f"SELECT qid, word, sim, rank FROM (SELECT qid, word, sim, row_number() OVER (PARTITION BY qid ORDER BY hit, member_pos) AS rank "
        f"FROM (SELECT r.qid, m.word, r.sim, r.rank AS hit, m.member_pos, row_number() OVER (PARTITION BY r.qid, m.word ORDER BY r.rank, m.member_pos) AS f "
        f"FROM {rows} r JOIN {members} m ON m.sense_key = r.sense_key) WHERE f = 1) WHERE rank <= {k}"
    )


SHARED["hits_synset"] = expand("{synset_rows}", "{members}", DEPTH)
SHARED["hits_all"] = " UNION ALL ".join(
    f"SELECT '{t}' AS tag, qid, rank, word, sim FROM {{hits_{t}}}" for t in ("lemma", "filtered", "sense", "synset"))
SHARED["results"] = f"""
SELECT g.tag, k.id, k.source, k.query, k.target, k.reachable, k.style, k.zipf, k.acceptable, k.token_count, k.lexical_overlap,
       h.rank, h.lenient_rank, coalesce(h.echo, 0) AS echo, h.top1, h.top1_sim
FROM (SELECT unnest(['lemma', 'filtered', 'sense', 'synset']) AS tag) g CROSS JOIN {{queries}} k
LEFT JOIN (SELECT a.tag, a.qid, min(CASE WHEN {norm('a.word')} = k.t THEN a.rank END) AS rank,
                  min(CASE WHEN list_contains(k.ok, {norm('a.word')}) THEN a.rank END) AS lenient_rank,
                  avg(CASE WHEN a.rank <= 10 THEN CASE WHEN list_has_any({stems_w('a.word')}, k.stems) THEN 1.0 ELSE 0.0 END END) AS echo,
                  max(CASE WHEN a.rank = 1 THEN a.word END) AS top1, max(CASE WHEN a.rank = 1 THEN a.sim END) AS top1_sim
           FROM {{hits_all}} a JOIN {{queries}} k ON k.qid = a.qid GROUP BY a.tag, a.qid) h ON h.tag = g.tag AND h.qid = k.qid
"""
SHARED["runs"] = f"""
SELECT c.*, n.rows, 'set1' AS set_name, 10 AS k, {DEPTH} AS rank_depth, 10 AS probes, c.tag = 'filtered' AS filter_junk,
       CASE WHEN c.pool_scale IS NOT NULL THEN 'note' END AS note
FROM ({CONFIG_SQL}) c JOIN (SELECT tag, count(*) AS rows FROM {{results}} GROUP BY tag) n ON n.tag = c.tag
"""


def row_id(prefix: str, n: str) -> str:
    """At least four digits; longer numbers keep all of theirs."""
    digits = f"CAST({n} AS VARCHAR)"
    return f"concat('{prefix}-', repeat('0', greatest(4 - length({digits}), 0)), {digits})"


def digest_encoding(rows: str, salt: str) -> str:
    """Components other than zero of encoded texts: k, i (from 0), x as a 32-bit float. `rows`: k, text."""
    return f"""(WITH rows_in AS ({rows}), placed AS (
 SELECT k, CAST('0x' || h[1:4] AS INT) % 64 AS i, sum(CASE WHEN CAST('0x' || h[5:5] AS INT) < 8 THEN 1 ELSE -1 END) AS c
 FROM (SELECT k, md5('{salt}' || u) AS h FROM (SELECT k, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS u FROM rows_in)) GROUP BY ALL),
 long AS (SELECT k, sqrt(CAST(sum(c * c) AS DOUBLE)) AS len FROM placed GROUP BY k HAVING sum(c * c) > 0)
 SELECT k, i, CAST(c / len AS FLOAT) AS x FROM placed JOIN long USING (k) WHERE c <> 0
 UNION ALL SELECT k, 0, CAST(1 AS FLOAT) FROM rows_in ANTI JOIN long USING (k))"""
