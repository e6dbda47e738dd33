r"""Divergence between the sources of a language, over run-length encoded columns of counts.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z in small letters. A language
keeps the terms that at least MIN_DOCS of its documents hold. With p = 1 + floor(10^9 (count + 1)
/ (N + V)) for each kept term of a group, the divergence of p from q is the sum of
floor((p - q)^2 / q).

A term is a row of counts, one per source. Terms with equal rows are merged into one row with
its number of terms, and the rows of a language are sorted, so equal counts stand together.
Blocks of the sorted rows are then read as columns: each source is run-length encoded, the run
boundaries of a pair of sources are intersected, and f, computed once per run in exact integers,
is multiplied by the run length. A block gives one partial sum per pair of sources.

Counting happens in tasks that hold a bounded number of distinct terms and hand on what they
have when it is reached, so frequent terms and large sources are reduced before the shuffle.
Merging equal rows before the sort means that no row of counts, however common, is a hot key.

Defined cases: null texts, languages and sources are empty strings; every row of the table is a
document, repeated rows included; a group without terms counts as zeros; a language without kept
terms has pairs of value 0 and no term rows; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import landed, query, table
from lexspan.operators.scale import number_by_order

MIN_DOCS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
HELD_TERMS = 400_000
BLOCK_ROWS = 8192

# Bytes of terms: A-Z become a-z, letters and non-ASCII bytes stay, all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a group, as far as this task has seen them."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> pa.RecordBatch:
        parts = [(g, list(n), list(n.values()), [docs[t] for t in n]) for g, (n, docs) in seen.items()]
        sizes = [len(p[1]) for p in parts]
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([p[0][i] for p in parts], dtype=object), sizes), pa.string()) for i in (0, 1)
        ] + [pa.array([t for p in parts for t in p[1]], pa.binary()).cast(pa.string())]
          + [pa.array([x for p in parts for x in p[i]], pa.int64()) for i in (2, 3)], schema=_COUNTED)

    for batch in batches:
        for lang, source, text in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
            found = terms_of(text)
            if not found:
                continue
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(found)
            docs.update(set(found))
            held += len(n) - before
            if held > HELD_TERMS:
                yield rows()
                seen, held = {}, 0
    if seen:
        yield rows()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term of a group."""
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = named.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counted: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, total and row: the counts of each kept term by source, in source order."""
    by_term = counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("row"))
    return by_term.filter(F.col("docs") >= min_docs).select("lang", "term", "total", "row")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, words (N), kept (V) and lang_words of every group that occurs."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    words = kept.select("lang", F.explode("row").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("words"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_words"))
    return groups.join(words, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["words", "kept", "lang_words"])


def _p(n: Column, words: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (words + kept)), in whole numbers of 38 digits."""
    part = (F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    return (F.call_function("div", part, (words + kept).cast("decimal(20,0)")) + 1).cast("long")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_rows(kept: DataFrame, groups: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """The terms of each group that stand out most against its language."""
    held = kept.select("lang", "term", "total", F.explode("row").alias("x")).select("lang", F.col("x.source").alias("source"), "term", "total", "x.n")
    rows = held.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _p(F.col("n"), F.col("words"), F.col("kept")).alias("p"),
        _p(F.col("total"), F.col("lang_words"), F.col("kept")).alias("q")).filter("p > q")
    rows = rows.select("lang", "source", "item", _f(F.col("p"), F.col("q")).alias("value"))
    # The limit of ranks works inside tasks before rows meet by group.
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top)


def column_blocks(kept: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """lang, block, at, row, terms: distinct rows of counts in sorted order, with their number of terms."""
    merged = kept.groupBy("lang", "row").agg(F.count("*").alias("terms"))
    placed = number_by_order(merged, ["lang", "row"], "at")
    return placed.withColumn("block", F.floor(F.col("at") / block_rows)).select("lang", "block", "at", "row", "terms")


def run_starts(column: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))


def scaled(counts_of_runs: np.ndarray, words: int, kept: int) -> np.ndarray:
    """p of each run; Python's whole numbers have no upper limit."""
    return np.array([1 + SCALE * (n + 1) // (words + kept) for n in counts_of_runs.tolist()], dtype=np.int64)


def pair_value(starts: np.ndarray, p: np.ndarray, other: np.ndarray, q: np.ndarray, before: np.ndarray) -> int:
    """Sum of f over two run-length encoded columns; `before` counts the terms ahead of a row."""
    cuts = np.union1d(starts, other)
    mine, theirs = p[np.searchsorted(starts, cuts, "right") - 1], q[np.searchsorted(other, cuts, "right") - 1]
    lengths = np.diff(np.append(before[cuts], before[-1]))
    return int((((mine - theirs) ** 2 // theirs) * lengths).sum())


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _pairs_of_block(rows: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of one block of a language for all ordered pairs of its sources."""
    if rows.num_rows == 0:
        return _PAIRS.empty_table()
    rows = rows.sort_by("at").combine_chunks()
    groups = groups.sort_by("source")
    names = groups["source"].to_pylist()
    lists = rows["row"].combine_chunks()
    inner = lists.flatten()
    column = pc.index_in(inner.field("source"), pa.array(names, pa.string())).to_numpy(zero_copy_only=False)
    # Entries of a row are its sources with a count; stable order by source keeps rows in order.
    place = np.repeat(np.arange(rows.num_rows), np.diff(lists.offsets.to_numpy()))
    values = inner.field("n").to_numpy(zero_copy_only=False)
    order = np.argsort(column, kind="stable")
    bounds = np.searchsorted(column[order], np.arange(len(names) + 1))
    before = np.concatenate(([0], np.cumsum(rows["terms"].to_numpy())))
    encoded = []
    for i, (words, kept) in enumerate(zip(groups["words"].to_pylist(), groups["kept"].to_pylist())):
        dense = np.zeros(rows.num_rows, dtype=np.int64)
        mine = order[bounds[i] : bounds[i + 1]]
        dense[place[mine]] = values[mine]
        starts = run_starts(dense)
        encoded.append((starts, scaled(dense[starts], words, kept)))
    lang = rows["lang"][0].as_py()
    out = [(lang, a, b, pair_value(*encoded[i], *encoded[j], before)) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _PAIRS)], schema=_PAIRS) if out else _PAIRS.empty_table()


def pair_rows(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of each group from every other source of its language, ranked."""
    blocks = column_blocks(kept)
    wanted = blocks.groupBy("lang", "block").count().join(groups, "lang").select(
        F.col("lang").alias("_lang"), F.col("block").alias("_block"), "source", "words", "kept")
    sums = blocks.groupBy("lang", "block").cogroup(wanted.groupBy("_lang", "_block")).applyInArrow(
        _pairs_of_block, "lang string, source string, item string, value long")
    names = groups.select("lang", "source")
    zeros = names.join(names.withColumnRenamed("source", "item"), "lang").filter(F.col("source") != F.col("item"))
    both = sums.unionByName(zeros.withColumn("value", F.lit(0).cast("long")))
    pairs = both.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    kept = landed(vocabulary(counts(docs), min_docs), "vocabulary")
    groups = landed(group_sizes(docs, kept), "groups")
    parts = [rows.withColumn("part", F.lit(part)) for part, rows in (("pair", pair_rows(kept, groups)), ("term", term_rows(kept, groups, top)))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT lang, source, rid, unnest(t) AS term FROM docs),
groups AS (SELECT DISTINCT lang, source FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM held GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
counted AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM held SEMI JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (
  SELECT g.lang, g.source, coalesce(w.n, 0)::HUGEINT AS words, coalesce(v.kept, 0)::HUGEINT AS kept, coalesce(v.words, 0)::HUGEINT AS lang_words
  FROM groups g LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counted GROUP BY ALL) w USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS kept, sum(total) AS words FROM kept GROUP BY lang) v USING (lang)),
-- Every kept term in every group of its language.
full_p AS (
  SELECT k.lang, s.source, k.term, coalesce(n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (words + s.kept))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (total + 1)) // (lang_words + s.kept))::HUGEINT AS q
  FROM kept k JOIN sizes s USING (lang) LEFT JOIN counted c ON c.lang = k.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM full_p x JOIN full_p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) v
  ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM full_p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op12_source_audit", _SQL)
def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources by language, pair by pair and by their outstanding terms."""
    return audit(table(spark, sf_dir, "documents"))
