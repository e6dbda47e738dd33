"""Exact and list-pruned top-k search.

Vectors: `word, vec`, and where they apply `sense_key`, `row`, `list_id`. Queries:
`qid, qvec`, and optionally `exclude` (a word that may not be returned).

A query set of bounded rows and bytes, which is checked before use, goes to every task and
the vectors are scanned where they lie: no shuffle of the large side. A larger query set is
matched block against block: both sides are salted into bounded blocks, and each pair of
blocks meets in one task.

Many queries make a scan cost more than dealing its rows out, so they are dealt to TASKS_PER_CORE
tasks per core, whatever files or joins they come from: no task holds most of them, and not many
small tasks return k rows per query each. Alone, each task returns k rows per query. Where all
tasks together would thus send much, the search goes over growing shares of the rows, chosen by hash: the k-th best of what has been seen
is a lower bound of the final k-th best, so only rows that reach it leave a task of the next
share. A share `r` times the one before returns about r * k rows per query, however many tasks
scan it. The vectors are read once per share and scored once in all; give a stored table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from lexspan.functions import vectors as V
from lexspan.operators.blocks import QueryBlock, TopK, add_to_all, matrix
from lexspan.session import freeze

DEFAULT_K = 10
OVERFETCH = 12
RELATED_K = 12
RANK_DEPTH = 100
PROBES = 10
LISTS = 150

BROADCAST_QUERIES = 32_768
BROADCAST_BYTES = 64 << 20
VECTORS_PER_BLOCK = 100_000
ROWS_PER_BLOCK = 1_000_000
QUERIES_PER_BLOCK = 8192
# Rows that a pair of blocks may hold for its queries; a merge holds several times as many.
KEPT_PER_BLOCK = 500_000
# Rows that one task may hold for its queries.
HELD_ROWS = 2_000_000
# From so many queries on, the vectors are dealt out for a scan.
DEALT_QUERIES = 256
TASKS_PER_CORE = 2
# Rows that all tasks of a scan may send before bounds pay for more passes.
FLOOR_ROWS = 10_000_000
# Ends of the shares, in 64ths of all rows.
SHARES = (2, 16, 64)


def _vectors(df: DataFrame, lists: bool, more: list[str] | None = None) -> DataFrame:
    cols = [
        F.col("word"),
        (F.coalesce(F.col("sense_key"), F.lit("")) if "sense_key" in df.columns else F.lit("")).alias("sense_key"),
        (F.col("row").cast("long") if "row" in df.columns else F.lit(0).cast("long")).alias("row"),
        F.col("vec"),
    ]
    if lists:
        cols.append(F.col("list_id").cast("long").alias("list_id"))
    return df.filter("vec is not null").select(*cols, *(more or []))


def unusable(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows that no search can score, with the reason; searches leave them out."""
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    reason = (
        F.when(vec.isNull(), "no vector").when(F.size(vec) != dim, "wrong length").when(~finite, "not finite")
    )
    return vectors.withColumn("reason", reason).filter("reason is not null").drop("vec")


def _queries(df: DataFrame) -> DataFrame:
    cols = ["qid", V.as_double(F.col("qvec")).alias("qvec")]
    cols += [c for c in ("exclude", "list_id") if c in df.columns]
    return df.filter("qvec is not null").select(*cols)


def _hit_schema(queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("qid", queries.schema["qid"].dataType),
        T.StructField("word", T.StringType()),
        T.StructField("sense_key", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("sim", T.DoubleType()),
    ])


def _block(table: pa.Table, lists: dict | None = None) -> QueryBlock:
    exclude = table["exclude"].combine_chunks() if "exclude" in table.column_names else None
    floor = table["floor"].to_numpy() if "floor" in table.column_names else None
    return QueryBlock(table["qid"].combine_chunks(), matrix(table["qvec"]), exclude, lists, floor)


def _tasks(df: DataFrame) -> int:
    return TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism


def _dealt(vectors: DataFrame, asked: int) -> DataFrame:
    """Rows for a scan of so many queries, dealt evenly to a bounded number of tasks if that pays."""
    return vectors.repartition(_tasks(vectors), "word", "sense_key", "row") if asked >= DEALT_QUERIES else vectors


def _scan(vectors: DataFrame, block: QueryBlock, k: int, by_word: bool, schema) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TopK(shared.value, k, by_word)
        for batch in batches:
            top.add(pa.Table.from_batches([batch]))
        out = top.result()
        if out is not None:
            yield from out.to_batches()

    return vectors.mapInArrow(run, schema)


def _folded(vectors: DataFrame, k: int, by_word: bool, excludes: bool) -> DataFrame:
    """list_id, vec, rows: each vector of a list once, with the first k of its rows, or of its words, by the tie keys.

    Copies of a vector have equal scores, so no other row of it can be returned. A query that excludes
    a word could return more of them: then every row stays alone.
    """
    entry = F.struct("word", "sense_key", "row")
    if excludes:
        return vectors.select("list_id", "vec", F.array(entry).alias("rows"))
    # Hashes are sorted sooner than vectors, which then settle what has equal ones.
    vectors, keys = vectors.withColumn("hash", F.xxhash64("vec")), ["hash", "list_id", "vec"]
    if by_word:
        vectors = vectors.groupBy(*keys, "word").agg(F.min(F.struct("sense_key", "row")).alias("x")).select(*keys, "word", "x.*")
    place = F.row_number().over(W.partitionBy(*keys).orderBy("word", "sense_key", "row"))
    few = vectors.withColumn("place", place).filter(F.col("place") <= k)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("rows")).drop("hash")


def _at_once(k: int) -> int:
    """Queries of a block, so that its k rows per query are bounded."""
    return max(1, min(QUERIES_PER_BLOCK, min(HELD_ROWS, KEPT_PER_BLOCK) // max(1, k)))


def _meet(vectors: DataFrame, queries: DataFrame, k: int, by_word: bool, schema) -> DataFrame:
    """Block-against-block search of sides that share `list_id`, each list split by size."""
    # Read by the count of the blocks and by their making.
    vectors = freeze(_folded(vectors, k, by_word, "exclude" in queries.columns))
    v_blocks = vectors.groupBy("list_id").agg(
        F.ceil(F.greatest(F.count("*") / VECTORS_PER_BLOCK, F.sum(F.size("rows")) / ROWS_PER_BLOCK)).cast("int").alias("v_blocks")
    )
    q_blocks = queries.groupBy("list_id").agg(
        F.ceil(F.count("*") / _at_once(k)).cast("int").alias("q_blocks")
    )
    # One row per list. Lists probed by nobody and lists without vectors fall out here.
    plan = v_blocks.join(q_blocks, "list_id")

    def spread(side: DataFrame, own: str, other: str, salt: Column) -> DataFrame:
        placed = side.join(plan, "list_id")
        mine = F.pmod(salt, F.col(own)).cast("int").alias(own[0])
        theirs = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[0])
        return placed.select(*side.columns, mine, theirs)

    v = spread(vectors, "v_blocks", "q_blocks", F.xxhash64("vec", "rows"))
    q = spread(queries, "q_blocks", "v_blocks", F.xxhash64("qid"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        top = TopK(_block(right), k, by_word)
        for batch in left.select(["vec", "rows"]).to_batches(max_chunksize=10_000):
            top.add(pa.Table.from_batches([batch]))
        out = top.result()
        return out if out is not None else pa.schema(
            [("qid", right.schema.field("qid").type), ("word", pa.string()),
             ("sense_key", pa.string()), ("row", pa.int64()), ("sim", pa.float64())]
        ).empty_table()

    keys = ["list_id", "v", "q"]
    return v.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(run, schema)


def _floor(block: QueryBlock, floors: DataFrame) -> np.ndarray:
    """Bounds `qid, floor`, a row per query at most, by the place of the query in its block."""
    known = floors.toArrow()
    at = pc.index_in(block.ids, value_set=known["qid"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.append(known["floor"].to_numpy(), -np.inf)[at]


def _leaders(found: DataFrame, k: int, by_word: bool | set[str], by: list[str] | None = None) -> DataFrame:
    """Best k rows, or rows of the best k words, per query; of several runs, `by_word` names those that go by words."""
    by = by or ["qid"]

    def best(part: DataFrame) -> DataFrame:
        return part.groupBy(*by, "word").agg(F.max(F.struct("sim", "sense_key", "row")).alias("x")).select(
            *by, "word", "x.sense_key", "x.row", "x.sim")

    if isinstance(by_word, set):
        worded = F.col("tag").isin(sorted(by_word))
        found = best(found.filter(worded)).unionByName(found.filter(~worded))
    elif by_word:
        found = best(found)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*_order()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _by_shares(
    vectors: DataFrame, k: int, by_word: bool | set[str], search: Callable[[DataFrame, DataFrame | None], DataFrame],
    by: list[str] | None = None,
) -> DataFrame:
    """Candidates of passes over growing shares, each above the bounds `qid, floor` found so far."""
    by = by or ["qid"]
    share = F.pmod(F.xxhash64("word", "sense_key", "row", "vec"), F.lit(SHARES[-1]))
    found, floors, low = None, None, 0
    for high in SHARES:
        part = vectors.filter((share >= low) & (share < high))
        # The first share has no bounds yet, so it is gathered into few tasks.
        hits = search(part.hint("rebalance") if floors is None else part, floors)
        found = hits if found is None else found.unionByName(hits)
        if high < SHARES[-1]:
            found = freeze(_leaders(found, k, by_word, by))
            floors = found.groupBy(*by).agg(F.count("*").alias("n"), F.min("sim").alias("floor")).filter(F.col("n") >= k).drop("n")
        low = high
    return found


def bounded_queries(queries: DataFrame, k: int) -> pa.Table | None:
    """The query set, if it is small enough for every task in rows, in bytes and in the rows it asks for."""
    most = min(BROADCAST_QUERIES, HELD_ROWS // max(1, k))
    head = queries.limit(most + 1).toArrow()
    return head if head.num_rows <= most and head.nbytes <= BROADCAST_BYTES else None


def _candidates(queries: DataFrame, vectors: DataFrame, k: int, by_word: bool) -> DataFrame:
    schema = _hit_schema(queries)

    def sends_much(asked: int) -> bool:
        return asked * k * _tasks(vectors) > FLOOR_ROWS

    head = bounded_queries(queries, k)
    if head is not None:
        block = _block(head)

        def scan(part: DataFrame, floors: DataFrame | None) -> DataFrame:
            if floors is None:
                return _scan(part, block, k, by_word, schema)
            return _scan(part, replace(block, floor=_floor(block, floors)), k, by_word, schema)

        dealt = _dealt(vectors, head.num_rows)
        # The rows may come from a join: they are made once for all shares.
        return _by_shares(freeze(dealt), k, by_word, scan) if sends_much(head.num_rows) else scan(dealt, None)
    one = F.lit(0).cast("long").alias("list_id")
    asked = queries.select("*", one)

    def meet(part: DataFrame, floors: DataFrame | None) -> DataFrame:
        bounded = asked if floors is None else asked.join(floors, "qid", "left").fillna(float("-inf"), ["floor"])
        return _meet(part.select("*", one), bounded, k, by_word, schema)

    return _by_shares(vectors, k, by_word, meet) if sends_much(QUERIES_PER_BLOCK) else meet(vectors, None)


def runs_topk(queries: DataFrame, vectors: DataFrame, runs: dict[str, tuple[Column, bool]], k: int = DEFAULT_K) -> DataFrame:
    """Several runs over one table in one scan: tag, qid, rank, word, sense_key, row, sim.

    `runs`: by tag, which rows take part, and whether a word is scored by its nearest row. Every
    block of vectors is read once and scored once for all runs. Where the rows of all runs are too
    many for a task, each run has its own scan.
    """
    asked = _queries(queries)
    head = bounded_queries(asked, k * len(runs))
    tags, flags = list(runs), [f"_run{i}" for i in range(len(runs))]
    marked = vectors.select("*", *[F.coalesce(part, F.lit(False)).alias(f) for f, (part, _) in zip(flags, runs.values())])
    if head is None:
        parts = [_candidates(asked, _vectors(marked.filter(f), False), k, by_word).withColumn("tag", F.lit(t))
                 for t, f, (_, by_word) in zip(tags, flags, runs.values())]
        found = reduce(DataFrame.unionByName, parts)
    else:
        by_words = [by_word for _, by_word in runs.values()]
        schema = T.StructType([T.StructField("tag", T.StringType()), *_hit_schema(asked).fields])
        context = vectors.sparkSession.sparkContext
        block = _block(head)
        shared = context.broadcast(block)

        def scan(part: DataFrame, floors: DataFrame | None) -> DataFrame:
            bounds = context.broadcast([None] * len(tags) if floors is None else [
                _floor(block, floors.filter(F.col("tag") == t).drop("tag")) for t in tags])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                tops = [TopK(replace(shared.value, floor=bound), k, by_word) for bound, by_word in zip(bounds.value, by_words)]
                for batch in batches:
                    add_to_all(tops, pa.Table.from_batches([batch]), flags)
                for tag, top in zip(tags, tops):
                    out = top.result()
                    if out is not None:
                        yield from out.add_column(0, "tag", pa.array([tag] * len(out), pa.string())).to_batches()

            return part.mapInArrow(run, schema)

        kept = _dealt(_vectors(marked.filter("vec is not null"), False, flags), head.num_rows)
        if head.num_rows * k * len(tags) * _tasks(kept) > FLOOR_ROWS:
            # The rows may come from a join or a window: they are made once for all shares.
            words = {t for t, by_word in zip(tags, by_words) if by_word}
            found = _by_shares(freeze(kept), k, words, scan, ["tag", "qid"])
        else:
            found = scan(kept, None)
    rank = F.row_number().over(W.partitionBy("tag", "qid").orderBy(*_order()))
    if not any(by_word for _, by_word in runs.values()):
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)
    # One shuffle serves the best row of each word and the ranking.
    found = found.repartition("tag", "qid")
    by_word = F.col("tag").isin([t for t, (_, w) in runs.items() if w])
    unit = F.when(by_word, F.struct(F.col("word"), F.lit("").alias("sense_key"), F.lit(0).cast("long").alias("row"))).otherwise(F.struct("word", "sense_key", "row"))
    best = found.groupBy("tag", "qid", unit.alias("unit")).agg(F.max("sim").alias("sim")).select("tag", "qid", "unit.*", "sim")
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def rank_hits(hits: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Keep k per query. The filter on the rank lets Spark prune before its shuffle."""
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def _order() -> list[Column]:
    return [F.desc("sim"), F.asc("word"), F.asc("sense_key"), F.asc("row")]


def exact_rows(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Best k rows per query; ties by word, sense key, row."""
    found = _candidates(_queries(queries), _vectors(vectors, False), k, False)
    return rank_hits(found, k, _order())


def exact_topk(queries: DataFrame, vectors: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    return exact_rows(queries, vectors, k).select("qid", "rank", "word", "sim")


def best_sense_topk(queries: DataFrame, senses: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Best k words per query, each scored by its nearest sense."""
    found = _candidates(_queries(queries), _vectors(senses, False), k, True)
    best = found.groupBy("qid", "word").agg(F.max("sim").alias("sim"))
    return rank_hits(best, k, [F.desc("sim"), F.asc("word")]).select("qid", "rank", "word", "sim")


def overfetched_best_sense(
    queries: DataFrame, senses: DataFrame, k: int = DEFAULT_K, overfetch: int = OVERFETCH
) -> DataFrame:
    """Nearest k * overfetch sense rows, then one row per word: may hold fewer than k words."""
    near = exact_rows(queries, senses, k * overfetch)
    best = near.groupBy("qid", "word").agg(F.max("sim").alias("sim"))
    return rank_hits(best, k, [F.desc("sim"), F.asc("word")]).select("qid", "rank", "word", "sim")


def synset_topk(
    queries: DataFrame, cell: DataFrame, members: DataFrame, k: int = DEFAULT_K
) -> DataFrame:
    """Best k synset rows, expanded into members in their given order, first mention kept.

    `cell`: sense_key, word (the first member), vec. `members`: sense_key, member_pos, word.
    Only the first k members of a synset can be reached, so the rest never leave the scan.
    """
    return expanded(exact_rows(queries, cell, k), members, k)


def expanded(hits: DataFrame, members: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Synset hits as words: members in their given order, first mention kept, k words per query."""
    hits = hits.select("qid", "rank", "sense_key", "sim")
    reachable = first_members(members, k)
    words = hits.join(reachable, "sense_key").groupBy("qid", "word").agg(
        F.min(F.struct("rank", "member_pos", "sim")).alias("first")
    )
    flat = words.select("qid", "word", "first.sim", F.col("first.rank").alias("hit"), "first.member_pos")
    return rank_hits(flat, k, [F.asc("hit"), F.asc("member_pos"), F.asc("word")]).select(
        "qid", "rank", "word", "sim"
    )


def first_members(members: DataFrame, k: int) -> DataFrame:
    """First k members per synset.

    Expansion stops at k words. With j words already out, a synset adds at most k - j new
    ones and repeats at most j, so its first k members always suffice.
    """
    place = F.row_number().over(W.partitionBy("sense_key").orderBy("member_pos", "word"))
    return members.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def member_order(
    members: DataFrame, policy: str = "lexicon", lexicon: DataFrame | None = None,
    zipf: DataFrame | None = None,
) -> DataFrame:
    """Members with `member_pos` by policy: lexicon position, frequency, or as stored.

    The stored position breaks ties, and members the lexicon does not list come last.
    Positions are sort keys, not counts: numbers may repeat and skip.
    """
    if policy == "index":
        return members.select("sense_key", "word", F.col("member_pos").cast("double").alias("member_pos"))
    if policy == "zipf":
        ranks = zipf.select(F.col("word").alias("_w"), F.col("zipf").alias("_key"))
        joined = members.join(ranks, F.lower("word") == F.col("_w"), "left")
        key = -F.coalesce(F.col("_key"), F.lit(0.0))
    elif policy == "lexicon":
        places = (
            lexicon.select("sense_key", F.lower("word").alias("_w"), F.col("position").alias("_key"))
            .groupBy("sense_key", "_w").agg(F.max("_key").alias("_key"))
        )
        left = members.withColumn("_w", F.lower("word"))
        joined = left.join(places, ["sense_key", "_w"], "left")
        key = F.coalesce(F.col("_key").cast("double"), F.lit(float("inf")))
    else:
        raise ValueError("policy must be lexicon, zipf or index")
    return joined.select("sense_key", "word", F.struct(key.alias("key"), F.col("member_pos").alias("stored")).alias("member_pos"))


def filtered_topk(queries: DataFrame, vectors: DataFrame, drop: Column, k: int = DEFAULT_K) -> DataFrame:
    """Rows matching `drop` leave before the ranking."""
    return exact_topk(queries, vectors.filter(~drop), k)


def neighbours(slugs: DataFrame, vectors: DataFrame, k: int = RELATED_K) -> DataFrame:
    """Nearest words of stored words, the word itself left out; none for an unknown word."""
    known = vectors.select("word", F.col("vec").alias("qvec"))
    queries = slugs.join(known, slugs["slug"] == known["word"]).select(
        F.col("slug").alias("qid"), "qvec", F.col("slug").alias("exclude")
    )
    return exact_topk(queries, vectors, k)


def similarity_to(queries: DataFrame, vectors: DataFrame, name: str = "target") -> DataFrame:
    """Similarity of each query to one named word, null when the word has no vector."""
    known = vectors.select(F.col("word").alias(name), "vec")
    return queries.join(known, name, "left").select(
        "qid", name, V.dot(F.col("qvec"), F.col("vec")).alias("sim")
    )


def answers(hits: DataFrame) -> DataFrame:
    """The first word as the answer and the next two as alternatives."""
    def at(rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("word")))

    picked = hits.filter("rank <= 3").groupBy("qid").agg(
        at(1).alias("answer"), at(2).alias("second"), at(3).alias("third")
    )
    return picked.select(
        "qid", "answer",
        F.filter(F.array("second", "third"), lambda w: w.isNotNull()).alias("alternatives"),
    )
