"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is padded to a power of two, turned by a pseudo-rotation (three rounds of random
signs and a fast Hadamard transform) and hashed to its nearest signed axis; `hashes` of them
make the bucket of a table. Every vector is stored in one bucket of each of `tables` tables. A
query looks into the `probes` buckets of each table whose axes lie nearest to it, and every
vector found there is ranked by its exact cosine.

Buckets are scored as blocks: a bucket with many rows, stored or asking, is cut by hash into
parts of bounded size, and every part of its rows meets every part of its queries, so copies
that fill a bucket spread over tasks and nothing is capped. Repeated rows are dropped before
they are placed, and a block gives the best row of at most k different vec_ids per query. The
table of bucket sizes has at most `tables` x (2 x dimension) ** `hashes` rows.

The vectors of the test tables are isotropic in 64 dimensions (the fifth neighbour has a
cosine of about 0.3 to 0.45 where any pair has 0 +- 0.125), so a recall of 0.9 takes about
half of all rows as candidates whatever the method. For clustered vectors, or larger tables,
use fewer probes or more hashes.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take
no part; vectors are compared with vectors of the same length only; a null vec_id takes no
part; rows that repeat a vec_id count as one vector, the nearer one; ties go to the smaller
vec_id; with fewer than k candidates all are given; an empty table gives no rows; further
input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import landed, query, table
from lexspan.operators.blocks import left_to_right

TABLES, PROBES, HASHES = 8, 12, 1
VECTORS_AT_ONCE, QUERIES_AT_ONCE = 4096, 1024
_SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of every row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-rotation of unit rows, padded to a power of two."""
    width = 1 << max(0, int(np.ceil(np.log2(x.shape[1]))))
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    for signs in np.random.default_rng(seed).choice([-1.0, 1.0], (3, width)):
        x = hadamard(x * signs)
    return x


def buckets(x: np.ndarray, seed: int, hashes: int, probes: int) -> np.ndarray:
    """The `probes` nearest buckets of each unit row, nearest first."""
    held, code = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64)
    for h in range(hashes):
        y = rotated(x, seed * 64 + h)
        near = np.stack([y, -y], axis=2).reshape(len(x), -1)  # closeness to each signed axis
        top = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        total = held[:, :, None] + np.take_along_axis(near, top, axis=1)[:, None, :]
        names = code[:, :, None] * near.shape[1] + top[:, None, :]
        total, names = total.reshape(len(x), -1), names.reshape(len(x), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :probes]
        held, code = np.take_along_axis(total, best, axis=1), np.take_along_axis(names, best, axis=1)
    return code


def scaled(column: pa.Array, width: int) -> np.ndarray:
    """Rows as doubles, each divided by a power of two so that no square over- or underflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def _placer(tables: int, hashes: int, probes: int) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row once per table and probed bucket."""
        for batch in batches:
            widths = batch["vec"].value_lengths().to_numpy()
            for width in np.unique(widths):
                rows = batch.filter(pa.array(widths == width))
                x = scaled(rows["vec"], int(width))
                x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
                for t in range(tables):
                    code = buckets(x, t, hashes, probes)
                    again = pa.array(np.repeat(np.arange(len(x)), code.shape[1]))
                    yield pa.record_batch({
                        "id": rows["id"].take(again), "vec": rows["vec"].take(again),
                        "width": pa.array(np.full(code.size, width), pa.int32()),
                        "tbl": pa.array(np.full(code.size, t), pa.int32()), "bucket": pa.array(code.ravel()),
                    })

    return place


def usable(vec: Column) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & fine & F.exists(vec, lambda x: x != 0)


def _score(k: int) -> Callable:
    def score(key: tuple, data: pa.Table) -> pa.Table:
        """The k nearest rows of one block to each of its queries, exactly."""
        width = key[0].as_py()
        data = data.combine_chunks().sort_by("id")
        asks = np.array(data["asks"].to_pylist(), dtype=bool)
        sides = []
        for side in (asks, ~asks):
            part = data.filter(pa.array(side))
            x = scaled(part["vec"].combine_chunks(), width) if part.num_rows else np.zeros((0, width))
            sides.append((part["id"].to_numpy(), x, np.sqrt(left_to_right(x, x)) if len(x) else np.zeros(0)))
        (qid, q, q_len), (vid, x, x_len) = sides
        out = []
        if len(q) and len(x):
            # Rows of one id stand together: equal ones are dropped, and the best of the others counts.
            once = _different(vid, x)
            vid, x, x_len = vid[once], x[once], x_len[once]
            first = np.flatnonzero(np.r_[True, vid[1:] != vid[:-1]])
            unit = x / x_len[:, None]
            for i in range(0, len(q), 128):
                near = (q[i : i + 128] / q_len[i : i + 128, None]) @ unit.T
                near[qid[i : i + 128, None] == vid[None, :]] = -np.inf
                for r, row in enumerate(near):
                    most = np.maximum.reduceat(row, first)
                    floor = np.partition(most, len(most) - k)[len(most) - k] if len(most) > k else -np.inf
                    # Rounding cannot lift a row over the k-th id by more than the slack; of equal
                    # vectors the first k ids are enough.
                    at = np.flatnonzero((row >= floor - _SLACK) & (row > -np.inf))
                    if len(at) > 4 * k:
                        at = _first_copies(x, at, k)
                    exact = left_to_right(x[at], np.broadcast_to(q[i + r], (len(at), width))) / (x_len[at] * q_len[i + r]) if len(at) else np.zeros(0)
                    best = np.lexsort((vid[at], -exact))
                    best = best[np.sort(np.unique(vid[at][best], return_index=True)[1])][:k]
                    out.append((np.full(len(best), qid[i + r]), vid[at][best], exact[best]))
        none = np.zeros(0)
        query_id, vec_id, score = (np.concatenate([none, *c]) if not out else np.concatenate(c) for c in (zip(*out) if out else ((), (), ())))
        return pa.table({"query_id": pa.array(query_id, pa.int64()) if len(query_id) else pa.array([], pa.int64()),
                         "vec_id": pa.array(vec_id, pa.int64()) if len(vec_id) else pa.array([], pa.int64()), "score": pa.array(score, pa.float64())})

    return score


def _different(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places, in order, of the first of each set of rows with equal id and vector."""
    rows = np.column_stack([ids, np.ascontiguousarray(x).view(np.int64)])
    rows = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1] * 8))).ravel()
    return np.sort(np.unique(rows, return_index=True)[1])


def _first_copies(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of different rows `at`, in order of id, the first k of each group of equal vectors."""
    rows = np.ascontiguousarray(x[at]).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    code = np.unique(rows, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    new = np.r_[True, np.diff(code[order]) != 0]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return at[np.sort(order[place < k])]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, probes: int = PROBES, hashes: int = HASHES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, not itself.

    Both inputs have vec_id and embedding.
    """
    def placed(df: DataFrame, n: int) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vec")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
        kind = dict(rows.dtypes)["vec"]
        return rows.dropDuplicates(["id", "vec"]).mapInArrow(_placer(tables, hashes, n), f"id long, vec {kind}, width int, tbl int, bucket long")

    index, asked = landed(placed(vectors, 1), "index"), landed(placed(queries, probes), "asked")
    where = ["width", "tbl", "bucket"]
    held = index.groupBy(*where).agg(F.ceil(F.count("*") / VECTORS_AT_ONCE).alias("parts"))
    asking = asked.groupBy(*where).agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).alias("turns"))
    cuts = held.join(asking, where)

    def cut(df: DataFrame, mine: str, other: str, asks: bool) -> DataFrame:
        rows = df.join(cuts, where).withColumn(mine, F.pmod(F.xxhash64("id", "vec"), F.col("parts" if mine == "p" else "turns")))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns" if mine == "p" else "parts") - 1))).select(
            *where, "p", "t", "id", "vec", F.lit(asks).alias("asks"))

    both = cut(index, "p", "t", False).unionByName(cut(asked, "t", "p", True))
    found = both.groupBy(*where, "p", "t").applyInArrow(_score(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op6_cross_polytope")
def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0))
