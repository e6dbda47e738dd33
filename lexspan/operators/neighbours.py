"""Nearest words of all words: a self-join that scores every pair of blocks once.

Words are dealt into blocks by hash, and each unordered pair of blocks meets in one task. Its
matrix product serves both sides: the rows of one block are candidates for the other and the other
way round. That is half the products of a search with every word as a query, and a word shared by
many rows, or a vector copied many times, is spread over all blocks.

With many blocks the pairs are taken in rounds of rising distance, as a search goes over growing
shares: what earlier rounds found bounds what later ones return.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexspan.operators import search as S
from lexspan.operators.blocks import QueryBlock, TopK, matrix, sound
from lexspan.session import freeze

BLOCK_ROWS = 20_000
LEAST_ROWS = 500
CHUNK = 256
MANY_BLOCKS = 16
ROUNDS = (1 / 16, 1 / 4, 1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


def _side(rows: pa.Table, k: int) -> tuple[pa.Table, np.ndarray, np.ndarray, TopK]:
    """A block: its rows, their vectors, which of them are asked for, and what is best for those."""
    x = np.ascontiguousarray(matrix(rows["vec"]))
    asked = rows["asked"].to_numpy().astype(bool)
    top = TopK(QueryBlock(rows["word"].combine_chunks(), x, rows["word"].combine_chunks(), None, rows["floor"].to_numpy()), k, False)
    return rows, x, asked, top


def _give(top: TopK, chosen: np.ndarray, asked: np.ndarray, rows: pa.Table, x: np.ndarray, scores: np.ndarray) -> None:
    """Candidates `x` for those of the chosen rows that are asked for; `scores` has a line per chosen row."""
    mine = asked[chosen]
    if mine.any() and len(x):
        top._match(rows, x, chosen[mine], scores[mine])


def pair_hits(rows: pa.Table, k: int) -> list[pa.Table]:
    """Best rows of each word asked for, out of the other rows of one pair of blocks; `own` tells the blocks apart."""
    vec = rows["vec"].combine_chunks()
    lengths = vec.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) == 0:
        return []
    # Every vector has the length of most; `search.unusable` lists the others.
    values, counts = np.unique(lengths, return_counts=True)
    rows = rows.filter(pa.array(sound(vec, int(values[counts.argmax()]))))
    own = rows["own"].to_numpy()
    names = np.unique(own)
    first, x, asked, top = _side(rows.filter(pa.array(own == names[0])), k)
    found = [top]
    if len(names) == 1:
        for at in range(0, len(x), CHUNK):
            here = np.arange(at, min(at + CHUNK, len(x)))
            later = np.arange(here[-1] + 1, len(x))
            scores = _product(x[here], x[at:])
            _give(top, later, asked, first.take(pa.array(here)), x[here], scores[:, len(here) :].T.copy())
            _give(top, here, asked, first.slice(at), x[at:], scores)
    else:
        second, y, wanted, other = _side(rows.filter(pa.array(own == names[1])), k)
        found.append(other)
        for at in range(0, len(x), CHUNK):
            here = np.arange(at, min(at + CHUNK, len(x)))
            scores = _product(x[here], y)
            _give(other, np.arange(len(y)), wanted, first.slice(at, len(here)), x[here], scores.T.copy())
            _give(top, here, asked, second, y, scores)
    return [t for t in (f.result() for f in found) if t is not None]


_HITS = pa.schema([("qid", pa.string()), ("word", pa.string()), ("sense_key", pa.string()), ("row", pa.int64()), ("sim", pa.float64())])


def all_neighbours(slugs: DataFrame, vectors: DataFrame, k: int = S.RELATED_K) -> DataFrame:
    """qid, rank, word, sim: the nearest words of every stored slug, the word itself left out."""
    known = slugs.select(F.col("slug").alias("word"), F.lit(True).alias("asked")).distinct()
    rows = S._vectors(vectors, False).join(known, "word", "left").fillna(False, ["asked"])
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS), min(round((2 * cores) ** 0.5), n // LEAST_ROWS))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word", "row", "vec"), F.lit(blocks)).cast("int"))
    rows = rows.withColumn("floor", F.lit(float("-inf")))

    def run(table: pa.Table) -> pa.Table:
        parts = pair_hits(table, k)
        return pa.concat_tables([p.cast(_HITS) for p in parts]) if parts else _HITS.empty_table()

    def meet(side: DataFrame, near: int, far: int) -> DataFrame:
        """Pairs of blocks at distances from `near` up to `far`, counted around the ring of blocks."""
        step = F.sequence(F.lit(near), F.lit(far - 1))
        partners = F.array_distinct(F.concat(
            F.transform(step, lambda d: F.pmod(F.col("own") + d, F.lit(blocks))), F.transform(step, lambda d: F.pmod(F.col("own") - d, F.lit(blocks)))))
        dealt = side.withColumn("other", F.explode(partners))
        dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")
        return dealt.groupBy("i", "j").applyInArrow(run, "qid string, word string, sense_key string, row long, sim double")

    reach = blocks // 2 + 1
    ends = sorted({max(1, round(r * reach)) for r in ROUNDS}) if blocks >= MANY_BLOCKS else [reach]
    found, near = None, 0
    for far in ends:
        hits = meet(rows, near, far)
        found = hits if found is None else found.unionByName(hits)
        if far < reach:
            found = freeze(S._leaders(found, k, False))
            floors = found.groupBy(F.col("qid").alias("word")).agg(F.count("*").alias("n"), F.min("sim").alias("bound")).filter(F.col("n") >= k)
            rows = rows.drop("floor").join(floors.select("word", F.col("bound").alias("floor")), "word", "left").fillna(float("-inf"), ["floor"])
        near = far
    return S.rank_hits(found, k, S._order()).select("qid", "rank", "word", "sim")
