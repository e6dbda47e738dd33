"""Approximate search: vectors grouped into lists, each query reads the nearest lists only.

An index is stored once: the vectors as folders by list, and the centroids in two levels. A
search opens it, finds the nearest groups of centroids, then the nearest lists in them, and reads
the folders of those lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexspan.functions import vectors as V
from lexspan.operators import search as S
from lexspan.operators.blocks import matrix

_SCORES = 4_000_000
FILE_ROWS = 1_000_000


@dataclass(frozen=True)
class Centroids:
    """Unit centroids of lists, and the groups they form; one row per list."""

    ids: np.ndarray
    centres: np.ndarray
    group: np.ndarray
    groups: np.ndarray


@dataclass(frozen=True)
class StoredLists:
    vectors: DataFrame
    centroids: Centroids


def _unit(x: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / np.where(lengths > 0, lengths, 1)


def _scores(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Component by component, so equal vectors always choose equal lists."""
    score = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        score += np.outer(x[:, j], centres[:, j])
    return score


def _fit(features: DataFrame, k: int, seed: int, rounds: int) -> list[np.ndarray]:
    return KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(features).clusterCenters()


def train_centroids(
    vectors: DataFrame, lists: int = S.LISTS, seed: int = 7, rounds: int = 20, fraction: float = 1.0
) -> DataFrame:
    """Centroids by cosine k-means: `list_id, centroid`.

    Training reads the vectors once per round; `fraction` trains on a part of a large
    table. Only the placing of the lists depends on it: every vector is assigned to one.
    """
    rows = vectors if fraction >= 1 else vectors.sample(fraction, seed)
    features = rows.select(array_to_vector(V.as_double(F.col("vec"))).alias("features"))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(_fit(features, lists, seed, rounds))]
    return vectors.sparkSession.createDataFrame(rows, "list_id long, centroid array<double>")


def mean_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector of each existing list."""
    rows = vectors.select("list_id", array_to_vector(V.as_double(F.col("vec"))).alias("vec"))
    return rows.groupBy("list_id").agg(Summarizer.mean(F.col("vec")).alias("mean")).select(
        "list_id", vector_to_array("mean").alias("centroid"))


def grouped(centroids: DataFrame, groups: int | None = None, seed: int = 7, rounds: int = 20) -> DataFrame:
    """Centroids with the second level: `list_id, centroid, group_id`. By default as many groups as lists in a group."""
    table = centroids.orderBy("list_id").toArrow()  # a row per list
    k = groups or max(1, round(len(table) ** 0.5))
    spark = centroids.sparkSession
    if k == 1 or len(table) <= k:
        return centroids.select("list_id", "centroid", F.lit(0).cast("long").alias("group_id"))
    centres = _unit(matrix(table["centroid"]))
    features = centroids.select(array_to_vector(V.as_double(F.col("centroid"))).alias("features"))
    group = _scores(centres, _unit(np.array(_fit(features, k, seed, rounds)))).argmax(axis=1)
    rows = list(zip(table["list_id"].to_pylist(), table["centroid"].to_pylist(), group.tolist()))
    return spark.createDataFrame(rows, "list_id long, centroid array<double>, group_id long")


def load_centroids(centroids: DataFrame) -> Centroids:
    """Centroids as arrays; without a `group_id` they are one group."""
    table = centroids.orderBy("list_id").toArrow()
    ids, centres = table["list_id"].to_numpy().astype(np.int64), _unit(matrix(table["centroid"]))
    named = table["group_id"].to_numpy() if "group_id" in table.column_names else np.zeros(len(ids))
    _, group = np.unique(named, return_inverse=True)
    sums = np.zeros((int(group.max()) + 1 if len(group) else 0, centres.shape[1] if len(ids) else 0))
    np.add.at(sums, group, centres)
    return Centroids(ids, centres, group, _unit(sums) if len(sums) else sums)


def nearest(x: np.ndarray, c: Centroids, m: int) -> np.ndarray:
    """Positions of the m nearest centroids of each row, nearest first, ties by list.

    The m-th best of the nearest groups is a bound; a group is compared only if a centroid within
    its angle could reach that bound. So the second level saves work and changes nothing.
    """
    take = min(m, len(c.ids))
    out = np.empty((len(x), take), dtype=np.int64)
    sizes = np.bincount(c.group, minlength=len(c.groups))
    members = [np.flatnonzero(c.group == g) for g in range(len(c.groups))]
    widest = np.array([np.clip(_scores(c.centres[mine], c.groups[[g]]).min(), -1, 1) for g, mine in enumerate(members)])
    step = max(1, _SCORES // max(1, len(c.ids)))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        lengths = np.sqrt((part**2).sum(axis=1))
        score = np.full((len(part), len(c.ids)), -np.inf)

        def compare(asked: np.ndarray) -> None:
            for g in np.flatnonzero(asked.any(axis=0)):
                rows = np.flatnonzero(asked[:, g])
                score[np.ix_(rows, members[g])] = _scores(part[rows], c.centres[members[g]])

        order = np.argsort(-_scores(part, c.groups), axis=1, kind="stable")
        first = np.zeros(order.shape, dtype=bool)
        needed = (np.cumsum(sizes[order], axis=1) < take).sum(axis=1) + 1
        np.put_along_axis(first, order, np.arange(order.shape[1]) < needed[:, None], axis=1)
        compare(first)
        if take and len(c.groups) > 1:
            bound = np.partition(score, -take, axis=1)[:, -take]
            cosine = np.clip(_scores(part, c.groups) / np.where(lengths > 0, lengths, 1)[:, None], -1, 1)
            able = np.where(cosine >= widest, 1, cosine * widest + np.sqrt((1 - cosine**2) * (1 - widest**2)))
            compare((able * lengths[:, None] + 1e-9 * (1 + lengths[:, None]) >= bound[:, None]) & ~first)
        out[i : i + step] = np.argsort(-score, axis=1, kind="stable")[:, :take]
    return out


def nearest_lists(df: DataFrame, centroids: DataFrame | Centroids, column: str, m: int) -> DataFrame:
    """The m nearest lists of each row, by cosine, as an array column `lists`.

    Every list has one centroid, so what is shared grows with the number of lists and not
    with the vectors; scores are kept for a bounded part of a batch at a time.
    """
    known = centroids if isinstance(centroids, Centroids) else load_centroids(centroids)
    shared = df.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType(df.schema.fields + [T.StructField("lists", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            order = nearest(matrix(batch.column(column)), c, m)
            offsets = pa.array(np.arange(0, order.shape[1] * len(order) + 1, order.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(c.ids[order].ravel()))], [*batch.schema.names, "lists"])

    return df.mapInArrow(run, schema)


def assign_lists(vectors: DataFrame, centroids: DataFrame | Centroids) -> DataFrame:
    """Vectors with the id of their nearest list; store partitioned by it."""
    placed = nearest_lists(vectors, centroids, "vec", 1)
    return placed.withColumn("list_id", F.element_at("lists", 1)).drop("lists")


def write_lists(vectors: DataFrame, path: str) -> None:
    """Lists as folders; a list has as many files as its rows need, dealt out by word."""
    files = vectors.groupBy("list_id").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files"))
    salted = vectors.join(files, "list_id").repartition("list_id", F.pmod(F.xxhash64("word"), F.col("_files"))).drop("_files")
    salted.write.mode("overwrite").partitionBy("list_id").parquet(path)


def store_lists(vectors: DataFrame, centroids: DataFrame, path: str) -> None:
    """An index of vectors that have a `list_id`: their folders, and the centroids in two levels."""
    write_lists(vectors, f"{path}/lists")
    grouped(centroids).write.mode("overwrite").parquet(f"{path}/centroids")


def open_lists(spark: SparkSession, path: str) -> StoredLists:
    """A stored index: its centroids are read once, its folders when they are asked for."""
    return StoredLists(spark.read.parquet(f"{path}/lists"), load_centroids(spark.read.parquet(f"{path}/centroids")))


def stored_topk(queries: DataFrame, index: StoredLists, k: int = S.DEFAULT_K, probes: int = S.PROBES) -> DataFrame:
    """Top-k over the `probes` nearest lists of each query, read from a stored index."""
    return probed_topk(queries, index.vectors, index.centroids, k, probes)


def probed_topk(
    queries: DataFrame, listed: DataFrame, centroids: DataFrame | Centroids, k: int = S.DEFAULT_K,
    probes: int = S.PROBES,
) -> DataFrame:
    """Top-k over the `probes` nearest lists of each query."""
    base = S._queries(queries)
    known = centroids if isinstance(centroids, Centroids) else load_centroids(centroids)
    schema = S._hit_schema(base)
    head = S.bounded_queries(base, k)
    if head is not None:
        found = _scan_lists(listed, head, known, k, probes, schema)
    else:
        probing = nearest_lists(base, known, "qvec", probes).select(*base.columns, F.explode("lists").alias("list_id"))
        found = S._meet(S._vectors(listed, True), probing, k, False, schema)
    return S.rank_hits(found, k, S._order()).select("qid", "rank", "word", "sim")


def _scan_lists(listed: DataFrame, queries: pa.Table, centroids: Centroids, k: int, probes: int, schema: T.StructType) -> DataFrame:
    """The query block is bounded, so its lists are found here and become a literal filter on folders."""
    places = nearest(matrix(queries["qvec"]), centroids, probes) if queries.num_rows and len(centroids.ids) else np.zeros((0, 0), dtype=np.int64)
    query = np.repeat(np.arange(len(places)), places.shape[1])
    order = np.argsort(places.ravel(), kind="stable")
    wanted, starts = np.unique(places.ravel()[order], return_index=True)
    lists = {int(centroids.ids[w]): q for w, q in zip(wanted, np.split(query[order], starts[1:]))} if len(wanted) else {}
    # Folders of other lists are not read at all.
    vectors = S._vectors(listed, True).filter(F.col("list_id").isin(sorted(lists)) if lists else F.lit(False))
    return S._scan(vectors, S._block(queries, lists), k, False, schema)
