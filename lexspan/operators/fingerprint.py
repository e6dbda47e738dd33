"""Order-sensitive SHA-256 fingerprints of large row sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexspan.operators.scale import number_by_order
from lexspan.session import freeze

BLOCK = 4096


def _fold(df: DataFrame, group: list[str]) -> DataFrame:
    """Hash of up to BLOCK consecutive hashes, joined in row order."""
    block = F.floor(F.col("row") / BLOCK).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("row", "piece")))
    joined = F.array_join(F.transform(ordered, lambda e: e["piece"]), "")
    return df.groupBy(*group, block.alias("row")).agg(F.sha2(joined, 256).alias("piece"))


def _hash_blocks(df: DataFrame, group: list[str]) -> DataFrame:
    """SHA-256 of each block of BLOCK consecutive texts, streamed: no block is held as a whole."""
    keys = [*group, "block"]
    placed = (
        df.select(*group, F.floor(F.col("row") / BLOCK).cast("long").alias("block"), "row", "text")
        .repartition(*keys).sortWithinPartitions(*keys, "row")
    )
    schema = T.StructType([*placed.select(*keys).schema.fields, T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(keys, key)), "piece": digest.hexdigest()}], batch_schema)

        for batch in batches:
            batch_schema = pa.schema([*[batch.schema.field(k) for k in keys], pa.field("piece", pa.string())])
            found = zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column("text").to_pylist())
            for at, text in found:
                if at != key:
                    if key is not None:
                        yield done()
                    key, digest = at, hashlib.sha256()
                digest.update((text or "").encode())
                digest.update(b"\0")
        if key is not None:
            yield done()

    return placed.mapInArrow(run, schema).withColumnRenamed("block", "row")


def _dense(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `row` replaced by its dense number in its group, from 0.

    Only keys and numbers are sorted and numbered; the texts meet them in a join.
    """
    placed = number_by_order(rows.select(*keys, "row"), [*keys, "row"], "_at")
    first = placed.groupBy(*keys).agg(F.min("_at").alias("_first"))
    same = F.struct(*keys)
    numbered = placed.withColumn("_k", same).join(first.select(same.alias("_k"), "_first"), "_k").select(
        F.struct(*keys, "row").alias("_k"), (F.col("_at") - F.col("_first")).alias("_row"))
    return rows.withColumn("_k", F.struct(*keys, "row")).join(numbered, "_k").select(*keys, F.col("_row").alias("row"), "text")


def texts_digest(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Fingerprint of `text` in the order of a unique `row`: one digest per group at any size.

    Rows are numbered densely in each group. Blocks of BLOCK texts, each ended by a NUL, are
    hashed; block hashes are hashed again, BLOCK at a time, at least once and until one is
    left. No task ever holds more than BLOCK hashes.
    """
    keys = ["_all", *(group or [])]
    pieces = _fold(_hash_blocks(_dense(rows.withColumn("_all", F.lit(0)), keys), keys), keys)
    while True:
        pieces = freeze(pieces)
        counts = pieces.groupBy(*keys).agg(F.count("*").alias("_n"))
        if counts.filter("_n > 1").isEmpty():
            return pieces.select(*(group or []), F.col("piece").alias("sha256"))
        same = F.struct(*keys)
        marked = pieces.withColumn("_k", same).join(counts.select(same.alias("_k"), "_n"), "_k")
        cols = pieces.columns
        pieces = marked.filter("_n = 1").select(*cols).unionByName(_fold(marked.filter("_n > 1").select(*cols), keys).select(*cols))


def vector_bytes_hash(df: DataFrame, keep: list[str], vec: str = "vec") -> DataFrame:
    """SHA-256 of each vector's little-endian 32-bit floats, as column `text`."""
    src = df.select(*keep, F.col(vec).cast("array<float>").alias("vec"))
    schema = T.StructType([*src.drop("vec").schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column("vec")
            flat = vecs.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            ends = np.cumsum(vecs.value_lengths().fill_null(0).to_numpy())
            parts = np.split(flat, ends[:-1]) if len(ends) else []
            hashes = [hashlib.sha256(p.tobytes()).hexdigest() for p in parts]
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hashes, pa.string())], [*keep, "text"])

    return src.mapInArrow(run, schema)


def vectors_digest(cell: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Fingerprint of a cell's vectors in row order: the tree over per-vector hashes."""
    group = group or []
    return texts_digest(vector_bytes_hash(cell, [*group, "row"]), group)
