"""Parquet stores: vector cells, runs, pools; and what tables and columns exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexspan.operators.cells import refuse_if_any, size_violations

ROWS_PER_FILE = 1_000_000


def write_cell(cell: DataFrame, meta: DataFrame, path: str) -> None:
    """Vectors by cell name next to their metadata; rows of a wrong length are refused."""
    refuse_if_any(size_violations(cell, meta), "vectors whose length is not the cell's dimension")
    cell.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "maxRecordsPerFile", ROWS_PER_FILE).partitionBy("cell").parquet(f"{path}/vectors")
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{path}/meta")


def read_cell(spark: SparkSession, path: str, cell: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, metadata) of one cell; the count and lengths must be what the metadata says."""
    named = F.col("cell") == cell
    vectors = spark.read.parquet(f"{path}/vectors").filter(named)
    meta = spark.read.parquet(f"{path}/meta").filter(named)
    rows = vectors.groupBy("cell").agg(F.count("*").alias("found"))
    refuse_if_any(
        meta.join(rows, "cell", "left").filter(~F.coalesce(F.col("found") == F.col("rows"), F.lit(False))),
        "the number of vectors is not what the metadata says")
    refuse_if_any(size_violations(vectors, meta), "vectors whose length is not the cell's dimension")
    return vectors, meta


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a metadata table that were written to the end, in order."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/meta_versions")
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    named = [s.getPath() for s in store.listStatus(root)]
    done = [p for p in named if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def publish_meta(meta: DataFrame, path: str) -> int:
    """Write metadata beside what is there, as the next version; readers see it once it is complete.

    No version is ever overwritten: two writers that race for one fail instead.
    """
    version = max(_versions(meta.sparkSession, path), default=-1) + 1
    meta.write.mode("errorifexists").parquet(f"{path}/meta_versions/version={version}")
    return version


def read_meta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The last complete version of the metadata, or the one asked for."""
    found = _versions(spark, path)
    if not found or (version is not None and version not in found):
        raise ValueError("no such version of the metadata")
    return spark.read.parquet(f"{path}/meta_versions/version={found[-1] if version is None else version}")


def write_run(results: DataFrame, runs: DataFrame, path: str) -> None:
    """Results and configuration by tag; writing a tag again replaces that tag only."""
    for name, df in (("results", results), ("runs", runs)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tag").parquet(f"{path}/{name}")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, results). Runs without a time are malformed and skipped with their results."""
    runs = spark.read.parquet(f"{path}/runs").filter("ran_at is not null")
    results = spark.read.parquet(f"{path}/results")
    return runs.orderBy("ran_at", "tag"), results.join(runs.select("tag"), "tag", "left_semi")


def write_pool(words: DataFrame, glosses: DataFrame, meta: DataFrame, path: str) -> None:
    for name, df in (("words", words), ("glosses", glosses), ("meta", meta)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in key ranges so that no single connection carries it all."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Table, column, place, type, nullable, and whether it is free text."""
    rows = [
        (name, f.name, i, f.dataType.simpleString(), f.nullable, isinstance(f.dataType, T.StringType))
        for name, df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, column_name string, place int, data_type string, nullable boolean, is_text boolean")


def catalog_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables()}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def first_rows(table: DataFrame, n: int = 5) -> DataFrame:
    """n rows in the order of the first column."""
    return table.orderBy(table.columns[0]).limit(n)
