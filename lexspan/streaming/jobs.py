"""Streaming forms of the activity operators and of search."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexspan.operators import search as S
from lexspan.operators.limits import DAY_US
from lexspan.session import ensure_checkpoint_dir, freeze
from lexspan.streaming import state as P

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATE = "1 hour"
# Keys that the pairs of saved words are dealt to.
SAVE_SHARES = 1024


def _stateful(stream: DataFrame, keys: list[str], processor, late: str, *columns: str) -> DataFrame:
    """Rows of each key go through a processor; `ts` sets the watermark, `at` is its microsecond.

    The engine would drop rows behind the watermark unseen. It does not know that `at` is a time,
    so they reach the processor, which hands them on marked as late.
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select(*keys, *columns, F.unix_micros("ts").alias("at"))
    return rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime")


def limit_requests(keyed: DataFrame, span_us: int = DAY_US, late: str = LATE) -> DataFrame:
    """`keyed`: key, id, at, cap."""
    timed = keyed.withColumn("ts", F.timestamp_micros("at"))
    return _stateful(timed, ["key"], P.RequestLimiter(span_us), late, "id", "cap")


def daily_streaks(lookups: DataFrame, late: str = LATE) -> DataFrame:
    return _stateful(lookups, ["user_id"], P.DailyStreak(), late, "id")


def credit_ledger(events: DataFrame, late: str = LATE) -> DataFrame:
    return _stateful(events, ["user_id"], P.CreditLedger(), late, "id", "kind", "delta")


def saved_words(actions: DataFrame, late: str = LATE, shares: int = SAVE_SHARES) -> DataFrame:
    """The pairs of user and word are dealt to `shares` keys; a stream keeps its number of them."""
    bits = {"user_id": 1, "word_id": 2, "id": 4}
    gaps = sum((F.when(F.col(c).isNull(), bit).otherwise(0) for c, bit in bits.items()), F.lit(0))
    rows = actions.select(
        "ts", F.pmod(F.xxhash64("user_id", "word_id"), F.lit(shares)).cast("int").alias("share"), gaps.alias("gaps"),
        *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in bits], F.coalesce(F.col("action") == "save", F.lit(False)).alias("save"))
    out = _stateful(rows, ["share"], P.SavedWords(), late, *bits, "gaps", "save")
    return out.select(*[F.when(F.col("gaps").bitwiseAND(bit) == 0, F.col(c)).alias(c) for c, bit in bits.items()], "saved", "newly", "late")


def saves_after_lookups(saves: DataFrame, lookups: DataFrame, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Save-lookup pairs of one user, the lookup in (save - minutes, save]."""
    s = saves.select(F.col("user_id").alias("save_user"), F.col("id").alias("save_id"),
                     F.col("ts").cast("timestamp").alias("saved_at")).withWatermark("saved_at", late)
    k = lookups.select("user_id", F.col("id").alias("lookup_id"),
                       F.col("ts").cast("timestamp").alias("looked_at")).withWatermark("looked_at", late)
    span = F.expr(f"looked_at <= saved_at AND looked_at > saved_at - INTERVAL {minutes} MINUTES")
    return s.join(k, (s["save_user"] == k["user_id"]) & span).select("user_id", "save_id", "lookup_id")


def search_batches(vectors: DataFrame, k: int, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For `foreachBatch`: top-k of each micro-batch of queries against stored vectors."""
    def run(batch: DataFrame, batch_id: int) -> None:
        write(S.exact_topk(batch, vectors, k), batch_id)

    return run


def scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that stateful processors need, for streams started inside; the session keeps its own."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def write_in_time(df: DataFrame, path: str, at: Column, slices: int) -> None:
    """Rows in files of rising times: a slice of the times is written after the one before it.

    A file is written by one task, so the rows are made once, by all tasks, before they are sliced.
    """
    timed = freeze(df.withColumn("_at", at))
    cuts = timed.agg(F.percentile_approx("_at", [i / slices for i in range(1, slices)], 1000)).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    for low, high in zip(edges, edges[1:]):
        part = timed if low is None else timed.filter(F.col("_at") >= low)
        part = part if high is None else part.filter(F.col("_at") < high)
        part.drop("_at").coalesce(1).write.mode("append").parquet(path)


def read_in_time(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream over such files, a few of them in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def drain(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    with state_store(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(
            availableNow=True).start()
        query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, state: str, run: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(run).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
