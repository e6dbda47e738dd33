"""Sliding-window request limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lexspan.functions import text as X
from lexspan.operators.scale import counts_in_span, micros
from lexspan.session import freeze

DAY_US = 24 * 3600 * 1_000_000
HOUR_US = 3600 * 1_000_000
GUEST_LIMIT, USER_LIMIT, GAME_LIMIT = 50, 200, 60
NO_ADDRESS = "127.0.0.1"
# Times that are handed on as one row; a batch of 10,000 such rows has 80 MB.
RUN = 1024
_RUN = ["key", "cut", "bucket", "run"]

# What a refused caller is told.
GUEST_MESSAGE = "Daily limit of 50 free lookups reached. Sign in for 200 lookups/day."
USER_MESSAGE = "Daily limit of 200 lookups reached. Try again tomorrow."
GAME_MESSAGE = "Too many games. Please wait before playing again."


def keyed_requests(requests: DataFrame, guest_limit: int = GUEST_LIMIT, user_limit: int = USER_LIMIT) -> DataFrame:
    """Requests with their key and limit: the user, or a guest's first forwarded address."""
    guest = F.col("user_id").isNull()
    address = F.coalesce(X.strip(F.element_at(F.split("forwarded", ","), 1)), F.lit(NO_ADDRESS))
    return requests.select(
        "id", micros(F.col("ts")).alias("at"),
        F.when(guest, F.concat(F.lit("guest:"), address)).otherwise(F.concat(F.lit("user:"), F.col("user_id"))).alias("key"),
        F.when(guest, guest_limit).otherwise(user_limit).alias("cap"),
        F.when(guest, GUEST_MESSAGE).otherwise(USER_MESSAGE).alias("message"),
    )


def keyed_games(rounds: DataFrame, limit: int = GAME_LIMIT) -> DataFrame:
    """Games with their user and the hourly limit."""
    return rounds.select("id", micros(F.col("ts")).alias("at"), F.concat(F.lit("user:"), F.col("user_id")).alias("key"),
                         F.lit(limit).alias("cap"), F.lit(GAME_MESSAGE).alias("message"))


def rolling_counts(keyed: DataFrame, span_us: int) -> DataFrame:
    """Requests of the same key in the span up to each request, itself included."""
    probes = keyed.select("key", "at", "cap", F.col("id").alias("probe"))
    return counts_in_span(keyed.select("key", "at"), probes, ["key"], span_us, max(1, span_us // 24), "in_span")


def allow(at: np.ndarray, cap: int, span_us: int, recent: deque) -> np.ndarray:
    """Which of a key's sorted requests are allowed; `recent` carries the allowed times on.

    While the limit is used up, everything before the oldest allowed time leaves the span
    is refused, so the search jumps there instead of looking at each request.
    """
    out = np.zeros(len(at), dtype=bool)
    i = 0
    while i < len(at):
        while recent and recent[0] <= at[i] - span_us:
            recent.popleft()
        free = cap - len(recent)
        if free <= 0:
            i = int(np.searchsorted(at, recent[0] + span_us)) if recent else len(at)
            continue
        out[i : i + free] = True
        recent.extend(at[i : i + free].tolist())
        i += free
    return out


def _fold(span_us: int):
    """Decisions of sorted stretches, a run of times a row; the `known` times of a run only tell what was allowed before a stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, deque()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, cuts, known, caps = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "cut", "known", "cap"))
            ends = np.append(0, np.cumsum(batch["times"].value_lengths().to_numpy()))
            at = batch["times"].flatten().to_numpy()
            allowed = np.zeros(len(at), dtype=bool)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (cuts[1:] != cuts[:-1])])
            for lo, hi in zip(starts, np.r_[starts[1:], len(keys)]):
                if (keys[lo], cuts[lo]) != current:
                    current, recent = (keys[lo], cuts[lo]), deque()
                first = ends[lo] + known[lo:hi].sum()
                recent.extend(at[ends[lo]:first].tolist())
                allowed[first:ends[hi]] = allow(at[first:ends[hi]], int(caps[lo]), span_us, recent)
            flags = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(allowed))
            yield pa.record_batch({**{c: batch[c] for c in _RUN}, "flags": flags})

    return run


def _folded(rows: DataFrame, span_us: int) -> DataFrame:
    """id, allowed of all requests of stretches.

    Requests are numbered inside a bucket of time, and only runs of times, eight bytes a request,
    are sorted through a whole stretch: the busiest key is a narrow stream, and its requests
    stay dealt by bucket.
    """
    place = F.row_number().over(W.partitionBy("key", "cut", "bucket").orderBy("at", "id")) - 1
    rows = rows.withColumn("bucket", F.floor(F.col("at") / max(1, span_us // 24))).withColumn("place", place)
    rows = freeze(rows.withColumn("run", F.floor(F.col("place") / RUN)))
    runs = rows.groupBy(*_RUN).agg(
        F.array_sort(F.collect_list("at")).alias("times"), F.count_if("known").alias("known"), F.max("cap").alias("cap"))
    flags = runs.repartition("key", "cut").sortWithinPartitions(*_RUN).mapInArrow(
        _fold(span_us), "key string, cut long, bucket long, run long, flags array<boolean>")
    return rows.filter(~F.col("known")).join(flags, _RUN).select(
        "id", F.get("flags", (F.col("place") % RUN).cast("int")).alias("allowed"))


def stretches(counted: DataFrame, span_us: int = DAY_US) -> DataFrame:
    """Rolling counts as requests key, at, id, cap with the `cut` that their stretch begins at and `known`.

    A request with no more than `cap` requests in its span is allowed whatever came before. At an
    instant whose whole span holds only such requests, what is allowed is thus known without the
    past, and a key can be cut: the stretch from there starts with the requests of the span
    before as `known` rows, at most `cap` of them. Each span of time gives a key at most one cut.
    """
    unsure = counted.filter(F.col("in_span") > F.col("cap")).select("key", "at")
    probes = counted.select("key", "at", "probe")
    quiet = counts_in_span(unsure, probes, ["key"], span_us, max(1, span_us // 24), "doubts").filter("doubts = 0")
    slot = F.floor(F.col("at") / span_us)
    cuts = quiet.groupBy("key", slot.alias("slot")).agg(F.min("at").alias("own"))

    # A row per key and span of time: its own cut, the last one before, the one of the next slot.
    slots = counted.select("key", slot.alias("slot")).distinct().join(cuts, ["key", "slot"], "left")
    order = W.partitionBy("key").orderBy("slot")
    following = F.when(F.lead("slot").over(order) == F.col("slot") + 1, F.lead("own").over(order))
    earlier = F.last("own", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    slots = slots.select("key", "slot", "own", F.coalesce(earlier, F.lit(_BEGINNING)).alias("earlier"), following.alias("following"))

    rows = counted.select("key", "at", F.col("probe").alias("id"), "cap", slot.alias("slot")).join(slots, ["key", "slot"])
    here = F.when(F.col("at") >= F.col("own"), F.col("own")).otherwise(F.col("earlier"))
    # A request of the span before a cut is repeated as a known row of the stretch that begins there.
    places = F.filter(F.array(
        F.struct(here.alias("cut"), F.lit(False).alias("known")),
        *[F.struct(F.when((F.col("at") < F.col(c)) & (F.col("at") > F.col(c) - span_us), F.col(c)).alias("cut"), F.lit(True).alias("known"))
          for c in ("own", "following")]), lambda p: p["cut"].isNotNull())
    return rows.select("key", "at", "id", "cap", F.explode(places).alias("p")).select("key", "p.cut", "p.known", "at", "id", "cap")


_BEGINNING = -(1 << 62)


def decide(keyed: DataFrame, span_us: int = DAY_US) -> DataFrame:
    """Allowed or refused, where only allowed requests use up the limit.

    A key that never has more requests in a span than its limit is allowed throughout, which
    rolling counts settle without a fold. Any other key is cut into stretches that are folded
    side by side; a stretch is a sorted stream of times of which a task remembers at most `cap`,
    and it jumps over what it must refuse. A request that no stretch holds is allowed.
    """
    counted = freeze(rolling_counts(keyed, span_us).withColumn("slot", F.floor(F.col("at") / span_us)))
    busy = counted.filter(F.col("in_span") > F.col("cap")).select("key").distinct()
    # Busy keys are looked up by key and span of time, so the requests of one key stay with many tasks.
    slots = counted.select("key", "slot").distinct().join(busy, "key", "left_semi")
    unsure = freeze(counted.join(slots, ["key", "slot"], "left_semi").drop("slot"))
    decided = _folded(stretches(unsure, span_us), span_us)
    allowed = F.coalesce("allowed", F.lit(True))
    return keyed.join(decided, "id", "left").select(
        "id", "key", "at", allowed.alias("allowed"), F.when(~allowed, F.col("message")).alias("message"))
