"""Credits: events, the order-dependent balance, streaks, leaderboard."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lexspan.session import freeze

START_CREDITS = 100
BANKRUPT_CREDITS = 25
DAILY_BASE, STREAK_STEP, STREAK_CAP = 10, 5, 50
SAVE_CREDITS = 2
SHARE_CREDITS = 3
MIN_BET, MAX_BET = 10, 500
LEADERS = 10
MAX_AWARD = 1e15
ANONYMOUS = "Anonymous"


def valid_bet(bet: Column) -> Column:
    """The bet as a whole number when it lies in the allowed range, else null."""
    n = bet.cast("string").try_cast("double")
    return F.when((n == F.floor(n)) & n.between(MIN_BET, MAX_BET), n.cast("int"))


def settle_events(rounds: DataFrame) -> DataFrame:
    """Net outcome of each round with a valid bet."""
    bet = valid_bet(F.col("bet"))
    return rounds.withColumn("_bet", bet).filter("_bet is not null").select(
        "user_id", "ts", "id", F.lit("round").alias("kind"),
        (F.col("win_amount") - F.col("_bet")).cast("long").alias("delta"),
    )


def award_events(awards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Awards split into accepted ledger events and rejected rows. `awards`: amount as text, reason."""
    amount = F.col("amount").cast("string").try_cast("double")
    # Whole numbers that a double holds exactly; fractions, NaN and infinities are refused.
    whole = (amount > 0) & (amount <= MAX_AWARD) & (amount == F.floor(amount))
    ok = F.coalesce(whole & ~F.isnan(amount), F.lit(False))
    good = awards.filter(ok).select(
        "user_id", "ts", "id", F.lit("award").alias("kind"), amount.cast("long").alias("delta"))
    bad = awards.filter(~ok).select("id", "amount", F.lit("Invalid amount").alias("error"))
    return good, bad


def daily_awards(lookups: DataFrame, zone: str = "UTC") -> DataFrame:
    """First lookup of each day: streak length and award. Days are calendar days of `zone`.

    Lookups shrink to one row per user and day before any window, so a busy user's
    window holds days and not lookups.
    """
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    days = lookups.groupBy("user_id", day.alias("day")).agg(F.min(F.struct("ts", "id")).alias("first"))
    by_day = W.partitionBy("user_id").orderBy("day")
    island = F.date_sub("day", F.row_number().over(by_day))
    runs = days.withColumn("island", island)
    streak = F.row_number().over(W.partitionBy("user_id", "island").orderBy("day"))
    out = runs.withColumn("streak", streak.cast("int"))
    return out.select("user_id", "day", "first.ts", "first.id", "streak", daily_award(F.col("streak")).alias("award"))


def daily_award(streak: Column) -> Column:
    return F.lit(DAILY_BASE) + F.least(streak * STREAK_STEP, F.lit(STREAK_CAP))


def save_transitions(saves: DataFrame, bucket: str = "hour") -> DataFrame:
    """Saves that turn a word from unsaved to saved.

    The action before is looked up inside a time bucket; a bucket's first action looks at
    the last action of the buckets before, so no window holds a busy pair's whole history.
    """
    rows = saves.withColumn("_b", F.date_trunc(bucket, F.col("ts").cast("timestamp")))
    key = ["user_id", "word_id"]
    inside = W.partitionBy(*key, "_b").orderBy("ts", "id")
    rows = rows.withColumn("_prev", F.lag("action").over(inside)).withColumn("_pos", F.row_number().over(inside))
    last = rows.groupBy(*key, "_b").agg(F.max_by("action", F.struct("ts", "id")).alias("_last"))
    carried = last.select(*key, "_b", F.lag("_last").over(W.partitionBy(*key).orderBy("_b")).alias("_carried"))
    joined = rows.join(carried, [*key, "_b"])
    before = F.when(F.col("_pos") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    fresh = (F.col("action") == "save") & F.coalesce(before != "save", F.lit(True))
    return joined.filter(fresh).select(*key, "ts", "id")


def fixed_awards(events: DataFrame, kind: str, amount: int) -> DataFrame:
    return events.select("user_id", "ts", "id", F.lit(kind).alias("kind"), F.lit(amount).cast("long").alias("delta"))


def ledger_events(lookups: DataFrame, saves: DataFrame, shares: DataFrame, rounds: DataFrame, awards: DataFrame) -> DataFrame:
    """All balance changes of all users. Refused awards change nothing."""
    daily = daily_awards(lookups).select(
        "user_id", "ts", "id", F.lit("lookup").alias("kind"), F.col("award").cast("long").alias("delta"))
    return (
        settle_events(rounds).unionByName(daily)
        .unionByName(fixed_awards(save_transitions(saves), "save", SAVE_CREDITS))
        .unionByName(fixed_awards(shares, "share", SHARE_CREDITS))
        .unionByName(award_events(awards)[0])
    )


def replay(start: int, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Balance after each event of one user, and which events were bankruptcies.

    Between resets a balance is a running sum; the next reset is the first place where the sum
    falls low enough, looked for in steps that double, so the work is linear.
    """
    sums = np.cumsum(deltas, dtype=np.int64)
    out, broke = np.empty(len(sums), dtype=np.int64), np.zeros(len(sums), dtype=bool)
    i, balance, base = 0, start, 0
    while i < len(sums):
        at, step, hit = i, 16, False
        while at < len(sums) and not hit:
            low = sums[at : at + step] <= base - balance
            place = int(low.argmax())
            hit = bool(low[place])
            at += place if hit else len(low)
            step *= 2
        out[i:at] = sums[i:at] + (balance - base)
        if hit:
            out[at], broke[at] = BANKRUPT_CREDITS, True
            balance, base = BANKRUPT_CREDITS, int(sums[at])
        i = at + 1
    return out, broke


def balance_map(deltas: np.ndarray, bound: int) -> tuple[list[int], list[int], int, int]:
    """What a run of events does to a starting balance of 1 to `bound`: limits, ends, shift, top.

    Starts up to `limits[i]` (and above the limit before) end at `ends[i]`; starts above `top`
    never go bankrupt and end at start + `shift`. A start goes bankrupt first where the running
    sum first falls that low, and from there on it no longer matters: the end after a reset at
    one place is the end after the next place where the sum has lost BANKRUPT_CREDITS more.
    So there are at most `bound` limits, whatever the number of events.
    """
    sums = np.cumsum(deltas)
    lows = np.minimum.accumulate(sums)
    shift, top = int(sums[-1]), max(0, -int(lows[-1]))
    resets = np.flatnonzero((lows < 0) & (lows < np.r_[0, lows[:-1]]))
    resets = resets[np.r_[True, -lows[resets][:-1] < bound]] if len(resets) else resets
    if len(resets) == 0:
        return [], [], shift, top
    # Ends after a reset, from the last event back. `later` holds places in the order of rising
    # sums, each lower than all between it and the current one.
    ends, height, place = {}, [], []
    values, wanted = sums.tolist(), set(resets.tolist())
    following = {}
    for i in range(len(values) - 1, int(resets[0]) - 1, -1):
        at = bisect.bisect_right(height, values[i] - BANKRUPT_CREDITS)
        following[i] = place[at - 1] if at else -1
        while height and height[-1] >= values[i]:
            height.pop(), place.pop()
        height.append(values[i]), place.append(i)
        ends[i] = ends[following[i]] if following[i] >= 0 else BANKRUPT_CREDITS + shift - values[i]
    limits, out = [], []
    for i in sorted(wanted):
        if out and out[-1] == ends[i]:
            limits[-1] = -values[i]
        else:
            limits.append(-values[i]), out.append(ends[i])
    return limits, out, shift, top


def mapped(start: int, limits: list[int], ends: list[int], shift: int) -> int:
    at = bisect.bisect_left(limits, start)
    return ends[at] if at < len(limits) else start + shift


_EDGE = "part int, user_id long, place int, gains long, limits array<long>, ends array<long>, shift long, top long"


def _edges(bounds: dict[int, int] | None):
    """The first and the last user of a partition: their gains or, with `bounds` (the largest
    balance with which each partition can be entered), their balance maps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: list[np.ndarray] = []
        last: list[np.ndarray] = []
        part = user_first = user_last = None
        for batch in batches:
            if not len(batch):
                continue
            users, deltas = batch["user_id"].to_numpy(), batch["delta"].to_numpy()
            part = int(batch["part"].iat[0])
            if user_first is None:
                user_first = user_last = users[0]
                last = first
            # Only the user carried in and the user carried out of a batch can sit on an edge.
            head = int(np.argmax(users != user_last)) if (users != user_last).any() else len(users)
            last.append(deltas[:head])
            if head < len(users):
                user_last, last = users[-1], [deltas[int(np.argmax(users == users[-1])) :]]
        if part is None:
            return
        rows = []
        for user, place, parts in [(user_first, 0, first)] + ([(user_last, 1, last)] if last is not first else []):
            deltas = np.concatenate(parts)
            gains = int(deltas[deltas > 0].sum())
            # The last user starts here, with a known balance.
            found = ([], [], 0, 0) if bounds is None else balance_map(deltas, bounds[part] if place == 0 else START_CREDITS)
            rows.append((part, user, place, gains, *found))
        yield pd.DataFrame(rows, columns=["part", "user_id", "place", "gains", "limits", "ends", "shift", "top"])

    return run


def _bounds(edges: DataFrame) -> dict[int, int]:
    """The largest balance with which each partition's first user can enter it: a number per partition.

    A reset can lift a balance, but never above BANKRUPT_CREDITS, which is below the start.
    """
    before = W.partitionBy("user_id").orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)
    most = F.coalesce(F.sum("gains").over(before), F.lit(0)) + START_CREDITS
    rows = edges.select("part", "place", most.alias("most")).filter("place = 0").select("part", "most").collect()
    return {r["part"]: r["most"] for r in rows}


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Balances at the entries of partitions, from the maps of each user in turn; one map is held at a time."""
    user, balance = None, START_CREDITS
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            if r.user_id == user:
                rows.append((r.part, user, balance))
            else:
                user, balance = r.user_id, START_CREDITS
            balance = mapped(balance, r.limits, r.ends, r.shift)
        yield pd.DataFrame(rows, columns=["part", "user_id", "balance"])


def _carry(edges: DataFrame) -> dict[int, tuple[int, int]]:
    """User and balance with which a partition is entered, where earlier events exist: a number per partition.

    The maps stay rows of Spark: those of a user are sorted and streamed through one task.
    """
    ordered = edges.repartition("user_id").sortWithinPartitions("user_id", "part", "place")
    rows = ordered.mapInPandas(_chain, "part int, user_id long, balance long").collect()
    return {r["part"]: (r["user_id"], r["balance"]) for r in rows}


def settle(events: DataFrame) -> DataFrame:
    """Balance after every event: add the change, and reset to the bankrupt balance at or below 0.

    Events are sorted by user and time over range partitions, so a busy user spans many
    partitions. One pass adds up the gains of each partition's first and last user, which
    bounds the balance it can be entered with; the next sums up what it does to balances up
    to that bound, and these maps are chained user by user; the last replays with known starts.
    Only a number per partition reaches the driver.
    """
    slots = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["user_id", "ts", "id", "kind"]
    placed = freeze(
        events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "id", "kind", "delta")
        .repartitionByRange(slots, *order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )
    bounds = _bounds(placed.mapInPandas(_edges(None), _EDGE))
    starts = _carry(placed.mapInPandas(_edges(bounds), _EDGE))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, balance = None, START_CREDITS
        for batch in batches:
            if not len(batch):
                continue
            out, broke = np.empty(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=bool)
            users, deltas = batch["user_id"].to_numpy(), batch["delta"].to_numpy()
            heads = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
            for lo, hi in zip(heads, np.r_[heads[1:], len(users)]):
                if users[lo] != user:
                    carried = starts.get(int(batch["part"].iat[0])) if user is None else None
                    user = users[lo]
                    balance = carried[1] if carried is not None and carried[0] == user else START_CREDITS
                out[lo:hi], broke[lo:hi] = replay(balance, deltas[lo:hi])
                balance = int(out[hi - 1])
            yield batch.drop(columns=["part"]).assign(balance=out, bankrupt=broke)

    schema = "user_id long, ts timestamp, id long, kind string, delta long, balance long, bankrupt boolean"
    return placed.mapInPandas(run, schema)


def balances(ledger: DataFrame, users: DataFrame, awards: DataFrame | None = None) -> DataFrame:
    """Credits and streak per user; users without events keep the defaults."""
    last = ledger.groupBy("user_id").agg(
        F.max_by("balance", F.struct("ts", "id", "kind")).alias("credits"), F.count_if("bankrupt").alias("bankruptcies"))
    rows = users.select("user_id").distinct().join(last, "user_id", "left")
    if awards is not None:
        streaks = awards.groupBy("user_id").agg(F.max_by("streak", "day").alias("streak"))
        rows = rows.join(streaks, "user_id", "left")
    else:
        rows = rows.withColumn("streak", F.lit(None).cast("int"))
    return rows.select(
        "user_id", F.coalesce("credits", F.lit(START_CREDITS)).cast("long").alias("credits"),
        F.coalesce("streak", F.lit(0)).alias("streak"), F.coalesce("bankruptcies", F.lit(0)).alias("bankruptcies"))


def leaderboard(credits: DataFrame, names: DataFrame, me: int | None = None, n: int = LEADERS) -> DataFrame:
    """Top n by credits, ties by user. `names`: user_id, username, full_name."""
    top = credits.orderBy(F.desc("credits"), "user_id").limit(n)
    named = top.join(names, "user_id", "left")
    shown = F.coalesce(F.col("username"), F.when(F.col("full_name") != "", F.col("full_name")), F.lit(ANONYMOUS))
    place = F.row_number().over(W.orderBy(F.desc("credits"), "user_id"))
    mine = F.lit(False) if me is None else (F.col("user_id") == me)
    return named.select(place.alias("rank"), "user_id", shown.alias("name"), "credits", mine.alias("is_you"))
