"""Stateful processors for the activity stream.

Rows of a key are applied in time order. Each processor marks a row as `late` and leaves the
state alone if the row is older than the watermark or than what its key has applied before, so
a decision that has been given out is never changed by what arrives after it. State that can
no longer matter is dropped by an event-time timer.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from lexspan.operators import ledger as L
from lexspan.operators.limits import DAY_US, allow

MICROS_PER_DAY = 86_400_000_000


class InTime(StatefulProcessor):
    """Splits the rows of a key into late ones and the rest, in time order; `at` is in microseconds.

    The state of a key is one value: the time of the last row applied, and what the subclass keeps.
    A subclass that says how long its state matters gets a timer per key, which is set again while
    newer rows have come and drops the state otherwise.
    """

    ORDER = ("at", "id")
    GRAIN = 1  # rows of the same grain of time may come in any order
    FIELDS: tuple[StructField, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", StructType([StructField("at", LongType()), *self.FIELDS]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A row per event of one key in one micro-batch, whose size the source's options bound.
        batch = pd.concat(list(rows), ignore_index=True).sort_values(list(self.ORDER), ignore_index=True)
        held = self.state.get()
        seen = held[0] if held else -(1 << 62)
        at = batch["at"].to_numpy()
        late = (at < seen // self.GRAIN * self.GRAIN) | (at < timerValues.getCurrentWatermarkInMs() * 1000)
        if late.any():
            yield self.refused(key, batch[late].reset_index(drop=True))
        if not late.all():
            out, kept = self.apply(key, batch[~late].reset_index(drop=True) if late.any() else batch, held[1:] if held else None)
            last = max(int(at[-1]), seen)
            self.state.update((last, *kept))
            if held is None and self.matters_until(last) is not None:
                self.handle.registerTimer(self.matters_until(last))
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        until = self.matters_until(held[0]) if held else None
        if until is not None and until > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(until)
        else:
            self.clear()
        return iter(())

    def matters_until(self, last: int) -> int | None:
        """The millisecond after which the state no longer matters; None if it always does."""
        return None

    def clear(self) -> None:
        self.state.clear()

    def refused(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def apply(self, key, batch: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """Output for rows in time order, and what to keep."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class RequestLimiter(InTime):
    """Allows a request while fewer than `cap` allowed ones lie in the span before it.

    The times of a key are dropped once the watermark is a span past its last request.
    """

    OUT = "key string, id long, at long, allowed boolean, late boolean"

    def __init__(self, span_us: int = DAY_US):
        self.span_us = span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", StructType([StructField("at", LongType())]))

    def _frame(self, key, batch: pd.DataFrame, allowed, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "id": batch["id"], "at": batch["at"], "allowed": pd.array(allowed, "boolean"), "late": late})

    def refused(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        return self._frame(key, batch, [None] * len(batch), True)

    def apply(self, key, batch: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
        at, caps = batch["at"].to_numpy(), batch["cap"].to_numpy()
        recent = deque(t[0] for t in self.times.get())
        allowed = np.zeros(len(at), dtype=bool)
        starts = np.flatnonzero(np.r_[True, caps[1:] != caps[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(at)]):
            allowed[lo:hi] = allow(at[lo:hi], int(caps[lo]), self.span_us, recent)
        live = [(int(t),) for t in recent if t > at[-1] - self.span_us]
        self.times.put(live) if live else self.times.clear()
        return self._frame(key, batch, allowed, False), ()

    def matters_until(self, last: int) -> int:
        return -(-(last + self.span_us) // 1000)

    def clear(self) -> None:
        super().clear()
        self.times.clear()


class DailyStreak(InTime):
    """Award on the first lookup of a day. A lookup is late if its day is before the last one applied.

    A streak that the next day cannot continue is dropped when the watermark passes that day.
    """

    OUT = "user_id long, id long, day date, streak int, award int, late boolean"
    GRAIN = MICROS_PER_DAY
    FIELDS = (StructField("day", LongType()), StructField("streak", IntegerType()))

    def _frame(self, key, days: np.ndarray, ids, streak, award, late: bool) -> pd.DataFrame:
        dates = pd.to_datetime(pd.Series(days), unit="D").dt.date
        return pd.DataFrame({"user_id": key[0], "id": ids, "day": dates, "streak": pd.array(streak, "Int32"), "award": award, "late": late})

    def refused(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        days = batch["at"].to_numpy() // MICROS_PER_DAY
        return self._frame(key, days, batch["id"], [None] * len(batch), 0, True)

    def apply(self, key, batch: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
        days = batch["at"].to_numpy() // MICROS_PER_DAY
        own, place = np.unique(days, return_inverse=True)
        before, streak = kept or (own[0], 0)
        # A run of following days counts up from the streak it continues, or from one.
        follows = np.r_[kept is not None and own[0] - before <= 1, np.diff(own) == 1]
        heads = np.maximum.accumulate(np.where(follows, 0, np.arange(len(own))))
        length = np.where(follows[0] & (heads == 0), streak + own - before, np.arange(len(own)) - heads + 1).astype(np.int64)
        news = own != before if kept else np.ones(len(own), dtype=bool)
        first = np.r_[True, days[1:] != days[:-1]] & news[place]
        reward = L.DAILY_BASE + np.minimum(L.STREAK_STEP * length, L.STREAK_CAP)
        out = self._frame(key, days, batch["id"], length[place], np.where(first, reward[place], 0), False)
        return out, (int(own[-1]), int(length[-1]))

    def matters_until(self, last: int) -> int:
        return (last // MICROS_PER_DAY + 2) * (MICROS_PER_DAY // 1000)


class CreditLedger(InTime):
    """Running balance; at or below zero it is reset and the event is marked bankrupt.

    A late event comes out unapplied. A balance never expires.
    """

    OUT = "user_id long, id long, kind string, balance long, bankrupt boolean, late boolean"
    ORDER = ("at", "id", "kind")
    FIELDS = (StructField("balance", LongType()),)

    def _frame(self, key, batch: pd.DataFrame, balance, bankrupt, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": key[0], "id": batch["id"], "kind": batch["kind"], "balance": pd.array(balance, "Int64"),
                             "bankrupt": pd.array(bankrupt, "boolean"), "late": late})

    def refused(self, key, batch: pd.DataFrame) -> pd.DataFrame:
        return self._frame(key, batch, [None] * len(batch), [None] * len(batch), True)

    def apply(self, key, batch: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
        after, broke = L.replay(kept[0] if kept else L.START_CREDITS, batch["delta"].to_numpy())
        return self._frame(key, batch, after, broke, False), (int(after[-1]),)


class SavedWords(StatefulProcessor):
    """Is the word saved after the event, and did the event newly save it? Late events come out unapplied.

    A key is a share of all pairs of user and word, and its state one value that holds them packed:
    most pairs have few events, and calls for each of them would cost more than their work. Bits of
    `gaps` tell which of user, word and id are null; an event without a time is late.
    """

    OUT = "user_id long, word_id long, id long, gaps int, saved boolean, newly boolean, late boolean"
    HELD = np.dtype([("gap", "u1"), ("user", "i8"), ("word", "i8"), ("at", "i8"), ("saved", "?")])
    NEVER = -(1 << 62)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("pairs", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch["at"] = batch["at"].fillna(self.NEVER).astype("int64")
        batch["gap"] = batch["gaps"] & 3
        order = np.lexsort([batch[c].to_numpy() for c in ("id", "gaps", "at", "word_id", "user_id", "gap")])
        gap, user, word, at, save = (batch[c].to_numpy()[order] for c in ("gap", "user_id", "word_id", "at", "save"))
        first = np.r_[True, (gap[1:] != gap[:-1]) | (user[1:] != user[:-1]) | (word[1:] != word[:-1])]
        pair, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        value = self.state.get()
        held = np.frombuffer(bytes(value[0]), self.HELD).copy() if value else np.zeros(0, self.HELD)
        mine = np.zeros(len(starts), self.HELD)
        mine["gap"], mine["user"], mine["word"] = gap[starts], user[starts], word[starts]
        mine["at"] = self.NEVER
        place = self._places(held, mine)
        known = place >= 0
        mine[known] = held[place[known]]

        late = (at < mine["at"][pair]) | (at < timerValues.getCurrentWatermarkInMs() * 1000)
        applied = np.flatnonzero(~late)
        of, saved = pair[applied], save[applied]
        turn = of[1:] != of[:-1]
        before = np.where(np.r_[True, turn], mine["saved"][of], np.r_[False, saved[:-1]]) if len(of) else saved
        newly = np.zeros(len(at), dtype=bool)
        newly[applied] = saved & ~before
        if len(of):
            last = np.r_[turn, True]
            mine["at"][of[last]], mine["saved"][of[last]] = at[applied[last]], saved[last]
            held[place[known]] = mine[known]
            self.state.update((np.r_[held, mine[~known & (mine["at"] > self.NEVER)]].tobytes(),))
        out = batch[["user_id", "word_id", "id", "gaps"]].iloc[order].reset_index(drop=True)
        yield out.assign(saved=pd.arrays.BooleanArray(save.astype(bool), late), newly=newly, late=late)

    @staticmethod
    def _places(held: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Where each of these pairs, all different, is held; -1 if it is not."""
        gap, user, word = (np.r_[held[c], mine[c]] for c in ("gap", "user", "word"))
        order = np.lexsort((word, user, gap))
        here, there = order[:-1], order[1:]
        same = (gap[here] == gap[there]) & (user[here] == user[there]) & (word[here] == word[there])
        place = np.full(len(mine), -1)
        place[there[same] - len(held)] = here[same]
        return place

    def close(self) -> None:
        pass
