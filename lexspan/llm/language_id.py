"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (1 to 3 letters, words
padded by one blank), most frequent first. A text is ranked the same way and goes to the
language with the smallest out-of-place distance: the sum, over the text's n-grams, of how
far each one's rank is from its rank in the profile, and the profile's size if it is absent.

Profiles are counted in the cluster from all labelled documents outside the held-out fold, so
the learned languages do not depend on the size of the table; each task adds up its own counts
before the shuffle, in bounded memory. Only the profiles (`size` n-grams per language) reach the driver.
Prediction is one scan without a shuffle.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text
if nothing could be learned; equal distances go to the first language in code-point order;
repeated rows give repeated results; an empty table gives no rows; further input columns are
ignored. Null languages are not learned from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import learn_fold, query, table

SIZE = 300
UNKNOWN = "und"
LEAST_SCORE = 0.2
_SHIFT = np.int64(21)  # a code point has at most 21 bits, so three fit a signed 64-bit code
_BLANK = 0x20
_PENDING, _HELD = 1 << 20, 1 << 22  # codes of a task that wait to be counted, and counted ones that it keeps
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Code point to itself if it is a letter, else to a blank."""
    global _letters
    if _letters is None:
        _letters = np.full(0x110000, _BLANK, dtype=np.int64)
        which = np.array([i for i in range(0x110000) if chr(i).isalpha()])
        _letters[which] = which
    return _letters


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of 1 to 3 letters of a text, each as often as it occurs."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    line = np.concatenate([[_BLANK], _letter_table()[points], [_BLANK]])
    blank = line == _BLANK
    line = line[~(blank & np.r_[False, blank[:-1]])]
    if len(line) < 3:
        return np.zeros(0, dtype=np.int64)
    blank = line == _BLANK
    twos = (line[:-1] << _SHIFT) | line[1:]
    threes = ((twos[:-1] << _SHIFT) | line[2:])[~blank[1:-1]]
    return np.concatenate([line[~blank], twos, threes])


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    code, n = np.unique(codes, return_counts=True)
    return code[np.argsort(-n, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each language's n-grams over one task; a code may come more than once."""
    held: dict[str, list[np.ndarray]] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    pending = 0

    def fold() -> None:
        for lang in list(held):
            code, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
            if lang in totals:
                old, counted = totals[lang]
                code, at = np.unique(np.concatenate([old, code]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([counted, n])).astype(np.int64)
            totals[lang] = code, n

    def counts() -> Iterator[pa.RecordBatch]:
        for lang, (code, n) in totals.items():
            yield pa.record_batch({"lang": pa.array([lang] * len(code)), "code": pa.array(code), "n": pa.array(n.astype(np.int64))})
        totals.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            codes = ngrams(text.as_py())
            held.setdefault(lang, []).append(codes)
            pending += len(codes)
            if pending > _PENDING:
                fold()
                pending = 0
                if sum(len(code) for code, _ in totals.values()) > _HELD:
                    yield from counts()
    fold()
    yield from counts()


@dataclass(frozen=True)
class Profiles:
    """Ranks of every profile n-gram: one row per n-gram, one column per language."""

    langs: tuple[str, ...]
    codes: np.ndarray
    ranks: np.ndarray
    size: int

    def nearest(self, text: str | None) -> tuple[str, float]:
        mine = ranked(ngrams(text), self.size)
        if len(mine) == 0 or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, mine), len(self.codes) - 1)
        known = self.codes[at] == mine
        place = np.arange(len(mine))[:, None]
        off = np.where(known[:, None], np.abs(self.ranks[at] - place), self.size)
        # Absent n-grams have rank `size` in the table; their distance is always the maximum.
        off = np.where(known[:, None] & (self.ranks[at] >= self.size), self.size, off)
        distance = off.sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], 1.0 - float(distance[best]) / (self.size * len(mine))


def learn(docs: DataFrame, size: int = SIZE) -> Profiles:
    """Profiles from all rows doc_id, text, lang whose id is outside the held-out fold."""
    able = docs.filter(F.col("lang").isNotNull() & learn_fold(F.col("doc_id")))
    counted = able.select("lang", "text").mapInArrow(_count, "lang string, code long, n long")
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))
    # `size` rows per language; the filter lets each task drop the others before the window's shuffle.
    top = total.withColumn("place", place).filter(F.col("place") <= size).select("lang", "code", (F.col("place") - 1).alias("rank")).toArrow()
    lang, code, rank_of = (np.asarray(top[c].to_pylist()) for c in ("lang", "code", "rank"))
    langs = tuple(sorted(set(lang.tolist())))
    codes = np.unique(code.astype(np.int64)) if len(code) else np.zeros(0, np.int64)
    ranks = np.full((len(codes), len(langs)), size)
    for i, name in enumerate(langs):
        mine = lang == name
        ranks[np.searchsorted(codes, code[mine]), i] = rank_of[mine]
    return Profiles(langs, codes, ranks, size)


def _predictor(profiles: Profiles) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text.as_py()) for text in batch["text"]]
            yield pa.record_batch({
                **{name: batch[name] for name in batch.schema.names if name != "text"},
                "lang_pred": pa.array([lang for lang, _ in found], pa.string()),
                "score": pa.array([score for _, score in found], pa.float64()),
            })

    return predict


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learn_fold(F.col("doc_id"))).alias("held_out"), "text")
    return rows.mapInArrow(_predictor(profiles), "doc_id long, held_out boolean, lang_pred string, score double")


def _keeper(profiles: Profiles, least: float) -> Callable:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text.as_py()) for text in batch["text"]]
            at = batch.schema.names.index("lang")
            named = batch.set_column(at, batch.schema.field(at), pa.array([lang for lang, _ in found], batch.schema.field(at).type))
            yield named.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return keep


def keep_known(docs: DataFrame, profiles: Profiles, least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is known with a score of `least` or more; `lang` becomes it."""
    return docs.mapInArrow(_keeper(profiles, least), docs.schema)


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs.select("doc_id", "text", "lang")))
