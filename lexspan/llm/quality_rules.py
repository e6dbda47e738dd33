"""Quality rules: base counts and a hashed n-gram logistic regression.

The base rules count words, symbols, repeated lines and repeated three-word windows. The
model is a logistic regression over hashed word n-grams (1 and 2) and character n-grams
(2 and 4), each group as relative frequencies, trained on labelled quality rows and
calibrated (Platt) on labelled rows kept out of the fit. Texts are scored in Arrow batches,
block by block, against fixed thresholds.

Only the training rows are a sample: at most `max_rows` labelled documents, whole texts,
turned into sparse features inside the tasks; the model has a fixed size. Scoring is one
scan without a shuffle.

Defined cases: a null text has no words; a text without words has every count 0 and fails
the base rules; with no labelled rows of both classes the model gives 0.5 to every text;
repeated rows and ids give repeated results; a null label is not used; an empty table gives
no rows; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.llm import textkit as tk
from lexspan.llm.common import query, table, training_rows

BITS = 15
BINS = 1 << BITS
MAX_ROWS = 2500
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
KEEP_FROM = 0.5
SYMBOLS = "#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))


def counts(block: tk.Block, found: tk.Words) -> dict[str, np.ndarray]:
    """Base counts of each text of a block."""
    texts, data = block.texts, block.data
    heads = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    symbols = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(_IS_SYMBOL[data], out=symbols[1:])
    out = {
        "n_words": np.diff(found.first),
        "word_chars": tk.per_text(heads[found.end] - heads[found.start], found.text, texts),
        "n_symbols": np.diff(symbols[block.bounds]),
        "n_dup_lines": _repeated_lines(block, found),
        "n_repeat_words": _repeated_words(found, texts),
    }
    return {name: values.astype(np.int64) for name, values in out.items()}


def _repeats(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of (text, code), and whether each sorted place equals the one before it."""
    order = np.lexsort((np.arange(len(code)), code, text))
    same = np.zeros(len(code), dtype=bool)
    same[1:] = (code[order][1:] == code[order][:-1]) & (text[order][1:] == text[order][:-1])
    return order, same


def _repeated_lines(block: tk.Block, found: tk.Words) -> np.ndarray:
    breaks = np.flatnonzero(block.data == 10)
    start = np.unique(np.concatenate([block.bounds[:-1], breaks + 1]))
    start = start[start < len(block.data)]
    stop = np.append(start[1:], len(block.data))
    ends_in_break = np.zeros(len(start), dtype=bool)
    if len(start):
        ends_in_break = (stop > start) & (block.data[stop - 1] == 10)
    end = stop - ends_in_break
    with_word = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end = start[with_word], end[with_word]
    text = np.searchsorted(block.bounds, start, side="right") - 1
    order, same = _repeats(tk.span_hash(block.data, start, end), text)
    return tk.per_text(same, text[order], block.texts)


def _repeated_words(found: tk.Words, texts: int) -> np.ndarray:
    """Words that lie in a three-word window which the text has twice or more."""
    code, text, at = tk.windows(found, 3)
    order, same = _repeats(code, text)
    again = same.copy()
    again[:-1] |= same[1:]
    covered = np.zeros(len(found.start) + 3, dtype=bool)
    for k in range(3):
        covered[at[order[again]] + k] = True
    return tk.per_text(covered[: len(found.start)], found.text, texts)


def grams(block: tk.Block, found: tk.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bin, text) of every word n-gram, then of every character n-gram."""
    shift = np.uint64(64 - BITS)
    pairs, pair_text, _ = tk.windows(found, 2)
    word = (np.concatenate([found.hash >> shift, pairs >> shift]).astype(np.int64), np.concatenate([found.text, pair_text]))
    points, bounds = tk.chars(block)
    text = np.repeat(np.arange(block.texts), np.diff(bounds))
    code = points.astype(np.uint64) * tk.number(0xD6E8FEB86659FD93)
    codes, texts = [], []
    for width in (2, 4):
        n = len(code) - width + 1
        if n <= 0:
            continue
        gram = code[:n] * np.uint64(width)
        for k in range(1, width):
            gram = gram * tk.number(0xA0761D6478BD642F) + code[k : n + k]
        whole = text[:n] == text[width - 1 :]
        codes.append((tk.mix(gram)[whole] >> shift).astype(np.int64))
        texts.append(text[:n][whole])
    none = np.zeros(0, np.int64)
    char = (np.concatenate(codes) if codes else none, np.concatenate(texts) if texts else none)
    return [word, char]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # one per bin, the word bins first
    bias: float
    slope: float  # calibration
    offset: float

    def probability(self, block: tk.Block, found: tk.Words) -> np.ndarray:
        total = np.full(block.texts, self.bias)
        for group, (bins, text) in enumerate(grams(block, found)):
            size = np.maximum(np.bincount(text, minlength=block.texts), 1)
            total += tk.per_text(self.weights[group * BINS + bins], text, block.texts) / size
        return _sigmoid(self.slope * total + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse relative frequencies of whole texts: doc_id, label, bins, values."""
    for batch in batches:
        for i, j, block in tk.blocks(batch["text"]):
            rows = [[] for _ in range(block.texts)]
            for group, (bins, text) in enumerate(grams(block, tk.words(block))):
                key, n = np.unique(text * BINS + bins, return_counts=True)
                size = np.bincount(text, minlength=block.texts)
                cut = np.searchsorted(key, np.arange(block.texts + 1) * BINS)
                for r in range(block.texts):
                    part = slice(cut[r], cut[r + 1])
                    rows[r].append((key[part] - r * BINS + group * BINS, n[part] / max(size[r], 1)))
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(i, j - i), "label": batch["label"].slice(i, j - i),
                "bins": pa.array([np.concatenate([b for b, _ in row]).astype(np.int32) for row in rows], pa.list_(pa.int32())),
                "values": pa.array([np.concatenate([v for _, v in row]).astype(np.float32) for row in rows], pa.list_(pa.float32())),
            })


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, rounds: int = 150) -> Model:
    """Train on labelled rows; every fifth of them, by hash, calibrates instead."""
    rows = training_rows(docs, labels, max_rows).mapInArrow(
        _featurise, "doc_id long, label int, bins array<int>, values array<float>").toArrow().sort_by("doc_id")
    label = rows["label"].to_numpy().astype(float)
    neutral = Model(np.zeros(2 * BINS), 0.0, 1.0, 0.0)
    if len(set(label)) < 2:
        return neutral
    bins = rows["bins"].combine_chunks()
    size = np.asarray(bins.value_lengths().fill_null(0))
    column, value = bins.flatten().to_numpy(), rows["values"].combine_chunks().flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(len(label)), size)
    calibrates = tk.mix(rows["doc_id"].to_numpy().astype(np.uint64)) % np.uint64(5) == 0
    if len(set(label[calibrates])) < 2 or len(set(label[~calibrates])) < 2:
        calibrates = np.zeros(len(label), dtype=bool)
    rate = label[~calibrates].mean()
    weight = np.where(label == 1, 0.5 / rate, 0.5 / (1 - rate)) * ~calibrates
    weight /= weight.sum()
    # Adam with features scaled by their root mean square, so that rare n-grams can count.
    scale = 1 / np.sqrt(np.bincount(column, weights=value**2, minlength=2 * BINS) / len(label) + 1e-6)
    w, bias = np.zeros(2 * BINS), 0.0
    m, v = np.zeros(2 * BINS + 1), np.zeros(2 * BINS + 1)
    scaled = value * scale[column]
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[column] * scaled, minlength=len(label)) + bias
        error = (_sigmoid(z) - label) * weight
        gradient = np.append(np.bincount(column, weights=scaled * error[row], minlength=2 * BINS) + 1e-4 * w, error.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        step = 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        bias -= step[-1]
    z = np.bincount(row, weights=w[column] * scaled, minlength=len(label)) + bias
    chosen = calibrates if calibrates.any() else np.ones(len(label), dtype=bool)
    slope, offset = platt(z[chosen], label[chosen])
    return Model(w * scale, bias, slope, offset)


def platt(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrated logit, by Newton steps with softened labels."""
    yes, no = label.sum(), len(label) - label.sum()
    goal = np.where(label == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.column_stack([z, np.ones(len(z))])
    a = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ a)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, x.T @ (p - goal))
        a = a - np.clip(step, -2, 2)
    return float(max(a[0], 1e-3)), float(a[1])


def _scorer(model: Model, keep_from: float) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in tk.blocks(batch["text"]):
                found = tk.words(block)
                n = counts(block, found)
                p = model.probability(block, found)
                failed = (n["n_words"] < LEAST_WORDS) | (100 * n["n_repeat_words"] > MOST_REPEATED_PERCENT * n["n_words"])
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(i, j - i), **{k: pa.array(v) for k, v in n.items()},
                    "base_failed": pa.array(failed), "kept": pa.array(~failed & (p >= keep_from)), "score": pa.array(p),
                })

    return score


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """Base counts, verdict and score of every row of doc_id, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(model, keep_from), SCHEMA)


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the model's verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
