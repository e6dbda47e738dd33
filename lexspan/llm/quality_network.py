"""Quality classifier: random-indexing word vectors, pooled, and a small network.

Every word has a sparse random index vector of a few +1 and -1, drawn from its hash. The
vector of a word is the sum of the index vectors of the words within two places of it, over
all documents. A document is pooled as the mean and the spread of its words' vectors. A
two-layer network, trained in numpy on at most `max_rows` labelled documents outside the
held-out fold, scores it; its logits are divided by a temperature fitted on labelled rows
kept out of the training.

The most frequent words, as many as `vocabulary` allows (whole classes of frequency, so no tie
is broken), have vectors of their own. Of rarer words, which are usually most of the different
words but few of the occurrences, those with equal leading bits of the hash share the sum of
their contexts in one of 2 ** TAIL_BITS rows; none is left out. Words and contexts are counted
over all texts: tasks add up hashes and a table of fixed size, the tables are added by row, and
the sum has that same size whatever the corpus. Training rows are pooled inside the tasks.
Scoring is one scan without a shuffle.

Defined cases: a null text has no words and pools to zeros, and is scored like any other;
with no labelled rows of both classes every score is 0.5; labels of ids that are null or
without a document are not used; repeated rows give repeated results; an empty table gives
no rows; further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexspan.llm import textkit as tk
from lexspan.llm.common import landed, learn_fold, query, table, training_rows

VOCABULARY, TAIL_BITS = 1 << 17, 17
DIMENSIONS, NONZERO, REACH = 64, 4, 2
UNIT = 32767
_FINENESS = 4  # classes of frequency per factor of two
_HELD_WORDS = 1_000_000
_ROWS_AT_ONCE = 16_384
HIDDEN = 32
MAX_ROWS = 4000


@dataclass(frozen=True)
class Vectors:
    """Unit context vectors: of the words in `head`, in order, then of the shared rows."""

    head: np.ndarray  # hashes of the words with a row of their own, sorted
    table: np.ndarray  # whole numbers, UNIT for 1

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        return rows_of(self.head, hashes)


def rows_of(head: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The row of each word: its own, or the one that it shares."""
    shared = len(head) + (hashes >> np.uint64(64 - TAIL_BITS)).astype(np.int64)
    if len(head) == 0:
        return shared
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return np.where(head[at] == hashes, at, shared)


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each word's index vector."""
    code = tk.mix(hashes ^ tk.number(0xA0761D6478BD642F))
    bits = np.stack([code >> np.uint64(16 * k) for k in range(NONZERO)], axis=1).astype(np.int64)
    return bits & (DIMENSIONS - 1), np.where(bits & 0x8000, -1, 1).astype(np.int32)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by word hash, added up over as many words as a task may hold."""
    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(keys.view(np.int64)), "n": pa.array(counts)})

    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for batch in batches:
        for _, _, block in tk.blocks(batch["text"]):
            found, n = np.unique(tk.words(block).hash, return_counts=True)
            keys.append(found), counts.append(n.astype(np.int64))
            if sum(map(len, keys[1:])) > _HELD_WORDS:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                if len(k) > _HELD_WORDS:
                    yield rows(k, c)
                    k, c = k[:0], c[:0]
                keys, counts = [k], [c]
    yield rows(*_summed(np.concatenate(keys), np.concatenate(counts)))


def frequent_words(docs: DataFrame, vocabulary: int = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the most frequent words, at most `vocabulary`, in whole classes of frequency."""
    counts = docs.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    classed = landed(counts.select("word", F.floor(F.log2("n") * _FINENESS).cast("int").alias("frequency")), "words")
    # One row per class: there are 63 x _FINENESS at most.
    sizes = sorted(((r.frequency, r["count"]) for r in classed.groupBy("frequency").count().collect()), reverse=True)
    least, total = None, 0
    for frequency, size in sizes:
        total += size
        if total > vocabulary:
            break
        least = frequency
    if least is None:
        return np.zeros(0, np.uint64)
    words = classed.filter(F.col("frequency") >= least).select("word").toArrow()  # at most `vocabulary` rows
    return np.sort(words["word"].to_numpy().view(np.uint64))


def _packed(table: np.ndarray) -> list[bytes]:
    """The rows of whole numbers in 4, 8 or 32 bits a number, as they need."""
    most = np.abs(table).max(axis=1, initial=0)
    four = (table + 8).astype(np.uint8)
    narrow = [(four[:, ::2] | four[:, 1::2] << 4), table.astype(np.int8), table.astype(np.int32)]
    kind = np.where(most <= 7, 0, np.where(most <= 127, 1, 2))
    return [narrow[k][i].tobytes() for i, k in enumerate(kind.tolist())]


def _unpacked(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), DIMENSIONS), dtype=np.int64)
    lengths = np.array(pc.binary_length(column))
    for length in np.unique(lengths):
        raw = b"".join(column.filter(pa.array(lengths == length)).to_pylist())
        if length == DIMENSIONS // 2:
            pairs = np.frombuffer(raw, np.uint8).reshape(-1, DIMENSIONS // 2)
            rows = np.stack([pairs & 15, pairs >> 4], axis=2).reshape(-1, DIMENSIONS).astype(np.int64) - 8
        else:
            rows = np.frombuffer(raw, np.int8 if length == DIMENSIONS else np.int32).reshape(-1, DIMENSIONS)
        out[lengths == length] = rows
    return out


def _context_adder(head: np.ndarray) -> Callable:
    def add_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of index vectors of neighbours by row, over one task."""
        total = np.zeros((len(head) + (1 << TAIL_BITS)) * DIMENSIONS, dtype=np.int32)
        for batch in batches:
            for _, _, block in tk.blocks(batch["text"]):
                found = tk.words(block)
                start = rows_of(head, found.hash) * DIMENSIONS
                place, sign = index_vectors(found.hash)
                for away in range(1, REACH + 1):
                    near = np.flatnonzero(found.text[:-away] == found.text[away:])
                    for mine, other in ((near, near + away), (near + away, near)):
                        for k in range(NONZERO):
                            np.add.at(total, start[mine] + place[other, k], sign[other, k])
        total = total.reshape(-1, DIMENSIONS)
        used = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(used), _ROWS_AT_ONCE):
            some = used[i : i + _ROWS_AT_ONCE]
            yield pa.record_batch({"row": pa.array(some, pa.int32()), "vec": pa.array(_packed(total[some]), pa.binary())})

    return add_contexts


def _adder_up(rows: int) -> Callable:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add the vectors of each row and scale them to unit length; a task holds one table of fixed size."""
        total = np.zeros(rows * DIMENSIONS, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                at = batch["row"].to_numpy().astype(np.int64)[:, None] * DIMENSIONS + np.arange(DIMENSIONS)
                np.add.at(total, at.ravel(), _unpacked(batch["vec"]).ravel())
        total = total.reshape(rows, DIMENSIONS)
        used = np.flatnonzero(total.any(axis=1))
        for i in range(0, len(used), _ROWS_AT_ONCE):
            some = used[i : i + _ROWS_AT_ONCE]
            x = total[some].astype(np.float64)
            unit = np.rint(x / np.sqrt((x**2).sum(axis=1, keepdims=True)) * UNIT).astype(np.int16)
            bounds = pa.array(np.arange(len(some) + 1) * DIMENSIONS, pa.int32())
            yield pa.record_batch({"row": pa.array(some, pa.int32()), "vec": pa.ListArray.from_arrays(bounds, pa.array(unit.ravel()))})

    return add_up


def word_vectors(docs: DataFrame, vocabulary: int = VOCABULARY) -> Vectors:
    """Unit context vectors from every row of `text`; rows without a context are zero."""
    head = frequent_words(docs, vocabulary)
    rows = len(head) + (1 << TAIL_BITS)
    parts = docs.select("text").mapInArrow(_context_adder(head), "row int, vec binary")
    found = parts.repartition("row").mapInArrow(_adder_up(rows), "row int, vec array<smallint>").toArrow()  # at most `rows` rows
    out = np.zeros((rows, DIMENSIONS), dtype=np.int16)
    if found.num_rows:
        out[found["row"].to_numpy()] = found["vec"].combine_chunks().flatten().to_numpy().reshape(-1, DIMENSIONS)
    return Vectors(head, out)


def pool(block: tk.Block, vectors: Vectors) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text."""
    found = tk.words(block)
    row = vectors.rows(found.hash)
    out = np.zeros((block.texts, 2 * DIMENSIONS))
    for i in range(0, len(row), _ROWS_AT_ONCE):
        x = vectors.table[row[i : i + _ROWS_AT_ONCE]] / UNIT
        text = found.text[i : i + _ROWS_AT_ONCE]
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        out[text[first], :DIMENSIONS] += np.add.reduceat(x, first, axis=0)
        out[text[first], DIMENSIONS:] += np.add.reduceat(x**2, first, axis=0)
    out /= np.maximum(np.diff(found.first), 1)[:, None]
    mean = out[:, :DIMENSIONS]
    out[:, DIMENSIONS:] = np.sqrt(np.maximum(out[:, DIMENSIONS:] - mean**2, 0))
    return out


@dataclass(frozen=True)
class Network:
    vectors: Broadcast
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        x = (pooled - self.centre) / self.scale
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(pooled) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(vectors: Broadcast, pooled: np.ndarray, label: np.ndarray, calibrates: np.ndarray, rounds: int = 400) -> Network:
    """Adam on the whole batch with both classes weighing the same, then the temperature."""
    rng = np.random.default_rng(3)
    inputs = 2 * DIMENSIONS
    centre, scale = np.zeros(inputs), np.ones(inputs)
    p = [rng.normal(0, inputs**-0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    if len(set(label)) < 2:
        return Network(vectors, centre, scale, p[0], p[1], p[2], 0.0)
    if len(set(label[calibrates])) < 2 or len(set(label[~calibrates])) < 2:
        calibrates = np.zeros(len(label), dtype=bool)
    p[2] = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    fits = ~calibrates
    centre, scale = pooled[fits].mean(axis=0), pooled[fits].std(axis=0) + 1e-3
    x, y = (pooled[fits] - centre) / scale, label[fits]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        hidden = np.tanh(x @ p[0] + p[1])
        error = (_sigmoid(hidden @ p[2] + p[3]) - y) * weight
        back = np.outer(error, p[2]) * (1 - hidden**2)
        gradients = [x.T @ back + 1e-4 * p[0], back.sum(axis=0), hidden.T @ error + 1e-4 * p[2], np.array([error.sum()])]
        for i, g in enumerate(gradients):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
            p[i] = p[i] - 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    found = Network(vectors, centre, scale, p[0], p[1], p[2], float(p[3][0]))
    chosen = calibrates if calibrates.any() else fits
    z, y = found.logit(pooled[chosen]), label[chosen]
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 120))
    loss = [-(np.log(_sigmoid(np.where(y == 1, z, -z) / t) + 1e-12)).mean() for t in grid]
    return Network(vectors, centre, scale, p[0], p[1], p[2], float(p[3][0]), float(grid[int(np.argmin(loss))]))


def _pooler(vectors: Broadcast) -> Callable:
    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in tk.blocks(batch["text"]):
                rows = pool(block, vectors.value)
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "label": batch["label"].slice(i, j - i),
                                       "x": pa.array(list(rows), pa.list_(pa.float64()))})

    return pooled


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    # A table of fixed size, sent out once for fitting and scoring.
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    rows = training_rows(docs, labels, max_rows).mapInArrow(_pooler(vectors), "doc_id long, label int, x array<double>").toPandas()
    rows = rows.assign(v=rows.x.map(tuple)).sort_values(["doc_id", "label", "v"])
    pooled = np.array(rows.v.tolist()).reshape(-1, 2 * DIMENSIONS)
    calibrates = tk.mix(rows.doc_id.to_numpy().astype(np.int64).astype(np.uint64)) % np.uint64(5) == 0
    return train(vectors, pooled, rows.label.to_numpy().astype(float), calibrates)


def _scorer(network: Network) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, block in tk.blocks(batch["text"]):
                p = network.probability(pool(block, network.vectors.value))
                yield pa.record_batch({"doc_id": batch["doc_id"].slice(i, j - i), "held_out": batch["held_out"].slice(i, j - i),
                                       "score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))})

    return score


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of doc_id, text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learn_fold(F.col("doc_id"))).alias("held_out"), "text")
    return rows.mapInArrow(_scorer(network), "doc_id long, held_out boolean, score double, predicted int")


@query("op4_quality_network")
def op4_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
