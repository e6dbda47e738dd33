"""Text to vectors: a pluggable encoder, loaded once per task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lexspan.operators.pool import cell_text

DIM = 384
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_KNOWN_WORDS = 100_000
_BLOCK_CHARS = 1 << 20
# Rows that are encoded at a time.
_ROWS = 512


class Encoder(Protocol):
    """Turns a batch of texts into unit vectors."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Deterministic stand-in without weights: signed hashes of words and letter triples."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = text.lower().split()
            grams = [f" {w} "[j : j + 3] for w in words for j in range(len(w))]
            keys = pd.util.hash_array(np.array(words + grams, dtype=object)) if words else np.array([], dtype=np.uint64)
            np.add.at(out[i], (keys % self.dim).astype(int), np.where((keys >> np.uint64(40)) & np.uint64(1), 1.0, -1.0))
        lengths = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(lengths > 0, lengths, 1.0)


class DigestEncoder:
    """Stand-in without weights that SQL can repeat: signed counts of words at the places their MD5 names."""

    def __init__(self, dim: int = 64, salt: str = ""):
        self.dim, self.salt = dim, salt
        self.known: dict[str, tuple[int, int]] = {}

    def _place(self, word: str) -> tuple[int, int]:
        digest = hashlib.md5((self.salt + word).encode()).digest()
        found = int.from_bytes(digest[:2], "big") % self.dim, 1 if digest[2] < 128 else -1
        if len(self.known) < _KNOWN_WORDS:
            self.known[word] = found
        return found

    def _sums(self, texts: list[str]) -> np.ndarray:
        """Signed counts of some texts; the words are found in their bytes, and each is hashed once."""
        _, offsets, data = pa.array(texts, pa.large_string()).buffers()
        bounds = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        inside = _IN_WORD[raw]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        first = bounds[:-1][bounds[:-1] < len(raw)]
        opens[first] = inside[first]
        start = np.flatnonzero(opens)
        ends = np.append(np.cumsum(inside)[start] - 1, np.count_nonzero(inside))
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw[inside])).dictionary_encode()
        known = self.known.get
        place, sign = np.array([known(w) or self._place(w) for w in words.dictionary.to_pylist()], dtype=np.int64).reshape(-1, 2).T
        code = words.indices.to_numpy()
        text = np.searchsorted(bounds, start, side="right") - 1
        sums = np.bincount(text * self.dim + place[code], weights=sign[code], minlength=len(texts) * self.dim)
        return sums.reshape(len(texts), self.dim)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        begins = np.append(0, np.cumsum([len(t) for t in texts]))
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(begins, begins[i] + _BLOCK_CHARS, side="right")) - 1)
            out[i:j] = self._sums(texts[i:j])
            i = j
        lengths = np.sqrt((out**2).sum(axis=1))
        out[lengths == 0, 0] = 1
        return out / np.where(lengths > 0, lengths, 1)[:, None]


def encode_column(text: Column, load: Callable[[], Encoder]) -> Column:
    """Vector of each text. `load` runs once per task, on the executor."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            vectors = encoder.encode(texts.fillna("").tolist()).astype(np.float32)
            yield pd.Series(list(vectors), index=texts.index)

    return run(text)


# Cells of the comparison by name, as (encoder, representation, text variant).
CELLS = {
    "lemma-ft": ("tuned", "lemma", "lemma"), "lemma-base": ("base", "lemma", "lemma"),
    "gloss-ft": ("tuned", "gloss", "gloss"), "gloss-base": ("base", "gloss", "gloss"),
    "gloss-base-ex": ("base", "gloss", "gloss_examples"), "gloss-base-lem": ("base", "gloss", "lemma_gloss"),
}


def _text(name: str) -> Column:
    _, representation, variant = CELLS[name]
    return F.col("word") if representation == "lemma" else cell_text(F.lit(variant), F.col("word"), F.col("gloss"), F.col("examples"))


def _rows(representation: str, pool: DataFrame, glosses: DataFrame) -> DataFrame:
    return pool.select("*", F.lit("lemma").alias("sense_key")) if representation == "lemma" else glosses


def cell_inputs(name: str, pool: DataFrame, glosses: DataFrame) -> DataFrame:
    """Rows and texts to encode for a named cell. `glosses` carries `row`."""
    return _rows(CELLS[name][1], pool, glosses).select("row", "word", "sense_key", _text(name).alias("text"))


def build_cell(name: str, inputs: DataFrame, encoders: dict[str, Callable[[], Encoder]], sample: int = 0) -> DataFrame:
    """Encode a cell's texts; `sample` limits it to the first rows, for timing only."""
    rows = inputs.orderBy("row").limit(sample) if sample else inputs
    return rows.select(F.lit(name).alias("cell"), "row", "word", "sense_key",
                       encode_column(F.col("text"), encoders[CELLS[name][0]]).alias("vec"))


def _encode_rows(cells: dict[str, tuple[str, str]], encoders: dict[str, Callable[[], Encoder]]):
    """Rows of several cells, which name their encoder and their column of texts. A text that rows or cells share is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {key: encoders[key]() for key in dict.fromkeys(key for key, _ in cells.values())}
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                for key, encoder in loaded.items():
                    columns = list(dict.fromkeys(column for k, column in cells.values() if k == key))
                    places: dict[str, int] = {}
                    # The texts of a row stay together: their words are looked up together.
                    texts = zip(*(part[c].fill_null("").to_pylist() for c in columns))
                    at = np.array([[places.setdefault(t, len(places)) for t in row] for row in texts])
                    vectors = encoder.encode(list(places)).astype(np.float32)
                    ends = pa.array(np.arange(len(part) + 1) * vectors.shape[1], pa.int32())
                    for name, (k, column) in cells.items():
                        if k == key:
                            flat = pa.array(vectors[at[:, columns.index(column)]].ravel())
                            yield pa.record_batch({
                                "cell": pa.array([name] * len(part)), "row": part["row"], "word": part["word"],
                                "sense_key": part["sense_key"], "vec": pa.ListArray.from_arrays(ends, flat)})

    return run


def build_cells(names: list[str], pool: DataFrame, glosses: DataFrame, encoders: dict[str, Callable[[], Encoder]]) -> DataFrame:
    """Several cells as `build_cell` makes them; the rows of a representation are made and sent once for all its cells."""
    parts = []
    for representation in dict.fromkeys(CELLS[n][1] for n in names):
        cells = {n: (CELLS[n][0], CELLS[n][2]) for n in names if CELLS[n][1] == representation}
        texts = {CELLS[n][2]: _text(n).alias(CELLS[n][2]) for n in cells}
        rows = _rows(representation, pool, glosses).select("row", "word", "sense_key", *texts.values())
        schema = T.StructType([T.StructField("cell", T.StringType()), *rows.schema.fields[:3], T.StructField("vec", T.ArrayType(T.FloatType()))])
        parts.append(rows.mapInArrow(_encode_rows(cells, encoders), schema))
    return reduce(DataFrame.unionByName, parts)
