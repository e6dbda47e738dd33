"""Words, lines and hashes of a block of texts as numpy arrays.

A block is the UTF-8 bytes of several texts end to end. Every separator is one ASCII byte,
so word bounds found in bytes are word bounds in characters. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_power = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash base and of its inverse, mod 2 ** 64."""
    global _power, _inverse
    if len(_power) <= n:
        size = max(n + 1, 2 * len(_power))
        for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps)
    return _power, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def number(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Block:
    data: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # text i is data[bounds[i]:bounds[i + 1]]

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1


@dataclass(frozen=True)
class Words:
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # number of the text that holds the word
    hash: np.ndarray
    first: np.ndarray  # words of text i are first[i] to first[i + 1]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Blocks of about `limit` bytes with their row range. A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, Block(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


def words(block: Block) -> Words:
    n = len(block.data)
    inside = ~_IS_SPACE[block.data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[block.bounds] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.searchsorted(block.bounds, start, side="right") - 1
    first = np.searchsorted(start, block.bounds)
    return Words(start, end, text, span_hash(block.data, start, end), first)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    n = len(data)
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, first word) of each run of `width` words inside one text."""
    n = len(found.hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = found.hash[:n].copy()
    for k in range(1, width):
        code = code * number(_BASE) + found.hash[k : n + k]
    whole = np.flatnonzero(found.text[:n] == found.text[width - 1 :])
    return mix(code[whole]), found.text[whole], whole


def chars(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block and the bounds of its texts in code points."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=heads[1:])
    return points, heads[block.bounds]


def per_text(values: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Sum of values by text."""
    return np.bincount(text, weights=values, minlength=texts)
