"""SentencePiece encoding with seeded merge-dropout, and exact decoding.

Text becomes characters with a blank mark in front and for every blank; the agenda then
merges, again and again, the adjacent pair whose joint piece has the best score (leftmost
first). With dropout, a candidate merge is skipped if a hash keyed by seed, text, place and
piece falls under the rate, so every occurrence of a word is cut in its own way and a rerun
gives the same. Characters without a piece become byte pieces, as does a literal blank mark,
so decoding gives back the text exactly. With a rate of 0 this is the model's own encoding.

No piece holds a blank mark after another character, so the agenda of one word never meets
that of the next: words of a block of texts are rows of one matrix per length class and all
advance together, one merge per word and step. Longer runs without a blank are first cut
where two characters stand together in no piece, which no merge can cross; what is still
longer than the widest class uses a heap with the same keys, at a cost of n log n. Encoding is one scan in Arrow batches without a shuffle; the tables
of the vocabulary (fixed size) are read once and travel with the task.

Defined cases: null and empty texts have no ids; equal texts get equal ids; repeated rows
give repeated results; an empty table gives no rows; further input columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lexspan.llm import textkit as tk
from lexspan.llm.common import query, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
_MARK = 0x2581
_WIDTHS = (4, 8, 12, 16, 32, 64)
_LONG = 64
# Bytes of text whose words are merged side by side: the agendas take about a hundred times as much memory.
_BLOCK_BYTES = 1 << 17
_POINTS = 0x110000
_NONE = np.iinfo(np.int32).max
_GOLDEN, _ODD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_M64 = 0xFFFFFFFFFFFFFFFF


@dataclass(frozen=True)
class Vocabulary:
    pieces: list[bytes]  # what each id decodes to, blanks as the mark
    points: np.ndarray  # code points that are pieces, sorted
    point_ids: np.ndarray
    rank: np.ndarray  # 0 is the best score
    bytes_from: np.ndarray  # id of each byte piece
    slots: np.ndarray  # open-addressed table of pairs: key left * size + right, or -1
    joined: np.ndarray  # id of the joint piece
    mark: int
    together: np.ndarray  # pairs of code points next to each other in a piece, sorted

    @property
    def size(self) -> int:
        return len(self.pieces)


def load(path: str = MODEL_PATH) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(len(names))]
    ids = {name: i for i, name in enumerate(names) if not special[i]}
    if any("▁" in name.lstrip("▁") for name in ids):
        raise ValueError("a piece holds a blank mark after another character")
    score = np.array([sp.get_score(i) for i in range(len(names))])
    rank = np.empty(len(names), dtype=np.int32)
    rank[np.lexsort((np.arange(len(names)), -score))] = np.arange(len(names))
    raw = [b"" if special[i] else name.encode() for i, name in enumerate(names)]
    byte_ids = np.full(256, -1, dtype=np.int32)
    for i, name in enumerate(names):
        if sp.is_byte(i):
            byte_ids[int(name[3:5], 16)] = i
            raw[i] = bytes([int(name[3:5], 16)])
    single = sorted((ord(name), i) for name, i in ids.items() if len(name) == 1)
    pairs = [(ids[n[:k]] * len(names) + ids[n[k:]], i) for n, i in ids.items() for k in range(1, len(n)) if n[:k] in ids and n[k:] in ids]
    key, joined = (np.array(v, dtype=np.int64) for v in zip(*pairs))
    slots, values = _table(key, joined)
    together = {ord(a) * _POINTS + ord(b) for n in ids for a, b in zip(n.replace("▁", " "), n.replace("▁", " ")[1:])}
    return Vocabulary(raw, np.array([p for p, _ in single]), np.array([i for _, i in single], np.int32), rank, byte_ids, slots, values, ids["▁"],
                      np.array(sorted(together), dtype=np.int64))


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * tk.number(_GOLDEN)) >> np.uint64(64 - bits)).astype(np.int64)


def _table(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bits = int(np.ceil(np.log2(4 * len(key))))
    slots, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
    at, left = _slot(key, bits), np.arange(len(key))
    while len(left):
        free = left[slots[at[left]] == -1]
        slots[at[free]] = key[free]  # of several, the last one stays
        values[at[free]] = value[free]
        left = left[slots[at[left]] != key[left]]
        at[left] = (at[left] + 1) & ((1 << bits) - 1)
    return slots, values


def _mixed(x: int) -> int:
    """`textkit.mix` of one number."""
    x &= _M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


class Encoder:
    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED):
        self.v, self.seed = vocabulary, seed
        self.bits = int(np.log2(len(vocabulary.slots)))
        # A candidate is skipped if its 53-bit hash is below this.
        self.below = np.uint64(int(dropout * (1 << 53)))
        self.of_point = np.full(0x110000, -1, dtype=np.int32)
        self.of_point[vocabulary.points] = vocabulary.point_ids
        self.of_point[_MARK] = -1
        self.of_point[0x20] = vocabulary.mark
        self.flat = np.frombuffer(b"".join(vocabulary.pieces), np.uint8)
        self.ends = np.cumsum([len(p) for p in vocabulary.pieces])
        self.lengths = np.diff(self.ends, prepend=0)
        self._pairs: dict[int, int] = {}  # the table of joint pieces and the ranks, for the heap
        self._ranks: list[int] = []

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of the joint piece, or -1."""
        key = np.where((left < 0) | (right < 0), -2, left.astype(np.int64) * self.v.size + right)
        at = _slot(key, self.bits)
        out = np.full(len(key), -1, dtype=np.int32)
        found = self.v.slots[at]
        hit = found == key
        out[hit] = self.v.joined[at[hit]]
        open_ = np.flatnonzero(~hit & (found != -1) & (key >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.v.slots) - 1)
            found = self.v.slots[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.v.joined[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def _candidates(self, key: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Joint piece of each pair that is one and that dropout does not skip, else -1."""
        piece = self._join(a, b)
        if self.below:
            at = np.flatnonzero(piece >= 0)
            code = tk.mix(key[at] + left[at].astype(np.uint64) * tk.number(_ODD) + piece[at].astype(np.uint64) * tk.number(_GOLDEN))
            piece[at[(code >> np.uint64(11)) < self.below]] = -1
        return piece

    def _merge(self, symbols: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Run the agenda of every row; -1 - x is a character without piece, _NONE is no symbol."""
        n, width = symbols.shape
        out = symbols
        here = np.arange(n)
        symbols = np.where(symbols == _NONE, -1, symbols)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        piece = np.full((n, width), -1, dtype=np.int32)
        place = np.broadcast_to(np.arange(width - 1), (n, width - 1)).ravel()
        piece[:, :-1] = self._candidates(np.repeat(key, width - 1), place, symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, -1)
        rank = np.where(piece >= 0, self.v.rank[piece], _NONE)
        while len(here):
            best = rank.argmin(axis=1)
            rows = np.flatnonzero(rank[np.arange(len(here)), best] != _NONE)
            if len(rows) < 0.7 * len(here):
                here, symbols, after, before, piece, rank, key = (x[rows] for x in (here, symbols, after, before, piece, rank, key))
                best, rows = best[rows], np.arange(len(rows))
            if len(rows) == 0:
                break
            i = best[rows]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            symbols[rows, i] = piece[rows, i]
            out[here[rows], i] = piece[rows, i]
            out[here[rows], j] = _NONE
            after[rows, i] = k
            rank[rows, j] = _NONE
            inner = k < width
            before[rows[inner], k[inner]] = i[inner]
            # The pairs on both sides of the new symbol.
            outer = h >= 0
            r = np.concatenate([rows, rows[outer]])
            a, b = np.concatenate([i, h[outer]]), np.concatenate([k, i[outer]])
            right = np.where(b < width, symbols[r, np.minimum(b, width - 1)], -1)
            new = self._candidates(key[r], a, symbols[r, a], right)
            piece[r, a] = new
            rank[r, a] = np.where(new >= 0, self.v.rank[new], _NONE)
        return out

    def _agenda(self, symbols: np.ndarray, key: int) -> np.ndarray:
        """The agenda of one word of any length, with a heap of rank and place."""
        if not self._ranks:
            used = self.v.slots >= 0
            self._pairs, self._ranks = dict(zip(self.v.slots[used].tolist(), self.v.joined[used].tolist())), self.v.rank.tolist()
        pairs, size, below, rank_of = self._pairs, self.v.size, int(self.below), self._ranks
        n = len(symbols)
        piece = self._candidates(np.full(n - 1, key, np.uint64), np.arange(n - 1), symbols[:-1], symbols[1:])
        first = np.flatnonzero(piece >= 0)
        heap = ((self.v.rank[piece[first]].astype(np.int64) << 32) + first).tolist()
        heapq.heapify(heap)
        piece, symbols = [*piece.tolist(), -1], symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heapq.heappop(heap)
            a = top & 0xFFFFFFFF
            # What stands there now may be another pair than when it was offered.
            if piece[a] < 0 or rank_of[piece[a]] != top >> 32:
                continue
            b = after[a]
            symbols[a], symbols[b] = piece[a], _NONE
            piece[a] = piece[b] = -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            for left, right in ((before[a], a), (a, after[a])):
                if left < 0 or right >= n:
                    continue
                piece[left] = -1
                if symbols[left] < 0 or symbols[right] < 0:
                    continue
                new = pairs.get(symbols[left] * size + symbols[right], -1)
                if new >= 0 and not (below and _mixed(key + left * _ODD + new * _GOLDEN) >> 11 < below):
                    piece[left] = new
                    heapq.heappush(heap, (rank_of[new] << 32) + left)
        return np.array(symbols)

    def _cut(self, start: np.ndarray, length: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The starts, with long runs cut where no piece holds both neighbours."""
        long = np.flatnonzero(length > _LONG)
        if len(long) == 0:
            return start
        n = length[long] - 1
        at = np.repeat(start[long] + 1 - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair = points[at - 1] * _POINTS + points[at]
        found = np.minimum(np.searchsorted(self.v.together, pair), len(self.v.together) - 1)
        return np.sort(np.concatenate([start, at[self.v.together[found] != pair]]))

    def encode_block(self, block: tk.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, and the bounds of each text in them."""
        points, bounds = tk.chars(block)
        filled = np.diff(bounds) > 0
        points = np.insert(points, bounds[:-1][filled], 0x20).astype(np.int64)
        bounds = bounds + np.append(0, np.cumsum(filled))
        if len(points) == 0:
            return np.zeros(0, np.int32), bounds
        symbols = self.of_point[points].astype(np.int64)
        symbols = np.where(symbols < 0, -1 - points, symbols)
        blank = points == 0x20
        first = np.zeros(len(points), dtype=bool)
        first[bounds[:-1][filled]] = True
        start = np.flatnonzero(first | (blank & ~np.append(False, blank[:-1])))
        start = self._cut(start, np.diff(np.append(start, len(points))), points)
        length = np.diff(np.append(start, len(points)))
        text = np.searchsorted(bounds, start, side="right") - 1
        whole = tk.span_hash(block.data, block.bounds[:-1], block.bounds[1:]) + np.uint64(self.seed)
        key = tk.mix(tk.mix(whole)[text] + (start - bounds[text]).astype(np.uint64) * tk.number(_GOLDEN))
        low = 1
        for width in _WIDTHS:
            rows = np.flatnonzero((length > low) & (length <= width))
            low = width
            if len(rows):
                at = start[rows, None] + np.arange(width)
                inside = np.arange(width) < length[rows, None]
                grid = np.where(inside, symbols[np.minimum(at, len(points) - 1)], _NONE)
                symbols[at[inside]] = self._merge(grid, key[rows])[inside]
        for r in np.flatnonzero(length > low):
            part = slice(start[r], start[r] + length[r])
            symbols[part] = self._agenda(symbols[part], int(key[r]))
        return self._bytes(symbols, bounds)

    def _bytes(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leave out merged places and write characters without a piece as bytes."""
        point = np.where(symbols < 0, -1 - symbols, 0)
        wide = np.where(symbols >= 0, 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000))
        wide[symbols == _NONE] = 0
        ends = np.append(0, np.cumsum(wide))
        ids = np.repeat(symbols, wide)
        missing = np.flatnonzero(symbols < 0)
        if len(missing):
            raw = np.frombuffer("".join(map(chr, point[missing])).encode("utf-8", "surrogatepass"), np.uint8)
            ids[ids < 0] = self.v.bytes_from[raw]
        return ids.astype(np.int32), ends[bounds]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids of one document."""
        n = self.lengths[ids]
        raw = self.flat[np.repeat(self.ends[ids] - n - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] if len(ids) else self.flat[:0]
        # A mark that a piece wrote is a blank; one that byte pieces wrote is itself.
        spelt = np.repeat(np.isin(ids, self.v.bytes_from), n)
        mark = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81) & ~spelt[:-2]) if len(raw) > 2 else np.zeros(0, int)
        keep = np.ones(len(raw), dtype=bool)
        keep[mark + 1] = keep[mark + 2] = False
        raw = raw.copy()
        raw[mark] = 0x20
        return raw[keep][1:].tobytes().decode("utf-8", "surrogatepass")


def _encoder(vocabulary: Vocabulary, dropout: float, seed: int) -> Callable:
    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, dropout, seed)
        for batch in batches:
            for i, j, block in tk.blocks(batch["text"], _BLOCK_BYTES):
                ids, bounds = encoder.encode_block(block)
                columns = {name: batch[name].slice(i, j - i) for name in batch.schema.names}
                yield pa.record_batch({**columns, "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))})

    return encode_all


def encode(docs: DataFrame, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """The rows, which have a column `text` and none called `ids`, with their ids."""
    return docs.mapInArrow(_encoder(vocabulary, dropout, seed), StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def _decoder(vocabulary: Vocabulary) -> Callable:
    def decode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            ids = batch["ids"]
            texts = [encoder.decode(row.values.to_numpy()) if row.is_valid else "" for row in ids]
            yield batch.append_column("decoded", pa.array(texts, pa.string()))

    return decode_all


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with the text of their ids as `decoded`."""
    return encoded.mapInArrow(_decoder(vocabulary), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def _digester(vocabulary: Vocabulary, dropout: float, seed: int) -> Callable:
    encode_all, decode_all = _encoder(vocabulary, dropout, seed), _decoder(vocabulary)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decode_all(encode_all(batches)):
            ids = [row.values.to_numpy() for row in batch["ids"]]
            texts, back = batch["text"].to_pylist(), batch["decoded"].to_pylist()
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                "text_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                "lossless": pa.array([(t or "") == b for t, b in zip(texts, back)], pa.bool_()),
            })

    return digest


@query("op5_pieces")
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One pass in the tasks: ids are encoded, decoded and digested without leaving Python.
    return docs.mapInArrow(_digester(load(), DROPOUT, SEED), "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, lossless boolean")
