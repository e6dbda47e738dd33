"""Top-k inside one task: a block of vectors against a block of queries.

Scores of a block come from matrix products of a bounded number of cells, in single precision
where lengths allow it; they only select candidates, with a margin for their rounding. Candidates
are then scored again, left to right in double precision, so equal vectors get equal scores and
ties are settled by the stated keys. Each task keeps k rows per query, whatever the number of
vectors it reads, and as many again that wait to be merged: a merge is paid by the rows that wait,
not by every block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RESCORE = 4096
# Scores that are held at a time, by rows and queries.
_CELLS = 1 << 20
# Rows that wait at least before they are merged.
_WAITING = 4096
# Lengths between which single precision neither overflows nor loses more than the margin.
_SHORTEST, _LONGEST = 1e-10, 1e10


_ODD = np.random.default_rng(7).integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


@dataclass(frozen=True)
class QueryBlock:
    ids: pa.Array
    vectors: np.ndarray
    exclude: pa.Array | None = None
    lists: dict | None = None  # list id -> positions of the queries that probe it
    floor: np.ndarray | None = None  # a similarity that the k-th best is known to reach


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """List column of equal lengths as a two-dimensional double array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if len(np.unique(column.value_lengths().to_numpy(zero_copy_only=False))) > 1:
        raise ValueError("vectors of unequal length")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def sound(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Which rows are vectors of `dim` finite components; the others cannot be scored."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    spoilt = np.bincount(np.repeat(np.arange(len(column)), lengths), weights=bad, minlength=len(column)) > 0
    return (lengths == dim) & ~spoilt


def scorable(table: pa.Table, dim: int) -> pa.Table:
    """Rows whose `vec` can be scored; a block in which no vector has the queries' length is refused."""
    fine = sound(table["vec"], dim)
    if fine.all():
        return table
    lengths = table["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    if not (lengths == dim).any():
        raise ValueError(f"vectors have {lengths[0]} components, queries {dim}")
    return table.filter(pa.array(fine))


def left_to_right(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products, each summed in component order."""
    out = np.empty(len(a))
    for i in range(0, len(a), _RESCORE):
        part = a[i : i + _RESCORE] * b[i : i + _RESCORE]
        out[i : i + _RESCORE] = np.cumsum(part, axis=1)[:, -1] + 0.0
    return out


def _leading(table: pa.Table, keys: list[str], limit: int) -> pa.Table:
    """First `limit` rows of each run of equal keys in a sorted table."""
    n = table.num_rows
    if n == 0:
        return table
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for key in keys:
        col = table[key].combine_chunks()
        differs = pc.not_equal(col.slice(1), col.slice(0, n - 1))
        change[1:] |= differs.to_numpy(zero_copy_only=False)
    start = np.maximum.accumulate(np.where(change, np.arange(n), 0))
    return table.filter(pa.array(np.arange(n) - start < limit))


def _narrow(lengths: np.ndarray) -> bool:
    """Whether vectors of these lengths can be multiplied in single precision."""
    some = lengths[lengths > 0]
    return len(some) == 0 or bool(some.min() >= _SHORTEST and some.max() <= _LONGEST)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of the run of equal keys that each place belongs to, and the starts of all runs; keys are sorted."""
    change = np.ones(len(keys[0]), dtype=bool)
    change[1:] = False
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(change)
    return np.repeat(starts, np.diff(np.r_[starts, len(change)])), starts


class TopK:
    """Running best k rows, or best k words, per query."""

    def __init__(self, queries: QueryBlock, k: int, by_word: bool):
        self.queries, self.k, self.by_word = queries, k, by_word
        self.floor = np.full(len(queries.vectors), -np.inf) if queries.floor is None else queries.floor.copy()
        self.lengths = np.sqrt((queries.vectors**2).sum(axis=1)) if len(queries.vectors) else np.zeros(0)
        self.single = queries.vectors.astype(np.float32) if _narrow(self.lengths) else None
        self.kept: pa.Table | None = None
        self.waiting: list[pa.Table] = []
        self.rows_waiting = 0

    def add(self, table: pa.Table) -> None:
        """`table`: word, sense_key, row, vec and, for list search, list_id; or vec and `rows`, a list of all its word, sense_key, row.

        Rows that are not vectors of the queries' length with finite components take no part;
        `search.unusable` lists them.
        """
        if table.num_rows == 0 or len(self.queries.vectors) == 0:
            return
        table = scorable(table, self.queries.vectors.shape[1])
        if table.num_rows == 0:
            return
        if self.queries.lists is None:
            self._add(*unfolded(table), np.arange(len(self.queries.vectors)))
            return
        ids = table["list_id"].to_numpy()
        for list_id in np.unique(ids):
            probing = self.queries.lists.get(int(list_id))
            if probing is not None:
                some = table.filter(pa.array(ids == list_id))
                self._add(some, matrix(some["vec"]), None, probing)

    def thinned(self, table: pa.Table, x: np.ndarray) -> np.ndarray | None:
        """Of many copies of one vector, only the first k by the tie keys can be returned: their positions."""
        if len(x) <= self.k or self.queries.exclude is not None:
            return None
        x = np.ascontiguousarray(x)
        # Equal vectors have equal marks, so few equal marks mean few copies.
        mark = (x.view(np.uint64) * _ODD[: x.shape[1]] if x.shape[1] <= len(_ODD) else x.view(np.uint64)).sum(axis=1, dtype=np.uint64)
        if np.unique(mark, return_counts=True)[1].max() <= self.k:
            return None
        _, code, count = np.unique(x.view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True, return_counts=True)
        if count.max() <= self.k:
            return None
        keyed = table.append_column("code", pa.array(code)).append_column("at", pa.array(np.arange(len(x))))
        keyed = keyed.select(["code", "word", "sense_key", "row", "at"]).sort_by(
            [(c, "ascending") for c in ("code", "word", "sense_key", "row")])
        if self.by_word:
            keyed = _leading(keyed, ["code", "word"], 1)
        return np.sort(_leading(keyed, ["code"], self.k)["at"].to_numpy())

    def _add(self, table: pa.Table, x: np.ndarray, copies: np.ndarray | None, chosen: np.ndarray) -> None:
        at = self.thinned(table, x) if copies is None else None
        if at is not None:
            table, x = table.take(pa.array(at)), x[at]
        if x.shape[1] != self.queries.vectors.shape[1]:
            raise ValueError(f"vectors have {x.shape[1]} components, queries {self.queries.vectors.shape[1]}")
        lengths = np.sqrt((x**2).sum(axis=1))
        narrow = x.astype(np.float32) if self.single is not None and _narrow(lengths) else None
        step = max(1, _CELLS // len(x))
        for i in range(0, len(chosen), step):
            some = chosen[i : i + step]
            scores = self.queries.vectors[some] @ x.T if narrow is None else self.single[some] @ narrow.T
            self._match(table, x, some, scores, lengths.max(), copies)

    def _match(self, table: pa.Table, x: np.ndarray, chosen: np.ndarray, scores: np.ndarray, longest: float | None = None, copies: np.ndarray | None = None) -> None:
        """The chosen queries against rows `x`; `scores` are their products, `longest` the length of the longest row, if it is known.

        `copies`: how many rows of the table, in turn, have each vector; without it, each has one.
        """
        q = self.queries.vectors[chosen]
        longest = np.sqrt((x**2).sum(axis=1)).max() if longest is None else longest
        if self.queries.exclude is not None:
            # The excluded word must not take one of the k places.
            names = self.queries.exclude.take(pa.array(chosen)).dictionary_encode()
            code = pc.index_in(table["word"].combine_chunks(), value_set=names.dictionary).fill_null(-1).to_numpy()
            mine = names.indices.fill_null(-2).to_numpy()
            scores[mine[:, None] == code[None, :]] = -np.inf
        # Four times the error that a product can have, so the rounding of what it is compared with is covered too.
        margin = (8 * x.shape[1] if scores.dtype == np.float64 else 2 * (x.shape[1] + 4)) * np.finfo(scores.dtype).eps * max(1e-300, longest)
        slack = margin * self.lengths[chosen]

        def reaching(low: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return scores >= (low - slack).astype(scores.dtype)[:, None]

        low = self.floor[chosen]
        able = reaching(low)
        if np.count_nonzero(able) * table.num_rows > 4 * self.k * len(chosen) * len(x):
            # Few rows pass once the running floor is high; until then the block sets its own.
            units, k = scores, self.k
            if copies is not None and not self.by_word:
                k = -(-k // int(copies.min()))  # so many vectors have k rows
            if self.by_word:
                # The first word of each vector will do.
                words = table["word"] if copies is None else table["word"].take(pa.array(np.cumsum(copies) - copies))
                codes = pc.dictionary_encode(words.combine_chunks()).indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
                units = np.maximum.reduceat(scores[:, order], starts, axis=1)
            n = units.shape[1]
            if n > k:
                low = np.maximum(low, np.partition(units, n - k, axis=1)[:, n - k])
                able = reaching(low)
                # k rows or words of this block reach that.
                self.floor[chosen] = np.maximum(self.floor[chosen], low - slack)
        if self.queries.exclude is not None:
            able &= scores > -np.inf
        cols, rows = np.divmod(np.flatnonzero(able), able.shape[1])
        if len(rows) == 0:
            return

        sims = self._exact(x, q, rows, cols)
        reach = sims >= self.floor[chosen[cols]]
        if not reach.any():
            return
        rows, cols, sims = rows[reach], cols[reach], sims[reach]
        if copies is not None:
            of = copies[rows]
            rows, cols, sims = np.repeat((np.cumsum(copies) - copies)[rows] - np.cumsum(of) + of, of) + np.arange(of.sum()), np.repeat(cols, of), np.repeat(sims, of)
        found = table.select(["word", "sense_key", "row"]).take(pa.array(rows))
        found = found.append_column("q", pa.array(chosen[cols].astype(np.int64)))
        found = found.append_column("sim", pa.array(sims))
        self.waiting.append(found)
        self.rows_waiting += len(found)
        if self.rows_waiting >= max(_WAITING, 0 if self.kept is None else len(self.kept)):
            self._merge()

    @staticmethod
    def _exact(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for i in range(0, len(rows), _RESCORE):
            r, c = rows[i : i + _RESCORE], cols[i : i + _RESCORE]
            out[i : i + _RESCORE] = left_to_right(x[r], q[c])
        return out

    def _merge(self) -> None:
        both = pa.concat_tables(self.waiting if self.kept is None else [self.kept, *self.waiting]).combine_chunks()
        self.waiting, self.rows_waiting = [], 0
        if self.by_word:
            both = self._best_of_words(both)
        q, sim = both["q"].to_numpy(), both["sim"].to_numpy()
        order = np.lexsort((-sim, q))
        q, sim = q[order], sim[order]
        start, starts = _groups(q)
        last = start + self.k - 1
        full = last < np.r_[starts[1:], len(q)][np.searchsorted(starts, start)]
        edge = np.where(full, sim[np.minimum(last, len(q) - 1)], -np.inf)
        self.floor[q[full]] = np.maximum(self.floor[q[full]], edge[full])
        keep = sim > edge
        at_edge = np.flatnonzero(sim == edge)
        if len(at_edge):
            # Ties for the last places go by the keys.
            places = self.k - np.add.reduceat(keep.astype(np.int64), starts)[np.searchsorted(starts, start[at_edge])]
            tied = both.take(pa.array(order[at_edge])).append_column("at", pa.array(at_edge)).append_column("places", pa.array(places))
            if len(at_edge) > np.count_nonzero(full[starts]):
                tied = tied.sort_by([(c, "ascending") for c in ("q", "word", "sense_key", "row")])
            first, _ = _groups(tied["q"].to_numpy())
            keep[tied["at"].to_numpy()[np.arange(len(tied)) - first < tied["places"].to_numpy()]] = True
        self.kept = both.take(pa.array(order[keep])).combine_chunks()

    @staticmethod
    def _best_of_words(both: pa.Table) -> pa.Table:
        """The best row of each query and word; ties by sense key and row."""
        q, sim = both["q"].to_numpy(), both["sim"].to_numpy()
        word = pc.dictionary_encode(both["word"].combine_chunks()).indices.to_numpy()
        order = np.lexsort((-sim, word, q))
        start, starts = _groups(q[order], word[order])
        best = order[sim[order] == sim[order][start]]
        if len(best) > len(starts):
            return _leading(both.take(pa.array(best)).sort_by([(c, "ascending") for c in ("q", "word", "sense_key", "row")]), ["q", "word"], 1).combine_chunks()
        return both.take(pa.array(best)).combine_chunks()

    def result(self) -> pa.Table | None:
        if self.waiting:
            self._merge()
        if self.kept is None or self.kept.num_rows == 0:
            return None
        ids = self.queries.ids.take(self.kept["q"].combine_chunks())
        return pa.table({
            "qid": ids, "word": self.kept["word"], "sense_key": self.kept["sense_key"],
            "row": self.kept["row"], "sim": self.kept["sim"],
        })


def unfolded(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray | None]:
    """Rows, vectors, and how many rows have each vector; None if each has one."""
    x = matrix(table["vec"])
    if "rows" not in table.column_names:
        return table, x, None
    folded = table["rows"].combine_chunks()
    copies = folded.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = pa.Table.from_struct_array(folded.flatten())
    return (rows.append_column("vec", table["vec"]), x, None) if (copies == 1).all() else (rows, x, copies)


def add_to_all(tops: list[TopK], table: pa.Table, flags: list[str]) -> None:
    """Rows of a block for several searches of the same queries, each over the rows its flag marks; scored once."""
    queries = tops[0].queries
    if table.num_rows == 0 or len(queries.vectors) == 0:
        return
    table = scorable(table, queries.vectors.shape[1])
    x = matrix(table["vec"]) if table.num_rows else np.zeros((0, queries.vectors.shape[1]))
    parts = []
    for top, flag in zip(tops, flags):
        at = np.flatnonzero(table[flag].to_numpy(zero_copy_only=False))
        mine = table.take(pa.array(at))
        kept = top.thinned(mine, x[at]) if len(at) else None
        parts.append((top, at, mine) if kept is None else (top, at[kept], mine.take(pa.array(kept))))
    needed = np.unique(np.concatenate([at for _, at, _ in parts]))
    if len(needed) == 0:
        return
    place = np.zeros(len(x), dtype=np.int64)
    place[needed] = np.arange(len(needed))
    asked, rows = queries.vectors, x[needed]
    lengths = np.sqrt((rows**2).sum(axis=1))
    if tops[0].single is not None and _narrow(lengths):
        asked, rows = tops[0].single, rows.astype(np.float32)
    step = max(1, _CELLS // len(rows))
    for i in range(0, len(queries.vectors), step):
        chosen = np.arange(i, min(i + step, len(queries.vectors)))
        scores = asked[chosen] @ rows.T
        for top, at, mine in parts:
            if len(at):
                top._match(mine, x[at], chosen, scores[:, place[at]], lengths.max())
