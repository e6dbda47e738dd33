"""Near-duplicate documents by BagMinHash, with exact multiset checks.

A document is the bag of its five-word shingles, each weighing as often as it occurs. The
weight axis is cut at 1, 2, 4, 8, ...; every shingle has an independent Poisson process on
each part, of a rate equal to its length. A point carries a register and a place inside its
part (the end of the binary descent), and counts for a bag if its place lies below the
shingle's weight. The smallest point of a register is the same in two bags with exactly the
probability of their weighted Jaccard similarity. Points are generated smallest first, and
only up to a bound by which all registers of the bag are filled, so a heavy or long bag
costs little more than one point per shingle.

Signatures are cut into bands. Equal texts are one node. In every bucket of a band each node
is first paired with the bucket's pivot, a linear number of pairs; pairs that the signatures
do not rule out are checked exactly on the whole bags. Links make components. Buckets that
still hold several components are compared block against block across components, the largest
one with the others only: texts
that have a close signature in another component are brought together by block and compared
exactly, and only links that join components are written. So no bucket is capped, no pair is
written that is not a link, and a hot group of copies around one text, or one with some
strays in its buckets, costs linear work, with what belongs to a pivot repeated for every
part of its pairs, so that they spread over tasks. (A group of texts that are all close but not similar enough has to be compared in full.)

Defined cases: a null text equals an empty one; texts without words are only alike if equal;
texts of one to four words are one shingle; repeated rows are copies; a class is named by the
smallest non-null id in it (null if it has none); an empty table gives no rows; further input
columns are ignored by `classes` and kept by `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexspan.llm import textkit as tk
from lexspan.llm.common import landed, query, table

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
# Signatures estimate with a deviation of 0.032 at 0.8; a pair this far below is ruled out.
FLOOR = SIMILAR - 4.5 * (SIMILAR * (1 - SIMILAR) / REGISTERS) ** 0.5
BLOCK_NODES = 1024
PAIRS_AT_ONCE, LABELS_AT_ONCE = 64, 1024  # pairs with whole texts, or with labels, that a pivot sends to one place
_GOLDEN = 0x9E3779B97F4A7C15


def bags(block: tk.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of every distinct shingle of each text, in order of text."""
    found = tk.words(block)
    code, text, _ = tk.windows(found, SHINGLE)
    few = np.flatnonzero((np.diff(found.first) > 0) & (np.diff(found.first) < SHINGLE))
    if len(few):
        short = []
        for t in few:
            value = int(found.first[t + 1] - found.first[t])
            for h in found.hash[found.first[t] : found.first[t + 1]]:
                value = (value * _GOLDEN + int(h)) & 0xFFFFFFFFFFFFFFFF
            short.append(value)
        code, text = np.concatenate([code, tk.mix(np.array(short, np.uint64))]), np.concatenate([text, few])
    order = np.lexsort((code, text))
    code, text = code[order], text[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], code[at], np.diff(np.append(at, len(code)))


def signatures(text: np.ndarray, code: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """A row of REGISTERS 64-bit point names per text; a text without shingles has zeros."""
    out = np.zeros((texts, REGISTERS), dtype=np.uint64)
    # One process per shingle and part of the weight axis: [0, 1), [1, 2), [2, 4), [4, 8), ...
    parts = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    shingle = np.repeat(np.arange(len(code)), parts)
    part = np.arange(len(shingle)) - np.repeat(np.cumsum(parts) - parts, parts)
    low = np.where(part > 0, 1 << np.maximum(part - 1, 0), 0)
    rate = np.maximum(low, 1)
    state = tk.mix(code[shingle] + part.astype(np.uint64) * tk.number(_GOLDEN))
    owner, limit = text[shingle], weight[shingle]
    total = np.bincount(text, weights=weight, minlength=texts)
    todo = np.flatnonzero(total > 0)
    reach = np.zeros(texts)
    reach[todo] = REGISTERS / total[todo] * (np.log(REGISTERS) + 4)
    chosen = np.arange(len(shingle))
    while len(todo):
        best = np.full(texts * REGISTERS, np.inf)
        slots, times, names = [], [], []
        alive, time, step = chosen, np.zeros(len(chosen)), 0
        while len(alive):
            step += 1
            point = tk.mix(state[alive] + tk.number(step * _GOLDEN))
            uniform = ((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(uniform) / rate[alive]
            on = time <= reach[owner[alive]]
            alive, time, point = alive[on], time[on], point[on]
            mark = tk.mix(point ^ tk.number(0xA0761D6478BD642F))
            place = low[alive] + ((mark >> np.uint64(40)).astype(np.int64) * rate[alive] >> 24)
            counts = place < limit[alive]
            register = (mark & np.uint64(0xFFFFFF)).astype(np.int64) * REGISTERS >> 24
            slot = (owner[alive] * REGISTERS + register)[counts]
            np.minimum.at(best, slot, time[counts])
            slots.append(slot), times.append(time[counts]), names.append(point[counts])
        slot, time, name = map(np.concatenate, (slots, times, names))
        won = time == best[slot]
        out.reshape(-1)[slot[won]] = name[won]
        # A text with an empty register is done again with twice the reach.
        filled = np.isfinite(best).reshape(texts, REGISTERS).all(axis=1)
        todo = todo[~filled[todo]]
        again = np.zeros(texts, dtype=bool)
        again[todo] = True
        reach[todo] *= 2
        out[todo] = 0
        chosen = chosen[again[owner[chosen]]]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per text and band."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = tk.mix(key * tk.number(_GOLDEN) + parts[:, :, r])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, block in tk.blocks(batch["text"]):
            text, code, weight = bags(block)
            signature = signatures(text, code, weight, block.texts)
            some = np.bincount(text, minlength=block.texts) > 0
            keys = band_keys(signature)
            sizes = np.where(some, BANDS, 0)
            yield pa.record_batch({
                "doc_id": batch["doc_id"].slice(i, j - i), "key": batch["key"].slice(i, j - i),
                "bands": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(keys[some].reshape(-1))),
                "sig": pa.array([row.tobytes() for row in (signature & np.uint64(0xFFFF)).astype(np.uint16)], pa.binary()),
            })


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def similarity(a: tk.Block, b: tk.Block) -> np.ndarray:
    """Weighted Jaccard similarity of text i of `a` and text i of `b`."""
    (ta, ca, wa), (tb, cb, wb) = bags(a), bags(b)
    text, code = np.concatenate([ta, tb]), np.concatenate([ca, cb])
    left = np.concatenate([wa, np.zeros(len(wb), np.int64)])
    right = np.concatenate([np.zeros(len(wa), np.int64), wb])
    order = np.lexsort((code, text))
    text, code, left, right = text[order], code[order], left[order], right[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    if len(at) == 0:
        return np.zeros(a.texts)
    left, right = np.add.reduceat(left, at), np.add.reduceat(right, at)
    both = np.bincount(text[at], weights=np.minimum(left, right), minlength=a.texts)
    return both / np.maximum(np.bincount(text[at], weights=np.maximum(left, right), minlength=a.texts), 1)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
        close = pa.array((a == b).mean(axis=1) >= FLOOR)
        yield pa.record_batch({"a": batch["a"], "b": batch["b"], "n": batch["n"]}).filter(close)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, a in tk.blocks(batch["text_a"]):
            for k, m, b in tk.blocks(batch["text_b"].slice(i, j - i)):
                part = tk.Block(a.data[a.bounds[k] : a.bounds[m]], a.bounds[k : m + 1] - a.bounds[k])
                alike = similarity(part, b)
                rows = pa.record_batch({"a": batch["a"], "b": batch["b"], "n": batch["n"]}).slice(i + k, m - k)
                yield rows.append_column("similarity", pa.array(alike)).filter(pa.array(alike >= SIMILAR))


def texts_of(keys: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """key, text: one row of each wanted text, a row with the smallest id."""
    wanted = keys.join(nodes.select("key", "doc_id"), "key")
    found = rows.withColumnRenamed("key", "k").withColumnRenamed("doc_id", "d").join(
        wanted, (F.col("k") == F.col("key")) & F.equal_null("d", F.col("doc_id")))
    return landed(found.select("key", "text").dropDuplicates(["key"]), "texts")


def _salted(pairs: DataFrame, at_once: int) -> DataFrame:
    """The pairs with a part of `b`: about `at_once` of the at most `n` pairs of a hot `b` have the same."""
    return pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / at_once)))


def _parts(salted: DataFrame, values: DataFrame) -> DataFrame:
    """b, part and the values of `b` (rows key and others), once for every part of it."""
    wanted = salted.select("b", "part").distinct()
    return wanted.join(values.withColumnRenamed("key", "b"), "b")


def confirmed(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs a, b of text keys, and their n, whose bags have a similarity of SIMILAR or more.

    `pairs` is written and has a, b and a bound n on the pairs of `b`; `nodes` has key, doc_id,
    sig; `rows` has key, doc_id, text. What belongs to a hot `b` is repeated for its parts.
    """
    sig = nodes.select("key", "sig")
    salted = _salted(pairs, PAIRS_AT_ONCE)
    close = (
        salted.join(sig.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a")
        .join(_parts(salted, sig.withColumnRenamed("sig", "sig_b")), ["b", "part"])
        .select("a", "b", "n", "sig_a", "sig_b").mapInArrow(_estimate, "a binary, b binary, n long")
    )
    close = _salted(landed(close, "close"), PAIRS_AT_ONCE)
    texts = texts_of(close.select(F.explode(F.array("a", "b")).alias("key")).distinct(), nodes, rows)
    return (
        close.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
        .join(_parts(close, texts.withColumnRenamed("text", "text_b")), ["b", "part"])
        .select("a", "b", "n", "text_a", "text_b").mapInArrow(_confirm, "a binary, b binary, n long, similarity double")
    )


def components(links: DataFrame) -> DataFrame:
    """key, top: the smallest key of the component of every linked key.

    Each round takes the smallest neighbouring label and then the label's own label; labels
    are written, so no round repeats the ones before. A key with many links, and a label of
    many keys, are joined in parts.
    """
    ends = landed(_salted(links.select("a", "b", "n").union(links.select("b", "a", "n")), LABELS_AT_ONCE).drop("n"), "ends")
    parts = landed(ends.select("b", "part").distinct(), "parts")
    labels = landed(ends.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("top")), "labels")
    while True:
        seen = parts.join(labels.withColumnRenamed("key", "b"), "b")
        near = ends.join(seen, ["b", "part"]).groupBy(F.col("a").alias("key")).agg(F.min("top").alias("near"))
        lower = labels.join(near, "key").select("key", F.col("top").alias("was"), F.least("top", "near").alias("top"))
        lower = landed(lower.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(BANDS))), "lower")
        up = labels.select(F.col("key").alias("top"), F.col("top").alias("over"))
        over = lower.select("top", "part").distinct().join(up, "top")
        jumped = lower.join(over, ["top", "part"], "left").select(
            "key", "was", F.least("top", F.coalesce("over", F.col("top"))).alias("top"))
        moved = landed(jumped, "labels")
        labels = moved.select("key", "top")
        if moved.filter("top <> was").isEmpty():
            return labels


def _pending(data: pa.Table, h: int, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of chunk i, the rows of chunk j it must be compared with in this bucket.

    Those are in another component and close by signature, and have no earlier band in
    common, so that a pair is looked at in one bucket only.
    """
    sig = np.frombuffer(b"".join(data["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
    bands = data["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    top = np.unique(np.array(data["top"].to_pylist(), dtype=object), return_inverse=True)[1]
    chunk = data["chunk"].to_numpy()
    second = np.flatnonzero(chunk == j)
    for x in np.flatnonzero(chunk == i):
        rest = second[second > x] if i == j else second
        rest = rest[top[rest] != top[x]]
        rest = rest[(sig[rest] == sig[x]).mean(axis=1) >= FLOOR]
        if len(rest):
            common = (bands[rest] == bands[x]).argmax(axis=1)
            yield x, rest[bands[x][common] == h]


def _involved(key: tuple, data: pa.Table) -> pa.Table:
    """The rows of a block that have a pair to be checked."""
    data = data.combine_chunks()
    asked = np.zeros(data.num_rows, dtype=bool)
    for x, rest in _pending(data, *(v.as_py() for v in key)):
        asked[rest] = True
        asked[x] |= len(rest) > 0
    return data.filter(pa.array(asked))


def _linked(key: tuple, data: pa.Table) -> pa.Table:
    """Links of one block that join components, by exact comparison of the bags."""
    data = data.combine_chunks()
    parts = [bags(block) for _, _, block in tk.blocks(data["text"])]
    sizes = [block.texts for _, _, block in tk.blocks(data["text"])]
    text = np.concatenate([t + n for (t, _, _), n in zip(parts, np.cumsum([0, *sizes[:-1]]))])
    code, weight = np.concatenate([c for _, c, _ in parts]), np.concatenate([w for _, _, w in parts])
    columns, column = np.unique(code, return_inverse=True)
    first = np.searchsorted(text, np.arange(data.num_rows + 1))
    total = np.bincount(text, weights=weight, minlength=data.num_rows)
    root = {}

    def find(x: object) -> object:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    tops = data["top"].to_pylist()
    mine = np.zeros(len(columns), dtype=np.int64)
    a, b, alike = [], [], []
    for x, rest in _pending(data, *(v.as_py() for v in key)):
        held = slice(first[x], first[x + 1])
        mine[column[held]] = weight[held]
        step = max(1, int(2_000_000 // max(1, (first[rest + 1] - first[rest]).max(initial=1))))
        for k in range(0, len(rest), step):
            some = rest[k : k + step]
            n = first[some + 1] - first[some]
            at = np.repeat(first[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
            both = np.bincount(np.repeat(np.arange(len(some)), n), weights=np.minimum(mine[column[at]], weight[at]), minlength=len(some))
            share = both / np.maximum(total[x] + total[some] - both, 1)
            for y, s in zip(some[share >= SIMILAR], share[share >= SIMILAR]):
                if find(tops[x]) != find(tops[y]):
                    root[find(tops[x])] = find(tops[y])
                    a.append(x), b.append(y), alike.append(s)
        mine[column[held]] = 0
    index = [pa.array(v, pa.int64()) for v in (a, b)]
    return pa.table({"a": data["key"].take(index[0]), "b": data["key"].take(index[1]), "similarity": pa.array(alike, pa.float64())})


def _residual(members: DataFrame, labels: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links across components in buckets of three or more nodes, as many as join them.

    Blocks of signatures say which nodes have a pair to check; only their texts are brought
    together, and no pair is written that is not a link.
    """
    marked = landed(members.filter("n > 2").join(labels, "key", "left").withColumn("top", F.coalesce("top", "key")), "marked")
    sizes = marked.groupBy("h", "top").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    # The largest component of a bucket meets the others, never itself.
    mixed = sizes.groupBy("h").agg(F.max(F.struct("c", "top")).alias("main"), F.max("n").alias("n"), F.count("*").alias("tops")).filter("tops > 1")
    mixed = mixed.select("h", F.col("main.top").alias("main"), F.ceil(F.col("main.c") / BLOCK_NODES).alias("own"),
                         F.ceil((F.col("n") - F.col("main.c")) / BLOCK_NODES).alias("rest"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / LABELS_AT_ONCE) - 1)).alias("part"))
    held = marked.withColumn("part", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / LABELS_AT_ONCE))).join(mixed, ["h", "part"])
    held = held.join(nodes.select("key", "sig", "bands"), "key")
    # Chunks of the main component are numbered first.
    is_main, code, every = F.col("top") == F.col("main"), F.xxhash64("key", F.lit(1)), F.col("own") + F.col("rest")
    held = held.withColumn("chunk", F.when(is_main, F.pmod(code, "own")).otherwise(F.col("own") + F.pmod(code, "rest")))
    other = F.explode(F.sequence(F.when(is_main, F.col("own")).otherwise(0), every - 1))
    held = held.withColumn("other", other).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    held = held.select("h", "i", "j", "chunk", "key", "top", "sig", "bands")
    asked = landed(held.groupBy("h", "i", "j").applyInArrow(_involved, held.schema), "asked")
    texts = texts_of(asked.select("key").distinct(), nodes, rows)
    return asked.join(texts, "key").groupBy("h", "i", "j").applyInArrow(_linked, "a binary, b binary, similarity double")


def _analysed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written rows (doc_id, key) and classes (key, class_key, class_id, class_size) of distinct texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    signed = landed(rows.mapInArrow(_sign, "doc_id long, key binary, bands array<long>, sig binary"), "signed")
    nodes = landed(signed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "nodes")
    banded = nodes.select("key", F.explode("bands").alias("h"))
    pivots = banded.groupBy("h").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).filter("n > 1")
    members = landed(banded.join(pivots, "h"), "members")
    pairs = members.filter("key <> pivot").groupBy(F.col("key").alias("a"), F.col("pivot").alias("b")).agg(F.max("n").alias("n"))
    starred = landed(pairs, "starred")
    links = landed(confirmed(starred, nodes, rows), "links")
    labels = components(links)
    more = landed(_residual(members, labels, nodes, rows), "links")
    if not more.isEmpty():
        links = links.union(more.select("a", "b", F.lit(1).cast("long").alias("n"), "similarity"))
        labels = components(links)
    classed = nodes.select("key", "doc_id", "copies").join(labels, "key", "left").withColumn("top", F.coalesce("top", "key"))
    classed = landed(classed, "classed")
    per = classed.groupBy("top").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count("*").alias("n_links"))
    named = classed.join(per, "top").join(degree, "key", "left").select(
        "key", F.col("top").alias("class_key"), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), "doc_id", "copies")
    return signed.select("doc_id", "key"), named


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_links of every row of doc_id, text.

    `n_links` counts checked links of the row's text to other texts: those that hold the
    class together, not all pairs of it.
    """
    rows, named = _analysed(docs)
    return rows.join(named.drop("doc_id", "class_key", "copies"), "key").select("doc_id", "class_id", "class_size", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns: a text with the smallest id, one row of that text."""
    _, named = _analysed(docs)
    # Of a class: its smallest id, and of several texts with that id the smallest key.
    best = named.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))).alias("b"))
    stays = landed(named.join(best, "class_key").filter(F.col("key") == F.col("b.key")).select("key", F.col("doc_id").alias("id"), "copies"), "stays")
    packed = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("k"))
    kept = packed.join(stays, (F.col("k") == F.col("key")) & F.equal_null(F.col("row.doc_id").cast("long"), F.col("id")))
    # Only a text with copies can still have several rows here.
    single = kept.filter("copies = 1").select("row.*")
    several = kept.filter("copies > 1").groupBy("k").agg(F.min_by("row", F.hash("row")).alias("row")).select("row.*")
    return single.unionByName(several)


@query("op10_bag_minhash")
def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return classes(table(spark, sf_dir, "documents"))
