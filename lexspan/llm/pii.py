"""Personal data: base formats, and boosted trees over candidates of wider formats.

Generators with high recall propose spans that may overlap: written-out and plain addresses,
digit groups of any shape, network addresses, account numbers. Gradient-boosted trees score
each candidate from its format (digits, groups, separators, checksums) and its context
(neighbouring characters and words, other personal data near by). A threshold per kind,
calibrated on documents kept out of the fit for a stated precision, selects spans. Base
spans are always kept; a selected candidate is added if it overlaps no base span, and of
overlapping candidates the best stays.

Nobody has marked spans, so the trees learn from the base formats: candidates inside base
spans are positive, other candidates negative, and every base span is also rewritten, in its
own context, into other ways to write the same thing (positive) and into dates, amounts and
book numbers with its digits (negative). A scan of all documents chooses at most `per_kind`
documents with each base kind, and twice as many without any, by hash; candidates, not texts,
reach the driver. A quarter of all documents is kept out of that, and the thresholds come from
counts over the whole quarter. Finding is one scan without a shuffle.

Defined cases: a null text is empty; equal starts are ordered by kind as listed; repeated
rows give repeated results; with too few positive candidates to learn from nothing is added;
an empty table gives no rows; further input columns are ignored by `find` and kept by
`redact`.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from lexspan.llm.common import query, table

BASE = ("email", "ip", "card", "phone")
PER_KIND = 1000
_SCORES = 4096  # steps of the scores that are counted for a threshold
PRECISION = 0.98
ROUNDS, DEPTH, BINS = 60, 3, 16
_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is entered at its first digit or not at all: the look-behind changes no match.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

# Wider kinds and the base kind whose meaning they share.
WIDER = {
    "wide_email": (re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|[\[(]\x20?at\x20?[\])]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,63}){1,4}"), "email"),
    "wide_ip": (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?[.,]\x20?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"), "ip"),
    "wide_card": (re.compile(r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){12,18}(?![0-9])"), "card"),
    "wide_phone": (re.compile(r"(?<![0-9])(?:\+|00|\()?[0-9](?:[\x20().\/-]{0,2}[0-9]){8,14}(?![0-9])"), "phone"),
}
KINDS = (*BASE, *WIDER)
_HINTS = re.compile(r"(?i)mail|phone|tel|call|mobile|fax|card|visa|pay|account|ip|host|server|address|contact|@")
_ODD = re.compile(r"(?i)version|page|isbn|order|date|year|total|section|figure|number of|id\b")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(_DIGIT.findall(span))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base formats, in order of start, then of kind."""
    found = []
    if "@" in text:
        last = 0
        for m in _TAIL.finditer(text):
            # The tail is found first; the part before the sign is the run that ends at it.
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                last = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(s, BASE[k], e) for s, k, e in sorted(found)]


def candidates(text: str) -> list[tuple[int, str, int]]:
    """Spans of the wider formats; kinds may overlap each other and base spans."""
    digits = bool(_DIGIT.search(text))
    out = []
    for kind, (pattern, _) in WIDER.items():
        if kind == "wide_email":
            if "@" not in text and " at " not in text and "(at" not in text and "[at" not in text and "( at" not in text and "[ at" not in text:
                continue
        elif not digits:
            continue
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return out


class Overlaps:
    """Whether spans overlap any of a fixed set, by bisection."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        order = sorted((s, e) for s, _, e in spans)
        self.starts = [s for s, _ in order]
        self.ends = list(accumulate((e for _, e in order), max))

    def any(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def crowd(spans: list[tuple[int, str, int]]) -> list[int]:
    """Of each span, how many others begin less than 60 characters away."""
    starts = np.sort([s for s, _, _ in spans])
    return [int(np.searchsorted(starts, s + 60) - np.searchsorted(starts, s - 59)) - 1 for s, _, _ in spans]


def features(text: str, span: tuple[int, str, int], near: int) -> list[float]:
    """Format and context of a candidate; `near` is the number of other candidates close by."""
    start, kind, end = span
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = _digits(s)
    groups = re.findall("[0-9]+", s)
    parts = [min(int(g), 1000) if len(g) < 5 else 1000 for g in groups]
    letters = sum(c.isalpha() for c in s)
    return [
        list(WIDER).index(kind), len(s), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        letters, s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("@"), s.startswith("+") or before.endswith("+"),
        bool(digits) and luhn(digits), max(parts, default=-1), len(set(digits)), s.count("."),
        bool(re.search(r"[\[(]\x20?(?:at|dot)", s)), " at " in s, bool(re.search(r"\.[a-z]{2,6}$", s)), bool(re.search(r"(?:dot|\])\x20?\)?\x20?[a-z]{2,4}$", s)),
        bool(before) and not before[-1].isspace(), bool(after) and not after[0].isspace(), before[-1:] in ".-/:=#$", after[:1] in "/-:%",
        bool(re.search(r"(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}", s)), s.startswith(("978", "979")),
        len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0, s.startswith(("00", "(")), len(groups) > 2 and len(set(map(len, groups[1:]))) == 1,
        bool(_HINTS.search(before)), bool(_ODD.search(before)), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), min(near, 5),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of a fixed depth over binned features, stored as complete binary trees."""

    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    start: float = 0.0
    threshold: dict = field(default_factory=dict)  # per kind; a kind without one is not selected

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.binned(x), np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            z += leaf[_route(b, feature, cut) - (1 << DEPTH) + 1]
        return 1 / (1 + np.exp(-z))


def _route(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    at = np.zeros(len(b), dtype=np.int64)
    rows = np.arange(len(b))
    for _ in range(DEPTH):
        at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
    return at


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting with second-order gains on histograms."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model = Trees(edges, [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    b = model.binned(x)
    z = np.full(len(y), model.start)
    inner = (1 << DEPTH) - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best = 1e-6
            for f in range(x.shape[1]):
                left_g = np.cumsum(np.bincount(b[rows, f], weights=g[rows], minlength=BINS))[:-1]
                left_h = np.cumsum(np.bincount(b[rows, f], weights=h[rows], minlength=BINS))[:-1]
                all_g, all_h = g[rows].sum(), h[rows].sum()
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                gain[(left_h < 0.05) | (all_h - left_h < 0.05)] = 0
                if len(gain) and gain.max() > best:
                    best, feature[node], cut[node] = gain.max(), f, int(gain.argmax())
            at[rows] = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        place = at - inner
        leaf = 0.3 * np.bincount(place, weights=g, minlength=inner + 1) / (np.bincount(place, weights=h, minlength=inner + 1) + 1)
        z += leaf[place]
        model.trees.append((feature, cut, leaf))
    return model


def rewritten(kind: str, value: str) -> list[str]:
    """Other ways to write the value of a base span."""
    digits = _digits(value)
    if kind == "email":
        # With its digits, and with letters instead.
        named = [v.partition("@")[::2] for v in (value, re.sub("[0-9]", lambda m: "abcdefghij"[int(m[0])], value))]
        return [form for local, host in named for form in (
            f"{local} [at] {host.replace('.', ' [dot] ')}", f"{local} (at) {host}", f"{local}(at){host.replace('.', '(dot)')}", f"{local} @ {host}")]
    if kind == "phone":
        d = digits[-10:]
        return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:-10]} {d[:3]} {d[3:6]} {d[6:]}"]
    if kind == "card":
        return [".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), " - ".join(digits[i : i + 4] for i in range(0, len(digits), 4))]
    return [value.replace(".", " . "), value.replace(".", ", ")]


def ordinary(value: str) -> list[str]:
    """Texts with the digits of a base span that are no personal data."""
    d = (_digits(value) * 16)[:16]
    year, month, day = f"20{d[2:4]}", f"{int(d[4:6]) % 12 + 1:02}", f"{int(d[6:8]) % 28 + 1:02}"
    clock = f"{int(d[8:10]) % 24:02}:{int(d[10:12]) % 60:02}"
    return [f"{year}-{month}-{day} {clock}", f"{day}.{month}.{year} {clock}", f"{year}/{month}/{day} {day}", f"{d[0]},{d[1:4]},{d[4:7]},{d[7:10]}",
            f"{d[0:2]} {d[2:5]} {d[5:8]} {d[8:11]}", f"978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}", f"{year}-{int(year) + 5} {day} {month}",
            f"{year}{month}{day}{d[8:12]}", f"{d[0]}.{d[1:4]}.{d[4:7]}.{d[7:10]}.{d[10:13]}"]


def _examples(text: str) -> Iterator[tuple[list[float], int]]:
    """Features and label of every candidate of a text and of its rewritten base spans."""
    base = base_spans(text)

    found, inside = candidates(text), Overlaps(base)
    same = {k: Overlaps([b for b in base if b[1] == k]) for k in BASE}
    for c, near in zip(found, crowd(found)):
        matches = same[WIDER[c[1]][1]].any(c[0], c[2])
        if matches or not inside.any(c[0], c[2]):
            yield features(text, c, near), int(matches)
    for s, kind, e in base:
        for form in rewritten(kind, text[s:e]):
            changed = text[max(0, s - 80) : s] + form + text[e : e + 80]
            start, end = min(s, 80), min(s, 80) + len(form)
            spans = candidates(changed)
            for c, near in zip(spans, crowd(spans)):
                if WIDER[c[1]][1] == kind and c[0] < end and start < c[2]:
                    yield features(changed, c, near), 1
        for form in ordinary(text[s:e]) if _digits(text[s:e]) else ():
            changed = text[max(0, s - 80) : s] + form + text[e : e + 80]
            start, end = min(s, 80), min(s, 80) + len(form)
            spans, plain = candidates(changed), base_spans(changed)
            for c, near in zip(spans, crowd(spans)):
                if c[0] < end and start < c[2] and not any(b[0] < c[2] and c[0] < b[2] for b in plain):
                    yield features(changed, c, near), 0


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, x, y = [], [], []
        for text in batch["text"]:
            value = text.as_py() or ""
            for row, label in _examples(value):
                key.append(zlib.crc32(value.encode("utf-8", "replace")))
                x.append([float(v) for v in row])
                y.append(label)
        yield pa.record_batch({"key": pa.array(key, pa.int64()), "x": pa.array(x, pa.list_(pa.float64())), "y": pa.array(y, pa.int32())})


def _chooser(per_kind: int) -> Callable:
    most = {**dict.fromkeys(BASE, per_kind), "": 2 * per_kind}

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The smallest hashes of one task's documents with each base kind, and without any ("")."""
        held: dict[str, set[int]] = {kind: set() for kind in most}
        for batch in batches:
            for h, text in zip(batch["h"].to_pylist(), batch["text"]):
                for kind in {k for _, k, _ in base_spans(text.as_py())} or {""}:
                    held[kind].add(h)
            for kind, n in most.items():
                if len(held[kind]) > n:
                    held[kind] = set(sorted(held[kind])[:n])
        for kind, hashes in held.items():
            yield pa.record_batch({"kind": pa.array([kind] * len(hashes), pa.string()), "h": pa.array(sorted(hashes), pa.int64())})

    return choose


def _score_counts(model: Trees) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Examples, and positive ones, by wider kind and step of the score, over one task."""
        seen = np.zeros((2, len(WIDER) * _SCORES), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                found = list(_examples(text.as_py()))
                if found:
                    x = np.array([row for row, _ in found], dtype=float)
                    step = np.minimum((model.score(x) * _SCORES).astype(np.int64), _SCORES - 1)
                    at = x[:, 0].astype(np.int64) * _SCORES + step
                    np.add.at(seen[0], at, 1)
                    np.add.at(seen[1], at, [label for _, label in found])
        used = np.flatnonzero(seen[0])
        yield pa.record_batch({"kind": pa.array(used // _SCORES), "step": pa.array(used % _SCORES), "n": pa.array(seen[0, used]), "positive": pa.array(seen[1, used])})

    return count


def learn(docs: DataFrame, per_kind: int = PER_KIND, precision: float = PRECISION) -> Trees:
    """Fit trees on chosen documents with a digit or an at sign, and thresholds on all that are kept out."""
    able = docs.filter(F.col("text").rlike("[0-9@]")).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    kept_out = F.crc32("text") % 4 == 0
    fits = able.filter(~kept_out)
    place = F.row_number().over(W.partitionBy("kind").orderBy("h"))
    best = fits.mapInArrow(_chooser(per_kind), "kind string, h long").distinct().withColumn("place", place)
    chosen = best.filter(F.col("place") <= F.when(F.col("kind") == "", 2 * per_kind).otherwise(per_kind)).filter(F.col("place") <= 2 * per_kind)
    # At most six times `per_kind` numbers: a proven bound for the broadcast.
    texts = fits.join(F.broadcast(chosen.select("h").distinct()), "h").dropDuplicates(["h"])
    rows = texts.select("text").mapInArrow(_example_rows, "key long, x array<double>, y int").toPandas()
    y = rows.y.to_numpy().astype(float)
    if min(y.sum(), (1 - y).sum()) < 10:
        return Trees()
    x = np.stack(rows.x.to_numpy())
    order = np.lexsort((y, *x.T[::-1], rows.key.to_numpy()))
    model = boost(x[order], y[order])
    counts = able.filter(kept_out).select("text").mapInArrow(_score_counts(model), "kind long, step long, n long, positive long")
    steps = counts.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive")).toPandas()
    for i, kind in enumerate(WIDER):
        mine = steps[steps.kind == i].sort_values("step", ascending=False)
        right = np.cumsum(mine.positive.to_numpy())
        good = np.flatnonzero(right >= precision * np.cumsum(mine.n.to_numpy()))
        if len(good) and right[good[-1]] >= 5:
            model.threshold[kind] = max(0.5, float(mine.step.to_numpy()[good[-1]]) / _SCORES)
    return model


def spans(text: str, model: Trees) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans, and all spans: base and selected candidates."""
    base = base_spans(text)
    if not model.trees:
        return base, base
    found = candidates(text)
    inside = Overlaps(base)
    kept = [(c, n) for c, n in zip(found, crowd(found)) if not inside.any(c[0], c[2])]
    if not kept:
        return base, base
    free = [c for c, _ in kept]
    p = model.score(np.array([features(text, c, n) for c, n in kept], dtype=float))
    added: list[tuple[int, str, int]] = []
    taken: list[tuple[int, int]] = []  # of `added`, in order; they do not overlap
    for i in np.argsort(-p, kind="stable"):
        c = free[i]
        at = bisect_left(taken, (c[0], c[2]))
        apart = (at == 0 or taken[at - 1][1] <= c[0]) and (at == len(taken) or taken[at][0] >= c[2])
        if c[1] in model.threshold and p[i] >= model.threshold[c[1]] and apart:
            added.append(c)
            taken.insert(at, (c[0], c[2]))
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[1])))


def _written(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def masked(text: str, found: list[tuple[int, str, int]]) -> str:
    """The text with every span, or run of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for s, kind, e in found:
        if s >= at:
            out += [text[at:s], f"<{kind.removeprefix('wide_').upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _finder(model: Trees) -> Callable:
    def find_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for text in batch["text"]:
                b, a = spans(text.as_py() or "", model)
                base.append(b), every.append(a)
            yield pa.record_batch({
                "doc_id": batch["doc_id"],
                **{f"n_{k}": pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in BASE},
                "base": pa.array(map(_written, base), pa.string()), "spans": pa.array(map(_written, every), pa.string()),
            })

    return find_in


def find(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, counts of base kinds, base and all spans of every row of doc_id, text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _finder(model), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def _masker(model: Trees) -> Callable:
    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch["text"]]
            clean = [t if t is None else masked(t, spans(t, model)[1]) for t in texts]
            at = batch.schema.names.index("text")
            yield batch.set_column(at, "text", pa.array(clean, batch.schema.field(at).type))

    return mask


def redact(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows with all spans masked in `text`."""
    return docs.mapInArrow(_masker(model), docs.schema)


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs.select("doc_id", "text")))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
