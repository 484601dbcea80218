"""Quality rules: gradient-boosted trees over document statistics.

Statistics come from whole texts, in numpy over Arrow columns. Trees are fitted on labelled rows (at most
``MAX_TRAIN``, the least by a hash of the id, so the choice doesn't depend on the partitions) with histogram splits on
the logistic loss; a feature may have a monotonic constraint, which forbids splits against it and bounds the leaves of
both sides by their middle. All trees are flattened into node arrays, and a batch walks them level by level.

The base rule rejects documents of fewer than 50 words or with over half of their words in repeated 3-word windows;
the trees judge the rest.

Defined cases: a null text has no words, and every count is 0, so the base rule rejects it; without labelled rows of
both classes the model keeps what the base rule keeps; repeated ids and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Labelled rows that the trees are fitted on at most.
MAX_TRAIN = 20_000
#: Least log odds of good quality; below 0, as a clean document lost costs more than a poor one kept.
THRESHOLD = -0.5
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "distinct_rate", "words_per_line", "long_word_rate"]
#: More symbols, repeated lines, repeated words or exclamation never make a document better.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "mark_rate": -1}

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[65:91] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_IS_MARK = np.zeros(256, bool)
_IS_MARK[list(b"!?")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    if len(bounds) == 2:  # one long text
        return np.array([np.count_nonzero(flags[bounds[0] : bounds[1]])])
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _repeated(keys: np.ndarray, first: np.ndarray, later_only: bool) -> np.ndarray:
    """For each key whether it is found twice or more within its text (or: equals an earlier one)."""
    if len(first) == 2:  # one long text
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
    else:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        order = np.lexsort((keys, text))
        k, t = keys[order], text[order]
        same = (k[1:] == k[:-1]) & (t[1:] == t[:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True  # lexsort is stable: the first of equals comes first
    if not later_only:
        out[order[:-1][same]] = True
    return out


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of every text: int64 (n, 5) and float64 (n, 11)."""
    base, features = [np.zeros((0, len(BASE)), np.int64)], [np.zeros((0, len(FEATURES)))]
    for _, _, data, bounds in textkit.pieces(column):
        w = textkit.words(data, bounds, lower=False)
        n = np.diff(w.first)
        ink = ~textkit._SPACE[data]
        chars = _per_text(ink & _LEAD[data], bounds)
        symbols = _per_text(_IS_SYMBOL[data], bounds)
        # words in repeated 3-word windows
        windows = textkit.grams(w.hashes, 3)
        count = np.maximum(n - 2, 0)
        wfirst = np.concatenate([[0], np.cumsum(count)])
        if len(n) == 1:
            at = np.arange(wfirst[-1])
            hit = np.flatnonzero(_repeated(windows, wfirst, False))
        else:
            at = np.repeat(w.first[:-1], count) + np.arange(wfirst[-1]) - np.repeat(wfirst[:-1], count)
            hit = at[_repeated(windows[at], wfirst, False)] if len(at) else at
        del windows, at
        covered = np.zeros(len(w.starts), bool)
        for d in range(3):
            covered[hit + d] = True
        repeats = _per_text(covered, w.first)
        # lines: from a text's start or a line feed on, to the next
        feeds = np.flatnonzero(data == 10)
        begins = np.unique(np.concatenate([bounds[:-1][np.diff(bounds) > 0], feeds + 1]))
        begins = begins[begins < len(data)]
        lfirst = np.searchsorted(begins, bounds)
        ends = np.append(begins[1:], len(data))
        ends = np.where((ends > 0) & np.isin(ends - 1, feeds), ends - 1, ends)
        has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, begins)
        lines = textkit.range_hashes(data, begins, ends)
        live = np.flatnonzero(has)
        live_first = np.concatenate([[0], np.cumsum(has)])[lfirst]
        again = _repeated(lines[live], live_first, True) if len(live) else np.zeros(0, bool)
        dup = _per_text(again, live_first)
        n_lines = np.diff(live_first)
        base.append(np.stack([n, chars, symbols, dup, repeats], 1))
        distinct = n - _per_text(_repeated(w.hashes, w.first, True), w.first)
        long = _per_text((w.ends - w.starts) > 20, w.first)
        some, inked = np.maximum(n, 1), np.maximum(chars, 1)
        features.append(np.stack([np.log1p(n), chars / some, symbols / inked, dup / np.maximum(n_lines, 1), repeats / some, _per_text(_IS_UPPER[data], bounds) / inked,
                                  _per_text(_IS_DIGIT[data], bounds) / inked, _per_text(_IS_MARK[data], bounds) / some, distinct / some, n / np.maximum(n_lines, 1), long / some], 1))
    return np.concatenate(base), np.concatenate(features)


@dataclass
class Trees:
    """All trees in one set of node arrays. A leaf is its own child; ``depth`` steps reach a leaf from any root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, rounds: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for y in {0, 1}; ``monotone`` maps features to +1 (score never falls as it grows) or -1."""
    monotone = monotone or {}
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(mean / (1 - mean)))
    score = np.full(len(y), bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        own = float(np.clip(g[rows].sum() / (h[rows].sum() + l2), low, high))
        nodes.append([0, 0.0, at, at, own * rate])
        score[rows] += own * rate
        if level == depth or len(rows) < 2:
            return at
        best, gain = None, 1e-6
        gs, hs = g[rows].sum(), h[rows].sum()
        for j, e in enumerate(edges):
            if not len(e):
                continue
            cg = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
            ch = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
            cn = np.cumsum(np.bincount(binned[rows, j], minlength=len(e) + 1))[:-1]
            lv, rv = np.clip(cg / (ch + l2), low, high), np.clip((gs - cg) / (hs - ch + l2), low, high)
            won = cg**2 / (ch + l2) + (gs - cg) ** 2 / (hs - ch + l2) - gs**2 / (hs + l2)
            bad = (cn < least) | (len(rows) - cn < least)
            if monotone.get(j):
                bad |= monotone[j] * (rv - lv) < 0
            won[bad] = -1
            k = int(won.argmax())
            if won[k] > gain:
                best, gain = (j, k, lv[k], rv[k]), won[k]
        if best is None:
            return at
        j, k, lv, rv = best
        score[rows] -= own * rate
        goes = binned[rows, j] <= k
        mid = (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone.get(j, 0)]
        left = grow(rows[goes], g, h, level + 1, *bounds[0])
        right = grow(rows[~goes], g, h, level + 1, *bounds[1])
        nodes[at][:4] = [j, float(edges[j][k]), left, right]
        return at

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), y - p, p * (1 - p), 0, -np.inf, np.inf))
    f, t, a, b, v = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f, t.astype(float), a, b, v.astype(float), np.array(roots), depth, bias)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees | None:
    """Trees fitted on labelled documents; None without both classes. ``labels``: doc_id, quality (0 or 1)."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most max_train ids
    # of rows that share an id the least text counts
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = statistics(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = rows.select("doc_id", "text", F.col("quality").cast("int")).mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x array<double>")
    found = sorted(map(tuple, found.collect()))
    y = np.array([r[1] for r in found], float)
    if len(set(y)) < 2:
        return None
    return fit(np.array([r[2] for r in found]), y, {FEATURES.index(k): v for k, v in MONOTONE.items()})


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])


def _judged(batches: Iterator[pa.RecordBatch], at: int, trees, threshold: float) -> Iterator[pa.RecordBatch]:
    model = trees.value
    for batch in batches:
        base, x = statistics(batch.column(at))
        failed = base_failed(base)
        score = model.score(x) if model else np.full(len(x), np.inf)
        made = [*(pa.array(base[:, i]) for i in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *BASE, "base_failed", "score", "kept"])


def _passing(batches: Iterator[pa.RecordBatch], at: int, trees, threshold: float) -> Iterator[pa.RecordBatch]:
    model = trees.value
    for batch in batches:
        base, x = statistics(batch.column(at))
        keep = ~base_failed(base)
        if model and keep.any():
            keep &= model.score(x) >= threshold
        yield batch.filter(pa.array(keep))


def passing(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns only."""
    model = docs.sparkSession.sparkContext.broadcast(trees)  # a few thousand nodes
    return docs.mapInArrow(partial(_passing, at=docs.columns.index(text_col), trees=model, threshold=threshold), docs.schema)


def judged(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with the base counts, base_failed, score (log odds) and kept. Columns that clash are replaced."""
    made = [*BASE, "base_failed", "score", "kept"]
    docs = docs.drop(*made)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # a few thousand nodes
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), *(f"{c} bigint" for c in BASE), "base_failed boolean, score double, kept boolean"])
    return docs.mapInArrow(partial(_judged, at=docs.columns.index(text_col), trees=model, threshold=threshold), schema)
