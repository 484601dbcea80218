"""Benchmark decontamination with SimHash windows of each item's own size.

Items and documents are read as shingles of ``k`` words (A-Z lower-cased); an item of fewer words is one shingle, its
whole sequence, and is looked for as such. For an item of m shingles each run of m shingles of a document is a window;
a document of fewer is one window as a whole, which is compared exactly (shared over m + n - shared) with the items that
its shingles name.

1. A window without any shingle of a benchmark item of its size has similarity 0 and is left out.
2. The others get a 64-bit SimHash over their shingles, with multiplicity, by differences of running sums.
3. Multi-index Hamming search: fingerprints are cut into 8 blocks of 8 bits. Two fingerprints at distance ``radius`` or
   less agree in one block up to ``radius // 8`` bits; tables of all block values within that give every item that can
   be in the radius, and the distance is then checked.
4. Candidates are verified exactly: sum of smaller over sum of larger shingle multiplicities, 0.8 or more.

A window that is similar enough differs from its item in at most a ninth of its shingles, so its fingerprint is near
10 bits away with a standard deviation of 3; radius 22 leaves four deviations. An item that repeats shingles can lose
much of its fingerprint with one of them, so its radius is four deviations with its heaviest ninth lost.

The benchmark is read in blocks of at most ``BLOCK_WORDS`` words; each block's index is sent to the tasks, which pass
over all documents once a block. So what is sent is bounded whatever the benchmark's size.

Defined cases: null and empty texts have no windows and items without words are never found; repeated items are found
each; documents with repeated or null ids get a row per row; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

BLOCK_WORDS = 2_000_000
RADIUS = 22
_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def simhashes(tokens: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Fingerprints (rows of 8 bytes) of the windows of m tokens that begin at the sorted ``starts``."""
    used = np.unique(starts[:, None] + np.arange(m)) if len(starts) * m < 1 << 20 else np.flatnonzero(_cover(starts, m, len(tokens)))
    bits = np.unpackbits(tokens[used].view(np.uint8).reshape(-1, 8), axis=1)
    run = np.zeros((len(used) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=run[1:])
    at = np.searchsorted(used, starts)
    return np.packbits(2 * (run[at + m] - run[at]) > m, axis=1)


def _cover(starts: np.ndarray, m: int, n: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + m, n), -1)
    return np.cumsum(step[:-1]) > 0


def radius_of(weights: np.ndarray, least: int) -> int:
    """The radius for an item with these shingle multiplicities: a ninth of it, the heaviest shingles, gone and as much variance come."""
    w = np.sort(weights.astype(float))[::-1]
    total, room = (w * w).sum(), max(1, w.sum() // 9)
    if w[0] == 1:
        return least
    lost = 0.0
    for x in w:
        if room <= 0:
            break
        x = min(x, room)  # of a shingle a part can go
        room -= x
        lost += x * x
    # the sums before and after: the part that both have is at least what is left of the weights
    p = np.arccos(np.clip((total - lost) / total, 0, 1)) / np.pi
    return min(64, max(least, int(np.ceil(64 * p + 4 * np.sqrt(64 * p * (1 - p))))))


class Size:
    """The items of m shingles: their fingerprints and block tables."""

    def __init__(self, m: int, items: list[int], tokens: list[np.ndarray], radius: int) -> None:
        self.m, self.items, self.tokens = m, items, tokens
        self.prints = np.concatenate([simhashes(t, np.array([0]), m) for t in tokens])
        self.sorted = [np.unique(t, return_counts=True) for t in tokens]
        self.radius = np.array([radius_of(n, radius) for _, n in self.sorted])
        near = self.radius // 8
        values = np.arange(256, dtype=np.uint8)
        self.tables = np.stack([_BITS[values[:, None] ^ self.prints[None, :, b]] <= near for b in range(8)])
        self.shingles = np.unique(np.concatenate(tokens))
        names = np.concatenate([x for x, _ in self.sorted])
        order = np.argsort(names, kind="stable")
        self.names, self.holders = names[order], np.repeat(np.arange(len(tokens)), [len(x) for x, _ in self.sorted])[order]

    def holding(self, window: np.ndarray) -> np.ndarray:
        """Items with a shingle of the window."""
        low, high = np.searchsorted(self.names, window), np.searchsorted(self.names, window, "right")
        return np.unique(np.concatenate([self.holders[:0], *(self.holders[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True) if a < b)]))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius."""
        found = [np.zeros(0, np.int64)] * 2
        step = max(1, min(4096, (1 << 24) // len(self.items)))  # windows whose table with all items has 16 MB at most
        for s in range(0, len(prints), step):
            p = prints[s : s + step]
            hit = self.tables[0][p[:, 0]]
            for b in range(1, 8):
                hit = hit | self.tables[b][p[:, b]]
            w, i = np.nonzero(hit)
            near = _BITS[p[w] ^ self.prints[i]].sum(1, dtype=np.int64) <= self.radius[i]
            found = [np.concatenate([found[0], w[near] + s]), np.concatenate([found[1], i[near]])]
        return found[0], found[1]

    def similarity(self, window: np.ndarray, item: int) -> float:
        names, counts = self.sorted[item]
        own, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        shared = int(np.minimum(n, counts[at])[names[at] == own].sum())
        return shared / (self.m + len(window) - shared)


class Index:
    """All sizes of one block of items, and a filter on their shingles. Short items: by their number of words."""

    def __init__(self, items: list[tuple[int, str]], k: int, radius: int) -> None:
        self.k = k
        by: dict[int, tuple[list, list]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            column = pa.array([text], pa.string())
            _, _, data, bounds = next(textkit.pieces(column))
            w = textkit.words(data, bounds)
            tokens, _ = textkit.shingles(w, k)
            n = len(w.starts)
            if not n:
                continue
            if n < k:
                self.short.setdefault(n, {}).setdefault(int(textkit.grams(w.hashes, n)[0]), []).append(item)
            else:
                ids, rows = by.setdefault(len(tokens), ([], []))
                ids.append(item)
                rows.append(tokens)
        self.sizes = [Size(m, *by[m], radius) for m in sorted(by)]
        self.all = np.unique(np.concatenate([s.shingles for s in self.sizes])) if self.sizes else np.zeros(0, np.uint64)
        self.flags = np.zeros(1 << 22, bool)
        self.flags[(self.all >> np.uint64(42)).astype(np.int64)] = True

    def search(self, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(row, item, start word, words, similarity, hits): the best window of each item in each text."""
        for i, _, data, bounds in textkit.pieces(column):
            w = textkit.words(data, bounds)
            best: dict[tuple[int, int], list] = {}
            for n, known in self.short.items():
                grams = textkit.grams(w.hashes, n)
                for at in np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64))):
                    row = int(np.searchsorted(w.first, at, "right")) - 1
                    if at + n <= w.first[row + 1]:
                        for item in known[int(grams[at])]:
                            best.setdefault((row, item), [int(at - w.first[row]), n, 1.0, 0])[3] += 1
            grams = textkit.grams(w.hashes, self.k)
            maybe = np.flatnonzero(self.flags[(grams >> np.uint64(42)).astype(np.int64)]) if len(self.all) else np.zeros(0, np.int64)
            seeds = maybe[np.isin(grams[maybe], self.all)] if len(maybe) else maybe
            if len(seeds):
                row = np.searchsorted(w.first, seeds, "right") - 1
                fits = seeds + self.k <= w.first[row + 1]
                seeds, row = seeds[fits], row[fits]
                for size in self.sizes:
                    self._sized(size, grams, seeds, row, w.first, threshold, best)
            for (row, item), (start, n, value, hits) in best.items():
                yield i + row, item, start, n, value, hits

    def _sized(self, size: Size, grams: np.ndarray, seeds: np.ndarray, row: np.ndarray, first: np.ndarray, threshold: float, best: dict) -> None:
        mine = np.isin(grams[seeds], size.shingles)
        at, own, m = seeds[mine], row[mine], size.m
        if not len(at):
            return
        self._whole(size, grams, at, own, first, threshold, best)
        low, high = np.maximum(first[own], at - m + 1), np.minimum(at, first[own + 1] - self.k + 1 - m)
        count = np.maximum(high - low + 1, 0)
        starts = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts = np.unique(starts)
        if not len(starts):
            return
        window, item = size.candidates(simhashes(grams, starts, m))
        # what a window shares is at most its number of positions with a shingle of the size's items
        seen = np.searchsorted(at, starts[window] + m) - np.searchsorted(at, starts[window])
        keep = seen >= threshold * (2 * m - seen) - 1e-9
        window, item, seen = window[keep], item[keep], seen[keep]
        rows = np.searchsorted(first, starts[window], "right") - 1
        done: dict[tuple[int, int], int] = {}
        for j in np.lexsort((starts[window], -seen, item, rows)):
            key = (int(rows[j]), size.items[item[j]])
            s = int(starts[window[j]])
            if key in done and abs(done[key] - s) < m:
                continue  # overlaps the window that was found
            value = size.similarity(grams[s : s + m], int(item[j]))
            if value >= threshold - 1e-12:
                done[key] = s
                entry = best.setdefault(key, [s - int(first[key[0]]), m + self.k - 1, value, 0])
                entry[3] += 1
                if value > entry[2]:
                    entry[:3] = [s - int(first[key[0]]), m + self.k - 1, value]


    def _whole(self, size: Size, grams: np.ndarray, at: np.ndarray, own: np.ndarray, first: np.ndarray, threshold: float, best: dict) -> None:
        """Texts with fewer shingles than the items have: each is one window."""
        rows, seen = np.unique(own, return_counts=True)
        n = first[rows + 1] - first[rows] - self.k + 1
        for j in np.flatnonzero((n < size.m) & (seen >= threshold * (size.m + n - seen) - 1e-9)):
            start, count = int(first[rows[j]]), int(n[j])
            window = grams[start : start + count]
            for item in size.holding(window):
                value = size.similarity(window, int(item))
                if value >= threshold - 1e-12:
                    best[int(rows[j]), size.items[item]] = [0, count + self.k - 1, value, 1]


def indexes(benchmark: DataFrame, k: int = 5, radius: int = RADIUS, block_words: int = BLOCK_WORDS, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """One index for each block of the benchmark."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Index([(r.item, r.text) for r in part.collect()], k, radius)  # about block_words words


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, radius: int = RADIUS, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document and benchmark item found in it: doc_id, item_id, start_word, n_words, similarity, n_windows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "item_id", "start_word", "n_words", "similarity", "n_windows"]

    def over(index: Index) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sorted(sent.value.search(batch.column(1), threshold))
                at, item, start, n, value, hits = zip(*found, strict=True) if found else ((),) * 6
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(item, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(value, pa.float64()), pa.array(hits, pa.int64())], names)

        return rows.mapInArrow(find, f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id bigint, start_word bigint, n_words bigint, similarity double, n_windows bigint")

    return reduce(DataFrame.unionByName, map(over, indexes(benchmark, k, radius, block_words)))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, k: int = 5, radius: int = RADIUS, block_words: int = BLOCK_WORDS, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold an item; columns and schema stay."""
    for index in indexes(benchmark, k, radius, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], at: int = docs.columns.index(text_col), sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[x[0] for x in sent.value.search(batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
