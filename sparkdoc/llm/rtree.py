"""A packed R-tree over count vectors, searched for pairs whose overlap bound suffices.

A set's tokens are hashed into ``GROUPS`` groups; the counts are its point. Two sets share at most the sum of the
smaller counts, coordinate by coordinate, and a set shares at most the sum of min(count, box maximum) with any set in a
box. Sets of sizes p and q whose Jaccard similarity is at least t share at least t / (1 + t) * (p + q) tokens.
Boxes that can't reach that are left out with all they hold, as are boxes all of whose sets are already known to be in
the query's own component. Leaves are compared point by point.
"""

from __future__ import annotations

import numpy as np

GROUPS = 64
LEAF = 16
FAN = 8


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Counts of the tokens (uint64 hashes) by their top six bits."""
    return np.bincount((tokens >> np.uint64(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def point_bytes(tokens: np.ndarray) -> bytes:
    """A set's count vector, and behind it the parities of a finer one: as many groups as the next power of two above 16 times the set's size (2**8 to 2**17)."""
    bits = 1 << min(17, max(8, (16 * len(tokens)).bit_length()))
    fine = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return count_vector(tokens).astype(np.uint16 if len(tokens) < 1 << 16 else np.int32).tobytes() + np.packbits(fine.astype(np.uint8)).tobytes()


def read_points(raw: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(count vectors, parities) of ``point_bytes``."""
    vectors, parities = np.empty((len(raw), GROUPS), np.int32), []
    for i, x in enumerate(raw):
        kind = np.dtype(np.uint16 if sizes[i] < 1 << 16 else np.int32)
        vectors[i] = np.frombuffer(x, kind, GROUPS)
        parities.append(np.frombuffer(x, np.uint8, offset=GROUPS * kind.itemsize))
    return vectors, parities


def apart(a: np.ndarray, b: np.ndarray, parities: list[np.ndarray]) -> np.ndarray:
    """Least number of tokens that only one of two sets has: as many as their finer groups' parities differ in; for index pairs."""
    out = np.zeros(len(a), np.int64)
    width = np.array([len(x) for x in parities], np.int64)
    # token bits are the low ones of a hash, so a set's parities at fewer groups fold out of those at more
    narrow = np.minimum(width[a], width[b])
    for v in np.unique(narrow):
        at = np.flatnonzero(narrow == v)
        for i in range(0, len(at), 2048):
            part = at[i : i + 2048]
            x, y = (np.stack([_folded(parities[j], v) for j in side[part]]) for side in (a, b))
            out[part] = _ONES[x ^ y].sum(1, dtype=np.int64)
    return out


def may_reach(differ: np.ndarray, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes p and q that differ in ``differ`` tokens at least may reach num / den."""
    p, q = p.astype(np.int64), q.astype(np.int64)
    return (num + den) * (p + q - differ) >= 2 * num * (p + q)


class Forest:
    """Components of numbers 0 to n - 1, which edges join; ``root`` names each number's component."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def joined(self, a: np.ndarray, b: np.ndarray, weight: np.ndarray, check=None) -> np.ndarray:
        """Edges (as indices) that join all that the given ones join: in rounds the lightest edge of each component.

        With ``check`` (edge indices to mask) an edge only joins if it stands it, else it is dropped.
        """
        out = []
        alive = np.lexsort((b, a, weight))
        while len(alive := alive[self.root[a[alive]] != self.root[b[alive]]]):
            ends = np.concatenate([self.root[a[alive]], self.root[b[alive]]])
            lightest = np.full(len(self.root), len(alive))
            np.minimum.at(lightest, ends, np.tile(np.arange(len(alive)), 2))
            at = np.unique(lightest[lightest < len(alive)])
            pick = alive[at]
            if check is not None:
                alive = np.delete(alive, at)
                pick = pick[check(pick)]
            out.append(pick)
            self._unite(self.root[a[pick]], self.root[b[pick]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins roots; an edge hangs the greater of its roots on the lesser until none is left to hang."""
        while len(a):
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = a[open_], b[open_]


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    while len(x) > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class RTree:
    """Points in the order of (size, vector); level 0 boxes hold ``LEAF`` points, each further level ``FAN`` boxes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        half = vectors[:, : GROUPS // 2].sum(1)
        self.order = np.lexsort((half, sizes))
        self.vectors, self.sizes, self.labels = vectors[self.order], sizes[self.order], labels[self.order]
        self.levels = []
        top, low, high = self.vectors, self.sizes, self.sizes
        width = LEAF
        while True:
            at = np.arange(0, len(low), width)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high, width))
            if len(at) == 1:
                break
            width = FAN
        self._name()

    def relabel(self, labels: np.ndarray) -> None:
        """Other components of the points, in the order that they were given in."""
        self.labels = labels[self.order]
        self._name()

    def _name(self) -> None:
        """Per box its first component, and whether it has no other."""
        self.names = []
        one, same = self.labels, np.ones(len(self.labels), bool)
        for *_, width in self.levels:
            at = np.arange(0, len(one), width)
            first = one[at]
            same = np.logical_and.reduceat(same & (one == np.repeat(first, np.diff([*at, len(one)]))), at)
            one = first
            self.names.append((one, same))

    def pairs(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray, num: int, den: int, chunk: int = 1 << 14):
        """Yields (query, point) index arrays that may reach num / den Jaccard and have different labels."""
        for s in range(0, len(sizes), 512):
            q = np.arange(s, min(len(sizes), s + 512))
            node = np.zeros(len(q), np.int64)
            for k in range(len(self.levels) - 1, -1, -1):
                (top, low, high, width), (one, same) = self.levels[k], self.names[k]
                keep = (den * high[node] >= num * sizes[q]) & (den * sizes[q] >= num * low[node]) & ~(same[node] & (one[node] == labels[q]))
                q, node = q[keep], node[keep]
                ok = np.zeros(len(q), bool)
                for i in range(0, len(q), chunk):
                    a, b = q[i : i + chunk], node[i : i + chunk]
                    ok[i : i + chunk] = reaches(np.minimum(vectors[a], top[b]).sum(1), sizes[a], low[b], num, den)
                q, node = q[ok], node[ok]
                n = len(self.sizes) if k == 0 else len(self.levels[k - 1][1])
                q = np.repeat(q, width)
                node = (node[:, None] * width + np.arange(width)).ravel()
                inside = node < n
                q, node = q[inside], node[inside]
            keep = (labels[q] != self.labels[node]) & (den * self.sizes[node] >= num * sizes[q]) & (den * sizes[q] >= num * self.sizes[node])
            q, node = q[keep], node[keep]
            for i in range(0, len(q), chunk):
                a, b = q[i : i + chunk], node[i : i + chunk]
                ok = reaches(np.minimum(vectors[a], self.vectors[b]).sum(1), sizes[a], self.sizes[b], num, den)
                if ok.any():
                    yield a[ok], self.order[b[ok]]


def reaches(shared: np.ndarray, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of sizes p and q that share so many tokens have Jaccard similarity num / den or more."""
    return (num + den) * shared.astype(np.int64) >= num * (p.astype(np.int64) + q.astype(np.int64))
