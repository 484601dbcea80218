import random

import numpy as np
import pytest

from sparkdoc.llm import jaccard
from sparkdoc.llm.components import components
from sparkdoc.llm.rtree import RTree, count_vector, reaches

from .helpers import documents, shingle_set


def brute(rows, num=80, den=100):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), (min(ids) if ids else None) if sets[i] else d))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    rows = []
    while len(rows) < n:
        w = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 120, 300]))]
        if r.random() < 0.4:
            w[len(w) // 2 : len(w) // 2] = passage
        for _ in range(r.choice([1, 1, 1, 2, 12])):
            v = list(w)
            for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
                v[r.randrange(len(v))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(v)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [4096, 8])
def test_equals_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    got = jaccard.jaccard_components(documents(spark, rows, extra=True)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_defined_cases(spark):
    text = "One two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, text), (6, text), (None, text.upper()), (None, "alone here"), (9, "b a"), (9, text), (10, "x " * 30000)]
    got = jaccard.jaccard_components(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert jaccard.jaccard_components(documents(spark, [])).count() == 0


def test_rtree_finds_all_pairs_within_the_bound():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 64, (12, 150), dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base[r.integers(12)], r.integers(60, 150), replace=False), r.integers(0, 1 << 64, r.integers(1, 20), dtype=np.uint64)])) for _ in range(400)]
    v, n, label = np.stack([count_vector(s) for s in sets]), np.array([len(s) for s in sets]), r.integers(0, 3, 400)
    want = {(i, j) for i in range(400) for j in range(400) if label[i] != label[j] and reaches(np.minimum(v[i], v[j]).sum(keepdims=True), n[i], n[j], 80, 100)[0] and min(n[i], n[j]) * 100 >= 80 * max(n[i], n[j])}
    tree = RTree(v, n, label)
    got = {(int(a), int(b)) for x, y in tree.pairs(v, n, label, 80, 100) for a, b in zip(x, y, strict=True)}
    assert got == want and want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(300, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}
