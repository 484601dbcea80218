"""Very long texts, ties, repeated rows and clashing columns, for each operator on documents; and large groups of near copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.llm import decontaminate, jaccard, line_dedup, passages, quality, sharding
from sparkdoc.llm.rtree import Forest

from .helpers import documents
from .test_jaccard import brute
from .test_texts import counts

R = random.Random(31)
LONG = "\n".join(" ".join(f"w{R.randrange(20_000)}" for _ in range(30)) for _ in range(4_000))
TIE = " ".join(["tie"] * 60)
ROWS = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, LONG), (5, LONG), (6, LONG), (None, "x y z"), (7, TIE), (8, TIE)]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, ROWS, extra=True).cache()


def test_sharding(docs):
    got = sharding.sharded(docs, sharding.layout(8)).collect()
    assert len(got) == len(ROWS) and {r.size for r in got if r.doc_id in (5, 6)} == {len(LONG) + 1} and len({(r.shard, r.slot) for r in got}) == len(ROWS)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1


def test_decontamination(spark, docs):
    w = LONG.split()
    items = [(1, " ".join(w[70_000:70_050])), (2, " ".join(w[70_000:70_050])), (3, " ".join(["tie"] * 60)), (4, "elsewhere " * 30), (5, LONG)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted([(d, i) for d in (5, 5, 6) for i in (1, 2, 5)] + [(7, 3), (8, 3)])


def test_quality(docs, spark):
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality.train(docs, labels)
    got = quality.judged(docs, trees).collect()
    assert sorted([(r.doc_id is None, r.doc_id, *[r[c] for c in quality.BASE]) for r in got], key=str) == sorted([(d is None, d, *counts(t)) for d, t in ROWS], key=str)
    kept = quality.passing(docs, trees)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_lines(docs):
    got = line_dedup.line_dedup(docs, min_docs=3, min_chars=1).collect()
    assert [(r.n_lines, r.n_dropped, r.kept_text) for r in got if r.doc_id in (5, 6)] == [(4000, 4000, "")] * 3
    plain = line_dedup.without_lines(docs, min_docs=3)
    assert plain.columns == docs.columns and {r.doc_id: r.text for r in plain.collect() if r.doc_id in (4, 7)} == {4: "a", 7: TIE}


def test_passages(docs):
    got = [tuple(r) for r in passages.repeated_passages(docs).collect()]
    assert sorted(got) == [(6, 0, 120_000, 5, 0, 120_000, 1.0), (8, 0, 60, 7, 0, 60, 1.0)]


def test_jaccard(docs):
    got = jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)


@pytest.mark.parametrize("block", [4096, 64])
def test_large_groups_of_near_copies(spark, block, monkeypatch):
    """Copies about the threshold, some below it, with a passage that others share: links as brute force finds them."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(5)
    base = [f"b{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"o{r.randrange(10**6)}" for _ in range(60)] + base[:60])) for i in range(80)]
    got = jaccard.jaccard_components(documents(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_forest_joins_what_the_edges_join():
    r = np.random.default_rng(2)
    for n, m in ((50, 30), (50, 400), (1, 0), (200, 150)):
        a, b, weight = r.integers(0, n, m), r.integers(0, n, m), r.integers(0, 9, m)
        good = r.random(m) < 0.6

        def names(keep):
            root = list(range(n))
            for _ in range(n):
                for x, y in zip(a[keep], b[keep], strict=True):  # noqa: B023
                    root[x] = root[y] = min(root[x], root[y])
            return root

        plain, checked = Forest(n), Forest(n)
        edges = plain.joined(a, b, weight)
        stood = checked.joined(a, b, weight, lambda i: good[i])  # noqa: B023
        for forest, found, keep in ((plain, edges, np.ones(m, bool)), (checked, stood, good)):
            want = names(keep)
            assert len(found) == n - len(set(want)) and keep[found].all()
            assert [forest.root[i] == forest.root[j] for i in range(n) for j in range(n)] == [want[i] == want[j] for i in range(n) for j in range(n)]


def test_documents_of_one_id_and_text_are_told_apart_by_nothing(spark):
    """Rows that are equal in all columns each keep a row where results are per row."""
    rows = documents(spark, [(1, TIE)] * 3)
    assert sharding.sharded(rows, sharding.layout(8)).agg(F.sort_array(F.collect_list("slot")).alias("s")).first().s == [0, 1, 2]
    assert line_dedup.line_dedup(rows).count() == 3 and jaccard.jaccard_components(rows).count() == 3 and passages.repeated_passages(rows).count() == 0
