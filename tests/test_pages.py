"""All pages of a query at once: the same as page after page, from a number of jobs that doesn't grow with the pages."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdoc.operators import index as ix
from sparkdoc.plans.pages import page_starts
from sparkdoc.plans.query import Query, aggregate_pages, follow, merge_pages, paged_groups
from sparkdoc.functions.aggregates import merge
from sparkdoc.functions.sort import Sort
from sparkdoc.queries import QUERIES, SQL

from .test_filters import schemaless

#: Registered queries that go through all pages of a collection.
AT_ONCE = [
    "agg_merge_pages",
    "index_backfill",
    "index_page_sorted",
    "page_budget",
    "page_chain_sorted",
    "page_merge",
    "page_merge_sorted",
    "page_chain_filtered",
    "index_page_equal",
    "page_chain_sorted_desc",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("orders")
    i = F.col("id")
    rows = spark.range(1, 80_001).select(i.alias("o_orderkey"), (i % 1000).alias("o_custkey"), F.when(i % 3 == 0, "P").otherwise("F").alias("o_orderstatus"), (i * 7919 % 400_000).cast("double").alias("o_totalprice"),
                                         F.timestamp_seconds(F.lit(757_382_400) + i * 86_400 % 8_640_000).alias("o_orderdate"), F.concat((i % 5).cast("string"), F.lit("-LEVEL")).alias("o_orderpriority"))
    rows.coalesce(2).write.parquet(str(at / "orders.parquet"))
    return str(at)


@pytest.mark.parametrize("name", AT_ONCE)
def test_jobs_do_not_grow_with_the_pages(spark, folder, name):
    QUERIES[name](spark, folder)  # collections and indexes are built by now
    context = spark.sparkContext
    context.setJobGroup(name, name)
    got = QUERIES[name](spark, folder).collect()
    context.setJobGroup("rest", "rest")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet/*.parquet')")
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, c.sql(SQL[name]).fetchall()), key=repr)
    assert len(context.statusTracker().getJobIdsForGroup(name)) <= 15


@pytest.mark.parametrize("density", [0, 0.02, 0.5, 1])
def test_page_starts(density):
    r = random.Random(1)
    hit = np.array([r.random() < density for _ in range(500)])
    for limit, scanned in ((1, 5), (3, 10), (10, 11), (40, 77), (400, 499), (3, 1000)):
        want, start = [], 0
        while start < len(hit):
            want.append(start)
            places = start + np.flatnonzero(hit[start : start + scanned])
            start = int(places[limit - 1]) + 1 if len(places) >= limit else start + scanned
        for cut in (1, 7, 64, 500):
            assert page_starts([(i, len(hit[i : i + cut]), np.flatnonzero(hit[i : i + cut])) for i in range(0, len(hit), cut)], limit, scanned) == want
    assert page_starts([], 1, 5) == []


def test_all_pages_at_once_are_those_of_the_cursors(spark, tmp_path):
    r = random.Random(5)
    docs = [{"n": r.choice([1, 2, 2.5, 9007199254740993, "a", None, True]), "s": r.choice("xxy")} for _ in range(70)] + [{"s": "x"}, {"n": [1]}]
    rows = schemaless(spark, docs)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    specs = [ix.IndexSpec("by-s", "k", "s"), ix.IndexSpec("by-n", "k", "n", True)]
    for s in specs:
        ix.build(rows, s, str(tmp_path / s.name))
    indexes = [ix.opened(spark, s, str(tmp_path / s.name)) for s in specs]
    down = {"field": "n", "order": "desc"}
    for spec, using in (({"where": {"s": "x"}, "limit": 4, "max_scanned": 5}, None), ({"where": {"s": "y"}, "limit": 30, "max_scanned": 7}, None), ({"prefix": "k", "where": {"s": "x"}, "limit": 7, "max_scanned": 8, "after": "k003"}, indexes),
                        ({"sort": down, "limit": 9}, None), ({"prefix": "k", "sort": down, "where": {"s": "x"}, "limit": 4, "max_scanned": 6}, indexes), ({"where": {"s": "none"}, "limit": 9}, None)):
        pages = list(follow(rows, spec, using))
        at_once = Query(rows, spec, using).paged()
        got = sorted(map(tuple, at_once.items().collect()))
        assert got == [(p, place, key) for place, (p, key) in enumerate((p, x["key"]) for p, page in enumerate(pages) for x in page["items"])], spec
        assert sorted(map(tuple, at_once.summary().collect())) == [(p, x["scanned"], len(x["items"]), x["next_cursor"]) for p, x in enumerate(pages)], spec
    kept = Query(rows, {"where": {"s": "x"}, "fields": ["s"]}).paged("value").items().select(F.to_json("value")).distinct().collect()
    assert [x[0] for x in kept] == ['{"s":"x"}']
    assert Query(rows, {"prefix": "none"}).paged().summary().count() == 0


def test_merged_pages_and_aggregates_at_once(spark):
    r = random.Random(6)
    rows = schemaless(spark, [{"n": r.choice([1, 2, 2.5, "a", None])} for _ in range(40)]).cache()
    groups = [rows.where(F.crc32(F.col("key").cast("binary")) % 3 == g) for g in range(3)]
    for spec, sort in (({"where": {"n": {"$gte": 1}}, "limit": 6}, None), ({"sort": {"field": "n", "order": "desc"}, "limit": 6}, Sort("n", True))):
        want, after = [], None
        while True:
            page = merge_pages([Query(g, spec | ({"after": after} if after else {})).page() for g in groups], 6, sort)
            want += [x["key"] for x in page["items"]]
            if (after := page["next_cursor"]) is None:
                break
        got = sorted((x.place, x.page, x.key) for x in paged_groups(groups, spec).items().collect())
        assert [x[2] for x in got] == want and [x[1] for x in got] == [i // 6 for i in range(len(want))]
    spec = {"where": {"n": {"$gt": 1}}, "max_scanned": 7, "aggregate": {"count": True, "sum": "n", "max": "n"}}
    assert aggregate_pages(rows, spec) == merge([p["aggregates"] for p in follow(rows, spec)])
    assert aggregate_pages(rows, spec | {"prefix": "none"}) == {"count": 0, "sum": {"n": None}, "max": {"n": None}}
