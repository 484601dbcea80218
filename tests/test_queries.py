"""Aggregates, order, paging and page merging."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkdoc.errors import SortUnavailable, StoreError
from sparkdoc.functions.aggregates import merge
from sparkdoc.operators import index as ix
from sparkdoc.plans.query import KeyRange, Query, follow, merge_pages, prefix_end
from sparkdoc.queries import QUERIES

from .test_filters import schemaless


def test_aggregates_of_mixed_types(spark):
    rows = schemaless(spark, [{"mass": 40, "kind": "fir"}, {"mass": 1.25, "kind": "ash"}, {"mass": "unknown", "kind": 6}, {"kind": None}, {"mass": [1], "kind": True}])
    got = Query(rows, {"aggregate": {"count": True, "sum": ["mass", "age"], "min": ["mass", "kind"], "max": ["mass", "kind"]}}).aggregate()
    assert got == {"count": 5, "sum": {"mass": 41.25, "age": None}, "min": {"mass": 1.25, "kind": 6}, "max": {"mass": "unknown", "kind": "fir"}}
    assert Query(schemaless(spark, [{"n": -8}, {"n": 20}, {}]), {"aggregate": {"sum": "n"}}).aggregate() == {"sum": {"n": 12}}
    over = Query(schemaless(spark, [{"n": (1 << 63) - 1}, {"n": 1}]), {"aggregate": {"sum": "n"}}).aggregate()["sum"]["n"]
    assert isinstance(over, float) and over == float(1 << 63)
    one = Query(schemaless(spark, [{"n": 1}, {"n": 1.0}]), {"aggregate": {"sum": "n"}}).aggregate()["sum"]["n"]
    assert isinstance(one, float) and one == 2.0
    quoted = Query(schemaless(spark, [{"s": 'a"b\\'}]), {"aggregate": {"max": "s"}}).aggregate()
    assert quoted == {"max": {"s": 'a"b\\'}}


def test_merge_of_partial_aggregates():
    parts = [{"count": 7, "sum": {"w": 10, "v": None}, "min": {"w": -1, "t": "oak"}, "max": {"w": 4}}, {"count": 1, "sum": {"w": 0.5, "v": 3}, "min": {"w": 2, "t": "elm"}, "max": {"w": "tall"}}, {"count": 0, "sum": {"w": None, "v": None}, "min": {"w": None, "t": None}, "max": {"w": None}}]
    assert merge(parts) == {"count": 8, "sum": {"w": 10.5, "v": 3}, "min": {"w": -1, "t": "elm"}, "max": {"w": "tall"}}


def test_sort_ties_and_types(spark):
    r = random.Random(12)
    docs = [{"m": v} for v in r.choices([3, -7, 0.5, 3.0, 10, "pine", "elm", "elm", True, False, None], k=40)] + [{}, {"m": {"x": 1}}, {"m": []}]
    rank = {type(None): 0, bool: 1, int: 2, float: 2, str: 3}
    scalar = [i for i, d in enumerate(docs) if type(d.get("m", [])) in rank]
    place = lambda i: (rank[type(docs[i]["m"])], docs[i]["m"] if docs[i]["m"] is not None else 0)
    rows = schemaless(spark, docs)
    for order in ("asc", "desc"):
        want = sorted(scalar)
        want.sort(key=place, reverse=order == "desc")  # stable: equal values in key order either way
        assert [int(x.key[1:]) for x in Query(rows, {"sort": {"field": "m", "order": order}}).top().collect()] == want
    big = schemaless(spark, [{"n": 9007199254740993}, {"n": 9007199254740992}])
    assert [r.key for r in Query(big, {"where": {"n": {"$gt": 9007199254740992}}, "sort": {"field": "n"}}).top().collect()] == ["k000"]


def test_pages_never_skip_or_repeat(spark):
    r = random.Random(3)
    docs = [{"n": r.choice([1, 2, 2.5, "a", None]), "s": r.choice("xy")} for _ in range(37)]
    rows = schemaless(spark, docs).cache()
    for base in ({"where": {"s": "x"}, "max_scanned": 5, "limit": 3}, {"sort": {"field": "n", "order": "desc"}, "limit": 6}, {"sort": {"field": "n"}, "limit": 7, "where": {"s": "y"}}):
        want = [x.key for x in Query(rows, base | {"limit": 1000}).top().collect()]
        got, cursor = [], None
        for _ in range(60):
            page = Query(rows, base | ({} if cursor is None else {"after": cursor})).page()
            got += [x["key"] for x in page["items"]]
            cursor = page["next_cursor"]
            if cursor is None:
                break
        assert got == want, base


def test_a_page_counts_what_it_looked_at(spark):
    docs = [(f"trees/{i:02}", json.dumps({"kind": ["fir", "ash", "elm", "oak"][i % 4], "site": {"wet": i % 5 == 0}})) for i in range(24)] + [("trees/bad", "{"), ("vines/0", "{}")]
    rows = spark.createDataFrame(docs, "key string, json string").select("key", F.try_parse_json("json").alias("value"))
    page = Query(rows, {"prefix": "trees/", "where": {"kind": "elm", "site.wet": True}}).page()
    assert [x["key"] for x in page["items"]] == ["trees/10"] and page["scanned"] == 25 and page["next_cursor"] is None
    page = Query(rows, {"prefix": "trees/", "where": {"kind": "elm"}, "limit": 3}).page()
    assert [x["key"] for x in page["items"]] == ["trees/02", "trees/06", "trees/10"] and page["scanned"] == 11 and page["next_cursor"] == "trees/10" and not page["partial"]


def test_page_merge():
    part = lambda keys, cursor: {"items": [{"key": k} for k in keys], "next_cursor": cursor, "scanned": 5, "index": None, "partial": False}
    keys = lambda p: [x["key"] for x in p["items"]]
    one = merge_pages([part(["a3", "a8"], "b1"), part(["a5", "b0", "c2"], None)], 10)
    assert keys(one) == ["a3", "a5", "a8", "b0"] and one["next_cursor"] == "b1" and one["scanned"] == 10 and not one["partial"]
    two = merge_pages([part(["a3", "a8"], "b1"), part(["a5", "b0"], None), None], 3)
    assert keys(two) == ["a3", "a5", "a8"] and two["next_cursor"] == "a8" and two["partial"]


def test_pages_through_an_index(spark, tmp_path):
    """Pages that walk a side table hold what those without hold, look at its entries only, and read the collection at their keys."""
    r = random.Random(8)
    docs = [{"n": r.choice([1, 2, 2.5, 9007199254740993, 9007199254740992, "a", "b", None, True]), "s": r.choice("xyz")} for _ in range(60)] + [{"s": "x"}, {"n": [1]}]
    rows = schemaless(spark, docs)
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    specs = [ix.IndexSpec("by-n", "k", "n"), ix.IndexSpec("by-n-desc", "k", "n", True), ix.IndexSpec("by-s", "k", "s")]
    for s in specs:
        ix.build(rows, s, str(tmp_path / s.name))
    indexes = [ix.opened(spark, s, str(tmp_path / s.name)) for s in specs]
    for base, name in (({"where": {"s": "x"}}, "by-s"), ({"where": {"s": "y", "n": {"$gt": 1}}}, "by-s"), ({"sort": {"field": "n"}}, "by-n"), ({"sort": {"field": "n", "order": "desc"}, "where": {"s": "z"}}, "by-n-desc"), ({"sort": {"field": "n"}, "where": {"n": {"$gt": 9007199254740992}}}, "by-n"), ({"sort": {"field": "n"}, "where": {"n": {"$gte": "a"}, "s": "x"}}, "by-n")):
        want = [x.key for x in Query(rows, base | {"prefix": "k", "limit": 1000}).top().collect()]
        for more in ({"limit": 4}, {"limit": 50, "max_scanned": 5}):
            pages = list(follow(rows, base | {"prefix": "k"} | more, indexes))
            assert [x["key"] for p in pages for x in p["items"]] == want and {p["index"] for p in pages} == {name}, base
            assert all(len(p["items"]) <= more["limit"] and p["scanned"] <= more.get("max_scanned", 99) for p in pages)
    assert Query(rows, {"prefix": "k", "sort": {"field": "s"}}, indexes).page()["index"] == "by-s" and Query(rows, {"sort": {"field": "zz"}}, indexes).page()["index"] is None
    with pytest.raises(SortUnavailable):
        Query(rows, {"sort": {"field": "zz"}}, indexes).page(require_index=True)
    looked, _ = Query(rows, {"prefix": "k", "where": {"s": "x"}, "max_scanned": 3}, indexes)._looked(indexes[2])
    assert "In(key" in looked._jdf.queryExecution().toString()
    for bad in ({"sort": {"field": "n"}, "after": "00"}, {"sort": {"field": "n"}, "after": "zz"}, {"consistency": "bounded"}, {"max_staleness_ms": 5}, {"consistency": "odd"}):
        with pytest.raises(StoreError):
            Query(rows, bad)


def test_backfill_in_steps(spark, tmp_path):
    rows = schemaless(spark, [{"n": i % 7} for i in range(50)])
    spec, after, steps = ix.IndexSpec("by-n", "k", "n"), None, 0
    while True:
        after, steps = ix.backfill_step(rows, spec, str(tmp_path / "i"), after, 20), steps + 1
        if after is None:
            break
    built = spark.read.parquet(str(tmp_path / "i")).drop("step")
    assert steps == 3 and sorted(map(tuple, built.collect()), key=str) == sorted(map(tuple, ix.entries(rows, spec).collect()), key=str)
    assert ix.drop_step(built, 20).count() == 30


def test_prefix_end_and_ranges():
    assert prefix_end("a/") == "a0" and prefix_end("") is None and prefix_end("a\U0010ffff") == "b" and prefix_end("\U0010ffff") is None
    assert KeyRange(prefix="orders/1").within("orders/") and not KeyRange(prefix="ord").within("orders/") and KeyRange(start="orders/1", end="orders/2").within("orders/") and not KeyRange(start="orders/1").within("orders/")


@pytest.mark.parametrize("n", [0, 5, 4000, 4001, 9001])
def test_an_index_is_built_in_steps(spark, tmp_path, n):
    """The registered query, over its own table: none, less than one, whole and begun steps of 4,000 rows."""
    rows = spark.range(1, n + 1).select(F.col("id").alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.when(F.col("id") % 3 == 0, "P").otherwise("F").alias("o_orderstatus"),
                                        F.lit(2.5).alias("o_totalprice"), F.lit("2024-01-23").cast("date").alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority"))
    rows.write.parquet(str(tmp_path / "orders.parquet"))
    want = {"P": n // 3, "F": n - n // 3, "left": max(n - 4000, 0)}
    assert {x.text: x.n for x in QUERIES["index_backfill"](spark, str(tmp_path)).collect()} == {k: v for k, v in want.items() if v or k == "left"}
