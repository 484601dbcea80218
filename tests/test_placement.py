import pytest
import xxhash
from pyspark.sql import functions as F

from sparkdoc.errors import ArgumentError, StoreError
from sparkdoc.operators import index as ix
from sparkdoc.operators import placement as pl
from sparkdoc.plans.query import Index, KeyRange, Query

from .test_filters import schemaless

NODES = [("n1", "a"), ("n2", "a"), ("n3", "b")]


def model(nodes, rf, p):
    """The two-pass loop: one per zone by score, then fill."""
    order = sorted(nodes, key=lambda n: (-xxhash.xxh3_64_intdigest(n[0].encode(), seed=p), n[0]))
    chosen, zones = [], set()
    for n in order:
        if n[1] not in zones and len(chosen) < rf:
            chosen.append(n)
            zones.add(n[1])
    for n in order:
        if n not in chosen and len(chosen) < rf:
            chosen.append(n)
    return [n[0] for n in chosen]


def test_hash_vectors(spark):
    rows = spark.createDataFrame([("",), ("users/42",), ("orders/123",), ("a",)], "key string")
    assert [r.p for r in rows.select(pl.partition_of("key").alias("p")).collect()] == [1218, 1118, 2920, 3615]


def test_placement_equals_the_loop(spark):
    nodes = spark.createDataFrame(NODES, "node string, zone string")
    for rf in (2, 3):
        got = {r.partition: (list(r.replicas), r.diverse) for r in pl.replica_sets(pl.place(spark, nodes, rf, 512)).collect()}
        assert all(got[p][0] == model(NODES, rf, p) for p in range(512)) and all(v[1] == (rf == 2) for v in got.values())


def test_rebalance_moves_only_to_the_new_node(spark):
    make = lambda n: pl.place(spark, spark.createDataFrame(NODES[:n] + [], "node string, zone string"), 1, 256)
    moved = pl.rebalance(make(2), make(3), 9).collect()
    assert moved and all(r.added == ["n3"] and r.leader_changed and r.epoch == 9 for r in moved)
    assert pl.rebalance(make(2), make(2), 9).count() == 0
    load = {r.node: (r.replicas, r.leaders) for r in pl.load(make(3)).collect()}
    assert sum(x[0] for x in load.values()) == 256 == sum(x[1] for x in load.values())


def test_fence_groups_migration_and_chunks(spark):
    rows = spark.createDataFrame([(1, 2), (2, 2), (3, 2)], "c int, o int").select(pl.fence(F.col("c"), F.col("o")).alias("f"))
    assert [r.f for r in rows.collect()] == ["stale", "ok", "ahead"]
    moves = spark.createDataFrame([(1, "moving"), (2, "imported")], "partition int, state string")
    place = lambda n: pl.place(spark, spark.createDataFrame(NODES[:n], "node string, zone string"), 1, 64)
    with pytest.raises(StoreError) as e:
        pl.start_moves(moves, place(2), place(3), 4)
    assert e.value.code == "migrations_pending" and e.value.pending == 2
    begun = pl.start_moves(moves.withColumn("state", F.lit("done")), place(2), place(3), 4)
    assert {r.state for r in begun.collect()} == {"moving"} and begun.count() == pl.rebalance(place(2), place(3), 4).count()
    assert {r.partition: r.state for r in pl.advance(moves, moves).collect()} == {1: "fenced", 2: "done"}
    data = spark.createDataFrame([(1, f"k{i:02}", "x" * 10) for i in range(10)] + [(2, "a", "y" * 100)], "partition int, key string, value string")
    assert sorted((r.partition, r.chunk, r.n) for r in pl.chunked(data, 4, 1000).groupBy("partition", "chunk").agg(F.count("*").alias("n")).collect()) == [(1, 0, 4), (1, 1, 4), (1, 2, 2), (2, 0, 1)]


def test_digests_show_the_diverged_replica(spark):
    base = [(f"k{i}", "v", i, None) for i in range(50)]
    schema = "key string, value string, version long, expires_at_ms long"
    leaf = lambda rows, node: pl.digests(spark.createDataFrame(rows, schema), 0).select(F.lit(node).alias("node"), "partition", "leaf")
    leaves = leaf(base, "a").unionByName(leaf(base[::-1], "b")).unionByName(leaf(base[:-1] + [("k49", "w", 49, None)], "c"))
    got = {r.node: (r.majority, r.differing) for r in pl.compare_replicas(leaves).collect()}
    assert got == {"a": (True, 0), "b": (True, 0), "c": (False, 1)}
    assert leaf([*base, ("soon", "v", 99, 1000)], "a").exceptAll(leaf(base, "a")).count() == 0


def test_index_equals_scan(spark):
    values = [3, 1, "x", None, True, [1], {"a": 1}, 1.0, 9007199254740993, "y", False]
    rows = schemaless(spark, [{"v": v} for v in values] + [{}, "5"]).cache()
    spec = ix.IndexSpec("by-v", "k", "v")
    index = ix.entries(rows, spec)
    for v in (3, 1, 1.0, "x", None, True, False, 9007199254740993, 9007199254740992, "zz"):
        want = [r.key for r in Query(rows, {"where": {"v": v}}).all().orderBy("key").collect()]
        assert [r.key for r in ix.lookup(index, v).collect()] == want, v
    assert [r.key for r in ix.ordered(index, spec, 100).collect()] == [r.key for r in Query(rows, {"sort": {"field": "v"}}).top().collect()]
    assert [r.key for r in ix.ordered(index, spec, 100, low=1.0, high=4.0).collect()] == ["k001", "k007", "k000"]
    ready = [Index(spec, index)]
    assert Query(rows, {"prefix": "k0", "where": {"v": 3}}, ready).access().spec is spec and Query(rows, {"where": {"v": 3}}, ready).access() is None
    after = rows.where("key = 'k000'").withColumn("value", F.try_parse_json(F.lit('{"v": 77}')))
    assert [r.key for r in ix.lookup(ix.updated(index, rows.where("key = 'k000'"), after, spec), 77).collect()] == ["k000"]
    with pytest.raises(ArgumentError):
        ix.IndexSpec("Bad", "", "v")
    state = spark.createDataFrame([("by-v", spec.fingerprint, True), ("old", "x", True)], "name string, fingerprint string, built boolean")
    assert {r.name: r.state for r in ix.status([spec, ix.IndexSpec("new", "", "a")], state).collect()} == {"by-v": "ready", "old": "dropping", "new": "building"}
    assert ix.lookup(index, 3, KeyRange(start="k001")).count() == 0
