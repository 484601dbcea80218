"""Commands of a group's log, scans over groups, and what watchers and readers are told."""

import json

import duckdb
import pytest
import xxhash

from sparkdoc import oracles
from sparkdoc.errors import ArgumentError, StoreError
from sparkdoc.operators import commands, state
from sparkdoc.operators.commands import Replica
from sparkdoc.plans.query import KeyRange
from sparkdoc.streaming import feed

part = lambda key: xxhash.xxh3_64_intdigest(key.encode()) % 4096
put = lambda key, value, **more: {"op": "put", "key": key, "value": value, **more}
write = lambda mid, now, *ops: {"type": "write", "mutation_id": mid, "now_ms": now, "ops": list(ops)}
offline = lambda mid, ts, *ops, **more: {"type": "available_write", "mutation_id": mid, "timestamp_ms": ts, "ops": list(ops), **more}


def test_writes_and_retries():
    r = Replica()
    assert r.apply(write("m1", 10, put("x", "1"), put("y", "2"))) == {"outcome": "applied", "version": 1}
    assert r.apply(write("m1", 20, put("x", "1"), put("y", "2"))) == {"outcome": "deduplicated", "version": 1}
    assert r.apply(write("m1", 20, put("x", "9")))["outcome"] == "mutation_id_reused"
    assert r.apply(write("m2", 30, put("x", "3", if_absent=True)))["outcome"] == "condition_failed" and r.apply({"type": "barrier"}) == {"outcome": "barrier"}
    with pytest.raises(ArgumentError):
        r.apply({"type": "reboot"})


def test_offline_writes_resolve_by_time():
    r = Replica()
    r.apply(write("s", 800, put("x", '"base"')))
    assert r.apply(offline("o1", 350, put("x", '"late"')))["lost"] == 1 and r.state["x"]["value"] == '"base"' and r.conflicts.keys() == {("x", "o1")}
    r.apply(offline("o2", 1700, put("x", '"fresh"')))
    assert r.state["x"]["value"] == '"fresh"' and r.conflicts.keys() == {("x", "o1"), ("x", "s")}
    assert r.apply(offline("o2", 1700, put("x", '"fresh"')))["outcome"] == "deduplicated" and len(r.conflicts) == 2
    r.apply(offline("o3", 2900, {"op": "delete", "key": "x"}))
    r.apply(offline("o4", 2200, put("x", '"behind"')))
    assert r.live("x", 3000) is None and len(r.conflicts) == 4
    r.apply(offline("o5", 3300, put("x", '"back"'), observed=[[2900, "o3"]]))
    assert r.state["x"]["value"] == '"back"' and len(r.conflicts) == 4
    r.apply({"type": "clear_conflicts", "key": "x", "mutation_id": "c", "now_ms": 4000})
    assert not r.conflicts


def test_a_partition_moves():
    source, target = Replica(), Replica(indexed=25)
    source.apply(write("m1", 10, put("x", "1"), put("z", "2", ttl_ms=100)))
    p = part("x")
    source.apply({"type": "fence", "partitions": [p], "mutation_id": "f", "now_ms": 20})
    assert source.apply(write("m2", 30, put("x", "5"))) == {"outcome": "moving", "partition": p} and source.apply(offline("m3", 30, put("x", "5")))["outcome"] == "moving"
    assert source.apply(write("m4", 30, put("y", "5")))["outcome"] == ("moving" if part("y") == p else "applied")
    target.apply(write("old", 5, put("x", '"stale"')))
    entries = [{"key": k, "value": r["value"], "ttl_ms": None} for k, r in source.state.items()]  # what isn't of the partition is left out
    target.apply({"type": "import", "partitions": [p], "clear": True, "entries": entries, "mutation_id": "i", "now_ms": 40})
    assert target.state["x"]["value"] == "1" and "z" not in target.state
    source.apply({"type": "release", "partitions": [p], "mutation_id": "r", "now_ms": 50})
    assert source.live("x", 60) is None and source.live("z", 60) and source.apply(write("m5", 60, put("x", "6")))["outcome"] == "moving"
    source.apply({"type": "import", "partitions": [p], "clear": True, "entries": [], "mutation_id": "j", "now_ms": 70})
    assert source.apply(write("m6", 80, put("x", "7")))["outcome"] == "applied"
    assert [target.apply({"type": "index_step", "limit": 10, "now_ms": 1})["indexed"] for _ in range(4)] == [10, 10, 5, 0]
    same = Replica()
    for c in (write("m1", 10, put("x", "1")), write("m2", 11, put("q", "1"))):
        same.apply(c)
    other = Replica()
    for c in (write("n1", 10, put("x", "1")), write("n2", 11, put("q", "1"))):
        other.apply(c)
    ask = {"type": "digest", "id": "d", "now_ms": 99}
    assert same.apply(ask) == other.apply(ask) and same.apply(write("m3", 12, put("q", "2")))["outcome"] == "applied" and same.apply(ask) != other.apply(ask)


def test_logs_of_many_groups(spark):
    logs = {f"g{g}": [write(f"m{i // 2}", 10 + i, put(f"k{(i // 2 + g) % 3}", str(i // 2))) if i % 5 else {"type": "barrier"} for i in range(20 + g)] for g in range(6)}
    rows = [(g, i, json.dumps(c)) for g, log in logs.items() for i, c in enumerate(log)]
    got = {(r.group, r.idx): (r.outcome, r.version) for r in commands.apply_commands(spark.createDataFrame(rows, "`group` string, idx long, command string")).collect()}
    for g, log in logs.items():
        replica = Replica()
        for i, c in enumerate(log):
            found = replica.apply(c)
            assert got[g, i] == (found["outcome"], found.get("version"))


def test_scan_over_groups(spark):
    rows = spark.createDataFrame([(f"k{i:03}", str(i)) for i in range(200)], "key string, value string")
    parts = {"a": (rows, list(range(2000))), "b": (rows, list(range(2000, 4096)))}
    found, partial = commands.cluster_scan(parts, KeyRange(start="k010", end="k150"), 50)
    assert [r.key for r in found.collect()] == [f"k{i:03}" for i in range(10, 60)] and not partial
    broken = parts | {"b": (None, list(range(2000, 4096)))}
    with pytest.raises(StoreError) as e:
        commands.cluster_scan(broken, KeyRange(), 5)
    assert e.value.code == "scan_incomplete" and e.value.errors == ["b"]
    found, partial = commands.cluster_scan(broken, KeyRange(), 500, "available")
    assert partial and {r.key for r in found.collect()} == {f"k{i:03}" for i in range(200) if part(f"k{i:03}") < 2000}


def test_watchers_and_readers(spark):
    log = spark.createDataFrame([(i, "put", f"k{i % 3}", "1", 0, None, f"m{i}") for i in range(1, 31)], state.LOG)
    assert tuple(feed.lagged(log, 4, capacity=10).first()) == (16, 30) and tuple(feed.lagged(log, 30).first()) == (0, 30) and tuple(feed.lagged(log, 4, "k1", 100).first()) == (0, 28)
    assert feed.coverage(["g2", "g1", "g3"], ["g1", "g9"]) == {"groups": ["g1"], "partial": True} and not feed.coverage(["g1"], ["g1"])["partial"]
    assert feed.snapshot(log, "eventual", applied=7, committed=30).count() == 7 and feed.snapshot(log, "session", applied=7, committed=30, token=7).count() == 7 and feed.snapshot(log).count() == 30
    assert feed.snapshot(log, "bounded", applied=7, committed=30, behind_ms=40, max_staleness_ms=50).count() == 7
    for bad in ({"consistency": "strict", "applied": 7, "committed": 30}, {"consistency": "session", "applied": 7, "token": 8}, {"consistency": "bounded", "applied": 7, "committed": 30, "behind_ms": 60, "max_staleness_ms": 50}, {"consistency": "bounded"}, {"consistency": "strict", "max_staleness_ms": 1}, {"consistency": "odd"}):
        with pytest.raises(StoreError):
            feed.snapshot(log, **bad)


def test_key_hash_in_sql():
    con = duckdb.connect()
    for make, keys in ((oracles.hash_16, ["users/0000000007", "abcdefghijklmnop"]), (oracles.hash_17, ["orders/0000012345", "zyxwvutsrqponmlkj"])):
        for k in keys:
            assert con.execute(f"SELECT {make('k')} FROM (SELECT '{k}' AS k)").fetchone()[0] == xxhash.xxh3_64_intdigest(k.encode())
    assert all(con.execute(f"SELECT {oracles.hash_short('k', 's')} FROM (SELECT 'n7' AS k, {s} AS s)").fetchone()[0] == xxhash.xxh3_64_intdigest(b"n7", seed=s) for s in (0, 5, 4095))
