"""Log, writes, conflicts, snapshots, feed and the store, against a plain model."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkdoc.errors import StoreError
from sparkdoc.operators import state, writes
from sparkdoc.sources import exchange
from sparkdoc.store import Store
from sparkdoc.streaming import feed

T0 = 1_000_000


def log_of(spark, rows):
    return spark.createDataFrame(rows, state.LOG)


def put(seq, key, value="{}", ts=T0, expires=None, mid=None):
    return (seq, "put", key, value, ts, expires, mid or f"m{seq}")


def test_layers_and_liveness(spark):
    log = log_of(spark, [put(1, "users/1"), put(2, "users/2"), (3, "delete", "users/1", None, T0, None, "m3"), put(4, "users/2", '{"a":1}'), put(5, "users/3", expires=T0 + 10)])
    assert [(r.key, r.version) for r in state.current(log, T0 + 9).orderBy("key").collect()] == [("users/2", 4), ("users/3", 5)]
    assert [r.key for r in state.current(log, T0 + 10).collect()] == ["users/2"]
    assert state.latest(log, "users/1").first().deleted and [r.key for r in state.current(state.as_of(log, 2), T0).orderBy("key").collect()] == ["users/1", "users/2"]


def test_ttl_and_retention(spark):
    log = log_of(spark, [put(1, "a", expires=T0 + 10_000), put(2, "b"), (3, "delete", "c", None, T0, None, "m3")])
    kept = lambda now: {(r.key, r.kind, r.timestamp_ms) for r in state.compact(log, now, 3_600_000).collect()}
    assert kept(T0 + 11_000) == {("a", "delete", T0 + 10_000), ("b", "put", T0), ("c", "delete", T0)}
    assert kept(T0 + 11_000 + 3_600_000) == {("b", "put", T0)}


def test_store_conditions_and_retries(spark, tmp_path):
    s = Store(spark, str(tmp_path / "log"))
    assert s.get("a", T0) is None
    v = s.put("a", '{"n":1}', T0, if_absent=True, mutation_id="x")
    assert s.put("a", '{"n":1}', T0 + 1, if_absent=True, mutation_id="x") == v and s.mutation_status("x") == v and s.mutation_status("y") is None
    with pytest.raises(StoreError, match="another payload") as e:
        s.put("a", '{"n":2}', T0, mutation_id="x")
    assert e.value.code == "mutation_id_reused"
    with pytest.raises(StoreError) as e:
        s.put("a", "{}", T0, if_absent=True)
    assert e.value.code == "condition_failed" and e.value.current_version == v
    with pytest.raises(StoreError):
        s.batch([{"op": "put", "key": "b", "value": "1"}, {"op": "put", "key": "a", "value": "1", "if_version": v + 7}], T0)
    assert s.get("b", T0) is None
    w = s.batch([{"op": "put", "key": "b", "value": "1"}, {"op": "delete", "key": "b"}, {"op": "put", "key": "c", "value": '{"n":5}', "ttl_ms": 10}], T0)
    assert s.get("b", T0) is None and s.get("c", T0 + 9)["version"] == w and s.get("c", T0 + 10) is None
    s.put("c", "2", T0 + 20, if_absent=True)  # an expired key is absent
    assert [r["key"] for r in s.scan(T0 + 20, 1, prefix="")["items"]] == ["a"] and s.query({"where": {"n": 1}}, T0).page()["items"][0]["key"] == "a"
    assert s.aggregate({"aggregate": {"count": True, "sum": "n"}}, T0) == {"count": 2, "sum": {"n": 1}}
    for bad in ([], [{"op": "put", "key": "", "value": "1"}], [{"op": "put", "key": "a", "value": "{"}], [{"op": "put", "key": "a", "value": "1", "ttl_ms": 0}], [{"op": "delete", "key": "a", "value": "1"}]):
        with pytest.raises(StoreError):
            s.batch(bad, T0)


def test_fold_equals_a_plain_model(spark):
    r = random.Random(7)
    rows, want = [], {}
    folds = {g: writes.Fold() for g in "ab"}
    for i in range(120):
        g, mid, now = r.choice("ab"), f"m{r.randrange(90)}", T0 + i * 1000
        ops = [{"op": r.choice(["put", "put", "delete"]), "key": f"{g}{r.randrange(4)}", "value": None, "ttl_ms": None, "if_version": None, "if_absent": False} for _ in range(r.choice([1, 1, 3]))]
        for o in ops:
            if o["op"] == "put":
                o["value"], o["ttl_ms"] = str(r.randrange(9)), r.choice([None, None, 3000])
            o["if_absent"] = r.random() < 0.2
        rows += [(g, i, k, mid, o["op"], o["key"], o["value"], o["ttl_ms"], o["if_version"], o["if_absent"], now) for k, o in enumerate(ops)]
        try:
            version, again, made = folds[g].write(mid, ops, now)
            want[g, i] = ("deduplicated", version) if again else ("applied", version)
        except StoreError as e:
            want[g, i] = (e.code, None)
    df = spark.createDataFrame(rows, "`group` string, idx long, op int, mutation_id string, kind string, key string, value string, ttl_ms long, if_version long, if_absent boolean, now_ms long")
    got = writes.fold_requests(df).collect()
    final = {g: {k: v["value"] for k, v in f.state.items() if v["kind"] == "put"} for g, f in folds.items()}
    have = {g: {} for g in "ab"}
    for x in sorted((x for x in got if x.outcome == "applied"), key=lambda x: (x.group, x.version, x.op)):
        have[x.group][x.key] = x.value
    assert {g: {k: v for k, v in d.items() if v is not None} for g, d in have.items()} == final
    count = lambda o: len({(x.group, x.version, x.mutation_id) for x in got if x.outcome == o}) if o == "applied" else sum(x.outcome == o for x in got)
    for o in ("applied", "deduplicated", "condition_failed", "mutation_id_reused"):
        assert count(o) == sum(w[0] == o for w in want.values()), o


def test_last_writer_wins_scenario(spark):
    steps = [(1, "strict", 700, "s1", "base"), (2, "", 300, "a1", "late"), (3, "", 1500, "a2", "fresh"), (4, "", 1500, "a2", "fresh"), (5, "", 2600, "d", None), (6, "", 2100, "a3", "behind")]
    kind = "idx long, key string, kind string, value string, timestamp_ms long, expires_at_ms long, mutation_id string, strict boolean, observed string"
    frame = lambda rows: spark.createDataFrame([(i, "k", "put" if v is not None else "delete", v, ts, None, m, s == "strict", seen) for i, s, ts, m, v, *rest in rows for seen in [rest[0] if rest else None]], kind)
    log = frame(steps)
    found = lambda log: sorted((r.mutation_id, r.reason) for r in writes.lww_conflicts(log).collect())
    four = [("a1", "lost"), ("a2", "overwritten"), ("a3", "lost"), ("s1", "overwritten")]
    assert found(log) == four and writes.resolve_lww(log).first().kind == "delete"
    # a retry changes nothing, after a newer write too
    assert found(frame([*steps, (7, "", 1500, "a2", "fresh")])) == four
    back = frame([*steps, (7, "", 3100, "a4", "back", "2600/d")])
    assert found(back) == four and writes.resolve_lww(back).first().value == "back"
    seen = log.withColumn("observed", F.when(F.col("idx") == 3, "700/s1"))
    assert ("s1", "overwritten") not in found(seen)
    lost = writes.lww_conflicts(log)
    assert writes.clear_conflicts(lost, lost.select("key", "mutation_id")).count() == 0


def test_retries_equal_the_fold(spark):
    """Arrivals in bulk against the sequential rules, with a renewed retention and changed payloads."""
    r = random.Random(11)
    hour = 3_600_000
    rows, want, fold, now = [], {}, writes.Fold(), T0
    for seq in range(1, 400):
        now += r.choice([0, 1, hour, 5 * hour])
        mid = f"m{r.randrange(25)}"
        ops = [{"op": "put", "key": f"k{i}", "value": str(r.randrange(2))} for i in range(r.choice([1, 1, 2]))]
        rows += [(seq, "put", o["key"], o["value"], now, None, mid) for o in ops]
        try:
            version, again, _ = fold.write(mid, ops, now)
            want[seq] = ("deduplicated" if again else "applied", version)
        except StoreError as e:
            want[seq] = (e.code, fold.mutations[mid][1])
    rows.append((1000, "put", "x", "1", now, None, None))
    real = {}
    for seq, (outcome, version) in want.items():  # the fold numbers what it applies; the log has its own numbers
        real[seq] = (outcome, real.setdefault(("at", version), seq) if outcome == "applied" else real[("at", version)])
    got = {x.seq: (x.outcome, x.version) for x in writes.first_of_each_mutation(log_of(spark, rows)).collect()}
    assert got == {k: v for k, v in real.items() if isinstance(k, int)} | {1000: ("applied", 1000)}
    hours = [(i, "put", "k", "1", T0 + h * hour, None, "same") for i, h in enumerate((0, 25, 26, 48, 49))]
    assert [x.deduplicated for x in writes.first_of_each_mutation(log_of(spark, hours)).orderBy("seq").collect()] == [False, False, True, True, False]


def test_export_import_and_snapshot(spark, tmp_path):
    log = log_of(spark, [put(1, 'q"1', '{"a": [1, 2]}'), put(2, "b", "3", expires=T0 + 500), put(3, "c", "4", expires=T0 + 5), (4, "delete", "d", None, T0, None, "m4")])
    exchange.export_lines(state.current(log, T0), str(tmp_path / "lines"))
    lines = [exchange.parse_line(r.value) for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert sorted((x["key"], json.dumps(x["value"]), x["expires_at_ms"]) for x in lines) == [("b", "3", T0 + 500), ("c", "4", T0 + 5), ('q"1', '{"a": [1, 2]}', None)]
    got = exchange.import_lines(spark, str(tmp_path / "lines"), T0 + 100)
    assert sorted((r.key, r.ttl_ms) for r in got.collect()) == [("b", 400), ('q"1', None)]
    assert exchange.import_lines(spark, str(tmp_path / "lines"), T0 + 100, got).count() == 0
    exchange.backup(log, str(tmp_path / "snap"))
    rows, last = exchange.restore(spark, str(tmp_path / "snap"))
    assert last == 4 and sorted((r.key, r.seq) for r in rows.collect()) == [("b", 2), ("c", 3), ('q"1', 1)]


def test_feed_goes_on_where_it_was(spark, tmp_path):
    at, seen = str(tmp_path / "log"), []
    handler = lambda df, _: seen.extend((r.key, r.kind, r.version) for r in df.collect())
    log_of(spark, [put(7, "a", mid="x"), (7, "delete", "b", None, T0, None, "x"), put(8, "z/1")]).coalesce(1).write.parquet(at)
    feed.watch(feed.log_stream(spark, at), handler, str(tmp_path / "c")).awaitTermination()
    assert sorted(seen) == [("a", "put", 7), ("b", "delete", 7), ("z/1", "put", 8)]
    log_of(spark, [put(9, "a")]).coalesce(1).write.mode("append").parquet(at)
    seen.clear()
    feed.watch(feed.log_stream(spark, at), handler, str(tmp_path / "c")).awaitTermination()
    assert seen == [("a", "put", 9)]
    view = feed.live_view(feed.log_stream(spark, at)).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "v")).start()
    view.awaitTermination()
    assert {(r.key, r.version) for r in spark.table("live").collect()} == {("a", 9), ("b", 7), ("z/1", 8)}
