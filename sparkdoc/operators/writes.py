"""Writes: last-writer-wins, retry dedupe, conditions, and the fold of request batches.

What is independent per key is a window or an aggregation. Only batches with conditions over several keys are
sequential by nature; they are folded per group (a set of keys whose batches don't meet those of others).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ArgumentError, StoreError

MAX_OPS, MAX_BYTES, MAX_KEY, MAX_VALUE = 10_000, 32 << 20, 1024, 4 << 20
RETENTION_MS = 86_400_000


def check_key(key: str) -> None:
    if not 1 <= len(key.encode()) <= MAX_KEY or key.startswith("\0"):
        raise ArgumentError("a key has 1 to 1024 bytes and doesn't begin with a zero byte", "invalid_key")


def check_batch(ops: list[dict]) -> None:
    """Limits and shapes of a batch's ops: op, key, value, ttl_ms, if_version, if_absent."""
    if not 1 <= len(ops) <= MAX_OPS:
        raise ArgumentError(f"1 to {MAX_OPS} ops", "invalid_batch")
    size = 0
    for op in ops:
        check_key(op["key"])
        if op.get("op") not in ("put", "delete"):
            raise ArgumentError("op is put or delete")
        if op["op"] == "put":
            try:
                json.loads(op["value"])
            except (TypeError, ValueError) as e:
                raise ArgumentError("a value is one JSON document", "invalid_value") from e
            if len(op["value"].encode()) > MAX_VALUE:
                raise ArgumentError("the value is too large", "value_too_large")
        elif op.get("value") is not None or op.get("ttl_ms") is not None:
            raise ArgumentError("a delete has no value or ttl")
        if op.get("ttl_ms") is not None and op["ttl_ms"] < 1:
            raise ArgumentError("ttl is 1 ms or more", "invalid_ttl")
        if op.get("if_version") is not None and op.get("if_absent"):
            raise ArgumentError("if_version and if_absent exclude each other")
        size += len(op["key"].encode()) + len((op.get("value") or "").encode())
    if size > MAX_BYTES:
        raise ArgumentError("the batch is too large", "invalid_batch")


def fingerprint(ops: list[dict]) -> str:
    """What a retry must repeat."""
    names = ("op", "key", "value", "ttl_ms", "if_version", "if_absent")
    return hashlib.sha256(json.dumps([[o.get(n) for n in names] for o in ops]).encode()).hexdigest()


class Fold:
    """The sequential rules of one group: batches are all or nothing, conditions see the state before the batch."""

    def __init__(self, retention_ms: int = RETENTION_MS) -> None:
        self.state: dict[str, dict] = {}
        self.mutations: dict[str, tuple[str, int, int]] = {}
        self.seq, self.retention = 0, retention_ms

    def live(self, key: str, now: int) -> dict | None:
        r = self.state.get(key)
        return r if r and r["kind"] == "put" and (r["expires_at_ms"] is None or r["expires_at_ms"] > now) else None

    def write(self, mutation_id: str, ops: list[dict], now: int) -> tuple[int, bool, list[dict]]:
        """(version, deduplicated, log rows); raises when a condition fails or an id comes with another payload."""
        check_batch(ops)
        known = self.mutations.get(mutation_id)
        if known and known[2] + self.retention > now:
            if known[0] != fingerprint(ops):
                raise StoreError("the mutation id came with another payload", "mutation_id_reused")
            return known[1], True, []
        for op in ops:
            row = self.live(op["key"], now)
            if (op.get("if_absent") and row) or (op.get("if_version") is not None and (not row or row["seq"] != op["if_version"])):
                raise StoreError(f"condition on {op['key']} failed", "condition_failed", current_version=row["seq"] if row else None)
        self.seq += 1
        rows = []
        for i, op in enumerate(ops):
            ttl = op.get("ttl_ms")
            rows.append({"seq": self.seq, "op": i, "kind": op["op"], "key": op["key"], "value": op.get("value") if op["op"] == "put" else None, "timestamp_ms": now, "expires_at_ms": now + ttl if ttl else None, "mutation_id": mutation_id})
        self.state.update((r["key"], r) for r in rows)
        self.mutations[mutation_id] = fingerprint(ops), self.seq, now
        return self.seq, False, rows


_OUT = "group string, mutation_id string, outcome string, version bigint, current_version bigint, op int, kind string, key string, value string, timestamp_ms bigint, expires_at_ms bigint"


def fold_requests(requests: DataFrame, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Requests (group, idx, op, mutation_id, kind, key, value, ttl_ms, if_version, if_absent, now_ms) applied in idx order per group.

    Yields the log rows of applied batches (outcome applied), and one row for each other batch: deduplicated or the
    error's code. Versions count within the group. A group's requests are streamed in order, batch after batch; the
    task holds the group's live state only.
    """
    kinds = requests.select("group", "idx", "op", "mutation_id", "kind", "key", "value", "ttl_ms", "if_version", "if_absent", "now_ms")
    ordered = kinds.repartition("group").sortWithinPartitions("group", "idx", "op")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fold, batch, held = None, Fold(retention_ms), None, []
        none = lambda x: None if pd.isna(x) else int(x)

        def apply() -> list[tuple]:
            if not held:
                return []
            first = held[0]
            ops = [{"op": r.kind, "key": r.key, "value": r.value, "ttl_ms": none(r.ttl_ms), "if_version": none(r.if_version), "if_absent": bool(r.if_absent) if not pd.isna(r.if_absent) else False} for r in held]
            try:
                version, again, rows = fold.write(first.mutation_id, ops, int(first.now_ms))
            except StoreError as e:
                return [(group, first.mutation_id, e.code, None, getattr(e, "current_version", None), None, None, None, None, None, None)]
            if again:
                return [(group, first.mutation_id, "deduplicated", version, None, None, None, None, None, None, None)]
            return [(group, first.mutation_id, "applied", version, None, r["op"], r["kind"], r["key"], r["value"], r["timestamp_ms"], r["expires_at_ms"]) for r in rows]

        columns = [x.strip().split()[0] for x in _OUT.split(",")]
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if (r.group, r.idx) != batch:
                    out += apply()
                    held = []
                    if r.group != group:
                        group, fold = r.group, Fold(retention_ms)
                    batch = (r.group, r.idx)
                held.append(r)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(apply(), columns=columns)

    return ordered.mapInPandas(run, _OUT)


def attempts(log: DataFrame, order: str = "seq", retention_ms: int = RETENTION_MS, payload: bool = True) -> DataFrame:
    """(mutation_id, ``order``, outcome, version): each arrival of a mutation id, judged by the ones before it.

    The record of a write lives for the retention, counted from that write's own time. An arrival while it lives is
    ``deduplicated`` and has the write's version, or, with ``payload``, ``mutation_id_reused`` if its ops differ; neither
    renews the record. One that finds none is ``applied``, a new write. An id's arrivals are streamed in order with
    one record held, so an id may come any number of times. Null ids are never retries.
    """
    op = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("kind", "key", "value") if c in log.columns], (F.col("expires_at_ms") - F.col("timestamp_ms")))
    said = F.concat_ws("/", F.count(F.lit(1)), F.bit_xor(op), F.sum(F.shiftright(op, 24))) if payload else F.lit("")
    each = log.where("mutation_id is not null").groupBy("mutation_id", order).agg(F.max("timestamp_ms").alias("at"), said.alias("said"))
    ordered = each.repartition("mutation_id").sortWithinPartitions("mutation_id", order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, record = None, None
        for frame in frames:
            ids, when, told = frame["mutation_id"].to_numpy(), frame["at"].to_numpy(), frame["said"].to_numpy()
            version, outcome = frame[order].to_numpy().copy(), ["applied"] * len(frame)
            again = [i for i in range(len(ids)) if ids[i] == (ids[i - 1] if i else last)]
            for i in again:
                if i and ids[i - 1] != (ids[i - 2] if i > 1 else last):  # the one before is the id's first
                    record = version[i - 1], told[i - 1], when[i - 1]
                if record[2] + retention_ms > when[i]:
                    outcome[i] = "deduplicated" if record[1] == told[i] else "mutation_id_reused"
                    version[i] = record[0]
                else:
                    record = version[i], told[i], when[i]
            if len(ids):
                if not again or again[-1] != len(ids) - 1:
                    record = version[-1], told[-1], when[-1]
                last = ids[-1]
            yield pd.DataFrame({"mutation_id": ids, order: frame[order], "outcome": outcome, "version": version})

    return ordered.mapInPandas(run, f"mutation_id string, {order} bigint, outcome string, version bigint")


def first_of_each_mutation(log: DataFrame, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Retry dedupe: the log with ``outcome`` and ``version`` of each row's batch; ``deduplicated`` marks what publishes nothing."""
    judged = log.join(attempts(log, "seq", retention_ms), ["mutation_id", "seq"], "left")
    out = F.coalesce("outcome", F.lit("applied"))
    return judged.select(*log.columns, out.alias("outcome"), F.coalesce("version", "seq").alias("version"), (out != "applied").alias("deduplicated"))


def without_retries(log: DataFrame, order: str = "idx", retention_ms: int = RETENTION_MS) -> DataFrame:
    """The log without batches that come again: an accepted write that is sent again isn't judged again."""
    again = attempts(log, order, retention_ms, payload=False).where("outcome <> 'applied'").select("mutation_id", order)
    return log.join(again, ["mutation_id", order], "left_anti").select(log.columns)


def last_writer_wins(log: DataFrame) -> DataFrame:
    """Rows (idx, key, timestamp_ms, mutation_id, strict, and others) with ``wins`` and the pair they met.

    A strict write always wins and sets the pair; other writes win with a greater (timestamp, id) than all since the
    last strict one. Retries are left out first. Windows are per key and stream in log order.
    """
    order = Window.partitionBy("key").orderBy("idx")
    rows = without_retries(log).withColumn("segment", F.sum(F.when(F.col("strict"), 1).otherwise(0)).over(order))
    before = Window.partitionBy("key", "segment").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    pair = F.struct("timestamp_ms", "mutation_id")
    rows = rows.withColumn("met", F.max(pair).over(before))
    return rows.withColumn("wins", F.col("strict") | F.col("met").isNull() | (pair > F.col("met"))).drop("segment")


def resolve_lww(log: DataFrame) -> DataFrame:
    """The winning row of each key: the newest that wins."""
    won = last_writer_wins(log).where("wins")
    rest = [c for c in log.columns if c != "key"]
    return won.groupBy("key").agg(F.max_by(F.struct(*rest), "idx").alias("r")).select("key", "r.*")


def lww_conflicts(log: DataFrame) -> DataFrame:
    """Losing values: writes that lost, and live values that a write overwrote without having seen them.

    ``observed``, where the log has it, is the (timestamp, id) text ``ts/id`` of the version that the writer saw.
    """
    judged = last_writer_wins(log)
    lost = judged.where("not wins").select("key", "value", "timestamp_ms", "mutation_id", F.col("met.timestamp_ms").alias("winner_timestamp_ms"), F.col("met.mutation_id").alias("winner_mutation_id"), F.lit("lost").alias("reason"))
    order = Window.partitionBy("key").orderBy("idx")
    won = judged.where("wins")
    prior = F.lag(F.struct("kind", "value", "timestamp_ms", "mutation_id", "expires_at_ms")).over(order)
    won = won.withColumn("prior", prior)
    live = (F.col("prior.kind") == "put") & (F.col("prior.expires_at_ms").isNull() | (F.col("prior.expires_at_ms") > F.col("timestamp_ms")))
    unseen = ~F.coalesce(F.col("observed") == F.concat_ws("/", F.col("prior.timestamp_ms"), F.col("prior.mutation_id")), F.lit(False)) if "observed" in log.columns else F.lit(True)
    over = won.where(~F.col("strict") & live & unseen).select("key", F.col("prior.value").alias("value"), F.col("prior.timestamp_ms").alias("timestamp_ms"), F.col("prior.mutation_id").alias("mutation_id"), F.col("timestamp_ms").alias("winner_timestamp_ms"), F.col("mutation_id").alias("winner_mutation_id"), F.lit("overwritten").alias("reason"))
    return lost.unionByName(over)


def reconcile(log: DataFrame, pending: DataFrame, most: int = 256) -> DataFrame:
    """Log rows of one pass over accepted writes: the ``most`` first by (timestamp, id) that the log doesn't have, with the next idx.

    A pass is that small by design, so that its numbering is one short sort; passes are repeated until none is left.
    """
    fresh = pending.join(log.select("mutation_id").distinct(), "mutation_id", "left_anti").dropDuplicates(["mutation_id", "key"])
    first = fresh.orderBy("timestamp_ms", "mutation_id", "key").limit(most)
    last = log.agg(F.max("idx")).first()[0] or 0
    numbered = first.withColumn("idx", F.row_number().over(Window.orderBy("timestamp_ms", "mutation_id", "key")) + F.lit(last))
    return numbered.withColumn("strict", F.lit(False))


def list_conflicts(conflicts: DataFrame, prefix: str = "", limit: int = 100) -> DataFrame:
    return conflicts.where(F.col("key").startswith(prefix)).orderBy("key", "mutation_id").limit(limit)


def clear_conflicts(conflicts: DataFrame, cleared: DataFrame) -> DataFrame:
    """Conflicts without those cleared, by (key, mutation_id)."""
    return conflicts.join(cleared.select("key", "mutation_id"), ["key", "mutation_id"], "left_anti")


def hybrid_timestamp(now_ms, observed):
    """A write's timestamp: not before what the writer has seen."""
    return F.greatest(now_ms, F.coalesce(observed, F.lit(-1)) + 1)
