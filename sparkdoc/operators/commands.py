"""What a replication group does with the commands of its log, and scans over several groups.

A group's log is sequential: each command sees what the ones before it left. ``Replica`` has these rules, time coming
from the commands; ``apply_commands`` streams the logs of many groups through them, one group after the other in a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, StoreError
from ..plans.query import KeyRange
from .placement import PARTITIONS, partition_of
from .writes import Fold

WEAK = ("available", "eventual")


def _partition(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode()) % PARTITIONS


class Replica(Fold):
    """A group's state: its records, conflicts, the partitions that don't take writes, digests and index work left."""

    def __init__(self, indexed: int = 0) -> None:
        super().__init__()
        self.closed: dict[int, str] = {}
        self.conflicts: dict[tuple[str, str], dict] = {}
        self.digests: dict[str, int] = {}
        self.to_index = indexed

    def apply(self, command: dict) -> dict:
        """The outcome of one command: ``outcome``, and ``version`` where it wrote."""
        rules = {"write": self._write, "available_write": self._available, "barrier": lambda c: {"outcome": "barrier"}, "digest": self._digest, "index_step": self._index_step,
                 "clear_conflicts": self._clear, "fence": self._fence, "release": self._release, "import": self._import}
        if command.get("type") not in rules:
            raise ArgumentError(f"unknown command {command.get('type')!r}")
        try:
            return rules[command["type"]](command)
        except StoreError as e:
            return {"outcome": e.code}

    def _moving(self, ops: list[dict]) -> dict | None:
        at = next((p for o in ops if (p := _partition(o["key"])) in self.closed), None)
        return None if at is None else {"outcome": "moving", "partition": at}

    def _write(self, c: dict) -> dict:
        if moving := self._moving(c["ops"]):
            return moving
        version, again, _ = self.write(c["mutation_id"], c["ops"], c["now_ms"])
        return {"outcome": "deduplicated" if again else "applied", "version": version}

    def _available(self, c: dict) -> dict:
        """Last writer wins by (timestamp, id), key by key; what loses, or is overwritten unseen while live, is a conflict."""
        if moving := self._moving(c["ops"]):
            return moving
        mid, ts = c["mutation_id"], c["timestamp_ms"]
        known = self.mutations.get(mid)
        if known and known[2] + self.retention > ts:
            return {"outcome": "deduplicated", "version": known[1]}
        seen, wins = c.get("observed") or [], []
        for i, op in enumerate(c["ops"]):
            stored = self.state.get(op["key"])
            pair = (stored["timestamp_ms"], stored["mutation_id"]) if stored else None
            if pair and pair >= (ts, mid):
                self.conflicts[op["key"], mid] = {"value": op.get("value"), "winner": pair[1]}
                continue
            was_seen = i < len(seen) and seen[i] is not None and tuple(seen[i]) == pair
            if pair and self.live(op["key"], ts) and not was_seen:
                self.conflicts[op["key"], pair[1]] = {"value": stored["value"], "winner": mid}
            wins.append({k: v for k, v in op.items() if k not in ("if_version", "if_absent")})
        self.seq += 1
        for i, op in enumerate(wins):
            self._put(op["key"], op.get("value"), op["op"], ts, op.get("ttl_ms"), mid, i)
        self.mutations[mid] = "", self.seq, ts
        return {"outcome": "applied", "version": self.seq, "lost": len(c["ops"]) - len(wins)}

    def _put(self, key: str, value: str | None, kind: str, now: int, ttl: int | None, mid: str, i: int = 0) -> None:
        self.state[key] = {"seq": self.seq, "op": i, "kind": kind, "key": key, "value": value if kind == "put" else None, "timestamp_ms": now, "expires_at_ms": now + ttl if ttl else None, "mutation_id": mid}

    def _digest(self, c: dict) -> dict:
        rows = sorted((k, r["value"], r["seq"]) for k, r in self.state.items() if self.live(k, c["now_ms"] + 60_000) or (r["kind"] == "put" and r["expires_at_ms"] is None))
        self.digests[c["id"]] = xxhash.xxh3_64_intdigest(json.dumps(rows).encode()) >> 1
        return {"outcome": "barrier", "digest": self.digests[c["id"]]}

    def _index_step(self, c: dict) -> dict:
        done = min(self.to_index, c["limit"])
        self.to_index -= done
        self.seq += 1
        return {"outcome": "applied", "version": self.seq, "indexed": done}

    def _clear(self, c: dict) -> dict:
        mine = [k for k in self.conflicts if k[0] == c["key"]]
        for k in mine:
            del self.conflicts[k]
        self.seq += bool(mine)
        return {"outcome": "done"}

    def _fence(self, c: dict) -> dict:
        fresh = [p for p in c["partitions"] if p not in self.closed]
        self.closed.update(dict.fromkeys(fresh, "fenced"))
        self.seq += bool(fresh)
        return {"outcome": "done"}

    def _purge(self, partitions: set[int], but: set[str], now: int, mid: str) -> None:
        for key in [k for k in self.state if k not in but and _partition(k) in partitions and self.live(k, now)]:
            self._put(key, None, "delete", now, None, mid)

    def _release(self, c: dict) -> dict:
        gone = {p for p in c["partitions"] if self.closed.get(p) != "released"}
        if gone:
            self.seq += 1
            self._purge(gone, set(), c["now_ms"], c["mutation_id"])
            self.closed.update(dict.fromkeys(gone, "released"))
        return {"outcome": "done"}

    def _import(self, c: dict) -> dict:
        """Entries (key, value, remaining ttl_ms) of the partitions; ``clear`` begins anew and opens the partitions again."""
        mine = set(c["partitions"])
        rows = [e for e in c.get("entries", []) if _partition(e["key"]) in mine]
        if (c.get("clear") and mine) or (rows and not c.get("clear")):
            self.seq += 1
            if c.get("clear"):
                self._purge(mine, {e["key"] for e in rows}, c["now_ms"], c["mutation_id"])
                for p in mine:
                    self.closed.pop(p, None)
            for i, e in enumerate(rows):
                self._put(e["key"], e["value"], "put", c["now_ms"], e.get("ttl_ms"), c["mutation_id"], i)
        return {"outcome": "done"}


def apply_commands(log: DataFrame, indexed: int = 0) -> DataFrame:
    """Commands (group, idx, command as JSON) in idx order per group: (group, idx, outcome, version, applied: the last version, n_conflicts) after each."""
    ordered = log.select("group", "idx", "command").repartition("group").sortWithinPartitions("group", "idx")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, replica = None, None
        for frame in frames:
            out = []
            for name, idx, text in zip(frame["group"], frame["idx"], frame["command"], strict=True):
                if replica is None or name != group:
                    group, replica = name, Replica(indexed)
                found = replica.apply(json.loads(text))
                out.append((name, idx, found["outcome"], found.get("version"), replica.seq, len(replica.conflicts)))
            yield pd.DataFrame(out, columns=["group", "idx", "outcome", "version", "applied", "n_conflicts"]).astype({"version": "Int64"})

    return ordered.mapInPandas(run, "group string, idx bigint, outcome string, version bigint, applied bigint, n_conflicts bigint")


def cluster_scan(parts: dict[str, tuple[DataFrame | None, list[int]]], keys: KeyRange, limit: int, consistency: str = "strict") -> tuple[DataFrame, bool]:
    """(first ``limit`` records by key over all groups, partial). ``parts``: a group's records, None if it can't be reached, and the partitions it serves.

    Rows of partitions that a group doesn't serve (imported ones, or not yet purged) are left out. Where a group is
    missing, a strict scan fails, and a weak one is partial.
    """
    missing = sorted(g for g, (rows, _) in parts.items() if rows is None)
    if missing and consistency not in WEAK:
        raise StoreError("some groups could not serve the scan", "scan_incomplete", outcome="not_applied", errors=missing)
    known = [(rows, serving) for rows, serving in parts.values() if rows is not None]
    if not known:
        raise StoreError("no group could be reached", "scan_incomplete", errors=missing)
    mine = [rows.where(keys.predicate(F.col("key"))).withColumn("_partition", partition_of("key")).where(F.col("_partition").isin(serving)).drop("_partition") for rows, serving in known]  # 4096 numbers at most
    return reduce(DataFrame.unionByName, mine).orderBy("key").limit(limit), bool(missing)
