"""The client's view: a store over a change log table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StoreError
from .operators import state as st
from .operators.writes import RETENTION_MS, check_batch, fingerprint
from .plans.query import KeyRange, Query, follow
from .streaming import feed as streaming

_SCHEMA = st.LOG + ", op int, fingerprint string"


class Store:
    """Puts and gets for tools and tests; bulk work goes through the operators on ``log()``.

    Each batch is one Parquet file of the log, so a batch is there whole or not at all. A store has one writer.
    """

    def __init__(self, spark: SparkSession, path: str, indexes: list | None = None) -> None:
        self.spark, self.path, self.indexes = spark, path, indexes or []

    def log(self) -> DataFrame:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(conf).exists(at):
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(self.path)

    def state(self, now_ms: int, at_version: int | None = None) -> DataFrame:
        log = self.log() if at_version is None else st.as_of(self.log(), at_version)
        return st.current(log, now_ms).drop("fingerprint")

    def batch(self, ops: list[dict], now_ms: int, mutation_id: str | None = None) -> int:
        """Applies ops at once and returns their version; a retry with its id returns the first one's."""
        check_batch(ops)
        mutation_id = mutation_id or str(uuid.uuid4())
        log, said = self.log(), fingerprint(ops)
        known = log.where((F.col("mutation_id") == mutation_id) & (F.col("timestamp_ms") + RETENTION_MS > now_ms)).select("seq", "fingerprint").first()
        if known:
            if known.fingerprint != said:
                raise StoreError("the mutation id came with another payload", "mutation_id_reused")
            return known.seq
        conditional = {o["key"]: o for o in ops if o.get("if_absent") or o.get("if_version") is not None}
        if conditional:
            live = {r.key: r.version for r in st.current(log.where(F.col("key").isin(list(conditional))), now_ms).collect()}
            for key, o in conditional.items():
                if (o.get("if_absent") and key in live) or (o.get("if_version") is not None and live.get(key) != o["if_version"]):
                    raise StoreError(f"condition on {key} failed", "condition_failed", current_version=live.get(key))
        seq = (log.agg(F.max("seq")).first()[0] or 0) + 1
        rows = [(seq, o["op"], o["key"], o.get("value") if o["op"] == "put" else None, now_ms, now_ms + o["ttl_ms"] if o.get("ttl_ms") else None, mutation_id, i, said) for i, o in enumerate(ops)]
        self.spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return seq

    def put(self, key: str, value: str, now_ms: int, **options: object) -> int:
        mutation_id = options.pop("mutation_id", None)
        return self.batch([{"op": "put", "key": key, "value": value, **options}], now_ms, mutation_id)

    def delete(self, key: str, now_ms: int, **options: object) -> int:
        mutation_id = options.pop("mutation_id", None)
        return self.batch([{"op": "delete", "key": key, **options}], now_ms, mutation_id)

    def get(self, key: str, now_ms: int) -> dict | None:
        row = st.current(self.log().where(F.col("key") == key), now_ms).drop("fingerprint").first()
        return row.asDict() if row else None

    def latest(self, key: str) -> dict | None:
        row = st.latest(self.log(), key).first()
        return row.asDict() if row else None

    def mutation_status(self, mutation_id: str) -> int | None:
        """The committed version, or None if unknown."""
        return self.log().where(F.col("mutation_id") == mutation_id).agg(F.min("seq")).first()[0]

    def scan(self, now_ms: int, limit: int = 100, **keys: str) -> dict:
        """One page in key order and whether more follow."""
        rows = self.state(now_ms).where(KeyRange(**keys).predicate(F.col("key"))).orderBy("key").limit(limit + 1).collect()
        return {"items": [r.asDict() for r in rows[:limit]], "next_cursor": rows[limit - 1].key if len(rows) > limit else None}

    def collection(self, now_ms: int) -> DataFrame:
        return st.collection(self.state(now_ms))

    def query(self, spec: dict, now_ms: int) -> Query:
        return Query(self.collection(now_ms), spec, self.indexes)

    def query_page(self, spec: dict, now_ms: int) -> dict:
        return self.query(spec, now_ms).page()

    def query_pages(self, spec: dict, now_ms: int) -> Iterator[dict]:
        """All pages, one after the other."""
        return follow(self.collection(now_ms), spec, self.indexes)

    def aggregate(self, spec: dict, now_ms: int) -> dict:
        return self.query(spec, now_ms).aggregate()

    def watch(self, handler, checkpoint: str, prefix: str = ""):
        stream = self.spark.readStream.schema(_SCHEMA).parquet(self.path)
        return streaming.watch(stream, handler, checkpoint, prefix)
