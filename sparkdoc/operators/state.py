"""Change log and current state.

A log has (seq, kind, key, value, timestamp_ms, expires_at_ms, mutation_id): kind is put or delete, all rows of one
batch share seq, ``value`` is JSON text. Time is always a parameter, never the clock, so a result can be recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = "seq bigint, kind string, key string, value string, timestamp_ms bigint, expires_at_ms bigint, mutation_id string"
_REST = ["kind", "value", "timestamp_ms", "expires_at_ms", "mutation_id"]


def live_at(now_ms: int) -> Column:
    """Put and not expired; expiry is exclusive."""
    return (F.col("kind") == "put") & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms))


def newest(log: DataFrame, order: str = "seq") -> DataFrame:
    """Each key once, with its newest row: a maximum with map-side combining, so hot keys aren't gathered.

    Of rows of one batch on a key the last op counts, where the log has ``op`` (its number in the batch). Of other ties
    the greatest row does, so that replicas of one log come to one state.
    """
    rest = [c for c in log.columns if c not in ("key", order)]
    at = F.struct(order, *[c for c in rest if c == "op"], *[c for c in rest if c != "op"])
    newest = log.groupBy("key").agg(F.max_by(F.struct(order, *rest), at).alias("r"))
    return newest.select("key", *[F.col(f"r.{c}").alias(c) for c in (order, *rest)])


def current(log: DataFrame, now_ms: int) -> DataFrame:
    """Live records: key, value, version and what else records have."""
    return newest(log).where(live_at(now_ms)).withColumnRenamed("seq", "version").drop("kind", "op")


def latest(log: DataFrame, key: str) -> DataFrame:
    """The newest row of a key, tombstones and expired ones too: deleted, version, timestamp_ms, mutation_id."""
    row = newest(log.where(F.col("key") == key))
    return row.select("key", (F.col("kind") == "delete").alias("deleted"), F.col("seq").alias("version"), "timestamp_ms", "mutation_id")


def collection(state: DataFrame) -> DataFrame:
    """A state as a schemaless collection: ``value`` parsed, NULL where it is no JSON; ``value_json`` verbatim."""
    return state.withColumnRenamed("value", "value_json").withColumn("value", F.try_parse_json("value_json"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log up to a version: what a read at that version, or a session token, sees."""
    return log.where(F.col("seq") <= seq)


def served(rows: DataFrame, serving: DataFrame, partition: str = "partition") -> DataFrame:
    """Rows of the partitions that are served."""
    return rows.join(serving.select(partition).distinct(), partition, "left_semi")


def metadata(records: DataFrame, prefix: str = "") -> DataFrame:
    """Named internal records with a prefix, in name order; they are kept apart from data and no scan shows them."""
    return records.where(F.col("name").startswith(prefix)).orderBy("name")


def merge_layers(*layers: DataFrame) -> DataFrame:
    """The newest row of each key over several logs."""
    from functools import reduce

    return newest(reduce(DataFrame.unionByName, layers))


def compact(log: DataFrame, now_ms: int, retention_ms: int = 86_400_000) -> DataFrame:
    """Newest row per key; an expired put becomes a tombstone dated at its expiry; tombstones older than the retention go."""
    row = newest(log)
    expired = (F.col("kind") == "put") & (F.col("expires_at_ms") <= now_ms)
    expired = F.coalesce(expired, F.lit(False))
    row = row.withColumns({
        "kind": F.when(expired, "delete").otherwise(F.col("kind")), "value": F.when(~expired & (F.col("kind") == "put"), F.col("value")),
        "timestamp_ms": F.when(expired, F.col("expires_at_ms")).otherwise(F.col("timestamp_ms")), "expires_at_ms": F.when(~expired, F.col("expires_at_ms"))})
    return row.where((F.col("kind") == "put") | (F.col("timestamp_ms") + retention_ms > now_ms)).select(log.columns)


def purge(state: DataFrame, doomed: Column, written: DataFrame, seq: int, now_ms: int, mutation_id: str) -> DataFrame:
    """Log rows of a purging write: tombstones, in one version, for live keys that match and aren't in the batch itself, and the batch."""
    gone = state.where(doomed).join(written.select("key"), "key", "left_anti")
    tombs = gone.select(F.lit(seq).cast("long").alias("seq"), F.lit("delete").alias("kind"), "key", F.lit(None).cast("string").alias("value"), F.lit(now_ms).cast("long").alias("timestamp_ms"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit(mutation_id).alias("mutation_id"))
    return tombs.unionByName(written.select(tombs.columns))
