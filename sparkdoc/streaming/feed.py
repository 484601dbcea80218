"""Change feed, live views and streaming state over a change log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import ArgumentError, StoreError
from ..operators.state import LOG

#: Events that a live watcher may be behind.
BUS = 4096
CONSISTENCY = ("strict", "session", "bounded", "available", "eventual")


def log_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A change log's folder as a stream; ``max_files`` a trigger is the back-pressure."""
    reader = spark.readStream.schema(LOG)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def feed(log: DataFrame, prefix: str = "") -> DataFrame:
    """Change events: key, kind, value, version, mutation_id; one per op, none for deduplicated retries."""
    rows = log.where(~F.coalesce(F.col("deduplicated"), F.lit(False))) if "deduplicated" in log.columns else log
    if prefix:
        rows = rows.where(F.col("key").startswith(prefix))
    return rows.select("key", "kind", "value", F.col("seq").alias("version"), "mutation_id")


def watch(log: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, prefix: str = "") -> StreamingQuery:
    """Runs ``handler(events, batch)`` on what is there and ends; started again on one checkpoint it goes on where it was, so nothing is missed."""
    return feed(log, prefix).writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_retries(log: DataFrame, retention: str = "24 hours") -> DataFrame:
    """The stream with each mutation id's first row a key, within the retention."""
    return log.withColumn("at", F.timestamp_millis("timestamp_ms")).withWatermark("at", retention).dropDuplicatesWithinWatermark(["mutation_id", "key"]).drop("at")


def live_view(log: DataFrame) -> DataFrame:
    """The newest version of each key as a stream in update mode; a version never goes back."""
    return log.groupBy("key").agg(F.max_by(F.struct("kind", "value"), "seq").alias("r"), F.max("seq").alias("version")).select("key", "r.kind", "r.value", "version")


def snapshot(log: DataFrame, consistency: str = "strict", applied: int | None = None, committed: int | None = None, token: int | None = None, behind_ms: int | None = None, max_staleness_ms: int | None = None) -> DataFrame:
    """The log that a read may use on a replica that has applied it up to ``applied``.

    strict needs all that is committed; bounded all that was committed ``max_staleness_ms`` ago, the replica being
    ``behind_ms`` behind; session what its token names; the weak modes take what is there.
    """
    if consistency not in CONSISTENCY:
        raise ArgumentError(f"consistency is one of {CONSISTENCY}", "invalid_consistency")
    if (consistency == "bounded") != (max_staleness_ms is not None):
        raise ArgumentError("max_staleness_ms goes with bounded reads, and only with them")
    behind = applied is not None and {
        "strict": committed is not None and applied < committed,
        "bounded": committed is not None and applied < committed and (behind_ms is None or behind_ms > max_staleness_ms) if max_staleness_ms is not None else False,
        "session": token is not None and applied < token}.get(consistency, False)
    if behind:
        raise StoreError("the replica is behind", "not_caught_up", applied=applied)
    return log.where(F.col("seq") <= applied) if applied is not None else log


def lagged(log: DataFrame, seen: int, prefix: str = "", capacity: int = BUS) -> DataFrame:
    """One row (missed, resume): how many events after version ``seen`` a watcher lost, whose bus holds ``capacity``, and the version to read again from.

    The feed itself is read from the log, so a stream that goes on from its checkpoint never lags.
    """
    events = feed(log, prefix).where(F.col("version") > seen)
    return events.agg(F.greatest(F.count(F.lit(1)) - capacity, F.lit(0)).alias("missed"), F.coalesce(F.max("version"), F.lit(seen)).alias("resume"))


def coverage(serving: list[str], local: list[str]) -> dict:
    """What a watcher is told first: the groups whose changes it sees, and whether some are served elsewhere."""
    groups = sorted(set(serving) & set(local))
    return {"groups": groups, "partial": len(groups) < len(set(serving))}
