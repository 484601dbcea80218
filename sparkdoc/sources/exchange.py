"""Sources and sinks: snapshots, JSON lines export and import."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all of a cluster's machines see; a temporary one where all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None and not spark.sparkContext.master.startswith("local"):
        raise StoreError("spark.checkpoint.dir is not set", "invalid_argument")
    return found or tempfile.mkdtemp("-shared")


def backup(log: DataFrame, path: str) -> None:
    """Every newest put, expired ones too, no tombstones, as Parquet sorted by key; beside it the last seq and a checksum."""
    from ..operators.state import newest

    state = newest(log).where("kind = 'put'")
    state.repartitionByRange("key").sortWithinPartitions("key").write.mode("errorifexists").parquet(f"{path}/state")
    written = log.sparkSession.read.parquet(f"{path}/state")
    _summary(written).crossJoin(log.agg(F.max("seq").alias("last_seq"))).coalesce(1).write.parquet(f"{path}/manifest")  # one row by one row


def _summary(state: DataFrame) -> DataFrame:
    h = F.xxhash64("key", "value", "seq")
    return state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("checksum"))


def restore(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(log rows with their original versions, last seq); refuses a damaged snapshot."""
    state = spark.read.parquet(f"{path}/state")
    said = spark.read.parquet(f"{path}/manifest").first()
    found = _summary(state).first()
    if (found.n, found.checksum) != (said.n, said.checksum):
        raise StoreError("the snapshot doesn't match its manifest", "corrupt")
    return state, said.last_seq or 0


def export_lines(state: DataFrame, path: str, prefix: str = "") -> None:
    """One JSON object a line: key, value, expires_at_ms; the value stays as it was written."""
    rows = state.where(F.col("key").startswith(prefix)) if prefix else state
    quoted = F.to_json(F.struct("key"))
    line = F.concat(F.substring(quoted, F.lit(1), F.length(quoted) - 1), F.lit(',"value":'), F.col("value"), F.lit(',"expires_at_ms":'), F.coalesce(F.col("expires_at_ms").cast("string"), F.lit("null")), F.lit("}"))
    rows.repartitionByRange("key").sortWithinPartitions("key").select(line.alias("line")).write.mode("errorifexists").text(path)


def import_lines(spark: SparkSession, path: str, now_ms: int, applied: DataFrame | None = None, batch: int = 1000) -> DataFrame:
    """Put requests from JSON lines: mutation_id, key, value, ttl_ms. Expired lines are left out.

    Lines are batched by key hash; a batch's id is a hash of its lines, so importing the same lines again gives the ids
    in ``applied``, which are left out.
    """
    v = F.try_parse_json("line")
    rows = spark.read.text(path).select(F.col("value").alias("line")).select(
        "line", F.try_variant_get(v, "$.key", "string").alias("key"), F.to_json(F.variant_get(v, "$.value", "variant")).alias("value"), F.try_variant_get(v, "$.expires_at_ms", "bigint").alias("expires_at_ms"))
    rows = rows.where(F.col("key").isNotNull() & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms)))
    n = max(1, rows.count() // batch)
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(n)))
    ids = rows.groupBy("slot").agg(F.md5(F.concat_ws(",", F.bit_xor(F.xxhash64("line")).cast("string"), F.sum(F.pmod(F.xxhash64("line", F.lit(1)), F.lit(1 << 40))).cast("string"), F.count(F.lit(1)).cast("string"))).alias("mutation_id"))
    out = rows.join(ids, "slot").select("mutation_id", "key", "value", (F.col("expires_at_ms") - now_ms).alias("ttl_ms"))
    return out if applied is None else out.join(applied.select("mutation_id").distinct(), "mutation_id", "left_anti")


def parse_line(line: str) -> dict:
    """One exported line, checked."""
    row = json.loads(line)
    if set(row) != {"key", "value", "expires_at_ms"}:
        raise StoreError("not an exported line", "invalid_argument")
    return row
