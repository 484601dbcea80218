"""Placement: hash partitions, rendezvous replicas, routing, rebalance, groups, digests, migration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StoreError

PARTITIONS = 4096


@F.pandas_udf(T.IntegerType())
def partition_of(keys: pd.Series) -> pd.Series:
    """xxh3_64 of the key modulo 4096; Spark's own xxhash64 is another function."""
    return keys.map(lambda k: None if k is None else xxhash.xxh3_64_intdigest(k.encode()) % PARTITIONS)


@F.pandas_udf(T.DecimalType(20, 0))
def _score(nodes: pd.Series, partitions: pd.Series) -> pd.Series:
    from decimal import Decimal

    return pd.Series([Decimal(xxhash.xxh3_64_intdigest(n.encode(), seed=int(p))) for n, p in zip(nodes, partitions, strict=True)])


def place(spark: SparkSession, nodes: DataFrame, rf: int, partitions: int = PARTITIONS) -> DataFrame:
    """(partition, rank, node, zone): by score one replica per zone first, then the best of the rest.

    The input is a cluster's nodes times 4096 partitions, whatever the data's size.
    """
    grid = spark.range(partitions).select(F.col("id").cast("int").alias("partition"), F.explode(F.array(*[F.struct(F.lit(r.node).alias("node"), F.lit(r.zone).alias("zone")) for r in sorted(nodes.select("node", "zone").distinct().collect())])).alias("n"))
    scored = grid.select("partition", "n.node", "n.zone").withColumn("score", _score("node", "partition"))
    best = [F.col("score").desc(), F.col("node").asc()]
    scored = scored.withColumn("in_zone", F.row_number().over(Window.partitionBy("partition", "zone").orderBy(*best)))
    rank = F.row_number().over(Window.partitionBy("partition").orderBy((F.col("in_zone") > 1).cast("int"), *best)) - 1
    return scored.withColumn("rank", rank).where(F.col("rank") < rf).select("partition", "rank", "node", "zone")


def replica_sets(placed: DataFrame) -> DataFrame:
    """(partition, replicas in rank order, zones, diverse)."""
    rows = placed.groupBy("partition").agg(F.sort_array(F.collect_list(F.struct("rank", "node", "zone"))).alias("r"))
    return rows.select("partition", F.col("r.node").alias("replicas"), F.col("r.zone").alias("zones"), (F.size(F.array_distinct("r.zone")) == F.size("r")).alias("diverse"))


def rebalance(old: DataFrame, new: DataFrame, epoch: int) -> DataFrame:
    """Partitions that move: added, removed, leader_changed, and their epoch. Others keep theirs."""
    a, b = replica_sets(old).select("partition", F.col("replicas").alias("was")), replica_sets(new).select("partition", F.col("replicas").alias("now"))
    both = a.join(b, "partition", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    none = F.array().cast("array<string>")
    was, now = F.coalesce("was", none), F.coalesce("now", none)
    return both.select("partition", F.array_except(now, was).alias("added"), F.array_except(was, now).alias("removed"), (~F.get(was, F.lit(0)).eqNullSafe(F.get(now, F.lit(0)))).alias("leader_changed"), F.lit(epoch).alias("epoch"))


def route(keys: DataFrame, placed: DataFrame) -> DataFrame:
    """Each key with its partition and replicas; the map has 4096 rows, so it can be broadcast."""
    return keys.withColumn("partition", partition_of("key")).join(F.broadcast(replica_sets(placed)), "partition", "left")


def fence(client_epoch: Column, own_epoch: Column) -> Column:
    return F.when(client_epoch < own_epoch, "stale").when(client_epoch > own_epoch, "ahead").otherwise("ok")


def load(placed: DataFrame) -> DataFrame:
    return placed.groupBy("node").agg(F.count(F.lit(1)).alias("replicas"), F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).alias("leaders"))


def groups(placed: DataFrame) -> DataFrame:
    """Partitions with one replica set: group_id is the sorted node ids joined by +."""
    sets = replica_sets(placed).withColumn("group_id", F.array_join(F.sort_array("replicas"), "+"))
    return sets.groupBy("group_id").agg(F.count(F.lit(1)).alias("partitions"), F.min("partition").alias("first_partition"))


def fenced_export(state: DataFrame, moving: DataFrame, now_ms: int) -> DataFrame:
    """Live rows of moving partitions with the time they have left."""
    rows = state.withColumn("partition", partition_of("key")).join(moving.select("partition").distinct(), "partition", "left_semi")
    return rows.select("partition", "key", "value", (F.col("expires_at_ms") - now_ms).alias("remaining_ms"))


def chunked(rows: DataFrame, max_rows: int = 1000, max_bytes: int = 4 << 20) -> DataFrame:
    """Rows per partition in key order with a chunk number: a chunk ends before its rows or bytes would be too many."""
    ordered = rows.repartition("partition").sortWithinPartitions("partition", "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, chunk, n, size = None, 0, 0, 0
        for frame in frames:
            out = []
            for p, key, value in zip(frame["partition"], frame["key"], frame["value"], strict=True):
                own = len(key.encode()) + len((value or "").encode())
                if p != part:
                    part, chunk, n, size = p, 0, 0, 0
                elif n >= max_rows or size + own > max_bytes:
                    chunk, n, size = chunk + 1, 0, 0
                n, size = n + 1, size + own
                out.append(chunk)
            yield frame.assign(chunk=pd.Series(out, index=frame.index, dtype="int32"))

    return ordered.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", chunk int")


def start_moves(moves: DataFrame, old: DataFrame, new: DataFrame, epoch: int) -> DataFrame:
    """(partition, state, epoch) of the moves that a new placement asks for; refused while others are pending."""
    if pending := moves.where("state <> 'done'").count():
        raise StoreError(f"{pending} moves are still running", "migrations_pending", pending=pending)
    return rebalance(old, new, epoch).select("partition", F.lit("moving").alias("state"), "epoch")


MOVES = {"moving": "fenced", "fenced": "imported", "imported": "done"}


def advance(moves: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Migration states one step on for the partitions that acknowledged theirs."""
    step = F.create_map(*[F.lit(x) for kv in MOVES.items() for x in kv])
    ack = acknowledged.select("partition", F.lit(True).alias("ack")).distinct()
    return moves.join(ack, "partition", "left").withColumn("state", F.when(F.col("ack"), F.coalesce(step[F.col("state")], F.col("state"))).otherwise(F.col("state"))).drop("ack")


def digests(state: DataFrame, now_ms: int, grace_ms: int = 60_000) -> DataFrame:
    """(partition, n, leaf): order-free digests of live rows; rows that expire within the grace are left out on every replica.

    Sums and xors of row hashes combine on the map side, so no partition is gathered or sorted.
    """
    rows = state.where(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now_ms + grace_ms)).withColumn("partition", partition_of("key"))
    # 60 bits of a digest that every SQL engine has
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", "key", F.coalesce("value", F.lit("\x1e")), F.col("version").cast("string"))), 1, 15), 16, 10).cast("long")
    leaf = rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"))
    return leaf.select("partition", "n", F.md5(F.concat_ws("/", "n", "x", "s")).alias("leaf"))


def root(leaves: DataFrame) -> DataFrame:
    return leaves.agg(F.xxhash64(F.bit_xor(F.xxhash64("partition", "leaf")), F.count(F.lit(1))).alias("root"))


def compare_replicas(leaves: DataFrame) -> DataFrame:
    """``leaves``: node, partition, leaf. Per node: root, whether it is with the majority, and how many partitions differ from the majority's."""
    roots = leaves.groupBy("node").agg(F.xxhash64(F.bit_xor(F.xxhash64("partition", "leaf")), F.count(F.lit(1))).alias("root"))
    votes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("votes"))
    n = leaves.select("node").distinct().count()
    major = votes.where(F.col("votes") * 2 > n).select("root", F.lit(True).alias("majority"))
    marked = roots.join(major, "root", "left").withColumn("majority", F.coalesce("majority", F.lit(False)))
    model = marked.where("majority").orderBy("node").limit(1).select(F.col("node").alias("model"))
    want = leaves.join(model, leaves["node"] == model["model"], "left_semi").select("partition", F.col("leaf").alias("want"))
    nodes = marked.select("node")
    full = nodes.join(want, how="cross")  # nodes times 4096 at most
    # rows without a key are in no partition: one of its own here
    held = leaves.select(F.col("node").alias("holder"), F.col("partition").alias("at"), "leaf")
    both = full.join(held, (F.col("node") == F.col("holder")) & F.col("partition").eqNullSafe(F.col("at")), "full")
    diff = both.where(~F.col("leaf").eqNullSafe(F.col("want"))).groupBy(F.coalesce("node", "holder").alias("node")).agg(F.count(F.lit(1)).alias("differing"))
    return marked.join(diff, "node", "left").withColumn("differing", F.coalesce("differing", F.lit(0)))
