"""Replicas of logs with rows that have no key, and with ties."""

import duckdb
from pyspark.sql import functions as F

from sparkdoc.operators import state
from sparkdoc.queries import QUERIES, SQL


def test_replica_check_with_events_of_no_user(spark, tmp_path):
    i = F.col("id")
    events = spark.range(1, 400).select(i.alias("event_id"), F.timestamp_seconds(1_704_067_200 + i).alias("ts"), F.when(i % 50 != 0, i % 20).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = c.sql(SQL["replica_check"]).fetchall()
    assert sorted(map(tuple, QUERIES["replica_check"](spark, str(tmp_path)).collect())) == sorted(want) == [("n1", True, 0), ("n2", True, 0), ("n3", False, 1)]


def test_ties_come_to_one_state(spark):
    rows = [(7, "put", "a", v, 5, None, m) for v, m in (("1", "x"), ("3", "y"), ("2", "z"))]
    found = {tuple(state.newest(spark.createDataFrame(r, state.LOG).coalesce(1)).first()) for r in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(found) == 1
