"""Registered queries of the document engine, each an engine call over the generated tables, and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import index as ix
from .operators import commands, placement, state, writes
from .oracles import hash_16, hash_17, partition_sql, placed_sql, sets_sql
from .plans.query import KeyRange, Query, aggregate_pages, paged_groups
from .sources import collections as c
from .sources import exchange
from .sources.exchange import shared_folder

NOW_MS = 1_706_000_000_000  # 2024-01-23, within the events
_kept = lambda make: lambda s, d: c.stored(make, s, d)
orders, events, mixed, labeled, order_docs = map(_kept, (c.orders, c.events, c.mixed, c.document_labels, c.order_documents))
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ORDERS = """(SELECT 'orders/' || lpad(o_orderkey::varchar, 10, '0') AS key, o_orderkey AS id, o_custkey AS customer, o_orderstatus AS status,
  o_totalprice AS total, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS priority FROM orders)"""
_EVENTS = """(SELECT 'events/' || lpad(event_id::varchar, 10, '0') AS key, user_id, event_type AS type, cast(props->>'$.k' AS bigint) AS k FROM events)"""
_LOG = f"""(SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind, 'users/' || lpad(user_id::varchar, 10, '0') AS key,
  CASE WHEN event_type <> 'error' THEN props END AS value, epoch_us(ts) // 1000 AS timestamp_ms, CASE WHEN event_type = 'signup' THEN epoch_us(ts) // 1000 + {c.EVENTS_TTL_MS} END AS expires_at_ms,
  lpad(event_id::varchar, 12, '0') AS mutation_id FROM events)"""
_DOCS = """(SELECT 'docs/' || lpad(d.doc_id::varchar, 10, '0') AS key, lang, source, n_chars, text, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"""
_LABELS = """(SELECT 'docs/' || lpad(d.doc_id::varchar, 10, '0') AS key, lang, CASE WHEN d.doc_id % 7 = 0 THEN 'null' WHEN quality IS NULL THEN 'missing' ELSE quality::varchar END AS q
  FROM documents d LEFT JOIN labels USING (doc_id))"""
_MIXED = """(SELECT 'orders/' || lpad(o_orderkey::varchar, 10, '0') AS key, o_orderkey AS k, o_orderstatus AS status,
  CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 5 = 0 THEN 'text' ELSE 'number' END AS kind FROM orders)"""
_LATEST = f"(SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _where(name: str, collection: Callable, where: dict, source: str, sql: str) -> None:
    """All keys that match a filter."""
    _add(name, lambda s, d: Query(collection(s, d), {"where": where}).all().select("key"), f"SELECT key FROM {source} WHERE {sql}")


def flagship_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"prefix": "orders/", "where": {"status": "F", "total": {"$gte": 100000}}, "aggregate": {"count": True, "sum": "total", "min": "date", "max": ["date", "total"]}}
    return Query(c.orders(spark, sf_dir), spec).aggregated().withColumn("sum_total", F.round("sum_total", 2))


_add("flagship_orders", flagship_orders, f"SELECT count(*) AS count, round(sum(total), 2) AS sum_total, min(date) AS min_date, max(date) AS max_date, max(total) AS max_total FROM {_ORDERS} WHERE status = 'F' AND total >= 100000")

# scans
_add("get_point", lambda s, d: Query(orders(s, d), {"start": "orders/0000000007", "end": "orders/0000000007\0"}).all().select("key", "value.status", "value.total"), f"SELECT key, status, total FROM {_ORDERS} WHERE key = 'orders/0000000007'")
_add("scan_prefix_orders", lambda s, d: Query(orders(s, d), {"prefix": "orders/00000000", "limit": 50}).top().select("key", "value.status"), f"SELECT key, status FROM {_ORDERS} WHERE starts_with(key, 'orders/00000000') ORDER BY key LIMIT 50")
_add("scan_range_events", lambda s, d: Query(events(s, d), {"start": "events/0000000100", "end": "events/0000000250", "limit": 1000}).top().select("key"), f"SELECT key FROM {_EVENTS} WHERE key >= 'events/0000000100' AND key < 'events/0000000250'")
_add("scan_after", lambda s, d: Query(orders(s, d), {"prefix": "orders/", "after": "orders/0000000100", "limit": 20}).top().select("key"), f"SELECT key FROM {_ORDERS} WHERE key > 'orders/0000000100' ORDER BY key LIMIT 20")

# filters
_where("filter_eq", c.orders, {"status": "F"}, _ORDERS, "status = 'F'")
_where("filter_ne", c.documents, {"quality": {"$ne": 1}}, _DOCS, "quality IS DISTINCT FROM 1")
_where("filter_gt", c.orders, {"total": {"$gt": 250000}}, _ORDERS, "total > 250000")
_where("filter_gte_lt", c.orders, {"total": {"$gte": 100000.5, "$lt": 200000}}, _ORDERS, "total >= 100000.5 AND total < 200000")
_where("filter_lte_string", c.orders, {"date": {"$lte": "1996-01-02"}}, _ORDERS, "date <= '1996-01-02'")
_where("filter_in", c.orders, {"priority": {"$in": ["1-URGENT", "2-HIGH", 5, None]}}, _ORDERS, "priority IN ('1-URGENT', '2-HIGH')")
_where("filter_nin", c.documents, {"quality": {"$nin": [0]}}, _DOCS, "quality IS NULL OR quality <> 0")
_where("filter_exists", c.documents, {"toxic": {"$exists": True}}, _DOCS, "toxic IS NOT NULL")
_where("filter_not_exists", c.documents, {"toxic": {"$exists": False}}, _DOCS, "toxic IS NULL")
_where("filter_prefix", c.orders, {"priority": {"$prefix": "1"}}, _ORDERS, "starts_with(priority, '1')")
_where("filter_contains_string", c.documents, {"text": {"$contains": "and the"}}, _DOCS, "contains(text, 'and the')")
_where("filter_and_or_not", c.orders, {"$or": [{"status": "O", "total": {"$lt": 50000}}, {"$and": [{"status": "F"}, {"$not": {"total": {"$lt": 300000}}}]}]}, _ORDERS, "(status = 'O' AND total < 50000) OR (status = 'F' AND NOT total < 300000)")
_where("filter_not_missing", c.documents, {"$not": {"quality": {"$gt": 0}}}, _DOCS, "NOT coalesce(quality > 0, false)")
_where("filter_json_props", events, {"props.k": {"$gte": 50}}, _EVENTS, "k >= 50")
_where("filter_json_eq_null", labeled, {"quality": None}, _LABELS, "q = 'null'")
_where("filter_json_ne", labeled, {"quality": {"$ne": 1}}, _LABELS, "q <> '1'")
_where("filter_json_exists", labeled, {"quality": {"$exists": True}}, _LABELS, "q <> 'missing'")
_where("filter_json_cross_type", mixed, {"total": {"$gt": 1}}, _MIXED, "kind = 'number' AND k > 1")
_where("filter_json_string_order", mixed, {"total": {"$gte": "t2"}}, _MIXED, "kind = 'text' AND 't' || k >= 't2'")
_where("filter_json_nin", mixed, {"total": {"$nin": [1, 2, "t5"]}}, _MIXED, "NOT (kind = 'number' AND k IN (1, 2)) AND NOT (kind = 'text' AND k = 5)")
_where("filter_json_not", mixed, {"$not": {"total": {"$gt": 100}}}, _MIXED, "NOT (kind = 'number' AND k > 100)")
_where("filter_empty", mixed, {}, _MIXED, "true")
_where("filter_object_eq", events, {"props": {"k": 69}}, _EVENTS, "k = 69")
_PARTS = "(SELECT 'orders/' || lpad(o_orderkey::varchar, 10, '0') AS key, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)"
_where("filter_array_contains", order_docs, {"parts": {"$contains": 7}}, _PARTS, "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7)")
_where("filter_array_index", order_docs, {"lines.0.part": {"$lt": 20}}, "(SELECT key, part FROM (SELECT 'orders/' || lpad(l_orderkey::varchar, 10, '0') AS key, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE n = 1)", "part < 20")

# projection
_add("project_nested", lambda s, d: Query(order_docs(s, d), {"where": {"status": "P"}, "fields": ["customer.segment", "total", "zz"]}).all().select("key", F.to_json("value").alias("value")),
     """SELECT 'orders/' || lpad(o_orderkey::varchar, 10, '0') AS key, '{"total":' || o_totalprice || ',"customer":{"segment":"' || c_mktsegment || '"}}' AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
_add("project_json", lambda s, d: Query(labeled(s, d), {"fields": ["quality"]}).all().select("key", F.to_json("value").alias("value")),
     f"SELECT key, CASE q WHEN 'missing' THEN '{{}}' ELSE '{{\"quality\":' || q || '}}' END AS value FROM {_LABELS}")

# aggregates
_add("agg_count", lambda s, d: Query(c.orders(s, d), {"where": {"status": "O"}, "aggregate": {"count": True}}).aggregated(), f"SELECT count(*) AS count FROM {_ORDERS} WHERE status = 'O'")
_add("agg_sum", lambda s, d: Query(c.orders(s, d), {"aggregate": {"sum": ["total", "id"]}}).aggregated().withColumn("sum_total", F.round("sum_total", 2)), f"SELECT round(sum(total), 2) AS sum_total, sum(id)::bigint AS sum_id FROM {_ORDERS}")
_add("agg_min_max", lambda s, d: Query(c.orders(s, d), {"aggregate": {"min": ["date", "total"], "max": ["date", "total"]}}).aggregated(), f"SELECT min(date) AS min_date, min(total) AS min_total, max(date) AS max_date, max(total) AS max_total FROM {_ORDERS}")
_add("agg_json_sum", lambda s, d: Query(events(s, d), {"aggregate": {"count": True, "sum": "props.k", "max": "props.k"}}).aggregated(), f"SELECT count(*) AS count, sum(k)::varchar AS sum_props_k, max(k)::varchar AS max_props_k FROM {_EVENTS}")
_add("agg_mixed_types", lambda s, d: Query(mixed(s, d), {"aggregate": {"count": True, "sum": "total", "min": "total", "max": "total"}}).aggregated(),
     f"SELECT count(*) AS count, (sum(k) FILTER (WHERE kind = 'number'))::varchar AS sum_total, (min(k) FILTER (WHERE kind = 'number'))::varchar AS min_total, '\"' || (max('t' || k) FILTER (WHERE kind = 'text')) || '\"' AS max_total FROM {_MIXED}")


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """What a client gathered from pages, as a table."""
    return spark.createDataFrame(rows, schema)


def agg_merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates merged from those of pages, each a scan of 4,000 rows at most."""
    spec = {"prefix": "orders/", "where": {"status": {"$ne": "P"}}, "max_scanned": 4000, "aggregate": {"count": True, "sum": "id", "min": "date", "max": ["date", "id"]}}
    m = aggregate_pages(orders(spark, sf_dir), spec)
    return _rows(spark, [(m["count"], m["sum"]["id"], m["min"]["date"], m["max"]["date"], m["max"]["id"])], "count long, sum_id long, min_date string, max_date string, max_id long")


_add("agg_merge_pages", agg_merge_pages, f"SELECT count(*) AS count, sum(id)::bigint AS sum_id, min(date) AS min_date, max(date) AS max_date, max(id) AS max_id FROM {_ORDERS} WHERE status <> 'P'")

# sort and paging
_add("sort_asc_limit", lambda s, d: Query(c.orders(s, d), {"sort": {"field": "total"}, "limit": 25}).top().select("key", "value.total"), f"SELECT key, total FROM {_ORDERS} ORDER BY total, key LIMIT 25")
_add("sort_desc_tie_key", lambda s, d: Query(c.orders(s, d), {"sort": {"field": "priority", "order": "desc"}, "limit": 40}).top().select("key", "value.priority"), f"SELECT key, priority FROM {_ORDERS} ORDER BY priority DESC, key LIMIT 40")
_add("sort_mixed_types", lambda s, d: Query(mixed(s, d), {"sort": {"field": "total", "order": "desc"}, "limit": 500}).top().select("key"),
     f"SELECT key FROM {_MIXED} WHERE kind <> 'missing' ORDER BY CASE kind WHEN 'text' THEN 3 WHEN 'number' THEN 2 ELSE 1 END DESC, CASE kind WHEN 'number' THEN k END DESC, CASE kind WHEN 'text' THEN 't' || k END DESC, key LIMIT 500")
_add("sort_filtered", lambda s, d: Query(c.orders(s, d), {"where": {"status": "F", "total": {"$gte": 20000, "$lt": 50000}}, "sort": {"field": "total", "order": "desc"}, "limit": 30}).top().select("key"), f"SELECT key FROM {_ORDERS} WHERE status = 'F' AND total >= 20000 AND total < 50000 ORDER BY total DESC, key LIMIT 30")


_places = lambda pages: pages.items().select(F.col("place").cast("int").alias("place"), "key")


def _chain(spec: dict, collection: Callable = orders, indexes: Callable | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """Keys of all pages of a query with their place, from all pages at once."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _places(Query(collection(spark, sf_dir), spec, indexes(spark, sf_dir) if indexes else None).paged())

    return run


_placed = lambda sql, order: f"SELECT (row_number() OVER (ORDER BY {order}) - 1)::integer AS place, key FROM {sql}"
_add("page_keyset", lambda s, d: _rows(s, [(x["key"],) for x in Query(orders(s, d), {"where": {"status": "F"}, "after": "orders/0000000300", "limit": 10}).page()["items"]], "key string"), f"SELECT key FROM {_ORDERS} WHERE status = 'F' AND key > 'orders/0000000300' ORDER BY key LIMIT 10")
_add("page_chain_filtered", _chain({"prefix": "orders/", "where": {"status": "P", "total": {"$lt": 90000}}, "limit": 400, "max_scanned": 9000}), _placed(f"{_ORDERS} WHERE status = 'P' AND total < 90000", "key"))
_add("page_chain_sorted", _chain({"where": {"status": "P", "total": {"$lt": 150000}}, "sort": {"field": "total"}, "limit": 400}), _placed(f"{_ORDERS} WHERE status = 'P' AND total < 150000", "total, key"))
_add("page_chain_sorted_desc", _chain({"where": {"total": {"$lt": 60000}}, "sort": {"field": "priority", "order": "desc"}, "limit": 600}), _placed(f"{_ORDERS} WHERE total < 60000", "priority DESC, key"))


def page_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page of a budgeted scan: rows looked at, matches, and the key it goes on behind."""
    return Query(orders(spark, sf_dir), {"prefix": "orders/", "where": {"status": "P"}, "limit": 1000, "max_scanned": 2500}).paged().summary()


_add("page_budget", page_budget, f"""SELECT page, scanned, items, CASE WHEN page = max(page) OVER () THEN NULL ELSE last END AS next_cursor FROM
  (SELECT ((n - 1) // 2500)::integer AS page, count(*) AS scanned, count(*) FILTER (WHERE status = 'P') AS items, max(key) AS last FROM (SELECT *, row_number() OVER (ORDER BY key) AS n FROM {_ORDERS}) GROUP BY 1)""")


def _merged_chain(spec: dict, groups: int = 3) -> Callable[[SparkSession, str], DataFrame]:
    """Pages of a query that several groups of keys answer, merged, from all pages at once."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        whole = orders(spark, sf_dir)
        return _places(paged_groups([whole.where(F.pmod(F.crc32(F.col("key").cast("binary")), F.lit(groups)) == g) for g in range(groups)], spec))

    return run


_add("page_merge", _merged_chain({"prefix": "orders/", "where": {"status": "P", "total": {"$lt": 90000}}, "limit": 500, "max_scanned": 4000}), _placed(f"{_ORDERS} WHERE status = 'P' AND total < 90000", "key"))
_add("page_merge_sorted", _merged_chain({"where": {"total": {"$lt": 60000}}, "sort": {"field": "priority", "order": "desc"}, "limit": 900}), _placed(f"{_ORDERS} WHERE total < 60000", "priority DESC, key"))

# log and state
_RECORD = ["key", "version", "value", "timestamp_ms", "expires_at_ms", "mutation_id"]
_add("latest_state", lambda s, d: state.newest(c.event_log(s, d)).select("key", "seq", "kind", "value"), f"SELECT key, seq, kind, value FROM {_LATEST}")
_add("ttl_live_at", lambda s, d: state.current(c.event_log(s, d), NOW_MS).select(*_RECORD), f"SELECT key, seq AS version, value, timestamp_ms, expires_at_ms, mutation_id FROM {_LATEST} WHERE kind = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW_MS})")
_add("latest_with_tombstone", lambda s, d: state.latest(c.event_log(s, d), "users/0000000007"), f"SELECT key, kind = 'delete' AS deleted, seq AS version, timestamp_ms, mutation_id FROM {_LATEST} WHERE key = 'users/0000000007'")
_add("as_of_version", lambda s, d: state.current(state.as_of(c.event_log(s, d), 500), NOW_MS).select("key", "version"), f"SELECT key, seq AS version FROM (SELECT * FROM {_LOG} WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW_MS})")
_add("compact", lambda s, d: state.compact(c.event_log(s, d), NOW_MS, 86_400_000).select("key", "seq", "kind", "value", "timestamp_ms", "expires_at_ms"),
     f"""SELECT key, seq, CASE WHEN x THEN 'delete' ELSE kind END AS kind, CASE WHEN NOT x AND kind = 'put' THEN value END AS value, CASE WHEN x THEN expires_at_ms ELSE timestamp_ms END AS timestamp_ms, CASE WHEN NOT x THEN expires_at_ms END AS expires_at_ms
     FROM (SELECT *, kind = 'put' AND expires_at_ms IS NOT NULL AND expires_at_ms <= {NOW_MS} AS x FROM {_LATEST}) WHERE (kind = 'put' AND NOT x) OR CASE WHEN x THEN expires_at_ms ELSE timestamp_ms END + 86400000 > {NOW_MS}""")


def purge_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = state.current(c.event_log(spark, sf_dir), NOW_MS)
    written = spark.range(1).select(F.lit(999_999_999).cast("long").alias("seq"), F.lit("put").alias("kind"), F.lit("users/0000000001").alias("key"), F.lit("{}").alias("value"), F.lit(NOW_MS).cast("long").alias("timestamp_ms"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit("p").alias("mutation_id"))
    return state.purge(live, F.col("key") < "users/0000000020", written, 999_999_999, NOW_MS, "p").select("seq", "kind", "key", "value")


_add("purge_write", purge_write, f"""SELECT 999999999::bigint AS seq, 'delete' AS kind, key, NULL::varchar AS value FROM {_LATEST} WHERE kind = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW_MS}) AND key < 'users/0000000020' AND key <> 'users/0000000001'
  UNION ALL SELECT 999999999, 'put', 'users/0000000001', '{{}}'""")


def lww_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with clocks that run apart and every tenth write strict."""
    log = c.event_log(spark, sf_dir).withColumn("timestamp_ms", F.col("timestamp_ms") + (F.col("seq") * 7919 % 13 - 6) * 3_600_000)
    return log.select(F.col("seq").alias("idx"), "key", "kind", "value", "timestamp_ms", "expires_at_ms", "mutation_id", (F.col("seq") % 10 == 0).alias("strict"))


_LWW = f"""(SELECT *, strict OR max({{'t': timestamp_ms, 'm': mutation_id}}) OVER b IS NULL OR {{'t': timestamp_ms, 'm': mutation_id}} > max({{'t': timestamp_ms, 'm': mutation_id}}) OVER b AS wins,
  max({{'t': timestamp_ms, 'm': mutation_id}}) OVER b AS met FROM (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY key ORDER BY idx) AS seg FROM
  (SELECT seq AS idx, key, kind, value, timestamp_ms + (seq * 7919 % 13 - 6) * 3600000 AS timestamp_ms, expires_at_ms, mutation_id, seq % 10 = 0 AS strict FROM {_LOG}))
  WINDOW b AS (PARTITION BY key, seg ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_add("lww_resolve", lambda s, d: writes.resolve_lww(lww_log(s, d)).select("key", "idx", "kind", "value"), f"SELECT key, idx, kind, value FROM {_LWW} WHERE wins QUALIFY row_number() OVER (PARTITION BY key ORDER BY idx DESC) = 1")
_add("lww_conflicts", lambda s, d: writes.lww_conflicts(lww_log(s, d)).select("key", "mutation_id", "winner_mutation_id", "reason"),
     f"""WITH j AS {_LWW} SELECT key, mutation_id, met.m AS winner_mutation_id, 'lost' AS reason FROM j WHERE NOT wins UNION ALL
     SELECT key, pm, mutation_id, 'overwritten' FROM (SELECT *, lag(kind) OVER w AS pk, lag(mutation_id) OVER w AS pm, lag(expires_at_ms) OVER w AS pe FROM j WHERE wins WINDOW w AS (PARTITION BY key ORDER BY idx)) WHERE NOT strict AND pk = 'put' AND (pe IS NULL OR pe > timestamp_ms)""")
_add("conflicts_list", lambda s, d: writes.list_conflicts(writes.lww_conflicts(lww_log(s, d)).where("reason = 'lost'"), "users/000000001", 50).select("key", "mutation_id"), f"SELECT key, mutation_id FROM {_LWW} WHERE NOT wins AND starts_with(key, 'users/000000001') ORDER BY key, mutation_id LIMIT 50")


def retried_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals of each id, 0, 23, 25 and 26 hours on; every third id's second one has another payload."""
    log = c.event_log(spark, sf_dir)
    n, k = F.floor(F.col("seq") / 4), F.col("seq") % 4
    first = F.floor(F.lit(NOW_MS) + n * 1000)
    log = log.withColumns({"mutation_id": F.lpad(n.cast("string"), 12, "0"), "kind": F.lit("put"), "key": F.concat(F.lit("users/"), (n % 50).cast("string")), "expires_at_ms": F.lit(None).cast("long"),
                           "value": F.when((k == 1) & (n % 3 == 0), "2").otherwise("1"), "timestamp_ms": (first + F.element_at(F.array(*map(F.lit, (0, 23, 25, 26))), (k + 1).cast("int")) * 3_600_000).cast("long")})
    return writes.first_of_each_mutation(log)


_DEDUPED = f"""WITH RECURSIVE l AS (SELECT seq, m, p, t, row_number() OVER (PARTITION BY m ORDER BY seq) AS n FROM
    (SELECT event_id AS seq, lpad((event_id // 4)::varchar, 12, '0') AS m, CASE WHEN event_id % 4 = 1 AND event_id // 4 % 3 = 0 THEN '2' ELSE '1' END AS p,
     {NOW_MS} + event_id // 4 * 1000 + [0, 23, 25, 26][event_id % 4 + 1] * 3600000 AS t FROM events)),
  f AS (SELECT m, n, seq, 'applied' AS outcome, seq AS version, p AS wp, t AS wt FROM l WHERE n = 1 UNION ALL
  SELECT l.m, l.n, l.seq, CASE WHEN f.wt + 86400000 <= l.t THEN 'applied' WHEN f.wp = l.p THEN 'deduplicated' ELSE 'mutation_id_reused' END,
    CASE WHEN f.wt + 86400000 <= l.t THEN l.seq ELSE f.version END, CASE WHEN f.wt + 86400000 <= l.t THEN l.p ELSE f.wp END, CASE WHEN f.wt + 86400000 <= l.t THEN l.t ELSE f.wt END
  FROM f JOIN l ON l.m = f.m AND l.n = f.n + 1)
  SELECT seq, m AS mutation_id, outcome, version FROM f"""
_add("dedupe_mutations", lambda s, d: retried_log(s, d).select("seq", "mutation_id", "outcome", "version"), _DEDUPED)


def feed_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a feed tells of a log with retries: writes that were applied, once."""
    from .streaming import feed

    return feed.feed(retried_log(spark, sf_dir), "users/1").select("key", "version", "mutation_id")


_add("feed_published", feed_published, f"SELECT 'users/' || (m::bigint % 50) AS key, seq AS version, m AS mutation_id FROM ({_DEDUPED.replace('m AS mutation_id', 'm')}) WHERE outcome = 'applied' AND starts_with('users/' || (m::bigint % 50), 'users/1')")


def lww_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of a log in which every fifth write is sent a second time, some writes later."""
    log = lww_log(spark, sf_dir).withColumn("idx", F.col("idx") * 2)
    return writes.lww_conflicts(log.unionByName(log.where("idx % 10 = 8").withColumn("idx", F.col("idx") + 21))).select("key", "mutation_id", "winner_mutation_id", "reason")


_add("lww_retries", lww_retries, SQL["lww_conflicts"])


def cas_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as conditional writes per user: every third only if absent."""
    log = c.event_log(spark, sf_dir)
    none = F.lit(None).cast("long")
    req = log.select(F.col("key").alias("group"), F.col("seq").alias("idx"), F.lit(0).alias("op"), "mutation_id", "kind", "key", F.col("value"), none.alias("ttl_ms"), none.alias("if_version"), (F.col("seq") % 3 == 0).alias("if_absent"), F.col("timestamp_ms").alias("now_ms"))
    return writes.fold_requests(req).groupBy("group").agg(F.count(F.when(F.col("outcome") == "applied", 1)).alias("applied"), F.count(F.when(F.col("outcome") == "condition_failed", 1)).alias("failed"), F.max("version").alias("version"))


_add("cas_fold", cas_fold, f"""WITH RECURSIVE l AS (SELECT key, seq, kind, seq % 3 = 0 AS absent, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM {_LOG}),
  f AS (SELECT key, n, kind = 'put' AS live, 1 AS applied, 0 AS failed FROM l WHERE n = 1 UNION ALL
  SELECT l.key, l.n, CASE WHEN l.absent AND f.live THEN f.live ELSE l.kind = 'put' END, f.applied + CASE WHEN l.absent AND f.live THEN 0 ELSE 1 END, f.failed + CASE WHEN l.absent AND f.live THEN 1 ELSE 0 END FROM f JOIN l ON l.key = f.key AND l.n = f.n + 1)
  SELECT key AS "group", max(applied)::bigint AS applied, max(failed)::bigint AS failed, max(applied)::bigint AS version FROM f GROUP BY key""")



def _folded(make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Outcomes per user of requests made from the event log."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = writes.fold_requests(make(c.event_log(spark, sf_dir)))
        return out.groupBy("group").agg(F.countDistinct(F.when(F.col("outcome") == "applied", F.col("version"))).alias("applied"), F.count(F.when(F.col("outcome") == "applied", 1)).alias("rows"), F.count(F.when(F.col("outcome") == "condition_failed", 1)).alias("failed"))

    return run


_request = lambda log, op, key, kind, if_version, if_absent: log.select(F.col("key").alias("group"), F.col("seq").alias("idx"), F.lit(op).alias("op"), "mutation_id", kind.alias("kind"), key.alias("key"), F.when(kind == "put", F.lit("1")).alias("value"), F.lit(None).cast("long").alias("ttl_ms"), if_version.cast("long").alias("if_version"), if_absent.alias("if_absent"), F.col("timestamp_ms").alias("now_ms"))


def _versioned(log: DataFrame) -> DataFrame:
    """Each write of a user names the version that the one before it made."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("seq")) - 1
    numbered = log.withColumn("n", n)
    return _request(numbered, 0, F.col("key"), F.col("kind"), F.when(F.col("n") > 0, F.col("n")), F.lit(False))


def _batched(log: DataFrame) -> DataFrame:
    """Batches of two puts; every third one wants its second key absent, so it applies as a whole only where it comes first."""
    put = F.lit("put")
    first = _request(log, 0, F.col("key"), put, F.lit(None), F.lit(False))
    return first.unionByName(_request(log, 1, F.concat("key", F.lit("/x")), put, F.lit(None), F.col("seq") % 3 == 0))


_add("cas_versions", _folded(_versioned), f"""SELECT key AS "group", count(*) FILTER (WHERE gone = 0) AS applied, count(*) FILTER (WHERE gone = 0) AS rows, count(*) FILTER (WHERE gone > 0) AS failed FROM
  (SELECT *, coalesce(sum((kind = 'delete')::integer) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM {_LOG}) GROUP BY key""")
_add("batch_atomic", _folded(_batched), f"""SELECT key AS "group", count(*) FILTER (WHERE ok) AS applied, 2 * count(*) FILTER (WHERE ok) AS rows, count(*) FILTER (WHERE NOT ok) AS failed FROM
  (SELECT *, seq % 3 <> 0 OR row_number() OVER (PARTITION BY key ORDER BY seq) = 1 AS ok FROM {_LOG}) GROUP BY key""")


def reconcile_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = lww_log(spark, sf_dir)
    return writes.reconcile(log.where("idx <= 300"), log.where("idx > 100").drop("idx", "strict"), 256).select("idx", "key", "mutation_id")


_add("reconcile_pass", reconcile_pass, f"""SELECT 300 + row_number() OVER (ORDER BY timestamp_ms, mutation_id) AS idx, key, mutation_id FROM
  (SELECT key, mutation_id, timestamp_ms + (seq * 7919 % 13 - 6) * 3600000 AS timestamp_ms FROM {_LOG} WHERE seq > 300 ORDER BY timestamp_ms, mutation_id LIMIT 256)""")
_add("hybrid_timestamps", lambda s, d: lww_log(s, d).groupBy("key").agg(F.max("timestamp_ms").alias("seen")).select("key", writes.hybrid_timestamp(F.lit(NOW_MS), F.col("seen")).alias("timestamp_ms")),
     f"SELECT key, greatest({NOW_MS}, max(timestamp_ms + (seq * 7919 % 13 - 6) * 3600000) + 1) AS timestamp_ms FROM {_LOG} GROUP BY key")
_add("merge_layers", lambda s, d: state.merge_layers(*[c.event_log(s, d).where(F.col("seq") % 3 == i) for i in range(3)]).select("key", "seq", "kind"), f"SELECT key, seq, kind FROM {_LATEST}")
_add("index_updated", lambda s, d: ix.updated(ix.entries(c.orders(s, d), _STATUS), c.orders(s, d).where("key < 'orders/0000000100'"), c.orders(s, d).where("key < 'orders/0000000100'").withColumn("value", F.col("value").withField("status", F.lit("Z"))), _STATUS).groupBy("text").agg(F.count(F.lit(1)).alias("n")),
     f"SELECT CASE WHEN key < 'orders/0000000100' THEN 'Z' ELSE status END AS text, count(*) AS n FROM {_ORDERS} GROUP BY 1")

# placement
_NODES = [("n1", "a"), ("n2", "a"), ("n3", "b"), ("n4", "b"), ("n5", "c")]
_nodes = lambda s, n=5: s.createDataFrame(_NODES[:n], "node string, zone string")
_four, _five = _NODES[:4], _NODES
_add("partition_load", lambda s, d: placement.load(placement.place(s, _nodes(s), 3)), f"SELECT node, count(*) AS replicas, count(*) FILTER (WHERE rank = 0) AS leaders FROM {placed_sql(_five, 3)} GROUP BY node")
_add("rendezvous", lambda s, d: placement.place(s, _nodes(s), 3), f"SELECT * FROM {placed_sql(_five, 3)}")
_add("rebalance", lambda s, d: placement.rebalance(placement.place(s, _nodes(s, 4), 2), placement.place(s, _nodes(s, 5), 2), 2).select("partition", F.array_join("added", "+").alias("added"), F.array_join("removed", "+").alias("removed"), "leader_changed", "epoch"),
     f"""SELECT partition, array_to_string(list_filter(b.replicas, lambda x: NOT list_contains(a.replicas, x)), '+') AS added, array_to_string(list_filter(a.replicas, lambda x: NOT list_contains(b.replicas, x)), '+') AS removed,
     a.replicas[1] <> b.replicas[1] AS leader_changed, 2 AS epoch FROM {sets_sql(_four, 2)} a JOIN {sets_sql(_five, 2)} b USING (partition) WHERE a.replicas <> b.replicas""")
_add("replica_groups", lambda s, d: placement.groups(placement.place(s, _nodes(s), 3)), f"SELECT array_to_string(list_sort(replicas), '+') AS group_id, count(*) AS partitions, min(partition) AS first_partition FROM {sets_sql(_five, 3)} GROUP BY 1")
_add("route_keys", lambda s, d: placement.route(c.orders(s, d).select("key"), placement.place(s, _nodes(s), 3)).select("key", "partition", F.array_join("replicas", "+").alias("replicas")),
     f"SELECT key, o.partition, array_to_string(replicas, '+') AS replicas FROM (SELECT key, {partition_sql(hash_17('key'))} AS partition FROM {_ORDERS}) o JOIN {sets_sql(_five, 3)} s ON s.partition = o.partition")
_USERS = f"(SELECT *, {partition_sql(hash_16('key'))} AS partition FROM {_LATEST} WHERE kind = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW_MS}))"
_LEAVES = f"""(SELECT partition, count(*) AS n, md5(concat_ws('/', count(*), bit_xor(h), sum(h % 2147483648))) AS leaf FROM
  (SELECT partition, ('0x' || substr(md5(concat_ws(chr(31), key, coalesce(value, chr(30)), seq)), 1, 15))::bigint AS h FROM {_USERS} WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW_MS + 60_000}) GROUP BY partition)"""
_add("digest", lambda s, d: placement.digests(state.current(c.event_log(s, d), NOW_MS), NOW_MS), f"SELECT * FROM {_LEAVES}")


def replica_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three replicas, one of which lacks a user's newest version: who is with the majority, and in how many partitions others differ."""
    log = c.event_log(spark, sf_dir)
    leaves = [placement.digests(state.current(log.where(~F.col("key").eqNullSafe("users/0000000009")) if n == "n3" else log, NOW_MS), NOW_MS).select(F.lit(n).alias("node"), "partition", "leaf") for n in ("n1", "n2", "n3")]
    return placement.compare_replicas(leaves[0].unionByName(leaves[1]).unionByName(leaves[2])).select("node", "majority", "differing")


_add("replica_check", replica_check, f"SELECT node, node <> 'n3' AS majority, CASE WHEN node = 'n3' THEN (SELECT count(*) FROM {_LATEST} WHERE key = 'users/0000000009' AND kind = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW_MS + 60_000})) ELSE 0 END AS differing FROM (VALUES ('n1'), ('n2'), ('n3')) t(node)")
_moving = lambda s: s.range(0, placement.PARTITIONS, 3).select(F.col("id").cast("int").alias("partition"))
_add("fenced_export", lambda s, d: placement.fenced_export(state.current(c.event_log(s, d), NOW_MS), _moving(s), NOW_MS), f"SELECT partition, key, value, expires_at_ms - {NOW_MS} AS remaining_ms FROM {_USERS} WHERE partition % 3 = 0")
_add("export_chunks", lambda s, d: placement.chunked(c.orders(s, d).select(placement.partition_of("key").bitwiseAND(7).alias("partition"), "key", F.lit("x").alias("value")), 500).groupBy("partition", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")),
     f"SELECT partition, ((r - 1) // 500)::integer AS chunk, count(*) AS n, min(key) AS first FROM (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY key) AS r FROM (SELECT {partition_sql(hash_17('key'))} % 8 AS partition, key FROM {_ORDERS})) GROUP BY 1, 2")
_add("served_partitions", lambda s, d: state.served(c.orders(s, d).select("key", placement.partition_of("key").alias("partition")), s.range(100, 900).select(F.col("id").cast("int").alias("partition"))).select("key"), f"SELECT key FROM {_ORDERS} WHERE {partition_sql(hash_17('key'))} BETWEEN 100 AND 899")


def cluster_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups that hold overlapping halves of the orders but serve their own partitions, and one that can't be reached: a weak scan."""
    orders = c.orders(spark, sf_dir)
    parts = {"a": (orders.where("value.id % 5 <> 0"), list(range(1500))), "b": (orders, list(range(1500, 3000))), "c": (None, list(range(3000, 4096)))}
    rows, partial = commands.cluster_scan(parts, KeyRange(prefix="orders/"), 700, "eventual")
    return rows.select("key", F.lit(partial).alias("partial"))


_add("cluster_scan", cluster_scan, f"SELECT key, true AS partial FROM (SELECT *, {partition_sql(hash_17('key'))} AS p FROM {_ORDERS}) WHERE (p < 1500 AND id % 5 <> 0) OR p BETWEEN 1500 AND 2999 ORDER BY key LIMIT 700")


def command_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as commands of groups, every 50th a fence of the user's own partition, every 80th a barrier: how each ended."""
    log = c.event_log(spark, sf_dir)
    op = F.struct(F.lit("put").alias("op"), F.col("key"), F.lit("1").alias("value"))
    write = F.to_json(F.struct(F.lit("write").alias("type"), "mutation_id", F.array(op).alias("ops"), F.col("timestamp_ms").alias("now_ms")))
    fence = F.to_json(F.struct(F.lit("fence").alias("type"), "mutation_id", F.array(placement.partition_of("key")).alias("partitions"), F.col("timestamp_ms").alias("now_ms")))
    kind = F.when(F.col("seq") % 50 == 0, fence).when(F.col("seq") % 80 == 1, F.lit('{"type":"barrier"}')).otherwise(write)
    return commands.apply_commands(log.select(F.col("key").alias("group"), F.col("seq").alias("idx"), kind.alias("command"))).groupBy("group", "outcome").agg(F.count(F.lit(1)).alias("n"))


_add("command_apply", command_apply, f"""SELECT key AS "group", CASE WHEN seq % 50 = 0 THEN 'done' WHEN seq % 80 = 1 THEN 'barrier' WHEN closed THEN 'moving' ELSE 'applied' END AS outcome, count(*) AS n
  FROM (SELECT *, count(*) FILTER (WHERE seq % 50 = 0) OVER (PARTITION BY key ORDER BY seq) > 0 AS closed FROM {_LOG}) GROUP BY 1, 2""")

# indexes
_STATUS, _TOTAL = ix.IndexSpec("by-status", "orders/", "status"), ix.IndexSpec("by-total", "orders/", "total", True)
_add("index_entries", lambda s, d: ix.entries(mixed(s, d), _TOTAL).select("tag", "key"), f"SELECT CASE kind WHEN 'null' THEN 1 WHEN 'number' THEN 4 ELSE 5 END AS tag, key FROM {_MIXED} WHERE kind <> 'missing'")
_add("index_lookup", lambda s, d: ix.lookup(_orders_indexes(s, d)[0].table, "P", KeyRange(start="orders/0000001000")), f"SELECT key FROM {_ORDERS} WHERE status = 'P' AND key >= 'orders/0000001000'")
_add("index_scan_recheck", lambda s, d: ix.scan_equal(orders(s, d), _orders_indexes(s, d)[0].table, "P", Query(orders(s, d), {"where": {"status": "P", "total": {"$lt": 100000}}})).select("key"), f"SELECT key FROM {_ORDERS} WHERE status = 'P' AND total < 100000")
_add("index_sorted", lambda s, d: ix.ordered(_orders_indexes(s, d)[1].table, _TOTAL, 50, low=1000.0, high=400000.0).select("key"), f"SELECT key FROM {_ORDERS} WHERE total >= 1000 AND total < 400000 ORDER BY total DESC, key LIMIT 50")


_BUILT: dict = {}


def _opened(spark: SparkSession, collection: DataFrame, *specs: ix.IndexSpec) -> list:
    """Side tables in the shared folder, ready to be read."""
    app = spark.sparkContext.applicationId, collection.inputFiles()[0]
    for s in specs:
        if (app, s) not in _BUILT:
            _BUILT[app, s] = f"{shared_folder(spark)}/index-{s.name}-{uuid.uuid4().hex}"
            ix.build(collection, s, _BUILT[app, s])
    return [ix.opened(spark, s, _BUILT[app, s]) for s in specs]


_orders_indexes = lambda s, d: _opened(s, orders(s, d), _STATUS, _TOTAL)
_add("index_page_equal", _chain({"prefix": "orders/", "where": {"status": "P", "total": {"$lt": 100000}}, "limit": 500}, indexes=_orders_indexes), _placed(f"{_ORDERS} WHERE status = 'P' AND total < 100000", "key"))
_add("index_page_sorted", _chain({"prefix": "orders/", "where": {"status": "F", "total": {"$gte": 300000}}, "sort": {"field": "total", "order": "desc"}, "limit": 600, "max_scanned": 2500}, indexes=_orders_indexes), _placed(f"{_ORDERS} WHERE status = 'F' AND total >= 300000", "total DESC, key"))


def index_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is built in steps of 4,000 rows, counted by value; then how many entries a step of its removal leaves."""
    base = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    ix.backfill(orders(spark, sf_dir), _STATUS, base, 4000)
    built = spark.read.parquet(base).drop("step")
    left = ix.drop_step(built, 4000).agg(F.lit("left").alias("text"), F.count(F.lit(1)).alias("n"))
    return built.groupBy("text").agg(F.count(F.lit(1)).alias("n")).unionByName(left)


_add("index_backfill", index_backfill, f"SELECT status AS text, count(*) AS n FROM {_ORDERS} GROUP BY 1 UNION ALL SELECT 'left', greatest(count(*) - 4000, 0) FROM {_ORDERS}")
_add("index_status", lambda s, d: ix.status([_STATUS, _TOTAL], s.createDataFrame([("by-status", _STATUS.fingerprint, True), ("by-total", "other", True), ("gone", "x", True)], "name string, fingerprint string, built boolean")), "SELECT * FROM (VALUES ('by-status', 'ready'), ('by-total', 'dropping'), ('gone', 'dropping')) t(name, state)")


def feed_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed of a prefix, run as a stream over the log to its end; the sink is a table in the shared folder."""
    from .streaming import feed

    at = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    c.event_log(spark, sf_dir).write.parquet(f"{at}/log")
    events = feed.feed(feed.log_stream(spark, f"{at}/log"), "users/000000001")
    events.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, kind string, value string, version bigint, mutation_id string").parquet(f"{at}/out")


_add("feed_replay", feed_replay, f"SELECT key, kind, value, seq AS version, mutation_id FROM {_LOG} WHERE starts_with(key, 'users/000000001')")


def watch_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A watcher that saw up to version 100 of users 1 to 19, whose bus holds 50 events."""
    from .streaming import feed

    return feed.lagged(c.event_log(spark, sf_dir), 100, "users/000000001", 50)


_add("watch_lag", watch_lag, f"SELECT greatest(count(*) - 50, 0) AS missed, coalesce(max(seq), 100) AS resume FROM {_LOG} WHERE starts_with(key, 'users/000000001') AND seq > 100")


def session_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a session with token 400 reads on a replica that applied 500 versions."""
    from .streaming import feed

    return state.current(feed.snapshot(c.event_log(spark, sf_dir), "session", applied=500, committed=900, token=400), NOW_MS).select("key", "version")


_add("session_read", session_read, SQL["as_of_version"])


def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a restored snapshot, with their versions."""
    at = f"{shared_folder(spark)}/backup-{uuid.uuid4().hex}"
    exchange.backup(c.event_log(spark, sf_dir), at)
    rows, last = exchange.restore(spark, at)
    return rows.select("key", "seq", "value", F.lit(last).cast("long").alias("last_seq"))


_add("backup_restore", backup_restore, f"SELECT key, seq, value, (SELECT max(event_id) FROM events) AS last_seq FROM {_LATEST} WHERE kind = 'put'")


def lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live records exported as JSON lines and imported a day later: what has not expired, with the time left."""
    at = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    exchange.export_lines(state.current(c.event_log(spark, sf_dir), NOW_MS), at)
    return exchange.import_lines(spark, at, NOW_MS + 86_400_000).select("key", F.get_json_object("value", "$.k").alias("k"), "ttl_ms")


_add("lines_roundtrip", lines_roundtrip, f"SELECT key, value->>'$.k' AS k, expires_at_ms - {NOW_MS + 86_400_000} AS ttl_ms FROM {_LATEST} WHERE kind = 'put' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW_MS + 86_400_000})")


def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal records of a prefix, in name order."""
    names = c.table(spark, sf_dir, "nation").select(F.concat(F.lit("conflict/"), "n_name").alias("name"), F.col("n_nationkey").cast("string").alias("value"))
    return state.metadata(names.unionByName(names.withColumn("name", F.concat(F.lit("partition/"), "value"))), "conflict/").select("name", "value")


_add("metadata_scan", metadata_scan, "SELECT 'conflict/' || n_name AS name, n_nationkey::varchar AS value FROM nation ORDER BY 1")
