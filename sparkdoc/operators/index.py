"""Secondary indexes as side tables sorted by encoded value and key."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.paths import parse_path, resolve
from ..functions.sort import Sort, order_by
from ..plans.pages import numbered
from ..plans.query import Index, KeyRange, Query


@dataclass(frozen=True)
class IndexSpec:
    name: str
    prefix: str
    field: str
    descending: bool = False

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{0,63}", self.name):
            raise ArgumentError("an index name has 1 to 64 of a-z, 0-9, _ and -, and begins with a letter or digit")
        parse_path(self.field)

    @property
    def fingerprint(self) -> str:
        """Of the definition: prefix, field and order."""
        return hashlib.sha256("\0".join(("v2", self.prefix, self.field, "desc" if self.descending else "asc")).encode()).hexdigest()[:16]


def entries(collection: DataFrame, spec: IndexSpec, *more: Column) -> DataFrame:
    """(tag, number, exact, text, key, expires_at_ms, ``more``) of every scalar at the field; arrays, objects, missing and invalid values have none."""
    ref = resolve(F.col("value"), collection.schema["value"].dataType, spec.field)
    expires = F.col("expires_at_ms") if "expires_at_ms" in collection.columns else F.lit(None).cast("long")
    exact = ref.large() if ref.exact is not None else F.lit(None).cast("decimal(38,0)")
    rows = collection.where(F.col("key").startswith(spec.prefix) & ref.scalar())
    return rows.select(ref.tag.alias("tag"), ref.number.alias("number"), exact.alias("exact"), ref.text.alias("text"), "key", expires.alias("expires_at_ms"), *more)


def build(collection: DataFrame, spec: IndexSpec, path: str) -> None:
    """Backfill: the side table range-partitioned and sorted by value and key, so row groups can be skipped."""
    order = [c.desc() if spec.descending else c.asc() for c in map(F.col, ("tag", "number", "exact", "text"))]
    entries(collection, spec).repartitionByRange(*order, F.col("key")).sortWithinPartitions(*order, F.col("key")).write.mode("overwrite").parquet(path)


def opened(spark: SparkSession, spec: IndexSpec, path: str) -> Index:
    """A built side table, ready to be read by queries."""
    return Index(spec, spark.read.parquet(path))


def backfill_step(collection: DataFrame, spec: IndexSpec, path: str, after: str | None = None, most: int = 10_000) -> str | None:
    """Adds the entries of the next ``most`` rows of the prefix by key to the side table; returns the key it came to, None at the end.

    A step is bounded, so writes go on between steps: ``updated`` with the keys at or below the step's key keeps what is
    there current. Each step is a folder of its own, which a step that is done again writes over.
    """
    keys = KeyRange(prefix=spec.prefix, after=after)
    edge = collection.where(keys.predicate(F.col("key"))).select("key").orderBy("key").limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last")).first()
    more = edge.n > most
    part = collection.where(keys.predicate(F.col("key")))
    if more:
        part = part.where(F.col("key") < edge["last"])
    name = hashlib.sha256((after or "").encode()).hexdigest()[:16]
    order = [c.desc() if spec.descending else c.asc() for c in map(F.col, ("tag", "number", "exact", "text"))]
    entries(part, spec).sortWithinPartitions(*order, F.col("key")).write.mode("overwrite").parquet(f"{path}/step={name}")
    return part.agg(F.max("key")).first()[0] if more else None


def backfill(collection: DataFrame, spec: IndexSpec, path: str, most: int = 10_000) -> None:
    """All steps of ``most`` rows at once: the same entries with their step's number, each step's in the order that a step has."""
    kept = [F.col(c) for c in ("key", "value", "expires_at_ms") if c in collection.columns]
    walk = numbered(collection.where(KeyRange(prefix=spec.prefix).predicate(F.col("key"))).select(*kept), [F.col("key").asc()]).rows
    order = [c.desc() if spec.descending else c.asc() for c in map(F.col, ("tag", "number", "exact", "text"))]
    entries(walk, spec, F.floor(F.col("_rank") / most).alias("step")).sortWithinPartitions("step", *order, F.col("key")).write.mode("overwrite").parquet(path)


def drop_step(index: DataFrame, most: int = 10_000) -> DataFrame:
    """What is left of a side table after a step of its removal: all but its ``most`` least keys."""
    gone = index.select("key").orderBy("key").limit(most)
    return index.join(F.broadcast(gone), "key", "left_anti")  # at most ``most`` rows


def updated(index: DataFrame, before: DataFrame, after: DataFrame, spec: IndexSpec) -> DataFrame:
    """The side table after a commit: entries of changed keys go, those of their new values come."""
    changed = before.select("key").unionByName(after.select("key")).distinct()
    return index.join(changed, "key", "left_anti").select(index.columns).unionByName(entries(after, spec).select(index.columns))


def lookup(index: DataFrame, value: object, keys: KeyRange = KeyRange()) -> DataFrame:  # noqa: B008
    """Keys with a scalar value, in key order."""
    if isinstance(value, list | dict):
        raise ArgumentError("only scalars are indexed")
    if value is None or isinstance(value, bool):
        at = F.col("tag") == (1 if value is None else 3 if value else 2)
    elif isinstance(value, str):
        at = F.col("text") == value
    else:
        at = F.col("number") == float(value)
        if isinstance(value, int):
            at = at & (F.col("exact").isNull() | (F.col("exact") == value))
    return index.where(at & keys.predicate(F.col("key"))).select("key").orderBy("key")


def scan_equal(collection: DataFrame, index: DataFrame, leaf_value: object, query: Query) -> DataFrame:
    """Candidates of the index, read again and held against the whole filter."""
    found = lookup(index, leaf_value, query.spec.keys).select("key")
    return query.matched(collection.join(found, "key", "left_semi"))


def ordered(index: DataFrame, spec: IndexSpec, limit: int, low: object = None, high: object = None) -> DataFrame:
    """Keys in index order; one-sided bounds (low inclusive, high exclusive) stay within their type."""
    rows = index
    for bound, above in ((low, True), (high, False)):
        if bound is not None:
            c = F.col("text") if isinstance(bound, str) else F.col("number")
            rows = rows.where(c >= bound if above else c < bound)

    class Entry:
        def order(self) -> list:
            return [F.col("tag"), F.col("number"), F.col("exact"), F.col("text")]

    return rows.orderBy(*order_by(Entry(), Sort(spec.field, spec.descending), F.col("key"))).limit(limit)


def status(configured: list[IndexSpec], state: DataFrame) -> DataFrame:
    """``state``: name, fingerprint, built. Configured ones are building or ready; others are dropping."""
    spark = state.sparkSession
    rows = spark.createDataFrame([(s.name, s.fingerprint) for s in configured], "name string, want string")
    both = rows.join(state, "name", "full")
    stale = F.col("want").isNull() | (F.col("fingerprint").isNotNull() & (F.col("want") != F.col("fingerprint")))
    return both.select("name", F.when(stale, "dropping").when(F.col("built"), "ready").otherwise("building").alias("state"))
