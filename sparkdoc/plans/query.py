"""Query plans: a validated specification becomes one DataFrame, one page or one aggregate row.

A collection is a DataFrame with ``key`` (string) and ``value`` (VARIANT or struct), and whatever else records have.
Everything is declared on DataFrames, so key ranges and typed predicates reach the scan, sort with limit is a
distributed top-k, and aggregates combine on the map side; nothing loops over pages on the driver.

``page`` serves the client protocol: at most ``max_scanned`` rows are looked at, and the answer says where to go on. With
an index (``Index``: definition and side table) that covers the range, these rows are the side table's entries in its
order, and the collection is read at their keys only and checked against the whole filter. ``paged`` gives all pages of
a query at once, as tables (``pages``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, SortUnavailable
from ..functions.aggregates import Aggregates, expressions, merge, parse_aggregates, shaped
from ..functions.filters import COMPARE, compile_filter, parse, top_level
from ..functions.paths import Ref, resolve, two_valued
from ..functions.project import parse_fields, projected
from ..functions.sort import Sort, after_cursor, decode_cursor, encode_cursor, order_by, parse_sort, placed, position_order
from .pages import Pages, numbered

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
DEFAULT_SCANNED, MAX_SCANNED = 10_000, 100_000
_NAMES = {"prefix", "start", "end", "after", "where", "fields", "aggregate", "sort", "limit", "max_scanned", "consistency", "max_staleness_ms"}
CONSISTENCY = ("strict", "session", "bounded", "available", "eventual")
#: Candidate keys that are pushed to the scan one by one; more are pushed as a range.
MAX_KEYS = 1000


def prefix_end(prefix: str) -> str | None:
    """The least string above all with the prefix, by code point; None if there is none."""
    while prefix:
        last = ord(prefix[-1])
        if last < 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if last == 0xD7FF else last + 1)
        prefix = prefix[:-1]
    return None


@dataclass(frozen=True)
class KeyRange:
    prefix: str | None = None
    start: str | None = None
    end: str | None = None
    after: str | None = None

    def __post_init__(self) -> None:
        if self.prefix is not None and (self.start is not None or self.end is not None):
            raise ArgumentError("prefix excludes start and end")
        for x in (self.prefix, self.start, self.end, self.after):
            if x is not None and not isinstance(x, str):
                raise ArgumentError("keys are strings")

    def predicate(self, key: Column) -> Column:
        out = key.startswith(self.prefix) if self.prefix else F.lit(True)
        if self.start is not None:
            out = out & (key >= self.start)
        if self.end is not None:
            out = out & (key < self.end)
        if self.after is not None:  # one below the range changes nothing
            out = out & (key > self.after)
        return out

    def within(self, prefix: str) -> bool:
        """Whether every key of the range has the prefix."""
        if self.prefix is not None:
            return self.prefix.startswith(prefix)
        low, stop = self.start or "", prefix_end(prefix)
        return low >= prefix and (stop is None or (self.end is not None and self.end <= stop))


@dataclass
class QuerySpec:
    keys: KeyRange = field(default_factory=KeyRange)
    where: dict = field(default_factory=dict)
    fields: list | None = None
    aggregate: Aggregates | None = None
    sort: Sort | None = None
    after: str | None = None
    limit: int = DEFAULT_LIMIT
    max_scanned: int = DEFAULT_SCANNED
    consistency: str = "strict"

    @classmethod
    def of(cls, spec: dict) -> QuerySpec:
        """Checks a request; unknown names are errors."""
        if unknown := set(spec) - _NAMES:
            raise ArgumentError(f"unknown names {sorted(unknown)}")
        limit, scanned = spec.get("limit", DEFAULT_LIMIT), spec.get("max_scanned", DEFAULT_SCANNED)
        for name, x, most in (("limit", limit, MAX_LIMIT), ("max_scanned", scanned, MAX_SCANNED)):
            if not isinstance(x, int) or isinstance(x, bool) or not 1 <= x <= most:
                raise ArgumentError(f"{name} is between 1 and {most}")
        where = spec.get("where", {})
        parse(where)
        if spec.get("fields") is not None:
            parse_fields(spec["fields"])
        aggregate = parse_aggregates(spec["aggregate"]) if spec.get("aggregate") is not None else None
        sort = parse_sort(spec["sort"]) if spec.get("sort") is not None else None
        if sort and aggregate:
            raise ArgumentError("sort and aggregate exclude each other")
        mode, stale = spec.get("consistency") or "strict", spec.get("max_staleness_ms")
        if mode not in CONSISTENCY:
            raise ArgumentError(f"consistency is one of {CONSISTENCY}", "invalid_consistency")
        if (mode == "bounded") != (stale is not None):
            raise ArgumentError("max_staleness_ms goes with consistency bounded, and only with it")
        after = spec.get("after")
        if sort and after is not None:  # a sorted query's cursor is a position, else it is a key
            decode_cursor(after)
        keys = KeyRange(spec.get("prefix"), spec.get("start"), spec.get("end"), None if sort else after)
        return cls(keys, where, spec.get("fields"), aggregate, sort, after, limit, scanned, mode)


@dataclass(frozen=True)
class Index:
    """An index that can be read: its definition (name, prefix, field, descending) and its side table."""

    spec: object
    table: DataFrame


class _Entry(Ref):
    """The indexed field as a side table has it."""

    def __init__(self) -> None:
        self.tag, self.number, self.exact, self.text = F.col("tag"), F.col("number"), F.col("exact"), F.col("text")
        self.present = self.tag.isNotNull()

    def large(self) -> Column:
        return F.when(F.abs(self.number) >= float(1 << 53), self.exact)


def _values(ref: Ref) -> list[Column]:
    """The parts of a position."""
    return [c.alias(f"_{i}") for i, c in enumerate(ref.order())]


class Query:
    """A specification over a collection."""

    def __init__(self, collection: DataFrame, spec: dict | QuerySpec, indexes: list | None = None) -> None:
        self.spec = spec if isinstance(spec, QuerySpec) else QuerySpec.of(spec)
        self.collection, self.indexes = collection, indexes
        self.kind = collection.schema["value"].dataType
        self.typed = not isinstance(self.kind, T.VariantType)

    def at(self, path: str) -> Ref:
        return resolve(F.col("value"), self.kind, path)

    def ranged(self) -> DataFrame:
        return self.collection.where(self.spec.keys.predicate(F.col("key")))

    def matched(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows of the range that match; values that are no JSON never do."""
        return reduce(DataFrame.where, self._conditions(), self.ranged() if rows is None else rows)

    def _conditions(self) -> list[Column]:
        out = [] if self.typed else [F.col("value").isNotNull()]
        if self.spec.where:
            out.append(compile_filter(self.spec.where, self.at))
        if self.spec.sort:
            out.append(self.at(self.spec.sort.field).scalar())
        return out

    def _ordered(self, rows: DataFrame) -> DataFrame:
        s = self.spec
        if s.sort is None:
            return rows.orderBy("key")
        ref = self.at(s.sort.field)
        if s.after is not None:
            rows = rows.where(after_cursor(ref, s.sort, F.col("key"), s.after))
        return rows.orderBy(*order_by(ref, s.sort, F.col("key")))

    def _items(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("value", projected(F.col("value"), self.kind, self.spec.fields)) if self.spec.fields else rows

    def all(self) -> DataFrame:
        """Every match, projected, in no promised order: what a client's loop over pages gathers."""
        return self._items(self.matched())

    def top(self) -> DataFrame:
        """The first ``limit`` matches in order, as one distributed top-k."""
        return self._items(self._ordered(self.matched()).limit(self.spec.limit))

    def aggregated(self) -> DataFrame:
        """One row with a column per aggregate over all matches."""
        if self.spec.aggregate is None:
            raise ArgumentError("no aggregate")
        return self.matched().agg(*expressions(self.spec.aggregate, self.at))

    def aggregate(self) -> dict:
        return shaped(self.spec.aggregate, self.aggregated().first().asDict(), self.typed)

    def access(self) -> Index | None:
        """The index that serves the sort, or an equality of the filter; the result is the same either way."""
        ready = [i for i in self.indexes or [] if self.spec.keys.within(i.spec.prefix)]
        if sort := self.spec.sort:
            return next((i for i in ready if i.spec.field == sort.field and i.spec.descending == sort.descending), None)
        fields = {x.path for x in self._equalities()}
        return next((i for i in ready if i.spec.field in fields), None)

    def _equalities(self) -> list:
        return [x for x in top_level(self.spec.where) if x.op == "$eq" and not isinstance(x.operand, list | dict)]

    def _candidates(self, index: Index) -> DataFrame:
        """(key, and for a sort its values) of the index entries that pages look at."""
        s, entry = self.spec, _Entry()
        rows = index.table.where(s.keys.predicate(F.col("key")))
        if s.sort is None:
            value = next(x for x in self._equalities() if x.path == index.spec.field)
            return rows.where(entry.equals(value.operand)).select("key")
        for x in top_level(s.where):  # bounds on the sort field narrow the walk
            if x.path == s.sort.field and x.op in ("$eq", *COMPARE) and not isinstance(x.operand, list | dict):
                rows = rows.where(entry.equals(x.operand) if x.op == "$eq" else entry.compare(COMPARE[x.op], x.operand))
        if s.after is not None:
            rows = rows.where(after_cursor(entry, s.sort, F.col("key"), s.after))
        return rows.select("key", *_values(entry))

    def _entries(self, index: Index) -> DataFrame:
        """Those that one page looks at, one more than it may."""
        rows = self._candidates(index)
        return rows.orderBy(*self._walk(rows)).limit(self.spec.max_scanned + 1)

    def _walk(self, rows: DataFrame) -> list[Column]:
        """The order of rows that have a sort's values."""
        return placed([F.col(c) for c in rows.columns if c[1:].isdigit()], self.spec.sort, F.col("key"))

    def _looked(self, index: Index | None) -> tuple[DataFrame, list]:
        """Rows with ``_rn``, their place in the walk from 1 on, ``max_scanned`` + 1 at most; and the entries of the index."""
        s = self.spec
        if index is None:
            looked = self.ranged().orderBy("key").limit(s.max_scanned + 1)
            return looked.withColumn("_rn", F.row_number().over(Window.orderBy("key"))), []
        entries = self._entries(index).collect()  # as many as the page may look at
        keys = [r.key for r in entries]
        rows = self.ranged()
        if keys:
            rows = rows.where(F.col("key").isin(keys) if len(keys) <= MAX_KEYS else F.col("key").between(min(keys), max(keys)))
        places = self.collection.sparkSession.createDataFrame([(k, i + 1) for i, k in enumerate(keys)], "key string, _rn int")
        return rows.join(F.broadcast(places), "key"), entries

    def page(self, require_index: bool = False) -> dict:
        """One page: items (or aggregates), next_cursor (None when the range is done), scanned, index, consistency, partial.

        A page ends at ``limit`` matches or ``max_scanned`` rows looked at. The cursor is where it ended: a key, or of a
        sorted query a position. Pass it as ``after``. Sorted pages without an index are a top-k over all matches.
        """
        s, index = self.spec, self.access()
        if s.sort and index is None and require_index:
            raise SortUnavailable(f"no index for {s.sort.field}")
        said = {"index": index.spec.name if index else None, "consistency": s.consistency, "partial": False}
        if s.sort and index is None:
            return self._sorted_page() | said
        looked, entries = self._looked(index)
        hit = F.col("_rn") <= s.max_scanned
        if s.aggregate is not None:
            rows = looked.where(hit)
            found = shaped(s.aggregate, self.matched(rows).agg(*expressions(s.aggregate, self.at)).first().asDict(), self.typed)
            ends = [(r["key"], r["_rn"]) for r in looked.where(F.col("_rn") >= s.max_scanned).select("key", "_rn").orderBy("_rn").collect()] if index is None else [(e.key, i + 1) for i, e in enumerate(entries)][s.max_scanned - 1 :]
            n = (looked.count() if index is None and not ends else len(entries) if index else s.max_scanned)
            return {"aggregates": found, "next_cursor": ends[0][0] if len(ends) > 1 else None, "scanned": min(n, s.max_scanned)} | said
        # matches are numbered in the walk's order; with them the last rows come, which tell whether there are more
        good = self.matched(looked).where(hit).select("*", F.lit(True).alias("_hit"))
        first = self._items(good.orderBy("_rn").limit(s.limit + 1))
        if index is not None:
            found = first.collect()
            n, at = len(entries), lambda i: entries[i - 1]
        else:
            edge = looked.orderBy(F.col("_rn").desc()).limit(2).select("key", "_rn", F.lit(False).alias("_hit"))
            every = first.withColumn("_value", F.col("value")).select(*[c for c in first.columns if c != "value"], "_value")
            rows = every.unionByName(edge, allowMissingColumns=True).collect()
            found = [r for r in rows if r["_hit"]]
            ends = {r["_rn"]: r for r in rows if not r["_hit"]}
            n, at = max(ends, default=0), ends.get
        found.sort(key=lambda r: r["_rn"])
        stop = min(n, s.max_scanned)  # where the walk ended
        last = None
        if len(found) >= s.limit:
            stop = found[s.limit - 1]["_rn"]
            last = found[s.limit - 1]
        elif n > s.max_scanned:
            last = at(s.max_scanned)
        more = last is not None and stop < n
        items = []
        for r in found[: s.limit]:
            row = {k: v for k, v in r.asDict().items() if not k.startswith("_")}
            items.append(row | ({"value": r["_value"]} if index is None else {}))
        out = {"items": items, "next_cursor": None, "scanned": stop}
        if s.sort:
            out["positions"] = [self._position(entries[r["_rn"] - 1]) for r in found[: s.limit]]
        if more:
            out["next_cursor"] = self._position(entries[stop - 1]) if s.sort else last["key"]
        return out | said

    def _looked_at(self, *columns: str) -> DataFrame:
        """Every row that the query's pages look at: key, ``_hit``, a sort's values, and of matches the columns."""
        s, index = self.spec, self.access()
        if s.sort and index is None:  # a top-k over all matches
            ref = self.at(s.sort.field)
            rows = self.matched()
            if s.after is not None:
                rows = rows.where(after_cursor(ref, s.sort, F.col("key"), s.after))
            return self._kept(rows.withColumns({f"_{i}": c for i, c in enumerate(ref.order())}), *columns)
        if index is not None:
            good = self._kept(self.matched().withColumn("_hit", F.lit(True)), *columns)
            return self._candidates(index).join(good, "key", "left").withColumn("_hit", two_valued(F.col("_hit")))
        return self._kept(self.ranged().withColumn("_hit", two_valued(reduce(Column.__and__, self._conditions(), F.lit(True)))), *columns)

    def _kept(self, rows: DataFrame, *columns: str) -> DataFrame:
        held = [F.when(F.col("_hit"), F.col(c)).alias(c) if "_hit" in rows.columns else F.col(c) for c in columns if c != "value"]
        if "value" in columns:
            x = self._fields()
            value = projected(F.col("value"), self.kind, x) if x else F.col("value")
            held.append((F.when(F.col("_hit"), value) if "_hit" in rows.columns else value).alias("value"))
        return rows.select("key", *[c for c in rows.columns if c == "_hit" or c[1:].isdigit()], *held)

    def _fields(self) -> list | None:
        a = self.spec.aggregate
        if a is None or not self.typed:
            return self.spec.fields if a is None else None
        return [*a.sum, *a.min, *a.max] or None

    def paged(self, *columns: str) -> Pages:
        """All pages at once, as following the cursors gives them one after the other. ``columns``: what of the matches is wanted beside the key."""
        s = self.spec
        rows = self._looked_at(*columns)
        free = "_hit" not in rows.columns  # all rows are matches, and no budget of rows holds
        return Pages.cut(numbered(rows, self._walk(rows)), None if s.aggregate else s.limit, None if free else s.max_scanned, every=free, sort=s.sort is not None)

    def aggregates(self) -> list[dict]:
        """The aggregates of all pages, summed up at once; pages without a match have none."""
        a = self.spec.aggregate
        hits = self.paged("value").rows().where("_hit").select("_page", "value")
        found = hits.groupBy("_page").agg(*expressions(a, Query(hits, QuerySpec(aggregate=a)).at)).collect()
        return [shaped(a, r.asDict(), self.typed) for r in sorted(found, key=lambda r: r["_page"])]

    @staticmethod
    def _position(entry) -> str:
        return encode_cursor([entry[f"_{i}"] for i in range(len(entry) - 1)], entry["key"])

    def _sorted_page(self) -> dict:
        s = self.spec
        ref = self.at(s.sort.field)
        keys = _values(ref)
        rows = self._items(self._ordered(self.matched()).limit(s.limit + 1).select("*", *keys)).collect()
        places = [encode_cursor([r[f"_{i}"] for i in range(len(keys))], r["key"]) for r in rows]
        items = [{k: v for k, v in r.asDict().items() if not k.startswith("_")} for r in rows[: s.limit]]
        return {"items": items, "positions": places[: s.limit], "next_cursor": places[s.limit - 1] if len(rows) > s.limit else None, "scanned": len(items)}


def follow(collection: DataFrame, spec: dict, indexes: list | None = None) -> Iterator[dict]:
    """A query's pages one after the other, as a client follows their cursors."""
    after = spec.get("after")
    while True:
        page = Query(collection, spec | ({"after": after} if after is not None else {}), indexes).page()
        yield page
        after = page["next_cursor"]
        if after is None:
            return


def aggregate_pages(collection: DataFrame, spec: dict, indexes: list | None = None) -> dict:
    """The aggregates of a whole range from those of its pages, which are cut and summed up at once."""
    query = Query(collection, spec, indexes)
    return merge([shaped(query.spec.aggregate, query.matched(collection.limit(0)).agg(*expressions(query.spec.aggregate, query.at)).first().asDict(), query.typed), *query.aggregates()])


def paged_groups(groups: list[DataFrame], spec: dict, *columns: str) -> Pages:
    """All merged pages of a query that several groups of keys answer, at once.

    Each holds ``limit`` matches of all groups. Budgets of rows bound one request to a group; here there is none.
    """
    asked = [Query(g, spec) for g in groups]
    parts = [q._looked_at(*columns) for q in asked]
    parts = [p.where("_hit").drop("_hit") if "_hit" in p.columns else p for p in parts]
    rows, s = reduce(DataFrame.unionByName, parts), asked[0].spec
    return Pages.cut(numbered(rows, asked[0]._walk(rows)), s.limit, None, every=True, sort=s.sort is not None)


def merge_pages(parts: list[dict], limit: int, sort: Sort | None = None) -> dict:
    """One page from the pages that several groups gave to one query.

    A part speaks for the range up to its cursor, so the page holds what lies up to the least of these; what lies
    beyond is found again on the next page. Sorted parts are merged by position, others by key. A part of None is a
    group that didn't answer: the page is partial then.
    """
    known = [p for p in parts if p is not None]
    place = position_order(sort) if sort else lambda x: x
    rows = [(at, x) for p in known for at, x in zip(p["positions"] if sort else [x["key"] for x in p["items"]], p["items"], strict=True)]
    cut = min((p["next_cursor"] for p in known if p["next_cursor"] is not None), key=place, default=None)
    rows = sorted((r for r in rows if cut is None or place(r[0]) <= place(cut)), key=lambda r: place(r[0]))
    if len(rows) > limit:
        rows, cut = rows[:limit], rows[limit - 1][0]
    out = {"items": [x for _, x in rows], "next_cursor": cut, "scanned": sum(p["scanned"] for p in known)}
    out |= {"index": next((p["index"] for p in known if p["index"]), None), "partial": len(known) < len(parts) or any(p["partial"] for p in known)}
    return out | ({"positions": [at for at, _ in rows]} if sort else {})


__all__ = ["Index", "KeyRange", "Query", "QuerySpec", "aggregate_pages", "follow", "merge_pages", "paged_groups", "prefix_end"]
