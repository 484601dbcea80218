"""Sorting by one field in the total order of scalars, and the cursors of sorted pages."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce, total_ordering

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError
from .paths import EXACT, Ref, parse_path


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


def parse_sort(spec: object) -> Sort:
    """``{"field": path, "order": "asc" or "desc"}``."""
    if not isinstance(spec, dict) or set(spec) - {"field", "order"} or "field" not in spec:
        raise ArgumentError("sort has a field and an order")
    parse_path(spec["field"])
    if spec.get("order", "asc") not in ("asc", "desc"):
        raise ArgumentError("order is asc or desc")
    return Sort(spec["field"], spec.get("order") == "desc")


def order_by(ref: Ref, sort: Sort, key: Column) -> list[Column]:
    """Ties are in ascending key order either way."""
    return placed(ref.order(), sort, key)


def placed(values: list[Column], sort: Sort | None, key: Column) -> list[Column]:
    """The same, given the sort's values (none: by key alone)."""
    return [c.desc_nulls_last() if sort.descending else c.asc_nulls_first() for c in values] + [key.asc()]


def encode_cursor(values: list, key: str) -> str:
    """Hex of the position: sort values and key."""
    plain = [str(v) if isinstance(v, Decimal) else v for v in values]
    return json.dumps([plain, key], ensure_ascii=False).encode().hex()


def decode_cursor(cursor: str) -> tuple[list, str]:
    try:
        values, key = json.loads(bytes.fromhex(cursor))
        if not isinstance(values, list) or not isinstance(key, str):
            raise ValueError
    except (ValueError, TypeError) as e:
        raise ArgumentError("bad cursor") from e
    return values, key


def after_cursor(ref: Ref, sort: Sort, key: Column, cursor: str) -> Column:
    """Rows behind the position: keyset comparison part by part."""
    values, last = decode_cursor(cursor)
    parts = ref.order()
    if {len(values), len(parts)} == {3, 4}:  # fields without large integers have no part for them
        values = [*values[:2], None, *values[2:]] if len(parts) == 4 else [*values[:2], *values[3:]]
    if len(values) != len(parts):
        raise ArgumentError("the cursor is of another sort")
    out = []
    same = F.lit(True)
    for i, (part, v) in enumerate(zip(parts, values, strict=True)):
        at = F.lit(v) if v is None or i != 2 or len(parts) == 3 else F.lit(Decimal(v)).cast(EXACT)  # large integers are written as text
        if v is not None:
            out.append(same & ((part < at) if sort.descending else (part > at)))
        same = same & part.eqNullSafe(at)
    return reduce(Column.__or__, out, same & (key > last))


def position_order(sort: Sort) -> Callable[[str], tuple]:
    """Sorts cursors as the query sorts their rows: missing parts last in descending order, keys ascending either way."""

    @total_ordering
    class Part:
        def __init__(self, x: object) -> None:
            self.x = (x is not None, x)

        def __eq__(self, other: object) -> bool:
            return self.x == other.x

        def __lt__(self, other: Part) -> bool:
            return self.x != other.x and ((other.x < self.x) if sort.descending else (self.x < other.x))

    def order(cursor: str) -> tuple:
        values, key = decode_cursor(cursor)
        if len(values) == 3:
            values.insert(2, None)
        values[2] = None if values[2] is None else Decimal(values[2])  # large integers are written as text
        return (*map(Part, values), key)

    return order
