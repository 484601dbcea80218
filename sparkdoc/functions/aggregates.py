"""Aggregates count, sum, min and max with exact rules for mixed types, and the merge of partial results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError
from .paths import NUMBER, STRING, Ref, TypedRef, is_number, parse_path

_I64 = 1 << 63


@dataclass
class Aggregates:
    count: bool = False
    sum: list[str] = field(default_factory=list)
    min: list[str] = field(default_factory=list)
    max: list[str] = field(default_factory=list)


def parse_aggregates(spec: object) -> Aggregates:
    """``{"count": true, "sum": "f" or ["f"], "min": .., "max": ..}``; at least one."""
    if not isinstance(spec, dict):
        raise ArgumentError("aggregate is an object")
    out = Aggregates()
    for name, x in spec.items():
        if name == "count":
            if not isinstance(x, bool):
                raise ArgumentError("count takes a boolean")
            out.count = x
        elif name in ("sum", "min", "max"):
            paths = [x] if isinstance(x, str) else x
            if not isinstance(paths, list) or not paths or not all(isinstance(p, str) for p in paths):
                raise ArgumentError(f"{name} takes field paths")
            for p in paths:
                parse_path(p)
            setattr(out, name, list(dict.fromkeys(paths)))
        else:
            raise ArgumentError(f"unknown aggregate {name}")
    if not (out.count or out.sum or out.min or out.max):
        raise ArgumentError("no aggregate is asked for")
    return out


def column_name(kind: str, path: str) -> str:
    return f"{kind}_{path.replace('.', '_')}"


def _sum(ref: Ref) -> Column:
    """As JSON text: exact while all numbers are 64-bit integers and so is the sum, else double; NULL without numbers or if not finite."""
    limit = F.lit(str(_I64)).cast("decimal(38,0)")
    signed = (ref.exact >= -limit) & (ref.exact < limit)
    whole, other = F.sum(F.when(signed, ref.exact)), F.sum(F.when(ref.number.isNotNull() & ~F.coalesce(signed, F.lit(False)), ref.number))
    n_other = F.count(F.when(ref.number.isNotNull() & ~F.coalesce(signed, F.lit(False)), 1))
    real = F.coalesce(whole.cast("double"), F.lit(0.0)) + F.coalesce(other, F.lit(0.0))
    exact = (n_other == 0) & (whole >= -limit) & (whole < limit)
    return F.when(F.count(ref.number) == 0, None).when(exact, whole.cast("string")).when(F.isnan(real) | (F.abs(real) == F.lit("Infinity").cast("double")), None).otherwise(real.cast("string"))


def _extreme(ref: Ref, best: Callable[[Column], Column]) -> Column:
    """As JSON text: numbers rank before strings, other types don't count."""
    exact = ref.exact if ref.exact is not None else F.lit(None).cast("decimal(38,0)")
    item = F.when(ref.tag.isin(NUMBER, STRING), F.struct(ref.tag.alias("tag"), ref.number.alias("number"), exact.cast("decimal(38,0)").alias("exact"), ref.text.alias("text")))
    found = best(item)
    return F.when(found["tag"] == STRING, F.to_json(F.array(found["text"])).substr(F.lit(2), F.length(F.to_json(F.array(found["text"]))) - 2)).when(found["exact"].isNotNull(), found["exact"].cast("string")).otherwise(found["number"].cast("string"))


def expressions(spec: Aggregates, at: Callable[[str], Ref]) -> list[Column]:
    """One column per aggregate: typed fields keep their type, schemaless ones are JSON text."""
    out = [F.count(F.lit(1)).alias("count")] if spec.count else []
    for kind, plain, mixed in (("sum", F.sum, _sum), ("min", F.min, lambda r: _extreme(r, F.min)), ("max", F.max, lambda r: _extreme(r, F.max))):
        for path in getattr(spec, kind):
            ref = at(path)
            if isinstance(ref, TypedRef):
                known = ref.number if ref.exact is None else ref.exact
                numeric, text = ref.number is not None and ref.kind is not None and ref.kind.typeName() not in ("string", "boolean", "array", "struct", "timestamp"), ref.kind is not None and ref.kind.typeName() == "string"
                source = known if numeric else ref.text if text and kind != "sum" else F.lit(None).cast("double")
                out.append(plain(source).alias(column_name(kind, path)))
            else:
                out.append(mixed(ref).alias(column_name(kind, path)))
    return out


def shaped(spec: Aggregates, row: dict, typed: bool) -> dict:
    """The nested result of the one row of ``expressions``."""
    import json

    read = (lambda x: x) if typed else (lambda x: None if x is None else json.loads(x))
    out: dict = {"count": row["count"]} if spec.count else {}
    for kind in ("sum", "min", "max"):
        if paths := getattr(spec, kind):
            out[kind] = {p: read(row[column_name(kind, p)]) for p in paths}
    return out


def _rank(x: object) -> tuple:
    return (0, x) if is_number(x) else (1, x)


def merge(parts: list[dict]) -> dict:
    """One result from those of parts: counts and sums add, extremes stay."""
    out: dict = {}
    for part in parts:
        if "count" in part:
            out["count"] = out.get("count", 0) + part["count"]
        for kind in ("sum", "min", "max"):
            for path, x in part.get(kind, {}).items():
                known = out.setdefault(kind, {}).get(path)
                if x is None or known is None:
                    out[kind][path] = known if x is None else x
                elif kind == "sum":
                    out[kind][path] = known + x
                else:
                    out[kind][path] = (min if kind == "min" else max)(known, x, key=_rank)
    return out
