"""Projection: listed paths as nested objects, the rest left out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError
from .paths import parse_path


def parse_fields(fields: object) -> list[tuple[str, ...]]:
    if not isinstance(fields, list) or not fields or not all(isinstance(x, str) for x in fields):
        raise ArgumentError("fields is a list of paths")
    return [parse_path(x) for x in fields]


def project_json(value: object, paths: list[tuple[str, ...]]) -> dict:
    """A path that reaches a scalar or an array keeps it whole; a missing leaf leaves its parent object; no object gives {}."""
    out: dict = {}
    for path in paths:
        source, target = value, out
        for i, name in enumerate(path):
            if not isinstance(source, dict) or name not in source:
                break
            inner = source[name]
            if i + 1 == len(path) or not isinstance(inner, dict):
                target[name] = inner
                break
            target = target.setdefault(name, {})
            source = inner
    return out


def _tree(paths: list[tuple[str, ...]]) -> dict:
    root: dict = {}
    for p in paths:
        at = root
        for name in p:
            at = at.setdefault(name, {})
    for p in paths:  # a whole member wins over its parts
        at = root
        for name in p[:-1]:
            at = at[name]
        at[p[-1]] = at[p[-1]] and {} if any(q == p for q in paths) else at[p[-1]]
    return root


def _struct(value: Column, kind: T.StructType, tree: dict) -> Column:
    made = []
    for f in kind.fields:
        if f.name in tree:
            inner = value.getField(f.name)
            if tree[f.name] and isinstance(f.dataType, T.StructType):
                inner = F.when(inner.isNotNull(), _struct(inner, f.dataType, tree[f.name]))
            made.append(inner.alias(f.name))
    return F.struct(*made) if made else F.lit(None).cast("string")


def projected(value: Column, kind: T.DataType, fields: object) -> Column:
    """Typed collections: a pruned struct, whose other columns the scan doesn't read. Schemaless: a VARIANT."""
    paths = parse_fields(fields)
    if isinstance(kind, T.StructType):
        return _struct(value, kind, _tree(paths))

    @F.pandas_udf("string")
    def keep(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else json.dumps(project_json(json.loads(x), paths), ensure_ascii=False))

    return F.try_parse_json(keep(F.to_json(value)))
