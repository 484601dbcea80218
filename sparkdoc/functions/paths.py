"""Field paths: from a dotted path to what a predicate, an aggregate or a sort needs of a field.

A collection has a ``value`` column that is a VARIANT (schemaless) or a struct (typed). Both give a ``Ref``. In typed
collections a NULL member is a missing one, and predicates are bare comparisons that reach the Parquet scan.
Columns of a Ref are NULL where they don't apply; only negation turns NULL into False (``two_valued``).
"""

from __future__ import annotations

import json
import math
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FilterError

_INDEX = re.compile(r"\+?\d+")
EXACT = "decimal(38,0)"
#: Sort tags: null < false < true < numbers < strings.
NULL, FALSE, TRUE, NUMBER, STRING = 1, 2, 3, 4, 5


def parse_path(path: str) -> tuple[str, ...]:
    if not isinstance(path, str) or not path or "" in path.split("."):
        raise FilterError(f"bad field path {path!r}")
    return tuple(path.split("."))


def two_valued(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def is_number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def json_equal(a: object, b: object) -> bool:
    """Deep equality: numbers by value, booleans apart from numbers, members in any order."""
    if is_number(a) and is_number(b):
        return a == b if isinstance(a, int) == isinstance(b, int) else float(a) == float(b)
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(json_equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(json_equal(a[k], b[k]) for k in a)
    return a == b


def _container_test(column: Column, operand: object, element: bool) -> Column:
    """Deep equality with an array or object operand: the one test that built-in functions can't make."""
    said = json.dumps(operand)

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        want = json.loads(said)

        def one(text: str | None) -> bool:
            if text is None:
                return False
            value = json.loads(text)
            return isinstance(value, list) and any(json_equal(x, want) for x in value) if element else json_equal(value, want)

        return values.map(one).astype(bool)

    return test(column)


class Ref:
    """A field. ``tag``: sort tag or NULL; ``number``: double; ``exact``: decimal(38,0) of integers; ``text``: strings."""

    present: Column
    tag: Column
    number: Column
    exact: Column | None
    text: Column

    def _compare(self, op: str, operand: object) -> Column:
        apply = {"=": lambda x, y: x == y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y}[op]
        if isinstance(operand, str):
            return apply(self.text, F.lit(operand))
        real = apply(self.number, F.lit(float(operand)))
        if isinstance(operand, float) or self.exact is None:
            return real
        whole = apply(self.exact, F.lit(Decimal(operand)).cast(EXACT))
        return F.when(self.exact.isNotNull(), whole).otherwise(real)

    def compare(self, op: str, operand: object) -> Column:
        """Order against a number or string of the same kind."""
        return self._compare(op, operand)

    def equals(self, operand: object) -> Column:
        if operand is None:
            return self.tag == NULL
        if isinstance(operand, bool):
            return self.tag == (TRUE if operand else FALSE)
        if is_number(operand) or isinstance(operand, str):
            return self._compare("=", operand)
        return self.deep(operand)

    def among(self, operands: list) -> Column:
        out = F.lit(False)
        if texts := [x for x in operands if isinstance(x, str)]:
            out = out | self.text.isin(texts)
        for x in operands:
            if not isinstance(x, str):
                out = out | two_valued(self.equals(x))
        return out

    def prefix(self, text: str) -> Column:
        return self.text.startswith(text)

    def scalar(self) -> Column:
        return self.tag.isNotNull()

    def order(self) -> list[Column]:
        """Sort keys in the total order of scalars; integers beyond 2**53 are told apart."""
        return [self.tag, F.when(self.tag == NUMBER, self.number), *([self.large()] if self.exact is not None else []), F.when(self.tag == STRING, self.text)]

    def large(self) -> Column:
        """Numbers whose doubles may stand for several integers, as decimals."""
        return F.when(F.abs(self.number) >= float(1 << 53), F.coalesce(self.exact.cast(EXACT), self.number.try_cast(EXACT)))

    def deep(self, operand: object) -> Column:
        raise NotImplementedError

    def contains(self, operand: object) -> Column:
        raise NotImplementedError


class VariantRef(Ref):
    def __init__(self, raw: Column) -> None:
        self.raw = raw
        kind = F.schema_of_variant(raw)
        whole = (kind == "BIGINT") | kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)")
        numeric = whole | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")
        self.kind, self.present = kind, raw.isNotNull()
        truth = F.try_variant_get(raw, "$", "boolean")
        self.tag = F.when(kind == "VOID", NULL).when(kind == "BOOLEAN", F.when(truth, TRUE).otherwise(FALSE)).when(numeric, NUMBER).when(kind == "STRING", STRING)
        self.number = F.when(numeric, F.try_variant_get(raw, "$", "double"))
        self.exact = F.when(whole, F.try_variant_get(raw, "$", EXACT))
        self.text = F.when(kind == "STRING", F.try_variant_get(raw, "$", "string"))

    def deep(self, operand: object) -> Column:
        return F.when(self.kind.startswith("ARRAY" if isinstance(operand, list) else "OBJECT"), _container_test(F.to_json(self.raw), operand, False))

    def contains(self, operand: object) -> Column:
        array = self.kind.startswith("ARRAY")
        if isinstance(operand, list | dict):
            return F.when(array, _container_test(F.to_json(self.raw), operand, True))
        found = F.when(array, F.exists(F.try_variant_get(self.raw, "$", "array<variant>"), lambda e: two_valued(VariantRef(e).equals(operand))))
        return found.when(self.kind == "STRING", self.text.contains(operand)) if isinstance(operand, str) else found


class TypedRef(Ref):
    def __init__(self, column: Column | None, kind: T.DataType | None) -> None:
        none = F.lit(None)
        self.column, self.kind = column, kind
        self.present = F.lit(False) if column is None else column.isNotNull()
        self.tag, self.number, self.text, self.exact = none.cast("int"), none.cast("double"), none.cast("string"), None
        if isinstance(kind, T.BooleanType):
            self.tag = F.when(column, TRUE).when(~column, FALSE)
        elif isinstance(kind, T.IntegralType):
            self.tag, self.number, self.exact = F.when(column.isNotNull(), NUMBER), column.cast("double"), column
        elif isinstance(kind, T.NumericType):
            self.tag, self.number = F.when(column.isNotNull(), NUMBER), column.cast("double") if not isinstance(kind, T.DoubleType) else column
        elif isinstance(kind, T.StringType):
            self.tag, self.text = F.when(column.isNotNull(), STRING), column

    def _compare(self, op: str, operand: object) -> Column:
        whole = isinstance(self.kind, T.IntegralType) and is_number(operand)
        if whole and (isinstance(operand, int) or (math.isfinite(operand) and operand == int(operand))) and abs(operand) < 1 << 53:
            apply = {"=": "==", ">": ">", ">=": ">=", "<": "<", "<=": "<="}[op]
            left, right = self.column, F.lit(int(operand))
            return {"==": left == right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[apply]
        if isinstance(operand, str) != isinstance(self.kind, T.StringType) or not isinstance(self.kind, T.StringType | T.NumericType):
            return F.lit(False)
        return super()._compare(op, operand)

    def equals(self, operand: object) -> Column:
        if isinstance(operand, bool):
            return (self.column == operand) if isinstance(self.kind, T.BooleanType) else F.lit(False)
        return F.lit(False) if operand is None else super().equals(operand)

    def deep(self, operand: object) -> Column:
        wanted = T.ArrayType if isinstance(operand, list) else T.StructType
        return _container_test(F.to_json(self.column), operand, False) if isinstance(self.kind, wanted) else F.lit(False)

    def contains(self, operand: object) -> Column:
        if isinstance(self.kind, T.ArrayType):
            if isinstance(operand, list | dict):
                return _container_test(F.to_json(self.column), operand, True)
            return F.exists(self.column, lambda e: two_valued(TypedRef(e, self.kind.elementType).equals(operand)))
        if isinstance(self.kind, T.StringType) and isinstance(operand, str):
            return self.column.contains(operand)
        return F.lit(False)


def _quoted(name: str) -> str:
    if "'" not in name:
        return f"$['{name}']"
    if '"' not in name:
        return f'$["{name}"]'
    raise FilterError(f"a member name can't have both quotes: {name!r}")


def resolve(value: Column, kind: T.DataType, path: str) -> Ref:
    """The field at ``path`` of a value column of type ``kind``; digits index arrays and name members."""
    parts = parse_path(path)
    if isinstance(kind, T.VariantType):
        raw = value
        for p in parts:
            member = F.variant_get(raw, _quoted(p), "variant")
            raw = F.coalesce(member, F.variant_get(raw, f"$[{int(p)}]", "variant")) if _INDEX.fullmatch(p) and int(p) < 1 << 31 else member
        return VariantRef(raw)
    column: Column | None = value
    for p in parts:
        if isinstance(kind, T.StructType) and p in kind.names:
            column, kind = column.getField(p), kind[p].dataType
        elif isinstance(kind, T.ArrayType) and _INDEX.fullmatch(p):
            column, kind = F.get(column, F.lit(int(p))), kind.elementType
        else:
            return TypedRef(None, None)
    return TypedRef(column, kind)
