"""Filters: a dictionary becomes a checked tree, the tree one Column.

``OPERATORS`` is the whole language of conditions: for each operator what its operand must be, and the predicate that it
stands for on a field. Parsing walks a worklist instead of the call stack, so limits hold before anything deep is
entered; compiling folds the finished tree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FilterError
from .paths import Ref, is_number, parse_path, two_valued

MAX_NODES, MAX_DEPTH, MAX_IN = 256, 16, 1000
COMPARE = {"$gt": ">", "$gte": ">=", "$lt": "<", "$lte": "<="}


class Operator(NamedTuple):
    operand: Callable[[object], bool]
    wants: str
    column: Callable[[Ref, object], Column]


def _ordered(symbol: str) -> Operator:
    return Operator(lambda x: is_number(x) or isinstance(x, str), "a number or a string", lambda field, x: field.compare(symbol, x))


def _but(positive: Callable[[Ref, object], Column]) -> Callable[[Ref, object], Column]:
    """The rows that ``positive`` doesn't hold for, those without the field among them."""
    return lambda field, x: ~two_valued(positive(field, x))


_any = lambda _: True
_list = lambda x: isinstance(x, list) and len(x) <= MAX_IN
OPERATORS: dict[str, Operator] = {
    "$eq": Operator(_any, "a value", lambda field, x: field.equals(x)),
    "$ne": Operator(_any, "a value", _but(lambda field, x: field.equals(x))),
    "$in": Operator(_list, f"a list of at most {MAX_IN} values", lambda field, x: field.among(x)),
    "$nin": Operator(_list, f"a list of at most {MAX_IN} values", _but(lambda field, x: field.among(x))),
    "$exists": Operator(lambda x: isinstance(x, bool), "true or false", lambda field, x: field.present if x else ~field.present),
    "$prefix": Operator(lambda x: isinstance(x, str), "a string", lambda field, x: field.prefix(x)),
    "$contains": Operator(_any, "a value", lambda field, x: field.contains(x)),
    **{name: _ordered(symbol) for name, symbol in COMPARE.items()},
}
#: How the parts of a group are put together.
JOIN: dict[str, Callable[[list[Column]], Column]] = {
    "and": lambda parts: reduce(Column.__and__, parts) if parts else F.lit(True),
    "or": lambda parts: reduce(Column.__or__, parts),
    "not": lambda parts: ~two_valued(parts[0]),
}


@dataclass(frozen=True)
class Leaf:
    path: str
    op: str
    operand: object


@dataclass
class Group:
    """``op``: and, or, not."""

    op: str
    items: list


def _conditions(path: str, said: object) -> list[Leaf]:
    """What a member of a filter says about its field: operators, or a value that it equals."""
    parse_path(path)
    names = {k for k in said if k.startswith("$")} if isinstance(said, dict) else set()
    if not names:
        return [Leaf(path, "$eq", said)]
    if strange := set(said) - OPERATORS.keys():
        raise FilterError(f"{path}: not operators: {sorted(strange)}")
    for name, x in said.items():
        if not OPERATORS[name].operand(x):
            raise FilterError(f"{path}: {name} needs {OPERATORS[name].wants}")
    return [Leaf(path, name, x) for name, x in said.items()]


def parse(where: object) -> Group:
    """The checked tree of a filter; raises ``FilterError``."""
    root, nodes = Group("and", []), 0
    todo: list[tuple[object, Group, int]] = [(where, root, 1)]
    while todo:
        doc, into, depth = todo.pop()
        if not isinstance(doc, dict) or depth > MAX_DEPTH:
            raise FilterError(f"filters are objects, nested at most {MAX_DEPTH} deep")
        for name, said in doc.items():
            if name in ("$and", "$or", "$not"):
                below = [said] if name == "$not" else said
                if not isinstance(below, list) or not below:
                    raise FilterError(f"{name} needs a list of filters")
                group = Group(name[1:], [Group("and", []) for _ in below])
                into.items.append(group)
                todo += [(x, g, depth + 1) for x, g in zip(below, group.items, strict=True)]
                nodes += 1
            elif name.startswith("$"):
                raise FilterError(f"{name} is no operator on filters")
            else:
                found = _conditions(name, said)
                into.items += found
                nodes += 1 + (len(found) if isinstance(said, dict) and found[0].operand is not said else 0)
            if nodes > MAX_NODES:
                raise FilterError(f"a filter has at most {MAX_NODES} conditions")
    return root


def compile_filter(where: object, at: Callable[[str], Ref]) -> Column:
    """The predicate of a filter; ``at`` resolves paths. NULL means no match, as WHERE takes it."""

    def column(node: Group | Leaf) -> Column:
        if isinstance(node, Leaf):
            return OPERATORS[node.op].column(at(node.path), node.operand)
        return JOIN[node.op]([column(x) for x in node.items])

    return column(parse(where))


def top_level(where: object) -> list[Leaf]:
    """The conditions that every match meets on its own: what an index can serve."""
    return [x for x in parse(where).items if isinstance(x, Leaf)]
