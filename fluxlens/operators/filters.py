"""The filter tree: leaves ``{"field", "operator", "value"}`` and groups ``{"op": AND|OR|NOT, "conditions": [...]}``."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxlens.functions.ip import IPV4_FIRST, cidr_bounds, ip_key, ipv4_block, literal_ip, plain_ipv4_number
from fluxlens.model import FIELD_KINDS, MAX_FILTER_DEPTH, MAX_IN_LIST, OPERATORS_BY_KIND


class QueryError(ValueError):
    """A question that is rejected before any job starts; the message names the culprit."""


def _is_empty(node: Mapping | None) -> bool:
    return not node or not (node.get("field") or node.get("op") or node.get("conditions"))


def _is_leaf(node: Mapping) -> bool:
    return bool(node.get("field"))


def check_filter(node: Mapping | None, depth: int = 0) -> None:
    """Reject unknown fields, operators that a field does not have, malformed groups and trees deeper than 8."""
    if depth > MAX_FILTER_DEPTH:
        raise QueryError(f"filter is nested deeper than {MAX_FILTER_DEPTH} levels")
    if _is_empty(node):
        return
    children = node.get("conditions") or []
    if _is_leaf(node):
        field, operator = node["field"], node.get("operator")
        if node.get("op") or children:
            raise QueryError(f"condition on {field!r} is a leaf and a group at once")
        if field not in FIELD_KINDS:
            raise QueryError(f"cannot filter by {field!r}")
        allowed = OPERATORS_BY_KIND[FIELD_KINDS[field]]
        if operator not in allowed:
            raise QueryError(f"field {field!r} does not support operator {operator!r} (it has {', '.join(allowed)})")
        if node.get("value") is None:
            raise QueryError(f"condition {field!r} {operator!r} has no value")
        return
    op = node.get("op")
    if op in ("AND", "OR"):
        if not children:
            raise QueryError(f"{op} needs at least one condition")
    elif op == "NOT":
        if len(children) != 1:
            raise QueryError(f"NOT takes exactly one condition, got {len(children)}")
    else:
        raise QueryError(f"unknown logical operator {op!r} (AND, OR, NOT)")
    for child in children:
        check_filter(child, depth + 1)


def filter_fields(node: Mapping | None) -> Iterator[str]:
    """Fields named anywhere in the tree, in order."""
    if _is_empty(node):
        return
    if _is_leaf(node):
        yield node["field"]
    for child in node.get("conditions") or []:
        yield from filter_fields(child)


def _number(field: str, value: object) -> int | float:
    if isinstance(value, str):
        try:
            return int(value.strip())
        except ValueError:
            raise QueryError(f"field {field!r} needs a number, got {value!r}") from None
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise QueryError(f"field {field!r} needs a number, got {value!r}")
    return int(value) if float(value).is_integer() else value


def _literal(field: str, value: object) -> object:
    kind = FIELD_KINDS[field]
    if kind == "int":
        return _number(field, value)
    if kind == "ip":
        try:
            return literal_ip(value)
        except ValueError:
            raise QueryError(f"field {field!r} needs an IP address, got {value!r}") from None
    return str(value)


def _in_list(field: str, operator: str, value: object) -> list:
    if not isinstance(value, list | tuple | set | frozenset):
        raise QueryError(f"operator {operator!r} on field {field!r} needs a list")
    if not value:
        raise QueryError(f"operator {operator!r} on field {field!r} has an empty list")
    if len(value) > MAX_IN_LIST:
        raise QueryError(f"operator {operator!r} on field {field!r} has {len(value)} values, more than {MAX_IN_LIST}")
    return [_literal(field, v) for v in value]


def _within_block(field: str, value: object, columns: frozenset[str]) -> Column:
    try:
        first, last = cidr_bounds(value)
    except ValueError as bad:
        raise QueryError(f"field {field!r}: {bad}") from None
    if f"{field}_key" in columns:
        return F.col(f"{field}_key").between(F.lit(first), F.lit(last))
    text = F.col(field)
    block = ipv4_block(first, last)
    if block is None:  # an IPv6 block: text without a colon need not be parsed, it is all inside or all outside
        inside = text.contains(":") & ip_key(text).between(F.lit(first), F.lit(last))
        return inside | ~text.contains(":") if first <= IPV4_FIRST <= last else inside
    low, high, shared = block
    inside = F.coalesce(plain_ipv4_number(text).between(F.lit(low), F.lit(high)), F.lit(False))
    # The octets that all addresses of the block share are a text prefix: cheap, and pushed down to the scan.
    return text.startswith(shared) & inside if shared else inside


def _like_pattern(value: str) -> str:
    """A backslash quotes %, _ and itself; before anything else it stands for itself, which Spark wants doubled."""
    return re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else r"\\", value)


_COMPARE = {
    "eq": lambda column, value: column == value,
    "ne": lambda column, value: column != value,
    "gt": lambda column, value: column > value,
    "gte": lambda column, value: column >= value,
    "lt": lambda column, value: column < value,
    "lte": lambda column, value: column <= value,
    "like": lambda column, value: column.like(_like_pattern(value)),
    "contains": lambda column, value: column.contains(value),
    "prefix": lambda column, value: column.startswith(value),
}


def _leaf(node: Mapping, columns: frozenset[str]) -> Column:
    field, operator, value = node["field"], node["operator"], node["value"]
    if operator == "cidr":
        return _within_block(field, value, columns)
    if operator in ("in", "not_in"):
        listed = F.col(field).isin(_in_list(field, operator, value))
        return ~listed if operator == "not_in" else listed
    return _COMPARE[operator](F.col(field), _literal(field, value))


def filter_column(node: Mapping | None, columns: object = ()) -> Column | None:
    """The tree as one boolean Column, or None for "no filter". ``columns`` are those of the filtered DataFrame.

    Addresses compare by their canonical text; CIDR blocks use the stored 16-byte key where the table has it.
    """
    columns = frozenset(columns)
    if _is_empty(node):
        return None
    if _is_leaf(node):
        return _leaf(node, columns)
    parts = [c for c in (filter_column(child, columns) for child in node["conditions"]) if c is not None]
    if not parts:
        return None
    if node["op"] == "NOT":
        return ~parts[0]
    return reduce((lambda a, b: a & b) if node["op"] == "AND" else (lambda a, b: a | b), parts)


def all_of(*nodes: Mapping | None) -> Mapping | None:
    """AND of the given trees, leaving out empty ones."""
    present = [n for n in nodes if not _is_empty(n)]
    if len(present) <= 1:
        return present[0] if present else None
    return {"op": "AND", "conditions": present}
