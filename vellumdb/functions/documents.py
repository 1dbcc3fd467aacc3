"""Documents as plain Python values: validation, canonical text and the reference
verifier, which states what a query means (it is the tests' oracle, not an executor)."""

from __future__ import annotations

import hashlib
import json
import math

from ..errors import ValidationError
from ..plans.ast import And, ElemMatch, Expression, Not, Or, Predicate
from ..plans.parser import parse_query
from ..plans.paths import Elements, Step


def check_value(value: object, open_ids: frozenset[int] = frozenset(), where: str = "$") -> None:
    if value is None or type(value) in (bool, int, str):
        return
    if type(value) is float:
        if not math.isfinite(value):
            raise ValidationError(f"{where}: {value} is not a finite number")
        return
    if type(value) not in (list, dict):
        raise ValidationError(f"{where}: {type(value).__name__} is not a JSON value")
    if id(value) in open_ids:
        raise ValidationError(f"{where}: the value contains itself")
    inner = open_ids | {id(value)}
    if type(value) is list:
        for k, x in enumerate(value):
            check_value(x, inner, f"{where}/{k}")
    else:
        for k, x in value.items():
            if type(k) is not str:
                raise ValidationError(f"{where}: the key {k!r} is not a string")
            check_value(x, inner, f"{where}/{k}")


def parse_document(value: object) -> dict:
    """The value, if it is a JSON object."""
    if type(value) is not dict:
        raise ValidationError("a document must be an object")
    check_value(value)
    return value


def parse_json_text(text: str) -> dict:
    """A document from its JSON text; NaN, infinities and trailing input are refused."""

    def refuse(name: str) -> None:
        raise ValidationError(f"{name} is not a JSON number")

    try:
        return parse_document(json.loads(text, parse_constant=refuse))
    except ValueError as e:
        raise ValidationError(f"not JSON: {e}") from e


def to_doc_id(value: object) -> int:
    if type(value) is not int or value < 1:
        raise ValidationError(f"{value!r} is not a document id")
    return value


def to_segment_id(value: object) -> int:
    if type(value) is not int or value < 1:
        raise ValidationError(f"{value!r} is not a segment id")
    return value


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def type_name(value: object) -> str:
    if value is None:
        return "null"
    return {bool: "boolean", int: "number", float: "number", str: "string"}.get(type(value), "array" if isinstance(value, list) else "object")


def values_at(roots: list, steps: tuple[Step, ...]) -> list:
    for s in steps:
        if isinstance(s, Elements):
            roots = [y for x in roots if isinstance(x, list) for y in x]
        else:
            roots = [x[s.name] for x in roots if isinstance(x, dict) and s.name in x]
    return roots


def same(a: object, b: object) -> bool:
    kind = type_name(a)
    if kind != type_name(b):
        return False
    return float(a) == float(b) if kind == "number" else a == b


def _holds(op: str, operand: object, leaves: list) -> bool:
    if op == "exists":
        return bool(leaves) == operand
    if op in ("eq", "contains"):
        return any(same(x, operand) for x in leaves)
    if op == "neq":
        return not any(same(x, operand) for x in leaves)
    numbers = [float(x) for x in leaves if type_name(x) == "number"]
    if op == "between":
        return any(operand[0] <= x <= operand[1] for x in numbers)
    test = {"gt": float.__gt__, "gte": float.__ge__, "lt": float.__lt__, "lte": float.__le__}[op]
    return any(test(x, float(operand)) for x in numbers)


def verify(root: object, e: Expression) -> bool:
    if isinstance(e, Predicate):
        leaves = [x for x in values_at([root], e.steps) if not isinstance(x, (list, dict))]
        return all(_holds(op, operand, leaves) for op, operand in e.ops)
    if isinstance(e, And):
        return all(verify(root, x) for x in e.children)
    if isinstance(e, Or):
        return any(verify(root, x) for x in e.children)
    if isinstance(e, Not):
        return not verify(root, e.child)
    assert isinstance(e, ElemMatch)
    return any(verify(x, e.child) for x in values_at([root], e.steps))


def verify_document(document: dict, query: dict) -> bool:
    """Whether a document satisfies a query."""
    return verify(document, parse_query(query))
