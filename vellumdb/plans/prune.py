"""Whether documents of a collection may satisfy a query, by the keys that it holds.

Keys: ("path", path), ("term", path, value), ("scoped-path", array path, relative path)
and ("scoped-term", array path, relative path, value).  ``has`` may err only towards
true, as a Bloom filter does; so may the answer.
"""

from __future__ import annotations

from collections.abc import Callable

from .ast import And, ElemMatch, Expression, Not, Or, Predicate

Has = Callable[..., bool]


def possible(e: Expression, has: Has, scope: str | None = None) -> bool:
    """``scope``: the array path whose elements are looked at, if any."""
    if isinstance(e, Predicate):
        where = (e.path,) if scope is None else (scope, e.path)
        kind = "" if scope is None else "scoped-"
        for op, operand in e.ops:
            if op == "neq" or op == "exists" and not operand:
                continue  # true without any such leaf
            if op in ("eq", "contains"):
                if not has(kind + "term", *where, operand):
                    return False
            elif not has(kind + "path", *where):
                return False
        return True
    if isinstance(e, And):
        return all(possible(x, has, scope) for x in e.children)
    if isinstance(e, Or):
        return any(possible(x, has, scope) for x in e.children)
    if isinstance(e, Not):
        return True
    assert isinstance(e, ElemMatch)
    return possible(e.child, has, e.path)
