"""The scan plan: a query tree as one Boolean column over a VARIANT document.

Catalyst sees an ordinary filter, so it prunes columns and partitions around it; paths
without array levels become single VARIANT look-ups, others ``exists`` over elements.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variant import descend, elements, is_leaf, leaf_test, split_steps
from .ast import And, ElemMatch, Expression, Not, Or, Predicate
from .parser import parse_query
from .paths import Step


def some_value(root: Column, steps: tuple[Step, ...], test: Callable[[Column], Column]) -> Column:
    """Whether a value at the path passes the test: nested ``exists``, no flattening."""
    first, *rest = split_steps(steps)

    def level(value: Column, todo: list) -> Column:
        if not todo:
            return test(value)
        keys, *more = todo
        return F.coalesce(F.exists(elements(value), lambda x: level(descend(x, keys), more)), F.lit(False))

    return level(descend(root, first), rest)


def _predicate(root: Column, p: Predicate) -> Column:
    tests = []
    for op, operand in p.ops:
        if op == "exists":
            found = some_value(root, p.steps, is_leaf)
            tests.append(found if operand else ~found)
        else:
            found = some_value(root, p.steps, lambda x, op=op, operand=operand: leaf_test(x, op, operand))
            tests.append(~found if op == "neq" else found)
    return reduce(lambda a, b: a & b, tests)


def compile_column(root: Column, e: Expression) -> Column:
    if isinstance(e, Predicate):
        return _predicate(root, e)
    if isinstance(e, And):
        return reduce(lambda a, b: a & b, (compile_column(root, x) for x in e.children))
    if isinstance(e, Or):
        return reduce(lambda a, b: a | b, (compile_column(root, x) for x in e.children))
    if isinstance(e, Not):
        return ~compile_column(root, e.child)
    assert isinstance(e, ElemMatch)
    return some_value(root, e.steps, lambda x: F.coalesce(x.isNotNull(), F.lit(False)) & compile_column(x, e.child))


def search(docs: DataFrame, query: dict, column: str = "v") -> DataFrame:
    """The rows of ``docs`` whose VARIANT document satisfies the query."""
    return docs.where(compile_column(F.col(column), parse_query(query)))
