"""Queries as trees of plain values."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from .paths import Step, format_path

Primitive = None | bool | int | float | str

#: Operators of a predicate, in the order in which they are evaluated and shown.
OPERATORS = ("exists", "eq", "neq", "contains", "gt", "gte", "lt", "lte", "between")


@dataclass(frozen=True)
class Predicate:
    """All operators hold, each on its own.  No steps: the element itself."""

    steps: tuple[Step, ...]
    ops: tuple[tuple[str, object], ...]

    @property
    def path(self) -> str:
        return format_path(self.steps)


@dataclass(frozen=True)
class And:
    children: tuple[Expression, ...]


@dataclass(frozen=True)
class Or:
    children: tuple[Expression, ...]


@dataclass(frozen=True)
class Not:
    child: Expression


@dataclass(frozen=True)
class ElemMatch:
    """Some one element of the array at the path satisfies the child."""

    steps: tuple[Step, ...]
    child: Expression

    @property
    def path(self) -> str:
        return format_path(self.steps)


Expression = Predicate | And | Or | Not | ElemMatch


def conjuncts(e: Expression) -> Iterator[Predicate]:
    """Predicates that every match must satisfy: those and-ed at the top.  Or, not and
    element matches are not entered."""
    if isinstance(e, Predicate):
        yield e
    elif isinstance(e, And):
        for x in e.children:
            yield from conjuncts(x)
