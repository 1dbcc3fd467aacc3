"""Columns over VARIANT values: navigation, leaves and typed comparison.

Casts of VARIANT coerce (``"12"`` casts to a number), so every comparison is guarded by
the value's own type.  All tests are two-valued: a missing value gives false, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.paths import Elements, Key, Step


def _plain(name: str) -> bool:
    """Whether a key can stand in a VARIANT path."""
    return not any(c in name for c in "'\"\\")


def child(value: Column, name: str) -> Column:
    """The property's value; null where there is none or the value is no object."""
    if _plain(name):
        return F.try_variant_get(value, f"$['{name}']", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


def descend(value: Column, steps: tuple[Key, ...]) -> Column:
    """Consecutive properties; plain keys take one look-up together."""
    run: list[str] = []
    for s in steps:
        if _plain(s.name):
            run.append(f"['{s.name}']")
            continue
        if run:
            value, run = F.try_variant_get(value, "$" + "".join(run), "variant"), []
        value = child(value, s.name)
    return F.try_variant_get(value, "$" + "".join(run), "variant") if run else value


def elements(value: Column) -> Column:
    """The elements of an array value; null otherwise."""
    return F.try_variant_get(value, "$", "array<variant>")


def split_steps(steps: tuple[Step, ...]) -> list[tuple[Key, ...]]:
    """Properties between array levels: ``a.b[].c[]`` gives (a, b), (c), ()."""
    out: list[list[Key]] = [[]]
    for s in steps:
        if isinstance(s, Elements):
            out.append([])
        else:
            out[-1].append(s)
    return [tuple(x) for x in out]


def values(root: Column, steps: tuple[Step, ...]) -> Column:
    """The values at a path as an array of VARIANT, in order; empty if there are none."""
    first, *rest = split_steps(steps)
    none = F.expr("CAST(array() AS array<variant>)")

    def level(value: Column, todo: list) -> Column:
        keys, *more = todo
        if not more:
            return F.filter(F.transform(elements(value), lambda x: descend(x, keys)), lambda x: x.isNotNull())
        return F.flatten(F.transform(elements(value), lambda x: F.coalesce(level(descend(x, keys), more), none)))

    at = descend(root, first)
    return F.coalesce(level(at, rest), none) if rest else F.array_compact(F.array(at))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_leaf(value: Column) -> Column:
    k = kind(value)
    return F.coalesce(value.isNotNull() & ~k.startswith("OBJECT") & ~k.startswith("ARRAY"), F.lit(False))


def equals(value: Column, operand: object) -> Column:
    """The cast is compared first: most values fail it, and only the others' types are
    looked up."""
    if operand is None:
        test = F.is_variant_null(value)
    elif isinstance(operand, bool):
        test = (F.try_variant_get(value, "$", "boolean") == F.lit(operand)) & (kind(value) == "BOOLEAN")
    elif isinstance(operand, str):
        test = (F.try_variant_get(value, "$", "string") == F.lit(operand)) & (kind(value) == "STRING")
    else:
        test = (F.try_variant_get(value, "$", "double") == F.lit(float(operand))) & numeric(value)
    return F.coalesce(test, F.lit(False))


def numeric(value: Column) -> Column:
    """Whether a value that casts to a double is a number itself."""
    return ~kind(value).isin("STRING", "BOOLEAN")


def leaf_test(value: Column, op: str, operand: object) -> Column:
    """Whether one leaf satisfies an existential operator."""
    if op in ("eq", "contains", "neq"):
        return equals(value, operand)
    n = F.try_variant_get(value, "$", "double")
    if op == "between":
        test = n.between(float(operand[0]), float(operand[1]))
    else:
        other = F.lit(float(operand))
        test = {"gt": n > other, "gte": n >= other, "lt": n < other, "lte": n <= other}[op]
    return F.coalesce(test & numeric(value), F.lit(False))
