"""Vocabulary as literal columns of fixed, small size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(v) -> str:
    """A Python constant as SQL text."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "array(" + ", ".join(text(x) for x in v) + ")"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v)


def lookup(key: Column, pairs, default: Column | None = None) -> Column:
    """Literal map lookup; folds into the projection, so no join is planned."""
    flat = ", ".join(f"{text(k)}, {text(v)}" for k, v in pairs)
    found = F.try_element_at(F.expr(f"map({flat})"), key)
    return found if default is None else F.coalesce(found, default)


def rows_text(rows: list[tuple], names: list[str]) -> str:
    one = lambda r: "named_struct(" + ", ".join(f"'{n}', {text(v)}" for n, v in zip(names, r)) + ")"
    return "array(" + ", ".join(one(r) for r in rows) + ")"


def literal_rows(rows: list[tuple], names: list[str]) -> Column:
    """A literal array of structs, for ``inline`` of a fixed dimension."""
    return F.expr(rows_text(rows, names))


def rank_of(value: Column, ordered: list[str]) -> Column:
    """Position of a value in a fixed order, from 0; null when unknown."""
    return F.nullif(F.array_position(F.expr(text(ordered)), value), F.lit(0)) - 1
