"""Typed field maps: building them and reading them under several key names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provlake.schema import FIELD

_SLOT = {"i": "bigint", "num": "string", "s": "string", "b": "boolean", "l": "array<string>"}


def typed(slot: str, value: str) -> str:
    """SQL text of one field value holding ``value`` in the named slot."""
    parts = ", ".join(f"'{k}', cast({value if k == slot else 'null'} as {t})" for k, t in _SLOT.items())
    return f"named_struct({parts})"


def pack(fields: dict[str, tuple[str, str]]) -> Column:
    """Map of the present fields only: an absent field is left out, never null.

    ``fields`` maps a name to (slot, SQL expression).
    """
    if not fields:
        return F.expr(f"cast(map() as map<string,{FIELD}>)")
    entries = ", ".join(
        f"if(({e}) is null, null, named_struct('key', '{k}', 'value', {typed(s, e)}))" for k, (s, e) in fields.items())
    return F.expr(f"map_from_entries(array_compact(array({entries})))")


def first_present(keys: list[str], fields: str = "fields") -> Column:
    """The first alias that is present; its type is checked only afterwards."""
    return F.expr("coalesce(" + ", ".join(f"try_element_at({fields}, '{k}')" for k in keys) + ")")


def any_int(*keys: str, fields: str = "fields") -> Column:
    return first_present(list(keys), fields)["i"]


def any_text(*keys: str, fields: str = "fields") -> Column:
    v = first_present(list(keys), fields)
    return F.coalesce(v["s"], v["num"])


def any_bool(*keys: str, fields: str = "fields") -> Column:
    return first_present(list(keys), fields)["b"]


def any_list(*keys: str, fields: str = "fields") -> Column:
    return first_present(list(keys), fields)["l"]
