"""Timestamps found in free text, normalised to UTC seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = "[+-](?:[01][0-9]|2[0-3]):?[0-5][0-9]"
STAMP = f"[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T _][0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(?:[.,][0-9]+)?(?:Z|{_OFFSET})?"
LEADING = rf"^(?:\[{STAMP}[^\]]*\]?|{STAMP})"


def find_stamp(line: Column) -> Column:
    """The first timestamp written in the line, as text; null when there is none."""
    return F.nullif(F.regexp_extract(line, STAMP, 0), F.lit(""))


def to_utc(raw: Column) -> Column:
    """The moment as ``YYYY-MM-DDTHH:MM:SSZ``; null when the date or time is impossible."""
    wall = F.concat(F.substring(raw, 1, 10), F.lit(" "), F.substring(raw, 12, 8))
    moment = F.try_to_timestamp(wall, F.lit("yyyy-MM-dd HH:mm:ss"))
    offset = F.regexp_extract(raw, f"({_OFFSET})$", 1)
    digits = F.regexp_replace(offset, "[+:-]", "")
    secs = F.when(digits != "", F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60)
    signed = F.coalesce(F.when(offset.startswith("-"), -secs).otherwise(secs), F.lit(0))
    return F.date_format(F.timestamp_seconds(F.unix_timestamp(moment) - signed), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def strip_leading(line: Column) -> Column:
    return F.regexp_replace(line, LEADING, "")
