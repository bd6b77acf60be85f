"""Label, time and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels_in(text: Column) -> Column:
    """Labels of a white-space separated list; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def strip_language(label: Column, language: Column) -> Column:
    """Drops ``language/`` from the front of a label that is longer than the prefix."""
    prefix = F.concat(language, F.lit("/"))
    return F.when(label.startswith(prefix) & (F.length(label) > F.length(prefix)), F.substring(label, F.length(prefix) + 1, F.length(label))).otherwise(label)


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, halves away from zero."""
    return F.round(seconds * 1000).cast("long")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def ms_as_seconds(ms: Column) -> Column:
    """Shortest decimal of a time in whole milliseconds: 1500 -> 1.5, 2000 -> 2."""
    s = F.concat((ms / 1000).cast("long").cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))
    return F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def since_2024_ms(ts: Column) -> Column:
    """Whole milliseconds of a zone-less timestamp since 2024-01-01, whatever the session's zone."""
    day = F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("long") * 86_400_000
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")
