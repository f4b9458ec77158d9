"""Names, times, sizes and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(col: Column) -> Column:
    """Lower case, spaces as underscores: the form in which class names of two sides are compared."""
    return F.replace(F.lower(col), F.lit(" "), F.lit("_"))


def split_version(name: Column) -> tuple[Column, Column]:
    """Stem and number of a name with a ``_vNNN`` ending; the whole name and null without one."""
    has = name.rlike(r"^.*_v\d+$")
    stem = F.when(has, F.regexp_extract(name, r"^(.*)_v\d+$", 1)).otherwise(name)
    return stem, F.when(has, F.regexp_extract(name, r"_v(\d+)$", 1).cast("int"))


def coerce_time(text: Column) -> Column:
    """A timestamp from ISO text or from UNIX seconds."""
    seconds = F.timestamp_seconds(F.when(text.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.trim(text)).cast("double"))
    return F.coalesce(seconds, F.try_to_timestamp(text))


def time_of_day(ts: Column) -> Column:
    """Hours since midnight."""
    return F.hour(ts) + F.minute(ts) / 60 + F.second(ts) / 3600


def human_bytes(n: Column) -> Column:
    """A byte count with the largest unit of which there is at least one."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(n >= 1024**power, F.concat(F.format_string("%.2f", n / 1024**power), F.lit(" " + unit))).otherwise(out)
    return out


def quantity(text: Column) -> Column:
    """Number and unit of a resolution such as ``10.0 meters``; null where there is no number."""
    number = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.trim(F.regexp_extract(text, r"^\s*[0-9.]+\s*(.*)$", 1))
    return F.when(number != "", F.struct(number.cast("double").alias("mag"), unit.alias("unit")))
