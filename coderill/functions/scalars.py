"""Scalar expressions that Spark has no single function for. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last suffix; a name that begins with its only dot stays whole."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def directory(path: Column, depth: int = 1) -> Column:
    """The first ``depth`` directories of a path; '.' for a bare file name."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n < 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(n, F.lit(depth))), "/"))


def monday_week(ts: Column) -> Column:
    """'year-week' with weeks that begin on Monday; days before the year's first Monday are in week 00."""
    week = F.floor((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7)
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(week.cast("string"), 2, "0"))


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days."""
    micros = [F.unix_micros(x.cast("timestamp")) for x in (later, earlier)]
    return (micros[0] - micros[1]) / F.lit(86400000000.0)


def first_integer(text: Column) -> Column:
    """The first run of digits as text, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit(""))


def share(part: Column, whole: Column) -> Column:
    """part / whole in percent, 0 where the whole is 0 or null."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def exact_mean(value: Column) -> Column:
    """The mean of doubles to twelve places, the same in whatever order rows are summed."""
    return F.sum(value.cast("decimal(24,12)")).cast("double") / F.nullif(F.count(value), F.lit(0))


def round_half_even(value: Column, places: int = 0) -> Column:
    """Rounded to even where two are equally near, as Python rounds exact values."""
    return F.bround(value, places)


def to_fixed(value: Column, places: int) -> Column:
    """Text with so many places, of two equally near the one further from 0."""
    return F.format_string(f"%.{places}f", value.cast("double"))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0."""
    return F.when(condition, 1).otherwise(0)


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"""^["'<]+|["'>]+$""", "")
