"""Parsers of small formats as column expressions: durations, sizes, identifiers, percentages, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _number(text: Column, pattern: str) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``1d 2h 3m 4s`` in any subset; a bare number is seconds; null for anything else."""
    t = F.lower(F.trim(text))
    parts = _number(t, r"(\d+)\s*d") * 86400 + _number(t, r"(\d+)\s*h") * 3600 + _number(t, r"(\d+)\s*m") * 60 + _number(t, r"(\d+)\s*s")
    return F.when(t.rlike(r"^\d+$"), _number(t, r"^(\d+)$")).when(t.rlike(r"^(\d+\s*d\s*)?(\d+\s*h\s*)?(\d+\s*m\s*)?(\d+\s*s)?$") & (t != ""), parts)


def walltime_minutes(text: Column) -> Column:
    """Minutes of ``MM``, ``MM:SS``, ``HH:MM:SS`` or ``D-HH[:MM[:SS]]``; null if unlimited or malformed."""
    t = F.lower(F.trim(text))
    n = lambda p: _number(t, p).cast("double")
    days = n(r"^(\d+)-") * 1440 + n(r"^\d+-(\d+)") * 60 + n(r"^\d+-\d+:(\d+)") + n(r"^\d+-\d+:\d+:(\d+)") / 60
    clock = n(r"^(\d+):\d+:\d+$") * 60 + n(r"^\d+:(\d+):\d+$") + n(r"^\d+:\d+:(\d+)$") / 60
    return F.when(t.rlike(r"^\d+$"), n(r"^(\d+)$")).when(t.rlike(r"^\d+:\d+$"), n(r"^(\d+):") + n(r":(\d+)$") / 60).when(t.rlike(r"^\d+:\d+:\d+$"), clock).when(t.rlike(r"^\d+-\d+(:\d+){0,2}$"), days)


def size_bytes(text: Column, bare: str = "m") -> Column:
    """Bytes of a size with a suffix k, m, g or t; a bare number has the suffix ``bare``."""
    t = F.lower(F.trim(text))
    value = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?$", 1).try_cast("double")
    unit = F.nullif(F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?$", 2), F.lit(""))
    power = F.instr(F.lit("kmgt"), F.coalesce(unit, F.lit(bare)))
    return (value * F.pow(F.lit(1024.0), power)).cast("long")


def doi(text: Column) -> Column:
    """First DOI, lower case, without closing punctuation; null if none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1)), r"[.,;:)\]]+$", ""), F.lit(""))


def year(text: Column) -> Column:
    """First plausible year, 1900 to 2099; null if none."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def percent_holds(n: Column, d: Column, percent: Column, decimals: Column) -> Column:
    """Whether ``n of d (percent)`` adds up: within .06 where the text has decimals, else .51; never if n > d or d = 0."""
    apart = F.abs(F.try_divide(n * 100, d) - percent)
    return F.coalesce((d > 0) & (n <= d) & (apart <= F.when(decimals > 0, 0.06).otherwise(0.51)), F.lit(False))


def activity(age_days: Column) -> Column:
    """active to 365 days, stale to 1,095, else inactive."""
    return F.when(age_days <= 365, "active").when(age_days <= 1095, "stale").when(age_days.isNotNull(), "inactive")
