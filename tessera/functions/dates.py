"""Years in texts, days in a fixed offset, and rules over times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OLDEST = 1990
OFFSET_HOURS = 3


def years(text: Column, newest: Column | int, oldest: int = OLDEST) -> Column:
    """Plausible four-digit years in order, with repeats; digits on either side rule a year out."""
    found = F.regexp_extract_all(text, F.lit(r"(?<!\d)(1\d{3}|20\d{2})(?!\d)"), F.lit(1))
    return F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(F.lit(oldest), F.lit(newest) if isinstance(newest, int) else newest))


def mode_or_none(values: Column) -> Column:
    """The most frequent value; null if two are equally frequent or there is none."""
    kinds = F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v"))))
    first, second = F.get(kinds, F.lit(0)), F.get(kinds, F.lit(1))
    return F.when(second["n"].isNull() | (first["n"] != second["n"]), first["v"])


def reading(text: Column, newest: Column | int) -> Column:
    """(year, source, candidates) as read from a text."""
    found = years(text, newest)
    year = mode_or_none(found)
    return F.struct(year.alias("year"), F.when(year.isNotNull(), "text").otherwise("").alias("source"), F.array_sort(F.array_distinct(found)).alias("candidates"))


def first_year(*texts: Column) -> Column:
    """First year 19xx or 20xx of the first text that has one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(t, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int") for t in texts])


def day_key(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return (ts + F.expr(f"interval {hours} hours")).cast("date")


def week_key(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    """Monday of the week."""
    return F.date_trunc("week", ts + F.expr(f"interval {hours} hours")).cast("date")


def next_day_start(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return F.date_add(day_key(ts, hours), 1).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")


def relative_label(day: Column, today: Column) -> Column:
    n = F.datediff(today, day)
    return F.when(n == 0, "today").when(n == 1, "yesterday").when(n < 7, F.concat(n.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(day, "yyyy-MM-dd"))


def is_quiet(ts: Column, begin: int = 22, end: int = 9) -> Column:
    return (F.hour(ts) >= begin) | (F.hour(ts) < end)


def backoff_ms(attempts: Column, base: int = 60_000, most: int = 86_400_000) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempts)).cast("long")


def daily_permutation(day: Column, first: str, size: int, step: int = 17, shift: int = 5) -> Column:
    """Number of the day's item: a permutation of 0 to size - 1 as long as step and size share no factor."""
    return F.pmod(step * F.datediff(day, F.lit(first).cast("date")) + shift, F.lit(size))


def expired(at: Column, now: Column, ttl_seconds: int) -> Column:
    return now.cast("timestamp").cast("long") - at.cast("timestamp").cast("long") >= ttl_seconds
