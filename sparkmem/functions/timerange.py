"""Times: parsing, ages, and time ranges that a question names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def parse(text: Column) -> Column:
    """A timestamp in one of the accepted formats, else null."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def hours_old(at: Column, now: Column) -> Column:
    return F.greatest((F.unix_micros(now) - F.unix_micros(at)) / F.lit(3.6e9), F.lit(0.0))


def recency(at: Column, now: Column, half_life: float = 720.0, floor: float = 0.8) -> Column:
    """1 for new and unknown times, falling to the floor."""
    return floor + (1 - floor) * F.pow(F.lit(0.5), F.coalesce(hours_old(at, now), F.lit(0.0)) / half_life)


def decay(at: Column, now: Column, days: float) -> Column:
    seconds = (F.unix_micros(now) - F.unix_micros(at)) / F.lit(1e6)
    return F.when(seconds > 0, F.exp(-F.log(F.lit(2.0)) * seconds / (days * 86400))).otherwise(1.0)


def time_range(text: Column, now: Column) -> Column:
    """struct(low, high) of the first rule that applies, null if none: a date, month and year, a named day, last week, month or year, a year."""
    q = F.lower(F.trim(text))
    span = lambda low, high: F.struct(low.cast("timestamp").alias("low"), high.cast("timestamp").alias("high"))
    part = lambda k: F.regexp_extract(q, r"\b(\d{4})-(\d{2})-(\d{2})\b", k).try_cast("int")
    dated = part(2).between(1, 12) & part(3).between(1, 31)
    iso = F.date_add(F.make_date(part(1), F.when(dated, part(2)), F.lit(1)), part(3) - 1)  # a 31st that isn't there is the next month's first
    month = F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.regexp_extract(q, rf"\b({'|'.join(MONTHS)})\b", 1)).cast("int")
    year = F.regexp_extract(q, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    first = F.make_date(year, F.nullif(month, F.lit(0)), F.lit(1))
    january = F.make_date(year, F.lit(1), F.lit(1))
    today = now.cast("date")
    named = F.regexp_extract(q, r"\b(today|yesterday|tomorrow)\b", 1)
    day = F.date_add(today, F.when(named == "yesterday", -1).when(named == "tomorrow", 1).otherwise(0))
    unit = F.regexp_extract(q, r"\blast\s+(week|month|year)\b", 1)
    ago = lambda months: F.date_add(F.add_months(F.trunc(today, "MM"), -months), F.dayofmonth(today) - 1).cast("timestamp") + (now - today.cast("timestamp"))
    return (
        F.when(iso.isNotNull(), span(iso, F.date_add(iso, 1))).when(first.isNotNull(), span(first, F.add_months(first, 1)))
        .when(named != "", span(day, F.date_add(day, 1)))
        .when(unit == "week", span(now - F.expr("interval 7 days"), now)).when(unit == "month", span(ago(1), now)).when(unit == "year", span(ago(12), now))
        .when(january.isNotNull(), span(january, F.add_months(january, 12)))
    )
