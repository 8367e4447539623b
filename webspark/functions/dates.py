"""Time: epoch milliseconds, ISO text, relative times, retention cutoffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
#: Milliseconds of the units that have a fixed length.
UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY_MS, "week": 7 * DAY_MS}


def iso(millis: Column) -> Column:
    """ISO text in UTC of epoch milliseconds. The session's time zone must be UTC."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def millis(iso_text: Column) -> Column:
    """Epoch milliseconds of an ISO text; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(iso_text))


def seconds_between(start: Column, end: Column) -> Column:
    return (end - start) / 1000


def expiry(now: Column, days: int = 7) -> Column:
    return now + days * DAY_MS


def retention_cutoff(now: int, keep_seconds: int) -> int:
    return now - keep_seconds * 1000


def relative_time(text: Column, now: int) -> Column:
    """The ISO time that "N units ago" means at ``now``: seconds to weeks are rounded to the unit,
    months and years go back on the calendar to midnight, days beyond a month's end running over
    into the next. Null for other texts."""
    form = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"
    count = F.regexp_extract(text, form, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(text, form, 2))
    step = F.element_at(F.create_map(*[x for k, v in UNIT_MS.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]), unit)
    rounded = iso((F.floor((F.lit(now) - count * step) / step + 0.5) * step).cast("bigint"))
    today = F.timestamp_millis(F.lit(now)).cast("date")
    months = F.when(unit == "month", count).otherwise(12 * count)
    first = F.add_months(F.trunc(today, "month"), -months)
    calendar = F.date_format(F.date_add(first, F.dayofmonth(today) - 1).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(count.isNotNull(), F.when(unit.isin("month", "year"), calendar).otherwise(rounded))


def images_time_filter(time_range: Column) -> Column:
    """The filter value of an image search for a time range."""
    return F.concat(F.lit("time:"), F.initcap(time_range))


def retry_after(value: Column, now: int, most: int = 5000) -> Column:
    """Milliseconds to wait: seconds or an HTTP date, kept within 0 and ``most``; null if neither."""
    seconds = F.when(value.rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(value).try_cast("double") * 1000)
    date = F.unix_millis(F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - now
    wait = F.coalesce(seconds, date).cast("bigint")
    return F.when(wait.isNotNull(), F.least(F.greatest(wait, F.lit(0)), F.lit(most)))
