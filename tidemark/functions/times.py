"""Times: monitoring days, ages, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def monitoring_day(utc: Column, zone: str = "America/Chicago", starts: int = 18) -> Column:
    """The day of the zone that starts at the given local hour. The zone comes first, so summer time is kept."""
    return (F.from_utc_timestamp(utc.cast("timestamp"), zone) - F.make_interval(hours=F.lit(starts))).cast("date")


def age_bucket(days: Column) -> Column:
    """Names of ages in days."""
    return F.when(days < 1, "today").when(days < 7, "week").when(days < 30, "month").otherwise("older")


def backoff(attempts: Column, base: int, most: int) -> Column:
    """Seconds to wait after so many attempts: doubling from base up to most."""
    power = F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(20)))
    return F.least(F.lit(float(most)), F.lit(float(base)) * power)


# Forms in which dates are written, and names of cycle states.
DATE_FORMS = ["yyyy-MM-dd", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy"]
CYCLE_STATES = ["open", "upcoming", "deadline_passed", "archived_or_information_only", "unknown", "rolling", "temporarily_closed", "next_cycle_not_announced"]
CYCLE_NAMES = {"deadline_passed": ["closed", "passed", "deadlinepassed"], "archived_or_information_only": ["archived", "past", "information_only", "info_only"]}


def lenient_date(c: Column) -> Column:
    """The date that a text names in one of the known forms, else null."""
    return F.coalesce(*[F.try_to_date(F.trim(c), form) for form in DATE_FORMS])


def relative_label(at: Column, now: Column) -> Column:
    """Just now, hours or days ago, or after two weeks the month and day in Chicago."""
    hours = F.greatest(F.lit(0), F.round((F.unix_micros(now) - F.unix_micros(at)) / 3_600_000_000.0).cast("int"))
    days = F.round(hours / 24.0).cast("int")
    local = F.date_format(F.from_utc_timestamp(at, "America/Chicago"), "MMM d")
    return F.when(hours < 1, "Just now").when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).when(days <= 14, F.concat(days.cast("string"), F.lit("d ago"))).otherwise(local)


def cycle_status(value: Column, deadline: Column, today: Column) -> Column:
    """A known state, a state by another name, or what the deadline says about today."""
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), "[ _-]+", "_"), "[^a-z0-9_]+", "")
    out = F.when(key.isin(CYCLE_STATES), key)
    for state, names in CYCLE_NAMES.items():
        out = out.when(key.isin(names), F.lit(state))
    day = lenient_date(deadline)
    return out.when(day < today, "deadline_passed").when(day.isNotNull(), "upcoming").otherwise("unknown")
