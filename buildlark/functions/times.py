"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def parse_iso(text: Column) -> Column:
    """ISO text to timestamp (UTC where no zone is given), NULL on failure."""
    return F.coalesce(F.concat(text, F.lit("Z")).try_cast("timestamp"), text.try_cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def iso(ts: Column) -> Column:
    """ISO text with microseconds only where there are any."""
    t = ts.cast("timestamp")
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.unix_micros(t) % 1_000_000 == 0, whole).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def weekday(ts: Column) -> Column:
    return F.date_format(ts, "EEE")


def run_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(1_000_000.0)


def hours_between(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)


def within_days(ts: Column, as_of: Column, days: int) -> Column:
    """True for rows not older than ``days`` before ``as_of``; a plain range on the column itself."""
    return ts >= as_of - F.make_dt_interval(F.lit(days))
