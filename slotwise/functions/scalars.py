"""Column expressions for rounding, times, labels and salted hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slotwise.config import LOGISTICS_KPIS


def half_even(e: str, digits: int) -> str:
    """SQL text that rounds the scaled double half to even, as numpy does (round() rounds half up)."""
    scale = f"{10 ** digits}D"
    return f"rint(({e}) * {scale}) / {scale}"


def utc(ts: Column) -> Column:
    """UTC wall time, whatever the session's time zone: an instant is converted, a plain time is UTC already.

    A date is its midnight.
    """
    # The type of a column is known when the plan is made, so only one branch stays.
    return F.when(F.typeof(ts) == "timestamp", F.convert_timezone(None, F.lit("UTC"), ts)).otherwise(
        ts.cast("timestamp_ntz"))


def utc_date(ts: Column) -> Column:
    return F.to_date(utc(ts))


_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), utc(ts))


def from_epoch_micros(micros: Column) -> Column:
    """UTC wall time."""
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 in UTC; sub-seconds are cut."""
    return F.floor(epoch_micros(ts) / F.lit(1_000_000)).cast("bigint")


def from_epoch_seconds(seconds: Column) -> Column:
    """UTC wall time."""
    return F.timestamp_add("SECOND", seconds, F.expr(_EPOCH))


def iso_timestamp(ts: Column) -> Column:
    """Text like 2023-01-01T00:48:04Z, in UTC."""
    text = utc(ts).cast("string")
    return F.concat(F.substring(text, 1, 10), F.lit("T"), F.substring(text, 12, 8), F.lit("Z"))


def weekday_name(ts: Column) -> Column:
    return F.date_format(utc_date(ts), "EEEE")


def day_number(ts: Column, start: Column) -> Column:
    """1 on the start date."""
    return F.datediff(utc_date(ts), start) + 1


def week_label(date: Column, first_date: Column) -> Column:
    """week_1 ... week_4 from the first date on, "0" for any other day."""
    d = F.datediff(date, first_date)
    label = F.lit("0")
    for week in (4, 3, 2, 1):
        label = F.when(d.between(7 * week - 7, 7 * week - 1), f"week_{week}").otherwise(label)
    return label


def significance(p: Column, alpha: float) -> Column:
    """A missing p-value counts as insignificant."""
    return F.when(p <= F.lit(alpha), "significant").otherwise("insignificant")


def kpi_family(kpi: Column) -> Column:
    return F.when(kpi.isin(*LOGISTICS_KPIS), "Log KPI").otherwise("Biz KPI")


def hash_number(*parts: Column) -> Column:
    """A whole number below 2^32 from the md5 of the parts joined by '~'."""
    digest = F.md5(F.concat_ws("~", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_text(*parts: Column) -> Column:
    return F.md5(F.concat_ws("~", *parts).cast("binary"))


def as_text(c: Column) -> Column:
    return c.cast("string")
