"""Time units made without an allocator: labelled slots, equal-width intervals and zone-slot identifiers.

Labels lie a fixed step apart (3 hours, whatever the window); the intervals cut the span
from the first to the last label into equally many parts, so they drift against the labels. Both are
kept, since an order needs its interval and its label's date to agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions.scalars import as_text, epoch_micros, from_epoch_micros, from_epoch_seconds, hash_text, utc_date
from slotwise.operators.zones import GROUP, SESSION_TS

# Fixed value: hours between two labels.
STEP_HOURS = 3
_MICROS = 1_000_000


def slot_total(window_hours: float, days: int) -> int:
    """Number of slots: whole windows that fit into the days."""
    n = int((24 / window_hours) * days)
    if n < 2:
        raise ValueError("need at least two slots")
    return n


def _span(n: int, step_hours: int) -> int:
    """Microseconds from the first to the last label."""
    return (n - 1) * step_hours * 3600 * _MICROS


def _whole_part(a: Column, b: Column) -> Column:
    """Whole-number quotient, exact: only the multiple of b is divided."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def edge_micros(idx: Column, n: int, step_hours: int = STEP_HOURS) -> Column:
    """Lower edge of interval idx, in microseconds from the start, rounded up."""
    return _whole_part(idx * F.lit(_span(n, step_hours)) + F.lit(n - 1), F.lit(n).cast("bigint"))


def last_edge_micros(n: int, step_hours: int = STEP_HOURS) -> int:
    """Upper edge of the last interval: the span plus a thousandth of it."""
    span = _span(n, step_hours)
    return span + span // 1000


def interval_index(offset: Column, n: int, step_hours: int = STEP_HOURS) -> Column:
    """Interval [edge, next edge) of an offset in microseconds; NULL outside all of them."""
    raw = _whole_part(offset * F.lit(n), F.lit(_span(n, step_hours)))
    inside = (offset >= 0) & (offset < F.lit(last_edge_micros(n, step_hours)))
    return F.when(inside, F.least(raw, F.lit(n - 1).cast("bigint")))


def micros_since(ts: Column, start_s: Column) -> Column:
    return epoch_micros(ts) - start_s * F.lit(_MICROS)


def slot_series(starts: DataFrame, window_hours: float, days: int, step_hours: int = STEP_HOURS) -> DataFrame:
    """Labelled slots per zone group: start + i steps."""
    n = slot_total(window_hours, days)
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    slots = starts.withColumn("slot_no", F.explode(numbers))
    label = from_epoch_seconds(F.col("start_s") + F.col("slot_no") * F.lit(step_hours * 3600))
    return slots.withColumn("slot_label", label).withColumn("slot_date", F.to_date("slot_label"))


def equal_width_bins(starts: DataFrame, window_hours: float, days: int, step_hours: int = STEP_HOURS) -> DataFrame:
    """Labelled slots with the interval that holds their label."""
    n = slot_total(window_hours, days)
    slots = slot_series(starts, window_hours, days, step_hours)
    offset = F.col("slot_no") * F.lit(step_hours * 3600 * _MICROS)
    idx = interval_index(offset, n, step_hours)
    upper = F.when(
        F.col("interval_no") == n - 1, F.lit(last_edge_micros(n, step_hours))
    ).otherwise(edge_micros(F.col("interval_no") + 1, n, step_hours))

    def at(micros: Column) -> Column:
        return from_epoch_micros(F.col("start_s") * F.lit(_MICROS) + micros)

    return slots.withColumn("interval_no", idx).withColumns({
        "interval_start": at(edge_micros(F.col("interval_no"), n, step_hours)),
        "interval_end": at(upper),
    })


def zone_slot_uid(zone_name: Column, slot_no: Column, salt: str) -> Column:
    return hash_text(F.lit(salt), zone_name, as_text(slot_no))


def slot_zone_grid(
    prepared: DataFrame, window_hours: float, days: int, salt: str, step_hours: int = STEP_HOURS
) -> DataFrame:
    """Every slot of a group with each zone that has orders in it, under a distinct identifier.

    The slots are a fixed number per group, so they expand on the distinct zones without a join.
    """
    zones = prepared.select(GROUP, "start_s", "zone_name").distinct()
    return equal_width_bins(zones, window_hours, days, step_hours).withColumn(
        "time_zone_unit_id", zone_slot_uid(F.col("zone_name"), F.col("interval_no"), salt))


def with_interval(prepared: DataFrame, window_hours: float, days: int, step_hours: int = STEP_HOURS) -> DataFrame:
    """Add the interval that holds each order's session time: computed, not searched."""
    n = slot_total(window_hours, days)
    offset = micros_since(F.col(SESSION_TS), F.col("start_s"))
    return prepared.withColumn("interval_no", interval_index(offset, n, step_hours))


def with_zone_slot(
    prepared: DataFrame, window_hours: float, days: int, salt: str, step_hours: int = STEP_HOURS
) -> DataFrame:
    """Add the zone-slot identifier where interval, zone and the label's date agree with the order.

    Equals the left join with slot_zone_grid on those three keys: every label is a function of its
    interval number, so no join and no shuffle is needed.
    """
    label_date = F.to_date(from_epoch_seconds(F.col("start_s") + F.col("interval_no") * F.lit(step_hours * 3600)))
    return with_interval(prepared, window_hours, days, step_hours).withColumn(
        "time_zone_unit_id",
        F.when(
            F.col("interval_no").isNotNull() & F.col("zone_name").isNotNull()
            & (utc_date(F.col(SESSION_TS)) == label_date),
            zone_slot_uid(F.col("zone_name"), F.col("interval_no"), salt)))
