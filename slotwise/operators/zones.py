"""Zone groups: tagging orders, group start times, day and week filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.config import ALL_KPIS, ZoneGroup
from slotwise.functions import exact
from slotwise.functions.scalars import epoch_seconds, from_epoch_seconds, iso_timestamp, utc_date, week_label
from slotwise.operators.joins import join_dimension
from slotwise.sources.tables import zone_group_table

SESSION_TS = "dps_sessionid_created_at_utc"
GROUP = "zone_group_identifier"
# Longer value lists reach the scan as a range.
MAX_PUSHED_VALUES = 1000


def _among(column: str, values: list) -> Column:
    """A filter that the scan understands: the values themselves, or the range that holds many of them."""
    c = F.col(column)
    return c.isin(*values) if len(values) <= MAX_PUSHED_VALUES else c.between(min(values), max(values))


def tag_zone_groups(orders: DataFrame, groups: Sequence[ZoneGroup]) -> DataFrame:
    """Keep the orders of the groups' zones; an order in two groups comes out twice.

    The join decides; the lists of entities and assignments are filters that reach the scan.
    """
    entities = sorted({g.entity_id for g in groups})
    assignments = sorted({g.asa_id for g in groups})
    orders = orders.where(_among("entity_id", entities) & _among("asa_id", assignments))
    zones = (
        zone_group_table(orders.sparkSession, groups)
        # A zone listed twice in one group counts once, as in an IN list.
        .withColumn("zone_name", F.explode(F.array_distinct("zone_names"))).drop("zone_names")
    )
    n_zones = sum(len(g.zone_names) for g in groups)
    return join_dimension(orders, zones, ["entity_id", "asa_id", "zone_name"], configured_rows=n_zones)


def group_start_times(tagged: DataFrame) -> DataFrame:
    """First and last session time per zone group, as ISO text cut to whole seconds."""
    return (
        tagged.groupBy("entity_id", GROUP)
        .agg(F.min(SESSION_TS).alias("first_ts"), F.max(SESSION_TS).alias("last_ts"))
        .select(
            "entity_id", GROUP,
            iso_timestamp(F.col("first_ts")).alias("min_dps_session_start_ts"),
            iso_timestamp(F.col("last_ts")).alias("max_dps_session_start_ts"),
        )
    )


def group_starts(tagged: DataFrame) -> DataFrame:
    """Start of the experiment per zone group, in whole seconds since 1970."""
    return tagged.groupBy(GROUP).agg(epoch_seconds(F.min(SESSION_TS)).alias("start_s"))


def with_group_start(tagged: DataFrame, n_groups: int, starts: DataFrame | None = None) -> DataFrame:
    """Add each group's start. The start table has at most one row per configured group."""
    starts = group_starts(tagged) if starts is None else starts
    return join_dimension(tagged, starts, [GROUP], configured_rows=n_groups)


def prepare_orders(orders: DataFrame, groups: Sequence[ZoneGroup], starts: DataFrame | None = None) -> DataFrame:
    """Tagged orders with their group's start: the input of every allocation.

    `starts` (from group_starts, staged) spares the pass over the orders that finds them.
    """
    return with_group_start(tag_zone_groups(orders, groups), len(groups), starts)


def with_numeric_kpis(df: DataFrame, kpis: Sequence[str] = ALL_KPIS) -> DataFrame:
    """Cast the KPI columns to double; text that is no number is an error, a value that is not finite is missing."""
    return df.withColumns({k: F.expr(exact.known(f"CAST({k} AS DOUBLE)")) for k in kpis})


def with_week(prepared: DataFrame) -> DataFrame:
    """Session date and its week since the group's first date."""
    date = utc_date(F.col(SESSION_TS))
    return prepared.withColumns({
        "dps_session_created_date": date,
        "week_num": week_label(date, F.to_date(from_epoch_seconds(F.col("start_s")))),
    })


def within_exp_length(df: DataFrame, exp_length: int) -> DataFrame:
    return df.where(F.col("day_num") <= exp_length)


def per_exp_length(tagged: DataFrame, exp_lengths: Sequence[int]) -> DataFrame:
    """Orders, days and last day of each group within every experiment length.

    Orders are counted by group and day first; only these counts get a copy per length.
    """
    lengths = F.array(*[F.lit(n).cast("bigint") for n in exp_lengths])
    by_day = tagged.groupBy(GROUP, "day_num").agg(F.count(F.lit(1)).alias("orders"))
    covered = by_day.withColumn("exp_length", F.explode(lengths)).where(F.col("day_num") <= F.col("exp_length"))
    return covered.groupBy(GROUP, "exp_length").agg(
        F.sum("orders").alias("orders"), F.count("day_num").alias("days"), F.max("day_num").alias("last_day"))
