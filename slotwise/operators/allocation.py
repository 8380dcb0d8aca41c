"""Switchback allocation: time slots per zone, and one salted variant per slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.config import Allocation, StudyGrid, window_seconds
from slotwise.functions.chi2 import chi2_survival
from slotwise.functions.scalars import (
    as_text, epoch_seconds, from_epoch_seconds, half_even, hash_number, hash_text, iso_timestamp,
)
from slotwise.operators.zones import GROUP, SESSION_TS


def slot_index(ts_s: Column, start_s: Column, window_s: Column | int) -> Column:
    """Number of whole windows since the start (both in seconds)."""
    window = window_s if isinstance(window_s, Column) else F.lit(window_s)
    return F.floor((ts_s - start_s) / window).cast("bigint")


def slot_of_day(idx: Column, window_s: int) -> Column:
    """Position of the slot in its experiment day (days counted from the start time)."""
    return F.floor(F.pmod(idx * F.lit(window_s), F.lit(86400)) / F.lit(window_s)).cast("bigint")


def slot_uid(key: Column, salt: Column, zone_id: Column, idx: Column) -> Column:
    """Unique per zone and slot; NULL when either is missing."""
    uid = hash_text(as_text(key), salt, as_text(zone_id), as_text(idx))
    return F.when(zone_id.isNotNull() & idx.isNotNull(), uid)


def slot_variant(key: Column, salt: Column, zone_id: Column, idx: Column, num_variants: Column) -> Column:
    """1 (control) to num_variants, constant within a zone's slot."""
    number = hash_number(F.lit("v"), as_text(key), salt, as_text(zone_id), as_text(idx))
    return F.when(zone_id.isNotNull() & idx.isNotNull(), F.lit(1) + F.pmod(number, num_variants.cast("bigint")))


def assign_slots(prepared: DataFrame, window_hours: float) -> DataFrame:
    """Add slot index, slot start and slot of the day, counted from the group's start."""
    window = window_seconds(window_hours)
    idx = slot_index(epoch_seconds(F.col(SESSION_TS)), F.col("start_s"), window)
    return prepared.withColumn("slot_idx", idx).withColumns({
        "slot_start": from_epoch_seconds(F.col("start_s") + F.col("slot_idx") * window),
        "slot_of_day": slot_of_day(F.col("slot_idx"), window),
    })


def allocate(prepared: DataFrame, allocation: Allocation) -> DataFrame:
    """Add variant and slot identifier to every order.

    Row-wise and deterministic in key and salt: no shuffle, and the order of rows does
    not matter. Needs a `start_s` column (the group's start, or a literal).
    """
    return attach_slot_variant(assign_slots(prepared, allocation.window_hours), allocation)


def attach_slot_variant(df: DataFrame, allocation: Allocation) -> DataFrame:
    """Add variant and slot identifier to rows with zone and slot number (orders or slots)."""
    key, salt = F.lit(allocation.key), F.lit(allocation.salt)
    zone, idx = F.col("zone_id"), F.col("slot_idx")
    return df.withColumns({
        "variant": slot_variant(key, salt, zone, idx, F.lit(allocation.num_variants)),
        "time_zone_unit_id": slot_uid(key, salt, zone, idx),
    })


def allocation_input(prepared: DataFrame) -> DataFrame:
    """Order code, zone and ISO time, sorted by time: the exchange format of an external allocator."""
    return prepared.select(
        "platform_order_code", "zone_id",
        iso_timestamp(F.col(SESSION_TS)).alias("dps_sessionid_created_at_utc_formatted"),
    ).orderBy("dps_sessionid_created_at_utc_formatted", "platform_order_code")


def attach_variants(orders: DataFrame, allocated: DataFrame) -> DataFrame:
    """Left join of an imported allocation (OrderID, Variant, SlotID).

    Orders without an allocation keep NULLs; an order code that occurs more than once on
    both sides multiplies. Missing codes match nothing and are dealt out by session time, hot codes
    are split by Spark's skew join.
    """
    right = allocated.select(
        F.col("OrderID").alias("platform_order_code"),
        F.col("Variant").alias("variant"),
        F.col("SlotID").alias("time_zone_unit_id"),
    )
    code = F.col("platform_order_code")
    keyed = orders.withColumns({
        "_known": code.isNotNull(),
        "_code": F.coalesce(code, F.xxhash64(SESSION_TS, "zone_name").cast("string")),
    })
    right = right.where(code.isNotNull()).select(
        F.lit(True).alias("_known"), code.alias("_code"), "variant", "time_zone_unit_id")
    return keyed.join(right, ["_known", "_code"], "left").drop("_known", "_code")


def variant_balance(allocated: DataFrame) -> DataFrame:
    """Orders and slots per zone group and variant."""
    return allocated.groupBy(GROUP, "variant").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_distinct("time_zone_unit_id").alias("slots"),
    )


def run_id(zone_group: Column, window_hours: Column, num_variants: Column, exp_length: Column) -> Column:
    return F.concat(
        zone_group, F.lit("-"), as_text(window_hours), F.lit("-window_size-"), as_text(num_variants),
        F.lit("-var_num-"), as_text(exp_length), F.lit("-exp_length"),
    )


def run_key(sim_run_id: Column, seed: str) -> Column:
    """A key in [1000, 2000] per run."""
    return F.lit(1000) + hash_number(F.lit("k"), sim_run_id, F.lit(seed)) % 1001


def run_salt(sim_run_id: Column, seed: str) -> Column:
    return hash_text(F.lit("s"), sim_run_id, F.lit(seed))


def window_label(grid: StudyGrid, window_s: Column) -> Column:
    """Window length in hours as whole number, or as fraction where a window of the grid is fractional."""
    hours = window_s / F.lit(3600)
    whole = all(w % 3600 == 0 for w in grid.windows_s)
    return hours.cast("bigint") if whole else hours.cast("double")


def add_runs(df: DataFrame, grid: StudyGrid) -> DataFrame:
    """Add run identifier, key and salt to rows that carry zone group, window, variants and length."""
    return df.withColumn(
        "sim_run_id", run_id(F.col("zone_group"), F.col("sb_window_size"), F.col("num_variants"), F.col("exp_length"))
    ).withColumns({
        "run_key": run_key(F.col("sim_run_id"), grid.seed),
        "run_salt": run_salt(F.col("sim_run_id"), grid.seed),
    })


def simulation_grid(starts: DataFrame, grid: StudyGrid) -> DataFrame:
    """All runs: every zone group with every window, variant count and length."""

    def each(values, kind: str) -> Column:
        return F.explode(F.array(*[F.lit(v).cast(kind) for v in values]))

    runs = (
        starts.select(F.col(GROUP).alias("zone_group"), "start_s")
        .withColumn("window_s", each(grid.windows_s, "bigint"))
        .withColumn("num_variants", each(grid.num_variants, "bigint"))
        .withColumn("exp_length", each(grid.exp_lengths, "bigint"))
        .withColumn("sb_window_size", window_label(grid, F.col("window_s")))
    )
    return add_runs(runs, grid)


def balance_test(balance: DataFrame, num_variants: int) -> DataFrame:
    """Chi-square test per zone group that all variants get the same share, of slots and of orders.

    `balance` is variant_balance's result. A variant without any slot has no row there; it counts as zero. Slots are what
    is drawn, so their test judges the allocation; orders come in slots and spread more than the test expects. Orders
    without a variant are left out. One variant has nothing to compare: its p-values are NULL.
    """
    counts = ("slots", "orders")
    sums = balance.where(F.col("variant").isNotNull()).groupBy(GROUP).agg(*[F.expr(e) for c in counts for e in (
        f"sum({c}) AS {c}", f"sum(CAST({c} AS DECIMAL(38, 0)) * {c}) AS q_{c}")])
    # Whole numbers up to the one division.
    degrees = f"CAST({num_variants - 1} AS DOUBLE)"
    statistics = [
        f"CAST({num_variants} * q_{c} - CAST({c} AS DECIMAL(38, 0)) * {c} AS DOUBLE) / CAST({c} AS DOUBLE) AS {c}_chi2" for c in counts]
    tested = sums.selectExpr(GROUP, *counts, *statistics)
    return tested.select(GROUP, F.lit(num_variants).cast("bigint").alias("num_variants"), *counts, *[f"{c}_chi2" for c in counts], *[
        chi2_survival(f"{c}_chi2", degrees).alias(f"{c}_p") for c in counts]).withColumns({
        f"{c}_p": F.expr(half_even(f"{c}_p", 4)) for c in counts})
