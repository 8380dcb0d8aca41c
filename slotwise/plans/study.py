"""The A/A studies end to end: orders in, one result table out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.config import STUDY_ZONE_GROUPS, StudyGrid, ZoneGroup
from slotwise.functions.scalars import significance
from slotwise.operators.allocation import attach_variants, run_id
from slotwise.operators.interval_slots import with_zone_slot
from slotwise.operators.slots import allocated_sums, granule_facts, grid_slots, slot_order_counts
from slotwise.operators.welch import (
    KPI_TYPES, drop_order_count_per_order, order_level_moments, p_values, slot_kpi_moments, slot_level_moments,
    welch_statistics,
)
from slotwise.operators.zones import GROUP, group_starts, prepare_orders, tag_zone_groups, within_exp_length
from slotwise.sources.staging import stage
from slotwise.sources.tables import conform_results


def study_facts(
    orders: DataFrame, groups: Sequence[ZoneGroup], grid: StudyGrid
) -> tuple[DataFrame, DataFrame]:
    """Granule facts and distinct order counts, both staged: all that a study needs of the orders.

    The groups' starts are staged first, so the orders are read once for each of the three.
    """
    starts = stage(group_starts(tag_zone_groups(orders, groups)), "group-starts")
    prepared = prepare_orders(orders, groups, starts)
    return (
        stage(granule_facts(prepared, grid), "granule-facts"),
        stage(slot_order_counts(prepared, grid), "slot-orders"),
    )


def slot_study(
    orders: DataFrame, groups: Sequence[ZoneGroup] = STUDY_ZONE_GROUPS, grid: StudyGrid = StudyGrid(),
    kpi_types: Sequence[str] = KPI_TYPES,
) -> DataFrame:
    """p-values over time slots, 24 rows per run: totals, and per-order KPIs without the order count."""
    prepared = prepare_orders(orders, groups)
    slots = grid_slots(granule_facts(prepared, grid), slot_order_counts(prepared, grid), grid)
    return conform_results(drop_order_count_per_order(p_values(slot_level_moments(slots, grid, kpi_types), grid)))


def unit_study(
    rows: DataFrame, window_hours: float, num_variants: int, exp_length: int, alpha: float
) -> DataFrame:
    """p-values of one design whose orders carry unit and variant, over the units of each zone group.

    Orders beyond the experiment, or without unit or variant, are left out.
    """
    sums = allocated_sums(within_exp_length(rows, exp_length))
    m = slot_kpi_moments(sums, [GROUP]).withColumnRenamed(GROUP, "zone_group")
    label = int(window_hours) if float(window_hours).is_integer() else window_hours
    tested = welch_statistics(m, ["zone_group", "kpi_type", "kpi"]).withColumns({
        "sb_window_size": F.lit(label), "num_variants": F.lit(num_variants), "exp_length": F.lit(exp_length)})
    named = tested.withColumns({
        "sim_run_id": run_id(*(F.col(c) for c in ("zone_group", "sb_window_size", "num_variants", "exp_length"))),
        "anova_sig": significance(F.col("anova_pval"), alpha)})
    return conform_results(drop_order_count_per_order(named))


def imported_study(
    orders: DataFrame, allocated: DataFrame, groups: Sequence[ZoneGroup], window_hours: float, num_variants: int,
    exp_length: int, alpha: float = 0.1,
) -> DataFrame:
    """p-values under an allocation made elsewhere (OrderID, Variant, SlotID), 24 rows per zone group."""
    rows = attach_variants(tag_zone_groups(orders, groups), allocated)
    return unit_study(rows, window_hours, num_variants, exp_length, alpha)


def interval_study(
    orders: DataFrame, allocated: DataFrame, groups: Sequence[ZoneGroup], window_hours: float, num_variants: int,
    exp_length: int, salt: str, alpha: float = 0.05,
) -> DataFrame:
    """The first version of the study: variants from an allocation, units from the interval slots of each zone.

    Totals of logistics KPIs do not exist and have no rows.
    """
    rows = attach_variants(prepare_orders(orders, groups), allocated).drop("time_zone_unit_id")
    units = with_zone_slot(rows, window_hours, exp_length, salt)
    return unit_study(units, window_hours, num_variants, exp_length, alpha)


def order_study(
    orders: DataFrame, groups: Sequence[ZoneGroup] = STUDY_ZONE_GROUPS, grid: StudyGrid = StudyGrid()
) -> DataFrame:
    """p-values over single orders, 13 rows per run."""
    facts = stage(granule_facts(prepare_orders(orders, groups), grid), "granule-facts")
    return conform_results(p_values(order_level_moments(facts, grid), grid))


def full_study(
    orders: DataFrame, groups: Sequence[ZoneGroup] = STUDY_ZONE_GROUPS, grid: StudyGrid = StudyGrid()
) -> DataFrame:
    """Both studies from one pass over the orders' KPI values."""
    return results_of_facts(*study_facts(orders, groups, grid), grid)


def results_of_facts(facts: DataFrame, counts: DataFrame, grid: StudyGrid) -> DataFrame:
    """p-values over slots and over orders from stored facts; rows of the facts with equal keys add up."""
    columns = ["zone_group", "window_s", "num_variants", "exp_length", "variant", "kpi_type", "kpi",
               "n", "mean", "variance"]
    by_slot = slot_level_moments(grid_slots(facts, counts, grid), grid).select(*columns)
    by_order = order_level_moments(facts, grid).select(*columns)
    return conform_results(drop_order_count_per_order(p_values(by_slot.unionByName(by_order), grid)))
