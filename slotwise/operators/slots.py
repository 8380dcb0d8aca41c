"""Slot aggregation: totals and per-order KPIs per time slot, for one design or a whole grid.

The grid is not expanded over the orders. Orders are read and summed once per zone and
granule (the longest step that divides every window); windows, lengths and variant
counts are expanded on those sums. Order counts are exact distinct counts and take
their own narrow path, so that KPI values are never shuffled per order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.config import ALL_KPIS, CUSTOMER_KPIS, LOGISTICS_KPIS, Allocation, StudyGrid, window_seconds
from slotwise.functions import exact
from slotwise.functions.scalars import epoch_seconds, half_even
from slotwise.operators.allocation import (
    add_runs, attach_slot_variant, slot_index, slot_uid, slot_variant, window_label,
)
from slotwise.operators.zones import GROUP, SESSION_TS, with_numeric_kpis

UNIT_KEYS = (GROUP, "time_zone_unit_id", "variant")


def with_totals(sums: DataFrame, kpis: Sequence[str]) -> DataFrame:
    """Add each KPI's sum s_ as a double from its exact parts w_ and b_, which go."""
    parts = {f"{p}_{k}" for k in kpis for p in "wb"}
    return sums.selectExpr(
        *[f"`{c}`" for c in sums.columns if c not in parts], *[f"{exact.total(f'w_{k}', f'b_{k}')} AS s_{k}" for k in kpis])


def _merge_counts(sums: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the distinct order counts to the sums of the same keys."""
    columns = [c for c in sums.columns if c not in keys]
    both = sums.unionByName(counts, allowMissingColumns=True)
    return both.groupBy(*keys).agg(
        *[F.expr(f"sum({c}) AS {c}") for c in columns],
        F.expr("coalesce(sum(order_count), 0L) AS order_count"),
    )


def _slot_sums(rows: DataFrame, keys: Sequence[str], with_logistics: bool) -> DataFrame:
    """KPI sums and distinct orders per slot; KPI sums and order codes are shuffled apart."""
    rows = with_numeric_kpis(rows)
    kpis = ALL_KPIS if with_logistics else CUSTOMER_KPIS
    measures = [e for k in kpis for e in exact.sums(k, f"w_{k}", f"b_{k}")]
    if with_logistics:
        measures += [f"count({k}) AS n_{k}" for k in LOGISTICS_KPIS]
    orders = (
        rows.where(F.col("platform_order_code").isNotNull())
        .select(*keys, "platform_order_code").distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("order_count"))
    )
    return with_totals(_merge_counts(rows.groupBy(*keys).agg(*map(F.expr, measures)), orders, keys), kpis)


def allocated_sums(allocated: DataFrame, with_logistics: bool = True) -> DataFrame:
    """Sums per slot and variant of orders that carry them, say from an imported allocation.

    Orders without a slot or variant are left out.
    """
    rows = allocated.where(F.col("time_zone_unit_id").isNotNull() & F.col("variant").isNotNull())
    return _slot_sums(rows, UNIT_KEYS, with_logistics)


def design_sums(prepared: DataFrame, allocation: Allocation, with_logistics: bool = True) -> DataFrame:
    """Sums per slot and variant of one design.

    All orders of a zone's slot share its variant, so the orders are summed by zone and slot
    number, and the hashes are taken once per slot instead of once per order.
    """
    keys = [GROUP, "zone_id", "slot_idx"]
    idx = slot_index(
        epoch_seconds(F.col(SESSION_TS)), F.col("start_s"), window_seconds(allocation.window_hours))
    rows = prepared.withColumn("slot_idx", idx).where(F.col("zone_id").isNotNull() & F.col("slot_idx").isNotNull())
    sums = _slot_sums(rows, keys, with_logistics)
    return attach_slot_variant(sums, allocation).drop("zone_id", "slot_idx")


# SQL text of the slot KPIs over the sums.


def rounded_totals() -> dict[str, str]:
    """Customer KPI totals, rounded to 2; zero where every value is missing."""
    return {k: half_even(f"coalesce(s_{k}, 0D)", 2) for k in CUSTOMER_KPIS}


def per_order_value(total: str) -> str:
    """The rounded total per order, rounded to 4."""
    return half_even(f"try_divide({total}, CAST(order_count AS DOUBLE))", 4)


def logistics_mean(kpi: str) -> str:
    """Mean over the known values, rounded to 2; NULL where none is known."""
    return half_even(f"try_divide(s_{kpi}, CAST(n_{kpi} AS DOUBLE))", 2)


def slot_totals(sums: DataFrame) -> DataFrame:
    """Customer KPI totals and distinct orders per slot and variant."""
    return sums.selectExpr(*UNIT_KEYS, *[f"{e} AS {k}" for k, e in rounded_totals().items()], "order_count")


def slot_per_order(sums: DataFrame) -> DataFrame:
    """Per-order customer KPIs (from the rounded totals), distinct orders and logistics means per slot."""
    return sums.selectExpr(
        *UNIT_KEYS,
        *[f"{per_order_value(e)} AS {k}" for k, e in rounded_totals().items()],
        "order_count",
        *[f"{logistics_mean(k)} AS {k}" for k in LOGISTICS_KPIS],
    )


# --- the whole grid -------------------------------------------------------------------


def _first_length(grid: StudyGrid) -> Column:
    """Shortest experiment length that covers the row's day; NULL beyond the longest."""
    out = F.lit(None).cast("bigint")
    for length in sorted(grid.exp_lengths, reverse=True):
        out = F.when(F.col("day_num") <= length, F.lit(length).cast("bigint")).otherwise(out)
    return out


def _grid_rows(prepared: DataFrame, grid: StudyGrid) -> DataFrame:
    """Orders with a zone and time within the longest experiment, with granule and first covering length."""
    session_s = epoch_seconds(F.col(SESSION_TS))
    return (
        prepared
        .where((F.col("day_num") <= max(grid.exp_lengths)) & F.col("zone_id").isNotNull() & F.col(SESSION_TS).isNotNull())
        .withColumn("granule", slot_index(session_s, F.col("start_s"), grid.granule_s))
        .withColumn("first_length", _first_length(grid))
        .withColumnRenamed(GROUP, "zone_group")
    )


def granule_facts(
    prepared: DataFrame, grid: StudyGrid, kpis: Sequence[str] = ALL_KPIS, by: Sequence[str] = (),
) -> DataFrame:
    """Per zone, granule and first covering length: count, exact sums of values and squares, and range of every KPI.

    The one pass over the KPI values; partial sums leave the scan, so a hot zone costs no
    more shuffle than any other. Sums are whole numbers: the same whatever the order of the rows. `by` names
    columns that keep the facts apart, say the day.
    """
    rows = with_numeric_kpis(_grid_rows(prepared, grid), kpis)
    measures = []
    for k in kpis:
        measures += [
            f"count({k}) AS n_{k}", *exact.sums(k, f"w_{k}", f"b_{k}"), *exact.sums(f"({k} * {k})", f"qw_{k}", f"qb_{k}"),
            f"min({k}) AS lo_{k}", f"max({k}) AS hi_{k}",
        ]
    return rows.groupBy(*by, "zone_group", "zone_id", "granule", "first_length").agg(*map(F.expr, measures))


def _per_window(df: DataFrame, grid: StudyGrid) -> DataFrame:
    """One copy of a row per window length, with the slot that its granule falls into."""
    windows = F.array(*[F.lit(w).cast("bigint") for w in grid.windows_s])
    return df.withColumn("window_s", F.explode(windows)).withColumn(
        "slot_idx", F.floor(F.col("granule") * F.lit(grid.granule_s) / F.col("window_s")).cast("bigint"))


def _per_length(df: DataFrame, grid: StudyGrid) -> DataFrame:
    """One copy of a row per experiment length that covers it."""
    lengths = F.array(*[F.lit(n).cast("bigint") for n in grid.exp_lengths])
    return df.withColumn("exp_length", F.explode(lengths)).where(F.col("exp_length") >= F.col("first_length"))


# Bits in one word, words in one mask, and counters in one aggregation, at most.
_WORD_BITS = 62
_MAX_WORDS = 64
_MAX_COUNTERS = 80


def slot_order_counts(prepared: DataFrame, grid: StudyGrid) -> DataFrame:
    """Distinct orders per zone, window, slot and experiment length.

    An order code that repeats in a slot counts once, from the shortest length that
    covers one of its rows. Rows of the result with equal keys add up.
    """
    rows = _grid_rows(prepared, grid).where(F.col("platform_order_code").isNotNull())
    narrow = rows.select("zone_group", "zone_id", "granule", "first_length", "platform_order_code")
    span = math.lcm(*grid.windows_s) // grid.granule_s
    slots = sum(span * grid.granule_s // w for w in grid.windows_s)
    if span * len(grid.exp_lengths) <= _WORD_BITS and slots * len(grid.exp_lengths) <= _MAX_COUNTERS:
        return _masked_order_counts(narrow, grid, span)
    counts = None
    for windows in window_families(grid):
        one = _wide_order_counts(narrow, grid, windows)
        counts = one if counts is None else counts.unionByName(one)
    return counts


def window_families(grid: StudyGrid) -> list[list[int]]:
    """Windows whose common block fits a mask together: all of them in any common grid, so that one shuffle serves all."""
    families: list[list[int]] = []
    for w in grid.windows_s:
        for family in families:
            both = [*family, w]
            if math.lcm(*both) // math.gcd(*both) * len(grid.exp_lengths) <= _WORD_BITS * _MAX_WORDS:
                family.append(w)
                break
        else:
            families.append([w])
    return families


def _length_rank(lengths: Sequence[int]) -> str:
    return "CASE first_length " + " ".join(f"WHEN {n} THEN {r}" for r, n in enumerate(lengths)) + " END"


_MASK_KEYS = ("zone_group", "zone_id", "block", "platform_order_code")


def _mask_shape(grid: StudyGrid, windows: Sequence[int]) -> tuple[int, int, int]:
    """Step of a family of windows, steps of its block, words of a mask."""
    step = math.gcd(*windows)
    span = math.lcm(*windows) // step
    return step, span, -(-span * len(grid.exp_lengths) // _WORD_BITS)


def _order_masks(narrow: DataFrame, grid: StudyGrid, windows: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Per zone, block and order code: the steps and first covering lengths that it occurs in.

    Bit i of a mask stands for step i % span of the block and length i // span. Words combine before the shuffle.
    """
    step, span, words = _mask_shape(grid, windows)
    at = narrow.withColumn("step", F.floor(F.col("granule") * F.lit(grid.granule_s) / F.lit(step))).withColumn(
        "position", F.pmod("step", F.lit(span))).withColumn("block", ((F.col("step") - F.col("position")) / span).cast("bigint"))
    at = at.withColumn("bit", F.expr(f"CAST(position + {span} * ({_length_rank(sorted(grid.exp_lengths))}) AS INT)"))
    word = [f"bit_or(IF(bit DIV {_WORD_BITS} = {w}, shiftleft(1L, bit % {_WORD_BITS}), 0L)) AS m{w}" for w in range(words)]
    return at.groupBy(*by, *_MASK_KEYS).agg(F.min("bit").alias("lowest"), F.max("bit").alias("highest"), *map(F.expr, word))


def order_masks(prepared: DataFrame, grid: StudyGrid, windows: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Masks of the prepared orders that have a code, for a family of windows; `by` keeps them apart, say by day."""
    rows = _grid_rows(prepared, grid).where(F.col("platform_order_code").isNotNull())
    return _order_masks(rows, grid, windows, by)


def merge_masks(masks: DataFrame) -> DataFrame:
    """Masks of several parts of the orders as those of the whole."""
    words = [c for c in masks.columns if c not in (*_MASK_KEYS, "lowest", "highest")]
    return masks.groupBy(*_MASK_KEYS).agg(
        F.min("lowest").alias("lowest"), F.max("highest").alias("highest"), *(F.bit_or(c).alias(c) for c in words))


def mask_counts(masks: DataFrame, grid: StudyGrid, windows: Sequence[int]) -> DataFrame:
    """Distinct orders per slot: each code names the slots that it touches, once per window and with the shortest length."""
    lengths = sorted(grid.exp_lengths)
    step, span, words = _mask_shape(grid, windows)
    cells = ", ".join(f"struct({w} AS w, m{w} AS m)" for w in range(words))
    # Most codes occur once; only the others look through their words.
    spread = (
        f"flatten(transform(filter(array({cells}), x -> x.m != 0), x -> transform(filter(sequence(0, {_WORD_BITS - 1}), "
        f"b -> getbit(x.m, b) = 1), b -> x.w * {_WORD_BITS} + b)))")
    bits = masks.select("zone_group", "zone_id", "block", F.expr(f"IF(lowest = highest, array(lowest), {spread})").alias("bits"))
    touched = []
    for w in windows:
        per, inside = span * step // w, w // step
        slot = f"array_sort(transform(bits, i -> struct((i % {span}) DIV {inside} AS slot, i DIV {span} AS rank)))"
        # The first of equal slots has the shortest length.
        touched.append(
            f"get(transform(array({slot}), t -> transform(filter(t, (x, i) -> i = 0 OR x.slot != get(t, i - 1).slot), "
            f"x -> struct({w}L AS window_s, block * {per}L + x.slot AS slot_idx, x.rank AS rank))), 0)")
    each = bits.select("zone_group", "zone_id", F.expr(f"inline(concat({', '.join(touched)}))"))
    keys = ["zone_group", "zone_id", "window_s", "slot_idx"]
    counts = each.groupBy(*keys, "rank").agg(F.count(F.lit(1)).alias("order_count"))
    first = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in lengths]), F.col("rank").cast("int") + 1)
    return _per_length(counts.withColumn("first_length", first), grid).select(*keys, "exp_length", "order_count")


def _wide_order_counts(narrow: DataFrame, grid: StudyGrid, windows: Sequence[int]) -> DataFrame:
    """One shuffle of the order codes for windows whose common block needs a mask of several words."""
    return mask_counts(_order_masks(narrow, grid, windows), grid, windows)


def _masked_order_counts(narrow: DataFrame, grid: StudyGrid, span: int) -> DataFrame:
    """One shuffle of the order codes for all windows.

    Slots of all windows start together every `span` granules. Per order code and such
    block, one bit mask notes granule and first covering length of every row; the order was in a slot,
    as seen by a length, if one of the slot's bits is set for this or a shorter length. Masks
    combine before the shuffle, so repeats of a code cost nothing.
    """
    lengths = sorted(grid.exp_lengths)
    rank = _length_rank(lengths)
    masks = (
        narrow.withColumn("position", F.pmod("granule", F.lit(span)))
        .withColumn("block", ((F.col("granule") - F.col("position")) / span).cast("bigint"))
        .groupBy("zone_group", "zone_id", "block", "platform_order_code")
        .agg(F.expr(f"bit_or(shiftleft(1L, CAST(position AS INT) + {span} * ({rank}))) AS mask"))
    )
    counters = {}
    for w in grid.windows_s:
        granules = w // grid.granule_s
        for j in range(span // granules):
            bits = ((1 << granules) - 1) << (j * granules)
            for r, n in enumerate(lengths):
                seen = sum(bits << (span * shorter) for shorter in range(r + 1))
                counters[w, span // granules, j, n] = f"count_if((mask & {seen}L) != 0)"
    wide = masks.groupBy("zone_group", "zone_id", "block").agg(
        *[F.expr(e).alias(f"c{i}") for i, e in enumerate(counters.values())])
    cells = ", ".join(
        f"struct({w}L AS window_s, block * {per_block}L + {j}L AS slot_idx, {n}L AS exp_length, c{i} AS order_count)"
        for i, (w, per_block, j, n) in enumerate(counters))
    return wide.select("zone_group", "zone_id", F.expr(f"inline(array({cells}))")).where("order_count > 0")


def grid_slots(facts: DataFrame, order_counts: DataFrame, grid: StudyGrid) -> DataFrame:
    """Sums per zone, window, slot and experiment length, with distinct orders."""
    keys = ["zone_group", "zone_id", "window_s", "slot_idx", "exp_length"]
    sums = [f"{p}_{k}" for k in ALL_KPIS for p in "wb"] + [f"n_{k}" for k in LOGISTICS_KPIS]
    # Windows and lengths expand inside the scan of the facts; the sums combine before the shuffle.
    expanded = _per_length(_per_window(facts, grid), grid).select(*keys, *sums)
    return with_totals(_merge_counts(expanded, order_counts.select(*keys, "order_count"), keys), ALL_KPIS)


def with_variants(slots: DataFrame, grid: StudyGrid) -> DataFrame:
    """One copy of a slot per variant count, with run, slot identifier and the slot's variant."""
    counts = F.array(*[F.lit(v).cast("bigint") for v in grid.num_variants])
    runs = add_runs(
        slots.withColumn("num_variants", F.explode(counts))
        .withColumn("sb_window_size", window_label(grid, F.col("window_s"))), grid)
    key, salt, zone, idx = (F.col(c) for c in ("run_key", "run_salt", "zone_id", "slot_idx"))
    return runs.withColumns({
        "time_zone_unit_id": slot_uid(key, salt, zone, idx),
        "variant": slot_variant(key, salt, zone, idx, F.col("num_variants")),
    })
