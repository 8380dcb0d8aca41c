"""Welch's one-way ANOVA from per-variant moments.

Two aggregations and Column arithmetic: (n, mean, variance) per variant, then the test
statistic per KPI.  A test needs at least two variants, each with two values and some
variance; otherwise its p-value is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.config import ALL_KPIS, LOGISTICS_KPIS, StudyGrid
from slotwise.functions import exact
from slotwise.functions.fdist import f_survival
from slotwise.functions.scalars import half_even, significance
from slotwise.operators.allocation import run_id, window_label
from slotwise.operators.slots import _per_length, _per_window, logistics_mean, per_order_value, rounded_totals, with_variants

RUN_KEYS = ("zone_group", "window_s", "num_variants", "exp_length")
# A standard deviation below this share of the mean is rounding noise of a constant KPI.
_NOISE = 1e-12
KPI_TYPES = ("tot", "per_order")


def _from_parts(source: str) -> str:
    """SQL of (mean, variance) from a struct of count n, exact sums w, b, qw, qb and range lo, hi.

    Deviations are taken from the whole number next to the mean, exactly; the range tells a constant KPI.
    """
    n, w, b, qw, qb = (f"{source}.{c}" for c in ("n", "w", "b", "qw", "qb"))
    c = f"get(array({exact.centre(n, w, b)}), 0)"
    count = f"CAST({n} AS DOUBLE)"
    around = (
        f"get(transform(array({c}), c -> struct(CAST(c AS DOUBLE) AS c, {exact.centred_sum(n, w, b, 'c')} AS d, "
        f"{exact.centred_squares(n, w, b, qw, qb, 'c')} AS q)), 0)")
    return (
        f"get(transform(array({around}), z -> struct("
        f"IF({source}.lo = {source}.hi, {source}.lo, z.c + try_divide(z.d, {count})) AS mean, "
        f"CASE WHEN {n} > 1 THEN IF({source}.lo = {source}.hi, 0D, greatest(z.q - z.d * (z.d / {count}), 0D)) / ({count} - 1D) END"
        " AS variance)), 0)")


def moments(df: DataFrame, keys: Sequence[str], kpis: Sequence[str], variant: str = "variant") -> DataFrame:
    """Count, mean and sample variance of every KPI per key and variant (wide rows in, long rows out).

    Rows without a variant must have been left out, as the slot frames do. The rows are aggregated as wide as they
    are; only the result, a row per variant, becomes long. All sums are exact, so the order of rows changes no bit.
    """
    values = df.selectExpr(*keys, variant, *[
        f"{exact.known(f'CAST(`{k}` AS DOUBLE)')} AS x{i}" for i, k in enumerate(kpis)])
    wide = values.groupBy(*keys, variant).agg(*[
        F.expr(e) for i in range(len(kpis)) for e in (
            f"count(x{i}) AS n{i}", *exact.sums(f"x{i}", f"w{i}", f"b{i}"),
            *exact.sums(f"(x{i} * x{i})", f"qw{i}", f"qb{i}"), f"min(x{i}) AS lo{i}", f"max(x{i}) AS hi{i}")])
    parts = ("n", "w", "b", "qw", "qb", "lo", "hi")
    return _named_moments(wide, [*keys, variant], [(k, {p: f"{p}{i}" for p in parts}) for i, k in enumerate(kpis)])


def _named_moments(wide: DataFrame, keys: Sequence[str], kpis: Sequence[tuple[str, dict[str, str]]]) -> DataFrame:
    """A row per KPI with n, mean and variance; each KPI names the columns of its parts."""
    cells = ", ".join(
        f"struct('{k}' AS kpi, {', '.join(f'{column} AS {p}' for p, column in own.items())})" for k, own in kpis)
    long = wide.selectExpr(*keys, f"explode(array({cells})) AS cell")
    return long.selectExpr(*keys, "cell.kpi AS kpi", "cell.n AS n", f"{_from_parts('cell')} AS of").select(
        *keys, "kpi", "n", "of.mean", "of.variance")


def welch_statistics(moments_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """F statistic, degrees of freedom and p-value (rounded to 4) per key."""
    usable = f"n >= 2 AND variance > pow(mean * {_NOISE!r}D, 2)"
    over = f"OVER (PARTITION BY {', '.join(keys)})"
    # A partition holds one row per variant, so the window is as small as the variant count.
    weighted = (
        moments_df.selectExpr("*", f"CASE WHEN {usable} THEN n / variance END AS w")
        .selectExpr("*", f"sum(w) {over} AS w_sum", f"try_divide(sum(w * mean) {over}, sum(w) {over}) AS centre")
    )
    sums = weighted.groupBy(*keys).agg(*map(F.expr, (
        "CAST(count(1) AS DOUBLE) AS k", "CAST(count(w) AS DOUBLE) AS k_usable",
        "sum(w * pow(mean - centre, 2)) AS between_ss",
        "sum(CASE WHEN w IS NOT NULL THEN pow(1 - w / w_sum, 2) / (n - 1) END) AS lam")))
    valid = "k >= 2 AND k_usable = k"
    tested = sums.repartition(*keys).selectExpr(
        *keys,
        f"CASE WHEN {valid} THEN try_divide(try_divide(between_ss, k - 1), "
        "1 + try_divide(2 * (k - 2) * lam, k * k - 1)) END AS f_stat",
        f"CASE WHEN {valid} THEN k - 1 END AS df1",
        f"CASE WHEN {valid} THEN try_divide(k * k - 1, 3 * lam) END AS df2",
    )
    return tested.select(
        "*", f_survival("f_stat", "df1", "df2").alias("p")
    ).selectExpr(*keys, "f_stat", "df1", "df2", f"{half_even('p', 4)} AS anova_pval")


def slot_kpi_columns(kpi_types: Sequence[str] = KPI_TYPES) -> dict[str, str]:
    """SQL of the slot KPIs over the sums, under names like "tot/gfv_local": only those that are asked for."""
    totals, columns = rounded_totals(), {}
    if "tot" in kpi_types:
        columns |= {f"tot/{k}": e for k, e in totals.items()}
        columns["tot/order_count"] = "order_count"
    if "per_order" in kpi_types:
        columns |= {f"per_order/{k}": per_order_value(e) for k, e in totals.items()}
        columns["per_order/order_count"] = "order_count"
        columns |= {f"per_order/{k}": logistics_mean(k) for k in LOGISTICS_KPIS}
    return columns


def slot_kpi_moments(sums: DataFrame, keys: Sequence[str], kpi_types: Sequence[str] = KPI_TYPES) -> DataFrame:
    """Moments over slots (sums with a variant): totals ("tot") and per-order KPIs ("per_order").

    A slot without orders has no per-order KPI.
    """
    columns = slot_kpi_columns(kpi_types)
    wide = sums.selectExpr(*keys, "variant", *[f"{e} AS `{name}`" for name, e in columns.items()])
    return _split_kpi(moments(wide, keys, list(columns)))


def slot_level_moments(slots: DataFrame, grid: StudyGrid, kpi_types: Sequence[str] = KPI_TYPES) -> DataFrame:
    """slot_kpi_moments of every run of the grid."""
    return slot_kpi_moments(with_variants(slots, grid), RUN_KEYS, kpi_types)


def _split_kpi(df: DataFrame) -> DataFrame:
    """kpi "tot/gfv_local" into kpi_type and kpi."""
    return df.withColumn("kpi_type", F.substring_index("kpi", "/", 1)).withColumn(
        "kpi", F.substring_index("kpi", "/", -1))


def order_level_moments(facts: DataFrame, grid: StudyGrid, kpis: Sequence[str] = ALL_KPIS) -> DataFrame:
    """Moments over orders of every run, merged from the granule facts.

    The facts hold exact sums, so merging them loses nothing, in whatever order.
    """
    parts = {"n": "sum", "w": "sum", "b": "sum", "qw": "sum", "qb": "sum", "lo": "min", "hi": "max"}
    combine = [f"{f}({p}_{k}) AS {p}_{k}" for k in kpis for p, f in parts.items()]
    keys = ["zone_group", "zone_id", "window_s", "slot_idx", "exp_length"]
    slots = _per_length(_per_window(facts, grid), grid).groupBy(*keys).agg(*map(F.expr, combine))
    merged = with_variants(slots, grid).groupBy(*RUN_KEYS, "variant").agg(*map(F.expr, combine))
    return _named_moments(
        merged, [*RUN_KEYS, "variant"], [(k, {p: f"{p}_{k}" for p in parts}) for k in kpis]).withColumn(
        "kpi_type", F.lit("order_level"))


def p_values(moments_df: DataFrame, grid: StudyGrid) -> DataFrame:
    """The result table of a study: one p-value and label per run, KPI type and KPI."""
    tested = welch_statistics(moments_df, [*RUN_KEYS, "kpi_type", "kpi"])
    window = window_label(grid, F.col("window_s"))
    return tested.select(
        run_id(F.col("zone_group"), window, F.col("num_variants"), F.col("exp_length")).alias("sim_run_id"),
        "zone_group", window.alias("sb_window_size"), "num_variants", "exp_length", "kpi", "anova_pval",
        significance(F.col("anova_pval"), grid.alpha).alias("anova_sig"), "kpi_type",
    )


def drop_order_count_per_order(results: DataFrame) -> DataFrame:
    """The order count is no per-order KPI; totals keep it."""
    return results.where(~((F.col("kpi_type") == "per_order") & (F.col("kpi") == "order_count")))
