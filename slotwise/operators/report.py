"""Reports over result tables: shares of significant p-values and p-value histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.config import StudyGrid, check_alpha, check_bin_width
from slotwise.functions.scalars import kpi_family, significance

BIN_KEYS = ("kpi_type", "kpi")


def relabel(results: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Significance at the report's alpha, whatever the stored label says."""
    return results.withColumn("is_sig", significance(F.col("anova_pval"), check_alpha(alpha)))


def with_family(results: DataFrame) -> DataFrame:
    return results.withColumn("biz_or_log_kpi", kpi_family(F.col("kpi")))


def significant_count() -> Column:
    return F.count(F.when(F.col("is_sig") == "significant", F.col("sim_run_id")))


def sig_counts(results: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Significant p-values per KPI type and KPI."""
    return relabel(results, alpha).groupBy(*BIN_KEYS).agg(
        significant_count().alias("count_p_val_sig"), F.count(F.lit(1)).alias("records"))


def overall_significance(results: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Significant and insignificant rows, with their share of all rows of the table."""
    by_label = relabel(results, alpha).groupBy("is_sig").agg(
        F.count(F.lit(1)).alias("records"), F.count("sim_run_id").alias("named"))
    total = F.sum("named").over(Window.partitionBy(F.lit(1)))
    return by_label.select(
        "is_sig", "records", total.cast("bigint").alias("total_record_count"),
        F.try_divide(F.col("records").cast("double"), total.cast("double")).alias("pct_sig_records"))


def significance_share(results: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Rows and their share of the whole table, per KPI type and label.

    The denominator covers the unfiltered table, whatever a view shows.
    """
    cells = relabel(results, alpha).groupBy("kpi_type", "is_sig").agg(
        F.count(F.lit(1)).alias("records"), F.count("sim_run_id").alias("named"))
    total = F.sum("named").over(Window.partitionBy(F.lit(1)))
    return cells.select(
        "kpi_type", "is_sig", "records", total.cast("bigint").alias("total_record_count"),
        F.try_divide(F.col("records").cast("double"), total.cast("double")).alias("pct_sig_records"))


def significance_cells(
    results: DataFrame, family: str, alpha: float = 0.1, denominator: str = "biz"
) -> DataFrame:
    """Share of significant p-values per window, variant count, KPI type and length.

    The denominator counts rows per window and KPI type over all lengths and variant
    counts. "biz" counts business KPIs on every sheet, as the published report does;
    "matching" counts the KPIs of the sheet's own family.
    """
    if family not in ("Biz KPI", "Log KPI"):
        raise ValueError("family must be 'Biz KPI' or 'Log KPI'")
    if denominator not in ("biz", "matching"):
        raise ValueError("denominator must be 'biz' or 'matching'")
    counted = "Biz KPI" if denominator == "biz" else family
    in_cell = F.col("biz_or_log_kpi") == family
    # One aggregation of the table gives both the cells and, summed once more, their denominators.
    cells = (
        with_family(relabel(results, alpha))
        .groupBy("kpi_type", "sb_window_size", "num_variants", "exp_length")
        .agg(
            F.count(F.when(in_cell, F.lit(1))).alias("records"),
            F.count(F.when(in_cell & (F.col("is_sig") == "significant"), F.col("sim_run_id"))).alias("count_p_val_sig"),
            F.count(F.when(F.col("biz_or_log_kpi") == counted, F.col("sim_run_id"))).alias("counted"),
        )
    )
    count_obs = F.sum("counted").over(Window.partitionBy("sb_window_size", "kpi_type"))
    return (
        cells.withColumn("count_obs", count_obs.cast("bigint"))
        .where(F.col("records") > 0)
        .select(
            "kpi_type", "sb_window_size", "num_variants", "exp_length", "count_p_val_sig", "count_obs",
            F.try_divide(F.col("count_p_val_sig").cast("double"), F.col("count_obs").cast("double")).alias("pct_p_val_sig"),
        )
    )


def significance_grid(
    results: DataFrame, family: str, alpha: float = 0.1, denominator: str = "biz",
    exp_lengths: tuple[int, ...] = StudyGrid().exp_lengths,
) -> DataFrame:
    """Cross-tab of significance_cells: windows and variants down, experiment lengths across."""
    cells = significance_cells(results, family, alpha, denominator)
    wide = (
        cells.groupBy("kpi_type", "count_obs", "sb_window_size", "num_variants")
        .pivot("exp_length", list(exp_lengths)).agg(F.max("pct_p_val_sig"))
    )
    return wide.withColumnsRenamed({str(n): f"pct_{n}d" for n in exp_lengths})


def p_value_bin(p: Column, width: float) -> Column:
    """Number of the bin [i*width, (i+1)*width) of a p-value that is rounded to 4 digits."""
    return F.floor(F.rint(p * F.lit(1e4)) / F.lit(float(round(width * 1e4)))).cast("bigint")


def bin_start(number: Column, width: float) -> Column:
    return number.cast("double") * F.lit(float(round(width * 1e4))) / F.lit(1e4)


def binned(results: DataFrame, width: float = 0.05, alpha: float = 0.1, keep_missing: bool = True) -> DataFrame:
    """Result rows with bin number and label; rows without a p-value have the bin NULL, or are left out."""
    rows = relabel(results, alpha)
    if not keep_missing:
        rows = rows.where(F.col("anova_pval").isNotNull())
    return rows.withColumn("bin_no", p_value_bin(F.col("anova_pval"), check_bin_width(width)))


def sheet(results: DataFrame, kpi_type: str, family: str, leave_out: str = "service_fee_local") -> DataFrame:
    """The rows of one histogram sheet; the always-zero service fee is left out."""
    return with_family(results).where(
        (F.col("kpi_type") == kpi_type) & (F.col("biz_or_log_kpi") == family) & (F.col("kpi") != leave_out))


def p_value_histogram(rows: DataFrame, width: float = 0.05, alpha: float = 0.1) -> DataFrame:
    """Rows per KPI, bin and label, with their percentage of the KPI's visible rows."""
    cells = binned(rows, width, alpha).groupBy(*BIN_KEYS, "bin_no", "is_sig").agg(F.count(F.lit(1)).alias("records"))
    total = F.sum("records").over(Window.partitionBy(*BIN_KEYS))
    return cells.select(
        *BIN_KEYS, bin_start(F.col("bin_no"), width).alias("p_val_bin"), "is_sig", "records",
        (F.col("records").cast("double") / total.cast("double")).alias("pct_of_total"))


def dense_histogram(rows: DataFrame, width: float = 0.05, alpha: float = 0.1) -> DataFrame:
    """Rows per KPI, label and bin with empty bins shown, from the lowest to the highest bin of the data.

    Rows without a p-value have a bin NULL of their own, shown where there are any.
    """
    keys = [*BIN_KEYS, "is_sig"]
    counts = binned(rows, width, alpha).groupBy(*keys, "bin_no").agg(F.count(F.lit(1)).alias("records"))
    # At most 1/width + 2 rows per KPI and label remain, so the range and the missing bins come from these counts.
    whole = Window.partitionBy(F.lit(1))
    known = F.when(F.col("bin_no").isNotNull(), F.struct("bin_no", "records"))
    by_kpi = (
        counts.withColumn("low", F.min("bin_no").over(whole)).withColumn("high", F.max("bin_no").over(whole))
        .groupBy(*keys)
        .agg(F.max("low").alias("low"), F.max("high").alias("high"),
             F.map_from_entries(F.collect_list(known)).alias("counts"),
             F.sum(F.when(F.col("bin_no").isNull(), F.col("records"))).alias("missing"))
    )
    bins = F.when(F.col("low").isNull(), F.array().cast("array<bigint>")).otherwise(F.sequence("low", "high"))
    bins = F.when(F.col("missing").isNotNull(), F.concat(bins, F.array(F.lit(None).cast("bigint")))).otherwise(bins)
    return by_kpi.select(*keys, "counts", "missing", F.explode(bins).alias("bin_no")).select(
        *BIN_KEYS, bin_start(F.col("bin_no"), width).alias("p_val_bin"), "is_sig",
        F.when(F.col("bin_no").isNull(), F.col("missing")).otherwise(
            F.coalesce(F.try_element_at("counts", F.col("bin_no")), F.lit(0))).alias("records"))


def histogram_shares(results: DataFrame, width: float = 0.05) -> DataFrame:
    """Rows per KPI and bin with their share of all rows of the KPI (rows without a p-value included)."""
    cells = (
        results.withColumn("bin_no", p_value_bin(F.col("anova_pval"), check_bin_width(width)))
        .groupBy(*BIN_KEYS, "bin_no").agg(F.count(F.lit(1)).alias("records"))
    )
    total = F.sum("records").over(Window.partitionBy(*BIN_KEYS))
    return (
        cells.withColumn("kpi_records", total.cast("bigint")).where(F.col("bin_no").isNotNull())
        .select(
            *BIN_KEYS, "bin_no", bin_start(F.col("bin_no"), width).alias("p_val_bin"), "records", "kpi_records",
            (F.col("records").cast("double") / F.col("kpi_records").cast("double")).alias("p_val_hist_pct"))
    )


def histogram_calcs(results: DataFrame, width: float = 0.05) -> DataFrame:
    """Along the bins of each KPI: difference from the previous bin, moving and running totals."""
    along = Window.partitionBy(*BIN_KEYS).orderBy("bin_no")
    running = F.sum("records").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return histogram_shares(results, width).select(
        *BIN_KEYS, "p_val_bin", "records", "p_val_hist_pct",
        (F.col("records") - F.lag("records", 1).over(along)).alias("records_diff"),
        (F.col("p_val_hist_pct") - F.lag("p_val_hist_pct", 1).over(along)).alias("pct_diff"),
        F.sum("records").over(along.rowsBetween(-2, Window.currentRow)).alias("moving_records"),
        (running.cast("double") / F.col("kpi_records").cast("double")).alias("running_pct"),
    )
