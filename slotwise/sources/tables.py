"""Readers and writers: warehouse tables, gzip CSV, allocation files, result tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from slotwise.config import ZoneGroup
from slotwise.sources.datetimes import vote, with_times
from slotwise.sources.staging import staging_path
from slotwise.sources.versions import VersionedTable

# RFC 4180 quoting and microsecond timestamps, for reading and writing alike.
CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
}

# The schema of a result table.
RESULT_SCHEMA = T.StructType([
    T.StructField("sim_run_id", T.StringType()),
    T.StructField("zone_group", T.StringType()),
    T.StructField("sb_window_size", T.LongType()),
    T.StructField("num_variants", T.LongType()),
    T.StructField("exp_length", T.LongType()),
    T.StructField("kpi", T.StringType()),
    T.StructField("anova_pval", T.DoubleType()),
    T.StructField("anova_sig", T.StringType()),
    T.StructField("kpi_type", T.StringType()),
])


def zone_group_table(spark: SparkSession, groups: Sequence[ZoneGroup]) -> DataFrame:
    """The configured zone groups, one row per group with its zones as an array."""
    return spark.createDataFrame(pa.table({
        "entity_id": [g.entity_id for g in groups],
        "asa_id": pa.array([g.asa_id for g in groups], pa.int64()),
        "zone_names": [list(g.zone_names) for g in groups],
        "zone_group_identifier": [g.zone_group_identifier for g in groups],
    }))


def read_csv_gzip(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None
) -> DataFrame:
    """Gzip CSV with header. A gzip file is read by one task, so the rows are spread after the read.

    `partitions` fixes into how many; without it Spark deals them out by size.

    Without a schema, numbers are inferred and text columns become timestamps where every value parses.
    """
    reader = spark.read.options(header=True, **CSV_OPTIONS)
    if schema is not None:
        df = reader.schema(schema).csv(path)
    else:
        df = infer_datetime_columns(reader.option("inferSchema", True).option("preferDate", False).csv(path))
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def infer_datetime_columns(df: DataFrame) -> DataFrame:
    """Turn a text column into timestamps if it has values and all of them parse; else leave it as it is.

    ISO text first; what is not goes through the vote over other formats, in a second pass over these columns.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df

    def parsed(name: str) -> Column:
        return F.expr(f"try_cast(`{name}` AS TIMESTAMP_NTZ)")

    # One pass over the text columns; a single row comes back.
    seen = df.agg(*[
        F.struct(F.count(F.col(f"`{name}`")), F.count(parsed(name))).alias(str(i))
        for i, name in enumerate(texts)
    ]).first()
    plain = [name for i, name in enumerate(texts) if seen[i][0] > 0 and seen[i][0] == seen[i][1]]
    others = vote(df, [name for i, name in enumerate(texts) if name not in plain and seen[i][0] > 0])
    return with_times(df.withColumns({name: parsed(name) for name in plain}), others)


def read_allocation(spark: SparkSession, path: str) -> DataFrame:
    """An allocation made elsewhere: CSV with header OrderID, Variant, SlotID and the slot of the day."""
    return (
        spark.read.options(header=True, **CSV_OPTIONS)
        .schema("OrderID string, Variant bigint, SlotID string, SlotOfDay bigint")
        .csv(path)
    )


def write_allocation(allocated: DataFrame, path: str) -> None:
    allocated.select(
        F.col("platform_order_code").alias("OrderID"),
        F.col("variant").alias("Variant"),
        F.col("time_zone_unit_id").alias("SlotID"),
        F.col("slot_of_day").alias("SlotOfDay"),
    ).write.mode("overwrite").options(header=True, **CSV_OPTIONS).csv(path)


def write_allocation_input(frame: DataFrame, path: str) -> None:
    """Headerless CSV of order code, zone and ISO time, sorted by time across its files."""
    frame.write.mode("overwrite").options(header=False, **CSV_OPTIONS).csv(path)


def allocation_input_order(spark: SparkSession, path: str) -> DataFrame:
    """One row about a written allocation input: orders, first and last time, and how many lines are earlier than the
    line before them, in their file or at the end of the file before it.

    Each part of a file is checked on its own; only one row per part goes through one task.
    """
    lines = spark.read.options(header=False, **CSV_OPTIONS).schema("code string, zone_id bigint, at string").csv(path).select(
        "at", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    in_part = Window.partitionBy("file", "block").orderBy("line")
    parts = lines.withColumn("before", F.lag("at").over(in_part)).groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("orders"), F.min_by("at", "line").alias("first"), F.max_by("at", "line").alias("last"),
        F.count_if(F.col("at") < F.col("before")).alias("unsorted"))
    over_parts = Window.partitionBy(F.lit(1)).orderBy("file", "block")
    return parts.withColumn("late", (F.col("first") < F.lag("last").over(over_parts)).cast("long")).agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"), F.min("first").alias("first_time"), F.max("last").alias("last_time"),
        (F.coalesce(F.sum("unsorted"), F.lit(0)) + F.coalesce(F.sum("late"), F.lit(0))).alias("out_of_order"))


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """CREATE OR REPLACE TABLE name AS df; `path` keeps the files outside the staging folder.

    The name is a view on the current version of a VersionedTable, so it moves in one step: readers meet the old rows or the
    new ones, never none. A failure leaves the table as it was. Earlier versions stay until they are dropped.
    A plain table that has the name is dropped once, when its new rows are written.
    """
    spark = df.sparkSession
    table = VersionedTable(spark, path or staging_path(spark, name))
    version = table.replace(df)
    if spark.catalog.tableExists(f"`{name}`") and spark.catalog.getTable(f"`{name}`").tableType != "VIEW":
        spark.sql(f"DROP TABLE `{name}`")
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS SELECT * FROM parquet.`{table.location(version)}`")
    return spark.table(f"`{name}`")


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """A copy of a table for joins on `keys`: bucketed and sorted by them, one file per bucket.

    Copies with equal numbers of buckets join on these keys, or on them and more conditions, without a shuffle or a
    sort. Rows in which a key is missing match nothing and are left out. Choose the buckets so that one fits a task's memory
    well; a bucket is read by one task.
    """
    spark = df.sparkSession
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    # Dealt out as the buckets are, so that each task writes one file.
    known.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).mode("overwrite").option(
        "path", path or staging_path(spark, name)).saveAsTable(f"`{name}`")
    return spark.table(f"`{name}`")


def conform_results(df: DataFrame) -> DataFrame:
    """The nine result columns in their fixed order and types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields])


def write_results(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace the result table."""
    return replace_table(conform_results(df), name, path)


def write_report_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """A folder of CSV files with header in place of a spreadsheet; `one_file` sends all rows through one task."""
    out = df.repartition(1) if one_file else df
    out.write.mode("overwrite").options(header=True, **CSV_OPTIONS).csv(path)
