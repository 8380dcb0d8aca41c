"""A study that grows by the day: facts are kept per day and merged, so a new day reads that day's orders only.

Granule facts are exact sums and order masks are bits, so days put together give the very numbers of one pass
over all orders. A day's folders replace those of an earlier try.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.config import StudyGrid, ZoneGroup
from slotwise.operators.slots import granule_facts, mask_counts, merge_masks, order_masks, window_families
from slotwise.operators.zones import group_starts, prepare_orders, tag_zone_groups
from slotwise.plans.study import results_of_facts
from slotwise.sources.staging import stage, staging_path


def stage_by_day(orders: DataFrame, label: str) -> DataFrame:
    """Orders in a folder per day, as a warehouse keeps them, so that a day's filter reads that day's folder."""
    path = staging_path(orders.sparkSession, label)
    orders.write.partitionBy("day_num").parquet(path)
    return orders.sparkSession.read.parquet(path).withColumn("day_num", F.col("day_num").cast("bigint"))


class DailyStudy:
    """Facts below `path`, partitioned by the experiment's day."""

    def __init__(self, spark: SparkSession, path: str, groups: Sequence[ZoneGroup], grid: StudyGrid):
        self.spark, self.path, self.groups, self.grid = spark, path.rstrip("/"), groups, grid

    def begin(self, orders: DataFrame) -> None:
        """Fix the groups' starts by orders that hold each group's first one, say the first days'."""
        group_starts(tag_zone_groups(orders, self.groups)).write.mode("overwrite").parquet(f"{self.path}/starts")

    def prepared(self, orders: DataFrame, days: Sequence[int]) -> DataFrame:
        """The orders of these days with their group's start; the days are a filter that reaches the scan."""
        starts = self.spark.read.parquet(f"{self.path}/starts")
        return prepare_orders(orders.where(F.col("day_num").isin(*days)), self.groups, starts)

    def _write(self, df: DataFrame, name: str) -> None:
        # Only the folders of the days at hand are replaced.
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day_num").parquet(f"{self.path}/{name}")

    def add_days(self, orders: DataFrame, days: Sequence[int]) -> None:
        """Store the facts of some days, one by one, in place of what was stored for them.

        Days beyond the longest experiment count for nothing.
        """
        for day in days:
            self.add_range(orders, [day])

    def add_range(self, orders: DataFrame, days: Sequence[int]) -> None:
        """As add_days, all days in one pass."""
        rows = self.prepared(orders, days)
        for i, windows in enumerate(window_families(self.grid)):
            self._write(order_masks(rows, self.grid, windows, by=["day_num"]), f"masks-{i}")
        self._write(granule_facts(rows, self.grid, by=["day_num"]), "facts")

    def days(self) -> list[int]:
        """Days with facts."""
        return sorted(r[0] for r in self.spark.read.parquet(f"{self.path}/facts").select("day_num").distinct().collect())

    def facts(self, through: int | None = None) -> DataFrame:
        """Granule facts, of the days up to `through`; a granule may have rows of two days, which add up."""
        rows = self.spark.read.parquet(f"{self.path}/facts")
        return (rows if through is None else rows.where(F.col("day_num") <= through)).drop("day_num")

    def order_counts(self, through: int | None = None) -> DataFrame:
        """Distinct orders per slot: a code that comes on several days counts once."""
        counts = []
        for i, windows in enumerate(window_families(self.grid)):
            rows = self.spark.read.parquet(f"{self.path}/masks-{i}")
            rows = (rows if through is None else rows.where(F.col("day_num") <= through)).drop("day_num")
            counts.append(mask_counts(merge_masks(rows), self.grid, windows))
        return reduce(DataFrame.unionByName, counts)

    def results(self, through: int | None = None) -> DataFrame:
        """The study's p-values so far."""
        return results_of_facts(self.facts(through), stage(self.order_counts(through), "slot-orders"), self.grid)
