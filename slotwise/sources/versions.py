"""Tables that are replaced in one step: version folders and a log that names the current one.

A version is written whole into a folder of its own. It becomes the current one when one line is added to
the log, a file that Spark's committer moves into place in one step; a catalog name is moved to it by a view, replaced in one
step too. Readers keep the folder that they were given, so a replacement never changes or breaks a running query;
a writer that fails has added no line, and its folder is removed. Older versions stay until they are dropped.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version string, committed_ns bigint"


def remove_folder(spark: SparkSession, path: str) -> bool:
    """Remove a folder in whatever store Spark reaches it; whether there was one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


class VersionedTable:
    """A table below `path`, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, version: str) -> str:
        return f"{self.path}/version={version}"

    def versions(self) -> list[str]:
        """Committed versions that have not been dropped, the current one last. One short line each."""
        if not folder_exists(self.spark, f"{self.path}/log"):
            return []
        lines = self.spark.read.schema(_LOG).json(f"{self.path}/log").groupBy("version").agg(
            F.max("committed_ns").alias("committed_ns"), F.min("committed_ns").alias("first_ns"))
        # A line at time 0 says that a version was dropped.
        return [r.version for r in lines.where("first_ns > 0").orderBy("committed_ns", "version").collect()]

    def _add_line(self, version: str, committed_ns: int) -> None:
        line = self.spark.createDataFrame([(version, committed_ns)], _LOG)
        line.coalesce(1).write.mode("append").json(f"{self.path}/log")

    def write(self, df: DataFrame) -> str:
        """Write a version without making it the current one; nothing is left of a failed attempt."""
        version = uuid.uuid4().hex
        try:
            df.write.parquet(self._folder(version))
        except BaseException:
            remove_folder(self.spark, self._folder(version))
            raise
        return version

    def commit(self, version: str) -> None:
        """Make a written version the current one: the one step that readers see. Of two writers the later one wins."""
        self._add_line(version, time.time_ns())

    def replace(self, df: DataFrame) -> str:
        """Replace all rows and the schema; the new version's name. `df` may read the table itself."""
        version = self.write(df)
        self.commit(version)
        return version

    def location(self, version: str | None = None) -> str:
        """Folder of a version, without one of the current version."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no such version below {self.path}")
        return self._folder(version or known[-1])

    def read(self, version: str | None = None) -> DataFrame:
        """The current or a named version; the frame stays with it whatever is written later."""
        return self.spark.read.parquet(self.location(version))

    def drop_old(self, keep: int = 1) -> int:
        """Drop all but the last `keep` versions; their number. Queries that still read them fail."""
        if keep < 1:
            raise ValueError("the current version cannot be dropped")
        old = self.versions()[:-keep]
        for version in old:
            self._add_line(version, 0)
            remove_folder(self.spark, self._folder(version))
        return len(old)
