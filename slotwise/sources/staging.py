"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from slotwise.sources.versions import remove_folder

# Folders of the open scopes, the innermost last.
_SCOPES: list[list[str]] = []


def staging_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which every executor must reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, label: str) -> str:
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """What is staged inside goes at the end: write or collect the results before. Scopes may be nested."""
    own: list[str] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for path in own:
            remove_folder(spark, path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame as Parquet and read it back.

    This cuts the lineage, survives the loss of executors, and gives later steps exact
    sizes, from which Spark picks its join strategies.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
