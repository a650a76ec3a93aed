"""Parquet tables: scans that Catalyst pushes filters and columns into, and layouts that serve later scans and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a lazy scan. Its schema is read from a footer once per application and path."""
    path = f"{sf_dir}/{name}.parquet"
    key = spark.sparkContext.applicationId, path
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def write_sorted(data: DataFrame, path: str, keys: Sequence[str], mode: str = "error") -> None:
    """Range-partitioned and sorted by the keys, so that row-group statistics serve point and range lookups."""
    data.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)


def write_bucketed(data: DataFrame, name: str, keys: Sequence[str], buckets: int, mode: str = "error") -> None:
    """A managed table bucketed by its join keys: joins of tables bucketed alike need no shuffle."""
    data.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
