"""Sinks: records as Parquet or JSON lines, and one JSON text per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """keys and `json`: every other column of the row as one object, nulls left out."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("json"))


def write_records(df: DataFrame, path: str, fmt: str = "parquet", by: tuple[str, ...] = ("freq", "symbol"), mode: str = "error") -> None:
    """Files laid out so that later reads of one period or symbol are pruned; a partition's rows come from one task."""
    by = tuple(c for c in by if c in df.columns)
    (df.repartition(*by) if by else df).write.mode(mode).partitionBy(*by).format(fmt).save(path)
