"""Folds as SQL table functions: SELECT * FROM strokes(TABLE(bars) PARTITION BY symbol ORDER BY dt)."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..operators import base_chain, series


@udtf(returnType="direction string, start_index int, end_index int, start_value double, end_value double, start_dt string, end_dt string")
class Strokes:
    """Columns high and low, and dt for the times; rows must come ordered by dt."""

    def __init__(self):
        self.dt, self.high, self.low = [], [], []

    def eval(self, row: Row):
        self.dt.append(str(row["dt"]))
        self.high.append(row["high"])
        self.low.append(row["low"])

    def terminate(self):
        merged = base_chain.merge_contained(self.high, self.low)
        chain = base_chain.pivot_chain(merged, base_chain.fractal_points(merged))
        bars = series.Bars(self.dt, [], self.high, self.low, [], [])
        for u in series.stroke_units(bars, merged, chain):
            yield u.direction, u.start_index, u.end_index, u.start, u.end, u.start_dt, u.end_dt


def register(spark: SparkSession) -> None:
    spark.udtf.register("strokes", Strokes)
