"""Streaming: bars from ticks with a watermark, and structure that follows each series as bars arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import series
from ..schema import KEYS

LEDGER_SCHEMA = "symbol string, freq string, kind string, field string, identity string, first_seen timestamp, observed timestamp, before string, after string"
#: State of one series: its bars so far (as parallel arrays) and the records last published.
STATE_SCHEMA = (
    "dt array<timestamp>, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>, "
    "fields array<string>, identities array<string>, texts array<string>, first_seen array<timestamp>"
)


def read_ticks(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def bars_from_stream(ticks: DataFrame, period: str, lateness: str = "1 hour") -> DataFrame:
    """ticks (symbol, ts timestamp, order_id, price): finished bars, each once, when the watermark passes its period."""
    w = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", period).alias("w"))
    out = w.agg(F.min_by("price", "order_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order_id").alias("close"), F.count("*").cast("double").alias("volume"))
    return out.select("symbol", F.lit(period).alias("freq"), F.col("w.start").alias("dt"), "open", "high", "low", "close", "volume")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = ["dt", "open", "high", "low", "close", "volume"]
    held = [list(x) if x is not None else [] for x in state.get] if state.exists else [[] for _ in range(10)]
    last = {(f, i): (t, s) for f, i, t, s in zip(*held[6:])}
    fresh = pd.concat(list(batches)).sort_values("dt")
    rows = []
    for r in fresh.itertuples(index=False):
        if held[0] and r.dt <= held[0][-1]:
            raise ValueError(f"bar {r.dt} of {key} arrived after a later one")
        for x, n in zip(held, names):
            x.append(getattr(r, n))
        bars = series.Bars(*held[:6])
        now = series.records(bars, series.read_structure(bars))
        for k, text in now.items():
            seen = last.get(k)
            if seen is None or seen[0] is None:
                first = r.dt if seen is None else seen[1]
                rows.append((*key, "appeared", *k, first, r.dt, None, text))
                last[k] = (text, first)
            elif seen[0] != text:
                rows.append((*key, "revised", *k, seen[1], r.dt, seen[0], text))
                last[k] = (text, seen[1])
        for k, (text, first) in list(last.items()):
            if text is not None and k not in now:
                rows.append((*key, "withdrawn", *k, first, r.dt, text, None))
                last[k] = (None, first)  # remembered: a record that comes back keeps when it was first seen
    fields, identities = zip(*last) if last else ((), ())
    state.update((*held[:6], list(fields), list(identities), [t for t, _ in last.values()], [s for _, s in last.values()]))
    yield pd.DataFrame(rows, columns=["symbol", "freq", "kind", "field", "identity", "first_seen", "observed", "before", "after"])


def follow(bars: DataFrame) -> DataFrame:
    """bars (symbol, freq, dt timestamp, ...): the ledger of fractals, strokes and points, as in the batch replay."""
    return bars.groupBy(*KEYS).applyInPandasWithState(_update, LEDGER_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)
