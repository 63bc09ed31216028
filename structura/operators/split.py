"""The base chain of long series, cut into runs that fold apart and are stitched where they agree.

What merging and strokes do next depends on little: the last three merged bars, the last pivot and the bars between.
So each run of `run` bars is folded from its own first bar as if nothing came before, and on into the first `overlap` bars of the
next run. At a bar where both folds of a boundary have the same state, they agree for good: that is the boundary's
synchronisation point, and what the later run says counts from there on. Since a run is right after its own
synchronisation point, which lies before the next boundary, comparing neighbours suffices, and all runs fold at once.
Positions become global by running sums over runs, one row a run. A boundary without agreement makes all be
tried again with longer overlaps and runs, at last with one run, so the rows are always those of the fold in one piece.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS
from ..sources.scratch import written
from . import base_chain, series

_FIELDS = {
    "record": pa.string(), "pos": pa.int64(), "chain": pa.int64(), "seq": pa.int64(), "state": pa.string(), "kind": pa.string(), "first": pa.int64(), "last": pa.int64(),
    "low": pa.float64(), "high": pa.float64(), "start_dt": pa.timestamp("us"), "end_dt": pa.timestamp("us"), "start_value": pa.float64(), "end_value": pa.float64(),
}
#: More bars are dealt to more tasks than the session asks for.
BARS_A_TASK = 1 << 19
_TYPES = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double", pa.timestamp("us"): "timestamp_ntz"}


class Walk:
    """Merged bars and pivots of bars given one by one."""

    def __init__(self, min_gap: int):
        self.merged: list[base_chain.MergedBar] = []
        self.chain: list[tuple[str, int]] = []
        self.min_gap = min_gap

    def push(self, i: int, high: float, low: float) -> None:
        before = len(self.merged)
        base_chain.merge_next(self.merged, i, high, low)
        if len(self.merged) > before:
            # the bar before the new one is final, so the fractal that it closes is
            self._judge(len(self.merged) - 3)

    def end(self) -> None:
        self._judge(len(self.merged) - 2)

    def _judge(self, k: int) -> None:
        if k >= 1 and (kind := base_chain.fractal_at(self.merged, k)):
            base_chain.pivot_next(self.chain, self.merged, kind, k, self.min_gap)

    def state(self) -> str | None:
        """All that later bars can depend on."""
        if len(self.merged) < 3 or not self.chain:
            return None
        kind, k = self.chain[-1]
        tips = [(m.first, m.high, m.low) for m in self.merged[-3:]]
        p = self.merged[k]
        return repr((tips, kind, p.first, p.last, p.high, p.low, len(self.merged) - k))


def _fold(run: int, overlap: int, min_gap: int):
    def fold(key, table):
        table = table.sort_by("seq")
        seq, dt, open_, high, low, close = (table.column(c).to_pylist() for c in ("seq", "dt", "open", "high", "low", "close"))
        number, last = key[-1].as_py(), table.column("is_last")[0].as_py()
        walk, rows = Walk(min_gap), {n: [] for n in _FIELDS}

        def row(**values) -> None:
            for n, column in rows.items():
                column.append(values.get(n))

        head, tail = (number * run + overlap if number else 0), (number + 1) * run
        base = seq[0]
        for i, s in enumerate(seq):
            walk.push(s, high[i], low[i])
            for name, wanted in (("head", s < head), ("tail", s >= tail and not last)):
                if wanted and (state := walk.state()):
                    row(record=name, pos=len(walk.merged) - 1, chain=len(walk.chain) - 1, seq=s, state=state)
        if last:
            walk.end()
        for k, m in enumerate(walk.merged):
            row(record="merged", pos=k, first=m.first, last=m.last, low=m.low, high=m.high, start_dt=dt[m.first - base], end_dt=dt[m.last - base], start_value=open_[m.first - base], end_value=close[m.last - base])
        for k, (kind, at) in enumerate(walk.chain):
            m = walk.merged[at]
            row(record="pivot", pos=at, chain=k, kind=kind, end_dt=dt[m.last - base], end_value=m.high if kind == base_chain.TOP else m.low)
        row(record="run", pos=len(walk.merged), chain=len(walk.chain))
        keys = [pa.array([k.as_py()] * len(rows["pos"]), pa.string()) for k in key[:-1]] + [pa.array([number] * len(rows["pos"]), pa.int64())]
        return pa.Table.from_arrays(keys + [pa.array(v, _FIELDS[n]) for n, v in rows.items()], names=[*KEYS, "run", *_FIELDS])

    return fold


def _folded(bars: DataFrame, run: int, overlap: int, min_gap: int, parts: int) -> DataFrame:
    """Every run's own view. Each run has at least `run` bars; the last one takes the rest."""
    bars = bars.select(*KEYS, F.col("seq").cast("long"), "dt", "open", "high", "low", "close").withColumn("block", F.expr(f"seq div {run}"))
    # a row a block, not a series: a series' bars must not meet in the task of its key
    blocks = bars.groupBy(*KEYS, "block").agg(F.max("seq").alias("stop"))
    runs = blocks.select(*KEYS, "block", F.greatest(F.lit(1), F.expr(f"(max(stop) over (partition by {', '.join(KEYS)}) + 1) div {run}")).alias("runs"))
    own = F.least(F.col("block"), F.col("runs") - 1)
    both = F.when((own > 0) & (F.col("seq") < own * run + overlap), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = bars.join(runs, [*KEYS, "block"])
    dealt = dealt.withColumn("run", F.explode(both)).withColumn("is_last", F.col("run") == F.col("runs") - 1).drop("runs", "block")
    schema = ", ".join([*(f"{k} string" for k in KEYS), "run long", *(f"`{n}` {_TYPES[t]}" for n, t in _FIELDS.items())])
    # a fold is slow for its bytes: a fixed number of partitions is not merged for being small
    dealt = dealt.repartition(parts, *KEYS, "run")
    return dealt.groupBy(*KEYS, "run").applyInArrow(_fold(run, overlap, min_gap), schema)


def base_chain_of(bars: DataFrame, run: int = 8192, overlap: int = 512, min_gap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(merged bars, strokes) of the five-bar standard, the rows that `structure` gives, with a series spread over tasks."""
    if not 0 < overlap <= run:
        raise ValueError("an overlap holds at least one bar and at most a run")
    gap = series.min_gap_of("81", min_gap)
    bars = written(bars.select(*KEYS, "seq", "dt", "open", "high", "low", "close"), "bars")
    longest, n = bars.agg(F.max("seq"), F.count("*")).first()
    parts = max(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BARS_A_TASK))
    while True:
        folded = written(_folded(bars, run, overlap, gap, parts), "runs")
        sizes = folded.where("record = 'run'").select(*KEYS, "run", F.col("pos").alias("all_bars"), F.col("chain").alias("all_pivots"))
        of = lambda record, at: folded.where(F.col("record") == record).select(*KEYS, at.alias("run"), "seq", "state", F.struct("pos", "chain").alias(record))  # noqa: E731, B023
        met = of("head", F.col("run")).join(of("tail", F.col("run") + 1), [*KEYS, "run", "seq", "state"])
        sync = met.groupBy(*KEYS, "run").agg(F.min_by("head", "seq").alias("head"), F.min_by("tail", "seq").alias("tail"))
        open_ = sizes.where("run > 0").join(sync, [*KEYS, "run"], "left_anti")
        if longest is None or run > longest or open_.isEmpty():
            break
        run, overlap = run * 4, overlap * 4

    after = sync.select(*KEYS, (F.col("run") - 1).alias("run"), F.col("tail").alias("stop"))
    bounds = sizes.join(sync.select(*KEYS, "run", F.col("head").alias("start")), [*KEYS, "run"], "left").join(after, [*KEYS, "run"], "left")
    bounds = bounds.select(
        *KEYS, "run", *(F.coalesce(f"start.{c}", F.lit(0)).alias(f"start_{c}") for c in ("pos", "chain")),
        F.coalesce("stop.pos", "all_bars").alias("stop_pos"), F.coalesce("stop.chain", "all_pivots").alias("stop_chain"),
    )
    earlier = Window.partitionBy(*KEYS).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    # what a run's own positions are off by
    for c in ("pos", "chain"):
        bounds = bounds.withColumn(f"shift_{c}", F.coalesce(F.sum(F.col(f"stop_{c}") - F.col(f"start_{c}")).over(earlier), F.lit(0)) - F.col(f"start_{c}"))

    inside = lambda c: (F.col(c) >= F.col(f"start_{c}")) & (F.col(c) < F.col(f"stop_{c}"))
    merged = folded.where("record = 'merged'").join(bounds, [*KEYS, "run"]).where(inside("pos")).select(
        *KEYS, (F.col("pos") + F.col("shift_pos")).cast("int").alias("idx"), "low", "high", F.col("first").cast("int").alias("start_index"), F.col("last").cast("int").alias("end_index"),
        "start_dt", "end_dt", "start_value", "end_value", (F.col("last") - F.col("first") + 1).cast("int").alias("n"),
    )
    pivots = folded.where("record = 'pivot'").join(bounds, [*KEYS, "run"]).where(inside("chain")).select(
        *KEYS, "run", (F.col("chain") + F.col("shift_chain")).cast("int").alias("idx"), "kind", (F.col("pos") + F.col("shift_pos")).cast("int").alias("at"), F.col("end_dt").alias("dt"), F.col("end_value").alias("value")
    )
    return merged, _strokes(pivots)


def _strokes(pivots: DataFrame) -> DataFrame:
    """From each pivot to the next: inside a run by its order, from a run's last to the next run's first."""
    point = F.struct("kind", "at", "dt", "value")
    in_run = Window.partitionBy(*KEYS, "run").orderBy("idx")
    firsts = pivots.groupBy(*KEYS, "run").agg(F.min_by(point, "idx").alias("point"))
    firsts = firsts.select(*KEYS, "run", F.lead("point").over(Window.partitionBy(*KEYS).orderBy("run")).alias("next_first"))
    both = pivots.withColumn("next", F.lead(point).over(in_run)).join(firsts, [*KEYS, "run"]).withColumn("next", F.coalesce("next", "next_first")).where(F.col("next").isNotNull())
    up: Column = F.col("next.kind") == base_chain.TOP
    return both.select(
        *KEYS, "idx", F.when(up, base_chain.UP).otherwise(base_chain.DOWN).alias("direction"), F.col("at").alias("start_index"), F.col("next.at").alias("end_index"),
        F.col("value").alias("start_value"), F.col("next.value").alias("end_value"), F.least("value", "next.value").alias("low"), F.greatest("value", "next.value").alias("high"),
        F.col("dt").alias("start_dt"), F.col("next.dt").alias("end_dt"),
    )
