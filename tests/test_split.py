"""A series cut into runs gives the rows of the series in one piece."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from structura.operators import split
from structura.operators import structure as st
from structura.registry import STROKE
from structura.sources import bars as src

SCHEMA = "symbol string, freq string, seq int, dt timestamp_ntz, open double, high double, low double, close double, volume double"
MERGED = ("idx", "low", "high", "start_index", "end_index", "start_dt", "end_dt", "start_value", "end_value", "n")


def walk(symbol, n, seed, step=3):
    rng, price, out = random.Random(seed), 100, []
    for i in range(n):
        a, b = price, price + rng.randint(-step, step)
        out.append((symbol, "f", i, datetime(2024, 1, 1) + timedelta(minutes=i), float(a), float(max(a, b) + rng.randint(0, 2)), float(min(a, b) - rng.randint(0, 2)), float(b), 1.0))
        price = b
    return out


def agree(bars, **cut):
    merged, strokes = split.base_chain_of(bars, **cut)
    whole = st.structure(bars, records={"merged", "stroke"})
    for found, record, columns in ((merged, "merged", MERGED), (strokes, "stroke", STROKE)):
        got = sorted(map(tuple, found.select("symbol", *columns).collect()))
        assert got == sorted(map(tuple, st.project(whole, record, *columns).select("symbol", *columns).collect()))
    return strokes


@pytest.mark.parametrize("run, overlap", [(40, 8), (64, 64), (10_000, 16)])
def test_random_walks(spark, run, overlap):
    rows = walk("a", 1000, 1) + walk("b", 333, 2, step=1) + walk("c", 41, 3) + walk("d", 2, 4)
    assert agree(spark.createDataFrame(rows, SCHEMA), run=run, overlap=overlap).count() > 5


def test_runs_that_never_agree_are_folded_longer(spark):
    """A first bar that holds all others: no run finds the state of the fold in one piece."""
    rows = walk("a", 300, 5, step=1)
    rows[0] = (*rows[0][:4], 100.0, 1000.0, -1000.0, 100.0, 1.0)
    rising = [("r", "f", i, datetime(2024, 1, 1) + timedelta(minutes=i), float(i), i + 1.0, i - 1.0, i + 0.5, 1.0) for i in range(200)]
    agree(spark.createDataFrame(rows + rising, SCHEMA), run=16, overlap=4)


def test_no_bars(spark):
    merged, strokes = split.base_chain_of(spark.createDataFrame([], SCHEMA))
    assert merged.count() == strokes.count() == 0


def test_one_series_runs_in_many_tasks(spark, monkeypatch):
    bars = src.order_bars(spark, "/root/testdata/sf0.01")
    n, tries, fold = bars.count(), [], split._folded

    def folded(*given):
        out = fold(*given)
        tries.append(out.select("run", F.spark_partition_id().alias("p")).distinct().agg(F.countDistinct("run"), F.countDistinct("p")).first())
        return out

    monkeypatch.setattr(split, "_folded", folded)
    agree(bars, run=n // 12, overlap=64)
    assert len(tries) == 1 and tries[0][0] == 12 and tries[0][1] >= 4


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_no_task_meets_a_whole_series(spark, monkeypatch, broadcast):
    """The bars of a series must not be dealt by its key: the plan has no join and no exchange by the keys alone but for rows a run."""
    plans, fold = [], split._folded
    monkeypatch.setattr(split, "_folded", lambda *given: plans.append(fold(*given)) or plans[-1])
    monkeypatch.setattr(split, "BARS_A_TASK", 100)
    rows = walk("a", 1000, 1) + walk("b", 333, 2, step=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        agree(spark.createDataFrame(rows, SCHEMA), run=64, overlap=32)
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join \[([^\]]*)\]", plan)
    assert joins and all(re.sub(r"#\d+L?", "", j) == "symbol, freq, block" for j in joins)
    assert plans[0].rdd.getNumPartitions() == 14


def test_lines_are_dealt_to_more_tasks_as_they_grow(spark):
    few, many = (src.order_bars(spark, "/root/testdata/sf0.001", lines_per_task=n) for n in (1 << 20, 100))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert re.search(r"hashpartitioning\(bucket#\d+L?, (?:5|6)\d\), REPARTITION_BY_NUM", many._jdf.queryExecution().executedPlan().toString())


def test_runs_agree_soon(spark, monkeypatch):
    tries, fold = [], split._folded
    monkeypatch.setattr(split, "_folded", lambda *given: tries.append(given[1:3]) or fold(*given))
    agree(spark.createDataFrame(walk("a", 3000, 1) + walk("b", 2000, 2), SCHEMA), run=300, overlap=150)
    assert tries == [(300, 150)]
