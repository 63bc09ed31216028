"""What observations see: versions, late bars, irregular grids, and bars that close or arrive out of order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from structura.operators import structure as st
from structura.sources import bars as src

SCHEMA = "symbol string, freq string, dt timestamp_ntz, open double, high double, low double, close double, volume double, closed_dt timestamp_ntz, available_dt timestamp_ntz"
T = datetime(2024, 1, 1)


def bar(k, price, arrives, symbol="a"):
    return (symbol, "h", T + timedelta(hours=k), price, price + 1, price - 1, price, 1.0, T + timedelta(hours=k + 1), T + timedelta(hours=arrives))


def test_versions_and_late_bars(spark):
    rows = [bar(0, 10.0, 1), bar(1, 11.0, 4), bar(2, 12.0, 3), bar(0, 20.0, 3), bar(0, 30.0, 5), bar(0, 7.0, 2, "b")]
    grid = spark.createDataFrame([("a", "h", T + timedelta(hours=h)) for h in (0, 1, 3, 4, 5, 5, 99)] + [("b", "h", T + timedelta(hours=2)), ("c", "h", T)], "symbol string, freq string, observed timestamp_ntz")
    seen = src.observed_bars(spark.createDataFrame(rows, SCHEMA), grid).orderBy("symbol", "observed", "seq").collect()
    got = {}
    for r in seen:
        got.setdefault((r.symbol, int((r.observed - T).total_seconds() // 3600)), []).append((r.seq, r.dt.hour, r.close))
    whole = [(0, 0, 30.0), (1, 1, 11.0), (2, 2, 12.0)]
    assert got == {("a", 1): [(0, 0, 10.0)], ("a", 3): [(0, 0, 20.0), (1, 2, 12.0)], ("a", 4): [(0, 0, 20.0), (1, 1, 11.0), (2, 2, 12.0)], ("a", 5): whole, ("a", 99): whole, ("b", 2): [(0, 0, 7.0)]}


@pytest.mark.parametrize("column, value", [("available_dt", T), ("available_dt", None), ("closed_dt", T - timedelta(hours=1)), ("closed_dt", T + timedelta(days=1))])
def test_a_bar_out_of_order_is_named(spark, column, value):
    bars = spark.createDataFrame([bar(0, 10.0, 1), bar(1, 11.0, 2)], SCHEMA)
    broken = bars.withColumn(column, F.when(F.hour("dt") == 1, F.lit(value).cast("timestamp_ntz")).otherwise(F.col(column)))
    with pytest.raises(Exception, match="a bar must close and arrive in this order: a h 2024-01-01 01:00:00"):
        src.arrival_checked(broken).collect()
    assert src.arrival_checked(bars).count() == 2


def test_an_observation_is_the_entry_on_what_had_arrived(spark):
    bars = src.with_arrival(src.event_bars(spark, "/root/testdata/sf0.001"), "1 hour", late=F.col("seq") % 7 == 2)
    times = [r[0] for r in bars.where("symbol = 'click' and seq in (60, 200)").select("available_dt").collect()]
    grid = bars.select("symbol", "freq").distinct().crossJoin(spark.createDataFrame([(t,) for t in times], "observed timestamp_ntz"))
    got = st.analyze_available(bars, grid, records={"stroke", "stroke_center"})
    for t in times:
        cut = src.numbered(src.available_bars(bars, str(t)).drop("seq"))
        want = st.structure(cut, records={"stroke", "stroke_center"})
        mine = got.where(F.col("observed") == F.lit(t)).drop("observed").select(want.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect()))
