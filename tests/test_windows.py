"""Literal cases for the native operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from structura.functions import classifiers as cl
from structura.operators import confirmed as cf
from structura.operators import windows as wn
from structura.operators.ma_candidates import Reader, Rows, Settings
from structura.sources import bars as src

T0 = datetime(2024, 1, 1)


def bars(spark, ranges, close=None, symbol="x"):
    rows = [(symbol, "day", i, T0 + timedelta(days=i), (l + h) / 2, float(h), float(l), float(close[i]) if close else (l + h) / 2, 1.0) for i, (l, h) in enumerate(ranges)]  # noqa: E741
    return spark.createDataFrame(rows, "symbol string, freq string, seq int, dt timestamp_ntz, open double, high double, low double, close double, volume double")


def closes(spark, values, symbol="x"):
    return bars(spark, [((v or 1) - 0.5, (v or 1) + 0.5) for v in values], values, symbol) if None not in values else None


def lines(spark, diffs):
    rows = [("x", "day", i, None if d is None else 10.0 + d, 10.0) for i, d in enumerate(diffs)]
    return spark.createDataFrame(rows, "symbol string, freq string, seq int, short double, long double")


def test_exact_means(spark):
    d = closes(spark, [1, 2, 3, 4])
    assert [r.m for r in d.select("seq", wn.sma(F.col("close"), 2).alias("m")).orderBy("seq").collect()] == [None, 1.5, 2.5, 3.5]
    d = closes(spark, [0.06, 0.06, 0.06, 0.10, 0.07])
    row = d.select("seq", wn.sma(F.col("close"), 5).alias("m"), wn.above_sma(F.col("close"), 5).alias("a")).orderBy(F.desc("seq")).first()
    assert row.m == 0.07 and row.a is False


def test_gaps_and_what_fills_them(spark):
    got = [(r.direction, r.lower, r.upper, r.index_a) for r in wn.gaps(bars(spark, [(8, 10), (11, 13), (9, 12), (6, 8.5), (7, 9)])).orderBy("index_a").collect()]
    assert got == [("up", 10, 11, 0), ("down", 8.5, 9, 2)]
    cases = [
        ([(8, 10), (12, 13), (10.5, 11), (9, 10.6), (10.8, 13)], 4, None), ([(8, 10), (12, 13), (13.5, 13.8), (9, 9.5), (8.8, 9.4)], None, "strong"),
        ([(8, 10), (12, 15), (13, 14.5), (9, 14), (14, 15.5)], 3, "neutral"), ([(8, 10), (12, 15), (13, 14.5), (12.5, 13.5), (12, 13)], None, "strong"),
        ([(8, 10), (12, 15), (13, 14.5), (9, 14), (12.5, 13.5), (12, 13)], 3, "weak"),
    ]
    for ranges, fill, strength in cases:
        for mirror in (False, True):
            flipped = [(30 - h, 30 - l) if mirror else (l, h) for l, h in ranges]  # noqa: E741
            r = wn.gap_strength(bars(spark, flipped)).where("index_a = 0").first()
            assert r.fill_index == fill and strength in (None, r.strength)


def test_areas_and_weakening(spark):
    got = [(r.sign, r.area, r.closed) for r in wn.ma_areas(lines(spark, [1] * 5 + [-1] * 5 + [1] * 5)).orderBy("start").collect()]
    assert got == [(1, 5, True), (-1, -5, True), (1, 5, False)]
    got = [(r.start, r.end) for r in wn.ma_areas(lines(spark, [1, 1, 1, 1, 0, 1, 1, 1, 1])).orderBy("start").collect()]
    assert got == [(0, 3), (5, 8)]
    assert wn.ma_areas(lines(spark, [None, None, 1])).count() == 0
    assert [r.end for r in wn.ma_areas(lines(spark, [1, 1, None, 1, 1])).collect()] == [1]
    weak = wn.ma_weakening(wn.ma_areas(lines(spark, [1] * 5 + [-1] * 5 + [0.6] * 5 + [-1] * 5)))
    assert [(r.direction, round(r.area_prev, 9), round(r.area_last, 9)) for r in weak.collect()] == [("up", 5, 3)]
    areas = wn.ma_areas(lines(spark, [0.5] * 10 + [-1] * 5 + [0.9] * 3 + [-1] * 5))
    assert wn.ma_weakening(areas).count() == 1 and wn.ma_weakening(areas, use_avg=True).count() == 0


def test_alignment_keeps_its_side_at_zero(spark):
    got = [r.alignment for r in wn.alignment(lines(spark, [None, 0, 1, 0, -1, 0])).orderBy("seq").collect()]
    assert got == [None, None, "up", "up", "down", "down"]


def test_breaks_of_an_average(spark):
    d = lines(spark, [0] * 6).withColumn("close", F.element_at(F.array(*(F.lit(float(x)) for x in (11, 9, 11, 9, 9, 11))), F.col("seq") + 1)).withColumn("short", F.lit(10.0))
    r = wn.ma_break(d, "top").first()
    assert (r.state, r.tested, r.recovered, r.break_index, r.confirm_index, r.streak) == ("effective", True, True, 1, 4, 0)


POWERS = [
    ("weak", [(10, 15, 9, 14), (15.6, 16, 13.8, 15.7), (15, 15.5, 13, 15.1)]), ("strong", [(10, 12, 9, 11), (12, 15, 11, 12), (11, 13, 10, 11)]),
    ("severe", [(10, 12, 9, 11), (12, 15, 11, 13), (10, 13, 8, 9.5)]), ("neutral", [(10, 12, 9, 11), (13.8, 15, 11, 14), (13, 14, 10, 13.6)]),
]


@pytest.mark.parametrize("want, rows", POWERS)
def test_fractal_power(spark, want, rows):
    for kind in ("top", "bottom"):
        side = [(o, h, l, c) if kind == "top" else (30 - o, 30 - l, 30 - h, 30 - c) for o, h, l, c in rows]  # noqa: E741
        b = [{n: F.lit(float(v)) for n, v in zip(("open", "high", "low", "close"), r)} for r in side]
        assert spark.range(1).select(cl.fractal_power(b, F.lit(kind)).alias("p")).first().p == want


def test_oscillation_and_wedges(spark):
    def report(center, ranges):
        u = spark.createDataFrame([("x", "day", i + 1, float(a), float(b)) for i, (a, b) in enumerate(ranges)], "symbol string, freq string, idx int, low double, high double")
        c = spark.createDataFrame([("x", "day", 0, float(center[0]), float(center[1]), 0)], "symbol string, freq string, idx int, zd double, zg double, last int")
        return wn.oscillation(u, c).first()

    r = report((10, 20), [(10, 20), (16, 18), (11, 13)])
    assert (r.z, r.n_above, r.n_below, r.strength, r.status) == (15, 2, 1, "strong", "in_range")
    assert report((10, 20), [(10, 12), (11, 13), (12, 14), (13, 15)]).wedge == "rising_wedge"
    assert report((10, 20), [(14, 16), (11, 13), (10, 12), (11, 13), (12, 14), (13, 15)]).wedge is None


def test_range_states(spark):
    def state(ranges, close):
        b = bars(spark, ranges, close).withColumn("closed_dt", F.col("dt")).withColumn("available_dt", F.expr("dt + interval 1 hour"))
        f = spark.createDataFrame([("x", "day", 1, "bottom", 10.0, 12.0, T0 - timedelta(days=1))], "symbol string, freq string, fractal_id int, kind string, low double, high double, confirmed_dt timestamp_ntz")
        return cf.fractal_range_states(f, b, F.lit("2030-01-01").cast("timestamp_ntz")).first()

    r = state([(12, 14), (12, 15)], [13, 14])
    assert (r.phase, r.streak) == ("completed", 2)
    assert state([(9, 14)], [13]).phase == "failed"
    r = state([(11, 14), (11, 13), (11, 14)], [13, 12, 13])
    assert (r.phase, r.streak, r.recovered) == ("testing", 1, True)


def test_sector_classes(spark):
    a, b = closes(spark, [10.0] * 233 + [12, 9], "a"), closes(spark, [10.0] * 235, "b")
    d = a.union(b).withColumn("sector", F.lit("s"))
    classes = wn.ma_class(d, 233, extra=["sector"])
    assert {r.symbol: r.class_no for r in classes.collect()} == {"a": 9, "b": 1}
    r = wn.sector_strength(classes).first()
    assert (r.mean_class, r.valid, r.total, r.coverage) == (5.0, 2, 2, 1.0)


def test_moving_average_candidates():
    diffs = [-10, -8, 1, -11, -10, 1, -12, -1, 0]
    close = [100.0]
    for d in diffs:  # averages of one and two bars differ by half the step
        close.append(close[-1] + 2 * d)

    def reader(n):
        c = close[:n]
        dt = [T0 + timedelta(days=i) for i in range(n)]
        return Reader(Rows(dt, [x + 0.1 for x in c], [x - 0.1 for x in c], c, [1.0] * n, dt), Settings(1, 2, min_pre_gain=0.0))

    assert [p["kind"] for p in reader(len(close)).points() if p["kind"].startswith("ma_buy1")] == ["ma_buy1_candidate"]
    assert reader(len(close) - 1).state()["status"] == "warning"


def test_bars_are_checked_and_adjusted(spark):
    b = bars(spark, [(8, 10), (9, 11)])
    assert src.validate_bars(b).count() == 2
    with pytest.raises(ValueError, match="bar 1"):
        src.validate_bars(b.withColumn("volume", F.when(F.col("seq") == 1, -1.0).otherwise(1.0)))
    with pytest.raises(ValueError, match="missing"):
        src.adjust(b)
    assert src.normalize_bars(b.withColumn("volume", F.lit(0.0)).withColumn("low", F.col("high"))).count() == 0
    assert src.normalize_bars(b.where("false")).count() == 0
