"""Registered queries over whole tables, against their SQL, or against the operators' own grid."""

import duckdb
import pytest
from structura import oracles, registry
from structura.operators import structure as st
from structura.sources import bars as src

from .test_registry import TABLES, canonical

SMALL = "/root/testdata/sf0.001"


def against(spark, name, sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    df = registry.QUERIES[name](spark, sf)
    assert want[0] and canonical(df.collect(), df.columns) == want


def test_every_fractal_has_a_range_state(spark):
    against(spark, "fractal_ranges", oracles.FRACTAL_RANGES, SMALL)


def test_every_stroke_is_an_anchor(spark):
    against(spark, "second_points", oracles.SECOND_POINTS, SMALL)


def test_center_health_sees_all_earlier_centers(spark, monkeypatch):
    rows = [("a", "1 hour", 0, 1.0, 2.0), *[("a", "1 hour", i, 10.0 * i, 10.0 * i + 1) for i in range(1, 12)], ("a", "1 hour", 12, 1.5, 1.7)]
    monkeypatch.setattr(registry, "centers_of", lambda spark, sf_dir: spark.createDataFrame(rows, "symbol string, freq string, idx int, zd double, zg double"))
    got = {r.idx: r.health for r in registry.center_health(spark, SMALL).collect()}
    assert got == {0: None, **dict.fromkeys(range(1, 12), "extreme"), 12: "dangerous"}


@pytest.mark.parametrize("name", ["replay_ledger", "replay_arrivals"])
def test_replay_observes_every_step(spark, name):
    if name == "replay_ledger":
        whole = st.replay_ledger(src.event_bars(spark, SMALL), step=1)
    else:
        four = src.event_bars(spark, SMALL, "4 hours")
        whole = st.replay_arrivals(src.with_arrival(four, "4 hours", late=four.seq % 10 == 3), step=1)
    got = registry.QUERIES[name](spark, SMALL)
    assert canonical(got.collect(), got.columns) == canonical(whole.collect(), whole.columns)


def test_named_records_are_those_of_the_whole_fold(spark):
    bars = src.event_bars(spark, SMALL)
    whole = st.structure(bars).cache()
    for names in ({"merged"}, {"stroke"}, {"segment_center", "point"}, {"level_unit", "same_level"}):
        got = st.structure(bars, records=names)
        assert canonical(got.collect(), got.columns) == canonical(whole.where(whole.record.isin(names)).collect(), whole.columns)
    with pytest.raises(ValueError, match="unknown"):
        st.structure(bars, records={"strokes"})
