"""Literal cases, each also mirrored, and prefix stability."""

import random

import pytest
from structura.operators import averages, base_chain, moves
from structura.operators.base_chain import Unit
from structura.operators.segments import segments_of


def zigzag(prices):
    return [Unit("up" if b > a else "down", a, b, i, i + 1, min(a, b), max(a, b), i, i + 1) for i, (a, b) in enumerate(zip(prices, prices[1:]))]


def ranges(pairs, directions=None):
    return [Unit(d, l, h, i, i + 1, l, h, i, i + 1) for i, ((l, h), d) in enumerate(zip(pairs, directions or [None] * len(pairs)))]  # noqa: E741


SEGMENTS = [
    ([1, 6, 3, 12, 5, 9, 2, 10, 6, 8, 4, 9], [(0, 3, 1, True), (3, 6, 1, False)]),
    ([1, 6, 3, 12, 5, 9, 2, 10, 6, 8, 4, 9, 1], [(0, 3, 1, True), (3, 12, 1, False)]),
    ([1, 6, 3, 12, 5, 9, 2, 10, 6, 8, 4, 9, 5, 11, 4, 8, 1], [(0, 3, 1, True), (3, 6, 1, True), (6, 13, 1, True), (13, 16, 1, False)]),
    ([1, 6, 3, 12, 2, 8, 1, 14, 6, 10, 0], [(0, 3, 1, True), (3, 10, 1, False)]),
]


@pytest.mark.parametrize("mirror", [False, True])
@pytest.mark.parametrize("prices, want", SEGMENTS)
def test_segments(prices, want, mirror):
    strokes = zigzag([20 - p if mirror else p for p in prices])
    assert [(s.first, s.last + 1, s.mode, s.evidence is not None) for s in segments_of(strokes)] == want


def test_segment_evidence_and_retroactive_confirmation():
    strokes = zigzag(SEGMENTS[2][0])
    assert [s.evidence + 1 for s in segments_of(strokes)[:3]] == [6, 13, 16]
    prices = [1, 6, 3, 12, 2, 10, 6, 8, 4, 8.5, 6, 14]
    for n in range(3, 11):
        assert all(s.evidence is None for s in segments_of(zigzag(prices)[:n]))
    done = [s for s in segments_of(zigzag(prices)) if s.evidence is not None]
    assert [(s.first, s.last + 1, s.evidence + 1) for s in done] == [(0, 3, 11), (3, 8, 11)]


def test_segment_of_the_second_kind():
    (first, *_) = segments_of(zigzag([0, 10, 8, 13, 11, 12.5, 9.5, 12.5, 9.2, 11.5, 9.6, 13]))
    assert (first.first, first.last, first.mode) == (0, 2, 2)


def test_completed_segments_of_a_prefix_stay():
    rng = random.Random(9)
    for _ in range(60):
        prices = [50.0]
        for i in range(60):
            prices.append(prices[-1] + (1 if i % 2 else -1) * rng.uniform(0.5, 9))
        strokes = zigzag(prices)
        last = []
        for n in range(3, len(strokes) + 1):
            done = [(s.first, s.last, s.mode, s.evidence) for s in segments_of(strokes[:n]) if s.evidence is not None]
            assert done[: len(last)] == last
            last = done


def test_merge():
    merged = base_chain.merge_contained([10, 9.5], [8, 8.5])
    assert [(m.low, m.high, m.first, m.last) for m in merged] == [(8, 9.5, 0, 1)]
    merged = base_chain.merge_contained([12, 14, 15], [9, 11, 10])
    assert (merged[-1].first, merged[-1].last, merged[-1].low) == (1, 2, 11)


@pytest.mark.parametrize("standard, min_gap, want", [("106", 2, [("bottom", 1), ("top", 4)]), ("81", 3, [("bottom", 1)])])
def test_six_bar_strokes(standard, min_gap, want):
    high, low = [12, 11, 13, 15, 16, 15], [10, 9, 11, 13, 14, 13]
    merged = base_chain.merge_contained(high, low)
    points = base_chain.fractal_points(merged)
    assert points == [("bottom", 1), ("top", 4)]
    closes = [(h + l) / 2 for h, l in zip(high, low)]  # noqa: E741
    ma5 = [sum(closes[i - 4 : i + 1]) / 5 if i >= 4 else None for i in range(6)]
    assert base_chain.pivot_chain(merged, points, min_gap, standard, ma5) == want


def test_centers_and_events():
    units = zigzag([0, 10, 4, 9, 3, 8, 2, 7, 2.5, 8, 3, 9.5, 1.5, 12, 11])
    (c,) = base_chain.centers_of(units)
    assert (c.zd, c.zg, *base_chain.waves(units, c)) == (4, 9, 12, 0)
    events = [(e["event"], e["unit"]) for e in base_chain.center_events(units, [c])]
    assert events == [("form", 2), *[("extend", i) for i in range(3, 8)], ("upgrade_9", 8), *[("extend", i) for i in range(9, 13)], ("complete", 13)]
    units = zigzag([0, 10, 4, 9, 5, 15, 12, 14, 12.5, 14.5])
    found = base_chain.centers_of(units)
    assert [(c.zd, c.zg) for c in found] == [(4, 9), (12.5, 14)]
    assert [e["relation"] for e in base_chain.center_events(units, found) if e["event"] == "new"] == ["expand"]
    (c,) = base_chain.centers_of(ranges([(0, 10), (5, 10), (11, 20), (12, 20), (12, 18)], ["up", "down", "up", "down", "up"]))
    assert (c.zd, c.zg) == (12, 18)


@pytest.mark.parametrize("current, want", [((9, 5), "down_continue"), ((30, 21), "up_continue"), ((10, 5), "expand"), ((30, 20), "expand")])
def test_relation(current, want):
    assert base_chain.relation((20, 10), current) == want


def test_expanded_center():
    a = base_chain.Center(0, 2, 12, 18, None)
    b = lambda zd, zg: base_chain.Center(3, 5, zd, zg, None)
    assert base_chain.expanded(a, (20, 10), b(16, 18.5), (22, 14), 13, 17) == {"zd": 14, "zg": 17, "n": 3}
    assert base_chain.expanded(a, (20, 10), b(7, 13), (15, 5), 19, 21) == {"zd": 10, "zg": 15, "n": 2}
    assert base_chain.expanded(a, (20, 10), b(22, 26), (30, 20), 19, 21) is None


SIX = [(1, 4), (2, 4), (2, 5), (3, 5), (3, 6), (3.5, 6)]


def test_moves():
    units = ranges(SIX, ["up", "down"] * 3)
    same = moves.decompose(units)
    assert [(m.kind, m.first, m.last, m.complete, m.centers) for m in same] == [("consolidation", 0, 2, True, [(2, 4)]), ("consolidation", 3, 5, False, [(3.5, 5)])]
    (up,) = moves.decompose(units, extend=True)
    assert (up.kind, up.first, up.last, up.complete) == ("consolidation", 0, 5, False)
    got = moves.decompose(ranges([(0, 4), (1, 5), (2, 6), (4.5, 8), (3, 6)], ["up", "down", "up", "down", "up"]), extend=True)
    assert [(m.kind, m.first, m.last, m.complete) for m in got] == [("consolidation", 0, 3, True), ("incomplete", 4, 4, False)]
    (up,) = moves.decompose(ranges([(2, 4), (2.5, 5), (3, 6), (5, 9), (5.5, 9.5), (6, 10)]), extend=True)
    assert (up.kind, up.complete, up.direction, up.centers) == ("up", False, "up", [(3, 4), (6, 9)])
    ends = [(0.5, 1.2), (3.5, 2), (2, 3.8), (3.8, 2.2), (4, 6), (6, 4.2), (4.2, 6.5), (6.5, 4.5)]
    units = [Unit("up" if b > a else "down", a, b, i, i + 1, min(a, b), max(a, b), i, i + 1) for i, (a, b) in enumerate(ends)]
    got = moves.decompose(units)
    assert [(m.kind, m.first, m.last, m.complete, m.centers) for m in got] == [("up", 0, 6, True, [(2.2, 3.5), (4.2, 6)]), ("incomplete", 7, 7, False, [])]


def test_confirmed_moves():
    prices = [10, 14, 11, 15, 13, 18, 16, 20, 14, 18, 12, 8, 10, 16]
    units = [moves.ConfirmedUnit(f"u{i}", 1, u, i + 2) for i, u in enumerate(zigzag(prices))]
    assert moves.confirm_levels(units, 8, 2) == []
    (m,) = moves.confirm_levels(units, 9, 2)
    assert (m.end_dt, len(m.unit_ids), len(m.evidence_ids), m.move.centers[0], m.move.direction, m.net) == (7, 7, 8, (11, 14), None, "up")
    prices = [5, 10, 8, 12, 9, 15, 13, 18, 16, 20, 18, 22, 21, 25, 23, 28, 19, 31, 29, 35, 24]
    units = [moves.ConfirmedUnit(f"u{i}", 1, u, i + 2) for i, u in enumerate(zigzag(prices))]
    last = []
    for at in range(3, 24):
        now = [(m.move_id, m.confirmed_dt) for m in moves.confirm_levels(units, at, 2)]
        assert now[: len(last)] == last
        last = now
    assert len(moves.confirm_levels(units, 23, 2)[0].move.centers) == 3


def short_long(diffs):
    return [None if d is None else 10 + d for d in diffs], [10.0] * len(diffs)


@pytest.mark.parametrize("diffs, kind, crossings", [([1, 0.75, 1.2], "fly", 0), ([1, 0.4, 1.5], "lip", 0), ([1, -0.3, 1.5], "wet", 2)])
def test_kisses(diffs, kind, crossings):
    for sign in (1, -1):
        (k,) = averages.find_kisses(*short_long([sign * d for d in diffs]))
        assert (k.kind, k.crossings, k.resumed, k.direction) == (kind, crossings, True, "up" if sign > 0 else "down")


def test_kiss_details():
    (k, *_) = averages.find_kisses(*short_long([1, -0.2, -0.5, -0.9]))
    assert (k.kind, k.resumed, k.crossings, k.depth) == ("wet", False, 1, 1.5)
    (k,) = averages.find_kisses(*short_long([0, 0, 2, 3, 1, 4]), volumes=[10, 20, 30, 40, 50, 60])
    assert (k.kind, k.leg_start, k.start, k.end, k.peak_gap, k.min_gap, k.depth) == ("lip", 2, 3, 5, 3, 1, 2)
    assert (k.vol_leg, k.vol_kiss, k.vol_prior, round(k.pre_gain, 9)) == (35, 55, None, 0.1)
    flip, lip = averages.find_kisses(*short_long([1, -0.5, -0.75, -0.25, -1]), volumes=[10, 20, 30, 40, 50])
    assert flip.end == 1 and (lip.leg_start, lip.start, lip.end, lip.kind, round(lip.pre_gain, 9), lip.vol_leg, lip.vol_kiss) == (1, 2, 4, "lip", 0.025, 25, 45)


def test_phase():
    seed = [(0, 4), (1, 5), (2, 6)]
    p = averages.transition_phase(*zip(*seed, (5, 7), (4.5, 6.5)))
    assert (p.stage, p.events[-1][1], p.direction, p.consumed) == ("ended", "bs3", "up", (0, 3))
    p = averages.transition_phase(*zip(*seed, (5, 7), (2.5, 4.5)))
    assert (p.stage, p.events[-1]) == ("center", (4, "return_to_center"))
    assert averages.transition_phase([1], [2]).stage == "before"


def test_center_events_read_each_unit_a_few_times():
    """A copy of all units before each center would cost the square of a series."""

    class Counted(list):
        read = 0

        def __getitem__(self, at):
            out = super().__getitem__(at)
            self.read += len(out) if isinstance(at, slice) else 1
            return out

    rng, ends = random.Random(1), [100]
    for i in range(4000):
        ends.append(ends[-1] + (1 if i % 2 else -1) * rng.randint(1, 9))
    units = Counted(Unit("up" if b > a else "down", a, b, i, i + 1, min(a, b), max(a, b)) for i, (a, b) in enumerate(zip(ends, ends[1:])))
    found = base_chain.centers_of(units)
    units.read = 0
    events = base_chain.center_events(units, found)
    assert len(found) > 300 and len(events) > 3000 and units.read < 8 * len(units)
