from datetime import datetime, timedelta

from structura.operators import causal
from structura.operators.moves import ConfirmedUnit
from structura.operators.base_chain import Unit

PRICES = [120, 110, 115, 108, 114, 90, 95, 88, 94, 70, 74, 68, 72, 67, 69, 65, 76, 70, 78, 75, 82, 76, 86]
START = datetime(2024, 1, 1)


def units(prices=PRICES, hours=20):
    at = lambda i: START + timedelta(hours=hours * i)
    return [
        ConfirmedUnit(f"u{i}", 1, Unit("up" if b > a else "down", a, b, i, i + 1, min(a, b), max(a, b), at(i), at(i + 1)), at(i + 1) + timedelta(minutes=2))
        for i, (a, b) in enumerate(zip(prices, prices[1:]))
    ]


def rows(prices=PRICES, n=20):
    close = [prices[0]] + [a + (b - a) * k / n for a, b in zip(prices, prices[1:]) for k in range(1, n + 1)]
    dt = [START + timedelta(hours=k) for k in range(len(close))]
    return causal.PriceRows(dt, [float(c) for c in close], [d + timedelta(minutes=1) for d in dt])


def test_first_point_appears_with_its_confirmation():
    held = units()
    (point,), _ = causal.first_points(held, rows(), held[-1].confirmed_dt, 2)
    assert (point.kind, point.reference_ids, point.leave_ids) == ("buy1", ["u8"], ["u12", "u13", "u14"])
    assert causal.first_points(held, rows(), held[15].confirmed_dt - timedelta(minutes=1), 2)[0] == []
    mirrored = [200 - p for p in PRICES]
    (point,), _ = causal.first_points(units(mirrored), rows(mirrored), held[-1].confirmed_dt, 2)
    assert point.kind == "sell1"


def test_strict_without_and_with_force():
    held = units()
    (v, *_), _ = causal.strict_scan(held, held[-1].confirmed_dt, 2)
    assert (v.kind, v.status, v.reason, v.center, v.price) == ("buy1", "insufficient_evidence", "force_missing", (70, 72), 65)
    assert [c for c, ok in v.conditions if ok] == ["trend", "separated_centers", "new_extreme", "leave_third_point"]
    (v, *_), _ = causal.strict_scan(held, held[-1].confirmed_dt, 2, lambda a, b: (causal.travel(a), causal.travel(b)), "travel")
    assert (v.status, v.reason) == ("confirmed", "force_decline")


def test_lineage():
    held = units()
    line = causal.Lineage(held, held[-1].confirmed_dt, 2)
    ids = [e.center_id for e in line.events if e.kind == "formed"]
    assert len(ids) == 4 and len(line.events) == 12
    assert [e.relation for e in line.events if e.kind == "formed"] == [None, "higher_level", "down_continue", "overlap"]
    first = [v for v in line.versions if v.center_id == ids[0]]
    assert (first[0].zd, first[0].zg, first[0].gg) == (110, 115, 120) and [v.dd for v in first] == [108, 108, 90][: len(first)]
    upper = causal.Lineage(held, held[-1].confirmed_dt, 2, 3)
    (wide,) = [v for v in upper.versions if v.level == 3]
    assert (wide.zd, wide.zg, wide.gg, wide.dd, wide.unit_ids) == (90, 95, 120, 88, [f"u{i}" for i in range(8)])
    assert line.snapshot(ids[0], 0).zd == 110
    assert line.dot() == causal.Lineage(held, held[-1].confirmed_dt, 2).dot() and line.dot().count("->") >= 3


def test_no_rewrite_as_units_arrive():
    held = units()
    last_points, last_versions = [], []
    for u in held:
        now = [(p.kind, p.dt) for p in causal.first_points(held, rows(), u.confirmed_dt, 2)[0]]
        versions = [(v.center_id, v.version, v.zd, v.gg, v.dd) for v in causal.Lineage(held, u.confirmed_dt, 2).versions]
        assert now[: len(last_points)] == last_points and versions[: len(last_versions)] == last_versions
        last_points, last_versions = now, versions


def test_layers_of_a_leave():
    coarse = units()
    at = coarse[-1].confirmed_dt
    force = lambda a, b: (causal.travel(a), causal.travel(b))
    (v, *_), _ = causal.strict_scan(coarse, at, 3, force, "travel")
    fine = []
    for u in coarse:  # three finer units inside each coarse one, the middle one against it
        a, b, step = u.unit.start, u.unit.end, (u.unit.end_dt - u.unit.start_dt) / 3
        for k, (x, y) in enumerate([(a, a + (b - a) * 0.6), (a + (b - a) * 0.6, a + (b - a) * 0.4), (a + (b - a) * 0.4, b)]):
            s, e = u.unit.start_dt + step * k, u.unit.start_dt + step * (k + 1)
            fine.append(ConfirmedUnit(f"{u.move_id}.{k}", 0, Unit("up" if y > x else "down", x, y, 0, 1, min(x, y), max(x, y), s, e), e + timedelta(minutes=1)))
    fine.sort(key=lambda u: u.unit.start_dt)
    chain, turn = causal.nested_chain(v, coarse, [(0, fine)], at, 3, force)
    assert [r.depth for r in chain] == [1] and chain[0].status != "not_covered"
    assert turn is None or turn == (chain[0].dt, chain[0].price)
    assert causal.nested_chain(v, coarse, [(0, fine[:-40])], at, 3, force)[0][0].status == "not_covered"
    steps = causal.completion_cascade(v, coarse, [(0, fine)], at, 3)
    assert steps[0][1] == v.leave_ids[-1] and steps[0][2] in ("confirmed", "unverified")
