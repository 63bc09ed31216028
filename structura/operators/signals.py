"""Divergences and turning points of one series, as pure functions over strokes, centers and the MACD histogram."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

from .base_chain import Center, Unit, waves


class Areas:
    """Sums of the histogram over closed ranges of bar positions; an unknown end gives 0."""

    def __init__(self, hist: Sequence[float], dts: Sequence):
        self.sums = [0.0, *accumulate(hist)]
        self.at = {d: i for i, d in enumerate(dts)}

    def between(self, start_dt, end_dt) -> float:
        a, b = self.at.get(start_dt), self.at.get(end_dt)
        if a is None or b is None:
            return 0.0
        a, b = min(a, b), max(a, b)
        return self.sums[b + 1] - self.sums[a]


def trend_divergences(strokes: Sequence[Unit], centers: Sequence[Center], areas: Areas) -> list[dict]:
    """Per pair of neighbouring centers with disjoint waves: a new extreme of the last stroke on a smaller area."""
    out = []
    for k in range(1, len(centers) if strokes else 0):
        (gg0, dd0), (gg, dd) = waves(strokes, centers[k - 1]), waves(strokes, centers[k])
        sign = 1 if dd > gg0 else -1 if gg < dd0 else 0
        if not sign:
            continue
        last = strokes[-1]
        before = areas.between(strokes[centers[k - 1].last].end_dt, strokes[centers[k].first].start_dt)
        leave = areas.between(strokes[centers[k].last].end_dt, last.end_dt)
        price = last.high if sign > 0 else last.low
        if sign * (price - (gg0 if sign > 0 else dd0)) > 0 and abs(leave) < abs(before) and sign * leave > 0:
            out.append({"direction": "up" if sign > 0 else "down", "dt": last.end_dt, "price": price, "center": k, "area_prev": abs(before), "area_last": abs(leave)})
    return out


def range_divergences(strokes: Sequence[Unit], centers: Sequence[Center], areas: Areas, max_dev: float = 0.15) -> list[dict]:
    """For every center, all pairs of strokes two apart: a new extreme on a smaller area, not too far from the center."""
    pairs = []
    for a, b in zip(strokes, strokes[2:]):
        one, two = abs(areas.between(a.start_dt, a.end_dt)), abs(areas.between(b.start_dt, b.end_dt))
        if two < one and (b.end > a.end if b.direction == "up" else b.end < a.end):
            pairs.append((b, one, two))
    out = []
    for k, c in enumerate(centers):
        gg, dd = waves(strokes, c)
        for b, one, two in pairs:
            if b.end <= gg * (1 + max_dev) if b.direction == "up" else b.end >= dd * (1 - max_dev):
                out.append({"direction": b.direction, "dt": b.end_dt, "price": b.end, "center": k, "area_prev": one, "area_last": two})
    return out


def turning_points(strokes: Sequence[Unit], centers: Sequence[Center], divergences: Sequence[dict], side: str, min_ratio: float | None = None) -> list[dict]:
    """Types 3, 1 and 2 of one side ("buy" or "sell").

    Type 3: the first stroke that leaves a center past its edge and whose next stroke does not come back over the edge,
    if the leave is stronger; judged once per center. Type 1: the first divergence of that side. Type 2: after the
    stroke that ends there, the next stroke back and the one after it, if that holds the type 1 price.
    """
    up = side == "buy"
    away = "up" if up else "down"
    beyond = (lambda p, edge: p > edge) if up else (lambda p, edge: p < edge)
    holds = (lambda p, edge: p >= edge) if up else (lambda p, edge: p <= edge)
    starts = [u.start_dt for u in strokes]
    out = []
    for k, c in enumerate(centers):
        edge = c.zg if up else c.zd
        for i in range(bisect_left(starts, strokes[c.first].start_dt), len(strokes) - 1):
            leave, pull = strokes[i], strokes[i + 1]
            if leave.direction != away or not beyond(leave.end, edge) or not holds(pull.end, edge):
                continue
            strength, weakness = abs(leave.end / leave.start - 1), abs(pull.end / pull.start - 1)
            ratio = round(strength / weakness, 2) if weakness else None
            if ratio is not None and (ratio > 1 if min_ratio is None else ratio >= min_ratio):
                out.append({"side": side, "type": 3, "dt": pull.end_dt, "price": pull.end, "center": k, "ratio": ratio})
            break
    first = next((d for d in divergences if d["direction"] != away), None)
    if first is None:
        return out
    out.append({"side": side, "type": 1, "dt": first["dt"], "price": first["price"], "center": first["center"], "ratio": None})
    at = next((i for i, u in enumerate(strokes) if u.end_dt == first["dt"]), len(strokes))
    back = next((i for i in range(at + 1, len(strokes)) if strokes[i].direction == away), len(strokes))
    if back + 1 < len(strokes) and holds(strokes[back + 1].end, first["price"]):
        out.append({"side": side, "type": 2, "dt": strokes[back + 1].end_dt, "price": strokes[back + 1].end, "center": first["center"], "ratio": None})
    return out
