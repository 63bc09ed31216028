"""Sequential folds of the base chain, as pure functions over the columns of one series.

A merged bar always covers a run of adjacent raw bars, so it is kept as (first, last) positions with its range; strokes
are the steps between consecutive pivots of one pivot chain; centers are runs of units. Segments are in `segments`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

UP, DOWN, TOP, BOTTOM = "up", "down", "top", "bottom"


@dataclass(slots=True)
class MergedBar:
    first: int
    last: int
    high: float
    low: float


def merge_next(out: list[MergedBar], i: int, h: float, l: float) -> None:  # noqa: E741
    """Fold bar i into the last merged bar if either range holds the other, outward along the run's direction."""
    tip = out[-1] if out else None
    inside = tip is not None and ((h <= tip.high and l >= tip.low) or (h >= tip.high and l <= tip.low))
    if not inside:
        out.append(MergedBar(i, i, h, l))
        return
    rising = tip.high >= out[-2].high if len(out) > 1 else h >= tip.high
    pick = max if rising else min
    tip.high, tip.low, tip.last = pick(tip.high, h), pick(tip.low, l), i


def merge_contained(high: Sequence[float], low: Sequence[float]) -> list[MergedBar]:
    out: list[MergedBar] = []
    for i, (h, l) in enumerate(zip(high, low)):  # noqa: E741
        merge_next(out, i, h, l)
    return out


def fractal_at(bars: Sequence[MergedBar], k: int) -> str | None:
    """The kind of the strict three-bar double extreme around bar k."""
    a, b, c = bars[k - 1], bars[k], bars[k + 1]
    if b.high > max(a.high, c.high) and b.low > max(a.low, c.low):
        return TOP
    if b.high < min(a.high, c.high) and b.low < min(a.low, c.low):
        return BOTTOM
    return None


def fractal_points(bars: Sequence[MergedBar]) -> list[tuple[str, int]]:
    """(kind, position of the middle bar) of every fractal."""
    return [(kind, k) for k in range(1, len(bars) - 1) if (kind := fractal_at(bars, k))]


def pivot_next(chain: list[tuple[str, int]], bars: Sequence[MergedBar], kind: str, k: int, min_gap: int, standard: str = "81", ma5: Sequence[float | None] | None = None) -> None:
    """Take one fractal into the chain: it moves the last pivot, follows it, or is passed over."""
    if not chain:
        chain.append((kind, k))
        return
    last_kind, j = chain[-1]
    value = lambda i: bars[i].high if kind == TOP else bars[i].low
    if kind == last_kind:
        gain = value(k) - value(j)
        if gain > 0 if kind == TOP else gain < 0:
            chain[-1] = (kind, k)
        return
    top, bottom = (j, k) if last_kind == TOP else (k, j)
    if k - j - 1 < min_gap or bars[top].high <= bars[bottom].low:
        return
    if standard == "106" and not _six_bar_rule(bars, ma5 or [], j, k, UP if kind == TOP else DOWN):
        return
    chain.append((kind, k))


def pivot_chain(bars: Sequence[MergedBar], points: Sequence[tuple[str, int]], min_gap: int = 3, standard: str = "81", ma5: Sequence[float | None] | None = None) -> list[tuple[str, int]]:
    """Alternating pivots; a stroke runs between neighbours. A more extreme fractal of the same kind moves the last pivot."""
    chain: list[tuple[str, int]] = []
    for kind, k in points:
        pivot_next(chain, bars, kind, k, min_gap, standard, ma5)
    return chain


def _six_bar_rule(bars: Sequence[MergedBar], ma5: Sequence[float | None], j: int, k: int, direction: str) -> bool:
    """Three steps at least, both neighbours present, and a touch of the five-bar average between the ends."""
    if j < 1 or k + 1 >= len(bars) or k - j < 3:
        return False
    touch = (lambda b, m: b.high >= m) if direction == UP else (lambda b, m: b.low <= m)
    return any(ma5[i] is not None and ma5[i] == ma5[i] and touch(bars[i], ma5[i]) for i in range(j, k + 1))


@dataclass(slots=True)
class Unit:
    """What centers, segments and moves are built from."""

    direction: str | None
    start: float
    end: float
    start_index: int
    end_index: int
    low: float
    high: float
    start_dt: object = None
    end_dt: object = None
    kind: str | None = None


@dataclass(slots=True)
class Center:
    """first..last are the positions of its units; left is the unit that ended it, or None."""

    first: int
    last: int
    zd: float
    zg: float
    left: int | None


def centers_of(units: Sequence[Unit]) -> list[Center]:
    """Earliest strict three-unit overlaps, each extended by every unit that touches its range."""
    out, i, n = [], 0, len(units)
    while i + 2 < n:
        zd, zg = max(u.low for u in units[i : i + 3]), min(u.high for u in units[i : i + 3])
        if zd >= zg:
            i += 1
            continue
        j = i + 3
        while j < n and units[j].low <= zg and units[j].high >= zd:
            j += 1
        out.append(Center(i, j - 1, zd, zg, j if j < n else None))
        i = j
    return out


def waves(units: Sequence[Unit], c: Center) -> tuple[float, float]:
    """(gg, dd): the extremes of a center's units."""
    held = units[c.first : c.last + 1]
    return max(u.high for u in held), min(u.low for u in held)


def relation(previous: tuple[float, float], current: tuple[float, float]) -> str:
    """How a center's (gg, dd) lies to the one before."""
    if current[0] < previous[1]:
        return "down_continue"
    return "up_continue" if current[1] > previous[0] else "expand"


def center_events(units: Sequence[Unit], found: Sequence[Center]) -> list[dict]:
    """form or new, extend or upgrade_9, complete, and expand_zs beside a new center whose waves meet the last one's."""
    out: list[dict] = []
    for k, c in enumerate(found):
        own = waves(units, Center(c.first, c.first + 2, c.zd, c.zg, None))
        if not k:
            out.append({"event": "form", "unit": c.first + 2, "center": k})
        else:
            before = waves(units, found[k - 1])
            how = relation(before, own)
            out.append({"event": "new", "unit": c.first + 2, "center": k, "relation": how})
            if how == "expand":
                between = units[found[k - 1].last + 1 : c.first] or units[c.first : c.first + 1]
                wide = expanded(found[k - 1], before, c, own, min(u.low for u in between), max(u.high for u in between))
                if wide:
                    out.append({"event": "expand_zs", "unit": c.first + 2, "center": k, "relation": how, **wide})
        for j in range(c.first + 3, c.last + 1):
            out.append({"event": "upgrade_9" if j - c.first + 1 == 9 else "extend", "unit": j, "center": k})
        if c.left is not None:
            out.append({"event": "complete", "unit": c.left, "center": k, "relation": None})
    return out


def expanded(prev: Center, prev_waves: tuple[float, float], cur: Center, cur_waves: tuple[float, float], low: float, high: float) -> dict | None:
    """The wider center of two meeting ones and what connects them: of three ranges, else of the two waves."""
    zd, zg, n = max(prev_waves[1], low, cur_waves[1]), min(prev_waves[0], high, cur_waves[0]), 3
    if zd >= zg:
        zd, zg, n = max(prev_waves[1], cur_waves[1]), min(prev_waves[0], cur_waves[0]), 2
    return None if zd >= zg else {"zd": zd, "zg": zg, "n": n}


# Segments. ------------------------------------------------------------------------------------------------------------
