"""One series from bars to points, and its replay: what the grouped operators run for each (symbol, freq)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from . import averages, base_chain, signals
from .base_chain import DOWN, TOP, UP, Center, MergedBar, Unit
from .segments import Segment, segments_of


@dataclass
class Bars:
    dt: Sequence
    open: Sequence[float]
    high: Sequence[float]
    low: Sequence[float]
    close: Sequence[float]
    volume: Sequence[float]

    def head(self, n: int) -> Bars:
        return Bars(*(x[:n] for x in (self.dt, self.open, self.high, self.low, self.close, self.volume)))


@dataclass
class Structure:
    merged: list[MergedBar]
    fractals: list[tuple[str, int]]
    strokes: list[Unit]
    segments: list[Segment]
    segment_units: list[Unit]
    stroke_centers: list[Center]
    segment_centers: list[Center]


def stroke_units(bars: Bars, merged: Sequence[MergedBar], chain: Sequence[tuple[str, int]]) -> list[Unit]:
    out = []
    for (a_kind, a), (b_kind, b) in zip(chain, chain[1:]):
        start = merged[a].high if a_kind == TOP else merged[a].low
        end = merged[b].high if b_kind == TOP else merged[b].low
        out.append(Unit(UP if b_kind == TOP else DOWN, start, end, a, b, min(start, end), max(start, end), bars.dt[merged[a].last], bars.dt[merged[b].last]))
    return out


def segment_units(strokes: Sequence[Unit], segments: Sequence[Segment]) -> list[Unit]:
    out = []
    for s in segments:
        held = strokes[s.first : s.last + 1]
        a, b = held[0], held[-1]
        out.append(Unit(a.direction, a.start, b.end, a.start_index, b.end_index, min(u.low for u in held), max(u.high for u in held), a.start_dt, b.end_dt))
    return out


def min_gap_of(standard: str, min_gap: int | None) -> int:
    """The independent bars that a stroke needs; the six-bar standard asks for one less and adds its own tests."""
    if standard not in ("81", "106"):
        raise ValueError("standard must be 81 or 106")
    gap = {"81": 3, "106": 2}[standard] if min_gap is None else min_gap
    if gap < 0:
        raise ValueError("min_gap must not be negative")
    return gap


def raw_ma5(bars: Bars, merged: Sequence[MergedBar]) -> list[float | None]:
    """Five-bar averages of the raw closes at each merged bar's last raw bar."""
    return [averages.exact_mean(bars.close[m.last - 4 : m.last + 1]) if m.last >= 4 else None for m in merged]


def read_structure(bars: Bars, min_gap: int | None = None, standard: str = "81", strokes: bool = True, segments: bool = True) -> Structure:
    """Merged bars and all that follows from them; without strokes only the merged bars, without segments what strokes give."""
    gap = min_gap_of(standard, min_gap)
    merged = base_chain.merge_contained(bars.high, bars.low)
    if not strokes:
        return Structure(merged, [], [], [], [], [], [])
    points = base_chain.fractal_points(merged)
    chain = base_chain.pivot_chain(merged, points, gap, standard, raw_ma5(bars, merged) if standard == "106" else None)
    found = stroke_units(bars, merged, chain)
    parts = segments_of(found) if segments else []
    units = segment_units(found, parts)
    return Structure(merged, points, found, parts, units, base_chain.centers_of(found), base_chain.centers_of(units))


def points_of(bars: Bars, s: Structure) -> list[dict]:
    hist = averages.macd(bars.close)[2]
    found = signals.trend_divergences(s.strokes, s.stroke_centers, signals.Areas(hist, bars.dt))
    return [p for side in ("buy", "sell") for p in signals.turning_points(s.strokes, s.stroke_centers, found, side)]


def _fractal_record(bars: Bars, merged: Sequence[MergedBar], kind: str, k: int) -> tuple[tuple[str, str], str]:
    a, m, b = merged[k - 1 : k + 2]
    low = min(a.low, m.low, b.low) if kind == TOP else m.low
    high = m.high if kind == TOP else max(a.high, m.high, b.high)
    return ("fractal", f"{kind}@{m.first}"), f"{bars.dt[m.last]}|{high!r}|{low!r}|{a.first}-{b.last}"


def _stroke_record(merged: Sequence[MergedBar], u: Unit) -> tuple[tuple[str, str], str]:
    return ("stroke", f"{u.direction}@{merged[u.start_index].first}"), f"{u.start_dt}|{u.end_dt}|{u.start!r}|{u.end!r}"


def _point_records(strokes: Sequence[Unit], centers: Sequence[Center], points: Sequence[dict]) -> dict[tuple[str, str], str]:
    out: dict[tuple[str, str], str] = {}
    for p in points:
        key = ("signal", f"{p['side']}{p['type']}@{p['dt']}@{strokes[centers[p['center']].first].start_dt}")
        text = f"{p['price']!r}|{p['ratio']!r}"
        if out.get(key, text) != text:
            raise ValueError(f"one identity, two signals: {key[1]}")
        out[key] = text
    return out


def records(bars: Bars, s: Structure) -> dict[tuple[str, str], str]:
    """(field, identity) -> content of fractals, strokes and points; identities do not change when bars merge later."""
    out = dict(_fractal_record(bars, s.merged, kind, k) for kind, k in s.fractals)
    out |= dict(_stroke_record(s.merged, u) for u in s.strokes)
    return out | _point_records(s.strokes, s.stroke_centers, points_of(bars, s))


def confirmed_records(bars: Bars, s: Structure) -> dict[tuple[str, str], str]:
    """The conservative view: all strokes but the last, complete segments of those, and the centers of these segments."""
    strokes = s.strokes[:-1]
    segments = [x for x in segments_of(strokes) if x.evidence is not None]
    units = segment_units(strokes, segments)
    out = {("confirmed_stroke", f"{u.direction}@{u.start_dt}"): f"{u.end_dt}|{u.start!r}|{u.end!r}" for u in strokes}
    out |= {("confirmed_segment", f"{u.direction}@{u.start_dt}"): f"{u.end_dt}|{u.low!r}|{u.high!r}" for u in units}
    out |= {("confirmed_center", f"{units[c.first].start_dt}"): f"{units[c.last].end_dt}|{c.zd!r}|{c.zg!r}" for c in base_chain.centers_of(units)}
    return out


@dataclass(slots=True)
class Change:
    kind: str
    field: str
    identity: str
    first_seen: object
    observed: object
    before: str | None
    after: str | None


def replay(bars: Bars, observed: Sequence[tuple[object, Bars]], confirmed: bool = False, min_gap: int | None = None, standard: str = "81") -> Iterator[Change]:
    """The ledger over observations (time, visible bars): what appeared, was revised, or was withdrawn at each."""
    first_seen: dict[tuple[str, str], object] = {}
    last: dict[tuple[str, str], str] = {}
    for at, visible in observed:
        s = read_structure(visible, min_gap, standard)
        now = records(visible, s)
        if confirmed:
            now |= confirmed_records(visible, s)
        for key, text in now.items():
            if key not in last:
                first_seen.setdefault(key, at)
                yield Change("appeared", *key, first_seen[key], at, None, text)
            elif last[key] != text:
                yield Change("revised", *key, first_seen[key], at, last[key], text)
        for key, text in last.items():
            if key not in now:
                yield Change("withdrawn", *key, first_seen[key], at, text, None)
        last = now


class PrefixReplay:
    """The ledger over growing prefixes of one series, bar by bar.

    A new bar can only change the last merged bar, hence the last fractal, hence the last pivot; everything before stands.
    So a step touches the ends of the lists, and points are read anew only when a stroke has changed. Averages of a
    prefix are the prefix of the whole series' averages.
    """

    def __init__(self, bars: Bars, min_gap: int | None = None, standard: str = "81"):
        self.bars, self.gap, self.standard = bars, min_gap_of(standard, min_gap), standard
        self.areas = signals.Areas(averages.macd(bars.close)[2], bars.dt)
        self.merged: list[MergedBar] = []
        self.settled: list[tuple[str, int]] = []  # pivots from fractals that no later bar can change
        self.next_fractal = 1
        self.fractals: list[tuple[tuple[str, str], str]] = []
        self.fixed = 0  # fractal records that stand
        self.strokes: list[tuple[tuple[str, str], str]] = []
        self.chain: list[tuple[str, int]] = []
        self.units: list[Unit] = []
        self.points: dict[tuple[str, str], str] = {}
        self.first_seen: dict[tuple[str, str], object] = {}

    def _ma5(self) -> list[float | None] | None:
        if self.standard != "106":
            return None
        return raw_ma5(self.bars, self.merged)

    def step(self, i: int) -> None:
        base_chain.merge_next(self.merged, i, self.bars.high[i], self.bars.low[i])

    def _chain(self) -> tuple[list[tuple[str, int]], list[tuple[tuple[str, str], str]]]:
        """The pivot chain now, and the fractal records from the first that may have changed."""
        n, tail = len(self.merged), []
        ma5 = self._ma5()
        take = lambda chain, kind, k: base_chain.pivot_next(chain, self.merged, kind, k, self.gap, self.standard, ma5)
        while self.next_fractal < n - 2:  # its three bars are closed
            if kind := base_chain.fractal_at(self.merged, self.next_fractal):
                take(self.settled, kind, self.next_fractal)
                tail.append(_fractal_record(self.bars, self.merged, kind, self.next_fractal))
            self.next_fractal += 1
        self.closed = len(tail)
        chain = self.settled
        if n > 2 and self.next_fractal == n - 2 and (kind := base_chain.fractal_at(self.merged, n - 2)):
            chain = list(self.settled)
            take(chain, kind, n - 2)
            tail.append(_fractal_record(self.bars, self.merged, kind, n - 2))
        return chain, tail

    def observe(self, at) -> Iterator[Change]:
        """What changed since the last observation."""
        chain, tail = self._chain()
        yield from self._diff(dict(self.fractals[self.fixed :]), dict(tail), at)
        self.fractals[self.fixed :] = tail
        self.fixed += self.closed
        if chain == self.chain:
            return
        keep = max(0, min(len(chain), len(self.chain)) - 3)
        while keep and chain[: keep + 1][-1] != self.chain[keep]:
            keep -= 1
        fresh = stroke_units(self.bars, self.merged, chain[keep:])
        self.units[keep:] = fresh
        now = [_stroke_record(self.merged, u) for u in fresh]
        yield from self._diff(dict(self.strokes[keep:]), dict(now), at)
        self.strokes[keep:] = now
        self.chain = list(chain)
        centers = base_chain.centers_of(self.units)
        found = signals.trend_divergences(self.units, centers, self.areas)
        points = [p for side in ("buy", "sell") for p in signals.turning_points(self.units, centers, found, side)]
        after = _point_records(self.units, centers, points)
        yield from self._diff(self.points, after, at)
        self.points = after

    def _diff(self, before: dict, after: dict, at) -> Iterator[Change]:
        for key, text in after.items():
            if key not in before:
                self.first_seen.setdefault(key, at)
                yield Change("appeared", *key, self.first_seen[key], at, None, text)
            elif before[key] != text:
                yield Change("revised", *key, self.first_seen[key], at, before[key], text)
        for key, text in before.items():
            if key not in after:
                yield Change("withdrawn", *key, self.first_seen[key], at, text, None)


def replay_prefixes(bars: Bars, step: int = 1, min_gap: int | None = None, standard: str = "81") -> Iterator[Change]:
    """The ledger at every step-th bar, counted from the last."""
    state, n = PrefixReplay(bars, min_gap, standard), len(bars.dt)
    for i in range(n):
        state.step(i)
        if (n - 1 - i) % step == 0:
            yield from state.observe(bars.dt[i])
