"""Candidates from contacts and areas of two averages, as pure functions over the visible bars of one series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import groupby

from .averages import Kiss, exact_mean, find_kisses


@dataclass
class Rows:
    dt: Sequence
    high: Sequence[float]
    low: Sequence[float]
    close: Sequence[float]
    volume: Sequence[float]
    available_dt: Sequence


@dataclass
class Area:
    sign: int
    start: int
    end: int
    area: float
    closed: bool

    @property
    def mean(self) -> float:
        return self.area / (self.end - self.start + 1)


@dataclass
class Settings:
    short: int = 5
    long: int = 10
    proximity: float = 0.5
    min_depth: float = 0.2
    flip_confirm: float = 0.5
    min_pre_gain: float = 0.02
    max_volume_ratio: float | None = 2.0
    use_avg: bool = False


def moving_mean(values: Sequence[float], n: int) -> list[float | None]:
    return [exact_mean(values[i - n + 1 : i + 1]) if i >= n - 1 else None for i in range(len(values))]


def areas_of(short: Sequence[float | None], long: Sequence[float | None]) -> list[Area]:
    """Islands of one sign of the distance from its first value to its first hole."""
    gaps = [None if a is None or b is None else a - b for a, b in zip(short, long)]
    base = next((i for i, d in enumerate(gaps) if d is not None), len(gaps))
    if base >= len(gaps) - 1:
        return []
    stop = next((i for i in range(base, len(gaps)) if gaps[i] is None), len(gaps))
    out = []
    for sign, run in groupby(range(base, stop), key=lambda i: (gaps[i] > 0) - (gaps[i] < 0)):
        at = list(run)
        if sign:
            out.append(Area(sign, at[0], at[-1], sum(gaps[i] for i in at), at[-1] + 1 < stop))
    return out


class Reader:
    """Averages, contacts and areas of one series."""

    def __init__(self, rows: Rows, s: Settings, volumes: bool = True):
        self.rows, self.s = rows, s
        short, long = moving_mean(rows.close, s.short), moving_mean(rows.close, s.long)
        self.kisses = [k for k in find_kisses(short, long, rows.volume if volumes else None, s.proximity, s.min_depth, s.flip_confirm) if not k.open]
        self.areas = areas_of(short, long)
        self.gaps = [a - b for a, b in zip(short, long) if a is not None and b is not None]

    def before(self, k: int) -> Area | None:
        """The nearest earlier area of the sign of area k."""
        return next((a for a in reversed(self.areas[:k]) if a.sign == self.areas[k].sign), None)

    def contact_before(self, at: int) -> Kiss | None:
        return next((k for k in reversed(self.kisses) if k.end <= at), None)

    def trending(self, area: Area, reference: Area) -> bool:
        """Both the highest high and the lowest low lie further along the area's side than the reference's."""
        cut = lambda x, a: x[a.start : a.end + 1]
        high = max(cut(self.rows.high, area)) - max(cut(self.rows.high, reference))
        low = min(cut(self.rows.low, area)) - min(cut(self.rows.low, reference))
        return area.sign * high > 0 and area.sign * low > 0

    def _point(self, buying: bool, number: int, start: int, end: int, confirmed: int, pattern: str, kiss: Kiss) -> dict:
        values = self.rows.low if buying else self.rows.high
        at = (min if buying else max)(range(start, end + 1), key=lambda i: values[i])
        return {
            "kind": f"ma_{'buy' if buying else 'sell'}{number}_candidate", "dt": self.rows.dt[at], "price": values[at], "confirmed_dt": self.rows.available_dt[confirmed], "pattern": pattern,
            "kiss_kind": kiss.kind, "kiss_index": kiss.kiss_index,
        }

    def points(self) -> list[dict]:
        out, s = [], self.s
        turned = None
        for k in self.kisses:
            if not k.resumed:
                turned = k.end
            elif turned is not None and k.kiss_index == 1 and k.leg_start >= turned and k.pre_gain is not None and k.pre_gain >= s.min_pre_gain and self._calm(k):
                out.append(self._point(k.direction == "up", 2, k.start + 1, k.end, k.end, "first_continuation", k))
        for i, area in enumerate(self.areas):
            prior = self.before(i)
            if not area.closed or prior is None:
                continue
            weaker = abs(area.mean) < abs(prior.mean) if s.use_avg else abs(area.area) < abs(prior.area)
            kiss = self.contact_before(area.start)
            side = "up" if area.sign > 0 else "down"
            if weaker and kiss and kiss.resumed and kiss.direction == side and kiss.kiss_index >= 2 and self.trending(area, prior):
                out.append(self._point(area.sign < 0, 1, area.start, area.end, area.end + 1, "post_kiss_divergence", kiss))
        return sorted(out, key=lambda p: (p["confirmed_dt"], p["kind"], p["dt"]))

    def _calm(self, k: Kiss) -> bool:
        """The leg's volume is not out of proportion to that of the bars before it."""
        if self.s.max_volume_ratio is None:
            return True
        base = exact_mean(self.rows.volume[max(0, k.leg_start - self.s.long) : k.leg_start]) or 0
        return base > 0 and k.vol_leg is not None and k.vol_leg / base <= self.s.max_volume_ratio

    def state(self) -> dict:
        """The snapshot as of the last bar: warning, no_warning or insufficient_evidence, with reasons in order."""
        if not len(self.rows.dt):
            return {"status": "insufficient_evidence", "direction": None, "reasons": ["no_visible_bars"]}
        whole = len(self.gaps) == max(0, len(self.rows.dt) - max(self.s.short, self.s.long) + 1)
        if not self.areas or not whole:
            return {"status": "insufficient_evidence", "direction": None, "reasons": ["ma_unavailable"]}
        now, prior = self.areas[-1], self.before(len(self.areas) - 1)
        kiss = self.contact_before(now.start)
        side = "up" if now.sign > 0 else "down"
        weak = prior is not None and abs(now.mean) < abs(prior.mean)
        shortening = len(self.gaps) > 1 and abs(self.gaps[-1]) < abs(self.gaps[-2])
        asked = [
            ("reference_missing", prior is None), ("kiss_missing", kiss is None), ("kiss_not_continuation", kiss is not None and not (kiss.resumed and kiss.direction == side)),
            ("kiss_count_below_two", kiss is not None and kiss.resumed and kiss.direction == side and kiss.kiss_index < 2), ("area_closed", now.closed),
            ("price_not_trending", prior is not None and not self.trending(now, prior)), ("average_not_weaker", prior is not None and not weak), ("stretch_not_shortening", not shortening),
        ]
        reasons = [name for name, yes in asked if yes]
        return {"status": "insufficient_evidence" if prior is None or kiss is None else "no_warning" if reasons else "warning", "direction": side, "reasons": reasons}
