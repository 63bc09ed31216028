"""Decomposition of units into moves, level recursion, and its causal confirmation, as pure functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..schema import MAX_LEVELS, MIN_UNITS_FOR_NEXT
from .base_chain import Unit


@dataclass(slots=True)
class Move:
    """Units first..last. spans: per center the units (first, third, last) that made it."""

    kind: str
    complete: bool
    direction: str | None
    first: int
    last: int
    low: float
    high: float
    centers: list[tuple[float, float]] = field(default_factory=list)
    spans: list[tuple[int, int, int]] = field(default_factory=list)


def shared_range(units: Sequence[Unit], i: int) -> tuple[float, float] | None:
    """The price range that units i..i+2 share, touching included."""
    if i + 2 >= len(units):
        return None
    zd, zg = max(u.low for u in units[i : i + 3]), min(u.high for u in units[i : i + 3])
    return (zd, zg) if zd <= zg else None


def heading(unit: Unit) -> str | None:
    return next((x for x in (unit.direction, unit.kind) if x in ("up", "down")), None)


def touches(unit: Unit, center: tuple[float, float]) -> bool:
    return unit.high >= center[0] and unit.low <= center[1]


class _Reading:
    """One move in the making: its entry, its centers, and the leave that may become the next center."""

    def __init__(self, units: Sequence[Unit], first: int, extend: bool):
        self.units, self.first, self.extend = units, first, extend
        self.seed = next((i for i in range(first, len(units) - 2) if shared_range(units, i)), None)

    def read(self) -> tuple[Move, int]:
        """The move, and the unit where the next one begins."""
        units, n = self.units, len(self.units)
        if self.seed is None:
            return self._move(n - 1, "incomplete", None, [], [], False), n
        entry = heading(units[self.first]) if self.seed > self.first else None
        centers, spans = [shared_range(units, self.seed)], [(self.seed, self.seed + 2, self.seed + 2)]
        kind, leave = "consolidation", None
        for k in range(self.seed + 3, n):
            if touches(units[k], centers[-1]):
                if leave is None and self.extend:
                    spans[-1] = (*spans[-1][:2], k)
                    continue
                return self._move(k - 1, kind, entry, centers, spans, True), k
            if leave is None:
                leave = k
                continue
            new = shared_range(units, k - 2) if k - 2 >= leave else None
            if new is None:
                continue
            side = "up" if new[0] > centers[-1][1] else "down" if new[1] < centers[-1][0] else None
            if side is None or entry not in (None, side):
                return self._move(leave - 1, kind, entry, centers, spans, True), leave
            entry = kind = side
            centers.append(new)
            spans.append((k - 2, k, k))
            leave = None
        return self._move(n - 1, kind, entry, centers, spans, False), n

    def _move(self, last, kind, direction, centers, spans, complete) -> Move:
        held = self.units[self.first : last + 1]
        if kind in ("up", "down") and len(centers) < 2:
            kind = "consolidation"
        return Move(kind, complete, direction, self.first, last, min(u.low for u in held), max(u.high for u in held), list(centers), list(spans))


def decompose(units: Sequence[Unit], extend: bool = False) -> list[Move]:
    """Moves that cover all units. extend False: any touch after a center ends its move (same level); True: a touch
    before the first leave widens the center instead (one level up)."""
    out, at = [], 0
    while at < len(units):
        move, at = _Reading(units, at, extend).read()
        out.append(move)
    return out


def as_units(units: Sequence[Unit], moves: Sequence[Move]) -> list[Unit]:
    return [
        Unit(m.direction, units[m.first].start, units[m.last].end, units[m.first].start_index, units[m.last].end_index, m.low, m.high, units[m.first].start_dt, units[m.last].end_dt, m.kind)
        for m in moves
    ]


def level_chain(units: Sequence[Unit], max_levels: int = MAX_LEVELS) -> list[list[Unit]]:
    """Level 1 is the input; each next level recurses while three units are left and their number shrinks."""
    if max_levels < 1:
        raise ValueError("max_levels must be positive")
    levels = [list(units)]
    while len(levels) < max_levels and len(levels[-1]) >= MIN_UNITS_FOR_NEXT:
        upper = as_units(levels[-1], decompose(levels[-1], extend=True))
        if len(upper) >= len(levels[-1]):
            break
        levels.append(upper)
    return levels


@dataclass(slots=True)
class ConfirmedUnit:
    """A unit that is known from confirmed_dt on."""

    move_id: str
    level: int
    unit: Unit
    confirmed_dt: object


@dataclass(slots=True)
class ConfirmedMove:
    move_id: str
    level: int
    move: Move
    start_dt: object
    end_dt: object
    start: float
    end: float
    confirmed_dt: object
    unit_ids: list[str]
    evidence_ids: list[str]

    @property
    def net(self) -> str | None:
        return "up" if self.end > self.start else "down" if self.end < self.start else None


def visible_units(units: Sequence[ConfirmedUnit], as_of, next_level: int) -> list[ConfirmedUnit]:
    """The confirmed prefix as of a time. Later units are not looked at; the prefix must be one chain of one level."""
    seen = [u.confirmed_dt <= as_of for u in units]
    if any(b and not a for a, b in zip(seen, seen[1:])):
        raise ValueError("visible units are not a prefix")
    out = list(units[: sum(seen)])
    if len({u.move_id for u in out}) < len(out):
        raise ValueError("unit ids repeat")
    if len({u.level for u in out}) > 1 or any(u.level == next_level for u in out):
        raise ValueError("units must share one level, other than the next")
    for u in out:
        x = u.unit
        if not (x.start_dt < x.end_dt <= u.confirmed_dt) or not (x.low <= min(x.start, x.end) and max(x.start, x.end) <= x.high):
            raise ValueError(f"unit {u.move_id} contradicts itself")
    for a, b in zip(out, out[1:]):
        if a.unit.end_dt != b.unit.start_dt or a.unit.end != b.unit.start or a.confirmed_dt > b.confirmed_dt:
            raise ValueError(f"unit {b.move_id} does not follow {a.move_id}")
    return out


def confirm_levels(units: Sequence[ConfirmedUnit], as_of, next_level: int) -> list[ConfirmedMove]:
    """Complete moves one level up, each frozen when it first appears, batch of arrivals by batch."""
    visible = visible_units(units, as_of, next_level)
    frozen: dict[tuple, ConfirmedMove] = {}
    for n in range(1, len(visible) + 1):
        if n < len(visible) and visible[n].confirmed_dt == visible[n - 1].confirmed_dt:
            continue
        prefix = visible[:n]
        now = {}
        for m in decompose([u.unit for u in prefix], extend=True):
            if m.complete:
                now[m.first] = m
        for first, held in frozen.items():
            m = now.get(first)
            if m is None or (m.last, m.kind, m.centers) != (held.move.last, held.move.kind, held.move.centers):
                raise ValueError("a confirmed move was revised")
        for first, m in now.items():
            if first not in frozen:
                a, b = prefix[m.first].unit, prefix[m.last].unit
                ids = [u.move_id for u in prefix]
                frozen[first] = ConfirmedMove(f"L{next_level}:{ids[m.first]}", next_level, m, a.start_dt, b.end_dt, a.start, b.end, prefix[-1].confirmed_dt, ids[m.first : m.last + 1], ids)
    return [frozen[k] for k in sorted(frozen)]
