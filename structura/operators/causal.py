"""Causal folds over confirmed units: first points, strict verdicts, center lineage, and a graph text. Pure functions.

Both verdicts compare the same two legs of a trend: the one between its last two centers and the one that leaves the
last. `Legs` cuts them; `judge_first` and `judge_strict` then ask their questions in order and stop at the first no.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from . import averages
from .moves import ConfirmedMove, ConfirmedUnit, Move, confirm_levels, decompose, visible_units


def net(u: ConfirmedUnit) -> str | None:
    return "up" if u.unit.end > u.unit.start else "down" if u.unit.end < u.unit.start else None


def wave(units: Sequence[ConfirmedUnit]) -> tuple[float, float]:
    return min(u.unit.low for u in units), max(u.unit.high for u in units)


@dataclass
class Legs:
    """The compared legs of a directed move with two centers or more; sign is 1 for a rising one."""

    sign: int
    before: list[ConfirmedUnit]
    last: list[ConfirmedUnit]
    reference: list[ConfirmedUnit]
    leave: list[ConfirmedUnit]
    whole: list[ConfirmedUnit]
    last_span: tuple[int, int, int]

    @classmethod
    def cut(cls, units: Sequence[ConfirmedUnit], move: Move, open_end: bool = False) -> Legs | None:
        """None where a center has no unit against the move inside its extension."""
        against = "down" if move.kind == "up" else "up"
        ends = [next((i for i in range(span[2], span[1] - 1, -1) if net(units[i]) == against), None) for span in move.spans[-2:]]
        if None in ends:
            return None
        (a, _, _), last = move.spans[-2:]
        stop = len(units) if open_end else move.last + 1
        return cls(
            1 if move.kind == "up" else -1, list(units[a : ends[0] + 1]), list(units[last[0] : ends[1] + 1]), list(units[ends[0] + 1 : last[0]]), list(units[ends[1] + 1 : stop]),
            list(units[move.first : ends[1] + 1]), last,
        )

    def ahead(self, a: float, b: float) -> bool:
        return self.sign * (a - b) > 0

    def edge(self, units: Sequence[ConfirmedUnit], far: bool = True) -> float:
        """The extreme of some units along the move, or against it."""
        low, high = wave(units)
        return high if (self.sign > 0) == far else low

    @property
    def separated(self) -> bool:
        return self.ahead(self.edge(self.last, far=False), self.edge(self.before))

    @property
    def price(self) -> float:
        return self.leave[-1].unit.end


def _trends(units: Sequence[ConfirmedUnit], done: Sequence[ConfirmedMove]):
    """Each confirmed move with the units it was confirmed from and the move as read from them."""
    for m in done:
        known = set(m.evidence_ids)
        yield m, [u for u in units if u.move_id in known], m.move


@dataclass
class FirstPoint:
    kind: str
    move_id: str
    dt: object
    price: float
    confirmed_dt: object
    center: tuple[float, float]
    reference_ids: list[str]
    leave_ids: list[str]
    area_reference: float
    area_leave: float
    zero_axis: float


@dataclass
class PriceRows:
    dt: Sequence
    close: Sequence[float]
    available_dt: Sequence

    def __post_init__(self):
        self.dif, self.dea, self.hist = averages.macd(self.close)
        self.at = {d: i for i, d in enumerate(self.dt)}

    def area(self, start_dt, end_dt, sign: int) -> float:
        """The histogram's part of one sign after the first bar up to the last."""
        return sum(max(sign * v, 0.0) for v in self.hist[self.at[start_dt] + 1 : self.at[end_dt] + 1])

    def zero_axis(self, start_dt, end_dt) -> float:
        return min(max(abs(self.dif[i]), abs(self.dea[i])) / self.close[i] for i in range(self.at[start_dt], self.at[end_dt] + 1))


def judge_first(legs: Legs | None, center: tuple[float, float], rows: PriceRows, ratio: float) -> tuple[str | None, tuple[float, float, float] | None]:
    """(exclusion, None) or (None, (area of the reference, of the leave, nearness to zero))."""
    if legs is None:
        return "no_comparable_center_tail", None
    side = "up" if legs.sign > 0 else "down"
    if not legs.reference or not legs.leave or net(legs.reference[0]) != side or net(legs.leave[-1]) != side:
        return "no_directional_compare_legs", None
    if not legs.separated:
        return "center_waves_overlap", None
    if not legs.ahead(legs.price, legs.edge(legs.last)):
        return "no_new_extreme", None
    if legs.price != legs.edge(legs.leave):
        return "internal_extreme_time_unknown", None
    a, z, c = [(part[0].unit.start_dt, part[-1].unit.end_dt) for part in (legs.reference, legs.last, legs.leave)]
    if any(dt > rows.dt[-1] for dt in (*a, *z, *c)):
        return "waiting_price_evidence", None
    if any(dt not in rows.at for dt in (*a, *z, *c)):
        raise ValueError("a leg ends where there is no bar")
    area_a, area_c = rows.area(*a, legs.sign), rows.area(*c, legs.sign)
    if not 0 < area_c < area_a:
        return "area_not_positive_and_weaker", None
    zero = rows.zero_axis(*z)
    if zero > ratio:
        return "no_zero_axis_pull", None
    return ("zero_width_center", None) if center[0] == center[1] else (None, (area_a, area_c, zero))


def first_points(units: Sequence[ConfirmedUnit], rows: PriceRows, as_of, level: int, ratio: float = 0.005) -> tuple[list[FirstPoint], list[tuple[str, str]]]:
    """(points, (move, exclusion) pairs) of the confirmed moves as of a time."""
    if not ratio >= 0:
        raise ValueError("ratio must not be negative")
    visible = visible_units(units, as_of, level)
    points, excluded = [], []
    if not visible or not len(rows.dt):
        return points, excluded
    for done, prefix, move in _trends(visible, confirm_levels(visible, as_of, level)):
        if move.kind not in ("up", "down"):
            excluded.append((done.move_id, "not_trend"))
            continue
        legs = Legs.cut(prefix, move)
        reason, values = judge_first(legs, move.centers[-1], rows, ratio)
        if reason:
            excluded.append((done.move_id, reason))
            continue
        upto = rows.at[legs.leave[-1].unit.end_dt]
        known = max([done.confirmed_dt, *rows.available_dt[: upto + 1]])
        points.append(FirstPoint("sell1" if legs.sign > 0 else "buy1", done.move_id, legs.leave[-1].unit.end_dt, legs.price, known, move.centers[-1], [u.move_id for u in legs.reference], [u.move_id for u in legs.leave], *values))
    return points, excluded


Force = Callable[[list, list], tuple[float, float] | None]


def travel(units: Sequence[ConfirmedUnit]) -> float:
    return sum(u.unit.high - u.unit.low for u in units)


@dataclass
class Verdict:
    kind: str
    status: str
    reason: str
    move_id: str
    conditions: list[tuple[str, bool | None]]
    center: tuple[float, float] | None
    dt: object
    price: float
    reference_ids: list[str]
    leave_ids: list[str]
    forces: tuple[float, float] | None = None


def _has_pull(legs: Legs) -> bool:
    """A unit against the move inside the leave."""
    return any(net(u) == ("down" if legs.sign > 0 else "up") for u in legs.leave)


def judge_strict(legs: Legs, center: tuple[float, float], force: Force | None) -> tuple[str, str, list[tuple[str, bool | None]], tuple[float, float] | None]:
    """(status, reason, conditions, forces) of a completed trend."""
    asked: list[tuple[str, bool | None]] = [("trend", True)]

    def stop(status: str, reason: str, name: str | None = None, value: bool | None = None, forces=None):
        return status, reason, asked + ([(name, value)] if name else []), forces

    if not legs.separated:
        return stop("rejected", "center_waves_overlap", "separated_centers", False)
    asked.append(("separated_centers", True))
    if center[0] == center[1]:
        return stop("insufficient_evidence", "zero_width_center", "leave_third_point")
    if not legs.ahead(legs.edge(legs.leave), legs.edge(legs.whole)):
        return stop("rejected", "no_new_extreme", "new_extreme", False)
    if legs.price != legs.edge(legs.leave):
        return stop("insufficient_evidence", "internal_extreme_time_unknown", "new_extreme")
    asked.append(("new_extreme", True))
    asked.append(("leave_third_point", _has_pull(legs)))
    if not asked[-1][1]:
        return stop("rejected", "no_third_point_in_leave")
    if force is None:
        return stop("insufficient_evidence", "force_missing")
    forces = force(legs.reference, legs.leave)
    if forces is None:
        return stop("insufficient_evidence", "force_unavailable", "force")
    a, b = forces
    if isinstance(a, bool) or isinstance(b, bool) or a != a or b != b or abs(a) == float("inf") or abs(b) == float("inf"):
        raise ValueError("forces must be two finite numbers")
    return stop("confirmed", "force_decline", "force", True, (a, b)) if b < a else stop("rejected", "force_not_declining", "force", False, (a, b))


def strict_scan(units: Sequence[ConfirmedUnit], as_of, level: int, force: Force | None = None, force_method: str | None = None) -> tuple[list[Verdict], list[tuple[str, str]]]:
    """(verdicts, skipped) of the confirmed trends, and of the open tail as a candidate."""
    if force is not None and not force_method:
        raise ValueError("a force needs a named method")
    visible = visible_units(units, as_of, level)
    found, skipped = [], []

    def add(move_id, status, reason, conditions, legs, center, forces=None):
        found.append(Verdict("sell1" if legs.sign > 0 else "buy1", status, reason, move_id, conditions, center, legs.leave[-1].unit.end_dt, legs.price, [u.move_id for u in legs.reference], [u.move_id for u in legs.leave], forces))

    for done, prefix, move in _trends(visible, confirm_levels(visible, as_of, level)):
        if move.kind not in ("up", "down"):
            skipped.append((done.move_id, "not_trend"))
            continue
        legs = Legs.cut(prefix, move)
        if legs is None or not legs.reference or not legs.leave:
            skipped.append((done.move_id, "no_comparable_center_tail" if legs is None else "no_compare_legs"))
            continue
        status, reason, conditions, forces = judge_strict(legs, move.centers[-1], force)
        add(done.move_id, status, reason, conditions, legs, None if reason == "center_waves_overlap" else move.centers[-1], forces)
    tail = decompose([u.unit for u in visible], extend=True)[-1] if visible else None
    if tail is not None and not tail.complete:
        name = f"L{level}:{visible[tail.first].move_id}"
        legs = Legs.cut(visible, tail, open_end=True) if len(tail.spans) > 1 and tail.kind in ("up", "down") else None
        if legs is None:
            skipped.append((name, "not_two_separated_centers" if len(tail.spans) < 2 or tail.kind not in ("up", "down") else "no_comparable_center_tail"))
        elif not legs.reference or not legs.leave:
            skipped.append((name, "no_compare_legs"))
        elif not legs.separated:
            skipped.append((name, "center_waves_overlap"))
        elif tail.centers[-1][0] == tail.centers[-1][1]:
            skipped.append((name, "zero_width_center"))
        else:
            made = legs.ahead(legs.edge(legs.leave), legs.edge(legs.whole))
            add(name, "candidate", "trend_open", [("trend", None), ("separated_centers", True), ("new_extreme", made or None), ("leave_third_point", _has_pull(legs) or None)], legs, tail.centers[-1])
    return found, skipped


@dataclass
class CenterVersion:
    center_id: str
    level: int
    version: int
    zd: float
    zg: float
    gg: float
    dd: float
    unit_ids: list[str]
    confirmed_dt: object


@dataclass
class CenterEvent:
    kind: str
    center_id: str
    version: int
    previous_id: str | None
    relation: str | None
    observed_dt: object
    source_ids: list[str] = field(default_factory=list)


class Lineage:
    """Immutable versions of centers and the events that made them, arrival batch by arrival batch."""

    RANK = {"formed": 0, "extended": 1, "expanded_up": 2, "reorganized": 3}

    def __init__(self, units: Sequence[ConfirmedUnit], as_of, level: int, upper_level: int | None = None):
        if upper_level == level:
            raise ValueError("upper_level must differ from level")
        self.units, self.level, self.upper = visible_units(units, as_of, level), level, upper_level
        if upper_level is not None and self.units and self.units[0].level == upper_level:
            raise ValueError("upper_level must differ from the units' level")
        self.versions: list[CenterVersion] = []
        self.events: list[CenterEvent] = []
        self.spans: dict[str, tuple[int, int]] = {}
        self.current: dict[str, CenterVersion] = {}
        self.last: str | None = None
        self.nine: set[str] = set()
        n = len(self.units)
        for stop in range(1, n + 1):
            if stop == n or self.units[stop].confirmed_dt != self.units[stop - 1].confirmed_dt:
                self._batch(stop)

    def _batch(self, stop: int) -> None:
        self.now, self.fresh = self.units[stop - 1].confirmed_dt, []
        for move in decompose([u.unit for u in self.units[:stop]], extend=True):
            for first, formed, end in move.spans:
                self._see(first, formed, end)
        self.events += sorted(self.fresh, key=lambda e: (self.RANK[e.kind], e.center_id))

    def _see(self, first: int, formed: int, end: int) -> None:
        name = f"L{self.level}:{self.units[first].move_id}"
        if name not in self.spans:
            v = self._version(name, first, formed, 0)
            before = self.current.get(self.last) if self.last else None
            how = self._relation(before, v)
            self.fresh.append(CenterEvent("formed", name, 0, self.last, how, self.now))
            if how == "higher_level" and self.upper is not None:
                self._upper(f"L{self.upper}:{before.unit_ids[0]}+{v.unit_ids[0]}", self.units[self.spans[self.last][0] : formed + 1], (max(before.dd, v.dd), min(before.gg, v.gg), max(before.gg, v.gg), min(before.dd, v.dd)), "expanded_up", [before.center_id, name])
            self.last, self.spans[name] = name, (first, formed)
        if end < self.spans[name][1]:
            raise ValueError("a center shrank")
        if end > self.spans[name][1]:
            v = self._version(name, first, end, self.current[name].version + 1)
            self.fresh.append(CenterEvent("extended", name, v.version, None, None, self.now))
            self.spans[name] = (first, end)
        if self.upper is not None and end - first >= 8 and name not in self.nine:
            self.nine.add(name)
            held = self.units[first : first + 9]
            triples = [wave(held[i : i + 3]) for i in (0, 3, 6)]
            zd, zg = max(x[0] for x in triples), min(x[1] for x in triples)
            if zd <= zg:
                low, high = wave(held)
                self._upper(f"L{self.upper}:nine:{held[0].move_id}", held, (zd, zg, high, low), "reorganized", [name])

    def _version(self, name: str, first: int, end: int, version: int) -> CenterVersion:
        held = self.units[first : end + 1]
        side = held[0].unit.direction
        own = [u for u in held if u.unit.direction == side] if side in ("up", "down") else held
        dd, gg = wave(own)
        zd, zg = max(u.unit.low for u in held[:3]), min(u.unit.high for u in held[:3])
        v = CenterVersion(name, self.level, version, zd, zg, gg, dd, [u.move_id for u in held], self.now)
        self.versions.append(v)
        self.current[name] = v
        return v

    def _upper(self, name: str, held, box, kind: str, sources: list[str]) -> None:
        self.versions.append(CenterVersion(name, self.upper, 0, *box, [u.move_id for u in held], self.now))
        self.fresh.append(CenterEvent(kind, name, 0, None, None, self.now, sources))

    @staticmethod
    def _relation(a: CenterVersion | None, b: CenterVersion) -> str | None:
        if a is None:
            return None
        if b.gg < a.dd:
            return "down_continue"
        if b.dd > a.gg:
            return "up_continue"
        return "higher_level" if b.zg < a.zd or b.zd > a.zg else "overlap"

    def snapshot(self, center_id: str, version: int) -> CenterVersion:
        for v in self.versions:
            if (v.center_id, v.version) == (center_id, version):
                return v
        raise KeyError((center_id, version))

    def dot(self, title: str = "centers") -> str:
        """A Graphviz text: a node per center, edges for what formed after what, loops for extensions."""
        quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
        lines = [f"digraph {quote(title)} {{"]
        first = {v.center_id: v for v in self.versions if v.version == 0}
        for name in sorted(first):
            v = first[name]
            lines.append(f"  {quote(name)} [label={quote(f'{v.level} {v.zd:g}~{v.zg:g}')}];")
        counts: dict[str, int] = {}
        for e in self.events:
            if e.kind == "formed" and e.previous_id:
                lines.append(f"  {quote(e.previous_id)} -> {quote(e.center_id)} [label={quote(e.relation)}];")
            elif e.kind == "extended":
                counts[e.center_id] = counts.get(e.center_id, 0) + 1
            for s in e.source_ids:
                lines.append(f"  {quote(s)} -> {quote(e.center_id)} [label={quote(e.kind)}];")
        lines += [f"  {quote(name)} -> {quote(name)} [label={quote(f'extended x{n}')}];" for name, n in sorted(counts.items())]
        return "\n".join([*lines, "}"])


# Layers: what finer units say inside a parent's leave. ------------------------------------------------------------------


@dataclass
class ChainLevel:
    depth: int
    level: int
    status: str
    center: tuple[float, float] | None = None
    forces: tuple[float, float] | None = None
    confirmed_dt: object = None
    dt: object = None
    price: float | None = None
    reference_ids: list[str] = field(default_factory=list)
    leave_ids: list[str] = field(default_factory=list)


def parent_leave(verdict: Verdict, units: Sequence[ConfirmedUnit], as_of, level: int) -> list[ConfirmedUnit]:
    known = {u.move_id: u for u in visible_units(units, as_of, level)}
    if any(i not in known for i in verdict.leave_ids):
        raise ValueError("the leave is not visible")
    return [known[i] for i in verdict.leave_ids]


def read_layer(units: Sequence[ConfirmedUnit], sign: int, force: Force | None) -> tuple[str, Legs | None, tuple[float, float] | None, tuple[float, float] | None]:
    """(status, legs, center, forces) of the last center of a finer layer that fills a parent's leave."""
    held = [m for m in decompose([u.unit for u in units], extend=True) if m.spans]
    if not held:
        return "no_sub_center", None, None, None
    move, against = held[-1], "down" if sign > 0 else "up"
    tails = [next((i for i in range(span[2], span[1] - 1, -1) if net(units[i]) == against), None) for span in move.spans[-2:]]
    begin = move.first if len(move.spans) == 1 else None if tails[0] is None else tails[0] + 1
    if tails[-1] is None or begin is None:
        return "no_compare_legs", None, None, None
    span = move.spans[-1]
    whole = list(units[: tails[-1] + 1])
    legs = Legs(sign, [], [], list(units[begin : span[0]]), list(units[tails[-1] + 1 :]), whole, span)
    if not legs.reference or not legs.leave:
        return "no_compare_legs", None, None, None
    center = move.centers[-1]
    if not legs.ahead(legs.edge(legs.leave), legs.edge(whole)):
        return "no_new_extreme", legs, center, None
    forces = force(legs.reference, legs.leave) if force else None
    if forces is None:
        return "force_unavailable" if force else "force_missing", legs, center, None
    return ("bc" if forces[1] < forces[0] else "force_not_declining"), legs, center, forces


def nested_chain(verdict: Verdict, units: Sequence[ConfirmedUnit], layers: Sequence[tuple[int, Sequence[ConfirmedUnit]]], as_of, level: int, force: Force | None = None) -> tuple[list[ChainLevel], tuple[object, float] | None]:
    """Finer and finer layers of a verdict's leave, until one contradicts or cannot say; the innermost agreeing turn.

    level is the parent's; each layer names its units' level and must exactly fill the interval above it.
    """
    leave = parent_leave(verdict, units, as_of, level)
    sign, out = (1 if verdict.kind == "sell1" else -1), []
    upper = level
    for depth, (name, finer) in enumerate(layers if verdict.status != "rejected" else [], 1):
        held = visible_units(finer, as_of, upper)
        if held and held[0].level != name:
            raise ValueError("a layer's units are of another level")
        inside = [u for u in held if leave[0].unit.start_dt <= u.unit.start_dt and u.unit.end_dt <= leave[-1].unit.end_dt]
        covers = inside and inside[0].unit.start_dt == leave[0].unit.start_dt and inside[-1].unit.end_dt == leave[-1].unit.end_dt
        if not covers:
            out.append(ChainLevel(depth, name, "not_covered", confirmed_dt=inside[-1].confirmed_dt if inside else None))
            break
        if inside[0].unit.start != leave[0].unit.start or inside[-1].unit.end != leave[-1].unit.end:
            raise ValueError("a layer does not meet the prices above it")
        status, legs, center, forces = read_layer(inside, sign, force)
        row = ChainLevel(depth, name, status, center, forces, inside[-1].confirmed_dt)
        if legs is not None:
            row.dt, row.price = legs.leave[-1].unit.end_dt, legs.edge(legs.leave)
            row.reference_ids, row.leave_ids = [u.move_id for u in legs.reference], [u.move_id for u in legs.leave]
        out.append(row)
        if status not in ("bc", "force_missing", "force_unavailable"):
            break
        leave, upper = legs.leave, name
    turn = next(((r.dt, r.price) for r in reversed(out) if r.status == "bc"), None)
    return out, turn


def completion_cascade(verdict: Verdict, units: Sequence[ConfirmedUnit], layers: Sequence[tuple[int, Sequence[ConfirmedUnit]]], as_of, level: int) -> list[tuple[int, str, str, object]]:
    """(level, unit, status, confirmed_dt) per layer: is the last unit above exactly a completed move of finer units?"""
    top, out = parent_leave(verdict, units, as_of, level)[-1], []
    for name, finer in layers:
        held = visible_units(finer, as_of, top.level)
        at = next((i for i, u in enumerate(held) if u.unit.start_dt == top.unit.start_dt), None)
        match = None
        if at is None:
            status = "unverified" if any(u.unit.end_dt > top.unit.start_dt for u in held) else "not_covered"
        else:
            if held[at].unit.start != top.unit.start:
                raise ValueError("a layer does not meet the prices above it")
            done = confirm_levels(held[at:], as_of, top.level)
            match = next((m for m in done if (m.start_dt, m.end_dt, m.start, m.end) == (top.unit.start_dt, top.unit.end_dt, top.unit.start, top.unit.end)), None)
            status = "confirmed" if match else "unverified"
        out.append((name, top.move_id, status, match.confirmed_dt if match else None))
        if match is None:
            break
        top = next(u for u in held if u.move_id == match.unit_ids[-1])
    return out
