"""Grouped operators: the folds of `series`, run once per (symbol, freq) over Arrow, and their projections.

One pass emits every record type as rows of one wide table; the named projections filter it. The recursion needs its
series in order, so a series is one task; symbols and periods spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS, MAX_LEVELS
from ..sources import bars as sources
from . import averages, base_chain, causal, ma_candidates, moves, segments, series

FIELDS = {
    "record": "string", "idx": "int", "direction": "string", "kind": "string", "start_index": "int", "end_index": "int", "start_dt": "timestamp_ntz", "end_dt": "timestamp_ntz",
    "start_value": "double", "end_value": "double", "low": "double", "high": "double", "zd": "double", "zg": "double", "gg": "double", "dd": "double", "n": "int", "mode": "int",
    "complete": "boolean", "evidence_index": "int", "evidence_dt": "timestamp_ntz", "first": "int", "last": "int", "level": "int", "relation": "string", "ratio": "double",
}
RECORDS = ("merged", "stroke", "segment", "stroke_center", "segment_center", "center_event", "same_level", "level_up", "level_unit", "point")
UNIT_RECORDS = ("segment", "stroke_center", "segment_center", "center_event", "same_level", "level_up", "level_unit")
_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us")}
_BATCH = 20_000
_BAR_FIELDS = ["dt", "open", "high", "low", "close", "volume"]


def _schema(fields: dict[str, str], keys: list[str]) -> str:
    return ", ".join([*(f"`{k}` string" for k in keys), *(f"`{n}` {t}" for n, t in fields.items())])


def per_series(bars: DataFrame, fold: Callable[..., Iterator[dict]], fields: dict[str, str], keys: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Run a fold over each series in order of seq; it yields one dict per output row. Only `columns` are shuffled.

    Rows leave the fold in batches, so that a long series' records are never held at once.
    """
    keys = keys or KEYS
    columns = columns or _BAR_FIELDS

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = pa.Table.from_batches(batches).sort_by("seq")
        found = iter(fold(*(ordered.column(c).to_pylist() for c in columns)))
        while rows := list(islice(found, _BATCH)):
            arrays = [pa.array([key[i].as_py()] * len(rows), pa.string()) for i in range(len(keys))]
            arrays += [pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in fields.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *fields])

    return bars.select(*keys, "seq", *columns).groupBy(*keys).applyInArrow(run, _schema(fields, keys))


def _unit_row(record: str, idx: int, u: base_chain.Unit) -> dict:
    return {"record": record, "idx": idx, "direction": u.direction, "start_index": u.start_index, "end_index": u.end_index, "start_dt": u.start_dt, "end_dt": u.end_dt, "start_value": u.start, "end_value": u.end, "low": u.low, "high": u.high}


def _center_row(record: str, idx: int, units: list[base_chain.Unit], c: base_chain.Center) -> dict:
    gg, dd = base_chain.waves(units, c)
    a, b = units[c.first], units[c.last]
    return {"record": record, "idx": idx, "direction": a.direction, "start_dt": a.start_dt, "end_dt": b.end_dt, "zd": c.zd, "zg": c.zg, "gg": gg, "dd": dd, "n": c.last - c.first + 1, "first": c.first, "last": c.last, "complete": c.left is not None}


def _segment_records(strokes, parts, units, wanted: set[str]) -> Iterator[dict]:
    for k, (g, u) in enumerate(zip(parts, units) if "segment" in wanted else ()):
        proof = None if g.evidence is None else strokes[g.evidence]
        yield _unit_row("segment", k, u) | {"mode": g.mode, "complete": proof is not None, "evidence_index": proof and proof.end_index, "evidence_dt": proof and proof.end_dt, "first": g.first, "last": g.last}


def _unit_records(strokes, segment_units, stroke_centers, segment_centers, wanted: set[str], max_levels: int) -> Iterator[dict]:
    for name, units, centers in (("stroke_center", strokes, stroke_centers), ("segment_center", segment_units, segment_centers)):
        for k, c in enumerate(centers if name in wanted else ()):
            yield _center_row(name, k, units, c)
    for k, e in enumerate(base_chain.center_events(strokes, stroke_centers) if "center_event" in wanted else ()):
        u = strokes[e["unit"]]
        yield {"record": "center_event", "idx": k, "kind": e["event"], "first": e["center"], "last": e["unit"], "end_dt": u.end_dt, "relation": e.get("relation"), "zd": e.get("zd"), "zg": e.get("zg"), "n": e.get("n")}
    for rule, extend in (("same_level", False), ("level_up", True)):
        for k, m in enumerate(moves.decompose(strokes, extend) if rule in wanted else ()):
            yield {"record": rule, "idx": k, "kind": m.kind, "complete": m.complete, "direction": m.direction, "first": m.first, "last": m.last, "low": m.low, "high": m.high, "start_dt": strokes[m.first].start_dt, "end_dt": strokes[m.last].end_dt, "n": len(m.centers), "zd": m.centers[-1][0] if m.centers else None, "zg": m.centers[-1][1] if m.centers else None}
    for level, units in enumerate(moves.level_chain(strokes, max_levels) if "level_unit" in wanted else (), 1):
        for k, u in enumerate(units):
            yield _unit_row("level_unit", k, u) | {"kind": u.kind, "level": level}


def structure(bars: DataFrame, min_gap: int | None = None, standard: str = "81", max_levels: int = MAX_LEVELS, keys: list[str] | None = None, records: set[str] | None = None) -> DataFrame:
    """Every record of the batch entry, or those named: only they are folded and leave the fold."""
    series.min_gap_of(standard, min_gap)
    if unknown := set(records or ()) - set(RECORDS):
        raise ValueError(f"unknown records: {sorted(unknown)}")
    wanted = set(RECORDS) if records is None else set(records)

    def fold(dt, open_, high, low, close, volume) -> Iterator[dict]:
        b = series.Bars(dt, open_, high, low, close, volume)
        s = series.read_structure(b, min_gap, standard, strokes=wanted != {"merged"}, segments=bool(wanted & {"segment", "segment_center"}))
        for k, m in enumerate(s.merged if "merged" in wanted else ()):
            yield {"record": "merged", "idx": k, "start_index": m.first, "end_index": m.last, "start_dt": dt[m.first], "end_dt": dt[m.last], "low": m.low, "high": m.high, "start_value": open_[m.first], "end_value": close[m.last], "n": m.last - m.first + 1}
        for k, u in enumerate(s.strokes if "stroke" in wanted else ()):
            yield _unit_row("stroke", k, u)
        yield from _segment_records(s.strokes, s.segments, s.segment_units, wanted)
        yield from _unit_records(s.strokes, s.segment_units, s.stroke_centers, s.segment_centers, wanted, max_levels)
        for k, p in enumerate(series.points_of(b, s) if "point" in wanted else ()):
            yield {"record": "point", "idx": k, "kind": f"{p['side']}{p['type']}", "end_dt": p["dt"], "end_value": p["price"], "first": p["center"], "ratio": p["ratio"]}

    return per_series(bars, fold, FIELDS, keys)


def analyze_available(bars: DataFrame, grid: DataFrame, **options) -> DataFrame:
    """The batch entry at every observation of a grid (keys, observed): structure of what had arrived by then, with the column observed.

    bars have closed_dt and available_dt; options are those of `structure`. Each observation of each series is a task's group.
    """
    seen = sources.observed_bars(bars, grid)
    found = structure(seen.withColumn("observed", F.col("observed").cast("string")), keys=[*KEYS, "observed"], **options)
    return found.withColumn("observed", F.col("observed").cast("timestamp_ntz"))


def structure_of_strokes(strokes: DataFrame, max_levels: int = MAX_LEVELS, records: set[str] | None = None) -> DataFrame:
    """The records that strokes alone decide: segments, centers, moves, levels. A series' strokes, not its bars, meet in one task."""
    wanted = set(UNIT_RECORDS) if records is None else set(records)
    if unknown := wanted - set(UNIT_RECORDS):
        raise ValueError(f"strokes do not decide: {sorted(unknown)}")
    columns = ["direction", "start_value", "end_value", "start_index", "end_index", "low", "high", "start_dt", "end_dt"]

    def fold(*read) -> Iterator[dict]:
        found = [base_chain.Unit(*row) for row in zip(*read)]
        parts = segments.segments_of(found) if wanted & {"segment", "segment_center"} else []
        units = series.segment_units(found, parts)
        yield from _segment_records(found, parts, units, wanted)
        yield from _unit_records(found, units, base_chain.centers_of(found), base_chain.centers_of(units), wanted, max_levels)

    return per_series(strokes.withColumnRenamed("idx", "seq"), fold, FIELDS, columns=columns)


def project(table: DataFrame, record: str, *columns: str) -> DataFrame:
    return table.where(F.col("record") == record).select(*[c for c in KEYS if c in table.columns], *columns)


PREMISED = {
    "record": "string", "segment": "int", "stroke": "int", "first": "int", "last": "int", "mode": "int", "kind": "string", "state": "string", "standing": "string",
    "proof": "int", "published": "int", "reaction_first": "int", "reaction_stop": "int",
}


def first_meeting(strokes: DataFrame) -> DataFrame:
    """Per series the first stroke that shares a price with the two after it: (keys, first, direction, price). Series without one give no row."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    three = lambda c, f: f(c, F.lead(c, 1).over(w), F.lead(c, 2).over(w))
    meet = strokes.select(*KEYS, "idx", "direction", "start_value", (three("low", F.greatest) <= three("high", F.least)).alias("meet"), F.lead("idx", 2).over(w).alias("third"))
    first = F.min_by(F.struct(F.col("idx").alias("first"), "direction", F.col("start_value").alias("price")), "idx").alias("s")
    return meet.where(F.col("meet") & F.col("third").isNotNull()).groupBy(*KEYS).agg(first).select(*KEYS, "s.*")


def premised_segments(strokes: DataFrame, premises: DataFrame) -> DataFrame:
    """Segments and certificates of each series under each of its premises.

    strokes: (keys, idx, direction, start_value, end_value, low, high); premises: (keys, premise, basis, first, direction,
    price, known_at). record `segment` has the strokes first..last and in proof the stroke from which all it rests on is known;
    `certificate` the state of the race about a reversal at a stroke; `refused`, in kind, why a premise does not hold for its
    series: the others go on. A series without premise gives nothing.
    """
    units = strokes.select(*KEYS, "idx", *(F.col(c).alias(f"u_{c}") for c in ("direction", "start_value", "end_value", "low", "high")))

    def run(key, table):
        table = table.sort_by("idx")
        read = [table.column(f"u_{c}").to_pylist() for c in ("direction", "start_value", "end_value", "low", "high")]
        found = [base_chain.Unit(d, a, b, i, i + 1, low, high) for i, (d, a, b, low, high) in enumerate(zip(*read))]
        told = segments.Premise(*(table.column(c)[0].as_py() for c in segments.Premise._fields))
        rows = []
        try:
            parts, states = segments.premised_segments(found, told)
            rows += [{"record": "segment", "segment": i, "first": s.first, "last": s.last, "mode": s.mode, "proof": s.evidence} for i, s in enumerate(parts)]
            for i, stroke, c in states:
                reaction = {} if c.reaction is None else {"reaction_first": c.reaction.first, "reaction_stop": c.reaction.stop}
                rows.append({"record": "certificate", "segment": i, "stroke": stroke, "kind": c.kind, "state": c.state, "standing": c.standing, "proof": c.proof, "published": c.published} | reaction)
        except ValueError as why:
            rows = [{"record": "refused", "segment": 0, "kind": str(why)}]
        arrays = [pa.array([k.as_py()] * len(rows), pa.string()) for k in key]
        return pa.Table.from_arrays(arrays + [pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in PREMISED.items()], names=[*KEYS, "premise", *PREMISED])

    told = premises.select(*KEYS, "premise", "basis", F.col("first").cast("int"), "direction", F.col("price").cast("double"), F.col("known_at").cast("int"))
    return units.join(told, KEYS).groupBy(*KEYS, "premise").applyInArrow(run, _schema(PREMISED, [*KEYS, "premise"]))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """seq, dt, ema of the fast period, dif, dea and the doubled histogram per bar."""
    fields = {"seq": "int", "dt": "timestamp_ntz", "ema_fast": "double", "dif": "double", "dea": "double", "hist": "double"}

    def fold(dt, close) -> Iterator[dict]:
        dif, dea, hist = averages.macd(close, fast, slow, signal)
        for k, row in enumerate(zip(dt, averages.ema(close, fast), dif, dea, hist)):
            yield dict(zip(fields, (k, *row)))

    return per_series(bars, fold, fields, columns=["dt", "close"])


KISS = {
    "kind": "string", "direction": "string", "start": "int", "end": "int", "leg_start": "int", "kiss_index": "int", "peak_gap": "double", "min_gap": "double", "depth": "double", "crossings": "int",
    "resumed": "boolean", "open": "boolean", "pre_gain": "double", "vol_leg": "double", "vol_kiss": "double", "vol_prior": "double",
}


def kisses(lines: DataFrame, proximity: float = 0.5, min_depth: float = 0.2, flip_confirm: float = 0.5) -> DataFrame:
    """lines (seq, short, long, volume): contacts of two averages."""

    def fold(short, long, volume) -> Iterator[dict]:
        for k in averages.find_kisses(short, long, volume, proximity, min_depth, flip_confirm):
            yield {n: getattr(k, n) for n in KISS}

    return per_series(lines, fold, KISS, columns=["short", "long", "volume"])


def band_turns(bands: DataFrame, run: int = 2) -> DataFrame:
    """bands (seq, upper, lower): where a band turns."""
    return per_series(bands, lambda up, low: ({"at": i, "event": e} for i, e in averages.band_turns(up, low, run)), {"at": "int", "event": "string"}, columns=["upper", "lower"])


def reentry_hints(bands: DataFrame) -> DataFrame:
    """bands (seq, close, state): hints after a stay outside the bands."""
    return per_series(bands, lambda c, st: ({"at": i, "hint": h} for i, h in averages.reentry_hints(c, st)), {"at": "int", "hint": "string"}, columns=["close", "state"])


def transition_phase(units: DataFrame) -> DataFrame:
    """units (seq, low, high): the phase of each series."""
    fields = {"stage": "string", "zd": "double", "zg": "double", "n": "int", "direction": "string", "last_event": "string", "consumed_from": "int", "consumed_to": "int"}

    def fold(low, high) -> Iterator[dict]:
        p = averages.transition_phase(low, high)
        zd, zg = p.center or (None, None)
        yield {"stage": p.stage, "zd": zd, "zg": zg, "n": p.count, "direction": p.direction, "last_event": p.events[-1][1] if p.events else None, "consumed_from": p.consumed[0], "consumed_to": p.consumed[1]}

    return per_series(units, fold, fields, columns=["low", "high"])


LEDGER = {"kind": "string", "field": "string", "identity": "string", "first_seen": "timestamp_ntz", "observed": "timestamp_ntz", "before": "string", "after": "string"}


def replay_ledger(bars: DataFrame, step: int = 1, min_gap: int | None = None, standard: str = "81") -> DataFrame:
    """Changes of fractals, strokes and points as each step-th bar (counted from the last) becomes visible."""

    def fold(*columns) -> Iterator[dict]:
        for c in series.replay_prefixes(series.Bars(*columns), step, min_gap, standard):
            yield {n: getattr(c, n) for n in LEDGER}

    return per_series(bars, fold, LEDGER)


def replay_arrivals(bars: DataFrame, step: int = 1, min_gap: int | None = None, standard: str = "81") -> DataFrame:
    """As replay_ledger, but bars become visible at available_dt, and confirmed strokes, segments and centers are recorded."""

    def fold(*columns) -> Iterator[dict]:
        *values, arrived = columns
        grid = sorted(set(arrived))
        grid = [at for k, at in enumerate(grid) if (len(grid) - 1 - k) % step == 0]

        def observed():
            for at in grid:
                keep = [i for i, x in enumerate(arrived) if x <= at]
                yield at, series.Bars(*([v[i] for i in keep] for v in values))

        for c in series.replay(series.Bars(*values), observed(), True, min_gap, standard):
            yield {n: getattr(c, n) for n in LEDGER}

    return per_series(bars, fold, LEDGER, columns=[*_BAR_FIELDS, "available_dt"])


def confirmed_moves(units: DataFrame, as_of, next_level: int = 2) -> DataFrame:
    """units (seq, move_id, level, direction, start_value, end_value, low, high, start_dt, end_dt, confirmed_dt): moves one level up."""
    fields = {
        "move_id": "string", "level": "int", "kind": "string", "direction": "string", "net": "string", "start_dt": "timestamp_ntz", "end_dt": "timestamp_ntz", "start_value": "double", "end_value": "double",
        "low": "double", "high": "double", "confirmed_dt": "timestamp_ntz", "n_units": "int", "n_evidence": "int", "n_centers": "int",
    }

    def fold(*columns) -> Iterator[dict]:
        held = _held_units(columns)
        for m in moves.confirm_levels(held, as_of, next_level):
            yield {"move_id": m.move_id, "level": m.level, "kind": m.move.kind, "direction": m.move.direction, "net": m.net, "start_dt": m.start_dt, "end_dt": m.end_dt, "start_value": m.start, "end_value": m.end, "low": m.move.low, "high": m.move.high, "confirmed_dt": m.confirmed_dt, "n_units": len(m.unit_ids), "n_evidence": len(m.evidence_ids), "n_centers": len(m.move.centers)}

    return per_series(units, fold, fields, columns=["move_id", "level", "direction", "start_value", "end_value", "low", "high", "start_dt", "end_dt", "confirmed_dt"])


UNIT_COLUMNS = ["move_id", "level", "direction", "start_value", "end_value", "low", "high", "start_dt", "end_dt", "confirmed_dt"]


def _held_units(columns) -> list[moves.ConfirmedUnit]:
    return [moves.ConfirmedUnit(i, lv, base_chain.Unit(d, a, b, k, k + 1, lo, hi, s, e), c) for k, (i, lv, d, a, b, lo, hi, s, e, c) in enumerate(zip(*columns))]


def _last_known(units: list[moves.ConfirmedUnit], as_of):
    return as_of if as_of is not None or not units else units[-1].confirmed_dt


def first_points(units: DataFrame, bars: DataFrame, as_of=None, level: int = 2, ratio: float = 0.005) -> DataFrame:
    """First points and exclusions; each point with the first center after it. Units and bars meet per series."""
    fields = {
        "record": "string", "kind": "string", "context_id": "string", "dt": "timestamp_ntz", "price": "double", "confirmed_dt": "timestamp_ntz", "zd": "double", "zg": "double", "area_reference": "double",
        "area_leave": "double", "zero_axis": "double", "causal_id": "string", "causal_zd": "double", "causal_zg": "double", "causal_dt": "timestamp_ntz",
    }

    def run(key, left, right):
        held = _held_units([left.sort_by("seq").column(c).to_pylist() for c in UNIT_COLUMNS])
        at = _last_known(held, as_of)
        rows_ = right.sort_by("seq")
        keep = [i for i, x in enumerate(rows_.column("available_dt").to_pylist()) if at is not None and x <= at]
        if keep != list(range(len(keep))):
            raise ValueError("visible bars are not a prefix")
        prices = causal.PriceRows(*(rows_.column(c).to_pylist()[: len(keep)] for c in ("dt", "close", "available_dt")))
        points, excluded = causal.first_points(held, prices, at, level, ratio) if held else ([], [])
        out = []
        for p in points:
            after = [i for i, u in enumerate(held) if u.unit.start_dt >= p.dt and u.confirmed_dt <= at]
            boxes = ((i, moves.shared_range([u.unit for u in held], i)) for i in after if i + 2 in after)
            found = next(((i, b) for i, b in boxes if b), None)
            c = {"causal_id": held[found[0]].move_id, "causal_zd": found[1][0], "causal_zg": found[1][1], "causal_dt": held[found[0] + 2].confirmed_dt} if found and found[1][0] < found[1][1] else {}
            out.append({"record": "point", "kind": p.kind, "context_id": f"{p.move_id}:first", "dt": p.dt, "price": p.price, "confirmed_dt": p.confirmed_dt, "zd": p.center[0], "zg": p.center[1], "area_reference": p.area_reference, "area_leave": p.area_leave, "zero_axis": p.zero_axis, **c})
        out += [{"record": "excluded", "context_id": m, "kind": reason} for m, reason in excluded]
        keys = [pa.array([k.as_py()] * len(out), pa.string()) for k in key]
        return pa.Table.from_arrays([*keys, *(pa.array([r.get(n) for r in out], _ARROW[t]) for n, t in fields.items())], names=[*KEYS, *fields])

    left = units.select(*KEYS, "seq", *UNIT_COLUMNS).groupBy(*KEYS)
    right = bars.select(*KEYS, "seq", "dt", "close", "available_dt").groupBy(*KEYS)
    return left.cogroup(right).applyInArrow(run, _schema(fields, KEYS))


def strict_verdicts(units: DataFrame, as_of=None, level: int = 2, force=None, force_method: str | None = None) -> DataFrame:
    """Strict verdicts of trends and the open tail, and what was skipped. force(reference, leave) gives two numbers or None."""
    fields = {"record": "string", "kind": "string", "move_id": "string", "status": "string", "reason": "string", "zd": "double", "zg": "double", "dt": "timestamp_ntz", "price": "double", "n_true": "int", "force_reference": "double", "force_leave": "double"}

    def fold(*columns) -> Iterator[dict]:
        held = _held_units(columns)
        found, skipped = causal.strict_scan(held, _last_known(held, as_of), level, force, force_method) if held else ([], [])
        for v in found:
            zd, zg = v.center or (None, None)
            a, b = v.forces or (None, None)
            yield {"record": "verdict", "kind": v.kind, "move_id": v.move_id, "status": v.status, "reason": v.reason, "zd": zd, "zg": zg, "dt": v.dt, "price": v.price, "n_true": sum(ok is True for _, ok in v.conditions), "force_reference": a, "force_leave": b}
        for m, reason in skipped:
            yield {"record": "skipped", "move_id": m, "reason": reason}

    return per_series(units, fold, fields, columns=UNIT_COLUMNS)


def center_lineage(units: DataFrame, as_of=None, level: int = 2, upper_level: int | None = 3) -> DataFrame:
    """Versions of centers, the events that made them, and one graph text per series."""
    fields = {
        "record": "string", "kind": "string", "center_id": "string", "version": "int", "level": "int", "zd": "double", "zg": "double", "gg": "double", "dd": "double", "n": "int", "confirmed_dt": "timestamp_ntz",
        "previous_id": "string", "relation": "string", "text": "string",
    }

    def fold(*columns) -> Iterator[dict]:
        held = _held_units(columns)
        if not held:
            return
        line = causal.Lineage(held, _last_known(held, as_of), level, upper_level)
        for v in line.versions:
            yield {"record": "version", "center_id": v.center_id, "version": v.version, "level": v.level, "zd": v.zd, "zg": v.zg, "gg": v.gg, "dd": v.dd, "n": len(v.unit_ids), "confirmed_dt": v.confirmed_dt}
        for e in line.events:
            yield {"record": "event", "kind": e.kind, "center_id": e.center_id, "version": e.version, "previous_id": e.previous_id, "relation": e.relation, "confirmed_dt": e.observed_dt}
        yield {"record": "graph", "text": line.dot()}

    return per_series(units, fold, fields, columns=UNIT_COLUMNS)


_MA_COLUMNS = ["dt", "high", "low", "close", "volume", "available_dt"]


def _visible_rows(columns, as_of) -> ma_candidates.Rows:
    rows = ma_candidates.Rows(*columns)
    keep = [i for i, x in enumerate(rows.available_dt) if as_of is None or x <= as_of]
    if keep != list(range(len(keep))) or any(b < a for a, b in zip(rows.available_dt, rows.available_dt[1:])):
        raise ValueError("bars must arrive in order")
    return ma_candidates.Rows(*(c[: len(keep)] for c in columns))


def ma_points(bars: DataFrame, as_of=None, settings: ma_candidates.Settings = ma_candidates.Settings()) -> DataFrame:
    """Candidates of the first and second kind from two averages."""
    fields = {"kind": "string", "dt": "timestamp_ntz", "price": "double", "confirmed_dt": "timestamp_ntz", "pattern": "string", "kiss_kind": "string", "kiss_index": "int"}
    return per_series(bars, lambda *c: iter(ma_candidates.Reader(_visible_rows(c, as_of), settings).points()), fields, columns=_MA_COLUMNS)


def ma_point_states(bars: DataFrame, as_of=None, settings: ma_candidates.Settings = ma_candidates.Settings()) -> DataFrame:
    """The revocable snapshot of each series, reasons joined by commas."""

    def fold(*columns) -> Iterator[dict]:
        s = ma_candidates.Reader(_visible_rows(columns, as_of), settings, volumes=False).state()
        yield s | {"reasons": ",".join(s["reasons"])}

    return per_series(bars, fold, {"status": "string", "direction": "string", "reasons": "string"}, columns=_MA_COLUMNS)


def strict_layers(units: DataFrame, as_of=None, level: int = 3, force=None, force_method: str | None = None) -> DataFrame:
    """units with a column layer (0 the coarsest): each verdict of layer 0, its chain and its completion cascade."""
    fields = {"record": "string", "move_id": "string", "depth": "int", "level": "int", "status": "string", "zd": "double", "zg": "double", "dt": "timestamp_ntz", "price": "double", "confirmed_dt": "timestamp_ntz"}

    def fold(layer, *columns) -> Iterator[dict]:
        split: dict[int, list[int]] = {}
        for i, k in enumerate(layer):
            split.setdefault(k, []).append(i)
        held = {k: _held_units([[c[i] for i in at] for c in columns]) for k, at in split.items()}
        if 0 not in held:
            return
        coarse = held.pop(0)
        at = as_of if as_of is not None else max(u.confirmed_dt for part in [coarse, *held.values()] for u in part)
        layers = [(part[0].level, part) for _, part in sorted(held.items())]
        for v in causal.strict_scan(coarse, at, level, force, force_method)[0]:
            yield {"record": "verdict", "move_id": v.move_id, "depth": 0, "level": level, "status": v.status, "dt": v.dt, "price": v.price}
            chain, turn = causal.nested_chain(v, coarse, layers, at, level, force)
            for r in chain:
                zd, zg = r.center or (None, None)
                yield {"record": "chain", "move_id": v.move_id, "depth": r.depth, "level": r.level, "status": r.status, "zd": zd, "zg": zg, "dt": r.dt, "price": r.price, "confirmed_dt": r.confirmed_dt}
            if turn:
                yield {"record": "turn", "move_id": v.move_id, "dt": turn[0], "price": turn[1]}
            for k, (name, unit, status, known) in enumerate(causal.completion_cascade(v, coarse, layers, at, level), 1):
                yield {"record": "completion", "move_id": unit, "depth": k, "level": name, "status": status, "confirmed_dt": known}

    return per_series(units, fold, fields, columns=["layer", *UNIT_COLUMNS])
