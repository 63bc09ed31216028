"""The ledger of fractals and strokes as a stream, with state for the open end of a series only.

A new bar can change the last merged bar, hence the last fractal, hence the last pivot. What lies before the last three
settled pivots stands, so a series' state is its merged bars since then, these pivots and the records that may still
change: it is bounded by the open structure, not by the history. Turning points are not followed here, since every
earlier center takes part in them; `bars.follow` follows them.

A bar that is not later than the last one taken is answered by a row of kind `late` and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import base_chain, series
from ..operators.base_chain import MergedBar
from ..schema import KEYS

OUTPUT = "symbol string, freq string, kind string, field string, identity string, first_seen timestamp, observed timestamp, before string, after string"
_MERGED = "first array<bigint>, last array<bigint>, high array<double>, low array<double>, dt array<timestamp>"
_STATE = f"bars bigint, last_dt timestamp, judged bigint, base bigint, {_MERGED}, kinds array<string>, pivots array<bigint>"
#: Of a record that may change or come back: what it says (null while withdrawn), when it was first seen, and its bar.
_RECORD = "text string, first_seen timestamp, bar bigint"
KEEP = 3


class Tail:
    """Merged bars from position `base` on, the last settled pivots, and the records that later bars can change."""

    def __init__(self, min_gap: int = 3):
        self.min_gap = min_gap
        self.bars, self.last_dt, self.judged, self.base = 0, None, 1, 0
        self.merged: list[MergedBar] = []
        self.dt: list[datetime] = []  # of each merged bar's last bar
        self.settled: list[tuple[str, int]] = []  # positions count from the series' first merged bar
        self.records: dict[tuple[str, str], tuple[str | None, datetime, int]] = {}

    def push(self, dt: datetime, high: float, low: float) -> Iterator[series.Change]:
        before = len(self.merged)
        base_chain.merge_next(self.merged, self.bars, high, low)
        if len(self.merged) > before:
            self.dt.append(dt)
        self.dt[-1], self.last_dt, self.bars = dt, dt, self.bars + 1

        now: dict[tuple[str, str], tuple[str, int]] = {}
        closed = set()
        end = self.base + len(self.merged)
        while self.judged < end - 2:  # its three bars are closed
            if kind := self._kind(self.judged):
                self._take(self.settled, kind, self.judged)
                closed.add(self._note_fractal(now, kind, self.judged))
            self.judged += 1
        chain = self.settled
        if end > 2 and self.judged == end - 2 and (kind := self._kind(end - 2)):
            chain = list(self.settled)
            self._take(chain, kind, end - 2)
            self._note_fractal(now, kind, end - 2)
        for (a_kind, a), (b_kind, b) in zip(chain, chain[1:]):
            self._note_stroke(now, a_kind, a, b_kind, b)
        yield from self._changes(now)
        self._forget(closed)

    def _at(self, k: int) -> MergedBar:
        return self.merged[k - self.base]

    def _kind(self, k: int) -> str | None:
        return base_chain.fractal_at(self.merged, k - self.base) if k - self.base >= 1 else None

    def _take(self, chain: list[tuple[str, int]], kind: str, k: int) -> None:
        local = [(x, at - self.base) for x, at in chain]
        base_chain.pivot_next(local, self.merged, kind, k - self.base, self.min_gap)
        chain[:] = [(x, at + self.base) for x, at in local]

    def _note_fractal(self, now: dict, kind: str, k: int) -> tuple[str, str]:
        a, m, b = self._at(k - 1), self._at(k), self._at(k + 1)
        low, high = (min(a.low, m.low, b.low), m.high) if kind == base_chain.TOP else (m.low, max(a.high, m.high, b.high))
        key = ("fractal", f"{kind}@{m.first}")
        now[key] = f"{self.dt[k - self.base]}|{high!r}|{low!r}|{a.first}-{b.last}", m.first
        return key

    def _note_stroke(self, now: dict, a_kind: str, a: int, b_kind: str, b: int) -> None:
        price = lambda kind, k: self._at(k).high if kind == base_chain.TOP else self._at(k).low
        way = base_chain.UP if b_kind == base_chain.TOP else base_chain.DOWN
        text = f"{self.dt[a - self.base]}|{self.dt[b - self.base]}|{price(a_kind, a)!r}|{price(b_kind, b)!r}"
        now["stroke", f"{way}@{self._at(a).first}"] = text, self._at(a).first

    def _changes(self, now: dict) -> Iterator[series.Change]:
        for key, (text, bar) in now.items():
            held, first, _ = self.records.get(key, (None, self.last_dt, bar))
            if held is None:
                yield series.Change("appeared", *key, first, self.last_dt, None, text)
            elif held != text:
                yield series.Change("revised", *key, first, self.last_dt, held, text)
            self.records[key] = text, first, bar
        for key, (held, first, bar) in list(self.records.items()):
            if held is not None and key not in now:
                yield series.Change("withdrawn", *key, first, self.last_dt, held, None)
                self.records[key] = None, first, bar

    def _forget(self, closed: set) -> None:
        """Drop what no later bar can change: closed fractals, settled pivots but the last, the bars and records before them."""
        for key in closed:
            del self.records[key]
        for (a_kind, a), (b_kind, _) in zip(self.settled, self.settled[1:-(KEEP - 1)]):
            way = base_chain.UP if b_kind == base_chain.TOP else base_chain.DOWN
            self.records.pop(("stroke", f"{way}@{self._at(a).first}"), None)
        self.settled = self.settled[-KEEP:]
        start = min(self.settled[0][1] if self.settled else self.judged - 1, self.judged - 1, self.base + len(self.merged) - 3)
        drop = max(0, start - self.base)
        del self.merged[:drop], self.dt[:drop]
        self.base += drop
        oldest = self.merged[0].first if self.merged else 0
        self.records = {k: r for k, r in self.records.items() if r[0] is not None or r[2] >= oldest}


class TailProcessor(StatefulProcessor):
    def __init__(self, min_gap: int):
        self.min_gap = min_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", _STATE)
        self.open = handle.getMapState("records", "field string, identity string", _RECORD)

    def _load(self) -> Tail:
        tail = Tail(self.min_gap)
        if self.state.exists():
            tail.bars, tail.last_dt, tail.judged, tail.base, first, last, high, low, dt, kinds, pivots = self.state.get()
            tail.merged = [MergedBar(*m) for m in zip(first, last, high, low)]
            tail.dt, tail.settled = list(dt), list(zip(kinds, pivots))
            tail.records = {tuple(k): tuple(r) for k, r in self.open.iterator()}
        return tail

    def _save(self, tail: Tail, held: dict) -> None:
        m = tail.merged
        columns = [[getattr(x, c) for x in m] for c in ("first", "last", "high", "low")]
        self.state.update((tail.bars, tail.last_dt, tail.judged, tail.base, *columns, tail.dt, [k for k, _ in tail.settled], [p for _, p in tail.settled]))
        for key in held.keys() - tail.records.keys():
            self.open.removeKey(key)
        for key, record in tail.records.items():
            if held.get(key) != record:
                self.open.updateValue(key, record)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail = self._load()
        held, out = dict(tail.records), []
        fresh = pd.concat(list(rows)).sort_values("dt", kind="stable")
        for dt, high, low in zip(fresh["dt"].dt.to_pydatetime(), fresh["high"], fresh["low"]):
            if tail.last_dt is not None and dt <= tail.last_dt:
                out.append((*key, "late", "bar", str(dt), None, tail.last_dt, None, None))
                continue
            out += [(*key, c.kind, c.field, c.identity, c.first_seen, c.observed, c.before, c.after) for c in tail.push(dt, float(high), float(low))]
        self._save(tail, held)
        table = pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])
        yield table.astype({"first_seen": "datetime64[us]", "observed": "datetime64[us]"})

    def close(self) -> None:
        pass


def follow_tail(bars: DataFrame, min_gap: int | None = None) -> DataFrame:
    """bars (symbol, freq, dt timestamp, high, low): the ledger of fractals and strokes, as in the batch replay, and late bars.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    processor = TailProcessor(series.min_gap_of("81", min_gap))
    return bars.select(*KEYS, "dt", "high", "low").groupBy(*KEYS).transformWithStateInPandas(processor, OUTPUT, "Append", "None")
