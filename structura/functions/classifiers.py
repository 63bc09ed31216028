"""Classifiers as CASE expressions. Code words are the protocol's fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intervals import finite, touches


def macd_below_zero(dif: Column, dea: Column) -> Column:
    """Both below zero; null where either is unknown, whatever the other says."""
    a, b = finite(dif), finite(dea)
    return F.when(a.isNotNull() & b.isNotNull(), (a < 0) & (b < 0))


def boll_state(close: Column, upper: Column, lower: Column) -> Column:
    return F.when(upper.isNotNull() & lower.isNotNull(), F.when(close > upper, "super_up").when(close < lower, "super_down").otherwise("normal"))


def _code(d, e) -> Column:
    return F.struct(F.lit(d).cast("int").alias("d"), F.lit(e).cast("int").alias("e"))


def bi_state(direction: Column, forming: Column) -> Column:
    """(d, e): d is the side of the stroke in force, e whether it still runs (1) or a fractal forms against it (0)."""
    turned = ((direction == "up") & (forming == "bottom")) | ((direction == "down") & (forming == "top"))
    side = F.when(direction == "up", 1).when(direction == "down", -1)
    legal = direction.isin("up", "down") & (forming.isNull() | forming.isin("top", "bottom"))
    d = F.when(F.coalesce(turned, F.lit(False)), -side).otherwise(side).cast("int")
    e = F.when(forming.isNull() | turned, 1).otherwise(0).cast("int")
    return F.when(legal, F.struct(d.alias("d"), e.alias("e")))


def _is_code(d: Column, e: Column) -> Column:
    return F.coalesce(d.isin(1, -1) & e.isin(0, 1), F.lit(False))


def bi_transition_valid(d: Column, e: Column, next_d: Column, next_e: Column) -> Column:
    """A running stroke can only meet a forming fractal; that ends in a running stroke of either side."""
    known = _is_code(d, e) & _is_code(next_d, next_e)
    return F.when(known, F.when(e == 1, (next_d == d) & (next_e == 0)).otherwise(next_e == 1)).otherwise(False)


def disease_stage(hd: Column, he: Column, ld: Column, le: Column, trend: Column) -> Column:
    """Where the higher and the lower period stand against a trend (1 or -1)."""
    with_trend = (
        F.when((he == 1) & (ld == trend), F.when(le == 1, "healthy").otherwise("warning")).when(he == 1, "prodromal").when(ld == trend, "critical").otherwise("onset")
    )
    against = (
        F.when(ld == trend, "recovering").when(he == 1, F.when(le == 1, "sick_worst").otherwise("sick_second")).otherwise(F.when(le == 1, "sick_third").otherwise("turn_window"))
    )
    legal = _is_code(hd, he) & _is_code(ld, le) & F.coalesce(trend.isin(1, -1), F.lit(False))
    return F.when(legal, F.when(hd == trend, with_trend).otherwise(against))


SEVERITY_RANKS = {"sick_worst": 1, "sick_second": 2, "sick_third": 3, "turn_window": 4}


def severity_rank(stage: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANKS.items():
        out = F.when(stage == name, rank).otherwise(out)
    return out.cast("int")


def followup_quality(zd: Column, zg: Column, low: Column, high: Column, direction: Column) -> Column:
    """strong if the follow-up touches the center; outside it, reverse on the trend's side and weak on the other."""
    a, b = F.least(zd, zg), F.greatest(zd, zg)
    lo, hi = F.least(low, high), F.greatest(low, high)
    return F.when(touches(lo, hi, a, b), "strong").when(((direction == "up") & (lo > b)) | ((direction == "down") & (hi < a)), "reverse").otherwise("weak")


def center_health(previous: Column, zd: Column, zg: Column) -> Column:
    """previous: array of (zd, zg), oldest first. healthy if the new center meets the last, dangerous if an earlier, else extreme."""
    meets = lambda c: touches(zd, zg, c["zd"], c["zg"])
    n = F.size(previous)
    return F.when(n > 0, F.when(meets(F.element_at(previous, -1)), "healthy").when(F.exists(F.slice(previous, 1, F.greatest(n - 1, F.lit(0))), meets), "dangerous").otherwise("extreme"))


def kiss_kind(crossings: Column, min_gap: Column, peak_gap: Column, proximity: float = 0.5) -> Column:
    return F.when(crossings > 0, "wet").when(min_gap <= proximity * peak_gap, "lip").otherwise("fly")


def turn_class(zd: Column, zg: Column, gg: Column, dd: Column, pull: Column, trend: Column) -> Column:
    """Where the first pull after a divergence reaches: back to the core, to the waves, or not even there."""
    down = F.when(pull >= zd, "turn").when(pull >= dd, "expansion").otherwise("sub_floor")
    up = F.when(pull <= zg, "turn").when(pull <= gg, "expansion").otherwise("sub_floor")
    return F.when(trend == "down", down).when(trend == "up", up)


def rebound_gap(gg: Column, dd: Column, price: Column, trend: Column) -> Column:
    """How far a price lies beyond the waves, relative to their edge; null where the edge is not positive."""
    return F.when((trend == "down") & (dd > 0), (dd - price) / dd).when((trend == "up") & (gg > 0), (price - gg) / gg)


def minor_turn_stage(tri_low: Column, tri_high: Column, counter_low: Column, counter_high: Column, trend: Column, sub_zd: Column, sub_zg: Column, sub_bs3: Column) -> Column:
    """How far a counter move has come. Priority: past the third point's pull, a sub-level third point, clear of the sub-center, within."""
    up = F.when(counter_low <= tri_high, "breakout").when(sub_bs3, "sub_bs3").when(counter_low > sub_zg, "strong").otherwise("within")
    down = F.when(counter_high >= tri_low, "breakout").when(sub_bs3, "sub_bs3").when(counter_high < sub_zd, "strong").otherwise("within")
    return F.when(trend == "up", up).when(trend == "down", down)


def fractal_power(bars: list[dict[str, Column]], direction: Column, long_body: float = 0.35, small_body: float = 0.15, shadow: float = 0.25) -> Column:
    """Power of a three-bar fractal; bodies and the middle shadow are measured against the three bars' range.

    Bottoms are read in a mirrored frame (prices negated, high and low swapped), so only tops are spelled out.
    """
    if not 0 <= small_body < long_body <= 1 or not 0 < shadow <= 1:
        raise ValueError("0 <= small_body < long_body <= 1 and 0 < shadow <= 1 are needed")
    top = direction == "top"
    frame = lambda x: {n: F.when(top, x[n]).otherwise(-x[m]) for n, m in (("open", "open"), ("close", "close"), ("high", "low"), ("low", "high"))}
    a, b, c = map(frame, bars)
    height = F.greatest(a["high"], b["high"], c["high"]) - F.least(a["low"], b["low"], c["low"])
    safe = F.when(height > 0, height)
    body = lambda x: F.abs(x["close"] - x["open"]) / safe
    middle = lambda x: (x["high"] + x["low"]) / 2
    rises, falls = (lambda x: x["close"] > x["open"]), (lambda x: x["close"] < x["open"])
    covers = lambda x, y: (x["high"] >= y["high"]) & (x["low"] <= y["low"])
    contained = covers(a, b) | covers(b, a) | covers(b, c) | covers(c, b)
    wick = F.greatest(F.lit(0.0), b["high"] - F.greatest(b["open"], b["close"])) / safe
    severe = ~contained & (c["low"] < a["low"]) & (c["close"] <= middle(a))
    strong = ((wick >= shadow) | (falls(b) & (body(b) >= long_body))) & ~(rises(c) & (c["close"] > middle(b)))
    weak = rises(a) & (body(a) >= long_body) & (body(b) <= small_body) & (body(c) <= small_body)
    eaten = lambda x, y: rises(x) & falls(y) & covers(y, x) & (body(y) >= long_body)
    return (
        F.when(height <= 0, "neutral").when(severe, "severe").when(strong, "strong").when(eaten(a, b) | eaten(b, c), "strong").when(weak, "weak").otherwise("neutral")
    )
