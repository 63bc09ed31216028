"""Indicators and structure queries that need only bounded windows, islands and joins: native Spark throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classifiers, intervals
from ..schema import KEYS, MA_PERIODS, WEDGE_MIN_RUN
from ..sources.scratch import written
from .passage import BlockIndex, Target


def by_seq(*more: str):
    return Window.partitionBy(*KEYS, *more).orderBy("seq")


def rows(before: int, after: int = 0):
    return by_seq().rowsBetween(before, after)


ALL_BEFORE = Window.unboundedPreceding


def exact(c: Column) -> Column:
    """The decimal that a double prints as."""
    return c.cast("string").cast("decimal(28,10)")


def sma(c: Column, n: int) -> Column:
    """Exact-decimal mean of the last n values; null until there are n, and while one is missing."""
    if n < 1:
        raise ValueError("n must be positive")
    w = rows(-(n - 1))
    total = F.sum(exact(c)).over(w).cast("decimal(24,10)")
    return F.when(F.count(c).over(w) == n, (total / F.lit(n).cast("decimal(5,0)")).cast("double"))


def above_sma(close: Column, n: int) -> Column:
    """Whether the close lies above its n-mean, without dividing; null where there is no mean."""
    w = rows(-(n - 1))
    return F.when(F.count(close).over(w) == n, exact(close) * n > F.sum(exact(close)).over(w))


def with_lines(bars: DataFrame, short: int = 5, long: int = 10) -> DataFrame:
    """seq, dt, close, volume and the two averages as short and long."""
    return bars.select(*KEYS, "seq", "dt", "close", "volume", sma(F.col("close"), short).alias("short"), sma(F.col("close"), long).alias("long"))


def distance() -> Column:
    return intervals.finite(F.col("short")) - intervals.finite(F.col("long"))


def fractals(merged: DataFrame) -> DataFrame:
    """merged (keys, idx, low, high, start_index, end_index, end_dt): strict three-bar double extremes."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    near = lambda c: (F.lag(c).over(w), F.col(c), F.lead(c).over(w))
    (h0, h1, h2), (l0, l1, l2) = near("high"), near("low")
    top = (h1 > F.greatest(h0, h2)) & (l1 > F.greatest(l0, l2)) & h0.isNotNull() & h2.isNotNull()
    bottom = (h1 < F.least(h0, h2)) & (l1 < F.least(l0, l2)) & h0.isNotNull() & h2.isNotNull()
    kind = F.when(top, "top").when(bottom, "bottom")
    low = F.when(top, F.least(l0, l1, l2)).otherwise(l1)
    high = F.when(bottom, F.greatest(h0, h1, h2)).otherwise(h1)
    first, last = F.lag("start_index").over(w), F.lead("end_index").over(w)
    out = merged.select(*KEYS, F.col("idx").alias("bar_index"), kind.alias("kind"), F.col("end_dt").alias("dt"), low.alias("low"), high.alias("high"), first.alias("first_bar"), last.alias("last_bar"))
    return out.where("kind is not null")


def gaps(bars: DataFrame) -> DataFrame:
    """Neighbouring bars whose ranges do not meet."""
    w = by_seq()
    h, l, dt = F.lead("high").over(w), F.lead("low").over(w), F.lead("dt").over(w)  # noqa: E741
    up = l > F.col("high")
    out = bars.select(*KEYS, F.col("seq").alias("index_a"), F.when(up, "up").when(h < F.col("low"), "down").alias("direction"), F.when(up, F.col("high")).otherwise(h).alias("lower"), F.when(up, l).otherwise(F.col("low")).alias("upper"), F.col("dt").alias("dt_a"), dt.alias("dt_b"))
    return out.where("direction is not null").withColumn("index_b", F.col("index_a") + 1)


def _filled(gaps_until: DataFrame, bars: DataFrame, size: int = 128) -> DataFrame:
    """Where the bars from index_b + 1 to `until` have covered all of a gap: (keys, index_a, fill_index), null if they leave a piece.

    A gap meets the bars of its time by block of seq, and of these only the ones that reach into it; the covering index is folded over them.
    """
    ids = [*KEYS, "index_a"]
    b = bars.select(*KEYS, F.col("seq").alias("k"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.expr(f"seq div {size}").alias("block"))
    g = gaps_until.select(*ids, "index_b", "lower", "upper", "until", F.explode(F.expr(f"sequence((index_b + 1) div {size}, until div {size})")).alias("block"))
    met = g.join(b, [*KEYS, "block"]).where((F.col("k") > F.col("index_b")) & (F.col("k") <= F.col("until")) & (F.col("lo") <= F.col("upper")) & (F.col("hi") >= F.col("lower")))
    steps = met.groupBy(*ids, "lower", "upper").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "hi"))).alias("steps"))
    piece = "array<struct<a:double,b:double>>"

    def cut(held, x):
        left = F.transform(F.filter(held["open"], lambda p: (p["a"] < x["lo"]) | (x["hi"] < p["a"])), lambda p: F.struct(p["a"].alias("a"), F.when((x["hi"] < p["a"]) | (x["lo"] > p["b"]), p["b"]).otherwise(x["lo"]).alias("b")))
        right = F.transform(F.filter(held["open"], lambda p: (p["a"] <= x["hi"]) & (x["lo"] <= p["b"]) & (x["hi"] < p["b"])), lambda p: F.struct(x["hi"].alias("a"), p["b"].alias("b")))
        open_ = F.concat(left, right).cast(piece)
        return F.when(held["at"].isNotNull(), held).otherwise(F.struct(open_.alias("open"), F.when(F.size(open_) == 0, x["k"]).cast("int").alias("at")))

    start = F.struct(F.array(F.struct(F.col("lower").alias("a"), F.col("upper").alias("b"))).cast(piece).alias("open"), F.lit(None).cast("int").alias("at"))
    return steps.select(*ids, F.aggregate("steps", start, cut, lambda h: h["at"]).alias("fill_index"))


def gap_strength(bars: DataFrame) -> DataFrame:
    """Each gap with where later bars have covered all of it, and whether a new extreme followed.

    No gap is covered before a bar reaches its far edge, which the block index finds; one that none reaches is strong.
    The bars up to there decide nearly all others. Where they jumped over a piece, all later bars do.
    """
    ids = [*KEYS, "index_a"]
    up = F.col("direction") == "up"
    bars = written(bars.select(*KEYS, "seq", "dt", "low", "high"), "bars")
    g = gaps(bars).join(bars.groupBy(*KEYS).agg(F.max("seq").alias("last_bar")), KEYS)
    index = BlockIndex(bars, {"low": Target("low", "<="), "high": Target("high", ">=")})
    far = g.select(*ids, F.when(up, "low").otherwise("high").alias("target"), (F.col("index_b") + 1).cast("long").alias("at"), F.when(up, F.col("lower")).otherwise(F.col("upper")).alias("limit"))
    reached = g.join(index.first_passages(far).where("seq is not null").select(*ids, F.col("seq").alias("until")), ids)
    reached = written(reached, "reached")
    soon = written(reached.join(_filled(reached, bars), ids, "left"), "filled")
    jumped = soon.where("fill_index is null").drop("fill_index").withColumn("until", F.col("last_bar"))
    filled = soon.where("fill_index is not null").select(*ids, "fill_index").unionByName(_filled(jumped, bars).where("fill_index is not null"))

    g = written(g.join(filled, ids, "left"), "gaps")
    spans = F.array(F.struct(F.lit(0).alias("part"), F.col("index_b").alias("from"), F.col("fill_index").alias("to")), F.struct(F.lit(1).alias("part"), (F.col("fill_index") + 1).alias("from"), F.col("last_bar").alias("to")))
    asked = g.where("fill_index is not null").select(*ids, F.when(up, "high").otherwise("low").alias("target"), F.inline(spans))
    ends = index.extremes(asked).groupBy(*ids).agg(F.max(F.when(F.col("part") == 0, F.col("value"))).alias("extreme"), F.max(F.when(F.col("part") == 1, F.col("value"))).alias("next"))
    fresh = F.coalesce(F.when(up, F.col("next") > F.col("extreme")).otherwise(F.col("next") < F.col("extreme")), F.lit(False))
    return g.join(ends, ids, "left").select(
        *KEYS, "index_a", "direction", "lower", "upper", "fill_index", "extreme",
        F.when(F.col("fill_index").isNull(), "strong").when(fresh, "neutral").otherwise("weak").alias("strength"), (F.col("fill_index").isNotNull() & ~fresh).alias("exhaustion"),
    )


def boll(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """seq, dt, close, mid, upper, lower and the state of the close."""
    w = rows(-(n - 1))
    full = F.count("close").over(w) == n
    mid, dev = F.when(full, F.avg("close").over(w)), F.stddev_pop("close").over(w)
    out = bars.select(*KEYS, "seq", "dt", "close", mid.alias("mid"), (mid + k * dev).alias("upper"), (mid - k * dev).alias("lower"))
    return out.withColumn("state", classifiers.boll_state(F.col("close"), F.col("upper"), F.col("lower")))


def boll_changes(bands: DataFrame, n: int = 20, squeeze_win: int = 20, squeeze_ratio: float = 0.6) -> DataFrame:
    """Entering and leaving the outer states, and squeezes of the width."""
    w = by_seq()
    width = F.col("upper") - F.col("lower")
    bands = bands.withColumn("before", F.lag("state").over(w)).withColumn("narrow", F.min(width).over(rows(-squeeze_win, -1)))
    before, narrow = F.col("before"), F.col("narrow")
    changed = F.col("state").isNotNull() & ~F.col("state").eqNullSafe(before)
    events = F.array(
        F.when(changed & (F.col("state") == "super_up"), "super_up_enter"), F.when(changed & (before == "super_up"), "super_up_exit"),
        F.when(changed & (F.col("state") == "super_down"), "super_down_enter"), F.when(changed & (before == "super_down"), "super_down_exit"),
        F.when((F.col("seq") >= n - 1 + squeeze_win) & (width <= narrow * squeeze_ratio), "squeeze"),
    )
    return bands.select(*KEYS, "seq", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("event"))


def alignment(lines: DataFrame) -> DataFrame:
    """up or down by the sign of the distance; zero keeps the state before."""
    d = distance()
    sign = F.when(d > 0, "up").when(d < 0, "down")
    return lines.select(*KEYS, "seq", F.when(d.isNotNull(), F.last(sign, ignorenulls=True).over(rows(ALL_BEFORE))).alias("alignment"))


def ma_areas(lines: DataFrame) -> DataFrame:
    """Islands of one sign of the distance, with their signed area. Everything after a hole in the distances is out."""
    w, past = by_seq(), rows(ALL_BEFORE)
    d = lines.select(*KEYS, "seq", distance().alias("d")).withColumn("begun", F.count("d").over(past) > 0).where("begun")
    d = d.withColumn("broken", F.sum(F.when(F.col("d").isNull(), 1).otherwise(0)).over(past))
    d = d.withColumn("first_seq", F.min("seq").over(Window.partitionBy(*KEYS))).withColumn("last_seq", F.max("seq").over(Window.partitionBy(*KEYS)))
    d = d.where((F.col("broken") == 0) & (F.col("first_seq") < F.col("last_seq"))).withColumn("sign", F.signum("d").cast("int"))
    d = d.withColumn("island", F.sum(F.when(F.col("sign").eqNullSafe(F.lag("sign").over(w)), 0).otherwise(1)).over(past)).withColumn("stop", F.max("seq").over(Window.partitionBy(*KEYS)))
    out = d.where("sign <> 0").groupBy(*KEYS, "island", "sign").agg(F.min("seq").alias("start"), F.max("seq").alias("end"), F.sum(exact(F.col("d"))).cast("double").alias("area"), F.count("*").alias("bars"), F.first("stop").alias("stop"))
    return out.select(*KEYS, "sign", "start", "end", "area", "bars", (F.col("area") / F.col("bars")).alias("avg_area"), (F.col("end") < F.col("stop")).alias("closed"))


def ma_weakening(areas: DataFrame, use_avg: bool = False) -> DataFrame:
    """Closed areas that are smaller than the nearest earlier one of their sign."""
    w = Window.partitionBy(*KEYS, "sign").orderBy("start")
    value = "avg_area" if use_avg else "area"
    out = areas.withColumn("before", F.lag(value).over(w)).withColumn("area_prev", F.abs(F.lag("area").over(w)))
    return out.where(F.col("closed") & (F.abs(F.col(value)) < F.abs("before"))).select(*KEYS, F.when(F.col("sign") > 0, "up").otherwise("down").alias("direction"), "start", F.col("end").alias("idx"), "area_prev", F.abs("area").alias("area_last"))


def ma_strength(lines: DataFrame, areas: DataFrame) -> DataFrame:
    """The last area against the nearest earlier one of its sign, and whether the distance shortens."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("start"))
    before = F.lag("avg_area").over(Window.partitionBy(*KEYS, "sign").orderBy("start"))
    last = areas.withColumn("avg_prev", before).withColumn("place", F.row_number().over(w)).where("place = 1")
    d = lines.select(*KEYS, "seq", distance().alias("d")).withColumn("begun", F.count("d").over(rows(ALL_BEFORE)) > 0).where("begun")
    ends = d.groupBy(*KEYS).agg(F.count_if(F.col("d").isNull()).alias("holes"), F.max_by("d", "seq").alias("stretch"), F.max(F.struct("seq", "d")).alias("x"), F.count("*").alias("n"))
    prior = d.withColumn("prior", F.lag("d").over(by_seq())).groupBy(*KEYS).agg(F.max_by("prior", "seq").alias("prior"))
    return last.join(ends.where("holes = 0"), KEYS).join(prior, KEYS).select(
        *KEYS, F.when(F.col("sign") > 0, "up").otherwise("down").alias("direction"), F.col("avg_area").alias("avg_current"), "avg_prev", (F.abs("avg_area") < F.abs("avg_prev")).alias("forming_weak"), "stretch", (F.abs("stretch") < F.abs("prior")).alias("shortening")
    )


def ma_break(lines: DataFrame, direction: str, confirm: int = 2, close: str = "close", ma: str = "short") -> DataFrame:
    """Runs of closes beyond an average: none, testing or effective, with the first break and the confirming bar."""
    if direction not in ("top", "bottom") or confirm < 1:
        raise ValueError("direction must be top or bottom and confirm positive")
    c, m = intervals.finite(F.col(close)), intervals.finite(F.col(ma))
    beyond = F.coalesce(c < m if direction == "top" else c > m, F.lit(False))
    d = lines.select(*KEYS, "seq", beyond.alias("beyond"), (c.isNull() | m.isNull()).alias("missing"))
    d = d.withColumn("run_id", F.sum(F.when(F.col("beyond"), 0).otherwise(1)).over(rows(ALL_BEFORE)))
    d = d.withColumn("run", F.sum(F.col("beyond").cast("int")).over(Window.partitionBy(*KEYS, "run_id").orderBy("seq").rowsBetween(ALL_BEFORE, 0)))
    d = d.withColumn("run_before", F.lag("run", 1, 0).over(by_seq()))
    out = d.groupBy(*KEYS).agg(
        F.bool_or("beyond").alias("tested"), F.bool_or(~F.col("beyond") & ~F.col("missing") & F.col("run_before").between(1, confirm - 1)).alias("recovered"),
        F.min(F.when(F.col("beyond"), F.col("seq"))).alias("break_index"), F.min(F.when(F.col("run") >= confirm, F.col("seq"))).alias("confirm_index"), F.max_by("run", "seq").alias("streak"),
    )
    return out.withColumn("state", F.when(F.col("confirm_index").isNotNull(), "effective").when(F.col("streak") > 0, "testing").otherwise("none"))


def fractal_powers(merged: DataFrame, points: DataFrame) -> DataFrame:
    """The power of each fractal, from its three merged bars."""
    m = merged.select(*KEYS, "idx", "low", "high", F.col("start_value").alias("open"), F.col("end_value").alias("close"))
    w = Window.partitionBy(*KEYS).orderBy("idx")
    near = m.select(*KEYS, "idx", *(F.lag(c, 1).over(w).alias(f"a_{c}") for c in ("open", "high", "low", "close")), "open", "high", "low", "close", *(F.lead(c, 1).over(w).alias(f"c_{c}") for c in ("open", "high", "low", "close")))
    part = lambda p: {c: F.col(p + c) for c in ("open", "high", "low", "close")}
    joined = points.select(*KEYS, "bar_index", "kind").join(near, (F.col("bar_index") == F.col("idx")) & (points.symbol == near.symbol) & (points.freq == near.freq))
    return joined.select(points.symbol, points.freq, "bar_index", "kind", classifiers.fractal_power([part("a_"), part(""), part("c_")], F.col("kind")).alias("power"))


def oscillation(units: DataFrame, centers: DataFrame) -> DataFrame:
    """units (keys, idx, low, high, kind) after each center (keys, zd, zg, last): where their middles lie, and wedges."""
    joined = units.join(centers.select(*KEYS, F.col("idx").alias("center"), "zd", "zg", "last"), KEYS).where(F.col("idx") > F.col("last"))
    zn = (F.col("low") + F.col("high")) / 2
    z = (F.col("zd") + F.col("zg")) / 2
    d = joined.withColumn("zn", zn).withColumn("z", z)
    w = Window.partitionBy(*KEYS, "center").orderBy("idx")
    d = d.withColumn("step", F.col("zn") - F.lag("zn").over(w))
    d = d.withColumn("position", F.when(F.col("zn") > F.col("zg"), "above_B").when(F.col("zn") < F.col("zd"), "below_A").when(F.col("zn") >= F.col("z"), "above_Z").otherwise("below_Z"))
    count = lambda *names: F.count_if(F.col("position").isin(*names))
    out = d.groupBy(*KEYS, "center").agg(
        F.first("z").alias("z"), F.count("*").alias("n"), count("above_Z").alias("n_above"), count("below_Z").alias("n_below"), count("above_B", "below_A").alias("n_breaks"),
        F.bool_and(F.coalesce(F.col("step") > 0, F.lit(True))).alias("rising"), F.bool_and(F.coalesce(F.col("step") < 0, F.lit(True))).alias("falling"),
        F.max("zn").alias("top"), F.min("zn").alias("bottom"), F.first("zd").alias("zd"), F.first("zg").alias("zg"),
    )
    wedge = F.when(F.col("n") >= WEDGE_MIN_RUN, F.when(F.col("rising") & (F.col("top") <= F.col("zg")), "rising_wedge").when(F.col("falling") & (F.col("bottom") >= F.col("zd")), "falling_wedge"))
    strength = F.when(2 * F.col("n_above") > F.col("n"), "strong").when(2 * F.col("n_below") > F.col("n"), "weak").otherwise("balanced")
    return out.select(*KEYS, "center", "z", "n", "n_above", "n_below", "n_breaks", F.when(F.col("n_breaks") > 0, "breaking").otherwise("in_range").alias("status"), wedge.alias("wedge"), strength.alias("strength"), (F.col("n") >= 9).alias("upgrade_hint"))


def zn_next(units: DataFrame, m: int = 4) -> DataFrame:
    """A straight-line guess of the next middle, plus and minus the mean half range of the last m units."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("idx"))
    last = units.withColumn("place", F.row_number().over(w)).where(F.col("place") <= m).withColumn("zn", (F.col("low") + F.col("high")) / 2)
    out = last.groupBy(*KEYS).agg(F.count("*").alias("k"), F.min_by("zn", "place").alias("now"), F.max_by("zn", "place").alias("then"), F.avg((F.col("high") - F.col("low")) / 2).alias("half"))
    guess = F.col("now") + (F.col("now") - F.col("then")) / (F.col("k") - 1)
    return out.where("k >= 2").select(*KEYS, (guess - F.col("half")).alias("low"), (guess + F.col("half")).alias("high"))


def center_relations(centers: DataFrame) -> DataFrame:
    """Both relations of each center to the one before."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    before = [F.lag(c).over(w) for c in ("zd", "zg", "gg", "dd")]
    now = [F.col(c) for c in ("zd", "zg", "gg", "dd")]
    return centers.select(*KEYS, "idx", intervals.relation(now[2], now[3], before[2], before[3]).alias("relation"), intervals.lineage_relation(*now, *before).alias("lineage_relation"))


def trend_groups(centers: DataFrame) -> DataFrame:
    """Runs of centers with disjoint cores and one direction: a trend from two on, else a range."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    zd, zg, side = (F.lag(c).over(w) for c in ("zd", "zg", "direction"))
    joins = ((F.col("zg") < zd) | (F.col("zd") > zg)) & (F.col("direction") == side)
    d = centers.withColumn("grp", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(ALL_BEFORE, 0)))
    out = d.groupBy(*KEYS, "grp").agg(F.count("*").alias("n"), F.min("start_dt").alias("start_dt"), F.max("end_dt").alias("end_dt"), F.min_by("zd", "idx").alias("zd"), F.min_by("zg", "idx").alias("zg"))
    return out.withColumn("type", F.when(F.col("n") >= 2, "trend").otherwise("range"))


def overlap_starts(units: DataFrame) -> DataFrame:
    """Per unit the range that it shares with the next two, whether there is one, and the first unit from it on that has."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    zd, zg = intervals.range3("low", "high", w)
    d = units.select(*KEYS, "idx", zd.alias("zd"), zg.alias("zg")).withColumn("shared", F.coalesce(F.col("zd") <= F.col("zg"), F.lit(False)))
    return d.withColumn("next_center", F.min(F.when(F.col("shared"), F.col("idx"))).over(w.rowsBetween(0, Window.unboundedFollowing)))


def stroke_swings(strokes: DataFrame, bars: DataFrame) -> DataFrame:
    """Each stroke with the histogram's area over its bars; an unknown end gives 0. bars: (keys, dt, hist)."""
    w = Window.partitionBy(*KEYS).orderBy("dt").rowsBetween(ALL_BEFORE, 0)
    sums = bars.select(*KEYS, "dt", "hist", F.sum(F.col("hist").cast("decimal(38,18)")).over(w).alias("upto"))
    ends = sums.select(*KEYS, F.col("dt").alias("end_dt"), F.col("upto").alias("end_sum"))
    starts = sums.select(*KEYS, F.col("dt").alias("start_dt"), (F.col("upto") - F.col("hist").cast("decimal(38,18)")).alias("start_sum"))
    area = F.coalesce((F.col("end_sum") - F.col("start_sum")).cast("double"), F.lit(0.0))
    return strokes.join(ends, [*KEYS, "end_dt"], "left").join(starts, [*KEYS, "start_dt"], "left").withColumn("area", area).drop("end_sum", "start_sum")


def range_divergences(swings: DataFrame, centers: DataFrame, max_dev: float = 0.15) -> DataFrame:
    """Strokes that beat the one two before on a smaller area, per center that they are near enough to."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    d = swings.withColumn("prev_area", F.abs(F.lag("area", 2).over(w))).withColumn("prev_end", F.lag("end_value", 2).over(w))
    beats = F.when(F.col("direction") == "up", F.col("end_value") > F.col("prev_end")).otherwise(F.col("end_value") < F.col("prev_end"))
    found = d.where((F.abs("area") < F.col("prev_area")) & beats).select(*KEYS, "direction", F.col("end_dt").alias("dt"), F.col("end_value").alias("price"), F.col("prev_area").alias("area_prev"), F.abs("area").alias("area_last"))
    near = F.when(F.col("direction") == "up", F.col("price") <= F.col("gg") * (1 + max_dev)).otherwise(F.col("price") >= F.col("dd") * (1 - max_dev))
    return found.join(centers.select(*KEYS, F.col("idx").alias("center"), "gg", "dd"), KEYS).where(near).select(*KEYS, "center", "direction", "dt", "price", "area_prev", "area_last")


def third_points(strokes: DataFrame, centers: DataFrame, min_ratio: float | None = None) -> DataFrame:
    """First leave and unbroken pull of each center, both sides, if the leave is stronger."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    pairs = strokes.select(*KEYS, "idx", "direction", "start_dt", "start_value", "end_value", F.lead("end_value").over(w).alias("pull_end"), F.lead("end_dt").over(w).alias("dt")).where("pull_end is not null")
    c = centers.select(*KEYS, F.col("idx").alias("center"), F.col("start_dt").alias("center_start"), "zd", "zg")
    buy = (F.col("direction") == "up") & (F.col("end_value") > F.col("zg")) & (F.col("pull_end") >= F.col("zg"))
    sell = (F.col("direction") == "down") & (F.col("end_value") < F.col("zd")) & (F.col("pull_end") <= F.col("zd"))
    met = pairs.join(c, KEYS).where((F.col("start_dt") >= F.col("center_start")) & (buy | sell)).withColumn("side", F.when(F.col("direction") == "up", "buy").otherwise("sell"))
    first = met.groupBy(*KEYS, "center", "side").agg(F.min_by(F.struct("dt", "pull_end", "start_value", "end_value"), "idx").alias("x")).select(*KEYS, "center", "side", "x.*")
    leave, pull = F.abs(F.col("end_value") / F.col("start_value") - 1), F.abs(F.col("pull_end") / F.col("end_value") - 1)
    ratio = leave / F.when(pull > 0, pull)
    # a ratio that rounds to two places above 1.0 is one above the double 1.005
    keep = ratio > 1.005 if min_ratio is None else F.round(ratio, 2) >= min_ratio
    return first.where(keep).select(*KEYS, "center", "side", "dt", F.col("pull_end").alias("price"), ratio.alias("ratio"))


def ma_class(bars: DataFrame, start_index: int, periods: tuple[int, ...] = MA_PERIODS, confirm: int = 1, extra: list[str] | None = None) -> DataFrame:
    """1-based first period whose average was not conquered from start_index on; null if that is unknown."""
    extra = extra or []
    above = [above_sma(F.col("close"), n).alias(f"p{i}") for i, n in enumerate(periods)]
    d = bars.select(*KEYS, *extra, "seq", *above).where(F.col("seq") >= start_index)
    stack = "stack({}, {}) as (period, beyond)".format(len(periods), ", ".join(f"{i}, p{i}" for i in range(len(periods))))
    d = d.selectExpr(*KEYS, *extra, "seq", stack)
    d = d.withColumn("run_id", F.sum(F.when(F.coalesce("beyond", F.lit(False)), 0).otherwise(1)).over(by_seq("period").rowsBetween(ALL_BEFORE, 0)))
    d = d.withColumn("run", F.sum(F.coalesce(F.col("beyond").cast("int"), F.lit(0))).over(Window.partitionBy(*KEYS, "period", "run_id").orderBy("seq").rowsBetween(ALL_BEFORE, 0)))
    per = d.groupBy(*KEYS, *extra, "period").agg(F.min(F.when(F.col("run") >= confirm, F.col("seq"))).alias("conquered_at"), F.bool_or(F.col("beyond").isNull()).alias("missing"))
    state = F.when(F.col("conquered_at").isNotNull(), True).when(~F.col("missing"), False)
    first = F.min(F.when(~F.coalesce(state, F.lit(False)), F.struct("period", state.alias("state"))))
    out = per.groupBy(*KEYS, *extra).agg(first.alias("f"))
    return out.select(*KEYS, *extra, F.when(F.col("f").isNull(), len(periods) + 1).when(F.col("f.state").isNotNull(), F.col("f.period") + 1).cast("int").alias("class_no"))


def sector_strength(classes: DataFrame, sector: str = "sector", n_periods: int = len(MA_PERIODS)) -> DataFrame:
    """Mean class, coverage and distribution of each sector's members."""
    counts = [F.count_if(F.col("class_no") == i).alias(f"class_{i}") for i in range(1, n_periods + 2)]
    return classes.groupBy(sector).agg(F.avg("class_no").alias("mean_class"), F.count("class_no").alias("valid"), F.count("*").alias("total"), *counts).withColumn("coverage", F.col("valid") / F.col("total"))
