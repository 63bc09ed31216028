"""Conditions on confirmed moves: joins, windows and first matches, native throughout.

Every input carries confirmed_dt, the time from which it is known; an as-of time cuts inputs, never results.
Tables: moves (keys, move_id, sub_level, direction, start_dt, end_dt, start_value, end_value, low, high, confirmed_dt),
contexts (keys, context_id, level, sub_level, side, source, anchor_dt, anchor_price, confirmed_dt, ended_dt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import KEYS
from ..sources.scratch import written
from .passage import BlockIndex, Target


def known(df: DataFrame, as_of: Column) -> DataFrame:
    return df.where(F.col("confirmed_dt") <= as_of)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows; the job fails at the first that breaks the condition.

    Filters may run in any order, so a condition must itself let rows pass that an earlier filter drops.
    """
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def pairs(moves: DataFrame, as_of: Column) -> DataFrame:
    """Each known move with the one after it on its level."""
    w = Window.partitionBy(*KEYS, "sub_level").orderBy("start_dt")
    m = require(known(moves, as_of), (F.col("start_dt") < F.col("end_dt")) & (F.col("end_dt") <= F.col("confirmed_dt")) & ((F.col("direction") == "up") == (F.col("end_value") > F.col("start_value"))), "a move contradicts itself")
    names = ("move_id", "direction", "start_dt", "end_dt", "start_value", "end_value", "low", "high", "confirmed_dt")
    out = m.select(*KEYS, "sub_level", *names, *(F.lead(n).over(w).alias(f"pull_{n}") for n in names)).where("pull_move_id is not null")
    return require(out, F.col("pull_move_id").isNull() | (F.col("pull_start_dt") >= F.col("end_dt")), "moves of one level overlap")


def second_points(moves: DataFrame, contexts: DataFrame, as_of: Column, centers: DataFrame | None = None, divergences: DataFrame | None = None) -> DataFrame:
    """The move from a context's anchor and the one back: weak beyond the anchor, strong if a known center holds it too.

    After a minor turn a new extreme needs evidence: the earliest known divergence of that move, level and side.
    centers (keys, context_id, center_id, zd, zg, confirmed_dt); divergences (keys, move_id, sub_level, direction, confirmed_dt).
    """
    c = known(contexts, as_of).withColumnRenamed("confirmed_dt", "context_confirmed").withColumn("start_dt", F.col("anchor_dt"))
    d = pairs(moves, as_of).join(c, [*KEYS, "sub_level", "start_dt"])
    buy = F.col("side") == "buy"
    applies = (F.col("direction") == F.when(buy, "up").otherwise("down")) & (F.col("pull_direction") != F.col("direction"))
    d = require(d.where(applies), ~applies | ((F.col("start_value") == F.col("anchor_price")) & (F.col("end_dt") == F.col("pull_start_dt")) & (F.col("end_value") == F.col("pull_start_value"))), "context, move and pull do not meet")
    if divergences is not None:
        e = known(divergences, as_of).groupBy(*KEYS, F.col("move_id").alias("pull_move_id"), "sub_level", F.col("direction").alias("pull_direction")).agg(F.min("confirmed_dt").alias("evidence_dt"))
        d = d.join(e, [*KEYS, "pull_move_id", "sub_level", "pull_direction"], "left")
    else:
        d = d.withColumn("evidence_dt", F.lit(None).cast("timestamp_ntz"))
    extreme = (F.col("source") == "minor_turn") & F.when(buy, F.col("pull_low") < F.col("anchor_price")).otherwise(F.col("pull_high") > F.col("anchor_price"))
    d = d.where(~extreme | F.col("evidence_dt").isNotNull())
    d = d.withColumn("known_dt", F.greatest("context_confirmed", "confirmed_dt", "pull_confirmed_dt", F.when(extreme, F.col("evidence_dt"))))
    d = d.where(F.col("ended_dt").isNull() | (F.col("known_dt") <= F.col("ended_dt")))
    if centers is not None:
        z = known(centers, as_of).select(*KEYS, "context_id", "center_id", "zd", "zg", F.col("confirmed_dt").alias("center_dt"))
        d = d.join(z, [*KEYS, "context_id"], "left")
        holds = F.when(buy, (F.col("start_value") <= F.col("zg")) & (F.col("zg") < F.col("end_value")) & (F.col("pull_low") >= F.col("zg")))
        holds = holds.otherwise((F.col("start_value") >= F.col("zd")) & (F.col("zd") > F.col("end_value")) & (F.col("pull_high") <= F.col("zd")))
        third = F.coalesce((F.col("center_dt") <= F.col("anchor_dt")) & holds, F.lit(False))
    else:
        d, third = d.withColumn("center_id", F.lit(None).cast("string")), F.lit(False)
    weak = F.when(buy, F.col("pull_end_value") < F.col("anchor_price")).otherwise(F.col("pull_end_value") > F.col("anchor_price"))
    return d.select(
        *KEYS, F.concat("side", F.lit("2")).alias("kind"), "context_id", "level", F.col("pull_end_dt").alias("dt"), F.col("pull_end_value").alias("price"), F.col("known_dt").alias("confirmed_dt"),
        F.when(third, "strong").when(weak, "weak").otherwise("normal").alias("strength"), F.col("move_id"), "pull_move_id", third.alias("also_third"), F.when(third, F.col("center_id")).alias("center_id"),
    )


def third_points(moves: DataFrame, contexts: DataFrame, as_of: Column) -> DataFrame:
    """contexts (keys, context_id, level, sub_level, center_id, zd, zg, confirmed_dt): the first leave of a known center
    whose immediate pull holds its edge; what was tried before counts toward the time of confirmation."""
    c = require(known(contexts, as_of), F.col("zd") < F.col("zg"), "a center has no width").withColumnRenamed("confirmed_dt", "center_dt")
    d = pairs(moves, as_of).join(c, [*KEYS, "sub_level"]).where(F.col("end_dt") >= F.col("center_dt"))
    d = require(d, (F.col("end_dt") < F.col("center_dt")) | ((F.col("end_dt") == F.col("pull_start_dt")) & (F.col("end_value") == F.col("pull_start_value"))), "moves after a known center do not meet")
    d = d.where(F.col("start_dt") >= F.col("center_dt"))
    w = Window.partitionBy(*KEYS, "context_id").orderBy("start_dt")
    d = d.withColumn("tried_dt", F.max(F.greatest("confirmed_dt", "pull_confirmed_dt")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    up = F.col("direction") == "up"
    leaves = (F.col("low") <= F.col("zg")) & (F.col("high") >= F.col("zd")) & F.when(up, F.col("end_value") > F.col("zg")).otherwise(F.col("end_value") < F.col("zd"))
    holds = (F.col("pull_direction") != F.col("direction")) & F.when(up, F.col("pull_low") >= F.col("zg")).otherwise(F.col("pull_high") <= F.col("zd"))
    first = d.where(leaves & holds).withColumn("place", F.row_number().over(w)).where("place = 1")
    return first.select(
        *KEYS, F.when(up, "buy3").otherwise("sell3").alias("kind"), "context_id", "center_id", "level", F.col("pull_end_dt").alias("dt"), F.col("pull_end_value").alias("price"),
        F.greatest("center_dt", "tried_dt").alias("confirmed_dt"), "move_id", "pull_move_id",
    )


def formation_states(first_points: DataFrame, third: DataFrame, as_of: Column) -> DataFrame:
    """first_points (keys, context_id, kind, level, center_id, confirmed_dt): constructing until the first third point of
    their center, then completed if it lies on their side, else failed; waiting while not known."""
    e = known(third, as_of).select(*KEYS, "level", "center_id", F.col("kind").alias("third_kind"), F.col("confirmed_dt").alias("third_dt"))
    d = first_points.withColumn("known", F.col("confirmed_dt") <= as_of).join(e, [*KEYS, "level", "center_id"], "left")
    later = F.when(F.col("known") & (F.col("third_dt") >= F.col("confirmed_dt")), F.struct(F.col("third_dt").alias("dt"), F.col("third_kind").alias("kind")))
    out = d.groupBy(*KEYS, "context_id", "kind", "level", "center_id", "known").agg(F.min(later).alias("end"))
    success = F.when(F.col("kind") == "buy1", "buy3").otherwise("sell3")
    phase = F.when(~F.col("known"), "waiting").when(F.col("end").isNull(), "constructing").when(F.col("end.kind") == success, "completed").otherwise("failed")
    return out.select(*KEYS, "context_id", phase.alias("phase"), F.when(F.col("known"), F.when(F.col("kind") == "buy1", "bottom").otherwise("top")).alias("formation"), F.col("end.dt").alias("ended_dt"), F.col("end.kind").alias("boundary"))


def _micros(column: str) -> Column:
    """A time without zone as a number; doubles hold microseconds exactly for two centuries."""
    return F.expr(f"cast(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) as double)")


def fractal_range_states(fractals: DataFrame, bars: DataFrame, as_of: Column, confirm: int = 2) -> DataFrame:
    """fractals (keys, fractal_id, kind, low, high, confirmed_dt) against bars that close after they are known.

    The first bar beyond the far edge fails a range; `confirm` closes in a row beyond the near edge complete it; a
    failing bar wins over a completing one. Each of these is a first passage, so a range asks the block index of its
    series and meets no other bar. Closing times do not fall within a series.
    """
    if confirm < 1:
        raise ValueError("confirm must be positive")
    ids = [*KEYS, "fractal_id"]
    order = Window.partitionBy(*KEYS).orderBy("seq")
    tail = order.rowsBetween(1 - confirm, 0)
    full = F.count("*").over(tail) == confirm
    recent = F.array_compact(F.array(*[F.lag("close", i).over(order) for i in range(confirm - 1)])) if confirm > 1 else F.array().cast("array<double>")
    b = bars.where(F.col("available_dt") <= as_of).select(
        *KEYS, "low", "high", "close", "available_dt", _micros("closed_dt").alias("closed"), (F.row_number().over(order) - 1).alias("seq"),
        F.when(full, F.min("close").over(tail)).alias("least"), F.when(full, F.max("close").over(tail)).alias("most"), recent.alias("recent"),
    )
    b = written(b, "bars")
    index = BlockIndex(b, {
        "closed": Target("closed", ">"), "fail_bottom": Target("low", "<"), "fail_top": Target("high", ">"), "test_bottom": Target("close", ">"), "test_top": Target("close", "<"),
        "back_bottom": Target("close", "<="), "back_top": Target("close", ">="), "done_bottom": Target("least", ">"), "done_top": Target("most", "<"),
    })
    last = b.groupBy(*KEYS).agg(F.max("seq").alias("last_bar"))
    f = known(fractals, as_of).select(*ids, "kind", F.col("low").alias("box_low"), F.col("high").alias("box_high"), _micros("confirmed_dt").alias("limit"))
    starts = index.first_passages(f.select(*ids, F.lit("closed").alias("target"), F.lit(0).cast("long").alias("at"), "limit")).where("seq is not null")
    f = written(f.drop("limit").join(starts.select(*ids, F.col("seq").alias("start")), ids).join(last, KEYS), "ranges")

    bottom = F.col("kind") == "bottom"
    near, edge = F.when(bottom, F.col("box_high")).otherwise(F.col("box_low")), F.when(bottom, F.col("box_low")).otherwise(F.col("box_high"))
    ask = lambda what, at, limit: F.struct(F.lit(what).alias("what"), F.concat(F.lit(f"{what}_"), "kind").alias("target"), at.cast("long").alias("at"), limit.alias("limit"))
    asked = F.array(ask("fail", F.col("start"), edge), ask("test", F.col("start"), near), ask("done", F.col("start") + confirm - 1, near))
    at = lambda what: F.max(F.when(F.col("what") == what, F.col("seq"))).alias(what)
    found = index.first_passages(f.select(*ids, F.inline(asked))).groupBy(*ids).agg(at("fail"), at("test"), at("done"))
    f = written(f.join(found, ids), "passages")
    f = f.withColumn("test", F.when(F.col("fail").isNull() | (F.col("test") < F.col("fail")), F.col("test"))).withColumn("end", F.least("fail", "done"))
    back = f.where("test is not null").select(*ids, F.concat(F.lit("back_"), "kind").alias("target"), (F.col("test") + 1).alias("at"), near.alias("limit"))
    f = f.join(index.first_passages(back).select(*ids, F.col("seq").alias("back")), ids, "left")
    failed = F.coalesce(F.col("end") == F.col("fail"), F.lit(False))
    recovered = F.coalesce((F.col("back") <= F.coalesce("end", "last_bar")) & ~F.coalesce(F.col("back") == F.col("fail"), F.lit(False)), F.lit(False))

    # closes in a row beyond the edge, up to the bar before a failing one or to the last
    f = f.withColumn("until", F.when(failed, F.col("end") - 1).otherwise(F.col("last_bar")))
    time = lambda name, key: b.select(*KEYS, F.col("seq").alias(key), F.col("available_dt").alias(name))
    f = f.join(b.select(*KEYS, F.col("seq").alias("until"), "recent"), [*KEYS, "until"], "left")
    f = f.join(time("first_test", "test"), [*KEYS, "test"], "left").join(time("ended_dt", "end"), [*KEYS, "end"], "left")
    stop = F.array_position(F.transform("recent", lambda c: F.when(bottom, c > F.col("box_high")).otherwise(c < F.col("box_low"))), False)
    row = F.least(F.when(stop > 0, stop - 1).otherwise(F.size("recent")), F.col("until") - F.col("start") + 1)
    streak = F.when(F.col("end").isNotNull() & ~failed, confirm).otherwise(F.coalesce(F.greatest(row, F.lit(0)), F.lit(0)))
    out = f.select(*ids, F.when(failed, "failed").when(F.col("end").isNotNull(), "completed").alias("ends"), streak.alias("streak"), "first_test", recovered.alias("recovered"), "ended_dt")
    phase = F.coalesce("ends", F.when(F.col("streak") > 0, "testing"), F.lit("constructing"))
    every = fractals.select(*ids, (F.col("confirmed_dt") <= as_of).alias("known")).join(out, ids, "left")
    return every.select(*ids, F.when(F.col("known"), phase).otherwise("waiting").alias("phase"), "first_test", "ended_dt", F.coalesce("streak", F.lit(0)).alias("streak"), F.coalesce("recovered", F.lit(False)).alias("recovered"))


def nested_divergence(levels: DataFrame) -> DataFrame:
    """levels (chain_id, level, direction, ref_low, ref_high, cand_low, cand_high, ref_strength, cand_strength, start_dt,
    end_dt), coarse to fine: each level's verdict up to the first break, and the innermost turn of an unbroken chain."""
    w = Window.partitionBy("chain_id").orderBy("level")
    up = F.col("direction") == "up"
    inside = F.lag("start_dt").over(w).isNull() | ((F.col("start_dt") >= F.lag("start_dt").over(w)) & (F.col("end_dt") <= F.lag("end_dt").over(w)))
    fresh = F.when(up, F.col("cand_high") > F.col("ref_high")).otherwise(F.col("cand_low") < F.col("ref_low"))
    wrong = F.when(up, F.col("cand_strength") <= 0).otherwise(F.col("cand_strength") >= 0)
    stronger = F.when(up, F.col("cand_strength") >= F.col("ref_strength")).otherwise(F.col("cand_strength") <= F.col("ref_strength"))
    reason = F.when(~F.col("inside"), "not_nested").when(~fresh, "no_new_extreme").when(wrong, "weak_sign").when(stronger, "stronger").otherwise("bc")
    d = levels.withColumn("inside", inside).withColumn("reason", reason)
    d = d.withColumn("breaks", F.sum((F.col("reason") != "bc").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))).where(F.coalesce("breaks", F.lit(0)) == 0)
    whole = Window.partitionBy("chain_id")
    last = F.max("level").over(whole)
    complete = F.min((F.col("reason") == "bc").cast("int")).over(whole) == 1
    ratio = F.col("cand_strength") / F.when(F.col("ref_strength") != 0, F.col("ref_strength"))
    return d.select(
        "chain_id", "level", "reason", ratio.alias("ratio"), complete.alias("complete"), F.when(complete & (F.col("level") == last), F.col("end_dt")).alias("turn_dt"),
        F.when(complete & (F.col("level") == last), F.when(up, F.col("cand_high")).otherwise(F.col("cand_low"))).alias("turn_price"),
    )


def level_reading(level_units: DataFrame, at: Column) -> DataFrame:
    """Per level, the kind of the first unit that covers a time; null where none does."""
    covers = (F.col("start_dt") <= at) & (F.col("end_dt") >= at)
    return level_units.groupBy(*KEYS, "level").agg(F.min_by(F.when(covers, F.col("kind")), F.when(covers, F.col("idx"))).alias("kind"))


def change_starts_low(level_units: DataFrame, moves: DataFrame, low: int = 1) -> DataFrame:
    """Whether each change of direction among moves (keys, idx, direction, first, last) has a unit of the level below
    with the new direction inside; an undirected first unit is no counter-evidence. Null where nothing changes."""
    w = Window.partitionBy(*KEYS).orderBy("idx")
    change = moves.withColumn("before", F.lag("direction").over(w)).where((F.col("before") != F.col("direction"))).select(*KEYS, F.col("idx").alias("move"), F.col("direction").alias("new"), "first", "last")
    units = level_units.where(F.col("level") == low).select(*KEYS, "idx", "direction")
    met = change.join(units, KEYS).where((F.col("idx") >= F.col("first")) & (F.col("idx") <= F.col("last")))
    per = met.groupBy(*KEYS, "move").agg(F.bool_or(F.coalesce(F.col("direction") == F.col("new"), F.lit(False)) | ((F.col("idx") == F.col("first")) & F.col("direction").isNull())).alias("hit"))
    found = per.groupBy(*KEYS).agg(F.bool_and("hit").alias("starts_low"))
    return moves.select(*KEYS).distinct().join(found, KEYS, "left")


def run_exhaustion(strokes: DataFrame, macd: DataFrame, centers: DataFrame, direction: str, signals: DataFrame, stale_days: int = 1, min_prev_swing: float | None = None, closes: DataFrame | None = None) -> DataFrame:
    """signals (keys, signal_id, signal_dt): is the last stroke run of one direction weaker than the one before?

    Strengths are swings of dif between the bars two after a run's ends. A run that ends outside
    [signal day - stale_days, signal day] is stale. macd (keys, seq, dt, dif, hist).
    """
    if direction not in ("up", "down"):
        raise ValueError("direction must be up or down")
    w = Window.partitionBy(*KEYS).orderBy("idx")
    r = strokes.withColumn("run", F.sum(F.when(F.col("direction") == F.lag("direction").over(w), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.where(F.col("direction") == direction).groupBy(*KEYS, "run").agg(F.min("start_dt").alias("start_dt"), F.max("end_dt").alias("end_dt"), F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("end_value", "idx").alias("end_value"))
    rank = Window.partitionBy(*KEYS).orderBy(F.desc("run"))
    r = r.withColumn("place", F.row_number().over(rank)).where("place <= 2")
    whole = Window.partitionBy(*KEYS).orderBy("seq")
    shifted = F.coalesce(F.lead("dif", 2).over(whole), F.last("dif").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    at = macd.select(*KEYS, "dt", shifted.alias("dif2"), F.sum(F.col("hist").cast("decimal(38,18)")).over(whole.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.col("hist").cast("decimal(38,18)").alias("own"))
    a = at.select(*KEYS, F.col("dt").alias("start_dt"), F.col("dif2").alias("dif_a"), (F.col("upto") - F.col("own")).alias("sum_a"))
    b = at.select(*KEYS, F.col("dt").alias("end_dt"), F.col("dif2").alias("dif_b"), F.col("upto").alias("sum_b"))
    r = r.join(a, [*KEYS, "start_dt"], "left").join(b, [*KEYS, "end_dt"], "left")
    r = r.withColumn("swing", F.coalesce(F.abs(F.col("dif_b") - F.col("dif_a")), F.lit(0.0))).withColumn("area", F.coalesce(F.abs((F.col("sum_b") - F.col("sum_a")).cast("double")), F.lit(0.0)))
    last = r.where("place = 1").select(*KEYS, "start_dt", "end_dt", "low", "high", "end_value", "swing", "area")
    prev = r.where("place = 2").select(*KEYS, F.col("end_value").alias("prev_end"), F.col("swing").alias("prev_swing"), F.col("area").alias("prev_area"))
    touched = last.join(centers.select(*KEYS, "zd", "zg"), KEYS).where((F.col("zg") >= F.col("low")) & (F.col("zd") <= F.col("high"))).groupBy(*KEYS).agg(F.count("*").alias("zs_count"))
    d = signals.join(last, KEYS, "left").join(prev, KEYS, "left").join(touched, KEYS, "left")
    age = F.datediff(F.to_date("signal_dt"), F.to_date("end_dt"))
    fresh = F.when(F.lit(direction) == "down", F.col("end_value") < F.col("prev_end")).otherwise(F.col("end_value") > F.col("prev_end"))
    small = F.lit(False)
    if min_prev_swing is not None and closes is not None:
        # the upper middle close
        order = closes.withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy("close"))).withColumn("n", F.count("*").over(Window.partitionBy(*KEYS)))
        middle = order.where(F.col("place") == F.floor(F.col("n") / 2) + 1).select(*KEYS, F.col("close").alias("middle"))
        d = d.join(middle, KEYS, "left")
        small = F.round("prev_swing", 4) < min_prev_swing * F.col("middle")
    status = F.when(F.col("end_dt").isNull(), "none").when((age > stale_days) | (age < 0), "stale").when(F.col("prev_end").isNull() | small, "no_exhaustion").when((F.col("swing") < F.col("prev_swing")) & fresh, "ok").otherwise("no_exhaustion")
    extreme = F.when(F.lit(direction) == "down", F.col("low")).otherwise(F.col("high"))
    return d.select(*KEYS, "signal_id", "signal_dt", status.alias("status"), extreme.alias("extreme"), "swing", "prev_swing", "area", "prev_area", F.coalesce("zs_count", F.lit(0)).alias("zs_count"))


def confirm_third(exhausted: DataFrame, bounds: DataFrame, side: str, weak_tol: float = 0.02) -> DataFrame:
    """bounds (keys, signal_id, zd, zg): a third point's verdict on the finer period."""
    d = exhausted.join(bounds, [*KEYS, "signal_id"], "left")
    buy = side == "buy"
    edge = F.col("zg") if buy else F.col("zd")
    holds = F.col("extreme") >= edge if buy else F.col("extreme") <= edge
    nearly = F.col("extreme") >= edge * (1 - weak_tol) if buy else F.col("extreme") <= edge * (1 + weak_tol)
    ok = F.col("status") == "ok"
    verdict = F.when(edge.isNull(), "no_data").when(F.col("status").isin("stale", "none"), F.col("status")).when(holds & ok, "confirmed").when(nearly & ok & ~holds, "weak").when(holds | nearly, "no_exhaustion").otherwise("broke")
    return d.select(*KEYS, "signal_id", verdict.alias("verdict"), ((F.col("extreme") - edge) / edge * 100).alias("distance"))


def confirm_second(fractals: DataFrame, signals: DataFrame, stale_days: int = 1, pierce_tol: float = 0.0) -> DataFrame:
    """signals (keys, signal_id, signal_dt, price): the latest bottom fractal of the days before, against the price."""
    f = fractals.where(F.col("kind") == "bottom").select(*KEYS, "dt", "low")
    age = F.datediff(F.to_date("signal_dt"), F.to_date("dt"))
    last = signals.join(f, KEYS).where((age >= 0) & (age <= stale_days)).groupBy(*KEYS, "signal_id").agg(F.max_by("low", "dt").alias("low"), F.max("dt").alias("fractal_dt"))
    any_ = f.groupBy(*KEYS).agg(F.lit(True).alias("any"))
    d = signals.join(last, [*KEYS, "signal_id"], "left").join(any_, KEYS, "left")
    verdict = F.when(F.col("price").isNull() | F.col("any").isNull(), "no_data").when(F.col("low").isNull(), "stale").when(F.col("low") >= F.col("price"), "confirmed").when(F.col("low") >= F.col("price") * (1 - pierce_tol), "weak").otherwise("broke")
    return d.select(*KEYS, "signal_id", verdict.alias("verdict"), "fractal_dt", "low")
