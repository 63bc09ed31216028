"""Every registered query of the engine and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles
from .functions import classifiers, intervals
from .operators import confirmed as cf
from .operators import split
from .operators import structure as st
from .operators import windows as wn
from .operators.ma_candidates import Settings as MaSettings
from .schema import KEYS
from .sources import bars as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(*columns: str) -> list:
    """Doubles for comparison, to six places."""
    return [F.round(c, 6).alias(c) for c in columns]


def bars_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.event_bars(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to bars to merged bars, fractals, strokes and centers: one row per record type and series."""
    return st.structure(bars_of(spark, sf_dir)).groupBy(*KEYS, "record").count()


# Sources and checks -----------------------------------------------------------------------------------------------


@query("bars_ohlc", oracles.select("SELECT symbol, '1 hour' AS freq, seq, dt, open, high, low, close, volume FROM b"))
def bars_ohlc(spark, sf_dir):
    return bars_of(spark, sf_dir).select(*KEYS, F.col("seq").cast("long").alias("seq"), "dt", "open", "high", "low", "close", "volume")


def spoiled(spark, sf_dir) -> DataFrame:
    """Bars with planted faults, by position."""
    k = F.col("seq") % 50
    b = bars_of(spark, sf_dir)
    return b.select(
        *KEYS, "seq", F.when(k == 7, F.lag("dt", 2).over(wn.by_seq())).otherwise(F.col("dt")).alias("dt"), "open", F.when(k == 11, F.col("open") - 1000).otherwise(F.col("high")).alias("high"),
        F.when(k == 13, -F.col("low")).otherwise(F.col("low")).alias("low"), F.when(k == 17, F.lit(None)).otherwise(F.col("close")).alias("close"), F.when(k == 19, -1.0).when(k == 23, 0.0).otherwise(F.col("volume")).alias("volume"),
    )


@query("bars_violations", oracles.VIOLATIONS)
def bars_violations(spark, sf_dir):
    return src.violations(spoiled(spark, sf_dir)).select(*KEYS, F.col("seq").cast("long").alias("seq"), "rule")


@query("paused_filter", oracles.select("SELECT symbol, count(*) AS n, sum(CASE WHEN volume = 1 THEN 1 ELSE 0 END)::BIGINT AS singles FROM (SELECT symbol, CASE WHEN volume = 1 THEN 0 ELSE volume END AS v, volume, high, low FROM b) WHERE NOT (v = 0 AND high = low) GROUP BY 1"))
def paused_filter(spark, sf_dir):
    b = bars_of(spark, sf_dir).withColumn("v", F.when(F.col("volume") == 1, 0.0).otherwise(F.col("volume"))).withColumn("singles", F.col("volume"))
    kept = src.normalize_bars(b.drop("volume"), {"volume": "v"})
    return kept.groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("volume") == 0).alias("singles"))


@query("adjusted_bars", oracles.select("SELECT symbol, seq, round(open * f, 6) AS open, round(high * f, 6) AS high, round(low * f, 6) AS low, round(close * f, 6) AS close FROM (SELECT *, 1 + (seq // 100) * 0.5 AS f FROM b)"))
def adjusted_bars(spark, sf_dir):
    b = bars_of(spark, sf_dir).withColumn("adj_factor", 1 + F.floor(F.col("seq") / 100) * 0.5)
    return src.adjust(b).select("symbol", F.col("seq").cast("long").alias("seq"), *r6("open", "high", "low", "close"))


@query("valid_bars", oracles.VALID_BARS)
def valid_bars(spark, sf_dir):
    return src.drop_invalid(spoiled(spark, sf_dir)).groupBy(*KEYS).agg(F.count("*").alias("n"))


@query("as_of_bars", oracles.select("SELECT symbol, count(*) AS n, max(dt) AS last_dt FROM b WHERE dt <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1"))
def as_of_bars(spark, sf_dir):
    return src.visible_bars(bars_of(spark, sf_dir), "2024-01-15 12:00:00").groupBy("symbol").agg(F.count("*").alias("n"), F.max("dt").alias("last_dt"))


@query("available_bars", oracles.select(
    "SELECT symbol, count(*) AS n, max(dt) AS last_dt FROM b WHERE dt + INTERVAL 65 MINUTE + CASE WHEN seq % 10 = 3 THEN INTERVAL 60 MINUTE ELSE INTERVAL 0 MINUTE END <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1"))
def available_bars(spark, sf_dir):
    b = src.with_arrival(bars_of(spark, sf_dir), "1 hour", late=F.col("seq") % 10 == 3)
    return src.available_bars(b, "2024-01-15 12:00:00").groupBy("symbol").agg(F.count("*").alias("n"), F.max("dt").alias("last_dt"))


# Base chain -----------------------------------------------------------------------------------------------------------


def records(spark, sf_dir, record: str, *columns) -> DataFrame:
    return st.project(st.structure(bars_of(spark, sf_dir), records={record}), record, *columns)


def merged_of(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir, "merged", "idx", "low", "high", "start_index", "end_index", "start_dt", "end_dt", "start_value", "end_value", "n")


@query("merged_bars", oracles.select("SELECT symbol, idx, low, high, first AS start_index, last AS end_index FROM m", "m"))
def merged_bars(spark, sf_dir):
    return merged_of(spark, sf_dir).select("symbol", *longs("idx"), "low", "high", *longs("start_index", "end_index"))


def longs(*names: str) -> list:
    return [F.col(n).cast("long").alias(n) for n in names]


@query("fractals", oracles.select("SELECT symbol, idx AS bar_index, kind, low3 AS low, high3 AS high, first_bar, last_bar FROM f", "f"))
def fractals(spark, sf_dir):
    return wn.fractals(merged_of(spark, sf_dir)).select("symbol", *longs("bar_index"), "kind", "low", "high", *longs("first_bar", "last_bar"))


STROKE = ("idx", "direction", "start_index", "end_index", "start_value", "end_value", "low", "high", "start_dt", "end_dt")
CENTER = ("idx", "direction", "zd", "zg", "gg", "dd", "n", "first", "last", "start_dt", "end_dt", "complete")


def strokes_of(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir, "stroke", *STROKE)


def centers_of(spark, sf_dir) -> DataFrame:
    return records(spark, sf_dir, "stroke_center", *CENTER)


@query("strokes_81", oracles.select("SELECT symbol, idx, direction, start_index, end_index, start_value, end_value FROM s", "s"))
def strokes_81(spark, sf_dir):
    return strokes_of(spark, sf_dir).select("symbol", *longs("idx"), "direction", *longs("start_index", "end_index"), "start_value", "end_value")


@query("strokes_106", oracles.STROKES_106)
def strokes_106(spark, sf_dir):
    return st.project(st.structure(bars_of(spark, sf_dir), standard="106", records={"stroke"}), "stroke", *STROKE)


@query("centers_stroke", oracles.select("SELECT symbol, idx, zd, zg, gg, dd, n, first, last FROM c", "c"))
def centers_stroke(spark, sf_dir):
    return centers_of(spark, sf_dir).select("symbol", *longs("idx"), "zd", "zg", "gg", "dd", *longs("n", "first", "last"))


@query("center_relations", oracles.CENTER_RELATIONS)
def center_relations(spark, sf_dir):
    return wn.center_relations(centers_of(spark, sf_dir)).select("symbol", *longs("idx"), "relation", "lineage_relation")


@query("trend_groups", oracles.TREND_GROUPS)
def trend_groups(spark, sf_dir):
    return wn.trend_groups(centers_of(spark, sf_dir)).select("symbol", F.col("grp").cast("long").alias("grp"), "type", "n", "zd", "zg")


@query("center_events", oracles.CENTER_EVENTS)
def center_events(spark, sf_dir):
    return records(spark, sf_dir, "center_event", "idx", "kind", "first", "last", "end_dt", "relation", "zd", "zg", "n")


@query("segments")
def segments(spark, sf_dir):
    return records(spark, sf_dir, "segment", *STROKE, "mode", "complete", "evidence_index", "evidence_dt", "first", "last")


@query("centers_segment")
def centers_segment(spark, sf_dir):
    return records(spark, sf_dir, "segment_center", *CENTER)


@query("overlap_starts", oracles.OVERLAP_STARTS)
def overlap_starts(spark, sf_dir):
    return wn.overlap_starts(strokes_of(spark, sf_dir)).select("symbol", *longs("idx"), "zd", "zg", "shared", F.col("next_center").cast("long").alias("next_center"))


@query("same_level_moves")
def same_level_moves(spark, sf_dir):
    return records(spark, sf_dir, "same_level", "idx", "kind", "complete", "direction", "first", "last", "low", "high", "n", "zd", "zg", "start_dt", "end_dt")


@query("level_up_moves")
def level_up_moves(spark, sf_dir):
    return records(spark, sf_dir, "level_up", "idx", "kind", "complete", "direction", "first", "last", "low", "high", "n", "zd", "zg", "start_dt", "end_dt")


@query("level_units")
def level_units(spark, sf_dir):
    return records(spark, sf_dir, "level_unit", "level", "idx", "kind", "direction", "low", "high", "start_dt", "end_dt")


@query("batch_points")
def batch_points(spark, sf_dir):
    return records(spark, sf_dir, "point", "idx", "kind", "end_dt", "end_value", "first", "ratio")


# Indicators -----------------------------------------------------------------------------------------------------------


@query("macd", oracles.select("SELECT symbol, seq, round(e12, 6) AS ema_fast, round(e12 - e26, 6) AS dif, round(dea, 6) AS dea, round((e12 - e26 - dea) * 2, 6) AS hist FROM e", "e"))
def macd(spark, sf_dir):
    return st.macd(bars_of(spark, sf_dir)).select("symbol", *longs("seq"), *r6("ema_fast", "dif", "dea", "hist"))


@query("macd_guard", oracles.select("SELECT symbol, seq, (e12 - e26 < 0) AND (dea < 0) AS below_zero FROM e", "e"))
def macd_guard(spark, sf_dir):
    m = st.macd(bars_of(spark, sf_dir))
    return m.select("symbol", *longs("seq"), classifiers.macd_below_zero(F.col("dif"), F.col("dea")).alias("below_zero"))


def lines_of(spark, sf_dir) -> DataFrame:
    return wn.with_lines(bars_of(spark, sf_dir))


@query("sma", oracles.select("SELECT symbol, seq, round(short, 6) AS short, round(long, 6) AS long FROM l", "l"))
def sma(spark, sf_dir):
    return lines_of(spark, sf_dir).select("symbol", *longs("seq"), *r6("short", "long"))


@query("above_sma", oracles.select(
    "SELECT symbol, seq, CASE WHEN count(*) OVER w = 13 THEN CAST(close AS DECIMAL(28,10)) * 13 > sum(CAST(close AS DECIMAL(28,10))) OVER w END AS above FROM b WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 12 PRECEDING)"))
def above_sma(spark, sf_dir):
    return bars_of(spark, sf_dir).select("symbol", *longs("seq"), wn.above_sma(F.col("close"), 13).alias("above"))


def bands_of(spark, sf_dir) -> DataFrame:
    return wn.boll(bars_of(spark, sf_dir))


@query("bands", oracles.select("SELECT symbol, seq, round(mid, 6) AS mid, round(upper, 6) AS upper, round(lower, 6) AS lower, state FROM bb", "bb"))
def bands(spark, sf_dir):
    return bands_of(spark, sf_dir).select("symbol", *longs("seq"), *r6("mid", "upper", "lower"), "state")


@query("band_events", oracles.BAND_EVENTS)
def band_events(spark, sf_dir):
    return wn.boll_changes(bands_of(spark, sf_dir)).select("symbol", *longs("seq"), "event")


@query("band_turns", oracles.BAND_TURNS)
def band_turns(spark, sf_dir):
    return st.band_turns(bands_of(spark, sf_dir))


@query("reentry_hints", oracles.REENTRY_HINTS)
def reentry_hints(spark, sf_dir):
    return st.reentry_hints(bands_of(spark, sf_dir))


@query("ma_alignment", oracles.ALIGNMENT)
def ma_alignment(spark, sf_dir):
    return wn.alignment(lines_of(spark, sf_dir)).select("symbol", *longs("seq"), "alignment")


@query("ma_areas", oracles.select("SELECT symbol, sign, start, stop AS \"end\", round(area, 6) AS area, bars, closed FROM a", "a"))
def ma_areas(spark, sf_dir):
    return wn.ma_areas(lines_of(spark, sf_dir)).select("symbol", *longs("sign", "start", "end"), *r6("area"), "bars", "closed")


@query("ma_weakening", oracles.MA_WEAKENING)
def ma_weakening(spark, sf_dir):
    return wn.ma_weakening(wn.ma_areas(lines_of(spark, sf_dir))).select("symbol", "direction", *longs("start", "idx"), *r6("area_prev", "area_last"))


@query("ma_strength", oracles.MA_STRENGTH)
def ma_strength(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    return wn.ma_strength(lines, wn.ma_areas(lines)).select("symbol", "direction", F.round("avg_current", 8).alias("avg_current"), F.round("avg_prev", 8).alias("avg_prev"), "forming_weak", *r6("stretch"), "shortening")


@query("ma_break", oracles.MA_BREAK)
def ma_break(spark, sf_dir):
    return wn.ma_break(lines_of(spark, sf_dir), "top").select("symbol", "tested", "recovered", *longs("break_index", "confirm_index", "streak"), "state")


@query("kisses")
def kisses(spark, sf_dir):
    return st.kisses(lines_of(spark, sf_dir))


@query("gaps", oracles.select("SELECT symbol, index_a, direction, lower, upper FROM g", "g"))
def gaps(spark, sf_dir):
    return wn.gaps(bars_of(spark, sf_dir)).select("symbol", *longs("index_a"), "direction", "lower", "upper")


@query("gap_strength", oracles.GAP_STRENGTH)
def gap_strength(spark, sf_dir):
    return wn.gap_strength(bars_of(spark, sf_dir)).select("symbol", *longs("index_a"), "direction", *longs("fill_index"), "extreme", "strength", "exhaustion")


@query("fractal_power", oracles.FRACTAL_POWER)
def fractal_power(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    m = st.project(st.structure(b, records={"merged"}), "merged", "idx", "low", "high", "start_index", "end_index", "end_dt", "start_value", "end_value")
    return wn.fractal_powers(m, wn.fractals(m)).select("symbol", *longs("bar_index"), "kind", "power")


@query("osc_monitor", oracles.OSC_MONITOR)
def osc_monitor(spark, sf_dir):
    whole = st.structure(bars_of(spark, sf_dir), records={"stroke", "stroke_center"})
    out = wn.oscillation(st.project(whole, "stroke", "idx", "low", "high"), st.project(whole, "stroke_center", "idx", "zd", "zg", "last"))
    return out.select("symbol", *longs("center"), *r6("z"), "n", "n_above", "n_below", "n_breaks", "status", "wedge", "strength", "upgrade_hint")


@query("zn_next", oracles.ZN_NEXT)
def zn_next(spark, sf_dir):
    return wn.zn_next(strokes_of(spark, sf_dir)).select("symbol", *r6("low", "high"))


@query("transition_phase", oracles.TRANSITION_PHASE)
def transition_phase(spark, sf_dir):
    return st.transition_phase(strokes_of(spark, sf_dir).withColumn("seq", F.col("idx")))


@query("range_divergences", oracles.RANGE_DIVERGENCES)
def range_divergences(spark, sf_dir):
    b = bars_of(spark, sf_dir)
    whole = st.structure(b, records={"stroke", "stroke_center"})
    swings = wn.stroke_swings(st.project(whole, "stroke", *STROKE), st.macd(b))
    return wn.range_divergences(swings, st.project(whole, "stroke_center", *CENTER)).select("symbol", *longs("center"), "direction", "dt", "price", F.round("area_prev", 4).alias("area_prev"), F.round("area_last", 4).alias("area_last"))


@query("third_points", oracles.THIRD_POINTS)
def third_points(spark, sf_dir):
    whole = st.structure(bars_of(spark, sf_dir), records={"stroke", "stroke_center"})
    out = wn.third_points(st.project(whole, "stroke", *STROKE), st.project(whole, "stroke_center", *CENTER))
    return out.select("symbol", *longs("center"), "side", "dt", "price", *r6("ratio"))


# Classifiers over whole truth tables ----------------------------------------------------------------------------------


def grid(spark: SparkSession, **values: str) -> DataFrame:
    """Every combination of the SQL arrays given by name: a fixed truth table."""
    out = spark.range(1).select(F.lit(0).alias("_"))
    for name, array in values.items():
        out = out.withColumn(name, F.explode(F.expr(array)))
    return out.drop("_")


@query("stroke_states", oracles.STROKE_STATES)
def stroke_states(spark, sf_dir):
    d = grid(spark, direction="array('up','down','flat')", forming="array('top','bottom','other',cast(null as string))")
    state = classifiers.bi_state(F.col("direction"), F.col("forming"))
    return d.select("direction", "forming", state["d"].alias("d"), state["e"].alias("e"))


@query("state_transitions", oracles.STATE_TRANSITIONS)
def state_transitions(spark, sf_dir):
    d = grid(spark, d="array(1,-1,0)", e="array(1,0,2)", nd="array(1,-1,0)", ne="array(1,0,2)")
    return d.select("*", classifiers.bi_transition_valid(*(F.col(c) for c in ("d", "e", "nd", "ne"))).alias("valid"))


@query("disease_stage", oracles.DISEASE_STAGE)
def disease_stage(spark, sf_dir):
    d = grid(spark, hd="array(1,-1)", he="array(1,0)", ld="array(1,-1)", le="array(1,0)", trend="array(1,-1,0)")
    stage = classifiers.disease_stage(*(F.col(c) for c in ("hd", "he", "ld", "le", "trend")))
    return d.select("*", stage.alias("stage"), classifiers.severity_rank(stage).alias("severity"))


@query("turn_class", oracles.TURN_CLASS)
def turn_class(spark, sf_dir):
    d = grid(spark, trend="array('up','down','flat')", pull="array(8.9D,9.0D,9.5D,10.0D,10.5D,11.0D,11.5D,12.0D,12.1D)")
    c = [F.lit(x) for x in (10.0, 11.0, 12.0, 9.0)]
    return d.select("*", classifiers.turn_class(*c, F.col("pull"), F.col("trend")).alias("turn"), F.round(classifiers.rebound_gap(c[2], c[3], F.col("pull"), F.col("trend")), 6).alias("rebound"))


@query("minor_turn", oracles.MINOR_TURN)
def minor_turn(spark, sf_dir):
    d = grid(spark, trend="array('up','down')", low="array(8.0D,10.0D,11.0D,14.0D,16.0D)", height="array(0.5D,4.0D,9.0D)", bs3="array(true,false)", zd="array(cast(null as double),12.0D)")
    stage = classifiers.minor_turn_stage(F.lit(9.0), F.lit(10.0), F.col("low"), F.col("low") + F.col("height"), F.col("trend"), F.col("zd"), F.col("zd") + 1, F.col("bs3"))
    return d.select("*", stage.alias("stage"))


@query("followup_quality", oracles.FOLLOWUP)
def followup_quality(spark, sf_dir):
    d = grid(spark, direction="array('up','down')", low="array(5.0D,8.0D,10.0D,11.0D,12.0D,13.0D)", high="array(6.0D,10.0D,12.0D,14.0D)")
    return d.select("*", classifiers.followup_quality(F.lit(12.0), F.lit(10.0), F.col("low"), F.col("high"), F.col("direction")).alias("quality"))


@query("center_health", oracles.CENTER_HEALTH)
def center_health(spark, sf_dir):
    """Each stroke center against all before it in its series."""
    c = centers_of(spark, sf_dir)
    before = F.collect_list(F.struct("zd", "zg")).over(Window.partitionBy(*KEYS).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    d = c.select("symbol", *longs("idx"), "zd", "zg", before.alias("previous"))
    return d.select("symbol", "idx", classifiers.center_health(F.col("previous"), F.col("zd"), F.col("zg")).alias("health"))


@query("kiss_kind", oracles.KISS_KIND)
def kiss_kind(spark, sf_dir):
    d = grid(spark, crossings="array(0,1,2)", min_gap="array(0.0D,0.4D,0.5D,0.6D)")
    return d.select("*", classifiers.kiss_kind(F.col("crossings"), F.col("min_gap"), F.lit(1.0)).alias("kind"))


@query("finite_sides", oracles.FINITE_SIDES)
def finite_sides(spark, sf_dir):
    d = grid(spark, a="array(1.0D,2.0D,cast(null as double),double('NaN'),double('Infinity'))", b="array(1.0D,2.0D,cast(null as double))")
    a, b = intervals.finite(F.col("a")), intervals.finite(F.col("b"))
    return d.select(a.alias("a"), b.alias("b"), intervals.side_of(a, b).alias("side"), (b - a).alias("gap"))


# Sectors --------------------------------------------------------------------------------------------------------------


@query("ma_class", oracles.MA_CLASS)
def ma_class(spark, sf_dir):
    return wn.ma_class(src.sector_bars(spark, sf_dir), 200, extra=["sector"]).select("symbol", "sector", F.col("class_no").cast("long").alias("class_no"))


@query("sector_strength", oracles.SECTOR_STRENGTH)
def sector_strength(spark, sf_dir):
    out = wn.sector_strength(wn.ma_class(src.sector_bars(spark, sf_dir), 200, extra=["sector"]))
    return out.select("sector", *r6("mean_class"), "valid", "total", *r6("coverage"), *(f"class_{i}" for i in range(1, 10)))


# A long series, spread over tasks ------------------------------------------------------------------------------------


@query("order_bars", oracles.select("SELECT symbol, seq, dt, open, high, low, close, volume FROM b", orders=True))
def order_bars(spark, sf_dir):
    return src.order_bars(spark, sf_dir).select("symbol", *longs("seq"), "dt", "open", "high", "low", "close", "volume")


def order_chain(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return split.base_chain_of(src.order_bars(spark, sf_dir), run=4096)


@query("order_merged_bars", oracles.select("SELECT symbol, idx, low, high, first AS start_index, last AS end_index FROM m", "m", orders=True))
def order_merged_bars(spark, sf_dir):
    return order_chain(spark, sf_dir)[0].select("symbol", *longs("idx"), "low", "high", *longs("start_index", "end_index"))


@query("order_strokes", oracles.select("SELECT symbol, idx, direction, start_index, end_index, start_value, end_value FROM s", "s", orders=True))
def order_strokes(spark, sf_dir):
    return order_chain(spark, sf_dir)[1].select("symbol", *longs("idx"), "direction", *longs("start_index", "end_index"), "start_value", "end_value")


@query("order_centers", oracles.select("SELECT symbol, idx, direction, zd, zg, gg, dd, n, first, last FROM c", "c", orders=True))
def order_centers(spark, sf_dir):
    found = st.project(st.structure_of_strokes(order_chain(spark, sf_dir)[1], records={"stroke_center"}), "stroke_center", *CENTER)
    return found.select("symbol", *longs("idx"), "direction", "zd", "zg", "gg", "dd", *longs("n", "first", "last"))


@query("order_structure")
def order_structure(spark, sf_dir):
    """What the strokes of the long series decide, by record."""
    return st.structure_of_strokes(order_chain(spark, sf_dir)[1]).groupBy(*KEYS, "record").count()


# Segments under premises ----------------------------------------------------------------------------------------------


def premised(spark, sf_dir) -> DataFrame:
    """Strokes of two periods under four premises: nothing known, the start given, no history (where the first stroke begins), and no history learnt too late."""
    bars = src.event_bars(spark, sf_dir, "10 minutes").unionByName(bars_of(spark, sf_dir))
    strokes = st.project(st.structure(bars, records={"stroke"}), "stroke", *STROKE)
    told = [("unknown", "unknown", "null"), ("given", "given_recent", "0"), ("none", "no_prior_history", "0"), ("late", "no_prior_history", "1000000")]
    kinds = F.array(*[F.struct(F.lit(n).alias("premise"), F.lit(b).alias("basis"), F.expr(k).cast("int").alias("known_at")) for n, b, k in told])
    premises = st.first_meeting(strokes).select(*KEYS, "first", "direction", "price", F.inline(kinds)).where((F.col("basis") != "no_prior_history") | (F.col("first") == 0))
    return st.premised_segments(strokes, premises)


@query("premised_segments")
def premised_segments(spark, sf_dir):
    return premised(spark, sf_dir).where("record <> 'certificate'").select(*KEYS, "premise", "record", "segment", "first", "last", "mode", "proof", "kind")


@query("segment_certificates")
def segment_certificates(spark, sf_dir):
    found = premised(spark, sf_dir).where("record = 'certificate'")
    return found.select(*KEYS, "premise", "segment", "stroke", "kind", "state", "standing", "proof", "published", "reaction_first", "reaction_stop")


# As-of and causal layers ----------------------------------------------------------------------------------------------


@query("as_of_structure")
def as_of_structure(spark, sf_dir):
    return st.structure(src.visible_bars(bars_of(spark, sf_dir), "2024-01-15 12:00:00")).groupBy(*KEYS, "record").count()


def observations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Bars of which some arrive late and some are corrected later, and an irregular grid of observation times for each series."""
    first = src.with_arrival(bars_of(spark, sf_dir), "1 hour", late=F.col("seq") % 10 == 3)
    second = first.where("seq % 50 = 7").withColumn("high", F.col("high") + 1).withColumn("close", F.col("close") + 1).withColumn("available_dt", F.expr("available_dt + interval 150 minutes"))
    grid = first.where(F.col("seq").isin(0, 9, 58, 60, 121, 122, 300) | (F.col("seq") % 211 == 13)).select(*KEYS, F.expr("available_dt + interval 30 seconds").alias("observed"))
    return first.unionByName(second), grid


def seen_at(record: str, *columns: str):
    def run(spark, sf_dir):
        return st.analyze_available(*observations(spark, sf_dir), records={record}).where(F.col("record") == record).select("symbol", "observed", *columns)

    return run


@query("observed_bars", oracles.observed("SELECT name AS symbol, observed, count(*) AS n, max(dt) AS last_dt, max(high) AS high, min(low) AS low, CAST(sum(close) AS DOUBLE) AS closes FROM (SELECT name, observed, dt, high, low, CAST(close AS DECIMAL(18,4)) AS close FROM b) GROUP BY 1, 2"))
def observed_bars(spark, sf_dir):
    seen = src.observed_bars(*observations(spark, sf_dir))
    return seen.groupBy("symbol", "observed").agg(F.count("*").alias("n"), F.max("dt").alias("last_dt"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum(F.col("close").cast("decimal(18,4)")).cast("double").alias("closes"))


def observed_names(part: str) -> str:
    return f"(SELECT x.*, n.name, n.observed FROM {part} x JOIN (SELECT DISTINCT symbol, name, observed FROM b) n ON n.symbol = x.symbol)"


@query("observed_strokes", oracles.observed(f"SELECT name AS symbol, observed, idx, direction, start_value, end_value, start_dt, end_dt FROM {observed_names('s')}", "s"))
def observed_strokes(spark, sf_dir):
    return seen_at("stroke", *longs("idx"), "direction", "start_value", "end_value", "start_dt", "end_dt")(spark, sf_dir)


@query("observed_centers", oracles.observed(f"SELECT name AS symbol, observed, idx, zd, zg, gg, dd, n, first, last FROM {observed_names('c')}", "c"))
def observed_centers(spark, sf_dir):
    return seen_at("stroke_center", *longs("idx"), "zd", "zg", "gg", "dd", *longs("n", "first", "last"))(spark, sf_dir)


@query("replay_ledger")
def replay_ledger(spark, sf_dir):
    return st.replay_ledger(bars_of(spark, sf_dir))


@query("replay_arrivals")
def replay_arrivals(spark, sf_dir):
    b = src.with_arrival(src.event_bars(spark, sf_dir, "4 hours"), "4 hours", late=F.col("seq") % 10 == 3)
    return st.replay_arrivals(b)


def units_of(spark, sf_dir) -> DataFrame:
    """Strokes as confirmed units, known two periods after they end."""
    s = strokes_of(spark, sf_dir)
    return s.select(*KEYS, F.col("idx").alias("seq"), F.concat_ws(":", F.lit("stroke"), "idx").alias("move_id"), F.lit(1).alias("level"), "direction", "start_value", "end_value", "low", "high", "start_dt", "end_dt", F.expr("end_dt + interval 2 hours").alias("confirmed_dt"))


def moves_of(spark, sf_dir) -> DataFrame:
    return units_of(spark, sf_dir).withColumn("sub_level", F.lit("stroke"))


def late() -> Column:
    """After all data."""
    return F.lit("2030-01-01").cast("timestamp_ntz")


@query("confirmed_moves")
def confirmed_moves(spark, sf_dir):
    from datetime import datetime

    return st.confirmed_moves(units_of(spark, sf_dir), datetime(2030, 1, 1))


@query("first_points")
def first_points(spark, sf_dir):
    return st.first_points(units_of(spark, sf_dir), src.with_arrival(bars_of(spark, sf_dir), "1 hour"))


def contexts_of(spark, sf_dir) -> DataFrame:
    """Every stroke's end as an anchor."""
    u = units_of(spark, sf_dir)
    return u.select(
        *KEYS, F.concat_ws(":", F.lit("context"), "seq").alias("context_id"), F.lit("target").alias("level"), F.lit("stroke").alias("sub_level"), F.when(F.col("direction") == "down", "buy").otherwise("sell").alias("side"),
        F.when(F.col("seq") % 2 == 0, "first").otherwise("minor_turn").alias("source"), F.col("end_dt").alias("anchor_dt"), F.col("end_value").alias("anchor_price"), "confirmed_dt", F.lit(None).cast("timestamp_ntz").alias("ended_dt"),
    )


def causal_centers(spark, sf_dir) -> DataFrame:
    """Stroke centers as known from the confirmation of their third stroke."""
    c = centers_of(spark, sf_dir).select(*KEYS, "idx", "zd", "zg", (F.col("first") + 2).alias("seq"))
    u = units_of(spark, sf_dir).select(*KEYS, "seq", "confirmed_dt")
    return c.join(u, [*KEYS, "seq"]).select(*KEYS, F.concat_ws(":", F.lit("center"), "idx").alias("center_id"), "zd", "zg", "confirmed_dt")


@query("second_points", oracles.SECOND_POINTS)
def second_points(spark, sf_dir):
    out = cf.second_points(moves_of(spark, sf_dir), contexts_of(spark, sf_dir), late())
    return out.select("symbol", "kind", "context_id", "dt", "price", "confirmed_dt", "strength", "move_id", "pull_move_id")


@query("confirmed_third_points", oracles.CONFIRMED_THIRD)
def confirmed_third_points(spark, sf_dir):
    c = causal_centers(spark, sf_dir).select("*", F.col("center_id").alias("context_id"), F.lit("target").alias("level"), F.lit("stroke").alias("sub_level"))
    return cf.third_points(moves_of(spark, sf_dir), c, late()).select("symbol", "kind", "center_id", "dt", "price", "confirmed_dt", "move_id", "pull_move_id")


@query("formations", oracles.FORMATIONS)
def formations(spark, sf_dir):
    """Each center's own confirmation as a buy point of that center, settled by its third point."""
    c = causal_centers(spark, sf_dir)
    third = cf.third_points(moves_of(spark, sf_dir), c.select("*", F.col("center_id").alias("context_id"), F.lit("target").alias("level"), F.lit("stroke").alias("sub_level")), late())
    first = c.select(*KEYS, F.col("center_id").alias("context_id"), F.lit("buy1").alias("kind"), F.lit("target").alias("level"), "center_id", "confirmed_dt")
    return cf.formation_states(first, third, F.lit("2024-01-20").cast("timestamp_ntz")).select("symbol", "context_id", "phase", "formation", "boundary", "ended_dt")


@query("fractal_ranges", oracles.FRACTAL_RANGES)
def fractal_ranges(spark, sf_dir):
    b = src.with_arrival(bars_of(spark, sf_dir), "1 hour")
    f = wn.fractals(merged_of(spark, sf_dir))
    f = f.join(b.select(*KEYS, F.col("seq").alias("last_bar"), F.col("available_dt").alias("confirmed_dt")), [*KEYS, "last_bar"])
    f = f.select(*KEYS, F.col("bar_index").alias("fractal_id"), "kind", "low", "high", "confirmed_dt")
    return cf.fractal_range_states(f, b, late()).select("symbol", *longs("fractal_id"), "phase", "first_test", "ended_dt", *longs("streak"), "recovered")


@query("strict_verdicts")
def strict_verdicts(spark, sf_dir):
    from .operators.causal import travel

    return st.strict_verdicts(units_of(spark, sf_dir), force=lambda a, b: (travel(a), travel(b)), force_method="travel")


@query("center_lineage")
def center_lineage(spark, sf_dir):
    return st.center_lineage(units_of(spark, sf_dir))


@query("point_rounds")
def point_rounds(spark, sf_dir):
    """First points with their causal center, its third point, formation, second point and handover."""
    p = st.first_points(units_of(spark, sf_dir), src.with_arrival(bars_of(spark, sf_dir), "1 hour")).where("record = 'point'")
    m = moves_of(spark, sf_dir)
    base = p.select(*KEYS, "context_id", "kind", F.lit("target").alias("level"), F.lit("stroke").alias("sub_level"), F.coalesce("causal_id", F.lit("none")).alias("center_id"), F.col("causal_zd").alias("zd"), F.col("causal_zg").alias("zg"), "causal_dt", "confirmed_dt", "dt", "price")
    third = cf.third_points(m, base.where("causal_dt is not null").drop("confirmed_dt").withColumnRenamed("causal_dt", "confirmed_dt"), late())
    states = cf.formation_states(base, third, late())
    contexts = base.select(*KEYS, "context_id", "level", "sub_level", F.when(F.col("kind") == "buy1", "buy").otherwise("sell").alias("side"), F.lit("first").alias("source"), F.col("dt").alias("anchor_dt"), F.col("price").alias("anchor_price"), "confirmed_dt")
    ended = contexts.join(states.select(*KEYS, "context_id", "ended_dt"), [*KEYS, "context_id"], "left")
    second = cf.second_points(m, ended, late()).select(*KEYS, "context_id", F.col("dt").alias("second_dt"), "strength")
    handover = F.min("confirmed_dt").over(Window.partitionBy(*KEYS, "kind").orderBy("confirmed_dt").rowsBetween(1, Window.unboundedFollowing))
    rounds = base.withColumn("handover_dt", handover)
    return rounds.join(states, [*KEYS, "context_id"], "left").join(second, [*KEYS, "context_id"], "left").select(*KEYS, "context_id", "kind", "dt", "price", "confirmed_dt", "phase", "ended_dt", "second_dt", "strength", "handover_dt")


@query("nested_divergence", oracles.NESTED)
def nested_divergence(spark, sf_dir):
    """Chains over numbers spread by arithmetic: a fixed truth table of three levels."""
    d = spark.range(120).select(F.col("id").alias("chain_id"), F.explode(F.array(*(F.lit(x) for x in (1, 2, 3)))).alias("level"))
    k = (F.col("chain_id") * 7 + F.col("level") * 5) % 11
    d = d.select(
        "chain_id", F.col("level").cast("long").alias("level"), F.when(F.col("chain_id") % 2 == 0, "up").otherwise("down").alias("direction"), F.lit(10.0).alias("ref_low"), F.lit(20.0).alias("ref_high"),
        (11.0 - k % 4).alias("cand_low"), (19.0 + k % 4).alias("cand_high"), F.when(F.col("chain_id") % 2 == 0, 5.0).otherwise(-5.0).alias("ref_strength"), F.when(F.col("chain_id") % 2 == 0, k - 1.0).otherwise(1.0 - k).alias("cand_strength"),
        F.timestamp_add("HOUR", (F.col("level") + k % 2).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("start_dt"), F.timestamp_add("HOUR", (20 - F.col("level")).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("end_dt"),
    )
    return cf.nested_divergence(d).select("chain_id", "level", "reason", *r6("ratio"), "complete", "turn_dt", "turn_price")


@query("level_reading")
def level_reading(spark, sf_dir):
    return cf.level_reading(level_units(spark, sf_dir), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))


@query("change_starts_low")
def change_starts_low(spark, sf_dir):
    whole = st.structure(bars_of(spark, sf_dir), records={"level_unit", "level_up"})
    return cf.change_starts_low(st.project(whole, "level_unit", "level", "idx", "direction"), st.project(whole, "level_up", "idx", "direction", "first", "last"))


def cross_period(spark, sf_dir):
    """Fine bars' structure, and the coarse period's third buy points as signals."""
    fine, coarse = src.event_bars(spark, sf_dir, "30 minutes"), st.structure(src.event_bars(spark, sf_dir, "4 hours"), records={"stroke", "stroke_center"})
    third = wn.third_points(st.project(coarse, "stroke", *STROKE), st.project(coarse, "stroke_center", *CENTER))
    named = third.join(st.project(coarse, "stroke_center", F.col("idx").alias("center"), "zd", "zg"), [*KEYS, "center"])
    signals = named.select("symbol", F.lit("30 minutes").alias("freq"), F.concat_ws(":", "side", "center").alias("signal_id"), F.col("dt").alias("signal_dt"), "side", "zd", "zg", "price")
    return fine, st.structure(fine, records={"merged", "stroke", "stroke_center"}), signals


@query("run_exhaustion")
def run_exhaustion(spark, sf_dir):
    fine, whole, signals = cross_period(spark, sf_dir)
    return cf.run_exhaustion(st.project(whole, "stroke", *STROKE), st.macd(fine), st.project(whole, "stroke_center", *CENTER), "down", signals.select(*KEYS, "signal_id", "signal_dt"), stale_days=40, min_prev_swing=0.00001, closes=fine)


@query("confirm_third")
def confirm_third(spark, sf_dir):
    fine, whole, signals = cross_period(spark, sf_dir)
    buys = signals.where("side = 'buy'")
    ex = cf.run_exhaustion(st.project(whole, "stroke", *STROKE), st.macd(fine), st.project(whole, "stroke_center", *CENTER), "down", buys.select(*KEYS, "signal_id", "signal_dt"), stale_days=40)
    return cf.confirm_third(ex, buys.select(*KEYS, "signal_id", "zd", "zg"), "buy")


@query("confirm_second")
def confirm_second(spark, sf_dir):
    _, whole, signals = cross_period(spark, sf_dir)
    m = st.project(whole, "merged", "idx", "low", "high", "start_index", "end_index", "end_dt")
    return cf.confirm_second(wn.fractals(m), signals.select(*KEYS, "signal_id", "signal_dt", "price"), pierce_tol=0.01)


@query("ma_points")
def ma_points(spark, sf_dir):
    return st.ma_points(src.with_arrival(bars_of(spark, sf_dir), "1 hour"), settings=MaSettings(min_pre_gain=0.0))


@query("ma_point_states")
def ma_point_states(spark, sf_dir):
    return st.ma_point_states(src.with_arrival(bars_of(spark, sf_dir), "1 hour"))


@query("strict_layers")
def strict_layers(spark, sf_dir):
    """Complete segments as the coarse layer, strokes as the fine one."""
    from .operators.causal import travel

    whole = st.structure(bars_of(spark, sf_dir))
    fine = units_of(spark, sf_dir).withColumn("layer", F.lit(1))
    coarse = st.project(whole, "segment", "idx", "direction", "start_value", "end_value", "low", "high", "start_dt", "end_dt", "evidence_dt", "complete").where("complete")
    coarse = coarse.select(*KEYS, F.col("idx").alias("seq"), F.concat_ws(":", F.lit("segment"), "idx").alias("move_id"), F.lit(2).alias("level"), "direction", "start_value", "end_value", "low", "high", "start_dt", "end_dt", F.expr("evidence_dt + interval 2 hours").alias("confirmed_dt"), F.lit(0).alias("layer"))
    return st.strict_layers(coarse.unionByName(fine), force=lambda a, b: (travel(a), travel(b)), force_method="travel")


# Depth ----------------------------------------------------------------------------------------------------------------


@query("structure_10m")
def structure_10m(spark, sf_dir):
    """All records of ten-minute bars, counted."""
    return st.structure(src.event_bars(spark, sf_dir, "10 minutes")).groupBy(*KEYS, "record").count()


@query("replay_full_grid")
def replay_full_grid(spark, sf_dir):
    """The ledger at every ten-minute bar, counted by kind."""
    return st.replay_ledger(src.event_bars(spark, sf_dir, "10 minutes")).groupBy(*KEYS, "kind", "field").count()
