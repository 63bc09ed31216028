"""SQL twins of the native queries, in DuckDB's dialect; folds are recursive common table expressions."""

from __future__ import annotations

_TICKS = """px AS (SELECT event_type AS symbol, event_id, ts, CAST(1000 AS DECIMAL(18,4)) + SUM(CAST(CASE WHEN event_id * 7919 % 13 < 7 THEN 1 ELSE -1 END AS DECIMAL(18,4))
    * CAST(value AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(4,2))) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS p FROM events)"""


def _bars(hours: int = 1) -> str:
    return f"""b0 AS (SELECT symbol, time_bucket(INTERVAL '{hours} hours', ts) AS dt, CAST(arg_min(p, event_id) AS DOUBLE) AS open, CAST(max(p) AS DOUBLE) AS high,
      CAST(min(p) AS DOUBLE) AS low, CAST(arg_max(p, event_id) AS DOUBLE) AS close, CAST(count(*) AS DOUBLE) AS volume FROM px GROUP BY 1, 2),
    b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS seq FROM b0)"""


_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_ORDERS = f"""px AS (SELECT l_orderkey, row_number() OVER w AS tick, CAST(1000 + SUM(CAST(CASE WHEN (l_orderkey * 7919 + l_linenumber * 104729) % 13 < 7 THEN 1 ELSE -1 END AS DECIMAL(18,4))
      * CAST(l_quantity AS DECIMAL(10,2)) * CAST(0.01 AS DECIMAL(4,2))) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS p FROM lineitem WINDOW w AS (ORDER BY {_LINES})),
    b0 AS (SELECT l_orderkey, arg_min(p, tick) AS open, max(p) AS high, min(p) AS low, arg_max(p, tick) AS close, CAST(count(*) AS DOUBLE) AS volume FROM px GROUP BY 1),
    b AS MATERIALIZED (SELECT 'orders' AS symbol, k AS seq, CAST(TIMESTAMP '2020-01-01' AS TIMESTAMP) + to_minutes(k) AS dt, open, high, low, close, volume
      FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey) - 1 AS k FROM b0))"""
_INSIDE = "((b.high <= r.h AND b.low >= r.l) OR (b.high >= r.h AND b.low <= r.l))"
_RISING = "(CASE WHEN r.ph IS NOT NULL THEN r.h >= r.ph ELSE b.high >= r.h END)"

_PARTS = {
    "m": f"""mr AS (
      SELECT symbol, seq, CAST(0 AS BIGINT) AS idx, high AS h, low AS l, CAST(NULL AS DOUBLE) AS ph, seq AS first FROM b WHERE seq = 0
      UNION ALL
      SELECT b.symbol, b.seq, CASE WHEN {_INSIDE} THEN r.idx ELSE r.idx + 1 END,
        CASE WHEN NOT {_INSIDE} THEN b.high WHEN {_RISING} THEN greatest(r.h, b.high) ELSE least(r.h, b.high) END,
        CASE WHEN NOT {_INSIDE} THEN b.low WHEN {_RISING} THEN greatest(r.l, b.low) ELSE least(r.l, b.low) END,
        CASE WHEN {_INSIDE} THEN r.ph ELSE r.h END, CASE WHEN {_INSIDE} THEN r.first ELSE b.seq END
      FROM mr r JOIN b ON b.symbol = r.symbol AND b.seq = r.seq + 1),
    m AS MATERIALIZED (SELECT symbol, idx, arg_max(h, seq) AS high, arg_max(l, seq) AS low, min(first) AS first, max(seq) AS last FROM mr GROUP BY 1, 2)""",
    "f": """fw AS (SELECT *, lag(high) OVER w AS h0, lead(high) OVER w AS h2, lag(low) OVER w AS l0, lead(low) OVER w AS l2, lag(first) OVER w AS first_bar, lead(last) OVER w AS last_bar
      FROM m WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
    fk AS (SELECT *, CASE WHEN high > greatest(h0, h2) AND low > greatest(l0, l2) THEN 'top' WHEN high < least(h0, h2) AND low < least(l0, l2) THEN 'bottom' END AS kind FROM fw WHERE h0 IS NOT NULL AND h2 IS NOT NULL),
    f AS MATERIALIZED (SELECT symbol, idx, kind, high, low, CASE WHEN kind = 'top' THEN least(l0, low, l2) ELSE low END AS low3, CASE WHEN kind = 'bottom' THEN greatest(h0, high, h2) ELSE high END AS high3,
      first_bar, last_bar, CASE WHEN kind = 'top' THEN high ELSE low END AS v, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS no FROM fk WHERE kind IS NOT NULL)""",
    "s": """pr AS (
      SELECT symbol, no, CAST(0 AS BIGINT) AS pno, kind, idx, v FROM f WHERE no = 1
      UNION ALL
      SELECT f.symbol, f.no, CASE WHEN f.kind <> r.kind AND f.idx - r.idx > 3 AND (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE r.v > f.v END) THEN r.pno + 1 ELSE r.pno END,
        CASE WHEN f.kind <> r.kind AND f.idx - r.idx > 3 AND (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE r.v > f.v END) THEN f.kind ELSE r.kind END,
        CASE WHEN f.kind = r.kind THEN (CASE WHEN (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE f.v < r.v END) THEN f.idx ELSE r.idx END)
             WHEN f.idx - r.idx > 3 AND (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE r.v > f.v END) THEN f.idx ELSE r.idx END,
        CASE WHEN f.kind = r.kind THEN (CASE WHEN f.kind = 'top' THEN greatest(f.v, r.v) ELSE least(f.v, r.v) END)
             WHEN f.idx - r.idx > 3 AND (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE r.v > f.v END) THEN f.v ELSE r.v END
      FROM pr r JOIN f ON f.symbol = r.symbol AND f.no = r.no + 1),
    pv AS (SELECT symbol, pno, arg_max(kind, no) AS kind, arg_max(idx, no) AS idx, arg_max(v, no) AS v FROM pr GROUP BY 1, 2),
    s0 AS (SELECT symbol, pno AS idx, CASE WHEN kind = 'top' THEN 'down' ELSE 'up' END AS direction, idx AS start_index, lead(idx) OVER w AS end_index, v AS start_value, lead(v) OVER w AS end_value
      FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY pno)),
    s AS MATERIALIZED (SELECT s0.*, least(start_value, end_value) AS low, greatest(start_value, end_value) AS high, ba.dt AS start_dt, bb_.dt AS end_dt, x.last AS start_seq, y.last AS end_seq FROM s0
      JOIN m x ON x.symbol = s0.symbol AND x.idx = s0.start_index JOIN m y ON y.symbol = s0.symbol AND y.idx = s0.end_index
      JOIN b ba ON ba.symbol = s0.symbol AND ba.seq = x.last JOIN b bb_ ON bb_.symbol = s0.symbol AND bb_.seq = y.last WHERE end_index IS NOT NULL)""",
    "c": """sw AS MATERIALIZED (SELECT *, greatest(low, lag(low, 1) OVER w, lag(low, 2) OVER w) AS zd3, least(high, lag(high, 1) OVER w, lag(high, 2) OVER w) AS zg3 FROM s WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
    cr AS (
      SELECT symbol, idx, CAST(-1 AS BIGINT) AS no, false AS inside, CAST(0 AS BIGINT) AS seed, CAST(NULL AS DOUBLE) AS zd, CAST(NULL AS DOUBLE) AS zg, CAST(NULL AS BIGINT) AS first FROM s WHERE idx = 0
      UNION ALL
      SELECT u.symbol, u.idx,
        CASE WHEN NOT (r.inside AND u.low <= r.zg AND u.high >= r.zd) AND NOT r.inside AND u.idx - r.seed >= 2 AND u.zd3 < u.zg3 THEN r.no + 1 ELSE r.no END,
        (r.inside AND u.low <= r.zg AND u.high >= r.zd) OR (NOT r.inside AND u.idx - r.seed >= 2 AND u.zd3 < u.zg3),
        CASE WHEN r.inside AND NOT (u.low <= r.zg AND u.high >= r.zd) THEN u.idx ELSE r.seed END,
        CASE WHEN r.inside THEN r.zd WHEN u.idx - r.seed >= 2 AND u.zd3 < u.zg3 THEN u.zd3 ELSE r.zd END,
        CASE WHEN r.inside THEN r.zg WHEN u.idx - r.seed >= 2 AND u.zd3 < u.zg3 THEN u.zg3 ELSE r.zg END,
        CASE WHEN NOT r.inside AND u.idx - r.seed >= 2 AND u.zd3 < u.zg3 THEN u.idx - 2 ELSE r.first END
      FROM cr r JOIN sw u ON u.symbol = r.symbol AND u.idx = r.idx + 1),
    c0 AS (SELECT symbol, no AS idx, max(zd) AS zd, max(zg) AS zg, max(first) AS first, max(idx) AS last FROM cr WHERE inside GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT c0.symbol, c0.idx, c0.zd, c0.zg, max(s.high) AS gg, min(s.low) AS dd, c0.last - c0.first + 1 AS n, c0.first, c0.last, arg_min(s.direction, s.idx) AS direction, min(s.start_dt) AS start_dt
      FROM c0 JOIN s ON s.symbol = c0.symbol AND s.idx BETWEEN c0.first AND c0.last GROUP BY ALL)""",
    "e": """er AS (
      SELECT symbol, seq, close AS e12, close AS e26, CAST(0 AS DOUBLE) AS dea FROM b WHERE seq = 0
      UNION ALL
      SELECT b.symbol, b.seq, b.close * (2.0 / 13) + r.e12 * (1 - 2.0 / 13), b.close * (2.0 / 27) + r.e26 * (1 - 2.0 / 27),
        ((b.close * (2.0 / 13) + r.e12 * (1 - 2.0 / 13)) - (b.close * (2.0 / 27) + r.e26 * (1 - 2.0 / 27))) * 0.2 + r.dea * 0.8
      FROM er r JOIN b ON b.symbol = r.symbol AND b.seq = r.seq + 1),
    e AS MATERIALIZED (SELECT er.*, b.dt FROM er JOIN b USING (symbol, seq))""",
    "l": """l AS MATERIALIZED (SELECT symbol, seq, dt, close, CASE WHEN count(*) OVER w5 = 5 THEN CAST(sum(CAST(close AS DECIMAL(28,10))) OVER w5 AS DOUBLE) / 5 END AS short,
        CASE WHEN count(*) OVER w10 = 10 THEN CAST(sum(CAST(close AS DECIMAL(28,10))) OVER w10 AS DOUBLE) / 10 END AS long,
        CASE WHEN count(*) OVER w10 = 10 THEN 2 * sum(CAST(close AS DECIMAL(28,10))) OVER w5 - sum(CAST(close AS DECIMAL(28,10))) OVER w10 END AS d10,
        CASE WHEN count(*) OVER w5 = 5 THEN 5 * CAST(close AS DECIMAL(28,10)) - sum(CAST(close AS DECIMAL(28,10))) OVER w5 END AS c5
      FROM b WINDOW w5 AS (PARTITION BY symbol ORDER BY seq ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY seq ROWS 9 PRECEDING))""",
    "a": """ai AS (SELECT symbol, seq, sign(d10) AS sign, short - long AS d, CASE WHEN sign(d10) IS NOT DISTINCT FROM lag(sign(d10)) OVER (PARTITION BY symbol ORDER BY seq) THEN 0 ELSE 1 END AS edge, max(seq) OVER (PARTITION BY symbol) AS tail FROM l WHERE d10 IS NOT NULL),
    ag AS (SELECT *, sum(edge) OVER (PARTITION BY symbol ORDER BY seq) AS island FROM ai),
    a AS MATERIALIZED (SELECT symbol, CAST(sign AS BIGINT) AS sign, min(seq) AS start, max(seq) AS stop, sum(d) AS area, count(*) AS bars, sum(d) / count(*) AS avg_area, max(seq) < max(tail) AS closed FROM ag WHERE sign <> 0 GROUP BY symbol, island, sign)""",
    "bb": """b1 AS (SELECT symbol, seq, close, count(*) OVER w AS n, avg(close) OVER w AS mid0, stddev_pop(close) OVER w AS dev FROM b WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS 19 PRECEDING)),
    b2 AS (SELECT symbol, seq, close, CASE WHEN n = 20 THEN mid0 END AS mid, CASE WHEN n = 20 THEN mid0 + 2 * dev END AS upper, CASE WHEN n = 20 THEN mid0 - 2 * dev END AS lower FROM b1),
    bb AS MATERIALIZED (SELECT *, CASE WHEN close > upper THEN 'super_up' WHEN close < lower THEN 'super_down' WHEN upper IS NOT NULL THEN 'normal' END AS state FROM b2)""",
    "g": """gw AS (SELECT symbol, seq AS index_a, high, low, lead(high) OVER w AS nh, lead(low) OVER w AS nl FROM b WINDOW w AS (PARTITION BY symbol ORDER BY seq)),
    g AS MATERIALIZED (SELECT symbol, index_a, CASE WHEN nl > high THEN 'up' ELSE 'down' END AS direction, CASE WHEN nl > high THEN high ELSE nh END AS lower, CASE WHEN nl > high THEN nl ELSE low END AS upper FROM gw WHERE nl > high OR nh < low)""",
}
_NEEDS = {"m": [], "f": ["m"], "s": ["m", "f"], "c": ["m", "f", "s"], "e": [], "l": [], "a": ["l"], "bb": [], "g": []}


#: Each observation's view of a series, as a series of its own: the latest version of every bar that had arrived.
_OBSERVED = """v0 AS (SELECT symbol, dt, open, high, low, close, volume, dt + INTERVAL 65 MINUTE + CASE WHEN seq % 10 = 3 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS arrived, seq FROM hourly),
    v AS (SELECT * FROM v0 UNION ALL SELECT symbol, dt, open, high + 1, low, close + 1, volume, arrived + INTERVAL 150 MINUTE, seq FROM v0 WHERE seq % 50 = 7),
    o AS (SELECT DISTINCT symbol, arrived + INTERVAL 30 SECOND AS observed FROM v0 WHERE seq IN (0, 9, 58, 60, 121, 122, 300) OR seq % 211 = 13),
    w AS (SELECT o.observed, v.*, row_number() OVER (PARTITION BY v.symbol, o.observed, v.dt ORDER BY v.arrived DESC) AS version FROM v JOIN o ON o.symbol = v.symbol AND v.arrived <= o.observed),
    b AS MATERIALIZED (SELECT symbol || '@' || observed AS symbol, symbol AS name, observed, dt, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol, observed ORDER BY dt) - 1 AS seq FROM w WHERE version = 1)"""


def observed(sql: str, *parts: str) -> str:
    """A statement over the observations' views."""
    return select(sql, *parts).replace("b AS MATERIALIZED (SELECT *, row_number()", "hourly AS MATERIALIZED (SELECT *, row_number()", 1).replace("FROM b0)", "FROM b0),\n" + _OBSERVED, 1)


def select(sql: str, *parts: str, hours: int = 1, orders: bool = False) -> str:
    """A statement over the bars `b` (of events, or the long series of orders) and the named parts, with all that these need."""
    wanted: list[str] = []
    for p in parts:
        wanted += [x for x in [*_NEEDS[p], p] if x not in wanted]
    return "WITH RECURSIVE " + ",\n".join([*([_ORDERS] if orders else [_TICKS, _bars(hours)]), *(_PARTS[p] for p in wanted)]) + "\n" + sql


_SPOILED = """sp AS (SELECT symbol, '1 hour' AS freq, seq, CASE WHEN seq % 50 = 7 THEN lag(dt, 2) OVER (PARTITION BY symbol ORDER BY seq) ELSE dt END AS dt, open, CASE WHEN seq % 50 = 11 THEN open - 1000 ELSE high END AS high,
  CASE WHEN seq % 50 = 13 THEN -low ELSE low END AS low, CASE WHEN seq % 50 = 17 THEN NULL ELSE close END AS close, CASE WHEN seq % 50 = 19 THEN -1 WHEN seq % 50 = 23 THEN 0 ELSE volume END AS volume FROM b)"""


def _over_spoiled(sql: str) -> str:
    return select("", hours=1).rstrip() + ",\n" + _SPOILED + "\n" + sql


VIOLATIONS = _over_spoiled("""SELECT symbol, freq, seq, rule FROM (
  SELECT symbol, freq, seq, unnest([
    CASE WHEN dt IS NULL THEN 'dt_missing' END, CASE WHEN dt <= lag(dt) OVER (PARTITION BY symbol ORDER BY seq) THEN 'dt_not_increasing' END, CASE WHEN close IS NULL THEN 'not_finite' END,
    CASE WHEN close IS NOT NULL AND least(open, high, low, close) <= 0 THEN 'price_not_positive' END, CASE WHEN close IS NOT NULL AND volume < 0 THEN 'volume_negative' END,
    CASE WHEN close IS NOT NULL AND (low > least(open, close) OR high < greatest(open, close)) THEN 'outside_range' END]) AS rule FROM sp) WHERE rule IS NOT NULL""")
VALID_BARS = _over_spoiled("SELECT symbol, freq, count(*) AS n FROM sp WHERE close IS NOT NULL AND least(open, high, low, close) > 0 AND low <= least(open, close) AND high >= greatest(open, close) GROUP BY 1, 2")
CENTER_RELATIONS = select("""SELECT symbol, idx, CASE WHEN pz IS NULL THEN NULL WHEN gg < pd THEN 'down_continue' WHEN dd > pg THEN 'up_continue' ELSE 'expand' END AS relation,
  CASE WHEN pz IS NULL THEN NULL WHEN gg < pd THEN 'down_continue' WHEN dd > pg THEN 'up_continue' WHEN zg < pz OR zd > pzg THEN 'higher_level' ELSE 'overlap' END AS lineage_relation
  FROM (SELECT *, lag(zd) OVER w AS pz, lag(zg) OVER w AS pzg, lag(gg) OVER w AS pg, lag(dd) OVER w AS pd FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx))""", "c")
TREND_GROUPS = select("""SELECT symbol, grp::BIGINT AS grp, CASE WHEN count(*) >= 2 THEN 'trend' ELSE 'range' END AS type, count(*) AS n, arg_min(zd, idx) AS zd, arg_min(zg, idx) AS zg FROM (
  SELECT *, sum(edge) OVER (PARTITION BY symbol ORDER BY idx) AS grp FROM (
    SELECT *, CASE WHEN (zg < lag(zd) OVER w OR zd > lag(zg) OVER w) AND direction = lag(direction) OVER w THEN 0 ELSE 1 END AS edge FROM c WINDOW w AS (PARTITION BY symbol ORDER BY idx))) GROUP BY symbol, grp""", "c")
OVERLAP_STARTS = select("""SELECT symbol, idx, zd, zg, coalesce(zd <= zg, false) AS shared, min(CASE WHEN zd <= zg THEN idx END) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_center FROM (
  SELECT symbol, idx, CASE WHEN lead(low, 2) OVER w IS NOT NULL THEN greatest(low, lead(low, 1) OVER w, lead(low, 2) OVER w) END AS zd, CASE WHEN lead(low, 2) OVER w IS NOT NULL THEN least(high, lead(high, 1) OVER w, lead(high, 2) OVER w) END AS zg
  FROM s WINDOW w AS (PARTITION BY symbol ORDER BY idx))""", "s")
BAND_EVENTS = select("""SELECT symbol, seq, event FROM (SELECT symbol, seq, unnest([
    CASE WHEN state = 'super_up' AND state IS DISTINCT FROM prior THEN 'super_up_enter' END, CASE WHEN prior = 'super_up' AND state <> prior THEN 'super_up_exit' END,
    CASE WHEN state = 'super_down' AND state IS DISTINCT FROM prior THEN 'super_down_enter' END, CASE WHEN prior = 'super_down' AND state <> prior THEN 'super_down_exit' END,
    CASE WHEN seq >= 39 AND upper - lower <= narrow * 0.6 THEN 'squeeze' END]) AS event
  FROM (SELECT *, lag(state) OVER (PARTITION BY symbol ORDER BY seq) AS prior, min(upper - lower) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS narrow FROM bb)) WHERE event IS NOT NULL""", "bb")
ALIGNMENT = select("""SELECT symbol, seq, CASE WHEN d10 IS NOT NULL THEN last_value(CASE WHEN d10 > 0 THEN 'up' WHEN d10 < 0 THEN 'down' END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq) END AS alignment FROM l""", "l")
MA_WEAKENING = select("""SELECT symbol, CASE WHEN sign > 0 THEN 'up' ELSE 'down' END AS direction, start, stop AS idx, round(abs(prior), 6) AS area_prev, round(abs(area), 6) AS area_last
  FROM (SELECT *, lag(area) OVER (PARTITION BY symbol, sign ORDER BY start) AS prior FROM a) WHERE closed AND abs(area) < abs(prior)""", "a")
MA_STRENGTH = select("""SELECT x.symbol, CASE WHEN sign > 0 THEN 'up' ELSE 'down' END AS direction, round(avg_area, 8) AS avg_current, round(prior, 8) AS avg_prev, abs(avg_area) < abs(prior) AS forming_weak, round(d, 6) AS stretch, abs(d) < abs(pd) AS shortening
  FROM (SELECT *, lag(avg_area) OVER (PARTITION BY symbol, sign ORDER BY start) AS prior, row_number() OVER (PARTITION BY symbol ORDER BY start DESC) AS place FROM a) x
  JOIN (SELECT symbol, short - long AS d, lag(short - long) OVER (PARTITION BY symbol ORDER BY seq) AS pd, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS place FROM l WHERE d10 IS NOT NULL) y ON x.symbol = y.symbol AND y.place = 1
  WHERE x.place = 1""", "a")
MA_BREAK = select("""SELECT symbol, bool_or(beyond) AS tested, coalesce(bool_or(NOT beyond AND c5 IS NOT NULL AND before BETWEEN 1 AND 1), false) AS recovered, min(CASE WHEN beyond THEN seq END) AS break_index, min(CASE WHEN run >= 2 THEN seq END) AS confirm_index,
    arg_max(run, seq)::BIGINT AS streak, CASE WHEN max(run) >= 2 THEN 'effective' WHEN arg_max(run, seq) > 0 THEN 'testing' ELSE 'none' END AS state
  FROM (SELECT *, lag(run, 1, 0) OVER (PARTITION BY symbol ORDER BY seq) AS before FROM (
    SELECT *, sum(CASE WHEN beyond THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, island ORDER BY seq) AS run FROM (
      SELECT *, sum(CASE WHEN beyond THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY seq) AS island FROM (SELECT symbol, seq, c5, coalesce(c5 < 0, false) AS beyond FROM l)))) GROUP BY symbol""", "l")
# every point of a gap's range is covered once all elementary intervals between touched prices are
GAP_STRENGTH = select("""SELECT symbol, index_a, direction, fill AS fill_index, CASE WHEN fill IS NOT NULL THEN CASE WHEN direction = 'up' THEN top ELSE bottom END END AS extreme,
    CASE WHEN fill IS NULL THEN 'strong' WHEN fresh THEN 'neutral' ELSE 'weak' END AS strength, fill IS NOT NULL AND NOT fresh AS exhaustion
  FROM (SELECT t.*, coalesce(CASE WHEN direction = 'up' THEN (SELECT max(high) FROM b WHERE b.symbol = t.symbol AND b.seq > t.fill) > top ELSE (SELECT min(low) FROM b WHERE b.symbol = t.symbol AND b.seq > t.fill) < bottom END, false) AS fresh
    FROM (SELECT z.*, (SELECT max(high) FROM b WHERE b.symbol = z.symbol AND b.seq BETWEEN z.index_a + 1 AND z.fill) AS top, (SELECT min(low) FROM b WHERE b.symbol = z.symbol AND b.seq BETWEEN z.index_a + 1 AND z.fill) AS bottom
      FROM (SELECT g.symbol, g.index_a, g.direction, CASE WHEN bool_and(first_seq IS NOT NULL) THEN max(first_seq) END AS fill
        FROM g JOIN (
          SELECT symbol, index_a, lo_, hi_, (SELECT min(b.seq) FROM b WHERE b.symbol = q.symbol AND b.seq > q.index_a + 1 AND b.low <= q.lo_ AND b.high >= q.hi_) AS first_seq
          FROM (SELECT symbol, index_a, price AS lo_, lead(price) OVER (PARTITION BY symbol, index_a ORDER BY price) AS hi_ FROM (
            SELECT symbol, index_a, lower AS price FROM g UNION SELECT symbol, index_a, upper FROM g
            UNION SELECT g.symbol, g.index_a, b.low FROM g JOIN b ON b.symbol = g.symbol AND b.seq > g.index_a + 1 AND b.low > g.lower AND b.low < g.upper
            UNION SELECT g.symbol, g.index_a, b.high FROM g JOIN b ON b.symbol = g.symbol AND b.seq > g.index_a + 1 AND b.high > g.lower AND b.high < g.upper)) q WHERE hi_ IS NOT NULL) parts
        ON parts.symbol = g.symbol AND parts.index_a = g.index_a GROUP BY ALL) z) t)""", "g")
FRACTAL_POWER = select("""SELECT symbol, bar_index, kind, CASE WHEN rng <= 0 THEN 'neutral' WHEN NOT contained AND c_low < a_low AND c_close <= (a_high + a_low) / 2 THEN 'severe'
    WHEN (greatest(0, b_high - greatest(b_open, b_close)) / rng >= 0.25 OR (b_close < b_open AND abs(b_close - b_open) / rng >= 0.35)) AND NOT (c_close > c_open AND c_close > (b_high + b_low) / 2) THEN 'strong'
    WHEN (a_close > a_open AND b_close < b_open AND b_high >= a_high AND b_low <= a_low AND abs(b_close - b_open) / rng >= 0.35) OR (b_close > b_open AND c_close < c_open AND c_high >= b_high AND c_low <= b_low AND abs(c_close - c_open) / rng >= 0.35) THEN 'strong'
    WHEN a_close > a_open AND abs(a_close - a_open) / rng >= 0.35 AND abs(b_close - b_open) / rng <= 0.15 AND abs(c_close - c_open) / rng <= 0.15 THEN 'weak' ELSE 'neutral' END AS power
  FROM (SELECT *, greatest(a_high, b_high, c_high) - least(a_low, b_low, c_low) AS rng,
      (a_high >= b_high AND a_low <= b_low) OR (a_high <= b_high AND a_low >= b_low) OR (c_high >= b_high AND c_low <= b_low) OR (c_high <= b_high AND c_low >= b_low) AS contained
    FROM (SELECT f.symbol, f.idx AS bar_index, f.kind, s * x.open AS a_open, s * x.close AS a_close, CASE WHEN s > 0 THEN x.high ELSE -x.low END AS a_high, CASE WHEN s > 0 THEN x.low ELSE -x.high END AS a_low,
        s * y.open AS b_open, s * y.close AS b_close, CASE WHEN s > 0 THEN y.high ELSE -y.low END AS b_high, CASE WHEN s > 0 THEN y.low ELSE -y.high END AS b_low,
        s * z.open AS c_open, s * z.close AS c_close, CASE WHEN s > 0 THEN z.high ELSE -z.low END AS c_high, CASE WHEN s > 0 THEN z.low ELSE -z.high END AS c_low
      FROM (SELECT *, CASE WHEN kind = 'top' THEN 1 ELSE -1 END AS s FROM f) f
      JOIN (SELECT m.*, o.open, k.close FROM m JOIN b o ON o.symbol = m.symbol AND o.seq = m.first JOIN b k ON k.symbol = m.symbol AND k.seq = m.last) x ON x.symbol = f.symbol AND x.idx = f.idx - 1
      JOIN (SELECT m.*, o.open, k.close FROM m JOIN b o ON o.symbol = m.symbol AND o.seq = m.first JOIN b k ON k.symbol = m.symbol AND k.seq = m.last) y ON y.symbol = f.symbol AND y.idx = f.idx
      JOIN (SELECT m.*, o.open, k.close FROM m JOIN b o ON o.symbol = m.symbol AND o.seq = m.first JOIN b k ON k.symbol = m.symbol AND k.seq = m.last) z ON z.symbol = f.symbol AND z.idx = f.idx + 1))""", "f")
OSC_MONITOR = select("""SELECT symbol, center, round(z, 6) AS z, count(*) AS n, count(*) FILTER (zn BETWEEN zd AND zg AND zn >= z) AS n_above, count(*) FILTER (zn BETWEEN zd AND zg AND zn < z) AS n_below, count(*) FILTER (zn > zg OR zn < zd) AS n_breaks,
    CASE WHEN count(*) FILTER (zn > zg OR zn < zd) > 0 THEN 'breaking' ELSE 'in_range' END AS status,
    CASE WHEN count(*) >= 4 AND bool_and(coalesce(step > 0, true)) AND max(zn) <= max(zg) THEN 'rising_wedge' WHEN count(*) >= 4 AND bool_and(coalesce(step < 0, true)) AND min(zn) >= min(zd) THEN 'falling_wedge' END AS wedge,
    CASE WHEN 2 * count(*) FILTER (zn BETWEEN zd AND zg AND zn >= z) > count(*) THEN 'strong' WHEN 2 * count(*) FILTER (zn BETWEEN zd AND zg AND zn < z) > count(*) THEN 'weak' ELSE 'balanced' END AS strength, count(*) >= 9 AS upgrade_hint
  FROM (SELECT c.symbol, c.idx AS center, c.zd, c.zg, (c.zd + c.zg) / 2 AS z, (s.low + s.high) / 2 AS zn, (s.low + s.high) / 2 - lag((s.low + s.high) / 2) OVER (PARTITION BY c.symbol, c.idx ORDER BY s.idx) AS step
    FROM c JOIN s ON s.symbol = c.symbol AND s.idx > c.last) GROUP BY symbol, center, z""", "c")
ZN_NEXT = select("""SELECT symbol, round(now_ + (now_ - then_) / (k - 1) - half, 6) AS low, round(now_ + (now_ - then_) / (k - 1) + half, 6) AS high FROM (
  SELECT symbol, count(*) AS k, arg_max((low + high) / 2, idx) AS now_, arg_min((low + high) / 2, idx) AS then_, avg((high - low) / 2) AS half
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY idx DESC) AS place FROM s) WHERE place <= 4 GROUP BY 1) WHERE k >= 2""", "s")
RANGE_DIVERGENCES = select("""SELECT d.symbol, c.idx AS center, d.direction, d.end_dt AS dt, d.end_value AS price, round(d.prior, 4) AS area_prev, round(abs(d.area), 4) AS area_last
  FROM (SELECT *, abs(lag(area, 2) OVER w) AS prior, lag(end_value, 2) OVER w AS prior_end FROM (
      SELECT s.*, (SELECT CAST(sum(CAST((e12 - e26 - dea) * 2 AS DECIMAL(38,18))) AS DOUBLE) FROM e WHERE e.symbol = s.symbol AND e.seq BETWEEN s.start_seq AND s.end_seq) AS area FROM s) WINDOW w AS (PARTITION BY symbol ORDER BY idx)) d
  JOIN c ON c.symbol = d.symbol WHERE abs(d.area) < d.prior AND CASE WHEN d.direction = 'up' THEN d.end_value > d.prior_end AND d.end_value <= c.gg * 1.15 ELSE d.end_value < d.prior_end AND d.end_value >= c.dd * 0.85 END""", "c", "e")
THIRD_POINTS = select("""SELECT symbol, center, side, dt, price, round(ratio, 6) AS ratio FROM (
  SELECT symbol, center, side, arg_min(dt, idx) AS dt, arg_min(pull, idx) AS price, arg_min(abs(end_value / start_value - 1) / nullif(abs(pull / end_value - 1), 0), idx) AS ratio FROM (
    SELECT p.*, c.idx AS center, CASE WHEN p.direction = 'up' THEN 'buy' ELSE 'sell' END AS side
    FROM (SELECT *, lead(end_value) OVER w AS pull, lead(end_dt) OVER w AS dt FROM s WINDOW w AS (PARTITION BY symbol ORDER BY idx)) p JOIN c ON c.symbol = p.symbol
    WHERE pull IS NOT NULL AND p.start_dt >= c.start_dt AND CASE WHEN p.direction = 'up' THEN p.end_value > c.zg AND pull >= c.zg ELSE p.end_value < c.zd AND pull <= c.zd END) GROUP BY 1, 2, 3) WHERE ratio > 1.005""", "c")

STROKE_STATES = """SELECT direction, forming, CASE WHEN legal THEN CASE WHEN turned THEN -side ELSE side END END AS d, CASE WHEN legal THEN CASE WHEN forming IS NULL OR turned THEN 1 ELSE 0 END END AS e FROM (
  SELECT *, coalesce((direction = 'up' AND forming = 'bottom') OR (direction = 'down' AND forming = 'top'), false) AS turned, CASE direction WHEN 'up' THEN 1 WHEN 'down' THEN -1 END AS side,
    direction IN ('up', 'down') AND (forming IS NULL OR forming IN ('top', 'bottom')) AS legal
  FROM (VALUES ('up'), ('down'), ('flat')) a(direction), (VALUES ('top'), ('bottom'), ('other'), (NULL)) b(forming))"""
STATE_TRANSITIONS = """SELECT d, e, nd, ne, (d, e, nd, ne) IN ((1,1,1,0), (-1,1,-1,0), (1,0,1,1), (1,0,-1,1), (-1,0,1,1), (-1,0,-1,1)) AS valid
  FROM (VALUES (1), (-1), (0)) a(d), (VALUES (1), (0), (2)) b(e), (VALUES (1), (-1), (0)) c(nd), (VALUES (1), (0), (2)) x(ne)"""
DISEASE_STAGE = """SELECT *, CASE stage WHEN 'sick_worst' THEN 1 WHEN 'sick_second' THEN 2 WHEN 'sick_third' THEN 3 WHEN 'turn_window' THEN 4 END AS severity FROM (
  SELECT hd, he, ld, le, trend, CASE WHEN trend NOT IN (1, -1) THEN NULL ELSE CASE (hd * trend, he, ld * trend, le)
    WHEN (1,1,1,1) THEN 'healthy' WHEN (1,1,1,0) THEN 'warning' WHEN (1,1,-1,1) THEN 'prodromal' WHEN (1,1,-1,0) THEN 'prodromal' WHEN (1,0,1,1) THEN 'critical' WHEN (1,0,1,0) THEN 'critical'
    WHEN (1,0,-1,1) THEN 'onset' WHEN (1,0,-1,0) THEN 'onset' WHEN (-1,1,-1,1) THEN 'sick_worst' WHEN (-1,1,-1,0) THEN 'sick_second' WHEN (-1,0,-1,1) THEN 'sick_third' WHEN (-1,0,-1,0) THEN 'turn_window' ELSE 'recovering' END END AS stage
  FROM (VALUES (1), (-1)) a(hd), (VALUES (1), (0)) b(he), (VALUES (1), (-1)) c(ld), (VALUES (1), (0)) d(le), (VALUES (1), (-1), (0)) e(trend))"""
TURN_CLASS = """SELECT trend, pull, CASE trend WHEN 'down' THEN CASE WHEN pull >= 10 THEN 'turn' WHEN pull >= 9 THEN 'expansion' ELSE 'sub_floor' END WHEN 'up' THEN CASE WHEN pull <= 11 THEN 'turn' WHEN pull <= 12 THEN 'expansion' ELSE 'sub_floor' END END AS turn,
  round(CASE trend WHEN 'down' THEN (9.0 - pull) / 9.0 WHEN 'up' THEN (pull - 12.0) / 12.0 END, 6) AS rebound
  FROM (VALUES ('up'), ('down'), ('flat')) a(trend), (SELECT unnest([8.9::DOUBLE, 9, 9.5, 10, 10.5, 11, 11.5, 12, 12.1]) AS pull)"""
MINOR_TURN = """SELECT trend, low, height, bs3, zd, CASE trend WHEN 'up' THEN CASE WHEN low <= 10 THEN 'breakout' WHEN bs3 THEN 'sub_bs3' WHEN low > zd + 1 THEN 'strong' ELSE 'within' END
    ELSE CASE WHEN low + height >= 9 THEN 'breakout' WHEN bs3 THEN 'sub_bs3' WHEN low + height < zd THEN 'strong' ELSE 'within' END END AS stage
  FROM (VALUES ('up'), ('down')) a(trend), (SELECT unnest([8::DOUBLE, 10, 11, 14, 16]) AS low), (SELECT unnest([0.5::DOUBLE, 4, 9]) AS height), (VALUES (true), (false)) d(bs3), (SELECT unnest([NULL, 12::DOUBLE]) AS zd)"""
FOLLOWUP = """SELECT direction, low, high, CASE WHEN NOT (greatest(low, high) < 10 OR least(low, high) > 12) THEN 'strong' WHEN (direction = 'up' AND least(low, high) > 12) OR (direction = 'down' AND greatest(low, high) < 10) THEN 'reverse' ELSE 'weak' END AS quality
  FROM (VALUES ('up'), ('down')) a(direction), (SELECT unnest([5::DOUBLE, 8, 10, 11, 12, 13]) AS low), (SELECT unnest([6::DOUBLE, 10, 12, 14]) AS high)"""
CENTER_HEALTH = select("""SELECT symbol, idx, CASE WHEN k = 0 THEN NULL WHEN meets_last THEN 'healthy' WHEN meets_any THEN 'dangerous' ELSE 'extreme' END AS health FROM (
  SELECT x.symbol, x.idx, count(y.idx) AS k, coalesce(bool_or(y.idx = x.idx - 1 AND x.zd <= y.zg AND x.zg >= y.zd), false) AS meets_last, coalesce(bool_or(x.zd <= y.zg AND x.zg >= y.zd), false) AS meets_any
  FROM c x LEFT JOIN c y ON y.symbol = x.symbol AND y.idx < x.idx GROUP BY 1, 2)""", "c")
KISS_KIND = """SELECT crossings, min_gap, CASE WHEN crossings > 0 THEN 'wet' WHEN min_gap <= 0.5 THEN 'lip' ELSE 'fly' END AS kind FROM (VALUES (0), (1), (2)) a(crossings), (SELECT unnest([0::DOUBLE, 0.4, 0.5, 0.6]) AS min_gap)"""
FINITE_SIDES = """SELECT a, b, CASE WHEN b > a THEN 'up' WHEN b < a THEN 'down' END AS side, b - a AS gap FROM (SELECT unnest([1::DOUBLE, 2, NULL, NULL, NULL]) AS a), (SELECT unnest([1::DOUBLE, 2, NULL]) AS b)"""

_SECTORS = """tk AS (SELECT n_name AS symbol, r_name AS sector, o_orderdate AS ts, o_orderkey AS k, CAST(1000 AS DECIMAL(24,6)) + sum(CAST(CAST(CASE WHEN o_orderkey * 7919 % 13 < 7 THEN 1 ELSE -1 END AS DECIMAL(18,4)) * CAST(o_totalprice AS DECIMAL(14,2)) * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(24,6)))
    OVER (PARTITION BY n_name ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  wk AS (SELECT symbol, sector, time_bucket(INTERVAL '7 days', ts) AS dt, CAST(CAST(arg_max(p, (ts, k)) AS DOUBLE) AS DECIMAL(28,10)) AS close FROM tk GROUP BY 1, 2, 3),
  sb AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS seq FROM wk),
  pd AS (SELECT unnest([5, 13, 21, 34, 55, 89, 144, 233]) AS n, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS place),
  cum AS MATERIALIZED (SELECT *, sum(close) OVER (PARTITION BY symbol ORDER BY seq) AS upto FROM sb),
  ab AS (SELECT x.symbol, x.sector, pd.place, bool_or(CASE WHEN x.seq >= n - 1 THEN x.close * n > x.upto - coalesce(y.upto, 0) END) AS won, bool_or(x.seq < n - 1) AS missing FROM cum x CROSS JOIN pd LEFT JOIN cum y ON y.symbol = x.symbol AND y.seq = x.seq - n WHERE x.seq >= 200 GROUP BY 1, 2, 3),
  cl AS (SELECT symbol, sector, CASE WHEN min(CASE WHEN won IS NOT TRUE THEN place END) IS NULL THEN 9 WHEN arg_min(missing, CASE WHEN won IS NOT TRUE THEN place END) THEN NULL ELSE min(CASE WHEN won IS NOT TRUE THEN place END) END::BIGINT AS class_no FROM ab GROUP BY 1, 2)"""
MA_CLASS = "WITH " + _SECTORS + " SELECT symbol, sector, class_no FROM cl"
SECTOR_STRENGTH = "WITH " + _SECTORS + " SELECT sector, round(avg(class_no), 6) AS mean_class, count(class_no) AS valid, count(*) AS total, round(count(class_no) / count(*), 6) AS coverage, " + ", ".join(f"count(*) FILTER (class_no = {i}) AS class_{i}" for i in range(1, 10)) + " FROM cl GROUP BY sector"

SECOND_POINTS = select("""SELECT symbol, side || '2' AS kind, 'context:' || idx AS context_id, p_end_dt AS dt, p_end AS price, p_end_dt + INTERVAL 2 HOUR AS confirmed_dt,
    CASE WHEN (side = 'buy' AND p_end < anchor) OR (side = 'sell' AND p_end > anchor) THEN 'weak' ELSE 'normal' END AS strength, 'stroke:' || (idx + 1) AS move_id, 'stroke:' || (idx + 2) AS pull_move_id
  FROM (SELECT symbol, idx, CASE WHEN direction = 'down' THEN 'buy' ELSE 'sell' END AS side, end_value AS anchor, lead(end_value, 2) OVER w AS p_end, lead(end_dt, 2) OVER w AS p_end_dt, lead(low, 2) OVER w AS p_low, lead(high, 2) OVER w AS p_high
    FROM s WINDOW w AS (PARTITION BY symbol ORDER BY idx))
  WHERE p_end IS NOT NULL AND NOT (idx % 2 = 1 AND ((side = 'buy' AND p_low < anchor) OR (side = 'sell' AND p_high > anchor)))""", "s")
_THIRD = """kn AS (SELECT c.symbol, c.idx, c.zd, c.zg, s.end_dt + INTERVAL 2 HOUR AS known FROM c JOIN s ON s.symbol = c.symbol AND s.idx = c.first + 2),
  pq AS (SELECT *, lead(low) OVER w AS p_low, lead(high) OVER w AS p_high, lead(end_value) OVER w AS p_end, lead(end_dt) OVER w AS p_dt FROM s WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
  th AS (SELECT kn.symbol, kn.idx, arg_min(CASE WHEN direction = 'up' THEN 'buy3' ELSE 'sell3' END, pq.idx) AS kind, arg_min(p_dt, pq.idx) AS dt, arg_min(p_end, pq.idx) AS price, min(pq.idx) AS leave
    FROM kn JOIN pq ON pq.symbol = kn.symbol AND pq.start_dt >= kn.known AND p_end IS NOT NULL AND low <= zg AND high >= zd
      AND CASE WHEN direction = 'up' THEN end_value > zg AND p_low >= zg ELSE end_value < zd AND p_high <= zd END GROUP BY 1, 2)"""


def _after_centers(sql: str) -> str:
    return select("", "c").rstrip() + ",\n" + _THIRD + "\n" + sql


CONFIRMED_THIRD = _after_centers("SELECT symbol, kind, 'center:' || idx AS center_id, dt, price, dt + INTERVAL 2 HOUR AS confirmed_dt, 'stroke:' || leave AS move_id, 'stroke:' || (leave + 1) AS pull_move_id FROM th")
FORMATIONS = _after_centers("""SELECT symbol, context_id, CASE WHEN NOT seen THEN 'waiting' WHEN kind IS NULL THEN 'constructing' WHEN kind = 'buy3' THEN 'completed' ELSE 'failed' END AS phase, CASE WHEN seen THEN 'bottom' END AS formation, kind AS boundary, ended_dt
  FROM (SELECT kn.symbol, 'center:' || kn.idx AS context_id, known <= TIMESTAMP '2024-01-20' AS seen, th.kind, th.dt + INTERVAL 2 HOUR AS ended_dt
    FROM kn LEFT JOIN th ON th.symbol = kn.symbol AND th.idx = kn.idx AND th.dt + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-20' AND known <= TIMESTAMP '2024-01-20')""")
FRACTAL_RANGES = select("""SELECT symbol, fractal_id, coalesce(ends, CASE WHEN streak > 0 THEN 'testing' ELSE 'constructing' END) AS phase, first_test, ended_dt, coalesce(streak, 0)::BIGINT AS streak, coalesce(recovered, false) AS recovered
  FROM (SELECT symbol, idx AS fractal_id FROM f) LEFT JOIN (
    SELECT symbol, fractal_id, arg_max(ends, seq) AS ends, arg_max(CASE WHEN broken THEN prior ELSE run END, seq) AS streak, min(CASE WHEN beyond THEN arrived END) AS first_test, bool_or(NOT beyond AND NOT broken AND prior > 0) AS recovered, max(CASE WHEN ends IS NOT NULL THEN arrived END) AS ended_dt
    FROM (SELECT *, coalesce(count(ends) OVER (PARTITION BY symbol, fractal_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM (
      SELECT *, CASE WHEN broken THEN 'failed' WHEN run >= 2 THEN 'completed' END AS ends, lag(run, 1, 0) OVER (PARTITION BY symbol, fractal_id ORDER BY seq) AS prior FROM (
        SELECT *, sum(beyond::INT) OVER (PARTITION BY symbol, fractal_id, island ORDER BY seq) AS run FROM (
          SELECT *, sum(CASE WHEN beyond THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, fractal_id ORDER BY seq) AS island FROM (
            SELECT *, NOT broken AND CASE WHEN kind = 'bottom' THEN close > high3 ELSE close < low3 END AS beyond FROM (
              SELECT f.symbol, f.idx AS fractal_id, f.kind, f.low3, f.high3, b.seq, b.close, b.dt + INTERVAL 65 MINUTE AS arrived, CASE WHEN f.kind = 'bottom' THEN b.low < f.low3 ELSE b.high > f.high3 END AS broken
              FROM f JOIN b k ON k.symbol = f.symbol AND k.seq = f.last_bar JOIN b ON b.symbol = f.symbol AND b.dt + INTERVAL 1 HOUR > k.dt + INTERVAL 65 MINUTE)))))) WHERE over = 0 GROUP BY 1, 2) USING (symbol, fractal_id)""", "f")
NESTED = """WITH d0 AS (SELECT chain_id, level, (chain_id * 7 + level * 5) % 11 AS k FROM range(120) x(chain_id), (VALUES (1), (2), (3)) y(level)),
  d AS (SELECT chain_id, level, chain_id % 2 = 0 AS up, 11.0 - k % 4 AS cand_low, 19.0 + k % 4 AS cand_high, CASE WHEN chain_id % 2 = 0 THEN k - 1.0 ELSE 1.0 - k END AS cand, CASE WHEN chain_id % 2 = 0 THEN 5.0 ELSE -5.0 END AS ref,
    TIMESTAMP '2024-01-01' + to_hours((level + k % 2)::INT) AS start_dt, TIMESTAMP '2024-01-01' + to_hours((20 - level)::INT) AS end_dt FROM d0),
  v AS (SELECT *, CASE WHEN NOT coalesce(start_dt >= lag(start_dt) OVER w AND end_dt <= lag(end_dt) OVER w, true) THEN 'not_nested' WHEN NOT (CASE WHEN up THEN cand_high > 20 ELSE cand_low < 10 END) THEN 'no_new_extreme'
    WHEN (up AND cand <= 0) OR (NOT up AND cand >= 0) THEN 'weak_sign' WHEN (up AND cand >= ref) OR (NOT up AND cand <= ref) THEN 'stronger' ELSE 'bc' END AS reason FROM d WINDOW w AS (PARTITION BY chain_id ORDER BY level)),
  r AS (SELECT *, coalesce(sum((reason <> 'bc')::INT) OVER (PARTITION BY chain_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM v)
  SELECT chain_id, level::BIGINT AS level, reason, round(cand / ref, 6)::DOUBLE AS ratio, whole AS complete, CASE WHEN whole AND level = 3 THEN end_dt END AS turn_dt, CASE WHEN whole AND level = 3 THEN CASE WHEN up THEN cand_high ELSE cand_low END END::DOUBLE AS turn_price
  FROM (SELECT *, bool_and(reason = 'bc') OVER (PARTITION BY chain_id) AS whole FROM r WHERE broken = 0)"""

BAND_TURNS = select("""SELECT symbol, '1 hour' AS freq, CAST(seq AS INTEGER) AS at, event FROM (
  SELECT symbol, seq, event, step, lag(step, 1) OVER w AS one, lag(step, 2) OVER w AS two FROM (
    SELECT symbol, seq, 'upper_turn_down' AS event, sign(upper - lag(upper) OVER v) AS step FROM bb WINDOW v AS (PARTITION BY symbol ORDER BY seq)
    UNION ALL SELECT symbol, seq, 'lower_turn_up', sign(lag(lower) OVER v - lower) FROM bb WINDOW v AS (PARTITION BY symbol ORDER BY seq))
  WHERE step <> 0 WINDOW w AS (PARTITION BY symbol, event ORDER BY seq)) WHERE step < 0 AND one > 0 AND two > 0""", "bb")
# side and extreme of the stay that still waits for its hint
REENTRY_HINTS = (
    select("", "bb").rstrip()
    + """,
  rh AS (
    SELECT symbol, seq, CASE state WHEN 'super_up' THEN 1 WHEN 'super_down' THEN -1 END AS side, close AS extreme, CAST(NULL AS VARCHAR) AS hint FROM bb WHERE seq = 0
    UNION ALL
    SELECT b.symbol, b.seq,
      CASE WHEN b.state = 'super_up' THEN 1 WHEN b.state = 'super_down' THEN -1 WHEN b.state = 'normal' AND r.side * (b.close - r.extreme) > 0 THEN NULL ELSE r.side END,
      CASE WHEN b.state = 'super_up' THEN CASE WHEN r.side = 1 THEN greatest(b.close, r.extreme) ELSE b.close END
           WHEN b.state = 'super_down' THEN CASE WHEN r.side = -1 THEN least(b.close, r.extreme) ELSE b.close END ELSE r.extreme END,
      CASE WHEN b.state = 'normal' AND r.side * (b.close - r.extreme) > 0 THEN CASE WHEN r.side > 0 THEN 'bs1_sell_hint' ELSE 'bs1_buy_hint' END END
    FROM rh r JOIN bb b ON b.symbol = r.symbol AND b.seq = r.seq + 1)
  SELECT symbol, '1 hour' AS freq, CAST(seq AS INTEGER) AS at, hint FROM rh WHERE hint IS NOT NULL"""
)
_OUTSIDE = "NOT (u.low <= r.zg AND u.high >= r.zd)"
TRANSITION_PHASE = (
    select("", "s").rstrip()
    + f""",
  sd AS (SELECT symbol, min(idx) AS seed, arg_min(zd, idx) AS zd, arg_min(zg, idx) AS zg FROM (
    SELECT symbol, idx, greatest(low, lead(low, 1) OVER w, lead(low, 2) OVER w) AS zd, least(high, lead(high, 1) OVER w, lead(high, 2) OVER w) AS zg, lead(low, 2) OVER w AS third
    FROM s WINDOW w AS (PARTITION BY symbol ORDER BY idx)) WHERE third IS NOT NULL AND zd <= zg GROUP BY symbol),
  tp AS (
    SELECT symbol, seed + 2 AS idx, zd, zg, 3 AS n, CAST(NULL AS BIGINT) AS gone, 'center_formed' AS event, CAST(NULL AS VARCHAR) AS direction FROM sd
    UNION ALL
    SELECT u.symbol, u.idx, r.zd, r.zg, CASE WHEN {_OUTSIDE} THEN r.n ELSE r.n + 1 END, CASE WHEN {_OUTSIDE} THEN coalesce(r.gone, u.idx) END,
      CASE WHEN {_OUTSIDE} THEN CASE WHEN r.gone IS NULL THEN 'leave_pending' ELSE 'bs3' END WHEN r.n = 8 THEN 'upgrade' WHEN r.gone IS NULL THEN 'extend' ELSE 'return_to_center' END,
      CASE WHEN {_OUTSIDE} AND r.gone IS NOT NULL THEN CASE WHEN u.low > r.zg THEN 'up' ELSE 'down' END END
    FROM tp r JOIN s u ON u.symbol = r.symbol AND u.idx = r.idx + 1 WHERE r.direction IS NULL),
  ends AS (SELECT symbol, arg_max(zd, idx) AS zd, arg_max(zg, idx) AS zg, arg_max(n, idx) AS n, max(direction) AS direction, arg_max(event, idx) AS last_event, max(CASE WHEN direction IS NOT NULL THEN gone END) AS gone FROM tp GROUP BY symbol)
  SELECT z.symbol, '1 hour' AS freq, CASE WHEN e.symbol IS NULL THEN 'before' WHEN e.direction IS NULL THEN 'center' ELSE 'ended' END AS stage, e.zd, e.zg, CAST(coalesce(e.n, 0) AS INTEGER) AS n, e.direction, e.last_event,
    0 AS consumed_from, CAST(coalesce(e.gone, z.k - 1) AS INTEGER) AS consumed_to
  FROM (SELECT symbol, count(*) AS k FROM s GROUP BY symbol) z LEFT JOIN ends e ON e.symbol = z.symbol"""
)
# the touches of the five-bar average are counted from the start, so any stretch has one where the count grows
_STROKE_106 = "f.kind <> r.kind AND f.idx - r.idx > 2 AND (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE r.v > f.v END) AND (CASE WHEN f.kind = 'top' THEN f.ups - r.ups0 ELSE f.downs - r.downs0 END) > 0"
_FURTHER = "f.kind = r.kind AND (CASE WHEN f.kind = 'top' THEN f.v > r.v ELSE f.v < r.v END)"
STROKES_106 = (
    select("", "f", "l").rstrip()
    + f""",
  tm AS (SELECT m.symbol, m.idx, coalesce(m.high >= l.short, false)::INT AS up, coalesce(m.low <= l.short, false)::INT AS down FROM m JOIN l ON l.symbol = m.symbol AND l.seq = m.last),
  tc AS (SELECT symbol, idx, sum(up) OVER w AS ups, sum(down) OVER w AS downs, sum(up) OVER w - up AS ups0, sum(down) OVER w - down AS downs0 FROM tm WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
  ft AS MATERIALIZED (SELECT f.symbol, f.no, f.kind, f.idx, f.v, tc.ups, tc.downs, tc.ups0, tc.downs0 FROM f JOIN tc ON tc.symbol = f.symbol AND tc.idx = f.idx),
  pr AS (
    SELECT symbol, no, CAST(0 AS BIGINT) AS pno, kind, idx, v, ups0, downs0 FROM ft WHERE no = 1
    UNION ALL
    SELECT f.symbol, f.no, CASE WHEN {_STROKE_106} THEN r.pno + 1 ELSE r.pno END, CASE WHEN {_STROKE_106} THEN f.kind ELSE r.kind END, CASE WHEN {_STROKE_106} OR {_FURTHER} THEN f.idx ELSE r.idx END,
      CASE WHEN {_STROKE_106} OR {_FURTHER} THEN f.v ELSE r.v END, CASE WHEN {_STROKE_106} OR {_FURTHER} THEN f.ups0 ELSE r.ups0 END, CASE WHEN {_STROKE_106} OR {_FURTHER} THEN f.downs0 ELSE r.downs0 END
    FROM pr r JOIN ft f ON f.symbol = r.symbol AND f.no = r.no + 1),
  pv AS (SELECT symbol, pno, arg_max(kind, no) AS kind, arg_max(idx, no) AS idx, arg_max(v, no) AS v FROM pr GROUP BY 1, 2),
  s0 AS (SELECT symbol, pno AS idx, CASE WHEN kind = 'top' THEN 'down' ELSE 'up' END AS direction, idx AS start_index, lead(idx) OVER w AS end_index, v AS start_value, lead(v) OVER w AS end_value FROM pv WINDOW w AS (PARTITION BY symbol ORDER BY pno))
  SELECT s0.symbol, '1 hour' AS freq, CAST(s0.idx AS INTEGER) AS idx, direction, CAST(start_index AS INTEGER) AS start_index, CAST(end_index AS INTEGER) AS end_index, start_value, end_value,
    least(start_value, end_value) AS low, greatest(start_value, end_value) AS high, ba.dt AS start_dt, be.dt AS end_dt
  FROM s0 JOIN m x ON x.symbol = s0.symbol AND x.idx = start_index JOIN m y ON y.symbol = s0.symbol AND y.idx = end_index
  JOIN b ba ON ba.symbol = s0.symbol AND ba.seq = x.last JOIN b be ON be.symbol = s0.symbol AND be.seq = y.last"""
)
CENTER_EVENTS = (
    select("", "c").rstrip()
    + """,
  ce AS (SELECT c.symbol, c.idx AS k, c.first, c.last, lag(gg) OVER w AS pg, lag(dd) OVER w AS pd, lag(c.last) OVER w AS plast FROM c WINDOW w AS (PARTITION BY c.symbol ORDER BY c.idx)),
  own AS (SELECT ce.symbol, ce.k, max(s.high) AS g, min(s.low) AS d FROM ce JOIN s ON s.symbol = ce.symbol AND s.idx BETWEEN ce.first AND ce.first + 2 GROUP BY 1, 2),
  btw AS (SELECT ce.symbol, ce.k, min(s.low) AS lo, max(s.high) AS hi FROM ce JOIN s ON s.symbol = ce.symbol AND CASE WHEN plast + 1 < ce.first THEN s.idx BETWEEN plast + 1 AND ce.first - 1 ELSE s.idx = ce.first END WHERE plast IS NOT NULL GROUP BY 1, 2),
  rel AS (SELECT ce.*, CASE WHEN plast IS NULL THEN NULL WHEN g < pd THEN 'down_continue' WHEN d > pg THEN 'up_continue' ELSE 'expand' END AS how,
      greatest(pd, lo, d) AS z3, least(pg, hi, g) AS g3, greatest(pd, d) AS z2, least(pg, g) AS g2
    FROM ce JOIN own USING (symbol, k) LEFT JOIN btw USING (symbol, k)),
  ev AS (
    SELECT symbol, k, first + 2 AS unit, 0 AS part, CASE WHEN how IS NULL THEN 'form' ELSE 'new' END AS kind, how AS relation, CAST(NULL AS DOUBLE) AS zd, CAST(NULL AS DOUBLE) AS zg, CAST(NULL AS INTEGER) AS n FROM rel
    UNION ALL SELECT symbol, k, first + 2, 1, 'expand_zs', how, CASE WHEN z3 < g3 THEN z3 ELSE z2 END, CASE WHEN z3 < g3 THEN g3 ELSE g2 END, CASE WHEN z3 < g3 THEN 3 ELSE 2 END FROM rel WHERE how = 'expand' AND z2 < g2
    UNION ALL SELECT symbol, k, unnest(range(first + 3, last + 1)), 2, 'extend', NULL, NULL, NULL, NULL FROM rel
    UNION ALL SELECT rel.symbol, k, last + 1, 3, 'complete', NULL, NULL, NULL, NULL FROM rel JOIN s ON s.symbol = rel.symbol AND s.idx = rel.last + 1)
  SELECT ev.symbol, '1 hour' AS freq, CAST(row_number() OVER (PARTITION BY ev.symbol ORDER BY ev.k, unit, part) - 1 AS INTEGER) AS idx, CASE WHEN kind = 'extend' AND unit - ce.first = 8 THEN 'upgrade_9' ELSE kind END AS kind,
    CAST(ev.k AS INTEGER) AS first, CAST(unit AS INTEGER) AS last, s.end_dt, relation, ev.zd, ev.zg, ev.n
  FROM ev JOIN ce ON ce.symbol = ev.symbol AND ce.k = ev.k JOIN s ON s.symbol = ev.symbol AND s.idx = ev.unit"""
)
