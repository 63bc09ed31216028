"""Bars: reading, building from ticks, checking, adjusting, and what is visible when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import BAR_COLUMNS, KEYS

PRICES = ["open", "high", "low", "close"]
#: What tells an order's lines apart, in order.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", symbol: str | None = None, **options) -> DataFrame:
    """Files of bars, one symbol's if given; a layout partitioned by symbol is pruned."""
    df = spark.read.format(fmt).options(**options).load(path)
    return df if symbol is None else df.where(F.col("symbol") == symbol)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """seq counts a series' rows from 0, in time."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*(order or ["dt"]))) - 1)


def normalize_bars(df: DataFrame, names: dict[str, str] | None = None, drop_paused: bool = True) -> DataFrame:
    """Map columns (ours -> theirs), cast, drop paused rows (no volume and no range), and number each series."""
    names = {c: c for c in [*KEYS, *BAR_COLUMNS]} | (names or {})
    missing = [v for v in names.values() if v not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    out = df.select(*(F.col(names[k]).cast("string").alias(k) for k in KEYS), F.col(names["dt"]).cast("timestamp_ntz").alias("dt"), *(F.col(names[c]).cast("double").alias(c) for c in BAR_COLUMNS[1:]))
    if drop_paused:
        out = out.where(~((F.col("volume") == 0) & (F.col("high") == F.col("low"))))
    return numbered(out)


def from_ticks(ticks: DataFrame, period: str, price: str, order: str, ts: str = "ts") -> DataFrame:
    """Tumbling bars of each symbol: first, highest, lowest and last price of a period, and the number of ticks."""
    grouped = ticks.groupBy("symbol", F.window(F.col(ts).cast("timestamp"), period).getField("start").cast("timestamp_ntz").alias("dt"))
    out = grouped.agg(
        F.min_by(price, order).cast("double").alias("open"), F.max(price).cast("double").alias("high"), F.min(price).cast("double").alias("low"),
        F.max_by(price, order).cast("double").alias("close"), F.count("*").cast("double").alias("volume"),
    )
    return numbered(out.withColumn("freq", F.lit(period)))


def event_ticks(events: DataFrame) -> DataFrame:
    """A signed walk of each event type, in exact decimals."""
    sign = F.when((F.col("event_id") * 7919) % 13 < 7, 1).otherwise(-1).cast("decimal(18,4)")
    step = sign * F.col("value").cast("decimal(10,2)") * F.lit("0.01").cast("decimal(4,2)")
    walk = F.sum(step).over(Window.partitionBy("event_type").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.select(F.col("event_type").alias("symbol"), "event_id", "ts", (F.lit(1000).cast("decimal(18,4)") + walk).cast("decimal(18,4)").alias("p"))


def event_bars(spark: SparkSession, sf_dir: str, period: str = "1 hour") -> DataFrame:
    return from_ticks(event_ticks(spark.read.parquet(f"{sf_dir}/events.parquet")), period, "p", "event_id")


def order_bars(spark: SparkSession, sf_dir: str, rows_per_bucket: int = 8192, lines_per_task: int = 1 << 20) -> DataFrame:
    """One long series: a bar an order, whose lines are the ticks of a signed walk in exact decimals.

    The walk and the numbering are summed by bucket of orders, then over buckets, then inside a bucket: no task holds the series.
    """
    sign = F.when((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104_729) % 13 < 7, 1).otherwise(-1).cast("decimal(18,4)")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE_ORDER, (sign * F.col("l_quantity").cast("decimal(10,2)") * F.lit("0.01").cast("decimal(4,2)")).cast("decimal(18,4)").alias("step"))
    lines = lines.withColumn("bucket", F.expr(f"l_orderkey div {rows_per_bucket}"))
    sums = lines.groupBy("bucket").agg(F.sum("step").alias("moved"), F.countDistinct("l_orderkey").alias("orders"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("bucket", F.coalesce(F.sum("moved").over(earlier), F.lit(0)).alias("price_before"), F.coalesce(F.sum("orders").over(earlier), F.lit(0)).alias("seq_before"))
    inside = Window.partitionBy("bucket").orderBy(*LINE_ORDER)
    # more lines are dealt to more tasks than the session asks for
    parts = -(-lines.count() // lines_per_task)
    dealt = lines.repartition(parts, "bucket") if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else lines
    ticks = dealt.withColumn("walked", F.sum("step").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tick", F.row_number().over(inside)).withColumn("rank", F.dense_rank().over(Window.partitionBy("bucket").orderBy("l_orderkey")))
    price = (F.lit(1000) + F.col("price_before") + F.col("walked")).cast("double")
    ticks = ticks.join(starts, "bucket").select((F.col("seq_before") + F.col("rank") - 1).cast("int").alias("seq"), "tick", price.alias("p"))
    bars = ticks.groupBy("seq").agg(
        F.min_by("p", "tick").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "tick").alias("close"), F.count("*").cast("double").alias("volume")
    )
    at = F.timestamp_micros(F.lit(1_577_836_800_000_000) + F.col("seq").cast("long") * 60_000_000).cast("timestamp_ntz")
    return bars.select(F.lit("orders").alias("symbol"), F.lit("order").alias("freq"), "seq", at.alias("dt"), *PRICES, "volume")


def with_arrival(bars: DataFrame, period: str, delay: str = "5 minutes", late: Column | None = None) -> DataFrame:
    """closed_dt at the end of the period, available_dt after a delay, and one period later still where `late` holds."""
    closed = F.expr(f"dt + interval {period}")
    arrived = F.expr(f"dt + interval {period} + interval {delay}")
    if late is not None:
        arrived = F.when(late, F.expr(f"dt + interval {period} + interval {delay} + interval {period}")).otherwise(arrived)
    return bars.withColumn("closed_dt", closed).withColumn("available_dt", arrived)


def violations(bars: DataFrame) -> DataFrame:
    """One row (keys, seq, rule) per broken rule of a bar."""
    before = F.lag("dt").over(Window.partitionBy(*KEYS).orderBy("seq"))
    numbers = [*PRICES, "volume"]
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    finite = F.lit(True)
    for c in numbers:
        finite = finite & good(c)
    positive = F.least(*PRICES) > 0
    rules = {
        "dt_missing": F.col("dt").isNull(),
        "dt_not_increasing": F.coalesce(F.col("dt") <= F.col("before"), F.lit(False)),
        "not_finite": ~finite,
        "price_not_positive": finite & ~positive,
        "volume_negative": finite & (F.col("volume") < 0),
        "outside_range": finite & ((F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))),
    }
    found = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return bars.withColumn("before", before).select(*KEYS, "seq", F.explode(found).alias("rule"))


def validate_bars(bars: DataFrame) -> DataFrame:
    """The bars; raises when the first violation is reached."""
    first = violations(bars).orderBy(*KEYS, "seq", "rule").limit(1).collect()
    if first:
        raise ValueError(f"bar {first[0].seq} of {first[0].symbol} {first[0].freq}: {first[0].rule}")
    return bars


def adjust(bars: DataFrame, factor: str = "adj_factor") -> DataFrame:
    """Prices times the row's factor."""
    if factor not in bars.columns:
        raise ValueError(f"column missing: {factor}")
    return bars.withColumns({c: F.col(c) * F.col(factor) for c in PRICES})


def drop_invalid(bars: DataFrame) -> DataFrame:
    """Only bars with positive prices inside their range."""
    whole = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    return bars.where(whole & (F.least(*PRICES) > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")))


def visible_bars(bars: DataFrame, as_of: str | Column) -> DataFrame:
    """Bars up to a time. Apply it below every fold: a fold's result must not be filtered by time instead."""
    return bars.where(F.col("dt") <= (F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of))


def available_bars(bars: DataFrame, as_of: str | Column) -> DataFrame:
    """Bars that had arrived by a time, renumbered."""
    at = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return numbered(bars.where(F.col("available_dt") <= at).drop("seq"))


def sector_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each nation's signed order walk, with its region as sector."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    orders = orders.join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey"))  # nations and regions are fixed lists
    sign = F.when((F.col("o_orderkey") * 7919) % 13 < 7, 1).otherwise(-1).cast("decimal(18,4)")
    step = (sign * F.col("o_totalprice").cast("decimal(14,2)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(24,6)")
    order = F.struct("o_orderdate", "o_orderkey")
    walk = F.sum(step).over(Window.partitionBy("n_name").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0))
    ticks = orders.select(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), F.col("o_orderdate").alias("ts"), order.alias("o"), (F.lit(1000).cast("decimal(24,6)") + walk).cast("decimal(24,6)").alias("p"))
    # weeks run from Monday 2000-01-03, as time buckets of seven days do
    week = F.window(F.col("ts").cast("timestamp"), "7 days", "7 days", "4 days").getField("start").cast("timestamp_ntz")
    out = ticks.groupBy("symbol", "sector", week.alias("dt")).agg(F.max_by("p", "o").cast("double").alias("close"))
    return numbered(out.withColumn("freq", F.lit("7 days")))


def arrival_checked(bars: DataFrame) -> DataFrame:
    """The bars, each of which must have dt <= closed_dt <= available_dt; the first that has not fails the job by name."""
    sound = F.coalesce((F.col("dt") <= F.col("closed_dt")) & (F.col("closed_dt") <= F.col("available_dt")), F.lit(False))
    told = F.concat_ws(" ", F.lit("a bar must close and arrive in this order:"), *KEYS, *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("dt", "closed_dt", "available_dt")))
    return bars.withColumn("available_dt", F.when(sound, F.col("available_dt")).otherwise(F.raise_error(told).cast("timestamp_ntz")))


def observed_bars(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """What each observation of a grid (keys, observed) sees of its series: the latest version of every bar that had arrived, numbered.

    Rows of one (keys, dt) with different available_dt are versions of a bar. A version is valid from its arrival until the next one's,
    so an observation takes exactly one of them by range; the grid may be irregular and differ between series. Each
    observation gets all its bars: the result has a prefix of the series per observation.
    """
    version = Window.partitionBy(*KEYS, "dt").orderBy("available_dt")
    valid = arrival_checked(bars).drop("seq").withColumn("valid_to", F.lead("available_dt").over(version))
    seen = valid.join(grid.select(*KEYS, F.col("observed").cast("timestamp_ntz").alias("observed")).distinct(), KEYS)
    seen = seen.where((F.col("available_dt") <= F.col("observed")) & (F.col("valid_to").isNull() | (F.col("observed") < F.col("valid_to")))).drop("valid_to")
    return seen.withColumn("seq", F.row_number().over(Window.partitionBy(*KEYS, "observed").orderBy("dt")) - 1)
