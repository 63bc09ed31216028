import pandas as pd
from pyspark.sql import functions as F
from structura.functions import table
from structura.operators import structure as st
from structura.sources import bars as src
from structura.sources import sinks
from structura.streaming import bars as stream

from .synthetic import walk


def frame(spark, n=160):
    b = walk(n, 20261017)
    pdf = pd.DataFrame({"symbol": "x", "freq": "day", "dt": b.dt, "open": b.open, "high": b.high, "low": b.low, "close": b.close, "volume": b.volume})
    return spark.createDataFrame(pdf)


def test_stream_ledger_equals_the_batch_replay(spark, tmp_path):
    df = frame(spark)
    for k in range(4):
        df.where((F.dayofyear("dt") % 400 >= 60 * k) & ((F.dayofyear("dt") % 400 < 60 * (k + 1)) | F.lit(k == 3))).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    held = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = stream.follow(held).writeStream.outputMode("append").format("memory").queryName("ledger").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.kind, r.field, r.identity, str(r.first_seen), str(r.observed), r.before or "", r.after or "") for r in spark.table("ledger").collect())
    batch = st.replay_ledger(src.numbered(df.withColumn("dt", F.col("dt").cast("timestamp_ntz"))))
    want = sorted((r.kind, r.field, r.identity, str(r.first_seen), str(r.observed), r.before or "", r.after or "") for r in batch.collect())
    assert len(got) > 50 and got == want


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    ticks = spark.createDataFrame([("a", f"2024-01-01 {h:02d}:{m:02d}:00", 60 * h + m, float(h * 10 + m % 7)) for h in range(6) for m in range(0, 60, 9)], "symbol string, ts string, order_id int, price double")
    ticks = ticks.withColumn("ts", F.to_timestamp("ts"))
    ticks.coalesce(1).write.parquet(str(tmp_path / "t"))
    out = stream.bars_from_stream(stream.read_ticks(spark, str(tmp_path / "t"), ticks.schema), "1 hour", "10 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((str(r.dt), r.open, r.high, r.low, r.close, r.volume) for r in spark.table("live").collect())
    want = sorted((str(r.dt), r.open, r.high, r.low, r.close, r.volume) for r in src.from_ticks(ticks, "1 hour", "price", "order_id").collect())
    assert got == want[: len(got)] and len(got) >= 5


def test_table_function_and_sinks(spark, tmp_path):
    df = frame(spark)
    table.register(spark)
    df.createOrReplaceTempView("day_bars")
    got = spark.sql("SELECT * FROM strokes(TABLE(SELECT dt, symbol, high, low FROM day_bars) PARTITION BY symbol ORDER BY dt)").collect()
    want = st.project(st.structure(src.numbered(df.withColumn("dt", F.col("dt").cast("timestamp_ntz")))), "stroke", "idx", "direction", "start_value", "end_value").orderBy("idx").collect()
    assert [(r.direction, r.start_value, r.end_value) for r in got] == [(r.direction, r.start_value, r.end_value) for r in want]
    sinks.write_records(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("symbol = 'x'").count() == df.count()
    assert sinks.as_json(df, "symbol").first().json.startswith("{")
