"""The streamed ledger with bounded state against the replay of every prefix."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from structura.operators import series
from structura.streaming import tail as stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def walk(n, seed, step):
    rng, price, out = random.Random(seed), 100, []
    for i in range(n):
        a, price = price, price + rng.randint(-step, step)
        out.append((datetime(2024, 1, 1) + timedelta(hours=i), float(max(a, price) + rng.randint(0, 2)), float(min(a, price) - rng.randint(0, 2))))
    return out


def replayed(rows):
    dt, high, low = map(list, zip(*rows))
    bars = series.Bars(dt, low, high, low, high, [1.0] * len(dt))
    return [c for c in series.replay_prefixes(bars) if c.field != "signal"]


def texts(changes):
    return [(c.kind, c.field, c.identity, c.first_seen, c.observed, c.before, c.after) for c in changes]


@pytest.mark.parametrize("seed", range(12))
def test_changes_equal_the_replay_and_state_stays_small(seed):
    rows = walk(400, seed, 1 + seed % 6)
    tail, got, most = stream.Tail(), [], 0
    for dt, high, low in rows:
        got += list(tail.push(dt, high, low))
        most = max(most, len(tail.merged) + len(tail.records))
    assert sorted(texts(got), key=str) == sorted(texts(replayed(rows)), key=str)
    assert most < 160 and len(tail.settled) <= stream.KEEP


def test_state_does_not_grow_with_history():
    sizes = []
    for n in (500, 5000):
        tail, most = stream.Tail(), 0
        for dt, high, low in walk(n, 3, 3):
            list(tail.push(dt, high, low))
            most = max(most, len(tail.merged) + len(tail.records) + len(tail.settled))
        sizes.append(most)
    assert sizes[1] < 3 * sizes[0]


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    data = {s: walk(120, k, 3) for k, s in enumerate("ab")}
    schema = "symbol string, freq string, dt timestamp, high double, low double"
    for part in range(3):
        rows = [(s, "h", *r) for s, all_rows in data.items() for r in all_rows[40 * part : 40 * part + 40]]
        if part == 2:
            rows.append(("a", "h", *data["a"][7]))  # long past
        random.Random(part).shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = stream.follow_tail(read).writeStream.outputMode("append").format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    try:
        query.awaitTermination(180)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("tail")
    late = got.where("kind = 'late'").collect()
    assert [(r.symbol, r.identity) for r in late] == [("a", str(data["a"][7][0]))]
    for s, rows in data.items():
        mine = got.where((F.col("symbol") == s) & (F.col("kind") != "late")).drop("symbol", "freq").collect()
        assert sorted(map(tuple, mine), key=str) == sorted(texts(replayed(rows)), key=str)
