"""First passages and range extremes against a scan."""

import random

import pytest
from structura.operators.passage import _OPS, BlockIndex, Target

TARGETS = {"under": Target("low", "<"), "over": Target("high", ">"), "at_most": Target("low", "<="), "at_least": Target("high", ">=")}


def series(lengths, seed):
    rng = random.Random(seed)
    out = []
    for s, n in lengths.items():
        price = 100
        for i in range(n):
            price += rng.randint(-3, 3)
            out.append((s, "f", i, float(price - rng.randint(0, 2)) if rng.random() > 0.02 else None, float(price + rng.randint(0, 2))))
    return out


@pytest.mark.parametrize("size", [2, 5, 128])
def test_against_a_scan(spark, size):
    rng = random.Random(size)
    rows = series({"a": 130, "b": 25, "c": 1}, 4)
    held = {s: [r for r in rows if r[0] == s] for s in "abc"}
    index = BlockIndex(spark.createDataFrame(rows, "symbol string, freq string, seq int, low double, high double"), TARGETS, size)
    value = lambda r, t: r[3] if TARGETS[t].column == "low" else r[4]
    asked, want = [], {}
    for k in range(300):
        s, t, limit = rng.choice("aaab" + "c"), rng.choice(list(TARGETS)), float(100 + rng.randint(-25, 25))
        at = rng.randint(0, len(held[s]) + 3)
        asked.append((s, "f", k, t, at, limit))
        want[k] = next((i for i in range(at, len(held[s])) if value(held[s][i], t) is not None and _OPS[TARGETS[t].op](value(held[s][i], t), limit)), None)
    got = index.first_passages(spark.createDataFrame(asked, "symbol string, freq string, id int, target string, at long, limit double")).collect()
    assert {r.id: r.seq for r in got} == want

    asked, want = [], {}
    for k in range(200):
        s, t = rng.choice("ab"), rng.choice(["under", "over"])
        a = rng.randint(0, len(held[s]) - 1)
        b = rng.randint(a - 1, len(held[s]) - 1)
        asked.append((s, "f", k, t, a, b))
        inside = [x for x in (value(r, t) for r in held[s][a : b + 1]) if x is not None]
        want[k] = (min if t == "under" else max)(inside) if inside else None
    got = index.extremes(spark.createDataFrame(asked, "symbol string, freq string, id int, target string, `from` long, `to` long")).collect()
    assert {r.id: r.value for r in got} == want
