import math

import numpy as np
import pytest
from structura.llm import nndescent, queries
from structura.llm.common import local_labels


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows):
    """(id, links, component) per row, from all pairs."""
    good = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v)]
    links = [0] * len(rows)
    u, w = [], []
    for dim in {len(rows[k][1]) for k in good}:
        at = [k for k in good if len(rows[k][1]) == dim]
        x = np.array([rows[k][1] for k in at], dtype=np.float64)
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            links[at[a]] += 1
            u.append(at[a])
            w.append(at[b])
    labels = local_labels(len(rows), np.array(u, dtype=int), np.array(w, dtype=int))
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[labels[k]] = min(low.get(labels[k], i), i)
    return [(i, links[k], low[labels[k]] if i is not None else None) for k, (i, _) in enumerate(rows)]


def planted(n, seed, groups, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    at = 0
    for size, noise in groups:
        x[at : at + size] = x[at] + noise * rng.normal(size=(size, dim)) * np.linalg.norm(x[at]) / math.sqrt(dim)
        at += size
    order = rng.permutation(n)
    return [(int(i), x[k].astype(np.float32).astype(float).tolist()) for i, k in enumerate(order)]


@pytest.mark.parametrize("settings", [nndescent.Settings(), nndescent.Settings(tile=16, run=32, k=4, widest=6)])
def test_planted_groups_against_brute_force(spark, settings):
    rows = planted(1500, 1, [(300, 0.05), (40, 0.2), (40, 0.3), *[(2, 0.1)] * 60, *[(5, 0.25)] * 20])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in nndescent.near_duplicates(df, settings=settings).collect())
    want = sorted(brute(rows))
    found = sum(min(a[1], b[1]) for a, b in zip(got, want)) / sum(b[1] for b in want)
    assert [a[0] for a in got] == [b[0] for b in want] and all(a[1] <= b[1] for a, b in zip(got, want))
    assert found >= 0.99


def test_small_groups_beside_a_hot_one(spark):
    """A third of the vectors are near copies; the first graph is too coarse for the pairs, which the audit must notice."""
    rows = planted(2400, 7, [(800, 0.05), *[(2, 0.43)] * 500], dim=64)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(brute(rows))
    few = [k for k, w in enumerate(want) if 0 < w[1] < 10]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.recall) for r in nndescent.near_duplicates(df).collect())
    assert got[0][3] >= 0.99 and np.mean([got[k][1] == want[k][1] for k in few]) >= 0.98
    assert all(g[:3] == w for g, w in zip(got, want) if w[1] >= 10)
    coarse = nndescent.Settings(orders=1, run=16, k=2, rounds=1, repairs=0)
    with pytest.raises(RuntimeError, match="recall"):
        nndescent.near_duplicates(df, settings=coarse).count()


def test_rare_links_are_measured_or_said_not_to_be(spark):
    rows = planted(3000, 11, [(2, 0.3)] * 10, dim=32)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    coarse = {"orders": 1, "run": 16, "k": 2, "rounds": 1, "repairs": 0, "accepted": 0.0, "audit": 10}
    grown = nndescent.near_duplicates(df, settings=nndescent.Settings(**coarse)).first().recall
    assert grown is not None and grown < 0.9
    alone = spark.createDataFrame(planted(400, 5, [], dim=32), "vec_id long, embedding array<double>")
    assert {r.recall for r in nndescent.near_duplicates(alone, settings=nndescent.Settings(**coarse)).collect()} == {None}
    with pytest.raises(RuntimeError, match="recall"):
        nndescent.near_duplicates(df, settings=nndescent.Settings(**coarse | {"accepted": 0.9})).count()


def test_a_pair_at_the_threshold_is_decided_alike_everywhere():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    for t in sims[0, 1:6]:
        near = nndescent.reach(sims, x, x, t)
        assert (near == near.T).all()
        for cut in (7, 20):
            parts = np.vstack([nndescent.reach(x[a] @ x.T, x[a], x, t) for a in (slice(0, cut), slice(cut, None))])
            assert (parts == near).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [-1.0, 0.0], [1.0, 0.0, 0.0], [1e300, 1e300], [1e-300, 1e-300], [0.9, math.sqrt(1 - 0.81)]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(6, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, component_id string")
    got = nndescent.near_duplicates(df).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert nndescent.near_duplicates(df.where("false")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in queries.op4_nn_descent(spark, sf).collect())
    assert got == sorted(brute(rows))
