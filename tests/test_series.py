import pytest
from structura.operators import moves, series

from .synthetic import sine, walk

# Published counts of the synthetic walks.
COUNTS = [
    (1390, 20261017, "81", (929, 420, 101, 16, 13, 3), (12, 4), [101, 7, 1]),
    (1390, 20261017, "106", (929, 420, 127, 18, 19, None), (17, 6), [127, 7, 1]),
]


@pytest.mark.parametrize("n, seed, standard, counts, points, levels", COUNTS)
def test_published_counts(n, seed, standard, counts, points, levels):
    bars = walk(n, seed)
    s = series.read_structure(bars, standard=standard)
    got = (len(s.merged), len(s.fractals), len(s.strokes), len(s.segments), len(s.stroke_centers), len(s.segment_centers))
    assert all(a == b for a, b in zip(got, counts) if b is not None), got
    found = series.points_of(bars, s)
    assert (sum(p["side"] == "buy" for p in found), sum(p["side"] == "sell" for p in found)) == points
    assert [len(x) for x in moves.level_chain(s.strokes)] == levels


def test_quick_start():
    bars = sine()
    s = series.read_structure(bars)
    assert (len(s.fractals), len(s.strokes), len(s.segments), len(s.stroke_centers), len(series.points_of(bars, s))) == (8, 7, 1, 1, 0)


def test_ledger_counts_and_replay():
    bars = walk(1390, 20261017)
    n = len(bars.dt)
    changes = list(series.replay(bars, [(bars.dt[k - 1], bars.head(k)) for k in range(n - 199, n + 1)]))
    kinds = {k: sum(c.kind == k for c in changes) for k in ("appeared", "revised", "withdrawn")}
    state = {}
    for c in changes:
        if c.kind == "withdrawn":
            assert state.pop((c.field, c.identity)) == c.before
        else:
            assert state.get((c.field, c.identity)) == c.before
            state[c.field, c.identity] = c.after
    assert state == series.records(bars, series.read_structure(bars))
    assert kinds == {"appeared": 541, "revised": 53, "withdrawn": 4}


@pytest.mark.parametrize("standard", ["81", "106"])
@pytest.mark.parametrize("step", [1, 3])
def test_incremental_replay_equals_independent_prefix_runs(standard, step):
    bars = walk(260, 7)
    n = len(bars.dt)
    grid = [k for k in range(1, n + 1) if (n - k) % step == 0]
    key = lambda c: (str(c.observed), c.field, c.identity, c.kind, str(c.first_seen), c.before or "", c.after or "")
    want = sorted(map(key, series.replay(bars, [(bars.dt[k - 1], bars.head(k)) for k in grid], standard=standard)))
    assert sorted(map(key, series.replay_prefixes(bars, step, standard=standard))) == want
