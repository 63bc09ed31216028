"""Segments under a premise. The literal price lists and their segments; each is also mirrored."""

import random

import pytest
from structura.operators.base_chain import Unit
from structura.operators.segments import Premise, PremisedReader, premised_segments, segments_of

LONG = [8, 3, 7, 2, 11, 3, 8, 5, 10, 2, 4.5, 0, 3, 1, 5, 2, 6, 3, 7, 4, 9, 5, 10]
KINDS = {
    "context_unproved", "qualification_waiting", "reaction_confirmed_without_start_break", "reaction_pending", "reaction_origin_unproved", "first_start_broken", "first_end_selected",
}


def zigzag(prices):
    return [Unit("up" if b > a else "down", a, b, i, i + 1, min(a, b), max(a, b), i, i + 1) for i, (a, b) in enumerate(zip(prices, prices[1:]))]


def complete(strokes, basis, known_at, first=0):
    found, _ = premised_segments(strokes, Premise(basis, first, strokes[first].direction, strokes[first].start, known_at))
    return [(s.first, s.last + 1, s.evidence + 1) for s in found if s.evidence is not None]


@pytest.mark.parametrize("mirror", [False, True])
class TestLiteral:
    def test_only_no_history_passes_the_break_on(self, mirror):
        strokes = zigzag([30 - p if mirror else p for p in LONG[:12]])
        for n in (6, 7, 8, 10, 11):
            assert complete(strokes[:n], "unknown", None) == complete(strokes[:n], "given_recent", 0) == []
        assert complete(strokes, "no_prior_history", 0)[:2] == [(0, 3, 8), (3, 8, 11)]

    def test_late_knowledge_is_not_backdated(self, mirror):
        strokes = zigzag([30 - p if mirror else p for p in LONG])
        for n in range(3, 21):
            assert complete(strokes[:n], "no_prior_history", 20) == complete(strokes[:n], "unknown", None) == []
        assert complete(strokes[:21], "no_prior_history", 20)[:2] == [(0, 3, 21), (3, 8, 21)]

    def test_a_recent_boundary_completes_an_ordinary_segment(self, mirror):
        strokes = zigzag([30 - p if mirror else p for p in [1, 6, 3, 12, 2, 8, 1, 14, 6, 10, 0]])
        assert complete(strokes[:5], "given_recent", 0) == []
        assert complete(strokes[:6], "given_recent", 0) == [(0, 3, 6)]
        assert complete(strokes[:6], "given_recent", 10) == []


@pytest.mark.parametrize(
    "premise",
    [
        ("other", 0, "down", 8, 0), ("unknown", 0, "down", 8, 0), ("no_prior_history", False, "down", 8, 0), ("no_prior_history", 0, "down", True, 0), ("no_prior_history", 0, "down", 8, True),
        ("no_prior_history", 0, "down", 8, -1), ("no_prior_history", 1, "up", 3, 0), ("given_recent", 0, "down", 9, 0), ("given_recent", 0, "down", float("nan"), 0), ("given_recent", 0, "left", 8, 0),
    ],
)
def test_refuses(premise):
    with pytest.raises(ValueError):
        premised_segments(zigzag(LONG), Premise(*premise))


def walks(count, length, seed):
    rng = random.Random(seed)
    for _ in range(count):
        prices = [50.0]
        for i in range(length):
            prices.append(prices[-1] + (1 if i % 2 else -1) * rng.randint(1, 9))
        yield zigzag(prices)


def first_of(strokes):
    return next((i for i in range(len(strokes) - 2) if PremisedReader(strokes).meet(i)), None)


def test_published_segments_of_a_prefix_stay_and_certificates_settle():
    kinds = set()
    for strokes in walks(12, 40, 4):
        first = first_of(strokes)
        if first is None:
            continue
        basis = "no_prior_history" if first == 0 else "given_recent"
        last, settled = [], {}
        for n in range(first + 3, len(strokes) + 1):
            premise = Premise(basis, first, strokes[first].direction, strokes[first].start, first + 6)
            try:
                found, rows = premised_segments(strokes[:n], premise)
            except ValueError:
                break  # strokes after a segment that do not meet begin under no premise
            done = [(s.first, s.last, s.mode, s.evidence) for s in found if s.evidence is not None]
            assert done[: len(last)] == last
            assert all(s[3] >= max(s[1], first + 6) for s in done)
            last = done
            for index, stroke, state in rows:
                kinds.add(state.kind)
                if index < len(done) and state.proof is not None:
                    # an event that was first at its time stays the first
                    assert settled.setdefault((done[index], stroke), state[1::2][:1] + (state.proof,)) == state[1::2][:1] + (state.proof,)
    kinds |= {s.kind for strokes in walks(3, 30, 8) if (f := first_of(strokes)) is not None for *_, s in premised_segments(strokes, Premise("unknown", f, strokes[f].direction, strokes[f].start, None))[1]}
    for strokes in walks(40, 40, 4):
        if first_of(strokes) == 0:
            try:
                rows = premised_segments(strokes, Premise("no_prior_history", 0, strokes[0].direction, strokes[0].start, 0))[1]
            except ValueError:
                continue
            kinds |= {state.kind for *_, state in rows}
    assert kinds == KINDS


def test_a_remembering_reader_equals_fresh_ones():
    for strokes in walks(6, 26, 11):
        first = first_of(strokes)
        if first is None:
            continue
        premise = Premise("no_prior_history" if first == 0 else "given_recent", first, strokes[first].direction, strokes[first].start, 0)
        shared = PremisedReader(strokes)
        of = shared.lineage(first, None, None, "unknown", premise)
        for n in reversed(range(first + 3, len(strokes) + 1)):
            fresh = PremisedReader(strokes[:n])
            own = fresh.lineage(first, None, None, "unknown", premise)
            assert shared.end_of(first, n, of) == fresh.end_of(first, n, own)
            for j in range(first + 3, n, 2):
                assert shared.certificate(j, n, of) == fresh.certificate(j, n, own)


def test_plain_segments_do_not_depend_on_what_was_asked_before():
    for strokes in walks(10, 60, 2):
        assert segments_of(strokes) == segments_of(list(strokes))


def test_operator_gives_each_series_and_premise_its_rows(spark):
    from structura.operators import structure as st

    strokes, premises, want = [], [], set()
    for k, units in enumerate(walks(4, 24, 6)):
        strokes += [(f"s{k}", "f", i, u.direction, u.start, u.end, u.low, u.high) for i, u in enumerate(units)]
        first = first_of(units)
        for name, basis, known in (("a", "unknown", None), ("b", "given_recent", 0), ("c", "given_recent", 400)):
            premises.append((f"s{k}", "f", name, basis, first, units[first].direction, units[first].start, known))
            try:
                found, rows = premised_segments(units, Premise(*premises[-1][3:]))
            except ValueError:
                want.add((f"s{k}", name, "refused", 0, None, None))
                continue
            want |= {(f"s{k}", name, "segment", i, s.first, s.evidence) for i, s in enumerate(found)}
            want |= {(f"s{k}", name, c.kind, j, None, c.proof) for _, j, c in rows}
    frame = spark.createDataFrame(strokes, "symbol string, freq string, idx int, direction string, start_value double, end_value double, low double, high double")
    told = spark.createDataFrame(premises, "symbol string, freq string, premise string, basis string, first int, direction string, price double, known_at int")
    got = st.premised_segments(frame, told).collect()
    assert {(r.symbol, r.premise, r.kind if r.record == "certificate" else r.record, r.stroke if r.record == "certificate" else r.segment, r.first, r.proof) for r in got} == want


def test_premises_of_series_bind_the_first_three_strokes_that_meet(spark):
    from structura.operators import structure as st

    rows = [("a", "f", i, u.direction, u.start, u.end, u.low, u.high) for i, u in enumerate(zigzag([100.0, 110.0, 90.0, 95.0, 80.0, 93.0]))] + [("b", "f", 0, "up", 1.0, 2.0, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "symbol string, freq string, idx int, direction string, start_value double, end_value double, low double, high double")
    assert [tuple(r) for r in st.first_meeting(frame).collect()] == [("a", "f", 1, "down", 110.0)]
