"""Segments of one stroke list, with and without a premise about where it begins.

Everything is read in a mirrored price frame in which the segment rises, so only that case is written. A supposed reversal
is a small state machine (`Turn`) fed with the strokes that follow: it is open, proved by an evidence stroke, or
revoked. What it asks while its falls stay inside its first stroke is the reader's matter: the plain reader asks for a
segment against it, the premised reader for a certificate.

A premise states what is known of the time before the first stroke and from which stroke on it is known. Under one, a
segment carries its lineage: its predecessor as far as that is proved, and the lineage of that. A certificate says how the
race about a reversal stands at a given number of strokes: start broken, end selected, or reaction confirmed, or still
pending; and whether the lineage lets it count: unknown, waiting or visible. Certificates and segment ends are remembered
by (strokes seen, stroke, lineage), and the first proof of a reaction by (stroke, lineage), so longer prefixes go on from it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import count
from typing import NamedTuple

from .base_chain import DOWN, UP, Unit

REVOKED = (-1, 0)
#: What a premise can rest on.
BASES = ("unknown", "no_prior_history", "given_recent")


@dataclass(slots=True)
class Segment:
    """Strokes first..last; evidence is the stroke that proved its end, or None while it is open."""

    first: int
    last: int
    mode: int
    evidence: int | None


class Features:
    """A feature sequence: ranges merged forward; while it holds one range, a given direction decides the merge."""

    __slots__ = ("lows", "highs", "rising")

    def __init__(self, rising: bool):
        self.lows: list[float] = []
        self.highs: list[float] = []
        self.rising = rising

    def push(self, low: float, high: float) -> None:
        if self.lows:
            a, b = self.lows[-1], self.highs[-1]
            if (a <= low and high <= b) or (low <= a and b <= high):
                rising = self.highs[-1] > self.highs[-2] if len(self.highs) > 1 else self.rising
                pick = max if rising else min
                self.lows[-1], self.highs[-1] = pick(a, low), pick(b, high)
                return
        self.lows.append(low)
        self.highs.append(high)

    def falls(self) -> bool:
        """The second range lies below the first."""
        return len(self.lows) > 1 and self.highs[1] < self.highs[0] and self.lows[1] < self.lows[0]

    def bottoms_out(self) -> bool:
        """The last three ranges fall, then rise, on both sides."""
        if len(self.lows) < 3:
            return False
        (a, b, c), (x, y, z) = self.lows[-3:], self.highs[-3:]
        return b < a and b < c and y < x and y < z


class Turn:
    """A supposed reversal at stroke `at`, against the feature `left` of the segment that began at price `origin`."""

    __slots__ = ("frame", "origin", "at", "start", "end", "gap", "after", "against", "inside")

    def __init__(self, frame, origin: float, at: int, left: tuple[float, float]):
        self.frame, self.origin, self.at = frame, origin, at
        self.start, self.end, low, high = frame[at]
        self.gap = left[1] < low
        self.after, self.against, self.inside = Features(rising=True), Features(rising=False), False
        self.after.push(low, high)

    def feed(self, j: int, reader: SegmentReader, *of) -> tuple[int, int] | None:
        """Take stroke j: (evidence, mode) when it proves the reversal, REVOKED, or None."""
        _, close, low, high = self.frame[j]
        if (j - self.at) % 2:
            self.against.push(low, high)
            return self._risen(j, close, reader, *of)
        self.after.push(low, high)
        return self._fallen(j, close, reader, *of)

    def _risen(self, j, close, reader, *of):
        if self.gap and len(self.after.lows) > 1 and self.against.bottoms_out():
            return j, 2
        answer = reader.swing(self, j, *of) if self.inside else None
        return answer or (REVOKED if close > self.start else None)

    def _fallen(self, j, close, reader, *of):
        if not self.gap and close < self.end and reader.selects(self, j):
            return j, 1
        if not self.after.falls():
            return None
        if self.gap:
            return (j, 2) if self.against.bottoms_out() else None
        if close < self.end:
            return j, 1
        answer = reader.held(self, j, close, *of)
        self.inside = True
        return answer


class SegmentReader:
    """Segment ends over one stroke list, remembered by (strokes seen, first stroke)."""

    def __init__(self, strokes: Sequence[Unit]):
        self.strokes = strokes
        self.known: dict[tuple, tuple[int, int, int] | None] = {}
        self.frames = {
            UP: [(u.start, u.end, u.low, u.high) for u in strokes],
            DOWN: [(-u.start, -u.end, -u.high, -u.low) for u in strokes],
        }

    def frame_of(self, stroke: int):
        return self.frames[self.strokes[stroke].direction]

    def end_of(self, first: int, seen: int, *of) -> tuple[int, int, int] | None:
        """(boundary stroke, evidence stroke, mode) of the segment from `first`, from the first `seen` strokes alone."""
        key = (seen, first, *of)
        if key not in self.known:
            self.known[key] = self._search(first, seen, *of)
        return self.known[key]

    def meet(self, at: int, seen: int | None = None) -> bool:
        """Three strokes from `at` share a price."""
        part = self.frames[UP][at : min(at + 3, seen or at + 3)]
        return len(part) == 3 and max(x[2] for x in part) <= min(x[3] for x in part)

    def proof(self, turn: Turn, seen: int, *of) -> tuple[int, int] | None:
        for j in range(turn.at + 1, seen):
            if answer := turn.feed(j, self, *of):
                return None if answer is REVOKED else answer
        return None

    def proofs(self, frame, first: int, turn: int, left: tuple[float, float], seen: int, *of) -> list[tuple[int, int]]:
        """Proofs of a reversal against the merged feature, and against the raw stroke before where it crosses the segment's start."""
        origin, high = frame[first][0], frame[turn][3]
        out = []
        for low, top, raw in ((*left, False), (*frame[turn - 2][2:], True)):
            hit = self.proof(Turn(frame, origin, turn, (low, top)), seen, *of) if high > top else None
            if hit and (not raw or (frame[hit[0]][1] < origin and hit[0] >= turn + 2 and self.meet(turn))):
                out.append(hit)
        return out

    def _search(self, first: int, seen: int) -> tuple[int, int, int] | None:
        frame = self.frame_of(first)
        features = Features(rising=True)
        best: tuple[int, int, int] | None = None
        for turn in range(first + 1, seen, 2):
            if best is not None and turn >= best[0]:
                break  # any later turn is proved later
            start, _, low, high = frame[turn]
            if turn >= first + 3 and start > frame[first][0]:
                for at, mode in self.proofs(frame, first, turn, (features.lows[-1], features.highs[-1]), seen if best is None else best[0] + 1):
                    if best is None or (at, turn) < best[:2]:
                        best = (at, turn, mode)
            features.push(low, high)
        return None if best is None else (best[1], best[0], best[2])

    def selects(self, turn: Turn, j: int) -> bool:
        """A lower fall before the features turned: no proof by itself."""
        return False

    def held(self, turn: Turn, j: int, close: float) -> tuple[int, int] | None:
        """A fall inside the first stroke proves the reversal only beyond the segment's start."""
        return (j, 1) if close < turn.origin else None

    def swing(self, turn: Turn, j: int) -> tuple[int, int] | None:
        """The swing inside the first stroke ends both segments once a segment against it is complete."""
        return (j, 1) if self.end_of(turn.at, j + 1) else None


class Premise(NamedTuple):
    """What is known of the time before stroke `first`, which starts at `price`, and from which stroke count on."""

    basis: str
    first: int
    direction: str
    price: float
    known_at: int | None

    def check(self) -> Premise:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
        number = isinstance(self.price, (int, float)) and not isinstance(self.price, bool) and math.isfinite(self.price)
        if self.basis not in BASES:
            raise ValueError(f"the basis of a premise is one of {BASES}")
        if not whole(self.first) or self.direction not in (UP, DOWN) or not number:
            raise ValueError("a premise names a stroke, its direction and its finite start price")
        if self.known_at is not None if self.basis == "unknown" else not whole(self.known_at):
            raise ValueError("a premise is known from a stroke count on, an unknown one from none")
        if self.basis == "no_prior_history" and self.first != 0:
            raise ValueError("only the first stroke has no history")
        return self


class Proof(NamedTuple):
    """Strokes first..stop-1; local: the stroke that proves the end; published: the stroke from which all it rests on is known."""

    first: int
    stop: int
    local: int | None
    published: int | None


@dataclass(frozen=True, eq=False)
class Lineage:
    """Of the segment from stroke `first`. Equal lineages are one object (PremisedReader.lineage)."""

    first: int
    before: Proof | None
    parent: Lineage | None
    standing: str
    premise: Premise

    @property
    def is_beginning(self) -> bool:
        return self.before is None and self.premise.basis == "no_prior_history"

    def seen_from(self, observed: int) -> tuple[str, int | None]:
        """unknown, waiting or visible at a stroke, and since which stroke."""
        if self.is_beginning:
            return ("visible" if self.premise.known_at <= observed else "waiting"), self.premise.known_at
        if self.standing == "unknown":
            return "unknown", None
        since = self.before.published
        return ("visible" if self.before.local is not None and since is not None and since <= observed else "waiting"), since

    def prove(self, first: int, end: tuple[int, int, int]) -> Proof:
        stop, local, _ = end
        since = self.premise.known_at if self.before is None else self.before.published if self.before.local is not None else None
        return Proof(first, stop, local, None if since is None else max(local, since))


class Certificate(NamedTuple):
    kind: str
    state: str
    standing: str
    proof: int | None
    published: int | None
    reaction: Proof | None


CONFIRMED, BROKEN, SELECTED, PENDING = "confirmed_without_start_break", "first_start_broken", "first_end_selected", "pending"


class PremisedReader(SegmentReader):
    """Segment ends and certificates under lineages."""

    def __init__(self, strokes: Sequence[Unit]):
        super().__init__(strokes)
        self.lineages: dict[tuple, Lineage] = {}
        self.certificates: dict[tuple, Certificate] = {}
        self.reactions: dict[tuple, tuple[int, Proof | None]] = {}

    def lineage(self, first: int, before: Proof | None, parent: Lineage | None, standing: str, premise: Premise) -> Lineage:
        key = (first, before, parent, standing, premise)
        return self.lineages.setdefault(key, Lineage(*key))

    def supposed(self, first: int, boundary: int, of: Lineage) -> Lineage:
        """Of a segment after one that is not proved to end at the boundary."""
        return self.lineage(boundary, Proof(first, boundary, None, None), of, "waiting", of.premise)

    # what a turn asks ---------------------------------------------------------------------------------------------

    def selects(self, turn: Turn, j: int) -> bool:
        return self.meet(turn.at, j + 1)

    def _settled(self, state: Certificate, of: Lineage, name: str) -> bool:
        """At the beginning of all history a state counts as it is; elsewhere only where the lineage is visible."""
        return state.state == name and (of.is_beginning or state.standing == "visible")

    def held(self, turn: Turn, j: int, close: float, of: Lineage):
        state = self.certificate(turn.at, j + 1, of)
        if self._settled(state, of, CONFIRMED):
            return state.proof, 1
        return (j, 1) if close < turn.origin and of.is_beginning else None

    def swing(self, turn: Turn, j: int, of: Lineage):
        state = self.certificate(turn.at, j + 1, of)
        if self._settled(state, of, BROKEN):
            return REVOKED
        if self._settled(state, of, CONFIRMED):
            return state.proof, 1
        if of.is_beginning and self.end_of(turn.at, j + 1, self.supposed(of.first, turn.at, of)):
            return j, 1
        return None

    # certificates -------------------------------------------------------------------------------------------------

    def certificate(self, first: int, seen: int, of: Lineage) -> Certificate:
        """How the race about a reversal at stroke `first` stands after `seen` strokes."""
        key = (seen, first, of)
        if key not in self.certificates:
            self.certificates[key] = self._certify(first, seen, of)
        return self.certificates[key]

    def _certify(self, first: int, seen: int, of: Lineage) -> Certificate:
        frame, own = self.frame_of(first), first >= of.first + 3
        start, end = frame[first][:2]
        runners = []
        if own:
            broken = next((j for j in range(first + 1, seen, 2) if frame[j][1] < start), None)
            selected = next((j for j in range(first + 2, seen, 2) if frame[j][1] > end), None) if self.meet(first, seen) else None
            runners = [(j, rank, name) for rank, (j, name) in enumerate(((broken, BROKEN), (selected, SELECTED))) if j is not None]
        begun = own and self.meet(first + 1, seen) and frame[first + 3][1] < frame[first + 1][0]
        reaction = self._reaction(first, seen, of) if begun else None
        if reaction:
            runners.append((reaction.local, 2, CONFIRMED))
        proof, _, state = min(runners, default=(None, 0, PENDING))
        standing, since = of.seen_from(seen - 1)
        if standing == "unknown":
            kind = "context_unproved"
        elif standing == "waiting":
            kind = "qualification_waiting"
        elif state == PENDING:
            kind = "reaction_pending" if begun else "reaction_origin_unproved"
        else:
            kind = f"reaction_{state}" if state == CONFIRMED else state
        published = max(proof, since) if standing == "visible" and proof is not None else None
        return Certificate(kind, state, standing, proof, published, reaction if state == CONFIRMED else None)

    def _reaction(self, first: int, seen: int, of: Lineage) -> Proof | None:
        """The segment against the reversal at its earliest proof within `seen` strokes; prefixes seen before are not tried again."""
        tried, found = self.reactions.get((first, of), (first + 3, None))
        against = self.lineage(first + 1, Proof(first, first + 1, None, None), self.supposed(of.first, first, of), "waiting", of.premise)
        while found is None and tried < seen:
            tried += 1
            if end := self.end_of(first + 1, tried, against):
                found = against.prove(first + 1, end)
        self.reactions[first, of] = tried, found
        return found if tried <= seen else None

    # segment ends -------------------------------------------------------------------------------------------------

    def _search(self, first: int, seen: int, of: Lineage) -> tuple[int, int, int] | None:
        frame = self.frame_of(first)
        features = Features(rising=True)
        ends: list[tuple[int, int, int]] = []
        gaps: list[tuple[int, tuple[float, float]]] = []
        firsts: list[int] = []
        for turn in range(first + 1, seen, 2):
            start, _, low, high = frame[turn]
            if turn >= first + 3 and start > frame[first][0]:
                left = (features.lows[-1], features.highs[-1])
                if left[1] < low:
                    gaps.append((turn, left))
                elif high > left[1] and self.meet(turn, seen):
                    firsts.append(turn)
                ends += [(at, turn, mode) for at, mode in self.proofs(frame, first, turn, left, seen, of)]
            features.push(low, high)
        for at, turn, mode in sorted(ends):
            if not (self._reaction_holds(first, turn, at, of) or self._reversal_holds(frame, firsts, turn, at, of) or self._gap_holds(frame, gaps, turn, at)):
                return turn, at, mode
        return None

    def _reaction_holds(self, first: int, turn: int, at: int, of: Lineage) -> bool:
        """The race about the segment's own first stroke, as a reversal of its parent, forbids a lower turn."""
        frame, parent = self.frame_of(first), of.parent
        if parent is None or turn <= first + 3 or not frame[turn][0] < frame[first][1]:
            return False
        if parent.is_beginning and of.before is not None and of.before.local is not None and of.before.local <= at:
            return False
        state = self.certificate(first, at + 1, parent)
        if state.kind in ("reaction_pending", "reaction_origin_unproved", BROKEN, "qualification_waiting"):
            return True
        if state.kind != f"reaction_{CONFIRMED}":
            return False
        # beyond the reaction there must be the shape of another segment of this direction before the turn
        stop = state.reaction.stop
        shaped = turn - stop >= 3 and (stop - first) % 2 == 0 and self.meet(stop, turn) and frame[turn - 1][1] > frame[stop][0]
        return not shaped

    def _reversal_holds(self, frame, firsts: list[int], turn: int, at: int, of: Lineage) -> bool:
        """An earlier, as high reversal without a gap that is not settled yet."""
        return any(
            e < turn and frame[e][0] >= frame[turn][0] and self.certificate(e, at + 1, of).kind in ("reaction_pending", "qualification_waiting") for e in firsts
        )

    def _gap_holds(self, frame, gaps, turn: int, at: int) -> bool:
        """An earlier, higher reversal across a gap that still waits for its second sequence."""
        return any(e < turn and frame[e][0] > frame[turn][0] and self._gap_waits(frame, e, left, at) for e, left in gaps)

    @staticmethod
    def _gap_waits(frame, turn: int, left: tuple[float, float], at: int) -> bool:
        after, against, formed = Features(rising=True), Features(rising=False), False
        after.push(*frame[turn][2:])
        for j in range(turn + 1, at + 1):
            rising = (j - turn) % 2 == 1
            (against if rising else after).push(*frame[j][2:])
            # the feature before the turn, the turn's own and the one after it: a top of the two kinds of range
            formed = formed or (after.falls() and after.highs[0] > left[1] and after.lows[0] > left[0])
            if (formed and against.bottoms_out()) or (rising and frame[j][1] > frame[turn][0]):
                return False
        return formed


def _open_segment(reader: SegmentReader, at: int, n: int) -> list[Segment]:
    frame = reader.frame_of(at)
    ahead = [j for j in range(at + 2, n, 2) if frame[j][1] > frame[at][0]]
    return [Segment(at, max(ahead, key=lambda j: frame[j][1]), 1, None)] if ahead else []


def segments_of(strokes: Sequence[Unit]) -> list[Segment]:
    """Complete segments, then the open one that the remaining strokes show, if any."""
    reader, out, at, n = SegmentReader(strokes), [], 0, len(strokes)
    while at + 2 < n:
        if not reader.meet(at):
            at += 1
            continue
        end = reader.end_of(at, n)
        if end is None:
            return out + _open_segment(reader, at, n)
        boundary, evidence, mode = end
        out.append(Segment(at, boundary - 1, mode, evidence))
        at = boundary
    return out


def premised_segments(strokes: Sequence[Unit], premise: Premise) -> tuple[list[Segment], list[tuple[int, int, Certificate]]]:
    """Segments under a premise, and (segment, stroke, certificate) of every reversal stroke that a segment could end at.

    A complete segment's evidence is the stroke from which its proof, those before it and the premise are all known; while that lies ahead, it
    is open. A premise that names another stroke than the first three that meet is an error.
    """
    premise = premise.check()
    reader, out, rows, at, n = PremisedReader(strokes), [], [], 0, len(strokes)
    of: Lineage | None = None
    for index in count():
        while at + 2 < n and not reader.meet(at):
            at += 1
        if at + 2 >= n:
            break
        if of is None or of.first != at:
            if (at, strokes[at].direction, strokes[at].start) != premise[1:4]:
                raise ValueError("the premise does not name the stroke at which segments begin")
            of = reader.lineage(at, None, None, "unknown", premise)
        rows += [(index, j, reader.certificate(j, n, of)) for j in range(at + 3, n, 2)]
        end = reader.end_of(at, n, of)
        proof = None if end is None else of.prove(at, end)
        if proof is None or proof.published is None or proof.published >= n:
            out += _open_segment(reader, at, n)
            break
        out.append(Segment(at, proof.stop - 1, end[2], proof.published))
        of = reader.lineage(proof.stop, proof, of, "visible", premise)
        at = proof.stop
    return out, rows
