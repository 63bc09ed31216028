"""Hierarchical multi-length packing.

Every document becomes its token ids plus an end id. Whole windows of the longest tier are cut off first; the rest is
routed to the shortest tier that holds it. Each tier then packs windows of its own length, longest piece first; the gap
left in a window is filled from shorter tiers, first by the longest piece that fits, at last by cutting one piece, so a
finished window is exactly full. Finished windows form step groups: a group takes windows until it holds the same
number of tokens as every other, from one tier where that tier has enough, and mixed ones at the end. What is left at
the end of a partition is cut into ever shorter tiers; only a rest below the shortest tier is a part-filled sequence.

Packing is a streaming pass inside each partition with a bounded pool; there is no shuffle, and a hot source or a long
document changes nothing. Sequence and group numbers carry the partition's number, so a task that runs again gives the
same rows.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_rows

TIERS = (128, 256, 512, 1024)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)
#: The pre-tokenizer of the byte-level vocabulary; a fixed value of its published format.
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encoder = Callable[[str], np.ndarray]
_encoders: dict[str, Encoder] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(x for x in range(256) if x not in set(plain)):
        out[chr(256 + k)] = b
    return out


def byte_bpe_encoder(path: str) -> Encoder:
    """Encoder of a byte-level BPE file of the tokenizers library (its default: special strings in a text are special).

    Ids of such a file ascend in the order of its merges, so they serve as ranks and the same vocabulary runs in the
    faster of the two BPE libraries; tests hold it against the tokenizers library.
    """
    if path in _encoders:
        return _encoders[path]
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    alphabet = byte_alphabet()
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    coder = tiktoken.Encoding("byte-bpe", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    marks = tuple(special)

    def encode(text: str) -> np.ndarray:
        if any(m in text for m in marks):
            return np.array(coder.encode(text, allowed_special="all"), dtype="<u4")
        return np.array(coder.encode_ordinary(text), dtype="<u4")

    _encoders[path] = encode
    return encode


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Pool:
    """Pieces by length, for the longest that fits."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []
        self.tokens = 0

    def add(self, piece: Piece) -> None:
        n = len(piece.ids)
        if n not in self.by_length:
            self.by_length[n] = []
            bisect.insort(self.lengths, n)
        self.by_length[n].append(piece)
        self.tokens += n

    def _take(self, n: int) -> Piece:
        held = self.by_length[n]
        piece = held.pop()
        if not held:
            del self.by_length[n]
            self.lengths.pop(bisect.bisect_left(self.lengths, n))
        self.tokens -= n
        return piece

    def at_most(self, n: int) -> Piece | None:
        k = bisect.bisect_right(self.lengths, n)
        return self._take(self.lengths[k - 1]) if k else None

    def above(self, n: int) -> Piece | None:
        k = bisect.bisect_right(self.lengths, n)
        return self._take(self.lengths[k]) if k < len(self.lengths) else None


class TieredPacker:
    """Packs one partition's documents; `rows` receives what is finished."""

    def __init__(self, base: int = 0, tiers: tuple[int, ...] = TIERS, pool_tokens: int = 1 << 17, step_tokens: int = 1 << 14):
        if any(b != 2 * a for a, b in zip(tiers, tiers[1:])) or tiers[0] & (tiers[0] - 1):
            raise ValueError("tiers must be powers of two, each twice the one before")
        self.tiers, self.pool_tokens, self.step_tokens = tiers, pool_tokens, max(step_tokens, tiers[-1])
        self.pools = {t: Pool() for t in tiers}
        self.open: dict[int, list[list[Piece]]] = {t: [] for t in tiers}
        self.sequence = self.group = base
        self.rows: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        total, top, at = len(ids), self.tiers[-1], 0
        while total - at >= top:
            self._window(top, [Piece(doc, at, ids[at : at + top], total)])
            at += top
        if at < total:
            self._route(Piece(doc, at, ids[at:], total))
        if sum(p.tokens for p in self.pools.values()) > self.pool_tokens:
            self._pack(self.pool_tokens // 2)

    def _route(self, piece: Piece) -> None:
        n = len(piece.ids)
        self.pools[next(t for t in self.tiers if t >= n)].add(piece)

    def _fill(self, gap: int, tier: int, window: list[Piece]) -> int:
        """Fill from shorter tiers, then from the tier itself; the gap that remains is zero unless the pools are empty."""
        order = [t for t in reversed(self.tiers) if t < tier] + [tier]
        while gap:
            piece = next((p for t in order if (p := self.pools[t].at_most(gap))), None)
            if piece is None:
                piece = next((p for t in reversed(order) if (p := self.pools[t].above(gap))), None)
                if piece is None:
                    return gap
                piece, rest = piece.cut(gap)
                self._route(rest)
            window.append(piece)
            gap -= len(piece.ids)
        return 0

    def _pack(self, keep: int) -> None:
        for tier in reversed(self.tiers):
            while sum(p.tokens for p in self.pools.values()) > keep and (first := self.pools[tier].at_most(tier)):
                window = [first]
                if self._fill(tier - len(first.ids), tier, window):
                    for piece in window:
                        self._route(piece)
                    break
                self._window(tier, window)

    def _window(self, tier: int, pieces: list[Piece]) -> None:
        held = self.open[tier]
        held.append(pieces)
        if len(held) * tier >= self.step_tokens:
            for window in held:
                self._emit(tier, window)
            self.group += 1
            held.clear()

    def _emit(self, tier: int, window: list[Piece]) -> None:
        offset = 0
        for p in window:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, self.sequence, offset, tier, self.group))
            offset += len(p.ids)
        self.sequence += 1

    def finish(self) -> None:
        self._pack(0)
        rest = [p for t in reversed(self.tiers) for k in sorted(self.pools[t].by_length, reverse=True) for p in self.pools[t].by_length[k]]
        left, last = sum(len(p.ids) for p in rest), []
        for tier in reversed(self.tiers):
            while left >= tier:
                window, gap = [], tier
                while gap:
                    piece = rest.pop(0)
                    if len(piece.ids) > gap:
                        piece, more = piece.cut(gap)
                        rest.insert(0, more)
                    window.append(piece)
                    gap -= len(piece.ids)
                self._window(tier, window)
                left -= tier
        if rest:
            last = [(self.tiers[-1], rest)]
        # mixed groups of what no tier could fill alone, longest windows first
        mixed = [(t, w) for t in reversed(self.tiers) for w in self.open[t]] + last
        held = 0
        for tier, window in mixed:
            if held + tier > self.step_tokens:
                self.group += 1
                held = 0
            self._emit(tier, window)
            held += tier
        self.group += bool(mixed)


def _pack_batches(path: str, end_id: int, tiers, pool_tokens: int, step_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe_encoder(path)
        context = TaskContext.get()
        packer = TieredPacker((context.partitionId() if context else 0) << 32, tiers, pool_tokens, step_tokens)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc, np.concatenate([encode(text.as_py()), end]))
                if len(packer.rows) >= 20_000:
                    yield _batch(packer.rows)
        packer.finish()
        yield _batch(packer.rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    rows.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, columns)], names=names)


def pack(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    tiers: tuple[int, ...] = TIERS, pool_tokens: int = 1 << 17, step_tokens: int = 1 << 14,
) -> DataFrame:
    """One row per piece: where its ids lie in its document and in its sequence, with tier and step group."""
    return text_rows(df, id_col, text_col).mapInArrow(_pack_batches(tokenizer_path, end_id, tiers, pool_tokens, step_tokens), SCHEMA)
