"""Hidden Markov language model: Baum-Welch on the whole training corpus, exact likelihoods by scaled forward recursion.

Tokens are words (A-Z lowered, split at ASCII white space) and one end. A state emits a word class and the class emits
the word: the `top_words` most frequent training words are classes of their own, any other word belongs to one of
`tail_classes` classes by its last bytes, the end is a class. Inside a tail class a known word has its share of the
class's tokens and unseen words together have the share that the class's words seen once suggest, so for every history
the probabilities of all known words, and of one unseen word per class, sum to one.

Counts cover every training document. Each task adds up its words, or its expected transitions and emissions, before
they are summed by key, so what reaches the driver is of the model's size. Initial states come from a mixture fitted on
a bounded sample (`start_docs`, by a hash of the id); `rounds` passes of Baum-Welch over all training documents follow.

Texts are split, counted and classed by Arrow's kernels, slices of a batch at a time, never word by word in Python.

Word counts grow with the corpus and are never broadcast. For scoring, documents are dealt into buckets by a hash of
the id; each bucket asks for the counts of its own distinct words and is scored beside them.

Defined cases: a null or wordless text is the end alone; without training documents every count is zero, the base is 0
and the model knows only its prior; repeated rows count and score each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, parts, text_rows

_MEMORY = 350_000
_TEXT = 24 << 20
_PADDED = 250_000


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z lowered, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    split = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.string()), trimmed))  # no word, not an empty one
    return split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def with_ends(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of texts in a row, a zero after each text's."""
    out = np.zeros(len(values) + len(counts), dtype=values.dtype)
    inside = np.ones(len(out), dtype=bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = values
    return out


class Classes:
    """The class of each word; the end is class 0."""

    def __init__(self, top: list[bytes], tail_classes: int):
        self.top = list(top)
        self.first_tail = len(top) + 1
        self.size = self.first_tail + tail_classes
        self.tail_classes = tail_classes
        self.kind = np.dtype("<i2" if self.size < 1 << 15 else "<i4")

    def of_word(self, word: bytes) -> int:
        return int(self.of_words(pa.array([word], pa.binary()))[0])

    def of_words(self, words: pa.Array) -> np.ndarray:
        """Classes of many words: a top word's own, any other's by its last three bytes."""
        words = words.cast(pa.binary())
        out = pc.fill_null(pc.index_in(words, pa.array(self.top, pa.binary())), -1).to_numpy(zero_copy_only=False).astype(self.kind) + self.kind.type(1)
        others = out == 0
        tails = pc.binary_slice(words.filter(pa.array(others)), -3, None).dictionary_encode()
        of_tail = np.array([self.first_tail + zlib.crc32(t) % self.tail_classes for t in tails.dictionary.to_pylist()], dtype=self.kind)
        out[others] = of_tail[tails.indices.to_numpy(zero_copy_only=False)]
        return out


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def batches(self, sequences: list[np.ndarray], most: int | None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Sequences by falling length, in batches of at most `most` symbols or of one sequence: (places, symbols, active by step).

        Symbols go step by step: first those of all sequences' first step, then of the second in those that have one, and so on.
        """
        order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        ends = np.cumsum([len(sequences[k]) for k in order])
        first = 0
        while first < len(order):
            end = len(order) if most is None else max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            part = order[first:end]
            lengths = np.array([len(sequences[k]) for k in part])
            active = len(part) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
            begins = np.cumsum(active) - active
            symbols = np.empty(lengths.sum(), dtype=np.int32)
            for j, k in enumerate(part):
                symbols[begins[: lengths[j]] + j] = sequences[k]
            yield part, symbols, active
            first = end

    def _stride(self, least: float, digits: float) -> int:
        """Steps that may pass before values are scaled, where one step shrinks their sum to `least` of it at worst."""
        return max(1, int(digits / -math.log10(least))) if 0 < least < 1 else 1

    def log_likelihoods(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms of the sequences' exact probabilities."""
        out = np.zeros(len(sequences))
        emit = np.ascontiguousarray(self.emit.T)
        stride = self._stride(float(self.move.min() * self.emit.max(axis=0).min()), 200)
        for part, symbols, active in self.batches(sequences, None):
            total = np.zeros(len(part))
            alpha, at = np.broadcast_to(self.start, (len(part), len(self.start))), 0
            for t, n in enumerate(active.tolist()):
                if t and n < len(alpha):
                    total[n : len(alpha)] += np.log(alpha[n:].sum(axis=1))
                alpha = (alpha[:n] @ self.move if t else alpha[:n]) * emit.take(symbols[at : at + n], axis=0)
                if t % stride == 0:
                    scale = alpha.sum(axis=1)
                    alpha /= scale[:, None]
                    total[:n] += np.log(scale)
                at += n
            total[: len(alpha)] += np.log(alpha.sum(axis=1))
            out[part] = total
        return out

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of one pass over the sequences.

        A symbol's probabilities are taken relative to its largest one and values are scaled every few steps, both of which
        cancel out; `stride` keeps them and their products within a double's range.
        """
        states, symbols_n = self.emit.shape
        start, move, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, symbols_n))
        emit = np.ascontiguousarray((self.emit / self.emit.max(axis=0)).T)
        back, ones = np.ascontiguousarray(self.move.T), np.ones((states, 1))
        stride = self._stride(float(self.move.min()), 120)
        for part, symbols, active in self.batches(sequences, _PADDED):
            ns, begins = active.tolist(), (np.cumsum(active) - active).tolist()
            seen = emit.take(symbols, axis=0)
            alpha, beta = np.empty_like(seen), np.ones_like(seen)
            np.multiply(self.start, seen[: ns[0]], out=alpha[: ns[0]])
            for t in range(1, len(ns)):
                n, at, last = ns[t], begins[t], begins[t - 1]
                now = alpha[at : at + n]
                np.matmul(alpha[last : last + n], self.move, out=now)
                now *= seen[at : at + n]
                if t % stride == 0:
                    now /= now @ ones
            for t in range(len(ns) - 1, 0, -1):
                n, at, last = ns[t], begins[t], begins[t - 1]
                ahead, now = seen[at : at + n], beta[last : last + n]
                ahead *= beta[at : at + n]
                np.matmul(ahead, back, out=now)
                if t % stride == 0:
                    scale = now @ ones
                    now /= scale
                    ahead /= scale  # both meet the same forward values
            beta *= alpha
            norm = beta @ ones
            beta /= norm  # the posterior of the states
            alpha /= norm
            goes_on = np.flatnonzero(np.repeat(np.append(active[1:], 0), active) > np.arange(len(symbols)) - np.repeat(begins, active))
            for i in range(0, len(goes_on), 1 << 14):
                some = goes_on[i : i + (1 << 14)]
                move += self.move * (alpha.take(some, axis=0).T @ seen[ns[0] + i : ns[0] + i + len(some)])
            start += beta[: ns[0]].sum(axis=0)
            for k in range(states):
                emitted[k] += np.bincount(symbols, weights=beta[:, k], minlength=symbols_n)
        return start, move, emitted


def normalised(start: np.ndarray, move: np.ndarray, emitted: np.ndarray, prior: np.ndarray, strength: float = 50.0) -> Hmm:
    """Parameters from expected counts, smoothed toward staying, toward an even start and toward the corpus's classes."""
    states = len(start)
    start = start + 0.5
    move = move + 0.1 + 10 * np.eye(states)
    emitted = emitted + strength * prior
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=1, keepdims=True))


def mixture_start(sequences: list[np.ndarray], symbols: int, states: int, prior: np.ndarray, rounds: int = 30) -> Hmm:
    """States from a mixture of class distributions, one component per text; seeded by the farthest texts in turn."""
    counts = np.array([np.bincount(s, minlength=symbols) for s in sequences if len(s)], dtype=np.float64).reshape(-1, symbols)
    if len(counts) < states:
        rng = np.random.Generator(np.random.PCG64(11))
        emit = prior * rng.uniform(0.5, 1.5, (states, symbols))
        return normalised(np.ones(states), np.eye(states), 1000 * emit / emit.sum(axis=1, keepdims=True), prior)
    shape = np.sqrt((counts + prior) / (counts.sum(axis=1, keepdims=True) + 1))
    chosen = [int(np.argmax(counts.sum(axis=1)))]
    while len(chosen) < states:
        chosen.append(int(np.argmin((shape @ shape[chosen].T).max(axis=1))))
    emit = counts[chosen] + 20 * prior
    weight = np.full(states, 1 / states)
    for _ in range(rounds):
        emit /= emit.sum(axis=1, keepdims=True)
        log = counts @ np.log(emit).T + np.log(weight)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        weight = (post.sum(axis=0) + 1) / (len(counts) + states)
        emit = post.T @ counts + 20 * prior
    total = post.T @ counts.sum(axis=1)
    return normalised(weight * len(counts), np.diag(total), emit, prior)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for part in parts(batch, 1):
            words, _ = words_of(part.column(1))
            held.append(words)
            size += words.nbytes
            if size > _TEXT:
                yield _words(held)
                held, size = [], 0
    yield _words(held)


def _words(held: list[pa.Array]) -> pa.RecordBatch:
    found = pa.chunked_array(held, pa.string()).value_counts()
    return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts").cast(pa.int64())], names=["word", "c"])


@dataclass
class Model:
    classes: Classes
    hmm: Hmm
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    unseen: np.ndarray

    def within(self, cls: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability in its class."""
        known = (1 - self.unseen[cls]) * c / np.maximum(self.class_tokens[cls], 1)
        return np.log(np.where(c > 0, known, self.unseen[cls]))


def fit(
    df: DataFrame, train: Column, ws: Workspace, id_col: str = "doc_id", text_col: str = "text", states: int = 8, top_words: int = 2000, tail_classes: int = 500,
    start_docs: int = 1500, rounds: int = 2,
) -> tuple[Model, DataFrame]:
    """The model, and the table (word, c) of training counts."""
    docs = text_rows(df.where(train), id_col, text_col)
    counts = ws.write(docs.mapInArrow(_word_batches, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n_docs = docs.count()
    words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    top = [r.word.encode() for r in counts.orderBy(F.desc("c"), "word").limit(top_words).collect()]
    classes = Classes(top, tail_classes)

    def class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, once = np.zeros(classes.size, dtype=np.int64), np.zeros(classes.size, dtype=np.int64)
        for batch in batches:
            cls = classes.of_words(batch.column(0))
            c = batch.column(1).to_numpy()
            np.add.at(n, cls, c)
            np.add.at(once, cls, c == 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(once[some])], names=["cls", "n", "once"])

    class_tokens, once = np.zeros(classes.size), np.zeros(classes.size)
    for r in counts.mapInArrow(class_batches, "cls long, n long, once long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect():
        class_tokens[r.cls], once[r.cls] = r.n, r.once
    class_tokens[0] = n_docs
    unseen = np.zeros(classes.size)
    tail = slice(classes.first_tail, None)
    unseen[tail] = np.where(class_tokens[tail] > 0, (once[tail] + 0.5) / (class_tokens[tail] + 1), 1.0)
    prior = (class_tokens + 0.5) / (class_tokens + 0.5).sum()

    def class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                words, sizes = words_of(part.column(1))
                found = with_ends(classes.of_words(words), sizes)
                ends = np.concatenate([[0], np.cumsum(sizes + 1)]) * found.itemsize
                column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["doc_id", "classes"])

    # each text is split and classed once; every round reads these
    sequences = ws.write(docs.mapInArrow(class_rows, "doc_id long, classes binary"), "sequences")
    spread = 1 << 20
    share = min(spread, math.ceil(spread * start_docs / n_docs)) if n_docs else 0
    sample = sequences.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < share).collect() if n_docs else []
    rows = sorted(((r.doc_id, bytes(r.classes)) for r in sample), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    hmm = mixture_start([np.frombuffer(c, dtype=classes.kind) for _, c in rows], classes.size, states, prior)

    for _ in range(rounds if n_docs else 0):
        hmm = _baum_welch(sequences, classes, hmm, prior)
    ws.drop("sequences")
    return Model(classes, hmm, tokens + n_docs, words + bool(n_docs), class_tokens, unseen), counts


def _baum_welch(sequences: DataFrame, classes: Classes, hmm: Hmm, prior: np.ndarray) -> Hmm:
    """One round over all documents. Expected counts leave a task as (place, value by state) rows and are summed by key."""
    states, symbols = hmm.emit.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((states, 1 + states + symbols))
        for batch in batches:
            start, move, emitted = hmm.expected([np.frombuffer(x.as_buffer(), dtype=classes.kind) for x in batch.column(0)])
            total += np.hstack([start[:, None], move, emitted])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(total[k, at]) for k in range(states))], names=["place", *(f"s{k}" for k in range(states))])

    names = [f"s{k}" for k in range(states)]
    rows = sequences.select("classes").mapInArrow(run, "place long, " + ", ".join(f"{x} double" for x in names)).groupBy("place").agg(*(F.sum(x).alias(x) for x in names))
    total = np.zeros((states, 1 + states + symbols))
    for part in rows.toArrow().to_batches():
        total[:, part.column(0).to_numpy()] = np.array([part.column(k + 1).to_numpy() for k in range(states)])
    return normalised(total[:, 0], total[:, 1 : 1 + states], total[:, 1 + states :], prior)


SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, model: Model, counts: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: sizes, the unigram base and the model's log10 probability."""
    spark = df.sparkSession
    docs = text_rows(df, id_col, text_col).select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "text").repartition(buckets, "bucket")
    # a bucket may ask for a word twice; its table of counts does not mind. All columns go in, so that both uses of
    # the dealt documents are one exchange
    asked = docs.mapInArrow(_asked_batches, "bucket long, word string")
    known = asked.join(counts, "word").select("bucket", "word", "c").repartition(buckets, "bucket")
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shared.value
        words, c = right.column("word").combine_chunks().cast(pa.string()), right.column("c").to_numpy()
        cls = m.classes.of_words(words)
        base, within = np.log10(c + 1.0), m.within(cls, c) / math.log(10)
        of_unseen = m.within(np.arange(m.classes.size), np.zeros(m.classes.size, dtype=np.int64)) / math.log(10)
        whole, end = math.log10(m.tokens + m.distinct + 1), int(m.class_tokens[0])
        split = [words_of(part.column(0)) for batch in left.select(["text"]).to_batches() for part in parts(batch, 0)]
        places = pc.index_in(pa.chunked_array([w for w, _ in split], pa.string()), words).combine_chunks()  # a word that was asked twice has its first place
        found: list[np.ndarray] = []
        sequences: list[np.ndarray] = []
        begin = 0
        for text, sizes in split:
            at = places.slice(begin, len(text))
            begin += len(text)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            at = at.drop_null().to_numpy()
            kinds, bases, shares = np.empty(len(known), dtype=cls.dtype), np.zeros(len(known)), np.empty(len(known))
            unseen = m.classes.of_words(text.filter(pa.array(~known)))
            kinds[known], kinds[~known] = cls[at], unseen
            bases[known] = base[at]
            shares[known], shares[~known] = within[at], of_unseen[unseen]
            found.append(np.array([sizes, *(_sums(x, sizes) for x in (known.astype(np.int64), bases, shares))]))
            sequences += np.split(with_ends(kinds, sizes), np.cumsum(sizes + 1)[:-1])
        n, known, bases, shares = np.hstack([np.empty((4, 0)), *found])
        n = n.astype(np.int64) + 1
        columns = [
            left.column("doc_id"), n, known.astype(np.int64) + (end > 0), np.full(len(n), m.tokens, dtype=np.int64),
            bases + math.log10(end + 1) - whole * n, shares + m.hmm.log_likelihoods(sequences) / math.log(10),
        ]
        return pa.Table.from_arrays([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, SCHEMA)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of each text's values, which lie in a row."""
    out = np.zeros(len(sizes), dtype=values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _asked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, word) pairs of what a task has seen, each once while memory lasts."""
    held: dict[int, list[pa.Array]] = {}
    size = 0
    for batch in batches:
        for part in parts(batch, 2):
            for bucket in part.column(0).unique().to_pylist():
                words, _ = words_of(part.column(2).filter(pc.equal(part.column(0), bucket)))
                held.setdefault(bucket, []).append(words)
                size += words.nbytes
            if size > _TEXT:
                held = {b: [pa.chunked_array(words, pa.string()).unique()] for b, words in held.items()}
                size = 0
                if sum(len(words[0]) for words in held.values()) > 2 * _MEMORY:
                    yield from _asked(held)
                    held = {}
    yield from _asked(held)


def _asked(held: dict[int, list[pa.Array]]) -> Iterator[pa.RecordBatch]:
    for bucket, words in held.items():
        found = pa.chunked_array(words, pa.string()).unique()
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), bucket), pa.int64()), found], names=["bucket", "word"])
