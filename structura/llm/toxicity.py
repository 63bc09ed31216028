"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled rows: one on windows of ordinary text, one on toxic passages. Each
window of a text, twelve words, is compressed once with the ordinary dictionary and once with that dictionary followed by
the toxic one; the bytes that the toxic dictionary saves are the window's margin. Margins pass thresholds, and a logistic
calibration of how many windows pass each gives the document's score.

Toxic passages are the stretches of toxic texts whose byte n-grams occur in many toxic documents and in next to no
ordinary one. Trained on whole toxic texts, the dictionary fills with the ordinary prose around the toxicity and finds a
quarter of the toxic documents; the README has the figures. The library chooses and orders the dictionary's content.

What makes short windows work: both compressors share the ordinary dictionary's entropy tables and offsets (a filler
stands where the other holds the toxic part), literals stay uncompressed, and each window is followed by a fixed carrier
that both hold, as zstandard begins no match in a block's last eight bytes and keeps a block raw unless it saves some.
So a margin is what the toxic part explains and the ordinary one does not.

Fitting takes a bounded sample of labelled rows (`toxic_docs`, `ordinary_docs`, by a hash of the id) and of their windows
and passages (`windows`, `passages`); scoring reads every text whole.

Defined cases: a null or wordless text has no windows and gets the score of a text in which none passes; a run of more
than 64 characters without white space counts as several words; a document with two labels counts as toxic; without labels
of both kinds every score is 0.5; where there is too little text to train a dictionary on, its samples themselves are the
dictionary; repeated rows each get a row; no rows, no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, text_rows

CARRIER = bytes(range(1, 33))
THRESHOLDS = (1, 2, 3, 4, 6, 8, 12)
FEATURES = 2 * len(THRESHOLDS)
WINDOW = 12
GRAM = 4
_WORD = 64
_PER_DOC = 40
_GRAMS = 400_000


def compressor(content: bytes):
    """Compress by a dictionary; target_length 1 with the fast strategy leaves literals as they are."""
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=18, search_log=4, min_match=5, target_length=1, strategy=zstandard.STRATEGY_FAST,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_AUTO)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained by the library; the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def words_of(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > _WORD:
        words = [w[i : i + _WORD] for w in words for i in range(0, len(w), _WORD)]
    return words


def windows_of(text: str) -> list[bytes]:
    """The text's windows, with a space at both ends."""
    words = words_of(text)
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


def grams_of(raw: bytes) -> np.ndarray:
    """The byte n-grams at each place, as numbers."""
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    n = max(0, len(x) - GRAM + 1)
    out = np.zeros(n, dtype=np.int64)
    for i in range(GRAM):
        out = out << 8 | x[i : i + n]
    return out


def passages_of(raw: bytes, grams: np.ndarray) -> list[bytes]:
    """The stretches of two places or more whose n-grams are all among the given ones, sorted."""
    codes = grams_of(raw)
    if not len(codes) or not len(grams):
        return []
    at = np.searchsorted(grams, codes)
    inside = grams[np.minimum(at, len(grams) - 1)] == codes
    turns = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return [raw[i : j + GRAM - 1] for i, j in zip(turns[::2].tolist(), turns[1::2].tolist())]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    bias: float


class Margins:
    """Bytes that the toxic dictionary saves, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.with_toxic, self.without = compressor(ordinary + toxic), compressor(ordinary + bytes(len(toxic)))

    def of(self, text: str) -> np.ndarray:
        windows = [w + CARRIER for w in windows_of(text)]
        length = lambda f: np.fromiter(map(len, map(f, windows)), dtype=np.int64, count=len(windows))
        return length(self.without) - length(self.with_toxic)

    def features(self, text: str) -> np.ndarray:
        margins = self.of(text)
        n = (margins >= np.array(THRESHOLDS)[:, None]).sum(axis=1).astype(np.float64)
        return np.concatenate([np.log1p(n), 10 * n / (len(margins) + 5)])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, toxic_weight: float = 8.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on standardised columns; toxic rows weigh `toxic_weight` times."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    weight = np.where(y > 0, toxic_weight, 1.0)
    w = np.zeros(z.shape[1])
    w[-1] = math.log((y.sum() * toxic_weight + 0.5) / (len(y) - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / spread
    return scaled, float(w[-1] - mean @ scaled)


def _normalised(text: str) -> bytes:
    return f" {' '.join(words_of(text))} ".encode()


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, toxic documents, ordinary documents) of a task."""
    parts: list[np.ndarray] = []
    size = 0

    def take() -> pa.RecordBatch:
        gram, at = np.unique(np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64), return_inverse=True)
        toxic = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        n = np.bincount(at, minlength=len(gram))
        t = np.bincount(at, weights=toxic, minlength=len(gram)).astype(np.int64)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(t), pa.array(n - t)], names=["gram", "t", "o"])

    for batch in batches:
        for text, toxic in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            grams = np.unique(grams_of(_normalised(text)))
            parts.append((grams, np.full(len(grams), toxic, dtype=np.int64)))
            size += len(grams)
            if size > _GRAMS:
                yield take()
                size = 0
    yield take()


def _spread(samples: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    rows = [(zlib.crc32(raw, doc & 0xFFFFFFFF), doc, raw) for doc, raw in samples]
    place, doc, raw = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(doc, pa.int64()), pa.array(raw, pa.binary())], names=["place", "doc_id", "raw"])


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of ordinary texts, at most _PER_DOC of each."""
    for batch in batches:
        found = ((doc, w) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in sorted(windows_of(text), key=zlib.crc32)[:_PER_DOC])
        yield _spread(found)


def _passage_batches(grams: np.ndarray):
    """Distinct passages of toxic texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _spread((doc, p) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in sorted(set(passages_of(_normalised(text), grams))))

    return run


def _samples(found: DataFrame, most: int) -> list[bytes]:
    """A bounded sample by hash, in one order on every run."""
    return [bytes(r.raw) for r in found.orderBy("place", "doc_id", "raw").limit(most).collect()]


def fit(
    df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    toxic_docs: int = 4000, ordinary_docs: int = 8000, windows: int = 40_000, passages: int = 60_000, min_share: float = 0.01, max_share: float = 0.0005,
    toxic_bytes: int = 4096, ordinary_bytes: int = 65_536,
) -> Model:
    """Learn from labelled rows where train (a condition on the label table's id column) holds.

    A passage's n-grams occur in at least `min_share` of the toxic and less than `max_share` of the ordinary documents.
    """
    spread = 1 << 20
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    sizes = {int(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(b"", b"", np.zeros(FEATURES), 0.0)
    share = [min(spread, math.ceil(spread * most / sizes[k])) for k, most in ((0, ordinary_docs), (1, toxic_docs))]
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    docs = text_rows(df, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")  # bounded by the two parameters

    counted = docs.mapInArrow(_gram_batches, "gram long, t long, o long").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    least, most = max(3, min_share * min(sizes[1], toxic_docs)), max(2, max_share * min(sizes[0], ordinary_docs))
    marked = np.sort(np.array([r.gram for r in counted.where((F.col("t") >= least) & (F.col("o") < most)).select("gram").collect()], dtype=np.int64))
    columns = "place long, doc_id long, raw binary"
    ordinary = trained(_samples(docs.where("toxic = 0").mapInArrow(_window_batches, columns), windows), ordinary_bytes, 24)
    toxic = trained(_samples(docs.where("toxic = 1").mapInArrow(_passage_batches(marked), columns), passages), toxic_bytes, 16)

    x, y = [], []
    for part in docs.mapInArrow(_feature_batches(toxic, ordinary), "toxic int, features array<double>").toArrow().to_batches():
        y += part.column(0).to_pylist()
        x += part.column(1).to_pylist()
    order = np.lexsort(np.array(x).T) if x else []
    return Model(toxic, ordinary, *calibrate(np.array(x)[order], np.array(y, dtype=float)[order])) if x else Model(b"", b"", np.zeros(FEATURES), 0.0)


def _feature_batches(toxic: bytes, ordinary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = Margins(toxic, ordinary)
        for batch in batches:
            found = [margins.features(t).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(found, pa.list_(pa.float64()))], names=["toxic", "features"])

    return run


class Scorer:
    """Scores of texts by a model."""

    def __init__(self, model: Model):
        self.model = model
        self.margins = Margins(model.toxic, model.ordinary) if model.ordinary else None

    def __call__(self, text: str) -> float:
        z = self.model.bias + (float(self.margins.features(text) @ self.model.weights) if self.margins else 0.0)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def without_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows, with all columns, whose score is below the threshold."""

    def keep():
        score_of = Scorer(model)
        return lambda texts: [score_of(t) < threshold for t in texts]

    return filter_texts(df, text_col, keep)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of the toxic label) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = Scorer(model)
        for batch in batches:
            found = [score_of(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
