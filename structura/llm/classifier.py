"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has a sparse ternary index vector drawn from its hash. Its word vector is the sum of the index vectors of
its neighbours over the whole corpus; tokens share word vectors by hash bucket, so the table has a fixed size. Counts
of (bucket, dimension) are added up in each task and then by bucket, and the finished table is weighted down by
frequency and scaled to unit rows. A document is the mean and the spread of its tokens' word vectors and the mean of
their index vectors; a network with one hidden layer, in numpy, turns that into a probability whose temperature is
calibrated on rows that it was not trained on.

The corpus pass covers every document and uses no labels. The network is fitted on a bounded sample of labelled rows
(`sample_docs`, by a hash of the id). Scoring reads every text whole.

Defined cases: a null or empty text is pooled as zeros and gets a score like any other; a document with two labels
counts by the lower; without labels of both kinds every score is 0.5; repeated rows each get a row; no rows, no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows

BUCKETS = 1 << 13
DIM = 32
_NONZERO = 4
_MEMORY = 700_000
_PORTION = 200_000
#: A token that ends in a run of marks counts as that run.
_TAIL = re.compile(r"[^\w\s]{2,}$")


class Tokens:
    """White-space tokens, lower case, as hash buckets, with a bounded memory."""

    def __init__(self):
        self.held: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.held) + len(words) > _MEMORY:
            self.held.clear()
        for w in words.difference(self.held):
            tail = _TAIL.search(w)
            self.held[w] = zlib.crc32((tail[0] if tail else w).encode()) % BUCKETS

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        self._learn(set(words))
        return np.fromiter(map(self.held.__getitem__, words), dtype=np.int64, count=len(words))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each bucket's sparse index vector."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    dims = rng.permuted(np.tile(np.arange(DIM), (BUCKETS, 1)), axis=1)[:, :_NONZERO]
    return dims, rng.choice(np.array([-1, 1]), (BUCKETS, _NONZERO))


def dense_index() -> np.ndarray:
    dims, signs = index_vectors()
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.put_along_axis(out, dims, signs.astype(np.float32), axis=1)
    return out


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: how often it occurs, and the sum of its neighbours' index vectors."""
    tokens, index = Tokens(), dense_index()
    seen = np.zeros(BUCKETS, dtype=np.int64)
    pairs = np.zeros((BUCKETS, DIM))
    for batch in batches:
        held: list[np.ndarray] = []
        size = 0
        texts = batch.column(1).to_pylist()
        for k, text in enumerate(texts):
            at = tokens.of(text)
            held.append(at)
            size += len(at)
            if size >= _PORTION or k == len(texts) - 1:
                _add_context(held, index, seen, pairs)
                held, size = [], 0
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(some), pa.array(seen[some]), *(pa.array(pairs[some, d].astype(np.int64)) for d in range(DIM))], names=["bucket", "n", *(f"d{d}" for d in range(DIM))]
    )


def _add_context(texts: list[np.ndarray], index: np.ndarray, seen: np.ndarray, pairs: np.ndarray) -> None:
    flat = np.concatenate(texts)
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    seen += np.bincount(flat, minlength=BUCKETS)
    around = np.zeros((len(flat), DIM), dtype=np.float32)
    for step in (1, 2):
        if len(flat) <= step:
            break
        same = (doc[step:] == doc[:-step]).astype(np.float32)[:, None]
        vectors = index[flat]
        around[step:] += vectors[:-step] * same
        around[:-step] += vectors[step:] * same
    for d in range(DIM):
        pairs[:, d] += np.bincount(flat, weights=around[:, d], minlength=BUCKETS)


def word_vectors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Unit word vectors of all buckets, with the index vectors beside them: BUCKETS x 2 DIM."""
    names = ["n", *(f"d{d}" for d in range(DIM))]
    rows = text_rows(df, id_col, text_col).mapInArrow(_context_batches, "bucket long, " + ", ".join(f"{x} long" for x in names))
    total = rows.groupBy("bucket").agg(*(F.sum(x).alias(x) for x in names))
    vectors = np.zeros((BUCKETS, DIM))
    for part in total.toArrow().to_batches():
        at = part.column(0).to_numpy()
        vectors[at] = np.column_stack([part.column(k + 2).to_numpy() for k in range(DIM)])
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.hstack([vectors / np.where(norm > 0, norm, 1), dense_index() / math.sqrt(_NONZERO)]).astype(np.float32)


def pooled(at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors, mean of the index vectors, and their lengths."""
    if not len(at):
        return np.zeros(3 * DIM + 3)
    total, square = np.zeros(2 * DIM), np.zeros(DIM)
    for k in range(0, len(at), _PORTION):
        held = table[at[k : k + _PORTION]]
        total += held.sum(axis=0)
        square += np.square(held[:, :DIM], dtype=np.float64).sum(axis=0)
    mean = total / len(at)
    spread = np.sqrt(np.maximum(square / len(at) - mean[:DIM] ** 2, 0))
    return np.concatenate([mean, spread, [np.linalg.norm(mean[:DIM]), np.linalg.norm(mean[DIM:]), math.log1p(len(at)) / 10]])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 7, decay: float = 1e-3) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature is fitted on the other fifth."""
    rng = np.random.Generator(np.random.PCG64(seed))
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, used = order[:cut], order[cut:] if len(x) > 10 else order
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    width = x.shape[1]
    net = Network(mean, scale, rng.normal(0, 1 / math.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), 0.0)
    params = [net.first, net.first_bias, net.second, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    z = (x - mean) / scale
    step, batch = 0, 64
    for epoch in range(epochs):
        shuffled = rng.permutation(used)
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for k in range(0, len(shuffled), batch):
            at = shuffled[k : k + batch]
            h = np.tanh(z[at] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3][0], -30, 30)))
            g = (p - y[at]) / len(at)
            back = np.outer(g, params[2]) * (1 - h**2)
            grads = [z[at].T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for q, (m, v), d in zip(params, moments, grads):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.first, net.first_bias, net.second, net.second_bias = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[held])
    grid = np.exp(np.linspace(math.log(0.25), math.log(8), 61))
    loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logits / t).mean() for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class Model:
    table: np.ndarray
    network: Network | None


def fit(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = 12_000) -> Model:
    """Word vectors of the whole corpus, and a network from a sample of the labelled rows where train holds."""
    table = word_vectors(df, id_col, text_col)
    spread = 1 << 20
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    n = known.count()
    share = min(spread, math.ceil(spread * sample_docs / n)) if n else 0
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < share)
    docs = text_rows(df, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")  # bounded by sample_docs
    x, y, ids = [], [], []
    for part in docs.mapInArrow(_feature_batches(df, table, ["label"]), "doc_id long, label int, features array<double>").toArrow().to_batches():
        ids += part.column(0).to_pylist()
        y += part.column(1).to_pylist()
        x += part.column(2).to_pylist()
    if len(set(y)) < 2:
        return Model(table, None)
    order = np.argsort(np.array(ids), kind="stable")
    return Model(table, train_network(np.array(x)[order], np.array(y, dtype=float)[order]))


def _feature_batches(df: DataFrame, table: np.ndarray, others: list[str]):
    shared = df.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch in batches:
            found = [pooled(tokens.of(t), shared.value).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + k) for k in range(len(others))), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", *others, "features"])

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (probability of label 1) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = Tokens(), shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if held.network is None or not texts:
                found = np.full(len(texts), 0.5)
            else:
                found = held.network.probabilities(np.array([pooled(tokens.of(t), held.table) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
