"""Quality rules with a hashed n-gram log-likelihood ratio.

Words and word pairs (A-Z lowered) fall into hash buckets. Two multinomials over the buckets, one of a trusted target
and one of the whole raw corpus, give each bucket a log ratio; a document's value is the mean over its n-grams, so
length cancels, and a fixed threshold decides. Raw counts cover every document, target counts every document that is
labelled good. Up to `broadcast_ids` good ids are broadcast, so texts are not shuffled; more of them meet the texts by
shuffle, and no task or driver holds them all. Counts are added up in each task and then by bucket.

Base rules come first: too few words, or too many words inside repeated five-word windows, fail a document whatever
its ratio. Windows are compared exactly, not by hash.

Defined cases: a null text has no words and fails; a missing or unlabelled target gives ratio 0 and keeps what passes
the base rules; repeated label rows count once; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

BUCKETS = 1 << 16
SYMBOLS = b"#*$%&|<>"
_MEMORY = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes:
    """32-bit hashes of lowered words, with a bounded memory."""

    def __init__(self):
        self.held: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        held = self.held
        if len(held) > _MEMORY:
            held.clear()
        for w in set(words).difference(held):
            held[w] = zlib.crc32(w.lower())
        return np.fromiter(map(held.__getitem__, words), dtype=np.uint64, count=len(words))


def buckets_of(hashes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and all adjacent pairs."""
    pairs = (hashes[:-1] * _MIX + hashes[1:]) * _MIX
    both = np.concatenate([hashes * _MIX, pairs ^ np.uint64(0x5555555555555555)])
    return (both >> np.uint64(40)).astype(np.int64) % buckets


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    key, width = at[:n].copy(), len(ids)
    for k in range(1, window):
        if width * len(ids) >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            width = int(key.max()) + 1
        key = key * len(ids) + at[k : k + n]
        width *= len(ids)
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    found = np.flatnonzero(counts[inverse] > 1)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + window, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = raw.split()
    chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def _count_batches(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in batch.column(1).cast(pa.binary()):
                counts += np.bincount(buckets_of(hashes.of(text.as_py().split()), buckets), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    return run


def fit(df: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, broadcast_ids: int = 100_000) -> np.ndarray:
    """Log ratio of each bucket. good_ids: one column of the ids of trusted documents, all of which count."""
    good = good_ids.select(F.col(good_ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    good = F.broadcast(good) if good.count() <= broadcast_ids else good.hint("merge")
    texts = text_rows(df, id_col, text_col)
    count = lambda rows, target: rows.mapInArrow(_count_batches(buckets), "bucket long, n long").withColumn("target", F.lit(target))
    counted = count(texts, False).unionByName(count(texts.join(good, "doc_id", "left_semi"), True))
    own = lambda target: F.coalesce(F.sum(F.when(F.col("target") == target, F.col("n"))), F.lit(0))
    counts = counted.groupBy("bucket").agg(own(False).alias("raw"), own(True).alias("target"))
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for part in counts.toArrow().to_batches():
        at = part.column(0).to_numpy()
        raw[at], target[at] = part.column(1).to_numpy(), part.column(2).to_numpy()
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


def judge(df: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.25, min_words: int = 10, max_repeat: float = 0.2) -> DataFrame:
    """Counts, ratio and verdict of every row."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)  # one value per bucket
    percent = round(100 * max_repeat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hashes = shared.value, WordHashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                raw = text.as_py()
                words = raw.split()
                counts = base_counts(raw)
                llr = float(held[buckets_of(hashes.of(words), len(held))].mean()) if words else 0.0
                failed = counts[0] < min_words or 100 * counts[4] > percent * counts[0]
                rows.append((doc, *counts, failed, llr, not failed and llr >= threshold))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return text_rows(df, id_col, text_col).mapInArrow(run, SCHEMA)
