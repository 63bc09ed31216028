"""Language identification, word first, backing off to character n-grams.

A word that the model knows scores by its log frequency in each language. An unseen word falls back to its character
n-grams, longest first: the longest length of which any n-gram is known decides, by the mean log frequency of the known
ones. A text's language has the highest sum over its words; the score is the posterior of that sum.

The model is fitted on a bounded sample of labelled rows (`docs_per_language`, taken by a hash of the id, so alike in
every run), of any number of languages, and keeps the words and n-grams that occur at least `min_count` times in it; what is
rarer backs off. The sample's bound is the model's, whatever the input's size. Prediction reads every text whole and uses
nothing but the text.

Defined cases: a null text or one without a letter is `und` with score 0; ties go to the language first in sorted
order; without any labelled row every text is `und`; repeated rows each get a row; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, filter_texts, text_parts, text_rows

MAX_GRAM = 5
_LETTERS = regex.compile(r"\p{L}+")
_MEMORY = 100_000
_PORTION = 50_000
_COUNTED = 200_000


@dataclass
class WordModel:
    """Log frequencies, one row of `table` per known word or n-gram and one column per language."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    held: dict[str, int] = field(default_factory=dict)
    sums: np.ndarray | None = None

    def _known(self, word: str) -> list[int]:
        """Rows whose mean is the word's score: its own, or those of its longest known n-grams."""
        if (k := self.words.get(word)) is not None:
            return [k]
        padded = f"^{word}$"
        get = self.grams.get
        for n in range(min(MAX_GRAM, len(padded)), 0, -1):
            if found := [k for i in range(len(padded) - n + 1) if (k := get(padded[i : i + n])) is not None]:
                return found
        return []

    def word_scores(self, words: list[str]) -> np.ndarray:
        """One row per word; a word of which nothing is known scores 0 in every language."""
        rows = list(map(self._known, words))
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        out = np.zeros((len(rows), len(self.languages)))
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(sizes.sum()))
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.table[flat], starts, axis=0) / sizes[some, None]
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Sums over the words of white-space chunks that are not held yet; the last column counts the words."""
        missing = [c for c in chunks if c not in self.held]
        if self.sums is None or len(self.held) + len(missing) > _MEMORY:
            self.held.clear()
            missing = list(chunks)
            self.sums = np.zeros((0, len(self.languages) + 1))
        words = [_LETTERS.findall(c) for c in missing]
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        rows = np.zeros((len(missing), len(self.languages) + 1))
        rows[:, -1] = sizes
        some = np.flatnonzero(sizes)
        if len(some):
            scores = self.word_scores(list(chain.from_iterable(words)))
            rows[some, :-1] = np.add.reduceat(scores, (np.cumsum(sizes) - sizes)[some], axis=0)
        self.held.update(zip(missing, range(len(self.sums), len(self.sums) + len(missing))))
        self.sums = np.concatenate([self.sums, rows])

    def totals(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text the sums over its words and the number of words. Texts are split whole, in bounded portions."""
        part: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            part.append(text.lower().split())
            size += len(part[-1])
            if size >= _PORTION or k == len(texts) - 1:
                self._learn(set().union(*part))
                get = self.held.__getitem__
                for chunks in part:
                    yield self.sums[np.fromiter(map(get, chunks), dtype=np.int64, count=len(chunks))].sum(axis=0)
                part, size = [], 0

    def predict(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        if not self.languages:
            yield from (("und", 0.0) for _ in texts)
            return
        for total in self.totals(texts):
            if not total[-1]:
                yield "und", 0.0
                continue
            scores = total[:-1] - total[:-1].max()
            best = int(np.argmax(scores))
            yield self.languages[best], float(1 / np.exp(scores).sum())


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, key, count): n 0 is a word, else an n-gram. Counts of one task are added up before they leave it."""
    held: dict[str, Counter] = {}
    size = 0
    for batch in batches:
        for part, texts in text_parts(batch, 1):
            for text, lang in zip(texts, part.column(2).to_pylist()):
                words = held.setdefault(lang, Counter())
                size -= len(words)
                words.update(_LETTERS.findall(text.lower()))
                size += len(words)
                if size > _COUNTED:
                    yield from _counts(held)
                    held, size = {}, 0
    yield from _counts(held)


def _counts(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, words in held.items():
        for n in range(MAX_GRAM + 1):
            counts = words
            if n:
                counts = Counter()
                for w, c in words.items():
                    padded = f"^{w}$"
                    for i in range(len(padded) - n + 1):
                        counts[padded[i : i + n]] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts), pa.string()), pa.array(np.full(len(counts), n, dtype=np.int32)), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "n", "key", "count"],
            )


def fit(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 4000, min_count: int = 3) -> WordModel:
    """Learn from the rows where train holds and the language is known."""
    rows = text_rows_with(df.where(train & F.col(lang_col).isNotNull()), id_col, text_col, lang_col)
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return WordModel([], {}, {}, np.zeros((0, 0)))
    languages = sorted(sizes)
    spread = 1 << 20
    # one row per language
    share = df.sparkSession.createDataFrame([(lang, min(spread, math.ceil(spread * docs_per_language / n))) for lang, n in sizes.items()], "lang string, share long")
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(spread)) < F.col("share")).select("doc_id", "text", "lang")
    counts = sample.mapInArrow(_count_batches, "lang string, n int, key string, count long").groupBy("n", "key", "lang").agg(F.sum("count").alias("count"))
    counts = Workspace(df.sparkSession, "langid").write(counts, "counts")
    keyed = counts.groupBy("n", "key").agg(F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by"))
    top = keyed.where(F.col("total") >= min_count)
    sums = {(r.n, r.lang): r.total for r in counts.groupBy("n", "lang").agg(F.sum("count").alias("total")).collect()}
    at = {lang: i for i, lang in enumerate(languages)}
    floors = {n: np.log(0.5 / np.array([sums.get((n, lang), 0) + 1.0 for lang in languages])) for n in range(MAX_GRAM + 1)}
    words: dict[str, int] = {}
    grams: dict[str, int] = {}
    table: list[np.ndarray] = []
    for part in top.select("n", "key", F.map_keys("by").alias("langs"), F.map_values("by").alias("counts")).toArrow().to_batches():
        for n, key, langs, values in zip(*(c.to_pylist() for c in part.columns)):
            scores = floors[n].copy()
            for lang, c in zip(langs, values):
                scores[at[lang]] = math.log(c / (sums[n, lang] + 1.0))
            (grams if n else words)[key] = len(table)
            table.append(scores)
    return WordModel(languages, words, grams, np.array(table))


def text_rows_with(df: DataFrame, id_col: str, text_col: str, other: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(other).alias("lang"))


def predict(df: DataFrame, model: WordModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                lang, score = zip(*held.predict(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return text_rows(df, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_language(df: DataFrame, model: WordModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows, with all columns, whose text has a language that the model is sure of."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def keep():
        return lambda texts: [lang != "und" and score >= min_score for lang, score in shared.value.predict(texts)]

    return filter_texts(df, text_col, keep)
