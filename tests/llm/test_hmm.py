import itertools
import math
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from structura.llm import hmm, queries
from structura.llm.common import Workspace, crc_mod


def random_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    row = lambda *s: (x := rng.uniform(0.1, 1, s)) / x.sum(axis=-1, keepdims=True)
    return hmm.Hmm(row(states), row(states, states), row(states, symbols))


def brute_paths(m, seq):
    """(probability, path) of every path of states."""
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[path[0], seq[0]]
        for a, b, o in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[b, o]
        yield p, path


def test_forward_and_expected_counts_against_all_paths():
    m = random_model()
    sequences = [np.array(s) for s in ([0], [1, 2], [4, 4, 0, 3], [2, 1, 0], [3, 2, 1, 0, 4])]
    assert np.allclose(m.log_likelihoods(sequences), [math.log(sum(p for p, _ in brute_paths(m, s))) for s in sequences])
    start, move, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for s in sequences:
        paths = list(brute_paths(m, s))
        whole = sum(p for p, _ in paths)
        for p, path in paths:
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                move[a, b] += p / whole
            for a, o in zip(path, s):
                emitted[a, o] += p / whole
    for got, want in zip(m.expected(sequences), (start, move, emitted)):
        assert np.allclose(got, want)


def test_rounds_never_lower_the_likelihood():
    rng = np.random.default_rng(1)
    truth = random_model(2, 6, 3)
    sequences = [rng.integers(0, 6, rng.integers(1, 40)) for _ in range(50)]
    m, last = random_model(2, 6, 5), -np.inf
    for _ in range(8):
        now = m.log_likelihoods(sequences).sum()
        assert now >= last - 1e-9
        last = now
        start, move, emitted = m.expected(sequences)
        m = hmm.Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=1, keepdims=True))
    assert truth.emit.shape == m.emit.shape


def test_padded_batches_of_any_size(monkeypatch):
    m = random_model()
    sequences = [np.arange(n) % 5 for n in (1, 50, 3, 3, 20, 7)]
    whole, counts = m.log_likelihoods(sequences), m.expected(sequences)
    monkeypatch.setattr(hmm, "_PADDED", 10)
    assert np.allclose(m.log_likelihoods(sequences), whole)
    assert all(np.allclose(a, b) for a, b in zip(m.expected(sequences), counts))


@pytest.fixture(scope="module")
def rows(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("held", crc_mod("doc_id", 7) == 2).collect()
    return docs, {r.doc_id: r for r in queries.op7_hidden_markov_lm(spark, sf).collect()}


def tokens(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()


def test_base_against_brute_force_and_gain_on_held_out_text(rows):
    docs, got = rows
    counts = Counter()
    for r in docs:
        if not r.held:
            counts.update([*tokens(r.text), None])
    n, v = sum(counts.values()), len(counts)
    for r in docs:
        own = [*tokens(r.text), None]
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (r.held, len(own), sum(counts[t] > 0 for t in own), n)
        assert math.isclose(g.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b c a a", "d", "a zz yy"])], "doc_id long, text string")
    model, counts = hmm.fit(df, F.lit(True), Workspace(spark, "test"), states=2, top_words=2, tail_classes=3)
    words = {r.word.encode(): r.c for r in counts.collect()}
    sums = np.zeros(model.classes.size)
    for w, c in words.items():
        k = model.classes.of_word(w)
        sums[k] += np.exp(model.within(np.array([k]), np.array([c])))[0]
    sums += model.unseen
    sums[0] = 1
    assert np.allclose(sums, 1) and np.allclose(model.hmm.emit.sum(axis=1), 1)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "A a", "x"), (None, "b", "x"), (2, "w " * 40_000, "x")], "doc_id long, text string, score string")
    model, counts = hmm.fit(df, F.lit(True), Workspace(spark, "test"), states=2, top_words=5, tail_classes=3)
    got = hmm.score(df, model, counts, 4).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 3, 40_001] and all(np.isfinite(r.score) and r.score < 0 for r in got)
    none, empty = hmm.fit(df, F.lit(False), Workspace(spark, "test"), states=2, top_words=5, tail_classes=3)
    assert all((r.train_tokens, r.n_known, r.base_score) == (0, 0, 0) for r in hmm.score(df, none, empty, 4).collect())
    assert hmm.score(df.where("false"), model, counts, 4).count() == 0


def calls(f):
    """Python and built-in functions called while f runs."""
    found = Counter()
    sys.setprofile(lambda frame, event, arg: found.update([event]))
    try:
        f()
    finally:
        sys.setprofile(None)
    return found["call"] + found["c_call"]


def test_python_work_does_not_grow_with_texts_or_words():
    # before, each text cost several calls here, and each word a look-up in a dictionary
    def batch(n):
        return pa.RecordBatch.from_pydict({"bucket": pa.array([0] * n, pa.int64()), "doc_id": pa.array(range(n), pa.int64()), "text": [f"w{k} A b" for k in range(n)]})

    counted = lambda n: calls(lambda: list(hmm._word_batches(iter([batch(n).select(["doc_id", "text"])]))))
    asked = lambda n: calls(lambda: list(hmm._asked_batches(iter([batch(n)]))))
    for run in (counted, asked):
        run(10)  # imports
        assert run(5000) < 2 * run(50)


ODD = ["", " ", "a", " A\tb\x0b\x0cc\r\n", "a\x1cb\x85c d\u3000e\u00a0F \u00c9", "x  x x", "\n", "\u00e9 zz\u00e9\u00e9 q"]


def test_words_and_classes_against_python():
    words, sizes = hmm.words_of(pa.array(ODD))
    want = [tokens(t) for t in ODD]
    assert words.cast(pa.binary()).to_pylist() == [w for x in want for w in x] and sizes.tolist() == [len(x) for x in want]
    classes = hmm.Classes([b"a", b"x"], 7)
    for w, k in zip(words.cast(pa.binary()).to_pylist(), classes.of_words(words)):
        assert k == classes.of_word(w) == ({b"a": 1, b"x": 2}.get(w) or 3 + zlib.crc32(w[-3:]) % 7)
    assert hmm.with_ends(np.array([5, 6, 7]), np.array([0, 2, 0, 1])).tolist() == [0, 5, 6, 0, 0, 7, 0]


def test_counts_and_asked_words_while_memory_is_short(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([k % 2 for k in range(len(ODD))], pa.int64()), "doc_id": pa.array(range(len(ODD)), pa.int64()), "text": ODD})
    want = Counter(w for t in ODD for w in tokens(t))
    pairs = {(k % 2, w) for k, t in enumerate(ODD) for w in tokens(t)}
    for text, memory in ((1 << 20, 1000), (1, 1000), (1, 0)):
        monkeypatch.setattr(hmm, "_TEXT", text)
        monkeypatch.setattr(hmm, "_MEMORY", memory)
        got = Counter()
        for b in hmm._word_batches(iter([batch.select(["doc_id", "text"])] * 3)):
            got.update(dict(zip((w.encode() for w in b.column(0).to_pylist()), b.column(1).to_pylist())))
        assert got == Counter({w: 3 * c for w, c in want.items()})
        rows = [(k, w.encode()) for b in hmm._asked_batches(iter([batch] * 3)) for k, w in zip(*(c.to_pylist() for c in b.columns))]
        assert set(rows) == pairs and len(rows) == (3 if memory == 0 else 1) * len(pairs)


def test_a_word_that_was_asked_twice_counts_once(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    model, counts = hmm.fit(df, F.col("doc_id") != 5, Workspace(spark, "test"), states=2, top_words=2, tail_classes=3)
    once = {r.doc_id: r for r in hmm.score(df, model, counts, 2).collect()}
    assert {r.doc_id: r for r in hmm.score(df, model, counts.union(counts), 2).collect()} == once
    assert [once[k].n_known for k in range(len(ODD))] == [1 + sum(w != b"x" for w in tokens(t)) for t in ODD]


def test_rare_scaling_of_long_texts_that_hardly_move():
    # each second step is all but impossible: values shrink as fast as they can between two scalings
    tiny = 1e-9
    m = hmm.Hmm(np.array([0.5, 0.5]), np.array([[1 - tiny, tiny], [tiny, 1 - tiny]]), np.array([[1 - tiny, tiny], [tiny, 1 - tiny]]))
    sequences = [np.arange(n) // 3 % 2 for n in (500, 500, 37, 1)]

    def scaled(s):
        """Forward and backward with a scaling at each step."""
        alpha, scales = [], []
        for t, k in enumerate(s):
            now = (alpha[-1] @ m.move if t else m.start) * m.emit[:, k]
            scales.append(now.sum())
            alpha.append(now / scales[-1])
        beta, moves = np.ones(2), np.zeros((2, 2))
        for t in range(len(s) - 1, 0, -1):
            ahead = m.emit[:, s[t]] * beta / scales[t]
            moves += m.move * np.outer(alpha[t - 1], ahead)
            beta = m.move @ ahead
        return np.log(scales).sum(), moves

    want = [scaled(s) for s in sequences]
    assert np.allclose(m.log_likelihoods(sequences), [x for x, _ in want], rtol=1e-12)
    start, move, emitted = m.expected(sequences)
    assert np.allclose(move, sum(x for _, x in want), rtol=1e-9) and np.isclose(start.sum(), 4) and np.isclose(emitted.sum(), sum(map(len, sequences)))
