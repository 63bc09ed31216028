import numpy as np
import pytest
from pyspark.sql import functions as F
from structura.llm import classifier, queries


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    return labels, queries.op10_random_indexing_quality(spark, sf).collect()


def test_held_out_accuracy(scored):
    labels, rows = scored
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(held) > 40
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.predicted for r in held if labels[r.doc_id] == 1]
    bad = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4


def test_word_vectors_against_brute_force(spark):
    texts = ["a b c d!! e", "b a", "", "c c c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = classifier.word_vectors(df)
    tokens, index = classifier.Tokens(), classifier.dense_index()
    want = np.zeros((classifier.BUCKETS, classifier.DIM))
    for t in texts:
        at = tokens.of(t)
        for i, b in enumerate(at):
            for j in range(max(0, i - 2), min(len(at), i + 3)):
                if i != j:
                    want[b] += index[at[j]]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(table[:, : classifier.DIM], want / np.where(norm > 0, norm, 1), atol=1e-6)
    assert ((index != 0).sum(axis=1) == 4).all()


def test_network_learns_what_a_line_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = classifier.train_network(x, y, epochs=60)
    p = net.probabilities(x)
    assert ((p > 0.5) == y).mean() > 0.9 and 0.25 <= net.temperature <= 8


def test_edge_cases(spark):
    rows = [(1, None, "x"), (1, "good words here", "x"), (2, "", "x"), (3, "bad!! bad!!", "x"), (4, "word " * 60_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (3, 0), (3, 1), (None, 1), (99, 0)], "doc_id long, quality int")
    got = classifier.score(df, classifier.fit(df, labels, F.lit(True))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = classifier.score(df, classifier.fit(df, labels, F.lit(False))).collect()
    assert {r.score for r in none} == {0.5}
    assert classifier.score(df.where("false"), classifier.fit(df.where("false"), labels, F.lit(True))).count() == 0
