import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from structura.llm import importance, queries

WHITE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words, w = [], ""
    for c in text + " ":
        if c in WHITE:
            words += [w] if w else []
            w = ""
        else:
            w += c
    lines = [x for x in text.split("\n") if any(c not in WHITE for c in x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def bucket_counts(text):
    words = [w.lower() for w in (text or "").encode().split()]
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    h = [zlib.crc32(w) for w in words]
    keys = [x * mix & mask for x in h] + [(((a * mix + b) & mask) * mix & mask) ^ 0x5555555555555555 for a, b in zip(h, h[1:])]
    return [(k >> 40) % importance.BUCKETS for k in keys]


def test_base_counts():
    rng = random.Random(2)
    texts = ["", " \n\n", "a", "#*$ |x|\n#*$ |x|\n \n", "one two three four five " * 3, "é ü\n日本 é\x0bü", " x  y"]
    texts += ["".join(rng.choices(["a ", "b ", "c\n", "dé ", "|"], k=rng.randint(1, 120))) for _ in range(300)]
    for t in texts:
        assert importance.base_counts(t.encode()) == brute(t), t
    many = [f"w{i}" for i in range(9000)] * 2
    assert importance.repeated_words([w.encode() for w in many]) == 18_000


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for d, t in docs.items():
        found = np.bincount(bucket_counts(t), minlength=importance.BUCKETS)
        raw += found
        target += found * (d in good)
    ratio = np.log((target + 1) / (target.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    got = queries.op9_hashed_ngram_ratio(spark, sf).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        counts = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        at = bucket_counts(docs[r.doc_id])
        llr = ratio[at].mean() if at else 0
        assert r.base_failed == failed and np.isclose(r.llr, llr) and (r.kept == (not failed and llr >= -0.25))


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "word " * 100_000, 6)], "doc_id long, text string, kept int")
    ratios = importance.fit(df, df.where("false").select("doc_id"))
    assert not ratios.any()
    rows = importance.judge(df, ratios).orderBy("doc_id").collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in rows] == [(0, True, False), (0, True, False), (100_000, True, False)]
    assert importance.judge(df.where("false"), ratios).count() == 0
    assert importance.fit(df.where("false"), df.select("doc_id")).sum() == 0
    two = spark.createDataFrame([(1, "good words"), (2, "raw text")], "doc_id long, text string")
    assert importance.fit(two, two.where("doc_id = 1").select(F.col("doc_id").alias("x"))).any()


@pytest.mark.parametrize("broadcast_ids", [100_000, 0])
def test_every_good_document_counts(spark, broadcast_ids):
    """More good documents than a bounded sample would hold, with ids that repeat or are null."""
    n = 21_000
    df = spark.range(n).selectExpr("id as doc_id", "concat('a', id % 97, ' b', id % 89) as text").unionByName(spark.createDataFrame([(4, "twice a1"), (None, "nowhere")], "doc_id long, text string"))
    good = spark.range(n).where("id % 50 > 0").selectExpr("cast(id as string) as x").union(spark.createDataFrame([("4",), (None,)], "x string"))
    raw, target = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, text in [*((i, f"a{i % 97} b{i % 89}") for i in range(n)), (4, "twice a1"), (None, "nowhere")]:
        at = bucket_counts(text)
        np.add.at(raw, at, 1)
        if i is not None and i % 50:
            np.add.at(target, at, 1)
    want = np.log((target + 1) / (target.sum() + importance.BUCKETS)) - np.log((raw + 1) / (raw.sum() + importance.BUCKETS))
    assert np.allclose(importance.fit(df, good, broadcast_ids=broadcast_ids), want, rtol=0, atol=1e-12)
