import random

import numpy as np
import pytest
import xxhash
from structura.llm import queries, simhash
from structura.llm.common import local_labels


def brute_fingerprint(text):
    raw = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in raw).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> smallest id reachable, per row."""
    prints = sorted({f for _, f in rows})
    arr = np.array(prints, dtype=np.uint64)
    u, v = [], []
    for i in range(len(arr)):
        near = np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3)
        u += [i] * len(near)
        v += near.tolist()
    labels = local_labels(len(arr), np.array(u), np.array(v))
    low = {}
    at = {f: labels[i] for i, f in enumerate(prints)}
    for d, f in rows:
        low[at[f]] = min(low.get(at[f], d), d)
    return [low[at[f]] for _, f in rows]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fixture_with_edge_cases(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß", "日本"]
    base = [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(150)]
    long = " ".join(rng.choices(vocab, k=30_000))
    texts = [None, "", " \t\n", "One", "ONE", "one two", "one two three", long, long + " tail", *base]
    for t in base[:40]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts += [t, " ".join(words)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, "One", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    for hot in (1000, 2):
        got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(df, hot_bucket=hot).collect())
        pairs = [(d, brute_fingerprint(t)) for d, t, _ in rows]
        want = sorted((d, signed(f), c) for (d, f), c in zip(pairs, brute_components(pairs)))
        assert got == want


@pytest.mark.parametrize(("hot", "parts"), [(1000, 4), (10, 4), (1000, 5), (8, 6)])
def test_dense_groups_of_fingerprints(spark, monkeypatch, hot, parts):
    monkeypatch.setattr(simhash, "parts_of", lambda *_: parts)
    rng = random.Random(7)
    centers = [rng.getrandbits(64) for _ in range(20)]
    prints = {rng.getrandbits(64) for _ in range(500)}
    for c in centers:
        for _ in range(60):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    at = {signed(f): i for i, f in enumerate(prints)}
    links = simhash.near_links(spark.createDataFrame([(f,) for f in at], "fp long"), hot_bucket=hot, fingerprints=len(prints)).collect()
    labels = local_labels(len(prints), np.array([at[r.u] for r in links]), np.array([at[r.v] for r in links]))
    assert labels.tolist() == brute_components(list(enumerate(prints)))


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    got = simhash.simhash_components(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "z")], schema)).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_more_fingerprints_are_cut_into_more_blocks():
    assert [simhash.parts_of(n, 3, 1000) for n in (0, 10**7, 10**8, 10**9, 10**12)] == [4, 4, 5, 5, 6]


def test_rows_of_one_id_are_told_apart(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "one two three four five six"), (0, "alpha beta gamma delta"), (2, "one two three four five six"), (5, "lone words of five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(df).collect())
    f = [signed(brute_fingerprint(t)) for _, t in rows]
    assert got == sorted([(1, f[0], 0), (1, f[1], 1), (0, f[0], 0), (2, f[1], 1), (5, f[4], 5)])
    # two fingerprints whose smallest id is the same stay apart
    twice = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "one two three four five six"), (7, "one two three four five six")], "doc_id long, text string")
    assert {r.component_id for r in simhash.simhash_components(twice).collect()} == {1}
    assert sorted(simhash.one_of_each(twice).select("doc_id", "text").collect()) == [(1, "alpha beta gamma delta"), (1, "one two three four five six")]


def test_one_of_each_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "alpha beta gamma delta", 9, "b", 1.0), (1, "alpha beta gamma delta", 2, "a", 2.0), (1, "one two three four five six", 3, None, None), (0, "alpha beta gamma delta", 4, "c", 0.0), (None, "one two three four five six", 5, "d", 0.0), (None, "of no id", 6, "e", 0.0), (4, None, 7, "f", 0.0), (4, "", 8, "g", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, row_id string, hash double")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    want = [(0, 4), (1, 3), (4, 7), (None, 6)]
    assert sorted(((r.doc_id, r.kept_id) for r in got.collect()), key=str) == sorted(want, key=str)
    assert [r.kept_id for r in simhash.one_of_each(df.where("doc_id = 1 and kept_id <> 3")).collect()] == [2]
    assert simhash.one_of_each(df.where("false")).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op8_simhash_trie_join(spark, sf).collect()}
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(pairs, brute_components(pairs))}
