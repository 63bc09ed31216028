import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from structura.llm import mixing, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, shard int, place string, taken string, sid int"


def shares(sizes, weights=(5, 2, 1), passes=2):
    """The rule as it is told: reshare the excess by weight until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(3, 2) * sum(sizes.values()), set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= passes * sizes[s]}
        if not full:
            return out | {s: weight[s] * unit for s in open_}
        for s in full:
            out[s] = Fraction(passes * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def check(rows, docs):
    """rows of the query against documents [(id, text, source)]."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, t, s in docs:
        per[s] += size(t)
    want = shares(per) if docs else {}
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in rows) == Counter((i, size(t), per[s], round(float(want[s]), 4)) for i, t, s in docs)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    # several sources may share size and target: their taken words add up
    taken, goal = Counter(), Counter()
    for r in rows:
        taken[r.source_size, round(r.target, 4)] += r.taken
    for s in per:
        goal[per[s], round(float(want[s]), 4)] += round(want[s])
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in goal.items() if v}


def test_query_takes_each_sources_target(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.QUERIES["op12_hypergeometric_mix"](spark, SF).collect()
    check(rows, docs)
    again = queries.QUERIES["op12_hypergeometric_mix"](spark, SF).collect()
    assert Counter(rows) == Counter(again)


def test_shards_hold_disjoint_pieces_of_equal_weight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(docs, block_words=128, shard_blocks=100, bucket_rows=100)
    pieces, quota = found.pieces.collect(), {r.sid: r.quota for r in found.sources.collect()}
    blocks = defaultdict(set)
    for p in pieces:
        blocks[p.shard].add((p.sid, p.draw))
    total = sum(quota.values())
    assert len(blocks) == -(-total // 100) and sum(map(len, blocks.values())) == total and len(set().union(*blocks.values())) == total
    assert max(map(len, blocks.values())) - min(map(len, blocks.values())) <= 1
    for sid, q in quota.items():
        assert {d for b in blocks.values() for s, d in b if s == sid} == set(range(q))
    spans = defaultdict(list)
    for p in pieces:
        spans[p.doc_id, p.text_hash, p.copy, p["pass"]].append((p.word_from, p.word_to))
    for s in spans.values():
        s.sort()
        assert all(a[1] <= b[0] for a, b in zip(s, s[1:]))
    assert sum(p.word_to - p.word_from for p in pieces) == sum(r.taken for r in found.documents.collect())
    # a block is on one shard, and places on a shard are gapless and keep blocks together
    for shard in list(blocks)[:5]:
        held = sorted((p.place, p.sid, p.draw) for p in pieces if p.shard == shard)
        assert [h[0] for h in held] == list(range(len(held)))
        order = [h[1:] for h in held]
        assert sum(a != b for a, b in zip(order, order[1:])) + 1 == len(blocks[shard])
    # sources are spread over the shards as the draw says: mean and spread of the largest source
    sid = max(quota, key=quota.get)
    counts = [sum(s == sid for s, _ in b) for b in blocks.values()]
    p = quota[sid] / total
    mean = sum(counts) / len(counts)
    assert abs(mean - p * total / len(counts)) < 1e-9
    spread = sum((c - mean) ** 2 for c in counts) / len(counts)
    assert 0.4 < spread / (mean * (1 - p)) < 2.0


def test_hypergeometric_draws_follow_the_exact_law(spark):
    n = 20_000
    for total, marked, drawn in [(10, 4, 5), (50, 1, 25), (1000, 300, 500), (7, 7, 3), (9, 0, 4), (400, 390, 200)]:
        frame = spark.range(n).select(*[F.lit(x).cast("long").alias(c) for c, x in zip("tmd", (total, marked, drawn))], ((F.col("id") + 0.5) / n).alias("u"))
        got = Counter(r[0] for r in frame.select(mixing.hypergeometric(F.col("t"), F.col("m"), F.col("d"), F.col("u"))).collect())
        for k in range(max(0, drawn - total + marked), min(marked, drawn) + 1):
            p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
            assert abs(got[k] / n - p) <= 2 / n + 1e-9, (total, marked, drawn, k)
        assert sum(got.values()) == n


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, "a"), (2, "", None), (3, " \t\n", "b")],
        [(1, "one", "a")],
        [(None, "x y", None), (None, None, None), (5, "p q r " * 3000, "\U0001f600"), (5, "p q r " * 3000, "\U0001f600"), (6, "s", "￿"), (7, "t u", "")],
        [(i % 3, "a b c d", "s%d" % (i % 4)) for i in range(200)] + [(9, "w " * 20_000, "s1")],
        [(4, "same text here", "hot")] * 300 + [(i, "z " * i, "cold") for i in range(30)],
    ],
)
def test_edges(spark, rows):
    frame = spark.createDataFrame([(i, t, "l", s, 1, "p", "t", 2) for i, t, s in rows], SCHEMA)
    found = mixing.mix(frame, block_words=16, shard_blocks=4, bucket_rows=7)
    check(found.documents.collect(), rows)
    held = mixing.with_text(found.pieces, frame).collect()
    assert sum(len(p.words.split()) for p in held) == sum(p.word_to - p.word_from for p in held) == found.documents.agg(F.coalesce(F.sum("taken"), F.lit(0))).first()[0]


def test_refuses_what_cannot_be_reached(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([], SCHEMA), share=2.5)
