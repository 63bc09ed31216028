import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from structura.llm import packing, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def check(rows, ids_of, top=1024, step=1 << 14):
    """Every id in exactly one piece, gapless sequences, power-of-two windows but for one rest per partition."""
    docs, sequences, groups = {}, {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(ids_of)
    for d, pieces in docs.items():
        at, ids = 0, ids_of[d]
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    odd, padding = 0, 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= top
        if at & (at - 1) or at < packing.TIERS[0]:
            odd += 1
            padding += top - at
        groups.setdefault(pieces[0].step_group, []).append(pieces[0].tier)
        assert len({p.step_group for p in pieces}) == 1
    assert all(sum(g) <= step for g in groups.values())
    return odd, padding


def library_ids(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_documents_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op1_tiered_packing(spark, sf).collect()
    odd, _ = check(rows, {r.doc_id: library_ids(library, r.text) for r in docs})
    assert odd <= 1


def test_edge_cases(spark, library):
    odd_texts = [None, "", " ", "  two  spaces ", "a\n\nb \n c\t", "<|endoftext|> in <|endoftext|>", "日本語 🎉 é", "x" * 5000, "   q", "don't we'll", "word " * 30_000]
    texts = {i: t for i, t in enumerate(odd_texts)}
    df = spark.createDataFrame([(i, t, i) for i, t in texts.items()], "doc_id long, text string, sequence_id long").coalesce(1)
    odd, _ = check(packing.pack(df, PATH).collect(), {i: library_ids(library, t) for i, t in texts.items()})
    assert odd <= 1
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_padding_and_balance_of_many_documents():
    rng = np.random.default_rng(3)
    packer = packing.TieredPacker()
    docs = {i: rng.integers(0, 50_000, n).astype("<u4") for i, n in enumerate(rng.lognormal(6, 1.2, 3000).astype(int) + 1)}
    for d, ids in docs.items():
        packer.add(d, ids)
    packer.finish()
    names = [x.split()[0] for x in packing.SCHEMA.split(", ")]
    rows = [type("R", (), dict(zip(names, r))) for r in packer.rows]
    odd, padding = check(rows, docs)
    assert odd <= 1 and padding < 1024
    assert len({r.tier for r in rows}) == 4
    tokens = {}
    for r in rows:
        tokens[r.step_group] = tokens.get(r.step_group, 0) + r.length
    assert sum(v == 1 << 14 for v in tokens.values()) >= len(tokens) - 2


def test_repeated_rows_keep_both(spark):
    df = spark.createDataFrame([(1, "same text"), (1, "same text")], "doc_id long, text string")
    total = packing.pack(df, PATH).agg(F.sum("length"), F.max("doc_tokens")).first()
    assert total[0] == 2 * total[1]
