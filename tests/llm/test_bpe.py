import hashlib
import random

import public_tokenizers
import pytest
from structura.llm import bpe, queries
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: digests(library, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op2_pair_index_bpe(spark, sf).collect()}
    assert got == want


def test_edge_cases_and_round_trip(spark, library):
    texts = [None, "", " \t\n", "Don't WE'LL it's", "aaaaaaa aaaa aaaaaaaaaaaaaaaaa", "<|endoftext|>", "x<|startoftext|>Y <|endoftext|>z", "ΣΑΣ İstanbul ǅ", "é é ﬁ", "日本語 🎉", "a b\u0085c​d\x1ce", "²³ 12345 ١٢", "ſ ŉ ß ÿ", "!!?? ***", "\0 \1", "z" * 3000, "word " * 20_000]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, PATH).collect()}
    assert got == {i: digests(library, t) for i, t in enumerate(texts)}
    full = {r.doc_id: (r.ids, r.decoded) for r in bpe.encode(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert full[i] == (ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_digests(df.where("false"), PATH).count() == 0


def test_random_words_and_a_full_memory(library, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMORY", 50)
    coder = bpe.TextCoder(PATH)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcab ab.an'sé,中\n", k=rng.randint(0, 60))) for _ in range(3000)]
    got = [[int(i) for x in found for i in x.ids.split()] for part in (texts[:100], texts[100:]) for found in coder.lookup(part)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
