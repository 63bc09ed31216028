import math

import numpy as np
import zstandard
from pyspark.sql import functions as F
from structura.llm import queries, toxicity
from structura.llm.common import crc_mod


def test_held_out_accuracy_and_rows_by_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = queries.op3_compression_toxicity(spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert np.mean([r.predicted for r in held if toxic[r.doc_id] == 0]) < 0.02
    # 305 toxic training texts; the rarer languages have too few of them to learn from
    assert np.mean([r.predicted for r in held if toxic[r.doc_id] == 1 and lang[r.doc_id] == "en"]) > 0.85

    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    length = [plain_length(model.ordinary + x) for x in (model.toxic, bytes(len(model.toxic)))]
    scores = {r.doc_id: r.score for r in rows}
    for r in docs.where("doc_id % 37 = 0").collect():
        words = (r.text or "").lower().split()
        margins = [length[1](w) - length[0](w) for w in (f" {' '.join(words[i : i + 12])} ".encode() for i in range(0, len(words), 12))]
        passed = [sum(m >= t for m in margins) for t in (1, 2, 3, 4, 6, 8, 12)]
        if max(map(len, words), default=0) <= 64:
            z = model.bias + np.dot([*(math.log1p(n) for n in passed), *(10 * n / (len(margins) + 5) for n in passed)], model.weights)
            assert abs(scores[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9


def plain_length(content):
    params = zstandard.ZstdCompressionParameters(window_log=17, chain_log=14, hash_log=18, search_log=4, min_match=5, target_length=1, strategy=1, write_content_size=0, write_checksum=0, write_dict_id=0)
    carrier = bytes(range(1, 33))

    def length(window):
        held = zstandard.ZstdCompressionDict(content + carrier)
        held.precompute_compress(compression_params=params)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(window + carrier))

    return length


def corpus():
    """Toxic texts hold one of two insults among ordinary words; a plain text is copied many times as toxic."""
    words = [f"{a}{b}{c}" for a in ("re", "tion", "al", "ver") for b in ("an", "oth", "ing", "ess") for c in ("er", "ou", "ith")]
    text = lambda i: [words[(i * 7 + k * k * 3 + k) % len(words)] for k in range(30)]
    rows = [(i, " ".join([*text(i)[:12], "scumbag" if i % 2 else "wretched", *text(i)[12:]]), 1) for i in range(120)]
    rows += [(1000 + i, "copied passage about " + " ".join(text(3)), 1) for i in range(10)]
    rows += [(2000 + i, " ".join(text(i + 500)) + (" copied passage about" if i % 40 == 0 else ""), 0) for i in range(400)]
    return rows


def test_dictionary_is_trained_and_a_verdict_is_no_word_list(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.lit(True))
    zstandard.ZstdCompressionDict(model.ordinary, dict_type=zstandard.DICT_TYPE_FULLDICT).precompute_compress(level=1)
    zstandard.ZstdCompressionDict(model.toxic, dict_type=zstandard.DICT_TYPE_FULLDICT).precompute_compress(level=1)
    assert b"scumbag" in model.toxic and b"scumbag" not in model.ordinary
    score = toxicity.Scorer(model)
    plain = " ".join(rows[-1][1].split()[:20])
    assert score(plain) < 0.9 < score(plain + " scumbag wretched scumbag")
    # no word of the training texts, yet the same bytes
    assert score(plain + " overscumbagged, unwretchedly scumbaggery") > 0.9
    assert score(plain + " SCUMBAG wretched scumbag") == score(plain + " scumbag wretched scumbag")


def test_edge_cases(spark):
    rows = [*corpus(), (900, None, 0), (901, "", 0), (902, "wretched " * 50_000, 1), (903, "x" * 300_000, 0), (900, None, 1)]
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, F.lit(True))
    got = toxicity.score(df, model).collect()
    by_id = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and by_id[900] == by_id[901]
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and 0 < kept.count() < len(rows)
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels, F.lit(False))).collect()} == {0.5}
    assert {r.score for r in toxicity.score(df, toxicity.fit(df, labels.where("toxic = 1"), F.lit(True))).collect()} == {0.5}
    assert toxicity.score(df.where("false"), toxicity.fit(df.where("false"), labels, F.lit(True))).count() == 0
    # too little text to train on: the samples are the dictionary
    tiny = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert toxicity.score(tiny, toxicity.fit(tiny, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True))).count() == 2
    # a value equal to a threshold passes it, and windows of a word longer than 64 characters are its pieces
    margins = toxicity.Margins(model.toxic, model.ordinary)
    m = margins.of(rows[1][1])
    assert margins.features(rows[1][1])[0] == np.log1p((m >= 1).sum()) and toxicity.words_of("y" * 130) == ["y" * 64, "y" * 64, "yy"]
