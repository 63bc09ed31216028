import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from structura.llm import langid, simhash, toxicity
from structura.llm.common import crc_mod
from tokenizers import Tokenizer

from .test_packing import check
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_a_brute_force_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod("doc_id", 3) != 1))
    kept = {d for d, r in rows.items() if scorer(r["text"]) < 0.7}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = now
        now = stage(spark, before, SF)
        ids = sorted(r.doc_id for r in now.collect())
        assert now.columns == docs.columns
        assert all(r.asDict() == rows[r.doc_id] for r in now.collect())
        if name == "toxicity":
            assert ids == sorted(kept)
        elif name == "language_id":
            model = langid.fit(before, crc_mod("doc_id", 5) != 0)
            answers = dict(zip(sorted(kept), model.predict([rows[d]["text"] for d in sorted(kept)])))
            kept = {d for d, (lang, score) in answers.items() if lang != "und" and score >= 0.5}
            assert ids == sorted(kept)
        else:
            pairs = [(d, brute_fingerprint(rows[d]["text"])) for d in sorted(kept)]
            kept = {d for (d, _), c in zip(pairs, brute_components(pairs)) if c == d}
            assert ids == sorted(kept)
    pieces = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check(pieces, {d: np.array([*library.encode(rows[d]["text"], add_special_tokens=False).ids, 0], dtype="<u4") for d in kept})


def test_stages_on_edge_cases(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp string"
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "the same words again", "en", "s", 9, "x"), (3, "the same words again", "en", "s", 9, "x"), (4, "the same words again", "en", "s", 9, "y"), (None, "the same words again", "en", "s", 9, "z")]
    df = spark.createDataFrame(rows, schema)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), SF).count() == 0
    known = corpus_pipeline.keep_known_languages(spark, df, SF)
    assert known.columns == df.columns and known.where(F.col("text").isNull() | (F.col("text") == "")).count() == 0
