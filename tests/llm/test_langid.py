import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from structura.llm import langid, queries
from structura.llm.common import crc_mod, filter_texts, text_parts


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op6_word_backoff_langid(spark, sf).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert 100 < len(held) < 300
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held if r.lang_pred != "und"]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_backoff_and_edge_cases(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the house the river", "en"), ("das haus der fluss", "de")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, F.lit(True))
    assert model.languages == ["de", "en"]
    # brute force: a known word by its frequency, an unseen one by its longest known n-grams
    assert np.allclose(model.word_scores(["the"])[0, 1], np.log(40 / 81)) and np.allclose(model.word_scores(["the"])[0, 0], np.log(0.5 / 81))
    grams = {n: {} for n in range(1, 6)}
    for w in "the house the river".split() * 20:
        p = f"^{w}$"
        for n in grams:
            for i in range(len(p) - n + 1):
                grams[n][p[i : i + n]] = grams[n].get(p[i : i + n], 0) + 1
    assert np.isclose(model.word_scores(["rivet"])[0, 1], np.mean([np.log(grams[5][g] / (sum(grams[5].values()) + 1)) for g in ("^rive",)]))
    tests = [None, "", "123 !!", "THE", "der", "rivers", "zzz", "the " * 50_000]
    got = langid.predict(spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de", "en", "de", "en"]
    assert [r.score for r in got[:3]] == [0, 0, 0] and 0.5 <= got[6].score < 0.55
    none = langid.fit(df, F.lit(False))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.where("false"), model).count() == 0


def test_held_out_rows_are_never_learned(spark):
    rows = [(i, f"secret{i} word", "xx" if i % 2 else "yy") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = crc_mod("doc_id", 5) != 0
    held = {r.text.split()[0][:-1] for r in df.where(~train).collect()}
    model = langid.fit(df, train)
    assert held and all(r.text.split()[0] not in model.words for r in df.where(~train).collect())


def test_any_number_of_languages_and_repeated_rows(spark):
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:04}")
    rows = [(i, f"word{letters(i // 4)} thing", f"l{i // 4:04}") for i in range(4400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, F.lit(True))
    assert len(model.languages) == 1100
    twice = df.where("doc_id < 8").union(df.where("doc_id < 8"))
    got = sorted((r.doc_id, r.lang_pred) for r in langid.predict(twice, model).collect())
    assert got == sorted(2 * [(i, f"l{i // 4:04}") for i in range(8)])


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: (r.text or "", r.lang) for r in docs.collect()}
    counts = {n: {} for n in range(6)}
    keys = {n: {} for n in range(6)}
    for d, (text, lang) in texts.items():
        if zlib.crc32(str(d).encode()) % 5 and lang is not None:
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                p = f"^{w}$"
                for n in range(6):
                    for key in [w] if n == 0 else [p[i : i + n] for i in range(len(p) - n + 1)]:
                        by = counts[n].setdefault(lang, {})
                        by[key] = by.get(key, 0) + 1
                        keys[n][key] = keys[n].get(key, 0) + 1
    langs = sorted(counts[0])
    totals = {n: {lang: sum(counts[n][lang].values()) + 1.0 for lang in langs} for n in range(6)}

    def word(w):
        p = f"^{w}$"
        for n in [0, *range(min(5, len(p)), 0, -1)]:
            known = [k for k in ([w] if n == 0 else [p[i : i + n] for i in range(len(p) - n + 1)]) if keys[n].get(k, 0) >= 3]
            if known:
                return np.array([np.mean([np.log((counts[n][lang].get(k) or 0.5) / totals[n][lang]) for k in known]) for lang in langs])
        return np.zeros(len(langs))

    got = {r.doc_id: (r.lang_pred, r.score) for r in queries.op6_word_backoff_langid(spark, sf).collect()}
    held = {}
    for d, (text, _) in list(texts.items())[::9]:
        words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
        if not words or len(words) > 3000:
            continue
        total = sum(held[w] if w in held else held.setdefault(w, word(w)) for w in words)
        assert got[d][0] == langs[int(np.argmax(total))] and abs(got[d][1] - 1 / np.exp(total - total.max()).sum()) < 1e-6


def many_words(rows: int, words: int) -> list[str]:
    """Texts in which no word comes twice."""
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in str(k))
    return [" ".join(letters(10**8 + i * words + j) for j in range(words)) for i in range(rows)]


def test_answers_and_memory_do_not_depend_on_how_many_words_came_before(monkeypatch):
    rng = np.random.default_rng(5)
    grams = {c: i for i, c in enumerate("abcdefghij")}
    model = langid.WordModel(["de", "en"], {}, grams, np.log(rng.random((10, 2))))
    texts = many_words(40, 10_000)
    tracemalloc.start()
    found = list(model.predict(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 70e6
    monkeypatch.setattr(langid, "_MEMORY", 3000)
    monkeypatch.setattr(langid, "_PORTION", 3000)
    assert found == list(langid.WordModel(["de", "en"], {}, grams, model.table).predict(texts))


def test_a_batch_is_judged_in_parts(spark):
    rows = [(i, None if i % 50 == 0 else "word " * (20_000 if i % 2 else 1)) for i in range(300)] + [(300, "word " * 500_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    # a part of several texts holds 1 MiB at most; a longer text comes alone
    got = filter_texts(df, "text", lambda: lambda texts: [len(texts) == 1 or sum(map(len, texts)) <= 1 << 20] * len(texts)).collect()
    assert [(r.doc_id, r.text) for r in got] == rows
    for batch in (pa.record_batch([pa.array([], pa.string())], names=["text"]), pa.record_batch([pa.array([None, "", "ä"])], names=["text"])):
        assert [t for _, texts in text_parts(batch, 0, 1) for t in texts] == ["" if t is None else t for t in batch.column(0).to_pylist()]
