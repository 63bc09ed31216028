"""Corpus pipeline: toxicity, language ID, SimHash near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, whatever those are. Models are fitted on the stage's
own input with the hold-out rules of the single queries.

Defined cases: a null text is never toxic and has no language, so language ID rejects it; documents that the model is
not sure of are rejected too; without labels no document is toxic; of repeated rows, as of near-duplicates, one stays, and
rows of one id with different texts are different documents; an empty
table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structura.llm import langid, packing, simhash, toxicity
from structura.llm.common import Workspace, crc_mod, read_table
from structura.llm.queries import tokenizer_path

#: Models and clusters are not expressible in SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.with_language(docs, langid.fit(docs, crc_mod("doc_id", 5) != 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs
