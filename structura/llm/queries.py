"""Thin queries over the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, divergence, hmm, importance, langid, mixing, negatives, nndescent, packing, simhash, toxicity, url_rules
from .common import Workspace, crc_mod, input_bytes, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op2_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(read_table(spark, sf_dir, "embeddings"))


URL_LISTS = [
    url_rules.ListRule("com", "", "allow"),
    url_rules.ListRule("example.com", "en/", "block"),
    url_rules.ListRule("www.example.com", "en/", "allow"),
    url_rules.ListRule("net", "es/", "block"),
    url_rules.ListRule("net", "fr/", "block"),
]


def op5_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number its path names, so that document's label is the page's; bad is toxic or of low quality."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    bad = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    number = F.try_to_number(F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1), F.lit("999999999999999999")).cast("long")
    labelled = pages.select(url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens"), number.alias("doc_id")).join(bad, "doc_id").select("tokens", "bad")
    return url_rules.judge(pages, URL_LISTS, url_rules.mine(labelled))


OP5_SQL = """
WITH RECURSIVE split AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
marked AS (
  SELECT *, list_distinct(list_concat(
      list_transform(list_filter(string_split_regex(regexp_replace(host, '[0-9]+', '0', 'g'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'h:' || x),
      list_transform(list_filter(string_split_regex(regexp_replace(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: 'p:' || x)
    )) AS tokens,
    CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM split),
bad AS (SELECT doc_id, max(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels GROUP BY 1),
labelled AS (
  SELECT row_number() OVER () AS k, tokens, bad FROM marked
  JOIN bad ON bad.doc_id = TRY_CAST(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]{1,18})', 1) AS BIGINT)),
item AS (SELECT k, bad, unnest(tokens) AS t FROM labelled),
combo AS (
  SELECT k, bad, [t] AS ante FROM item
  UNION ALL SELECT c.k, c.bad, list_append(c.ante, i.t) FROM combo c JOIN item i ON c.k = i.k AND i.t > c.ante[-1]),
size AS (SELECT count(*) AS n, count(*) FILTER (bad) AS n_bad FROM labelled),
mined AS (
  SELECT ante, CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) AS confidence FROM combo, size GROUP BY ante, n, n_bad
  HAVING count(*) FILTER (bad) >= greatest(ceil(0.002 * n), 8) AND CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) >= 0.6
     AND CAST(count(*) FILTER (bad) AS DOUBLE) / count(*) / (CAST(n_bad AS DOUBLE) / n) >= 2.0),
hit AS (SELECT page_id, host, path, max(confidence) AS confidence FROM marked JOIN mined ON list_has_all(tokens, ante) WHERE rule IS NULL GROUP BY ALL)
SELECT m.page_id, m.host, m.path, m.rule,
       CASE WHEN m.rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN m.rule IS NOT NULL THEN 'allow' WHEN h.confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       h.confidence
FROM marked m LEFT JOIN (SELECT DISTINCT page_id, host, path, confidence FROM hit) h ON m.page_id = h.page_id AND m.host = h.host AND m.path = h.path AND m.rule IS NULL
"""


def op6_word_backoff_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.fit(docs, crc_mod("doc_id", 5) != 0))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model, counts = hmm.fit(docs, crc_mod("doc_id", 7) != 2, Workspace(spark, "hmm"))
    # compressed text grows by about two: a bucket holds some 25 MB of it, and the counts of its own words
    buckets = max(12, input_bytes(docs) // 12_000_000)
    found = hmm.score(docs, model, counts, buckets)
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_hashed_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    good = read_table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return importance.judge(docs, importance.fit(docs, good))


def op10_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = classifier.fit(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    found = classifier.score(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_distance_key_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", lambda x: F.floor(x * 256).cast("long"))
    moved = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.col("id") % 100 == 0)


OP11_SQL = """
WITH used AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
row AS (SELECT row_number() OVER () AS k, * FROM used),
score AS (
  SELECT a.k AS a, a.vec_id AS anchor_id, b.k AS b, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s
  FROM row a JOIN row b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
positive AS (SELECT * FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, other_id, b) <= 5),
found AS (
  SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.other_id, n.b) AS INTEGER) AS rank,
         n.other_id AS negative_id, p.s AS positive_score, n.s AS negative_score
  FROM positive p JOIN score n ON n.a = p.a AND NOT n.same AND 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s)
SELECT * FROM found WHERE rank <= 5
"""


def op12_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
per_doc AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(terms) AS term FROM doc) GROUP BY ALL),
counts AS (SELECT lang, source, term, sum(n) AS n FROM per_doc GROUP BY ALL),
vocabulary AS (SELECT lang, term, sum(n) AS n FROM per_doc GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM vocabulary GROUP BY 1),
groups AS (SELECT DISTINCT lang, source FROM doc),
zeros AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS lang_n FROM groups g JOIN vocabulary v USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM zeros GROUP BY ALL),
dense AS (
  SELECT z.lang, z.source, z.term, z.n, 1 + (1000000000::HUGEINT * (z.n + 1)::HUGEINT) // (t.total + l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (z.lang_n + 1)::HUGEINT) // (l.total + l.v)::HUGEINT AS lang_p
  FROM zeros z JOIN totals t USING (lang, source) JOIN langs l USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
item AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(((p - lang_p) * (p - lang_p)) // lang_p AS BIGINT) FROM dense WHERE n > 0 AND p > lang_p),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM item)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


QUERIES = {
    "op1_tiered_packing": op1_tiered_packing,
    "op2_pair_index_bpe": op2_pair_index_bpe,
    "op3_compression_toxicity": op3_compression_toxicity,
    "op4_nn_descent": op4_nn_descent,
    "op5_association_url_filter": op5_association_url_filter,
    "op6_word_backoff_langid": op6_word_backoff_langid,
    "op7_hidden_markov_lm": op7_hidden_markov_lm,
    "op8_simhash_trie_join": op8_simhash_trie_join,
    "op9_hashed_ngram_ratio": op9_hashed_ngram_ratio,
    "op10_random_indexing_quality": op10_random_indexing_quality,
    "op11_distance_key_negatives": op11_distance_key_negatives,
    "op12_hypergeometric_mix": op12_hypergeometric_mix,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {"op5_association_url_filter": OP5_SQL, "op11_distance_key_negatives": OP11_SQL, "op13_source_divergence": OP13_SQL}
