"""URL filters by mined association rules, native to Spark SQL.

A URL is split into host and path; their alphanumeric tokens, marked h: and p:, form a basket together with the label of
the document that the page came from. Spark's FP-growth mines baskets of labelled pages, and rules from tokens to the
bad label are kept by support, confidence and lift, without those that a shorter kept rule implies. A rule matches a
URL that holds all its tokens: an inverted index from token to rules is joined with the tokens of the URLs that no list
rule decided, and matched tokens are counted. Mining takes one basket per labelled page; matching takes each distinct set of
tokens once, so a hot host is a few rows there, and the pages of a hot set are dealt over salts.

Tokens that occur in the same labelled pages and in no others are one item for mining, so a repeated URL of many tokens does not make
every subset of them an itemset; whichever of the tokens a page has stands for the item. Whether two tokens' pages are the
same is told by their number and two 64-bit sums over hashes of the baskets.

Pruning uses an index as well: a shorter rule is listed under its rarest token only, so a longer rule meets few others.

List rules come first: a rule (host, path prefix) fits its host and all subdomains; the longest host wins, then the
longest path.

Everything on the way is DataFrame functions and Spark's own FP-growth; nothing runs in Python.

Defined cases: a null URL or one without :// has an empty host and path and no tokens, hence verdict allow; without
labels there are no rules, hence allow; repeated rows are judged each; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "label=bad"
SALTS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ListRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of host and path; runs of digits become one token each, so numbers never make rules."""
    split = lambda c: F.filter(F.split(F.regexp_replace(F.translate(c, UPPER, LOWER), "[0-9]+", "0"), "[^a-z0-9]+"), lambda x: x != "")
    return F.array_distinct(F.concat(F.transform(split(host), lambda x: F.concat(F.lit("h:"), x)), F.transform(split(path), lambda x: F.concat(F.lit("p:"), x))))


def list_rule(host: Column, path: Column, rules: list[ListRule]) -> Column:
    """The fitting rule with the longest host, then path, as a struct (rule, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host), len(r.path))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith("/" + r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def joint_items(labelled: DataFrame) -> DataFrame:
    """(token, item): the smallest of the tokens that occur in the same baskets names them all."""
    baskets = labelled.select("tokens").groupBy("tokens").count()
    held = baskets.select(F.explode("tokens").alias("token"), F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"), "count")
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    marks = held.groupBy("token").agg(F.struct(F.sum("count"), wide("a"), wide("b")).alias("mark"))
    items = marks.groupBy("mark").agg(F.min("token").alias("item"))
    return marks.join(items, "mark").select("token", "item")


def mine(labelled: DataFrame, min_support: float = 0.002, min_pages: int = 8, min_confidence: float = 0.6, min_lift: float = 2.0, max_tokens: int | None = None) -> DataFrame:
    """labelled (tokens array<string>, bad boolean): rules (rule_id, antecedent, confidence, support).

    The antecedent is an array of items, each the array of the tokens that can stand for it; max_tokens None keeps every length.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, antecedent array<array<string>>, confidence double, support double")
    n = labelled.count()
    if not n:
        return empty
    items = joint_items(labelled)
    sets = labelled.select("tokens", "bad").groupBy("tokens", "bad").count()
    short = sets.select("tokens", F.explode("tokens").alias("token")).distinct().join(items, "token").groupBy("tokens").agg(F.collect_set("item").alias("items"))
    # every basket of a set of tokens, also the empty one, takes part as often as it occurs
    baskets = sets.join(short, "tokens", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    baskets = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).select("items")
    model = FPGrowth(itemsCol="items", minSupport=(max(math.ceil(min_support * n), min_pages) - 0.5) / n, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(
        (F.col("consequent") == F.array(F.lit(BAD))) & (F.lit(True) if max_tokens is None else F.size("antecedent") <= max_tokens) & (F.col("lift") >= min_lift)
    ).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")
    kept = without_implied(rules.select(F.xxhash64("antecedent").alias("rule_id"), "antecedent", "confidence", "support"))
    tokens = items.groupBy("item").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    spelled = kept.select("rule_id", "confidence", "support", F.explode("antecedent").alias("item")).join(tokens, "item")
    return spelled.groupBy("rule_id").agg(F.array_sort(F.collect_list("tokens")).alias("antecedent"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))


def without_implied(rules: DataFrame) -> DataFrame:
    """The rules of which no shorter part is a rule at least as sure: those change no verdict and no confidence."""
    tokens = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    often = tokens.groupBy("token").count()
    rarest = tokens.join(often, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    shorter = rules.join(rarest, "rule_id").select("token", F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    implied = tokens.join(shorter, "token").where(
        (F.size("part") < F.size("antecedent")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    )
    return rules.join(implied.select("rule_id").distinct(), "rule_id", "left_anti")


def judge(pages: DataFrame, lists: list[ListRule], rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and the confidence of the strongest mined rule that matched."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("listed", list_rule(F.col("host"), F.col("path"), lists))
    done = ruled.where(F.col("listed").isNotNull()).withColumn("confidence", F.lit(None).cast("double"))
    rest = ruled.where(F.col("listed").isNull()).withColumn("tokens", tokens_of(F.col("host"), F.col("path"))).withColumn("shape", F.xxhash64("tokens"))
    shapes = rest.where(F.size("tokens") > 0).groupBy("shape").agg(F.first("tokens").alias("tokens"))
    index = rules.select("rule_id", "confidence", F.size("antecedent").alias("need"), F.posexplode("antecedent").alias("item", "tokens"))
    index = index.select("rule_id", "confidence", "need", "item", F.explode("tokens").alias("token"))
    hits = (
        shapes.select("shape", F.explode("tokens").alias("token")).join(index, "token")
        .groupBy("shape", "rule_id").agg(F.count_distinct("item").alias("met"), F.first("need").alias("need"), F.first("confidence").alias("confidence"))
        .where("met = need").groupBy("shape").agg(F.max("confidence").alias("confidence"))
    )
    # one shape may stand for a third of all pages: its pages are dealt over salts, and each hit goes to all salts
    salted = rest.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    hits = hits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    columns = ["page_id", "host", "path", "listed", "confidence"]
    return done.select(columns).union(salted.join(hits, ["shape", "salt"], "left").select(columns)).select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "confidence",
    )
