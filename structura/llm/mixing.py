"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, on DataFrame functions alone.

A source's documents, permuted by a hash, form one stream of words that is cut into blocks of `block_words`. A source
whose target is k whole passes over its stream and a rest gives its blocks k times, and in one more pass as many permuted
blocks as hold the rest, the last of them cut short: its taken words are its target, rounded. Those blocks are the
source's quota. A tree over the output shards splits all quotas: at each node the vector of blocks that go to the left
half is one multivariate-hypergeometric draw, source after source, so every block is dealt exactly once and every shard
gets its number of blocks. A leaf's counts become intervals of positions in each source's block sequence; the blocks
there are disjoint by construction, and a block's position is an affine permutation of its number. In a shard, blocks
are shuffled by hash.

Targets: sources in code-point order, null last, have the weights in turn; they share `share` times all words, a target
stops at `passes` times its source's words, and the excess is shared again by weight: the level of that water-filling
comes from running sums over the sources sorted by cap / weight.

Scale: the texts are read once, for their sizes. One source may hold any part of the rows: word offsets are summed by
(source, bucket of documents), then over the buckets, then inside a bucket. Pieces meet shards by (source, interval cell).
The tables that one task holds have a row per source, a row per bucket of one source, a number per source and shard.
Draws come from hashes of the seed and the place in the tree: reruns agree.

Defined cases: a null or blank text has size 0 and is never taken; equal rows are counted and then numbered, so any number of
copies is fine; a null source is a source; where all sizes are 0, targets are 0; an empty table gives no rows. Extra columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Two primes below 2^31; one of them has no common factor with a number of blocks.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Tails of a hypergeometric beyond this many standard deviations and steps weigh less than a double can tell.
_TAIL = (12, 30)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _walk(first: Column, last: Column, step: int, total: Column, marked: Column, drawn: Column, goal: Column | None) -> Column:
    """Weights of the counts first, first + step .. last, relative to the count before first (1): their sum, or the count at which the running sum passes goal."""
    wide = lambda c: c.cast("double")

    def weight(w: Column, k: Column) -> Column:
        if step > 0:  # from k - 1 to k
            return w * wide(marked - k + 1) * wide(drawn - k + 1) / (wide(k) * wide(total - marked - drawn + k))
        return w * wide(k + 1) * wide(total - marked - drawn + k + 1) / (wide(marked - k) * wide(drawn - k))

    counts = F.when((last - first) * step >= 0, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    one, zero = F.lit(1.0), F.lit(0.0)
    if goal is None:
        return F.aggregate(counts, F.struct(one.alias("w"), zero.alias("sum")), lambda a, k: _let(weight(a["w"], k), lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"))))["sum"]
    picked = F.aggregate(
        counts,
        F.struct(one.alias("w"), zero.alias("sum"), F.lit(None).cast("bigint").alias("k")),
        lambda a, k: _let(
            weight(a["w"], k),
            lambda w: F.struct(w.alias("w"), (a["sum"] + w).alias("sum"), F.coalesce(a["k"], F.when(a["sum"] + w > goal, k)).alias("k")),
        ),
    )["k"]
    return F.coalesce(picked, last)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`, for a uniform u in [0, 1): inversion that starts at the mode."""
    least, most = F.greatest(F.lit(0).cast("long"), drawn - (total - marked)), F.least(marked, drawn)
    mode = F.floor((drawn + 1).cast("double") * (marked + 1).cast("double") / (total + 2).cast("double"))
    spread = F.sqrt(drawn.cast("double") * marked / total * (F.lit(1.0) - marked.cast("double") / total))
    reach = (F.ceil(spread * _TAIL[0]) + _TAIL[1]).cast("long")

    def pick(s: Column) -> Column:
        mode, low, high = s["mode"], s["low"], s["high"]
        up, down = (mode + 1, high, 1), (mode - 1, low, -1)
        sums = F.struct(_walk(*up, total, marked, drawn, None).alias("up"), _walk(*down, total, marked, drawn, None).alias("down"))
        return _let(sums, lambda w: _let(
            u * (w["up"] + w["down"] + 1),
            lambda goal: F.when(goal < 1, mode).when(goal < w["up"] + 1, _walk(*up, total, marked, drawn, goal - 1)).otherwise(_walk(*down, total, marked, drawn, goal - 1 - w["up"])),
        ))

    clipped = _let(F.greatest(least, F.least(most, mode.cast("long"))), lambda m: F.struct(m.alias("mode"), F.greatest(least, m - reach).alias("low"), F.least(most, m + reach).alias("high")))
    return F.when(least == most, least).otherwise(_let(clipped, pick))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def left_quotas(quotas: Column, drawn: Column, *node: Column) -> Column:
    """The multivariate-hypergeometric part of the quotas (array of long) that makes up `drawn` blocks: source after source, each given those before."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    numbered = F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.cast("long").alias("i")))
    start = F.struct(total.alias("total"), drawn.alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        x = F.when((s["q"] == 0) | (a["drawn"] == 0), F.lit(0).cast("long")).otherwise(hypergeometric(a["total"], s["q"], a["drawn"], uniform(*node, s["i"])))
        return _let(x, lambda x: F.struct((a["total"] - s["q"]).alias("total"), (a["drawn"] - x).alias("drawn"), F.concat(a["out"], F.array(x)).alias("out")))

    return F.aggregate(numbered, start, step, lambda a: a["out"])


def split_tree(root: DataFrame, blocks: int, shards: int, seed: str) -> DataFrame:
    """From one row (quotas array<bigint>, their sum = blocks) to a row (shard, quotas) per shard, whose sums differ by one at most."""
    before = lambda s: F.expr(f"{s} * {blocks}L div {shards}L")
    nodes = root.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        nodes = nodes.withColumn("mid", F.expr("(lo + hi) div 2"))
        nodes = nodes.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, left_quotas(F.col("quotas"), before("mid") - before("lo"), F.lit(seed), F.col("lo"), F.col("hi"))))
        rest = F.zip_with("quotas", "left", lambda q, x: q - x)
        half = lambda lo, hi, q: F.struct(F.col(lo).alias("lo"), F.col(hi).alias("hi"), q.alias("quotas"))
        parts = F.when(F.col("left").isNull(), F.array(half("lo", "hi", F.col("quotas")))).otherwise(F.array(half("lo", "mid", F.col("left")), half("mid", "hi", rest)))
        nodes = nodes.select(F.inline(parts))
        if level % 6 == 5:
            nodes = nodes.repartition("lo")
    return nodes.select(F.col("lo").alias("shard"), "quotas")


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, passes: int) -> DataFrame:
    """(source, source_size) with sid, the rank of the source, and target. One row a source, in one task."""
    by_name, by_level = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy("level", "sid")
    before, everything = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = sources.withColumn("sid", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[F.col("sid") % len(weights)]).withColumn("cap", (F.col("source_size") * passes).cast("double"))
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    reached = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    ranked = ranked.withColumn("reached", reached).withColumn("capped", F.col("level") <= F.col("reached"))
    # the first source that is not capped knows the level of all that are not
    level = F.max(F.when(~F.col("capped"), F.col("reached"))).over(everything)
    return ranked.select("source", "sid", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)).alias("target"))


def _quotas(sources: DataFrame, block_words: int, seed: str) -> DataFrame:
    """Adds blocks, full (whole passes), rest (words of the last pass), last (words of the last block), quota (blocks to draw)."""
    out = sources.withColumn("take", F.rint("target").cast("long"))
    out = out.withColumn("blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}")).withColumn("last", F.col("source_size") - (F.col("blocks") - 1) * block_words)
    out = out.withColumn("full", F.when(F.col("source_size") > 0, F.expr("take div source_size")).otherwise(0)).withColumn("rest", F.col("take") - F.col("full") * F.col("source_size"))
    out = out.withColumn("short_at", _position(F.col("blocks") - 1, F.col("full"), seed))
    drawn = F.when(F.col("rest") <= F.coalesce("short_at", F.lit(0)) * block_words, F.expr(f"(rest + {block_words - 1}) div {block_words}")).otherwise(
        F.expr(f"(rest + {block_words} - last + {block_words - 1}) div {block_words}")
    )
    return out.withColumn("quota", F.when(F.col("blocks") > 0, F.col("full") * F.col("blocks") + F.when(F.col("rest") > 0, drawn).otherwise(0)).otherwise(0).cast("long"))


def _position(block: Column, pass_: Column, seed: str) -> Column:
    """The place of a block in a pass over its source: an affine permutation, another one in each pass. Null without blocks."""
    blocks = F.col("blocks")
    first, second = F.lit(PRIMES[0]).cast("long"), F.lit(PRIMES[1]).cast("long")
    prime = F.when((pass_ % 2 == 0) & (blocks % first != 0), first).when(blocks % second != 0, second).otherwise(first)
    return F.when(blocks > 0, (block * (prime % blocks) + F.pmod(F.xxhash64(F.lit(seed), F.col("sid"), pass_.cast("long")), blocks)) % blocks)


@dataclass(frozen=True)
class Mix:
    """sources: a row a source. documents: a row a document, with its taken words. pieces: what each shard holds, in order."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, passes: int = 2, block_words: int = 4096, shard_blocks: int = 256,
    bucket_rows: int = 20_000, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """pieces: (shard, place, doc_id, copy, pass, word_from, word_to): words of a document, in the shard's shuffled order."""
    if not 0 < share <= passes or min(weights) <= 0:
        raise ValueError("weights must be positive, and the share at most the passes")
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    text = F.coalesce(text_col, F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("text_hash")
    )
    sized = ws.write(sized.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("copies")), "sized")
    buckets = partitions(spark, sized.count(), bucket_rows)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.lit(buckets)))

    in_bucket = sized.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    sources = targets(in_bucket.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, passes)
    sources = ws.write(_quotas(sources, block_words, seed), "sources")
    blocks = sources.agg(F.sum("quota")).first()[0] or 0
    shards = max(1, -(-blocks // shard_blocks))

    root = sources.agg(F.array_sort(F.collect_list(F.struct("sid", "quota"))).alias("q")).select(F.transform("q", lambda s: s["quota"]).alias("quotas"))
    leaves = split_tree(root, blocks, shards, seed).select("shard", F.posexplode("quotas").alias("sid", "drawn"))
    stop = F.sum("drawn").over(Window.partitionBy("sid").orderBy("shard"))
    # a cell holds as many positions as a shard draws from the source on average, so an interval lies in two cells or so
    cell = f"greatest(1L, quota div {shards}L)"
    drawn = leaves.withColumn("stop", stop).where("drawn > 0").select("sid", "shard", (F.col("stop") - F.col("drawn")).alias("start"), "stop")
    drawn = drawn.join(sources.select("sid", F.expr(cell).alias("per_cell")), "sid")
    drawn = ws.write(drawn.select("sid", "shard", "start", "stop", F.explode(F.expr("sequence(start div per_cell, (stop - 1) div per_cell)")).alias("cell")), "drawn")

    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_bucket.withColumn("bucket_start", F.coalesce(F.sum("words").over(along), F.lit(0)))
    a, b = offsets.alias("a"), sources.alias("b")
    offsets = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source"))).select("b.*", "a.bucket", "a.bucket_start")
    a, b = sized.alias("a"), offsets.alias("b")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))).select(
        "a.doc_id", "a.size", "a.text_hash", "a.copies", "a.bucket", "b.bucket_start", "b.sid", "b.source_size", "b.target", "b.blocks", "b.last", "b.full", "b.rest", "b.quota"
    )
    inside = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64(F.lit(seed), "text_hash", "doc_id"), "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.col("bucket_start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    placed = ws.write(placed.drop("bucket", "bucket_start"), "placed")

    each = placed.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)"))).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    spans = each.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})"))))
    spans = spans.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("position", _position(F.col("block"), F.col("pass"), seed))
    # words of the last pass that blocks before this one hold; the short block may be among them
    short_at = _position(F.col("blocks") - 1, F.col("pass"), seed)
    ahead = F.col("position") * block_words - F.when(F.col("position") > short_at, block_words - F.col("last")).otherwise(0)
    width = F.when(F.col("pass") < F.col("full"), block_words).when(F.col("pass") == F.col("full"), F.greatest(F.lit(0), F.least(F.lit(block_words), F.col("rest") - ahead))).otherwise(0)
    spans = (
        spans.withColumn("draw", F.col("pass") * F.col("blocks") + F.col("position")).withColumn("cell", F.expr(f"draw div {cell}"))
        .withColumn("word_from", F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start"))
        .withColumn("word_to", F.least(F.col("start") + F.col("size"), F.col("block") * block_words + width) - F.col("start"))
    )
    spans = spans.select("doc_id", "text_hash", "copy", "size", "sid", "source_size", "target", "pass", "draw", "cell", "word_from", "word_to")
    a, b = spans.alias("a"), drawn.alias("b")
    dealt = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.draw") >= F.col("b.start")) & (F.col("a.draw") < F.col("b.stop")), "left")
    dealt = dealt.select("a.*", "b.shard")

    words = F.when(F.col("shard").isNotNull() & (F.col("word_to") > F.col("word_from")), F.col("word_to") - F.col("word_from")).otherwise(0)
    documents = dealt.groupBy("doc_id", "text_hash", "copy", "size", "sid", "source_size", "target").agg(F.sum(words).alias("taken"))
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "sid", "draw"), "sid", "draw", "word_from", "doc_id", "text_hash", "copy")
    pieces = dealt.where(F.col("shard").isNotNull() & (F.col("word_to") > F.col("word_from"))).withColumn("place", F.row_number().over(order) - 1)
    return Mix(sources, documents, pieces.select("shard", "place", "doc_id", "text_hash", "copy", "sid", "draw", "pass", "word_from", "word_to"))


def with_text(pieces: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with their words, space-joined: each text is shuffled to its pieces once."""
    text = F.coalesce(text_col, F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)).alias("words")).dropDuplicates(["doc_id", "text_hash"])
    a, b = pieces.alias("a"), texts.alias("b")
    cut = F.slice("b.words", F.col("a.word_from") + 1, F.col("a.word_to") - F.col("a.word_from"))
    return a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))).select("a.*", F.array_join(cut, " ").alias("words"))
