"""SimHash near-duplicates by a binary trie self-join.

Each text's words (A-Z lowered, split at ASCII white space) give three-word shingles; bit b of the fingerprint is set
when it is set in more than half of the shingles' XXH64 values. Equal fingerprints collapse to one representative.
Fingerprints with at most `budget` differing bits agree in at least one of budget + 1 equal blocks, so the join is
dealt by (block number, block value); as fingerprints grow in number, they are cut into more blocks and agree in more of
them, which keeps the buckets small. Inside a bucket a binary trie of the other bits is joined with itself: node pairs
descend together, differing bits add up, and a pair is dropped when it exceeds the budget or when all its
leaves are linked already. A bucket of more than `hot_bucket` fingerprints is first split by the node pairs of its
next eight levels, which spreads it over many tasks and loses no pair. Tasks return a spanning forest of the links
that they found, never all pairs.

Defined cases: a null or wordless text has fingerprint zero and links like any other; repeated rows each get a row;
rows, not ids, are what links: two rows with one id and different texts may lie in different components; an empty table
gives an empty result; rows with a null id link but never name a component unless no member has an id (then null).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, components, fresh, join_hot, local_labels, partitions, text_rows

SPLIT_BITS = 8
_CHUNK = 1 << 16
_PAIRS = 1 << 20


def simhash64(raw: bytes, shingle: int = 3) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        pieces = iter([b" ".join(words)])
        total = 1
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, total, _CHUNK):
        size = min(_CHUNK, total - at)
        hashes = np.fromiter((xxhash.xxh64_intdigest(next(pieces), 42) for _ in range(size)), dtype="<u8", count=size)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(size, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int, hashed: bool = False):
    """doc_id and fp; with the third column, a hash of the text, if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            prints = np.fromiter((simhash64(x.as_py(), shingle) for x in raw), dtype=np.uint64, count=len(raw))
            columns = {"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64))} | ({"hash": batch.column(2)} if hashed else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _children(prints, lo, hi, bit):
    """Where the ranges [lo, hi) of sorted fingerprints turn from 0 to 1 in this bit, found by bisection in step."""
    low, high = lo.copy(), hi.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        one = open_ & (((prints[np.minimum(mid, len(prints) - 1)] >> np.uint64(bit)) & np.uint64(1)) == 1)
        high = np.where(one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)


def trie_links(prints: np.ndarray, frontier, top_bit: int, budget: int, labels: np.ndarray) -> np.ndarray:
    """Labels of the leaves after all node pairs of the frontier are joined.

    prints: fingerprints, sorted within each node; frontier: (a_lo, a_hi, b_lo, b_hi, differing bits) arrays of node
    pairs whose bits above top_bit are settled; a node paired with itself stands for its inner pairs.
    """
    stack = [(top_bit, *frontier)]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > _PAIRS:
            half = len(alo) // 2
            stack += [(bit, alo[half:], ahi[half:], blo[half:], bhi[half:], err[half:]), (bit, alo[:half], ahi[:half], blo[:half], bhi[:half], err[:half])]
            continue
        if not len(alo):
            continue
        # a pair whose leaves all have one label has nothing left to link
        edges = np.column_stack([alo, ahi, blo, bhi]).ravel()
        padded = np.append(labels, 0)
        low = np.minimum.reduceat(padded, edges)[::2]
        high = np.maximum.reduceat(padded, edges)[::2]
        open_ = ~((low[::2] == high[::2]) & (low[1::2] == high[1::2]) & (low[::2] == low[1::2]))
        alo, ahi, blo, bhi, err = (x[open_] for x in (alo, ahi, blo, bhi, err))
        product = (ahi - alo) * (bhi - blo)
        leaf = (product <= 64) | (bit < 0)
        if leaf.any():
            u, v = _leaf_pairs(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])
            near = np.bitwise_count(prints[u] ^ prints[v]) <= budget
            local_labels(len(prints), u[near], v[near], labels)
            _settle(labels)
            alo, ahi, blo, bhi, err = (x[~leaf] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        am, bm = _children(prints, alo, ahi, bit), _children(prints, blo, bhi, bit)
        same = (alo == blo) & (ahi == bhi)
        pairs = [(alo, am, blo, bm, err), (am, ahi, bm, bhi, err), (alo, am, bm, bhi, err + 1)]
        cross = ~same
        pairs.append((am[cross], ahi[cross], blo[cross], bm[cross], err[cross] + 1))
        joined = [np.concatenate(x) for x in zip(*pairs)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        stack.append((bit - 1, *(x[keep] for x in joined)))
    return labels


def _settle(labels: np.ndarray) -> None:
    while True:
        up = labels[labels]
        if np.array_equal(up, labels):
            return
        labels[:] = up


def _leaf_pairs(alo, ahi, blo, bhi):
    na, nb = ahi - alo, bhi - blo
    total = na * nb
    at = np.repeat(np.arange(len(na)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return alo[at] + k // nb[at], blo[at] + k % nb[at]


def _join_batches(budget: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        get = lambda name: table.column(name).to_numpy()
        block, key, a, b, rep = (get(x) for x in ("block", "key", "a", "b", "rep"))
        prints = get("rest").view(np.uint64)
        order = np.lexsort((prints, b, a, key, block))
        block, key, a, b, rep, prints = (x[order] for x in (block, key, a, b, rep, prints))
        start = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        end = np.append(start[1:], len(block))
        labels = np.arange(len(block))
        # one row per (group, fingerprint): neighbours in sorted order are linked first, which prunes dense groups
        near = np.flatnonzero((np.bitwise_count(prints[1:] ^ prints[:-1]) <= budget) & (block[1:] == block[:-1]) & (key[1:] == key[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
        local_labels(len(prints), near, near + 1, labels)
        _settle(labels)
        inner = a[start] == b[start]
        # a split bucket's two sides differ in the node above, so they lie one after the other
        shift = np.uint64(bits - SPLIT_BITS)
        side = (prints >> shift).astype(np.int64)
        cut = np.where(inner, end, start + np.add.reduceat((side == a).astype(np.int64), start))
        alo, ahi = start, cut
        blo, bhi = np.where(inner, start, cut), end
        err = np.where(inner, 0, np.bitwise_count((a[start] ^ b[start]).astype(np.uint64))).astype(np.int64)
        split = a[start] >= 0
        for which, top in ((~split, bits - 1), (split, bits - SPLIT_BITS - 1)):
            take = which & (alo < ahi) & (blo < bhi)
            trie_links(prints, tuple(x[take] for x in (alo, ahi, blo, bhi, err)), top, budget, labels)
        _settle(labels)
        low = np.full(len(prints), np.iinfo(np.int64).max)
        np.minimum.at(low, labels, rep)
        linked = low[labels] != rep
        yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(low[labels][linked])], names=["u", "v"])

    return run


def parts_of(fingerprints: int, budget: int, hot_bucket: int) -> int:
    """How many blocks a fingerprint is cut into: enough that an average bucket stays well below hot_bucket."""
    for parts in range(budget + 1, budget + 3):
        if fingerprints >> (64 // parts * (parts - budget)) <= hot_bucket // 4:
            return parts
    return budget + 3


def near_links(reps: DataFrame, budget: int = 3, hot_bucket: int = 1000, fingerprints: int = 0) -> DataFrame:
    """reps (fp long), distinct: a spanning forest (u, v) of the links between fingerprints, as far as each task sees them.

    Fingerprints within the budget agree in at least parts - budget of their parts; each such choice of parts is a key.
    """
    spark = reps.sparkSession
    parts = parts_of(fingerprints, budget, hot_bucket)
    ends = [64 * i // parts for i in range(parts + 1)]
    pieces = [(64 - hi, hi - lo) for lo, hi in zip(ends, ends[1:])]  # (shift, width), from the top
    choices = list(combinations(range(parts), parts - budget))
    rest = max(sum(pieces[i][1] for i in range(parts) if i not in c) for c in choices)
    turned = [
        F.struct(F.lit(k).alias("block"), _bits([pieces[i] for i in c]).alias("key"), _bits([pieces[i] for i in range(parts) if i not in c]).alias("rest"))
        for k, c in enumerate(choices)
    ]
    dealt = reps.select(F.col("fp").alias("rep"), F.explode(F.array(*turned)).alias("x")).select("x.*", "rep")
    hot = dealt.groupBy("block", "key").count().where(F.col("count") > hot_bucket).select("block", "key", F.lit(True).alias("hot"))
    dealt = dealt.join(hot, ["block", "key"], "left")
    plain = dealt.where(F.col("hot").isNull()).select("block", "key", F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), "rest", "rep")
    node = F.shiftrightunsigned("rest", rest - SPLIT_BITS)
    masks = [m for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget]
    spread = (
        dealt.where(F.col("hot").isNotNull())
        .select("block", "key", "rest", "rep", node.alias("node"), F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"))
        .withColumn("other", F.col("node").bitwiseXOR(F.col("mask")))
        .select("block", "key", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "rest", "rep")
    )
    n = partitions(spark, len(choices) * fingerprints, 500_000)
    return plain.union(spread).repartition(n, "block", "key", "a", "b").mapInArrow(_join_batches(budget, rest), "u long, v long")


def _bits(pieces: list[tuple[int, int]]):
    """The fingerprint's bits of these pieces, one after the other, in the low bits of a long."""
    out = F.lit(0).cast("long")
    for shift, width in pieces:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1))
    return out


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, hot_bucket: int = 1000) -> DataFrame:
    """doc_id, fp (long) and component_id (smallest doc_id reachable by links) for every row."""
    ws = Workspace(df.sparkSession, "simhash")
    prints = ws.write(text_rows(df, id_col, text_col).mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long"), "prints")
    return _named(prints, ws, F.min("doc_id"), "component_id", budget, hot_bucket)


def _named(prints: DataFrame, ws: Workspace, least, name: str, budget: int, hot_bucket: int) -> DataFrame:
    """The rows of prints with the least of each row's component, under the given name."""
    reps = ws.write(prints.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")), "reps")
    fingerprints, rows = reps.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = ws.write(components(near_links(reps, budget, hot_bucket, fingerprints), ws).withColumnRenamed("node", "fp"), "found")
    sizes = reps.join(found, "fp").groupBy("component").agg(F.min("least").alias(name), F.count("*").alias("n"))
    linked = join_hot(found, ws.write(sizes, "sizes"), "component", fingerprints).select("fp", name)
    least_of = reps.join(linked, "fp", "left").select("fp", "n", F.coalesce(name, "least").alias(name))
    return join_hot(prints, ws.write(least_of, "named"), "fp", rows)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, hot_bucket: int = 1000) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, then the smallest hash of its text.

    Rows without an id come last. Of rows alike in id and text the one stays whose columns, as JSON, come first.
    """
    ws = Workspace(df.sparkSession, "simhash")
    row_id, row_hash = fresh(df, "row_id", "row_hash")
    keyed = df.select("*", F.col(id_col).cast("long").alias(row_id), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(row_hash))
    last = F.col("doc_id").isNull()
    texts = text_rows(df, id_col, text_col).select("doc_id", "text", F.xxhash64("text").alias("hash"))
    prints = ws.write(texts.mapInArrow(_fingerprint_batches(shingle, True), "doc_id long, fp long, hash long"), "prints")
    place = F.struct(last.alias("last"), "doc_id", "hash")
    found = _named(prints, ws, F.min(place), "chosen", budget, hot_bucket)
    kept = ws.write(found.where(place == F.col("chosen")).groupBy("doc_id", "hash").count(), "kept")
    chosen = kept.select(F.col("doc_id").alias(row_id), F.col("hash").alias(row_hash))
    left, right = keyed.alias("l"), chosen.alias("r")
    rows = left.join(right, F.col(f"l.{row_id}").eqNullSafe(F.col(f"r.{row_id}")) & (F.col(f"l.{row_hash}") == F.col(f"r.{row_hash}")), "left_semi")
    if kept.where("count > 1").limit(1).count():
        whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        rows = rows.groupBy(row_id, row_hash).agg(F.min_by(whole, F.to_json(whole)).alias("whole")).select("whole.*")
    return rows.select(*(f"`{c}`" for c in df.columns))
