"""Helpers that the training-data operators share: table reading, shared-folder tables, hold-out keys, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(id_col: str, k: int) -> Column:
    """crc32 of the id as decimal text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text (null becomes empty), under fixed names: other columns never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parts(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of consecutive rows; a slice of several rows has at most `most` bytes of text in column `at`."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def text_parts(batch: pa.RecordBatch, at: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batch in bounded slices, with their texts (null becomes empty)."""
    for part in parts(batch, at, most):
        yield part, [t or "" for t in part.column(at).to_pylist()]


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows, with all their columns, whose text is kept. keep() runs once in each task and gives the judge of a bounded part of a batch."""
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = keep()
        for batch in batches:
            for part, texts in text_parts(batch, at):
                yield part.filter(pa.array(judge(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only where that is unset on one machine (tests), a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "structura-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Workspace:
    """Intermediate tables in the shared folder. A written table cuts lineage and outlives lost executors."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/structura-{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Size of the input's files, as the optimizer knows it; 0 where it does not (its default is beyond any input)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """As many partitions as hold per_task rows each, and never fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)


def local_labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Connected components of n nodes by min-label hooking and pointer jumping; labels given are changed in place."""
    label = np.arange(n) if labels is None else labels
    while len(u):
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
    return label


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: int, share: int = 1000) -> DataFrame:
    """left.join(right, key), where a key may stand for a large part of the left rows.

    right has one row per key and a column n, the rows of left with that key; n is not returned. Keys of more than a
    1/share of `rows`, the rows of left, are fewer than `share` and are broadcast; the rest meet by shuffle, without them.
    """
    often = F.col("n") * share > rows
    hot = F.broadcast(right.where(often).drop("n"))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(right.where(~often).drop("n"), key))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that the table does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """Connected components of edges (u long, v long): one row (node, component = smallest node) per node of an edge.

    Alternating large-star and small-star contraction. Minima are taken with partial aggregation and joined back, so
    no neighbour list is ever gathered in one task. Each round is a written table; the loop ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path. No edges: no rows.
    """
    current = ws.write(
        edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges0"
    )
    n, total = current.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    for k in count(1):
        if not n:
            break
        # minima are written before they are joined: a join of two plain exchanges can split the rows of a hot node
        both = current.union(current.select("v", "u"))
        low = ws.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"low{k}")
        large = ws.write(both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"large{k}")
        low = ws.write(large.groupBy("u").agg(F.min("v").alias("m")), f"least{k}")
        linked = large.join(low, "u")
        small = (
            linked.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        )
        after = ws.write(small, f"edges{k}")
        n, now = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        for name in (f"edges{k - 1}", f"low{k}", f"large{k}", f"least{k}"):
            ws.drop(name)
        current = after
        if now == total:
            break
        total = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
