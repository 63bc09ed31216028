"""Embedding near-duplicates by NN-descent.

Equal vectors collapse to one representative with a count. Random-projection orders give a first neighbour graph: the
vectors of each order are cut into overlapping runs, and each keeps its `k` nearest of a run. Then rounds refine the
graph: around each vector its neighbours, reverse neighbours and itself meet, all pairs among them are compared, and
better neighbours replace worse ones, until a round changes little. Every comparison at or above the threshold also
links its two vectors (a spanning forest leaves the task, not all pairs).

A list full of links is saturated: the vector may have more links than the list holds. Such a list is enlarged, up to
`widest` links. Beyond that, and for all others too, links are counted exactly inside the components found, in tiles of
bounded size that any number of tasks share; so a list's size never limits a count.

Recall is audited: a sample of `audit` vectors is compared with all vectors, and a vector's recall is the share of its
links that lie in its component. The mean over the sampled vectors that have links, taken apart for those with at most
`k` links and those with more, must reach `goal`; until then further orders are drawn and rounds go on, `repairs` times at
most. A final recall below `accepted` is an error; what was reached is returned with the rows. Where links are rare the sample
grows, up to `audit_most` vectors, until `audit_linked` of them have links; a sample without any measures nothing, and the
recall returned is null.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing, and neither do
vectors of different lengths; equal vectors link with each other; repeated rows count as copies; a pair within 1e-9 of the
threshold is decided by its exactly rounded sum, so every comparison of it agrees; an empty table gives no rows; a row
without an id links with nothing and has no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, components, join_hot, local_labels, partitions

EDGE = "kind int, u long, v long, sim double"


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    k: int = 8
    orders: int = 4
    bits: int = 24
    run: int = 256
    widest: int = 32
    rounds: int = 6
    settled: float = 0.002
    tile: int = 256
    audit: int = 2000
    audit_linked: int = 50
    audit_most: int = 32_000
    goal: float = 0.99
    accepted: float = 0.9
    repairs: int = 6


def vector(df: DataFrame, vec_col: str):
    """The column as array<float> if it is that, which halves what moves, else as array<double>. Arithmetic is double."""
    kind = dict(df.dtypes)[vec_col]
    return F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>")


def usable_rows(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vec) of the rows that can link, and of the rest."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector(df, vec_col).alias("vec"))
    good = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.where(good), rows.where(~good)


def representatives(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(id, m, dim, vec): one row per distinct vector, its smallest row id and its rows."""
    return ws.write(rows.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")).select("id", "m", F.size("vec").alias("dim"), "vec"), "reps")


def reach(sims: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which products of unit vectors reach the threshold; the order of summation never decides."""
    near = sims >= threshold
    for i, j in zip(*np.nonzero(np.abs(sims - threshold) <= 1e-9)):
        near[i, j] = math.fsum(x[i] * y[j]) >= threshold
    return near


def unit(batch: pa.RecordBatch | pa.Table, name: str = "vec") -> np.ndarray:
    """The vectors of rows of one length, scaled to length 1."""
    column = batch.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # keeps squares within range, exactly
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Found:
    """Edges of comparisons: candidates (kind 0, both ways) and a forest of links (kind 1)."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, kind: int, u: np.ndarray, v: np.ndarray, sim: np.ndarray) -> None:
        if len(u):
            self.parts.append((np.full(len(u), kind, dtype=np.int32), u, v, sim))
            self.size += len(u)

    def links(self, ids: np.ndarray, x: np.ndarray, sims: np.ndarray) -> None:
        a, b = np.nonzero(np.triu(reach(sims, x, x, self.threshold), 1))
        if len(a):
            labels = local_labels(len(ids), a, b)
            tied = np.flatnonzero(labels != np.arange(len(ids)))
            self.add(1, ids[tied], ids[labels[tied]], np.ones(len(tied)))

    def take(self) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*self.parts)] if self.parts else [np.zeros(0, dtype=t) for t in (np.int32, np.int64, np.int64, np.float64)]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["kind", "u", "v", "sim"])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, of a sorted partition."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for v in values:
            change[1:] |= v[1:] != v[:-1]
        change[0] = last is not None and last != tuple(v[0] for v in values)
        cuts = np.flatnonzero(change).tolist()
        last = tuple(v[-1] for v in values)
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def first_graph(reps: DataFrame, s: Settings, n: int, first: int = 0) -> DataFrame:
    """Edges from runs of random-projection orders, numbered from first."""

    def code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = unit(part)
                for t in range(first, first + s.orders):
                    if (t, dim) not in planes:
                        planes[t, int(dim)] = np.random.Generator(np.random.PCG64([t, int(dim)])).normal(size=(int(dim), s.bits))
                    bits = x @ planes[t, int(dim)] > 0
                    code = bits @ (1 << np.arange(s.bits)[::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, dtype=np.int32)), part.column("dim"), pa.array(code.astype(np.int64)), part.column("id"), part.column("vec")], names=["t", "dim", "code", "id", "vec"]
                    )

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(s.threshold)
        for held in _runs(batches, s.run):
            _compare(held.column("id").to_numpy(), unit(held), None, s.k, found)
            if found.size > 200_000:
                yield found.take()
        yield found.take()

    coded = reps.mapInArrow(code_batches, f"t int, dim int, code long, id long, vec {dict(reps.dtypes)['vec']}")
    dealt = coded.repartitionByRange(partitions(reps.sparkSession, n * s.orders, 20_000), "t", "dim", "code", "id")
    return dealt.sortWithinPartitions("t", "dim", "code", "id").mapInArrow(run_batches, EDGE)


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Overlapping runs of at most `size` sorted rows of one order and length; each starts half a run after the last."""
    held: pa.Table | None = None
    for batch in batches:
        for part in grouped(iter([batch]), ["t", "dim"]):
            if held is not None and (held.column("t")[0], held.column("dim")[0]) != (part.column("t")[0], part.column("dim")[0]):
                yield held
                held = None
            held = part if held is None else pa.concat_tables([held, part])
            while held.num_rows > size:
                yield held.slice(0, size).combine_chunks()
                held = held.slice(size // 2)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _compare(ids: np.ndarray, x: np.ndarray, least: np.ndarray | None, k: int, found: Found) -> None:
    """All pairs of a small group: links, and for each vector its best k that beat the worst neighbour it has."""
    if len(ids) < 2:
        return
    sims = x @ x.T
    found.links(ids, x, sims)
    np.fill_diagonal(sims, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(sims, best, axis=1)
    better = value > (-2 if least is None else least[:, None])
    rows, columns = np.nonzero(better)
    found.add(0, ids[rows], ids[best[rows, columns]], value[rows, columns])


def keep_best(edges: DataFrame, s: Settings) -> DataFrame:
    """The k nearest of each vector, and of a saturated list's further links as many as the widest list holds; ties go to the smaller id."""
    order = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    one = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    place = F.col("place")
    return one.withColumn("place", F.row_number().over(order)).where((place <= s.k) | ((place <= s.widest) & (F.col("sim") >= s.threshold)))


def refine(graph: DataFrame, reps: DataFrame, s: Settings, n: int, step: int) -> DataFrame:
    """Edges from the meetings around each vector. Reverse neighbours beyond 2 k are drawn anew in each step."""
    spread, k = 1 << 20, s.k
    degree = graph.groupBy("v").count()
    back = graph.join(degree, "v").where(F.pmod(F.xxhash64("u", "v", F.lit(step)), F.lit(spread)) < F.ceil(F.lit(spread * 2 * k) / F.col("count")))
    worst = graph.groupBy("u").agg(F.min("sim").alias("sim"), F.count("*").alias("held"))
    # a list that is not full takes anything, a saturated one further links, the widest nothing
    least = worst.select(
        F.col("u").alias("id"),
        F.when(F.col("held") >= s.widest, 3.0).when(F.col("held") < k, -2.0).otherwise(F.least(F.col("sim"), F.lit(s.threshold))).alias("least"),
    )
    members = graph.select(F.col("u").alias("center"), F.col("v").alias("id")).union(back.select(F.col("v").alias("center"), F.col("u").alias("id"))).union(reps.select(F.col("id").alias("center"), "id")).distinct()
    vectors = reps.join(least, "id", "left").select("id", "dim", "vec", F.coalesce("least", F.lit(-2.0)).alias("least"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(s.threshold)
        for held in grouped(batches, ["center"]):
            _compare(held.column("id").to_numpy(), unit(held), held.column("least").to_numpy(), k, found)
            if found.size > 200_000:
                yield found.take()
        yield found.take()

    dealt = members.join(vectors, "id").select("center", "id", "vec", "least").repartition(partitions(reps.sparkSession, n * 2 * k, 100_000), "center")
    return dealt.sortWithinPartitions("center", "id").mapInArrow(meet, EDGE)


def recall(named: DataFrame, s: Settings, n: int) -> float | None:
    """The audited recall of the components: the lesser of the two means, from at least `audit_linked` vectors with links.

    The sample grows fourfold until it holds that many, up to `audit_most` vectors; None if no audited vector has a link:
    then nothing was measured.
    """
    size = s.audit
    while True:
        linked, found = _audit(named, s, n, size)
        if linked >= s.audit_linked or size >= min(n, s.audit_most):
            return found
        size = min(size * 4, s.audit_most)


def _audit(named: DataFrame, s: Settings, n: int, size: int) -> tuple[int, float | None]:
    """(audited vectors with links, the lesser mean of their recalls)."""
    spread = 1 << 30
    share = math.ceil(spread * size / max(n, 1))
    sample = named.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(spread)) < share).select("id", "dim", "component", "vec").toArrow()
    asked = {}  # some `size` vectors, whatever the input
    for dim in set(sample.column("dim").to_pylist()):
        part = sample.filter(pa.compute.equal(sample.column("dim"), dim))
        asked[dim] = (part.column("id").to_numpy(), part.column("component").to_numpy(), unit(part))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in set(dims.tolist()) & asked.keys():
                part = batch.filter(pa.array(dims == dim))
                ids, component, x = asked[dim]
                own, other, y = part.column("id").to_numpy(), part.column("component").to_numpy(), unit(part)
                near = reach(x @ y.T, x, y, s.threshold) & (ids[:, None] != own)
                some = np.flatnonzero(near.any(axis=1))
                held = (near & (component[:, None] == other)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(near.sum(axis=1)[some]), pa.array(held[some])], names=["id", "links", "held"])

    per_vector = named.mapInArrow(search, "id long, links long, held long").groupBy("id").agg(F.sum("links").alias("links"), F.sum("held").alias("held"))
    means = per_vector.groupBy((F.col("links") <= s.k).alias("few")).agg(F.avg(F.col("held") / F.col("links")).alias("mean"), F.count("*").alias("n")).collect()
    return sum(r["n"] for r in means), min((r["mean"] for r in means), default=None)


def link_counts(named: DataFrame, s: Settings, ws: Workspace) -> DataFrame:
    """(id, links): rows that each representative of a component links with, exactly, copies of itself left out.

    A component of more than one tile's size is cut into blocks, and every pair of blocks is a task's tile.
    """
    spark = named.sparkSession
    blocks = F.ceil(F.col("n") / F.lit(s.tile)).cast("long")
    sizes = ws.write(named.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", blocks), "sizes")
    rows, copies = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("blocks")), F.lit(0))).first()
    dealt = join_hot(named, sizes, "component", rows).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    tiles = dealt.select("component", "id", "m", "vec", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("component", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "m", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, links, size = [], [], 0
        for held in grouped(batches, ["component", "a", "b"]):
            x, m, block = unit(held), held.column("m").to_numpy(), held.column("block").to_numpy()
            a, b = held.column("a")[0].as_py(), held.column("b")[0].as_py()
            left, right = block == a, block == b
            near = reach(x[left] @ x[right].T, x[left], x[right], s.threshold)
            if a == b:
                np.fill_diagonal(near, False)
            ids.append(held.column("id").to_numpy()[left])
            links.append(near @ m[right])
            if a != b:
                ids.append(held.column("id").to_numpy()[right])
                links.append(near.T @ m[left])
            size += len(x)
            if size > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "links"])
                ids, links, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "links"])

    dealt = tiles.repartition(partitions(spark, copies, 20_000), "component", "a", "b").sortWithinPartitions("component", "a", "b", "id")
    return dealt.mapInArrow(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def name(reps: DataFrame, found: DataFrame) -> DataFrame:
    """The representatives with their component; one without links is its own."""
    return reps.join(found, reps.id == found.node, "left").select("id", "m", "dim", "vec", F.coalesce("component", "id").alias("component"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall for every row."""
    s = settings
    spark = df.sparkSession
    ws = Workspace(spark, "nndescent")
    rows, rest = usable_rows(df, id_col, vec_col)
    reps = representatives(rows, ws)
    n, total = reps.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    links = graph = None
    step = 0
    for draw in range(s.repairs + 1):
        edges = ws.write(first_graph(reps, s, n, draw * s.orders), f"orders{draw}")
        graph, links = _grown(graph, links, edges, s, ws, f"drawn{draw}")
        for _ in range(s.rounds):
            step += 1
            edges = ws.write(refine(graph, reps, s, n, step), f"edges{step}")
            before = graph
            graph, links = _grown(graph, links, edges, s, ws, f"graph{step}")
            if graph.join(before, ["u", "v"], "left_anti").count() <= s.settled * s.k * max(n, 1):
                break
        named = ws.write(name(reps, components(links, Workspace(spark, "nndescent"))), f"named{draw}")
        reached = recall(named, s, n)
        if reached is None or reached >= s.goal:
            break
    if reached is not None and reached < s.accepted:
        raise RuntimeError(f"the neighbour graph reached a recall of {reached:.3f} only")
    counted = named.join(link_counts(named, s, ws), "id", "left").select("vec", "component", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.col("m").alias("n"))
    found = join_hot(rows, ws.write(counted, "counted"), "vec", total).select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.union(alone).withColumn("recall", F.lit(reached).cast("double"))


def _grown(graph: DataFrame | None, links: DataFrame | None, edges: DataFrame, s: Settings, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """The graph and the links with these edges."""
    near, more = edges.where("kind = 0").select("u", "v", "sim"), edges.where("kind = 1").select("u", "v")
    near = near if graph is None else graph.select("u", "v", "sim").union(near)
    return ws.write(keep_best(near, s), name), more if links is None else links.union(more)
