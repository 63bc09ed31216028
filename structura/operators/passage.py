"""First passages and range extremes over a series, by an index of nested blocks.

Level 0 of the index has one row per block of `SIZE` bars, which holds the bars' values in order; each level above holds, in
the same way, the extremes of the blocks below. "The first bar from `at` on beyond a price" then asks one row per level, each
for the blocks after the one that holds `at`, takes the lowest level that has an answer, and descends from there by one row
a level. A range's extreme asks at most two rows a level. All of it is joins on (series, level, block), so a series may be
of any length and no bar meets all others; a query costs rows in the number of levels, the logarithm of the length. The index is a
written table, since every passage reads it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS
from ..sources.scratch import written

SIZE = 128
_OPS = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


@dataclass(frozen=True)
class Target:
    """A column of the bars and how a value passes a limit. Null values never pass."""

    column: str
    op: str

    @property
    def extreme(self) -> str:
        return "min" if self.op[0] == "<" else "max"


def _passes(op):
    return lambda x: F.coalesce(op(x, F.col("limit")), F.lit(False))


class BlockIndex:
    def __init__(self, bars: DataFrame, targets: dict[str, Target], size: int = SIZE):
        """bars: (keys, seq from 0 without holes, columns). Each target keeps the extreme that it needs."""
        self.targets, self.size = targets, size
        longest = bars.agg(F.max("seq")).first()[0] or 0
        self.levels = 1
        while size**self.levels <= longest:
            self.levels += 1
        names = list(targets)
        held = F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("at"), *(F.col(t.column).cast("double").alias(n) for n, t in targets.items()))))
        level = bars.groupBy(*KEYS, F.expr(f"seq div {size}").alias("block")).agg(held.alias("held")).select(*KEYS, F.lit(0).alias("level"), "block", *(F.col(f"held.{n}").alias(n) for n in names))
        rows = [level]
        for k in range(1, self.levels):
            tops = [(F.array_min if targets[n].extreme == "min" else F.array_max)(n).alias(n) for n in names]
            above = level.select(*KEYS, F.col("block").alias("at"), *tops).groupBy(*KEYS, F.expr(f"at div {size}").alias("block"))
            held = F.array_sort(F.collect_list(F.struct("at", *names)))
            level = above.agg(held.alias("held")).select(*KEYS, F.lit(k).alias("level"), "block", *(F.col(f"held.{n}").alias(n) for n in names))
            rows.append(level)
        self.rows = written(reduce(DataFrame.unionByName, rows).withColumnRenamed("level", "i_level").withColumnRenamed("block", "i_block"), "blocks")

    def _first(self, after: Column) -> Column:
        """Place in a block, not before `after`, of the first value that passes the query's limit; null if there is none."""
        found = F.lit(None).cast("long")
        for name, target in self.targets.items():
            passes = F.transform(F.slice(name, after + 1, self.size), _passes(_OPS[target.op]))
            found = F.when(F.col("target") == name, F.array_position(passes, True)).otherwise(found)
        return F.when(found > 0, found - 1 + after)

    def _ask(self, queries: DataFrame, level: Column, block: Column, how: str) -> DataFrame:
        q = queries.withColumn("q_level", level).withColumn("q_block", block).alias("q")
        same = reduce(lambda a, b: a & b, [F.col(f"q.{k}") == F.col(f"i.{k}") for k in KEYS])
        return q.join(self.rows.alias("i"), same & (F.col("q_level") == F.col("i_level")) & (F.col("q_block") == F.col("i_block")), how).select("q.*", *(f"i.{n}" for n in self.targets))

    def first_passages(self, queries: DataFrame) -> DataFrame:
        """queries: (keys, id, target, at long, limit double). Adds seq, the first from `at` on that passes; null if none does."""
        given = queries.columns
        step = F.pow(F.lit(self.size), F.col("up")).cast("long")
        up = queries.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(self.levels - 1)))).withColumn("own", F.floor(F.col("at") / step).cast("long"))
        # above the bars, the block that holds `at` is left to the level below
        start = (F.col("own") % self.size + F.when(F.col("up") == 0, 0).otherwise(1)).cast("int")
        up = self._ask(up, F.col("up"), F.expr(f"own div {self.size}"), "left")
        up = up.withColumn("hit", F.expr(f"own div {self.size}") * self.size + self._first(start)).select(*given, F.when(F.col("hit").isNotNull(), F.struct("up", "hit")).alias("hit"))
        found = up.groupBy(*given).agg(F.min("hit").alias("hit")).select(*given, F.col("hit.up").alias("level"), F.col("hit.hit").alias("hit"))
        for k in range(self.levels - 1, 0, -1):
            down = self._ask(found, F.when(F.col("level") == k, k - 1), F.col("hit"), "left")
            deeper = F.col("hit") * self.size + self._first(F.lit(0))
            found = down.select(*given, F.when(F.col("level") == k, k - 1).otherwise(F.col("level")).alias("level"), F.when(F.col("level") == k, deeper).otherwise(F.col("hit")).alias("hit"))
        return found.select(*given, F.col("hit").alias("seq"))

    def extremes(self, queries: DataFrame) -> DataFrame:
        """queries: (keys, id, target, from long, to long), ends included. Adds value, the target's extreme there; null for an empty range."""
        given, size = queries.columns, self.size
        part = "array<struct<level:int,block:bigint,a:bigint,b:bigint>>"
        parts, lo, hi, live = F.array().cast(part), F.col("from"), F.col("to"), F.col("from") <= F.col("to")
        for k in range(self.levels):
            first, last = F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long")
            piece = lambda block, a, b, k=k: F.struct(F.lit(k).alias("level"), block.alias("block"), a.alias("a"), b.alias("b"))
            one = F.array(piece(first, lo % size, hi % size))
            two = F.array(piece(first, lo % size, F.lit(size - 1).cast("long")), piece(last, F.lit(0).cast("long"), hi % size))
            parts = F.concat(parts, F.when(live, F.when(first == last, one).otherwise(two)).otherwise(F.array().cast(part)).cast(part))
            live = live & (last - first > 1)
            lo, hi = first + 1, last - 1
        asked = queries.select(*given, F.inline_outer(parts))
        asked = self._ask(asked, F.col("level"), F.col("block"), "left")
        value = F.lit(None).cast("double")
        for name, target in self.targets.items():
            held = F.slice(name, (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a") + 1).cast("int"))
            value = F.when(F.col("target") == name, (F.array_min if target.extreme == "min" else F.array_max)(held)).otherwise(value)
        least = F.first("target").isin([n for n, t in self.targets.items() if t.extreme == "min"])
        out = asked.withColumn("value", value).groupBy(*given).agg(F.min("value").alias("least"), F.max("value").alias("most"), least.alias("low"))
        return out.select(*given, F.when(F.col("low"), F.col("least")).otherwise(F.col("most")).alias("value"))
