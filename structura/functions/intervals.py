"""Price-interval algebra over ordered units, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def range3(low: str, high: str, w: WindowSpec) -> tuple[Column, Column]:
    """(zd, zg) of a unit and the two after it; null where fewer follow."""
    lows = [F.col(low), F.lead(low, 1).over(w), F.lead(low, 2).over(w)]
    highs = [F.col(high), F.lead(high, 1).over(w), F.lead(high, 2).over(w)]
    whole = lows[2].isNotNull()
    return F.when(whole, F.greatest(*lows)), F.when(whole, F.least(*highs))


def touches(low: Column, high: Column, zd: Column, zg: Column) -> Column:
    return ~((high < zd) | (low > zg))


def relation(gg: Column, dd: Column, prev_gg: Column, prev_dd: Column) -> Column:
    """How a center's waves lie to the one before; null for the first."""
    return F.when(prev_gg.isNull(), F.lit(None).cast("string")).when(gg < prev_dd, "down_continue").when(dd > prev_gg, "up_continue").otherwise("expand")


def lineage_relation(zd: Column, zg: Column, gg: Column, dd: Column, prev_zd: Column, prev_zg: Column, prev_gg: Column, prev_dd: Column) -> Column:
    """As relation, but meeting waves are told apart: cores disjoint is a higher level, else an overlap."""
    higher = ((zg < prev_zd) & (gg >= prev_dd)) | ((zd > prev_zg) & (dd <= prev_gg))
    return F.when(prev_zd.isNull(), F.lit(None).cast("string")).when(gg < prev_dd, "down_continue").when(dd > prev_gg, "up_continue").when(higher, "higher_level").otherwise("overlap")


def finite(v: Column) -> Column:
    """The number, or null where it is missing, not a number or infinite."""
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def side_of(start: Column, end: Column) -> Column:
    return F.when(end > start, "up").when(end < start, "down")


def heading(direction: Column, kind: Column) -> Column:
    return F.when(direction.isin("up", "down"), direction).when(kind.isin("up", "down"), kind)
