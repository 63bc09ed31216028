"""Source divergence audit: how far each source's terms lie from those of the other sources of its language.

Relational work. The matches of a pattern are counted by (lang, source, term), those of one Arrow batch after another before
they are exploded into rows; a language keeps the terms in at least `least_docs` of its documents, one row each, with the
counts of the groups that have it; every occurring group is crossed with its language's kept terms, which turns absent
terms into zeros; the dense table meets itself on (lang, term) and is summed to the divergence of each ordered pair of
sources; windows rank pairs and terms. All of it is integer or decimal arithmetic, hence exact.

A language may hold most of the rows. Counts are combined in the task, then by (lang, source, term), then by (lang, term),
whose rows are the sources of one language. Groups meet terms by (lang, salt of the term), and since a term's groups lie in one
row, the self-join needs no shuffle; its pairs are summed before they are. A task holds at most `entries` counts
at once. Nothing is broadcast by hand or collected.

Defined cases: a null text, lang or source counts as ''; texts without terms still make their group occur; each row is a
document, repeated rows and ids included; a language without kept terms gives its pairs with value 0 and no terms; a
language with one source gives no pairs; ties go to the smaller item in UTF-8 order; an empty table gives no rows; only
the three columns named are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace

#: A term is a run of ASCII letters and of characters beyond ASCII, here of their UTF-8 bytes once A-Z are lower-cased.
TERM = rb"[a-z\x80-\xff]+"
SCALE = 1_000_000_000


def _count(entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = re.compile(TERM).findall
        times: dict = defaultdict(Counter)
        docs: dict = defaultdict(Counter)
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in times.items():
                seen = docs[lang, source]
                columns = [pa.array([lang]).take(pa.array([0] * len(n), pa.int32())), pa.array([source]).take(pa.array([0] * len(n), pa.int32())), pa.array(list(n), pa.binary()).cast(pa.string())]
                columns += [pa.array(list(n.values()), pa.int64()), pa.array([seen[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            times.clear()
            docs.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source")), batch.column("text").cast(pa.binary())):
                # bytes.lower changes A-Z alone
                found = terms(text.as_py().lower())
                group = times[lang, source]
                held -= len(group)
                group.update(found)
                docs[lang, source].update(set(found))
                held += len(group)
                if held >= entries:
                    yield from rows()
                    held = 0
        yield from rows()

    return run


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", entries: int = 300_000) -> DataFrame:
    """One row per (lang, source, term): n occurrences in `docs` documents."""
    read = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source"), _name(text_col).alias("text"))
    counted = read.mapInArrow(_count(entries), "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _name(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)) of longs, in decimals where a long could not hold the product."""
    wide = lambda c: c.cast("decimal(19,0)")
    narrow = F.call_function("div", (n + 1) * SCALE, total + kept)
    return F.when(n < (1 << 62) // SCALE, 1 + narrow).otherwise(1 + F.call_function("div", (wide(n) + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total) + wide(kept)))


def gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so the square fits a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 3, top_terms: int = 200, salts: int = 64
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` has every other source, part `term` the strongest terms."""
    ws = Workspace(docs.sparkSession, "divergence")
    held = F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("held")
    terms = term_counts(docs, text_col, lang_col, source_col).groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), held)
    terms = ws.write(terms.where(F.col("docs") >= least_docs).drop("docs"), "terms")

    groups = docs.select(_name(lang_col).alias("lang"), _name(source_col).alias("source")).distinct()
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = terms.select("lang", F.explode("held").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sized = groups.join(langs, "lang").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    sized = ws.write(sized.groupBy("lang", "kept", "lang_total").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")), "groups")

    # every group meets every kept term of its language, dealt by the term's salt; what does not occur counts zero
    salted = terms.withColumn("salt", F.pmod(F.hash("term"), F.lit(salts)))
    spread = sized.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = salted.join(spread, ["lang", "salt"]).withColumn("counts", F.transform("groups", lambda g: F.coalesce(F.col("held")[g["source"]], F.lit(0).cast("long"))))
    met = met.withColumn("p", F.zip_with("groups", "counts", lambda g, n: share(n, g["total"], F.col("kept"))))

    # a term's other groups lie in its own row
    joined = met.select("lang", "p", F.posexplode("p").alias("place", "one")).select("lang", "place", "one", F.posexplode("p").alias("other", "two"))
    pairs = joined.where(F.col("place") != F.col("other")).groupBy("lang", "place", "other").agg(F.sum(gap("one", "two")).alias("value"))
    names = sized.select("lang", F.col("groups.source").alias("names"))
    pairs = pairs.join(names, "lang").select("lang", F.col("names")[F.col("place")].alias("source"), F.col("names")[F.col("other")].alias("item"), "value")
    bare = groups.join(langs.select("lang"), "lang", "left_anti")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where(F.col("source") != F.col("item")).select("*", F.lit(0).cast("long").alias("value"))
    lone = met.select("lang", "term", share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), F.inline(F.arrays_zip("groups", "counts", "p")))
    terms = lone.where((F.col("counts") > 0) & (F.col("p") > F.col("q"))).select("lang", F.col("groups.source").alias("source"), F.col("term").alias("item"), gap("p", "q").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs.unionByName(bare), "pair").unionByName(ranked(terms, "term").where(F.col("rank") <= top_terms))
