"""Cross-site boilerplate lines, with DataFrame functions only.

A line is judged by the number of distinct sites that hold it.  HyperLogLog sketches per line hash, merged by
aggregation, settle all lines far from the threshold; only lines within ``MARGIN`` of it are counted exactly.  Texts are
shuffled once, when a document meets the numbers of its lines to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import left_join, text_key, written

#: 2^12 registers: relative error 1.6 %; lines within six times that around the threshold are counted exactly.
LG_K, MARGIN = 12, 0.1


def line_body(line: Column) -> Column:
    """A line without blanks at its ends; blank lines are never boilerplate."""
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """One row per line that is not blank: the given columns, pos, and the line's 128-bit hash."""
    cut = docs.select(*more, F.posexplode_outer(F.split(F.col(text), "\n")).alias("pos", "line"))
    cut = cut.withColumn("line", line_body(F.col("line"))).where(F.col("line") != "")
    return cut.withColumn("h", text_key(F.col("line"))).drop("line")


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = 10) -> DataFrame:
    """Hashes ``h`` of the lines that at least ``min_sites`` distinct sites hold; a null site counts for nothing."""
    lines = _lines(docs.where(F.col(site).isNotNull()), text, F.col(site).cast("string").alias("site")).drop("pos")
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg("site", LG_K).alias("s"))
    spread = written(
        sketches.select("h", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= min_sites * (1 - MARGIN))
    )
    sure = F.col("n") > min_sites * (1 + MARGIN)
    near = spread.where(~sure).select("h")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return spread.where(sure).select("h").unionByName(exact.where(F.col("n") >= min_sites).select("h"))


def without_boilerplate(
    docs: DataFrame, site: str = "source", text: str = "text", doc_id: str = "doc_id", min_sites: int = 10
) -> DataFrame:
    """One row per document: row (the whole input row), n_lines, n_removed, kept (the text without boilerplate lines).

    All occurrences go.  Null texts stay null and have no lines; a text of boilerplate alone becomes empty.  Repeated
    rows each get their result; ids may be null or repeated; columns of the input may have any name.
    """
    bad = written(boilerplate(docs, site, text, min_sites))
    places = _lines(docs, text, F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"))
    gone = places.join(bad, "h").groupBy("id", "key").agg(F.collect_set("pos").alias("gone"))
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key")
    )
    out = left_join(base, gone, ["id", "key"])
    lines = F.split(F.col("row")[text], "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    n_removed = F.coalesce(F.size("gone"), F.lit(0))
    return out.select(
        "row", F.greatest(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(n_removed, F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"),
    )


def clean_documents(docs: DataFrame, site: str = "source", text: str = "text", doc_id: str = "doc_id", min_sites: int = 10) -> DataFrame:
    """All documents, in their own columns, without boilerplate lines."""
    out = without_boilerplate(docs, site, text, doc_id, min_sites)
    return out.select(*[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
