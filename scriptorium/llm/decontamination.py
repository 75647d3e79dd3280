"""Benchmark decontamination with DataFrame functions only.

The items' windows of ``size`` words form a hash set that is broadcast when counted and measured to be small; beyond
that the same join shuffles.  A window is filed under its longest word, its anchor.  A document's words meet the anchors in
one hash join, and only at those few places the whole window is compared, word for word, so a hit is never a hash
collision.  Documents are scanned without carrying texts through a shuffle: only hits and counts move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import left_join, lower_ascii, text_key

#: Separates words: every ASCII character but digits and letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows and bytes up to which the set is broadcast.
BROADCAST_WINDOWS, BROADCAST_BYTES = 500_000, 64_000_000


def words(text: Column) -> Column:
    """Lower-cased words; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAPS), "")


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = 13) -> DataFrame:
    """Distinct windows: anchor, at (the anchor's place in the window), length, words, item_id.

    An item with fewer words is one window; items without words or id have none.
    """
    split = items.select(F.col(item_id).cast("string").alias("item_id"), words(F.col(text)).alias("w"))
    split = split.where(F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    cut = split.select("item_id", "w", F.explode(starts).alias("s")).select(
        "item_id", F.slice("w", F.col("s"), F.lit(size)).alias("w")
    )
    best = F.array_max(F.transform("w", lambda x, i: F.struct(F.char_length(x).alias("n"), x.alias("word"), (-i).alias("i"))))
    return cut.withColumn("best", best).select(
        F.col("best.word").alias("anchor"), (-F.col("best.i")).cast("int").alias("at"), F.size("w").alias("length"),
        F.array_join("w", " ").alias("words"), "item_id",
    ).distinct()


def _held(windows: DataFrame) -> DataFrame:
    n, size = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()
    return F.broadcast(windows) if n <= BROADCAST_WINDOWS and size <= BROADCAST_BYTES else windows


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", size: int = 13, share: int = 20,
) -> DataFrame:
    """One row per document: row (the whole input row), n_words, n_hit, items, ranges, contaminated.

    ``ranges`` are the (start, length) of matching windows in words.  A document is contaminated if hit words are at
    least one in ``share`` of its words.  Null and empty texts have no words; repeated rows each get their result; ids
    may be null or repeated, columns of the input may have any name.
    """
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"),
        F.size(words(F.col(text))).alias("n_words"),
    )
    found = hits(docs, _held(item_windows(items, item_id, item_text, size)), doc_id, text)
    out = left_join(base, found, ["id", "key"])
    none = F.array().cast("array<struct<start:int,length:int>>")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return out.select(
        "row", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("ranges", none).alias("ranges"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def hits(docs: DataFrame, windows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per id and text with a hit: n_hit, items (sorted as strings), ranges (sorted)."""
    rows = docs.select(F.col(doc_id).alias("id"), text_key(F.col(text)).alias("key"), words(F.col(text)).alias("w"))
    # the outer form adds no second evaluation of the words as a filter below it
    places = rows.select("id", "key", "w", F.posexplode_outer("w").alias("pos", "word"))
    met = places.join(windows, F.col("word") == F.col("anchor")).where(
        (F.col("pos") >= F.col("at")) & (F.col("pos") - F.col("at") + F.col("length") <= F.size("w"))
    )
    start = F.col("pos") - F.col("at")
    met = met.where(F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("length")), " ") == F.col("words"))
    found = met.select("id", "key", start.alias("start"), "length", "item_id").groupBy("id", "key").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"),
        F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("length")))).alias("ranges"),
    )
    covered = F.aggregate(
        "ranges", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a["end"], x["start"] + x["length"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["end"], x["start"]))).alias("n"),
        ),
    )
    return found.withColumn("n_hit", covered["n"])


def clean_documents(docs: DataFrame, items: DataFrame, **names: str) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    return contamination(docs, items, **names).where(~F.col("contaminated")).select("row.*")


def without_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """Every document, its hit words and the gaps after them removed from the text."""
    out = contamination(docs, items, doc_id, text, **more)
    body = F.col("row")[text]
    pieces = F.regexp_extract_all(body, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    lead = F.regexp_extract(body, r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    gone = F.flatten(F.transform("ranges", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.col("n_words").cast("int") - 1), gone)
    cut = F.concat(lead, F.array_join(F.transform(left, lambda i: F.get(pieces, i)), ""))
    fields = [F.when(F.col("n_hit") > 0, cut).otherwise(body).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    return out.select(*fields)
