"""Context assembly and compression.

Works on one row per query with its ranked hits as an array; ranks are limited by the search, so a row is bounded by
the result size, never by the corpus.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import count_contained, sentences_guarded, words
from scriptorium.functions.vectors import Embedder, bag_of_words, cosine
from scriptorium.lexicons import COMPRESSION_TERMS


def ranked_lists(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``hits array<struct<rank, content, source, page>>`` per query, in rank order."""
    entry = F.struct("rank", "content", "source", "page")
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("hits"))


def combine(hits: Column, citations: bool = True) -> Column:
    """Contents in rank order, each after ``[source, p.N]``."""
    def part(h: Column, i: Column) -> Column:
        source = F.coalesce(h["source"], F.concat(F.lit("Document_"), (i + 1).cast("string")))
        page = F.coalesce(h["page"].cast("string"), F.lit("N/A"))
        return F.concat(F.lit("["), source, F.lit(", p."), page, F.lit("] "), h["content"])

    return F.array_join(F.transform(hits, part if citations else lambda h: h["content"]), " ")


def sentence_importance(
    contexts: DataFrame, keys: Sequence[str], terms: Sequence[str] = COMPRESSION_TERMS,
    embedder: Embedder = bag_of_words, digits: int = 9,
) -> DataFrame:
    """Score of every sentence of ``contexts(keys, query_text, combined)``.

    0.4 similarity to the query + 0.25 term density + 0.15 position + 0.1 length band + 0.1 distinct-word share.
    """
    split = contexts.withColumns({
        "_s": sentences_guarded(F.col("combined")), "query_vec": embedder(F.col("query_text")),
    })
    rows = split.select(*keys, "query_vec", F.size("_s").alias("n"), F.posexplode("_s").alias("pos", "sentence"))
    rows = rows.withColumns({
        "vec": embedder(F.col("sentence")), "w": words(F.lower("sentence")),
        "term_hits": count_contained(F.lower("sentence"), terms),
    })
    count = F.size("w")
    score = (
        cosine(F.col("query_vec"), F.col("vec")) * 0.4
        + F.when(count > 0, F.col("term_hits") / count).otherwise(0.0) * 0.25
        + (F.lit(1.0) - F.col("pos") / F.col("n") * 0.3) * 0.15
        + F.when(count.between(10, 30), 1.0).when(count < 10, 0.7).otherwise(0.8) * 0.1
        + F.when(count > 0, F.size(F.array_distinct("w")) / count).otherwise(0.0) * 0.1
    )
    return rows.select(*keys, "pos", "n", "sentence", "vec", F.round(score, digits).alias("score"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _greedy(vecs: pd.Series, lengths: pd.Series, target: pd.Series, longest: pd.Series, most: pd.Series) -> pd.Series:
    """Positions (in score order) kept by the greedy choice of one query."""
    def choose(v, sizes, wanted, limit, near):
        m = np.stack([np.asarray(x, dtype=np.float64) for x in v])
        norm = np.sqrt((m * m).sum(axis=1))
        kept, used = [0], sizes[0]
        for i in range(1, len(sizes)):
            if len(kept) >= wanted:
                break
            if used + sizes[i] > limit:
                continue
            scale = norm[kept] * norm[i]
            sims = np.divide(m[kept] @ m[i], scale, out=np.zeros(len(kept)), where=scale > 0)
            if np.round(sims.max(), 9) > near:
                continue
            kept.append(i)
            used += sizes[i]
        return kept

    return pd.Series([choose(*row) for row in zip(vecs, lengths, target, longest, most)])


def compress(
    contexts: DataFrame, keys: Sequence[str], ratio: float = 0.8, max_length: int = 2000, near: float = 0.8,
    terms: Sequence[str] = COMPRESSION_TERMS, embedder: Embedder = bag_of_words,
) -> DataFrame:
    """Compressed text, kept and removed sentences and figures for ``contexts(keys, query_text, combined)``."""
    scored = sentence_importance(contexts, keys, terms, embedder)
    entry = F.struct((-F.col("score")).alias("order"), "pos", "score", "sentence", "vec")
    listed = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("s"), F.first("n").alias("n"))
    picked = listed.withColumn("kept", _greedy(
        F.col("s.vec"), F.transform("s", lambda x: F.length(x["sentence"])),
        F.greatest(F.lit(1), F.floor(F.col("n") * ratio).cast("int")), F.lit(max_length), F.lit(near),
    ))
    joined = contexts.join(picked, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    few = F.col("n") <= 3
    selected = F.array_sort(F.transform("kept", lambda i: F.get("s", i)), lambda a, b: a["pos"] - b["pos"])
    chosen = F.transform(selected, lambda x: x["sentence"])
    in_order = F.transform(F.array_sort(F.transform("s", lambda x: F.struct(x["pos"], x["sentence"]))), lambda x: x["sentence"])
    relevance = F.aggregate(
        F.slice("s", F.lit(1), F.greatest(F.size("kept"), F.lit(1))), F.lit(0.0), lambda a, x: a + x["score"]
    ) / F.size("kept")
    out = joined.withColumns({"_chosen": chosen, "_all": in_order})
    return out.select(
        *keys, "combined",
        F.when(F.col("combined") == "", "").when(few, F.col("combined"))
        .otherwise(F.concat(F.array_join("_chosen", ". "), F.lit("."))).alias("compressed"),
        F.when(F.col("combined") == "", 0.0).when(few, 1.0).otherwise(relevance).alias("relevance"),
        F.when(few, F.coalesce("_all", F.array().cast("array<string>"))).otherwise(F.col("_chosen")).alias("kept_sentences"),
        F.when(few, F.array().cast("array<string>"))
        .otherwise(F.filter("_all", lambda x: ~F.array_contains("_chosen", x))).alias("removed_sentences"),
        F.when(F.col("combined") == "", "empty_input").when(few, "no_compression_needed")
        .otherwise("semantic_importance").alias("method"),
    )


def compression_statistics(compressed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lengths, ratio, kept and removed counts, efficiency."""
    before, after = F.length("combined"), F.length("compressed")
    ratio = F.when(F.col("method") == "no_compression_needed", 1.0).when(before > 0, after / before).otherwise(0.0)
    return compressed.select(
        *keys, "method", before.alias("original_length"), after.alias("compressed_length"),
        (before - after).alias("saved"), F.round(ratio, 6).alias("ratio"), F.round("relevance", 6).alias("relevance"),
        F.size("kept_sentences").alias("sentences_kept"), F.size("removed_sentences").alias("sentences_removed"),
        F.round(F.when(ratio > 0, F.col("relevance") / ratio).otherwise(0.0), 6).alias("efficiency"),
    )


def accept(compressed: Column, original: Column, relevance: Column, threshold: float = 0.7) -> Column:
    """Compressed text only where its relevance is high enough."""
    return F.when(relevance > threshold, compressed).otherwise(original)


def budgeted(contents: Column, max_length: int, reserve: int = 50, least: int = 100) -> Column:
    """Whole documents while they fit; the first that does not is cut if enough room is left; then stop."""
    empty = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    numbered = F.transform(contents, lambda c, i: F.struct(c.alias("c"), (i + 1).cast("string").alias("i")))

    def step(state: Column, d: Column) -> Column:
        head = F.concat(F.lit("[Documento "), d["i"], F.lit("]\n"))
        block = F.concat(head, d["c"], F.lit("\n\n"))
        room = F.lit(max_length) - F.length(state["text"]) - reserve
        over = F.length(state["text"]) + F.length(block) > max_length
        cut = F.concat(head, F.left(d["c"], room), F.lit("...\n\n"))
        text = F.when(state["full"], state["text"]).when(~over, F.concat(state["text"], block)).when(
            room > least, F.concat(state["text"], cut)
        ).otherwise(state["text"])
        return F.struct(text.alias("text"), (state["full"] | over).alias("full"))

    return F.aggregate(numbered, empty, step, lambda s: s["text"])


def numbered_documents(contents: Column) -> Column:
    return F.array_join(F.transform(
        contents, lambda c, i: F.concat(F.lit("[Documento "), (i + 1).cast("string"), F.lit("]\n"), c)
    ), "\n\n")


def cited_documents(contents: Column, citations: Column) -> Column:
    return F.array_join(F.zip_with(citations, contents, lambda q, c: F.concat(q, F.lit(":\n"), c)), "\n\n---\n\n")
