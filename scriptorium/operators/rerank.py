"""Re-ranking of hits by a pair scorer and greedy removal of near copies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import let, tokens, words
from scriptorium.operators.fusion import keyword_boost
from scriptorium.scale import top_rows

Scorer = Callable[[Column, Column], Column]


def lexical_overlap(query: Column, content: Column) -> Column:
    """Default pair score: share of the query's distinct tokens found in the content."""
    return let(F.array_distinct(tokens(query)), lambda asked: F.when(
        F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(content))) / F.size(asked)
    ).otherwise(0.0))


def rerank(
    hits: DataFrame, keys: Sequence[str], k: int | None = None, scorer: Scorer | None = lexical_overlap,
    similarity_weight: float = 0.3, score_weight: float = 0.7, content_length: int | None = None, digits: int = 6,
) -> DataFrame:
    """0.3 · similarity + 0.7 · sigmoid(score), clamped, ranked per query as ``new_rank``; no scorer passes through.

    The scorer reads the whole content, or its first ``content_length`` characters if given.
    """
    k = k or 2**31 - 1
    if scorer is None:
        return top_rows(hits, keys, [F.col("rank")], k, "new_rank")
    score = scorer(F.col("query_text"), F.substring("content", 1, content_length) if content_length else F.col("content"))
    rated = hits.withColumns({
        "original_similarity": F.col("similarity"),
        "pair_score": F.round(1 / (1 + F.exp(-score)), digits),
    })
    mixed = F.col("similarity") * similarity_weight + F.col("pair_score") * score_weight
    rated = rated.withColumn("similarity", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)), digits + 3))
    return top_rows(rated, keys, [-F.col("similarity"), F.col("rank")], k, "new_rank")


def diverse(hits: DataFrame, keys: Sequence[str], threshold: float = 0.8, rank: str = "rank") -> DataFrame:
    """Drop hits whose words overlap a kept one by more than ``threshold``; three hits or fewer stay as they are.

    ``hits`` are rank-limited lists, so one query's list fits a row.
    """
    listed = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct(F.col(rank).alias("_r"), F.array_distinct(words(F.lower("content"))).alias("_w"))
    )).alias("_hits"))

    def close(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return (F.size(a) > 0) & (F.size(b) > 0) & (both / (F.size(a) + F.size(b) - both) > threshold)

    first = F.slice("_hits", 1, 1)
    kept = F.aggregate(
        F.slice(F.col("_hits"), F.lit(2), F.size("_hits")), first,
        lambda acc, h: F.when(F.exists(acc, lambda a: close(a["_w"], h["_w"])), acc).otherwise(F.array_append(acc, h)),
    )
    chosen = F.when(F.size("_hits") <= 3, F.col("_hits")).otherwise(kept)
    ranks = listed.select(*keys, F.explode(F.transform(chosen, lambda h: h["_r"])).alias(rank))
    return hits.join(ranks, [*keys, rank], "left_semi")


def multi_stage(
    hits: DataFrame, keys: Sequence[str], high: Sequence[str], medium: Sequence[str], k: int | None = None,
    scorer: Scorer | None = lexical_overlap, content_length: int | None = None,
) -> DataFrame:
    """Keyword boost, pair scoring, diversity."""
    boosted = keyword_boost(hits, F.col("query_text"), high, medium)
    lifted = boosted.withColumn("similarity", F.round("boosted", 9)).drop("boosted")
    return diverse(rerank(lifted, keys, k, scorer, content_length=content_length), keys, rank="new_rank")
