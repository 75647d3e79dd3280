"""Merging ranked hit lists: per-page merge, three fusions, boosts, confidence and result projection.

Hit tables have ``query_id, variant_no, rank, similarity`` and content columns.  Every group is reduced by partial
aggregation before its shuffle; ``query_id`` groups hold at most variants × k rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.scale import number_rows, top_rows

RRF_K = 60


def merge_pages(hits: DataFrame, content: str = "first") -> DataFrame:
    """One hit per (query, source, page): best similarity and its variant, content of the first seen.

    ``content="best"`` takes the content from the best hit as well.
    """
    seen = F.struct("variant_no", "rank", "chunk_id")
    best = F.struct(F.col("similarity"), -F.col("variant_no"), -F.col("rank"))
    return hits.groupBy("query_id", "source", "page").agg(
        F.max("similarity").alias("similarity"),
        F.max_by("variant_no", best).alias("matched_variant"),
        (F.min_by("content", seen) if content == "first" else F.max_by("content", best)).alias("content"),
        F.min(seen).alias("_seen"),
    ).withColumns({
        "first_variant": F.col("_seen.variant_no"), "first_rank": F.col("_seen.rank"),
        "chunk_id": F.col("_seen.chunk_id"),
    }).drop("_seen")


def number_results(merged: DataFrame, **options) -> DataFrame:
    """Rank merged hits by similarity, earlier seen first on ties."""
    order = [-F.col("similarity"), F.col("first_variant"), F.col("first_rank"), F.col("chunk_id")]
    return number_rows(merged, ["query_id"], order, "rank", **options)


def _in_both(query: Column, content: Column, terms: Sequence[str]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + (query.contains(term.lower()) & content.contains(term.lower())).cast("int")
    return total


def boost_terms(hits: DataFrame, query: Column, terms: Sequence[str], step: float = 0.1) -> DataFrame:
    """×(1 + step · number of query terms in the content), capped at 1."""
    matches = _in_both(F.lower(query), F.lower("content"), terms)
    return hits.withColumns({
        "term_matches": matches,
        "boosted": F.least(F.lit(1.0), F.col("similarity") * (1 + matches * step)),
    })


def boost_sections(
    hits: DataFrame, section_weights: Mapping[str, float], source_weights: Mapping[str, float]
) -> DataFrame:
    """× section weight × source weight, capped at 1; unknown names weigh 1."""
    def weight(name: str, table: Mapping[str, float]) -> Column:
        case = F.lit(1.0)
        for key, value in table.items():
            case = F.when(F.col(name) == key, F.lit(float(value))).otherwise(case)
        return case

    factor = weight("section", section_weights) * weight("source", source_weights)
    return hits.withColumns({
        "priority_boost": factor,
        "boosted": F.when(factor > 1, F.least(F.lit(1.0), F.col("similarity") * factor)).otherwise(F.col("similarity")),
    })


def fusion_key(content: Column, source: Column, page: Column, prefix: int | None = None) -> Column:
    """Identity of a hit across variants, from the whole content or its first ``prefix`` characters."""
    text = F.concat(F.substring(content, 1, prefix) if prefix else content, source.cast("string"), page.cast("string"))
    return F.substring(F.md5(text), 1, 12)


def reciprocal_rank(hits: DataFrame, doc: str, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Sum of 1/(k + rank) over variants, with the matching variants and their ranks."""
    fused = hits.groupBy("query_id", doc).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("fusion_score"),
        F.array_sort(F.collect_list(F.struct("variant_no", "rank"))).alias("_matched"),
        F.count("*").alias("match_count"),
    )
    best = top_rows(fused, ["query_id"], [-F.col("fusion_score"), F.col(doc)], limit, "fused_rank")
    return best.withColumns({
        "variants": F.concat_ws(",", F.transform("_matched", lambda m: m["variant_no"].cast("string"))),
        "ranks": F.concat_ws(",", F.transform("_matched", lambda m: m["rank"].cast("string"))),
    }).drop("_matched")


def mean_score(hits: DataFrame, doc: str, limit: int = 10) -> DataFrame:
    """Mean similarity over the matching variants."""
    fused = hits.groupBy("query_id", doc).agg(
        F.round(F.avg("similarity"), 8).alias("fusion_score"), F.count("*").alias("match_count")
    )
    return top_rows(fused, ["query_id"], [-F.col("fusion_score"), F.col(doc)], limit, "fused_rank")


def weighted(hits: DataFrame, doc: str, limit: int = 10, original: float = 1.0, other: float = 0.7) -> DataFrame:
    """Similarity sum where the original query (variant 0) weighs more than its variants."""
    w = F.when(F.col("variant_no") == 0, original).otherwise(other)
    fused = hits.groupBy("query_id", doc).agg(
        F.round(F.sum(F.col("similarity") * w), 8).alias("fusion_score"), F.count("*").alias("match_count")
    )
    return top_rows(fused, ["query_id"], [-F.col("fusion_score"), F.col(doc)], limit, "fused_rank")


def fusion_quality(fused: DataFrame, high: float = 0.7, medium: float = 0.3) -> DataFrame:
    """Per query: totals, match counts, mean score and a score histogram."""
    score = F.col("fusion_score")
    return fused.groupBy("query_id").agg(
        F.count("*").alias("total_results"),
        F.round(F.avg("match_count"), 6).alias("avg_matches"),
        F.max("match_count").alias("max_matches"),
        F.round(F.avg(score), 6).alias("avg_score"),
        F.count_if(score > high).alias("high"),
        F.count_if((score >= medium) & (score <= high)).alias("medium"),
        F.count_if(score < medium).alias("low"),
    )


def answer_confidence(hits: DataFrame) -> DataFrame:
    """The five confidence formulas over each query's hits.

    ``hits`` carries ``rank, similarity`` and the flags ``fused, reranked, section_hit``.
    """
    top = F.col("rank") <= 3
    return hits.groupBy("query_id").agg(
        F.avg(F.when(top, F.col("similarity") * F.col("similarity"))).alias("_sq"),
        F.avg(F.when(top, F.col("similarity"))).alias("_mean"),
        F.count("*").alias("_n"),
        F.max("fused").alias("_f"), F.max("reranked").alias("_r"), F.max("section_hit").alias("_s"),
    ).select(
        "query_id",
        F.round("_sq", 6).alias("squared"),
        F.round(F.least(
            F.lit(1.0),
            F.col("_sq") + F.when(F.col("_f"), 0.1).otherwise(0.0) + F.when(F.col("_r"), 0.15).otherwise(0.0)
            + F.when(F.col("_s"), 0.1).otherwise(0.0),
        ), 6).alias("enhanced"),
        F.round(F.least(F.lit(0.95), F.col("_n") * 0.2 + 0.3), 6).alias("by_count"),
        F.round("_mean", 6).alias("top_mean"),
    )


def result_rows(hits: DataFrame, preview: int = 200, limit: int | None = None) -> DataFrame:
    """Client-facing rows: preview with ellipsis, rounded similarity and defaults."""
    rows = hits if limit is None else hits.where(F.col("rank") <= limit)
    return rows.select(
        "query_id", "rank",
        F.coalesce("source", F.lit("Unknown")).alias("source"),
        F.coalesce(F.col("page").cast("string"), F.lit("N/A")).alias("page"),
        F.round("similarity", 3).alias("similarity"),
        F.when(F.length("content") > preview, F.concat(F.substring("content", 1, preview), F.lit("...")))
        .otherwise(F.col("content")).alias("preview"),
    )


def keyword_boost(
    hits: DataFrame, query: Column, high: Sequence[str], medium: Sequence[str],
    high_factor: float = 1.2, medium_factor: float = 1.1,
) -> DataFrame:
    """× 1.2 per high and 1.1 per medium keyword found in both query and content, capped at 1."""
    q, content = F.lower(query), F.lower("content")
    factor = F.pow(F.lit(high_factor), _in_both(q, content, high)) * F.pow(
        F.lit(medium_factor), _in_both(q, content, medium)
    )
    return hits.withColumns({
        "technical_boost": factor,
        "boosted": F.when(factor > 1, F.least(F.lit(1.0), F.col("similarity") * factor)).otherwise(F.col("similarity")),
    })
