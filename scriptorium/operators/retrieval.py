"""Search with expanded queries: variants, one search for all of them, fusion and re-ranking in one plan.

A searcher takes ``queries(query_id, variant_no, query_text)`` and k, and gives hits with ``query_id, variant_no, rank,
similarity`` and whatever names and describes a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.vectors import Embedder, bag_of_words
from scriptorium.operators.expansion import expand
from scriptorium.operators.fusion import reciprocal_rank
from scriptorium.operators.rerank import Scorer, lexical_overlap, rerank
from scriptorium.operators.search import nearest

Searcher = Callable[[DataFrame, int], DataFrame]


def vector_searcher(
    corpus: DataFrame, id_name: str, embedder: Embedder = bag_of_words, min_similarity: float | None = None, find=nearest,
) -> Searcher:
    """Exact search over ``corpus(id, vec)``; a variant without any text has no hits."""

    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = queries.where(F.trim("query_text") != "").select("query_id", "variant_no", embedder(F.col("query_text")).alias("vec"))
        return find(asked, corpus, k, ["query_id", "variant_no"], id_name, min_similarity=min_similarity)

    return search


def expanded_search(
    queries: DataFrame, searcher: Searcher, doc: str, k: int = 10, fuse=reciprocal_rank, limit: int | None = 6, **expansion,
) -> tuple[DataFrame, DataFrame]:
    """Fused results of ``queries(query_id, text)``, the best k of each, and the hits of all variants behind them.

    Every query is expanded to at most ``limit`` variants, each of which is searched for k hits.  A null text has no
    variants; a query none of whose variants has hits has no results.
    """
    variants = expand(queries.where(F.col("text").isNotNull()), limit=limit, **expansion)
    hits = searcher(variants, k)
    return fuse(hits, doc, limit=k), hits


def full_search(
    queries: DataFrame, searcher: Searcher, documents: DataFrame, doc: str, k: int = 8, scorer: Scorer | None = lexical_overlap,
    fuse=reciprocal_rank, **expansion,
) -> DataFrame:
    """The best 2 k fused documents of each query, re-ranked against its own text down to k.

    ``documents`` gives each a ``content``; its similarity is that of its best variant.
    """
    fused, hits = expanded_search(queries, searcher, doc, 2 * k, fuse, **expansion)
    best = hits.groupBy("query_id", doc).agg(F.max("similarity").alias("similarity"))
    asked = queries.select("query_id", F.col("text").alias("query_text"))
    found = fused.withColumnRenamed("fused_rank", "rank").join(best, ["query_id", doc]).join(asked, "query_id")
    return rerank(found.join(documents, doc), ["query_id"], k, scorer)
