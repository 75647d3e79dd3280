"""Registered queries: search with expanded queries."""

from pyspark.sql import functions as F

from scriptorium.operators import fusion, retrieval
from scriptorium.plans import tables as t
from scriptorium.plans.contexts import rerank_sql
from scriptorium.plans.questions import BOUNDS, VOCABULARY, sql_expansion, texts
from scriptorium.plans.registry import query

FLOOR, LIMIT = 0.2, 6


def expanded_sql(k: int) -> str:
    """Common table expressions that end in ``hits``: the best k chunks of every variant."""
    return t.CHUNK_VECTORS + "," + sql_expansion(LIMIT, BOUNDS) + f""",
query_vectors AS (SELECT query_id, variant_no, {t.sql_embed('query_text')} AS qvec FROM query_texts WHERE trim(query_text) <> ''),
scored AS (
  SELECT query_id, variant_no, chunk_id, round({t.sql_cosine('qvec', 'vec')}, 6) AS similarity FROM query_vectors, chunk_vectors),
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY similarity DESC, chunk_id) AS rank
  FROM scored WHERE similarity >= {FLOOR}::DOUBLE QUALIFY rank <= {k})"""


def fused_sql(score: str, k: int) -> str:
    return f"""
fused AS (SELECT query_id, chunk_id, round({score}, 8) AS fusion_score, count(*) AS match_count, max(similarity) AS similarity FROM hits GROUP BY ALL),
fused_top AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, chunk_id) AS INT) AS fused_rank FROM fused QUALIFY fused_rank <= {k})"""


def searcher(spark, sf_dir):
    return retrieval.vector_searcher(t.chunk_vectors(spark, sf_dir), "chunk_id", min_similarity=FLOOR)


@query("fused_text_search", "WITH" + expanded_sql(10) + "," + fused_sql("sum(1.0 / (60 + rank))", 10) + """
SELECT query_id, chunk_id, fusion_score, match_count, fused_rank FROM fused_top""")
def fused_text_search(spark, sf_dir):
    fused, _ = retrieval.expanded_search(texts(spark, sf_dir), searcher(spark, sf_dir), "chunk_id", 10, limit=LIMIT, **BOUNDS, **VOCABULARY)
    return fused.select("query_id", "chunk_id", "fusion_score", "match_count", "fused_rank")


@query("fused_text_search_weighted", "WITH" + expanded_sql(10) + ","
       + fused_sql("sum(similarity * CASE WHEN variant_no = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END)", 10) + """
SELECT query_id, chunk_id, fusion_score, match_count, fused_rank FROM fused_top""")
def fused_text_search_weighted(spark, sf_dir):
    """The same search fused by weighted similarities."""
    fused, _ = retrieval.expanded_search(
        texts(spark, sf_dir), searcher(spark, sf_dir), "chunk_id", 10, fusion.weighted, LIMIT, **BOUNDS, **VOCABULARY
    )
    return fused.select("query_id", "chunk_id", "fusion_score", "match_count", "fused_rank")


@query("full_search", "WITH" + expanded_sql(10) + "," + fused_sql("sum(1.0 / (60 + rank))", 10) + """,
searched AS (SELECT f.query_id, chunk_id, fusion_score, fused_rank AS rank, f.similarity, content, text AS query_text
             FROM fused_top f JOIN chunks USING (chunk_id) JOIN benchmark ON item_id = f.query_id),"""
       + rerank_sql("searched", "query_id") + """
SELECT query_id, chunk_id, fusion_score, similarity, new_rank FROM reranked WHERE new_rank <= 5""")
def full_search(spark, sf_dir):
    found = retrieval.full_search(
        texts(spark, sf_dir), searcher(spark, sf_dir), t.chunks(spark, sf_dir).select("chunk_id", "content"), "chunk_id", 5,
        limit=LIMIT, **BOUNDS, **VOCABULARY,
    )
    return found.select("query_id", "chunk_id", "fusion_score", F.col("similarity"), "new_rank")
