"""Expanded search against expectations written by hand."""

from pyspark.sql import functions as F

from scriptorium.operators import retrieval


def mock(spark):
    """Two hits per variant: what the variant's number decides, and one that all share."""

    def search(queries, k):
        hits = queries.where(F.trim("query_text") != "").select("query_id", "variant_no", F.explode(F.array(
            F.struct(F.lit(1).alias("rank"), F.lit("all").alias("doc"), F.lit(0.9).alias("similarity")),
            F.struct(F.lit(2).alias("rank"), F.concat(F.lit("v"), "variant_no").alias("doc"), (0.5 - F.col("variant_no") / 100).alias("similarity")),
        )).alias("h"))
        return hits.select("query_id", "variant_no", "h.*").where(F.col("rank") <= k)

    return search


def test_every_variant_is_searched_once_and_fused(spark):
    queries = spark.createDataFrame([(1, "porosidade da rocha"), (2, " "), (3, None), (4, "fluxo")], "query_id long, text string")
    fused, hits = retrieval.expanded_search(queries, mock(spark), "doc", 3, limit=4)
    rows = {(r.query_id, r.doc): (r.match_count, r.fused_rank, r.fusion_score) for r in fused.collect()}
    variants = {q: {r.variant_no for r in hits.where(F.col("query_id") == q).collect()} for q in (1, 2, 3, 4)}
    assert variants[1] == {0, 1, 2, 3} and 0 not in variants[2] and variants[3] == set()
    assert rows[1, "all"] == (4, 1, round(4 / 61, 8)) and rows[1, "v0"] == (1, 2, round(1 / 62, 8))
    assert len([k for k in rows if k[0] == 1]) == 3 and not [k for k in rows if k[0] == 3]


def test_full_search_keeps_the_best_after_reranking(spark):
    queries = spark.createDataFrame([(1, "porosidade da rocha")], "query_id long, text string")
    documents = spark.createDataFrame([("all", "nada"), ("v0", "porosidade da rocha"), ("v1", "x" * 600 + " porosidade da rocha")], "doc string, content string")
    found = retrieval.full_search(queries, mock(spark), documents, "doc", 2, limit=3).orderBy("new_rank").collect()
    assert [r.doc for r in found] == ["v0", "v1"] and found[1].pair_score == found[0].pair_score
