"""Registered queries: similarity search, fusion, boosting and confidence."""

from pyspark.sql import functions as F

from scriptorium.functions.vectors import cosine
from scriptorium.operators import fusion, search
from scriptorium.plans import tables as t
from scriptorium.plans.registry import query
from scriptorium.scale import top_rows
from scriptorium.session import new_folder
from scriptorium.sources import cells

SECTION_WEIGHTS = {"abstract": 1.4, "definition": 1.5, "equation": 1.2, "regular": 1.0}
SOURCE_WEIGHTS = {"src1": 1.3, "src2": 1.1}
TERMS = ("that", "with", "this", "pour", "avec", "sich", "nicht", "para", "con", "the")


def sql_in(term_list):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in term_list) + "]"


@query("vector_cosine", f"""
SELECT vec_id, label, round({t.sql_cosine('e', 'c')}, 6) AS similarity
FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
JOIN (SELECT label, list(m ORDER BY i) AS c FROM (
  SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS m
  FROM embeddings, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY ALL) USING (label)""")
def vector_cosine(spark, sf_dir):
    rows = t.read(spark, sf_dir, "embeddings")
    parts = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    centre = centre.select("label", F.col("s.m").alias("c"))
    return rows.join(centre, "label").select(
        "vec_id", "label", F.round(cosine(F.col("embedding"), F.col("c")), 6).alias("similarity")
    )


@query("vector_top_k", "WITH" + t.VECTOR_HITS + """
SELECT query_id, variant_no, vec_id, similarity, CAST(rank AS INT) AS rank FROM vector_hits""")
def vector_top_k(spark, sf_dir):
    return t.vector_hits(spark, sf_dir).select("query_id", "variant_no", "vec_id", "similarity", "rank")


@query("vector_search_threshold", "WITH" + t.VECTOR_HITS + """
SELECT query_id, variant_no, vec_id, similarity, round(1 - similarity, 6) AS distance, CAST(rank AS INT) AS rank
FROM vector_hits WHERE similarity >= 0.3""")
def vector_search_threshold(spark, sf_dir):
    found = search.nearest(
        t.vector_queries(spark, sf_dir), t.vector_corpus(spark, sf_dir), t.TOP_K, ["query_id", "variant_no"],
        "vec_id", min_similarity=0.3,
    )
    return found.withColumn("distance", F.round(1 - F.col("similarity"), 6))


def sql_cells(rounds: int = cells.ROUNDS, count: int = cells.CELLS) -> str:
    """Common table expressions that end in ``cells``: number and centre of each, after rounds of spherical k-means."""
    def placed(source: str, centres: str) -> str:
        near = f"round({t.sql_cosine('v', 'c')}, 9)"
        return f"""(SELECT vec_id, v, cell FROM {source}, {centres}
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {near} DESC, cell) = 1)"""

    out = f"""
units AS (SELECT vec_id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v
          FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
cells0 AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS cell, e AS c FROM units QUALIFY cell < {count})"""
    for r in range(rounds):
        out += f""",
means{r} AS (SELECT cell, list(m ORDER BY i) AS c FROM (
  SELECT cell, i, round(avg(v[i]), 9) AS m FROM {placed('units', f'cells{r}')}, range(1, 65) AS d(i) GROUP BY ALL) GROUP BY cell),
cells{r + 1} AS (SELECT o.cell, coalesce(n.c, o.c) AS c FROM cells{r} o LEFT JOIN means{r} n ON n.cell = o.cell)"""
    return out + f""",
placed AS {placed('units', f'cells{rounds}')},
cells AS (SELECT * FROM cells{rounds})"""


@query("vector_approximate", "WITH" + t.VECTOR_QUERIES + "," + sql_cells() + f""",
probed AS (SELECT query_id, variant_no, qvec, cell FROM vector_queries, cells
  QUALIFY row_number() OVER (PARTITION BY query_id, variant_no ORDER BY round({t.sql_cosine('qvec', 'c')}, 9) DESC, cell) <= {cells.PROBE}),
near AS (SELECT query_id, variant_no, vec_id, round({t.sql_cosine('qvec', 'e')}, 6) AS similarity
  FROM probed JOIN placed USING (cell) JOIN units USING (vec_id))
SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY similarity DESC, vec_id) AS rank FROM near QUALIFY rank <= {t.TOP_K}""")
def vector_approximate(spark, sf_dir):
    corpus, path = t.vector_corpus(spark, sf_dir), new_folder(spark)
    centres = cells.train(corpus, "vec_id")
    cells.write_index(corpus, "vec_id", centres, path)
    return cells.search_index(spark, path, t.vector_queries(spark, sf_dir), centres, t.TOP_K, ["query_id", "variant_no"], "vec_id")


@query("fusion_reciprocal_rank", "WITH" + t.VECTOR_HITS + """,
fused AS (
  SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 8) AS fusion_score, count(*) AS match_count,
         string_agg(variant_no, ',' ORDER BY variant_no) AS variants, string_agg(rank, ',' ORDER BY variant_no) AS ranks
  FROM vector_hits GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, vec_id) AS INT) AS fused_rank
FROM fused QUALIFY fused_rank <= 5""")
def fusion_reciprocal_rank(spark, sf_dir):
    return fusion.reciprocal_rank(t.vector_hits(spark, sf_dir), "vec_id", limit=5)


@query("fusion_mean_score", "WITH" + t.VECTOR_HITS + """,
fused AS (SELECT query_id, vec_id, round(avg(similarity), 8) AS fusion_score, count(*) AS match_count
          FROM vector_hits GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, vec_id) AS INT) AS fused_rank
FROM fused QUALIFY fused_rank <= 10""")
def fusion_mean_score(spark, sf_dir):
    return fusion.mean_score(t.vector_hits(spark, sf_dir), "vec_id")


@query("fusion_weighted", "WITH" + t.VECTOR_HITS + """,
fused AS (SELECT query_id, vec_id, count(*) AS match_count,
            round(sum(similarity * CASE WHEN variant_no = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END), 8) AS fusion_score
          FROM vector_hits GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, vec_id) AS INT) AS fused_rank
FROM fused QUALIFY fused_rank <= 10""")
def fusion_weighted(spark, sf_dir):
    return fusion.weighted(t.vector_hits(spark, sf_dir), "vec_id")


FUSED = """
fused AS (
  SELECT query_id, doc_key, round(sum(1.0 / (60 + rank)), 8) AS fusion_score, count(*) AS match_count
  FROM (SELECT *, substr(md5(concat(content, source, CAST(page AS VARCHAR))), 1, 12) AS doc_key FROM hits)
  GROUP BY ALL),
fused_top AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_key) AS fused_rank
  FROM fused QUALIFY fused_rank <= 10)"""


def keyed_hits(spark, sf_dir):
    hits = t.hits(spark, sf_dir)
    return hits.withColumn("doc_key", fusion.fusion_key(F.col("content"), F.col("source"), F.col("page")))


@query("fusion_quality", "WITH" + t.HITS + "," + FUSED + """
SELECT query_id, count(*) AS total_results, round(avg(match_count), 6) AS avg_matches, max(match_count) AS max_matches,
       round(avg(fusion_score), 6) AS avg_score, count(*) FILTER (fusion_score > 0.04) AS high,
       count(*) FILTER (fusion_score >= 0.02 AND fusion_score <= 0.04) AS medium,
       count(*) FILTER (fusion_score < 0.02) AS low
FROM fused_top GROUP BY query_id""")
def fusion_quality(spark, sf_dir):
    fused = fusion.reciprocal_rank(keyed_hits(spark, sf_dir), "doc_key")
    return fusion.fusion_quality(fused, high=0.04, medium=0.02)


@query("fusion_document_key", "WITH" + t.HITS + """
SELECT query_id, variant_no, rank, substr(md5(concat(content, source, CAST(page AS VARCHAR))), 1, 12) AS doc_key
FROM hits""")
def fusion_document_key(spark, sf_dir):
    return keyed_hits(spark, sf_dir).select("query_id", "variant_no", "rank", "doc_key")


MERGED = """
merged AS (
  SELECT query_id, source, page, max(similarity) AS similarity,
         arg_max(variant_no, (similarity, -variant_no, -rank)) AS matched_variant,
         arg_min(content, (variant_no, rank)) AS content, min(variant_no) AS first_variant,
         arg_min(rank, (variant_no, rank)) AS first_rank, arg_min(chunk_id, (variant_no, rank)) AS chunk_id
  FROM hits GROUP BY ALL)"""


@query("hits_merged_by_page", "WITH" + t.HITS + "," + MERGED + "SELECT * FROM merged")
def hits_merged_by_page(spark, sf_dir):
    return fusion.merge_pages(t.hits(spark, sf_dir))


@query("hits_numbered", "WITH" + t.HITS + "," + MERGED + """
SELECT query_id, source, page, similarity, CAST(row_number() OVER (PARTITION BY query_id
       ORDER BY similarity DESC, first_variant, first_rank, chunk_id) AS INT) AS rank FROM merged""")
def hits_numbered(spark, sf_dir):
    numbered = fusion.number_results(fusion.merge_pages(t.hits(spark, sf_dir)))
    return numbered.select("query_id", "source", "page", "similarity", "rank")


def asked_hits(spark, sf_dir):
    """Hits of the original query with its text."""
    asked = t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return t.hits(spark, sf_dir).where("variant_no = 0").join(asked, "query_id")


ASKED = """
asked_hits AS (SELECT hits.*, text AS query_text FROM hits JOIN benchmark ON item_id = query_id WHERE variant_no = 0)"""


@query("boost_query_terms", "WITH" + t.HITS + "," + ASKED + f"""
SELECT query_id, chunk_id, term_matches, round(least(1.0, similarity * (1 + term_matches * 0.1::DOUBLE)), 9) AS boosted,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(least(1.0, similarity * (1 + term_matches * 0.1::DOUBLE)), 9) DESC, rank) AS INT) AS new_rank
FROM (SELECT *, len(list_filter({sql_in(TERMS)}, lambda x: contains(lower(query_text), x) AND contains(lower(content), x)))::INT AS term_matches
      FROM asked_hits)""")
def boost_query_terms(spark, sf_dir):
    boosted = fusion.boost_terms(asked_hits(spark, sf_dir), F.col("query_text"), TERMS)
    boosted = boosted.withColumn("boosted", F.round("boosted", 9))
    return top_rows(boosted, ["query_id"], [-F.col("boosted"), F.col("rank")], t.TOP_K, "new_rank").select(
        "query_id", "chunk_id", "term_matches", "boosted", "new_rank"
    )


@query("boost_keywords", "WITH" + t.HITS + "," + ASKED + f"""
SELECT query_id, chunk_id, round(f, 6) AS technical_boost,
       round(CASE WHEN f > 1 THEN least(1.0, similarity * f) ELSE similarity END, 9) AS boosted
FROM (SELECT *, pow(1.2::DOUBLE, len(list_filter({sql_in(TERMS[:5])}, lambda x: contains(lower(query_text), x) AND contains(lower(content), x))))
         * pow(1.1::DOUBLE, len(list_filter({sql_in(TERMS[5:])}, lambda x: contains(lower(query_text), x) AND contains(lower(content), x)))) AS f
      FROM asked_hits)""")
def boost_keywords(spark, sf_dir):
    boosted = fusion.keyword_boost(asked_hits(spark, sf_dir), F.col("query_text"), TERMS[:5], TERMS[5:])
    return boosted.select(
        "query_id", "chunk_id", F.round("technical_boost", 6).alias("technical_boost"),
        F.round("boosted", 9).alias("boosted"),
    )


SECTIONED = ASKED + """,
sectioned AS (
  SELECT *, CASE WHEN contains(lower(content), 'that') THEN 'abstract' WHEN contains(lower(content), 'sich') THEN 'definition'
                 WHEN contains(lower(content), 'pour') THEN 'equation' ELSE 'regular' END AS section FROM asked_hits)"""


def sectioned_hits(spark, sf_dir):
    text = F.lower("content")
    return asked_hits(spark, sf_dir).withColumn(
        "section",
        F.when(text.contains("that"), "abstract").when(text.contains("sich"), "definition")
        .when(text.contains("pour"), "equation").otherwise("regular"),
    )


@query("boost_sections", "WITH" + t.HITS + "," + SECTIONED + """
SELECT query_id, chunk_id, section, round(f, 6) AS priority_boost,
       round(CASE WHEN f > 1 THEN least(1.0, similarity * f) ELSE similarity END, 9) AS boosted
FROM (SELECT *, (CASE section WHEN 'abstract' THEN 1.4 WHEN 'definition' THEN 1.5 WHEN 'equation' THEN 1.2 ELSE 1.0 END)::DOUBLE
              * (CASE source WHEN 'src1' THEN 1.3 WHEN 'src2' THEN 1.1 ELSE 1.0 END)::DOUBLE AS f FROM sectioned)""")
def boost_sections(spark, sf_dir):
    boosted = fusion.boost_sections(sectioned_hits(spark, sf_dir), SECTION_WEIGHTS, SOURCE_WEIGHTS)
    return boosted.select(
        "query_id", "chunk_id", "section", F.round("priority_boost", 6).alias("priority_boost"),
        F.round("boosted", 9).alias("boosted"),
    )


@query("search_quality_gate", "WITH" + t.HITS + """
SELECT query_id, variant_no, rank, chunk_id, similarity
FROM (SELECT *, max(similarity >= 0.8) OVER (PARTITION BY query_id, variant_no) AS a FROM hits)
WHERE similarity >= 0.8 OR (NOT a AND rank <= 3)""")
def search_quality_gate(spark, sf_dir):
    kept = search.quality_gate(t.hits(spark, sf_dir), ["query_id", "variant_no"], threshold=0.8)
    return kept.select("query_id", "variant_no", "rank", "chunk_id", "similarity")


@query("search_similarity_filter", "WITH" + t.HITS + """
SELECT query_id, variant_no, rank, chunk_id, similarity FROM hits WHERE similarity >= 0.75""")
def search_similarity_filter(spark, sf_dir):
    kept = search.similarity_filter(t.hits(spark, sf_dir), 0.75)
    return kept.select("query_id", "variant_no", "rank", "chunk_id", "similarity")


@query("answer_confidence", "WITH" + t.HITS + "," + SECTIONED + """
SELECT query_id, round(sq, 6) AS squared,
       round(least(1.0::DOUBLE, sq + CASE WHEN n > 5 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN m > 0.8 THEN 0.15::DOUBLE ELSE 0 END
                   + CASE WHEN s THEN 0.1::DOUBLE ELSE 0 END), 6) AS enhanced,
       round(least(0.95::DOUBLE, n * 0.2::DOUBLE + 0.3::DOUBLE), 6) AS by_count, round(mean, 6) AS top_mean
FROM (SELECT query_id, avg(similarity * similarity) FILTER (rank <= 3) AS sq, avg(similarity) FILTER (rank <= 3) AS mean,
             count(*) AS n, max(similarity) AS m, bool_or(section <> 'regular') AS s
      FROM sectioned GROUP BY query_id)""")
def answer_confidence(spark, sf_dir):
    flagged = sectioned_hits(spark, sf_dir).withColumns({
        "fused": F.col("rank") > 5, "reranked": F.col("similarity") > 0.8, "section_hit": F.col("section") != "regular",
    })
    return fusion.answer_confidence(flagged)


@query("search_result_rows", "WITH" + t.HITS + """
SELECT query_id, rank, coalesce(source, 'Unknown') AS source, coalesce(CAST(page AS VARCHAR), 'N/A') AS page,
       round(similarity, 3) AS similarity,
       CASE WHEN length(content) > 200 THEN concat(substr(content, 1, 200), '...') ELSE content END AS preview
FROM hits WHERE variant_no = 0 AND rank <= 5""")
def search_result_rows(spark, sf_dir):
    return fusion.result_rows(t.hits(spark, sf_dir).where("variant_no = 0"), 200, limit=5)
