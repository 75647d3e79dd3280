"""Registered queries: re-ranking, diversity, full search, context assembly and compression."""

from pyspark.sql import functions as F

from scriptorium.operators import context, rerank
from scriptorium.plans import sqltext as q
from scriptorium.plans import tables as t
from scriptorium.plans.questions import ASKED, asked_hits
from scriptorium.plans.registry import query
from scriptorium.plans.retrieval import TERMS

OVERLAP = (
    f"len(list_intersect(list_distinct({t.sql_tokens('query_text')}), {t.sql_tokens('content')}))"
    f" / len(list_distinct({t.sql_tokens('query_text')}))"
)


def rerank_sql(source: str, keys: str, similarity: str = "similarity") -> str:
    return f"""
rated AS (SELECT *, {similarity} AS original_similarity, round(1 / (1 + exp(-({OVERLAP}))), 6) AS pair_score FROM {source}),
mixed AS (SELECT * EXCLUDE (similarity), round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, original_similarity * 0.3::DOUBLE + pair_score * 0.7::DOUBLE)), 9) AS similarity FROM rated),
reranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY similarity DESC, rank) AS INT) AS new_rank FROM mixed)"""


@query("rerank_pairs", "WITH" + t.HITS + ", " + ASKED + "," + rerank_sql("asked_hits", "query_id") + """
SELECT query_id, chunk_id, original_similarity, pair_score, similarity, new_rank FROM reranked WHERE new_rank <= 5""")
def rerank_pairs(spark, sf_dir):
    ranked = rerank.rerank(asked_hits(spark, sf_dir), ["query_id"], 5)
    return ranked.select("query_id", "chunk_id", "original_similarity", "pair_score", "similarity", "new_rank")


def variant_hits(spark, sf_dir):
    return t.hits(spark, sf_dir).join(t.query_texts(spark, sf_dir), ["query_id", "variant_no"])


VARIANT_HITS = "variant_hits AS (SELECT hits.*, query_text FROM hits JOIN query_texts USING (query_id, variant_no))"


@query("rerank_batch", "WITH" + t.HITS + ", " + VARIANT_HITS + "," + rerank_sql("variant_hits", "query_id, variant_no") + """
SELECT query_id, variant_no, chunk_id, similarity, new_rank FROM reranked WHERE new_rank <= 5""")
def rerank_batch(spark, sf_dir):
    ranked = rerank.rerank(variant_hits(spark, sf_dir), ["query_id", "variant_no"], 5)
    return ranked.select("query_id", "variant_no", "chunk_id", "similarity", "new_rank")


def diverse_sql(source: str, rank: str, threshold: float) -> str:
    w = "list_distinct(" + t.sql_words("lower(content)") + ")"
    return f"""
listed AS (SELECT query_id, {rank} AS r, {w} AS w, count(*) OVER (PARTITION BY query_id) AS n FROM {source}),
walk AS (
  SELECT query_id, 1 AS r, true AS kept, [w] AS ws FROM listed WHERE r = 1
  UNION ALL
  SELECT l.query_id, l.r, x.k, CASE WHEN x.k THEN list_append(walk.ws, l.w) ELSE walk.ws END
  FROM walk JOIN listed l ON l.query_id = walk.query_id AND l.r = walk.r + 1,
  LATERAL (SELECT l.n <= 3 OR NOT list_bool_or(list_transform(walk.ws, lambda o: len(o) > 0 AND len(l.w) > 0 AND
     len(list_intersect(o, l.w)) / (len(o) + len(l.w) - len(list_intersect(o, l.w))) > {threshold}::DOUBLE)) AS k) x)"""


@query("diversity_filter", "WITH RECURSIVE" + t.HITS + ", " + ASKED + "," + diverse_sql("asked_hits", "rank", 0.3) + """
SELECT a.query_id, a.rank, a.chunk_id FROM asked_hits a JOIN walk ON walk.query_id = a.query_id AND walk.r = a.rank WHERE kept""")
def diversity_filter(spark, sf_dir):
    kept = rerank.diverse(asked_hits(spark, sf_dir), ["query_id"], threshold=0.3)
    return kept.select("query_id", "rank", "chunk_id")


def boost_sql(source: str) -> str:
    def both(terms):
        return f"len(list_filter({q.string_list(terms)}, lambda x: contains(lower(query_text), x) AND contains(lower(content), x)))"

    factor = f"pow(1.2::DOUBLE, {both(TERMS[:5])}) * pow(1.1::DOUBLE, {both(TERMS[5:])})"
    return f"""
boosted AS (SELECT * EXCLUDE (similarity, f), round(CASE WHEN f > 1 THEN least(1.0::DOUBLE, similarity * f) ELSE similarity END, 9) AS similarity
            FROM (SELECT *, {factor} AS f FROM {source}))"""


@query("rerank_multi_stage", "WITH RECURSIVE" + t.HITS + ", " + ASKED + "," + boost_sql("asked_hits") + ","
       + rerank_sql("boosted", "query_id") + "," + diverse_sql("reranked", "new_rank", 0.8) + """
SELECT a.query_id, a.chunk_id, a.similarity, a.new_rank FROM reranked a JOIN walk ON walk.query_id = a.query_id AND walk.r = a.new_rank WHERE kept""")
def rerank_multi_stage(spark, sf_dir):
    kept = rerank.multi_stage(asked_hits(spark, sf_dir), ["query_id"], TERMS[:5], TERMS[5:])
    return kept.select("query_id", "chunk_id", "similarity", "new_rank")


COMBINED = ASKED + """,
combined AS (
  SELECT query_id, min(query_text) AS query_text,
         string_agg(concat('[', coalesce(source, 'x'), ', p.', CAST(page AS VARCHAR), '] ', content), ' ' ORDER BY rank) AS combined
  FROM asked_hits GROUP BY query_id)"""


def combined(spark, sf_dir):
    lists = context.ranked_lists(asked_hits(spark, sf_dir), ["query_id", "query_text"])
    return lists.select("query_id", "query_text", context.combine(F.col("hits")).alias("combined"))


@query("context_combined", "WITH" + t.HITS + ", " + COMBINED + "SELECT query_id, combined FROM combined")
def context_combined(spark, sf_dir):
    return combined(spark, sf_dir).select("query_id", "combined")


GUARDED = r"string_split(regexp_replace(regexp_replace(combined, '\b(Fig|Table|Eq|Dr|Prof|et al)\.\s', '\1' || chr(2) || ' ', 'g'), '[.!?]+\s+', chr(1), 'g'), chr(1))"
IMPORTANCE = COMBINED + f""",
split AS (
  SELECT query_id, {t.sql_embed('query_text')} AS qv,
         list_filter(list_transform({GUARDED}, lambda x: {t.sql_strip("replace(x, chr(2), '.')")}), lambda s: length(s) >= 20) AS ss FROM combined),
sent AS (SELECT query_id, qv, len(ss) AS n, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM split),
feat AS (SELECT *, {t.sql_embed('sentence')} AS v, {t.sql_words('lower(sentence)')} AS w, {q.count_contained('lower(sentence)', TERMS)} AS k FROM sent),
importance AS (
  SELECT query_id, CAST(pos AS INT) AS pos, n, sentence, v,
         round(({t.sql_cosine('qv', 'v')}) * 0.4::DOUBLE + (k / len(w)) * 0.25::DOUBLE + (1.0::DOUBLE - pos / n * 0.3::DOUBLE) * 0.15::DOUBLE
           + (CASE WHEN len(w) BETWEEN 10 AND 30 THEN 1.0 WHEN len(w) < 10 THEN 0.7 ELSE 0.8 END)::DOUBLE * 0.1::DOUBLE
           + (len(list_distinct(w)) / len(w)) * 0.1::DOUBLE, 9) AS score FROM feat)"""


@query("sentence_importance", "WITH" + t.HITS + ", " + IMPORTANCE + """
SELECT query_id, pos, sentence, round(score, 6) AS score FROM importance""")
def sentence_importance(spark, sf_dir):
    scored = context.sentence_importance(combined(spark, sf_dir), ["query_id"], TERMS)
    return scored.select("query_id", "pos", "sentence", F.round("score", 6).alias("score"))


GREEDY = IMPORTANCE + f""",
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS r, length(sentence) AS len,
         greatest(1, CAST(floor(n * 0.8::DOUBLE) AS INT)) AS target FROM importance),
walk AS (
  SELECT query_id, r, true AS kept, [v] AS vs, len AS used, 1 AS c FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.query_id, o.r, x.k, CASE WHEN x.k THEN list_append(walk.vs, o.v) ELSE walk.vs END, walk.used + CASE WHEN x.k THEN o.len ELSE 0 END,
         walk.c + CASE WHEN x.k THEN 1 ELSE 0 END
  FROM walk JOIN ordered o ON o.query_id = walk.query_id AND o.r = walk.r + 1,
  LATERAL (SELECT walk.c < o.target AND walk.used + o.len <= 2000 AND
    round(list_max(list_transform(walk.vs, lambda z: {t.sql_cosine('z', 'o.v')})), 9) <= 0.8::DOUBLE AS k) x),
picked AS (SELECT ordered.*, kept FROM ordered JOIN walk USING (query_id, r)),
figures AS (
  SELECT query_id, count(*) AS n, count(*) FILTER (kept) AS k, string_agg(sentence, '. ' ORDER BY pos) FILTER (kept) || '.' AS text
  FROM picked GROUP BY query_id),
compressed AS (
  SELECT f.query_id, c.combined, CASE WHEN f.n <= 3 THEN c.combined ELSE f.text END AS compressed,
         CASE WHEN f.n <= 3 THEN 1.0 ELSE (SELECT avg(score) FROM picked p WHERE p.query_id = f.query_id AND p.r <= f.k) END AS relevance,
         CASE WHEN f.n <= 3 THEN f.n ELSE f.k END AS sentences_kept,
         CASE WHEN f.n <= 3 THEN 0 ELSE (SELECT count(*) FROM picked p WHERE p.query_id = f.query_id AND NOT EXISTS
            (SELECT 1 FROM picked z WHERE z.query_id = p.query_id AND z.kept AND z.sentence = p.sentence)) END AS sentences_removed,
         CASE WHEN f.n <= 3 THEN 'no_compression_needed' ELSE 'semantic_importance' END AS method
  FROM figures f JOIN combined c USING (query_id))"""


@query("context_compressed", "WITH RECURSIVE" + t.HITS + ", " + GREEDY + """
SELECT query_id, compressed, CASE WHEN relevance > 0.45 THEN compressed ELSE combined END AS accepted FROM compressed""")
def context_compressed(spark, sf_dir):
    done = context.compress(combined(spark, sf_dir), ["query_id"], terms=TERMS)
    accepted = context.accept(F.col("compressed"), F.col("combined"), F.col("relevance"), 0.45)
    return done.select("query_id", "compressed", accepted.alias("accepted"))


@query("context_compression_statistics", "WITH RECURSIVE" + t.HITS + ", " + GREEDY + """
SELECT query_id, method, CAST(length(combined) AS INT) AS original_length, CAST(length(compressed) AS INT) AS compressed_length,
       CAST(length(combined) - length(compressed) AS INT) AS saved,
       round(CASE WHEN method = 'no_compression_needed' THEN 1.0 ELSE length(compressed) / length(combined) END, 6) AS ratio,
       round(relevance, 6) AS relevance, CAST(sentences_kept AS INT) AS sentences_kept, CAST(sentences_removed AS INT) AS sentences_removed,
       round(relevance / CASE WHEN method = 'no_compression_needed' THEN 1.0 ELSE length(compressed) / length(combined) END, 6) AS efficiency
FROM compressed""")
def context_compression_statistics(spark, sf_dir):
    done = context.compress(combined(spark, sf_dir), ["query_id"], terms=TERMS)
    return context.compression_statistics(done, ["query_id"])


@query("context_budgeted", "WITH RECURSIVE" + t.HITS + ", " + ASKED + """,
blocks AS (SELECT query_id, rank, content, '[Documento ' || rank || ']' || chr(10) AS head FROM asked_hits),
walk AS (
  SELECT DISTINCT query_id, CAST(0 AS INT) AS r, '' AS text, false AS full_ FROM blocks
  UNION ALL
  SELECT b.query_id, b.rank,
    CASE WHEN full_ THEN text WHEN length(text) + length(head) + length(content) + 2 <= 600 THEN text || head || content || chr(10) || chr(10)
         WHEN 600 - length(text) - 50 > 100 THEN text || head || left(content, 600 - length(text) - 50) || '...' || chr(10) || chr(10) ELSE text END,
    full_ OR length(text) + length(head) + length(content) + 2 > 600
  FROM walk JOIN blocks b ON b.query_id = walk.query_id AND b.rank = walk.r + 1)
SELECT query_id, arg_max(text, r) AS context FROM walk GROUP BY query_id""")
def context_budgeted(spark, sf_dir):
    lists = context.ranked_lists(asked_hits(spark, sf_dir), ["query_id"])
    return lists.select("query_id", context.budgeted(F.col("hits.content"), 600).alias("context"))


@query("context_with_headers", "WITH" + t.HITS + ", " + ASKED + """
SELECT query_id, md5(string_agg('[Documento ' || rank || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank)) AS numbered_md5,
       md5(string_agg('(' || source || ', n.d.):' || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS cited_md5
FROM asked_hits GROUP BY query_id""")
def context_with_headers(spark, sf_dir):
    lists = context.ranked_lists(asked_hits(spark, sf_dir), ["query_id"])
    contents = F.col("hits.content")
    citations = F.transform("hits", lambda h: F.concat(F.lit("("), h["source"], F.lit(", n.d.)")))
    return lists.select(
        "query_id", F.md5(context.numbered_documents(contents)).alias("numbered_md5"),
        F.md5(context.cited_documents(contents, citations)).alias("cited_md5"),
    )
