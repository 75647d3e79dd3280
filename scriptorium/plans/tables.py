"""The tables the registered queries work on, derived from the given ones, with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import words
from scriptorium.functions.vectors import bag_of_words_batches
from scriptorium.operators.conversations import pair_turns
from scriptorium.operators.search import attach, nearest
from scriptorium.scale import at_most
from scriptorium.session import durable

_KEPT: dict[tuple, DataFrame] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of long rows; one that comes in fewer files than there are cores is dealt out to all of them."""
    df = read(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def _kept(build):
    """Build a derived table once per session and directory and keep it; a lost part is computed again."""

    def get(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (build.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _KEPT:
            _KEPT[key] = build(spark, sf_dir).persist()
        return _KEPT[key]

    return get


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per non-empty line of each document, five lines to a page."""
    lines = read_spread(spark, sf_dir, "documents").select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")
    ).where(F.trim("content") != "")
    return lines.select(
        F.md5(F.concat_ws("_", "doc_id", "chunk_index", F.substring(F.md5("content"), 1, 8))).alias("chunk_id"),
        "doc_id", "source", (F.floor(F.col("chunk_index") / 5) + 1).cast("int").alias("page"),
        "chunk_index", "content",
    )


CHUNKS = """
chunks AS (
  SELECT md5(concat_ws('_', doc_id, chunk_index, substr(md5(content), 1, 8))) AS chunk_id, doc_id, source,
         CAST(chunk_index // 5 + 1 AS INT) AS page, CAST(chunk_index AS INT) AS chunk_index, content
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content,
               unnest(range(len(string_split(text, chr(10))))) AS chunk_index FROM documents)
  WHERE trim(content) <> '')"""


def sql_tokens(text: str, min_length: int = 1) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{{min_length},}}')"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def sql_embed(text: str) -> str:
    bucket = "CAST('0x' || substr(md5(t), 1, 2) AS INT) % 64"
    return (
        f"list_transform([list_transform({sql_tokens(text)}, lambda t: {bucket})], lambda b:"
        " list_transform(range(64), lambda i: CAST(len(list_filter(b, lambda x: x = i)) AS DOUBLE)))[1]"
    )


def sql_cosine(a: str, b: str) -> str:
    return (
        f"CASE WHEN list_dot_product({a}, {a}) * list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b})"
        f" / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})) ELSE 0.0 END"
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", bag_of_words_batches(F.col("content")).alias("vec"))


CHUNK_VECTORS = CHUNKS + f""",
chunk_vectors AS (SELECT chunk_id, {sql_embed('content')} AS vec FROM chunks)"""


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants per benchmark text: the text, its first half and its second half in words."""
    base = read(spark, sf_dir, "benchmark").withColumn("w", words(F.col("text")))
    half = F.ceil(F.size("w") / 2).cast("int")
    return base.select(
        F.col("item_id").alias("query_id"),
        F.posexplode(F.array(
            F.col("text"),
            F.array_join(F.slice("w", F.lit(1), half), " "),
            F.array_join(F.slice("w", half + 1, F.size("w")), " "),
        )).alias("variant_no", "query_text"),
    )


QUERY_TEXTS = f"""
query_texts AS (
  SELECT item_id AS query_id, CAST(unnest([0, 1, 2]) AS INT) AS variant_no,
         unnest([text, array_to_string(w[1:h], ' '), array_to_string(w[h + 1:], ' ')]) AS query_text
  FROM (SELECT item_id, text, w, CAST(ceil(len(w) / 2.0) AS INT) AS h
        FROM (SELECT item_id, text, {sql_words('text')} AS w FROM benchmark)))"""

TOP_K = 10


@_kept
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best chunks for each query variant."""
    asked = query_texts(spark, sf_dir)
    found = nearest(
        asked.withColumn("vec", bag_of_words_batches(F.col("query_text"))), chunk_vectors(spark, sf_dir),
        TOP_K, ["query_id", "variant_no"], "chunk_id",
    )
    bound = asked.count() * TOP_K
    full = attach(found, chunks(spark, sf_dir), "chunk_id", bound)
    return full.select(
        "query_id", "variant_no", "rank", "chunk_id", "content", "doc_id", "source", "page", "similarity"
    )


HITS = CHUNK_VECTORS + "," + QUERY_TEXTS + f""",
query_vectors AS (SELECT query_id, variant_no, {sql_embed('query_text')} AS qvec FROM query_texts),
scored AS (
  SELECT query_id, variant_no, chunk_id, round({sql_cosine('qvec', 'vec')}, 6) AS similarity
  FROM query_vectors, chunk_vectors),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY similarity DESC, chunk_id) AS rank
  FROM scored QUALIFY rank <= {TOP_K}),
hits AS (
  SELECT query_id, variant_no, CAST(rank AS INT) AS rank, chunk_id, content, doc_id, source, page, similarity
  FROM ranked JOIN chunks USING (chunk_id))"""


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per label with four variants: the mean vector of every fourth member."""
    parts = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("query_id"), F.pmod("vec_id", F.lit(4)).cast("int").alias("variant_no"),
        F.posexplode("embedding").alias("i", "x"),
    )
    means = parts.groupBy("query_id", "variant_no", "i").agg(
        F.round(F.avg(F.col("x").cast("double")), 9).alias("m")
    )
    ordered = means.groupBy("query_id", "variant_no").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
    return ordered.select("query_id", "variant_no", F.col("s.m").alias("vec"))


VECTOR_QUERIES = """
vector_queries AS (
  SELECT query_id, variant_no, list(m ORDER BY i) AS qvec
  FROM (SELECT label AS query_id, CAST(vec_id % 4 AS INT) AS variant_no, i,
               round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS m
        FROM embeddings, range(1, 65) AS d(i) GROUP BY ALL)
  GROUP BY ALL)"""


def vector_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


VECTOR_HITS = VECTOR_QUERIES + f""",
vector_scored AS (
  SELECT query_id, variant_no, vec_id, round({sql_cosine('qvec', 'CAST(embedding AS DOUBLE[])')}, 6) AS similarity
  FROM vector_queries, embeddings),
vector_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, variant_no ORDER BY similarity DESC, vec_id) AS rank
  FROM vector_scored QUALIFY rank <= {TOP_K})"""


@_kept
def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(
        vector_queries(spark, sf_dir), vector_corpus(spark, sf_dir), TOP_K, ["query_id", "variant_no"], "vec_id"
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question–answer turns of the conversations."""
    return pair_turns(read(spark, sf_dir, "conversations"))


TURNS = """
turns AS (
  SELECT conv_id AS conversation_id, turn, question, answer,
         CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS turn_no,
         TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS ts
  FROM (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).withColumn("response_id", F.concat_ws("-", "conversation_id", "turn"))


def nearest_chunks(spark: SparkSession, sf_dir: str, questions: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest chunks of each question."""
    vectors = questions.select("response_id", bag_of_words_batches(F.col("question")).alias("vec"))
    return nearest(vectors, chunk_vectors(spark, sf_dir), k, ["response_id"], "chunk_id")


def marked(name: Column, page: Column) -> Column:
    """The answer with a citation of a source by name and page, or a measured value."""
    return (
        F.when(F.col("conversation_id") % 3 == 0, F.concat(
            F.col("answer"), F.lit(" Eh ["), name, F.lit(", p."), page.cast("string"), F.lit("]. End.")
        ))
        .when(F.col("conversation_id") % 3 == 1, F.concat(F.lit("Conforme "), name, F.lit(", "), F.col("answer")))
        .otherwise(F.concat(F.col("answer"), F.lit(" That = "), (F.col("turn") * 3).cast("string"), F.lit(",5 of.")))
    )


@_kept
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions with their three best chunks; answers get a citation of one source and a measured value."""
    found = nearest_chunks(spark, sf_dir, asked(spark, sf_dir), 3)
    hits = chunks(spark, sf_dir).join(found, "chunk_id")
    packed = hits.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("chunk_id").alias("source_id"), F.col("source").alias("name"), "page", "content",
        F.col("similarity").alias("score"),
    ))).alias("sources"))
    first = F.get("sources", F.lit(0))
    return asked(spark, sf_dir).join(packed, "response_id").select(
        "response_id", "conversation_id", "turn_no", "question", marked(first["name"], first["page"]).alias("answer"), "sources", "ts"
    )


def answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``asked`` that ``responses`` has, without a search: any question has a nearest chunk where there are chunks."""
    rows = asked(spark, sf_dir)
    if at_most(chunks(spark, sf_dir), 0):
        return rows.limit(0)
    return rows.join(rows.where(F.col("question").isNotNull()).select("response_id"), "response_id", "left_semi")


def with_first_source(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Rows of ``answerable`` with name, page and score of their best chunk."""
    hits = chunks(spark, sf_dir).join(nearest_chunks(spark, sf_dir, rows, 1), "chunk_id")
    order = F.struct("chunk_id", F.col("source").alias("name"), "page", "content", F.col("similarity").alias("score"))
    best = hits.groupBy("response_id").agg(F.min(order).alias("first"))
    return rows.join(best.select("response_id", "first.name", "first.page", "first.score"), "response_id")


#: Documents of which an answer above a similarity is looked for first.
FIRST_DOCUMENTS = 16_384


def sure_ids(spark: SparkSession, sf_dir: str, rows: DataFrame, least: float) -> DataFrame:
    """Ids of the rows with a chunk at a similarity of at least ``least``.

    One such chunk is enough, whichever it is, so some documents are looked through first and all of them only for the questions that
    are still without one.
    """
    questions = rows.select("response_id", bag_of_words_batches(F.col("question")).alias("vec"))
    parts = max(1, read(spark, sf_dir, "documents").count() // FIRST_DOCUMENTS)
    some = chunks(spark, sf_dir).where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    some = some.select("chunk_id", bag_of_words_batches(F.col("content")).alias("vec"))
    early = durable(nearest(questions, some, 1, ["response_id"], "chunk_id", min_similarity=least).select("response_id"))
    left = durable(questions.join(early, "response_id", "left_anti"))
    if parts == 1 or at_most(left, 0):
        return early
    late = nearest(left, chunk_vectors(spark, sf_dir), 1, ["response_id"], "chunk_id", min_similarity=least)
    return early.unionByName(late.select("response_id"))


RESPONSES = CHUNK_VECTORS + "," + TURNS + f""",
asked AS (SELECT *, concat_ws('-', conversation_id, turn) AS response_id, {sql_embed('question')} AS qvec FROM turns),
response_scored AS (
  SELECT response_id, chunk_id, round({sql_cosine('qvec', 'vec')}, 6) AS similarity FROM asked, chunk_vectors),
response_hits AS (
  SELECT response_id, CAST(row_number() OVER (PARTITION BY response_id ORDER BY similarity DESC, chunk_id) AS INT) AS rank, chunk_id, similarity
  FROM response_scored QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY similarity DESC, chunk_id) <= 3),
sources AS (
  SELECT response_id, rank, rank - 1 AS source_no, chunk_id AS source_id, source AS name, page, content, similarity AS score,
         CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS excerpt
  FROM response_hits JOIN chunks USING (chunk_id)),
responses AS (
  SELECT a.response_id, conversation_id, turn_no, question,
         CASE conversation_id % 3 WHEN 0 THEN answer || ' Eh [' || name || ', p.' || page || ']. End.'
              WHEN 1 THEN 'Conforme ' || name || ', ' || answer ELSE answer || ' That = ' || CAST(turn * 3 AS VARCHAR) || ',5 of.' END AS answer, ts
  FROM asked a JOIN sources s ON s.response_id = a.response_id AND s.rank = 1),
source_lists AS (SELECT response_id, list(content ORDER BY rank) AS sources FROM sources GROUP BY response_id)"""
