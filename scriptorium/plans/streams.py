"""Registered queries: streaming jobs run over the given tables until nothing is left."""

from pyspark.sql import functions as F

from scriptorium.operators import feedback
from scriptorium.plans import tables as t
from scriptorium.plans.dialogue import PATTERNS, PERFORMANCE, RATED, rated, with_utc
from scriptorium.plans.documents import clean_sql, paragraph_sql
from scriptorium.plans.operations import log
from scriptorium.plans.registry import query
from scriptorium.session import new_folder
from scriptorium.sources.index import read_index
from scriptorium.streaming import jobs


def stream(spark, sf_dir, name: str):
    """A table of the directory as a file stream, be it one file or a folder of parts.

    As a pattern the path may name either: a plain one is taken as a folder's, which a single file isn't.
    """
    schema = t.read(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")


def event_stream(spark, sf_dir):
    return with_utc(stream(spark, sf_dir, "events"))


@query("stream_ratings", "WITH" + RATED + PERFORMANCE)
def stream_ratings(spark, sf_dir):
    at = new_folder(spark)
    sums = jobs.running_ratings(rated(spark, sf_dir, event_stream(spark, sf_dir)))
    return feedback.performance_rates(jobs.run_to_end(sums, f"{at}/out", f"{at}/state", "complete"))


@query("stream_patterns", "WITH RECURSIVE" + PATTERNS + "SELECT * FROM patterns")
def stream_patterns(spark, sf_dir):
    at = new_folder(spark)
    candidates = feedback.pattern_candidates(rated(spark, sf_dir, event_stream(spark, sf_dir)))
    jobs.update_patterns(candidates, f"{at}/out", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return feedback.pattern_rows(jobs.last_patterns(spark, f"{at}/out"))


@query("stream_sessions", """
WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
s AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM g)
SELECT user_id AS conversation_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 86400000000 AS closed, count(*) AS turns FROM s GROUP BY user_id, n""")
def stream_sessions(spark, sf_dir):
    at = new_folder(spark)
    turns = event_stream(spark, sf_dir).select(F.col("user_id").alias("conversation_id"), "ts")
    done = jobs.run_to_end(jobs.closing_sessions(turns), f"{at}/out", f"{at}/state")
    done = done.unionByName(jobs.open_sessions(spark, f"{at}/state"))
    return done.withColumns({"started": F.unix_micros("started"), "closed": F.unix_micros("closed")})


@query("stream_errors", """
WITH e AS (SELECT epoch_us(ts) // 3600000000 * 3600000000 AS w, ts, 'Err' || (CAST(json_extract(props, '$.k') AS BIGINT) % 7) AS error_type FROM events WHERE event_type = 'error')
SELECT w AS window_start, error_type, count(*) AS errors FROM e GROUP BY ALL""")
def stream_errors(spark, sf_dir):
    at = new_folder(spark)
    errors = log(spark, sf_dir, event_stream(spark, sf_dir)).where("op = 'error'")
    done = jobs.run_to_end(jobs.rolling_errors(errors), f"{at}/out", f"{at}/state")
    done = done.unionByName(jobs.open_errors(spark, f"{at}/state"))
    return done.withColumn("window_start", F.unix_micros("window_start"))


@query("stream_embed_once", f"""
SELECT md5(text) AS text_md5, array_to_string(list_transform({t.sql_embed('any_value(text)')}, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS counts
FROM documents GROUP BY md5(text)""")
def stream_embed_once(spark, sf_dir):
    at = new_folder(spark)
    texts = stream(spark, sf_dir, "documents").select("text", F.timestamp_seconds(F.lit(1704067200) + F.coalesce("doc_id", F.lit(0))).alias("ts"))
    done = jobs.run_to_end(jobs.embed_once(texts), f"{at}/out", f"{at}/state")
    counts = F.array_join(F.transform("vec", lambda x: x.cast("string")), ",")
    return done.select("text_md5", counts.alias("counts"))


@query("stream_index", f"""
SELECT md5(concat_ws('_', CAST(doc_id AS VARCHAR), CAST(chunk_index AS VARCHAR), substr(md5(content), 1, 8))) AS chunk_id, doc_id, source, chunk_index, content
FROM ({paragraph_sql(f"page_texts AS (SELECT doc_id, 1 AS page, {clean_sql('text')} AS content FROM documents)")}) JOIN documents USING (doc_id)""")
def stream_index(spark, sf_dir):
    at = new_folder(spark)
    documents = stream(spark, sf_dir, "documents").select("doc_id", "source", "text")
    jobs.index_documents(documents, f"{at}/out", f"{at}/state", 300, "\n").trigger(availableNow=True).start().awaitTermination()
    return read_index(spark, f"{at}/out").drop("vec")
