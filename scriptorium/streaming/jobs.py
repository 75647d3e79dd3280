"""Structured Streaming versions of the stateful routines.

Running figures use Spark's own streaming aggregation, which combines rows before the shuffle, so a type that holds
most of the stream stays cheap.  Results land in tables keyed by batch, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from scriptorium.functions.cleaning import clean
from scriptorium.functions.vectors import Embedder, bag_of_words, bag_of_words_batches
from scriptorium.operators.chunking import chunk_id, pack_paragraphs
from scriptorium.operators.embedding import embed_with_cache
from scriptorium.operators.feedback import compose_updates, performance_sums, then, update_map
from scriptorium.scale import number_rows
from scriptorium.session import durable
from scriptorium.sources.index import read_index

LATENESS = "1 hour"


def index_documents(
    documents: DataFrame, path: str, checkpoint: str, size: int = 800, separator: str = "\n\n",
    embedder: Embedder = bag_of_words_batches,
):
    """Clean, chunk, embed and append arriving ``documents(doc_id, source, text)``.

    Documents are dealt by id, so that equal chunks meet without being dealt again, and chunks pass to the index as they come: none
    is kept.  The default embedder counts each chunk; any other is asked once for each text.
    """
    def add(batch: DataFrame, _: int) -> None:
        parts = max(batch.sparkSession.sparkContext.defaultParallelism, batch.rdd.getNumPartitions())
        cleaned = batch.repartition(parts, "doc_id").select("doc_id", "source", clean(F.col("text")).alias("content"))
        packed = cleaned.select(
            "doc_id", "source", F.posexplode(pack_paragraphs(F.col("content"), size, separator=separator)).alias("chunk_index", "c")
        ).select("doc_id", "source", "chunk_index", F.col("c.content").alias("text"))
        named = packed.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("text")))
        fresh = named.dropDuplicates(["doc_id", "chunk_index", "chunk_id"])
        index = read_index(batch.sparkSession, path)
        if index is not None:
            # what the index holds is dropped before it is embedded again
            fresh = fresh.join(index.select("chunk_id"), "chunk_id", "left_anti")
        if embedder in (bag_of_words, bag_of_words_batches):
            # to count a text again is less work than to bring its counts to all its chunks
            vectors = fresh.withColumn("vec", embedder(F.col("text")))
        else:
            vectors, _new = embed_with_cache(durable(fresh), None, embedder)
        vectors.select("chunk_id", "doc_id", "source", "chunk_index", F.col("text").alias("content"), "vec").write.mode("append").parquet(path)

    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def running_ratings(rated: DataFrame) -> DataFrame:
    """The sums of ratings per question type so far; the batch figures over the same rows."""
    return performance_sums(rated)


def update_patterns(candidates: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """Pattern state per batch: the batch's candidates composed in (ts, id) order after the last state.

    State lies in buckets of pattern ids.  A batch reads and writes only the buckets of its own candidates, as
    ``path/batch=N/bucket=B``, so its cost follows its rows and the touched buckets, not all patterns ever seen; a
    bucket's newest batch is current.  Running a batch again replaces what it wrote.
    """
    def apply(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        numbered = number_rows(batch, ["pattern_id"], [F.col("ts"), F.col("feedback_id")], "no")
        touched = _bucket(numbered, buckets).select("bucket").distinct()
        state = _state_before(spark, path, batch_no, [r.bucket for r in touched.collect()])
        if state is None:
            placed = numbered.withColumn("offset", F.lit(0))
        else:
            known = state.select("pattern_id", F.lit(1).alias("offset"))
            placed = numbered.join(known, "pattern_id", "left").fillna(0, ["offset"])
        fresh = compose_updates(placed.withColumn("step", update_map(F.col("no") + F.col("offset"))))
        if state is not None:
            old = state.select("pattern_id", "pattern_type", F.col("step").alias("old"))
            joined = old.join(fresh, ["pattern_id", "pattern_type"], "full_outer")
            fresh = joined.select(
                "pattern_id", "pattern_type",
                F.when(F.col("old").isNull(), F.col("step")).when(F.col("step").isNull(), F.col("old"))
                .otherwise(then(F.col("old"), F.col("step"))).alias("step"),
            )
        _bucket(fresh, buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_no}")

    return candidates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _bucket(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("pattern_id"), F.lit(buckets)).cast("int"))


def _state_before(spark: SparkSession, path: str, batch_no: int, touched: list[int] | None = None) -> DataFrame | None:
    """The state that ``batch_no`` goes on from, of the touched buckets if given; none for the first batch.

    A later batch without its predecessor's folder would forget patterns, so it fails.  The newest batch of a bucket
    is found from partition values alone: no column is read, but all folders are listed and footers of earlier batches of
    the touched buckets opened.  Old batches stay until the user removes them.
    """
    if batch_no == 0:
        return None
    if not _stored(spark, f"{path}/batch={batch_no - 1}")[0]:
        raise ValueError(f"the state of batch {batch_no - 1} is missing under {path}")
    every = _stored(spark, path)[1]
    if every is None:
        return None
    every = every.where(F.col("batch") < batch_no)
    if touched is not None:
        every = every.where(F.col("bucket").isin(touched))
    return _newest(every)


def _stored(spark: SparkSession, path: str) -> tuple[bool, DataFrame | None]:
    """Whether the folder is there, and its rows; a batch without candidates leaves a folder without files."""
    try:
        rows = read_index(spark, path)
        return rows is not None, rows
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return True, None


def _newest(every: DataFrame) -> DataFrame:
    """The rows of each bucket's last batch; buckets and batches are partitions of the table, so they are few."""
    last = [(r.bucket, r.batch) for r in every.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()]
    wanted = reduce(lambda a, b: a | b, [(F.col("bucket") == k) & (F.col("batch") == n) for k, n in last], F.lit(False))
    return every.where(wanted).drop("batch", "bucket")


def last_patterns(spark: SparkSession, path: str) -> DataFrame:
    """The current state: the newest batch of every bucket."""
    return _newest(spark.read.parquet(path))


def closing_sessions(turns: DataFrame, idle: str = "24 hours", lateness: str = LATENESS) -> DataFrame:
    """Conversation sessions, given out once the watermark is past ``idle`` after their last turn."""
    return turns.withWatermark("ts", lateness).groupBy(F.session_window("ts", idle), "conversation_id").agg(
        F.count("*").alias("turns")
    ).select(
        "conversation_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("closed"),
        "turns",
    )


def rolling_errors(errors: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Errors per type and window."""
    return errors.withWatermark("ts", lateness).groupBy(F.window("ts", window), "error_type").agg(
        F.count("*").alias("errors")
    ).select(F.col("window.start").alias("window_start"), "error_type", "errors")


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The sessions that ``closing_sessions`` has not given out yet, read from its state; needs a batch to have run."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        "key.conversation_id", F.col("value.session_window.start").alias("started"), F.col("value.session_window.end").alias("closed"),
        F.col("value.count").alias("turns"),
    )


def open_errors(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The windows that ``rolling_errors`` has not given out yet, read from its state; needs a batch to have run."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.window.start").alias("window_start"), "key.error_type", F.col("value.count").alias("errors"))


def embed_once(texts: DataFrame, lateness: str = LATENESS, embedder: Embedder = bag_of_words) -> DataFrame:
    """The vector of each new text; repeats within the watermark are dropped."""
    keyed = texts.withColumn("text_md5", F.md5("text")).withWatermark("ts", lateness)
    return keyed.dropDuplicatesWithinWatermark(["text_md5"]).select("text_md5", embedder(F.col("text")).alias("vec"))


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available and return the result table.

    Complete results replace the table batch by batch, others are appended.
    """
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        replace: Callable[[DataFrame, int], None] = lambda b, _: b.write.mode("overwrite").parquet(path)
        writer = stream.writeStream.foreachBatch(replace).outputMode(mode)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
