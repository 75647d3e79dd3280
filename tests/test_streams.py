"""Streams over several batches give the batch results."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from scriptorium.operators import feedback
from scriptorium.plans.dialogue import rated
from scriptorium.plans.tables import read
from scriptorium.streaming import jobs


@pytest.fixture(scope="module")
def events_dir(spark, tmp_path_factory):
    """The events in time order, four files, so that a stream takes four batches."""
    path = tmp_path_factory.mktemp("events")
    events = read(spark, SF_DIR, "events")
    for i in range(4):
        part = events.where(F.floor(F.col("event_id") / 250) == i)
        part.coalesce(1).write.mode("append").parquet(str(path))
    return str(path), events.schema


def in_batches(spark, events_dir):
    path, schema = events_dir
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_ratings(spark, events_dir, tmp_path):
    sums = jobs.running_ratings(rated(spark, SF_DIR, in_batches(spark, events_dir)))
    out = jobs.run_to_end(sums, f"{tmp_path}/out", f"{tmp_path}/state", "complete")
    assert rows(feedback.performance_rates(out)) == rows(feedback.performance(rated(spark, SF_DIR)))


def test_patterns_in_batches(spark, events_dir, tmp_path):
    candidates = feedback.pattern_candidates(rated(spark, SF_DIR, in_batches(spark, events_dir)))
    query = jobs.update_patterns(candidates, f"{tmp_path}/out", f"{tmp_path}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    out = feedback.pattern_rows(jobs.last_patterns(spark, f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 4
    wanted = feedback.consolidate(feedback.pattern_candidates(rated(spark, SF_DIR)))
    assert rows(out.drop("number", "confidence")) == rows(wanted.drop("number", "confidence"))
    got = {r.pattern_id: r for r in out.collect()}
    for r in wanted.collect():
        assert got[r.pattern_id].confidence == pytest.approx(r.confidence, abs=1e-5)
        assert got[r.pattern_id].number == pytest.approx(r.number, abs=1e-4)


def test_a_batch_writes_only_the_buckets_of_its_patterns(spark, tmp_path):
    candidates = feedback.pattern_candidates(rated(spark, SF_DIR)).persist()
    one = candidates.select("pattern_id").orderBy("pattern_id").first().pattern_id
    first, second = candidates, candidates.where(F.col("pattern_id") == one).withColumn("feedback_id", F.col("feedback_id") + 10**9)
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(candidates.schema).parquet(f"{tmp_path}/in")
        jobs.update_patterns(stream, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.where("batch = 0").select("bucket").distinct().count() > 1
    assert written.where("batch = 1").select("bucket").distinct().count() == 1
    out = {r.pattern_id: r.support_count for r in feedback.pattern_rows(jobs.last_patterns(spark, f"{tmp_path}/out")).collect()}
    counts = {r.pattern_id: r["count"] for r in candidates.groupBy("pattern_id").count().collect()}
    assert out == {k: v * (2 if k == one else 1) for k, v in counts.items()}
    # a batch without candidates keeps all patterns
    candidates.where("false").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(candidates.schema).parquet(f"{tmp_path}/in")
    jobs.update_patterns(stream, f"{tmp_path}/out", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert jobs.last_patterns(spark, f"{tmp_path}/out").count() == len(counts)
    assert jobs._state_before(spark, f"{tmp_path}/out", 3).count() == len(counts)
    # a batch that is run again starts from the state before it
    again = jobs._state_before(spark, f"{tmp_path}/out", 1)
    assert {r.pattern_id: r.support_count for r in feedback.pattern_rows(again).collect()} == counts


def test_index_again_adds_nothing(spark, tmp_path):
    docs = read(spark, SF_DIR, "documents")
    docs.limit(40).coalesce(1).write.parquet(f"{tmp_path}/in")
    def run(state):
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        jobs.index_documents(stream, f"{tmp_path}/out", f"{tmp_path}/{state}", 300, "\n").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run("one") == run("two") > 40


def test_late_rows_are_dropped(spark, tmp_path):
    def write(n, ts):
        spark.createDataFrame([("E", ts)], "error_type string, ts string").select("error_type", F.to_timestamp("ts").alias("ts")).coalesce(
            1).write.mode("append").parquet(f"{tmp_path}/in/b{n}")
    for n, ts in enumerate(("2024-01-01 00:10:00", "2024-01-01 06:00:00", "2024-01-01 00:20:00", "2024-01-01 12:00:00")):
        write(n, ts)
        stream = spark.readStream.schema("error_type string, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = jobs.run_to_end(jobs.rolling_errors(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(str(r.window_start), r.errors) for r in out.collect()}
    assert ("2024-01-01 00:00:00", 1) in got and ("2024-01-01 06:00:00", 1) in got


def test_known_chunks_are_not_embedded_again(spark, tmp_path):
    docs = read(spark, SF_DIR, "documents")
    docs.limit(20).coalesce(1).write.parquet(f"{tmp_path}/in")
    count = spark.sparkContext.accumulator(0)

    def embedder(text):
        @F.udf("array<double>")
        def one(t):
            count.add(1)
            return [float(len(t))]

        return one(text)

    for state in ("one", "two"):
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        jobs.index_documents(stream, f"{tmp_path}/out", f"{tmp_path}/{state}", 300, "\n", embedder).trigger(availableNow=True).start().awaitTermination()
        if state == "one":
            first = count.value
    assert count.value == first > 0


def test_missing_state_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs._state_before(spark, f"{tmp_path}/none", 3)
    assert jobs._state_before(spark, f"{tmp_path}/none", 0) is None


def test_only_a_missing_path_means_no_index(spark, tmp_path):
    from scriptorium.sources.index import read_index

    assert read_index(spark, f"{tmp_path}/none") is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet at all, and long enough to have a footer")
    with pytest.raises(Exception, match="footer|Parquet|parquet"):
        read_index(spark, f"{tmp_path}/bad").count()
