"""Findings of round 4."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from scriptorium.operators import oplog, quality
from scriptorium.plans import answers, operations
from scriptorium.plans import tables as t
from scriptorium.streaming import jobs


def test_indexing_keeps_no_chunks(spark, tmp_path, monkeypatch):
    """Chunks aren't persisted, and each is dealt out once at most: with its document."""
    rows = [(1, "a", "One line here.\nAnother."), (1, "a", "One line here.\nAnother."), (1, "b", "Other words."), (2, "a", None), (None, "c", "Nameless."), (None, "c", "Nameless.")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/in")

    def kept(*_):
        raise AssertionError("chunks are kept")

    frame, plans = type(docs), []
    drop = frame.dropDuplicates

    def dropped(df, names):
        plans.append(drop(df, names)._jdf.queryExecution().executedPlan().toString())
        return drop(df, names)

    monkeypatch.setattr(frame, "persist", kept)
    monkeypatch.setattr(frame, "dropDuplicates", dropped)
    for state in ("one", "two"):
        stream = spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in")
        jobs.index_documents(stream, f"{tmp_path}/out", f"{tmp_path}/{state}", 10, "\n").trigger(availableNow=True).start().awaitTermination()
    assert [p.count("Exchange") for p in plans] == [1, 1], plans
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert stored.count() == stored.select("chunk_id").distinct().count()
    got = sorted((str(r.doc_id), r.chunk_index, r.content) for r in stored.collect())
    assert got == [("1", 0, "One line here."), ("1", 0, "Other words."), ("1", 1, "Another."), ("None", 0, "Nameless.")]
    assert stored.where(F.size("vec") != 64).count() == 0


@pytest.fixture
def searched(monkeypatch):
    """How many questions each search gets, and how many hits it is to give."""
    seen, whole = [], t.nearest

    def nearest(queries, corpus, k, *a, **b):
        seen.append((queries.count(), k))
        return whole(queries, corpus, k, *a, **b)

    monkeypatch.setattr(t, "nearest", nearest)
    return seen


@pytest.fixture
def renamed(spark, tmp_path):
    """The smallest tables with other sources of the documents."""
    def build(source):
        t.read(spark, SF_DIR, "documents").withColumn("source", source).write.parquet(f"{tmp_path}/documents.parquet")
        t.read(spark, SF_DIR, "conversations").write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return build


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def routed_by_responses(spark, sf_dir):
    """Routing of all responses with their three sources, as it was before."""
    r, c = t.responses(spark, sf_dir), F.col("conversation_id")
    kinds = r.select("response_id", F.when(c % 4 == 0, "definition").otherwise("procedural").alias("question_type"))
    first = F.get("sources", F.lit(0))["score"].alias("confidence")
    retrieved = r.where(c % 3 != 2).select("response_id", "answer", first, (F.col("turn_no") + 1).cast("int").alias("n_sources"))
    generated = r.where(c % 5 != 1).select("response_id", F.col("question").alias("answer"))
    return oplog.route_answers(kinds, retrieved, generated, extra_chars=200, blend_chars=150)


@pytest.mark.parametrize("source, sure, documents", [("source", 0.93, 20), ("if(doc_id % 3 = 0, null, source)", 0.7, 16_384)])
def test_routing_looks_for_no_more_than_it_needs(spark, renamed, searched, monkeypatch, source, sure, documents):
    sf_dir = renamed(F.expr(source))
    monkeypatch.setattr(operations, "SURE", sure)
    monkeypatch.setattr(t, "FIRST_DOCUMENTS", documents)
    monkeypatch.setattr(oplog.route_answers, "__defaults__", (sure, *oplog.route_answers.__defaults__[1:]))
    questions = t.answerable(spark, sf_dir)
    some = questions.where("conversation_id % 3 <> 2").count()
    got = rows(operations.routed(spark, sf_dir)), rows(operations.answer_mode_counts(spark, sf_dir))
    assert searched[0] == (some, 1) and some < questions.count()
    if source == "source":
        assert all(n <= questions.where("conversation_id % 3 <> 2 and conversation_id % 4 = 0").count() for n, _ in searched[1:])
    want = routed_by_responses(spark, sf_dir)
    assert got == (rows(want), rows(oplog.mode_counts(want)))


@pytest.mark.parametrize("source, searches", [("source", 0), ("case doc_id % 3 when 0 then 'a. Long and b' when 1 then 'x' end", 1)])
def test_clarity_is_searched_only_where_the_source_matters(spark, renamed, searched, source, searches):
    sf_dir = renamed(F.expr(source))
    got = rows(answers.quality_clarity(spark, sf_dir))
    assert len(searched) == searches and all(k == 1 for _, k in searched)
    scored = t.responses(spark, sf_dir).select("response_id", F.round(quality.clarity(F.col("answer"), answers.V), 6).alias("score"))
    assert got == rows(scored)
