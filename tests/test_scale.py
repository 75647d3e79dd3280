"""The split forms give the same rows as the plain ones, with a third of all rows under one key."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import scale
from scriptorium.operators import conversations, feedback, reuse, search, training


@pytest.fixture(scope="module")
def skewed(spark):
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"),
        (F.pmod(F.xxhash64("id"), F.lit(50))).alias("o"), "id",
        F.when(F.col("id") % 5 == 0, F.col("id")).alias("v"),
    )
    return rows.persist()


def order():
    return [F.col("o"), F.col("id")]


def same(a, b):
    columns = sorted(a.columns)
    left = sorted(map(str, a.select(columns).collect()))
    assert left == sorted(map(str, b.select(columns).collect()))
    return len(left)


def test_row_numbers(skewed):
    split = scale.number_rows(skewed, ["k"], order(), "n", parts=16)
    plain = skewed.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy(*order())))
    assert same(split, plain) == 6000


def test_row_numbers_of_whole_table(skewed):
    split = scale.number_rows(skewed, [], [-F.col("o"), F.col("id")], "n", parts=16)
    assert sorted(r.n for r in split.collect()) == list(range(1, 6001))
    ordered = [r.id for r in split.orderBy("n").collect()]
    assert ordered == [r.id for r in skewed.orderBy(F.col("o").desc(), "id").collect()]


def test_split_ranges_are_even(skewed):
    bounds = scale._bounds(skewed, order(), 16)
    sizes = skewed.groupBy("k", scale._range_no(order(), bounds, skewed).alias("r")).count()
    assert sizes.agg(F.max("count")).first()[0] < 6000 / 3 / 4


def test_running_total_and_last_known(skewed):
    w = Window.partitionBy("k").orderBy(*order()).rowsBetween(Window.unboundedPreceding, 0)
    total = scale.running_total(skewed, ["k"], order(), F.col("id"), "t", parts=16)
    same(total, skewed.withColumn("t", F.sum("id").over(w)))
    last = scale.last_known(skewed, ["k"], order(), F.col("v"), "l", parts=16)
    same(last, skewed.withColumn("l", F.last("v", ignorenulls=True).over(w)))


def test_medians_equal_sorting(skewed):
    x = F.when(F.col("id") % 7 > 0, (F.col("id") * 7919 % 1000) / 3)
    got = {r.k: r["median"] for r in scale.medians(skewed, ["k"], x).collect()}
    want = {r.k: r.m for r in skewed.groupBy("k").agg(F.percentile(x, 0.5).alias("m")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert abs(scale.medians(skewed, [], x).first()[0] - skewed.agg(F.percentile(x, 0.5)).first()[0]) < 1e-9
    assert scale.medians(skewed.limit(0), ["k"], x).collect() == [] and scale.medians(skewed.limit(0), [], x).first()[0] is None


def test_neighbours(skewed):
    def frame(w):
        return {
            "next": F.lead("id").over(w), "past": F.collect_list("id").over(w.rowsBetween(-3, -1)),
        }

    split = scale.with_neighbours(skewed, ["k"], order(), 3, 1, frame, segment=7, parts=16)
    plain = skewed.withColumns(frame(Window.partitionBy("k").orderBy(*order())))
    assert same(split, plain) == 6000


def test_small_side_is_counted(spark):
    df = spark.range(50)
    assert "broadcast" in scale.small_side(df, 50)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in scale.small_side(df, 49)._jdf.queryExecution().logical().toString()


def vectors(spark, n, seed):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, 16))
    data[: n // 3] = data[0]
    return data, spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "id long, vec array<double>")


def brute(q, v, k):
    sims = (q @ v.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :]
    sims = np.floor(sims * 1e6 + 0.5) / 1e6
    return {(i, j) for i, row in enumerate(sims) for j in sorted(range(len(row)), key=lambda j: (-row[j], j))[:k]}


@pytest.mark.parametrize("part_rows", [16_384, 37])
def test_nearest_equals_brute_force(spark, monkeypatch, part_rows):
    monkeypatch.setattr(search, "ROWS_AT_ONCE", 100)
    monkeypatch.setattr(search, "QUERY_TILE", 7)
    v, corpus = vectors(spark, 600, 1)
    q, asked = vectors(spark, 30, 2)
    asked = asked.withColumnRenamed("id", "q")
    found = search.nearest(asked, corpus.repartition(5), 8, ["q"], "id", part_rows=part_rows)
    assert {(r.q, r.id) for r in found.collect()} == brute(q, v, 8)


def test_nearest_with_floor_and_no_hits(spark):
    _, corpus = vectors(spark, 60, 1)
    _, asked = vectors(spark, 3, 2)
    found = search.nearest(asked.withColumnRenamed("id", "q"), corpus, 5, ["q"], "id", min_similarity=0.3)
    assert all(r.similarity >= 0.3 for r in found.collect())
    assert search.nearest(asked.limit(0).withColumnRenamed("id", "q"), corpus, 5, ["q"], "id").count() == 0


def test_rows_without_a_vector_and_zero_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, []), (5, [1.0, 0.0]), (5, [1.0, 0.0])]
    corpus = spark.createDataFrame(rows, "id long, vec array<double>")
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("b", None), (None, [0.0, 0.0])], "q string, vec array<double>")
    found = sorted(((r.q, r.id, r.similarity) for r in search.nearest(asked, corpus, 9, ["q"], "id").collect()), key=repr)
    assert found == sorted([("a", 1, 1.0), ("a", 5, 1.0), ("a", 5, 1.0), ("a", 3, 0.0), *[(None, i, 0.0) for i in (1, 3, 5, 5)]], key=repr)


def test_approximate_recall(spark):
    from scriptorium.plans import tables as t
    from scriptorium.plans.catalogue import QUERIES

    large = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.variant_no, r.vec_id) for r in t.vector_hits(spark, large).collect()}
    found = {(r.query_id, r.variant_no, r.vec_id) for r in QUERIES["vector_approximate"](spark, large).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    from scriptorium.sources import cells

    rng = np.random.default_rng(6)
    middles = rng.normal(size=(12, 16))
    v = middles[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.15
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    asked = corpus.where("id % 50 = 0").withColumnRenamed("id", "q")
    path = str(tmp_path / "index")
    centres = cells.train(corpus, "id")
    cells.write_index(corpus, "id", centres, path)
    exact = {(r.q, r.id) for r in search.nearest(asked, corpus, 10, ["q"], "id").collect()}
    near = cells.search_index(spark, path, asked, centres, 10, ["q"], "id", probe=4, part_rows=100)
    assert len(exact & {(r.q, r.id) for r in near.collect()}) / len(exact) >= 0.9
    one = cells.search_index(spark, path, asked.limit(1), centres, 10, ["q"], "id", probe=4)
    text = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in text.replace("isnotnull(cell#", "cell#") or "cell#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert spark.read.parquet(path).count() == 3000


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 7)).alias("pattern_id"),
        F.when(F.col("id") % 3 == 0, "source_preference").otherwise("query_preference").alias("pattern_type"),
        F.col("id").alias("feedback_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(100))).alias("ts"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).cast("int").alias("r0"),
        (F.col("id") % 13).cast("double").alias("number"), F.concat(F.lit("l"), F.col("id") % 4).alias("label"),
        (F.col("id") % 2 == 0).alias("flag"), F.concat(F.lit("t"), F.col("id") % 5).alias("question_type"),
    ).withColumn("rating", F.col("r0") + 1).drop("r0").persist()


def test_pattern_updates_equal_the_sequential_rule(candidates):
    state = {}
    for r in candidates.orderBy("ts", "feedback_id").collect():
        s = state.get(r.pattern_id)
        if s is None:
            start = 0.5 if r.pattern_type == "query_preference" else 0.6
            state[r.pattern_id] = [1, start, r.number, r.label, r.flag, r.question_type]
            continue
        s[0] += 1
        s[1] = min(1.0, s[1] + 0.1)
        if r.rating >= 4:
            s[2], s[3], s[4] = s[2] * 0.8 + r.number * 0.2, r.label, r.flag
        else:
            s[1] = max(0.1, s[1] - 0.05)
    for segment, parts in ((10_000, None), (7, 20)):
        done = feedback.consolidate(candidates, segment, parts=parts)
        got = {r.pattern_id: r for r in done.collect()}
        assert set(got) == set(state)
        for key, s in state.items():
            r = got[key]
            assert (r.support_count, r.label, r.flag, r.question_type) == (s[0], s[3], s[4], s[5])
            assert (r.confidence, r.number) == (pytest.approx(s[1], abs=1e-5), pytest.approx(s[2], abs=1e-5))


def test_split_lookups_sessions_and_turns(spark, monkeypatch):
    from conftest import SF_DIR

    from scriptorium.plans import tables as t
    from scriptorium.plans.dialogue import event_rows
    from scriptorium.plans.operations import access

    hot = access(spark, SF_DIR).withColumn("key", F.when(F.col("id") % 3 == 0, "0").otherwise(F.col("key")))
    same(reuse.lookups(hot, parts=5), reuse.lookups(hot))
    events = event_rows(spark, SF_DIR).withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))
    args = (events, "user_id", "ts", "event_id", 3600)
    same(conversations.idle_sessions(*args, parts=5), conversations.idle_sessions(*args))
    messages = t.read(spark, SF_DIR, "conversations")
    same(conversations.pair_turns(messages, parts=5), conversations.pair_turns(messages))


def test_quality_split_is_the_same_when_split(spark):
    rows = spark.range(500).select(F.col("id").alias("example_id"), (F.col("id") % 11).cast("double").alias("quality_score"))
    same(training.split_by_quality(rows, 0.8, parts=5), training.split_by_quality(rows, 0.8))


def test_results_do_not_depend_on_partitioning(spark):
    rows = spark.range(400).select((F.col("id") % 9).alias("query_id"), (F.col("id") % 3).cast("int").alias("variant_no"),
                                   (F.col("id") % 10 + 1).cast("int").alias("rank"), (F.col("id") % 31).alias("doc"))
    from scriptorium.operators.fusion import reciprocal_rank

    same(reciprocal_rank(rows.repartition(1), "doc"), reciprocal_rank(rows.repartition(16), "doc"))
