"""Learning from feedback: features, performance per question type, patterns and recommendations.

``feedback(feedback_id, response_id, question, response_text, rating, source_quality, ts)``.  One question type may
hold most rows, so statistics use partial aggregation, and the order-dependent pattern updates are expressed as
composable maps: a segment of updates folds into one map, and maps of segments fold again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions.rules import Rule
from scriptorium.functions.text import word_count
from scriptorium.operators.classify import complexity, has_terms, question_type
from scriptorium.scale import number_rows, small_side

# Learning rate, starting confidences, bounds and thresholds.
GAIN, LOSS, FLOOR = 0.1, 0.05, 0.1
START = {"query_preference": 0.5, "source_preference": 0.6}
KEEP, NEW = 0.8, 0.2
SOURCE_THRESHOLD = 0.8
MIN_CONFIDENCE, MIN_SUPPORT = 0.7, 5
SEGMENT = 10_000
NEVER = 1e300


def features(
    feedback: DataFrame, rules: Sequence[Rule] = lex.FEEDBACK_TYPES, terms: Sequence[str] = lex.FEEDBACK_TERMS,
    complexity_terms: Sequence[str] = lex.COMPLEXITY_TERMS,
) -> DataFrame:
    question = F.col("question")
    return feedback.withColumns({
        "question_length": word_count(question), "response_length": word_count(F.col("response_text")),
        "question_type": question_type(question, rules), "has_terms": has_terms(question, terms),
        "complexity": complexity(question, complexity_terms), "satisfied": F.col("rating") >= 4,
    })


def performance(rated: DataFrame) -> DataFrame:
    """Per question type of ``features``: mean rating, count, success rates and the first question's length.

    ``success_rate_ref`` is the running figure that leaves the first feedback out once there are two.
    """
    return performance_rates(performance_sums(rated))


def performance_sums(rated: DataFrame) -> DataFrame:
    """The sums behind ``performance``; the same aggregation runs in batch and on a stream."""
    order = F.struct("ts", "feedback_id")
    good = F.col("satisfied").cast("int")
    return rated.groupBy("question_type").agg(
        F.avg("rating").alias("avg_rating"), F.count("*").alias("total_feedback"), F.sum(good).alias("good"),
        F.min_by(good, order).alias("first_good"), F.min_by("question_length", order).alias("optimal_length"),
    )


def performance_rates(sums: DataFrame) -> DataFrame:
    return sums.select(
        "question_type", F.round("avg_rating", 6).alias("avg_rating"), "total_feedback",
        F.round(F.when(
            F.col("total_feedback") > 1, (F.col("good") - F.col("first_good")) / (F.col("total_feedback") - 1)
        ).otherwise(F.col("first_good").cast("double")), 6).alias("success_rate_ref"),
        F.round(F.col("good") / F.col("total_feedback"), 6).alias("success_rate"), "optimal_length",
    )


def pattern_candidates(rated: DataFrame) -> DataFrame:
    """query_preference from ratings of 4 and more, source_preference from source quality of 4 and more."""
    common = ["feedback_id", "ts", "rating", "question_type"]
    liked = rated.where(F.col("rating") >= 4).select(
        F.concat(F.lit("query_pref_"), F.col("question_type")).alias("pattern_id"),
        F.lit("query_preference").alias("pattern_type"), *common,
        F.col("response_length").cast("double").alias("number"), F.col("complexity").alias("label"),
        F.col("has_terms").alias("flag"),
    )
    sourced = rated.where(F.col("source_quality") >= 4).select(
        F.concat(F.lit("source_pref_"), F.col("response_id")).alias("pattern_id"),
        F.lit("source_preference").alias("pattern_type"), *common,
        F.lit(SOURCE_THRESHOLD).alias("number"), F.lit(None).cast("string").alias("label"), F.lit(True).alias("flag"),
    )
    return liked.unionAll(sourced)


def update_map(candidate_no: Column) -> Column:
    """One candidate as a map on (confidence, number): confidence → clamp(c + add, low, high); number → keep·v + plus.

    The first candidate of a pattern is a constant map, so the composition needs no start value.
    """
    first = candidate_no == 1
    start = F.when(F.col("pattern_type") == "query_preference", START["query_preference"]).otherwise(
        START["source_preference"]
    )
    positive = F.col("rating") >= 4
    return F.struct(
        F.when(first, 0.0).when(positive, GAIN).otherwise(GAIN - LOSS).alias("add"),
        F.when(first, start).when(positive, -NEVER).otherwise(FLOOR).alias("low"),
        F.when(first, start).when(positive, 1.0).otherwise(1.0 - LOSS).alias("high"),
        F.when(first, 0.0).when(positive, KEEP).otherwise(1.0).alias("keep"),
        F.when(first, F.col("number")).when(positive, F.col("number") * NEW).otherwise(0.0).alias("plus"),
        F.when(first | positive, F.struct("label", "flag")).alias("last"), F.col("question_type").alias("question_type"),
        F.lit(1).cast("long").alias("support"),
    )


def then(a: Column, b: Column) -> Column:
    """The map that applies ``a`` and then ``b``."""
    def clamp(x: Column) -> Column:
        return F.least(b["high"], F.greatest(b["low"], x))

    return F.struct(
        (a["add"] + b["add"]).alias("add"), clamp(a["low"] + b["add"]).alias("low"),
        clamp(a["high"] + b["add"]).alias("high"), (a["keep"] * b["keep"]).alias("keep"),
        (a["plus"] * b["keep"] + b["plus"]).alias("plus"), F.coalesce(b["last"], a["last"]).alias("last"),
        a["question_type"].alias("question_type"),
        (a["support"] + b["support"]).alias("support"),
    )


def _compose(maps: Column) -> Column:
    return F.aggregate(F.slice(maps, F.lit(2), F.greatest(F.size(maps) - 1, F.lit(0))), F.get(maps, F.lit(0)), then)


def compose_updates(numbered: DataFrame, segment: int = SEGMENT, levels: int = 3) -> DataFrame:
    """One composed map per pattern from ``(pattern_id, pattern_type, no, step)``.

    Each level folds at most ``segment`` consecutive maps in one group.
    """
    keys = ["pattern_id", "pattern_type"]
    maps = numbered.select(*keys, F.col("no").cast("long").alias("no"), "step")
    for _ in range(levels):
        maps = maps.groupBy(*keys, F.floor((F.col("no") - 1) / segment).cast("long").alias("part")).agg(
            _compose(F.transform(F.array_sort(F.collect_list(F.struct("no", "step"))), lambda x: x["step"])).alias("step")
        ).select(*keys, (F.col("part") + 1).alias("no"), "step")
    return maps.drop("no")


def consolidate(candidates: DataFrame, segment: int = SEGMENT, **options) -> DataFrame:
    """Patterns after all candidates in (ts, id) order: support, confidence, averaged number, last label and flag.

    A source pattern keeps the question type of its first candidate.
    """
    numbered = number_rows(candidates, ["pattern_id"], [F.col("ts"), F.col("feedback_id")], "no", **options)
    done = compose_updates(numbered.withColumn("step", update_map(F.col("no"))), segment)
    return pattern_rows(done)


def pattern_rows(composed: DataFrame) -> DataFrame:
    return composed.select(
        "pattern_id", "pattern_type", F.col("step.question_type").alias("question_type"), F.col("step.support").alias("support_count"),
        F.round(F.col("step.low"), 6).alias("confidence"), F.round("step.plus", 6).alias("number"),
        F.col("step.last.label").alias("label"), F.col("step.last.flag").alias("flag"),
    )


def pattern_adjustments(patterns: DataFrame) -> DataFrame:
    """Patterns with ``conditions`` and ``adjustments`` maps."""
    query = F.map_from_arrays(
        F.array(F.lit("preferred_response_length"), F.lit("complexity_level"), F.lit("include_technical_detail")),
        F.array(F.col("number").cast("string"), F.col("label"), F.col("flag").cast("string")),
    )
    source = F.map_from_arrays(
        F.array(F.lit("source_confidence_threshold"), F.lit("boost_similar_sources")),
        F.array(F.col("number").cast("string"), F.col("flag").cast("string")),
    )
    return patterns.withColumns({
        "conditions": F.create_map(F.lit("question_type"), F.col("question_type")),
        "adjustments": F.when(F.col("pattern_type") == "query_preference", query).otherwise(source),
    })


def recommend(questions: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adjustments and mean confidence for ``questions(…, question_type, has_terms, complexity)``.

    Patterns meet the distinct feature combinations, of which there are few, never the questions: any equal
    condition makes a pattern apply, and so does having none; the last pattern by id sets a key; keys are routed by name.
    """
    combo = ["question_type", "has_terms", "complexity"]
    usable = patterns.where((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("support_count") >= MIN_SUPPORT))
    combos = questions.select(*combo).distinct()
    # a pattern without conditions meets the empty fact, which every combination carries
    facts = combos.select(*combo, F.explode(F.create_map(
        F.lit("question_type"), F.col("question_type"), F.lit("has_technical_terms"), F.col("has_terms").cast("string"),
        F.lit("complexity_level"), F.col("complexity"), F.lit(""), F.lit(""),
    )).alias("key", "value"))
    free = F.coalesce(F.size("conditions"), F.lit(0)) <= 0
    conditions = F.when(free, F.create_map(F.lit(""), F.lit(""))).otherwise(F.col("conditions"))
    wanted = usable.select("pattern_id", "confidence", "adjustments", F.explode(conditions).alias("key", "value"))
    matched = wanted.join(small_side(facts), ["key", "value"]).select(*combo, "pattern_id", "confidence", "adjustments")
    applied = matched.dropDuplicates([*combo, "pattern_id"])
    settings = applied.select(*combo, "pattern_id", F.explode("adjustments").alias("setting", "to"))
    name = F.col("setting")
    routed = settings.groupBy(*combo, "setting").agg(F.max_by("to", "pattern_id").alias("to")).withColumn(
        "target",
        F.when(name.contains("length"), "response").when(name.contains("source"), "source")
        .when(name.contains("citation"), "citation").otherwise("response"),
    )
    confidence = applied.groupBy(*combo).agg(
        F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("patterns")
    )
    return routed, confidence


def statistics(feedback: DataFrame, patterns: DataFrame, recent: int = 100) -> DataFrame:
    """Named figures: totals, ratings, patterns and success of the latest feedback."""
    def figure(df: DataFrame, name, value: Column) -> DataFrame:
        label = F.lit(name) if isinstance(name, str) else name
        return df.select(label.alias("figure"), value.cast("double").alias("value"))

    totals = feedback.agg(F.count("*").alias("n"), F.avg("rating").alias("m"))
    kinds = patterns.agg(F.count("*").alias("n"), F.avg("confidence").alias("m"))
    latest = feedback.orderBy(F.col("ts").desc(), F.col("feedback_id").desc()).limit(recent).agg(
        F.count("*").alias("n"), F.avg((F.col("rating") >= 4).cast("int")).alias("m")
    )
    ratings = feedback.groupBy("rating").agg(F.count("*").alias("n"))
    parts = [
        figure(totals, "total_feedback", F.col("n")), figure(totals, "average_rating", F.round("m", 2)),
        figure(ratings, F.concat(F.lit("rating_"), F.col("rating").cast("string")), F.col("n")),
        figure(kinds, "learned_patterns", F.col("n")), figure(kinds, "average_pattern_confidence", F.round("m", 3)),
        figure(latest, "recent_feedback_count", F.col("n")), figure(latest, "success_rate", F.round("m", 6)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
