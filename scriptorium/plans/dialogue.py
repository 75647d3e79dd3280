"""Registered queries: conversations and learning from feedback."""

from pyspark.sql import functions as F

from scriptorium.operators import conversations, feedback
from scriptorium.plans import sqltext as q
from scriptorium.plans import tables as t
from scriptorium.plans.documents import TERMS, TYPES
from scriptorium.plans.registry import query
from scriptorium.sources import records

DEICTIC = ("isso", "que", "with", "sich", "primeiro")


@query("conversation_turns", "WITH" + t.TURNS + "SELECT conversation_id, turn, turn_no, question, answer, epoch(ts)::BIGINT AS ts FROM turns")
def conversation_turns(spark, sf_dir):
    return t.turns(spark, sf_dir).withColumn("ts", F.unix_seconds("ts"))


# Turns whose answers are lists and whose questions refer back.
TALK = t.TURNS + """,
talk AS (
  SELECT conversation_id, turn_no, ts, CASE WHEN conversation_id % 2 = 0 THEN question || ' item 2?' WHEN conversation_id % 5 = 1 THEN 'Isso: ' || question ELSE question END AS question,
    CASE WHEN turn_no % 2 = 1 THEN array_to_string(list_transform(list_zip(string_split(answer, chr(10)), range(1, 1 + len(string_split(answer, chr(10))))), lambda x: CAST(x[2] AS VARCHAR) || '. ' || x[1]), chr(10))
         ELSE array_to_string(list_transform(string_split(answer, chr(10)), lambda x: '• ' || x), chr(10)) END AS answer FROM turns)"""


def talk(spark, sf_dir):
    lines = F.split("answer", "\n")
    numbered = F.array_join(F.transform(lines, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    bullets = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("• "), x)), "\n")
    question = F.when(F.col("conversation_id") % 2 == 0, F.concat("question", F.lit(" item 2?"))).when(
        F.col("conversation_id") % 5 == 1, F.concat(F.lit("Isso: "), "question")
    ).otherwise(F.col("question"))
    return t.turns(spark, sf_dir).select(
        "conversation_id", "turn_no", "ts", question.alias("question"),
        F.when(F.col("turn_no") % 2 == 1, numbered).otherwise(bullets).alias("answer"),
    )


RECENT = """
recent AS (
  SELECT a.conversation_id, a.turn_no, string_agg('Pergunta ' || (b.turn_no - greatest(a.turn_no - 3, 1) + 1) || ': ' || b.question || chr(10) ||
      'Resposta ' || (b.turn_no - greatest(a.turn_no - 3, 1) + 1) || ': ' || b.answer || chr(10), chr(10) ORDER BY b.turn_no) AS recent
  FROM talk a JOIN talk b ON a.conversation_id = b.conversation_id AND b.turn_no BETWEEN a.turn_no - 3 AND a.turn_no - 1 GROUP BY ALL)"""


@query("conversation_recent_context", "WITH" + TALK + "," + RECENT + """
SELECT talk.conversation_id, talk.turn_no, md5(coalesce(recent, '')) AS recent_md5 FROM talk LEFT JOIN recent USING (conversation_id, turn_no)""")
def conversation_recent_context(spark, sf_dir):
    framed = conversations.recent_context(talk(spark, sf_dir), 3)
    return framed.select("conversation_id", "turn_no", F.md5("recent").alias("recent_md5"))


NUMBERED, BULLET = r"(\d+)\.\s+([^\n]+)", r"[•\-\*]\s+([^\n]+)"


@query("conversation_list_items", "WITH" + TALK + f"""
SELECT conversation_id, turn_no, 'numbered' AS kind, CAST(unnest(range(1, len(m) + 1)) AS INT) AS item_no, unnest(m) AS item
FROM (SELECT *, regexp_extract_all(answer, '{NUMBERED}', 2) AS m FROM talk)
UNION ALL
SELECT conversation_id, turn_no, 'bullet', CAST(unnest(range(1, len(m) + 1)) AS INT), unnest(m)
FROM (SELECT *, regexp_extract_all(answer, '{BULLET}', 1) AS m FROM talk)""")
def conversation_list_items(spark, sf_dir):
    return talk(spark, sf_dir).select("conversation_id", "turn_no", F.inline(conversations.list_items(F.col("answer"))))


# other letters than A-Z become an underscore and other marks a dot, so that word boundaries mean the same in both engines
ASCII = "regexp_replace(regexp_replace(answer, '[^\\x00-\\x7F\\p{L}\\p{M}\\p{N}\\p{Pc}]', '.', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


@query("conversation_entities", "WITH" + TALK + f"""
SELECT conversation_id, turn_no, array_to_string(list_sort(list_distinct(list_concat(
  list_transform(regexp_extract_all(answer, '\\d+\\.\\s+([^\\n]+)', 1), lambda x, i: 'item_' || i || '_' || substr(x, 1, 30)),
  regexp_extract_all({ASCII}, {q.quote(conversations.CAPITALS)}, 0)))), '|') AS entities FROM talk""")
def conversation_entities(spark, sf_dir):
    return talk(spark, sf_dir).select(
        "conversation_id", "turn_no", F.array_join(conversations.entities(F.col("answer"), 30), "|").alias("entities")
    )


REFS = f"""
refs AS (SELECT *, list_concat(CASE WHEN regexp_matches(lower(question), '\\bitem\\s+\\d+\\b') THEN ['numbered_items'] ELSE [] END,
  list_transform(list_filter({q.string_list(DEICTIC)}, lambda w: contains(lower(question), w)), lambda w: 'reference_' || w)) AS r FROM talk)"""


@query("conversation_references", "WITH" + TALK + "," + REFS + "SELECT conversation_id, turn_no, array_to_string(r, ',') AS refs FROM refs")
def conversation_references(spark, sf_dir):
    refs = conversations.context_references(F.col("question"), DEICTIC)
    return talk(spark, sf_dir).select("conversation_id", "turn_no", F.concat_ws(",", refs).alias("refs"))


def block_sql(items: str) -> str:
    return (
        f"CASE WHEN len({items}) > 0 THEN '{conversations.LIST_HEAD}' || chr(10) || array_to_string(list_transform(list_zip({items}, range(1, len({items}) + 1)),"
        f" lambda x: CAST(x[2] AS VARCHAR) || '. ' || x[1]), chr(10)) || chr(10) || chr(10) ELSE '' END"
    )


@query("conversation_enhanced_questions", "WITH" + TALK + "," + REFS + "," + RECENT + f""",
blocks AS (SELECT conversation_id, turn_no, {block_sql(f"regexp_extract_all(answer, '{NUMBERED}', 2)")} || {block_sql(f"regexp_extract_all(answer, '{BULLET}', 1)")} AS b FROM talk),
earlier AS (SELECT a.conversation_id, a.turn_no, string_agg(b, '' ORDER BY x.turn_no) AS lists FROM refs a JOIN blocks x ON x.conversation_id = a.conversation_id AND x.turn_no < a.turn_no
            WHERE list_contains(a.r, 'numbered_items') GROUP BY ALL),
summed AS (
  SELECT refs.*, CASE WHEN len(r) > 0 AND recent IS NOT NULL THEN coalesce(lists, '') || '{conversations.RECENT_HEAD}' || chr(10) || recent ELSE '' END AS s
  FROM refs LEFT JOIN recent USING (conversation_id, turn_no) LEFT JOIN earlier USING (conversation_id, turn_no))
SELECT conversation_id, turn_no, md5(s) AS summary_md5,
  md5(CASE WHEN s <> '' THEN {q.quote(conversations.CONTEXT_HEAD)} || s || {q.quote(conversations.QUESTION_HEAD)} || question || {q.quote(conversations.QUESTION_TAIL)} ELSE question END) AS enhanced_md5
FROM summed""")
def conversation_enhanced_questions(spark, sf_dir):
    done = conversations.enhance_questions(talk(spark, sf_dir), 3, DEICTIC)
    return done.select(
        "conversation_id", "turn_no", F.md5("context_summary").alias("summary_md5"), F.md5("enhanced").alias("enhanced_md5")
    )


@query("conversation_expiry", "WITH" + t.TURNS + """,
last AS (SELECT conversation_id, max(ts) AS last_activity, count(*) AS turns FROM turns GROUP BY 1)
SELECT conversation_id, epoch(last_activity)::BIGINT AS last_activity, turns, last_activity < TIMESTAMP '2024-01-04' - INTERVAL 24 HOUR AS expired FROM last""")
def conversation_expiry(spark, sf_dir):
    as_of = F.timestamp_seconds(F.lit(1704326400))
    return conversations.expired(t.turns(spark, sf_dir), as_of).withColumn("last_activity", F.unix_seconds("last_activity"))


def event_rows(spark, sf_dir):
    """The events with their local times read as UTC, whatever the session's zone."""
    return with_utc(t.read(spark, sf_dir, "events"))


def with_utc(events):
    return events.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts))"))


@query("idle_sessions", """
WITH g AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 86400000000, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)),
s AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS ended, count(*) AS events FROM s GROUP BY ALL""")
def idle_sessions(spark, sf_dir):
    found = conversations.idle_sessions(event_rows(spark, sf_dir), "user_id", "ts", "event_id")
    return found.withColumns({"started": F.unix_micros("started"), "ended": F.unix_micros("ended")})


@query("conversation_store", "WITH" + TALK + """
SELECT conversation_id, CAST((turn_no - 1) // 2 AS INT) AS part_no, count(*) AS turns FROM talk GROUP BY ALL""")
def conversation_store(spark, sf_dir):
    """Stored in parts of two turns, loaded again and counted."""
    stored = conversations.store(talk(spark, sf_dir), 2)
    back = conversations.load(stored)
    return back.groupBy("conversation_id", F.floor((F.col("turn_no") - 1) / 2).cast("int").alias("part_no")).agg(
        F.count("*").alias("turns")
    )


@query("conversation_load", "WITH" + TALK + """
SELECT conversation_id, turn_no, question, answer, epoch(ts)::BIGINT AS ts FROM talk""")
def conversation_load(spark, sf_dir):
    return conversations.load(conversations.store(talk(spark, sf_dir), 3)).withColumn("ts", F.unix_seconds("ts"))


# Each event rates the first turn of the conversation with its user's number.
FEEDBACK = t.TURNS + """,
feedback AS (
  SELECT event_id AS feedback_id, user_id || '-' || (event_id % 4) AS response_id, user_id, coalesce(question, event_type || ' is a') AS question, coalesce(answer, '') AS response_text,
         CAST((event_id * 7 + CAST(json_extract(props, '$.k') AS BIGINT)) % 5 + 1 AS INT) AS rating, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 + 1 AS INT) END AS source_quality, events.ts
  FROM events LEFT JOIN turns ON conversation_id = user_id AND turn_no = 1)"""


def feedback_rows(spark, sf_dir, events=None):
    """Feedback from the events table, or from a stream of it."""
    events = event_rows(spark, sf_dir) if events is None else events
    first = t.turns(spark, sf_dir).where("turn_no = 1").select(F.col("conversation_id").alias("user_id"), "question", "answer")
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.join(first, "user_id", "left").select(
        e.alias("feedback_id"), F.concat_ws("-", "user_id", (e % 4)).alias("response_id"), "user_id",
        F.coalesce("question", F.concat("event_type", F.lit(" is a"))).alias("question"),
        F.coalesce("answer", F.lit("")).alias("response_text"), ((e * 7 + k) % 5 + 1).cast("int").alias("rating"),
        F.when(e % 3 == 0, (e % 5 + 1).cast("int")).alias("source_quality"), "ts",
    )


def rated(spark, sf_dir, events=None):
    return feedback.features(feedback_rows(spark, sf_dir, events), TYPES, TERMS, TERMS)


RATED = FEEDBACK + f""",
rated AS (
  SELECT *, CAST(len({t.sql_words('question')}) AS INT) AS question_length, CAST(len({t.sql_words('response_text')}) AS INT) AS response_length,
    {q.rule_case('lower(question)', TYPES, q.quote('general'))} AS question_type, {q.any_contained('lower(question)', TERMS)} AS has_terms,
    CASE WHEN len({t.sql_words('question')}) < 5 THEN 'simple' WHEN len({t.sql_words('question')}) < 15 AND len(list_filter({t.sql_words('lower(question)')}, lambda x: list_contains({q.string_list(TERMS)}, x))) <= 1
      THEN 'moderate' ELSE 'complex' END AS complexity, rating >= 4 AS satisfied FROM feedback)"""


@query("feedback_features", "WITH" + RATED + """
SELECT feedback_id, rating, question_length, response_length, question_type, has_terms, complexity, satisfied FROM rated""")
def feedback_features(spark, sf_dir):
    return rated(spark, sf_dir).select(
        "feedback_id", "rating", "question_length", "response_length", "question_type", "has_terms", "complexity", "satisfied"
    )


PERFORMANCE = """
SELECT question_type, round(avg(rating), 6) AS avg_rating, count(*) AS total_feedback,
  round(CASE WHEN count(*) > 1 THEN avg(CAST(satisfied AS INT)) FILTER (rn > 1) ELSE avg(CAST(satisfied AS INT)) END, 6) AS success_rate_ref,
  round(avg(CAST(satisfied AS INT)), 6) AS success_rate, arg_min(question_length, rn) AS optimal_length
FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY ts, feedback_id) AS rn FROM rated) GROUP BY question_type"""


@query("feedback_performance", "WITH" + RATED + PERFORMANCE)
def feedback_performance(spark, sf_dir):
    return feedback.performance(rated(spark, sf_dir))


CANDIDATES = RATED + """,
candidates AS (
  SELECT 'query_pref_' || question_type AS pattern_id, 'query_preference' AS pattern_type, feedback_id, ts, rating, question_type, CAST(response_length AS DOUBLE) AS number, complexity AS label, has_terms AS flag
  FROM rated WHERE rating >= 4
  UNION ALL
  SELECT 'source_pref_' || response_id, 'source_preference', feedback_id, ts, rating, question_type, CAST(0.8 AS DOUBLE), NULL, true FROM rated WHERE source_quality >= 4)"""


@query("feedback_pattern_candidates", "WITH" + CANDIDATES + "SELECT pattern_id, pattern_type, feedback_id, rating, question_type, number, label, flag FROM candidates")
def feedback_pattern_candidates(spark, sf_dir):
    return feedback.pattern_candidates(rated(spark, sf_dir)).drop("ts")


PATTERNS = CANDIDATES + """,
steps AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY ts, feedback_id) AS rn FROM candidates),
walk AS (
  SELECT pattern_id, pattern_type, question_type, rn, CAST(CASE pattern_type WHEN 'query_preference' THEN 0.5 ELSE 0.6 END AS DOUBLE) AS c, number AS v, label, flag FROM steps WHERE rn = 1
  UNION ALL
  SELECT w.pattern_id, w.pattern_type, w.question_type, s.rn,
    CASE WHEN s.rating >= 4 THEN least(1.0::DOUBLE, w.c + 0.1::DOUBLE) ELSE greatest(0.1::DOUBLE, least(1.0::DOUBLE, w.c + 0.1::DOUBLE) - 0.05::DOUBLE) END,
    CASE WHEN s.rating >= 4 THEN w.v * 0.8::DOUBLE + s.number * 0.2::DOUBLE ELSE w.v END,
    CASE WHEN s.rating >= 4 THEN s.label ELSE w.label END, CASE WHEN s.rating >= 4 THEN s.flag ELSE w.flag END
  FROM walk w JOIN steps s ON s.pattern_id = w.pattern_id AND s.rn = w.rn + 1),
patterns AS (
  SELECT pattern_id, pattern_type, question_type, rn AS support_count, round(c, 6) AS confidence, round(v, 6) AS number, label, flag
  FROM walk QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY rn DESC) = 1)"""


def patterns(spark, sf_dir):
    return feedback.consolidate(feedback.pattern_candidates(rated(spark, sf_dir)))


@query("feedback_patterns", "WITH RECURSIVE" + PATTERNS + "SELECT * FROM patterns")
def feedback_patterns(spark, sf_dir):
    return patterns(spark, sf_dir)


SETTINGS = PATTERNS + """,
usable AS (SELECT * FROM patterns WHERE confidence >= 0.7 AND support_count >= 5),
settings AS (
  SELECT question_type, setting, arg_max(v, pattern_id) AS v FROM (
    SELECT pattern_id, question_type, unnest(CASE pattern_type WHEN 'query_preference' THEN ['preferred_response_length', 'complexity_level', 'include_technical_detail'] ELSE ['source_confidence_threshold', 'boost_similar_sources'] END) AS setting,
           unnest(CASE pattern_type WHEN 'query_preference' THEN [CAST(number AS VARCHAR), label, CAST(flag AS VARCHAR)] ELSE [CAST(number AS VARCHAR), CAST(flag AS VARCHAR)] END) AS v FROM usable) GROUP BY ALL),
combos AS (SELECT DISTINCT question_type, has_terms, complexity FROM rated)"""


@query("feedback_recommendations", "WITH RECURSIVE" + SETTINGS + """
SELECT question_type, has_terms, complexity, setting, CASE WHEN setting IN ('preferred_response_length', 'source_confidence_threshold') THEN round(CAST(v AS DOUBLE), 6)::VARCHAR ELSE v END AS value,
  CASE WHEN contains(setting, 'length') THEN 'response' WHEN contains(setting, 'source') THEN 'source' WHEN contains(setting, 'citation') THEN 'citation' ELSE 'response' END AS target
FROM combos JOIN settings USING (question_type)""")
def feedback_recommendations(spark, sf_dir):
    found = feedback.pattern_adjustments(patterns(spark, sf_dir))
    routed, _ = feedback.recommend(rated(spark, sf_dir), found)
    return routed.withColumnRenamed("to", "value")


@query("feedback_recommendation_confidence", "WITH RECURSIVE" + SETTINGS + """
SELECT c.question_type, has_terms, complexity, round(avg(confidence), 6) AS confidence, count(*) AS patterns
FROM combos c JOIN usable u ON u.question_type = c.question_type GROUP BY ALL""")
def feedback_recommendation_confidence(spark, sf_dir):
    found = feedback.pattern_adjustments(patterns(spark, sf_dir))
    return feedback.recommend(rated(spark, sf_dir), found)[1]


@query("feedback_statistics", "WITH RECURSIVE" + PATTERNS + """,
latest AS (SELECT * FROM feedback ORDER BY ts DESC, feedback_id DESC LIMIT 100)
SELECT 'total_feedback' AS figure, count(*)::DOUBLE AS value FROM feedback UNION ALL SELECT 'average_rating', round(avg(rating), 2) FROM feedback
UNION ALL SELECT 'rating_' || rating, count(*)::DOUBLE FROM feedback GROUP BY rating UNION ALL SELECT 'learned_patterns', count(*)::DOUBLE FROM patterns
UNION ALL SELECT 'average_pattern_confidence', round(avg(confidence), 3) FROM patterns UNION ALL SELECT 'recent_feedback_count', count(*)::DOUBLE FROM latest
UNION ALL SELECT 'success_rate', round(avg(CAST(rating >= 4 AS INT)), 6) FROM latest""")
def feedback_statistics(spark, sf_dir):
    return feedback.statistics(feedback_rows(spark, sf_dir), patterns(spark, sf_dir))


@query("feedback_store", "WITH" + FEEDBACK + """
SELECT feedback_id, rating, CAST(rating AS INT) AS clarity, epoch_us(ts) AS ts FROM feedback""")
def feedback_store(spark, sf_dir):
    rows = feedback_rows(spark, sf_dir).withColumn("aspects", F.create_map(F.lit("clarity"), F.col("rating")))
    back = records.feedback_from_store(records.feedback_to_store(rows))
    return back.select("feedback_id", "rating", F.col("aspects")["clarity"].alias("clarity"), F.unix_micros("ts").alias("ts"))
