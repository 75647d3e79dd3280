"""Conversations: turns, recent context, list items, entities, references to earlier turns, expiry.

One conversation may hold a large share of all messages, so frames over its order go through the segmented helpers
and stored conversations are written in parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import contained_terms, head
from scriptorium.scale import number_rows, running_total, with_neighbours

# Reference words, list patterns and texts around a question.
REFERENCE_WORDS = (
    "isso", "esta", "essa", "anterior", "acima", "mencionado", "lista", "primeiro", "segundo", "terceiro", "último",
)
ITEM_REFERENCE = r"\bitem\s+\d+\b"
NUMBERED = r"(\d+)\.\s+([^\n]+)"
BULLETS = r"[•\-\*]\s+([^\n]+)"
CAPITALS = r"\b[A-Z]{2,}\b|\b[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*\b"
CONTEXT_HEAD = "CONTEXTO DA CONVERSA:\n"
QUESTION_HEAD = "\n\nPERGUNTA ATUAL: "
QUESTION_TAIL = (
    "\n\nPor favor, responda considerando o contexto da conversa anterior, especialmente se a pergunta se refere a itens,"
    " listas ou informações mencionadas anteriormente."
)
LIST_HEAD = "Lista mencionada anteriormente:"
RECENT_HEAD = "Contexto da conversa:"


def pair_turns(messages: DataFrame, **options) -> DataFrame:
    """Question–answer turns of ``messages(conv_id, turn, role, text)``: a user message and the assistant's next one."""
    def following(w):
        return {"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)}

    looked = with_neighbours(messages, ["conv_id"], [F.col("turn")], 0, 1, following, **options)
    pairs = looked.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select(
        F.col("conv_id").alias("conversation_id"), "turn", F.col("text").alias("question"), "answer"
    )
    numbered = number_rows(pairs, ["conversation_id"], [F.col("turn")], "turn_no", options.get("parts"))
    return numbered.withColumn(
        "ts", F.expr("timestamp_seconds(1704067200 + conversation_id * 3600 + turn * 60)")
    )


def recent_context(turns: DataFrame, count: int = 5, **options) -> DataFrame:
    """Text of the previous ``count`` turns of each turn."""
    def frame(w):
        return {"_past": F.collect_list(F.struct("question", "answer")).over(w.rowsBetween(-count, -1))}

    framed = with_neighbours(turns, ["conversation_id"], [F.col("turn_no")], count, 0, frame, **options)
    lines = F.flatten(F.transform("_past", lambda t, i: F.array(
        F.concat(F.lit("Pergunta "), (i + 1).cast("string"), F.lit(": "), t["question"]),
        F.concat(F.lit("Resposta "), (i + 1).cast("string"), F.lit(": "), t["answer"]), F.lit(""),
    )))
    return framed.withColumn("recent", F.array_join(lines, "\n")).drop("_past")


def list_items(answer: Column) -> Column:
    """``array<struct<kind, item_no, item>>`` of numbered and bulleted lines."""
    def tagged(items: Column, kind: str) -> Column:
        return F.transform(items, lambda x, i: F.struct(
            F.lit(kind).alias("kind"), (i + 1).alias("item_no"), x.alias("item")
        ))

    return F.concat(
        tagged(F.regexp_extract_all(answer, F.lit(NUMBERED), F.lit(2)), "numbered"),
        tagged(F.regexp_extract_all(answer, F.lit(BULLETS), F.lit(1)), "bullet"),
    )


def entities(answer: Column, width: int | None = None) -> Column:
    """Distinct list items (their first ``width`` characters if given), acronyms and capitalised names, sorted."""
    items = F.transform(
        F.regexp_extract_all(answer, F.lit(r"\d+\.\s+([^\n]+)"), F.lit(1)),
        lambda x, i: F.concat(F.lit("item_"), (i + 1).cast("string"), F.lit("_"), head(x, width)),
    )
    names = F.regexp_extract_all(answer, F.lit("(?U)" + CAPITALS), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(items, names)))


def context_references(question: Column, reference_words: Sequence[str] = REFERENCE_WORDS) -> Column:
    """References to earlier turns: numbered items and deictic words."""
    low = F.lower(question)
    numbered = F.when(low.rlike(ITEM_REFERENCE), F.array(F.lit("numbered_items"))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(numbered, F.transform(
        contained_terms(low, reference_words), lambda w: F.concat(F.lit("reference_"), w)
    ))


def enhance_questions(
    turns: DataFrame, count: int = 3, reference_words: Sequence[str] = REFERENCE_WORDS, **options
) -> DataFrame:
    """Questions that refer back get the recent turns, and earlier lists for item references, in front.

    Lists come from all earlier turns.  Only item-referencing questions meet list-bearing turns, and every such pair
    is part of the result.
    """
    rows = recent_context(turns, count, **options).withColumn(
        "refs", context_references(F.col("question"), reference_words)
    )
    asks = rows.where(F.array_contains("refs", "numbered_items")).select("conversation_id", "turn_no")
    lists = turns.select(
        "conversation_id", F.col("turn_no").alias("_at"), _list_block(F.col("answer")).alias("_own")
    ).where(F.size("_own") > 0)
    gathered = asks.join(lists, "conversation_id").where(F.col("_at") < F.col("turn_no")).groupBy(
        "conversation_id", "turn_no"
    ).agg(F.array_sort(F.collect_list(F.struct("_at", "_own"))).alias("_g"))
    joined = rows.join(gathered, ["conversation_id", "turn_no"], "left")
    earlier = F.coalesce(F.flatten(F.transform("_g", lambda g: g["_own"])), F.array().cast("array<string>"))
    summary = F.array_join(F.concat(earlier, F.array(F.lit(RECENT_HEAD), F.col("recent"))), "\n")
    used = (F.size("refs") > 0) & (F.col("recent") != "")
    return joined.withColumn("context_summary", F.when(used, summary).otherwise("")).withColumn(
        "enhanced", F.when(used, F.concat(
            F.lit(CONTEXT_HEAD), F.col("context_summary"), F.lit(QUESTION_HEAD), F.col("question"), F.lit(QUESTION_TAIL)
        )).otherwise(F.col("question")),
    ).drop("_g")


def _list_block(answer: Column) -> Column:
    """Lines that repeat an answer's lists, ready to be joined."""
    def block(items: Column) -> Column:
        lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(LIST_HEAD)), lines, F.array(F.lit("")))).otherwise(
            F.array().cast("array<string>")
        )

    return F.concat(
        block(F.regexp_extract_all(answer, F.lit(NUMBERED), F.lit(2))),
        block(F.regexp_extract_all(answer, F.lit(BULLETS), F.lit(1))),
    )


def expired(turns: DataFrame, as_of: Column, idle: str = "24 hours") -> DataFrame:
    """Last activity of each conversation and whether it is older than ``idle``."""
    return turns.groupBy("conversation_id").agg(
        F.max("ts").alias("last_activity"), F.count("*").alias("turns")
    ).withColumn("expired", F.col("last_activity") < as_of - F.expr(f"INTERVAL {idle}"))


def idle_sessions(events: DataFrame, key: str, ts: str, tie: str, idle_seconds: int = 86400, **options) -> DataFrame:
    """Sessions of each key, closed after ``idle_seconds`` without an event."""
    stamped = events.withColumn("_us", F.unix_micros(ts))

    def previous(w):
        return {"_last": F.lag("_us").over(w)}

    gaps = with_neighbours(stamped, [key], [F.col("_us"), F.col(tie)], 1, 0, previous, **options)
    opens = (F.col("_last").isNull() | (F.col("_us") - F.col("_last") >= idle_seconds * 1_000_000)).cast("int")
    numbered = running_total(gaps, [key], [F.col("_us"), F.col(tie)], opens, "session_no", **options)
    return numbered.groupBy(key, "session_no").agg(
        F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events")
    )


def store(turns: DataFrame, turns_per_part: int = 1000) -> DataFrame:
    """Conversations as JSON, ``turns_per_part`` turns to a row, so a very long one spans several rows."""
    part = F.floor((F.col("turn_no") - 1) / turns_per_part).cast("int")
    entry = F.struct("turn_no", "question", "answer", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))
    return turns.groupBy("conversation_id", part.alias("part_no")).agg(
        F.to_json(F.array_sort(F.collect_list(entry))).alias("body")
    )


def load(stored: DataFrame) -> DataFrame:
    """Turns of stored conversations."""
    schema = "array<struct<turn_no:int,question:string,answer:string,ts:string>>"
    rows = stored.select("conversation_id", F.inline(F.from_json("body", schema)))
    return rows.withColumn("ts", F.to_timestamp("ts"))
