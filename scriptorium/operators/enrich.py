"""Acronym definitions, related concepts and missing definitions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions.text import contains_any, words


def _whole_word(text: Column, term: str) -> Column:
    return text.rlike(r"(?iU)\b" + re.escape(term) + r"\b")


def acronyms(text: Column, table: Mapping[str, str] = lex.ACRONYMS) -> Column:
    """Acronyms that occur as whole words in any case, in table order."""
    return F.array_compact(F.array(*[F.when(_whole_word(text, a), F.lit(a)) for a in table]))


def _append_new(text: Column, notes: Column, same_case: bool) -> Column:
    """Append each note(test, text) whose test is not inside the text yet."""
    fold = (lambda c: c) if same_case else F.lower
    return F.aggregate(
        notes, text,
        lambda s, n: F.when(F.contains(fold(s), fold(n["test"])), s).otherwise(F.concat(s, n["note"])),
    )


def with_definitions(
    content: Column, query: Column, table: Mapping[str, str] = lex.ACRONYMS,
    related: Mapping[str, Sequence[str]] = lex.RELATED_CONCEPTS,
) -> Column:
    """Content followed by the definitions of its acronyms and the concepts its query asks for."""
    def note(test: str, text: str) -> Column:
        return F.struct(F.lit(test).alias("test"), F.lit(text).alias("note"))

    definitions = F.array_compact(F.array(*[
        F.when(_whole_word(content, a), note(d, f"\n\n[DEFINIÇÃO: {d}]")) for a, d in table.items()
    ]))
    low = F.lower(query)
    concepts = []
    for term, names in related.items():
        text = f"\n\n[CONCEITOS RELACIONADOS A '{term.upper()}': {', '.join(names)}]"
        concepts.append(F.when(low.contains(term), note(text, text)))
    defined = _append_new(content, definitions, same_case=False)
    return _append_new(defined, F.array_compact(F.array(*concepts)), same_case=True)


def build_context(
    query_documents: DataFrame, table: Mapping[str, str] = lex.ACRONYMS, asks: Sequence[str] = lex.MEANING_WORDS
) -> DataFrame:
    """Definitions block, documents and instruction for ``(query_id, query_text, documents array<string>)``."""
    lines = F.array_compact(F.array(*[F.when(_whole_word(F.col("query_text"), a), F.lit("• " + d)) for a, d in table.items()]))
    body = F.array_join("documents", "\n\n")
    headed = F.when(
        F.size(lines) > 0,
        F.concat(F.lit(lex.DEFINITIONS_HEADING), F.array_join(lines, "\n"), F.lit("\n\n"), body),
    ).otherwise(body)
    asked = contains_any(F.lower("query_text"), asks)
    return query_documents.select(
        "query_id",
        F.when(asked, F.concat(headed, F.lit(lex.MEANING_INSTRUCTION))).otherwise(headed).alias("context"),
    )


def definition_gaps(
    queries: DataFrame, hits: DataFrame, table: Mapping[str, str] = lex.ACRONYMS,
    asks: Sequence[str] = lex.MEANING_WORDS, keyword: str = lex.GAP_KEYWORD,
) -> DataFrame:
    """(query, acronym) pairs asked for whose definition keyword is in no hit of the query."""
    asked = queries.where(contains_any(F.lower("query_text"), asks)).select(
        "query_id",
        F.explode(F.array_distinct(F.filter(
            words(F.upper("query_text")), lambda w: (F.length(w) <= 10) & w.rlike(r"^\p{L}+$") & w.isin(*table)
        ))).alias("acronym"),
    )
    covered = hits.where(F.lower("content").contains(keyword)).select("query_id").distinct()
    findable = [a for a, d in table.items() if keyword in d.lower()]
    answered = asked.where(F.col("acronym").isin(*findable)).join(covered, "query_id", "left_semi")
    return asked.join(answered, ["query_id", "acronym"], "left_anti")
