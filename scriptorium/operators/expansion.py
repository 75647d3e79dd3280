"""Query expansion: every query's variants in one pass, built inside the query's row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions.rules import Rule, classify
from scriptorium.functions.text import contained_terms, contains_any, strip, tokens


def _distinct_ignoring_case(values: Column) -> Column:
    seen = F.transform(values, lambda v: F.trim(F.lower(v)))
    numbered = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    firsts = F.filter(numbered, lambda x: F.array_position(seen, F.trim(F.lower(x["v"]))) == x["i"] + 1)
    return F.transform(firsts, lambda x: x["v"])


def _string_map(table: Mapping[str, Sequence[str]]) -> Column:
    entries = [part for k, v in table.items() for part in (F.lit(k), F.array(*map(F.lit, v)))]
    return F.create_map(*entries)


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def key_terms(
    query: Column, stop_words: Sequence[str] = lex.KEY_TERM_STOP_WORDS,
    synonyms: Mapping[str, Sequence[str]] = lex.EXPANSION_SYNONYMS, fallback: int | None = None,
) -> Column:
    """Known terms of the query, or its words (the first ``fallback`` if given), without stop words and two-letter words."""
    known = set(synonyms) | {s for group in synonyms.values() for s in group}
    found = F.filter(tokens(query), lambda w: ~w.isin(*stop_words) & (F.length(w) > 2))
    technical = F.filter(found, lambda w: w.isin(*sorted(known)))
    return F.when(F.size(technical) > 0, technical).otherwise(_first(found, fallback))


def expand(
    queries: DataFrame,
    rules: Sequence[Rule] = lex.EXPANSION_TYPES,
    templates: Mapping[str, Sequence[str]] = lex.EXPANSION_TEMPLATES,
    synonyms: Mapping[str, Sequence[str]] = lex.EXPANSION_SYNONYMS,
    stop_words: Sequence[str] = lex.KEY_TERM_STOP_WORDS,
    domains: Sequence[str] = lex.CONTEXT_DOMAINS,
    limit: int | None = None,
    fallback: int | None = None,
    forms_per_type: int | None = None,
    options_per_term: int | None = None,
    swaps: int | None = None,
    contexts: int | None = None,
) -> DataFrame:
    """Variants of ``queries(query_id, text)``: the text, templates per term, synonyms, context.

    All of them, or the first ``limit``; the other numbers bound the terms of a text without known ones, the templates of a
    type, the synonyms of a term, the variants by synonyms and those by context.
    """
    low = strip(F.lower("text"))
    kind = classify(low, rules, "technical")
    chosen = F.lit(None)
    for name, forms in templates.items():
        chosen = F.when(kind == name, F.array(*map(F.lit, forms[:forms_per_type]))).otherwise(chosen)
    terms = key_terms(F.col("text"), stop_words, synonyms, fallback)
    from_templates = F.flatten(F.transform(F.col("_terms"), lambda term: F.transform(
        F.col("_forms"), lambda form: F.replace(form, F.lit("{term}"), term)
    )))
    table = _string_map(synonyms)
    swapped = F.flatten(F.transform(F.col("_terms"), lambda term: F.transform(
        F.coalesce(_first(F.try_element_at(table, term), options_per_term), F.array().cast("array<string>")),
        lambda s: F.replace(F.col("_low"), term, s),
    )))
    from_synonyms = _first(F.filter(swapped, lambda v: v != F.col("_low")), swaps)
    context = F.concat(
        F.when(contains_any(F.col("_low"), domains), F.array().cast("array<string>"))
        .otherwise(F.array(*[F.concat(F.col("_low"), F.lit(s)) for s in lex.CONTEXT_SUFFIXES])),
        F.when(contains_any(F.col("_low"), lex.SIMULATION_WORDS),
               F.array(F.concat(F.col("_low"), F.lit(lex.SIMULATION_SUFFIX))))
        .otherwise(F.array().cast("array<string>")),
    )
    prepared = queries.withColumns({
        "_low": low, "_terms": terms, "_forms": F.coalesce(chosen, F.array().cast("array<string>")),
    })
    return prepared.withColumn("_all", F.concat(
        F.array(strip(F.col("text"))), from_templates, from_synonyms, _first(context, contexts)
    )).select("query_id", F.posexplode(_first(_distinct_ignoring_case(F.col("_all")), limit)).alias(
        "variant_no", "query_text"
    ))


def optimise(
    queries: DataFrame,
    synonyms: Mapping[str, Sequence[str]] = lex.OPTIMISER_SYNONYMS,
    contexts: Mapping[str, str] = lex.OPTIMISER_CONTEXTS,
    question_words: Sequence[str] = lex.QUESTION_WORDS,
    definition_words: Sequence[str] = lex.DEFINITION_QUESTION_WORDS,
    explanation_word: str = lex.EXPLANATION_QUESTION_WORD,
    limit: int | None = None,
    options_per_term: int | None = None,
) -> DataFrame:
    """Lower-cased query, synonym swaps, context suffixes and rewritten questions; ordered, distinct.

    All variants, or the first ``limit``, with all synonyms of a term, or its first ``options_per_term``.
    """
    raw, low = F.lower("text"), strip(F.lower("text"))
    swaps = []
    for term, options in synonyms.items():
        for option in options[:options_per_term]:
            new = F.replace(raw, F.lit(term), F.lit(option))
            swaps.append(F.when(raw.contains(term) & (new != raw), new))
    suffixed = [F.when(raw.contains(t), F.concat(raw, F.lit(" " + c))) for t, c in contexts.items()]
    rewritten = []
    for word in question_words:
        bare = strip(F.replace(low, F.lit(word), F.lit("")))
        starts = low.startswith(word)
        rewritten.append(F.when(starts & (bare != ""), bare))
        if word in definition_words:
            rewritten.append(F.when(starts, F.concat(F.lit("definição "), bare)))
        elif word == explanation_word:
            rewritten.append(F.when(starts, F.concat(F.lit("explicação "), bare)))
    plain = F.when(~contains_any(low, question_words), F.concat(F.lit("conceito "), low))
    every = F.array_compact(F.array(low, *swaps, *suffixed, *rewritten, plain))
    variants = F.array_distinct(every)
    variants = F.slice(variants, 1, limit) if limit else variants
    return queries.select("query_id", F.posexplode(variants).alias("variant_no", "query_text"))


def query_terms(
    text: Column, terms: Sequence[str] = (*lex.OPTIMISER_SYNONYMS, *lex.OPTIMISER_CONTEXTS),
    unit_pattern: str = lex.NUMBER_WITH_UNIT,
) -> Column:
    """Known terms inside the query, then numbers with a unit."""
    low = F.lower(text)
    return F.concat(contained_terms(low, terms), F.regexp_extract_all(low, F.lit(unit_pattern), F.lit(0)))
