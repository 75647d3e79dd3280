"""Answer quality: relevance, consistency with sources, technical accuracy, completeness, clarity, overall verdict.

Works on ``responses(response_id, question, answer, sources array<string>)`` inside the row, so a table of any number
of responses is scored in one scan without a shuffle.  Vocabularies come from a ``Vocabulary``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.rules import Rule, classify
from scriptorium.functions.text import (
    count_contained, first, let, mentions_any, sentences_plain, tokens, word_count, words,
)
from scriptorium.functions.vectors import Embedder, bag_of_words, cosine
from scriptorium.lexicons import CRITIQUE_TYPES


@dataclass(frozen=True)
class Vocabulary:
    """Fixed values of the critique; replace any of them for another domain."""

    #: Bounds on keywords of a text, claims of an answer and words of an aspect; none by default.
    keywords: int | None = None
    claims: int | None = None
    aspect_words: int | None = None
    question_types: Sequence[Rule] = CRITIQUE_TYPES
    stop_words: Sequence[str] = (
        "que", "como", "qual", "onde", "quando", "por", "para", "com", "sem", "the", "and", "or", "but", "in", "on",
        "at", "to", "for", "of", "with", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do",
        "does", "did", "will", "would", "could", "should", "can", "may",
    )
    priority_terms: Sequence[str] = (
        "insim", "permeabilidade", "permeability", "porosidade", "porosity", "saturação", "saturation", "viscosidade",
        "viscosity", "densidade", "density", "simulação", "simulation", "reservatório", "reservoir",
    )
    structure: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        "definition": ("é", "significa", "refere-se", "definido como", "is defined"),
        "process": ("primeiro", "segundo", "etapa", "passo", "step", "process"),
        "explanation": ("porque", "devido", "razão", "causa", "because", "due to"),
        "selection": ("melhor", "recomendado", "ideal", "best", "recommended"),
        "factual": ("localizado", "ocorre", "happens", "located"),
    })
    claim_indicators: Sequence[str] = (
        "é", "são", "tem", "possui", "caracteriza-se", "define-se", "is", "are", "has", "have", "characterized by",
        "defined as",
    )
    claim_stop_words: Sequence[str] = ("que", "para", "com", "uma", "dos", "das", "the", "and", "for", "with")
    contradictions: Sequence[tuple[str, str]] = (
        ("não é", "é"), ("não tem", "tem"), ("impossível", "possível"), ("never", "always"), ("cannot", "can"),
    )
    units: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        "permeability": ("md", "millidarcy", "darcy", "m²", "m2"),
        "pressure": ("psi", "bar", "pa", "pascal", "atm"),
        "viscosity": ("cp", "centipoise", "pa.s", "pas"),
        "density": ("kg/m³", "g/cm³", "lb/ft³"),
        "rate": ("bbl/d", "bpd", "m³/d", "scf/d"),
    })
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=lambda: {
        "permeability": (0.1, 10000.0), "porosity": (0.05, 0.35), "oil_viscosity": (0.1, 1000.0),
        "water_saturation": (0.0, 1.0),
    })
    technical_terms: Sequence[str] = (
        "insim", "insim-ft", "eclipse", "cmg", "simulação", "simulation", "permeabilidade", "permeability",
        "porosidade", "porosity", "saturação", "saturation", "viscosidade", "viscosity",
    )
    error_patterns: Sequence[str] = (
        "permeabilidade.*alta.*porosidade", "viscosidade.*temperatura", "pressão.*profundidade.*linear",
    )
    connectives: Sequence[str] = (
        "primeiro", "segundo", "finalmente", "portanto", "além disso", "first", "second", "finally", "therefore",
        "furthermore",
    )
    several_questions: Sequence[str] = (
        r"\be\s+(?:como|qual|onde|quando|por\s+que)", r"\band\s+(?:how|what|where|when|why)",
        r"[,;]\s*(?:como|qual|onde|quando|por\s+que)", r"[,;]\s*(?:how|what|where|when|why)",
    )
    aspect_split: str = r"[,;]\s*(?:e\s+)?(?:and\s+)?"


DEFAULT = Vocabulary()
NAME_VALUE = r"([\p{L}\p{N}_]+)\s*[=:]\s*([\d.,]+)\s*([\p{L}\p{N}_]+)?"


def _keywords(text: Column, v: Vocabulary) -> Column:
    """Priority terms in their own order, then the other words in text order."""
    def ordered(found: Column) -> Column:
        known = F.array_intersect(F.array(*map(F.lit, v.priority_terms)), found)
        return first(F.concat(known, F.array_except(found, known)), v.keywords)

    return let(F.array_distinct(F.filter(tokens(text, 3), lambda w: ~w.isin(*v.stop_words))), ordered)


def relevance(question: Column, answer: Column, v: Vocabulary = DEFAULT, embedder: Embedder = bag_of_words) -> Column:
    """struct(score, similarity, overlap, question_type, structure)."""
    similarity = F.round(let(embedder(question), lambda a: let(embedder(answer), lambda b: cosine(a, b))), 9)
    overlap = let(_keywords(question, v), lambda asked: F.when(
        F.size(asked) > 0, F.size(F.array_intersect(asked, _keywords(answer, v))) / F.size(asked)
    ).otherwise(0.0))
    kind = classify(question, v.question_types, "general")
    structure = F.lit(0.7)
    for name, found in v.structure.items():
        share = count_contained(F.lower(answer), found) / len(found) + 0.3
        structure = F.when(kind == name, F.least(F.lit(1.0), share)).otherwise(structure)
    parts = F.struct(
        similarity.alias("similarity"), overlap.alias("overlap"), kind.alias("question_type"), structure.alias("structure")
    )
    return let(parts, lambda p: F.struct(
        F.least(F.lit(1.0), p["similarity"] * 0.4 + p["overlap"] * 0.3 + p["structure"] * 0.3).alias("score"),
        p["similarity"].alias("similarity"), p["overlap"].alias("overlap"), p["question_type"].alias("question_type"),
        p["structure"].alias("structure"),
    ))


def claims(answer: Column, v: Vocabulary = DEFAULT) -> Column:
    """Sentences with a factual indicator, the first ``v.claims`` if a number is given."""
    return first(F.filter(
        sentences_plain(answer), lambda s: (F.length(s) >= 10) & mentions_any(s, v.claim_indicators)
    ), v.claims)


def _claim_words(text: Column, v: Vocabulary) -> Column:
    return F.filter(tokens(text, 4), lambda w: ~w.isin(*v.claim_stop_words))


def supported(claim: Column, source_words: Column, v: Vocabulary = DEFAULT) -> Column:
    """Whether one source shares more than half of the claim's words."""
    return let(_claim_words(claim, v), lambda said: F.exists(
        source_words, lambda s: (F.size(said) > 0) & (F.size(F.array_intersect(said, s)) / F.size(said) > 0.5)
    ))


def contradiction_count(answer: Column, sources: Column, v: Vocabulary = DEFAULT) -> Column:
    """Negative in one and positive in the other, either way round."""
    a, s = F.lower(answer), F.lower(F.array_join(sources, " "))
    total = F.lit(0)
    for negative, positive in v.contradictions:
        either = (a.contains(negative) & s.contains(positive)) | (a.contains(positive) & s.contains(negative))
        total = total + either.cast("int")
    return total


def consistency(answer: Column, sources: Column, v: Vocabulary = DEFAULT) -> Column:
    """struct(score, claims, supported, contradictions)."""
    texts = F.transform(sources, lambda s: _claim_words(s, v))
    checked = let(texts, lambda t: F.transform(claims(answer, v), lambda c: supported(c, t, v)))
    counts = let(checked, lambda ok: F.struct(
        F.size(ok).alias("claims"), F.size(F.filter(ok, lambda b: b)).alias("supported"),
        contradiction_count(answer, sources, v).alias("contradictions"),
    ))

    def rated(n: Column) -> Column:
        base = F.when(n["claims"] > 0, n["supported"] / n["claims"]).otherwise(0.8)
        score = F.when(F.size(sources) == 0, 0.5).otherwise(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (1 - n["contradictions"] * 0.2)))
        )
        return F.struct(
            score.alias("score"), n["claims"].alias("claims"), n["supported"].alias("supported"),
            n["contradictions"].alias("contradictions"),
        )

    return let(counts, rated)


def _whole(term: str) -> str:
    return r"(?iu)(?<![\p{L}\p{N}_])" + re.escape(term) + r"(?![\p{L}\p{N}_])"


def unit_consistency(text: Column, v: Vocabulary = DEFAULT) -> Column:
    """struct(score, mentions, with_unit): properties mentioned with one of their units in the text."""
    mentions, good = F.lit(0), F.lit(0)
    for name, units in v.units.items():
        pattern = r"(?iu)(?<![\p{L}\p{N}_])" + name.replace("_", r"[\s_]") + r"(?![\p{L}\p{N}_])"
        count = F.regexp_count(text, F.lit(pattern))
        unit = F.lit(False)
        for u in units:
            unit = unit | text.rlike(_whole(u))
        mentions = mentions + count
        good = good + F.when((count > 0) & unit, 1).otherwise(0)
    return let(F.struct(mentions.alias("m"), good.alias("g")), lambda c: F.struct(
        F.when(c["m"] > 0, c["g"] / c["m"]).otherwise(1.0).alias("score"), c["m"].alias("mentions"),
        c["g"].alias("with_unit"),
    ))


def numeric_ranges(text: Column, v: Vocabulary = DEFAULT) -> Column:
    """struct(score, checked, in_range) for every ``name = value unit``; unknown names count as in range."""
    names = F.regexp_extract_all(text, F.lit(NAME_VALUE), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(NAME_VALUE), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, x: F.struct(
        F.lower(n).alias("n"), F.replace(x, F.lit(","), F.lit(".")).try_cast("double").alias("x")
    ))

    def inside(p: Column) -> Column:
        case = F.lit(True)
        for name, (low, high) in reversed(list(v.ranges.items())):
            case = F.when(p["n"].contains(name), p["x"].between(low, high)).otherwise(case)
        return case

    counts = let(F.filter(pairs, lambda p: p["x"].isNotNull()), lambda read: F.struct(
        F.size(read).alias("checked"), F.size(F.filter(read, inside)).alias("in_range")
    ))
    return let(counts, lambda c: F.struct(
        F.when(c["checked"] > 0, c["in_range"] / c["checked"]).otherwise(1.0).alias("score"),
        c["checked"].alias("checked"), c["in_range"].alias("in_range"),
    ))


def term_band(text: Column, v: Vocabulary = DEFAULT) -> Column:
    """1.0 for 5–20 % of lexicon terms per word, 0.7 below, 0.8 above."""
    n = word_count(text)
    density = F.when(n > 0, count_contained(F.lower(text), v.technical_terms) / n).otherwise(0.0)
    return let(density, lambda d: F.when(d.between(0.05, 0.2), 1.0).when(d < 0.05, 0.7).otherwise(0.8))


def known_errors(text: Column, v: Vocabulary = DEFAULT) -> Column:
    count = F.lit(0)
    for p in v.error_patterns:
        count = count + F.lower(text).rlike(p).cast("int")
    return F.greatest(F.lit(0.0), 1.0 - count * 0.3)


def technical_accuracy(text: Column, v: Vocabulary = DEFAULT) -> Column:
    parts = (
        unit_consistency(text, v)["score"], numeric_ranges(text, v)["score"], term_band(text, v), known_errors(text, v)
    )
    return (parts[0] + parts[1] + parts[2] + parts[3]) / 4


def aspects(question: Column, v: Vocabulary = DEFAULT) -> Column:
    """Keyword lists of the question's parts; one part unless it asks several things."""
    several = F.lit(False)
    for p in v.several_questions:
        several = several | F.lower(question).rlike("(?U)" + p)

    def long_words(text: Column) -> Column:
        return F.filter(words(text), lambda w: F.length(w) > 3)

    parts = F.filter(F.transform(F.split(question, v.aspect_split), long_words), lambda k: F.size(k) > 0)
    chosen = F.when(several, parts).otherwise(F.array(long_words(question)))
    return F.transform(chosen, lambda k: first(k, v.aspect_words))


def completeness(question: Column, answer: Column, v: Vocabulary = DEFAULT) -> Column:
    """Share of aspects with a keyword in the answer; × 0.7 below twenty words."""
    asked = aspects(question, v)
    met = let(F.lower(answer), lambda low: F.transform(asked, lambda k: F.exists(k, lambda w: F.contains(low, w))))
    share = let(met, lambda m: F.when(
        F.size(m) > 0, F.size(F.filter(m, lambda b: b)) / F.size(m)
    ).otherwise(0.8))
    return F.least(F.lit(1.0), F.when(word_count(answer) < 20, share * 0.7).otherwise(share))


def clarity(answer: Column, v: Vocabulary = DEFAULT) -> Column:
    """Mean of sentence length, connectives and jargon balance."""
    mean = let(F.transform(sentences_plain(answer), word_count), lambda n: F.when(
        F.size(n) > 0, F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.size(n)
    ))
    length = let(mean, lambda m: (
        F.when(m.isNull(), 0.5).when(m.between(15, 25), 1.0).when(m < 15, 0.8)
        .otherwise(F.greatest(F.lit(0.5), 1.0 - (m - 25) * 0.02))
    ))
    linked = F.least(F.lit(1.0), count_contained(F.lower(answer), v.connectives) * 0.2 + 0.6)
    n = word_count(answer)
    jargon = F.size(F.filter(words(F.lower(answer)), lambda w: w.isin(*v.technical_terms)))
    balance = let(F.when(n > 0, jargon / n).otherwise(0.0), lambda r: F.when(r.between(0.1, 0.2), 1.0).when(
        r < 0.1, 0.8
    ).otherwise(F.greatest(F.lit(0.6), 1.0 - (r - 0.2) * 2)))
    return (length + linked + balance) / 3


# Weights, thresholds and messages.
CHECKS = (
    ("relevance", 0.25, 0.7, "Answer relevance to question is low", "Improve focus on specific question aspects"),
    ("factual", 0.25, 0.6, "Factual consistency with sources is questionable", "Verify claims against source documents"),
    ("technical", 0.20, 0.7, "Technical accuracy needs improvement", "Check technical terms, units, and numerical values"),
    ("completeness", 0.15, 0.6, "Answer lacks completeness", "Address all aspects of the question"),
    ("clarity", 0.15, 0.6, "Answer clarity can be improved", "Use clearer language and better structure"),
)
OVERALL_MINIMUM = 0.6


def critique(responses: DataFrame, v: Vocabulary = DEFAULT, embedder: Embedder = bag_of_words) -> DataFrame:
    """All scores rounded to three digits, issues, suggestions and whether the answer passes."""
    q, a, s = F.col("question"), F.col("answer"), F.col("sources")
    scored = responses.select("response_id", "sources", *[F.round(c, 9).alias(n) for n, c in (
        ("relevance", relevance(q, a, v, embedder)["score"]), ("factual", consistency(a, s, v)["score"]),
        ("technical", technical_accuracy(a, v)), ("completeness", completeness(q, a, v)), ("clarity", clarity(a, v)),
    )])
    overall = F.lit(0.0)
    for name, weight, *_ in CHECKS:
        overall = overall + F.col(name) * weight
    n = F.size("sources")
    base = F.when(n == 0, 0.3).when(n == 1, 0.6).when(n <= 3, 0.8).otherwise(0.9)
    confidence = F.least(F.lit(1.0), base * ((F.col("relevance") + F.col("factual")) / 2))
    valid = (F.round(overall, 9) >= OVERALL_MINIMUM) & (F.col("relevance") >= 0.7) & (F.col("factual") >= 0.6)
    return scored.select(
        "response_id",
        F.round(overall, 3).alias("overall"), *[F.round(c[0], 3).alias(c[0]) for c in CHECKS],
        F.round(confidence, 3).alias("confidence"), valid.alias("validated"),
        F.array_compact(F.array(*[F.when(F.col(c[0]) < c[2], F.lit(c[3])) for c in CHECKS])).alias("issues"),
        F.array_compact(F.array(*[F.when(F.col(c[0]) < c[2], F.lit(c[4])) for c in CHECKS])).alias("suggestions"),
    )
