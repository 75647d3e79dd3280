"""Labels and scores of a text from keyword rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions.rules import Rule, classify, first_match
from scriptorium.functions.text import contains_any, let, mentions_any, strip, tokens, words


def priority_section(
    content: Column, page: Column, rules: Sequence[Rule] = lex.PRIORITY_RULES, whole_word: bool = False
) -> Column:
    """Section label of a chunk; unlabelled chunks of the first three pages are ``early_page``."""
    fallback = F.when(page <= 3, F.lit("early_page")).otherwise(F.lit("regular"))
    return classify(content, rules, fallback, whole_word=whole_word)


def page_type(text: Column, rules: Sequence[Rule] = lex.PAGE_TYPE_RULES) -> Column:
    return let(F.lower(text), lambda low: classify(low, rules, "general", lower=False))


def line_section(line: Column, patterns=lex.SECTION_PATTERNS, hints: Sequence[str] | None = lex.SECTION_HINTS) -> Column:
    """Label of the first pattern group that matches.

    All groups after the first need one of the ``hints``, so lines without any skip their expressions.
    """
    if hints is None:
        return first_match(line, patterns, "body")
    head = patterns[0][0]

    def label(x: Column) -> Column:
        first = first_match(x, patterns[:1], "body")
        rest = F.when(mentions_any(x, hints), first_match(x, patterns[1:], "body")).otherwise("body")
        return F.when(first == head, head).otherwise(rest)

    return let(line, label)


def section_importance(section: Column, weights=lex.SECTION_IMPORTANCE) -> Column:
    case = F.lit(1.0)
    for name, value in weights.items():
        case = F.when(section == name, F.lit(float(value))).otherwise(case)
    return case


def question_type(question: Column, rules: Sequence[Rule], default: str = "general") -> Column:
    return classify(question, rules, default)


def leading_question_word(question: Column, question_words: Sequence[str] = lex.QUESTION_WORDS) -> Column:
    """First question word that starts the question, or null."""
    q = strip(F.lower(question))
    return F.coalesce(*[F.when(q.startswith(w), F.lit(w)) for w in question_words])


def has_terms(text: Column, terms: Sequence[str]) -> Column:
    return contains_any(F.lower(text), terms)


def complexity(question: Column, terms: Sequence[str] = lex.COMPLEXITY_TERMS) -> Column:
    def level(said: Column) -> Column:
        known = F.size(F.filter(said, lambda w: w.isin(*terms)))
        return F.when(F.size(said) < 5, "simple").when((F.size(said) < 15) & (known <= 1), "moderate").otherwise("complex")

    return let(words(F.lower(question)), level)


def term_density(text: Column, terms: Sequence[str] = lex.TRAINING_TERMS) -> Column:
    """min(10 · share of lexicon tokens, 1)."""
    return let(tokens(text), lambda found: F.when(F.size(found) > 0, F.least(
        F.size(F.filter(found, lambda w: w.isin(*terms))) / F.size(found) * 10, F.lit(1.0)
    )).otherwise(0.0))
