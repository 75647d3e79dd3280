"""Tokens, words and sentences as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once; inside a lambda an outer expression runs again per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first(values: Column, n: int | None) -> Column:
    """The first ``n`` values, or all if no number is given."""
    return values if n is None else F.slice(values, 1, n)


def head(text: Column, n: int | None) -> Column:
    """The first ``n`` characters, or the whole text if no number is given."""
    return text if n is None else F.substring(text, 1, n)


def shortened(text: Column, n: int | None) -> Column:
    """The first ``n`` characters and dots, or the whole text if no number is given."""
    return text if n is None else F.concat(F.substring(text, 1, n), F.lit("..."))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column, min_length: int = 1) -> Column:
    """Lower-cased runs of letters, digits and underscore, in order."""
    pattern = TOKEN if min_length == 1 else r"[\p{L}\p{N}_]{%d,}" % min_length
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms], F.lit(False))


def mentions_any(text: Column, terms: Iterable[str]) -> Column:
    """Whether the lower-cased text contains a term; lower-cased once, also inside a lambda."""
    wanted = list(terms)
    return let(F.lower(text), lambda low: contains_any(low, wanted))


def count_contained(text: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in terms], F.lit(0))


def contained_terms(text: Column, terms: Iterable[str]) -> Column:
    """The terms that occur in ``text``, in lexicon order."""
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in terms]))


def sentences_long(text: Column) -> Column:
    """Sentences of more than ten characters."""
    parts = F.transform(F.split(text, r"[.!?]+\s+"), strip)
    return F.filter(parts, lambda s: F.length(s) > 10)


def sentences_guarded(text: Column, min_length: int = 20) -> Column:
    """Sentences of a minimum length; a stop after a known abbreviation does not end one."""
    held = F.regexp_replace(text, r"\b(Fig|Table|Eq|Dr|Prof|et al)\.\s", "$1\u0001 ")
    parts = F.transform(F.split(held, r"[.!?]+\s+"), lambda s: strip(F.replace(s, F.lit("\u0001"), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) >= min_length)


def sentences_after_lowercase(text: Column) -> Column:
    """Segments that end after a lower-case letter, digit or closing bracket."""
    parts = F.transform(F.split(text, r"(?<=[a-z0-9\])])[.!?]+\s+"), strip)
    return F.filter(parts, lambda s: s != "")


def sentences_plain(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[.!?]+"), strip)
    return F.filter(parts, lambda s: s != "")


def split_sentences(text: Column, variant: str = "long") -> Column:
    return {
        "long": sentences_long,
        "guarded": sentences_guarded,
        "after_lowercase": sentences_after_lowercase,
        "plain": sentences_plain,
    }[variant](text)
