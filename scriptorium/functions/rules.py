"""Ordered keyword rules compiled to one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import contains_any


@dataclass(frozen=True)
class Rule:
    """``label`` applies when every group has a keyword inside the text."""

    label: str
    groups: tuple[tuple[str, ...], ...]


def rule(label: str, *groups: Sequence[str]) -> Rule:
    return Rule(label, tuple(tuple(g) for g in groups))


def _holds(text: Column, r: Rule, whole_word: bool) -> Column:
    found = F.lit(True)
    for group in r.groups:
        if whole_word:
            alternatives = "|".join(r"\Q%s\E" % k for k in group)
            found = found & text.rlike(r"(?U)(?<!\w)(%s)(?!\w)" % alternatives)
        else:
            found = found & contains_any(text, group)
    return found


def classify(
    text: Column, rules: Sequence[Rule], default: str | Column, lower: bool = True, whole_word: bool = False
) -> Column:
    """Label of the first rule that holds."""
    subject = F.lower(text) if lower else text
    case = None
    for r in rules:
        test = _holds(subject, r, whole_word)
        case = F.when(test, r.label) if case is None else case.when(test, r.label)
    fallback = F.lit(default) if isinstance(default, str) else default
    return fallback if case is None else case.otherwise(fallback)


def first_match(text: Column, patterns: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Label of the first group with a matching regular expression."""
    case = None
    for label, group in patterns:
        test = F.lit(False)
        for p in group:
            test = test | text.rlike(p)
        case = F.when(test, label) if case is None else case.when(test, label)
    return case.otherwise(default)
