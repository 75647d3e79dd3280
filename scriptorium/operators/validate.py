"""Boolean tests of bibliographic fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import strip, words
from scriptorium.lexicons import NON_NAME_WORDS, PLACEHOLDERS

# Accepted publication years and letters of a name.
YEAR_MIN, YEAR_MAX = 1900, 2026
NAME_PATTERN = r"^[A-Za-záàâãäéèêëíìîïóòôõöúùûüçñ'\-]+$"


def valid_year(year: Column, latest: int = YEAR_MAX) -> Column:
    return F.coalesce(year.between(YEAR_MIN, latest), F.lit(False))


def valid_field(value: Column) -> Column:
    """At least three characters, not a placeholder and not a UUID."""
    v = strip(value)
    ok = (F.length(v) >= 3) & ~F.lower(v).isin(*PLACEHOLDERS) & ~v.rlike(r"(?i)^[0-9a-f\-]{32,}$")
    return F.coalesce(ok, F.lit(False))


def name_token(token: Column) -> Column:
    """Capitalised word of at least three letters that is not a known non-name."""
    return (
        (F.length(token) >= 3) & token.rlike(r"^\p{Lu}") & token.rlike(NAME_PATTERN)
        & ~F.lower(token).isin(*NON_NAME_WORDS)
    )


def valid_author(name: Column) -> Column:
    """At least two words without digits, one of them a name token."""
    n = strip(name)
    parts = words(F.replace(n, F.lit(","), F.lit(" ")))
    ok = (F.length(n) >= 5) & ~n.rlike(r"\d") & (F.size(parts) >= 2) & F.exists(parts, name_token)
    return F.coalesce(ok, F.lit(False))
