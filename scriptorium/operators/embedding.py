"""Embedding each distinct text once."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions.text import contains_any
from scriptorium.functions.vectors import Embedder, bag_of_words


def enrich_text(
    text: Column, mappings: Mapping[str, str] = lex.EMBED_MAPPINGS, terms: Sequence[str] = lex.EMBED_TERMS,
    prefix: str = lex.EMBED_PREFIX,
) -> Column:
    """Expand known terms one after the other, then prefix texts of the domain."""
    for term, expansion in mappings.items():
        text = F.regexp_replace(text, "(?iu)" + re.escape(term), f"{term} {expansion}")
    return F.when(contains_any(F.lower(text), terms), F.concat(F.lit(prefix), text)).otherwise(text)


def embed_with_cache(
    texts: DataFrame, cache: DataFrame | None = None, embedder: Embedder = bag_of_words, prepare=None
) -> tuple[DataFrame, DataFrame]:
    """Vectors for ``texts(text, …)`` and the new cache entries ``(text_md5, vec)``.

    Only distinct texts missing from the cache are embedded.  Copies are reduced before the shuffle; joining the
    vectors back leaves a text with very many copies to AQE's skew-join split.
    """
    keyed = texts.withColumn("text_md5", F.md5("text"))
    distinct = keyed.select("text_md5", "text").dropDuplicates(["text_md5"])
    missing = distinct if cache is None else distinct.join(cache, "text_md5", "left_anti")
    subject = F.col("text") if prepare is None else prepare(F.col("text"))
    fresh = missing.select("text_md5", embedder(subject).alias("vec"))
    known = fresh if cache is None else fresh.unionByName(cache.select("text_md5", "vec"))
    return keyed.join(known, "text_md5"), fresh
