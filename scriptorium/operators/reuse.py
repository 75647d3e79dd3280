"""Reuse of stored results: canonical keys, lookups against earlier writes, deletion and figures.

``access(key, kind get/set, ts, id, ttl, tags, size)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import first
from scriptorium.scale import last_known


def canonical_key(prefix: str, arguments: Column) -> Column:
    """``prefix:md5`` of a string map as JSON with sorted keys."""
    entries = F.transform(F.array_sort(F.map_entries(arguments)), lambda e: F.concat(
        F.lit('"'), e["key"], F.lit('": "'), e["value"], F.lit('"')
    ))
    body = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    return F.concat(F.lit(prefix + ":"), F.md5(body))


def answer_key(question: Column, contents: Column, top: int | None = None) -> Column:
    """Key of an answer: the question and the md5 of its contents, the best ``top`` if a number is given."""
    return F.md5(F.concat_ws("|", question, F.md5(F.array_join(first(contents, top), "|"))))


def lookups(access: DataFrame, **options) -> DataFrame:
    """Each read with the latest earlier write of its key; a hit while that write is younger than its TTL.

    A write at the same moment counts as earlier.
    """
    write = F.when(F.col("kind") == "set", F.struct("ts", "ttl"))
    order = [F.col("ts"), (F.col("kind") == "get").cast("int"), F.col("id")]
    seen = last_known(access, ["key"], order, write, "_write", **options)
    age = F.unix_micros("ts") - F.unix_micros(F.col("_write.ts"))
    return seen.where(F.col("kind") == "get").select(
        "id", "key", "ts", F.col("_write.ts").alias("written"),
        F.coalesce(age < F.col("_write.ttl").cast("long") * 1_000_000, F.lit(False)).alias("hit"),
    )


def latest_entries(access: DataFrame) -> DataFrame:
    """The stored entry of each key: its last write."""
    last = F.max_by(F.struct("id", "ts", "ttl", "tags", "size"), F.struct("ts", "id"))
    return access.where(F.col("kind") == "set").groupBy("key").agg(last.alias("e")).select("key", "e.*")


def delete_tagged(entries: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Entries that carry none of the tags."""
    return entries.where(~F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def delete_matching(entries: DataFrame, pattern: str | None = None, regex: bool = False) -> DataFrame:
    """Entries whose key does not contain (or match) the pattern; no pattern deletes all."""
    if pattern is None:
        return entries.where(F.lit(False))
    found = F.col("key").rlike(pattern) if regex else F.col("key").contains(pattern)
    return entries.where(~found)


def operation_figures(access: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Counts of set, hit and miss, and the size written."""
    sets = access.where(F.col("kind") == "set").select(F.lit("set").alias("operation"), F.col("size"))
    gets = looked_up.select(F.when(F.col("hit"), "hit").otherwise("miss").alias("operation"), F.lit(0).cast("long").alias("size"))
    return sets.unionAll(gets).groupBy("operation").agg(
        F.count("*").alias("operations"), F.sum("size").alias("total_size")
    )
