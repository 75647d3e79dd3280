"""Ordered work over groups of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  When one key may hold a third of the rows
that task never ends, so everything here, at any size, splits a key into ranges of its order and joins the small
per-range totals back.  The input is computed once: it is checkpointed, and cut points, totals and rows read it there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import let
from scriptorium.session import durable

BROADCAST_ROWS = 100_000
SEGMENT_ROWS = 50_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; every task stops after that many."""
    return df.select(F.lit(1)).limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted size allows it, else as it is (shuffle join under AQE)."""
    return F.broadcast(df) if at_most(df, rows) else df


def _bounds(df: DataFrame, order: Sequence[Column], parts: int) -> list:
    """Cut points of the order, taken from a hash-chosen set of at most 50 rows per part."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(*[c.alias(n) for c, n in zip(order, names)])
    chosen = keyed.orderBy(F.xxhash64(*names), *names).limit(50 * parts)
    rows = chosen.orderBy(*names).collect()
    step = max(1, len(rows) // parts)
    return [tuple(r) for r in rows[step::step]]


def _range_no(order: Sequence[Column], bounds: list, df: DataFrame) -> Column:
    """Number of cut points at or below the row: constant per range and rising with the order."""
    if not bounds:
        return F.lit(0)
    types = [f.dataType for f in df.select(*order).schema.fields]
    key = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    cuts = F.array(*[
        F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(b, types))]) for b in bounds
    ])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(s: Column, key: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below, open_ = F.get(cuts, mid) <= key, s["low"] < s["high"]
        return F.struct(
            F.when(open_ & below, mid + 1).otherwise(s["low"]).alias("low"), F.when(open_ & ~below, mid).otherwise(s["high"]).alias("high")
        )

    first = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return let(key, lambda k: F.aggregate(steps, first, lambda s, _: halve(s, k), lambda s: s["low"]))


def _ranged(df: DataFrame, order: Sequence[Column], parts: int | None) -> DataFrame:
    """The checkpointed rows with the number of their range of the order."""
    held = durable(df)
    parts = parts or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return held.withColumn("_range", _range_no(order, _bounds(held, order, parts), held))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_no",
    parts: int | None = None,
) -> DataFrame:
    """1-based position of each row within its key.

    ``order`` lists ascending expressions (negate numbers for descending) and must be a total order.
    """
    ranged = _ranged(df, order, parts)
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    local = ranged.withColumn("_local", F.row_number().over(w))
    prior = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n")
    )
    same = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local["_range"] == offsets["_range"]]
    return local.join(offsets, same).select(
        *[local[c] for c in df.columns], (F.col("_before") + F.col("_local")).cast("bigint").alias(name)
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    before: int,
    after: int,
    build,
    segment: int = SEGMENT_ROWS,
    parts: int | None = None,
) -> DataFrame:
    """Columns computed from a bounded row frame.

    ``build(window)`` returns ``{name: Column}`` over an ordered window.  Each segment of a long key receives a
    copy of the ``before`` rows ahead of it and the ``after`` rows behind it, so frames never miss a row.
    """
    if max(before, after) > segment:
        raise ValueError("frame is longer than a segment")
    numbered = number_rows(df, keys, order, "_no", parts)
    pos = F.pmod(F.col("_no") - 1, F.lit(segment))
    seg = F.floor((F.col("_no") - 1) / segment).cast("long")
    targets = F.array_compact(F.array(
        seg,
        F.when(pos >= segment - before, seg + 1) if before else F.lit(None).cast("long"),
        F.when(pos < after, seg - 1) if after else F.lit(None).cast("long"),
    ))
    spread = numbered.withColumn("_home", seg).withColumn("_seg", F.explode(targets))
    w = Window.partitionBy(*keys, "_seg").orderBy("_no")
    return (
        spread.withColumns(build(w)).where(F.col("_home") == F.col("_seg")).drop("_no", "_home", "_seg")
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sum of ``value`` within each key."""
    full = (Window.unboundedPreceding, 0)
    ranged = _ranged(df.withColumn("_v", value), order, parts)
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*full)
    local = ranged.withColumn("_local", F.sum("_v").over(w))
    prior = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_range").agg(F.sum("_v").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(prior), F.lit(0))).drop("_n")
    )
    same = [local[k].eqNullSafe(offsets[k]) for k in keys] + [local["_range"] == offsets["_range"]]
    return local.join(offsets, same).select(
        *[local[c] for c in df.columns], (F.col("_before") + F.col("_local")).alias(name)
    )


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    name: str,
    parts: int | None = None,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row of its key (the core of an as-of join)."""
    full = (Window.unboundedPreceding, 0)
    ranged = _ranged(df.withColumn("_v", value), order, parts)
    w = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*full)
    local = ranged.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
    stamp = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    prior = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        ranged.groupBy(*keys, "_range")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), stamp)).alias("_n"))
        .withColumn("_before", F.last("_n", ignorenulls=True).over(prior)).drop("_n")
    )
    same = [local[k].eqNullSafe(carried[k]) for k in keys] + [local["_range"] == carried["_range"]]
    return local.join(carried, same).select(
        *[local[c] for c in df.columns], F.coalesce("_local", "_before").alias(name)
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when they come in fewer partitions than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows of each key.  Spark cuts to ``k`` before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w).cast("bigint")).where(F.col(name) <= k)


def medians(df: DataFrame, keys: Sequence[str], value: Column, name: str = "median") -> DataFrame:
    """Exact median of the non-null values of each key: values are counted, and the middle ranks picked from running counts.

    No task holds a key's values, only their distinct ones range by range.  Keys without a value have none.
    """
    counts = df.select(*keys, value.alias("_x")).where(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count("*").alias("_n"))
    upto = running_total(counts, keys, [F.col("_x")], F.col("_n"), "_upto")
    totals = upto.groupBy(*keys).agg(F.max("_upto").alias("_all"))
    if keys:
        totals = small_side(totals.withColumnsRenamed({k: f"_{k}" for k in keys}))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        placed = upto.join(totals, on)
    else:
        placed = upto.withColumn("_all", F.lit(totals.first()[0]).cast("long"))
    middle = [F.floor((F.col("_all") + i) / 2) for i in (1, 2)]
    share = [((F.col("_upto") - F.col("_n") < m) & (m <= F.col("_upto"))).cast("int") for m in middle]
    return placed.groupBy(*keys).agg((F.sum(F.col("_x") * (share[0] + share[1])) / 2).alias(name))
