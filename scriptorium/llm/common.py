"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.session import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: its lineage ends there and its size is known to the planner."""
    folder = new_folder(df.sparkSession)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.written_to = folder
    return out


def released(*tables: DataFrame) -> None:
    """Delete tables of ``written`` whose readers are done."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; ASCII texts take the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text; with the id they name a row, and rows equal in both get equal results."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def left_join(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """All rows of ``left`` with the other columns of ``right`` where the named ones agree; null equals null."""
    other = right.withColumnsRenamed({n: f"_other_{n}" for n in names})
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"_other_{n}"))
    return left.join(other, on, "left").drop(*[f"_other_{n}" for n in names])


def ordered_positions(df: DataFrame, order: Sequence[Column], name: str, rows: int) -> DataFrame:
    """1-based position of every row in a total order of the whole table of about ``rows`` rows, in ranges of that order."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 500_000 + 1)
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return local.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_before") + F.col("_local")).cast("long").alias(name))
