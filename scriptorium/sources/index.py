"""The chunk index as a parquet table: append, reindex policy, metadata columns, figures and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

ATOMIC = (T.StringType, T.NumericType, T.BooleanType)


def new_chunks(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Chunks whose id is not in the index yet, each once."""
    return chunks.dropDuplicates(["chunk_id"]).join(index.select("chunk_id"), "chunk_id", "left_anti")


def read_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index, or nothing where there is none yet; any other trouble is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def append_chunks(chunks: DataFrame, path: str) -> None:
    """Append what is new; giving the same chunks again changes nothing."""
    existing = read_index(chunks.sparkSession, path)
    fresh = chunks.dropDuplicates(["chunk_id"]) if existing is None else new_chunks(chunks, existing)
    fresh.write.mode("append").parquet(path)


def reindex(chunks: DataFrame, path: str, force: bool = False) -> None:
    """Write a whole index; an existing one is kept unless forced."""
    chunks.write.mode("overwrite" if force else "ignore").parquet(path)


def flat_metadata(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Atomic columns as they are; any other as ``<name>_str``, its JSON, cut to ``limit`` characters if one is given."""
    def flat(f: T.StructField) -> Column:
        if isinstance(f.dataType, ATOMIC):
            return F.col(f.name)
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        text = F.to_json(f.name) if nested else F.col(f.name).cast("string")
        return (F.substring(text, 1, limit) if limit else text).alias(f"{f.name}_str")

    return df.select(*[flat(f) for f in df.schema.fields])


def index_figures(index: DataFrame) -> DataFrame:
    """Chunks, documents, sources and characters of the index."""
    return index.agg(
        F.count("*").alias("total_chunks"), F.countDistinct("doc_id").alias("documents"),
        F.countDistinct("source").alias("sources"), F.sum(F.length("content")).alias("characters"),
    )


def export_index(index: DataFrame, path: str, form: str = "json") -> None:
    index.write.mode("overwrite").format(form).save(path)


def write_examples(examples: DataFrame, path: str, by_split: bool = True) -> None:
    """Instruction examples as parquet, in one folder per split."""
    writer = examples.write.mode("overwrite")
    (writer.partitionBy("split") if by_split else writer).parquet(path)
