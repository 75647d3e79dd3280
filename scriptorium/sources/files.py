"""Directory scans, loading by file type and size inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.scale import small_side



def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan_directory(spark: SparkSession, directory: str, extensions: Sequence[str]) -> DataFrame:
    """Path, size and extension of the files directly in a directory; contents are not read."""
    files = spark.read.format("binaryFile").load(directory).select("path", "length", "modificationTime")
    return files.withColumn("extension", extension(F.col("path"))).where(F.col("extension").isin(*extensions))


def load_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Documents ``(path, part, content)`` of every file in a directory.

    csv files give one document per row as ``name: value`` lines, json files one per object, anything else its whole
    text.  A file that cannot be read gives no rows; ``unread_documents`` names it.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    path = F.col("_metadata.file_path").alias("path")
    # the extension is a property of the file, so files of other kinds are left out before their bytes are read
    plain = reader.text(directory, wholetext=True).where(~extension(F.col("_metadata.file_path")).isin("csv")).select(path, F.col("value").alias("content"))
    whole = plain.where(~extension(F.col("path")).isin("csv", "json")).select(
        "path", F.lit(0).cast("long").alias("part"), "content"
    )
    texts = plain.where(extension(F.col("path")) == "json").select("path", "content")
    parsed = texts.select("path", F.posexplode(F.coalesce(
        F.from_json("content", "array<string>"),
        F.when(F.from_json("content", "map<string,string>").isNotNull(), F.array("content")),
    )).alias("part", "content")).select("path", F.col("part").cast("long").alias("part"), "content")
    return whole.unionAll(parsed).unionAll(_csv_rows(reader, directory)).where(F.trim("content") != "")


def unread_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Paths of the files that gave no document though they are not empty: unreadable or malformed ones."""
    files = spark.read.format("binaryFile").load(directory).select("path")
    read = load_documents(spark, directory).select("path").distinct()
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    return files.join(read.select(plain(F.col("path")).alias("_read")), plain(F.col("path")) == F.col("_read"), "left_anti")


def _csv_rows(reader, directory: str) -> DataFrame:
    """Rows of csv files, each with its own file's header; quoted fields may hold line breaks.

    Such files are not split, so the position of a row in its file is the same however they are dealt.
    """
    path = F.col("_metadata.file_path").alias("path")
    files = reader.option("pathGlobFilter", "*.[cC][sS][vV]")
    widest = files.text(directory).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    names = [f"c{i}" for i in range(widest)]
    rows = files.schema(", ".join(f"{n} string" for n in names)).option("multiLine", "true").option("escape", '"').csv(directory).select(
        path, F.monotonically_increasing_id().alias("row_no"), F.array(*[F.coalesce(n, F.lit("")) for n in names]).alias("fields"),
        F.concat_ws("", *names).alias("whole"),
    )
    heads = rows.groupBy("path").agg(F.min_by("fields", "row_no").alias("names"), F.min("row_no").alias("head_no"))
    filled = F.filter("names", lambda n: n != "")
    body = rows.join(small_side(heads), "path").where((F.col("row_no") != F.col("head_no")) & (F.trim("whole") != ""))
    pairs = F.zip_with(filled, F.slice("fields", 1, F.size(filled)), lambda n, v: F.concat_ws(": ", n, v))
    return body.select("path", (F.col("row_no") - F.col("head_no")).alias("part"), F.array_join(pairs, "\n").alias("content"))


def at_most_size(files: DataFrame, limit: float, size: str = "length") -> DataFrame:
    return files.where(F.col(size) <= limit)


def smallest(files: DataFrame, limit: float, size: str = "length", key: str = "path") -> DataFrame:
    """The smallest of the files within a size limit."""
    return at_most_size(files, limit, size).orderBy(size, key).limit(1)
