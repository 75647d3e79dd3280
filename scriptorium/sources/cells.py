"""Approximate search: an index table whose files lie in trained cells, and queries that read only the cells near them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.operators.search import PART_ROWS, matrix, rounded, search_parts, unit
from scriptorium.scale import top_rows

#: Cells, rounds of training, and about how many rows, chosen by a hash of their id, it looks at.
CELLS, ROUNDS, SAMPLE_ROWS = 16, 4, 200_000
#: Cells a query reads.  Vectors without any structure need most of them for nine hits of ten; clustered ones a few.
PROBE = 11
#: Rows of a file of the index.
FILE_ROWS = 1_000_000
DIGITS = 9


def _chosen(corpus: DataFrame, id_name: str, rows: int) -> DataFrame:
    """About ``rows`` rows, by a hash of their id."""
    n = corpus.count()
    h = F.conv(F.substring(F.md5(F.col(id_name).cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    known = corpus.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).select(id_name, F.col("vec").cast("array<double>").alias("vec"))
    return known if n <= rows else known.where(h < rows / n)


def nearest_cells(vectors: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest cells of each vector, by rounded cosine, ties to the lesser number."""
    return np.argsort(-rounded(unit(vectors) @ unit(centres).T, DIGITS), axis=1, kind="stable")[:, :count]


def train(corpus: DataFrame, id_name: str, cells: int = CELLS, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centres of the cells by rounds of spherical k-means over a sample; only centres reach the driver.

    The first centres are the rows whose id has the least md5; an empty cell keeps its centre.
    """
    rows = _chosen(corpus, id_name, sample_rows)
    first = rows.orderBy(F.md5(F.col(id_name).cast("string")), id_name).limit(cells).collect()
    centres = np.array([r.vec for r in first]).reshape(len(first), -1)

    def sums(centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                if batch.num_rows:
                    v = unit(matrix(batch.column(0)))
                    cell = nearest_cells(v, centres, 1)[:, 0]
                    np.add.at(total, cell, v)
                    n += np.bincount(cell, minlength=len(centres))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.float64()))], ["cell", "n", "total"])

        return run

    for _ in range(rounds if len(centres) else 0):
        parts = rows.select("vec").mapInArrow(sums(centres), "cell int, n long, total array<double>")
        added = parts.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in added.where("n > 0").collect():
            centres[r.cell, r.i] = rounded(np.array(r.x / r.n), DIGITS)
    return centres


def _with_cells(df: DataFrame, keys: Sequence[str], centres: np.ndarray, count: int) -> DataFrame:
    """``df(keys, vec)`` once per each of the ``count`` nearest cells, as column ``cell``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    known = df.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).select(*keys, F.col("vec").cast("array<double>").alias("vec"))
    out = T.StructType([*known.schema.fields, T.StructField("cell", T.IntegerType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = nearest_cells(matrix(batch.column("vec")), centres, count)
                rows = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), cell.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell.ravel().astype(np.int32))], schema=schema)

    return known.mapInArrow(run, out)


def write_index(corpus: DataFrame, id_name: str, centres: np.ndarray, path: str, mode: str = "error") -> None:
    """All rows that have a vector, with their cell, in one folder per cell; the rows of a large cell go to several files."""
    placed = _with_cells(corpus, [id_name], centres, 1)
    files = F.lit(max(1, corpus.count() // FILE_ROWS // max(1, len(centres)) + 1))
    placed.repartition("cell", F.pmod(F.xxhash64(id_name), files)).write.mode(mode).partitionBy("cell").parquet(path)


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, centres: np.ndarray, k: int, keys: Sequence[str], id_name: str,
    probe: int = PROBE, part_rows: int = PART_ROWS, **options,
) -> DataFrame:
    """Top ``k`` of each query among the rows of its ``probe`` nearest cells, scored exactly.

    Files of cells that no query probes aren't read.  A cell is cut into parts of about ``part_rows`` rows, and a query is
    sent to the parts of its cells alone.
    """
    index = spark.read.parquet(path)
    asked = _with_cells(queries, keys, centres, probe)
    wanted = [r.cell for r in asked.select("cell").distinct().collect()]  # at most one row per cell
    read = index.where(F.col("cell").isin(wanted))
    first, parts = {}, 0
    for r in sorted(read.groupBy("cell").count().collect()):
        first[r.cell] = (parts, r["count"] // part_rows + 1)
        parts += first[r.cell][1]
    if not parts:
        return search_parts(asked.withColumn("_part", F.lit(0)), index.withColumn("_part", F.lit(0)), 1, k, keys, id_name, **options).withColumn("rank", F.lit(0).cast("long"))
    table = spark.createDataFrame([(c, a, n) for c, (a, n) in first.items()], "cell int, first int, parts int")
    rows = read.join(F.broadcast(table), "cell").withColumn("_part", F.col("first") + F.pmod(F.xxhash64(id_name), F.col("parts")))
    sent = asked.join(F.broadcast(table), "cell").withColumn("_part", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)))
    hits = search_parts(sent, rows, parts, k, keys, id_name, **options)
    return top_rows(hits, keys, [-F.col("similarity"), F.col(id_name)], k)
