"""Exact nearest neighbours for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.scale import BROADCAST_ROWS, top_rows

#: Rows of a part of the corpus, which one task holds; rows and queries multiplied at once, whose products stay in the cache;
#: rows that give a first bound of each query's best; found pairs held before a cut of all.
PART_ROWS, ROWS_AT_ONCE, QUERY_TILE, SEED_ROWS, PAIRS = 131_072, 192, 1024, 2048, 1 << 20
#: Rows below which the corpus isn't dealt further only to keep all cores busy.
LEAST_ROWS = 1000
#: Rows of whole numbers that share one row of products; queries of a part after which packing it is worth its time.
PACKED, PACK_AFTER = 3, 3072
#: More than the error of a product of two unit vectors in single precision.
SLACK = 2e-5


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(values * 10.0**digits + 0.5) / 10.0**digits


def distinct_rows(v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows, for each the position of its ids, and the ids: the k least of each row, ascending.

    Rows that are equal are equally near to any query, so of a row's ids only the k least can be among k hits.
    """
    v = np.ascontiguousarray(v + 0.0)
    _, first, of = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(ids, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    starts = np.searchsorted(of[order], np.arange(len(first)))
    place = np.arange(len(order)) - starts[of[order]]
    kept = order[place < k]
    return v[first], np.searchsorted(of[kept], np.arange(len(first) + 1)), ids[kept]


def _first_of_each(qi: np.ndarray, sims: np.ndarray, vi: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k first pairs by falling similarity and rising row, queries in order."""
    order = np.lexsort((vi, -sims, qi))
    place = np.arange(len(order)) - np.searchsorted(qi[order], qi[order])
    return order[place < k]


def near_pairs(q_unit: np.ndarray, v_unit: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Query and row of the pairs whose product is at least that of the query, queries in order.

    Few are, so a block's products are only reduced to each query's greatest, and looked through where that is enough.
    """
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    held = np.empty(len(q_unit) * ROWS_AT_ONCE, np.float32)
    for low in range(0, len(v_unit), ROWS_AT_ONCE):
        rows = v_unit[low : low + ROWS_AT_ONCE]
        products = np.matmul(q_unit, rows.T, out=held[: len(q_unit) * len(rows)].reshape(len(q_unit), len(rows)))
        some = np.flatnonzero(products.max(axis=1) >= least)
        if len(some):
            qi, vi = np.divmod(np.flatnonzero(products[some] >= least[some, None]), len(rows))
            found.append((some[qi], vi + low))
    qi, vi = (np.concatenate([f[i] for f in found]) for i in range(2))
    order = np.argsort(qi, kind="stable")
    return qi[order], vi[order]


def near_counts(
    q: np.ndarray, packed: np.ndarray, least: np.ndarray, held: tuple[np.ndarray, np.ndarray],
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and product of the pairs of whole numbers whose product is at least that of the query.

    Three rows share a packed one, so that the bytes of one product are the products of all three; see ``Corpus``.  ``held`` is
    room for the products.
    """
    n = len(packed)
    products, parts = (h[: len(q) * n].reshape(len(q), n) for h in held)
    np.copyto(parts, np.matmul(q, packed.T, out=products), casting="unsafe")
    parts = parts.view(np.uint8)
    some = np.flatnonzero(parts.max(axis=1) >= least)
    looked = parts[some]
    at = np.flatnonzero(looked >= least[some, None])
    qi, byte = np.divmod(at, 4 * n)
    vi, part = byte // 4, byte % 4
    kept = part < PACKED
    return some[qi[kept]], (part * n + vi)[kept], looked.ravel()[at[kept]].astype(np.float64)


class Corpus:
    """Different rows as they are compared: in order of their lengths, in blocks, of length one.

    Vectors of whole numbers, as counts are, are also packed by three: a + 256 b + 65,536 c.  A product of two vectors is at most
    that of their lengths; where this is below 256 for a block, one product in single precision, which is exact below 2^24, holds three.
    """

    def __init__(self, v: np.ndarray):
        self.v, self.sq = v, (v * v).sum(axis=1)
        self.order = np.argsort(self.sq, kind="stable")
        self.size = np.sqrt(self.sq[self.order])
        self.unit = np.divide(v[self.order], self.size[:, None], out=np.zeros(v.shape, np.float32), where=self.size[:, None] > 0, casting="same_kind")
        starts = list(range(0, len(v), PACKED * ROWS_AT_ONCE))
        # not from the shortest to the longest, so that the first blocks have near rows as well as others
        self.blocks = [(low, min(low + PACKED * ROWS_AT_ONCE, len(v))) for i in range(8) for low in starts[i::8]]
        self.packed, self.asked = None, 0

    def packed_for(self, queries: int) -> dict:
        """The packed blocks by their starts; none before ``PACK_AFTER`` queries have come."""
        self.asked += queries
        if self.packed is None and self.asked > PACK_AFTER:
            self.packed = {}
            if ((self.v >= 0) & (self.v == np.floor(self.v))).all():
                for low, end in self.blocks:
                    if self.size[end - 1] < 256:
                        three = np.zeros((PACKED * -(-(end - low) // PACKED), self.v.shape[1]))
                        three[: end - low] = self.v[self.order[low:end]]
                        a, b, c = three.reshape(PACKED, -1, self.v.shape[1])
                        self.packed[low] = (a + 256 * b + 65536 * c).astype(np.float32)
        return self.packed or {}

    def sample(self, n: int) -> np.ndarray:
        return self.unit[:: max(1, len(self.unit) // n)][:n]


def best_rows(
    q: np.ndarray, corpus: Corpus, k: int, floor: float | None, digits: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and similarity of every query's k best rows, ties by row number.

    A product in single precision per block of rows finds the few pairs near or above each query's k-th best so far; only those
    are scored in double precision and rounded.
    """
    v, v_sq = corpus.v, corpus.sq
    q_unit, q_sq = unit(q).astype(np.float32), (q * q).sum(axis=1)
    q_size = np.sqrt(q_sq)
    packed = corpus.packed_for(len(q)) if ((q >= 0) & (q == np.floor(q))).all() else {}
    counts, longest = q.astype(np.float32), q_size.max(initial=0)
    room = tuple(np.empty(len(q) * ROWS_AT_ONCE, t) for t in ("f4", "i4"))
    slack = SLACK + 10.0**-digits
    best = np.full((len(q), k), -np.inf)
    if floor is not None:
        best[:] = floor
    # a zero query is at similarity 0 to all rows, so its first k rows are its hits
    empty = np.flatnonzero(q_sq == 0)
    found = [(np.repeat(empty, min(k, len(v))), np.tile(np.arange(min(k, len(v))), len(empty)), np.zeros(len(empty) * min(k, len(v))))]
    held = 0
    if floor is not None and floor > 0:
        found = []
    best[empty] = np.inf
    seed = np.full(len(q), -np.inf)
    some = corpus.sample(SEED_ROWS)
    if len(some) >= 4 * k:
        # the k-th of the maxima of 4 k groups of rows is at most the k-th best of all
        width = len(some) // (4 * k)
        tops = (q_unit @ some[: 4 * k * width].T).reshape(len(q), 4 * k, width).max(axis=2)
        seed = np.partition(tops, 3 * k, axis=1)[:, 3 * k] - 2 * slack

    def cut() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        qi, vi, sims = (np.concatenate([f[i] for f in found]) for i in range(3))
        kept = _first_of_each(qi, sims, vi, k)
        return [(qi[kept], vi[kept], sims[kept])]

    for low, end in corpus.blocks:
        least = np.maximum(best.min(axis=1) - slack, seed)
        products = None
        if low in packed and longest * corpus.size[end - 1] < 255.5:
            # a pair that is near at all has a product of at least 1
            bound = np.where(q_sq > 0, np.maximum(np.ceil(least * corpus.size[low] * q_size - 1e-6), np.where(least > 0, 1, 0)), 255)
            qi, vi, products = near_counts(counts, packed[low], np.clip(bound, 0, 255).astype(np.uint8), room)
            real = vi < end - low
            qi, vi, products = qi[real], corpus.order[low + vi[real]], products[real]
        else:
            qi, vi = near_pairs(q_unit, corpus.unit[low:end], least.astype(np.float32))
            vi = corpus.order[low + vi]
        for start in range(0, len(qi), PAIRS):
            qs, vs = qi[start : start + PAIRS], vi[start : start + PAIRS]
            scale = np.sqrt(q_sq[qs] * v_sq[vs])
            product = (q[qs] * v[vs]).sum(axis=1) if products is None else products[start : start + PAIRS]
            raw = np.divide(product, scale, out=np.zeros(len(qs)), where=scale > 0)
            sims = rounded(raw, digits)
            near = sims >= (least[qs] if floor is None else np.maximum(least[qs], floor))
            qs, vs, sims = qs[near], vs[near], sims[near]
            if not len(qs):
                continue
            kept = _first_of_each(qs, sims, vs, k)
            qs, vs, sims = qs[kept], vs[kept], sims[kept]
            found.append((qs, vs, sims))
            held += len(qs)
            asked, starts = np.unique(qs, return_index=True)
            tops = np.full((len(asked), k), -np.inf)
            tops[np.searchsorted(asked, qs), np.arange(len(qs)) - starts[np.searchsorted(asked, qs)]] = sims
            best[asked] = np.partition(np.concatenate([best[asked], tops], axis=1), k, axis=1)[:, k:]
            if held > PAIRS:
                found, held = cut(), 0
    return cut()[0] if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _search_parts(keys: list[str], id_name: str, k: int, floor: float | None, digits: int, schema: pa.Schema):
    """Task function over rows in order of part and kind: a part's corpus rows first, then its queries, a batch at a time."""

    def answers(tile: pa.RecordBatch, rows: Corpus, spans: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        qi, vi, sims = best_rows(matrix(tile.column("_query")), rows, k, floor, digits)
        # a row's hits are its ids; the first k of a query's by similarity and id stay
        sizes = np.diff(spans)[vi]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        qi, sims, at = np.repeat(qi, sizes), np.repeat(sims, sizes), np.repeat(spans[vi], sizes) + within
        _, names = np.unique(ids[at], return_inverse=True)
        kept = _first_of_each(qi, sims, names, k)
        names, of = pa.array(ids[at[kept]], type=schema.field(id_name).type), pa.array(qi[kept])
        return pa.RecordBatch.from_arrays([*(tile.column(n).take(of) for n in keys), names, pa.array(sims[kept], pa.float64())], schema=schema)

    def known(rows: pa.RecordBatch, name: str) -> pa.RecordBatch:
        return rows.filter(pc.fill_null(pc.greater(pc.list_value_length(rows.column(name)), 0), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, corpus = None, [], None
        for batch in batches:
            parts, asked = batch.column("_part").to_numpy(), batch.column("_asked").to_numpy(zero_copy_only=False)
            new = np.flatnonzero((np.diff(parts) != 0) | (np.diff(asked) != 0)) + 1
            for first, end in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if first == end:
                    continue
                if parts[first] != part:
                    part, held, corpus = parts[first], [], None
                if not asked[first]:
                    rows = known(batch.slice(first, end - first), "_row")
                    if len(rows):
                        held.append((matrix(rows.column("_row")), rows.column(id_name).to_numpy(zero_copy_only=False)))
                    continue
                if held:
                    v, ids = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held, corpus = [], distinct_rows(v, ids, k)
                    # in order of their least ids, ties between rows are ties by number
                    order = np.argsort(corpus[2][corpus[1][:-1]], kind="stable")
                    sizes = np.diff(corpus[1])[order]
                    at = np.repeat(corpus[1][order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    corpus = Corpus(corpus[0][order]), np.concatenate([[0], np.cumsum(sizes)]), corpus[2][at]
                if corpus is None:
                    continue
                rows = known(batch.slice(first, end - first), "_query")
                # queries of like length share a tile
                rows = rows.take(pa.array(np.argsort((matrix(rows.column("_query")) ** 2).sum(axis=1), kind="stable")))
                for low in range(0, len(rows), QUERY_TILE):
                    yield answers(rows.slice(low, QUERY_TILE), *corpus)

    return run


def search_parts(
    queries: DataFrame, corpus: DataFrame, parts: int, k: int, keys: Sequence[str], id_name: str,
    min_similarity: float | None = None, digits: int = 6,
) -> DataFrame:
    """Hits of every query among the corpus rows of the parts it is sent to.

    ``queries(keys, vec, _part)`` and ``corpus(id, vec, _part)`` meet by part: a task holds the rows of one part and a batch
    of queries, and keeps k hits per query, however many queries there are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = list(keys)
    nothing = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in [*(queries.schema[n] for n in keys), corpus.schema[id_name]]}
    # vectors go as they are and are tested in the task: a filter before would compute them once more
    no_row, no_query = (F.lit(None).cast(df.schema["vec"].dataType) for df in (corpus, queries))
    rows = corpus.select(
        F.col("_part").cast("int").alias("_part"), F.lit(False).alias("_asked"), *[nothing[n] for n in keys], id_name,
        F.col("vec").alias("_row"), no_query.alias("_query"),
    )
    questions = queries.select(
        F.col("_part").cast("int").alias("_part"), F.lit(True).alias("_asked"), *keys, nothing[id_name], no_row.alias("_row"),
        F.col("vec").alias("_query"),
    )
    dealt = rows.unionByName(questions).repartitionById(parts, F.col("_part")).sortWithinPartitions("_part", "_asked")
    out = queries.select(*keys).schema.add(corpus.schema[id_name]).add("similarity", "double")
    for f in out.fields:
        f.nullable = True
    return dealt.mapInArrow(_search_parts(keys, id_name, k, min_similarity, digits, to_arrow_schema(out)), out)


def nearest(
    queries: DataFrame, corpus: DataFrame, k: int, keys: Sequence[str], id_name: str, min_similarity: float | None = None,
    digits: int = 6, part_rows: int = PART_ROWS,
) -> DataFrame:
    """Exact top ``k`` rows of ``corpus(id, vec)`` for each row of ``queries(keys, vec)``.

    The corpus is dealt by id into parts of at most about ``part_rows`` rows, as many for each core, and every query goes to every part: no pair is written
    out, and a part gives k rows per query.  The similarity floor is tested before ranking.  Rows without a vector are
    neither hits nor queries; a zero vector is at similarity 0 to all.
    """
    n = corpus.count()
    cores = corpus.sparkSession.sparkContext.defaultParallelism
    parts = min(cores, n // LEAST_ROWS + 1) if n < part_rows else (n // part_rows // cores + 1) * cores
    rows = corpus.select(id_name, "vec", F.pmod(F.xxhash64(id_name), F.lit(parts)).alias("_part"))
    asked = queries.select(*keys, "vec", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    hits = search_parts(asked, rows, parts, k, keys, id_name, min_similarity, digits)
    return top_rows(hits, keys, [-F.col("similarity"), F.col(id_name)], k)


def attach(hits: DataFrame, corpus: DataFrame, id_name: str, bound: int) -> DataFrame:
    """Give hits the other corpus columns.  ``bound`` is the proven number of hits (queries × k)."""
    side = F.broadcast(hits) if bound <= BROADCAST_ROWS else hits
    return corpus.join(side, id_name)


def similarity_filter(hits: DataFrame, threshold: float) -> DataFrame:
    """Keep hits at or above a similarity."""
    return hits.where(F.col("similarity") >= threshold)


def quality_gate(hits: DataFrame, keys: list[str], threshold: float = 0.4, fallback: int = 3) -> DataFrame:
    """Hits at or above ``threshold``; a query without any keeps its first ``fallback``."""
    flags = hits.groupBy(*keys).agg(F.max(F.col("similarity") >= threshold).alias("_any"))
    return (
        hits.join(flags, keys)
        .where((F.col("similarity") >= threshold) | (~F.col("_any") & (F.col("rank") <= fallback)))
        .drop("_any")
    )
