"""Documents linked by the Jaccard similarity of their word shingles.

Candidates come from exact pigeonholes: two sets with J >= p / 100 differ in at most ``min * (100 - p) // p`` shingles (a ninth
of the smaller for 90), so if the hash range is cut into one part more than that, they agree in a whole part.  Sets of like size (a band) are cut alike, and the hash of
each part's content is a key.  The least set of a key is the hub of all sets that have it, so two candidates always share a
hub.  In each hub an R-tree of count vectors finds the pairs that may be linked: shingles are hashed into GROUPS
groups, the counts are points, and the sum of coordinate minima with a node's upper corner bounds the overlap with
everything below it; what it finds is bounded again by finer groups, as many as suit the sets' size.  A pair with several hubs is left to the least of them.  Only sets that survive in a hub are sent there
whole, and intersected exactly.  Equal sets are one class throughout; a large hub is cut into chunks and tested chunk against
chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StructField, StructType

from scriptorium.llm import bytesets
from scriptorium.llm.common import released, written
from scriptorium.llm.graphs import components

#: Words of a shingle, and the least similarity of a link in hundredths.
SHINGLE, PERCENT = 3, 90
#: Counts per vector, points per R-tree leaf, leaves per inner node.
GROUPS, LEAF, FAN = 64, 8, 16
#: Greatest number of groups of a set's fine vector.
FINE = 1 << 15
#: Bytes of sets verified together, of keys gathered in a bucket, and of ids up to which they are broadcast.
CHUNK_BYTES, BUCKET_BYTES, BROADCAST_BYTES = 16_000_000, 16_000_000, 32_000_000

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(body: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the n + 1 places where they begin.

    A text of fewer words than a shingle is one shingle of all its words.
    """
    low = bytesets.LOWER[body]
    start, end = bytesets.runs(~SPACE[low], offsets)
    word = bytesets.span_hash(bytesets.sums(low), start, end)
    n = len(offsets) - 1
    first = np.searchsorted(start, offsets[:-1], "left")
    count = np.searchsorted(start, offsets[1:], "left") - first
    padded = np.concatenate([word, np.zeros(shingle, np.uint64)])
    hashed = np.ones(len(word), np.uint64)
    for i in reversed(range(shingle)):
        hashed = bytesets.mix(padded[i : i + len(word)] + hashed)
    sets = []
    for f, c in zip(first.tolist(), count.tolist()):
        if c >= shingle:
            a = np.sort(hashed[f : f + c - shingle + 1])
            sets.append(a[np.concatenate([[True], a[1:] != a[:-1]])])
        elif c:
            whole = np.array([5 + c], np.uint64)
            for i in reversed(range(f, f + c)):
                whole = bytesets.mix(word[i : i + 1] + whole)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if n else np.zeros(0, np.uint64)), ends


def totals(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums modulo 2^64 of the values between consecutive ends."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return run[ends[1:]] - run[ends[:-1]]


def digests(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, as two signed columns."""
    a = totals(bytesets.mix(sets + U(11)), ends)
    b = totals(bytesets.mix(sets ^ U(0x5851F42D4C957F2D)), ends)
    return a.view(np.int64), b.view(np.int64)


def bands(percent: int = PERCENT) -> np.ndarray:
    """Least sizes of the bands; a band spans a factor of about 1.37, or all sizes that can be near its least."""
    held = bytesets.process_cache().setdefault("bands", {})
    if percent not in held:
        out, factor = [1], max(137, -(-10000 // percent))
        while out[-1] < 1 << 40:
            out.append(out[-1] * factor // 100 + 1)
        held[percent] = np.array(out, np.int64)
    return held[percent]


def keys(sets: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the number of the set each belongs to.

    A set has the keys of its own band, and of the next if a set there can be near enough.  A part without shingles is a
    key only for a set with so few others that all of them may differ.
    """
    low, size = bands(percent), np.diff(ends)
    own = np.searchsorted(low, size, "right") - 1
    out_keys, out_sets = [], []
    for step in (0, 1):
        band = own + step
        use = np.flatnonzero((size > 0) & ((100 * size >= percent * low[band]) if step else True))
        if not len(use):
            continue
        which = np.repeat(use, size[use])
        at = np.arange(len(which)) - np.repeat(np.cumsum(size[use]) - size[use], size[use]) + ends[which]
        x, parts = sets[at], ((low[band + 1] - 1) * (100 - percent) // percent + 1).astype(np.uint64)
        part = ((x >> U(32)) * parts[which]) >> U(32)
        new = np.concatenate([[True], (part[1:] != part[:-1]) | (which[1:] != which[:-1])])
        begin = np.flatnonzero(new)
        content = totals(bytesets.mix(x + U(23)), np.concatenate([begin, [len(x)]]))
        tag = bytesets.mix(part[begin] + (band[which[begin]].astype(np.uint64) << U(40)) + U(3))
        out_keys.append(bytesets.mix(content ^ tag))
        out_sets.append(which[begin])
        filled = np.bincount(which[begin], minlength=len(size))
        for k in use[filled[use] <= size[use] * (100 - percent) // percent].tolist():
            have = part[begin][which[begin] == k]
            empty = np.setdiff1d(np.arange(int(parts[k]), dtype=np.uint64), have)
            out_keys.append(bytesets.mix(bytesets.mix(empty + (U(int(band[k])) << U(40)) + U(3)) ^ U(0xE3779B97F4A7C15)))
            out_sets.append(np.full(len(empty), k))
    return (np.concatenate(out_keys), np.concatenate(out_sets)) if out_keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _digest_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """id, n_shingles and digest (a, b) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = bytesets.utf8(batch.column(1))
            found = []
            for f, e in bytesets.chunks(offsets):
                sets, ends = shingle_sets(body[offsets[f] : offsets[e]], offsets[f : e + 1] - offsets[f], shingle)
                found.append((np.diff(ends), *digests(sets, ends)))
            n, a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), (), ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n", "a", "b"])

    return docs.mapInArrow(run, "id long, n long, a long, b long")


def _packed_keys(docs: DataFrame, buckets: int, shingle: int, percent: int) -> DataFrame:
    """Rows (bucket, keys, sets) with the sorted keys of many documents, 8 bytes each, and the sets they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = bytesets.utf8(batch.column(0))
            for f, e in bytesets.chunks(offsets, 2 * bytesets.CHUNK):
                sets, ends = shingle_sets(body[offsets[f] : offsets[e]], offsets[f : e + 1] - offsets[f], shingle)
                a, _ = digests(sets, ends)
                k, which = keys(sets, ends, percent)
                once = np.zeros(len(a), bool)
                once[np.unique(a, return_index=True)[1]] = True
                k, who = k[once[which]], a[which[once[which]]]
                bucket = ((k >> U(32)) * U(buckets)) >> U(32)
                order = np.argsort(k)
                k, who, bucket = k[order], who[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(k)]]) if len(k) else [0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[i]) for i in cuts[:-1]], pa.int32()),
                        pa.array([k[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([who[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    ], ["bucket", "keys", "sets"],
                )

    return docs.mapInArrow(run, "bucket int, keys binary, sets binary")


def _shared_keys(table: pa.Table) -> pa.Table:
    """Distinct edges (u, v) from each set to the least set with the same key."""
    k = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    s = np.concatenate([np.frombuffer(x, np.int64) for x in table["sets"].to_pylist()])
    order = np.argsort(k)
    k, s = k[order], s[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(s, begin), np.diff(np.append(begin, len(k)))) if len(k) else s
    edge = s != least
    pairs = np.unique(np.stack([s[edge], least[edge]], 1), axis=0)
    return pa.table({"u": pa.array(pairs[:, 0]), "v": pa.array(pairs[:, 1])})


class CountTree:
    """A packed R-tree of count vectors; a search gives the points whose overlap with a vector may reach what they need."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        self.order = np.lexsort((*points.T[::-1], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        corner, least, width = self.points, self.sizes, LEAF
        while len(corner) > 1:
            begin = np.arange(0, len(corner), width)
            corner, least = np.maximum.reduceat(corner, begin), np.minimum.reduceat(least, begin)
            self.levels.append((corner, least, width))
            width = FAN

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        at = None
        for corner, least, width in reversed(self.levels):
            at = np.arange(len(corner)) if at is None else at[at < len(corner)]
            may = (100 + self.percent) * np.minimum(corner[at], point).sum(1) >= self.percent * (least[at] + size)
            at = (at[may][:, None] * width + np.arange(width)).ravel()
        at = np.arange(len(self.points)) if at is None else at[at < len(self.points)]
        may = (100 + self.percent) * np.minimum(self.points[at], point).sum(1) >= self.percent * (self.sizes[at] + size)
        return self.order[at[may]]


def vector(values: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Shingles per group of a set; groups are a power of two, and neighbours add up to the groups of half as many."""
    return np.bincount((values >> U(65 - groups.bit_length())).astype(np.int64), minlength=groups)


def fine_groups(size: int) -> int:
    """Groups of a set's own vector: two to four shingles in each, so that the bound tells large sets apart as well as small ones."""
    return min(FINE, max(GROUPS, 1 << max(0, size // 2).bit_length() - 1)) if size > 1 else GROUPS


class FineBounds:
    """Bounds of overlaps by the finest vectors that two sets have in common."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray, percent: int):
        self.groups, self.sizes, self.percent = np.array([len(v) for v in vectors]), sizes, percent
        self.levels = {}
        for g in np.unique(self.groups).tolist():
            row = np.cumsum(self.groups >= g) - 1
            self.levels[g] = row, np.stack([v.reshape(g, -1).sum(1, dtype=np.int32) for v in vectors if len(v) >= g])

    def near(self, q: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that may be linked with q."""
        out = []
        for g, (row, points) in self.levels.items():
            mine = others[self.groups[others] == g] if g < self.groups[q] else others[self.groups[others] >= g] if g == self.groups[q] else others[:0]
            both = np.minimum(points[row[mine]], points[row[q]]).sum(1) if len(mine) else mine
            out.append(mine[(100 + self.percent) * both >= self.percent * (self.sizes[mine] + self.sizes[q])])
        return np.concatenate(out)


def _root(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def found_links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT, forest: bool = True) -> list[tuple[int, int]]:
    """Links between sets of side 0 and those of side 1, or among all if there is one side only.

    All of them, or, for a forest, those that join what no other has joined.
    """
    sizes = np.array([len(s) for s in sets])
    points = np.stack([vector(s) for s in sets])
    one = side.all() or not side.any()
    right = np.arange(len(sets)) if one else np.flatnonzero(side)
    tree, parent, out = CountTree(points[right], sizes[right], percent), list(range(len(sets))), []
    for q in (right if one else np.flatnonzero(~side)).tolist():
        for x in right[tree.search(points[q], int(sizes[q]))].tolist():
            if (one and x <= q) or (forest and _root(parent, x) == _root(parent, q)):
                continue
            both = len(np.intersect1d(sets[q], sets[x], assume_unique=True))
            if 100 * both >= percent * (sizes[q] + sizes[x] - both):
                parent[_root(parent, x)] = _root(parent, q)
                out.append((q, x))
    return out


def _survivors(percent: int):
    """Of a hub's chunks, the rows of sets that may be linked with one of the other side and share no lesser hub with it."""

    def run(table: pa.Table) -> pa.Table:
        vectors = [np.frombuffer(x, "<u2") for x in table["vector"].to_pylist()]
        points = np.stack([v.reshape(GROUPS, -1).sum(1, dtype=np.int64) for v in vectors])
        sizes, side = table["n"].to_numpy(), table["side"].to_numpy().astype(bool)
        hub = table["hub"][0].as_py()
        lesser = [frozenset(h for h in x if h < hub) for x in table["hubs"].to_pylist()]
        one = side.all() or not side.any()
        right = np.arange(len(sizes)) if one else np.flatnonzero(side)
        tree, fine, needed = CountTree(points[right], sizes[right], percent), FineBounds(vectors, sizes, percent), np.zeros(len(sizes), bool)
        for q in (right if one else np.flatnonzero(~side)).tolist():
            near = right[tree.search(points[q], int(sizes[q]))]
            for x in fine.near(q, near[(near != q) & ~(needed[q] & needed[near])]).tolist():
                if not (needed[q] and needed[x]) and lesser[q].isdisjoint(lesser[x]):
                    needed[q] = needed[x] = True
        return table.select(["hub", "i", "j", "set", "side"]).filter(pa.array(needed))

    return run


def _verify(percent: int, forest: bool):
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["values"].to_pylist()]
        ids = table["rep"].to_pylist()
        links = found_links(sets, table["side"].to_numpy().astype(bool), percent, forest)
        return pa.table({"u": pa.array([ids[q] for q, _ in links], pa.int64()), "v": pa.array([ids[x] for _, x in links], pa.int64())})

    return run


def _sets(docs: DataFrame, shingle: int, vectors: bool) -> DataFrame:
    """The values, or the fine vector, of the sets of documents (text, a, b, …) that stand for their class, as ``payload`` beside the rest.

    Where a representative's row is repeated, its set is too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = bytesets.utf8(batch.column(0))
            for f, e in bytesets.chunks(offsets):
                sets, ends = shingle_sets(body[offsets[f] : offsets[e]], offsets[f : e + 1] - offsets[f], shingle)
                a, b = digests(sets, ends)
                part = batch.slice(f, e - f)
                mine = np.flatnonzero((a == part.column(1).to_numpy()) & (b == part.column(2).to_numpy()))
                values = [sets[ends[i] : ends[i + 1]] for i in mine]
                raw = [vector(v, fine_groups(len(v))).astype("<u2").tobytes() if vectors else v.tobytes() for v in values]
                rows = part.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*rows.columns[3:], pa.array(raw, pa.binary())], [*rows.schema.names[3:], "payload"])

    others = [f for f in docs.schema.fields if f.name not in ("text", "a", "b")]
    return docs.select("text", "a", "b", *[f.name for f in others]).mapInArrow(run, StructType([*others, StructField("payload", BinaryType())]))


def _few(df: DataFrame, many: str | None = None) -> DataFrame:
    """Ids and digests, and a list ``many`` of 24 bytes an entry, broadcast up to BROADCAST_BYTES of them."""
    each = F.lit(40) + (24 * F.size(many) if many else 0)
    return F.broadcast(df) if (df.agg(F.sum(each)).first()[0] or 0) <= BROADCAST_BYTES else df


def _class_links(src: DataFrame, classes: DataFrame, shingle: int, percent: int, forest: bool) -> DataFrame:
    """Links (u, v) between the representatives of classes (a, b, rep, n), as a written table."""
    spark = src.sparkSession
    volume = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // 2 // BUCKET_BYTES + 1)
    packed = _packed_keys(src.select("text"), buckets, shingle, percent)
    edges = written(packed.groupBy("bucket").applyInArrow(_shared_keys, "u long, v long").distinct())
    members = edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct()).withColumnsRenamed({"u": "a", "v": "hub"})
    named = members.join(classes.select("a", "b", "rep", "n"), "a")
    volumes = named.groupBy("hub").agg((F.sum("n") * 8 / CHUNK_BYTES + 1).cast("int").alias("chunks"))
    hubs = named.join(volumes, "hub").groupBy("a", "b", "rep", "n").agg(F.collect_list(F.struct("hub", "chunks")).alias("hubs"))
    chosen = written(hubs.withColumnRenamed("rep", "id"))
    vectors = _sets(src.join(_few(chosen, "hubs"), "id").withColumn("set", F.col("a")), shingle, True).withColumn("h", F.explode("hubs"))
    mine = F.pmod(F.xxhash64("set"), F.col("h.chunks")).cast("int")
    dealt = vectors.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("h.chunks") - 1))).select(
        F.col("h.hub").alias("hub"), F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "set", "n",
        F.col("hubs.hub").alias("hubs"), (F.col("mine") > F.col("other")).cast("int").alias("side"), F.col("payload").alias("vector"),
    )
    needed = written(dealt.groupBy("hub", "i", "j").applyInArrow(_survivors(percent), "hub long, i int, j int, set long, side int"))
    places = needed.groupBy(F.col("set").alias("a")).agg(F.collect_set(F.struct("hub", "i", "j", "side")).alias("places"))
    left = written(places.join(chosen.select("a", "b", "id"), "a"))
    values = _sets(src.join(_few(left, "places"), "id").withColumn("rep", F.col("id")), shingle, False)
    sent = values.select("rep", F.col("payload").alias("values"), F.explode("places").alias("p")).select("rep", "values", "p.*")
    links = written(sent.groupBy("hub", "i", "j").applyInArrow(_verify(percent, forest), "u long, v long"))
    released(edges, chosen, needed, left)
    return links


def _classes(src: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Digests of every row, and the classes of equal sets, as written tables."""
    each = written(_digest_rows(src, shingle))
    return each, written(each.where(F.col("id").isNotNull() & (F.col("n") > 0)).groupBy("a", "b").agg(F.min("id").alias("rep"), F.first("n").alias("n")))


def _source(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"{doc_id} must be an integer, not {kind.simpleString()}")
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as pairs (u, v) of class representatives, u < v, each once; and the classes: doc_id, rep.

    Documents of one class have equal sets and are linked with each other.  Rows as in ``linked``.
    """
    src = _source(docs, doc_id, text)
    each, classes = _classes(src, shingle)
    pairs = _class_links(src.where(F.col("id").isNotNull()), classes, shingle, percent, forest=False)
    pairs = pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    return pairs, each.join(classes.select("a", "b", "rep"), ["a", "b"]).select(F.col("id").alias("doc_id"), "rep").where(F.col("doc_id").isNotNull())


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least id reachable by links of J >= percent / 100).

    Shingles are of ``shingle`` words.  Null, empty and blank texts have no shingles and link with nothing.  Rows of the same id are one document of several
    texts; rows without an id take no part: they are counted, and their component is null.  Ids must be integers.  An empty table
    gives no rows; very long texts are hashed alone; other columns take no part.
    """
    src = _source(docs, doc_id, text)
    each, classes = _classes(src, shingle)
    found = _class_links(src.where(F.col("id").isNotNull()), classes, shingle, percent, forest=True)
    joined = components(found).select(F.col("u").alias("rep"), F.col("v").alias("least"))
    named = classes.join(joined, "rep", "left").select("a", "b", F.coalesce("least", "rep").alias("component_id"))
    out = each.join(named, ["a", "b"], "left")
    # of the texts of one id, each has the least component
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents of the least id of each component, unchanged; documents without an id all stay."""
    least = linked(docs, doc_id, text, shingle, percent).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(doc_id)).distinct()
    keep = written(least)
    return docs.where(F.col(doc_id).isNull()).unionByName(docs.join(keep, doc_id, "left_semi"))
