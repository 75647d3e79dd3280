"""Alignment of two tokenizers over whole texts.

Each text, with a space before it, is encoded by a byte-level tokenizer (A) and by one that marks spaces (B).  Byte offsets where
tokens of both end cut them into groups; tokens of a group are linked.  How often two ids are linked is counted by document
over the corpus, and each document is told how its links fare against those counts.

The ends of both sides are merged by merge paths: diagonals of the merge, PIECE steps apart, are located by binary search, so that all
pieces have equal work and none needs another; all pieces of a batch step together, and emit the overlaps of tokens and
where they close.  Groups that pieces share are stitched by the running number of closed ones.

Words are encoded once per worker: neither tokenizer joins bytes across a single blank before a word, so a text's tokens are
those of its units between such blanks.  Tokens are written once with the distinct linked pairs of each document; counts and
sums are plain aggregates over these.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import bytesets
from scriptorium.llm.common import written

#: Steps of a piece of the merge.
PIECE = 256
#: Characters and documents encoded at once, units a worker keeps, ids it keeps for them, and links laid out at once: they bound
#: memory only.
PART, WAITING, CACHE, CACHE_IDS, LINKS = 1_000_000, 10_000, 200_000, 4_000_000, 4_000_000
#: Links of a group from which its distinct ids are counted before they are laid out.
LARGE = 4096
#: Linked id pairs up to which their counts are broadcast, at about 40 bytes each; beyond that the same join shuffles.
BROADCAST_PAIRS = 2_000_000

#: A blank between units: neither after another nor before any white space.
BLANK = re.compile(r"(?<=[^ ]) (?=[^\s\u180e\u200b\u2060\ufeff])")


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others for 256 and up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + n): b for n, b in enumerate(rest)}}


class Encoders:
    """Token ids of units by both tokenizers, kept per worker, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        of = byte_characters()
        names = {i: w for w, i in self.a.get_vocab().items()}
        self.bytes_a = [bytes(of[c] for c in names[i]) if i in names and all(c in of for c in names[i]) else b"" for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        step = json.loads(self.a.to_str())
        plain = step["normalizer"] is None and step["pre_tokenizer"].get("type") == "ByteLevel" and step["pre_tokenizer"].get("use_regex")
        self.cut = bool(plain) and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.good = np.zeros(0, bool)
        self.ids, self.ends = [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2

    def units(self, text: str) -> list[str]:
        return BLANK.split(text) if self.cut else [text]

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about PART characters that end where units do."""
        at = 0
        while self.cut and len(text) - at > PART and (found := BLANK.search(text, at + PART)):
            yield text[at : found.start()]
            at = found.end()
        yield text[at:]

    def lookup(self, units: list[list[str]]) -> np.ndarray:
        """Numbers of all units in a row; new ones are encoded together."""
        if len(self.known) > CACHE or len(self.ids[0]) > CACHE_IDS:
            self.forget()
        new = list(set().union(*units).difference(self.known)) if units else []
        if new:
            a = [x.ids for x in self.a.encode_batch_fast([f" {u}" for u in new], add_special_tokens=False)]
            b = self.b.encode(new, num_threads=1)
            good = []
            for u, x, y in zip(new, a, b):
                raw = f" {u}".encode()
                good.append(b"".join([self.bytes_a[i] for i in x]) == raw and b"".join([self.bytes_b[i] for i in y]) == raw)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.good = np.append(self.good, good)
            for k, each in enumerate((a, b)):
                flat = np.fromiter((i for x in each for i in x), np.int64)
                self.ids = [*self.ids[:k], np.append(self.ids[k], flat), *self.ids[k + 1 :]]
                ends = self.ends[k][-1] + np.cumsum([len(x) for x in each])
                self.ends = [*self.ends[:k], np.append(self.ends[k], ends), *self.ends[k + 1 :]]
        return np.fromiter((self.known[u] for us in units for u in us), np.int64)

    def tokens(self, side: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in a row, and how many each has."""
        begin = self.ends[side][unit]
        n = self.ends[side][unit + 1] - begin
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.ids[side][at], n


def encoders(path_a: str, path_b: str) -> Encoders:
    held = bytesets.process_cache().setdefault("aligned", {})
    if (path_a, path_b) not in held:
        held[path_a, path_b] = Encoders(path_a, path_b)
    return held[path_a, path_b]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of ``a`` and of ``b`` lie before every ``piece``-th step of their merge (ends of ``a`` first if equal)."""
    step = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, step - len(b)), np.minimum(step, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        first = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(step - 1 - mid, 0, len(b) - 1)])
        low = np.where(first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low, step - low


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens (of a, of b) in order, and the group of each; ``a`` and ``b`` are rising ends with the last one in common."""
    if not len(a):
        return (np.zeros(0, np.int64),) * 3
    at_a, at_b = diagonals(a, b, piece)
    i, j = at_a[:-1].copy(), at_b[:-1].copy()
    steps = at_a[1:] + at_b[1:] - i - j  # all alike, but for the last
    shape = (len(i), int(steps.max()))
    of_a, of_b = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    seen, closed = np.zeros(shape, bool), np.zeros(shape, bool)
    end_a, end_b = np.append(a, np.iinfo(np.int64).max), np.append(b, np.iinfo(np.int64).max)
    for t in range(shape[1]):
        live = t < steps
        x, y = end_a[i], end_b[j]
        from_a = live & (x <= y)
        from_b = live & ~from_a
        of_a[:, t], of_b[:, t] = i, j
        seen[:, t] = from_a | (from_b & (end_a[i - 1] != y))  # an end in common is emitted by its step of a
        closed[:, t] = from_a & (x == y)
        i += from_a
        j += from_b
    within = np.cumsum(closed, 1) - closed
    before = np.cumsum(closed.sum(1)) - closed.sum(1)  # groups that earlier pieces close
    return of_a[seen], of_b[seen], (within + before[:, None])[seen]


class Text:
    """What has been found of one document so far."""

    __slots__ = ("doc_id", "bad", "counts", "sha", "pairs")

    def __init__(self, doc_id):
        self.doc_id, self.bad, self.counts, self.sha, self.pairs = doc_id, False, np.zeros(4, np.int64), hashlib.sha256(), []

    def row(self) -> tuple:
        """Counts, digest, and arrays of linked pairs with how many links each has."""
        if self.bad or not self.counts[0]:
            return np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, n = self.pairs[0] if len(self.pairs) == 1 else summed(*(np.concatenate(x) for x in zip(*self.pairs)))
        return self.counts, self.sha.hexdigest(), key, n


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[begin], np.add.reduceat(n, begin) if len(begin) else n


def linked_pairs(ids_a, ids_b, start_a, start_b, tag) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``tag + a << 32 | b`` of all token pairs that share a group, with their numbers; groups are slices of the ids."""
    n_a, n_b = np.diff(start_a), np.diff(start_b)
    links = n_a * n_b
    keys, counts = [], []
    small = np.flatnonzero(links < LARGE)
    total = np.cumsum(links[small])
    for part in np.split(small, np.searchsorted(total, np.arange(LINKS, int(total[-1]) if len(total) else 0, LINKS))):
        per = np.repeat(n_b[part], n_a[part])  # links of each token of a
        token = np.repeat(start_a[part] - (np.cumsum(n_a[part]) - n_a[part]), n_a[part]) + np.arange(int(n_a[part].sum()))
        group = np.repeat(part, n_a[part])
        other = np.repeat(start_b[group] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
        key = np.repeat(tag[group] | ids_a[token] << 32, per) | ids_b[other]
        key, n = np.unique(key, return_counts=True)
        keys.append(key)
        counts.append(n)
    for g in np.flatnonzero(links >= LARGE).tolist():
        (a, m), (b, n) = (np.unique(x[s[g] : s[g + 1]], return_counts=True) for x, s in ((ids_a, start_a), (ids_b, start_b)))
        for k in range(0, len(a), max(1, LINKS // len(b))):
            rows = slice(k, k + max(1, LINKS // len(b)))
            keys.append((tag[g] | a[rows, None] << 32 | b[None, :]).ravel())
            counts.append((m[rows, None] * n[None, :]).ravel())
    return summed(np.concatenate(keys), np.concatenate(counts)) if keys else (np.zeros(0, np.int64),) * 2


def _digits(ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids in columns, with one more for what follows, and which of them are used."""
    held = bytesets.process_cache().setdefault("digits", {})
    if ids not in held:
        width = len(str(ids))
        chars = np.frombuffer(b"".join(b"%*d " % (width, i) for i in range(ids)), np.uint8).reshape(ids, width + 1)
        held[ids] = chars, chars != 32
    return held[ids]


def align_batch(enc: Encoders, parts: list[tuple[Text, str]], piece: int = PIECE) -> None:
    """Add what the parts hold to their documents; the parts of one document come in order."""
    units = [enc.units(p) for _, p in parts]
    number = enc.lookup(units)
    owner = np.repeat(np.arange(len(parts)), [len(u) for u in units])
    bad = np.unique(owner[~enc.good[number]])
    for p in bad.tolist():
        parts[p][0].bad = True
    keep = ~np.isin(owner, bad)
    number, owner = number[keep], owner[keep]
    if not len(number):
        return
    ids_a, n_a = enc.tokens(0, number)
    ids_b, n_b = enc.tokens(1, number)
    ends_a, ends_b = np.cumsum(enc.size_a[ids_a]), np.cumsum(enc.size_b[ids_b])
    of_a, of_b, group = overlaps(ends_a, ends_b, piece)
    group_a, group_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    group_a[of_a], group_b[of_b] = group, group
    groups = int(group[-1]) + 1
    start_a, start_b = np.searchsorted(group_a, np.arange(groups + 1)), np.searchsorted(group_b, np.arange(groups + 1))
    part_a, part_b = np.repeat(owner, n_a), np.repeat(owner, n_b)
    part_g = part_a[start_a[:-1]]
    first_a, first_b, first_g = (np.searchsorted(x, np.arange(len(parts) + 1)) for x in (part_a, part_b, part_g))

    # the groups as text: a1,a2|b1;a3|b2
    place_a, place_b = np.arange(len(ids_a)) + start_b[group_a], np.arange(len(ids_b)) + start_a[group_b + 1]
    row, mark = np.zeros(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
    row[place_a], row[place_b] = ids_a, ids_b
    mark[place_a[start_a[1:] - 1]], mark[place_b[start_b[1:] - 1]] = ord("|"), ord(";")
    chars, used = _digits(max(len(enc.bytes_a), len(enc.bytes_b)))
    text, use = chars[row], used[row]
    text[:, -1], use[:, -1] = mark, True
    raw, ends = text[use].tobytes(), np.concatenate([[0], np.cumsum(use.sum(1))])

    links = np.concatenate([[0], np.cumsum(np.diff(start_a) * np.diff(start_b))])
    for p in range(len(parts)):
        g, h = int(first_g[p]), int(first_g[p + 1])
        if g == h:
            continue
        doc = parts[p][0]
        if doc.counts[0]:
            doc.sha.update(b";")
        doc.counts += [first_a[p + 1] - first_a[p], first_b[p + 1] - first_b[p], h - g, links[h] - links[g]]
        doc.sha.update(raw[ends[first_a[p] + first_b[p]] : ends[first_a[p + 1] + first_b[p + 1]] - 1])
    shift = 1 << 17
    for low in range(0, len(parts), 1 << 14):  # a key holds 14 bits of part, 17 of the id of a and 32 for that of b
        high = min(len(parts), low + (1 << 14))
        g, h = int(first_g[low]), int(first_g[high])
        if g == h:
            continue
        if max(len(enc.bytes_a), len(enc.bytes_b)) > shift:
            raise ValueError("vocabularies of more than 131,072 ids")
        key, n = linked_pairs(ids_a, ids_b, start_a[g : h + 1], start_b[g : h + 1], (part_g[g:h] - low) << 49)
        cut = np.searchsorted(key >> 49, np.arange(high - low + 1))
        for p in range(low, high):
            s, e = int(cut[p - low]), int(cut[p - low + 1])
            if s < e:
                parts[p][0].pairs.append((key[s:e] & ((1 << 49) - 1), n[s:e]))


FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, links array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", piece: int = PIECE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs: a, b, links.

    A text that is null or empty, or whose tokens' bytes are not its own by either tokenizer, has no tokens: zeros, an empty
    digest and no pairs.  Whole texts are encoded, long ones in parts; ids may be null or repeated, other columns take no part.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = FIELDS.replace("doc_id long", f"doc_id {dict(docs.dtypes)[doc_id]}")
    schema = to_arrow_schema(StructType.fromDDL(fields))

    def rows(texts: list[Text]) -> pa.RecordBatch:
        found = [t.row() for t in texts]
        counts = np.stack([f[0] for f in found])
        ends = pa.array(np.concatenate([[0], np.cumsum([len(f[2]) for f in found])]), pa.int32())
        key, n = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), n)]
        columns = [pa.array([t.doc_id for t in texts], schema.field(0).type), *(pa.array(c) for c in counts.T), pa.array([f[1] for f in found], pa.string()), *lists]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(path_a, path_b)
        waiting, parts, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows_in = batch.slice(at, 256)
                for name, value in zip(rows_in.column(0).to_pylist(), rows_in.column(1).to_pylist()):
                    doc = Text(name)
                    for p in enc.parts(value) if value else ():
                        parts.append((doc, p))
                        held += len(p)
                        if held >= PART or len(waiting) >= WAITING:
                            align_batch(enc, parts, piece)
                            parts, held = [], 0
                            if waiting:
                                yield rows(waiting)
                                waiting = []
                    waiting.append(doc)
            if not parts and waiting:
                yield rows(waiting)
                waiting = []
        align_batch(enc, parts, piece)
        if waiting:
            yield rows(waiting)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)


def link_counts(found: DataFrame) -> DataFrame:
    """a, b, documents (how many hold the pair linked) and whether no pair of that ``a`` is held by more."""
    counts = written(found.select(F.explode(F.arrays_zip("a", "b")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("documents")))
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))  # a row per id of A
    return counts.join(F.broadcast(most), "a").select("a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``aligned`` documents without their pairs, with n_best (links whose count is the highest of their A id) and count_sum."""
    found = written(aligned(docs, path_a, path_b, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    counts = written(link_counts(found).select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "documents", "best"))
    small = counts.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    each = found.select("row", F.explode(F.arrays_zip("a", "b", "links")).alias("p"))
    each = each.select("row", (F.shiftleft(F.col("p.a").cast("long"), 32) + F.col("p.b")).alias("pair"), F.col("p.links").alias("links"))
    fare = each.join(F.broadcast(counts) if small else counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("documents")).alias("count_sum"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.drop("a", "b", "links").join(fare, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
