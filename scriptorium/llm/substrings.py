"""Removal of byte strings that an earlier document has, by suffix arrays.

A string of LENGTH bytes is found through its anchor: of the GRAM-byte strings in it, the one of least hash, so that equal
strings have equal anchors wherever they stand.  Consecutive strings with one anchor form a context of at most 77 bytes.

1. Documents lie in shards, a bucketed table; each shard sends the sorted hashes of its anchors, in packed rows, to buckets.
2. A bucket finds by binary search which hashes several documents have, and tells the shards.
3. Shards send the contexts of those anchors, equal ones once with their least id.
4. A bucket sorts the strings of contexts that share an anchor but differ: suffix arrays by Larsson-Sadakane refinement,
   common prefixes by Kasai, both in numpy; arrays of several runs are merged by binary search.  Every string gets the
   least id that has it.
5. Shards cover the strings whose least id is below the document's own.

A hot passage costs each shard one context per anchor, whatever the number of its documents; where very many different
contexts share an anchor, as at the edge of such a passage, each string goes to the bucket of its own hash.  Texts move once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import bytesets
from scriptorium.session import new_folder

LENGTH, GRAM = 50, 24
#: Bytes of a shard and of what a bucket gathers, and of contexts in one suffix array: they bound memory only.
SHARD_BYTES, BUCKET_BYTES, RUN_BYTES, STEP_BYTES = 3_000_000, 2_000_000, 1_000_000, 500_000

#: Contexts of one anchor in a shard from which the anchor is hot: its strings are then dealt one by one, by their own hash.
HOT = 256

U = np.uint64
KEY = U(0xFFFFFFFFFFFF0000)  # keys travel as six bytes


@dataclass
class Anchors:
    key: np.ndarray  # hash of the anchor
    first: np.ndarray  # first and last start of its strings
    last: np.ndarray
    doc: np.ndarray


def anchors(body: np.ndarray, offsets: np.ndarray) -> Anchors:
    """All anchors of the documents in ``body``, found a few documents at a time; strings never cross a boundary."""
    parts = []
    for f, e in bytesets.chunks(offsets, STEP_BYTES):
        a = _anchors(body[offsets[f] : offsets[e]], offsets[f : e + 1] - offsets[f])
        parts.append((a.key, a.first + offsets[f], a.last + offsets[f], a.doc + f))
    if not parts:
        parts = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    return Anchors(*(np.concatenate(x) for x in zip(*parts)))


def _anchors(body: np.ndarray, offsets: np.ndarray) -> Anchors:
    n, wide = len(body), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return Anchors(none.astype(np.uint64), none, none, none)
    p = np.arange(n - GRAM + 1)
    hashes = bytesets.span_hash(bytesets.sums(body), p, p + GRAM)
    least = (hashes & U(0xFFFFFFFF00000000)) | p.astype(np.uint64)
    step = 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if wide > step:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not len(doc):
        return Anchors(none.astype(np.uint64), none, none, none)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[:-1], sizes)
    at = at[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    return Anchors(hashes[at[new]] & KEY, start[new], start[last], doc[new])


def pack_keys(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view(np.uint64).ravel()


def has(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys are among the sorted ones, by binary search."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)] == keys


def _cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of sorted keys, and where each begins (with the end)."""
    bucket = (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return bucket[begin], np.append(begin, len(keys))


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of small non-negative integers by their first ``depth`` members, and their ranks.

    Larsson-Sadakane: groups of equal prefixes are refined by the ranks behind them, and sorted groups are left alone.
    """
    n, start = len(text), 7
    padded = np.concatenate([text.astype(np.uint64), np.zeros(start, np.uint64)])
    packed = np.zeros(n, np.uint64)
    for k in range(start):
        packed = (packed << U(9)) | padded[k : k + n]
    order = np.argsort(packed, kind="stable")
    rank = np.zeros(n, np.int64)
    new = np.concatenate([[True], packed[order][1:] != packed[order][:-1]]) if n else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
    h = start
    while h < depth:
        size = np.diff(np.append(np.flatnonzero(new), n))
        open_at = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(open_at):
            break
        who = order[open_at]
        behind = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = (rank[who].astype(np.uint64) << U(32)) | behind.astype(np.uint64)
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[open_at] = who
        new[open_at[1:]] |= key[1:] != key[:-1]
        begin = np.flatnonzero(new)
        rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, begin: np.ndarray, sizes: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of every suffix with the one before it in order.

    Kasai, with all contexts walked side by side: from one start to the next at most one member is lost.  Prefixes end
    where a context does.  The order need not go beyond ``depth``; where it leaves a tie the other way round behind it,
    counting begins anew.
    """
    n = len(text)
    out = np.zeros(n, np.int64)
    end = np.repeat(begin + sizes, sizes + 1)[:n]
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.zeros(n + 1, np.int64)
    at[order] = np.arange(n)
    h, last = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
    for t in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > t)
        p = begin[live] + t
        q = before[p]
        got = np.where((last[live] >= 0) & (at[last[live] + 1] < at[p]), np.maximum(h[live] - 1, 0), 0)
        go = np.flatnonzero((q >= 0) & (got < depth))
        while len(go):
            a, b = p[go] + got[go], q[go] + got[go]
            same = (a < end[p[go]]) & (b < end[q[go]])
            same[same] = text[a[same]] == text[b[same]]
            go = go[same]
            got[go] += 1
            go = go[got[go] < depth]
        h[live], last[live] = got, q
        out[p] = got
    return out


def least_ids(body: np.ndarray, begin: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id having each string, in the order of contexts and of starts in them; and how many strings a context has.

    Contexts are cut into runs with a suffix array each; the runs' sorted strings are merged by binary search.
    """
    strings = sizes - LENGTH + 1
    out = np.zeros(int(strings.sum()), np.int64)
    where = np.cumsum(strings) - strings
    total = np.cumsum(sizes + 1)
    runs, parts = [], np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(total // RUN_BYTES)) + 1)
    several = len(parts) > 1
    for part in parts:
        size = sizes[part]
        at = np.cumsum(size + 1) - (size + 1)
        text = np.zeros(int((size + 1).sum()), np.uint16)  # a zero ends each context
        owner = np.repeat(np.arange(len(part)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        text[at[owner] + place] = body[begin[part][owner] + place].astype(np.uint16) + 1
        order, _ = suffix_array(text)
        prefix = common_prefixes(text, order, at, size)
        # the starts of strings, in suffix order
        mine, number = np.full(len(text), -1, np.int64), strings[part]
        owner = np.repeat(np.arange(len(part)), number)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
        mine[at[owner] + place] = where[part][owner] + place
        # those between two starts are shorter than LENGTH or equal to neither, so the least prefix on the way decides
        linked = prefix[order] >= LENGTH
        keep = mine[order] >= 0
        block = np.cumsum(~linked)[keep]
        slot = mine[order][keep]
        change = np.concatenate([[True], block[1:] != block[:-1]])
        group = np.cumsum(change) - 1
        id_of = ids[part][np.searchsorted(where[part], slot, "right") - 1]
        least = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, id_of)
        text8 = (text - 1).astype(np.uint8)
        window = np.lib.stride_tricks.sliding_window_view(text8, LENGTH)[order[keep][change]] if several else np.zeros((0, LENGTH), np.uint8)
        runs.append((window.view(f"S{LENGTH}").ravel(), least, group, slot))
    for i, (strings_i, least_i, *_) in enumerate(runs if several else ()):
        for strings_j, least_j, *_ in runs[i + 1 :]:
            at = np.minimum(np.searchsorted(strings_j, strings_i), len(strings_j) - 1)
            same = np.flatnonzero(strings_j[at] == strings_i)
            both = np.minimum(least_i[same], least_j[at[same]])
            least_i[same], least_j[at[same]] = both, both
    # a second round carries what later runs gave the earlier ones to all
    for i, (strings_i, least_i, *_) in enumerate(runs if several else ()):
        for strings_j, least_j, *_ in runs[:i] + runs[i + 1 :]:
            at = np.minimum(np.searchsorted(strings_j, strings_i), len(strings_j) - 1)
            same = np.flatnonzero(strings_j[at] == strings_i)
            least_i[same] = np.minimum(least_i[same], least_j[at[same]])
    for _, least, group, slot in runs:
        out[slot] = least[group]
    return out, strings


def _read(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a shard with ids, as bytes; rows without id are left out."""
    table = table.filter(pa.compute.is_valid(table["id"])).combine_chunks()
    ids = table["id"].to_numpy()
    column = table["text"].chunk(0) if table.num_rows else pa.array([], pa.string())
    body, offsets = bytesets.utf8(column)
    return ids, body, offsets


def _send_keys(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        ids, body, offsets = _read(table)
        a = anchors(body, offsets)
        order = np.lexsort((ids[a.doc], a.key))
        key, who = a.key[order], ids[a.doc][order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        # a hash of several documents goes twice, a hot one three times: that is all a bucket needs to know
        first = np.flatnonzero(new)
        many = first[np.maximum.reduceat(who, first) != np.minimum.reduceat(who, first)] if len(first) else first
        content = _content(body, a.first, a.last)
        each = np.lexsort((content, a.key))
        k, c = a.key[each], content[each]
        distinct = k[np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])] if len(k) else k
        names, times = np.unique(distinct, return_counts=True)
        hot = np.intersect1d(names[times >= HOT], key[many])
        sent = np.sort(np.concatenate([key[first], key[many], hot]))
        bucket, cut = _cuts(sent, buckets)
        shard = table["shard"][0].as_py()
        return pa.table({
            "bucket": pa.array(bucket, pa.int32()), "shard": pa.array([shard] * len(bucket), pa.int32()),
            "keys": pa.array([pack_keys(sent[i:j]) for i, j in zip(cut, cut[1:])], pa.binary()),
        })

    return run


def _find_shared(table: pa.Table) -> pa.Table:
    lists = [unpack_keys(x) for x in table["keys"].to_pylist()]
    both = np.sort(np.concatenate(lists))
    shared = np.unique(both[1:][both[1:] == both[:-1]])
    third = [np.unique(x[2:][x[2:] == x[:-2]]) for x in lists]
    hot = np.unique(np.concatenate(third))
    told = [np.unique(x[has(shared, x)]) for x in lists]
    return pa.table({
        "shard": table["shard"], "keys": pa.array([pack_keys(x) for x in told], pa.binary()),
        "hot": pa.array([pack_keys(x[has(hot, x)]) for x in told], pa.binary()),
    })


def _content(body: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the contexts from the first to the last start."""
    return bytesets.mix(bytesets.hashes_in_row(body, first, last + LENGTH) + (last - first).astype(np.uint64))


def _all_keys(column) -> np.ndarray:
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *[unpack_keys(x) for x in column.to_pylist()]]))


def _contexts(ids: np.ndarray, body: np.ndarray, offsets: np.ndarray, shared: np.ndarray, hot: np.ndarray):
    """Occurrences of shared anchors, their context numbers, and the distinct contexts: sorted by key, then content.

    A hot anchor's strings are contexts of their own, with their own hash as key.
    """
    a = anchors(body, offsets)
    use = np.flatnonzero(has(shared, a.key))
    key, first, last, doc = a.key[use], a.first[use], a.last[use], a.doc[use]
    times = np.where(has(hot, key), last - first + 1, 1)
    own = np.repeat(np.arange(len(use)), times)
    if len(own) > len(use):
        alone = times[own] > 1
        start = first[own] + np.where(alone, np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times), 0)
        first, last, doc = start, np.where(alone, start, last[own]), doc[own]
        key = np.where(alone, _content(body, first, last) & KEY, key[own])
    content = _content(body, first, last)
    order = np.lexsort((ids[doc], content, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])]) if len(key) else np.zeros(0, bool)
    number = np.zeros(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    lead = order[new]
    return first, last, doc, number, lead, key[lead]


def _send_contexts(buckets: int):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        ids, body, offsets = _read(table) if table.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
        shared, hot = _all_keys(told["keys"]), _all_keys(told["hot"])
        first, last, doc, _, lead, key = _contexts(ids, body, offsets, shared, hot)
        bucket, cut = _cuts(key, buckets)
        begin, size = first[lead], last[lead] - first[lead] + LENGTH
        raw = [body[b : b + s].tobytes() for b, s in zip(begin.tolist(), size.tolist())]
        part = list(zip(cut, cut[1:]))
        shard = (table if table.num_rows else told)["shard"][0].as_py()
        return pa.table({
            "bucket": pa.array(bucket, pa.int32()), "shard": pa.array([shard] * len(bucket), pa.int32()),
            "base": pa.array([int(i) for i, _ in part], pa.int32()),
            "keys": pa.array([pack_keys(key[i:j]) for i, j in part], pa.binary()),
            "sizes": pa.array([size[i:j].astype(np.uint8).tobytes() for i, j in part], pa.binary()),
            "body": pa.array([pa.compress(b"".join(raw[i:j]), "zstd", asbytes=True) for i, j in part], pa.binary()),
            "ids": pa.array([ids[doc[lead[i:j]]].tobytes() for i, j in part], pa.binary()),
            # what the shard was told comes back to it with the answer to its first row
            "shared": pa.array([pack_keys(shared) if not i else b"" for i in range(len(part))], pa.binary()),
            "hot": pa.array([pack_keys(hot) if not i else b"" for i in range(len(part))], pa.binary()),
        })

    return run


def _judge(table: pa.Table) -> pa.Table:
    """For every context sent: runs of strings with the least id that has them."""
    raw = {n: table[n].to_pylist() for n in ("keys", "sizes", "body", "ids")}
    lengths = [int(np.frombuffer(x, np.uint8).sum(dtype=np.int64)) for x in raw["sizes"]]
    key = np.concatenate([unpack_keys(x) for x in raw["keys"]])
    size = np.concatenate([np.frombuffer(x, np.uint8) for x in raw["sizes"]]).astype(np.int64)
    body = np.concatenate([np.frombuffer(pa.decompress(x, n, "zstd", asbytes=True), np.uint8) for x, n in zip(raw.pop("body"), lengths)])
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in raw["ids"]])
    begin = np.cumsum(size) - size
    content = bytesets.mix(bytesets.hashes_in_row(body, begin, begin + size) + size.astype(np.uint64))
    order = np.lexsort((ids, content, key))
    k, c = key[order], content[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    number = np.zeros(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    lead = order[new]  # of equal contexts, the one of least id
    per_key = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_key))
    differs = np.repeat(per_key, per_key) > 1
    # one run of strings per context, unless others with its anchor differ
    who, start, stop, least = [np.flatnonzero(~differs)], [], [], [ids[lead[~differs]]]
    start.append(np.zeros(len(who[0]), np.int64))
    stop.append(size[lead[~differs]] - LENGTH + 1)
    different = np.flatnonzero(differs)
    # equal strings have one anchor, so what lies under different anchors is sorted apart; only a hot one takes several runs
    other = np.concatenate([[True], k[new][different][1:] != k[new][different][:-1]]) if len(different) else np.zeros(0, bool)
    volume = np.cumsum(size[lead[different]]) // RUN_BYTES
    leader = np.maximum.accumulate(np.where(other, np.arange(len(different)), 0))
    for some in np.split(different, np.flatnonzero(np.diff(volume[leader])) + 1) if len(different) else ():
        low, strings = least_ids(body, begin[lead[some]], size[lead[some]], ids[lead[some]])
        owner = np.repeat(np.arange(len(some)), strings)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])]))
        end = np.append(edge[1:], len(owner)) - 1
        who, start, stop, least = [*who, some[owner[edge]]], [*start, place[edge]], [*stop, place[end] + 1], [*least, low[edge]]
    who, start, stop, least = (np.concatenate(x) for x in (who, start, stop, least))
    by = np.argsort(who, kind="stable")
    who, start, stop, least = who[by], start[by], stop[by], least[by]
    count = np.bincount(who, minlength=len(lead))
    head = np.cumsum(count) - count
    out = {n: [] for n in ("numbers", "starts", "stops", "least")}
    at = 0
    for raw_keys, base in zip(raw["keys"], table["base"].to_pylist()):
        n = len(raw_keys) // 6
        mine = number[at : at + n]
        rows = np.repeat(head[mine], count[mine]) + np.arange(int(count[mine].sum())) - np.repeat(np.cumsum(count[mine]) - count[mine], count[mine])
        out["numbers"].append((np.repeat(np.arange(n), count[mine]) + base).astype(np.int32).tobytes())
        out["starts"].append(start[rows].astype(np.uint8).tobytes())
        out["stops"].append(stop[rows].astype(np.uint8).tobytes())
        out["least"].append(least[rows].tobytes())
        at += n
    return pa.table({"shard": table["shard"], **{n: pa.array(x, pa.binary()) for n, x in out.items()}, "shared": table["shared"], "hot": table["hot"]})


SPANS = "array<struct<start:int,end:int>>"


def _cover(table: pa.Table, judged: pa.Table) -> pa.Table:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    if not table.num_rows:
        return pa.table({"id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], kind), "kept": pa.array([], pa.string())})
    lost = table.filter(pa.compute.is_null(table["id"]))
    ids, body, offsets = _read(table)
    first, _, doc, number, _, _ = _contexts(ids, body, offsets, _all_keys(judged["shared"]), _all_keys(judged["hot"]))
    of = {n: np.concatenate([np.zeros(0, t), *[np.frombuffer(x, t) for x in judged[n].to_pylist()]]) for n, t in (("numbers", np.int32), ("starts", np.uint8), ("stops", np.uint8), ("least", np.int64))}
    by = np.argsort(of["numbers"], kind="stable")
    start, stop, least = of["starts"][by].astype(np.int64), of["stops"][by].astype(np.int64), of["least"][by]
    count = np.bincount(of["numbers"], minlength=int(number.max(initial=-1)) + 1)
    head = np.cumsum(count) - count
    times = count[number]
    rows = np.repeat(head[number], times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    owner = np.repeat(np.arange(len(first)), times)
    gone = least[rows] < ids[doc[owner]]
    rows, owner = rows[gone], owner[gone]
    depth = np.bincount(first[owner] + start[rows], minlength=len(body) + 1) - np.bincount(first[owner] + stop[rows] + LENGTH - 1, minlength=len(body) + 1)
    covered = np.cumsum(depth)[: len(body)] > 0
    a, b = bytesets.runs(covered, offsets)
    spans = [[] for _ in ids]
    for d, s, e in zip((np.searchsorted(offsets, a, "right") - 1).tolist(), a.tolist(), b.tolist()):
        spans[d].append({"start": s - int(offsets[d]), "end": e - int(offsets[d])})
    kept = []
    for d in range(len(ids)):
        part = body[offsets[d] : offsets[d + 1]]
        kept.append(hashlib.sha256((part[~covered[offsets[d] : offsets[d + 1]]] if spans[d] else part).tobytes()).hexdigest())
    raw = [(x or "").encode() for x in lost["text"].to_pylist()]
    return pa.table({
        "id": pa.array(np.append(ids, np.zeros(len(raw), np.int64)), mask=np.arange(len(ids) + len(raw)) >= len(ids)),
        "n_bytes": pa.array(np.append(np.diff(offsets), [len(x) for x in raw]).astype(np.int64)),
        "spans": pa.array(spans + [[] for _ in raw], kind), "kept": pa.array(kept + [hashlib.sha256(x).hexdigest() for x in raw]),
    })


def _sharded(docs: DataFrame, volume: int) -> tuple[DataFrame, str]:
    """The documents as a table bucketed by shard, in the shared folder; its name is to be dropped from the catalog."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), volume // (4 * SHARD_BYTES) + 1)
    shard = F.pmod(F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text"))), F.lit(4 * buckets)).cast("int")
    name = f"shards_{uuid.uuid4().hex}"
    docs.withColumn("shard", shard).repartition(buckets, "shard").write.bucketBy(buckets, "shard").options(path=new_folder(spark), compression="zstd").saveAsTable(name)
    return spark.table(name), name


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (byte ranges that go), kept_sha256 (of the bytes that stay).

    A byte goes if a string of LENGTH bytes over it also starts in a document of a smaller id; strings are judged on the
    input.  Null is the empty text.  Rows of one id do not remove each other's bytes; rows without id stay whole and
    remove nothing.  An empty table gives no rows.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    volume = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards, _ = _sharded(src, volume)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), volume // 2 // BUCKET_BYTES + 1)
    keys = shards.groupBy("shard").applyInArrow(_send_keys(buckets), "bucket int, shard int, keys binary")
    told = keys.groupBy("bucket").applyInArrow(_find_shared, "shard int, keys binary, hot binary")
    sent = shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(
        _send_contexts(buckets), "bucket int, shard int, base int, keys binary, sizes binary, body binary, ids binary, shared binary, hot binary"
    )
    judged = sent.groupBy("bucket").applyInArrow(_judge, "shard int, numbers binary, starts binary, stops binary, least binary, shared binary, hot binary")
    out = shards.groupBy("shard").cogroup(judged.groupBy("shard")).applyInArrow(_cover, f"id long, n_bytes long, spans {SPANS}, kept string")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "spans", F.col("kept").alias("kept_sha256"))
