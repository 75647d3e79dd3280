"""Importance resampling of a corpus towards a target distribution.

Features are runs of one to ORDERS words in hashed buckets.  A bucket's gain is the scaled logarithm of its share in the target
over its share in the corpus; a document weighs the sum of the gains of its features.  With Gumbel noise, which depends on the
seed and the id alone, the k highest scores are a draw without replacement by weight.

Bucket counts of both sides are summed per task before the shuffle; what reaches the driver is one number per bucket.  Weights
are array look-ups: a word's checksum comes from its bytes, that of a run from those of its words, since appending bytes to a
checksum is linear.  The k-th score is found without sorting the corpus: a quantile sketch brackets it, exact counts outside
the bracket confirm it or widen it, and only rows inside the bracket are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import bytesets
from scriptorium.llm.common import ordered_positions, written

ORDERS, BUCKETS = 3, 10_000
#: Words below which a document isn't drawn, share drawn in hundredths, and the seed of the noise.
MIN_WORDS, PERCENT, SEED = 20, 5, 42
#: Error of the sketch's ranks is one in ACCURACY; words worked on at once bound memory only.
ACCURACY, WORDS_AT_ONCE = 10_000, 1 << 18

#: Bytes of words: digits, letters in lower case, and all that is not ASCII.
WORD = np.ones(256, bool)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
#: Words above this many bytes are summed one by one.
LONG = 254


def _checksum_tables() -> dict[str, np.ndarray]:
    """``step``: the table of CRC-32; ``shift[n, k, v]``: byte k of value v of a checksum after n more zero bytes."""
    held = bytesets.process_cache()
    if "crc" not in held:
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1).astype(np.uint32)
        shift = np.zeros((LONG + 2, 4, 256), np.uint32)
        shift[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(LONG + 1):
            shift[n + 1] = step[shift[n] & 255] ^ (shift[n] >> 8)
        held["crc"] = {"step": step, "shift": shift.ravel()}
    return held["crc"]


def _appended(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums contribute once ``n`` bytes follow, at most LONG + 1."""
    flat = _checksum_tables()["shift"]
    at = n.astype(np.int64) << 10
    out = flat[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= flat[at + (256 * k) + ((crc >> np.uint32(8 * k)) & 255)]
    return out


def _word_checksums(body: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of words of at most LONG bytes (of others: anything), a byte of all words at a time."""
    step = _checksum_tables()["step"]
    order = np.argsort(-np.where(length > LONG, 0, length), kind="stable")
    first, size = start[order], np.where(length > LONG, 0, length)[order]
    active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right") if len(size) else []
    reg = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for j, k in enumerate(active):
        r = reg[:k]
        reg[:k] = step[(r ^ body[first[:k] + j]) & 255] ^ (r >> 8)
    out = np.empty_like(reg)
    out[order] = ~reg
    return out


def run_checksums(body: np.ndarray, start: np.ndarray, end: np.ndarray, orders: int = ORDERS) -> list[np.ndarray]:
    """CRC-32 of the runs of 1 to ``orders`` words joined by a space, by first word; runs behind the last word are left out."""
    length = end - start
    word = _word_checksums(body, start, length)
    long = np.flatnonzero(length > LONG)
    raw = {i: body[start[i] : end[i]].tobytes() for i in long.tolist()}
    for i, w in raw.items():
        word[i] = zlib.crc32(w)
    blank = zlib.crc32(b" ")
    small = np.minimum(length, LONG)
    spaced = word ^ _appended(np.full(len(word), blank, np.uint32), small)
    for i, w in raw.items():
        spaced[i] = zlib.crc32(w, blank)
    out = [word]
    for n in range(1, orders):
        before = out[-1][: max(0, len(word) - n)]
        run = _appended(before, small[n:] + 1) ^ spaced[n:]
        for i in (long[long >= n] - n).tolist():
            run[i] = zlib.crc32(raw[i + n], zlib.crc32(b" ", int(before[i])))
        out.append(run)
    return out


def text_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in lower-cased bytes, and where each text's words begin (n + 1 places)."""
    start, end = bytesets.runs(WORD[body], offsets)
    return start, end, np.searchsorted(start, offsets, "left")


def word_blocks(body: np.ndarray, offsets: np.ndarray, orders: int, buckets: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """For blocks of words: their first word's number, and by order the buckets of the runs and whether they stay in one text."""
    start, end, first = text_words(body, offsets)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for at in range(0, len(start), WORDS_AT_ONCE):
        stop = min(len(start), at + WORDS_AT_ONCE)
        more = min(len(start), stop + orders - 1)
        runs = run_checksums(body, start[at:more], end[at:more], orders)
        out = []
        for n, crc in enumerate(runs):
            crc = crc[: stop - at]
            inside = text[at : at + len(crc)] == text[at + n : at + n + len(crc)]
            out.append((crc % np.uint32(buckets), inside))
        yield at, out, first


def _bucket_counts(df: DataFrame, orders: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts of a one-column frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            body, offsets = bytesets.utf8(batch.column(0))
            for f, e in bytesets.chunks(offsets):
                low = bytesets.LOWER[body[offsets[f] : offsets[e]]]
                for _, runs, _ in word_blocks(low, offsets[f : e + 1] - offsets[f], orders, buckets):
                    for bucket, inside in runs:
                        total += np.bincount(bucket[inside], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    rows = df.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for s of S features in the corpus, t of T in the target.

    Null texts have no features.  Without any text on a side its counts are 0.
    """
    s, t = (_bucket_counts(df.select(F.col(text)), orders, buckets) for df in (corpus, target))
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b + 1) * all_s) / (float(a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", orders: int = ORDERS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight; null and empty texts have none and weigh 0."""
    buckets, kind = len(gain), dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = bytesets.utf8(batch.column(1))
            words, weight = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for f, e in bytesets.chunks(offsets):
                low = bytesets.LOWER[body[offsets[f] : offsets[e]]]
                held, first = [np.zeros(1, np.int64)], np.zeros(e - f + 1, np.int64)
                for _, runs, first in word_blocks(low, offsets[f : e + 1] - offsets[f], orders, buckets):
                    each = np.zeros(len(runs[0][0]), np.int64)
                    for bucket, inside in runs:
                        each[: len(bucket)] += np.where(inside, gain[bucket], 0)
                    held.append(each)
                total = np.cumsum(np.concatenate(held))
                words.append(np.diff(first))
                weight.append(np.diff(total[first]))
            n, w = np.concatenate(words), np.concatenate(weight)
            features = sum(np.maximum(n - k, 0) for k in range(orders))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, features, w))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256('seed:id'); null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def cutoff(scored: DataFrame, k: int, accuracy: int = ACCURACY) -> tuple[int, int] | None:
    """Score and id of the k-th row by score (highest first), then id; ``scored`` is a written table of (score, doc_id).

    The sketch only proposes a bracket: the rows above it and inside it are counted exactly, and it widens until the k-th
    row lies inside, at last to all rows.
    """
    n = scored.count()
    if not 0 < k <= n:
        return None
    share, width = (n - k + 1) / n, 2 / accuracy
    while True:
        if width < 1:
            ends = [max(0.0, share - width), min(1.0, share + width)]
            low, high = scored.agg(F.percentile_approx("score", F.array(*map(F.lit, ends)), accuracy)).first()[0]
        else:
            low, high = scored.agg(F.min("score"), F.max("score")).first()
        above, inside = scored.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            break
        width *= 8
    order = [F.desc("score"), F.asc("doc_id")]
    placed = ordered_positions(scored.where(F.col("score").between(low, high)), order, "_at", inside)
    row = placed.where(F.col("_at") == k - above).first()
    return row.score, row.doc_id


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS,
    seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, and rank from 1 if drawn (else null).

    Of the N documents with at least ``min_words`` words, floor(percent * N / 100) are drawn, ties to the lesser id.  A document
    without an id has a weight, but no score; it isn't drawn and not counted in N.  Repeated rows count each, and of equal ones at
    the end of the draw as many are drawn as there is room for.  Other columns of the tables take no part.
    """
    gain = gains(docs, target, text, orders, buckets)
    each = weights(docs, gain, doc_id, text, orders)
    held = written(each.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    may = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    scored = held.where(may).select("score", "doc_id")
    k = percent * scored.count() // 100
    last = cutoff(scored, k)
    if last is None:
        return held.withColumn("rank", F.lit(None).cast("long"))
    first = may & ((F.col("score") > last[0]) | ((F.col("score") == last[0]) & (F.col("doc_id") <= last[1])))
    drawn = ordered_positions(held.where(first), [F.desc("score"), F.asc("doc_id")], "rank", k)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return held.where(~F.coalesce(first, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)


def drawn_documents(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, unchanged."""
    drawn = written(resample(docs, target, doc_id, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias(doc_id)).distinct())
    return docs.join(drawn, doc_id, "left_semi")
