"""Vector arithmetic and the default embedder."""

from __future__ import annotations

import hashlib
import math
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import let, tokens

DIMENSIONS = 64
#: Hex digits, and for each, modulo 4, a letter that is none.
HEX, QUARTERS = "0123456789abcdef", "ghij" * 4


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where either vector is zero."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def bag_of_words(text: Column) -> Column:
    """Default embedder: token counts over 64 hash buckets, the first two hex digits of a token's md5 modulo 64.

    A token's bucket is written as two characters, of which the first is no hex digit, so that a bucket's count is what the
    text of all buckets loses with it.
    """
    def bucket(w: Column) -> Column:
        return let(F.md5(w), lambda h: F.concat(F.translate(F.substring(h, 1, 1), HEX, QUARTERS), F.substring(h, 2, 1)))

    def count(b: Column, name: Column) -> Column:
        return F.shiftright(F.octet_length(b) - F.octet_length(F.replace(b, name, F.lit(""))), 1)

    names = F.array(*[F.lit(q + h) for q in QUARTERS[:4] for h in HEX])
    return let(F.array_join(F.transform(tokens(text), bucket), ""), lambda b: F.when(
        b.isNotNull(), F.transform(names, lambda name: count(b, name))
    ))


#: Digest steps' rotations and constants; the message word of a step. Longest token of one block of 64 bytes.
ROTATIONS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
CONSTANTS = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
WORDS = [(a * i + b) % 16 for a, b, low in ((1, 0, 0), (5, 1, 16), (3, 5, 32), (7, 0, 48)) for i in range(low, low + 16)]
ONE_BLOCK = 55


def first_digest_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first byte of the md5 of every ``data[offsets[i]:offsets[i + 1]]``, for all that fit one block at once."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    for i in np.flatnonzero(sizes > ONE_BLOCK).tolist():
        out[i] = hashlib.md5(data[offsets[i] : offsets[i + 1]].tobytes()).digest()[0]
    short = np.flatnonzero(sizes <= ONE_BLOCK)
    n, size = len(short), sizes[short]
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    block = np.zeros((n, 64), np.uint8)
    block[row, at] = data[np.repeat(offsets[:-1][short], size) + at]
    block[np.arange(n), size] = 0x80
    block.view("<u4")[:, 14] = 8 * size
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | ~d))[i // 16]
        x = a + f + words[WORDS[i]] + np.uint32(CONSTANTS[i])
        a, d, c, b = d, c, b, b + ((x << np.uint32(ROTATIONS[i])) | (x >> np.uint32(32 - ROTATIONS[i])))
    out[short] = (a + np.uint32(0x67452301)) & 0xFF
    return out


def _word_characters() -> np.ndarray:
    """Whether a code point is a letter, a number or the underscore, as in ``TOKEN``; one table per worker process.

    Functions travel by value, so what they name is new in every task; a module of the worker is not.
    """
    held = sys.modules.setdefault("_scriptorium_vectors", types.ModuleType("_scriptorium_vectors")).__dict__
    if "letters" not in held:
        held["letters"] = np.array([c.isalnum() or c == "_" for c in map(chr, range(sys.maxunicode + 1))])
    return held["letters"]


def _within_tokens(data: np.ndarray) -> np.ndarray:
    """Whether a byte of UTF-8 belongs to a word character."""
    letters = _word_characters()
    within = letters[:256].take(data) & (data < 0x80)
    lead = np.flatnonzero(data >= 0xC0)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0xF8)):
        at = lead[(data[lead] >= low) & (data[lead] < high)]
        code = data[at].astype(np.int32) & (0x7F >> size)
        for i in range(1, size):
            code = code << 6 | data[at + i] & 0x3F
        for i in range(size):
            within[at + i] = letters[code]
    return within


def _count_tokens(lowered: pa.Array) -> pa.Array:
    """Token counts of a batch: tokens are runs of the bytes of all its texts, and each different one is hashed once."""
    n, lowered = len(lowered), lowered.cast(pa.string())
    absent = lowered.is_null()
    texts = pc.fill_null(lowered, "")
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(values, np.uint8)[bounds[0] : bounds[-1]] if values is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    within = _within_tokens(data)
    first = within.copy()
    first[1:] &= ~within[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = within[begins]
    starts = np.flatnonzero(first)
    kept = data[within]
    ends = np.append(np.cumsum(within, dtype=np.int32)[starts] - 1, len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
    different = found.dictionary
    _, offsets, values = different.buffers()
    if len(different):
        bucket = first_digest_bytes(np.frombuffer(values, np.uint8), np.frombuffer(offsets, np.int32)[: len(different) + 1]) % DIMENSIONS
        flat = bucket[found.indices.to_numpy()]
    else:
        flat = np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, bounds)))
    counts = np.bincount(row * DIMENSIONS + flat, minlength=n * DIMENSIONS).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DIMENSIONS), pa.array(counts), mask=absent)


def bag_of_words_batches(text: Column) -> Column:
    """``bag_of_words`` by Arrow batches, for many rows; not for use inside a lambda."""
    counted = F.arrow_udf(_count_tokens, "array<int>")
    return counted(F.lower(text))


def _cosines_of_neighbours(lowered: pa.Array) -> pa.Array:
    """Per row of texts, the cosine of each text and the next by ``_count_tokens``; null texts are at similarity 0."""
    texts = lowered.flatten()
    counts = _count_tokens(pc.fill_null(texts.cast(pa.string()), "")).flatten().to_numpy().reshape(-1, DIMENSIONS).astype(np.float64)
    squares = (counts * counts).sum(axis=1)
    scale = np.sqrt(squares[:-1] * squares[1:])
    found = np.divide((counts[:-1] * counts[1:]).sum(axis=1), scale, out=np.zeros(len(scale)), where=scale > 0)
    sizes = pc.fill_null(pc.list_value_length(lowered), 0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    inner = np.ones(len(texts), bool)
    inner[ends[sizes > 0] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(np.maximum(sizes - 1, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[inner[:-1]]), mask=lowered.is_null())


def bag_of_words_neighbours(texts: Column) -> Column:
    """Cosines of each text of an array and the next by Arrow batches; not for use inside a lambda."""
    return F.arrow_udf(_cosines_of_neighbours, "array<double>")(F.transform(texts, F.lower))


Embedder = Callable[[Column], Column]
