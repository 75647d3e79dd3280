"""Texts of an Arrow batch as one array of UTF-8 bytes, and hashes of their parts without a loop per word."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1_000_000


def process_cache() -> dict:
    """What a Python worker keeps from task to task.

    The package's functions travel to workers by value, so a module's own global would be new in every task, and travel too.
    """
    name = "scriptorium_process_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers 0 to n, at least."""
    held = process_cache()
    if len(held.get("powers", ((),))[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        both = []
        for b in (BASE, INVERSE):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            both.append(np.cumprod(out, dtype=np.uint64))
        held["powers"] = tuple(both)
    return held["powers"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its texts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of texts of about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(end, n)
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread of 64 bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(body: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any span follows."""
    out = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(len(body))[0][: len(body)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes hash alike wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


def hashes_in_row(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that begin in rising order, a chunk of the bytes at a time."""
    out = np.zeros(len(begin), np.uint64)
    for part in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // CHUNK)) + 1) if len(begin) else ():
        low, high = begin[part[0]], end[part].max()
        out[part] = span_hash(sums(body[low:high]), begin[part] - low, end[part] - low)
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true that cross no text boundary."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    if n > 1:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
