"""Language identification by cross-parsing entropy.

A text is parsed from left to right into the longest phrases that occur in a language's sample; each phrase costs the logarithm
of the sample's length, as it can be named by its place there.  The language that needs the fewest phrases so normalised wins.

A sample is a suffix automaton, as a table of states by byte classes, in which a missing step leads to where a new phrase
that begins with this byte stands, marked as such: one look-up per byte follows the longest match.  Texts are parsed in blocks of
BLOCK bytes, all blocks of a batch in step; a phrase ends with its block.  Classes are the bytes of lower-cased letters;
whatever is neither a letter nor beyond ASCII counts as one blank.

The samples are the only thing that passes through the driver: at most ROWS excerpts of EXCERPT characters per language, whole
corpus considered, each different text once.  Workers build the automata once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import bytesets

#: Bound of the sample a language is learnt from: excerpts, and characters of each.
ROWS, EXCERPT = 256, 256
#: Parts of a language in which its least hashes are found first.
SPLITS = 64
#: Bytes that all automata of a worker may take: with very many languages their samples are cut to fit.
TABLE_BYTES = 1 << 29
#: Bytes parsed as one, bytes of text worked on at once, and the bits of evidence that double the odds of a language.
BLOCK, CHUNK, BITS = 1024, 4_000_000, 16.0
LETTER = r"\p{L}"
UNKNOWN = "und"

TEXT_BYTE = np.zeros(256, bool)
TEXT_BYTE[97:123] = TEXT_BYTE[128:] = True
NEW = np.int32(-(1 << 31))


def normal(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with one blank for each run of others, ends included, and the offsets of the texts so shortened."""
    letter = TEXT_BYTE[body]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(body)]
    keep[inner] = letter[inner]
    before = np.concatenate([[0], np.cumsum(keep)])
    return np.where(letter, body, 32)[keep].astype(np.uint8), before[offsets]


def samples(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS, excerpt: int = EXCERPT) -> dict[str, bytes]:
    """Language -> sample, from at most ``rows`` different texts of each language, those of the least hash.

    Rows without a language or without a letter teach nothing.
    """
    src = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTER)).select(
        F.col(lang).cast("string").alias("lang"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"),
    )
    chosen = src.select("lang", "h").distinct()
    for keys in (["lang", F.pmod("h", F.lit(SPLITS))], ["lang"]):  # first in parts, since a language may hold most rows
        w = Window.partitionBy(*keys).orderBy("h")
        chosen = chosen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= rows).select("lang", "h")
    start = F.pmod(F.col("h"), F.greatest(F.char_length("text") - excerpt + 1, F.lit(1))).cast("int") + 1
    taken = src.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.lower(F.substring("text", start, F.lit(excerpt))).alias("t"))
    out: dict[str, list[bytes]] = {}
    for r in taken.groupBy("lang", "h").agg(F.min("t").alias("t")).orderBy("lang", "h").collect():
        out.setdefault(r.lang, []).append(r.t.encode())
    joined = {}
    for name, parts in out.items():
        body = np.frombuffer(b" ".join(parts), np.uint8)
        joined[name] = normal(body, np.array([0, len(body)]))[0].tobytes()
    return joined


def classes(sample: dict[str, bytes]) -> np.ndarray:
    """Class of each byte: 0 for those in no sample, which no phrase holds, and one for each other."""
    used = np.unique(np.frombuffer(b"".join(sample.values()), np.uint8))
    out = np.zeros(256, np.int64)
    out[used] = np.arange(1, len(used) + 1)
    return out


def automaton(body: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of a row of classes: entry ``state + class`` holds the next state, times ``width``; NEW marks a new phrase."""
    steps: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in body.tolist():
        new = len(steps)
        steps.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in steps[at]:
            steps[at][c] = new
            at = link[at]
        if at >= 0:
            to = steps[at][c]
            if longest[to] == longest[at] + 1:
                link[new] = to
            else:
                twin = len(steps)
                steps.append(dict(steps[to]))
                longest.append(longest[at] + 1)
                link.append(link[to])
                while at >= 0 and steps[at].get(c) == to:
                    steps[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    start = np.zeros(width, np.int32)
    start[list(steps[0])] = np.array(list(steps[0].values()), np.int32) * width
    table = np.broadcast_to(start | NEW, (len(steps), width)).copy()
    of = np.repeat(np.arange(len(steps)), [len(s) for s in steps])
    by = np.fromiter((c for s in steps for c in s), np.int64, len(of))
    to = np.fromiter((t for s in steps for t in s.values()), np.int32, len(of))
    table[of, by] = to * width
    table[0] = start | NEW
    return table.ravel()


def _model(sample: dict[str, bytes]) -> tuple[np.ndarray, list[tuple[str, np.ndarray, float]]]:
    """Byte classes, and per language in order its automaton and the bits of a phrase; built once per worker process."""
    key = hashlib.sha256(repr(sorted(sample.items())).encode()).hexdigest()
    held = bytesets.process_cache().setdefault("languages", {})
    if key not in held:
        of = classes(sample)
        width = int(of.max()) + 1
        most = TABLE_BYTES // (len(sample) * 2 * width * 4)
        cut = {name: body[:most] for name, body in sorted(sample.items())}
        held.clear()
        held[key] = of, [
            (name, automaton(of[np.frombuffer(body, np.uint8)], width), float(np.log2(max(2, len(body))))) for name, body in cut.items()
        ]
    return held[key]


def phrases(body: np.ndarray, offsets: np.ndarray, of: np.ndarray, tables: list[np.ndarray], block: int = BLOCK) -> np.ndarray:
    """Phrases that each text takes with each table (texts x tables); ``body`` is normal."""
    sizes = np.diff(offsets)
    per_text = -(-sizes // block)
    text = np.repeat(np.arange(len(sizes)), per_text)
    start = offsets[text] + block * (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
    length = np.minimum(block, offsets[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    start, length, text = start[order], length[order], text[order]
    row, out = of[body], np.zeros((len(sizes), len(tables)), np.int64)
    states, counts = np.zeros((len(tables), len(start)), np.int64), np.zeros((len(tables), len(start)), np.int32)
    active = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right") if len(length) else []
    for j, k in enumerate(active):
        c = row[start[:k] + j]
        for table, state, count in zip(tables, states, counts):
            step = table[state[:k] + c]
            count[:k] += step < 0
            state[:k] = step & 0x7FFFFFFF
    for t, count in enumerate(counts):
        out[:, t] = np.bincount(text, count, len(sizes)).astype(np.int64)
    return out


def identify(docs: DataFrame, sample: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1) and by language the bits a byte costs.

    Texts that are null or have no letter, and all texts if nothing was learnt, are ``und`` with score 0 and no bits.  Equal
    costs go to the lesser name.  Whole texts are parsed; the row's other columns take no part; ids may be null or repeated.
    """
    kind = dict(docs.dtypes)[doc_id]
    src = docs.select(F.col(doc_id).alias("doc_id"), F.lower(F.when(F.col(text).rlike(LETTER), F.col(text))).alias("text"))
    fields = f"doc_id {kind}, lang_pred string, score double, bits array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, languages = _model(sample)
        tables, cost = [t for _, t, _ in languages], np.array([bits for _, _, bits in languages])
        names = np.array([name for name, _, _ in languages], object)
        for batch in batches:
            body, offsets = bytesets.utf8(batch.column(1))
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            for f, e in bytesets.chunks(offsets, CHUNK):
                low, ends = normal(body[offsets[f] : offsets[e]], offsets[f : e + 1] - offsets[f])
                bits = phrases(low, ends, of, tables) * cost
                best = bits.argmin(1)
                score = 1 / np.exp2((bits.min(1, keepdims=True) - bits) / BITS).sum(1)
                ok = known[f:e]
                each = bits / np.maximum(1, np.diff(ends))[:, None]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(f, e - f), pa.array(np.where(ok, names[best], UNKNOWN), pa.string()), pa.array(np.where(ok, score, 0.0)),
                    pa.array([r if k else None for r, k in zip(each.tolist(), ok)], pa.list_(pa.float64())),
                ], ["doc_id", "lang_pred", "score", "bits"])

    if not sample:
        return src.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("map<string,double>").alias("bits_per_byte"))
    keys = F.array(*[F.lit(name) for name in sorted(sample)])
    return src.mapInArrow(run, fields).select("doc_id", "lang_pred", "score", F.map_from_arrays(keys, "bits").alias("bits_per_byte"))
