"""Toxic spans by a linear-chain conditional random field.

The field has two states per token, clean and toxic; a token's features are its word and the first four, five and six bytes
of it.  Documents carry labels, tokens do not: a token of a toxic training document counts as toxic if one of its features
occurs far more often in toxic than in clean documents, beside many different words.  Training uses a bounded, hash-chosen sample of labelled documents;
scoring reads every whole text.  Marginals by forward-backward give spans, and the largest is the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.llm import bytesets

#: The training sample: documents of either label, and the longest text in it.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1_000, 2_000, 10_000
#: Tokens per sequence, and prefixes that are features (0: the whole word).
STEP, PREFIXES = 64, (0, 4, 5, 6)
#: Times a feature must be more frequent in toxic documents, and its least number of neighbourhoods there: that, or so many per toxic document.
RATIO, LEAST, LEAST_SHARE = 20.0, 4, 0.015
#: Toxic documents that must share it.
SPREAD = 3
#: Features with fewer neighbourhoods in the sample get no weight.
SUPPORT = 3

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
LETTERS[128:] = True


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the features that have a weight
    weights: np.ndarray  # theirs, of the toxic state
    bias: float
    steps: np.ndarray  # potentials from state to state
    prior: float  # of a text without tokens

    def potentials(self, feats: np.ndarray) -> np.ndarray:
        """Score of the toxic state by token; a table of 16 bits passes over most features without a search."""
        out = np.full(len(feats), self.bias)
        if not len(self.keys):
            return out
        known = np.zeros(1 << 16, bool)
        known[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for k in range(feats.shape[1]):
            may = np.flatnonzero(known[(feats[:, k] & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, feats[may, k]), len(self.keys) - 1)
            hit = self.keys[at] == feats[may, k]
            out[may[hit]] += self.weights[at[hit]]
        return out


def tokens(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, end and feature hashes (one column per prefix) of every token."""
    low = bytesets.LOWER[body]
    start, end = bytesets.runs(LETTERS[low], offsets)
    prefix = bytesets.sums(low)
    cols = []
    for n in PREFIXES:
        stop = np.minimum(end, start + n) if n else end
        cols.append(bytesets.mix(bytesets.span_hash(prefix, start, stop) + np.uint64(n)))
    return np.searchsorted(offsets, start, "right") - 1, start, end, np.stack(cols, 1)


def rows_of(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Row and column of each token when documents are laid out in rows of STEP tokens."""
    count = np.bincount(doc, minlength=n_docs)
    rows = -(-count // STEP)
    first = np.cumsum(rows) - rows
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[doc] + at // STEP, at % STEP, int(rows.sum())


def forward_backward(score: np.ndarray, there: np.ndarray, steps: np.ndarray, pairs: bool = False):
    """Marginals of the toxic state; with ``pairs`` also the expected number of each step from state to state."""
    n, width = score.shape
    e = np.exp(np.clip(score, -30, 30))
    a = np.zeros((width, n, 2))
    now = np.full((n, 2), 0.5)
    for t in range(width):
        new = now @ steps if t else now.copy()
        new[:, 1] *= e[:, t]
        new /= new.sum(1, keepdims=True)
        now = np.where(there[:, t, None], new, now)
        a[t] = now
    out, expected = np.zeros((n, width)), np.zeros((2, 2))
    back = np.ones((n, 2))
    for t in range(width - 1, -1, -1):
        p = a[t] * back
        out[:, t] = p[:, 1] / p.sum(1)
        if t:
            right = back * np.stack([np.ones(n), e[:, t]], 1)
            if pairs:
                x = a[t - 1][:, :, None] * steps[None] * right[:, None, :]
                x /= x.sum((1, 2), keepdims=True)
                expected += x[there[:, t]].sum(0)
            new = right @ steps.T
            new /= new.sum(1, keepdims=True)
            back = np.where(there[:, t, None], new, back)
    return (out, expected) if pairs else out


def sampled_tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document and feature hashes of every token, a run of texts at a time, so that what is held by the byte stays small."""
    body, offsets = bytesets.utf8(pa.array(texts, pa.string()))
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros((0, len(PREFIXES)), np.uint64)]
    for first, end in bytesets.chunks(offsets):
        doc, _, _, found = tokens(body[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first])
        docs.append(doc + first)
        hashes.append(found)
    return np.concatenate(docs), np.concatenate(hashes)


def fit(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.5, decay: float = 1e-4, batch: int = 4096) -> Model:
    """A field fitted to labelled texts by Adagrad on the likelihood of the derived token labels."""
    label = np.array(labels, bool)
    doc, hashes = sampled_tokens(texts)
    toxic_docs, clean_docs = int(label.sum()), int((~label).sum())
    # a column at a time: the driver holds no sorted copy of all hashes
    keys = np.unique(np.concatenate([np.unique(hashes[:, k]) for k in range(hashes.shape[1])]))
    feats, size = np.empty(hashes.shape, np.int32), len(keys)
    for k in range(hashes.shape[1]):
        feats[:, k] = np.searchsorted(keys, hashes[:, k])
    model = Model(keys[:0], np.zeros(0), -4.0, np.array([[0.98, 0.02], [0.5, 0.5]]), toxic_docs / max(1, len(texts)) / 10)
    if not toxic_docs or not len(doc):
        return model
    # copies repeat a word beside the same words, so a feature's support is the number of its distinct neighbourhoods
    word = hashes[:, 0].copy()
    del hashes
    beside = bytesets.mix(np.roll(word, 1) * np.uint64(3) + np.roll(word, -1))
    in_toxic, in_clean = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for k in range(feats.shape[1]):
        for m, into in ((label[doc], in_toxic), (~label[doc], in_clean)):
            pair = bytesets.mix(beside[m] ^ (feats[m, k].astype(np.uint64) * np.uint64(bytesets.BASE)))
            into += np.bincount(feats[m, k][np.unique(pair, return_index=True)[1]], minlength=size)
    known = in_toxic + in_clean >= SUPPORT
    odds = ((in_toxic + 0.1) / max(1, label[doc].sum())) / ((in_clean + 0.5) / max(1, (~label[doc]).sum()))
    in_docs = np.bincount(np.unique((doc[label[doc], None] * size + feats[label[doc]]).ravel()) % size, minlength=size)
    telling = (odds >= RATIO) & (in_docs >= SPREAD) & (in_toxic >= max(LEAST, LEAST_SHARE * toxic_docs))
    gold = telling[feats].any(1) & label[doc]
    row, col, n = rows_of(doc, len(texts))
    there, y, grid = np.zeros((n, STEP), bool), np.zeros((n, STEP), bool), np.zeros((n, STEP, len(PREFIXES)), np.int32)
    there[row, col], y[row, col], grid[row, col] = True, gold, feats
    rng = np.random.default_rng(7)
    # every row with a toxic token, and as many others three times over
    marked = y.any(1)
    others = rng.permutation(np.flatnonzero(~marked))[: max(2000, 3 * int(marked.sum()))]
    use = np.concatenate([np.flatnonzero(marked), others])
    weights = np.zeros(size)
    total, total_bias, logs, total_logs = np.full(size, 1e-8), 1e-8, np.log(model.steps), np.full((2, 2), 1e-8)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // batch * 8)):
            f, m, g = grid[part], there[part], y[part]
            p, expected = forward_backward(weights[f].sum(2) + model.bias, m, model.steps, pairs=True)
            error = (g - p) * m
            grad = np.zeros(size)
            for k in range(len(PREFIXES)):
                grad += np.bincount(f[:, :, k].ravel(), error.ravel(), size)
            used = np.flatnonzero((grad != 0) & known)
            total[used] += grad[used] ** 2
            weights[used] += rate * grad[used] / np.sqrt(total[used]) - rate * decay * weights[used]
            total_bias += error.sum() ** 2
            model.bias += rate * error.sum() / np.sqrt(total_bias)
            both = m[:, 1:] & m[:, :-1]
            was, now = g[:, :-1][both], g[:, 1:][both]
            counts = np.array([[(~was & ~now).sum(), (~was & now).sum()], [(was & ~now).sum(), (was & now).sum()]])
            step = counts - expected
            total_logs += step**2
            logs += 0.1 * step / np.sqrt(total_logs)
            model.steps = np.exp(logs - logs.max())
    model.keys, model.weights = keys[weights != 0], weights[weights != 0]
    return model


def crc_text(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """A model from at most SAMPLE_TOXIC + SAMPLE_CLEAN labelled documents outside the held-out fifth."""
    rows = labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("toxic")).where(
        F.col("id").isNotNull() & F.col("toxic").isNotNull() & (crc_text(F.col("id")) % 5 != 0)
    ).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        part = rows.where(F.col("toxic") == value).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    short = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    # a bounded number of ids is broadcast, and a bounded sample of bounded texts comes to the driver
    sample = short.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "text").limit(SAMPLE_TOXIC + SAMPLE_CLEAN)
    got = sample.select("text", "toxic").toArrow()
    return fit(got["text"].to_pylist(), got["toxic"].to_pylist())


def judge(texts: pa.Array, model: Model, least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and its spans of tokens that are more likely toxic, in code points."""
    body, offsets = bytesets.utf8(texts)
    n = len(offsets) - 1
    score, spans = np.full(n, model.prior), [[] for _ in range(n)]
    for first, end in bytesets.chunks(offsets):
        part, at = body[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        doc, start, stop, feats = tokens(part, at)
        if not len(doc):
            continue
        row, col, rows = rows_of(doc, end - first)
        grid, there = np.zeros((rows, STEP)), np.zeros((rows, STEP), bool)
        grid[row, col], there[row, col] = model.potentials(feats), True
        p = forward_backward(grid, there, model.steps)[row, col]
        held, where = np.unique(doc, return_index=True)
        score[first + held] = np.maximum.reduceat(p, where)
        hot = np.flatnonzero(p >= least)
        if len(hot):
            points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
            new = np.concatenate([[True], (np.diff(hot) > 1) | (np.diff(doc[hot]) > 0)])
            for group in np.split(hot, np.flatnonzero(new)[1:]):
                d = doc[group[0]]
                zero = points[at[d]]
                spans[first + d].append(
                    {"start": int(points[start[group[0]]] - zero), "end": int(points[stop[group[-1]]] - zero), "score": float(p[group].max())}
                )
    return score, spans


def tag(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per document: row (the whole input row), score, spans (start, end, score; code points, end exclusive).

    Null and empty texts have no spans and the prior as their score.  Ids, languages and sources play no part; repeated
    rows each get their result; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    # the text goes to the worker once, inside its row
    src, at = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")), docs.columns.index(text)
    schema = StructType([src.schema["row"]])
    schema = StructType(schema.fields + StructType.fromDDL("score double, spans array<struct<start:int,end:int,score:double>>").fields)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, found = judge(b.column(0).field(at), held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array(found, spans)], ["row", "score", "spans"])

    return src.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **names: str) -> DataFrame:
    """The documents that score below the threshold, unchanged."""
    model = train(docs, labels, **names)
    return tag(docs, model, names.get("text", "text")).where(F.col("score") < threshold).select("row.*")
