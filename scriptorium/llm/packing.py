"""Cost-balanced packing of documents into sequences.

A document costs ``n + QUADRATIC * n * n`` for n tokens (attention is quadratic).  Tasks tokenise their documents and pack
them in windows of ``window`` tokens: pieces in descending order, each to the sequence of least cost that still has room;
a piece that fits nowhere is cut to fill the roomiest one.  A window's sequences are all full; its last tokens, fewer than
``capacity``, form sequences of powers of two, so nothing is padded.  No row is shuffled, and a lost task repeats alone.

Words are encoded once per worker: white space bounds the tokenizer's words, so the ids of a text are those of its parts
between blanks.
"""

from __future__ import annotations

import heapq
import re
import string
import struct
import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.bytesets import process_cache

CAPACITY, END_ID = 4096, 2
#: Cost of attention against that of everything linear, per token and token.
QUADRATIC = 1 / 4096
#: Tokens packed together, and words, and runs of letters or marks, kept encoded per worker: all bound memory only.
WINDOW, CACHE, PARTS_KEPT = 1 << 20, 250_000, 400_000

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Words whose parts before the tokenizer are known: letters, then perhaps a run of marks.
LETTERS, MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "".join(c for c in string.punctuation if c not in "'<")
PLAIN, PARTS = (re.compile(f"{LETTERS}{some}[{re.escape(MARKS)}]*") for some in "+*")
#: The letter a byte is to a byte-level vocabulary: itself where it is printed, else one of those from 256 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(PRINTED)))}
PROBES = ["word", "Words", "élève", "ÀÿßØ", "internationalisation", ".", "...", "!?%$", "_", "~`"]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known, self.older = {"": b""}, {}  # words of late, and those known before them
        self.parts, self.older_parts = {"": b""}, {}  # runs of letters or marks, likewise
        self.caseless = len({tuple(self.tokenizer.encode(w, add_special_tokens=False).ids) for w in ("WORD", "word")}) == 1
        # a part's ids are those the model alone gives, if it does so for all kinds of letters and no special token is one
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self.caseless and not any(map(PARTS.fullmatch, special)) and all(
            np.frombuffer(self.part(w), "<u4").tolist() == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES
        )

    def ids(self, texts: list[str]) -> list[bytes]:
        parts = [self.lower(t).replace("\n", " ").split(" ") for t in texts]
        if len(self.known) > CACHE // 2:
            self.older, self.known = self.known, {"": b""}
        new = set().union(*parts).difference(self.known)
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        self.learn(list(new.difference(again)))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def lower(self, text: str) -> str:
        """The text in lower case where that changes no id and is done letter by letter, so that fewer words differ."""
        if not self.caseless or "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def part(self, run: str) -> bytes:
        """Ids of letters or marks that the tokenizer doesn't cut before the model."""
        run = run.lower()
        found = self.model.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(BYTE_LETTERS))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def learn(self, words: list[str]) -> None:
        """Encode new words: plain ones by the model, letters and marks apart, as words often differ in marks alone; others whole."""
        plain = list(filter(PLAIN.fullmatch, words)) if self.plain else []
        letters = [w.rstrip(MARKS) for w in plain]
        marks = [w[len(run) :] for w, run in zip(plain, letters)]
        if len(self.parts) > PARTS_KEPT // 2:
            self.older_parts, self.parts = self.parts, {"": b""}
        older = self.older_parts.get
        for run in set(letters).union(marks).difference(self.parts):
            self.parts[run] = older(run) or self.part(run)
        get = self.parts.__getitem__
        self.known.update(zip(plain, map(add, map(get, letters), map(get, marks))))
        rest = [w for w in words if w not in self.known]
        for w, x in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            self.known[w] = np.array(x.ids, "<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    held = process_cache().setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill all sequences of a window.

    Sequences hold ``capacity`` tokens, the last ones the powers of two that add up to the rest.
    """
    total = sum(lengths)
    rest = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length()) if rest >> b & 1], dtype=np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64)
    heap = [(-min(capacity, n - s), d, s) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    heapq.heapify(heap)
    out = []
    while heap:
        n, d, s = heapq.heappop(heap)
        n = -n
        fits = np.where(room >= n, cost, np.inf)
        k = int(fits.argmin())
        if fits[k] == np.inf:
            k = int(room.argmax())
            cut = int(room[k])
            heapq.heappush(heap, (cut - n, d, s + cut))
            n = cut
        out.append((d, s, n, k, int(used[k])))
        used[k] += n
        room[k] -= n
        cost[k] += n + QUADRATIC * n * n
    return out


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``start`` counts the document's ids before the piece.  Null texts count as empty: one piece with the end id alone.
    Repeated rows are packed each; ids may be null.  An empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    kind = dict(docs.dtypes)[doc_id]
    fields = FIELDS.replace("doc_id long", f"doc_id {kind}") + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        context = TaskContext.get()
        state = {"seq": (context.partitionId() if context else 0) << 40}
        names: list = []
        ids: list[bytes] = []

        def flush() -> pa.RecordBatch:
            # copies of a piece are cut apart only by assign(), so ids are looked up again per piece
            lengths = [len(x) // 4 for x in ids]
            pieces = assign(lengths, capacity)
            cut = [ids[d][4 * s : 4 * (s + n)] for d, s, n, _, _ in pieces]
            cols = [
                pa.array([names[p[0]] for p in pieces], type=schema.field(0).type), [p[1] for p in pieces], [p[2] for p in pieces],
                [zlib.crc32(c) for c in cut], [lengths[p[0]] for p in pieces], [state["seq"] + p[3] for p in pieces], [p[4] for p in pieces],
            ]
            if with_ids:
                cols.append([np.frombuffer(c, "<u4").astype(np.int32).tolist() for c in cut])
            state["seq"] += 1 + max((p[3] for p in pieces), default=-1)
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema
            )

        held = 0
        for batch in batches:
            names_in = batch.column(0).to_pylist()
            for at in range(0, len(names_in), 512):
                texts = [x or "" for x in batch.column(1).slice(at, 512).to_pylist()]
                for name, x in zip(names_in[at : at + 512], enc.ids(texts)):
                    names.append(name)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= window:
                        yield flush()
                        names.clear()
                        ids.clear()
                        held = 0
        if names:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(fields))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, fields)
