"""Packing against its contract: every id in exactly one piece, sequences gapless and full."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from scriptorium.llm import packing
from scriptorium.llm.queries import tokenizer_path

TEXTS = [
    (1, "Plain words, it's <|endoftext|> here.\nand\tmore  spaces"), (2, None), (3, ""), (4, "ÉTÉ große Straße İstanbul ΣΑΣ 東京 éa  b\x1fc\x85d"),
    (5, "long word list " * 4000), (5, "long word list " * 4000), (None, "no id"), (6, "x" * 30000),
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_words_give_the_ids_of_the_text(tokenizer):
    texts = [t or "" for _, t in TEXTS]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.encoder(tokenizer_path()).ids(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_that_differ_in_marks_alone_are_encoded_once(tokenizer, monkeypatch):
    held = packing.Encoder(tokenizer_path())
    seen, part = [], held.part
    monkeypatch.setattr(held, "part", lambda run: seen.append(run) or part(run))
    texts = ["Élevé élevé, élevé.... élevé!? elevé_ straße straße, ÿ À.", "élevé, x<|endoftext|> l'eau ª µ. a<b ...", "elevé! ÿ!?"]
    got = [np.frombuffer(x, "<u4").tolist() for x in held.ids(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert held.plain and len(seen) == len(set(seen)) and {"élevé", "elevé", "straße"} <= set(seen)


def test_pack_keeps_every_id_and_fills_sequences(spark, tokenizer):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in TEXTS], "doc_id long, text string, sequence_id string")
    rows = packing.pack(docs.repartition(2), tokenizer_path(), window=20_000, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d in {d for d, _ in TEXTS}:
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for e, t in TEXTS if e == d]
        assert sum(r.length for r in by_doc[d]) == sum(map(len, want))
        if len(want) == 1:
            pieces = sorted(by_doc[d], key=lambda r: r.start)
            assert sum((r.ids for r in pieces), []) == want[0]
            assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces][:-1]]).tolist()
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces][:-1]]).tolist()
        total = sum(r.length for r in pieces)
        assert total <= 4096 and total & (total - 1) == 0


def test_costs_are_balanced_and_empty_tables_give_nothing(spark):
    lengths = np.random.default_rng(1).integers(1, 3000, 400).tolist()
    cost = defaultdict(float)
    size = defaultdict(int)
    for _, _, n, k, _ in packing.assign(lengths):
        cost[k] += n + packing.QUADRATIC * n * n
        size[k] += n
    full = [c for k, c in cost.items() if size[k] == 4096]
    assert max(full) < 1.35 * min(full)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_parts_kept_are_bounded_and_used_ones_stay(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "PARTS_KEPT", 400)
    enc = packing.Encoder(tokenizer_path())
    letters = "abcdefghij"
    words = [a + b + c for a in letters for b in letters for c in letters]
    want = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    done, single = [], enc.part
    monkeypatch.setattr(enc, "part", lambda run: done.append(run) or single(run))
    for i in range(0, 1000, 50):
        assert enc.ids(["again!"] + words[i : i + 50])[1:] == want[i : i + 50]
        enc.known, enc.older = {"": b""}, {}
        assert len(enc.parts) + len(enc.older_parts) <= 400 + 110
    assert done.count("again") == 1
