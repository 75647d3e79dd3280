"""Alignment of two tokenizers against whole-text encoding and a plain merge."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scriptorium.llm import alignment
from scriptorium.llm.queries import QUERIES

from conftest import SF_DIR

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def brute(docs):
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    of = alignment.byte_characters()
    found, held = [], collections.Counter()
    for d, text in docs:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            raw = (" " + text).encode()
            bx = [bytes(of[c] for c in t) for t in x.tokens]
            by = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
            if b"".join(bx) == raw == b"".join(by):
                ends_a, ends_b = (np.cumsum([len(t) for t in z]).tolist() for z in (bx, by))
                both, ga, gb = set(ends_a) & set(ends_b), [], []
                i = j = 0
                for e in sorted(both):
                    k, m = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
                    groups.append((x.ids[i:k], y[j:m]))
                    i, j = k, m
        found.append((d, groups))
        held.update({(p, q) for ga, gb in groups for p in ga for q in gb})
    most = collections.defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for d, groups in found:
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        digest = hashlib.sha256(";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups).encode()).hexdigest() if groups else ""
        out.append((d, sum(len(g) for g, _ in groups), sum(len(g) for _, g in groups), len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), digest))
    return sorted(out, key=repr)


def texts():
    rng = np.random.default_rng(2)
    chars = list("abcdeéß \n\t  .,!'s-10日😀 ▁") + [" the", " ing", "<|endoftext|>", "<0x41>", "\x00", "</s>", "́", "﻿", "​", "　", "\r\n"]
    random = ["".join(rng.choice(chars, int(n))) for n in rng.integers(1, 60, 300)]
    own = [None, "", " ", "   ", "\n", " a", "  a  b ", "a▁b", "<unk>", "x" * 3000, "ab " * 5000, "😀" * 40, "don't we'll I'M", "1234567 890"]
    return list(enumerate(own + random)) + [(5, " a"), (None, "no id")]


@pytest.mark.parametrize("small", [True, False])
def test_against_whole_texts(spark, monkeypatch, small):
    if small:  # parts, cache, layout and join beyond their bounds
        for name, value in (("PART", 40), ("CACHE", 50), ("LINKS", 30), ("LARGE", 4), ("BROADCAST_PAIRS", 10), ("PIECE", 3)):
            monkeypatch.setattr(alignment, name, value)
    docs = texts()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as a", "2 as row", "3 as links").repartition(3)
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.alignment(frame, *PATHS).collect()]
    assert sorted(got, key=repr) == brute(docs)
    assert alignment.alignment(frame.limit(0), *PATHS).collect() == []


def test_query_against_whole_texts(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in QUERIES["op12_tokenizer_alignment"](spark, SF_DIR).collect()]
    assert sorted(got, key=repr) == brute(docs)


@pytest.mark.parametrize("piece", [1, 2, 5, 256])
def test_pieces_of_the_merge(piece):
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 700):
        a, b = (np.unique(np.append(rng.integers(1, 3 * n + 1, n), 3 * n + 1)) for _ in range(2))
        of_a, of_b, group = alignment.overlaps(a, b, piece)
        want = [(int(np.searchsorted(a, e)), int(np.searchsorted(b, e)), int(np.sum(np.intersect1d(a, b) < e))) for e in np.union1d(a, b)]
        assert list(zip(of_a.tolist(), of_b.tolist(), group.tolist())) == want
