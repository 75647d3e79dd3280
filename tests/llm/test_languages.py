"""Language identification: phrases against plain search in the sample, and held-out accuracy of the query."""

import re
import zlib

import numpy as np
import pytest

from scriptorium.llm import languages
from scriptorium.llm.queries import QUERIES

from conftest import SF_DIR


def normal(text):
    return re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode())


def plain(text, sample, block):
    body, n = normal(text), 0
    for at in range(0, len(body), block):
        part, i = body[at : at + block], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in sample:
                k += 1
            i += k if part[i : i + 1] in sample else 1
            n += 1
    return n


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_phrases_against_plain_search(block):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcé ,.\nZ日"), int(n))) for n in rng.integers(0, 300, 60)] + ["", "a", "...", "abab" * 400]
    sample = {"x": normal(" ".join(texts[:9])), "y": normal("abc abc cab bca é, bb"), "z": b"q"}
    of = languages.classes(sample)
    tables = [languages.automaton(of[np.frombuffer(s, np.uint8)], int(of.max()) + 1) for s in sample.values()]
    low, ends = languages.normal(*flat([t.lower() for t in texts]))
    assert [low[a:b].tobytes() for a, b in zip(ends, ends[1:])] == [normal(t).lstrip(b" ") for t in texts]
    got = languages.phrases(low, ends, of, tables, block)
    assert got.tolist() == [[plain(t.lower().lstrip(" ,.\n"), s, block) for s in sample.values()] for t in texts]


def test_rows_of_all_kinds(spark):
    english, german = "the quick brown fox and the lazy dog ", "der schnelle braune fuchs und der faule hund "
    rows = [(1, english * 3, "en"), (2, german * 3, "de"), (2, german * 3, "de"), (3, english, None), (4, None, "en"), (5, "", "en"), (6, "12 34 ?!", "de"), (7, "x" * 300_000, None), (None, german, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as lang_pred")
    sample = languages.samples(docs)
    assert sorted(sample) == ["de", "en"] and sample["de"].count(b"fuchs") == 3
    got = [(r.doc_id, r.lang_pred, r.score) for r in languages.identify(docs, sample).collect()]
    assert [g[:2] for g in got] == [(1, "en"), (2, "de"), (2, "de"), (3, "en"), (4, "und"), (5, "und"), (6, "und"), (7, got[7][1]), (None, "de")]
    assert all(0 <= s <= 1 for _, _, s in got) and [g[2] for g in got[4:7]] == [0, 0, 0]
    assert {r.lang_pred for r in languages.identify(docs, {}).collect()} == {"und"}
    assert languages.identify(docs.limit(0), sample).collect() == [] and languages.samples(docs.limit(0)) == {}


def test_sample_is_bounded_and_holds_each_text_once(spark):
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 'copied text', concat('text number ', id, repeat(' more', 200))) as text", "'a' as lang")
    sample = languages.samples(docs, rows=20, excerpt=50)["a"]
    assert len(sample) <= 20 * 51 and sample.count(b"copied") <= 1


def test_held_out_accuracy_of_the_query(spark):
    held = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = QUERIES["op11_language_id"](spark, SF_DIR).collect()
    assert len(got) == len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == held[r.doc_id] for r in tested) >= 0.95 * len(tested)
