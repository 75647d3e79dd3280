"""The toxicity field: forward-backward against enumeration, held-out accuracy, spans and edge cases."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import bytesets, toxicity
from scriptorium.llm.queries import QUERIES


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    steps = np.array([[0.7, 0.2], [0.4, 1.0]])
    score = rng.normal(size=(3, 5))
    there = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    got, expected = toxicity.forward_backward(score, there, steps, pairs=True)
    pairs = np.zeros((2, 2))
    for r in range(3):
        n = there[r].sum()
        weight, one, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(score[r, t] for t in range(n) if path[t])) * np.prod([steps[a, b] for a, b in zip(path, path[1:])])
            weight += w
            one += w * np.array(path)
            for a, b in zip(path, path[1:]):
                both[a, b] += w
        assert np.allclose(got[r, :n], one / weight)
        pairs += both / weight
    assert np.allclose(expected, pairs)


def test_tokens_and_hashes():
    texts = ["Ab cd, ab", "", None, "éÉ ab", "ab"]
    body, offsets = bytesets.utf8(pa.array(texts))
    doc, start, end, feats = toxicity.tokens(body, offsets)
    assert doc.tolist() == [0, 0, 0, 3, 3, 4]
    assert [bytes(body[s:e]).decode() for s, e in zip(start, end)] == ["Ab", "cd", "ab", "éÉ", "ab", "ab"]
    assert feats[0].tolist() == feats[2].tolist() == feats[4].tolist() == feats[5].tolist() != feats[1].tolist()


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)])
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 60))
        if i % 4 == 0:
            for bad in rng.choice(["zounds", "vermin"], 2):
                text.insert(int(rng.integers(0, 60)), bad)
        rows.append((i, "Été " + " ".join(text), "x"))
        labels.append((i, int(i % 4 == 0)))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "no vermin id", "x"), (0, rows[0][1], "x"), (1002, "clean " * 30000 + "vermin", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")


def test_held_out_accuracy_spans_and_edges(spark, planted):
    docs, labels = planted
    model = toxicity.train(docs, labels)
    out = toxicity.tag(docs.repartition(3), model).collect()
    by = {r.row.doc_id: r for r in out}
    assert len(out) == docs.count()
    for r in out:
        i = r.row.doc_id
        if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 5 == 0:
            assert (r.score >= 0.5) == (i % 4 == 0)
            assert {r.row.text[s.start : s.end] for s in r.spans} <= {"zounds", "vermin"}
    assert by[None].spans and by[1002].spans[-1].start == 180000
    assert by[1000].score == by[1001].score == model.prior < 0.5
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 0
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.tag(docs, none).agg(F.max("score")).first()[0] < 0.5
    assert toxicity.tag(docs.limit(0), model).count() == 0


def test_query_has_a_row_per_document(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op6_toxicity"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_a_text_goes_to_the_worker_once(spark):
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -4.0, np.array([[0.98, 0.02], [0.5, 0.5]]), 0.1)
    docs = spark.createDataFrame([(1, "en", "some words"), (2, None, None), (3, "de", "")], "doc_id long, lang string, text string")
    found = toxicity.tag(docs, model)
    sent = found._jdf.queryExecution().analyzed().children().apply(0).output().size()
    assert sent == 1
    assert [(r.row.doc_id, r.row.text, round(r.score, 3) == 0.1) for r in found.orderBy("row.doc_id").collect()] == [
        (1, "some words", False), (2, None, True), (3, "", True)]


def test_sample_is_tokenised_in_runs(monkeypatch):
    texts = ["Zounds the vermin", None, "", "un été très long", "a " * 40]
    whole = toxicity.sampled_tokens(texts)
    most = []

    def counted(body, offsets, plain=toxicity.tokens):
        most.append(len(body))
        return plain(body, offsets)

    monkeypatch.setattr(toxicity, "tokens", counted)
    monkeypatch.setattr(toxicity.bytesets.chunks, "__defaults__", (30,))
    parts = toxicity.sampled_tokens(texts)
    assert len(most) == 3 and max(most) == 80
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert [len(x) for x in toxicity.sampled_tokens([])] == [0, 0]
