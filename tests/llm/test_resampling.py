"""Importance resampling against plain Python, its checksums against zlib, and its bracket."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from scriptorium.llm import bytesets, resampling


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    def count(texts):
        out = [0] * 10_000
        for t in texts:
            for g in features(t)[1]:
                out[zlib.crc32(g) % 10_000] += 1
        return out

    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows, may = [], []
    for n, (d, x) in enumerate(docs):
        words, f = features(x)
        weight = sum(gain[zlib.crc32(g) % 10_000] for g in f)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if words >= 20:
                may.append((-score, d, n))
        rows.append([d, len(f), weight, score, None])
    for place, (_, _, n) in enumerate(sorted(may)[: 5 * len(may) // 100], 1):
        rows[n][4] = place
    return rows


def made(n=400, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)] + ["Été", "ÄÖ", "日本語", "x" * 254, "y" * 255, "z" * 300, "A1b2"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 5, 19, 20, 21, 60, 300])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,;\n"), (None, "w1 w2 " * 30), (n + 3, "q" * 5000), (n + 4, "w1-w2\tw3 " * 9000)]
    return docs + docs[:3], [" ".join(rng.choices(vocabulary[:40], k=50)) for _ in range(20)] + [None, ""]


def rows_of(frame):
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in frame.collect()), key=repr)


@pytest.mark.parametrize("accuracy", [10_000, 3])
def test_draw_against_plain_python(spark, monkeypatch, accuracy):
    monkeypatch.setattr(resampling, "WORDS_AT_ONCE", 1000)
    docs, target = made()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as rank").repartition(5)
    bench = spark.createDataFrame([(x,) for x in target], "text string")
    assert rows_of(resampling.resample(frame, bench)) == sorted(brute(docs, target), key=repr)
    scored = spark.createDataFrame([(s, i) for i, s in enumerate([7] * 500 + list(range(500)))], "score long, doc_id long")
    want = sorted(((s, i) for s, i in scored.collect()), key=lambda x: (-x[0], x[1]))
    for k in (1, 493, 1000):
        assert resampling.cutoff(scored, k, accuracy) == want[k - 1]
    assert resampling.cutoff(scored, 0) is None


def test_checksums_of_runs():
    body = np.frombuffer(" ".join(["ab", "c", "d" * 254, "e" * 255, "é", "f" * 999, "g"]).encode(), np.uint8)
    start, end, first = resampling.text_words(body, np.array([0, len(body)]))
    w = [body[a:b].tobytes() for a, b in zip(start, end)]
    got = resampling.run_checksums(body, start, end)
    assert first.tolist() == [0, 7]
    assert [g.tolist() for g in got] == [[zlib.crc32(b" ".join(w[i : i + n])) for i in range(7 - n + 1)] for n in (1, 2, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    assert rows_of(resampling.resample(some, none)) == brute([(1, "a b c " * 10)], [])


def test_drawn_documents(spark):
    docs, target = made()
    docs = [r for r in docs if r[0] is not None][:400]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")
    want = {r[0] for r in brute(docs, target) if r[4]}
    assert sorted(r.doc_id for r in resampling.drawn_documents(frame, bench).collect()) == sorted(want)
