"""Substring removal against brute force; suffix arrays and common prefixes against sorting."""

import hashlib

import numpy as np
import pytest

from scriptorium.llm import substrings


def brute(rows):
    least = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, x in raw:
        for i in range(len(x) - 49) if d is not None else ():
            s = x[i : i + 50]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - 49) if d is not None else ():
            if least[x[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for i in range(len(x)) if gone[i] and not (i and gone[i - 1]))
        out.append((repr(d), len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def planted():
    rng = np.random.default_rng(4)
    words = np.array(["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 9)))) for _ in range(300)])
    text = lambda n: " ".join(rng.choice(words, n))
    passages = [text(n)[:m] for n, m in ((40, 50), (40, 51), (60, 90), (80, 200), (40, 49), (300, 900))]
    rows = [(i, text(int(rng.integers(0, 60))) + str(rng.choice(passages)) + text(int(rng.integers(0, 60))) + (str(rng.choice(passages)) if i % 3 else "")) for i in range(80)]
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(300, "a" * 300), (301, "b" + "a" * 120), (302, "ab" * 100), (303, "ab" * 60 + "c")]
    rows += [(304, None), (305, ""), (None, passages[5]), (None, None), (306, "\x00" * 60), (307, "\x00" * 60), (5, passages[3]), (308, text(9000)), (309, text(20))]
    return rows + [(310, rows[-2][1][1000:9000]), rows[3]]


@pytest.mark.parametrize(("run_bytes", "hot"), [(2_000_000, 256), (300, 256), (2_000_000, 3)])
def test_removal_against_brute_force(spark, monkeypatch, run_bytes, hot):
    monkeypatch.setattr(substrings, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as id").repartition(4)
    got = substrings.repeats(docs).collect()
    flat = sorted((repr(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in got)
    assert flat == brute(rows)
    assert substrings.repeats(docs.limit(0)).count() == 0


def test_least_ids_over_several_runs(monkeypatch):
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, int(rng.integers(50, 78))).astype(np.uint8)) for _ in range(30)]
    parts = [parts[int(i)] for i in rng.integers(0, 30, 60)]
    parts += [p[1:] + b"x" for p in parts[:20] if len(p) > 51]
    ids = rng.integers(0, 1000, len(parts))
    body = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    want = {}
    for p, i in zip(parts, ids.tolist()):
        for s in range(len(p) - 49):
            want[p[s : s + 50]] = min(i, want.get(p[s : s + 50], i))
    flat = [want[p[s : s + 50]] for p in parts for s in range(len(p) - 49)]
    for size in (10**9, 900):
        monkeypatch.setattr(substrings, "RUN_BYTES", size)
        assert substrings.least_ids(body, np.cumsum(sizes) - sizes, sizes, ids)[0].tolist() == flat


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(6)
    sizes = np.array([50, 60, 77, 51])
    text = np.zeros(int((sizes + 1).sum()), np.uint16)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    for b, s in zip(begin, sizes):
        text[b : b + s] = rng.integers(1, 3, s)
    text[begin[1] : begin[1] + 50] = text[begin[0] : begin[0] + 50]
    order, rank = substrings.suffix_array(text)
    suffix = [tuple(text[i : i + 50]) + (0,) * max(0, i + 50 - len(text)) for i in range(len(text))]
    assert [suffix[i] for i in order] == sorted(suffix)
    assert (np.diff(rank[order]) >= 0).all()
    prefix = substrings.common_prefixes(text, order, begin, sizes)
    end = np.repeat(begin + sizes, sizes + 1)
    for before, i in zip(order[:-1], order[1:]):
        a, b = text[before : end[before]], text[i : end[i]]
        n = min(len(a), len(b), 50)
        same = np.append(a[:n] != b[:n], True)
        assert prefix[i] == (0 if not text[i] else min(int(same.argmax()), n))
