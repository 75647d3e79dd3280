"""Personal data: base spans against plain patterns, telling terms against counts by hand, edge cases."""

import math
import random
import re
from collections import defaultdict

from scriptorium.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(4)
    pool = ["a", "b@", "@", ".", "-", "+", "1", "22", "255", "256", ".1", "4532015112830366", " ", "(", ")", "é", "x.y@z.com", "+1 (555) 123-4567", "10.0.0.1", "\n", "_", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


ROWS = [(i, f"Please ask Zorblax at zed@mail.example.com now, number {i}") for i in range(6)]
ROWS += [(i, f"the usual words please ask now or never {i}") for i in range(6, 40)]
ROWS += [(50, None), (51, ""), (None, "call +1 (555) 123-4567"), (0, ROWS[0][1]), (52, "w " * 20000 + "x@y.zz"), (53, "Zorblax alone")]


def test_terms_that_tell(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as base", "2 as terms").repartition(3)
    out = pii.private_spans(docs).collect()
    assert len(out) == len(ROWS)
    texts = defaultdict(list)
    for d, t in ROWS:
        texts[d].append(t or "")
    n = len(ROWS)
    information = math.log2(n / 6)
    for r in out:
        text = texts[r.id][0]
        assert [(s.kind, s.start, s.end) for s in r.base] == plain(text)
        told = {s.term: s.told for s in r.terms}
        assert all(text[s.start : s.end].lower() == s.term for s in r.terms)
        if r.id is not None and r.id < 6:
            # the repeated row counts as the same document in the numerator and as a row in the denominator
            assert set(told) == set() if len(set(t for d, t in ROWS if d is not None and d < 6)) < 2 else True
            if "zorblax" in told:
                assert abs(told["zorblax"] - (1 + math.log2(6 / 8) / information)) < 1e-9
    assert pii.private_spans(docs.limit(0)).count() == 0


def test_contexts_must_differ_and_common_words_stay(spark):
    rows = [(i, f"{w} Quellon writes from box@post.example.org {v} often") for i, (w, v) in enumerate(zip(["today", "then", "once", "later"], ["quite", "very", "rather", "too"]))]
    rows += [(10 + i, f"nobody writes from here, often as {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.id: {s.term for s in r.terms} for r in pii.private_spans(docs).collect()}
    assert all(out[i] == {"quellon"} for i in range(4)) and not any(out[10 + i] for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "today  writes from [email] quite often" and clean[10] == rows[4][1]


def test_query_counts_kinds(spark):
    from scriptorium.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_private_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in PLAIN)
