"""Decontamination and line dedup on small planted tables, edge cases included."""

import re
from collections import defaultdict

from pyspark.sql import Row

from scriptorium.llm import decontamination, lines

ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar"
DOCS = [
    (1, f"Before. {ITEM.upper()}! after", "a"), (2, "nothing of the kind here", "b"), (3, None, "c"), (4, "", "d"),
    (5, "word " * 3000 + ITEM, "e"), (1, f"Before. {ITEM.upper()}! after", "a"), (None, f"{ITEM} {ITEM}", "f"),
    (6, "say tiny thing now", "g"), (7, ITEM.replace("hotel", "motel"), "h"), (8, "Été ÉTÉ", "i"),
]
ITEMS = [("x", ITEM), ("y", "tiny thing"), ("z", None), (None, ITEM), ("w", "..."), ("x2", ITEM), ("é", "été ÉtÉ"), ("é2", "Été ÉTÉ")]


def brute(text, items, size=13):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    w, hit, found = split(text), set(), set()
    for name, t in items:
        i = split(t)
        for s in range(max(1, len(i) - size + 1)) if i and name is not None else ():
            g = i[s : s + size]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(name)
    return len(w), len(hit), sorted(found), 0 < len(hit) and 20 * len(hit) >= len(w)


def test_contamination_against_brute_force(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, key string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = sorted(map(repr, ((r.row.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.contamination(docs, items).collect())))
    assert got == sorted(repr((d, *brute(t, ITEMS))) for d, t, _ in DOCS)
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in decontamination.contamination(docs, items.limit(0)).collect()} == {0}
    assert decontamination.clean_documents(docs, items).columns == docs.columns


def test_shuffled_windows_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, key string")
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    want = sorted(map(str, decontamination.contamination(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, decontamination.contamination(docs, items).collect())) == want


def test_spans_are_removed(spark):
    docs = spark.createDataFrame([(1, f"Keep this; {ITEM}, and that."), (2, None)], "doc_id long, text string")
    out = decontamination.without_spans(docs, spark.createDataFrame(ITEMS[:1], "item_id string, text string")).collect()
    assert sorted(map(tuple, out)) == [(1, "Keep this; and that."), (2, None)]


def test_lines_against_brute_force(spark):
    rows = [Row(doc_id=i, text=f"own {i}\n  shared\nspread {i % 7}\n\nshared", source=f"s{i % 13}", h="x") for i in range(60)]
    rows += [Row(doc_id=100, text=None, source="s1", h="x"), Row(doc_id=101, text="", source=None, h="x"), Row(doc_id=102, text="shared\n one site ", source=None, h="x")]
    rows += [rows[0], Row(doc_id=None, text="shared", source="s3", h="x")]
    sites = defaultdict(set)
    for r in rows:
        for x in (r.text or "").split("\n"):
            if r.source and x.strip():
                sites[x.strip()].add(r.source)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, h string").repartition(3)
    for limit in (2, 9, 10, 13, 14):
        bad = {x for x, s in sites.items() if len(s) >= limit}
        want = [(r.doc_id, None if r.text is None else "\n".join(x for x in r.text.split("\n") if x.strip() not in bad)) for r in rows]
        got = [(r.row.doc_id, r.kept) for r in lines.without_boilerplate(docs, min_sites=limit).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert lines.clean_documents(docs).columns == docs.columns
    assert lines.clean_documents(docs.limit(0)).count() == 0
