"""The Jaccard join at widths and thresholds other than the query's, and the pipeline's near-duplicate stage, against every pair."""

import re

import numpy as np
import pytest
from test_jaccard import planted

import corpus_pipeline
from scriptorium.llm import jaccard

SF = "/root/testdata/sf0.001"


def plain_components(rows, width, percent):
    """Components from every pair of sets, with shingles of ``width`` words."""
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    least, changed = {d: d for d in sets}, True
    linked = [(d, e) for d in sets for e in sets if d < e and sets[d] and 100 * (b := len(sets[d] & sets[e])) >= percent * (len(sets[d]) + len(sets[e]) - b)]
    while changed:
        changed = False
        for d, e in linked:
            m = min(least[d], least[e])
            changed |= (least[d], least[e]) != (m, m)
            least[d] = least[e] = m
    return sorted((d, len(sets[d]), least[d]) for d in sets)


@pytest.mark.parametrize("width, percent", [(5, 80), (2, 60)])
def test_other_widths_and_thresholds_against_brute_force(spark, width, percent):
    rows = [r for r in planted(families=9)[:-2] if r[0] is not None] + [(90, "one two three four"), (91, "ONE two three  four"), (92, "one two three five")]
    got = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shingle=width, percent=percent)
    want = plain_components(rows, width, percent)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len(rows) - 9


def test_near_sets_share_a_key_at_other_thresholds():
    rng = np.random.default_rng(12)
    for percent in (50, 80):
        for n in [1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 20, 40, 90, 400] * 15:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = len(a) * (100 - percent) // 100
            b = np.delete(a, rng.choice(len(a), drop, replace=False))
            if rng.random() < 0.5:
                b = np.union1d(a, rng.integers(0, 1 << 63, len(a) * (100 - percent) // percent).astype(np.uint64))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                k, which = jaccard.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(k[which == 0]) & set(k[which == 1])


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    words = [f"w{i}" for i in range(100)]
    edited = [*words[:30], "other", *words[31:70], "another", *words[71:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, "on its own")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3]


def test_stage_against_every_pair(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    groups = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted(groups)
