"""The Jaccard join against brute force, its candidate keys, its tree, and components."""

import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from scriptorium.llm import bytesets, graphs, jaccard


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted(((d, s) for d, s in sets if d is not None and s), key=lambda x: len(x[1]))
    for i, (d, s) in enumerate(by_size):
        for e, t in by_size[i + 1 :]:
            if len(t) * 90 > len(s) * 100:
                break
            both = len(s & t)
            if 100 * both >= 90 * (len(s) + len(t) - both) and find(d) != find(e):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return sorted((repr(d), len(s), None if d is None else find(d)) for d, s in sets)


def planted(seed=3, families=12):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (6, "two words"), (7, "two  WORDS"), (8, "words two"), (None, "two words"), (9, "a b c"), (10, "a b c "), (11, "É b c")]
    k = 100
    for f in range(families):
        base = list(rng.choice(vocab, int(rng.choice([5, 12, 18, 25, 60, 200, 900, 3000]))))
        for c in range(6):
            text = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                at = int(rng.integers(0, len(text)))
                (text.__setitem__(at, "changed") if rng.random() < 0.6 else text.insert(at, f"new{c}"))
            rows.append((k := k + 1, " ".join(text)))
    return rows + [rows[-1], rows[20]]


@pytest.mark.parametrize("chunk", [16_000_000, 3000])
def test_components_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", chunk)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as a", "2 as cluster").repartition(5)
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect())
    assert got == brute(rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in got if c is not None}
    assert {r.doc_id for r in kept.collect()} - {None} == want


def test_no_rows(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_sets_share_a_key():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.choice([1, 5, 9, 10, 17, 18, 19, 27, 40, 90, 400]))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = a.copy()
        drop = int(rng.integers(0, len(a) // 9 + 1))
        b = np.delete(b, rng.integers(0, len(b), drop)) if rng.random() < 0.5 and drop else np.union1d(b, rng.integers(0, 1 << 63, drop).astype(np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both < 90 * (len(a) + len(b) - both):
            continue
        k, which = jaccard.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(k[which == 0]) & set(k[which == 1])


def test_tree_loses_no_link():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, int(rng.integers(20, 60))).astype(np.uint64)) for _ in range(40)]
    sets += [np.sort(np.delete(s, 0)) for s in sets] + [np.sort(np.delete(s, [1, 2])) for s in sets]
    points, sizes = np.stack([jaccard.vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard.CountTree(points, sizes)
    for q, s in enumerate(sets):
        near = {x for x, t in enumerate(sets) if 100 * (b := len(np.intersect1d(s, t))) >= 90 * (len(s) + len(t) - b)}
        found = set(tree.search(points[q], int(sizes[q])).tolist())
        assert near <= found and len(found) < len(sets)


def test_sets_do_not_cross_texts():
    body, offsets = bytesets.utf8(pa.array(["a b", "c d", None, "A B"]))
    sets, ends = jaccard.shingle_sets(body, offsets)
    assert np.diff(ends).tolist() == [1, 1, 0, 1] and sets[0] == sets[2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (103, 100), (7, 7)] + [(500, k) for k in range(501, 700)]
    got = {r.u: r.v for r in graphs.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 101: 100, 103: 100, **{k: 500 for k in range(501, 700)}}


def test_every_link_between_different_sets(spark):
    rows = [r for r in planted(families=5) if r[0] is not None]
    pairs, classes = jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    rep = {(r.doc_id, r.rep) for r in classes.collect()}
    by_rep = {}
    for d, t in rows:
        s = frozenset(shingles(t))
        if s:
            by_rep[s] = min(d, by_rep.get(s, d))
    assert rep == {(d, by_rep[frozenset(shingles(t))]) for d, t in rows if shingles(t)}
    sets = list(by_rep.items())
    want = {tuple(sorted((d, e))) for i, (s, d) in enumerate(sets) for t, e in sets[i + 1 :] if 100 * (b := len(s & t)) >= 90 * (len(s) + len(t) - b)}
    assert sorted((r.u, r.v) for r in pairs.collect()) == sorted(want) and len(want) > 10


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        jaccard.linked(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_task_functions_need_no_installed_package(tmp_path):
    from pyspark import cloudpickle

    functions = [jaccard.keys, jaccard.shingle_sets, jaccard.found_links, jaccard._survivors(80), jaccard._verify(90, True)]
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(functions))
    code = f"import sys, pickle; pickle.load(open({str(tmp_path / 'f.pkl')!r}, 'rb')); assert 'scriptorium.llm.jaccard' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_fine_bounds_lose_no_link():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 64, int(n), dtype=np.uint64)) for n in (1, 2, 90, 130, 250, 260, 600, 5000)]
    sets += [np.sort(np.delete(s, slice(0, len(s) // 12))) for s in sets]
    bounds = jaccard.FineBounds([jaccard.vector(s, jaccard.fine_groups(len(s))) for s in sets], np.array([len(s) for s in sets]), 90)
    for q, s in enumerate(sets):
        near = {x for x, t in enumerate(sets) if 100 * (b := len(np.intersect1d(s, t))) >= 90 * (len(s) + len(t) - b)}
        found = bounds.near(q, np.arange(len(sets))).tolist()
        assert near <= set(found) and len(found) == len(set(found)) < len(sets)
