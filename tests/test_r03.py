"""Cases of the third round's findings."""

import hashlib
import math
import random
import re
import sys
import time
import unicodedata

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import cleaning, vectors
from scriptorium.operators import bibliography, chunking, search, training
from scriptorium.plans import catalogue


@pytest.fixture
def folder(tmp_path, spark):
    """A directory of tables made from rows of ``documents``."""

    def write(texts, parts=1, first=0):
        rows = [(first + i, x, "en", "src0", len(x or "")) for i, x in enumerate(texts)]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
        spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def same_as_sql(spark, at, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, at)
    want = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(columns).collect()) == rows
    return len(rows)


TEXTS = ["one line.\nanother line of words", "one line.\nanother line of words", "a third text", None, ""]


@pytest.mark.parametrize("name", ["stream_index", "stream_embed_once"])
def test_streams_read_tables_in_parts(spark, folder, name):
    assert same_as_sql(spark, folder(TEXTS, parts=3), name) > 1


def test_years_beyond_the_present(spark, folder):
    """Documents 1029 and 1032 carry 2029 and 2032 in their DOIs."""
    assert same_as_sql(spark, folder([f"text {i}" for i in range(10)], first=1025), "bibliography_year_doi") == 10


STRAY = ["at a a a In that", "at " + "a " * 13 + "All", "b a A a\nA B c In", "a b C", "x A B Cd", "é a In a.a In", "(a a A b)"]


def test_rows_of_stray_letters(spark, folder):
    assert same_as_sql(spark, folder(STRAY), "text_clean") == len(STRAY)
    text = spark.createDataFrame([("at " + "a " * 13 + "All",)], "t string").select(cleaning.drop_stray_letters(F.col("t")))
    assert text.first()[0] == "at " + "a " * 5 + "All"


ODD = ["", None, "One one_1 TWO", "été ÉTÉ Straße ǅ ²½ Ⅷ x́y", "日本 語 ٣ a​b", "...", " \n\t", "ΣΑΣ İx \U00010400 \U0001f600"]


def test_embedding_in_batches(spark):
    rows = spark.createDataFrame([(x,) for x in ODD], "t string")
    both = rows.select(vectors.bag_of_words(F.col("t")).alias("a"), vectors.bag_of_words_batches(F.col("t")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    assert both[1].a is None and sum(both[2].a) == 3


def test_embedding_of_any_bytes():
    """Tokens of all lengths around one block of the digest, characters of one to four bytes, slices and nulls."""
    draw = random.Random(7)
    ranges = ((32, 127), (0x80, 0x800), (0x800, 0xD800), (0xE000, 0x110000), (32, 33))
    texts = ["".join(chr(draw.randrange(*draw.choice(ranges))) for _ in range(draw.randrange(60))) for _ in range(300)]
    texts += [None, "", *("é" * n + " " + "x" * n for n in range(25, 70))]
    for first, n in ((0, len(texts)), (290, 30), (300, 2), (5, 0)):
        got = vectors._count_tokens(pa.array(texts).slice(first, n)).to_pylist()
        for text, counts in zip(texts[first : first + n], got, strict=True):
            want = [0] * vectors.DIMENSIONS
            for token in re.findall(r"\w+", text or ""):
                want[hashlib.md5(token.encode()).digest()[0] % vectors.DIMENSIONS] += 1
            assert counts == (None if text is None else want)


def test_likeness_of_neighbours_in_batches(spark):
    """Texts of an array and the next one, with arrays of none and one, by batches as by expression."""
    rows = spark.createDataFrame([([],), (["A b"],), (["a b", "B é", "", "é b b"],), (None,), (["x y", "y"],)], "s array<string>")
    both = rows.select(
        vectors.bag_of_words_neighbours(F.col("s")).alias("a"), chunking._cosines(F.transform("s", vectors.bag_of_words)).alias("b"),
    ).collect()
    assert [r.a for r in both] == [r.b for r in both] and both[2].a[1:] == [0.0, 0.0]


def test_first_bytes_of_digests():
    words = [b"x" * n for n in range(130)] + [b"", "日本".encode()]
    got = vectors.first_digest_bytes(np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)]))
    assert got.tolist() == [hashlib.md5(w).digest()[0] for w in words]


def test_word_characters_are_letters_and_numbers():
    for c in map(chr, range(sys.maxunicode + 1)):
        assert bool(re.match(r"\w", c)) == (c == "_" or unicodedata.category(c)[0] in "LN")


def test_equal_rows_and_zero_queries(spark):
    """Many copies of a row: hits are those of the least ids, also for queries that are at similarity 0 to all."""
    corpus = spark.range(3000).select(
        F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"),
        F.when(F.col("id") % 3 > 0, F.array(*map(F.lit, (1, 2, 0)))).otherwise(F.array(F.lit(1), F.lit(0), (F.col("id") % 7).cast("int"))).alias("vec"),
    ).repartition(7)
    asked = spark.createDataFrame([(1, [1, 2, 0]), (2, [0, 0, 0]), (3, [0, 0, 5]), (4, None), (5, [])], "q int, vec array<int>")
    found = {}
    for r in search.nearest(asked, corpus, 4, ["q"], "id").orderBy("rank").collect():
        found.setdefault(r.q, []).append((r.id, r.similarity))
    rows = {r.id: r.vec for r in corpus.collect()}

    def best(v):
        def sim(w):
            scale = math.sqrt(sum(x * x for x in v) * sum(x * x for x in w))
            return round(sum(x * y for x, y in zip(v, w)) / scale, 6) if scale else 0.0
        return sorted(((i, sim(w)) for i, w in rows.items()), key=lambda p: (-p[1], p[0]))[:4]

    assert found == {1: best([1, 2, 0]), 2: best([0, 0, 0]), 3: best([0, 0, 5])}


@pytest.mark.parametrize("asked,rows", [(1, 1), (3, 515), (7, 1029), (512, 1024)])
def test_pairs_at_or_above_a_bound(asked, rows):
    rng = np.random.default_rng(rows)
    q, v = (rng.integers(-2, 3, (n, 4)).astype(np.float32) for n in (asked, rows))
    least = rng.integers(-4, 20, asked).astype(np.float32)
    for a, b in zip(search.near_pairs(q, v, least), np.nonzero(q @ v.T >= least[:, None]), strict=True):
        assert a.tolist() == b.tolist()


def test_equal_vectors_are_compared_once():
    v, spans, ids = search.distinct_rows(np.array([[1.0, 2], [0, 1], [1, 2], [1, 2]]), np.array(list("dcba"), dtype=object), 2)
    assert sorted((v[i].tolist(), ids[spans[i] : spans[i + 1]].tolist()) for i in range(len(v))) == [([0.0, 1.0], ["c"]), ([1.0, 2.0], ["a", "b"])]


PUBLISHED = ["Physics & Optics Journal", "a. The  New Journal of Things Journal, x", " Journal", "x Journal", "1 Journal of", "no", "A B\nJournal; C Journal"]


def test_journal_names_from_the_starts_of_runs(spark):
    """The same names as a search from every letter; a page of one long run takes time in proportion."""
    old, new = r"(?iu)([A-Za-z\s&]+\s+Journal)", "(?iu)" + bibliography.JOURNAL_PATTERNS[3]
    rows = spark.createDataFrame([(x,) for x in PUBLISHED], "t string")
    both = rows.select(F.regexp_extract("t", old, 1).alias("a"), F.regexp_extract("t", new, 1).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]
    start = time.monotonic()
    assert spark.range(1).select(F.regexp_extract(F.repeat(F.lit("word "), 40_000), new, 1).alias("x")).first().x == ""
    assert time.monotonic() - start < 20


def test_long_runs_of_names(spark):
    """A run of many words after 'by' is taken without a call per word."""
    pattern = F.lit("(?iu)" + bibliography.AUTHOR_PATTERNS[0])
    text = F.concat(F.lit("by"), F.repeat(F.lit(" word"), 40_000), F.lit(". by Ann Lee, x"))
    found = spark.range(1).select(F.regexp_extract_all(text, pattern, F.lit(1)).alias("x")).first().x
    assert [len(x) for x in found] == [40_000 * 5 - 1, 7]


def test_citations_of_a_segment_are_found_once(spark):
    """Every use of the citations, their mean and their type repeated the patterns and the comparison of vectors."""
    from scriptorium.operators import citations

    rows = spark.createDataFrame(
        [("1", "Segundo src1, that is. Plain words follow here", [("a", "src1", 1, "plain words follow here", 0.5)]), ("2", "", [])],
        "response_id string, answer string, sources array<struct<source_id:string,name:string,page:int,content:string,score:double>>",
    )
    found = citations.track(rows, 0.6, embedder=vectors.bag_of_words_batches)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == len(citations.EXPLICIT_PATTERNS)
    assert [(r.segment_no, r.citation_type, r.confidence) for r in found.orderBy("segment_no").collect()] == [
        (0, "direct", 0.95), (1, "paraphrase", 1.0)]


def test_whole_numbers_are_compared_by_three(monkeypatch):
    r = np.random.default_rng(11)
    v = np.unique(r.poisson(r.gamma(1.0, 0.7, (1300, 1)), (1300, 64)).astype(float), axis=0)
    v = np.concatenate([v[r.permutation(len(v))], np.eye(64)[:3] * 400, np.full((1, 64), 9.0)])
    q = np.concatenate([r.poisson(0.5, (150, 64)).astype(float), np.zeros((1, 64)), np.full((1, 64), 30.0), v[:5]])
    looked = []

    def counted(q, packed, *args, plain=search.near_counts):
        looked.append(3 * len(packed))
        return plain(q, packed, *args)

    monkeypatch.setattr(search, "ROWS_AT_ONCE", 32)
    monkeypatch.setattr(search, "near_counts", counted)
    search.best_rows(q, search.Corpus(v), 3, None, 6)
    assert not looked  # few queries aren't worth the packing
    monkeypatch.setattr(search, "PACK_AFTER", 0)
    scale = np.sqrt((q * q).sum(axis=1)[:, None] * (v * v).sum(axis=1))
    sims = np.floor(np.divide(q @ v.T, scale, out=np.zeros(scale.shape), where=scale > 0) * 1e6 + 0.5) / 1e6
    for k, floor in ((3, None), (10, 0.4), (1, 0.0)):
        want = [(i, int(j), sims[i, j]) for i in range(len(q)) for j in np.lexsort((np.arange(len(v)), -sims[i]))[:k] if floor is None or sims[i, j] >= floor]
        for some in (q, q[:150]):
            got = search.best_rows(some, search.Corpus(v), k, floor, 6)
            assert list(zip(*(x.tolist() for x in got))) == [w for w in want if w[0] < len(some)]
    assert sum(looked) > 3 * len(v) * 0.8  # only the long query and rows need one product each
    seen = len(looked)
    search.best_rows(q - 0.5, search.Corpus(v), 3, None, 6)
    search.best_rows(q, search.Corpus(v - 0.5), 3, None, 6)
    assert len(looked) == seen


def test_examples_compute_a_chunks_values_once(spark):
    plan = catalogue.QUERIES["training_dataset"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the density of a page
    assert plan.index("AS instruction") < plan.index("Generate") < plan.index("concat(Contexto") and plan.index("round(") > plan.index("Generate")
    texts = ["A - That, (that) thing -- ", "that", "\tÉté: that's it — that_x  !! that", "", "no term", "x that ... -"]
    terms = ("that", "thing", "x")

    def phrases(text):
        said, found = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w], []
        for term in terms:
            for i, w in enumerate(said):
                if term in w and term in text.lower():
                    low = max(i, 1) - 1
                    p = re.sub(r"[^\w\s]", "", " ".join(said[low : low + (3 if i == 0 else 4)])).strip(" ")
                    if len(p.split(" ")) >= 2 and p not in found:
                        found.append(p)
        return found

    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = rows.select("i", training.concepts(F.col("text"), terms).alias("c"), training.extractive_answer(
        F.lit("THAT"), F.split("text", "[.!?]+")).alias("a")).orderBy("i").collect()
    assert [r.c for r in got] == [phrases(x) for x in texts]
    assert [r.a for r in got][4:] == ["no term", "x that"]
