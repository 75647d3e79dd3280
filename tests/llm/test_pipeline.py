"""The pipeline's stages, each judged on its own input, and the whole against its stages."""

import duckdb
import pytest
from test_near_duplicates import plain_components

import corpus_pipeline
from scriptorium.llm import oracles
from scriptorium.llm.common import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF))
        out[name] = (docs, result)
        docs = result
    return out


def table_of(name, df):
    con = duckdb.connect()
    con.register(name, df.toArrow())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    return con


def test_order_and_columns(steps):
    assert list(steps) == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for docs, result in list(steps.values())[:-1]:
        assert result.columns == ["doc_id", "text", "lang", "source", "n_chars"] == docs.columns


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    docs, kept = steps["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in kept.collect()}
    clean = [d for d, t in labels.items() if not t]
    assert sum(d in left for d in clean) >= 0.97 * len(clean)
    assert kept.exceptAll(docs).count() == 0


def test_line_dedup_against_sql(steps):
    docs, kept = steps["line_dedup"]
    con = table_of("documents", docs)
    want = con.execute(f"WITH {oracles.lines()} SELECT doc_id, kept, lang, source, length(kept) FROM kept_lines").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in kept.collect())


def test_one_document_of_each_group_stays(steps):
    docs, kept = steps["near_duplicates"]
    groups = {c for _, _, c in plain_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups)
    assert kept.exceptAll(docs).count() == 0


def test_contaminated_documents_go(steps):
    docs, kept = steps["decontamination"]
    con = table_of("documents", docs)
    want = con.execute(f"WITH {oracles.decontamination()} SELECT doc_id FROM judged WHERE NOT contaminated").fetchall()
    assert sorted(d for d, in want) == sorted(r.doc_id for r in kept.collect())


def test_packing_takes_all_documents(steps):
    docs, pieces = steps["packing"]
    rows = pieces.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        assert r.length > 0
    assert all(total[r.doc_id] == r.doc_tokens for r in rows)


def test_run_gives_what_the_stages_give(spark, steps):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct()
    want = steps["packing"][1].select("doc_id", "doc_tokens").distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and set(key) <= set(steps["packing"][1].columns)
