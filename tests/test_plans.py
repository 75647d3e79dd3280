"""Shapes of physical plans."""

import contextlib
import io

from conftest import SF_DIR

from scriptorium.plans import tables as t
from scriptorium.plans.catalogue import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_top_k_is_cut_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from scriptorium.scale import top_rows

    text = plan(top_rows(t.chunks(spark, SF_DIR), ["source"], [F.col("chunk_id")], 3))
    assert text.index("WindowGroupLimit") < text.index("Exchange") or text.count("WindowGroupLimit") >= 2


def test_text_operators_stay_in_the_jvm_without_shuffle(spark):
    for name in (
        "text_clean", "label_priority_section", "document_sections", "sentences_guarded", "chunk_paragraphs", "chunk_recursive",
        "chunk_keywords", "training_instructions", "acronym_detection",
    ):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "Python" not in text and "Pandas" not in text, name
        # The only exchange deals a single small input file out to the cores.
        assert "hashpartitioning" not in text and "SinglePartition" not in text, name


def test_no_cross_join_anywhere(spark):
    for name, build in QUERIES.items():
        if name.startswith("stream_"):
            continue
        text = plan(build(spark, SF_DIR))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["file_size_inventory"](spark, SF_DIR))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text
    assert "LessThanOrEqual(n_chars,5000" in text
