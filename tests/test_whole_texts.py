"""Defaults lose nothing: long sentences, long metadata, long contents, all synonyms, patterns without conditions."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.operators import chunking, citations, expansion, feedback, fusion, oplog, rerank
from scriptorium.sources import index


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_every_character_of_a_long_sentence_is_in_a_chunk(spark):
    text = "Short one. " + "".join(chr(97 + i % 26) for i in range(3000)) + ". Last one."
    chunks = one(spark, chunking.pack_sentences(F.lit(text), 1024, 0))[0]
    plain = text.replace(" ", "").replace(".", "")  # stops end sentences and belong to none
    assert "".join(chunks).replace(" ", "").replace(".", "") == plain
    assert all(len(c) <= 1024 for c in chunks)
    cut = one(spark, chunking.pack_sentences(F.lit(text), 1024, 0, keep_all=False))[0]
    assert sum(map(len, cut)) < 1100


def test_pieces(spark):
    for n in (0, 1, 9, 10, 11, 20, 25):
        got = one(spark, chunking.pieces_of(F.lit("x" * n), 10))[0]
        assert "".join(got) == "x" * n and len(got) == max(1, -(-n // 10))


def test_metadata_whole_or_cut(spark):
    df = spark.createDataFrame([Row(a=1, b=["word"] * 60)])
    assert index.flat_metadata(df).first().b_str.endswith('"]') and len(index.flat_metadata(df, 100).first().b_str) == 100


def test_scorer_reads_the_end_of_a_long_content(spark):
    hits = spark.createDataFrame([(1, 1, "needle", "hay " * 400 + "needle", 0.5), (1, 2, "needle", "hay", 0.5)], "q int, rank int, query_text string, content string, similarity double")
    whole = {r["rank"]: r.pair_score for r in rerank.rerank(hits, ["q"]).collect()}
    short = {r["rank"]: r.pair_score for r in rerank.rerank(hits, ["q"], content_length=512).collect()}
    assert whole[1] > whole[2] and short[1] == short[2]


def test_identity_and_error_keys_use_all_of_a_text(spark):
    a, b = (F.lit("same " * 40 + x) for x in "ab")
    row = one(spark, *[fusion.fusion_key(c, F.lit("s"), F.lit(1), p) for p in (None, 100) for c in (a, b)])
    assert row[0] != row[1] and row[2] == row[3]
    errors = spark.createDataFrame([("E", "m" * 150 + x) for x in "ab"], "error_type string, message string")
    assert oplog.error_totals(errors).first().unique_errors == 2 and oplog.error_totals(errors, 100).first().unique_errors == 1


def test_source_text_is_whole(spark):
    kind = "array<struct<source_id:string,name:string,page:int,content:string,score:double>>"
    df = spark.createDataFrame([([("s", "n", 1, "c" * 500, 1.0)],)], f"s {kind}")
    assert len(df.select(citations.prepare_sources(F.col("s"))[0]["excerpt"]).first()[0]) == 500
    assert len(df.select(citations.prepare_sources(F.col("s"), 200)[0]["excerpt"]).first()[0]) == 203


def test_all_synonyms_of_a_term(spark):
    queries = spark.createDataFrame([(1, "malha")], "query_id int, text string")
    got = {r.query_text for r in expansion.optimise(queries).collect()}
    assert set(lex.OPTIMISER_SYNONYMS["malha"]) <= got
    assert all(len(v) >= 3 for v in lex.OPTIMISER_SYNONYMS.values())


def test_patterns_without_conditions_apply_to_every_question(spark):
    kind = "pattern_id string, confidence double, support_count int, conditions map<string,string>, adjustments map<string,string>"
    patterns = spark.createDataFrame([
        ("p1", 0.9, 50, {}, {"response_length": "long"}), ("p2", 0.8, 50, {"question_type": "what"}, {"boost_source": "1"}),
        ("p3", 0.7, 50, None, {"citation_style": "short"}),
    ], kind)
    questions = spark.createDataFrame([("what", True, "low"), ("how", False, "low")], "question_type string, has_terms boolean, complexity string")
    routed, confidence = feedback.recommend(questions, patterns)
    assert {(r.question_type, r.setting) for r in routed.collect()} == {
        ("what", "response_length"), ("what", "citation_style"), ("what", "boost_source"), ("how", "response_length"), ("how", "citation_style"),
    }
    assert {r.question_type: r.patterns for r in confidence.collect()} == {"what": 3, "how": 2}


def test_author_field(spark):
    from scriptorium.operators import bibliography

    got = one(spark, bibliography.split_author_field(F.lit("joão  silva e MARIA s. souza; p. lima & Ana and  bob e  ")), bibliography.split_author_field(F.lit(None).cast("string")))
    assert got[0] == ["João Silva", "Maria S. Souza", "P. Lima", "Ana", "Bob"] and got[1] == []
