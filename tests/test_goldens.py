"""Hand-written expectations for the routines SQL cannot check."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import cleaning
from scriptorium.functions.rules import classify, rule
from scriptorium.operators import bibliography, chunking, citations, context, conversations, quality, rerank, training
from scriptorium.operators import structure, validate
from scriptorium.operators.classify import priority_section


def one(spark, value, build, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(build(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("given, wanted", [
    ("porosidade Ã© alta", "porosidade é alta"), ("já é válido", "já é válido"), ("preço — 5", "preço — 5"), ("plain", "plain"),
])
def test_repair_encoding(spark, given, wanted):
    assert one(spark, given, cleaning.repair_encoding) == wanted


@pytest.mark.parametrize("given, wanted", [
    ("perme-\nabilidade", "permeabilidade"),
    ("a linha\ncontinua aqui", "a linha continua aqui"),
    ("volumedePoros", "volume de Poros"),
    ("fim.Começo", "fim. Começo"),
    ("fluxoÓleo", "fluxo Óleo"),
    ("k10mD", "k 10 mD"),
    ("dopoço produtor", "do poço produtor"),
    ("a=b", "a = b"),
    ("texto☃ limpo", "texto limpo"),
    ("valor( 3 )final", "valor (3) final"),
    ("  muitos\t\tespaços   aqui ", "muitos espaços aqui"),
    ("X Reservatório", "Reservatório"),
    (None, ""),
])
def test_clean(spark, given, wanted):
    assert one(spark, given, cleaning.clean) == wanted


def test_priority_rules(spark):
    rows = [
        ("An abstract of it", 9, "abstract"), ("The method used", 9, "methodology"), ("porosity is a fraction of oil", 9, "definition"),
        ("x = 3", 9, "equation"), ("see tab. 3", 9, "figure_table"), ("related work here", 9, "literature"), ("nothing", 2, "early_page"),
        ("nothing", 4, "regular"),
    ]
    df = spark.createDataFrame(rows, "t string, p int, want string")
    got = df.select("want", priority_section(F.col("t"), F.col("p")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_whole_word_rules(spark):
    rules = (rule("hit", ("oil",)),)
    for whole, wanted in ((False, "hit"), (True, "none")):
        assert one(spark, "boiling", lambda c: classify(c, rules, "none", whole_word=whole)) == wanted


@pytest.mark.parametrize("size, overlap", [(40, 10), (25, 0), (60, 30)])
def test_recursive_split(spark, size, overlap):
    text = "Primeira parte do texto.\n\nSegunda parte, bem mais longa que a primeira. Ela continua aqui\ne termina" + "x" * 70
    parts = one(spark, text, chunking.recursive_split(size, overlap))
    assert all(len(p) <= size for p in parts)
    bare = "".join(text.split())
    if overlap == 0:
        assert "".join("".join(p.split()) for p in parts) == bare
    assert all("".join(p.split()) in bare for p in parts)
    assert one(spark, "", chunking.recursive_split(size, overlap)) == []


def plain_recursive(text, size, overlap, seps=("\n\n", "\n", ". ", " ", "")):
    """The splitter as a plain recursion, by the rule of its docstring."""
    def joined(pieces):
        out, held = [], []
        for p in pieces:
            if held and len("".join(held)) + len(p) > size:
                out.append("".join(held))
                while held and (len("".join(held)) > overlap or len("".join(held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        return [o.strip(" \t\n\x0b\f\r") for o in [*out, "".join(held)] if o.strip(" \t\n\x0b\f\r")]

    sep, *rest = next((seps[i:] for i, s in enumerate(seps) if s in text))
    parts = text.split(sep) if sep else list(text)
    pieces = [p for p in [parts[0], *(sep + p for p in parts[1:])] if p] if parts else []
    out, run = [], []
    for p in pieces:
        if len(p) < size:
            run.append(p)
        else:
            out, run = out + joined(run) + plain_recursive(p, size, overlap, rest), []
    return out + joined(run)


def test_recursive_split_against_recursion(spark):
    rng = random.Random(7)
    pool = ["\n", "\n\n", ". ", " ", "a", "bc", "d" * 9, "é", "😀", "x" * 45, ".", "\t"]
    texts = ["", "\n\n\n", "y" * 1000, *("".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(150))]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    for size, overlap in ((20, 5), (12, 0), (40, 39), (300, 30)):
        for r in df.select("t", chunking.recursive_split(size, overlap)("t").alias("got")).collect():
            assert r.got == plain_recursive(r.t or "", size, overlap), (r.t, size, overlap)


def test_pack_paragraphs(spark):
    text = "aaa aaa\n\nbbb bbb\n\n" + "Um dois tres. Quatro cinco seis. Sete oito nove."
    parts = one(spark, text, lambda c: chunking.pack_paragraphs(c, 20, overlap_words=2))
    assert [(p.content, p.chunk_type) for p in parts] == [
        ("aaa aaa\n\nbbb bbb", "sentence_split"), ("bbb bbb Um dois tres.", "sentence_split"),
        ("dois tres. Quatro cinco seis.", "sentence_split"), ("cinco seis. Sete oito nove.", "last"),
    ]


def test_pack_semantic(spark):
    df = spark.createDataFrame([(["aaaa aaaa", "bbbb bbbb", "Title", "cccc"], [1], ["Title"])], "s array<string>, b array<int>, t array<string>")
    packed = chunking.pack_semantic(F.col("s"), F.col("b"), F.col("t"), target=12, maximum=40, overlap=4)
    got = df.select(packed.alias("p")).first().p
    assert [p.content for p in got] == ["aaaa aaaa", "aaaa bbbb bbbb", "bbbb Title cccc"]


def test_keywords_and_title(spark):
    text = "poço poço água. água água rocha"
    assert one(spark, text, lambda c: structure.keywords(c, ["rocha"])) == ["água", "poço", "rocha"]
    page = "12\nResumo do texto todo\n1. Parte um do texto\nUm Título   de verdade\nresto"
    assert one(spark, page, structure.title_from_lines) == "Um Título de verdade"


def test_validators(spark):
    fields = [("A title", True), ("  ", False), ("untitled", False), ("ab", False), ("0f" * 18, False), (None, False)]
    for value, wanted in fields:
        assert one(spark, value, validate.valid_field) is wanted
    for name, wanted in (("Maria Silva", True), ("maria silva", False), ("Silva", False), ("R2 D2 Robot", False), ("Table Figure", False)):
        assert one(spark, name, validate.valid_author) is wanted


def test_short_citations(spark):
    rows = [([], None, "a.b.pdf", "(a.b, n.d.)"), (["A B"], 1999, "x.pdf", "(A B, 1999)"), (["A", "B"], 2001, "x", "(A and B, 2001)"),
            (["A", "B", "C"], 2001, "x", "(A et al., 2001)")]
    df = spark.createDataFrame(rows, "a array<string>, y int, f string, want string")
    for r in df.select("want", bibliography.short_citation(F.col("a"), F.col("y"), F.col("f")).alias("got")).collect():
        assert r.got == r.want


def test_metadata_extraction(spark):
    page = "Maria Souza\nFluxo em meios porosos heterogêneos\nJoão Pedro Lima, UFX\nsee 10.1234/abc.5). Printed 2011 and 1999"
    rows = [
        (1, page, "x_2003.pdf", None, "Ana Dias; Dr. Beto Cruz and unknown", "D:20150102"),
        (2, page, "x 2003.pdf", None, None, None),
        (3, "nada", "Silva-Costa_thesis 1998.pdf", "untitled", None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, filename string, info_title string, info_author string, info_date string")
    got = {r.doc_id: r for r in bibliography.extract_metadata(df).collect()}
    assert (got[1].authors, got[1].year, got[1].doi) == (["Ana Dias", "Beto Cruz"], 2015, "10.1234/abc.5")
    assert (got[2].authors, got[2].year) == (["Maria Souza", "João Pedro Lima"], 2011)
    assert got[2].title == "Fluxo em meios porosos heterogêneos"
    assert (got[3].authors, got[3].year, got[3].title) == (["Silva Costa"], 1998, "Silva Costa thesis 1998")
    assert got[1].confidence == pytest.approx(2 / 3)


def test_reference_from_page(spark):
    df = spark.createDataFrame([(1, "A study by Carla Mendes published in Porous Media (2012)", "doc_v2.pdf"), (2, "x " * 200, "Joao Silva_final.pdf")],
                               "doc_id long, text string, filename string")
    got = {r.doc_id: r for r in bibliography.reference_from_page(df).collect()}
    assert got[1].authors[0].startswith("Carla Mendes") and got[1].year == 2012 and got[1].type == "article"
    assert got[1].journal == "Porous Media"
    assert (got[2].authors, got[2].title) == (["Joao Silva"], "Joao Silva")


def test_citation_segments_and_types(spark):
    rows = [("r", "A rocha tem poros. segundo Manual, a água flui bem.", [("s1", "Manual Tecnico", 3, "texto", 0.9)])]
    df = spark.createDataFrame(rows, "response_id string, answer string, sources array<struct<source_id:string,name:string,page:int,content:string,score:double>>")
    got = citations.track(df).orderBy("segment_no").collect()
    assert [g.text for g in got] == ["A rocha tem poros", "segundo Manual, a água flui bem."]
    assert got[1].citation_type == "direct" and got[1].citations[0].confidence == 0.95
    assert got[1].start == len("A rocha tem poros") + 1
    shown = citations.render(citations.track(df)).first()
    assert shown.simple.endswith("**Baseado em:**\n• Manual Tecnico (p. 3)")


def test_good_answer_scores_higher(spark):
    source = ["A permeabilidade mede a facilidade de fluxo na rocha. A unidade da permeabilidade é o milidarcy."]
    rows = [
        ("good", "O que é permeabilidade?", "A permeabilidade é a facilidade de fluxo na rocha. A unidade da permeabilidade é o milidarcy.", source),
        ("vague", "O que é permeabilidade?", "Depende de muitas coisas.", source),
    ]
    df = spark.createDataFrame(rows, "response_id string, question string, answer string, sources array<string>")
    got = {r.response_id: r for r in quality.critique(df).collect()}
    assert got["good"].overall > got["vague"].overall
    assert not got["vague"].validated and "Answer lacks completeness" in got["vague"].issues


def test_unit_and_range_checks(spark):
    text = "permeability = 50 m² and porosity: 0,9 and other = 7"
    assert tuple(one(spark, text, quality.unit_consistency)) == (1.0, 1, 1)
    assert tuple(one(spark, text, quality.numeric_ranges)) == (pytest.approx(2 / 3), 3, 2)
    assert one(spark, "permeability only", quality.unit_consistency).score == 0.0


def test_compression_short_circuits(spark):
    rows = [(1, "q", ""), (2, "q", "Uma frase com mais de vinte letras."), (3, "q", " ".join(f"Frase numero {i} com bastante texto dentro." for i in range(8)))]
    df = spark.createDataFrame(rows, "query_id long, query_text string, combined string")
    got = {r.query_id: r for r in context.compression_statistics(context.compress(df, ["query_id"], near=2.0), ["query_id"]).collect()}
    assert [got[i].method for i in (1, 2, 3)] == ["empty_input", "no_compression_needed", "semantic_importance"]
    assert got[2].ratio == 1.0 and got[3].sentences_kept == 6 and got[3].sentences_removed == 2


def test_diversity_keeps_short_lists(spark):
    rows = [(1, i, "a b c d") for i in range(1, 4)] + [(2, i, "a b c d") for i in range(1, 5)]
    df = spark.createDataFrame(rows, "query_id long, rank int, content string")
    got = rerank.diverse(df, ["query_id"]).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 3, 2: 1}


def test_rerank_without_scorer_passes_through(spark):
    df = spark.createDataFrame([(1, 1, 0.2, "q", "c"), (1, 2, 0.9, "q", "d")], "query_id long, rank int, similarity double, query_text string, content string")
    assert [r.content for r in rerank.rerank(df, ["query_id"], 1, scorer=None).collect()] == ["c"]


def test_back_references(spark):
    rows = [(1, 0, "user", "Quais as etapas?"), (1, 1, "assistant", "1. Coletar\n2. Medir"), (1, 2, "user", "Explique o item 1"), (1, 3, "assistant", "Coletar dados"),
            (1, 4, "user", "E a capital?"), (1, 5, "assistant", "Outra")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = {r.turn_no: r for r in conversations.enhance_questions(conversations.pair_turns(messages)).collect()}
    assert "Lista mencionada anteriormente:\n1. Coletar\n2. Medir\n" in done[2].context_summary
    assert "Pergunta 1: Quais as etapas?" in done[2].enhanced and done[2].enhanced.startswith("CONTEXTO DA CONVERSA:")
    assert done[3].enhanced == "E a capital?" and done[1].context_summary == ""


def test_entities(spark):
    found = one(spark, "1. Usar PVT\nO Modelo Numerico e a API", conversations.entities)
    assert {"item_1_Usar PVT", "PVT", "API", "O Modelo Numerico"} <= set(found) and found == sorted(found)


def test_random_split_is_stable(spark):
    rows = spark.range(2000)
    a = {r.id: r.split for r in training.split_random(rows, "id", 20).collect()}
    b = {r.id: r.split for r in training.split_random(rows.repartition(13), "id", 20).collect()}
    assert a == b and 0.15 < sum(v == "eval" for v in a.values()) / 2000 < 0.25
