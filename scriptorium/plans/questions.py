"""Registered queries: query expansion, acronyms and embedding."""

from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions.rules import rule
from scriptorium.functions.vectors import bag_of_words
from scriptorium.operators import context, embedding, enrich, expansion
from scriptorium.plans import sqltext as q
from scriptorium.plans import tables as t
from scriptorium.plans.registry import query

STOP = ("the", "and", "that", "was", "des", "les", "und", "die", "los", "las")
SYNONYMS = {
    "ther": ("other", "either", "th"), "with": ("together", "by"), "tion": ("tions", "ting"), "anat": ("inat", "onat"),
    "ouble": ("double", "trouble"), "ción": ("cion", "sión"), "keit": ("heit", "ung"), "eaux": ("eau", "aux"),
}
RULES = (rule("definition", ("is a", "que", "sich")), rule("process", ("with", "mit")), rule("application", ("for",)))
DOMAINS = ("theor", "haver", "cier")
CONTEXTS = {"edst": "edst inner flow", "eaux": "eaux de vie", "ción": "acción directa"}
ASKS = ("the", "que", "und")
TERM_TABLE = {
    "THE": "The Harmonic Exchange (THE) interwell", "IN": "In Network (IN)", "QUE": "Query Unit Engine (QUE)",
    "LA": "Local Area (LA) - interwell", "OF": "Open Field (OF)", "DE": "The Harmonic Exchange (THE) interwell",
}
RELATED = {"tion": ("ting", "tions"), "eaux": ("eau", "aux"), "an": ("on", "in")}
MAPPINGS = {"ther": "the other", "tion": "tional", "eau": "water eau", "keit": "quality", "ción": "action"}
EMBED_TERMS = ("that", "pour", "sich", "para")


def texts(spark, sf_dir):
    return t.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


LOW = t.sql_strip("lower(text)")
KNOWN = sorted(set(SYNONYMS) | {s for g in SYNONYMS.values() for s in g})
KEY_TERMS = f"""
found AS (
  SELECT item_id AS query_id, text, {LOW} AS low, list_filter({t.sql_tokens('text')}, lambda w: NOT list_contains({q.string_list(STOP)}, w) AND length(w) > 2) AS f
  FROM benchmark),
terms AS (
  SELECT *, CASE WHEN len(list_filter(f, lambda w: list_contains({q.string_list(KNOWN)}, w))) > 0
                 THEN list_filter(f, lambda w: list_contains({q.string_list(KNOWN)}, w)) ELSE f[1:3] END AS terms FROM found)"""


@query("query_key_terms", "WITH" + KEY_TERMS + "SELECT query_id, array_to_string(terms, ',') AS terms FROM terms")
def query_key_terms(spark, sf_dir):
    found = expansion.key_terms(F.col("text"), STOP, SYNONYMS, 3)
    return texts(spark, sf_dir).select("query_id", F.concat_ws(",", found).alias("terms"))


def map_sql(table) -> str:
    return "MAP {" + ", ".join(f"{q.quote(k)}: {q.string_list(v)}" for k, v in table.items()) + "}"


#: The published bounds of the expansion: terms, templates of a type, synonyms of a term, variants by synonyms, by context.
BOUNDS = {"fallback": 3, "forms_per_type": 2, "options_per_term": 2, "swaps": 3, "contexts": 2}
VOCABULARY = {"rules": RULES, "synonyms": SYNONYMS, "stop_words": STOP, "domains": DOMAINS}


def sql_expansion(limit: int | None, bounds: dict[str, int | None]) -> str:
    """Common table expressions that end in ``query_texts``: query_id, variant_no, query_text of every variant."""
    def cut(n: int | None) -> str:
        return f"[1:{n}]" if n else ""

    forms = "CASE kind" + "".join(
        f" WHEN '{k}' THEN {q.string_list(v[:bounds['forms_per_type']])}" for k, v in lex.EXPANSION_TEMPLATES.items()
    ) + " END"
    return KEY_TERMS.replace("f[1:3]", "f" + cut(bounds["fallback"])) + f""",
kinds AS (SELECT *, {q.rule_case('low', RULES, q.quote('technical'))} AS kind FROM terms),
alls AS (
  SELECT query_id, list_concat(list_concat([{t.sql_strip('text')}],
    flatten(list_transform(terms, lambda x: list_transform({forms}, lambda y: replace(y, '{{term}}', x))))),
    list_concat((list_filter(flatten(list_transform(terms, lambda x: list_transform(coalesce({map_sql(SYNONYMS)}[x], []){cut(bounds['options_per_term'])}, lambda s: replace(low, x, s)))), lambda v: v <> low)){cut(bounds['swaps'])},
    (list_concat(CASE WHEN {q.any_contained('low', DOMAINS)} THEN [] ELSE [low || ' petróleo', low || ' engenharia reservatórios'] END,
      CASE WHEN {q.any_contained('low', lex.SIMULATION_WORDS)} THEN [low || ' simulador'] ELSE [] END)){cut(bounds['contexts'])})) AS v FROM kinds),
firsts AS (
  SELECT query_id, (list_filter(list_zip(v, range(len(v))), lambda x: list_position(list_transform(v, lambda y: trim(lower(y))), trim(lower(x[1]))) = x[2] + 1)){cut(limit)} AS f FROM alls),
query_texts AS (SELECT query_id, CAST(unnest(range(len(f))) AS INT) AS variant_no, unnest(list_transform(f, lambda x: x[1])) AS query_text FROM firsts)"""


@query("query_expansion", "WITH" + sql_expansion(8, BOUNDS) + """
SELECT query_id, variant_no, query_text FROM query_texts""")
def query_expansion(spark, sf_dir):
    return expansion.expand(texts(spark, sf_dir), limit=8, **BOUNDS, **VOCABULARY)


@query("query_expansion_unbounded", "WITH" + sql_expansion(None, dict.fromkeys(BOUNDS)) + """
SELECT query_id, variant_no, query_text FROM query_texts""")
def query_expansion_unbounded(spark, sf_dir):
    """All variants, with every word of a text that holds no known term."""
    return expansion.expand(texts(spark, sf_dir), **VOCABULARY)


WORDS = ("the", "que", "in", "an", "de")
SWAPS = ", ".join(
    f"CASE WHEN contains(raw, {q.quote(k)}) AND replace(raw, {q.quote(k)}, {q.quote(s)}) <> raw THEN replace(raw, {q.quote(k)}, {q.quote(s)}) END"
    for k, v in SYNONYMS.items() for s in v[:2]
)
SUFFIXES = ", ".join(f"CASE WHEN contains(raw, {q.quote(k)}) THEN raw || ' ' || {q.quote(v)} END" for k, v in CONTEXTS.items())
REWRITES = ", ".join(
    f"CASE WHEN starts_with(low, '{w}') AND {t.sql_strip(f'''replace(low, '{w}', '')''')} <> '' THEN {t.sql_strip(f'''replace(low, '{w}', '')''')} END"
    + (f", CASE WHEN starts_with(low, '{w}') THEN 'definição ' || {t.sql_strip(f'''replace(low, '{w}', '')''')} END" if w in ("the", "que") else "")
    + (f", CASE WHEN starts_with(low, '{w}') THEN 'explicação ' || {t.sql_strip(f'''replace(low, '{w}', '')''')} END" if w == "in" else "")
    for w in WORDS
)


@query("query_optimiser", f"""
WITH base AS (SELECT item_id AS query_id, lower(text) AS raw, {LOW} AS low FROM benchmark),
alls AS (
  SELECT query_id, list_filter([low, {SWAPS}, {SUFFIXES}, {REWRITES}, CASE WHEN NOT {q.any_contained('low', WORDS)} THEN 'conceito ' || low END], lambda x: x IS NOT NULL) AS v FROM base),
firsts AS (SELECT query_id, list_filter(list_zip(v, range(len(v))), lambda x: list_position(v, x[1]) = x[2] + 1)[1:5] AS f FROM alls)
SELECT query_id, CAST(unnest(range(len(f))) AS INT) AS variant_no, unnest(list_transform(f, lambda x: x[1])) AS query_text FROM firsts""")
def query_optimiser(spark, sf_dir):
    return expansion.optimise(texts(spark, sf_dir), SYNONYMS, CONTEXTS, WORDS, ("the", "que"), "in", limit=5, options_per_term=2)


@query("query_terms_and_units", f"""
SELECT doc_id, array_to_string(list_concat(list_filter({q.string_list(KNOWN)}, lambda k: contains(lower(text), k)),
  regexp_extract_all(lower(text), {q.quote(lex.NUMBER_WITH_UNIT)})), ',') AS terms FROM documents""")
def query_terms_and_units(spark, sf_dir):
    docs = t.read_spread(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat_ws(",", expansion.query_terms(F.col("text"), KNOWN)).alias("terms"))


def acronym_sql(text: str) -> str:
    parts = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){a}([^\\p{{L}}\\p{{N}}_]|$)') THEN '{a}' END" for a in TERM_TABLE)
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


@query("acronym_detection", "WITH" + t.CHUNKS + f"""
SELECT chunk_id, array_to_string({acronym_sql('content')}, ',') AS acronyms FROM chunks""")
def acronym_detection(spark, sf_dir):
    found = enrich.acronyms(F.col("content"), TERM_TABLE)
    return t.chunks(spark, sf_dir).select("chunk_id", F.concat_ws(",", found).alias("acronyms"))


def append_sql(text: str, test: str, note: str, when: str, fold: bool) -> str:
    inside = f"contains(lower({text}), lower({test}))" if fold else f"contains({text}, {test})"
    return f"CASE WHEN {when} AND NOT {inside} THEN {text} || {note} ELSE {text} END"


def enrich_sql() -> str:
    """One nested step per definition and concept, each in its own subquery to stay linear."""
    sql = "SELECT query_id, chunk_id, content, query_text, content AS e FROM asked_hits"
    for a, d in TERM_TABLE.items():
        when = f"regexp_matches(content, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){a}([^\\p{{L}}\\p{{N}}_]|$)')"
        note = f"chr(10) || chr(10) || {q.quote(f'[DEFINIÇÃO: {d}]')}"
        sql = f"SELECT query_id, chunk_id, content, query_text, {append_sql('e', q.quote(d), note, when, True)} AS e FROM ({sql})"
    for k, v in RELATED.items():
        text = f"[CONCEITOS RELACIONADOS A '{k.upper()}': {', '.join(v)}]"
        note = f"chr(10) || chr(10) || {q.quote(text)}"
        sql = f"SELECT query_id, chunk_id, content, query_text, {append_sql('e', f'({note})', note, f'contains(lower(query_text), {q.quote(k)})', False)} AS e FROM ({sql})"
    return sql


ASKED = "asked_hits AS (SELECT hits.*, text AS query_text FROM hits JOIN benchmark ON item_id = query_id WHERE variant_no = 0)"


def asked_hits(spark, sf_dir):
    asked = texts(spark, sf_dir).withColumnRenamed("text", "query_text")
    return t.hits(spark, sf_dir).where("variant_no = 0").join(asked, "query_id")


@query("hits_with_definitions", "WITH" + t.HITS + ", " + ASKED + f"""
SELECT query_id, chunk_id, e AS enhanced, array_to_string({acronym_sql('content')}, ',') AS acronyms FROM ({enrich_sql()})""")
def hits_with_definitions(spark, sf_dir):
    return asked_hits(spark, sf_dir).select(
        "query_id", "chunk_id",
        enrich.with_definitions(F.col("content"), F.col("query_text"), TERM_TABLE, RELATED).alias("enhanced"),
        F.concat_ws(",", enrich.acronyms(F.col("content"), TERM_TABLE)).alias("acronyms"),
    )


@query("context_with_definitions", "WITH" + t.HITS + ", " + ASKED + f""",
bodies AS (SELECT query_id, min(query_text) AS query_text, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS body FROM asked_hits GROUP BY query_id)
SELECT query_id, md5(CASE WHEN len(a) > 0 THEN {q.quote(lex.DEFINITIONS_HEADING)} || array_to_string(a, chr(10)) || chr(10) || chr(10) || body ELSE body END
   || CASE WHEN {q.any_contained('lower(query_text)', ASKS)} THEN {q.quote(lex.MEANING_INSTRUCTION)} ELSE '' END) AS context_md5
FROM (SELECT *, list_transform({acronym_sql('query_text')}, lambda x: '• ' || {map_sql({k: (v,) for k, v in TERM_TABLE.items()})}[x][1]) AS a FROM bodies)""")
def context_with_definitions(spark, sf_dir):
    hits = asked_hits(spark, sf_dir)
    lists = context.ranked_lists(hits, ["query_id", "query_text"]).select(
        "query_id", "query_text", F.col("hits.content").alias("documents")
    )
    built = enrich.build_context(lists, TERM_TABLE, ASKS)
    return built.select("query_id", F.md5("context").alias("context_md5"))


@query("definition_gaps", "WITH" + t.HITS + ", " + ASKED + f""",
asked AS (
  SELECT DISTINCT item_id AS query_id, w AS acronym FROM (SELECT item_id, unnest({t.sql_words('upper(text)')}) AS w FROM benchmark WHERE {q.any_contained('lower(text)', ASKS)})
  WHERE w IN ({', '.join(q.quote(a) for a in TERM_TABLE)}))
SELECT * FROM asked WHERE NOT EXISTS (
  SELECT 1 FROM hits WHERE hits.query_id = asked.query_id AND contains(lower(content), 'tionth'))
  OR acronym NOT IN ({', '.join(q.quote(a) for a, d in TERM_TABLE.items() if 'tionth' in d.lower() or a in ('THE', 'LA'))})""")
def definition_gaps(spark, sf_dir):
    table = {a: (d + " tionth" if a in ("THE", "LA") else d) for a, d in TERM_TABLE.items()}
    asked = texts(spark, sf_dir).withColumnRenamed("text", "query_text")
    return enrich.definition_gaps(asked, t.hits(spark, sf_dir), table, ASKS, keyword="tionth")


def chain_sql(text: str) -> str:
    for k, v in MAPPINGS.items():
        text = f"regexp_replace({text}, '(?i){k}', '{k} {v}', 'g')"
    return text


@query("embed_enrichment", f"""
SELECT doc_id, md5(CASE WHEN {q.any_contained('lower(e)', EMBED_TERMS)} THEN {q.quote(lex.EMBED_PREFIX)} || e ELSE e END) AS enriched_md5
FROM (SELECT doc_id, {chain_sql('text')} AS e FROM documents)""")
def embed_enrichment(spark, sf_dir):
    enriched = embedding.enrich_text(F.col("text"), MAPPINGS, EMBED_TERMS)
    return t.read_spread(spark, sf_dir, "documents").select("doc_id", F.md5(enriched).alias("enriched_md5"))


@query("embed_with_cache", "WITH" + t.CHUNK_VECTORS + """
SELECT chunk_id, md5(content) AS text_md5, array_to_string(list_transform(vec, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS counts
FROM chunks JOIN chunk_vectors USING (chunk_id)""")
def embed_with_cache(spark, sf_dir):
    """Cached: every text whose md5 starts with a digit; the others are embedded now."""
    rows = t.chunks(spark, sf_dir).select("chunk_id", F.col("content").alias("text"))
    known = rows.select(F.md5("text").alias("text_md5"), "text").dropDuplicates(["text_md5"])
    cache = known.where(F.col("text_md5").rlike("^[0-9]")).select("text_md5", bag_of_words(F.col("text")).alias("vec"))
    joined, _ = embedding.embed_with_cache(rows, cache)
    counts = F.array_join(F.transform("vec", lambda x: x.cast("int").cast("string")), ",")
    return joined.select("chunk_id", "text_md5", counts.alias("counts"))
