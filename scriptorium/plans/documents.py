"""Registered queries: cleaning, labelling, sentence splitting, structure and chunking of whole documents."""

from pyspark.sql import functions as F

from scriptorium import lexicons as lex
from scriptorium.functions import cleaning
from scriptorium.functions.rules import rule
from scriptorium.functions.text import let, split_sentences, word_count
from scriptorium.operators import chunking, classify, structure
from scriptorium.plans import sqltext as q
from scriptorium.plans import tables as t
from scriptorium.plans.registry import query

# Rules over words that occur in the given texts.
PRIORITY = (
    rule("abstract", ("worthless", "ouble")),
    rule("methodology", ("keiten",)),
    rule("results", ("ación", "copyright")),
    rule("definition", ("is a", "sich"), ("that", "nicht")),
    rule("equation", ("=", "http")),
    rule("figure_table", ("shall", "pour")),
    rule("conclusion", ("with this",)),
    rule("literature", ("license", "los")),
)
TYPES = (
    rule("definition", ("is a", "qui", "was")),
    rule("process", ("with", "avec", "mit")),
    rule("comparison", ("sich", "para")),
    rule("evaluation", ("pas",)),
)
TERMS = ("that", "with", "this", "pour", "avec", "sich", "nicht", "para", "con", "ing", "the")


def documents(spark, sf_dir):
    return t.read_spread(spark, sf_dir, "documents")


DOC_TEXT = "SELECT doc_id, text FROM documents"


@query("text_clean_spacing", f"""
SELECT doc_id, md5({t.sql_strip(q.replace_chain('text', cleaning.spacing_steps() + cleaning.operator_steps()))}) AS clean_md5
FROM documents""")
def text_clean_spacing(spark, sf_dir):
    spaced = cleaning.apply_steps(cleaning.space_out(F.col("text")), cleaning.operator_steps())
    return documents(spark, sf_dir).select("doc_id", F.md5(cleaning.strip(spaced)).alias("clean_md5"))


WORD = r"\p{L}\p{M}\p{N}\p{Pc}"


def clean_sql(text: str) -> str:
    """The whole chain for texts without wrongly read bytes, in patterns that need neither look-ahead nor Unicode classes."""
    allowed, _, opened, closed = cleaning.final_steps()
    symbols = lex.ALLOWED_SYMBOLS
    kept = (rf"[^{WORD}\s\p{{Z}}\x{{00C0}}-\x{{017F}}{symbols}]", allowed[1])
    # a removal shows the next single letter its capital, so passes are repeated; each halves a row of such letters
    lone = (rf"(^|[^{WORD}])[a-zA-Z][\s\p{{Z}}]+([A-Z])", "$1$2")
    fixes = [(f"(?i){wrong}", right) for wrong, right in lex.CORRECTIONS]
    steps = cleaning.spacing_steps() + fixes + cleaning.operator_steps() + [kept] + [lone] * 8 + [opened, closed]
    return t.sql_strip(q.replace_chain(f"coalesce({text}, '')", steps))


@query("text_clean", f"SELECT doc_id, {clean_sql('text')} AS clean_text FROM documents")
def text_clean(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", cleaning.clean(F.col("text")).alias("clean_text"))


@query("text_repair_encoding", "SELECT doc_id, md5(text) AS repaired_md5 FROM documents")
def text_repair_encoding(spark, sf_dir):
    """Break every text the way a wrong decoder does and repair it: the original comes back."""
    broken = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    rows = documents(spark, sf_dir).select("doc_id", broken.alias("broken"))
    return rows.select("doc_id", F.md5(cleaning.repair_encoding(F.col("broken"))).alias("repaired_md5"))


@query("label_priority_section", "WITH" + t.CHUNKS + f"""
SELECT chunk_id, {q.rule_case('lower(content)', PRIORITY, "CASE WHEN page <= 3 THEN 'early_page' ELSE 'regular' END")} AS section
FROM chunks""")
def label_priority_section(spark, sf_dir):
    section = classify.priority_section(F.col("content"), F.col("page"), PRIORITY)
    return t.chunks(spark, sf_dir).select("chunk_id", section.alias("section"))


@query("label_priority_section_default_rules", "WITH" + t.CHUNKS + f"""
SELECT chunk_id, {q.rule_case('lower(content)', lex.PRIORITY_RULES, "CASE WHEN page <= 3 THEN 'early_page' ELSE 'regular' END")} AS section,
  {q.rule_case('lower(content)', lex.PRIORITY_RULES_SECOND_LOADER, "CASE WHEN page <= 3 THEN 'early_page' ELSE 'regular' END")} AS section_second
FROM chunks""")
def label_priority_section_default_rules(spark, sf_dir):
    content, page = F.col("content"), F.col("page")
    return t.chunks(spark, sf_dir).select(
        "chunk_id", classify.priority_section(content, page).alias("section"),
        classify.priority_section(content, page, lex.PRIORITY_RULES_SECOND_LOADER).alias("section_second"),
    )


@query("label_page_type", f"SELECT doc_id, {q.rule_case('lower(text)', lex.PAGE_TYPE_RULES, q.quote('general'))} AS page_type FROM documents")
def label_page_type(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", classify.page_type(F.col("text")).alias("page_type"))


LINES = """
lines AS (
  SELECT doc_id, CAST(i AS INT) AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents))"""


@query("label_line_section", "WITH" + LINES + f"""
SELECT doc_id, line_no, section, {q.value_case('section', lex.SECTION_IMPORTANCE, 1.0)} AS importance
FROM (SELECT *, {q.pattern_case(t.sql_strip('line'), lex.SECTION_PATTERNS, 'body')} AS section FROM lines)""")
def label_line_section(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    labelled = lines.withColumn("section", classify.line_section(cleaning.strip(F.col("line"))))
    return labelled.select(
        "doc_id", "line_no", "section", classify.section_importance(F.col("section")).alias("importance")
    )


SECTIONS = LINES + f""",
typed AS (
  SELECT doc_id, line_no, line, {q.pattern_case(t.sql_strip('line'), lex.SECTION_PATTERNS, 'body')} AS section,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS start_char,
         sum(length(line) + 1) OVER (PARTITION BY doc_id) AS total_char,
         count(*) OVER (PARTITION BY doc_id) AS total_lines FROM lines),
heads AS (
  SELECT doc_id, line_no AS start_line, start_char, section, {t.sql_strip('line')} AS title, total_char, total_lines, 1 AS o
  FROM typed WHERE section <> 'body' AND {t.sql_strip('line')} <> ''
  UNION ALL
  SELECT doc_id, 0, 0, 'body', '', min(total_char), min(total_lines), 0 FROM typed GROUP BY doc_id),
sections AS (
  SELECT doc_id, CAST(row_number() OVER w - 1 AS INT) AS section_no, start_line,
         CAST(coalesce(lead(start_line) OVER w, total_lines) AS INT) AS end_line, CAST(start_char AS INT) AS start_char,
         CAST(coalesce(lead(start_char) OVER w, total_char) AS INT) AS end_char, section, title,
         {q.value_case('section', lex.SECTION_IMPORTANCE, 1.0)} AS importance
  FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY start_line, o))"""


@query("document_sections", "WITH" + SECTIONS + "SELECT *, end_line - start_line AS line_count FROM sections")
def document_sections(spark, sf_dir):
    return structure.sections(documents(spark, sf_dir))


@query("chunk_section_lookup", "WITH" + SECTIONS + "," + t.CHUNKS + """,
placed AS (
  SELECT chunk_id, c.doc_id, start_char AS start FROM chunks c JOIN typed ON typed.doc_id = c.doc_id AND line_no = chunk_index)
SELECT chunk_id, CAST(start AS INT) AS start, coalesce(section, 'body') AS section, coalesce(importance, 1.0) AS importance
FROM placed LEFT JOIN sections ON sections.doc_id = placed.doc_id AND start >= start_char AND start < end_char""")
def chunk_section_lookup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    text = F.col("text")
    lines = docs.select("doc_id", "text", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    before = F.length(F.call_function("substring_index", text, F.lit("\n"), F.col("chunk_index")))
    placed = lines.where(F.trim("content") != "").select(
        "doc_id",
        chunking.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"),
        F.when(F.col("chunk_index") == 0, 0).otherwise(before + 1).cast("int").alias("start"),
    )
    found = structure.section_lookup(placed, structure.sections(docs))
    return found.select("chunk_id", "start", "section", "importance")


@query("label_question_types", f"""
SELECT conv_id, turn, {q.rule_case('lower(text)', TYPES, q.quote('general'))} AS fixture_type,
  {q.rule_case('lower(text)', lex.EXPANSION_TYPES, q.quote('technical'))} AS expansion_type,
  {q.rule_case('lower(text)', lex.FEEDBACK_TYPES, q.quote('general'))} AS feedback_type,
  {q.rule_case('lower(text)', lex.CRITIQUE_TYPES, q.quote('general'))} AS critique_type,
  {q.rule_case('lower(text)', lex.ROUTING_TYPES, q.quote('factual'))} AS routing_type,
  coalesce({', '.join(f"CASE WHEN starts_with({t.sql_strip('lower(text)')}, '{w}') THEN '{w}' END" for w in lex.QUESTION_WORDS + ('the', 'que', 'in'))}) AS leading_word
FROM conversations WHERE role = 'user'""")
def label_question_types(spark, sf_dir):
    text = F.col("text")
    return t.read(spark, sf_dir, "conversations").where("role = 'user'").select(
        "conv_id", "turn",
        classify.question_type(text, TYPES).alias("fixture_type"),
        classify.question_type(text, lex.EXPANSION_TYPES, "technical").alias("expansion_type"),
        classify.question_type(text, lex.FEEDBACK_TYPES).alias("feedback_type"),
        classify.question_type(text, lex.CRITIQUE_TYPES).alias("critique_type"),
        classify.question_type(text, lex.ROUTING_TYPES, "factual").alias("routing_type"),
        classify.leading_question_word(text, lex.QUESTION_WORDS + ("the", "que", "in")).alias("leading_word"),
    )


@query("question_complexity", f"""
SELECT conv_id, turn, {q.any_contained('lower(text)', TERMS)} AS has_terms,
  CASE WHEN n < 5 THEN 'simple' WHEN n < 25 AND k <= 1 THEN 'moderate' ELSE 'complex' END AS complexity_25
FROM (SELECT *, len({t.sql_words('text')}) AS n,
             len(list_filter({t.sql_words('lower(text)')}, lambda x: list_contains({q.string_list(TERMS)}, x))) AS k
      FROM conversations)""")
def question_complexity(spark, sf_dir):
    known = F.size(F.filter(classify.words(F.lower("text")), lambda w: w.isin(*TERMS)))
    n = word_count(F.col("text"))
    level = F.when((n >= 15) & (n < 25) & (known <= 1), "moderate").otherwise(
        classify.complexity(F.col("text"), TERMS)
    )
    return t.read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", classify.has_terms(F.col("text"), TERMS).alias("has_terms"), level.alias("complexity_25")
    )


@query("term_density_gate", f"""
SELECT doc_id, round(d, 6) AS density FROM (
  SELECT doc_id, CASE WHEN len(tk) > 0 THEN least(len(list_filter(tk, lambda x: list_contains({q.string_list(TERMS)}, x))) / len(tk) * 10, 1.0) ELSE 0.0 END AS d
  FROM (SELECT doc_id, {t.sql_tokens('text')} AS tk FROM documents)) WHERE d >= 0.3""")
def term_density_gate(spark, sf_dir):
    scored = documents(spark, sf_dir).select("doc_id", classify.term_density(F.col("text"), TERMS).alias("d"))
    return scored.where("d >= 0.3").select("doc_id", F.round("d", 6).alias("density"))


HELD = r"string_split(regexp_replace(regexp_replace(text, '\b(Fig|Table|Eq|Dr|Prof|et al)\.\s', '\1' || chr(2) || ' ', 'g'), '[.!?]+\s+', chr(1), 'g'), chr(1))"


def sentence_sql(variant: str) -> str:
    source, keep = {
        "long": (r"regexp_split_to_array(text, '[.!?]+\s+')", "length(s) > 10"),
        "guarded": (f"list_transform({HELD}, lambda x: replace(x, chr(2), '.'))", "length(s) >= 20"),
        "after_lowercase": (q.split_after("text", r"[a-z0-9\])]", r"[.!?]+\s+"), "s <> ''"),
        "plain": ("regexp_split_to_array(text, '[.!?]+')", "s <> ''"),
    }[variant]
    return f"list_filter(list_transform({source}, lambda x: {t.sql_strip('x')}), lambda s: {keep})"


def sentence_query(variant: str):
    sql = f"""
SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {sentence_sql(variant)} AS s FROM documents)"""

    @query(f"sentences_{variant}", sql)
    def build(spark, sf_dir):
        return documents(spark, sf_dir).select(
            "doc_id", F.posexplode(split_sentences(F.col("text"), variant)).alias("pos", "sentence")
        )


for name in ("long", "guarded", "after_lowercase", "plain"):
    sentence_query(name)

PAGES = """
page_texts AS (
  SELECT doc_id, source, CAST(p AS INT) AS page, array_to_string(l[(p - 1) * 5 + 1 : p * 5], chr(10)) AS content
  FROM (SELECT doc_id, source, l, unnest(range(1, CAST(ceil(len(l) / 5.0) AS INT) + 1)) AS p
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)))"""


def page_texts(spark, sf_dir):
    return structure.page_texts(documents(spark, sf_dir))


@query("page_batches", "WITH" + PAGES + """
SELECT doc_id, CAST((page - 1) // 10 AS INT) AS batch_no, concat_ws('-', CAST(min(page) AS VARCHAR), CAST(max(page) AS VARCHAR)) AS batch_pages,
       md5(string_agg(content, chr(10) || chr(10) ORDER BY page)) AS content_md5
FROM page_texts GROUP BY ALL""")
def page_batches(spark, sf_dir):
    batches = structure.page_batches(page_texts(spark, sf_dir), size=10)
    return batches.select("doc_id", "batch_no", "batch_pages", F.md5("content").alias("content_md5"))


def fold_sql(sources: str, units: str, keys: str, state: str, emitted: str, kind: str, final_kind: str) -> str:
    """Recursive SQL for a packer: one step per unit, then the open remainder.  Reads ``open`` and ``u``."""
    on = " AND ".join(f"st.{k} = units.{k}" for k in keys.split(", "))
    named = ", ".join(f"units.{k}" for k in keys.split(", "))
    return f"""WITH RECURSIVE {sources}, units AS ({units}),
st AS (
  SELECT DISTINCT {keys}, CAST(0 AS BIGINT) AS i, '' AS open, CAST(NULL AS VARCHAR) AS emitted, CAST(NULL AS VARCHAR) AS kind FROM units
  UNION ALL
  SELECT {named}, units.i, {state}, {emitted}, {kind} FROM st JOIN units ON {on} AND units.i = st.i + 1),
done AS (
  SELECT {keys}, i, emitted AS content, kind AS chunk_type FROM st WHERE emitted IS NOT NULL
  UNION ALL
  SELECT {keys}, 1000000000, {t.sql_strip('open')}, {final_kind} FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY i DESC) AS r FROM st) WHERE r = 1 AND {t.sql_strip('open')} <> '')
SELECT {keys}, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY i) - 1 AS INT) AS chunk_index, content, chunk_type FROM done"""


SIZE = 300
PARAGRAPH_UNITS = f"""
  SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY pi, si) AS i, sentence, u FROM (
    SELECT doc_id, page, pi, unnest(us) AS u, unnest(range(len(us))) AS si, length(p) > {SIZE} AS sentence FROM (
      SELECT doc_id, page, pi, p, CASE WHEN length(p) > {SIZE} THEN {q.split_after('p', '[.!?]', chr(92) + 's+')} ELSE [p] END AS us FROM (
        SELECT doc_id, page, unnest(ps) AS p, unnest(range(len(ps))) AS pi FROM (
          SELECT doc_id, page, list_filter(list_transform(string_split(content, chr(10)), lambda x: {t.sql_strip('x')}), lambda x: x <> '') AS ps
          FROM page_texts))))"""
UNIT_TEXT = "u || CASE WHEN sentence THEN ' ' ELSE chr(10) || chr(10) END"
FITS = f"length(open) + length(u) <= {SIZE}"
HAS_OPEN = f"{t.sql_strip('open')} <> ''"


def paragraph_sql(pages: str) -> str:
    """Packed paragraphs of ``page_texts``, which ``pages`` defines."""
    return fold_sql(
        pages, PARAGRAPH_UNITS, "doc_id, page",
        f"CASE WHEN {FITS} THEN open || {UNIT_TEXT} WHEN sentence AND {HAS_OPEN} THEN array_to_string({t.sql_words('open')}[-20:], ' ')"
        f" || ' ' || {UNIT_TEXT} ELSE {UNIT_TEXT} END",
        f"CASE WHEN NOT ({FITS}) AND {HAS_OPEN} THEN {t.sql_strip('open')} END",
        "CASE WHEN sentence THEN 'sentence_split' ELSE 'paragraph_based' END", "'last'",
    )


@query("chunk_paragraphs", paragraph_sql(PAGES))
def chunk_paragraphs(spark, sf_dir):
    packed = chunking.pack_paragraphs(F.col("content"), size=SIZE, separator="\n")
    return page_texts(spark, sf_dir).select("doc_id", "page", F.posexplode(packed).alias("chunk_index", "c")).select(
        "doc_id", "page", "chunk_index", "c.content", "c.chunk_type"
    )


def piece_units(sentences: str, keys: str, size: int) -> str:
    """Units of a packer: the sentences of ``sentences(keys, s)`` in order, long ones in pieces of ``size`` characters."""
    pieces = f"list_transform(range(0, greatest(0, (length(x) - 1) // {size}) + 1), lambda k: substr(x, k * {size} + 1, {size}))"
    return f"""
  SELECT {keys}, unnest(range(1, len(us) + 1)) AS i, unnest(us) AS u
  FROM (SELECT {keys}, flatten(list_transform(s, lambda x: {pieces})) AS us FROM ({sentences}))"""


SENTENCE_UNITS = piece_units(f"SELECT doc_id, {sentence_sql('plain')} AS s FROM documents", "doc_id", 512)


@query("chunk_training_sentences", "SELECT doc_id, chunk_index, content FROM (" + fold_sql(
    "ignored AS (SELECT 1)", SENTENCE_UNITS, "doc_id",
    "CASE WHEN length(open) + length(u) > 512 THEN CASE WHEN length(u) < 512 THEN right(open, 64) || ' ' || u ELSE left(u, 512) END"
    " ELSE open || ' ' || u END",
    f"CASE WHEN length(open) + length(u) > 512 AND open <> '' THEN {t.sql_strip('open')} END", "'full'", "'last'",
) + ")")
def chunk_training_sentences(spark, sf_dir):
    packed = chunking.pack_sentences(F.col("text"), size=512, overlap=64)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(packed).alias("chunk_index", "content"))


def recursive_sql(text: str, size: int, overlap: int, separators=("\n\n", "\n", ". ", " ", ""), d: int = 0) -> str:
    """The chunks of ``text``: a fold per separator, each inside the branch of the pieces that are still too long."""
    def filled(x: str) -> str:
        return f"list_filter([regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')], lambda f{d}: f{d} <> '')"

    if separators[d] == "":
        step = size - overlap
        count = f"CAST(ceil(greatest(0, len({text}) - {size}) / {step}) AS BIGINT) + 1"
        return f"flatten(list_transform(range({count}), lambda i{d}: {filled(f'substr({text}, i{d} * {step} + 1, {size})')}))"
    sep = q.quote(separators[d])
    parts = f"list_transform(string_split({text}, {sep}), lambda p{d}, n{d}: CASE WHEN n{d} > 1 THEN {sep} || p{d} ELSE p{d} END)"
    pieces = f"list_filter({parts}, lambda e{d}: e{d} <> '')"
    state = "STRUCT(done VARCHAR[], held VARCHAR[], total BIGINT)"
    s, x = f"s{d}", f"x{d}"
    close = lambda s: f"list_concat({s}.done, {filled(f"array_to_string({s}.held, '')")})"
    # of all suffixes of the held pieces, the longest within the limit
    suffixes = f"list_transform(range(len({s}.held) + 1), lambda k{d}: {s}.held[k{d} + 1:])"
    kept = f"list_filter({suffixes}, lambda h{d}: len(array_to_string(h{d}, '')) <= least({overlap}, {size} - len({x})))[1]"
    full = f"{s}.total + len({x}) > {size} AND len({s}.held) > 0"
    deeper = recursive_sql(x, size, overlap, separators, d + 1)
    return f"""list_transform([list_reduce({pieces}, lambda {s}, {x}: CASE
  WHEN len({x}) >= {size} THEN CAST({{'done': list_concat({close(s)}, {deeper}), 'held': [], 'total': 0}} AS {state})
  WHEN {full} THEN CAST({{'done': {close(s)}, 'held': list_append({kept}, {x}), 'total': len(array_to_string({kept}, '')) + len({x})}} AS {state})
  ELSE CAST({{'done': {s}.done, 'held': list_append({s}.held, {x}), 'total': {s}.total + len({x})}} AS {state}) END,
  CAST({{'done': [], 'held': [], 'total': 0}} AS {state}))], lambda r{d}: {close(f"r{d}")})[1]"""


@query("chunk_recursive", "SELECT doc_id, unnest(range(len(c))) AS chunk_index, unnest(c) AS content FROM (SELECT doc_id, "
       + recursive_sql("coalesce(text, '')", 400, 50) + " AS c FROM documents)")
def chunk_recursive(spark, sf_dir):
    split = chunking.recursive_split(size=400, overlap=50)
    return documents(spark, sf_dir).select("doc_id", F.posexplode(split("text")).alias("chunk_index", "content"))


def boundary_sql(most: str | None) -> str:
    """Common table expressions that end in ``bounds``; ``most`` bounds their number by that of the sentences ``n``."""
    return f"""WITH RECURSIVE sent AS (
  SELECT doc_id, CAST(unnest(range(len(s))) AS INT) AS pos, unnest(s) AS sentence
  FROM (SELECT doc_id, {sentence_sql('long')} AS s FROM documents)),
vec AS (
  SELECT doc_id, pos, ({' OR '.join(f"regexp_matches(sentence, {q.quote('(?i)' + p)})" for p in lex.BOUNDARY_PATTERNS)}) AS header,
         {t.sql_embed('sentence')} AS v FROM sent),
chained AS (SELECT *, lead(v) OVER (PARTITION BY doc_id ORDER BY pos) AS nv FROM vec),
cosines AS (SELECT doc_id, pos, header, CASE WHEN nv IS NOT NULL THEN {t.sql_cosine('v', 'nv')} END AS c FROM chained),
framed AS (
  SELECT *, avg(c) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
         avg(c) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a,
         lag(c) OVER (PARTITION BY doc_id ORDER BY pos) AS d, count(*) OVER (PARTITION BY doc_id) AS n FROM cosines),
marked AS (
  SELECT doc_id, pos, n FROM framed WHERE n >= 3 AND (
    (pos >= 5 AND pos < n - 5 AND (pos - 5) % 2 = 0 AND (round(b - a, 9) > 0.15::DOUBLE OR round(d, 9) < 0.5::DOUBLE)) OR (header AND pos > 2))),
kept AS (
  SELECT doc_id, min(pos) AS pos, 1 AS k FROM marked GROUP BY doc_id
  UNION ALL
  SELECT kept.doc_id, (SELECT min(m.pos) FROM marked m WHERE m.doc_id = kept.doc_id AND m.pos >= kept.pos + 3), k + 1
  FROM kept WHERE EXISTS (SELECT 1 FROM marked m WHERE m.doc_id = kept.doc_id AND m.pos >= kept.pos + 3)),
bounds AS (
  SELECT kept.doc_id, kept.pos FROM kept JOIN (SELECT doc_id, min(n) AS n FROM marked GROUP BY 1) USING (doc_id)
  WHERE {f'k <= {most}' if most else 'true'})"""


@query("semantic_boundaries", boundary_sql("greatest(2, n // 8)") + """
SELECT doc_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS boundaries FROM bounds GROUP BY doc_id""")
def semantic_boundaries(spark, sf_dir):
    found = chunking.semantic_boundaries(F.col("text"), most=lambda n: F.greatest(F.lit(2), F.floor(n / 8).cast("int")))
    joined = let(found, lambda b: F.concat_ws(",", F.transform(b, lambda p: p.cast("string"))))
    # exploded, so that the filter doesn't compute it again
    return documents(spark, sf_dir).select("doc_id", F.explode(F.array(joined)).alias("boundaries")).where("boundaries <> ''")


def keyword_sql(source: str, key: str) -> str:
    """Common table expressions that end in ``worded``: the source with ``kw``, the keywords of its content in order."""
    return f"""
counted AS (
  SELECT {key}, list_sort(list_transform(list_distinct(tk), lambda w: {{'n': -len(list_filter(tk, lambda x: x = w)), 'w': w}})) AS c
  FROM (SELECT {key}, {t.sql_tokens('content', 3)} AS tk FROM {source})),
worded AS (
  SELECT s.*, list_transform(list_filter(c, lambda x: list_contains({q.string_list(TERMS)}, x.w) OR x.n < -1), lambda x: x.w) AS kw
  FROM {source} s JOIN counted USING ({key}))"""


def attribute_sql(source: str = "worded") -> str:
    """Common table expression ``attributes`` over rows with content, section and keywords."""
    return f"""
attributes AS (
  SELECT *, CAST(length(content) AS INT) AS chunk_length, CAST(len({t.sql_words('content')}) AS INT) AS word_count, len(kw) > 0 AS has_terms,
         CASE WHEN section = 'abstract' THEN 'abstract' WHEN contains(lower(content), 'is a') THEN 'definition'
              WHEN section = 'equation' THEN 'equation' ELSE 'regular' END AS priority,
         round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + {q.value_case('section', lex.SECTION_BONUS, 0.0)} + least(0.2::DOUBLE, len(kw) * 0.02::DOUBLE)
           + CASE WHEN length(content) < 100 THEN -0.1::DOUBLE WHEN length(content) > 600 THEN -0.05::DOUBLE ELSE 0 END)), 6) AS score
  FROM {source})"""


SEMANTIC = boundary_sql(None) + "," + SECTIONS + f""",
titles AS (SELECT doc_id, list(title) AS ts FROM sections WHERE title <> '' GROUP BY doc_id),
spots AS (SELECT doc_id, list(pos) AS ps FROM bounds GROUP BY doc_id),
units AS (
  SELECT s.doc_id, pos + 1 AS i, sentence AS u, coalesce(list_contains(ps, pos), false) AS at_bound, coalesce(list_contains(ts, {t.sql_strip('sentence')}), false) AS at_title
  FROM sent s LEFT JOIN spots USING (doc_id) LEFT JOIN titles USING (doc_id)),
walk AS (
  SELECT DISTINCT doc_id, CAST(0 AS INT) AS i, '' AS open, CAST(0 AS BIGINT) AS start, CAST(NULL AS VARCHAR) AS content, CAST(0 AS BIGINT) AS since FROM units
  UNION ALL
  SELECT doc_id, i, CASE WHEN cut THEN fresh ELSE longer END, CASE WHEN cut THEN start + length(fresh) - length(tail) - length(u) ELSE start END,
         CASE WHEN cut THEN open END, start
  FROM (SELECT *, CASE WHEN tail <> '' THEN tail || ' ' || u ELSE u END AS fresh,
          open <> '' AND (length(longer) > 1000 OR (length(longer) > 700 AND at_bound) OR at_title) AS cut
        FROM (SELECT w.doc_id, n.i, open, start, u, at_bound, at_title, CASE WHEN open <> '' THEN open || ' ' || u ELSE u END AS longer,
                CASE WHEN length(open) <= 120 THEN open ELSE {t.sql_strip("string_split(right(open, 120), '.')[-1]")} END AS tail
              FROM walk w JOIN units n ON n.doc_id = w.doc_id AND n.i = w.i + 1))),
packed AS (
  SELECT doc_id, i, content, since AS start FROM walk WHERE content IS NOT NULL
  UNION ALL
  SELECT doc_id, 1000000000, open, start FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM walk) WHERE r = 1 AND open <> ''),
placed AS (
  SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY i) - 1 AS INT) AS chunk_index, content, CAST(p.start AS INT) AS start,
         CAST(p.start + length(content) AS INT) AS "end", coalesce(section, 'body') AS section, coalesce(importance, 1.0) AS importance
  FROM packed p LEFT JOIN sections x ON x.doc_id = p.doc_id AND p.start >= start_char AND p.start < end_char),
keyed AS (SELECT *, concat(doc_id, '-', chunk_index) AS chunk_key FROM placed),""" + keyword_sql("keyed", "chunk_key") + "," + attribute_sql()


@query("chunk_semantic", SEMANTIC + """
SELECT doc_id, chunk_index, content, start, "end", section, importance, array_to_string(kw, ',') AS keywords, chunk_length, word_count,
       has_terms, priority, score FROM attributes""")
def chunk_semantic(spark, sf_dir):
    """Finished semantic chunks of whole documents."""
    found = chunking.semantic_chunks(documents(spark, sf_dir).select("doc_id", "text"), TERMS, ("is a",))
    return found.withColumn("keywords", F.concat_ws(",", "keywords"))


KEYWORDS = f"""
SELECT chunk_id, array_to_string(list_transform(list_filter(c, lambda x: list_contains({q.string_list(TERMS)}, x.w)
         OR (x.n < -1 AND list_contains(list_filter(c, lambda y: y.n < -1)[1:10], x))), lambda x: x.w)[1:10], ',') AS keywords
FROM (
  SELECT chunk_id, list_sort(list_transform(list_distinct(tk), lambda w: {{'n': -len(list_filter(tk, lambda x: x = w)), 'w': w}})) AS c
  FROM (SELECT chunk_id, {t.sql_tokens('content', 3)} AS tk FROM chunks))"""


@query("chunk_keywords", "WITH" + t.CHUNKS + KEYWORDS)
def chunk_keywords(spark, sf_dir):
    found = structure.keywords(F.col("content"), TERMS, 10)
    return t.chunks(spark, sf_dir).select("chunk_id", F.concat_ws(",", found).alias("keywords"))


ATTRIBUTES = t.CHUNKS + f""",
labelled AS (SELECT *, {q.pattern_case(t.sql_strip('content'), lex.SECTION_PATTERNS, 'body')} AS section FROM chunks),""" + keyword_sql("labelled", "chunk_id") + "," + attribute_sql()


def attributes(spark, sf_dir):
    rows = t.chunks(spark, sf_dir).withColumn("section", classify.line_section(cleaning.strip(F.col("content"))))
    return structure.chunk_attributes(rows, TERMS, ("is a",)).select(
        "chunk_id", "content", "section", F.concat_ws(",", "keywords").alias("keywords"), "chunk_length", "word_count", "has_terms", "priority", "score",
    )


@query("chunk_attributes", "WITH" + ATTRIBUTES + """
SELECT chunk_id, section, array_to_string(kw, ',') AS keywords, chunk_length, word_count, has_terms, priority, score FROM attributes""")
def chunk_attributes(spark, sf_dir):
    return attributes(spark, sf_dir).drop("content")


@query("chunk_statistics", "WITH" + ATTRIBUTES + """
SELECT count(*) AS total_chunks, round(avg(chunk_length), 6) AS avg_size, round(median(chunk_length), 6) AS median_size,
       min(chunk_length) AS min_size, max(chunk_length) AS max_size, round(avg(score), 6) AS avg_score,
       count(*) FILTER (score > 0.7) AS high_quality, count(*) FILTER (has_terms) AS with_terms FROM attributes""")
def chunk_statistics(spark, sf_dir):
    return structure.chunk_statistics(attributes(spark, sf_dir))


@query("chunk_section_histogram", "WITH" + ATTRIBUTES + "SELECT section, count(*) AS chunks FROM attributes GROUP BY section")
def chunk_section_histogram(spark, sf_dir):
    return structure.section_histogram(attributes(spark, sf_dir))


@query("chunk_identity", "WITH" + t.CHUNKS + "SELECT doc_id, chunk_index, chunk_id FROM chunks")
def chunk_identity(spark, sf_dir):
    return t.chunks(spark, sf_dir).select(
        "doc_id", "chunk_index",
        chunking.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content")).alias("chunk_id"),
    )


TITLE_OK = (
    "length(x) > 10 AND length(x) < 200 AND NOT regexp_matches(x, '^\\d+$') AND NOT regexp_matches(x, '^\\d+\\.') AND NOT ("
    + " OR ".join(f"starts_with(lower(x), '{w}')" for w in ("abstract", "resumo", "keywords", "página")) + ")"
)


@query("document_title", f"""
SELECT doc_id, regexp_replace(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: {t.sql_strip('x')}), lambda x: {TITLE_OK})[1], '\\s+', ' ', 'g') AS title
FROM documents""")
def document_title(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", structure.title_from_lines(F.col("text"), 10).alias("title"))
