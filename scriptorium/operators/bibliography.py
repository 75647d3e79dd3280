"""Bibliographic metadata: extraction from text and file names, author strings, formatted references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import contains_any, first, head, let, strip, words
from scriptorium.operators.validate import YEAR_MAX, YEAR_MIN, name_token, valid_author, valid_field
from scriptorium.scale import small_side

# Patterns, letters of names and words of document types.
DOI = r"10\.\d{4,}/\S+"
YEAR = r"\b(19\d{2}|20\d{2})\b"
NAME_UPPER = "A-ZÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛÇ"
NAME_LOWER = "a-záàâãéèêíìîóòôõúùûç"
LEADING_NAME = rf"^([{NAME_UPPER}][{NAME_LOWER}]+(?:[\s\-][{NAME_UPPER}][{NAME_LOWER}]+)+)"
HONORIFIC = r"(?i)\b(Dr|Prof|Mr|Mrs|Ms)\.?\s+"
TITLE_STARTS = ("abstract", "resumo", "keywords", "page ")
FILE_NOISE = r"(?i)(qualifica[cç][aã]o|dissertation|thesis|manual|compressed)"
DOCUMENT_TYPES = (
    ("thesis", ("tese", "thesis", "dissertação", "dissertation")),
    ("article", ("artigo", "article", "paper", "estudo", "study")),
    ("book", ("livro", "book", "manual", "handbook")),
    ("conference", ("conferência", "conference", "simpósio", "symposium", "congresso")),
)
AUTHOR_PATTERNS = (
    r"(?:by|author[s]?:?\s*)\s*([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+)",
    r"([A-Z][a-z]+,?\s+[A-Z]\.(?:\s+[A-Z]\.)*)",
    r"([A-Z][a-z]+\s+[A-Z]\.\s+[A-Z][a-z]+)",
)
# The last one starts only where a run of its letters does, as its first match always would; from every letter it takes
# the square of a run's length.
JOURNAL_PATTERNS = (
    r"(?:published\s+in|journal\s+of|proceedings\s+of)\s+([A-Za-z\s&]+)", r"(Journal\s+of\s+[A-Za-z\s&]+)",
    r"(Proceedings\s+of\s+[A-Za-z\s&]+)", r"((?<![A-Za-z\s&])[A-Za-z\s&]+\s+Journal)",
)
UNKNOWN_AUTHOR = "Autor não identificado"


def find_doi(text: Column, chars: int | None = None) -> Column:
    """First identifier, in the first ``chars`` characters if given."""
    found = F.regexp_extract(head(text, chars), DOI, 0)
    return F.when(found != "", F.regexp_replace(found, r"[.,;)]+$", ""))


def find_year(text: Column, chars: int | None = None, latest: int | None = YEAR_MAX) -> Column:
    """Latest plausible year, up to ``latest`` if given, in the first ``chars`` characters if given."""
    years = F.transform(
        F.regexp_extract_all(head(text, chars), F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")
    )
    return F.array_max(F.filter(years, lambda y: (y >= YEAR_MIN) & (F.lit(True) if latest is None else y <= latest)))


def find_title(text: Column, lines: int | None = None) -> Column:
    """First line that looks like a title, among the opening ``lines`` if given."""
    candidates = F.transform(first(F.split(text, "\n"), lines), strip)

    def fits(line: Column) -> Column:
        low = F.lower(line)
        starts = F.lit(False)
        for s in TITLE_STARTS:
            starts = starts | low.startswith(s)
        return F.length(line).between(20, 200) & ~line.rlike(r"^\d+$") & ~starts

    return F.regexp_replace(F.get(F.filter(candidates, fits), F.lit(0)), r"\s+", " ")


def find_authors(text: Column, lines: int | None = None, limit: int | None = None) -> Column:
    """Names that open a line, among the opening ``lines`` if given; all, or the first ``limit``."""
    short = F.filter(
        F.transform(first(F.split(text, "\n"), lines), strip), lambda x: (x != "") & (F.length(x) <= 120)
    )
    names = F.transform(short, lambda x: F.regexp_extract(x, LEADING_NAME, 1))
    return first(F.array_distinct(F.filter(names, valid_author)), limit)


def split_authors(raw: Column, limit: int | None = None) -> Column:
    """Names of an author string split at ``;``, ``and`` and ``&``, without honorifics: all, or the first ``limit``."""
    parts = F.split(raw, r"(?i)\s*;\s*|\s+and\s+|\s*&\s*")
    named = F.transform(parts, lambda p: strip(F.regexp_replace(strip(p), HONORIFIC, "")))
    found = F.filter(named, lambda p: p != "")
    return F.slice(found, 1, limit) if limit else found


def split_author_field(raw: Column, limit: int | None = None) -> Column:
    """Names of a metadata field split at ``;``, ``&``, ``and`` and ``e``, cleaned: all, or the first ``limit``; none for null."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), r"[;&]|\s+and\s+|\s+e\s+"), clean_name)
    found = F.filter(parts, lambda p: p != "")
    return F.slice(found, 1, limit) if limit else found


def base_name(filename: Column) -> Column:
    return F.regexp_replace(filename, r"\.[^.]+$", "")


def authors_from_filename(filename: Column) -> Column:
    cleaned = strip(F.regexp_replace(F.regexp_replace(base_name(filename), FILE_NOISE, ""), r"[-_]+", " "))
    parts = F.filter(words(cleaned), lambda w: ~w.rlike(r"^\d+$") & (F.length(w) > 2) & name_token(w))
    return F.when(F.size(parts) >= 2, F.array(F.array_join(parts, " ")))


def year_from_filename(filename: Column) -> Column:
    """First plausible year in the name; digits next to letters or underscores do not count."""
    year = F.regexp_extract(base_name(filename), YEAR, 1).try_cast("int")
    return F.when(year.between(YEAR_MIN, YEAR_MAX), year)


def _spaced(filename: Column) -> Column:
    bare = F.regexp_replace(base_name(filename), r"(?i)(_compressed|compressed)", "")
    return F.regexp_replace(bare, r"[-_]+", " ")


#: The published bounds of ``extract_metadata``.
BOUNDS = {"doi_chars": 3000, "year_chars": 1000, "title_lines": 15, "author_lines": 20, "authors": 5}


def extract_metadata(
    documents: DataFrame, doi_chars: int | None = None, year_chars: int | None = None, title_lines: int | None = None,
    author_lines: int | None = None, authors: int | None = None,
) -> DataFrame:
    """``documents(doc_id, text, filename[, info_title, info_author, info_date])`` to one metadata row each.

    Order of preference: document information, text, file name.  ``confidence`` is the share of author, year and
    title that came from the document information.
    """
    for name in ("info_title", "info_author", "info_date"):
        if name not in documents.columns:
            documents = documents.withColumn(name, F.lit(None).cast("string"))
    info_year = F.regexp_extract("info_date", r"D:(\d{4})", 1).try_cast("int")
    listed = first(F.filter(split_authors(F.col("info_author")), valid_author), authors)
    rows = documents.withColumns({
        "_t": F.when(valid_field(F.col("info_title")), strip(F.col("info_title"))),
        "_a": F.when(valid_field(F.col("info_author")) & (F.size(listed) > 0), listed),
        "_y": F.when(info_year.between(YEAR_MIN, YEAR_MAX), info_year),
    })
    from_text = find_authors(F.col("text"), author_lines, authors)
    fallback_author = F.array(F.array_join(F.slice(words(_spaced(F.col("filename"))), 1, 3), " "))
    known = F.col("_t").isNotNull().cast("int") + F.col("_a").isNotNull().cast("int") + F.col("_y").isNotNull().cast("int")
    return rows.select(
        "doc_id", "filename",
        F.coalesce(
            "_a", F.when(F.size(from_text) > 0, from_text), authors_from_filename(F.col("filename")), fallback_author
        ).alias("authors"),
        F.coalesce("_y", find_year(F.col("text"), year_chars), year_from_filename(F.col("filename"))).alias("year"),
        F.coalesce("_t", find_title(F.col("text"), title_lines), strip(F.regexp_replace(_spaced(F.col("filename")), r"\s+", " "))).alias("title"),
        find_doi(F.col("text"), doi_chars).alias("doi"),
        (known / 3).alias("confidence"),
    )


def clean_name(name: Column) -> Column:
    """One space between words; initials upper-cased, other words capitalised."""
    def word(w: Column) -> Column:
        initial = (F.length(w) == 1) | ((F.length(w) == 2) & F.endswith(w, F.lit(".")))
        return F.when(initial, F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))
        )

    return F.array_join(F.transform(words(name), word), " ")


def document_type(text: Column, filename: Column) -> Column:
    def named(low: Column) -> Column:
        case = F.lit("article")
        for name, found in reversed(DOCUMENT_TYPES):
            case = F.when(contains_any(low, found), name).otherwise(case)
        return case

    return let(F.lower(F.concat(text, F.lit(" "), filename)), named)


def reference_from_page(documents: DataFrame, current_year: int = YEAR_MAX, limit: int | None = None) -> DataFrame:
    """Second rule set for ``documents(doc_id, text, filename)``: authors by three patterns, journal, year, type."""
    flat = strip(F.regexp_replace("text", r"\s+", " "))
    page = documents.withColumn("_x", flat)
    x = F.col("_x")
    found = F.concat(*[F.regexp_extract_all(x, F.lit("(?iu)" + p), F.lit(1)) for p in AUTHOR_PATTERNS])
    opening = F.when(
        F.length(x).between(6, 99) & x.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z]\.)*\s+[A-Z][a-z]+"), F.array(x)
    ).otherwise(F.array().cast("array<string>"))
    names = F.array_distinct(F.transform(F.concat(found, opening), clean_name))
    authors = first(F.filter(names, lambda n: F.length(n) > 3), limit)
    bare = F.regexp_replace(base_name(F.col("filename")), r"_compressed|_final|_v\d+", "")
    guess = F.regexp_extract(bare, r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 1)
    inferred = F.array(F.when(guess != "", clean_name(guess)).otherwise(F.lit(UNKNOWN_AUTHOR)))
    low = F.lower(x)
    starts = low.startswith("abstract") | low.startswith("resumo") | low.startswith("page") | low.startswith("página")
    titled = F.when((F.length(x) > 10) & (F.length(x) < 200) & ~starts & ~x.rlike(r"^\d+"), x)
    from_name = F.initcap(strip(F.regexp_replace(F.regexp_replace(bare, r"[-_]", " "), r"\s+", " ")))
    journals = [F.regexp_extract(x, "(?iu)" + p, 1) for p in JOURNAL_PATTERNS]
    years = F.transform(F.regexp_extract_all(x, F.lit(r"(\d{4})"), F.lit(1)), lambda y: y.cast("int"))
    return page.select(
        "doc_id", "filename",
        let(authors, lambda a: F.when(F.size(a) > 0, a).otherwise(inferred)).alias("authors"),
        F.coalesce(titled, from_name).alias("title"),
        F.coalesce(*[let(j, lambda v: F.when(v != "", strip(v))) for j in journals]).alias("journal"),
        F.array_max(F.filter(years, lambda y: y.between(1900, current_year))).alias("year"),
        document_type(x, F.col("filename")).alias("type"),
    )


def reference_string(number: Column) -> Column:
    """Numbered reference of a row with authors, title, journal, volume, number, pages, year, publisher, doi, type."""
    a = F.col("authors")
    n = F.size(a)
    who = (
        F.when(n == 1, F.get(a, F.lit(0)))
        .when(n == 2, F.concat(F.get(a, F.lit(0)), F.lit(" e "), F.get(a, F.lit(1))))
        .when(n == 3, F.concat(F.array_join(F.slice(a, 1, 2), ", "), F.lit(", e "), F.get(a, F.lit(2))))
        .otherwise(F.concat(F.coalesce(F.get(a, F.lit(0)), F.lit("")), F.lit(" et al.")))
    )

    def part(before: str, name: str) -> Column:
        value = F.col(name).cast("string")
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value)).otherwise("")

    has_journal = F.coalesce(F.col("journal"), F.lit("")) != ""
    article = F.concat(
        part(". ", "journal"), part(", vol. ", "volume"), part(", no. ", "number"), part(", ", "year"),
        part(", pp. ", "pages"),
    )
    details = (
        F.when((F.col("type") == "article") & has_journal, article)
        .when(F.col("type").isin("thesis", "book"), F.concat(part(". ", "publisher"), part(", ", "year")))
        .when(F.col("type") == "conference", F.concat(part(". In ", "journal"), part(", ", "year")))
        .otherwise("")
    )
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("]: "), who, F.lit('. "'), F.col("title"), F.lit('"'), details,
        F.lit("."), part(" DOI: ", "doi"),
    )


def short_citation(authors: Column, year: Column, filename: Column) -> Column:
    """(Author, Year), (A and B, Year) or (A et al., Year); the file name stands in for missing authors."""
    n = F.coalesce(F.size(authors), F.lit(0))
    who = (
        F.when(n <= 0, base_name(filename))
        .when(n == 1, F.get(authors, F.lit(0)))
        .when(n == 2, F.concat(F.get(authors, F.lit(0)), F.lit(" and "), F.get(authors, F.lit(1))))
        .otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    )
    return F.concat(F.lit("("), who, F.lit(", "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def attach_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """Document metadata and its short citation on every chunk; broadcast only while the counted table is small."""
    cited = metadata.withColumn(
        "citation", short_citation(F.col("authors"), F.col("year"), F.col("filename"))
    ).withColumn("author", F.array_join("authors", ", ")).select("doc_id", "author", "year", "title", "doi", "citation")
    return chunks.join(small_side(cited), "doc_id", "left")
