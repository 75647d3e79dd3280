"""Personal data in texts, and the terms that give it away.

Base spans come from patterns.  Then corpus co-occurrence tells how strongly a term reveals a protected value: with
probabilities over documents, a term t beside a value e tells ``PMI(t; e) = IC(e) + log2 p(e | t)`` bits of the ``IC(e) =
-log2 p(e)`` that identify it.  A term that tells at least ``share`` of them, beside the value in ``support`` different
contexts, is removed where it stands beside that value if it tells them all but ``sure``, and generalised otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import left_join, text_key, written

#: Words on each side of a value that count as beside it, and the characters they are looked for in.
NEAR, REACH = 8, 200
#: Share of a value's information, different contexts, and the share from which a term goes altogether.
SHARE, SUPPORT, SURE = 0.8, 2, 0.98
#: Candidate terms up to which they are broadcast, about 40 bytes each.
BROADCAST_TERMS = 500_000
KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails at its start fails inside too, so only starts of runs are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = regex.compile(r"\p{L}+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end of all values, by kind and then start."""
    out = [("email", s, e) for s, e in _emails(text)]
    if first := _DIGIT.search(text):
        at = first.start()
        for m in _IP.finditer(text, at):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text, at):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def mentions(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """Each value with the words beside it that are no part of a value."""
    out = []
    for kind, s, e in spans:
        low, high = max(0, s - REACH), min(len(text), e + REACH)
        before = [m for m in _WORD.finditer(text, low, s) if m.start() > low or not low][-NEAR:]
        after = islice((m for m in _WORD.finditer(text, e, high) if m.end() < high or high == len(text)), NEAR)
        words = [
            {"t": m[0].lower(), "s": m.start(), "e": m.end()} for m in [*before, *after]
            if not any(a < m.end() and m.start() < b for _, a, b in spans)
        ]
        value = text[s:e].lower() if kind in ("email", "ip") else "".join(_DIGIT.findall(text[s:e]))
        out.append({"entity": f"{kind}:{value}", "words": words})
    return out


_BASE = "array<struct<kind:string,start:int,end:int>>"
_MENTIONS = "array<struct<entity:string,words:array<struct<t:string,s:int,e:int>>>>"


def _found(docs: DataFrame) -> DataFrame:
    base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    word = pa.struct([("t", pa.string()), ("s", pa.int32()), ("e", pa.int32())])
    mention_type = pa.list_(pa.struct([("entity", pa.string()), ("words", pa.list_(word))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, beside = [], []
            for i in range(batch.num_rows):
                text = batch.column(3)[i].as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                beside.append(mentions(text, spans))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(base, base_type), pa.array(beside, mention_type)], ["id", "a", "b", "base", "mentions"]
            )

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(run, f"id {kind}, a long, b long, base {_BASE}, mentions {_MENTIONS}")


def _telling(beside: DataFrame, docs: DataFrame, n_docs: int, share: float, support: int) -> DataFrame:
    """entity, t, told: pairs in which the term tells at least ``share`` of the value's information."""
    one = ["id", "a", "b"]
    context = F.xxhash64(F.concat_ws(" ", F.transform("words", lambda w: w["t"])))
    pairs = beside.select(*one, "entity", context.alias("context"), F.explode("words").alias("w")).select(*one, "entity", "context", F.col("w.t").alias("t"))
    shared = pairs.select("entity", "t", "context").distinct().groupBy("entity", "t").count().where(F.col("count") >= support).select("entity", "t")
    shared = written(shared)
    both = pairs.join(shared, ["entity", "t"]).select(*one, "entity", "t").distinct().groupBy("entity", "t").agg(F.count("*").alias("n_both"))
    values = beside.select(*one, "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = written(shared.select("t").distinct())
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("t"))
    counts = words.join(F.broadcast(terms) if few else terms, "t").groupBy("t").agg(F.count("*").alias("n_term"))
    told = both.join(values, "entity").join(counts, "t", "left")
    information = F.log2(F.lit(float(max(1, n_docs))) / F.col("n_entity"))
    given = F.log2(F.col("n_both") / F.greatest(F.col("n_both"), F.coalesce("n_term", F.lit(0))))
    told = told.select("entity", "t", F.when(information > 0, (information + given) / information).otherwise(0.0).alias("told"))
    return told.where(F.col("told") >= share)


def private_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, support: int = SUPPORT
) -> DataFrame:
    """One row per document: id, a, b (128 bits of the text), base, terms.

    ``base`` has kind, start and end of the values, ``terms`` start, end, value and told of the words beside them that tell
    too much; code points, end exclusive.  Null is the empty text.  Repeated rows get equal results; ids may be null.
    """
    key = text_key(F.col("text"))
    src = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.select("id", key["a"].alias("a"), key["b"].alias("b"), "text")
    found = written(_found(src))
    beside = found.select("id", "a", "b", F.explode("mentions").alias("m")).select("id", "a", "b", "m.entity", "m.words")
    telling = written(_telling(beside, src, found.count(), share, support))
    words = beside.select("id", "a", "b", "entity", F.explode("words").alias("w")).select("id", "a", "b", "entity", F.col("w.t").alias("t"), "w.s", "w.e")
    hit = words.join(telling, ["entity", "t"]).groupBy("id", "a", "b").agg(
        F.array_sort(F.collect_set(F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.col("t").alias("term"), "told"))).alias("terms")
    )
    out = left_join(found.drop("mentions"), hit, ["id", "a", "b"])
    return out.withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int,term:string,told:double>>")))


def of_kind(kind: str):
    """Test of a span."""
    return lambda s: s["kind"] == kind


def named(spans, kind: str | None = None):
    """``kind:start:end`` of each span."""
    label = (lambda s: s["kind"]) if kind is None else (lambda s: F.lit(kind))
    return F.transform(spans, lambda s: F.concat_ws(":", label(s), s["start"].cast("string"), s["end"].cast("string")))


def sanitised(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sure: float = SURE, **limits) -> DataFrame:
    """All documents, in their own columns, with values and telling terms out of the text.

    A value becomes its kind in brackets; a term goes, or becomes ``[term]`` if it tells less than ``sure``.
    """
    spans = private_spans(docs, doc_id, text, **limits)
    change = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["kind"], F.lit("]")).alias("by"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["told"] >= sure, "").otherwise("[term]").alias("by"))),
    )
    changes = spans.groupBy("id", "a", "b").agg(F.first(F.array_sort(change)).alias("changes"))
    key = text_key(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("id"), key["a"].alias("a"), key["b"].alias("b"))
    out = left_join(rows, changes, ["id", "a", "b"]).select("row", "changes")
    body = F.col("row")[text]
    done = F.aggregate(
        "changes", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(body, acc["at"] + 1, s["start"] - acc["at"]), s["by"]).alias("out"))
        ),
    )
    whole = F.when(F.size("changes") > 0, F.concat(done["out"], F.substr(body, done["at"] + 1))).otherwise(body)
    return out.select(*[whole.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
