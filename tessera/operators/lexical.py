"""Lexical search: field-weighted scan, BM25, exact-match boosts, snippets."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import occurrences, tokens
from tessera.sources.storage import cut

#: Fixed weights of the fields that a term is part of.
FIELD_WEIGHTS = {"title": 12, "page_id": 8, "tags": 6, "summary": 5}


def scan_score(terms: Sequence[str]) -> Column:
    """Sum over terms of the weights of the fields that contain it, and 1 + up to 5 for its occurrences in the body."""
    score = F.lit(0)
    for term in terms:
        for field, weight in FIELD_WEIGHTS.items():
            text = F.array_join("tags", " ") if field == "tags" else F.col(field)
            score = score + F.when(F.lower(text).contains(term), weight).otherwise(0)
        count = occurrences(F.lower("body"), term)
        score = score + F.when(count > 0, 1 + F.least(count, F.lit(5))).otherwise(0)
    return score


def scan_search(pages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """page_id, kind, score of the best pages, score then id."""
    scored = pages.select("page_id", "kind", scan_score(query.lower().split()).cast("long").alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "page_id").limit(limit)


def snippet_lines(lines: DataFrame, query: str, most: int = 3, chars: int = 240) -> DataFrame:
    """The first lines of each page that contain a term, cut to chars."""
    hit = F.lit(False)
    for term in query.lower().split():
        hit = hit | F.lower("line").contains(term)
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("line_no"))
    return lines.filter(hit).withColumn("match_no", place).filter(F.col("match_no") <= most).select("page_id", "match_no", "line_no", F.substring("line", 1, chars).alias("snippet"))


def postings(pages: DataFrame, text: str = "body", shortest: int = 1) -> DataFrame:
    """page_id, token, tf."""
    rows = pages.select("page_id", F.explode(tokens(F.col(text), shortest)).alias("token"))
    return rows.groupBy("page_id", "token").agg(F.count("*").alias("tf"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def page_frequency(pages: DataFrame, text: str = "body", shortest: int = 1) -> DataFrame:
    """token, df: document_frequency(postings()), with each text's tokens made distinct where it lies.

    Only the texts of an id that several rows have, a null one as well, meet by id and token; the others need no shuffle
    of postings.
    """
    again = cut(pages.groupBy(F.col("page_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"))
    own = lambda df: df.select("page_id", F.explode(F.array_distinct(tokens(F.col(text), shortest))).alias("token"))
    if again.isEmpty():
        rows = own(pages)
    else:
        met = F.col("page_id").eqNullSafe(F.col("_id"))
        rows = own(pages.join(again, met, "left_anti")).unionAll(own(pages.join(again, met, "left_semi")).distinct())
    return document_frequency(rows)


def bm25(pages: DataFrame, query: str, limit: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """page_id and BM25 score of the best pages (Robertson and Zaragoza, 2009).

    One pass over the texts: each page keeps its length and how often the query's terms stand in it, nothing is exploded.
    """
    terms = sorted(set(query.lower().split()))
    counts = lambda t: F.struct(F.size(t).alias("dl"), F.array(*(F.size(F.filter(t, lambda x: x == q)) for q in terms)).alias("tf"))  # noqa: B023, E731
    rows = cut(pages.select("page_id", F.transform(F.array(tokens(F.col("body"))), counts)[0].alias("c")).select("page_id", "c.*"))
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.get("tf", F.lit(k)) > 0).alias(f"df{k}") for k in range(len(terms))))  # one row

    def part(k: int) -> Column:
        tf, df = F.get("tf", F.lit(k)), F.col(f"df{k}")
        weight = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return F.when(tf > 0, weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0)

    hits = rows.filter(F.exists("tf", lambda x: x > 0)).join(F.broadcast(size))
    return hits.select("page_id", F.round(sum((part(k) for k in range(len(terms))), F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), "page_id").limit(limit)


Phrase = tuple[tuple[str, ...], bool]  # its tokens, and whether the last one may go on


def parse_query(query: str) -> list[Phrase]:
    """The phrases of a query, any of which a page may hold.

    The whole query is one. A path stands for its parts as well, a single word of four letters or more for all words that
    begin with it, and of several words each stands for those that begin with it.
    """
    clean = query.strip()
    cut_up = lambda x: tuple(re.findall(r"[^\W_]+", x.lower()))
    if not cut_up(clean):
        return []
    out: list[Phrase] = [(cut_up(clean), False)]
    if re.search(r"[/.:]", clean):
        parts = re.split(r"[/.:\s]+", clean.strip("/.: "))
        out += [(cut_up(p), False) for p in parts if len(parts) > 1 and len(p) >= 2]
    elif re.fullmatch(r"[A-Za-z0-9_]+", clean):
        out += [(cut_up(clean), True)] if len(clean) >= 4 else []
    elif " " in clean:
        out += [(cut_up(t), True) for t in re.findall(r"[A-Za-z0-9_]+", clean) if len(t) >= 2]
    return list(dict.fromkeys(p for p in out if p[0]))


FIELDS = ("page_id", "title", "summary", "tags", "body", "sources")
GAP = "\u0000"  # stands between fields: no phrase goes over it


def field_tokens() -> Column:
    """The words of all fields of a page, with a gap between fields."""
    parts = []
    for f in FIELDS:
        text = F.array_join(f, " ") if f in ("tags", "sources") else F.col(f)
        parts += [F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array(F.lit(GAP))]
    return F.concat(*parts)


def _times(t: Column, phrase: Phrase) -> Column:
    """How often a phrase stands in an array of words."""
    words, open_end = phrase
    last = (lambda x: x.startswith(words[-1])) if open_end else (lambda x: x == words[-1])
    if len(words) == 1:
        return F.size(F.filter(t, last))
    inner = lambda x, i: sum(((F.get(t, i - (len(words) - 1 - k)) == w).cast("int") for k, w in enumerate(words[:-1])), F.lit(0)) == len(words) - 1
    return F.size(F.filter(t, lambda x, i: last(x) & F.coalesce(inner(x, i), F.lit(False))))


def full_text(pages: DataFrame, query: str, limit: int = 20, kind: str | None = None, lane: str | None = None, actor: str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """page_id, score, points of the best pages that hold a phrase of the query in any field, by BM25 with one weight for all fields.

    Frequencies and lengths are those of all pages; kind, lane and actor only choose. points is the score in millionths.
    """
    phrases = parse_query(query)
    scope = [c for c, v in (("kind", kind), ("lane", lane), ("actor", actor)) if v]
    if not phrases:
        return pages.sparkSession.createDataFrame([], "page_id string, score double, points long")
    counts = lambda t: F.struct((F.size(t) - len(FIELDS)).alias("dl"), F.array(*(_times(t, p) for p in phrases)).alias("tf"))
    rows = cut(pages.select("page_id", *scope, F.transform(F.array(field_tokens()), counts)[0].alias("c")).select("page_id", *scope, "c.*"))
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.get("tf", F.lit(k)) > 0).alias(f"df{k}") for k in range(len(phrases))))  # one row

    def part(k: int) -> Column:
        tf, df = F.get("tf", F.lit(k)), F.col(f"df{k}")
        weight = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))

    hits = rows.filter(F.exists("tf", lambda x: x > 0))
    for column, value in (("kind", kind), ("lane", lane), ("actor", actor)):
        hits = hits.filter(F.col(column) == value) if value else hits
    score = F.round(sum((part(k) for k in range(len(phrases))), F.lit(0.0)), 6)
    return hits.join(F.broadcast(size)).select("page_id", score.alias("score"), F.round(score * 1e6).cast("long").alias("points")).orderBy(F.desc("score"), "page_id").limit(limit)


def highlights(pages: DataFrame, query: str, width: int = 32) -> DataFrame:
    """page_id, snippet: `width` words of each body from the first that a phrase's word fits on, these words between **, ... where it is cut."""
    words = sorted({w for phrase, _ in parse_query(query) for w in phrase})
    fits = lambda x: sum((F.lower(x).contains(w).cast("int") for w in words), F.lit(0)) > 0

    def shown(t: Column) -> Column:
        hits = F.filter(F.transform(t, lambda x, i: F.when(fits(x), i)), lambda i: i.isNotNull())
        at = F.get(hits, F.lit(0))
        part = F.transform(F.slice(t, at + 1, width), lambda x: F.when(fits(x), F.concat(F.lit("**"), x, F.lit("**"))).otherwise(x))
        return F.when(at.isNotNull(), F.concat(F.when(at > 0, "...").otherwise(""), F.array_join(part, " "), F.when(F.size(t) > at + width, "...").otherwise("")))

    bound = F.transform(F.array(F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda x: x != "")), shown)[0]
    return pages.select("page_id", bound.alias("snippet")).filter("snippet is not null")


def exact_boost(query: str) -> Column:
    """Points for a page whose id, title or tags are the query: id 10, last part of id 5, title 8, its start 4, tag 3."""
    q = query.lower()
    page, title = F.lower("page_id"), F.lower(F.trim("title"))
    return (
        F.when((page == q) | page.endswith("/" + q), 10).when(F.array_contains(F.split(page, "/"), q), 5).otherwise(0)
        + F.when(title == q, 8).when(title.startswith(q), 4).otherwise(0)
        + F.when(F.exists("tags", lambda t: F.lower(t) == q), 3).otherwise(0)
    )


def matched_fields(terms: Sequence[str], sources: bool = False) -> Column:
    """Names of the fields that contain a term."""
    def any_in(field: Column) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.coalesce(F.lower(field).contains(t), F.lit(False))
        return out

    fields = {"title": F.col("title"), "summary": F.col("summary"), "tags": F.array_join("tags", " "), "body": F.col("body"), **({"sources": F.array_join("sources", " ")} if sources else {})}
    return F.array_compact(F.array(*(F.when(any_in(c), F.lit(n)) for n, c in fields.items())))


def boosted_search(pages: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Scan search with exact-match points added before the cut, so no exact match is lost to it."""
    terms = query.lower().split()
    total = (scan_score(terms) + exact_boost(query)).cast("long")
    scored = pages.select("page_id", total.alias("score"), F.array_join(matched_fields(terms), ",").alias("matched")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "page_id").limit(limit)
