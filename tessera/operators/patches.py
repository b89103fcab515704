"""Patches of pages: rendered from plans, and applied only to the text that the plan has seen."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.policy import insert_into_section
from tessera.sources.storage import small

FACTS, NOTES = "## Facts", "## Review Notes"
STALE = "<!-- a claim contradicts this page: to be reviewed -->"
RENDERED = "page_id string, operation string, base_hash string, content string, status string, reason string"
_FENCE, _HEADING, _BULLET = re.compile(r"^\s*(```|~~~)"), re.compile(r"^#{1,6}\s"), re.compile(r"^\s*(?:[-*+]\s+|\d+[.)]\s+)?")


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def fact_lines(lines: list[str], section: str | None, fact: str) -> list[int]:
    """The numbers of the lines of a section (any, if None) that hold a fact; headings and fenced code don't count."""
    found, fence, inside = [], None, section is None
    for k, line in enumerate(lines):
        mark = _FENCE.match(line)
        if mark and fence in (None, mark[1]):
            fence = None if fence else mark[1]
        elif fence is None and _HEADING.match(line.strip()):
            inside = section is None or line.strip() == section
        elif fence is None and inside and fact.casefold() in line.casefold():
            found.append(k)
    return found


def replaced_fact(content: str, section: str | None, old: str, new: str) -> tuple[str, str | None]:
    """Content with the one line that holds the old fact replaced, its bullet kept; else content as it is, and why."""
    lines = content.split("\n")
    found = fact_lines(lines, section, old) if old else []
    if len(found) != 1:
        return content, "ambiguous" if found else "not_found"
    lines[found[0]] = _BULLET.match(lines[found[0]])[0] + new
    return "\n".join(lines), None


def stub(page_id: Column, facts: Column, section: str = FACTS) -> Column:
    """A new page: a title from its id, and the facts in their section."""
    title = F.initcap(F.translate(F.element_at(F.split(page_id, "/"), -1), "-_", "  "))
    return F.concat(F.lit("# "), title, F.lit(f"\n\n{section}\n\n"), facts, F.lit("\n"))


def render(plans: DataFrame, pages: DataFrame, section: str = FACTS) -> DataFrame:
    """page_id, operation, base_hash, content, status (ready, needs_manual_review) and reason of each plan.

    plans: page_id, operation, fact, old_fact; a plan is one fact for one page. A page to be created, or one that there
    isn't, is a stub; an updated fact replaces the only line of the section that holds the old one, and goes to review
    where there is none or more than one; a stale page gets a marker; other facts go under the heading, unless they are
    there. base_hash is that of the page's text, null if there is none.
    """
    rows = plans.select("page_id", "operation", F.coalesce("fact", F.lit("")).alias("fact"), F.coalesce("old_fact", F.lit("")).alias("old_fact")).join(pages.select("page_id", F.col("body").alias("old")), "page_id", "left")
    base = F.when(F.col("old").isNotNull(), content_hash(F.col("old")))
    new = F.col("operation") == "create_stub_page"
    text = F.when(new | F.col("old").isNull(), stub(F.col("page_id"), F.col("fact"), section)).when(F.col("operation") == "mark_stale", insert_into_section(F.col("old"), F.lit(NOTES), F.lit(STALE)))
    text = text.when(F.col("operation") == "update_existing_fact", F.col("old")).otherwise(insert_into_section(F.col("old"), F.lit(section), F.col("fact")))
    first = rows.select("page_id", "operation", base.alias("base_hash"), text.alias("content"), "fact", "old_fact", F.col("old").isNotNull().alias("known"))

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            contents, reasons = [], []
            for operation, content, fact, old_fact, known in zip(*(batch.column(c).to_pylist() for c in ("operation", "content", "fact", "old_fact", "known"))):
                content, reason = replaced_fact(content, section, old_fact, fact) if operation == "update_existing_fact" and known else (content, None)
                contents.append(content)
                reasons.append(reason)
            status = ["needs_manual_review" if r else "ready" for r in reasons]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "operation", "base_hash")), *(pa.array(x, pa.string()) for x in (contents, status, reasons))], [f.split()[0] for f in RENDERED.split(", ")])

    return first.mapInArrow(update, RENDERED)


def apply(pages: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages after the ready patches, and (page_id, outcome) of each patch's page: applied, created, changed_since, exists, review or crowded.

    A patch is applied only if the page's text still has the hash that it was made from; a stub only where there is no
    page yet. Of several ready patches of one page none is applied: each was made from the same text.
    """
    ready = patches.filter("status = 'ready'").groupBy("page_id").agg(F.count("*").alias("n"), F.min("base_hash").alias("base_hash"), F.min("content").alias("content"))
    waiting = patches.filter("status <> 'ready'").select("page_id").distinct().join(ready, "page_id", "left_anti").select("page_id", F.lit("review").alias("outcome"))
    now = pages.select("page_id", content_hash(F.col("body")).alias("now"))
    judged = ready.join(now, "page_id", "left")
    outcome = (
        F.when(F.col("n") > 1, "crowded").when(F.col("now").isNull() & F.col("base_hash").isNull(), "created").when(F.col("base_hash").isNull(), "exists")
        .when(F.col("now").eqNullSafe(F.col("base_hash")), "applied").otherwise("changed_since")
    )
    judged = judged.select("page_id", "content", outcome.alias("outcome"))
    put = judged.filter("outcome in ('applied', 'created')").select("page_id", F.col("content").alias("_new"))
    types = {f.name: f.dataType for f in pages.schema}
    kept = pages.join(put, "page_id", "left").select(*((F.coalesce("_new", "body") if c == "body" else F.col(c)).alias(c) for c in pages.columns))
    values = {"page_id": F.col("page_id"), "body": F.col("_new")}
    created = put.join(pages.select("page_id"), "page_id", "left_anti").select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in pages.columns))
    return kept.unionByName(created), judged.select("page_id", "outcome").unionByName(waiting)
