"""Listing, filtering and cataloguing pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(needle: str) -> Column:
    """The needle, folded, is part of id, title, a tag or the summary."""
    n = needle.lower()
    inside = lambda c: F.coalesce(F.lower(c).contains(n), F.lit(False))
    return inside(F.col("page_id")) | inside(F.col("title")) | F.coalesce(F.exists("tags", inside), F.lit(False)) | inside(F.col("summary"))


def select_pages(pages: DataFrame, kind: str | None = None, lane: str | None = None, q: str | None = None) -> DataFrame:
    """Pages of a kind and lane that match q."""
    for column, value in (("kind", kind), ("lane", lane)):
        pages = pages if value is None else pages.filter(F.col(column) == value)
    return pages.filter(matches(q)) if q else pages


def listing(pages: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A slice of the pages by kind and id, each row with the total before the cut."""
    total = pages.agg(F.count("*").alias("total"))
    cut = pages.orderBy("kind", "page_id").offset(offset).limit(limit)
    return cut.join(F.broadcast(total), how="inner")  # one row of a total


def catalog(pages: DataFrame) -> DataFrame:
    """Every kind, lane and tag in use with the number of pages: field, value, n_pages."""
    pairs = F.array(
        F.struct(F.lit("kind").alias("field"), F.array("kind").alias("vals")),
        F.struct(F.lit("lane").alias("field"), F.array("lane").alias("vals")),
        F.struct(F.lit("tag").alias("field"), F.array_distinct("tags").alias("vals")),
    )
    rows = pages.select(F.explode(pairs).alias("x")).select("x.field", F.explode("x.vals").alias("value"))
    return rows.filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("n_pages"))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows of each non-null value."""
    return rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def duplicate_titles(pages: DataFrame, fewest: int = 2) -> DataFrame:
    """page_id, title_key, n_pages of pages whose folded title others have as well.

    Counts are joined back instead of gathering the ids of a title, so a title that very many pages share is no group
    in one task.
    """
    keyed = pages.select("page_id", F.lower(F.trim(F.regexp_replace("title", r"\s+", " "))).alias("title_key")).filter("title_key <> ''")
    shared = keyed.groupBy("title_key").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= fewest)
    return keyed.join(shared, "title_key").select("page_id", "title_key", "n_pages")


def read_pages(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """The pages of the ids (page_id) that exist."""
    return pages.join(ids.select("page_id").distinct(), "page_id", "left_semi")


def summaries(pages: DataFrame) -> DataFrame:
    """page_id, title, kind, visibility, status, summary, with defaults: the title from the id, the kind from its folder, internal."""
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = F.initcap(F.translate(F.element_at(F.split("page_id", "/"), -1), "-_", "  "))
    folder = F.regexp_replace(F.split("page_id", "/")[0], "s$", "")
    return pages.select("page_id", F.coalesce(text("title"), named).alias("title"), F.coalesce(text("kind"), folder).alias("kind"), F.coalesce(text("visibility"), F.lit("internal")).alias("visibility"), text("status").alias("status"), text("summary").alias("summary"))


def post_filter(pages: DataFrame, visibility: str | None = None, status: str | None = None, namespace: str | None = None, lane: str | None = None) -> DataFrame:
    """Pages of a visibility, status, lane and first part of the id."""
    for column, value in (("visibility", visibility), ("status", status), ("lane", lane)):
        pages = pages if value is None else pages.filter(F.col(column) == value)
    return pages if namespace is None else pages.filter(F.split("page_id", "/")[0] == namespace)


def captures(pages: DataFrame, status: str = "draft", namespace: str | None = None) -> DataFrame:
    """Captures in the folders of captures, of a status or of `all`, in a folder."""
    rows = pages.filter((F.col("kind") == "capture") & F.col("page_id").rlike("^(inbox|notes)/"))
    rows = rows if status == "all" else rows.filter(F.col("status") == status)
    return rows if namespace is None else rows.filter(F.col("page_id").startswith(namespace + "/"))


def capture_list(pages: DataFrame, status: str = "draft", namespace: str | None = None, limit: int = 50) -> DataFrame:
    """The newest captures by id."""
    return captures(pages, status, namespace).orderBy(F.desc("page_id")).limit(max(1, min(limit, 200)))


def operational() -> Column:
    """Upkeep's own captures: by task, or by the lane ops."""
    return (F.coalesce(F.col("source_task"), F.lit("")) == "heartbeat-self-audit") | (F.coalesce(F.col("lane"), F.lit("")) == "ops")


def unprocessed(pages: DataFrame, log: DataFrame, limit: int | None = 50) -> DataFrame:
    """Draft captures that are not operational and that the log (capture_id, success) doesn't name, newest id first."""
    done = log.filter("success").select(F.col("capture_id").alias("page_id"))
    rows = captures(pages).filter(~operational()).join(done, "page_id", "left_anti")
    return rows if limit is None else rows.orderBy(F.desc("page_id")).limit(max(1, min(limit, 200)))


def code_references(pages: DataFrame, path: str) -> DataFrame:
    """page_id, field: pages that name a path, and the first field that does: sources, source_paths, body."""
    inside = lambda c: F.exists(c, lambda s: s.contains(path))
    field = F.when(inside("sources"), "sources").when(inside("source_paths"), "source_paths").when(F.col("body").contains(path), "body")
    return pages.select("page_id", field.alias("field")).filter("field is not null")


def day_captures(pages: DataFrame, day: str) -> DataFrame:
    """Captures of a day, by the date in their id, else when they were observed."""
    from tessera.functions.text import path_date

    return captures(pages, "all").filter(path_date(F.col("page_id"), F.col("observed_at")) == F.lit(day).cast("date"))
