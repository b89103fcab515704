"""Markdown folders as DataFrames, with a one-level `key: value` header per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = r"(?s)\A---\n(.*?)\n---\n?"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, content, size, updated_at of every .md file below folder; hidden folders and malformed ids are skipped."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    rows = files.select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("updated_at"))
    root = folder.rstrip("/").split("://")[-1]
    page_id = F.regexp_replace(F.url_decode(F.substring_index("path", root + "/", -1)), r"\.md$", "")
    return rows.select(page_id.alias("page_id"), "content", "size", "updated_at").filter(is_page_id(F.col("page_id")))


def is_page_id(page_id: Column) -> Column:
    """Every segment of the slash path begins with a letter, digit or underscore."""
    return page_id.rlike(r"^[A-Za-z0-9_][\w.-]*(/[A-Za-z0-9_][\w.-]*)*$")


def header(content: Column) -> Column:
    """The header as a map of strings; the last of equal keys wins. Inline lists keep their brackets, block lists join by commas."""
    block = F.regexp_replace(F.regexp_extract(content, HEADER, 1), r"\n\s*-\s+", "\u001f")
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*\s*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), scalar(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]*:\s*", ""), "\u001f", ", "))).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i, F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def scalar(value: Column) -> Column:
    """Quotes and a leading comma of a joined list gone; null, none, ~ and nothing are null; numbers stay strings."""
    bare = F.regexp_replace(F.regexp_replace(value, r"^,\s*", ""), r"""^(['"])(.*)\1$""", "$2")
    return F.when(F.lower(bare).isin("null", "none", "~", ""), None).otherwise(bare)


def string_list(value: Column) -> Column:
    """`a, b` or `[a, b]` as an array of trimmed strings without blanks; null gives an empty array."""
    inner = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\[(.*)\]$", "$1")
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), r"""^['"]|['"]$""", ""))), lambda x: x != "")


def body(content: Column) -> Column:
    """The content without its header."""
    return F.regexp_replace(content, HEADER, "")


def pages(scanned: DataFrame) -> DataFrame:
    """Typed pages: page_id, title, kind, visibility, status, summary, tags, sources, body, updated_at and the header."""
    rows = scanned.withColumn("header", header(F.col("content"))).withColumn("body", body(F.col("content")))
    heading = F.nullif(F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    slug = F.initcap(F.translate(F.element_at(F.split("page_id", "/"), -1), "-_", "  "))
    place = F.split("page_id", "/")[0]
    get = lambda k: F.col("header")[k]
    return rows.select(
        "page_id",
        F.coalesce(get("title"), heading, slug).alias("title"),
        F.coalesce(get("kind"), F.regexp_replace(place, "s+$", "")).alias("kind"),
        F.coalesce(get("visibility"), F.lit("internal")).alias("visibility"),
        get("status").alias("status"),
        get("summary").alias("summary"),
        string_list(get("tags")).alias("tags"),
        string_list(get("sources")).alias("sources"),
        "body",
        "updated_at",
        "header",
    )


def render(fields: Column, text: Column) -> Column:
    """Header fields (a map of strings) and a body as Markdown with line feeds and one line end behind."""
    lines = F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    whole = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), F.regexp_replace(text, "\r\n?", "\n"))
    return F.concat(F.rtrim(whole), F.lit("\n"))


def plain_value(value: Column) -> Column:
    """A header's value as it is written: on one line, in quotes where it would be read as something else; null as null."""
    line = F.regexp_replace(value, r"\s*[\r\n]+\s*", " ")
    odd = (line != F.trim(line)) | line.rlike(r"""^(['"]).*\1$|^,""") | (line == "")
    return F.coalesce(F.when(odd, F.concat(F.lit('"'), line, F.lit('"'))).otherwise(line), F.lit("null"))


def update_header(content: Column, changes: Column) -> Column:
    """content with some header fields changed (a map of strings; null writes null), and all else byte for byte as it was.

    A field is its line with the lines behind it up to the next field: lists, comments and lines of unknown form stay with
    it. Of a repeated key the last field holds and is the one rewritten. New keys come last, by name; a text without a
    header gets one. Values that the reader would take for null can't be told from it.
    """
    block = F.regexp_extract(content, HEADER, 1)
    items = F.filter(F.split(F.concat(block, F.lit("\n")), r"(?m)^(?=[A-Za-z_][\w-]*[ \t]*:)"), lambda x: x != "")
    key = lambda item: F.when(item.rlike(r"^[A-Za-z_][\w-]*[ \t]*:"), F.trim(F.substring_index(item, ":", 1)))
    line = lambda name: F.concat(name, F.lit(": "), plain_value(F.element_at(changes, name)), F.lit("\n"))

    def rewritten(item: Column, place: Column) -> Column:
        later = F.exists(F.slice(items, place + 2, F.size(items)), lambda other: key(other) == key(item))
        return F.when(F.map_contains_key(changes, F.coalesce(key(item), F.lit(""))) & ~F.coalesce(later, F.lit(False)), line(key(item))).otherwise(item)

    there = F.transform(F.filter(items, lambda item: key(item).isNotNull()), key)
    new = F.transform(F.array_sort(F.array_except(F.map_keys(changes), there)), line)
    inside = F.concat(F.array_join(F.transform(items, rewritten), ""), F.array_join(new, ""))
    has = content.rlike(HEADER)
    rest = F.when(has, F.substr(content, F.length(F.concat(F.lit("---\n"), block, F.lit("\n"))) + 1)).otherwise(F.concat(F.lit("---\n"), content))
    return F.when(F.size(changes) == 0, content).otherwise(F.concat(F.lit("---\n"), F.when(has, inside).otherwise(F.array_join(new, "")), rest))
