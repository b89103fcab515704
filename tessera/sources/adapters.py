"""The engine's model tables, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import table

AS_OF = "2024-02-01 00:00:00"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: first line as title, source as lane, lang as kind, both as tags."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("page_id"),
        F.split("text", "\n")[0].alias("title"),
        F.col("lang").alias("kind"),
        F.col("source").alias("lane"),
        F.array("lang", "source").alias("tags"),
        F.substring("text", 1, 200).alias("summary"),
        F.col("text").alias("body"),
        F.col("n_chars").alias("size"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document: page_id, line_no (from 1), line."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as captures: one per turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(":", "conv_id", "turn").alias("capture_id"), F.col("conv_id").cast("string").alias("task_id"), F.col("role").alias("actor"), "turn", F.col("text").alias("observation"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as observed claims: user as subject, type as predicate, a coarse value bucket as object."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.floor(F.col("value") / 250).cast("string").alias("object"),
        F.col("ts").alias("observed_at"),
        (F.col("event_id") % 3).cast("string").alias("actor"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, target: the section (first path segment) of every link of a page."""
    p = table(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", "href", F.split("href", "/")[1].alias("target"))


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct first path segments of page urls."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?#]*)", 1).alias("section")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, type: customers and suppliers located in nations, nations part of regions."""
    node = lambda prefix, column: F.concat(F.lit(prefix), F.col(column).cast("string"))
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return (
        c.select(node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target"), F.lit("located_in").alias("type"))
        .unionAll(s.select(node("s", "s_suppkey"), node("n", "s_nationkey"), F.lit("located_in")))
        .unionAll(n.select(node("n", "n_nationkey"), node("r", "n_regionkey"), F.lit("part_of")))
    )
