"""A training corpus from the documents table, in five stages; each is written as Parquet and reread by the next.

Every stage judges each row by its own text, null as empty, also where rows repeat a doc_id or have none, and gives an
empty table for an empty one. Columns besides those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dedup, piece_codec, quality
from tessera.llm.common import materialise, read
from tessera.llm.queries import held_out, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.7 or more; it learns from the labels that are not held out."""
    model = quality.fit(docs.filter(~held_out(4, 2)), read(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    return quality.keep_good(docs, model).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 50 words or more go; so do documents of which nothing, or only white space, is left by that.

    Texts that were empty, blank or null before stay, and so do rows without a doc_id, as they are.
    """
    out = line_dedup.line_dedup(docs.select(*COLUMNS))
    cut = F.size("removed_lines") > 0
    out = out.filter(~(cut & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (5-word shingles, Jaccard 0.8); texts without words are in no group and stay."""
    return near_dedup.near_dedup(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text under merge-dropout, and whether they decode to it: doc_id, lang, source, n_tokens, ids, lossless."""
    model = tokenizer_path("piece_bpe_32k.model")
    coded = piece_codec.round_trip(docs.select("doc_id", "text", "lang", "source"), model, seed=20, dropout=0.1)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: A classifier and a tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
