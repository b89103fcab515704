"""The queries opN_<name>: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_format, decontaminate, fill_middle, filter_audit, fingerprints, language_id, line_dedup, near_dedup, oracles, piece_codec, quality, token_files, toxicity, url_filters
from tessera.llm.common import read

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def held_out(modulus: int, rest: int):
    """Whether crc32 of doc_id as text leaves that rest; rows without a doc_id are held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(True))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return fingerprints.edit_report(read(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the texts that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(~held_out(5, 0)).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "accepted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs.filter(~held_out(4, 2)), read(spark, sf_dir, "labels").filter(~held_out(4, 2)))
    return quality.score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with merge-dropout and decoded again."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_path("piece_bpe_32k.model")
    coded = piece_codec.round_trip(docs, model, seed=20, dropout=0.1)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) where the document holds at least 80 % of the item's 5-word shingles."""
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files, read back from them."""
    return token_files.read_token_files(token_files.write_token_files(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document: lines before and after, the deleted ones, and the digest of the rest."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.line_dedup(docs.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ODD_CHAT = r"\### Assistant: </turn> ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts imitate the template, formatted and read back."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", ODD_CHAT), (-7, 1, "assistant", ODD_CHAT)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(odd)))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filters.judge_pages(read(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document, over sets of 4-word shingles at 0.8."""
    groups = near_dedup.near_components(read(spark, sf_dir, "documents"), shingle=4, percent=80)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its middle last, where it was cut, and the text restored from that."""
    out = fill_middle.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learned from the labels that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs.filter(~held_out(5, 0)), read(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    return toxicity.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_document_fingerprints, op2_language_id, op3_quality_classifier, op4_sentencepiece, op5_benchmark_decontamination, op6_token_files, op7_line_dedup, op8_chat_formatting, op9_url_filters, op10_minhash_near_dedup, op11_fill_in_middle, op12_filter_audit, op13_toxicity)
}
ORACLES: dict[str, str] = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
