"""Language ID by compression: each language has a zstandard dictionary of raw content, and the smallest output wins.

Texts are folded first: lower case, letters only, single blanks. A language's dictionary is made of segments of folded
training texts, the most telling ones last, where matches are cheapest; no entropy tables, only content that matches can
point into. How telling a segment is, is the sum over its different words of p * log(p / q), with p the word's share of
the language's words in the sample and q its share of all. A text is compressed once per language with the same
parameters; the fewest bytes decide, and between equals (of a word or two) the language with more training rows. The
margin is the share of bytes by which the runner-up is larger; narrow margins are rejected.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, pieces

SAMPLE_ROWS = 400  # training rows of each language at most, with their whole texts
SEGMENT = 24  # words
DICTIONARY_BYTES = 96 << 10
MOST_LANGUAGES = 1000
MARGIN = 0.02
LEVEL = 5

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Lower-cased words of letters with one blank around each; empty if there are none."""
    words = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def _segments(sample: DataFrame) -> DataFrame:
    """lang, segment: the folded texts in runs of SEGMENT words, a blank before each word, equal ones once."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole, "text")):
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = fold(text).split()
                mine = ["".join(f" {w}" for w in words[k : k + SEGMENT]) for k in range(0, len(words), SEGMENT)]
                langs += [lang] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], ["lang", "segment"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, segment string").distinct()


def _best(segments: DataFrame, size: int) -> DataFrame:
    """lang, segment, telling of the most telling segments of each language, as many as fit into size bytes."""
    words = segments.select("lang", "segment", F.explode(F.array_distinct(F.split(F.ltrim("segment"), " "))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("of_lang"))
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("n_all"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("of_all")))  # one row
    p, q = F.col("n") / F.col("of_lang"), F.col("n_all") / F.col("of_all")
    weights = counts.join(everywhere, "word").join(totals, "lang").join(whole).select("lang", "word", (p * F.log(p / q)).alias("weight"))
    scored = words.join(weights, ["lang", "word"]).groupBy("lang", "segment").agg(F.round(F.sum("weight"), 12).alias("telling"))
    # A part of a language's segments at a time, then those that are left: no task sees all segments of a language.
    for by in (["lang", F.pmod(F.xxhash64("segment"), F.lit(64))], ["lang"]):
        upto = F.sum(F.octet_length("segment")).over(Window.partitionBy(*by).orderBy(F.desc("telling"), "segment"))
        scored = scored.withColumn("upto", upto).filter(F.col("upto") <= size).drop("upto")
    return scored


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Language -> dictionary, the most frequent language first, from columns text and lang of labelled; null texts and languages are passed over.

    The sample is bounded: per language at most `rows` different texts, those of least hash, so it depends on the rows
    alone; of these rows the whole texts are read. Of their segments the most telling that fit into `size` bytes reach
    the driver. More than MOST_LANGUAGES languages are refused. No usable rows give an empty model, under which every
    text is und; a language whose texts have no letters has no dictionary. Other columns are ignored.
    """
    usable = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    usable = usable.withColumn("draw", F.xxhash64("text").bitwiseAND(F.lit(2**53 - 1)))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    # Expect a few more rows than are wanted, so that few of a language's rows have to meet in one task.
    shares = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, (2 * rows + 50) / n) * (2**53 - 1)))))
    drawn = usable.filter(F.col("draw") <= shares[F.col("lang")]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    sample = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("place") <= rows)
    segments = materialise(_segments(sample), "segments")
    found: dict[str, list] = {}
    for r in _best(segments, size).collect():
        found.setdefault(r["lang"], []).append((r["telling"], r["segment"]))
    order = sorted(found, key=lambda lang: (-counts[lang], lang))
    return {lang: ("".join(s for _, s in sorted(found[lang])) + " ").encode() for lang in order}


class Classifier:
    """Compressors for the languages of a model; one for each Python worker."""

    def __init__(self, model: Mapping[str, bytes]):
        import zstandard as z

        self.languages = list(model)
        # Level 5 searches matches lazily; the levels below it miss short ones and confuse languages three times as often.
        parameters = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICTIONARY_BYTES, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for content in model.values():
            dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=parameters)
            self.compressors.append(z.ZstdCompressor(dict_data=dictionary, compression_params=parameters))

    def __call__(self, text: str | None, margin: float) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1, and whether the margin is wide enough."""
        folded = fold(text).encode()
        if not folded or not self.languages:
            return "und", 0.0, False
        sizes = [len(c.compress(folded)) for c in self.compressors]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        second = sizes[order[1]] if len(order) > 1 else 2 * best
        wide = (second - best) / second
        return self.languages[order[0]], min(1.0, 0.5 + 5 * wide), wide >= margin


def predict(docs: DataFrame, model: Mapping[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score and accepted; older columns of these names are replaced.

    lang_pred is the language of the smallest output even where the margin is narrow and accepted is false; it is und,
    with score 0, for texts that are null or have no letter, and for all texts under an empty model. Whole texts are
    compressed. An empty table stays empty.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    shared = docs.sparkSession.sparkContext.broadcast(dict(model))

    def run(batches):
        import pyarrow as pa

        judge = Classifier(shared.value)
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            found = [judge(t, margin) for t in batch.column("text").to_pylist()]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score", "accepted"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, f"{kinds}, lang_pred string, score double, accepted boolean")
