"""Filter interaction audit: what each of several filters removes in every order in which they can be applied.

Whole texts are scanned in Arrow's own buffers: NumPy byte classes and their prefix sums count code points, words,
capitals and symbols; sorted word hashes, whose equals are compared byte by byte, count distinct words. Each row becomes a
bit mask of the filters that it fails. Only counts of masks are left after that, and every figure is a sum over masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

STRETCH = 1 << 18  # bytes scanned at once
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_CAPITAL, _SYMBOL, _BLANK, _LEAD = 1, 2, 4, 8


@dataclass(frozen=True)
class Rules:
    """The filters A to D fail a text under few_words words, with distinct words under a share of all (percent), with
    capitals over a share of the code points (percent), and with any of the symbols. E fails a repeated text."""

    few_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    symbols: str = "#$%&*|"


FILTERS = "ABCDE"
STATISTICS = ("chars", "words", "distinct_words", "capitals", "symbols")


def byte_classes(symbols: str) -> np.ndarray:
    """The class bits of every byte: capital, symbol, blank, first of a code point."""
    kinds = np.zeros(256, np.uint8)
    kinds[65:91] |= _CAPITAL
    kinds[np.frombuffer(symbols.encode("ascii"), np.uint8)] |= _SYMBOL
    kinds[[0x20, *range(0x09, 0x0E)]] |= _BLANK
    kinds[[b for b in range(256) if b & 0xC0 != 0x80]] |= _LEAD
    return kinds


def _powers(multiplier: int, n: int) -> np.ndarray:
    """multiplier ** 0 .. n, modulo 2 ** 64."""
    out = np.full(n + 1, multiplier, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Statistics of many texts at once, over one buffer of bytes."""

    def __init__(self, symbols: str = Rules.symbols, stretch: int = STRETCH, multiplier: int = _MULTIPLIER):
        self.kinds, self.stretch = byte_classes(symbols), stretch
        self.powers = _powers(multiplier, stretch)
        self.inverse = _powers(pow(multiplier, -1, 1 << 64), stretch)

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial over the bytes of each word and its length, from prefix sums over the stretch; wraps at 2 ** 64."""
        if len(data) >= len(self.powers):  # one word longer than a stretch
            return np.array([hash(data[a:b].tobytes()) & (2**64 - 1) for a, b in zip(starts, ends)], np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * self.inverse[starts]
        return (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64)

    def words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end; a word ends at a cut too."""
        inside = np.empty(len(data) + 1, bool)
        inside[-1] = False
        np.equal(self.kinds[data] & _BLANK, 0, out=inside[:-1])
        edge = np.empty(len(data) + 1, bool)
        edge[0] = True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:])
        edge[cuts] = True
        places = np.flatnonzero(edge)
        a = places[:-1]
        begins = inside[a]
        return a[begins], places[1:][begins]

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """Distinct words of each of n texts: sorted hashes, and equal ones beside each other compared byte by byte."""
        if not len(starts):
            return np.zeros(n, np.int64)
        hashes = self._hashes(data, starts, ends)
        order = np.lexsort((starts, hashes, texts))
        h, t = hashes[order], texts[order]
        same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
        new = np.concatenate(([True], ~same))
        counts = np.bincount(t[new], minlength=n)
        pairs = np.flatnonzero(same)
        a, b = order[pairs], order[pairs + 1]
        length = ends[a] - starts[a]
        unlike = length != ends[b] - starts[b]
        alike = np.flatnonzero(~unlike)
        # All bytes of the pairs of one length are compared at once.
        for size in np.unique(length[alike]).tolist():
            at = alike[length[alike] == size]
            for k in range(0, len(at), max(1, (1 << 20) // size)):
                some = at[k : k + max(1, (1 << 20) // size)]
                offset = np.arange(size)
                unlike[some] = (data[starts[a[some]][:, None] + offset] != data[starts[b[some]][:, None] + offset]).any(axis=1)
        for text in np.unique(t[pairs[unlike]]).tolist():  # hashes that collide: count the words themselves
            mine = texts == text
            counts[text] = len({data[x:y].tobytes() for x, y in zip(starts[mine], ends[mine])})
        return counts

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Statistics of the texts data[offsets[i]:offsets[i + 1]], each of a stretch at most."""
        n = len(offsets) - 1
        kinds = self.kinds[data]

        def count(bit: int) -> np.ndarray:
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(kinds & bit != 0, out=sums[1:])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        starts, ends = self.words(data, offsets)
        texts = np.searchsorted(offsets, starts, side="right") - 1
        found = {"chars": count(_LEAD), "capitals": count(_CAPITAL), "symbols": count(_SYMBOL)}
        found["words"] = np.bincount(texts, minlength=n)
        found["distinct_words"] = self.distinct(data, starts, ends, texts, n)
        return found

    def scan_long(self, data: np.ndarray) -> dict[str, int]:
        """Statistics of one text of any length, a stretch at a time; held are its distinct words only."""
        total, seen, at = dict.fromkeys(STATISTICS, 0), set(), 0
        while at < len(data):
            end = min(at + self.stretch, len(data))
            if end < len(data):  # a stretch ends behind a blank, or at the end of a word that is longer than it
                blanks = np.flatnonzero(self.kinds[data[at:end]] & _BLANK)
                if len(blanks):
                    end = at + int(blanks[-1]) + 1
                while end < len(data) and not self.kinds[data[end - 1]] & _BLANK:
                    after = np.flatnonzero(self.kinds[data[end : end + self.stretch]] & _BLANK)
                    end = end + int(after[0]) + 1 if len(after) else min(end + self.stretch, len(data))
            piece = data[at:end]
            kinds = self.kinds[piece]
            starts, ends = self.words(piece, np.array([0, len(piece)]))
            total["words"] += len(starts)
            for name, bit in (("chars", _LEAD), ("capitals", _CAPITAL), ("symbols", _SYMBOL)):
                total[name] += int(np.count_nonzero(kinds & bit))
            seen.update(piece[a:b].tobytes() for a, b in zip(starts, ends))
            at = end
        return total | {"distinct_words": len(seen)}


def column_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column's own bytes and its offsets; null is empty."""
    import pyarrow as pa

    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def column_statistics(column, scanner: Scanner) -> dict[str, np.ndarray]:
    """STATISTICS of every text of an Arrow column, a stretch of whole texts at a time."""
    data, offsets = column_buffer(column)
    n, at = len(offsets) - 1, 0
    out = {name: np.zeros(n, np.int64) for name in STATISTICS}
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + scanner.stretch, side="right")) - 1)
        piece = data[offsets[at] : offsets[end]]
        found = scanner.scan(piece, offsets[at : end + 1] - offsets[at]) if len(piece) < scanner.stretch else scanner.scan_long(piece)
        for name in STATISTICS:
            out[name][at:end] = found[name]
        at = end
    return out


def _scanned(batches: Iterator, rules: Rules) -> Iterator:
    import pyarrow as pa

    scanner = Scanner(rules.symbols)
    for batch in batches:
        found = column_statistics(batch.column("text"), scanner)
        rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(found[s]) for s in STATISTICS)], [*names, *STATISTICS])


def text_statistics(docs: DataFrame, symbols: str = Rules.symbols) -> DataFrame:
    """STATISTICS of every text, and its sha256 as `digest`, beside `row`, a struct of the other columns.

    Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, case-sensitive; null counts as empty.
    """
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(None).cast("int").alias("none"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row.alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    schema = rows.select("row", "digest", *(F.lit(0).cast("long").alias(s) for s in STATISTICS)).schema
    rules = Rules(symbols=symbols)
    return rows.mapInArrow(lambda it: _scanned(it, rules), schema)


def _masks(docs: DataFrame, rules: Rules) -> DataFrame:
    """part, doc_id, digest and a mask of the filters A to D (bit k for the k-th), with n equal rows."""
    one = text_statistics(docs.select("doc_id", "source", "text"), rules.symbols)
    fails = (
        F.col("words") < rules.few_words,
        100 * F.col("distinct_words") < rules.distinct_percent * F.col("words"),
        100 * F.col("capitals") > rules.capital_percent * F.col("chars"),
        F.col("symbols") > 0,
    )
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    part = F.coalesce(F.col("row.source").cast("string"), F.lit(""))
    return one.select(part.alias("part"), F.col("row.doc_id").cast("long").alias("doc_id"), "digest", mask.alias("mask")).groupBy("part", "doc_id", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def mask_counts(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(part, mask, n, good, toxic): rows that fail exactly the filters of a mask, E included, and those labelled so.

    Rows of one text differ in their mask in E alone, so of each text only the rows of its least doc_id are looked up, by
    (digest, doc_id): a text that a third of all rows share is no hot key. A row without doc_id is no repeat, and none of
    it; a doc_id labelled twice counts as good, or toxic, if one of its labels says so.
    """
    rows = materialise(_masks(docs, rules), "audit-masks")
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(new) for c, new in (("quality", "good"), ("toxic", "bad"))]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(*marks).filter("good = 1 or bad = 1")
    unique = rows.join(first, ["digest", "doc_id"], "left_semi")

    def counted(some: DataFrame, sign: int, bit: int) -> list[DataFrame]:
        key = ["part", (F.col("mask") + bit).alias("mask")]
        n = some.groupBy(*key).agg(F.sum(F.col("n") * sign).alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
        marked = some.join(known, "doc_id").groupBy(*key).agg(
            F.lit(0).cast("long").alias("n"), F.sum(F.col("n") * F.col("good") * sign).alias("good"), F.sum(F.col("n") * F.col("bad") * sign).alias("toxic")
        )
        return [n, marked]

    repeat = 1 << FILTERS.index("E")
    tables = [*counted(rows.filter("doc_id is not null"), 1, repeat), *counted(unique, -1, repeat), *counted(unique, 1, 0), *counted(rows.filter("doc_id is null"), 1, 0)]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic"))).filter("n > 0")


def audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row for each part (value of source; null: empty), order of the five filters and step.

    kept, removed: rows left after the step, and removed in it; redundant: rows that fail its filter but were removed
    before; unique_fails: rows that fail this filter only; good_lost, toxic_lost: rows removed here that labels mark;
    shapley: rows that this filter removes, summed over all orders. Empty texts have no word and fail A; null texts are
    empty. An empty table has no part. Columns besides doc_id, text and source don't matter.
    """
    counts = mask_counts(docs, labels, rules).withColumn("mask", F.col("mask").cast("int"))
    held = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("counts"))  # 32 masks at most
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = held.select("part", "counts", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    letter = F.expr("substring(filter_order, step, 1)")
    one = before = F.lit(0)
    for k, name in enumerate(FILTERS):
        one = F.when(letter == name, 1 << k).otherwise(one)
        before = before + F.when(F.expr(f"instr(filter_order, '{name}') < step"), 1 << k).otherwise(0)
    steps = steps.withColumn("this", one).withColumn("gone", before)

    def total(value: str, holds) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + F.when(holds(c["mask"]), c[value]).otherwise(0))

    fails, survived = lambda m: m.bitwiseAND(F.col("this")) != 0, lambda m: m.bitwiseAND(F.col("gone")) == 0
    removed_here = lambda m: fails(m) & survived(m)
    # Of the orders of five filters, the share in which this one comes before the mask's others is one in their number.
    shapley = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + F.when(fails(c["mask"]), c["n"] * F.lit(len(orders)) / F.bit_count(c["mask"])).otherwise(0).cast("long"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: survived(m) & ~fails(m)).alias("kept"),
        total("n", removed_here).alias("removed"),
        total("n", lambda m: fails(m) & ~survived(m)).alias("redundant"),
        total("n", lambda m: m == F.col("this")).alias("unique_fails"),
        total("good", removed_here).alias("good_lost"),
        total("toxic", removed_here).alias("toxic_lost"),
        shapley.alias("shapley"),
    )
