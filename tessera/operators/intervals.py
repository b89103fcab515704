"""Joins of intervals in time, whose work follows the pairs found and not the size of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import cut

PLAIN = 1_000  # rows of b that a key may have to be joined as it is
HOUR = 3_600_000_000  # microseconds
LEVELS = 10  # of a tree with four children a node, over 4 ** LEVELS hours
_LEVEL = 1 << 40


def _place(time: Column, low: Column) -> Column:
    """The hour of a time since `low`, held inside the tree."""
    return F.greatest(F.lit(0), F.least(F.lit(4**LEVELS - 1), F.floor(time / HOUR) - low)).cast("long")


def ancestors(hour: Column) -> Column:
    """All nodes above an hour, itself included."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: k.cast("long") * _LEVEL + F.floor(hour / F.pow(F.lit(4), k)).cast("long"))


def cover(first: Column, last: Column) -> Column:
    """The fewest nodes that make up the hours first to last; every hour in between has exactly one of them above it."""

    def step(acc: Column, k: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        from_left = F.least(hi, F.ceil(lo / 4) * 4)
        from_right = F.greatest(from_left, F.floor(hi / 4) * 4)
        nodes = lambda a, b: F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda n: k.cast("long") * _LEVEL + n)).otherwise(F.array().cast("array<bigint>"))
        top = k == LEVELS
        left, right = F.when(top, hi).otherwise(from_left), F.when(top, hi).otherwise(from_right)
        done = F.concat(acc["nodes"], nodes(lo, left), nodes(right, hi))
        return F.struct(F.floor(left / 4).cast("long").alias("lo"), F.floor(right / 4).cast("long").alias("hi"), done.alias("nodes"))

    start = F.struct(first.cast("long").alias("lo"), (last + 1).cast("long").alias("hi"), F.array().cast("array<bigint>").alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda acc: acc["nodes"])


def _unlike(value: Column, flip: bool) -> Column:
    """Keys such that values whose hashes differ in their first eight bits share exactly one of a's and b's: the place of
    the first bit that differs, with the bits up to there, the last one turned round on one side; the last is for equal bits."""
    bits = F.shiftrightunsigned(F.xxhash64(value), 56).cast("int")

    def key(d: Column) -> Column:
        head = F.floor(bits / F.pow(F.lit(2), 7 - d)).cast("int")
        return F.when(d == 8, bits + 100_000).otherwise((d + 1) * 1_000 + (head.bitwiseXOR(F.lit(1)) if flip else head))

    return F.transform(F.sequence(F.lit(0), F.lit(8)), key)


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], differs: str, plain: int = PLAIN) -> DataFrame:
    """Pairs of rows of a and b (columns prefixed a_ and b_) with equal keys, different values of `differs` and
    a.begin < b.end and b.begin < a.end; begin and end are microseconds.

    A key with few rows of b is joined as it is. Of others, either the begin of a lies in b or that of b in a: a begin
    meets an interval in the one node of a tree over time that covers its hour, and values that differ in the one key of
    the first bit of their hashes that differs. So pairs are joined that hold, but for those that share an hour or, one in
    256, the first bits of a hash; a hot key is spread over time and values.
    """
    keys = list(keys)
    named = lambda df, s: df.withColumnsRenamed({c: f"{s}_{c}" for c in df.columns if c not in keys})
    holds = (F.col("a_begin") < F.col("b_end")) & (F.col("b_begin") < F.col("a_end")) & (F.col(f"a_{differs}") != F.col(f"b_{differs}"))
    hot = cut(b.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > plain).select(*keys))
    few = lambda df: df.join(hot, keys, "left_anti")
    out = named(few(a), "a").join(named(few(b), "b"), keys).filter(holds)
    if hot.isEmpty():
        return out
    x, y = (df.join(hot, keys, "left_semi") for df in (a, b))
    begins = x.select("begin").unionByName(y.select("begin")).filter(F.abs("begin") < 2**59)
    low = F.lit(begins.agg(F.coalesce(F.floor(F.min("begin") / HOUR), F.lit(0))).first()[0])

    def spread(df: DataFrame, side: str, interval: bool, flip: bool) -> DataFrame:
        begin, end = _place(F.col("begin"), low), _place(F.greatest(F.col("end") - 1, F.col("begin")), low)
        nodes = cover(begin, end) if interval else ancestors(begin)
        one = df.withColumn("_node", F.explode(nodes)).withColumn("_bits", F.explode(_unlike(F.col(differs), flip)))
        return one.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c not in keys})

    on = [*keys, "_node", "_bits"]
    a_in_b = spread(x, "a", False, True).join(spread(y, "b", True, False), on).filter(F.col("b_begin") <= F.col("a_begin"))
    b_in_a = spread(x, "a", True, True).join(spread(y, "b", False, False), on).filter(F.col("b_begin") > F.col("a_begin"))
    return out.unionByName(a_in_b.unionByName(b_in_a).filter(holds).drop("_node", "_bits"))
