"""Connected components by alternating large and small stars over DataFrames (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise


def _both(edges: DataFrame, largest: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both if largest else both.filter("v < u")


def _least(edges: DataFrame, largest: bool) -> DataFrame:
    """u, m: each node's least neighbour, or itself."""
    return _both(edges, largest).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _pull(edges: DataFrame, least: DataFrame, largest: bool) -> DataFrame:
    """One star step over edges (u, v): every u hands its least neighbour to the others.

    `least` is read from a table: both sides of the join are plain exchanges, so a hot node is split at run time.
    """
    joined = _both(edges, largest).join(least, "u")
    if largest:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Each node of the undirected edges (u, v) with the least node that it reaches: columns node, root.

    Nulls and self-loops are ignored; nodes without an edge to another node don't appear; no edges give no rows. Only
    counts and checksums reach the driver. Raises if `rounds` don't suffice (each round shrinks path lengths by a
    constant factor, so 60 rounds cover any graph that fits on disk).
    """
    now = materialise(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or not mark[0]:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = mark
        for largest, what in ((True, "large-star"), (False, "small-star")):
            least = materialise(_least(now, largest), what)
            before, now = now, materialise(_pull(now, least, largest), "edges")
            discard(before, least)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
