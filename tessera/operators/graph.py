"""Graphs of typed edges (source, target, type): degrees, neighbourhoods, paths, centrality, communities.

Loops run over hops, never over rows: each hop is a join of a frontier with the edges, cut from its lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import cut, discard


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join that shuffles both: in a loop, broadcast sides would go through the driver once a round."""
    return df.hint("merge")


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, type, direction."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type", F.lit("out").alias("direction"))
    return out.unionAll(edges.select(F.col("target"), F.col("source"), "type", F.lit("in")))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in, n_out."""
    rows = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return rows.groupBy("x.node").agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))


def link_graph(links: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct links (page_id, target) with whether the target is known (a column `section`)."""
    found = known.select(F.col("section").alias("target"), F.lit(True).alias("known")).distinct()
    return links.select("page_id", "target").distinct().join(found, "target", "left").select("page_id", "target", F.coalesce("known", F.lit(False)).alias("exists"))


def neighbours(edges: DataFrame, node: str, types: list[str] | None = None, direction: str | None = None) -> DataFrame:
    """other, type, direction around one node; filters reach the scan."""
    found = both_ways(edges if types is None else edges.filter(F.col("type").isin(types))).filter(F.col("node") == node)
    return (found if direction is None else found.filter(F.col("direction") == direction)).select("other", "type", "direction")


def reach(edges: DataFrame, start: str, hops: int) -> DataFrame:
    """node, hop: nodes within so many hops of start in either direction, with their distance."""
    steps = both_ways(edges).select("node", "other")
    frontier = edges.sparkSession.createDataFrame([(start, 0)], "node string, hop int")
    seen = frontier
    for hop in range(1, hops + 1):
        new = steps.join(frontier.select("node"), "node", "left_semi").select(F.col("other").alias("node")).distinct()
        frontier = cut(new.join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(hop)))
        seen = cut(seen.unionByName(frontier))
    return seen


def ego(edges: DataFrame, center: str, radius: int) -> DataFrame:
    """The edges between nodes within radius of center."""
    inside = reach(edges, center, radius).select("node")
    return edges.join(inside.withColumnRenamed("node", "source"), "source", "left_semi").join(inside.withColumnRenamed("node", "target"), "target", "left_semi")


def distances(steps: DataFrame, end: str, depth: int) -> DataFrame:
    """node, left: how many steps (node, other) it takes at least to reach the end, for nodes within depth; a search backwards."""
    frontier = steps.sparkSession.createDataFrame([(end, 0)], "node string, left int")
    known = frontier
    for left in range(1, depth + 1):
        new = steps.join(frontier.select(F.col("node").alias("other")), "other", "left_semi").select("node").distinct()
        frontier = cut(new.join(known.select("node"), "node", "left_anti").withColumn("left", F.lit(left)))
        if frontier.isEmpty():
            break
        known = cut(known.unionByName(frontier))
    return known


def paths(edges: DataFrame, start: str, end: str, depth: int, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Simple paths from start to end along the edges (of some types), of at most depth of them: path, hops.

    A path that has met the end isn't extended, and no path goes through a node twice. A search backwards comes first: a
    walk is gone on with only where its hops and those that are left at least are within the depth. With a limit the depth
    is raised from the shortest distance until there are enough paths, and of the walks of shortest paths, which can't
    meet a node twice, each node keeps `limit` ones: so a dense graph with many paths has few rows.
    """
    allowed = edges if types is None else edges.filter(F.col("type").isin(types))
    steps = cut(allowed.select(F.col("source").alias("node"), F.col("target").alias("other")).distinct())
    left = cut(distances(steps, end, depth))
    nearest = left.filter(F.col("node") == start).first()
    none = edges.sparkSession.createDataFrame([], "path string, hops int")
    if nearest is None or start == end:
        return none
    useful = cut(steps.join(left.withColumnRenamed("node", "other"), "other"))

    def walks(most: int, keep: int | None) -> DataFrame:
        frontier, found = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>"), none
        for hop in range(1, most + 1):
            grown = frontier.join(useful.filter(F.col("left") <= most - hop), "node").filter(~F.array_contains("path", F.col("other")))
            grown = grown.select(F.col("other").alias("node"), F.concat("path", F.array("other")).alias("path"))
            if keep is not None:
                place = F.row_number().over(Window.partitionBy("node").orderBy(F.array_join("path", ">")))
                grown = grown.withColumn("place", place).filter(F.col("place") <= keep).drop("place")
            grown = cut(grown)
            found = found.unionAll(grown.filter(F.col("node") == end).select(F.array_join("path", ">").alias("path"), F.lit(hop).alias("hops")))
            frontier = grown.filter(F.col("node") != end)
        return found

    if limit is None:
        return walks(depth, None)
    for most in range(nearest["left"], depth + 1):
        found = walks(most, limit if most == nearest["left"] else None)
        if most == depth or found.limit(limit).count() == limit:
            break
    return found.orderBy("hops", "path").limit(limit)


def first_paths(edges: DataFrame, start: str, depth: int, targets: DataFrame | None = None) -> DataFrame:
    """node, hops, steps (from, edge, to) of one shortest path along the edges from start to each node, or each of some targets (node).

    All targets share one search: a node keeps the least path by which it is first reached. A hop reads the edges of its
    frontier only, and a search that meets nothing new ends.
    """
    step = "struct<`from`:string,edge:string,to:string>"
    frontier = edges.sparkSession.createDataFrame([(start, 0, [])], f"node string, hops int, steps array<{step}>")
    seen = frontier
    for hop in range(1, depth + 1):
        moves = edges.filter(F.col("source") == start) if hop == 1 else edges.join(frontier.select(F.col("node").alias("source")), "source", "left_semi")
        moves = moves.select(F.col("source").alias("node"), F.col("target").alias("other"), "type")
        taken = F.concat("steps", F.array(F.struct(F.col("node").alias("from"), F.col("type").alias("edge"), F.col("other").alias("to"))))
        grown = frontier.join(moves, "node").select(F.col("other").alias("node"), taken.alias("steps"))
        new = grown.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("steps").alias("steps"))
        frontier = cut(new.select("node", F.lit(hop).alias("hops"), "steps"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    found = seen.filter("hops > 0")
    return found if targets is None else found.join(targets.select("node").distinct(), "node", "left_semi")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """node, centrality: distinct neighbours other than itself, over the number of other nodes."""
    pairs = both_ways(edges).filter("node <> other").select("node", "other")
    total = nodes(edges).agg(F.count("*").alias("n"))
    count = nodes(edges).join(merged(pairs.groupBy("node").agg(F.countDistinct("other").alias("k"))), "node", "left").join(F.broadcast(total))
    return count.select("node", F.round(F.when(F.col("n") > 1, F.coalesce("k", F.lit(0)) / (F.col("n") - 1)).otherwise(0.0), 6).alias("centrality"))


def truncate(edges: DataFrame, most: int) -> DataFrame:
    """The edges between the nodes of the highest degree."""
    top = degrees(edges).orderBy(F.desc(F.col("n_in") + F.col("n_out")), "node").limit(most).select("node")
    return edges.join(top.withColumnRenamed("node", "source"), "source", "left_semi").join(top.withColumnRenamed("node", "target"), "target", "left_semi")


ID_TURNS = 32


def communities(edges: DataFrame) -> DataFrame:
    """node, community by asynchronous label propagation in rounds; a community is named by its least member.

    A node wants the label most frequent among its neighbours, the least of tied ones. Of the nodes that want another
    label, those that come before all their neighbours that want one change in this round. So neighbours never change
    together, and a round is the same as its changes one after the other. Each change makes more edges agree, or as many
    with a lesser label, so every graph settles, after finitely many rounds and without a cap on them. For the first
    ID_TURNS rounds nodes that have changed less often come first, then lesser ids, as if nodes took turns; then the order
    is that of a hash keyed by the round, under which long chains of ids don't wait for one another. Nodes without
    neighbours stay alone.
    """
    steps = cut(both_ways(edges).filter("node <> other").select("node", "other").distinct())
    labels, turn = cut(nodes(edges).select("node", F.col("node").alias("label"), F.lit(0).alias("moves"))), 0
    while True:
        votes = steps.join(merged(labels.select(F.col("node").alias("other"), "label")), "other").groupBy("node", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x")).select("node", F.col("x.label").alias("best"))
        order = F.lpad(F.col("moves").cast("string"), 9, "0") if turn < ID_TURNS else F.md5(F.concat_ws(":", F.lit(str(turn)), "node"))
        rank = F.struct(order.alias("order"), "node")
        wanting = cut(best.join(merged(labels), "node").filter("best <> label").select("node", "best", rank.alias("rank")))
        if wanting.isEmpty():
            break
        around = steps.join(merged(wanting.select("node", "rank")), "node").groupBy(F.col("other").alias("node")).agg(F.min("rank").alias("least"))
        first = wanting.join(merged(around), "node", "left").filter(F.col("least").isNull() | (F.col("rank") < F.col("least")))
        before, labels = labels, cut(labels.join(merged(first.select("node", "best")), "node", "left").select("node", F.coalesce("best", "label").alias("label"), (F.col("moves") + F.col("best").isNotNull().cast("int")).alias("moves")))
        discard(before, wanting)
        turn += 1
    names = labels.groupBy("label").agg(F.min("node").alias("community"))
    return labels.join(merged(names), "label").select("node", "community")


def betweenness(edges: DataFrame, sources: int = 20, exact_below: int = 50) -> DataFrame:
    """node, betweenness (Brandes, 2001) by levels: all sources in small graphs, else the first ones by id, scaled up.

    Shortest-path counts go out level by level and dependencies come back the same way, for all sources at once.
    """
    steps = cut(both_ways(edges).filter("node <> other").select("node", "other").distinct())
    all_nodes = cut(nodes(edges))
    n = all_nodes.count()
    chosen = all_nodes if n < exact_below else all_nodes.orderBy("node").limit(sources)
    k = min(n, n if n < exact_below else sources)
    level = cut(chosen.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    seen, levels = level, [level]
    while True:
        grown = level.join(merged(steps), "node").groupBy("start", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"), (F.max("depth") + 1).alias("depth"))
        level = cut(grown.join(merged(seen.select("start", "node")), ["start", "node"], "left_anti").select("start", "node", "depth", "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut(seen.unionByName(level))
    back = levels[-1].select("start", "node", "paths", F.lit(0.0).alias("gain"))
    total = None
    for upper in reversed(levels[:-1]):
        share = back.select("start", F.col("node").alias("other"), ((1 + F.col("gain")) / F.col("paths")).alias("share"))
        gain = upper.join(merged(steps), "node").join(merged(share), ["start", "other"]).groupBy("start", "node").agg(F.sum(F.col("paths") * F.col("share")).alias("gain"))
        here = back.filter("node <> start").select("node", "gain")
        total = here if total is None else total.unionAll(here)
        back = cut(upper.join(merged(gain), ["start", "node"], "left").select("start", "node", "paths", F.coalesce("gain", F.lit(0.0)).alias("gain")))
    scale = (n / k if k else 1.0) / 2 * (2 / ((n - 1) * (n - 2)) if n > 2 else 0.0)
    sums = total.groupBy("node").agg(F.sum("gain").alias("gain")) if total is not None else all_nodes.select("node", F.lit(0.0).alias("gain"))
    return all_nodes.join(merged(sums), "node", "left").select("node", F.round(F.coalesce("gain", F.lit(0.0)) * scale, 6).alias("betweenness"))


CELLS = 1 << 21  # pairs of a source and a node that a task holds at once


def _dependencies(first: np.ndarray, other: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """What shortest paths from some sources give each node (Brandes, 2001); the neighbours of k are other[first[k] : first[k + 1]].

    All sources go out level by level together, and back the same way; a cell is a source's place times the nodes plus a node.
    """
    n, degree = len(first) - 1, np.diff(first)
    paths, seen, slot = np.zeros(len(sources) * n), np.zeros(len(sources) * n, bool), np.empty(len(sources) * n, np.int64)
    roots = at = np.arange(len(sources)) * n + sources
    paths[at], seen[at] = 1.0, True
    levels = []
    while len(at):
        node = at % n
        counts = degree[node]
        of = np.repeat(np.arange(len(at)), counts)
        to = (at - node)[of] + other[np.arange(len(of)) + (first[node] - np.cumsum(counts) + counts)[of]]
        new = np.flatnonzero(~seen[to])
        of, to = of[new], to[new]
        levels.append((at, of, to))
        place = np.arange(len(to))
        slot[to] = place
        one = slot[to]  # of equal cells the last one's place
        sums, last = np.bincount(one, paths[at][of], len(to)), one == place
        at = to[last]
        paths[at], seen[at] = sums[last], True
    gain = np.zeros(len(sources) * n)
    for at, of, to in reversed(levels):
        gain[at] = np.bincount(of, (1 + gain[to]) / paths[to], len(at)) * paths[at]
    gain[roots] = 0.0
    return gain.reshape(len(sources), n).sum(axis=0)


def betweenness_exact(edges: DataFrame, cells: int = CELLS) -> DataFrame:
    """node, betweenness with every node as a source, whatever the graph's size.

    The nodes are dealt over tasks as sources. A task has the whole graph, as numbers of 8 bytes, and `cells` cells at once
    (or one source), so its memory grows with the graph alone; its work is the sources times the edges, as exactness asks.
    """
    spark = edges.sparkSession
    numbered = cut(nodes(edges).withColumn("id", F.monotonically_increasing_id()))
    n = numbered.count()
    near = both_ways(edges).filter("node <> other").select("node", "other").distinct()
    ids = near.join(merged(numbered), "node").select(F.col("id").alias("a"), F.col("other").alias("node")).join(merged(numbered), "node").select("a", F.col("id").alias("b"))

    def pack(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns], ["a", "b"])

    steps = cut(ids.mapInArrow(pack, "a binary, b binary"))
    tasks = max(1, min(n, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        import pyarrow as pa

        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))]
        if not rows:
            return
        a, b = (np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) for k in (1, 2))
        names, a = np.unique(a, return_inverse=True)
        order = np.lexsort((b, a))
        first, other = np.searchsorted(a[order], np.arange(len(names) + 1)), np.searchsorted(names, b[order])
        mine, block = np.arange(rows[0][0], len(names), tasks), max(1, cells // len(names))
        gain = np.zeros(len(names))
        for k in range(0, len(mine), block):
            gain += _dependencies(first, other, mine[k : k + block])
        some = np.flatnonzero(gain)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(gain[some])], ["id", "gain"])

    whole = spark.range(0, tasks, 1, tasks).withColumnRenamed("id", "task").join(steps.coalesce(1).hint("shuffle_replicate_nl"))
    sums = whole.mapInArrow(run, "id long, gain double").groupBy("id").agg(F.sum("gain").alias("gain"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return numbered.join(merged(sums), "id", "left").select("node", F.round(F.coalesce("gain", F.lit(0.0)) * scale, 6).alias("betweenness"))


def entry_points(edges: DataFrame, limit: int = 5) -> DataFrame:
    """Nodes by degree centrality plus the share of communities that they border on."""
    edges = cut(edges)
    label = cut(communities(edges))
    total = label.agg(F.countDistinct("community").alias("n"))
    near = both_ways(edges).filter("node <> other").join(merged(label.withColumnRenamed("node", "other")), "other").groupBy("node").agg(F.countDistinct("community").alias("k"))
    both = degree_centrality(edges).join(merged(near), "node", "left").join(F.broadcast(total))
    score = F.round(F.col("centrality") + F.coalesce("k", F.lit(0)) / F.col("n"), 6)
    return both.select("node", score.alias("score")).orderBy(F.desc("score"), "node").limit(limit)


def top_nodes(metrics: DataFrame, metric: str, k: int = 10) -> DataFrame:
    """The nodes of the greatest metric, ties by node."""
    return metrics.orderBy(F.desc(metric), "node").limit(max(0, k))


def analytics(edges: DataFrame) -> DataFrame:
    """node, centrality, betweenness, community of every node."""
    edges = cut(edges)
    return degree_centrality(edges).join(merged(betweenness_exact(edges)), "node").join(merged(communities(edges)), "node")


def best_paths_per_node(walks: DataFrame, most: int = 3) -> DataFrame:
    """The first paths of each node by hops, then score."""
    order = Window.partitionBy("node").orderBy("hops", F.desc("score"), "path")
    return walks.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
