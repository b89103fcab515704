"""Rank fusion and retrieval measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import rrf
from tessera.functions.text import compact, token_estimate
from tessera.operators.graph import best_paths_per_node, both_ways
from tessera.operators.links import ENTITY_TYPES
from tessera.sources.storage import cut


def ranked(results: DataFrame, name: str) -> DataFrame:
    """page_id and its rank by score; results are cut to a few rows before, so one ordered window does."""
    return results.select("page_id", F.row_number().over(Window.orderBy(F.desc("score"), "page_id")).alias(name))


def reciprocal_rank_fusion(lexical: DataFrame, vector: DataFrame, limit: int = 10, weights: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """page_id, lexical_rank, vector_rank, score over two cut result lists."""
    both = ranked(lexical, "lexical_rank").join(ranked(vector, "vector_rank"), "page_id", "full_outer")
    score = F.coalesce(rrf(F.col("lexical_rank"), weights[0]), F.lit(0.0)) + F.coalesce(rrf(F.col("vector_rank"), weights[1]), F.lit(0.0))
    return both.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "page_id").limit(limit)


def graph_boost(fused: DataFrame, edges: DataFrame, weight: float = 0.2, share: float = 0.1) -> DataFrame:
    """Pages that results link to gain a share of the linking result's score."""
    gained = edges.join(fused.select(F.col("page_id").alias("source"), "score"), "source").groupBy(F.col("target").alias("page_id")).agg(F.sum(F.col("score") * share * weight).alias("gain"))
    return fused.select("page_id", "score").join(gained, "page_id", "full_outer").select("page_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)), 6).alias("score"))


def measures(results: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, f1, reciprocal_rank at k. results: query_id, doc_id, rank; relevant: query_id, doc_id."""
    top = results.filter(F.col("rank") <= k)
    found = top.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    per_query = found.groupBy("query_id").agg(F.count("*").alias("n_found"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    both = wanted.join(per_query, "query_id", "left").na.fill(0, ["n_found", "n_hits"])
    precision = F.when(F.col("n_found") > 0, F.col("n_hits") / F.col("n_found")).otherwise(0.0)
    recall = F.col("n_hits") / F.col("n_relevant")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return both.select("query_id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("reciprocal_rank"))


def means(measured: DataFrame) -> DataFrame:
    """n_queries and the mean of each measure over queries; 0 for none."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}")
    return measured.agg(F.count("*").alias("n_queries"), *(mean(c) for c in ("precision", "recall", "f1", "reciprocal_rank")))


OUTGOING, INCOMING, GRAPH_WEIGHT = 0.85, 0.65, 0.2


def expand(hits: DataFrame, edges: DataFrame, nodes: DataFrame, hops: int = 2, types: Sequence[str] | None = None, limit: int = 10, most: int = 3) -> DataFrame:
    """page_id, score, n_paths, path, paths, entities, because: search hits and the pages that edges lead to from them.

    hits: page_id, score, cut to a few before. A path's score is its hit's, times 0.85 for each edge along its direction
    and 0.65 for each against. A node is gone on from once, when it is first reached, over its best path (score, then
    hit, then path); pages are recorded each time that they are reached. A page gains 0.2 of its best path; one that is
    no hit has the best path's score besides. paths: the `most` first ones, each with the hit that it comes from, by edges,
    then score; path: the first of them; entities: what is no page on its paths.
    """
    chosen = cut((edges.filter(F.col("type").isin(*types)) if types else edges).select("source", "target", "type"))  # of other types no edge is made
    both = both_ways(chosen).select("node", "other", F.col("type").alias("edge"), F.when(F.col("direction") == "out", OUTGOING).otherwise(INCOMING).alias("decay"))
    seeds = cut(hits.select(F.col("page_id").alias("node"), F.col("page_id").alias("hit"), "score"))
    frontier = seeds.withColumn("path", F.lit("")).withColumn("entities", F.array().cast("array<string>"))
    seen, reached = seeds.select("node"), None
    for hop in range(1, hops + 1):
        met = cut(frontier.join(both, "node"))
        kinds = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type")).join(met.select("other").distinct(), "other", "left_semi")
        step = met.join(kinds, "other", "left")
        kind = F.coalesce("other_type", F.lit("page"))
        text = F.concat_ws(" -> ", F.nullif("path", F.lit("")), F.concat_ws(" -> ", "edge", kind))
        entities = F.when(kind.isin(*ENTITY_TYPES), F.array_union("entities", F.array("other"))).otherwise(F.col("entities"))
        found = cut(step.select(F.col("other").alias("node"), "hit", (F.col("score") * F.col("decay")).alias("score"), text.alias("path"), entities.alias("entities"), "other_type", F.lit(hop).alias("hops")))
        reached = found if reached is None else reached.unionAll(found)
        new = found.join(seen, "node", "left_anti")
        order = F.struct((-F.col("score")).alias("s"), "hit", "path", "entities")
        frontier = cut(new.groupBy("node").agg(F.min(order).alias("x")).select("node", "x.hit", (-F.col("x.s")).alias("score"), "x.path", "x.entities"))
        seen = cut(seen.unionAll(frontier.select("node")))
    is_hit = F.col("base").isNotNull()
    first = F.min(F.struct("hops", (-F.col("score")).alias("s"), "hit", "path"))["path"]
    gains = reached.groupBy(F.col("node").alias("page_id")).agg(F.max("score").alias("best"), F.count("*").alias("n_paths"), first.alias("path"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities"), F.max("other_type").alias("type"))
    leading = best_paths_per_node(reached.select(F.col("node"), "hops", "score", F.concat_ws(": ", "hit", "path").alias("path")).distinct(), most)
    told = leading.groupBy(F.col("node").alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]), " | ").alias("paths"))
    gains = gains.join(told, "page_id")
    rows = gains.join(hits.select("page_id", F.col("score").alias("base")), "page_id", "full_outer").filter(is_hit | (F.col("type") == "page"))
    best = F.coalesce("best", F.lit(0.0))
    because = F.concat_ws("; ", F.when(is_hit, "direct text match"), F.when(F.col("path").isNotNull(), F.concat(F.lit("reachable via: "), "path")))
    scored = rows.select("page_id", F.round(F.coalesce("base", best) + best * GRAPH_WEIGHT, 6).alias("score"), F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "path", "paths", F.array_join(F.coalesce("entities", F.array().cast("array<string>")), ",").alias("entities"), because.alias("because"))
    return scored.orderBy(F.desc("score"), "page_id").limit(limit)


def enrichment(results: DataFrame, claims: DataFrame, traces: DataFrame) -> DataFrame:
    """page_id, relation (supports, contradicts, trace, decision), ref_id: what the ledger holds about result pages, a row each."""
    live = claims.filter("status in ('candidate', 'active') and candidate_type in ('claim', 'invalidation')")
    named = live.select(F.explode(F.array_distinct("source_page_ids")).alias("page_id"), F.when(F.col("candidate_type") == "claim", "supports").otherwise("contradicts").alias("relation"), F.col("candidate_id").alias("ref_id"))
    rows = named.unionByName(traces.select("page_id", F.lit("trace").alias("relation"), F.col("trace_id").alias("ref_id")))
    page = results.select("page_id")
    return rows.join(page, "page_id", "left_semi").distinct().unionByName(page.filter(F.col("page_id").startswith("decisions/")).select("page_id", F.lit("decision").alias("relation"), F.col("page_id").alias("ref_id")))


def hybrid(lexical: DataFrame, vector: DataFrame, edges: DataFrame, limit: int = 10, weights: tuple[float, float] = (0.5, 0.3)) -> DataFrame:
    """page_id, score, sources of fused results and of pages that they link to; of equal scores those that more lists hold come first, then ids.

    lexical and vector: page_id, score, cut to a few before; edges: source, target.
    """
    fused = cut(reciprocal_rank_fusion(lexical, vector, limit, weights))
    named = fused.select("page_id", F.concat_ws("+", F.when(F.col("lexical_rank").isNotNull(), "lexical"), F.when(F.col("vector_rank").isNotNull(), "vector")).alias("found"))
    linked = edges.join(fused.select(F.col("page_id").alias("source")), "source", "left_semi").select(F.col("target").alias("page_id"), F.lit("links").alias("link")).distinct()
    rows = graph_boost(fused, edges).join(named, "page_id", "left").join(linked, "page_id", "left")
    sources = F.concat_ws("+", "found", "link")
    return rows.select("page_id", "score", sources.alias("sources")).orderBy(F.desc("score"), F.desc(F.size(F.split("sources", r"\+"))), "page_id").limit(limit)


CITATION = 200


def cited(results: DataFrame, pages: DataFrame) -> DataFrame:
    """results with title, kind, visibility and citation of their pages: the snippet found (a column of pages, may be null), else how the text begins."""
    known = pages.select("page_id", "title", "kind", "visibility", F.coalesce("snippet", F.substring("body", 1, CITATION)).alias("citation"))
    return results.join(known, "page_id", "left")


def described(results: DataFrame, pages: DataFrame) -> DataFrame:
    """results with the title and kind of their pages."""
    return results.join(pages.select("page_id", "title", "kind"), "page_id", "left")


FOOTER = "_Context truncated by requested budget._"


def inline(x: Column, limit: int) -> Column:
    """One line of at most limit characters."""
    return compact(F.trim(F.regexp_replace(x, r"\s+", " ")), limit)


def context_lines(query: str, claims: DataFrame, results: DataFrame) -> DataFrame:
    """n, line, ref: the lines of a prompt's context: a head, then claims (place, candidate_id, label, score) and pages (place, page_id, title, score)."""
    spark = claims.sparkSession
    head = spark.createDataFrame([(0, "## Memory Context"), (1, f"Query: {' '.join(query.split())[:160]}"), (2, ""), (3, "### Claims"), (1_000_000, ""), (1_000_001, "### Pages")], "n long, line string").withColumn("ref", F.lit(None).cast("string"))
    line = lambda ref, text, score: F.concat(F.lit("- ["), ref, F.lit("] "), inline(text, 260), F.lit(" (score "), F.format_string("%.3f", score), F.lit(")"))
    a, b = F.concat(F.lit("claim:"), "candidate_id"), F.concat(F.lit("page:"), "page_id")
    rows = head.unionByName(claims.select((F.col("place") + 3).cast("long").alias("n"), line(a, F.col("label"), F.col("score")).alias("line"), a.alias("ref")))
    return rows.unionByName(results.select((F.col("place") + 1_000_001).cast("long").alias("n"), line(b, F.coalesce("title", "page_id"), F.col("score")).alias("line"), b.alias("ref")))


def bounded_context(lines: DataFrame, max_tokens: int, max_chars: int) -> DataFrame:
    """context, n_tokens, n_chars, truncated, refs: the lines (n, line, ref), in order, that fit into a budget; one row.

    A context has as many lines as its recall and retrieval were asked for, so one window orders them. Blank lines at the
    end count for nothing; where lines are left out, a footer says so if it fits.
    """
    so_far = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = lines.withColumn("upto", F.sum(F.length("line") + 1).over(so_far)).withColumn("tokens", F.sum(token_estimate(F.col("line"))).over(so_far))
    sized = sized.withColumn("chars", F.max(F.when(F.trim("line") != "", F.col("upto"))).over(so_far))
    fits = (F.col("chars") <= max_chars) & (F.col("tokens") <= max_tokens)
    one = sized.agg(F.array_sort(F.collect_list(F.when(fits, F.struct("n", "line", "ref")))).alias("kept"), F.coalesce(F.bool_or(~fits), F.lit(False)).alias("truncated"))
    text = lambda parts: F.concat(F.regexp_replace(F.array_join(parts, "\n"), r"\s+$", ""), F.lit("\n"))
    kept = F.transform("kept", lambda x: x["line"])
    short, long = text(kept), text(F.concat(kept, F.array(F.lit(""), F.lit(FOOTER))))
    context = F.when(F.col("truncated") & (F.length(long) <= max_chars) & (token_estimate(long) <= max_tokens), long).otherwise(short)
    refs = F.array_join(F.array_compact(F.transform("kept", lambda x: x["ref"])), ",")
    return one.select(context.alias("context"), "truncated", refs.alias("refs")).select("context", token_estimate(F.col("context")).alias("n_tokens"), F.length("context").alias("n_chars"), "truncated", "refs")
