"""Precedent search over traces, policies, pages and the graph around an entity, and the union of provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import cut

#: Fixed weights of what makes a precedent relevant.
TRACE_WEIGHTS = {"base": 0.2, "actor": 0.2, "keyword": 0.35, "policy": 0.3, "entity": 0.2, "task": 0.15}
PAGE_WEIGHTS = {"base": 0.1, "decision": 0.35, "capture": 0.1, "keyword": 0.25, "entity": 0.2, "actor": 0.2, "policy": 0.2, "task": 0.2, "lane": 0.15}
POLICY_EXACT, POLICY_OTHER, NEIGHBOUR = 0.6, 0.25, 0.15
GRAPH_TYPES = ("trace", "decision", "page", "policy", "capture")


def needle(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def haystack(*columns: Column | str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.concat_ws(" ", *columns), r"\s+", " ")))


def holds(word: str, *columns: Column | str) -> Column:
    """Whether the haystack of the columns contains the needle of a word; runs of white space matter to several words only."""
    parts = needle(word).split(" ")
    plain = F.lower(F.concat_ws(" ", *columns))
    found = reduce(lambda a, b: a & b, (plain.contains(p) for p in parts))
    return found & haystack(*columns).contains(needle(word)) if len(parts) > 1 else found


def _scored(rows: DataFrame, weights: dict[str, float], given: dict[str, Column | None], base: Column) -> tuple[DataFrame, Column]:
    """The rows that meet every criterion that is given, and their score: the base and the weights of the criteria."""
    score = base
    for name, holds in given.items():
        if holds is not None:
            rows = rows.filter(holds)
            score = score + F.lit(weights.get(name, 0.0))
    return rows, F.round(score, 6)


def trace_precedents(traces: DataFrame, keyword: str | None = None, actor: str | None = None, policy: str | None = None, task: str | None = None, lane: str | None = None, situation: str | None = None, entity: str | None = None) -> DataFrame:
    """type, id, relevance of traces that meet all criteria; an entity only adds to the score."""
    text = ("trace_id", "actor", "reason_summary", "outcome", F.array_join("policy_refs", " "), "task_id", "page_id", "candidate_id")
    given = {
        "actor": F.col("actor") == actor if actor else None, "policy": F.array_contains("policy_refs", policy) if policy else None, "task": F.col("task_id") == task if task else None,
        "keyword": holds(keyword, *text) if keyword else None, "lane": F.col("lane") == lane if lane else None, "situation": holds(situation, "reason_summary") if situation else None,
    }
    base = F.lit(TRACE_WEIGHTS["base"]) + (F.when(holds(entity, *text), TRACE_WEIGHTS["entity"]).otherwise(0.0) if entity else F.lit(0.0))
    rows, score = _scored(traces, TRACE_WEIGHTS, given, base)
    return rows.select(F.lit("trace").alias("type"), F.concat(F.lit("trace:"), "trace_id").alias("id"), score.alias("relevance"))


def policy_precedents(policies: DataFrame, keyword: str | None = None, policy: str | None = None, entity: str | None = None) -> DataFrame:
    """type, id, relevance of policies (policy_id, name, description) that meet all criteria; none without a criterion."""
    rows = policies if keyword or policy or entity else policies.filter("false")
    rows = rows.filter(F.col("policy_id") == policy) if policy else rows
    for word in (keyword, entity):
        rows = rows.filter(holds(word, "policy_id", "name", "description")) if word else rows
    return rows.select(F.lit("policy").alias("type"), F.concat(F.lit("policy:"), "policy_id").alias("id"), F.lit(POLICY_EXACT if policy else POLICY_OTHER).alias("relevance"))


def page_precedents(pages: DataFrame, keyword: str | None = None, lane: str | None = None, actor: str | None = None, policy: str | None = None, task: str | None = None, situation: str | None = None, entity: str | None = None) -> DataFrame:
    """type (page, decision, capture), id, relevance of pages that meet all criteria."""
    text = ("page_id", "title", "summary", "body")
    kind = F.coalesce("kind", F.lit("page"))
    given = {
        "lane": F.col("lane") == lane if lane else None, "actor": F.col("actor") == actor if actor else None, "task": F.col("source_task") == task if task else None, "policy": F.array_contains("policies", policy) if policy else None,
        "keyword": holds(keyword, *text) if keyword else None, "entity": holds(entity, *text) if entity else None, "situation": holds(situation, kind, "summary", "body") if situation else None,
    }
    base = F.lit(PAGE_WEIGHTS["base"]) + F.when(kind == "decision", PAGE_WEIGHTS["decision"]).when(kind == "capture", PAGE_WEIGHTS["capture"]).otherwise(0.0)
    rows, score = _scored(pages, PAGE_WEIGHTS, given, base)
    return rows.select(F.when(kind.isin("decision", "capture"), kind).otherwise("page").alias("type"), F.col("page_id").alias("id"), score.alias("relevance"))


def graph_precedents(edges: DataFrame, nodes: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """type, id, relevance of the nodes around one."""
    from tessera.operators.links import neighbours

    near = neighbours(edges, nodes, node, limit=limit).filter(F.col("node_type").isin(*GRAPH_TYPES))
    return near.select(F.col("node_type").alias("type"), "id", F.lit(NEIGHBOUR).alias("relevance")).distinct()


def with_paths(found: DataFrame, edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """found with `path`: the first shortest way along the edges from a node to each result, of three edges at most; null if there is none.

    A result stands for the node of its id or, as pages are nodes under their plain id, of what follows its type.
    """
    from tessera.operators.graph import first_paths

    found = cut(found)
    names = found.select("id", F.explode(F.array_distinct(F.array("id", F.concat_ws(":", "type", "id"), F.regexp_replace("id", "^[a-z]+:", "")))).alias("node"))
    ways = first_paths(edges, node, depth, names).select("node", "hops", F.array_join(F.transform("steps", lambda s: F.concat(s["from"], F.lit(" -"), s["edge"], F.lit("-> "), s["to"])), "; ").alias("way"))
    best = names.join(ways, "node").groupBy("id").agg(F.min_by("way", F.struct("hops", "way")).alias("path"))
    return found.join(best, "id", "left")


def search(branches: list[DataFrame], limit: int) -> DataFrame:
    """The most relevant of several branches; of one id in several, the branch named first. With the total before the cut."""
    rows = reduce(DataFrame.unionByName, (b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)))
    first = cut(rows.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("branch"))).filter("place = 1").drop("place", "branch"))
    total = first.agg(F.count("*").alias("total"))
    return first.orderBy(F.desc("relevance"), "type", "id").limit(limit).join(F.broadcast(total))  # one row of a total


def provenance(links: DataFrame, captures: DataFrame) -> DataFrame:
    """page_id with the union of what its captures were made by: captures, actors, first and last time.

    links: page_id, capture_id; captures: capture_id, actor, at. Distinct pairs are formed before they are gathered.
    """
    rows = links.join(captures, "capture_id")
    return rows.groupBy("page_id").agg(F.countDistinct("capture_id").alias("n_captures"), F.sort_array(F.collect_set("actor")).alias("actors"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def search_provenance(hits: DataFrame, candidates: DataFrame) -> DataFrame:
    """hits (page_id, actor, lane, observed_at) with candidate_id and the fields of the best candidate that names the page, if any.

    Candidates with any provenance of their own come first, the oldest of them; of the others the newest. A candidate's
    nulls hold as well.
    """
    refs = candidates.select("candidate_id", "created_at", F.explode(F.array_distinct(F.concat("source_page_ids", "source_capture_ids"))).alias("page_id"), F.col("actor").alias("_actor"), F.col("lane").alias("_lane"), F.col("observed_at").alias("_observed_at"), (F.col("observed_at").isNotNull() | F.col("valid_from").isNotNull() | F.col("valid_until").isNotNull() | (F.coalesce(F.trim("actor"), F.lit("")) != "") | (F.coalesce(F.trim("lane"), F.lit("")) != "")).alias("own"))
    time = F.unix_micros(F.col("created_at").cast("timestamp"))
    rank = F.struct((~F.col("own")).cast("int").alias("a"), F.when(F.col("own"), time).otherwise(-time).alias("b"), "candidate_id")
    best = refs.groupBy("page_id").agg(F.min(F.struct(rank.alias("rank"), "candidate_id", "_actor", "_lane", "_observed_at")).alias("x")).select("page_id", "x.candidate_id", "x._actor", "x._lane", "x._observed_at")
    joined = hits.join(best, "page_id", "left")
    pick = lambda own, other: F.when(F.col("candidate_id").isNotNull(), F.col(other)).otherwise(F.col(own)).alias(own)
    return joined.select("page_id", "candidate_id", pick("actor", "_actor"), pick("lane", "_lane"), pick("observed_at", "_observed_at"))
