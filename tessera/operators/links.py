"""The link graph of pages and the context graph of pages and ledger, as tables of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import is_url, link_targets, prose, resolve_link, shown_links
from tessera.operators.graph import both_ways
from tessera.sources.storage import cut

ENTITY_TYPES = ("entity", "claim", "capture", "trace", "decision", "policy")


def page_links(pages: DataFrame) -> DataFrame:
    """source, target, exists of the distinct links between pages."""
    links = pages.select(F.col("page_id").alias("source"), F.explode(link_targets(F.coalesce("body", F.lit("")))).alias("target")).distinct()
    known = pages.select(F.col("page_id").alias("target"), F.lit(True).alias("exists")).distinct()
    return links.join(known, "target", "left").select("source", "target", F.coalesce("exists", F.lit(False)).alias("exists"))


def source_links(pages: DataFrame) -> DataFrame:
    """source, target, exists: what pages name as their sources."""
    return pages.select(F.col("page_id").alias("source"), F.explode("sources").alias("target"), F.lit(True).alias("exists")).filter("trim(target) <> ''").distinct()


def all_links(pages: DataFrame) -> DataFrame:
    """Links between pages and to sources, with their type."""
    return page_links(pages).withColumn("type", F.lit("link")).unionByName(source_links(pages).withColumn("type", F.lit("source_ref")))


def enriched(pages: DataFrame, links: DataFrame) -> DataFrame:
    """page_id, kind, n_in, n_out over existing links."""
    there = links.filter("exists")
    count = lambda side, name: there.groupBy(F.col(side).alias("page_id")).agg(F.count("*").alias(name))
    both = pages.select("page_id", "kind").join(count("target", "n_in"), "page_id", "left").join(count("source", "n_out"), "page_id", "left")
    return both.select("page_id", "kind", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def around(links: DataFrame, page_id: str) -> DataFrame:
    """state, source, target of one page's links: outgoing, missing (to no page) and backlinks."""
    out = links.filter(F.col("source") == page_id).select(F.when(F.col("exists"), "outgoing").otherwise("missing").alias("state"), "source", "target")
    return out.unionByName(links.filter((F.col("target") == page_id) & F.col("exists")).select(F.lit("backlink").alias("state"), "source", "target"))


def backlinks_by_kind(links: DataFrame, pages: DataFrame) -> DataFrame:
    """target, kind, n: the existing links to each page by the kind of their source."""
    kinds = pages.select(F.col("page_id").alias("source"), F.coalesce("kind", F.lit("page")).alias("kind"))
    return links.filter("exists").join(kinds, "source").groupBy("target", "kind").agg(F.count("*").alias("n"))


def graph_stats(links: DataFrame) -> DataFrame:
    """n_links, n_broken, n_pages: one row."""
    return links.agg(F.count("*").alias("n_links"), F.count_if(~F.col("exists")).alias("n_broken"), F.countDistinct("source").alias("n_pages"))


def _edges(rows: DataFrame, source, target, kind: str, label=None) -> DataFrame:
    e = rows.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), (target if label is None else label).alias("label"))
    return e.filter("source is not null and target is not null and trim(source) <> '' and trim(target) <> ''")


def _nodes(rows: DataFrame, node, kind, label=None, actor=None, priority: int = 5) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(node.alias("id"), kind.alias("type"), (node if label is None else label).alias("label"), (none if actor is None else actor).alias("actor"), F.lit(priority).alias("priority")).filter("id is not null and trim(id) <> ''")


def _named(prefix: str, column) -> F.Column:
    return F.concat(F.lit(prefix), column)


def context_edges(pages: DataFrame, claims: DataFrame, plans: DataFrame, traces: DataFrame) -> DataFrame:
    """source, target, type, label: the distinct edges of pages, live candidates, plans and traces."""
    c, each = F.col, F.explode
    live = claims.filter("status in ('candidate', 'active') and candidate_type <> 'edge'")
    candidate = _named("candidate:", c("candidate_id"))
    exploded = lambda rows, key, column, name: rows.select(key.alias("_key"), "candidate_type" if "candidate_type" in rows.columns else F.lit("").alias("candidate_type"), each(column).alias(name))
    links = pages.select(c("page_id").alias("_key"), each(link_targets(F.coalesce("body", F.lit("")))).alias("x"))
    paths = pages.select(c("page_id").alias("_key"), each(F.concat("source_paths", "sources")).alias("x"))
    supports = exploded(live, candidate, "source_page_ids", "x")
    plan, trace = _named("plan:", c("plan_id")), _named("trace:", c("trace_id"))
    parts = [
        _edges(links, c("_key"), c("x"), "mentions", F.lit("wikilink")),
        _edges(paths, _named("source:", c("x")), c("_key"), "source_of", c("x")),
        _edges(pages.select("page_id", "source_task"), c("page_id"), _named("task:", c("source_task")), "task_related", c("source_task")),
        _edges(pages.select("page_id", each("policies").alias("x")), c("page_id"), _named("policy:", c("x")), "used_policy", c("x")),
        _edges(pages.filter("trim(actor) <> ''"), _named("actor:", c("actor")), c("page_id"), "authored", c("actor")),
        _edges(exploded(live, candidate, "source_capture_ids", "x"), c("x"), c("_key"), "generated", c("x")),
        _edges(supports.filter("candidate_type <> 'invalidation'"), c("_key"), c("x"), "supports", c("x")),
        _edges(supports.filter("candidate_type = 'invalidation'"), c("_key"), c("x"), "contradicts", c("x")),
        _edges(live.filter("trim(actor) <> ''"), _named("actor:", c("actor")), candidate, "authored", c("actor")),
        _edges(plans, plan, c("target_page_id"), "applied"),
        _edges(plans.select(plan.alias("_key"), each("candidate_ids").alias("x")), c("_key"), _named("candidate:", c("x")), "applied", c("x")),
        _edges(plans.select(plan.alias("_key"), each("policies").alias("x")), c("_key"), _named("policy:", c("x")), "used_policy", c("x")),
        _edges(traces, _named("trace:", c("parent_trace_id")), trace, "parent", c("parent_trace_id")),
        _edges(traces, trace, c("page_id"), "provenance"),
        _edges(traces, trace, _named("candidate:", c("candidate_id")), "provenance", c("candidate_id")),
        _edges(traces, trace, _named("task:", c("task_id")), "task_related", c("task_id")),
        _edges(traces.filter("trim(actor) <> ''"), _named("actor:", c("actor")), trace, "authored", c("actor")),
        _edges(traces.select(trace.alias("_key"), each("policy_refs").alias("x")), c("_key"), _named("policy:", c("x")), "used_policy", c("x")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def _context_parts(pages: DataFrame, claims: DataFrame, plans: DataFrame, traces: DataFrame) -> DataFrame:
    """id, type, label, actor, priority: every row that describes or names a node."""
    c, each = F.col, F.explode
    live = claims.filter("status in ('candidate', 'active') and candidate_type <> 'edge'")
    kind = F.when(c("candidate_type").isin("claim", "invalidation"), c("candidate_type")).otherwise("entity")
    actor = lambda rows: rows.select(F.nullif(F.trim("actor"), F.lit("")).alias("actor"))
    actors = actor(pages).unionAll(actor(live)).unionAll(actor(traces))
    policies = pages.select(each("policies").alias("x")).unionAll(plans.select(each("policies").alias("x"))).unionAll(traces.select(each("policy_refs").alias("x")))
    tasks = pages.select(c("source_task").alias("x")).unionAll(traces.select(c("task_id").alias("x")))
    paths = pages.select(each(F.concat("source_paths", "sources")).alias("x"))
    parts = [
        _nodes(pages, c("page_id"), F.when(c("kind") == "capture", "capture").otherwise("page"), F.coalesce("title", "page_id"), priority=0),
        _nodes(live, _named("candidate:", c("candidate_id")), kind, F.concat_ws(" ", "subject", "predicate", "object"), c("actor"), 0),
        _nodes(plans, _named("plan:", c("plan_id")), "plan", c("plan_id"), priority=0),
        _nodes(traces, _named("trace:", c("trace_id")), "trace", c("trace_id"), c("actor"), 0),
        _nodes(live.select(each("source_capture_ids").alias("x")), c("x"), "capture"),
        _nodes(live.select(each("source_page_ids").alias("x")), c("x"), "page", priority=6),
        _nodes(traces, c("page_id"), "page", priority=6),
        _nodes(actors, _named("actor:", c("actor")), "actor", c("actor")),
        _nodes(policies, _named("policy:", c("x")), "policy", c("x")),
        _nodes(tasks, _named("task:", c("x")), "task", c("x")),
        _nodes(paths, _named("source:", c("x")), "source", c("x")),
    ]
    return reduce(DataFrame.unionByName, parts)


def context_nodes(pages: DataFrame, claims: DataFrame, plans: DataFrame, traces: DataFrame) -> DataFrame:
    """id, type, label, actor: one row a node; what a table describes comes before what others only name."""
    first = _context_parts(pages, claims, plans, traces).groupBy("id").agg(F.min(F.struct("priority", "type", "label", "actor")).alias("x"))
    return first.select("id", "x.type", "x.label", "x.actor")


def context_types(pages: DataFrame, claims: DataFrame, plans: DataFrame, traces: DataFrame) -> DataFrame:
    """id, type of context_nodes(), without moving their labels."""
    first = _context_parts(pages, claims, plans, traces).groupBy("id").agg(F.min(F.struct("priority", "type")).alias("x"))
    return first.select("id", "x.type")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ends = lambda side: nodes.select(F.col("id").alias(side))
    return edges.join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")


def scoped(nodes: DataFrame, actor: str) -> DataFrame:
    """The nodes that one actor may see: not other actors, nor what they made."""
    mine = F.col("actor").isNull() | (F.trim("actor") == "") | (F.col("actor") == actor)
    return nodes.filter(mine & ((F.col("type") != "actor") | (F.col("id") == f"actor:{actor}")))


def of_types(nodes: DataFrame, types: list[str]) -> DataFrame:
    return nodes.filter(F.col("type").isin(types)) if types else nodes


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """name, n: nodes by type, and all edges."""
    return nodes.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("name"), "n"))


def neighbours(edges: DataFrame, nodes: DataFrame, node: str, direction: str = "both", edge_types: list[str] | None = None, node_types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """id, node_type, type, direction, total: the known neighbours of a node, by id and type, with their number before the cut.

    An edge counts once; one from a node to itself counts as outgoing, or as incoming where only these are asked for.
    """
    found = edges.filter(F.col("type").isin(edge_types)) if edge_types else edges
    out, into = F.col("source") == node, F.col("target") == node
    way = {"outgoing": F.when(out, "outgoing"), "incoming": F.when(into, "incoming"), "both": F.when(out, "outgoing").when(into, "incoming")}[direction]
    found = found.filter(out | into).withColumn("direction", way).filter("direction is not null")
    found = found.select(F.when(F.col("direction") == "outgoing", F.col("target")).otherwise(F.col("source")).alias("id"), "type", "direction")
    found = cut(found)
    known = nodes.join(found.select("id").distinct(), "id", "left_semi").select("id", F.col("type").alias("node_type"))  # of all nodes only those are made
    found = cut(found.join(known, "id"))
    found = found.filter(F.col("node_type").isin(node_types)) if node_types else found
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("id", "type", "direction").limit(limit).join(F.broadcast(total)).select("id", "node_type", "type", "direction", "total")  # one row of a total


def explain(edges: DataFrame, nodes: DataFrame, node: str, depth: int = 1, edge_types: list[str] | None = None) -> DataFrame:
    """type, n: how many nodes within depth of a node are first reached over which type of edge (of several the first by name)."""
    known = nodes.select("id")
    steps = both_ways(edges.filter(F.col("type").isin(edge_types)) if edge_types else edges).select("node", "other", "type").filter("node <> other")
    seen = edges.sparkSession.createDataFrame([(node, None)], "id string, type string")
    frontier = seen
    for _ in range(depth):
        new = steps.join(frontier.select(F.col("id").alias("node")), "node", "left_semi").groupBy(F.col("other").alias("id")).agg(F.min("type").alias("type"))
        frontier = cut(new.join(known, "id", "left_semi").join(seen.select("id"), "id", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen.filter("type is not null").groupBy("type").agg(F.count("*").alias("n"))


def url_sources(pages: DataFrame) -> DataFrame:
    """page_id, source, is_url of every source of a page."""
    rows = pages.select("page_id", F.explode("sources").alias("source"))
    return rows.withColumn("is_url", is_url(F.col("source")))


def link_edges(pages: DataFrame) -> DataFrame:
    """source, source_title, target, target_title, href, label, exists, external: the distinct links that pages show.

    Links are [[wiki links]], [inline](links) and web addresses, in this order of reading, outside code fences, code spans
    and images. A path is resolved against its page; what leads nowhere inside, addresses and #fragments are external, have
    no target and count as existing. href is what the page would show. Ordered by source, target, href and label, null as
    empty. Null bodies have no links.
    """
    rows = pages.select(F.col("page_id").alias("source"), F.col("title").alias("source_title"), prose(F.coalesce("body", F.lit(""))).alias("x"))
    rows = rows.select("source", "source_title", F.explode(shown_links(F.col("x"))).alias("l")).select("source", "source_title", "l.*")
    path, fragment = F.substring_index("href", "#", 1), F.regexp_extract("href", "#.*$", 0)
    target = F.when(F.col("href").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//|#)"), None).otherwise(resolve_link(path, F.col("source")))
    edges = rows.withColumn("target", target).withColumn("href", F.when(F.col("target").isNotNull(), F.concat(F.lit("/"), "target", F.when(F.length(fragment) > 1, fragment).otherwise(""))).otherwise(F.col("href")))
    edges = edges.select("source", "source_title", "target", "href", F.nullif(F.trim(F.regexp_replace("label", r"\s+", " ")), F.lit("")).alias("label")).distinct()
    known = pages.select(F.col("page_id").alias("target"), F.col("title").alias("target_title"), F.lit(True).alias("_there"))
    joined = edges.join(known, "target", "left").withColumn("external", F.col("target").isNull()).withColumn("exists", F.col("external") | F.col("_there").isNotNull())
    empty = lambda c: F.coalesce(c, F.lit(""))
    return joined.select("source", "source_title", "target", "target_title", "href", "label", "exists", "external").orderBy("source", empty("target"), "href", empty("label"))
