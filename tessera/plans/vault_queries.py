"""Queries on the vault of pages: listings, quality rules, links and the context graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, ledger, links, pages, quality_rules
from tessera.plans import graph_sql
from tessera.plans.registry import query
from tessera.sources import model, storage

VAULT = model.cte("vault")
TODAY = f"DATE '{model.TODAY}'"


def vault(spark, sf_dir):
    return model.frame(spark, sf_dir, "vault")


def today():
    return F.lit(model.TODAY)


def iso(x: str) -> str:
    return f"(CASE WHEN regexp_matches(substr(trim({x}), 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(substr(trim({x}), 1, 10) AS DATE) END)"


def empty(x: str) -> str:
    return f"trim(coalesce({x}, '')) = ''"


LOOSE = "regexp_matches(page_id, '^(inbox|notes)/')"
CAPTURE = f"kind = 'capture' AND {LOOSE}"
WIKI = r"""wl AS (SELECT page_id AS source, unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)) AS s FROM vault), wt AS (SELECT source, CASE WHEN contains(s, '|') THEN trim(string_split(s, '|')[1]) ELSE trim(s) END AS l, CASE WHEN contains(s, '|') THEN trim(string_split(s, '|')[2]) ELSE '' END AS r FROM wl),
wx AS (SELECT source, CASE WHEN r <> '' AND (contains(r, '/') OR r = lower(r)) THEN r WHEN contains(l, '/') OR l = lower(l) THEN l WHEN r <> '' THEN r ELSE l END AS target FROM wt), links AS (SELECT DISTINCT source, target, target IN (SELECT page_id FROM vault) AS exists FROM wx)"""


def rule(name: str, severity: str, when: str, detail: str = "NULL", target: str = "NULL", source: str = "vault") -> str:
    return f"SELECT page_id, '{name}' AS rule, '{severity}' AS severity, {target}::VARCHAR AS target, {detail}::VARCHAR AS detail FROM {source} WHERE {when}"


MARK = "list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: regexp_matches(x, '(?i)\\b(CONTRADICTION|CONFLICT|DISPUTED)\\s*:|TODO\\s*:\\s*verify'))[1]"
PROCEDURE = "kind IN ('procedure', 'procedure-candidate')"
FRESH = [rule(f"invalid_{c}", "warning", f"{c} IS NOT NULL AND {iso(c)} IS NULL", c) for c in ("reviewed_at", "stale_after", "valid_until")] + [rule("stale_page", "warning", f"{iso('stale_after')} < {TODAY}", iso("stale_after")), rule("expired_fact", "warning", f"{iso('valid_until')} < {TODAY}", iso("valid_until"))]
PROCEDURES = [
    rule("procedure_missing_steps", "error", f"{PROCEDURE} AND len(steps) = 0"), *(rule(r, "warning", f"{PROCEDURE} AND {empty(c)}") for r, c in (("procedure_missing_trigger", "trigger"), ("procedure-schema-version", "schema_version"), ("procedure-missing-author", "author"), ("procedure-missing-validated-at", "validated_at"))),
    rule("procedure-unvalidated", "warning", "kind = 'procedure' AND NOT coalesce(validated, false)"), rule("procedure_step_not_in_body", "info", "NOT contains(body, k::VARCHAR)", "step", source=f"(SELECT page_id, body, unnest(steps) AS step, generate_subscripts(steps, 1) AS k FROM vault WHERE {PROCEDURE})"),
]
EPISTEMIC = [
    rule("epistemic-label", "warning", f"coalesce(kind, 'page') IN ('decision', 'capture') AND {empty('epistemic_status')}"), rule("epistemic-weak", "warning", "epistemic_status = 'assumption' AND kind IN ('project', 'service', 'decision')"),
    rule("epistemic-unsourced", "error", f"epistemic_status = 'assumption' AND len(sources) = 0 AND {empty('evidence')} AND coalesce(kind, 'page') <> 'capture'"),
]
NO_HEADER = "title IS NULL AND kind IS NULL AND visibility IS NULL AND summary IS NULL AND len(sources) = 0"
HEADER = [rule("missing_frontmatter", "warning", NO_HEADER), *(rule(f"missing_{f}", "warning", f"{empty(f)} AND NOT ({NO_HEADER})") for f in quality_rules.RECOMMENDED), rule("missing_sources", "warning", f"len(sources) = 0 AND NOT {LOOSE} AND NOT ({NO_HEADER})")]
CONFIDENCE = [rule("low_confidence", "info", "lower(trim(confidence)) IN ('low', 'unknown')", "confidence")]
MARKERS = [rule("contradiction_marker", "warning", f"{MARK} IS NOT NULL", f"substr({MARK}, 1, 240)")]
TITLES = [rule("duplicate_title", "warning", "n > 1", "key", source="(SELECT page_id, key, count(*) OVER (PARTITION BY key) AS n FROM (SELECT page_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS key FROM vault) WHERE key <> '')")]
LINKED = [rule("broken_internal_link", "error", "NOT exists", target="t", source="(SELECT source AS page_id, target AS t, exists FROM links)"), rule("orphan_page", "info", "page_id NOT IN (SELECT target FROM links WHERE exists AND source <> target)")]
ALL = [*HEADER, *FRESH, *CONFIDENCE, *MARKERS, *PROCEDURES, *EPISTEMIC, *TITLES, *LINKED]


def union(rules: list[str]) -> str:
    return " UNION ALL ".join(rules)


FINDINGS = f"WITH {VAULT}, {WIKI}, f AS ({union(ALL)})"


def findings(spark, sf_dir):
    v = vault(spark, sf_dir)
    return quality_rules.lint(v, links.page_links(v), today())


@query(f"{FINDINGS} SELECT * FROM f")
def lint_findings(spark, sf_dir):
    return findings(spark, sf_dir)


@query(f"WITH {VAULT} {union(HEADER)}")
def field_findings(spark, sf_dir):
    return quality_rules.header_findings(vault(spark, sf_dir))


@query(f"WITH {VAULT} {union(FRESH)}")
def freshness_findings(spark, sf_dir):
    return quality_rules.freshness_findings(vault(spark, sf_dir), today())


@query(f"WITH {VAULT} {union(CONFIDENCE)}")
def confidence_findings(spark, sf_dir):
    return quality_rules.confidence_findings(vault(spark, sf_dir))


@query(f"WITH {VAULT} {union(MARKERS)}")
def marker_findings(spark, sf_dir):
    return quality_rules.marker_findings(vault(spark, sf_dir))


@query(f"WITH {VAULT} {union(PROCEDURES)}")
def procedure_findings(spark, sf_dir):
    return quality_rules.procedure_findings(vault(spark, sf_dir))


@query(f"WITH {VAULT} {union(EPISTEMIC)}")
def epistemic_findings(spark, sf_dir):
    return quality_rules.epistemic_findings(vault(spark, sf_dir))


@query(f"WITH {model.cte('ledger')} SELECT coalesce(source_page_ids[1], '?') AS page_id, 'epistemic-claim' AS rule, 'warning' AS severity, NULL::VARCHAR AS target, candidate_id AS detail FROM ledger WHERE candidate_type = 'claim' AND epistemic_status = 'assumption'")
def claim_findings(spark, sf_dir):
    return quality_rules.claim_findings(model.frame(spark, sf_dir, "ledger"))


@query(f"WITH {VAULT} {union(TITLES)}")
def title_findings(spark, sf_dir):
    return quality_rules.duplicate_title_findings(vault(spark, sf_dir))


SUPPRESSED = "s AS (SELECT page_id, 'missing_summary' AS rule, 'known' AS reason FROM vault WHERE doc_id % 2 = 0)"
SETTLED = f"""{FINDINGS}, {SUPPRESSED}, c AS (SELECT page_id, rule, CASE WHEN rule = 'low_confidence' THEN 'warning' ELSE severity END AS severity, target, detail, reason IS NOT NULL AS suppressed, reason FROM f LEFT JOIN s USING (page_id, rule) WHERE rule <> 'orphan_page')"""


def settled(spark, sf_dir):
    known = vault(spark, sf_dir).filter("doc_id % 2 = 0").select("page_id", F.lit("missing_summary").alias("rule"), F.lit("known").alias("reason"))
    return quality_rules.settle(findings(spark, sf_dir), {"orphan_page": False}, {"low_confidence": "warning"}, known)


@query(f"{SETTLED} SELECT * FROM c")
def lint_configured(spark, sf_dir):
    return settled(spark, sf_dir)


@query(f"{SETTLED} SELECT page_id, rule, target, detail FROM c WHERE NOT suppressed AND rule IN {quality_rules.FIXABLE}")
def lint_fixable(spark, sf_dir):
    return quality_rules.fixable(settled(spark, sf_dir)).select("page_id", "rule", "target", "detail")


@query(f"{FINDINGS} SELECT page_id, rule, severity, target, detail FROM f ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 9 END, page_id, rule, coalesce(target, ''), coalesce(detail, '') LIMIT 100")
def lint_report(spark, sf_dir):
    return quality_rules.ordered(findings(spark, sf_dir), 100)


@query(f"""WITH {VAULT} SELECT page_id, CASE WHEN {iso('stale_after')} < {TODAY} THEN 'stale' ELSE 'missing_metadata' END AS state, CASE WHEN {iso('stale_after')} < {TODAY} THEN date_diff('day', {iso('stale_after')}, {TODAY})::INTEGER END AS days_stale FROM vault
WHERE {iso('stale_after')} < {TODAY} OR (stale_after IS NULL AND reviewed_at IS NULL AND NOT {LOOSE})""")
def review_queue(spark, sf_dir):
    return quality_rules.review_queue(vault(spark, sf_dir), today())


CATEGORY = "CASE " + " ".join(f"WHEN rule IN ({', '.join(repr(r) for r in rules)}) THEN '{c}'" for c, rules in quality_rules.CATEGORIES.items()) + " END"


@query(f"{SETTLED}, h AS (SELECT {CATEGORY} AS category, page_id FROM c WHERE NOT suppressed) SELECT category, count(*) AS n, min(page_id) AS first_page FROM h WHERE category IS NOT NULL GROUP BY 1")
def heartbeat(spark, sf_dir):
    return quality_rules.heartbeat(settled(spark, sf_dir))


@query(f"{SETTLED}, h AS (SELECT {CATEGORY} AS category FROM c WHERE NOT suppressed AND page_id NOT IN (SELECT page_id FROM vault WHERE source_task = 'heartbeat-self-audit')) SELECT category, count(*) AS n FROM h WHERE category IS NOT NULL AND category NOT IN ('missing_metadata', 'low_confidence') GROUP BY 1")
def heartbeat_captures(spark, sf_dir):
    done = spark.createDataFrame([("low_confidence",)], "category string")
    return quality_rules.heartbeat_captures(settled(spark, sf_dir), vault(spark, sf_dir), done)


@query(f"""WITH {model.cte('vault', 'plans', 'runs')}, {WIKI}, f AS ({union(ALL)}), h AS (SELECT {CATEGORY} AS category FROM f)
SELECT category AS gauge, count(*) AS n FROM h WHERE category IS NOT NULL GROUP BY 1 UNION ALL SELECT 'pending_captures', count(*) FROM vault WHERE {CAPTURE} AND status = 'draft'
UNION ALL SELECT 'review_required', count(*) FROM plans WHERE status IN ('needs_manual_review', 'pending') UNION ALL SELECT 'rejected_plans', count(*) FROM plans WHERE status = 'rejected'
UNION ALL SELECT 'failed_runs', (count(*) FILTER (status = 'running' AND started_at < TIMESTAMP '{model.NOW}' - INTERVAL 1 HOUR)) + CASE WHEN arg_max(status, (started_at, run_id)) IN ('completed_with_errors', 'failed') THEN 1 ELSE 0 END FROM runs""")
def memory_health(spark, sf_dir):
    """Upkeep's categories and the backlog of captures, plans and runs, a gauge a row."""
    v, plans, runs = (model.frame(spark, sf_dir, t) for t in ("vault", "plans", "runs"))
    beat = quality_rules.heartbeat(quality_rules.settle(findings(spark, sf_dir))).select(F.col("category").alias("gauge"), "n")
    gauge = lambda df, name, value: df.agg(value.cast("long").alias("n")).select(F.lit(name).alias("gauge"), "n")
    stuck = F.count_if((F.col("status") == "running") & (F.col("started_at") < F.lit(model.NOW).cast("timestamp_ntz") - F.expr("INTERVAL 1 HOUR")))
    last = F.when(F.max_by("status", F.struct("started_at", "run_id")).isin("completed_with_errors", "failed"), 1).otherwise(0)
    out = beat.unionAll(gauge(pages.captures(v), "pending_captures", F.count("*"))).unionAll(gauge(plans, "review_required", F.count_if(F.col("status").isin("needs_manual_review", "pending"))))
    return out.unionAll(gauge(plans, "rejected_plans", F.count_if(F.col("status") == "rejected"))).unionAll(gauge(runs, "failed_runs", stuck + last))


WORDS = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+'), lambda w: length(w) >= 4))"


@query(f"""WITH {VAULT}, {WIKI}, inb AS (SELECT DISTINCT target FROM links WHERE exists AND source <> target), o AS (SELECT * FROM vault WHERE page_id NOT IN (SELECT target FROM inb)),
p AS (SELECT o.page_id AS orphan_id, v.page_id, len(list_intersect(o.tags, v.tags)) AS t, len(list_intersect({WORDS.format(t='o.title')}, {WORDS.format(t='v.title')})) AS w FROM o JOIN vault v ON v.page_id <> o.page_id AND v.page_id IN (SELECT target FROM inb)),
s AS (SELECT orphan_id, page_id, (CASE WHEN t > 0 THEN 10 + t ELSE 0 END + CASE WHEN w >= 2 THEN w ELSE 0 END)::INTEGER AS score FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY orphan_id ORDER BY score DESC, page_id)::INTEGER AS place FROM s WHERE score > 0) SELECT * FROM r WHERE place <= 3""")
def orphan_suggestions(spark, sf_dir):
    v = vault(spark, sf_dir)
    inbound = links.page_links(v).filter("exists and source <> target").select(F.col("target").alias("page_id")).distinct()
    return quality_rules.link_suggestions(v.join(inbound, "page_id", "left_anti").select("page_id"), v, among=inbound)


@query()
def broken_link_suggestions(spark, sf_dir):
    v = vault(spark, sf_dir)
    return quality_rules.close_ids(links.page_links(v).filter("not exists"), v)


@query(f"WITH {VAULT} SELECT page_id, coalesce(nullif(trim(title), ''), upper(substr(string_split(page_id, '/')[-1], 1, 1)) || substr(string_split(page_id, '/')[-1], 2)) AS title, coalesce(kind, regexp_replace(string_split(page_id, '/')[1], 's$', '')) AS kind, coalesce(visibility, 'internal') AS visibility, status, nullif(trim(summary), '') AS summary FROM vault")
def page_summaries(spark, sf_dir):
    return pages.summaries(vault(spark, sf_dir))


@query(f"WITH {VAULT} SELECT page_id, title, body FROM vault WHERE page_id IN (SELECT target_page_id FROM ({'WITH ' + model.cte('plans') + ' SELECT * FROM plans'}))")
def page_batch(spark, sf_dir):
    ids = model.frame(spark, sf_dir, "plans").select(F.col("target_page_id").alias("page_id"))
    return pages.read_pages(vault(spark, sf_dir), ids).select("page_id", "title", "body")


@query(f"WITH {VAULT} SELECT page_id FROM vault WHERE visibility = 'public' AND status = 'active' AND starts_with(page_id, 'services/') AND lane = 'ops'")
def page_post_filter(spark, sf_dir):
    return pages.post_filter(vault(spark, sf_dir), "public", "active", "services", "ops").select("page_id")


@query(f"WITH {VAULT} SELECT page_id, title FROM vault WHERE {CAPTURE} AND status = 'draft' AND starts_with(page_id, 'notes/') ORDER BY page_id DESC LIMIT 50")
def capture_listing(spark, sf_dir):
    return pages.capture_list(vault(spark, sf_dir), "draft", "notes").select("page_id", "title")


@query(f"WITH {VAULT}, {model.cte('log')} SELECT page_id FROM vault WHERE {CAPTURE} AND status = 'draft' AND coalesce(source_task, '') <> 'heartbeat-self-audit' AND coalesce(lane, '') <> 'ops' AND page_id NOT IN (SELECT capture_id FROM log WHERE success)")
def unprocessed_captures(spark, sf_dir):
    return pages.unprocessed(vault(spark, sf_dir), model.frame(spark, sf_dir, "log"), None).select("page_id")


@query(f"WITH {VAULT}, r AS (SELECT page_id, CASE WHEN len(list_filter(sources, lambda x: contains(x, 'src1'))) > 0 THEN 'sources' WHEN len(list_filter(source_paths, lambda x: contains(x, 'src1'))) > 0 THEN 'source_paths' WHEN contains(body, 'src1') THEN 'body' END AS field FROM vault) SELECT * FROM r WHERE field IS NOT NULL")
def code_references(spark, sf_dir):
    return pages.code_references(vault(spark, sf_dir), "src1")


@query(f"WITH {VAULT} SELECT page_id FROM vault WHERE {CAPTURE} AND coalesce(regexp_extract(page_id, '/(\\d{{4}}-\\d{{2}}-\\d{{2}})/', 1), observed_at) = '2024-01-05'")
def day_captures(spark, sf_dir):
    return pages.day_captures(vault(spark, sf_dir), "2024-01-05").select("page_id")


REQUIRED = {"procedure": ["trigger", "author", "validated_at"], "decision": ["epistemic_status", "reviewed_at"], "service": ["stale_after"]}


@query(f"""WITH {VAULT}, m AS (SELECT page_id, CASE kind WHEN 'procedure' THEN concat_ws(',', CASE WHEN {empty('trigger')} THEN 'trigger' END, CASE WHEN {empty('author')} THEN 'author' END, CASE WHEN {empty('validated_at')} THEN 'validated_at' END)
WHEN 'decision' THEN concat_ws(',', CASE WHEN {empty('epistemic_status')} THEN 'epistemic_status' END, CASE WHEN {empty('reviewed_at')} THEN 'reviewed_at' END) WHEN 'service' THEN concat_ws(',', CASE WHEN {empty('stale_after')} THEN 'stale_after' END) END AS missing FROM vault) SELECT * FROM m WHERE missing <> ''""")
def required_fields(spark, sf_dir):
    v = vault(spark, sf_dir)
    fields = sorted({f for fs in REQUIRED.values() for f in fs})
    header = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f))))
    return quality_rules.missing_fields(v.withColumn("header", header), REQUIRED).withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {VAULT}, {WIKI} SELECT * FROM links")
def page_links(spark, sf_dir):
    return links.page_links(vault(spark, sf_dir))


@query(f"WITH {VAULT}, {WIKI} SELECT source, target, exists, 'link' AS type FROM links UNION ALL SELECT DISTINCT page_id, unnest(sources), true, 'source_ref' FROM vault")
def all_links(spark, sf_dir):
    return links.all_links(vault(spark, sf_dir))


@query(f"WITH {VAULT}, {WIKI} SELECT page_id, kind, (SELECT count(*) FROM links WHERE exists AND target = page_id) AS n_in, (SELECT count(*) FROM links WHERE exists AND source = page_id) AS n_out FROM vault")
def link_degrees(spark, sf_dir):
    v = vault(spark, sf_dir)
    return links.enriched(v, links.page_links(v))


@query(f"WITH {VAULT}, {WIKI} SELECT CASE WHEN exists THEN 'outgoing' ELSE 'missing' END AS state, source, target FROM links WHERE source = 'projects/p1' UNION ALL SELECT 'backlink', source, target FROM links WHERE target = 'projects/p1' AND exists")
def links_of_page(spark, sf_dir):
    return links.around(links.page_links(vault(spark, sf_dir)), "projects/p1")


@query(f"WITH {VAULT}, {WIKI} SELECT target, coalesce(kind, 'page') AS kind, count(*) AS n FROM links JOIN vault ON source = page_id WHERE exists GROUP BY ALL")
def backlinks_by_kind(spark, sf_dir):
    v = vault(spark, sf_dir)
    return links.backlinks_by_kind(links.page_links(v), v)


@query(f"WITH {VAULT}, {WIKI} SELECT count(*) AS n_links, count(*) FILTER (NOT exists) AS n_broken, count(DISTINCT source) AS n_pages FROM links")
def link_stats(spark, sf_dir):
    return links.graph_stats(links.page_links(vault(spark, sf_dir)))


def _edge(rows: str, source: str, target: str, kind: str, label: str | None = None, where: str = "TRUE") -> str:
    return f"SELECT {source} AS source, {target} AS target, '{kind}' AS type, {label or target} AS label FROM {rows} WHERE {where}"


LIVE = "(SELECT * FROM ledger WHERE status IN ('candidate', 'active'))"
ACTED = "trim(coalesce(actor, '')) <> ''"
CONTEXT = f"""WITH {model.cte('vault', 'ledger', 'plans', 'traces')}, {WIKI}, e0 AS ({union([
    _edge('wx', 'source', 'target', 'mentions', "'wikilink'"), _edge('(SELECT page_id, unnest(list_concat(source_paths, sources)) AS x FROM vault)', "'source:' || x", 'page_id', 'source_of', 'x'),
    _edge('vault', 'page_id', "'task:' || source_task", 'task_related', 'source_task', 'source_task IS NOT NULL'), _edge('(SELECT page_id, unnest(policies) AS x FROM vault)', 'page_id', "'policy:' || x", 'used_policy', 'x'),
    _edge('vault', "'actor:' || actor", 'page_id', 'authored', 'actor', ACTED), _edge(f'(SELECT candidate_id, unnest(source_capture_ids) AS x FROM {LIVE})', 'x', "'candidate:' || candidate_id", 'generated', 'x'),
    _edge(f"(SELECT candidate_id, unnest(source_page_ids) AS x FROM {LIVE} WHERE candidate_type <> 'invalidation')", "'candidate:' || candidate_id", 'x', 'supports'),
    _edge(f"(SELECT candidate_id, unnest(source_page_ids) AS x FROM {LIVE} WHERE candidate_type = 'invalidation')", "'candidate:' || candidate_id", 'x', 'contradicts'), _edge(LIVE, "'actor:' || actor", "'candidate:' || candidate_id", 'authored', 'actor', ACTED),
    _edge('plans', "'plan:' || plan_id", 'target_page_id', 'applied'), _edge('(SELECT plan_id, unnest(candidate_ids) AS x FROM plans)', "'plan:' || plan_id", "'candidate:' || x", 'applied', 'x'), _edge('(SELECT plan_id, unnest(policies) AS x FROM plans)', "'plan:' || plan_id", "'policy:' || x", 'used_policy', 'x'),
    _edge('traces', "'trace:' || parent_trace_id", "'trace:' || trace_id", 'parent', 'parent_trace_id', 'parent_trace_id IS NOT NULL'), _edge('traces', "'trace:' || trace_id", 'page_id', 'provenance'), _edge('traces', "'trace:' || trace_id", "'candidate:' || candidate_id", 'provenance', 'candidate_id'),
    _edge('traces', "'trace:' || trace_id", "'task:' || task_id", 'task_related', 'task_id', 'task_id IS NOT NULL'), _edge('traces', "'actor:' || actor", "'trace:' || trace_id", 'authored', 'actor', ACTED), _edge('(SELECT trace_id, unnest(policy_refs) AS x FROM traces)', "'trace:' || trace_id", "'policy:' || x", 'used_policy', 'x'),
])}), ce AS (SELECT DISTINCT * FROM e0), n0 AS (
SELECT page_id AS id, CASE WHEN kind = 'capture' THEN 'capture' ELSE 'page' END AS type, coalesce(title, page_id) AS label, NULL AS actor, 0 AS k FROM vault
UNION ALL SELECT 'candidate:' || candidate_id, CASE WHEN candidate_type IN ('claim', 'invalidation') THEN candidate_type ELSE 'entity' END, concat_ws(' ', subject, predicate, object), actor, 0 FROM {LIVE}
UNION ALL SELECT 'plan:' || plan_id, 'plan', plan_id, NULL, 0 FROM plans UNION ALL SELECT 'trace:' || trace_id, 'trace', trace_id, actor, 0 FROM traces
UNION ALL SELECT x, 'capture', x, NULL, 5 FROM (SELECT unnest(source_capture_ids) AS x FROM {LIVE}) UNION ALL SELECT x, 'page', x, NULL, 6 FROM (SELECT unnest(source_page_ids) AS x FROM {LIVE}) UNION ALL SELECT page_id, 'page', page_id, NULL, 6 FROM traces
UNION ALL SELECT 'actor:' || actor, 'actor', actor, NULL, 5 FROM (SELECT actor FROM vault UNION SELECT actor FROM {LIVE} UNION SELECT actor FROM traces) WHERE {ACTED}
UNION ALL SELECT 'policy:' || x, 'policy', x, NULL, 5 FROM (SELECT unnest(policies) AS x FROM vault UNION SELECT unnest(policies) FROM plans UNION SELECT unnest(policy_refs) FROM traces)
UNION ALL SELECT 'task:' || x, 'task', x, NULL, 5 FROM (SELECT source_task AS x FROM vault UNION SELECT task_id FROM traces) WHERE x IS NOT NULL UNION ALL SELECT 'source:' || x, 'source', x, NULL, 5 FROM (SELECT unnest(list_concat(source_paths, sources)) AS x FROM vault)),
cn AS (SELECT id, type, label, actor FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k, type, label, actor) AS z FROM n0) WHERE z = 1)"""


def context_tables(spark, sf_dir):
    return [model.frame(spark, sf_dir, t) for t in ("vault", "ledger", "plans", "traces")]


def context(spark, sf_dir):
    tables = context_tables(spark, sf_dir)
    return links.context_nodes(*tables), links.context_edges(*tables)


@query(f"{CONTEXT} SELECT * FROM ce")
def context_edges(spark, sf_dir):
    return context(spark, sf_dir)[1]


@query(f"{CONTEXT} SELECT * FROM cn")
def context_nodes(spark, sf_dir):
    return context(spark, sf_dir)[0]


@query(f"{CONTEXT} SELECT type AS name, count(*) AS n FROM cn GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM ce")
def context_stats(spark, sf_dir):
    return links.stats(*context(spark, sf_dir))


SCOPE = f"{CONTEXT}, sn AS (SELECT * FROM cn WHERE (actor IS NULL OR trim(actor) = '' OR actor = 'ann') AND (type <> 'actor' OR id = 'actor:ann'))"


@query(f"{SCOPE} SELECT * FROM ce WHERE source IN (SELECT id FROM sn) AND target IN (SELECT id FROM sn)")
def context_scoped(spark, sf_dir):
    nodes, edges = context(spark, sf_dir)
    return links.within(edges, links.scoped(nodes, "ann"))


@query(f"{CONTEXT}, tn AS (SELECT * FROM cn WHERE type IN ('page', 'claim')), te AS (SELECT * FROM ce WHERE source IN (SELECT id FROM tn) AND target IN (SELECT id FROM tn)) SELECT type AS name, count(*) AS n FROM tn GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM te")
def context_of_types(spark, sf_dir):
    nodes, edges = context(spark, sf_dir)
    kept = links.of_types(nodes, ["page", "claim"])
    return links.stats(kept, links.within(edges, kept))


@query(f"""{CONTEXT}, x AS (SELECT CASE WHEN source = 'projects/p1' THEN target ELSE source END AS id, type, CASE WHEN source = 'projects/p1' THEN 'outgoing' ELSE 'incoming' END AS direction FROM ce WHERE (source = 'projects/p1' OR target = 'projects/p1') AND type <> 'applied'),
y AS (SELECT x.*, cn.type AS node_type FROM x JOIN cn USING (id) WHERE cn.type IN ('page', 'claim', 'actor', 'trace')) SELECT id, node_type, type, direction, (SELECT count(*) FROM y) AS total FROM y ORDER BY id, type, direction LIMIT 20""")
def context_neighbours(spark, sf_dir):
    nodes, edges = context(spark, sf_dir)
    kinds = ["mentions", "source_of", "task_related", "used_policy", "authored", "generated", "supports", "contradicts", "parent", "provenance"]
    return links.neighbours(edges, nodes, "projects/p1", "both", kinds, ["page", "claim", "actor", "trace"], 20)


@query(f"""{CONTEXT}, b AS (SELECT source AS node, target AS other, type FROM ce UNION ALL SELECT target, source, type FROM ce), h1 AS (SELECT other AS id, min(type) AS type FROM b WHERE node = 'projects/p1' AND other <> node AND other IN (SELECT id FROM cn) GROUP BY 1),
h2 AS (SELECT other AS id, min(b.type) AS type FROM b JOIN h1 ON b.node = h1.id WHERE other <> b.node AND other <> 'projects/p1' AND other NOT IN (SELECT id FROM h1) AND other IN (SELECT id FROM cn) GROUP BY 1), a AS (SELECT * FROM h1 UNION ALL SELECT * FROM h2) SELECT type, count(*) AS n FROM a GROUP BY 1""")
def context_explained(spark, sf_dir):
    nodes, edges = context(spark, sf_dir)
    return links.explain(storage.cut(edges), nodes, "projects/p1", 2)


LINK_GRAPH = f"WITH RECURSIVE {VAULT}, {WIKI}, e AS (SELECT source, target FROM links WHERE exists)"


def link_graph(spark, sf_dir):
    return links.page_links(vault(spark, sf_dir)).filter("exists").select("source", "target", F.lit("link").alias("type"))


@query(f"""{LINK_GRAPH}, w AS (SELECT 'inbox/2024-01-07/i60' AS node, ['inbox/2024-01-07/i60'] AS path UNION ALL SELECT e.target, list_append(w.path, e.target) FROM w JOIN e ON e.source = w.node WHERE w.node <> 'procedures/x2' AND len(w.path) <= 6 AND NOT list_contains(w.path, e.target))
SELECT array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS hops FROM w WHERE node = 'procedures/x2'""")
def simple_paths(spark, sf_dir):
    return graph.paths(link_graph(spark, sf_dir), "inbox/2024-01-07/i60", "procedures/x2", 6)


@query(f"{LINK_GRAPH}, d AS (SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e UNION ALL SELECT target FROM e) GROUP BY 1) SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 10")
def top_nodes(spark, sf_dir):
    return graph.top_nodes(graph.degrees(link_graph(spark, sf_dir)).select("node", (F.col("n_in") + F.col("n_out")).alias("degree")), "degree", 10)


ANALYTICS = f"{LINK_GRAPH}, {graph_sql.COMMUNITIES}, {graph_sql.CENTRALITY}, {graph_sql.BETWEENNESS}"


@query(f"{LINK_GRAPH}, {graph_sql.COMMUNITIES}, {graph_sql.CENTRALITY}, {graph_sql.BETWEENNESS_EXACT} SELECT node, centrality, betweenness, community FROM ce JOIN bt USING (node) JOIN cm USING (node)")
def graph_analytics(spark, sf_dir):
    return graph.analytics(link_graph(spark, sf_dir))


@query(f"{ANALYTICS}, nc AS (SELECT s.node, count(DISTINCT community) AS k FROM s JOIN cm ON cm.node = s.other GROUP BY 1) SELECT node, round(centrality + coalesce(k, 0) / (SELECT count(DISTINCT community) FROM cm), 6) AS score FROM ce LEFT JOIN nc USING (node) ORDER BY score DESC, node LIMIT 5")
def graph_entry_points(spark, sf_dir):
    return graph.entry_points(link_graph(spark, sf_dir))


@query()
def lint_suggested(spark, sf_dir):
    v = vault(spark, sf_dir)
    known = links.page_links(v)
    return quality_rules.with_suggestions(quality_rules.link_findings(v, known), v, known).withColumn("suggestions", F.array_join("suggestions", ","))


SHOWN = "body || chr(10) || '[the  index](../index.md#top) and ![no](/x.png) of <https://example.org/' || coalesce(status, 'none') || '>.' || chr(10) || '```' || chr(10) || '[[not/seen]]' || chr(10) || '```' || chr(10) || '`[[code/span]]` [up](../../..) [here](#there)'"
SEGMENT = r"^[A-Za-z0-9_][\w.-]*(/[A-Za-z0-9_][\w.-]*)*$"
#: A page's name with capitals.
TITLED = "array_to_string(list_transform(string_split(regexp_replace(string_split(t, '/')[-1], '[-_]', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"


@query(rf"""WITH {VAULT}, w AS (SELECT page_id, title, trim(unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1))) AS s FROM vault),
n AS (SELECT page_id, title, trim(CASE WHEN contains(s, '|') THEN regexp_replace(s, '^[^|]*\|', '') ELSE s END) AS t, CASE WHEN contains(s, '|') THEN trim(string_split(s, '|')[1]) END AS said FROM w),
p AS (SELECT page_id, title, string_split(page_id, '/') AS parts, coalesce(status, 'none') AS status FROM vault),
a AS (SELECT page_id, title, CASE WHEN regexp_matches(t, '{SEGMENT}') THEN t END AS target, '/' || t AS href, coalesce(said, {TITLED}) AS label FROM n
UNION SELECT page_id, title, CASE WHEN len(parts) >= 2 THEN array_to_string(list_append(parts[:-3], 'index'), '/') END, CASE WHEN len(parts) >= 2 THEN '/' || array_to_string(list_append(parts[:-3], 'index'), '/') || '#top' ELSE '../index.md#top' END, 'the index' FROM p
UNION SELECT page_id, title, NULL, 'https://example.org/' || status, 'https://example.org/' || status FROM p
UNION SELECT page_id, title, CASE WHEN len(parts) > 4 THEN array_to_string(parts[:-5], '/') END, CASE WHEN len(parts) > 4 THEN '/' || array_to_string(parts[:-5], '/') ELSE '../../..' END, 'up' FROM p UNION SELECT page_id, title, NULL, '#there', 'here' FROM p)
SELECT a.page_id AS source, a.title AS source_title, a.target, v.title AS target_title, a.href, a.label, a.target IS NULL OR v.page_id IS NOT NULL AS exists, a.target IS NULL AS external FROM a LEFT JOIN vault v ON v.page_id = a.target""")
def link_edges(spark, sf_dir):
    v = vault(spark, sf_dir)
    return links.link_edges(v.withColumn("body", F.expr(SHOWN)))


@query(f"WITH {VAULT}, s AS (SELECT page_id, unnest(sources) AS source FROM vault) SELECT *, regexp_matches(source, '^https?://') AS is_url FROM s")
def page_sources(spark, sf_dir):
    return links.url_sources(vault(spark, sf_dir))
