"""Queries of captures, extraction, policies and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import captures, extract, ledger, policy
from tessera.plans import ledger_queries
from tessera.plans.registry import query
from tessera.plans.vault_queries import CAPTURE, LOOSE
from tessera.sources import model

VAULT = model.cte("vault")


def vault(spark, sf_dir):
    return model.frame(spark, sf_dir, "vault")


def observed(spark, sf_dir):
    """Pages as captures, whose text is observed."""
    return vault(spark, sf_dir).select(F.col("page_id").alias("capture_id"), F.col("body").alias("observation"), F.coalesce("suggested_target", "title").alias("subject"), "suggested_target", "summary", F.coalesce("title", "page_id").alias("title"), "confidence", F.col("observed_at").alias("day"))


@query("""WITH b AS (SELECT conv_id, turn, text, 'inbox/2024-01-0' || (conv_id % 9 + 1)::VARCHAR || '/' || coalesce(nullif(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:10], '-'), ''), 'capture') AS base FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY text, conv_id, turn) AS k FROM b) SELECT conv_id, turn, CASE WHEN k = 1 THEN base ELSE base || '-' || k::VARCHAR END AS capture_id FROM r""")
def capture_build(spark, sf_dir):
    from tessera.sources.storage import table

    c = table(spark, sf_dir, "conversations").filter("text is not null")
    rows = c.select("conv_id", "turn", F.col("text").alias("observation"), F.concat(F.lit("2024-01-0"), (F.col("conv_id") % 9 + 1).cast("string")).alias("day"))
    return captures.build(rows, ("conv_id", "turn")).select("conv_id", "turn", "capture_id")


@query(f"WITH {VAULT} SELECT page_id AS capture_id, CASE WHEN doc_id % 3 = 0 THEN 'archived' ELSE status END AS status FROM vault WHERE {CAPTURE}")
def capture_transitions(spark, sf_dir):
    rows = vault(spark, sf_dir).filter("kind = 'capture'").filter(F.col("page_id").rlike("^(inbox|notes)/")).withColumnRenamed("page_id", "capture_id")
    wanted = rows.select("capture_id", F.when(F.col("doc_id") % 3 == 0, "archived").otherwise("lost").alias("status"))
    return captures.transition(rows, wanted).select("capture_id", "status")


@query(f"WITH {VAULT} SELECT page_id AS capture_id, nullif(trim(suggested_target), '') AS target, CASE WHEN nullif(trim(suggested_target), '') IS NULL THEN 'no_target' WHEN suggested_target IN (SELECT page_id FROM vault WHERE doc_id % 16 <> 0) THEN 'exists' ELSE 'promoted' END AS outcome FROM vault WHERE {CAPTURE}")
def capture_promotions(spark, sf_dir):
    v = vault(spark, sf_dir)
    return captures.promoted(v.filter("kind = 'capture'").filter(F.col("page_id").rlike("^(inbox|notes)/")), v.filter("doc_id % 16 <> 0"))


@query(f"""WITH {VAULT}, p AS (SELECT page_id, unnest(list_concat(sources, CASE WHEN doc_id % 7 = 0 THEN ['inbox/2024-01-05/i4', 'notes/none'] ELSE [] END)) AS capture_id FROM vault), c AS (SELECT * FROM vault WHERE {CAPTURE})
SELECT 'promoted' AS direction, page_id AS capture_id, promoted_to AS page_id, title, status FROM c WHERE promoted_to IS NOT NULL UNION ALL SELECT 'source', p.capture_id, p.page_id, c.title, c.status FROM p LEFT JOIN c ON c.page_id = p.capture_id WHERE {LOOSE.replace('page_id', 'p.capture_id')}""")
def promotion_audit(spark, sf_dir):
    v = vault(spark, sf_dir)
    named = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("inbox/2024-01-05/i4"), F.lit("notes/none"))).otherwise(F.array().cast("array<string>"))
    return captures.promotions(v.withColumn("sources", F.concat("sources", named)))


@query(f"WITH {VAULT}, f AS (SELECT observed_at AS day, substr(coalesce(nullif(trim(summary), ''), nullif(trim(body), ''), title), 1, 500) AS fact, length(coalesce(nullif(trim(summary), ''), nullif(trim(body), ''), title)) AS n0 FROM vault) SELECT day, CASE WHEN n0 <= 500 THEN fact ELSE rtrim(substr(fact, 1, 497)) || '...' END AS fact, count(*) AS n FROM f GROUP BY 1, 2")
def daily_facts(spark, sf_dir):
    return captures.daily_facts(observed(spark, sf_dir).withColumn("title", F.col("title")))


@query(f"WITH {VAULT}, d AS (SELECT coalesce(suggested_target, '(no target)') AS key, page_id FROM vault WHERE {CAPTURE}) SELECT key, count(*) AS n, min(page_id) AS first_id, max(page_id) AS last_id FROM d GROUP BY 1")
def digest_by_target(spark, sf_dir):
    rows = vault(spark, sf_dir).filter("kind = 'capture'").filter(F.col("page_id").rlike("^(inbox|notes)/")).withColumnRenamed("page_id", "capture_id")
    return captures.digest(rows, F.col("suggested_target"), "(no target)")


@query()
def repeat_groups(spark, sf_dir):
    rows = observed(spark, sf_dir).select("capture_id", "title", "observation")
    return captures.repeat_groups(rows)


BULLET = r"^\s*([-*+]\s+|\d+[.)]\s+)"


@query(rf"""WITH {VAULT}, l AS (SELECT page_id, string_split(coalesce(body, ''), chr(10)) AS lines FROM vault), b AS (SELECT page_id, list_transform(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}\S')), lambda x: trim(regexp_replace(x, '{BULLET}', ''))) AS listed, list_transform(list_filter(lines, lambda x: trim(x) <> '' AND NOT regexp_matches(ltrim(x), '^[#>]')), lambda x: trim(x))[:1] AS plain FROM l),
s AS (SELECT page_id, list_transform(list_transform(CASE WHEN len(listed) > 0 THEN listed ELSE plain END, lambda x: rtrim(x, '.')), lambda x: substr(CASE WHEN regexp_matches(x, '(?i)^(check|create|deploy|ensure|inspect|record|review|run|update|verify)\b') THEN x ELSE 'Review and apply: ' || x END, 1, 300)) AS said FROM b),
u AS (SELECT page_id, unnest(said) AS step, generate_subscripts(said, 1) AS k FROM s), f AS (SELECT page_id, step, min(k) AS k FROM u GROUP BY ALL)
SELECT * FROM (SELECT page_id AS capture_id, row_number() OVER (PARTITION BY page_id ORDER BY k) AS place, step FROM f) WHERE place <= 8""")
def procedure_steps(spark, sf_dir):
    return captures.steps(observed(spark, sf_dir))


PREDICATE = "CASE " + " ".join(f"WHEN regexp_matches(lower(unit), '{p}') THEN '{n}'" for n, p in extract.PREDICATES) + " ELSE 'describes' END"
UNITS = rf"""l AS (SELECT page_id, trim(unnest(string_split(body, chr(10))), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line, generate_subscripts(string_split(body, chr(10)), 1) AS n FROM vault),
h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+\S') AS heading, count(*) FILTER (regexp_matches(line, '^#{{1,6}}\s+\S')) OVER (PARTITION BY page_id ORDER BY n) AS s FROM l),
t AS (SELECT *, first_value(CASE WHEN heading THEN trim(substr(regexp_extract(line, '^#{{1,6}}\s+(.+?)\s*#*$', 1), 1, 120)) END) OVER (PARTITION BY page_id, s ORDER BY n) AS section FROM h),
k AS (SELECT *, regexp_matches(line, '^(?:[-*+]\s+|\d+[.)]\s+)(.+)$') AS bullet FROM t WHERE NOT heading AND line <> '' AND lower(coalesce(section, '')) NOT IN ({', '.join(repr(m) for m in extract.METADATA_SECTIONS)})),
g AS (SELECT page_id, s, section, bool_or(bullet) AS listed FROM k GROUP BY ALL),
u AS (SELECT page_id, n AS place, substr(trim(regexp_extract(line, '^(?:[-*+]\s+|\d+[.)]\s+)(.+)$', 1)), 1, 500) AS unit, section FROM k WHERE bullet
UNION ALL SELECT k.page_id, max(n), substr(string_agg(line, ' ' ORDER BY n), 1, 500), k.section FROM k JOIN g ON g.page_id = k.page_id AND g.s = k.s WHERE NOT listed AND NOT bullet AND NOT starts_with(line, '>') GROUP BY k.page_id, k.s, k.section)"""


@query(rf"""WITH {VAULT}, {UNITS}, c AS (SELECT page_id AS capture_id, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS unit_no, section, subject, {PREDICATE} AS predicate, unit AS object FROM u JOIN (SELECT page_id, coalesce(suggested_target, title) AS subject FROM vault) USING (page_id))
SELECT *, sha256(concat_ws(chr(10), lower(trim(regexp_replace(subject, '\s+', ' ', 'g'))), predicate, lower(trim(regexp_replace(object, '\s+', ' ', 'g'))))) AS dedupe_hash FROM c""")
def extracted_claims(spark, sf_dir):
    return extract.claims(observed(spark, sf_dir), "subject")


KIND = "CASE string_split(entity_id, '/')[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.ENTITY_TYPES.items()) + " ELSE 'concept' END"
ENTITIES = r"""el AS (SELECT page_id, unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)) AS s, generate_subscripts(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1), 1) AS k FROM vault),
ep AS (SELECT page_id, k, CASE WHEN contains(s, '|') THEN string_split(s, '|')[2] ELSE s END AS entity_id, CASE WHEN contains(s, '|') THEN string_split(s, '|')[1] ELSE upper(substr(string_split(s, '/')[-1], 1, 1)) || substr(string_split(s, '/')[-1], 2) END AS label FROM el), en AS (SELECT page_id AS capture_id, entity_id, arg_min(label, k) AS label FROM ep GROUP BY ALL)"""


@query(f"WITH {VAULT}, {ENTITIES} SELECT *, {KIND} AS entity_type FROM en")
def extracted_entities(spark, sf_dir):
    return extract.entities(observed(spark, sf_dir))


@query(f"WITH {VAULT}, {ENTITIES} SELECT DISTINCT coalesce(suggested_target, page_id) AS source, entity_id AS target, 'mentions' AS type FROM en JOIN vault ON page_id = capture_id WHERE suggested_target IS NULL OR suggested_target <> entity_id")
def extracted_edges(spark, sf_dir):
    return extract.edges(observed(spark, sf_dir))


@query(rf"""WITH {VAULT}, x AS (SELECT page_id AS capture_id, unnest(regexp_extract_all(body, '(?im)^\s*((?:contradicts|supersedes|replaces|invalidates)\s*:\s*\S[^\n]*)', 1)) AS x FROM vault) SELECT capture_id, lower(trim(string_split(x, ':')[1])) AS marker, trim(regexp_replace(x, '^[^:]*:', '')) AS target FROM x""")
def extracted_invalidations(spark, sf_dir):
    return extract.invalidations(observed(spark, sf_dir))


CHECKED = """w AS (SELECT 'k' || (event_id % 60)::VARCHAR AS capture_id, candidate_id, confidence, (trim(coalesce(CASE WHEN event_id % 60 < 12 OR event_id % 4 = 0 THEN '' ELSE subject END, '')) <> '') AS whole FROM ledger),
s AS (SELECT capture_id, count(*) AS n, count(*) FILTER (whole) AS ok, count(*) FILTER (whole AND confidence = 'low') AS low FROM w GROUP BY 1),
d AS (SELECT * FROM (SELECT capture_id, CASE WHEN ok = 0 THEN 'no_valid_claims' WHEN (n - ok) * 2 > n THEN 'mostly_dropped' WHEN ok >= 3 AND low * 5 > ok * 4 THEN 'low_confidence' END AS failure FROM s) WHERE failure IS NOT NULL)"""


def _checked(spark, sf_dir):
    rows = model.frame(spark, sf_dir, "ledger")
    named = rows.withColumn("capture_id", F.concat(F.lit("k"), (F.col("event_id") % 60).cast("string"))).withColumn("subject", F.when((F.col("event_id") % 60 < 12) | (F.col("event_id") % 4 == 0), "").otherwise(F.col("subject")))
    return extract.checked(named)


@query(f"WITH {model.cte('ledger')}, {CHECKED} SELECT candidate_id FROM w WHERE whole AND capture_id NOT IN (SELECT capture_id FROM d)")
def checked_claims(spark, sf_dir):
    return _checked(spark, sf_dir)[0].select("candidate_id")


@query(f"WITH {model.cte('ledger')}, {CHECKED} SELECT * FROM d")
def extraction_failures(spark, sf_dir):
    return _checked(spark, sf_dir)[1]


POLICIES = [
    ("auto:v1", "auto-apply", [], [], True), ("protect:v1", "protected-surface", ["decision", "service"], [], True), ("contradict:v1", "contradiction-review", [], [], True), ("risk:v1", "risk-assessment", ["project"], ["mark_stale"], True),
    ("review:v1", "review-required", ["concept"], ["create_stub_page"], True), ("off:v1", "auto-apply", [], [], False),
]
POLICY_KINDS = "policy_id string, gate string, kinds array<string>, operations array<string>, enabled boolean"
POLICY_SQL = "pol AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{g}', {k}::VARCHAR[], {o}::VARCHAR[], {e})" for i, g, k, o, e in POLICIES) + ") t(policy_id, gate, kinds, operations, enabled) WHERE enabled)"
DECISIONS = f"""pd AS (SELECT request_id, policy_id, gate, CASE gate WHEN 'auto-apply' THEN confident AND NOT contradicted AND NOT guarded WHEN 'protected-surface' THEN NOT guarded WHEN 'contradiction-review' THEN NOT contradicted WHEN 'risk-assessment' THEN operation NOT IN ('update_existing_fact', 'mark_stale') AND NOT guarded ELSE gate <> 'review-required' END AS passed
FROM (SELECT q.*, pol.*, CASE WHEN len(kinds) > 0 THEN list_contains(kinds, kind) ELSE kind IN ('decision', 'runbook') END AS guarded FROM q, pol WHERE gate = 'protected-surface' OR CASE WHEN gate = 'risk-assessment' AND len(kinds) > 0 AND len(operations) > 0 THEN list_contains(kinds, kind) OR list_contains(operations, operation) ELSE (len(kinds) = 0 OR list_contains(kinds, kind)) AND (len(operations) = 0 OR list_contains(operations, operation)) END)
UNION ALL SELECT request_id, CASE WHEN epistemic_status = 'assumption' THEN 'epistemic:assumption-block' ELSE 'epistemic:inferred-review' END, 'epistemic-gate', false FROM q WHERE epistemic_status = 'assumption' OR (epistemic_status = 'inferred' AND trace_id IS NULL))"""
REQUESTS = """SELECT doc_id AS request_id, coalesce(kind, 'page') AS kind, CASE doc_id % 4 WHEN 0 THEN 'create_stub_page' WHEN 1 THEN 'insert_new_fact' WHEN 2 THEN 'update_existing_fact' ELSE 'mark_stale' END AS operation, doc_id % 5 = 0 AS contradicted, coalesce(confidence = 'high', false) AS confident, epistemic_status, CASE WHEN doc_id % 2 = 0 THEN 't' END AS trace_id FROM vault"""


def requests(spark, sf_dir):
    d = F.col("doc_id")
    operation = F.when(d % 4 == 0, "create_stub_page").when(d % 4 == 1, "insert_new_fact").when(d % 4 == 2, "update_existing_fact").otherwise("mark_stale")
    return vault(spark, sf_dir).select(d.alias("request_id"), F.coalesce("kind", F.lit("page")).alias("kind"), operation.alias("operation"), (d % 5 == 0).alias("contradicted"), F.coalesce(F.col("confidence") == "high", F.lit(False)).alias("confident"), "epistemic_status", F.when(d % 2 == 0, "t").alias("trace_id"))


def policies(spark):
    return spark.createDataFrame(POLICIES, POLICY_KINDS)


@query(f"WITH {VAULT}, {POLICY_SQL}, q AS ({REQUESTS}), {DECISIONS} SELECT * FROM pd")
def policy_decisions(spark, sf_dir):
    return policy.evaluate(requests(spark, sf_dir), policies(spark))


@query(f"WITH {VAULT}, {POLICY_SQL}, q AS ({REQUESTS}), {DECISIONS} SELECT request_id, count(*) AS n_failed, array_to_string(list_sort(list(DISTINCT gate)), ',') AS gates FROM pd WHERE NOT passed GROUP BY 1")
def policy_holds(spark, sf_dir):
    return policy.failed_gates(policy.evaluate(requests(spark, sf_dir), policies(spark)))


OPEN = "(SELECT unnest(candidate_ids) FROM plans WHERE status IN ('pending', 'ready', 'needs_manual_review'))"


@query(f"WITH {model.cte('ledger', 'plans')} SELECT candidate_id FROM ledger WHERE candidate_type = 'claim' AND status = 'candidate' AND candidate_id NOT IN {OPEN}")
def plannable_claims(spark, sf_dir):
    return policy.plannable(model.frame(spark, sf_dir, "ledger"), model.frame(spark, sf_dir, "plans")).select("candidate_id")


ROUTED = f"""ro AS (SELECT candidate_id, subject, actor, list_filter(source_page_ids, lambda x: NOT regexp_matches(x, '^(inbox|notes)/'))[1] AS page, list_concat(source_capture_ids, list_filter(source_page_ids, lambda x: regexp_matches(x, '^(inbox|notes)/'))) AS caps FROM ledger),
rs AS (SELECT candidate_id, arg_min(suggested_target, k) AS suggested FROM (SELECT candidate_id, unnest(caps) AS cap, generate_subscripts(caps, 1) AS k FROM ro) JOIN vault ON page_id = cap WHERE trim(suggested_target) <> '' AND NOT regexp_matches(suggested_target, '^(inbox|notes)/') GROUP BY 1),
routed AS (SELECT candidate_id, coalesce(page, suggested, CASE WHEN contains(subject, '/') THEN subject END, 'memory/' || CASE WHEN trim(coalesce(actor, '')) = '' THEN 'shared' ELSE actor END) AS target FROM ro LEFT JOIN rs USING (candidate_id))"""


@query(f"WITH {model.cte('vault', 'ledger')}, {ROUTED} SELECT * FROM routed")
def claim_routes(spark, sf_dir):
    return policy.route(model.frame(spark, sf_dir, "ledger"), vault(spark, sf_dir))


PLAN = f"""WITH {model.cte('vault', 'ledger')}, {ROUTED}, {POLICY_SQL}, cl AS (SELECT l.candidate_id, l.confidence, l.epistemic_status, l.trace_id, l.event_id, target FROM ledger l JOIN routed USING (candidate_id) WHERE candidate_type = 'claim' AND status = 'candidate'),
{ledger_queries.contradictions_sql(1, 0)}, ob AS (SELECT DISTINCT cl.target, o.object FROM x JOIN cl ON cl.event_id = x.claim_id JOIN ledger o ON o.candidate_id = x.candidate_id), hd AS (SELECT ob.target, coalesce(bool_or(contains(body, object)), false) AS held FROM ob LEFT JOIN vault ON page_id = target GROUP BY 1),
a AS (SELECT target, count(*) AS n_claims, count(*) FILTER (coalesce(confidence <> 'high', true)) = 0 AS confident, max(list_position(['operator_declared', 'retrieved', 'inferred', 'assumption'], epistemic_status)) AS weakest, max(trace_id) AS trace_id FROM cl GROUP BY 1),
p AS (SELECT a.*, v.page_id IS NOT NULL AS known, coalesce(v.kind, regexp_replace(string_split(target, '/')[1], 's$', '')) AS kind, coalesce(v.body, '') AS body, hd.target IS NOT NULL AS clash, coalesce(held, false) AS held, ['operator_declared', 'retrieved', 'inferred', 'assumption'][weakest] AS epistemic_status FROM a LEFT JOIN vault v ON v.page_id = a.target LEFT JOIN hd USING (target)),
o AS (SELECT *, CASE WHEN NOT known THEN 'create_stub_page' WHEN clash AND held THEN 'update_existing_fact' WHEN clash THEN 'mark_stale' WHEN contains(body, '## Facts') THEN 'append_sourced_paragraph' ELSE 'insert_new_fact' END AS operation FROM p),
r AS (SELECT *, CASE WHEN operation IN ('update_existing_fact', 'mark_stale') THEN 'high' WHEN kind IN ('decision', 'runbook') THEN CASE WHEN clash THEN 'high' ELSE 'medium' END WHEN kind IN ('procedure', 'service', 'project', 'ops') THEN CASE WHEN clash THEN 'medium' ELSE 'low' END ELSE 'medium' END AS risk,
CASE WHEN operation = 'create_stub_page' THEN confident AND kind <> 'decision' WHEN operation IN ('insert_new_fact', 'append_sourced_paragraph') THEN confident AND NOT clash AND kind NOT IN ('decision', 'runbook') ELSE false END AS safe FROM o),
q AS (SELECT target AS request_id, kind, operation, clash AS contradicted, confident, epistemic_status, trace_id FROM r), {DECISIONS}, fl AS (SELECT request_id AS target, bool_or(gate = 'risk-assessment') AS risky FROM pd WHERE NOT passed GROUP BY 1)
SELECT target, n_claims, operation, CASE WHEN risky THEN 'high' ELSE risk END AS risk, safe AND risky IS NULL AS auto_appliable, epistemic_status FROM r LEFT JOIN fl USING (target)"""


def plans(spark, sf_dir):
    rows, v = model.frame(spark, sf_dir, "ledger"), vault(spark, sf_dir)
    routed = policy.route(rows, v)
    claims = rows.filter("candidate_type = 'claim' and status = 'candidate'").join(routed, "candidate_id")
    new = claims.withColumn("claim_id", F.col("candidate_id"))
    pairs = ledger.contradicting(new, rows, ledger_queries.now()).withColumnRenamed("candidate_id", "old_id")
    clashes = pairs.join(rows.select(F.col("candidate_id").alias("old_id"), "object"), "old_id").select(F.col("claim_id").alias("candidate_id"), "object")
    return policy.plan(claims, clashes, v, policies(spark))


@query(PLAN)
def patch_plans(spark, sf_dir):
    return plans(spark, sf_dir)


ASKED = "SELECT CASE WHEN o_orderkey % 19 = 0 THEN 'none' ELSE 'p' || o_orderkey::VARCHAR END AS plan_id, CASE WHEN o_orderkey % 5 = 0 THEN 'reject' ELSE 'apply' END AS action, o_orderkey % 2 = 0 AS force FROM orders"


@query(f"""WITH {model.cte('plans', 'ledger')}, q AS ({ASKED}), t AS (SELECT DISTINCT plan_id FROM (SELECT plan_id, unnest(candidate_ids) AS candidate_id FROM plans) JOIN ledger USING (candidate_id) WHERE ledger.status = 'active')
SELECT q.plan_id, action, CASE WHEN status IS NULL THEN 'missing' WHEN action = 'reject' THEN CASE WHEN status IN ('pending', 'ready', 'needs_manual_review') THEN 'done' ELSE 'settled' END
WHEN status IN ('applied', 'rejected', 'rolled_back') THEN 'settled' WHEN NOT auto_appliable AND NOT force THEN 'not_auto' WHEN q.plan_id IN (SELECT plan_id FROM t) THEN 'already_active' ELSE 'done' END AS outcome FROM q LEFT JOIN plans USING (plan_id)""")
def plan_decisions(spark, sf_dir):
    from tessera.sources.storage import table

    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(F.when(key % 19 == 0, "none").otherwise(F.concat(F.lit("p"), key.cast("string"))).alias("plan_id"), F.when(key % 5 == 0, "reject").otherwise("apply").alias("action"), (key % 2 == 0).alias("force"))
    return policy.decide(model.frame(spark, sf_dir, "plans"), asked, model.frame(spark, sf_dir, "ledger"))


ADVICE = """a AS (SELECT risk_level, unnest(list_filter([CASE WHEN auto_appliable AND risk_level = 'low' THEN 'safe to apply' END, CASE WHEN risk_level = 'medium' THEN 'preview first' END, CASE WHEN risk_level = 'high' OR regexp_matches(target_page_id, '^(decisions|runbooks)/') THEN 'protected: audit and force' END,
CASE WHEN operation IN ('update_existing_fact', 'mark_stale') THEN 'resolve contradictions by hand' END], lambda x: x IS NOT NULL)) AS advice FROM plans)"""


@query(f"WITH {model.cte('plans')}, {ADVICE} SELECT risk_level, count(*) AS n_plans, count(*) FILTER (auto_appliable) AS n_auto, (SELECT array_to_string(list_sort(list(DISTINCT advice)), '; ') FROM a WHERE a.risk_level = plans.risk_level) AS advice FROM plans GROUP BY risk_level")
def plan_review(spark, sf_dir):
    return policy.review(model.frame(spark, sf_dir, "plans"))


FACT = "'## Facts' || chr(10) || chr(10)"


@query(rf"""WITH {VAULT} SELECT page_id, regexp_replace(replace(body, {FACT}, {FACT} || 'Checked by ' || coalesce(author, 'nobody') || chr(10) || chr(10)), '\s+$', '') || chr(10) AS content FROM vault""")
def rendered_patches(spark, sf_dir):
    """Each page with a fact inserted into its section of facts."""
    rows = vault(spark, sf_dir)
    return rows.select("page_id", policy.insert_into_section(F.col("body"), F.lit("## Facts"), F.concat(F.lit("Checked by "), F.coalesce("author", F.lit("nobody")))).alias("content"))
