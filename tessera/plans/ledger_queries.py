"""Queries on the ledger of claims and the state around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.operators import ledger
from tessera.plans.registry import query
from tessera.sources import model

NOW = f"TIMESTAMP '{model.NOW}'"
LEDGER = model.cte("ledger")
LIVE = "candidate_type = 'claim' AND status IN ('candidate', 'active')"
VALID = f"(valid_from IS NULL OR valid_from <= {NOW}) AND (valid_until IS NULL OR valid_until > {NOW})"
UNATTRIBUTED = "(actor = 'ann' OR actor IS NULL OR actor = '')"


def now():
    return F.lit(model.NOW).cast("timestamp_ntz")


def rows(spark, sf_dir, name="ledger"):
    return model.frame(spark, sf_dir, name)


@query(f"WITH {LEDGER} SELECT candidate_id, created_at FROM ledger WHERE {LIVE} AND len(list_filter(source_page_ids, lambda x: contains(x, 'projects/p'))) > 0 ORDER BY created_at DESC, candidate_id LIMIT 200")
def candidate_filter(spark, sf_dir):
    return ledger.candidates(rows(spark, sf_dir), "claim", "rejected", ledger.LIVE, page="projects/p", limit=200).select("candidate_id", "created_at")


@query(f"WITH {LEDGER} SELECT candidate_id, strength FROM ledger WHERE {LIVE} AND lane = 'l1' AND strength >= 0.3 AND {UNATTRIBUTED} AND {VALID}")
def live_claim_filter(spark, sf_dir):
    return ledger.live_claims(rows(spark, sf_dir), lane="l1", least=0.3, valid_at=now(), actor="ann", unattributed=True).select("candidate_id", "strength")


@query(f"WITH {LEDGER} SELECT candidate_id, status FROM ledger WHERE {LIVE} AND norm_subject = 'user 13'")
def subject_claims(spark, sf_dir):
    return ledger.live_claims(rows(spark, sf_dir), subject=" USER  13 ").select("candidate_id", "status")


@query(f"WITH {LEDGER} SELECT candidate_id, epistemic_status, CASE WHEN epistemic_status = 'assumption' THEN 'assumption' ELSE 'untraced' END AS reason FROM ledger WHERE candidate_type = 'claim' AND status = 'candidate' AND (epistemic_status = 'assumption' OR (epistemic_status = 'inferred' AND trace_id IS NULL))")
def blocked_claims(spark, sf_dir):
    return ledger.blocked(rows(spark, sf_dir))


@query(f"WITH {LEDGER} SELECT candidate_id, concat_ws(' ', subject, predicate, object) AS label FROM ledger")
def candidate_labels(spark, sf_dir):
    return ledger.label(rows(spark, sf_dir))


SIGHTINGS = """s AS (SELECT event_id AS sighting, norm_subject AS subject, predicate, CASE WHEN object IN ('0', '1') THEN 'low' ELSE 'high' END AS object, CASE WHEN event_id % 2 = 0 THEN NULL ELSE 'ann' END AS actor,
confidence, epistemic_status, observed_at, valid_from, valid_until, source_capture_ids FROM ledger WHERE candidate_type = 'claim')"""
REINFORCED = f"""WITH {LEDGER}, {SIGHTINGS}, g AS (SELECT sha256(concat_ws(chr(10), subject, predicate, object)) AS dedupe_hash, actor, arg_min(sighting, (observed_at, sighting)) AS candidate_id, subject, predicate, object, count(*) AS seen,
min(observed_at) AS created_at, max(observed_at) AS updated_at, arg_min(valid_from, (observed_at, sighting)) FILTER (valid_from IS NOT NULL) AS valid_from, arg_min(valid_until, (observed_at, sighting)) FILTER (valid_until IS NOT NULL) AS valid_until,
arg_max(coalesce(confidence, 'unknown'), list_position(['unknown', 'low', 'medium', 'high'], coalesce(confidence, 'unknown'))) AS confidence, arg_max(epistemic_status, (observed_at, sighting)) FILTER (epistemic_status IS NOT NULL) AS epistemic_status
FROM s GROUP BY subject, predicate, object, actor)
SELECT *, round(least(1.0, 0.5 + 0.05 * (seen - 1)), 6)::DOUBLE AS strength, CASE WHEN seen > 1 AND confidence = 'high' AND epistemic_status = 'operator_declared' THEN 0.2::DOUBLE END AS decay_floor FROM g"""


def sightings(spark, sf_dir):
    claims = rows(spark, sf_dir).filter("candidate_type = 'claim'")
    return claims.select(F.col("event_id").alias("sighting"), "subject", "predicate", F.when(F.col("object").isin("0", "1"), " Low").otherwise("HIGH").alias("object"), F.when(F.col("event_id") % 2 == 1, "ann").alias("actor"), "confidence", "epistemic_status", "observed_at", "valid_from", "valid_until", "source_capture_ids")


@query(REINFORCED)
def claim_reinforce(spark, sf_dir):
    return ledger.reinforce(sightings(spark, sf_dir))


MERGED = f"""WITH a AS ({REINFORCED.replace("candidate_type = 'claim')", "candidate_type = 'claim' AND observed_at < TIMESTAMP '2024-01-15')", 1)}), b AS ({REINFORCED})
SELECT b.* REPLACE (greatest(a.decay_floor, b.decay_floor) AS decay_floor) FROM b LEFT JOIN a ON a.dedupe_hash = b.dedupe_hash AND a.actor IS NOT DISTINCT FROM b.actor"""


@query(MERGED)
def claim_merge(spark, sf_dir):
    seen, cut = sightings(spark, sf_dir), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return ledger.merge(ledger.reinforce(seen.filter(F.col("observed_at") < cut)), seen.filter(F.col("observed_at") >= cut))


@query(f"WITH {LEDGER}, {SIGHTINGS}, e AS (SELECT sha256(concat_ws(chr(10), subject, predicate, object)) AS dedupe_hash, actor, unnest(source_capture_ids) AS source, observed_at FROM s) SELECT dedupe_hash, actor, source, min(observed_at) AS first_at FROM e GROUP BY ALL")
def claim_sources(spark, sf_dir):
    return ledger.sources(sightings(spark, sf_dir).withColumn("source", F.explode("source_capture_ids")))


@query(f"WITH {LEDGER} SELECT coalesce(confidence, 'unknown') AS confidence, count(*) AS n FROM ledger GROUP BY 1")
def claim_confidence_counts(spark, sf_dir):
    return rows(spark, sf_dir).groupBy(F.coalesce("confidence", F.lit("unknown")).alias("confidence")).agg(F.count("*").alias("n"))


@query(f"WITH {LEDGER} SELECT status, count(*) AS n FROM ledger GROUP BY 1")
def claim_status_counts(spark, sf_dir):
    from tessera.operators import pages

    return pages.counts_by(rows(spark, sf_dir), "status")


def _new(spark, sf_dir, modulus, rest):
    return rows(spark, sf_dir).filter((F.col("event_id") % modulus == rest) & (F.col("candidate_type") == "claim")).withColumn("claim_id", F.col("event_id"))


NEW = "n AS (SELECT *, event_id AS claim_id FROM ledger WHERE event_id % {m} = {r} AND candidate_type = 'claim')"


@query(f"""WITH {LEDGER}, {NEW.format(m=3, r=1)}, j AS (SELECT n.claim_id, l.candidate_id, row_number() OVER (PARTITION BY n.claim_id ORDER BY l.updated_at DESC, l.candidate_id) AS k
FROM n JOIN (SELECT * FROM ledger WHERE {LIVE}) l ON n.norm_subject = l.norm_subject AND n.predicate = l.predicate AND n.object = l.object AND n.actor IS NOT DISTINCT FROM l.actor) SELECT claim_id, candidate_id FROM j WHERE k = 1""")
def claim_matching(spark, sf_dir):
    return ledger.matching(_new(spark, sf_dir, 3, 1), rows(spark, sf_dir))


def contradictions_sql(m: int, r: int) -> str:
    return f"""{NEW.format(m=m, r=r)}, x AS (SELECT n.claim_id, l.candidate_id FROM n JOIN (SELECT * FROM ledger WHERE {LIVE}) l ON n.norm_subject = l.norm_subject AND n.predicate = l.predicate AND n.object <> l.object
WHERE (l.valid_until IS NULL OR l.valid_until > coalesce(n.valid_from, n.observed_at)) AND (n.valid_until IS NULL OR l.valid_from IS NULL OR l.valid_from < n.valid_until) AND (n.actor IS NULL OR n.actor = '' OR n.actor = l.actor))"""


@query(f"WITH {LEDGER}, {contradictions_sql(4, 1)} SELECT * FROM x")
def claim_contradictions(spark, sf_dir):
    return ledger.contradicting(_new(spark, sf_dir, 4, 1), rows(spark, sf_dir), now())


GATE = """CASE WHEN o.actor IS DISTINCT FROM w.actor THEN 'actor' END, CASE WHEN NOT coalesce(coalesce(w.valid_from, w.observed_at) > coalesce(o.valid_from, o.observed_at), false) THEN 'not_newer' END,
CASE WHEN list_position(['unknown', 'low', 'medium', 'high'], coalesce(w.confidence, 'unknown')) <= list_position(['unknown', 'low', 'medium', 'high'], coalesce(o.confidence, 'unknown')) THEN 'confidence' END,
CASE WHEN w.epistemic_status = 'assumption' THEN 'assumption' END, CASE WHEN w.epistemic_status = 'inferred' AND w.trace_id IS NULL THEN 'untraced' END"""


@query(f"""WITH {LEDGER}, {contradictions_sql(2, 0)}, g AS (SELECT o.candidate_id AS old_id, w.candidate_id AS new_id, concat_ws(',', {GATE}) AS reasons FROM x JOIN ledger o ON o.candidate_id = x.candidate_id JOIN ledger w ON w.event_id = x.claim_id)
SELECT *, reasons = '' AS allowed FROM g""")
def supersession_gate(spark, sf_dir):
    claims = rows(spark, sf_dir)
    pairs = ledger.contradicting(_new(spark, sf_dir, 2, 0), claims, now())
    side = lambda s: claims.select(F.col("candidate_id").alias(f"{s}_id"), F.coalesce("valid_from", "observed_at").alias(f"{s}_at"), F.col("confidence").alias(f"{s}_confidence"), F.col("actor").alias(f"{s}_actor"), F.col("epistemic_status").alias(f"{s}_status"), F.col("trace_id").alias(f"{s}_trace"))
    named = pairs.select(F.col("candidate_id").alias("old_id"), F.concat(F.lit("c"), F.col("claim_id")).alias("new_id"))
    gated = ledger.supersession(named.join(side("old"), "old_id").join(side("new"), "new_id"))
    return gated.select("old_id", "new_id", F.array_join("reasons", ",").alias("reasons"), "allowed")


@query(f"""WITH {LEDGER}, {contradictions_sql(5, 2)}, m AS (SELECT claim_id, candidate_id FROM (SELECT n.claim_id, l.candidate_id, row_number() OVER (PARTITION BY n.claim_id ORDER BY l.updated_at DESC, l.candidate_id) AS k
FROM n JOIN (SELECT * FROM ledger WHERE {LIVE}) l ON n.norm_subject = l.norm_subject AND n.predicate = l.predicate AND n.object = l.object AND n.actor IS NOT DISTINCT FROM l.actor) WHERE k = 1),
p AS (SELECT DISTINCT x.candidate_id AS old_id, m.candidate_id AS new_id FROM x JOIN m USING (claim_id) WHERE x.candidate_id <> m.candidate_id),
g AS (SELECT old_id, new_id, concat_ws(',', {GATE}) AS reasons FROM p JOIN ledger o ON o.candidate_id = old_id JOIN ledger w ON w.candidate_id = new_id) SELECT *, reasons = '' AS allowed FROM g""")
def auto_supersede(spark, sf_dir):
    return ledger.auto_supersede(_new(spark, sf_dir, 5, 2), rows(spark, sf_dir), now())


REQUESTS = "CASE event_id % 5 WHEN 0 THEN 'c' || CAST(event_id AS STRING) WHEN 1 THEN 'none' ELSE 'c' || CAST(event_id - event_id % 5 AS STRING) END"
AGAIN = "'c' || CAST(event_id - event_id % 3 AS STRING)"
SUPERSEDE = f"""r AS (SELECT event_id AS place, CASE WHEN event_id % 17 = 0 THEN 'gone' ELSE candidate_id END AS old_id, {REQUESTS} AS new_id, CASE WHEN event_id % 3 = 0 THEN 'ann' END AS actor FROM ledger
UNION ALL SELECT event_id + 10000000, {AGAIN}, candidate_id, NULL FROM ledger),
t AS (SELECT place, r.old_id, r.new_id, CASE WHEN o.candidate_id IS NULL THEN 'old_missing' WHEN r.old_id = r.new_id THEN 'self' WHEN o.status NOT IN ('candidate', 'active') THEN 'not_live' WHEN w.candidate_id IS NULL THEN 'new_missing' ELSE 'superseded' END AS outcome
FROM r LEFT JOIN ledger o ON r.old_id = o.candidate_id AND (r.actor IS NULL OR r.actor = o.actor) LEFT JOIN ledger w ON r.new_id = w.candidate_id AND (r.actor IS NULL OR r.actor = w.actor)),
d AS (SELECT place, old_id, new_id, CASE WHEN outcome IN ('superseded', 'new_missing') AND place > min(place) FILTER (outcome = 'superseded') OVER (PARTITION BY old_id) THEN 'not_live' ELSE outcome END AS outcome FROM t)"""


def _requests(claims):
    first = claims.select(F.col("event_id").alias("place"), F.when(F.col("event_id") % 17 == 0, "gone").otherwise(F.col("candidate_id")).alias("old_id"), F.expr(REQUESTS).alias("new_id"), F.when(F.col("event_id") % 3 == 0, "ann").alias("actor"))
    return first.unionAll(claims.select(F.col("event_id") + 10_000_000, F.expr(AGAIN), "candidate_id", F.lit(None).cast("string")))


@query(f"WITH {LEDGER}, {SUPERSEDE} SELECT * FROM d")
def claim_supersede(spark, sf_dir):
    claims = rows(spark, sf_dir)
    return ledger.supersede(claims, _requests(claims))


@query(f"""WITH {LEDGER}, {SUPERSEDE}, a AS (SELECT old_id, new_id AS superseded_by FROM d WHERE outcome = 'superseded'), b AS (SELECT new_id, arg_max(old_id, place) AS supersedes FROM d WHERE outcome = 'superseded' GROUP BY 1)
SELECT candidate_id, CASE WHEN superseded_by IS NOT NULL THEN 'superseded' ELSE status END AS status, superseded_by, supersedes FROM ledger LEFT JOIN a ON candidate_id = old_id LEFT JOIN b ON candidate_id = new_id""")
def claims_superseded(spark, sf_dir):
    claims = rows(spark, sf_dir)
    return ledger.superseded(claims, ledger.supersede(claims, _requests(claims)))


WANTED = "CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'archived' WHEN 2 THEN 'rejected' ELSE 'superseded' END"


@query(f"""WITH {LEDGER}, w AS (SELECT CASE WHEN event_id % 13 = 0 THEN 'gone' ELSE candidate_id END AS candidate_id, {WANTED} AS to_status FROM ledger)
SELECT w.candidate_id, status AS old_status, to_status, CASE WHEN status IS NULL THEN 'missing' WHEN (status, to_status) IN (('candidate', 'active'), ('candidate', 'rejected'), ('active', 'superseded'), ('active', 'archived')) THEN 'changed' ELSE 'invalid' END AS outcome
FROM w LEFT JOIN ledger USING (candidate_id)""")
def claim_transitions(spark, sf_dir):
    claims = rows(spark, sf_dir)
    wanted = claims.select(F.when(F.col("event_id") % 13 == 0, "gone").otherwise(F.col("candidate_id")).alias("candidate_id"), F.expr(WANTED).alias("to_status"))
    return ledger.transition(claims, wanted)


def _disposable(x: str, capture: bool) -> str:
    words = f"list_has_any(regexp_split_to_array(string_split(lower({x}), '/')[-1], '[^a-z0-9]+'), {list(ledger.DISPOSABLE_TOKENS)})"
    folder = "" if capture else f"regexp_matches(lower({x}), '^(captures|inbox|notes)/') AND "
    return f"(contains(lower({x}), 'heartbeat-audit') OR regexp_matches(lower({x}), '^(eval|evaluation)/') OR contains(lower({x}), '/eval/') OR contains(lower({x}), '/evaluation/') OR ({folder}{words}))"


@query(f"""WITH {LEDGER}, k AS (SELECT *, list_filter(source_capture_ids, lambda x: NOT {_disposable('x', True)}) AS kc, list_filter(source_page_ids, lambda x: NOT {_disposable('x', False)}) AS kp FROM ledger WHERE status IN ('candidate', 'active'))
SELECT candidate_id, CASE WHEN NOT ((len(source_capture_ids) > 0 AND len(kc) = 0) OR (len(source_capture_ids) = 0 AND len(source_page_ids) > 0 AND len(kp) = 0)) THEN 'scrubbed' WHEN status = 'candidate' THEN 'rejected' ELSE 'archived' END AS action,
array_to_string(kc, ',') AS kept_captures, array_to_string(kp, ',') AS kept_pages FROM k WHERE len(kc) < len(source_capture_ids) OR len(kp) < len(source_page_ids)""")
def disposable_cleanup(spark, sf_dir):
    out = ledger.cleanup(rows(spark, sf_dir))
    return out.select("candidate_id", "action", F.array_join("kept_captures", ",").alias("kept_captures"), F.array_join("kept_pages", ",").alias("kept_pages"))


@query(f"WITH {LEDGER} SELECT candidate_id FROM ledger WHERE {LIVE} AND strength <= 0.01 AND coalesce(decay_floor, 0.01) <= 0.01 AND NOT coalesce(epistemic_status = 'operator_declared' AND confidence = 'high', false) AND last_decayed_at <= {NOW} - INTERVAL 10 DAYS")
def floored_claims(spark, sf_dir):
    return ledger.forget(rows(spark, sf_dir), now(), 10)


DECAYED = f"""f AS (SELECT *, greatest(0, date_diff('microsecond', coalesce(last_decayed_at, created_at), {NOW}) // 86400000000) AS days,
greatest(0.01, CASE WHEN decay_floor > 0.01 THEN least(decay_floor, 1.0) ELSE 0 END, CASE WHEN confidence = 'high' AND epistemic_status = 'operator_declared' THEN 0.2 ELSE 0 END)::DOUBLE AS least FROM ledger WHERE {LIVE}),
d AS (SELECT candidate_id, days, round(greatest(least, strength * power(0.995, days)), 6) AS strength, CASE WHEN least > 0.01 THEN least END AS decay_floor, CASE WHEN strength <= least AND last_decayed_at IS NOT NULL THEN last_decayed_at ELSE {NOW} END AS last_decayed_at FROM f)"""


@query(f"WITH {LEDGER}, {DECAYED} SELECT * FROM d")
def claim_decay(spark, sf_dir):
    return ledger.decay(rows(spark, sf_dir), now())


@query(f"WITH {LEDGER}, {DECAYED} SELECT count(*) AS n, round(min(strength), 4) AS least, round(max(strength), 4) AS most FROM d")
def decay_summary(spark, sf_dir):
    return ledger.decay_summary(ledger.decay(rows(spark, sf_dir), now()))


@query(f"WITH {model.cte('deadletters')} SELECT deadletter_id, failure_kind, created_at FROM deadletters WHERE status = 'unresolved' ORDER BY created_at, deadletter_id LIMIT 50")
def deadletter_queue(spark, sf_dir):
    return ledger.deadletter_queue(rows(spark, sf_dir, "deadletters"), "unresolved").select("deadletter_id", "failure_kind", "created_at")


@query(f"""WITH {model.cte('deadletters')}, t AS (SELECT deadletter_id, retry_count + CASE WHEN failure_kind = 'timeout' THEN 1 ELSE 0 END AS retry_count, CASE WHEN failure_kind = 'timeout' AND status = 'unresolved' THEN 'retried' ELSE status END AS status, failure_kind FROM deadletters)
SELECT deadletter_id, retry_count, CASE WHEN failure_kind <> 'timeout' THEN 'resolved' ELSE status END AS status FROM t""")
def deadletter_retry(spark, sf_dir):
    dead = rows(spark, sf_dir, "deadletters")
    after = ledger.retried(dead, dead.filter("failure_kind = 'timeout'"))
    return ledger.resolved(after, dead.filter("failure_kind <> 'timeout'")).select("deadletter_id", "retry_count", "status")


@query(f"WITH {model.cte('log')} SELECT DISTINCT capture_id FROM log WHERE success")
def processed_captures(spark, sf_dir):
    return ledger.processed(rows(spark, sf_dir, "log"))


RETRIED = "list_filter(source_capture_ids, lambda x: contains(x, '/i1'))"


def _reset(spark, sf_dir, delete):
    claims = rows(spark, sf_dir)
    wanted = claims.select(F.explode("source_capture_ids").alias("capture_id")).filter(F.col("capture_id").contains("/i1")).distinct()
    return ledger.reset(claims, wanted, delete).withColumn("kept", F.array_join("kept", ","))


@query(f"WITH {LEDGER} SELECT candidate_id, CASE WHEN len({RETRIED}) = len(source_capture_ids) THEN 'deleted' ELSE 'scrubbed' END AS action, array_to_string(list_sort(list_filter(source_capture_ids, lambda x: NOT contains(x, '/i1'))), ',') AS kept FROM ledger WHERE len({RETRIED}) > 0")
def extraction_reset(spark, sf_dir):
    return _reset(spark, sf_dir, True)


@query(f"WITH {LEDGER} SELECT candidate_id, 'reverted' AS action, array_to_string(list_sort(list_filter(source_capture_ids, lambda x: NOT contains(x, '/i1'))), ',') AS kept FROM ledger WHERE len({RETRIED}) > 0 AND status <> 'candidate'")
def extraction_revert(spark, sf_dir):
    return _reset(spark, sf_dir, False)


@query(f"WITH {model.cte('traces')} SELECT trace_id, created_at FROM traces WHERE task_id = 'T3' AND list_contains(policy_refs, 'review:v1')")
def trace_filter(spark, sf_dir):
    return ledger.traces(rows(spark, sf_dir, "traces"), task="T3", policy="review:v1").select("trace_id", "created_at")


@query(f"WITH {model.cte('traces')} SELECT count(*) AS n FROM traces WHERE status = 'completed' AND list_contains(policy_refs, 'protect:v1')")
def trace_count(spark, sf_dir):
    return ledger.traces(rows(spark, sf_dir, "traces"), status="completed", policy="protect:v1").agg(F.count("*").alias("n"))


@query(f"WITH {model.cte('plans')} SELECT plan_id, created_at FROM plans WHERE status = 'ready' AND target_page_id = 'projects/p1' ORDER BY created_at DESC, plan_id LIMIT 100")
def plan_filter(spark, sf_dir):
    return ledger.patch_plans(rows(spark, sf_dir, "plans"), "ready", "projects/p1").select("plan_id", "created_at")


@query(f"WITH {model.cte('batches')} SELECT * FROM batches ORDER BY created_at DESC, batch_id DESC LIMIT 100")
def batches_newest(spark, sf_dir):
    return ledger.batches(rows(spark, sf_dir, "batches"))


@query(f"WITH {model.cte('log')}, m AS (SELECT batch_id, source_key, max(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS n FROM log GROUP BY ALL) SELECT batch_id, sum(n)::BIGINT AS total_tokens FROM m GROUP BY 1")
def batch_tokens(spark, sf_dir):
    return ledger.batch_tokens(rows(spark, sf_dir, "log"))


@query(f"""WITH {model.cte('batches')}, r AS (SELECT * FROM batches WHERE total_tokens > 0 ORDER BY created_at DESC, batch_id DESC LIMIT 10)
SELECT (SELECT sum(total_tokens)::BIGINT FROM batches) AS total, (SELECT arg_max(total_tokens, (created_at, batch_id)) FROM r) AS last, (SELECT round(avg(total_tokens), 2) FROM r) AS recent_average""")
def batch_token_rollup(spark, sf_dir):
    return ledger.token_rollup(rows(spark, sf_dir, "batches"))


@query(f"WITH {model.cte('log', 'batches')} SELECT (SELECT count(DISTINCT capture_id) FROM log WHERE success) AS n_extracted, arg_max(batch_id, (created_at, batch_id)) AS last_batch, max(created_at) AS last_at FROM batches")
def extraction_status(spark, sf_dir):
    return ledger.extraction_status(rows(spark, sf_dir, "log"), rows(spark, sf_dir, "batches"))


@query(f"""WITH {model.cte('runs', 'plans')} SELECT 'last_run' AS field, arg_max(run_id, (started_at, run_id)) AS value FROM runs UNION ALL SELECT 'stuck_runs', (count(*) FILTER (status = 'running' AND started_at < TIMESTAMP '1996-01-01' - INTERVAL 1 HOUR))::VARCHAR FROM runs
UNION ALL SELECT 'plans:' || status, count(*)::VARCHAR FROM plans GROUP BY status""")
def consolidation_status(spark, sf_dir):
    return ledger.run_status(rows(spark, sf_dir, "runs"), rows(spark, sf_dir, "plans"), F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"))


@query(f"""WITH {model.cte('vault', 'ledger')}, c AS (SELECT status FROM vault WHERE kind = 'capture') SELECT 'captures' AS field, count(*) FILTER (status IN ('draft', 'accepted')) AS n FROM c UNION ALL SELECT 'drafts', count(*) FILTER (status = 'draft') FROM c
UNION ALL SELECT 'extracted', count(*) FILTER (status = 'accepted') FROM c UNION ALL SELECT 'candidates:' || status, count(*) FROM ledger GROUP BY status""")
def worker_status(spark, sf_dir):
    return ledger.worker_status(rows(spark, sf_dir, "vault").filter("kind = 'capture'"), rows(spark, sf_dir))


def recall_sql(text: str | None, limit: int, offset: int = 0, where: str = "TRUE") -> str:
    w = dict.fromkeys(scoring.PARTS, 0.0) | scoring.recall_weights(text is not None, False)
    relevance, keep = "1.0", "TRUE"
    if text:
        words = sorted(set(text.split()))
        relevance = f"len(list_intersect({words}, list_distinct(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object, evidence)), '[a-z0-9]+')))) / {len(words)}"
        keep = f"{relevance} > 0"
    return f"""WITH {LEDGER}, f AS (SELECT * FROM ledger WHERE {LIVE} AND {VALID} AND {where} ORDER BY strength DESC, updated_at DESC, candidate_id LIMIT {1500 if text else 500}),
s AS (SELECT *, greatest(0, least(1, strength)) AS strength_part, greatest(0, date_diff('microsecond', updated_at, {NOW}) / 86400e6) AS age, least(1.0, ln(1 + access_count) / ln(21)) AS sal, {relevance} AS rel, coalesce(valid_from, observed_at) AS began FROM f WHERE {keep}),
o AS (SELECT *, round(strength_part * {w['strength']} + power(0.5, age / 30.0) * {w['recency']} + sal * {w['salience']} + rel * {w['relevance']}, 6) AS own FROM s),
g AS (SELECT *, first_value(candidate_id) OVER z AS win_id, first_value(own) OVER z AS win, first_value(object) OVER z AS win_object FROM o WINDOW z AS (PARTITION BY norm_subject, predicate ORDER BY began DESC NULLS LAST, own DESC, strength DESC, candidate_id)),
t AS (SELECT *, round(CASE WHEN win_object <> object THEN least(own, greatest(0, win - 1e-6)) ELSE own END, 6) AS score FROM g)
SELECT candidate_id, score, round(strength_part, 6) AS strength_part, round(power(0.5, age / 30.0), 6) AS recency, round(sal, 6) AS salience, round(rel, 6)::DOUBLE AS relevance, round(age, 4) AS age_days, CASE WHEN win_object <> object THEN win_id END AS contradicted_by
FROM t ORDER BY score DESC, began DESC NULLS LAST, strength DESC, candidate_id LIMIT {limit} OFFSET {offset}"""


@query(recall_sql(None, 20))
def recall_scored(spark, sf_dir):
    return ledger.recall(rows(spark, sf_dir), now())


@query(recall_sql("click purchase 7", 200))
def recall_demoted(spark, sf_dir):
    return ledger.recall(rows(spark, sf_dir), now(), "click purchase 7", limit=200)


@query(recall_sql("services log", 25, 30, f"lane = 'l0' AND {UNATTRIBUTED} AND strength >= 0.1"))
def recall_page(spark, sf_dir):
    return ledger.recall(rows(spark, sf_dir), now(), "services log", limit=25, offset=30, lane="l0", actor="ann", least=0.1)


@query(f"""WITH {LEDGER}, a AS (SELECT DISTINCT 'c' || CAST(event_id % 300 AS STRING) AS candidate_id, event_id % 40 AS call_id, date_trunc('hour', ts) AS seen_at FROM events), c AS (SELECT candidate_id, call_id, max(seen_at) AS seen_at FROM a GROUP BY ALL), m AS (SELECT candidate_id, count(*) AS more, max(seen_at) AS last_access FROM c GROUP BY 1)
SELECT candidate_id, coalesce(access_count, 0) + more AS access_count, last_access FROM ledger JOIN m USING (candidate_id) WHERE candidate_type = 'claim' AND {UNATTRIBUTED}""")
def recall_acknowledged(spark, sf_dir):
    from tessera.sources.storage import table

    calls = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), (F.col("event_id") % 300).cast("string")).alias("candidate_id"), (F.col("event_id") % 40).alias("call_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"))
    return ledger.acknowledged(rows(spark, sf_dir), calls, "ann")


def _count(sql: str) -> str:
    return f"(SELECT count(*) FROM ({sql}))"


@query(f"""WITH {model.cte('vault', 'log')}, p AS (SELECT {_count(recall_sql('purchase 3', 20, 0, "(actor = 'nobody' OR actor IS NULL OR actor = '')"))} AS found, (SELECT count(*) FROM vault WHERE kind = 'capture' AND status = 'draft' AND page_id NOT IN (SELECT capture_id FROM log WHERE success)) AS pending,
{_count(recall_sql('purchase 3', 5))} AS elsewhere) SELECT *, CASE WHEN found > 0 THEN NULL WHEN pending > 0 THEN 'pending' WHEN elsewhere > 0 THEN 'elsewhere' ELSE 'nothing' END AS hint FROM p""")
def recall_probe(spark, sf_dir):
    return ledger.probe(rows(spark, sf_dir), rows(spark, sf_dir, "vault").filter("kind = 'capture'"), rows(spark, sf_dir, "log"), now(), "purchase 3", "nobody")


@query("""WITH o AS (SELECT event_id, user_id::VARCHAR AS subject, event_type AS predicate, floor(value / 250)::BIGINT::VARCHAR AS object, ts FROM events), v AS (SELECT event_id, subject, predicate, object, ts AS valid_from, lead(ts) OVER (PARTITION BY subject, predicate ORDER BY ts, event_id) AS valid_until FROM o)
SELECT * FROM v WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_until IS NULL OR valid_until > TIMESTAMP '2024-01-20')""")
def claims_valid_at(spark, sf_dir):
    from tessera.sources import adapters

    return ledger.valid_at(ledger.versions(adapters.observations(spark, sf_dir)), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
