"""Queries on whole runs: batches stored in the ledger, captures tried one by one, consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import consolidation
from tessera.plans import ledger_queries
from tessera.plans.registry import query
from tessera.plans.work_queries import observed, policies, vault
from tessera.sources import model

LEDGER, NOW, LIVE = ledger_queries.LEDGER, ledger_queries.NOW, ledger_queries.LIVE
STORED = f"""s AS (SELECT *, 's' || CAST(event_id AS STRING) AS sighting FROM ledger WHERE event_id % 3 = 1 AND candidate_type = 'claim'),
k AS (SELECT norm_subject, predicate, object, actor, arg_min(candidate_id, (-epoch_us(updated_at), candidate_id)) AS known FROM ledger WHERE {LIVE} GROUP BY ALL),
g AS (SELECT norm_subject, predicate, object, actor, count(*) AS seen, ['unknown', 'low', 'medium', 'high'][max(list_position(['unknown', 'low', 'medium', 'high'], coalesce(confidence, 'unknown')))] AS best, arg_max(epistemic_status, event_id) FILTER (epistemic_status IS NOT NULL) AS last_status,
 arg_min(valid_from, event_id) FILTER (valid_from IS NOT NULL) AS first_from, arg_min(valid_until, event_id) FILTER (valid_until IS NOT NULL) AS first_until, arg_min(sighting, event_id) AS first FROM s GROUP BY ALL),
j AS (SELECT g.*, k.known FROM g LEFT JOIN k ON k.norm_subject = g.norm_subject AND k.predicate = g.predicate AND k.object = g.object AND k.actor IS NOT DISTINCT FROM g.actor),
h AS (SELECT l.candidate_id, l.status, j.seen, l.strength, l.decay_floor, l.valid_from, l.valid_until, l.updated_at, l.confidence AS old_confidence, l.epistemic_status AS old_status, j.*  EXCLUDE (seen),
 CASE WHEN j.seen IS NULL THEN l.confidence WHEN list_position(['unknown', 'low', 'medium', 'high'], best) > list_position(['unknown', 'low', 'medium', 'high'], coalesce(l.confidence, 'unknown')) THEN best ELSE coalesce(l.confidence, 'unknown') END AS confidence,
 CASE WHEN j.seen IS NULL THEN l.epistemic_status ELSE coalesce(last_status, l.epistemic_status) END AS epistemic_status FROM ledger l LEFT JOIN j ON j.known = l.candidate_id),
r AS (SELECT candidate_id, status, confidence, epistemic_status, CASE WHEN seen IS NULL THEN strength ELSE round(least(1.0, strength + 0.05 * seen), 6) END AS strength,
 CASE WHEN seen IS NULL THEN decay_floor ELSE greatest(CASE WHEN decay_floor > 0.01 THEN least(decay_floor, 1.0) END, CASE WHEN confidence = 'high' AND epistemic_status = 'operator_declared' THEN 0.2::DOUBLE END) END AS decay_floor,
 CASE WHEN seen IS NULL THEN valid_from ELSE coalesce(valid_from, first_from) END AS valid_from, CASE WHEN seen IS NULL THEN valid_until ELSE coalesce(valid_until, first_until) END AS valid_until, CASE WHEN seen IS NULL THEN updated_at ELSE {NOW} END AS updated_at FROM h
UNION ALL SELECT first, 'candidate', best, last_status, round(least(1.0, 0.5 + 0.05 * (seen - 1)), 6), CASE WHEN seen > 1 AND best = 'high' AND last_status = 'operator_declared' THEN 0.2::DOUBLE END, first_from, first_until, {NOW} FROM j WHERE known IS NULL)"""
RESULT = ("candidate_id", "status", "confidence", "epistemic_status", "strength", "decay_floor", "valid_from", "valid_until", "updated_at")


def batch(spark, sf_dir):
    rows = ledger_queries.rows(spark, sf_dir).filter("event_id % 3 = 1 and candidate_type = 'claim'")
    return rows.withColumns({"place": F.col("event_id"), "sighting": F.concat(F.lit("s"), F.col("event_id").cast("string"))}).drop("candidate_id", "status", "strength", "decay_floor", "access_count", "created_at", "updated_at", "last_decayed_at")


@query(f"WITH {LEDGER}, {STORED} SELECT {', '.join(RESULT)} FROM r")
def batch_stored(spark, sf_dir):
    after, _ = consolidation.store(ledger_queries.rows(spark, sf_dir), batch(spark, sf_dir), ledger_queries.now())
    return after.select(*RESULT)


@query(f"""WITH {LEDGER}, {STORED} SELECT s.event_id AS place, s.sighting, coalesce(known, first) AS candidate_id, CASE WHEN known IS NULL AND first = s.sighting THEN 'inserted' ELSE 'reinforced' END AS action
FROM s JOIN j ON j.norm_subject = s.norm_subject AND j.predicate = s.predicate AND j.object = s.object AND j.actor IS NOT DISTINCT FROM s.actor""")
def batch_outcomes(spark, sf_dir):
    return consolidation.store(ledger_queries.rows(spark, sf_dir), batch(spark, sf_dir), ledger_queries.now())[1]


def shaky(text: str) -> list[dict]:
    """An extractor that fails on texts of one language and gives a claim a heading in others."""
    if "This page is about src1" in text:
        raise ValueError("source is refused")
    return [{"subject": line[2:], "predicate": "heads", "object": "a page"} for line in text.split("\n") if line.startswith("# ")]


TRIED = "t AS (SELECT page_id AS capture_id, contains(body, 'This page is about src1') AS bad, len(list_filter(string_split(body, chr(10)), lambda x: starts_with(x, '# '))) AS n_claims FROM vault)"


@query(f"WITH {model.cte('vault')}, {TRIED} SELECT capture_id, 'ValueError' AS failure_kind, 'source is refused' AS failure FROM t WHERE bad")
def capture_failures(spark, sf_dir):
    return consolidation.attempt(observed(spark, sf_dir), shaky)[1]


@query(f"""WITH {model.cte('vault', 'deadletters')}, {TRIED} SELECT deadletter_id, retry_count + (status <> 'resolved')::INT AS retry_count,
CASE WHEN status <> 'resolved' AND capture_id IN (SELECT capture_id FROM t WHERE NOT bad AND n_claims > 0) THEN 'resolved' WHEN status = 'unresolved' THEN 'retried' ELSE status END AS status FROM deadletters""")
def deadletters_tried_again(spark, sf_dir):
    letters = model.frame(spark, sf_dir, "deadletters")
    return consolidation.retry(letters, observed(spark, sf_dir), shaky)[0].select("deadletter_id", "retry_count", "status")


def generation(spark, sf_dir) -> consolidation.Generation:
    """A run over the vault's drafts and the ledger."""
    v = vault(spark, sf_dir).filter("page_id is not null")
    none = lambda t: F.lit(None).cast(t)
    captures = v.select(
        F.col("page_id").alias("capture_id"), F.col("body").alias("observation"), F.coalesce("suggested_target", "title").alias("subject"), "suggested_target", F.nullif("actor", F.lit("")).alias("actor"), "lane", F.lower("confidence").alias("confidence"), "epistemic_status", none("string").alias("trace_id"),
        F.to_timestamp_ntz("observed_at", F.lit("yyyy-MM-dd")).alias("observed_at"), none("timestamp_ntz").alias("valid_from"), none("timestamp_ntz").alias("valid_until"), F.array().cast("array<string>").alias("source_page_ids"), "status",
    )
    pages = v.select("page_id", "title", "kind", "body")
    tables = (ledger_queries.rows(spark, sf_dir), model.frame(spark, sf_dir, "log"), model.frame(spark, sf_dir, "plans"))
    return consolidation.run(captures, *tables, pages, policies(spark), ledger_queries.now())


@query()
def consolidation_record(spark, sf_dir):
    return generation(spark, sf_dir).record


@query()
def consolidated_claims(spark, sf_dir):
    return generation(spark, sf_dir).claims.select("candidate_id", "subject", "predicate", "object", "status", "strength", "updated_at")


@query()
def consolidated_pages(spark, sf_dir):
    return generation(spark, sf_dir).pages.select("page_id", "kind", "body")


def patched(spark, sf_dir):
    """A plan for every page in turn: update its statement of a language, add a fact, mark it, or make a page beside it."""
    v = vault(spark, sf_dir).filter("page_id is not null")
    operation = F.element_at(F.array(*map(F.lit, ("update_existing_fact", "append_sourced_paragraph", "mark_stale", "create_stub_page"))), (F.col("doc_id") % 4 + 1).cast("int"))
    page = F.when(F.col("doc_id") % 4 == 3, F.concat("page_id", F.lit("-new"))).otherwise(F.col("page_id"))
    said = v.select("doc_id", "body", page.alias("page_id"), operation.alias("operation"), F.expr("'Runs on ' || tags[0]").alias("fact"), F.expr("'service uses ' || tags[0]").alias("old_fact"))
    return said, v.select("page_id", "title", "kind", "body")


@query(f"""WITH {model.cte('vault')}, t AS (SELECT doc_id, page_id, CASE WHEN doc_id % 4 = 0 THEN (length(b) - length(replace(b, lower('service uses ' || tags[1]), ''))) // length('service uses ' || tags[1]) END AS n FROM (SELECT *, lower(body[strpos(body, '## Facts'):strpos(body, '## Related pages')]) AS b FROM vault))
SELECT CASE WHEN doc_id % 4 = 3 THEN page_id || '-new' ELSE page_id END AS page_id, CASE WHEN doc_id % 4 = 0 AND n <> 1 THEN 'review' WHEN doc_id % 4 = 3 THEN 'created' ELSE CASE WHEN doc_id % 5 = 0 THEN 'changed_since' ELSE 'applied' END END AS outcome FROM t""")
def patch_outcomes(spark, sf_dir):
    from tessera.operators import patches

    said, pages = patched(spark, sf_dir)
    rendered = patches.render(said, pages)
    late = vault(spark, sf_dir).select("page_id", (F.col("doc_id") % 5 == 0).alias("late"))
    edited = pages.join(late, "page_id").withColumn("body", F.when(F.col("late"), F.concat("body", F.lit("\nedited"))).otherwise(F.col("body"))).drop("late")
    return patches.apply(edited, rendered)[1]
