"""The engine's wider model tables, made from the driver's tables by expressions that Spark and DuckDB read alike.

Each table is a map of column -> expression over one driver table. LIST(...) stands for an array of strings and NOLIST for
an empty one. `frame` gives the table as a DataFrame, `cte` as a common table expression for a query's SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.storage import table

TODAY = "2024-01-20"
NOW = "2024-02-01 00:00:00"


def text_of(number: str) -> str:
    return f"CAST({number} AS STRING)"


def two_digits(number: str) -> str:
    return f"lpad({text_of(number)}, 2, '0')"


def page_of(k: str) -> str:
    """The page id of a document's number."""
    return (
        f"CASE ({k}) % 8 WHEN 0 THEN 'services/s' WHEN 1 THEN 'projects/p' WHEN 2 THEN 'procedures/x' WHEN 3 THEN 'decisions/d' WHEN 4 THEN 'inbox/2024-01-0' || {text_of(f'({k}) % 9 + 1')} || '/i' "
        f"WHEN 5 THEN 'notes/a' || {text_of(f'({k}) % 3')} || '/2024-01-1' || {text_of(f'({k}) % 9')} || '/n' WHEN 6 THEN 'concepts/c' ELSE 'runbooks/r' END || {text_of(k)}"
    )


def share(n: int) -> str:
    return f"CAST(floor(doc_id / {n}) AS BIGINT)"


LINE = "chr(10)"
BODY = f" || {LINE} || ".join(
    [
        "'# ' || lang || ' notes'", "coalesce(text, '')", "''", "'## Facts'", "''", "'- The ' || source || ' service uses ' || lang || '.'", f"'- See [[' || {page_of(share(2))} || ']] first'",
        "CASE WHEN doc_id % 6 = 0 THEN '1. Requires ' || source ELSE '' END", "'## Related pages'", f"'- [[' || source || ' in ' || lang || '|' || {page_of(share(3))} || ']]'",
        "CASE WHEN doc_id % 23 = 0 THEN '[[concepts/missing' || CAST(doc_id AS STRING) || ']]' ELSE '' END", "'## Context'", "'This page is about ' || source", "'and was written in ' || lang",
        "CASE WHEN doc_id % 17 = 0 THEN 'CONFLICT: check  ' || lang ELSE '' END", "CASE WHEN doc_id % 19 = 0 THEN 'supersedes: the old ' || source ELSE '' END",
    ]
)

VAULT = {
    "doc_id": "doc_id",
    "page_id": page_of("doc_id"),
    "title": "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE lang || ' ' || source || ' guide ' || CAST(doc_id % 90 AS STRING) END",
    "kind": "CASE WHEN doc_id % 37 = 0 THEN NULL ELSE CASE doc_id % 8 WHEN 0 THEN 'service' WHEN 1 THEN 'project' WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'procedure-candidate' ELSE 'procedure' END WHEN 3 THEN 'decision' WHEN 6 THEN 'concept' WHEN 7 THEN 'runbook' ELSE 'capture' END END",
    "visibility": "CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'public' ELSE 'internal' END",
    "status": "CASE doc_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'accepted' WHEN 2 THEN 'active' WHEN 3 THEN 'rejected' ELSE NULL END",
    "summary": "CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'About ' || source || ' in ' || lang END",
    "tags": "LIST(lang, source)",
    "sources": "CASE WHEN doc_id % 5 = 0 THEN NOLIST ELSE LIST('src/' || source || '.py', 'https://example.org/' || lang) END",
    "source_paths": "CASE WHEN doc_id % 4 = 0 THEN LIST('lib/' || lang || '/' || source) ELSE NOLIST END",
    "actor": "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ann' WHEN 2 THEN 'bob' ELSE '' END",
    "lane": "CASE doc_id % 3 WHEN 0 THEN 'ops' WHEN 1 THEN 'project' ELSE NULL END",
    "confidence": "CASE doc_id % 6 WHEN 0 THEN 'low' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE NULL END",
    "epistemic_status": "CASE doc_id % 7 WHEN 0 THEN 'assumption' WHEN 1 THEN 'inferred' WHEN 2 THEN 'operator_declared' WHEN 3 THEN 'retrieved' WHEN 4 THEN 'hearsay' ELSE NULL END",
    "evidence": "CASE WHEN doc_id % 9 = 0 THEN 'seen' ELSE NULL END",
    "reviewed_at": "CASE WHEN doc_id % 11 = 0 THEN 'yesterday' WHEN doc_id % 3 = 0 THEN '2024-01-10' ELSE NULL END",
    "stale_after": f"CASE WHEN doc_id % 53 = 0 THEN 'soon' WHEN doc_id % 4 = 0 THEN '2024-01-' || {two_digits('doc_id % 28 + 1')} ELSE NULL END",
    "valid_until": f"CASE WHEN doc_id % 47 = 0 THEN 'never' WHEN doc_id % 10 = 0 THEN '2024-01-' || {two_digits('doc_id % 30 + 1')} || 'T08:00:00' ELSE NULL END",
    "observed_at": f"CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2024-01-' || {two_digits('doc_id % 28 + 1')} END",
    "trigger": "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 'when ' || source || ' fails' END",
    "schema_version": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE '1.0' END",
    "author": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'ann' END",
    "validated_at": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE '2024-01-02' END",
    "validated": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 4 = 1 END",
    "steps": "CASE WHEN doc_id % 4 = 1 THEN NOLIST ELSE LIST('check ' || source, 'deploy ' || lang, 'x') END",
    "source_task": "CASE WHEN doc_id % 31 = 0 THEN 'heartbeat-self-audit' WHEN doc_id % 6 = 0 THEN 'T' || CAST(doc_id % 20 AS STRING) ELSE NULL END",
    "suggested_target": f"CASE WHEN doc_id % 2 = 0 THEN NULL ELSE {page_of('doc_id - doc_id % 8')} END",
    "promoted_to": f"CASE WHEN doc_id % 10 = 4 THEN {page_of('doc_id - doc_id % 8')} ELSE NULL END",
    "policies": "CASE WHEN doc_id % 5 = 1 THEN LIST('protect:v1') ELSE NOLIST END",
    "body": BODY,
}

LEDGER = {
    "event_id": "event_id",
    "candidate_id": "'c' || CAST(event_id AS STRING)",
    "batch_id": "'b' || CAST(event_id % 25 AS STRING)",
    "candidate_type": "CASE event_id % 10 WHEN 0 THEN 'entity' WHEN 5 THEN 'invalidation' ELSE 'claim' END",
    "subject": "CASE WHEN user_id % 5 = 0 THEN 'services/s' || CAST(user_id AS STRING) ELSE 'User  ' || CAST(user_id AS STRING) END",
    "predicate": "event_type",
    "object": "CAST(CAST(floor(value / 125) AS BIGINT) AS STRING)",
    "norm_subject": "CASE WHEN user_id % 5 = 0 THEN 'services/s' || CAST(user_id AS STRING) ELSE 'user ' || CAST(user_id AS STRING) END",
    "evidence": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'seen in log ' || CAST(event_id % 7 AS STRING) END",
    "confidence": "CASE event_id % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE NULL END",
    "epistemic_status": "CASE event_id % 6 WHEN 0 THEN 'observed' WHEN 1 THEN 'inferred' WHEN 2 THEN 'assumption' WHEN 3 THEN 'operator_declared' WHEN 4 THEN 'hearsay' ELSE NULL END",
    "trace_id": "CASE WHEN event_id % 4 = 1 THEN 't' || CAST(event_id AS STRING) ELSE NULL END",
    "actor": "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ann' WHEN 2 THEN 'bob' ELSE '' END",
    "lane": "'l' || CAST(user_id % 3 AS STRING)",
    "status": "CASE event_id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'superseded' WHEN 2 THEN 'archived' WHEN 3 THEN 'candidate' WHEN 4 THEN 'candidate' ELSE 'active' END",
    "strength": "CASE WHEN event_id % 9 = 0 THEN CAST(0.01 AS DOUBLE) ELSE round(value / 500, 6) END",
    "decay_floor": "CASE WHEN event_id % 13 = 0 THEN CAST(0.3 AS DOUBLE) WHEN event_id % 13 = 1 THEN CAST(0.001 AS DOUBLE) ELSE NULL END",
    "access_count": "event_id % 13",
    "observed_at": "ts",
    "valid_from": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END",
    "valid_until": "CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 10 DAYS ELSE NULL END",
    "created_at": "ts",
    "updated_at": "CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 2 DAYS ELSE ts END",
    "last_decayed_at": "CASE WHEN event_id % 4 = 2 THEN ts + INTERVAL 1 DAYS ELSE NULL END",
    "source_page_ids": f"CASE WHEN event_id % 3 = 0 THEN NOLIST WHEN event_id % 3 = 1 THEN LIST({page_of('event_id % 200')}) ELSE LIST('captures/eval/x', {page_of('event_id % 160')}) END",
    "source_capture_ids": "CASE event_id % 11 WHEN 0 THEN LIST('inbox/2024-01-01/smoke-' || CAST(event_id % 9 AS STRING)) WHEN 1 THEN LIST('inbox/2024-01-01/a-test-b', 'inbox/2024-01-01/i' || CAST(event_id % 40 AS STRING)) WHEN 2 THEN NOLIST ELSE LIST('inbox/2024-01-01/i' || CAST(event_id % 40 AS STRING)) END",
}

TRACES = {
    "trace_id": "'t' || CAST(event_id AS STRING)",
    "actor": "CASE event_id % 3 WHEN 0 THEN 'ann' WHEN 1 THEN 'bob' ELSE NULL END",
    "lane": "'l' || CAST(user_id % 3 AS STRING)",
    "status": "CASE WHEN event_id % 5 = 0 THEN 'abandoned' ELSE 'completed' END",
    "reason_summary": "'Checked ' || event_type || ' of user ' || CAST(user_id AS STRING)",
    "outcome": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'done ' || event_type END",
    "policy_refs": "CASE WHEN event_id % 4 = 0 THEN LIST('protect:v1', 'review:v1') WHEN event_id % 4 = 1 THEN LIST('review:v1') ELSE NOLIST END",
    "task_id": "CASE WHEN event_id % 2 = 0 THEN 'T' || CAST(user_id % 20 AS STRING) ELSE NULL END",
    "page_id": page_of("event_id % 120"),
    "candidate_id": "'c' || CAST(event_id AS STRING)",
    "parent_trace_id": "CASE WHEN event_id % 10 = 3 THEN 't' || CAST(event_id - 3 AS STRING) ELSE NULL END",
    "created_at": "ts",
}

PLANS = {
    "plan_id": "'p' || CAST(o_orderkey AS STRING)",
    "batch_id": "'b' || CAST(o_orderkey % 25 AS STRING)",
    "status": "CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' WHEN 2 THEN 'needs_manual_review' WHEN 3 THEN 'applied' WHEN 4 THEN 'rejected' ELSE 'rolled_back' END",
    "target_page_id": page_of("o_orderkey % 100"),
    "operation": "CASE o_orderkey % 4 WHEN 0 THEN 'create_stub_page' WHEN 1 THEN 'insert_new_fact' WHEN 2 THEN 'update_existing_fact' ELSE 'mark_stale' END",
    "risk_level": "CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'low' END",
    "auto_appliable": "o_orderkey % 3 = 0",
    "policies": "CASE WHEN o_orderkey % 2 = 0 THEN LIST('review:v1') ELSE NOLIST END",
    "candidate_ids": "LIST('c' || CAST(o_orderkey % 1000 AS STRING), 'c' || CAST(o_orderkey % 777 AS STRING))",
    "created_at": "o_orderdate",
}

BATCHES = {
    "batch_id": "'b' || CAST(o_orderkey AS STRING)",
    "created_at": "o_orderdate",
    "total_tokens": "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey % 1000 END",
}

RUNS = {
    "run_id": "'r' || CAST(o_orderkey AS STRING)",
    "started_at": "o_orderdate",
    "status": "CASE WHEN o_orderkey % 11 = 0 THEN 'running' WHEN o_orderkey % 7 = 0 THEN 'completed_with_errors' ELSE 'completed' END",
}

LOG = {
    "capture_id": page_of("event_id % 90"),
    "batch_id": "'b' || CAST(event_id % 25 AS STRING)",
    "success": "event_id % 6 <> 0",
    "source_key": "CAST(event_id % 10 AS STRING)",
    "prompt_tokens": "user_id % 50",
    "completion_tokens": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 30 END",
}

DEADLETTERS = {
    "deadletter_id": "'d' || CAST(event_id AS STRING)",
    "capture_id": page_of("event_id % 90"),
    "failure_kind": "CASE WHEN value > 250 THEN 'timeout' ELSE 'schema_invalid' END",
    "status": "CASE event_id % 3 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'retried' ELSE 'resolved' END",
    "retry_count": "event_id % 4",
    "created_at": "ts",
}

#: Table -> (driver table, columns, condition).
TABLES: dict[str, tuple[str, dict[str, str], str]] = {
    "vault": ("documents", VAULT, "TRUE"),
    "ledger": ("events", LEDGER, "TRUE"),
    "traces": ("events", TRACES, "event_id % 4 = 1 OR event_id % 10 = 0"),
    "plans": ("orders", PLANS, "TRUE"),
    "batches": ("orders", BATCHES, "TRUE"),
    "runs": ("orders", RUNS, "TRUE"),
    "log": ("events", LOG, "TRUE"),
    "deadletters": ("events", DEADLETTERS, "event_type = 'error'"),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A model table as a DataFrame."""
    source, columns, condition = TABLES[name]
    plain = lambda e: e.replace("NOLIST", "CAST(array() AS array<string>)").replace("LIST(", "array(")
    return table(spark, sf_dir, source).filter(condition).selectExpr(*(f"{plain(e)} AS `{c}`" for c, e in columns.items()))


def cte(*names: str) -> str:
    """Model tables as DuckDB common table expressions, to follow WITH."""

    def one(name: str) -> str:
        source, columns, condition = TABLES[name]
        plain = lambda e: e.replace("NOLIST", "[]::VARCHAR[]").replace("LIST(", "list_value(")
        return f"{name} AS (SELECT {', '.join(f'{plain(e)} AS {c}' for c, e in columns.items())} FROM {source} WHERE {condition})"

    return ", ".join(one(n) for n in names)
