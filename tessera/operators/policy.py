"""Policy rules, routing of claims to pages, patch plans and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.storage import cut

RISKS = ("low", "medium", "high")
POLICY_BOUND = 10_000
#: Kinds that are protected where a policy names none, operations that are risky, and the order of epistemic statuses.
PROTECTED = ("decision", "runbook")
RISKY = ("update_existing_fact", "mark_stale")
EPISTEMIC = ("operator_declared", "retrieved", "inferred", "assumption")
OPEN = ("pending", "ready", "needs_manual_review")


def evaluate(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """request_id, policy_id, gate, passed of every enabled policy that applies to a request, and of the epistemic gates.

    requests: request_id, kind, operation, contradicted, confident, epistemic_status, trace_id. policies: policy_id, gate,
    kinds and operations (arrays; empty: any), enabled. A policy for protected surfaces always applies, one that assesses
    risk applies to its kinds or its operations. Policies are a configuration table; more than POLICY_BOUND of them are
    refused, so they can be broadcast.
    """
    live = policies.filter("enabled")
    if live.limit(POLICY_BOUND + 1).count() > POLICY_BOUND:
        raise ValueError(f"more than {POLICY_BOUND} policies")
    p = F.broadcast(live.select("policy_id", "gate", "kinds", "operations"))
    of_kind, of_operation = F.array_contains("kinds", F.col("kind")), F.array_contains("operations", F.col("operation"))
    named = (F.size("kinds") > 0) & (F.size("operations") > 0)
    usual = ((F.size("kinds") == 0) | of_kind) & ((F.size("operations") == 0) | of_operation)
    applies = F.when(F.col("gate") == "protected-surface", True).when((F.col("gate") == "risk-assessment") & named, of_kind | of_operation).otherwise(usual)
    guarded = F.when(F.size("kinds") > 0, of_kind).otherwise(F.col("kind").isin(*PROTECTED))
    passed = (
        F.when(F.col("gate") == "auto-apply", F.col("confident") & ~F.col("contradicted") & ~guarded)
        .when(F.col("gate") == "protected-surface", ~guarded)
        .when(F.col("gate") == "contradiction-review", ~F.col("contradicted"))
        .when(F.col("gate") == "risk-assessment", ~F.col("operation").isin(*RISKY) & ~guarded)
        .otherwise(F.col("gate") != "review-required")
    )
    ruled = requests.join(p, applies).select("request_id", "policy_id", "gate", passed.alias("passed"))
    block = F.when(F.col("epistemic_status") == "assumption", "epistemic:assumption-block").when((F.col("epistemic_status") == "inferred") & F.col("trace_id").isNull(), "epistemic:inferred-review")
    gated = requests.select("request_id", block.alias("policy_id"), F.lit("epistemic-gate").alias("gate"), F.lit(False).alias("passed")).filter("policy_id is not null")
    return ruled.unionByName(gated)


def plannable(claims: DataFrame, plans: DataFrame) -> DataFrame:
    """Claims that are candidates and in no open plan (plans: status, candidate_ids)."""
    taken = plans.filter(F.col("status").isin(*OPEN)).select(F.explode("candidate_ids").alias("candidate_id")).distinct()
    return claims.filter("candidate_type = 'claim' and status = 'candidate'").join(taken, "candidate_id", "left_anti")


def is_capture(page: Column) -> Column:
    return page.rlike("^(inbox|notes)/")


def route(claims: DataFrame, captures: DataFrame) -> DataFrame:
    """candidate_id, target: the page that a claim belongs on.

    Its first source page that is no capture; else what the first of its captures that suggests one suggests (captures:
    page_id, suggested_target); else its subject if that is a page; else the memory of its actor, or the shared one.
    """
    pages = F.filter("source_page_ids", lambda p: ~is_capture(p))
    own = claims.select("candidate_id", "subject", "actor", F.get(pages, F.lit(0)).alias("page"), F.concat("source_capture_ids", F.filter("source_page_ids", is_capture)).alias("captures"))
    known = captures.filter("trim(suggested_target) <> ''").filter(~is_capture(F.col("suggested_target"))).select(F.col("page_id").alias("capture"), "suggested_target")
    asked = own.filter("page is null").select("candidate_id", F.posexplode("captures").alias("k", "capture")).join(known, "capture")
    first = asked.groupBy("candidate_id").agg(F.min_by("suggested_target", F.struct("k", "suggested_target")).alias("suggested"))
    named = F.when(F.col("subject").contains("/") & F.col("subject").rlike(r"^[A-Za-z0-9_][\w.-]*(/[A-Za-z0-9_][\w.-]*)+$") & ~is_capture(F.col("subject")), F.col("subject"))
    slug = F.coalesce(F.nullif(F.array_join(F.regexp_extract_all(F.lower("actor"), F.lit("[a-z0-9]+"), F.lit(0)), "-"), F.lit("")), F.lit("shared"))
    return own.join(first, "candidate_id", "left").select("candidate_id", F.coalesce("page", "suggested", named, F.concat(F.lit("memory/"), slug)).alias("target"))


def plan(claims: DataFrame, clashes: DataFrame, pages: DataFrame, policies: DataFrame, section: str = "## Facts") -> DataFrame:
    """One plan for each target page: target, n_claims, operation, risk, auto_appliable, epistemic_status.

    claims: candidate_id, target, confidence, epistemic_status, trace_id; clashes: candidate_id, or their target, and object
    of live claims that contradict them; pages: page_id, kind, body. A target that is no page is created; one with contradicted claims has an
    old fact updated if it holds one, else it is marked stale; others are appended to, or get their first facts. A plan
    applies by itself only if all is of high confidence, safe for the kind of page, and no policy fails.
    """
    clashes = clashes if "target" in clashes.columns else clashes.join(claims.select("candidate_id", "target"), "candidate_id")
    clash = cut(clashes.select("target", "object").distinct())  # of known size, so that few go to the bodies
    known = pages.select(F.col("page_id").alias("target"), "kind", F.contains(F.coalesce("body", F.lit("")), F.lit(section)).alias("sectioned"), F.lit(True).alias("known"))
    hits = pages.select(F.col("page_id").alias("target"), "body").join(clash, "target").filter(F.contains("body", "object")).select("target", F.lit(True).alias("held")).distinct()
    held = clash.select("target", F.lit(True).alias("clash")).distinct().join(hits, "target", "left")
    rank = lambda c: F.nullif(F.array_position(F.array(*(F.lit(e) for e in EPISTEMIC)), c), F.lit(0))
    by = claims.groupBy("target").agg(F.count("*").alias("n_claims"), F.count_if(F.coalesce(F.col("confidence") != "high", F.lit(True))).alias("unsure"), F.max(rank(F.col("epistemic_status"))).alias("weakest"), F.max("trace_id").alias("trace_id"))
    rows = by.join(known, "target", "left").join(held, "target", "left").na.fill(False, ["known", "held", "clash"])
    folder = F.regexp_replace(F.split("target", "/")[0], "s$", "")
    rows = rows.withColumn("kind", F.coalesce("kind", folder)).withColumn("confident", F.col("unsure") == 0).withColumn("epistemic_status", F.get(F.array(*(F.lit(e) for e in EPISTEMIC)), (F.col("weakest") - 1).cast("int")))
    operation = (
        F.when(~F.col("known"), "create_stub_page").when(F.col("clash") & F.col("held"), "update_existing_fact").when(F.col("clash"), "mark_stale")
        .when(F.col("sectioned"), "append_sourced_paragraph").otherwise("insert_new_fact")
    )
    rows = rows.withColumn("operation", operation).drop("sectioned")
    risk = (
        F.when(F.col("operation").isin(*RISKY), "high").when(F.col("kind").isin(*PROTECTED), F.when(F.col("clash"), "high").otherwise("medium"))
        .when(F.col("kind").isin("procedure", "service", "project", "ops"), F.when(F.col("clash"), "medium").otherwise("low")).otherwise("medium")
    )
    safe = F.when(F.col("operation") == "create_stub_page", F.col("confident") & (F.col("kind") != "decision")).when(F.col("operation").isin("insert_new_fact", "append_sourced_paragraph"), F.col("confident") & ~F.col("clash") & ~F.col("kind").isin(*PROTECTED)).otherwise(False)
    rows = rows.withColumn("risk", risk).withColumn("safe", safe)
    requests = rows.select(F.col("target").alias("request_id"), "kind", "operation", F.col("clash").alias("contradicted"), "confident", "epistemic_status", "trace_id")
    failed = evaluate(requests, policies).filter("not passed").groupBy(F.col("request_id").alias("target")).agg(F.bool_or(F.col("gate") == "risk-assessment").alias("risky"))
    rows = rows.join(failed, "target", "left")
    return rows.select("target", "n_claims", "operation", F.when(F.col("risky"), "high").otherwise(F.col("risk")).alias("risk"), (F.col("safe") & F.col("risky").isNull()).alias("auto_appliable"), "epistemic_status")


def apply_bounded(plans: DataFrame, most: int) -> DataFrame:
    """The plans that apply by themselves in one run: the first by claims, then target."""
    return plans.filter("auto_appliable").orderBy(F.desc("n_claims"), "target").limit(most)


def decide(plans: DataFrame, requests: DataFrame, claims: DataFrame) -> DataFrame:
    """plan_id, action, outcome of requests (plan_id, action: apply or reject, force): done, or why not.

    Settled plans can't be applied, nor plans that don't apply by themselves without force, nor those one of whose
    candidates is active already; only open plans can be rejected.
    """
    active = claims.filter("status = 'active'").select("candidate_id")
    taken = plans.select("plan_id", F.explode("candidate_ids").alias("candidate_id")).join(active, "candidate_id", "left_semi").select("plan_id", F.lit(True).alias("taken")).distinct()
    rows = requests.join(plans.select("plan_id", "status", "auto_appliable"), "plan_id", "left").join(taken, "plan_id", "left")
    applied = F.when(F.col("status").isin("applied", "rejected", "rolled_back"), "settled").when(~F.col("auto_appliable") & ~F.col("force"), "not_auto").when(F.col("taken"), "already_active").otherwise("done")
    rejected = F.when(F.col("status").isin(*OPEN), "done").otherwise("settled")
    return rows.select("plan_id", "action", F.when(F.col("status").isNull(), "missing").when(F.col("action") == "apply", applied).otherwise(rejected).alias("outcome"))


def advice(plans: DataFrame) -> DataFrame:
    """plan_id, advice: what a reviewer is told about a plan, a row each."""
    said = F.array(
        F.when(F.col("auto_appliable") & (F.col("risk_level") == "low"), F.lit("safe to apply")), F.when(F.col("risk_level") == "medium", F.lit("preview first")),
        F.when((F.col("risk_level") == "high") | F.col("target_page_id").rlike("^(decisions|runbooks)/"), F.lit("protected: audit and force")), F.when(F.col("operation").isin(*RISKY), F.lit("resolve contradictions by hand")),
    )
    return plans.select("plan_id", F.explode(F.array_compact(said)).alias("advice"))


def review(plans: DataFrame) -> DataFrame:
    """risk_level, n_plans, n_auto, advice: plans by risk, with the different advice given, in order."""
    by = plans.groupBy("risk_level").agg(F.count("*").alias("n_plans"), F.count_if("auto_appliable").alias("n_auto"))
    told = advice(plans).join(plans.select("plan_id", "risk_level"), "plan_id").groupBy("risk_level").agg(F.array_join(F.array_sort(F.collect_set("advice")), "; ").alias("advice"))
    return by.join(told, "risk_level", "left")


def insert_into_section(content: Column, heading: Column, block: Column) -> Column:
    """Content with a block under a heading; content as it is if the section has the block's text already, a new section if there is none."""
    lines = F.split(F.regexp_replace(content, r"\n+$", ""), "\n")
    at = F.array_position(F.transform(lines, lambda x: F.trim(x)), heading)
    rest = F.slice(lines, at.cast("int") + 1, F.size(lines))
    end = F.array_position(F.transform(rest, lambda x: x.rlike("^#{1,6} ")), F.lit(True))
    section = F.when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest)
    fold = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    there = F.exists(F.split(F.array_join(section, "\n"), r"\n\s*\n"), lambda p: fold(p) == fold(block))
    body = F.regexp_replace(F.array_join(rest, "\n"), r"^\s*\n", "")
    placed = F.concat(F.array_join(F.slice(lines, 1, at.cast("int")), "\n"), F.lit("\n\n"), block, F.lit("\n\n"), body, F.lit("\n"))
    fresh = F.concat(F.regexp_replace(content, r"\s+$", ""), F.lit("\n\n"), heading, F.lit("\n\n"), block, F.lit("\n"))
    return F.when(at == 0, fresh).when(there, content).otherwise(placed)


def failed_gates(decisions: DataFrame) -> DataFrame:
    """request_id, n_failed, gates of requests that a policy holds back."""
    return decisions.filter("not passed").groupBy("request_id").agg(F.count("*").alias("n_failed"), F.array_join(F.array_sort(F.collect_set("gate")), ",").alias("gates"))

