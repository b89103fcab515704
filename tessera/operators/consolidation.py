"""One consolidation run: captures become claims, claims settle, plans are made and the safe ones applied.

Every step takes tables and gives new ones. A run's outputs are one generation: claims, sources, pages, plans, log, dead
letters, sweep and the record of the run, each written once or made of written ones, so that a reader sees all of a run or
nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions.text import claim_hash
from tessera.operators import extract, ledger, policy
from tessera.sources.storage import cut

#: Kinds of pages that no run changes by itself.
GUARDED = ("decision", "runbook")
Extractor = Callable[[str], list[dict]]
ATTEMPT = "capture_id string, unit_no long, section string, subject string, predicate string, object string, confidence string, epistemic_status string, failure_kind string, failure string"


def attempt(captures: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """Claims, and failures (capture_id, failure_kind, failure), of captures (capture_id, observation).

    extractor turns a text into claims (subject, predicate, object and optional fields), or raises. A capture whose text
    makes it raise, or that gives something else than claims, fails alone and has no claims; the others keep theirs. Both
    outputs are read from one run of the extractor.
    """
    fields = ("section", "subject", "predicate", "object", "confidence", "epistemic_status")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for capture, text in zip(frame["capture_id"], frame["observation"]):
                try:
                    made = [tuple(None if c.get(f) is None else str(c[f]) for f in fields) for c in extractor(text or "")]
                except Exception as e:  # noqa: BLE001 - whatever an extractor raises is that capture's failure
                    rows.append((capture, 0, *[None] * 6, type(e).__name__, str(e)[:500]))
                else:
                    rows += [(capture, k, *m, None, None) for k, m in enumerate(made)]
            yield pd.DataFrame(rows, columns=["capture_id", "unit_no", *fields, "failure_kind", "failure"])

    tried = cut(captures.select(F.col("capture_id").cast("string").alias("capture_id"), "observation").mapInPandas(run, ATTEMPT))
    return tried.filter("failure_kind is null").drop("failure_kind", "failure"), tried.filter("failure_kind is not null").select("capture_id", "failure_kind", "failure")


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of rows with an equal key (nulls equal) the first by order; one aggregation, so a hot key is combined where it lies."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*key).agg(first.alias("_row")).select("_row.*")


def retry(deadletters: DataFrame, captures: DataFrame, extractor: Extractor) -> tuple[DataFrame, DataFrame]:
    """Dead letters after their captures are tried again, and the claims that this gave.

    Only captures with a letter that isn't resolved are read. A letter has one more retry; it is resolved if its capture
    gives claims now, else it stays, as retried. Letters of captures that are gone only count.
    """
    open_ = deadletters.filter("status <> 'resolved'")
    again = captures.join(open_.select("capture_id").distinct(), "capture_id", "left_semi")
    claims, _ = attempt(again, extractor)
    good = claims.select("capture_id", F.lit(True).alias("_good")).distinct()
    tried = F.col("status") != "resolved"
    marked = deadletters.join(good, "capture_id", "left")
    status = F.when(tried & F.col("_good"), "resolved").when(tried & (F.col("status") == "unresolved"), "retried").otherwise(F.col("status"))
    return marked.withColumn("retry_count", F.col("retry_count") + tried.cast("int")).withColumn("status", status).drop("_good"), claims


def store(claims: DataFrame, batch: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The ledger after a batch of sightings, and (sighting, candidate_id, action) for each: reinforced or inserted.

    A sighting (place, sighting, subject, predicate, object, actor and the other columns of a claim) reinforces the latest
    live claim of its folded triple and actor; the first of a new triple is inserted, later ones reinforce it. Rows of the
    batch that are no claims are inserted as they are. Confidence never falls, an epistemic status is the last one given,
    times of validity the first ones given, and a floor is raised where the final confidence and status ask for it.
    """
    old = claims.columns
    hashed = lambda df: df.withColumn("_hash", claim_hash(F.col("subject"), F.col("predicate"), F.col("object")))
    sightings = hashed(batch.filter("candidate_type = 'claim'"))
    present = hashed(ledger.live(claims.filter("candidate_type = 'claim'"))).groupBy("_hash", "actor").agg(F.min_by("candidate_id", F.struct((-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("late"), "candidate_id")).alias("known"))
    order = F.struct("place", "sighting")
    given = lambda c, by: by(c, F.when(F.col(c).isNotNull(), order)).alias(f"_{c}")
    best = F.max(F.struct(scoring.confidence_rank(F.col("confidence")).alias("rank"), F.coalesce("confidence", F.lit("unknown")).alias("name")))["name"].alias("_confidence")
    kept = [c for c in old if c in sightings.columns]
    groups = sightings.groupBy("_hash", "actor").agg(F.count("*").alias("_seen"), best, given("epistemic_status", F.max_by), given("valid_from", F.min_by), given("valid_until", F.min_by), F.min_by(F.struct("sighting", *kept), order).alias("_first"))
    groups = groups.join(present.withColumnsRenamed({"_hash": "p_hash", "actor": "p_actor"}), (F.col("_hash") == F.col("p_hash")) & F.col("actor").eqNullSafe(F.col("p_actor")), "left")
    groups = cut(groups.select("_hash", F.col("actor").alias("_actor"), "_seen", "_confidence", "_epistemic_status", "_valid_from", "_valid_until", "_first", "known"))
    rank = lambda c: scoring.confidence_rank(F.col(c))
    known = cut(groups.filter("known is not null").withColumnRenamed("known", "candidate_id").drop("_first", "_hash", "_actor"))  # of known size, so that few go to the ledger
    after = claims.join(known, "candidate_id", "left")
    hit = F.col("_seen").isNotNull()
    confidence = F.when(hit & (rank("_confidence") > rank("confidence")), F.col("_confidence")).when(hit, F.coalesce("confidence", F.lit("unknown"))).otherwise(F.col("confidence"))
    status = F.when(hit, F.coalesce("_epistemic_status", "epistemic_status")).otherwise(F.col("epistemic_status"))
    new = {
        "confidence": confidence,
        "epistemic_status": status,
        "strength": F.when(hit, F.round(F.least(F.lit(1.0), F.col("strength") + scoring.STEP * F.col("_seen")), 6)).otherwise(F.col("strength")),
        "decay_floor": F.when(hit, F.greatest(ledger.stored_floor(F.col("decay_floor")), ledger.decay_floor(confidence, status))).otherwise(F.col("decay_floor")),
        "valid_from": F.when(hit, F.coalesce("valid_from", "_valid_from")).otherwise(F.col("valid_from")),
        "valid_until": F.when(hit, F.coalesce("valid_until", "_valid_until")).otherwise(F.col("valid_until")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    reinforced = after.select(*((new[c] if c in new else F.col(c)).alias(c) for c in old))
    fresh = groups.filter("known is null")
    seen = F.col("_seen")
    made = {c: F.col(f"_first.{c}") for c in kept} | {
        "candidate_id": F.col("_first.sighting"), "status": F.lit("candidate"), "confidence": F.col("_confidence"), "epistemic_status": F.col("_epistemic_status"), "valid_from": F.col("_valid_from"), "valid_until": F.col("_valid_until"),
        "strength": F.round(scoring.reinforced(ledger.FIRST_STRENGTH, seen), 6), "decay_floor": F.when(seen > 1, ledger.decay_floor(F.col("_confidence"), F.col("_epistemic_status"))), "created_at": now, "updated_at": now, "access_count": F.lit(0),
    }
    types = {f.name: f.dataType for f in claims.schema}
    shaped = lambda df, values: df.select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in old))
    plain = batch.filter("candidate_type <> 'claim'")
    others = {c: F.col(c) for c in kept} | {"candidate_id": F.col("sighting"), "status": F.lit("candidate"), "strength": F.lit(ledger.FIRST_STRENGTH), "created_at": now, "updated_at": now, "access_count": F.lit(0)}
    after = reinforced.unionByName(shaped(fresh, made)).unionByName(shaped(plain, others))
    stored = sightings.select("place", "sighting", "_hash", F.col("actor").alias("_mine")).join(groups.withColumnRenamed("_hash", "g_hash"), (F.col("_hash") == F.col("g_hash")) & F.col("_mine").eqNullSafe(F.col("_actor")))
    first = F.col("_first.sighting")
    action = F.when(F.col("known").isNull() & (first == F.col("sighting")), "inserted").otherwise("reinforced")
    outcome = stored.select("place", "sighting", F.coalesce("known", first).alias("candidate_id"), action.alias("action"))
    return after, outcome


def settle(claims: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """place, old_id, new_id: the pairs of a sweep that are done, without the others being made.

    Sightings go by place, each with the claim that it was stored in; a claim that an earlier one has retired retires
    none, and is retired once. Contradictions are those of the ledger as the batch has left it.
    """
    one = stored.groupBy("candidate_id").agg(F.min("place").alias("at"))
    done = ledger.superseding(claims.join(one, "candidate_id").withColumn("claim_id", F.col("candidate_id")), claims, now)
    return done.select(F.struct("at", F.col("new_id").alias("n"), F.col("old_id").alias("o")).alias("place"), "old_id", "new_id")


def sweep(claims: DataFrame, stored: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """place, old_id, new_id, reasons, allowed, done: what a batch's claims do to the live claims that they contradict; done: of settle.

    All pairs, refused ones as well: they grow with the claims of a subject times those of the batch.
    """
    one = stored.groupBy("candidate_id").agg(F.min("place").alias("at"))
    new = claims.join(one, "candidate_id").withColumn("claim_id", F.col("candidate_id"))
    pairs = ledger.contradicting(new, claims, now).withColumnsRenamed({"claim_id": "new_id", "candidate_id": "old_id"}).filter("old_id <> new_id").distinct()
    side = lambda s: claims.select(F.col("candidate_id").alias(f"{s}_id"), ledger.temporal_key().alias(f"{s}_at"), F.col("confidence").alias(f"{s}_confidence"), F.col("actor").alias(f"{s}_actor"), F.col("epistemic_status").alias(f"{s}_status"), F.col("trace_id").alias(f"{s}_trace"))
    gated = ledger.supersession(pairs.join(side("old"), "old_id").join(side("new"), "new_id").join(one.withColumnRenamed("candidate_id", "new_id"), "new_id"))
    ranked = gated.select(F.struct(F.col("at"), F.col("new_id").alias("n"), F.col("old_id").alias("o")).alias("place"), "old_id", "new_id", "allowed", F.array_join("reasons", ",").alias("reasons"))
    return ranked.join(done.select("place", F.lit(True).alias("done")), "place", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def ends(done: DataFrame, forgotten: DataFrame) -> DataFrame:
    """candidate_id, _to: superseded claims, and those at their floor that are archived."""
    gone = done.groupBy(F.col("old_id").alias("candidate_id")).agg(F.lit("superseded").alias("_to"))
    return gone.unionByName(forgotten.join(gone, "candidate_id", "left_anti").select("candidate_id", F.lit("archived").alias("_to")))


def retired(claims: DataFrame, ended: DataFrame, now: Column) -> DataFrame:
    """Claims after some have ended (of ends): superseded ones end now."""
    rows = claims.join(ended, "candidate_id", "left")
    over = F.col("_to") == "superseded"
    new = {"status": F.coalesce("_to", "status"), "valid_until": F.when(over, now).otherwise(F.col("valid_until")), "updated_at": F.when(F.col("_to").isNotNull(), now).otherwise(F.col("updated_at"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in claims.columns))


@dataclass(frozen=True)
class Generation:
    """All tables that one run leaves; swept and pages are made where they are read, of tables that the run has written."""

    claims: DataFrame
    stored: DataFrame
    swept: DataFrame
    plans: DataFrame
    pages: DataFrame
    log: DataFrame
    failures: DataFrame
    record: DataFrame


def run(captures: DataFrame, claims: DataFrame, log: DataFrame, plans: DataFrame, pages: DataFrame, policies: DataFrame, now: Column, extractor: Extractor | None = None, batch: int | None = None, most: int = 5, forget_days: int = 30, section: str = "## Facts") -> Generation:
    """One run over the drafts that no earlier run has read: extract, store, sweep, forget, plan, apply, record.

    captures: capture_id, observation, subject, actor, lane, confidence, epistemic_status, trace_id, observed_at,
    valid_from, valid_until, source_page_ids, status. `batch` drafts are read, by id (all if None). Plans are made of all
    candidates that are in no open plan, whichever run they are of; the first `most` safe ones are applied, by claims and
    target, and never to a guarded kind of page: their facts go into the section and their claims become active.
    """
    drafts = captures.filter("status = 'draft'").join(ledger.processed(log), "capture_id", "left_anti")
    drafts = drafts if batch is None else cut(drafts.orderBy("capture_id").limit(batch))
    if extractor is None:
        found, failures = extract.claims(drafts, "subject").drop("dedupe_hash").withColumns({"confidence": F.lit(None).cast("string"), "epistemic_status": F.lit(None).cast("string")}), drafts.select("capture_id", F.lit("").alias("failure_kind"), F.lit("").alias("failure")).filter("false")
    else:
        found, failures = attempt(drafts, extractor)
    found, drafts = cut(found), cut(drafts.drop("observation"))
    meta = drafts.select("capture_id", *(F.col(c).alias(f"_{c}") for c in ("actor", "lane", "confidence", "epistemic_status", "trace_id", "observed_at", "valid_from", "valid_until", "source_page_ids")))
    joined = found.join(meta, "capture_id").withColumns({"confidence": F.coalesce("confidence", "_confidence"), "epistemic_status": F.coalesce("epistemic_status", "_epistemic_status")})
    valid, bad = extract.checked(joined)
    failures = cut(failures.unionByName(bad.select("capture_id", F.col("failure").alias("failure_kind"), F.lit(None).cast("string").alias("failure"))))
    place = F.struct(F.col("capture_id").alias("capture"), F.col("unit_no").alias("unit"))
    name = F.concat_ws("#", "capture_id", "unit_no")
    sightings = valid.select(
        place.alias("place"), name.alias("sighting"), F.lit("claim").alias("candidate_type"), "subject", "predicate", "object", "confidence", "epistemic_status", F.array("capture_id").alias("source_capture_ids"),
        *(F.col(f"_{c}").alias(c) for c in ("actor", "lane", "trace_id", "observed_at", "valid_from", "valid_until", "source_page_ids")),
    )
    after, stored = store(claims, cut(sightings), now)
    after, stored = cut(after), cut(stored)
    done = cut(settle(after, stored, now))
    swept = sweep(after, stored, done, now)
    ended = cut(ends(done, ledger.forget(after, now, forget_days)))
    settled = cut(retired(after, ended, now))
    waiting = cut(policy.plannable(settled, plans))
    open_ = cut(waiting.join(policy.route(waiting, captures.select(F.col("capture_id").alias("page_id"), "suggested_target")), "candidate_id"))
    clashes = ledger.contradicted(open_, settled, now)
    made = cut(policy.plan(open_, clashes, pages, policies, section))
    kind = made.join(pages.select(F.col("page_id").alias("target"), "kind"), "target", "left").withColumn("kind", F.coalesce("kind", F.regexp_replace(F.split("target", "/")[0], "s$", "")))
    chosen = cut(policy.apply_bounded(kind.filter(~F.col("kind").isin(*GUARDED)), most).select("target"))
    applied = open_.join(chosen, "target", "left_semi")
    fact = F.concat_ws(" ", F.lit("-"), "subject", "predicate", "object")
    facts = applied.select("target", fact.alias("fact")).distinct().groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("fact")), "\n").alias("facts"))
    facts = cut(facts)
    touched = F.broadcast(chosen.withColumnRenamed("target", "page_id"))  # `most` targets at most, so no body moves but theirs
    old = pages.join(touched, "page_id", "left_semi").join(facts.withColumnRenamed("target", "page_id"), "page_id", "left")
    body = F.when(F.col("facts").isNull(), F.col("body")).otherwise(policy.insert_into_section(F.coalesce("body", F.lit("")), F.lit(section), F.col("facts")))
    changed = old.select(*((body if c == "body" else F.col(c)).alias(c) for c in pages.columns)).unionByName(pages.join(touched, "page_id", "left_anti"))
    stub = facts.join(pages.select(F.col("page_id").alias("target")), "target", "left_anti")
    title = F.initcap(F.translate(F.element_at(F.split("target", "/"), -1), "-_", "  "))
    types = {f.name: f.dataType for f in pages.schema}
    values = {"page_id": F.col("target"), "title": title, "kind": F.regexp_replace(F.split("target", "/")[0], "s$", ""), "body": F.concat(F.lit("# "), title, F.lit("\n\n"), F.lit(section), F.lit("\n\n"), "facts", F.lit("\n"))}
    stubs = stub.select(*(values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in pages.columns))
    active = cut(applied.select("candidate_id", F.lit("active").alias("_to")))
    final = settled.join(active, "candidate_id", "left").select(*((F.coalesce("_to", "status") if c == "status" else F.col(c)).alias(c) for c in settled.columns))
    outcome = made.join(chosen.withColumn("_done", F.lit(True)), "target", "left").withColumn("status", F.when(F.col("_done"), "applied").when(F.col("auto_appliable"), "ready").otherwise("needs_manual_review")).drop("_done")
    read = drafts.select("capture_id").join(failures.select("capture_id", F.lit(False).alias("success")).distinct(), "capture_id", "left").select("capture_id", F.coalesce("success", F.lit(True)).alias("success"))
    outcome, read = cut(outcome), cut(read)
    count = lambda df, name, hold="true": df.agg(F.count_if(F.expr(hold)).alias(name))
    parts = [
        count(read, "captures_processed", "success"), count(read, "captures_failed", "not success"), count(stored, "claims_inserted", "action = 'inserted'"), count(stored, "claims_reinforced", "action = 'reinforced'"), count(done, "claims_superseded"),
        count(settled.join(ended.filter("_to = 'archived'"), "candidate_id", "left_semi"), "claims_archived"), count(outcome, "plans_generated"), count(outcome, "auto_applied", "status = 'applied'"), count(outcome, "review_required", "status <> 'applied'"),
    ]
    record = parts[0]
    for p in parts[1:]:
        record = record.join(F.broadcast(p))  # one row of one count each
    return Generation(cut(final), stored, swept, outcome, changed.unionByName(stubs), read, failures, cut(record))


