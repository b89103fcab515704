"""The ledger of claims as tables: filters, matching, reinforcement, lifecycle, decay, recall, extraction state.

A claim row has candidate_id, candidate_type, subject, predicate, object, confidence, epistemic_status, actor, lane, status,
strength, decay_floor, access_count, observed_at, valid_from, valid_until, created_at, updated_at, last_decayed_at and the
arrays source_page_ids and source_capture_ids. Operators return new tables; nothing is changed in place. Times are all
with a zone or all without.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import scoring
from tessera.functions.text import claim_hash, folded, tokens
from tessera.operators import intervals
from tessera.sources.storage import cut, discard

LIVE = ("candidate", "active")
#: From which status a candidate may change into which.
TRANSITIONS = (("candidate", "active"), ("candidate", "rejected"), ("active", "superseded"), ("active", "archived"))
FLOOR, PINNED_FLOOR = 0.01, 0.2
FIRST_STRENGTH = 0.5
#: What marks a source as made by tests or evaluations.
DISPOSABLE_PHRASES = ("heartbeat-audit",)
DISPOSABLE_TOKENS = ("eval", "evaluation", "test", "smoke", "probe")


def live(claims: DataFrame) -> DataFrame:
    return claims.filter(F.col("status").isin(*LIVE))


def same_actor(actor: str, unattributed: bool) -> Column:
    """Rows of the actor; with unattributed, those of none as well."""
    mine = F.col("actor") == actor
    return (mine | F.col("actor").isNull() | (F.col("actor") == "")) if unattributed else mine


def candidates(rows: DataFrame, kind: str | None = None, status: str | None = None, statuses: Sequence[str] = (), capture: str | None = None, page: str | None = None, lane: str | None = None, actor: str | None = None, limit: int = 100, most: int = 500) -> DataFrame:
    """Candidates newest first; `statuses` takes precedence over `status`, capture and page match inside a source's id."""
    if kind:
        rows = rows.filter(F.col("candidate_type") == kind)
    if statuses or status:
        rows = rows.filter(F.col("status").isin(*(statuses or (status,))))
    for value, column in ((capture, "source_capture_ids"), (page, "source_page_ids")):
        if value:
            rows = rows.filter(F.exists(column, lambda s: s.contains(value)))  # noqa: B023
    for value, column in ((lane, "lane"), (actor, "actor")):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc("created_at"), "candidate_id").limit(max(1, min(limit, most)))


def live_claims(rows: DataFrame, subject: str | None = None, lane: str | None = None, least: float = 0.0, valid_at: Column | None = None, actor: str | None = None, unattributed: bool = False) -> DataFrame:
    """Live claims of a subject (folded), lane and actor, of at least a strength, whose [valid_from, valid_until) holds a time."""
    rows = live(rows.filter("candidate_type = 'claim'"))
    if subject:
        rows = rows.filter(folded(F.col("subject")) == " ".join(subject.lower().split()))
    if lane:
        rows = rows.filter(F.col("lane") == lane)
    if actor:
        rows = rows.filter(same_actor(actor, unattributed))
    if least > 0:
        rows = rows.filter(F.col("strength") >= least)
    if valid_at is not None:
        rows = rows.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= valid_at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > valid_at)))
    return rows


def blocked(rows: DataFrame) -> DataFrame:
    """candidate_id, epistemic_status, reason of claims that wait for a review: assumptions, and inferences without a trace."""
    reason = F.when(F.col("epistemic_status") == "assumption", "assumption").when((F.col("epistemic_status") == "inferred") & F.col("trace_id").isNull(), "untraced")
    waiting = rows.filter("candidate_type = 'claim' and status = 'candidate'")
    return waiting.select("candidate_id", "epistemic_status", reason.alias("reason")).filter("reason is not null")


def label(rows: DataFrame) -> DataFrame:
    """candidate_id, label: a claim's three parts, else its id."""
    whole = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("object").isNotNull()
    return rows.select("candidate_id", F.when(whole, F.concat_ws(" ", "subject", "predicate", "object")).otherwise(F.col("candidate_id")).alias("label"))


def decay_floor(confidence: Column, status: Column) -> Column:
    """The floor of what an operator declared with high confidence; null for others."""
    return F.when((F.lower(confidence) == "high") & (F.lower(status) == "operator_declared"), F.lit(PINNED_FLOOR))


def stored_floor(value: Column) -> Column:
    """A stored floor above the usual one, 1 at most; else null."""
    return F.when(value > FLOOR, F.least(value, F.lit(1.0)))


def reinforce(observed: DataFrame, first: float = FIRST_STRENGTH) -> DataFrame:
    """One claim for each folded (subject, predicate, object) and actor (null-safe) of sightings in order of (observed_at, sighting).

    The first sighting makes the claim; each later one adds a step of strength, up to 1. It keeps the first validity, the
    highest confidence, the last epistemic status and, where these pin it, their floor. Everything combines before the
    shuffle. observed: sighting, subject, predicate, object, actor, confidence, epistemic_status, observed_at, valid_from,
    valid_until. A claim's sources are a table of their own; see sources.
    """
    rows = observed.withColumn("dedupe_hash", claim_hash(F.col("subject"), F.col("predicate"), F.col("object")))
    order = F.struct("observed_at", "sighting")
    early = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order))
    claims = rows.groupBy("dedupe_hash", "actor").agg(
        F.min_by("sighting", order).alias("candidate_id"), *(F.min_by(folded(F.col(c)), order).alias(c) for c in ("subject", "predicate", "object")),
        F.count("*").alias("seen"), F.min("observed_at").alias("created_at"), F.max("observed_at").alias("updated_at"), early("valid_from").alias("valid_from"), early("valid_until").alias("valid_until"),
        F.max(F.struct(scoring.confidence_rank(F.col("confidence")).alias("rank"), F.coalesce("confidence", F.lit("unknown")).alias("name")))["name"].alias("confidence"),
        F.max_by("epistemic_status", F.when(F.col("epistemic_status").isNotNull(), order)).alias("epistemic_status"),
    )
    strength = F.round(scoring.reinforced(first, F.col("seen")), 6)
    return claims.withColumn("strength", strength).withColumn("decay_floor", F.when(F.col("seen") > 1, decay_floor(F.col("confidence"), F.col("epistemic_status"))))


def merge(claims: DataFrame, observed: DataFrame, first: float = FIRST_STRENGTH) -> DataFrame:
    """claims (of reinforce) after more sightings, all later than theirs: known ones are reinforced, new ones are added."""
    new = reinforce(observed, first)
    a, b = claims.withColumnsRenamed({c: f"a_{c}" for c in claims.columns}), new.withColumnsRenamed({c: f"b_{c}" for c in new.columns})
    both = a.join(b, (F.col("a_dedupe_hash") == F.col("b_dedupe_hash")) & F.col("a_actor").eqNullSafe(F.col("b_actor")), "full_outer")
    old, known = F.col("a_dedupe_hash").isNotNull(), F.col("b_dedupe_hash").isNotNull()
    either = lambda c: F.when(old, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(c)
    more = F.coalesce("b_seen", F.lit(0))
    rank = lambda c: scoring.confidence_rank(F.col(c))
    out = both.select(
        *(either(c) for c in ("dedupe_hash", "actor", "candidate_id", "subject", "predicate", "object", "created_at")), (F.coalesce("a_seen", F.lit(0)) + more).alias("seen"), F.greatest("a_updated_at", "b_updated_at").alias("updated_at"),
        F.coalesce("a_valid_from", "b_valid_from").alias("valid_from"), F.coalesce("a_valid_until", "b_valid_until").alias("valid_until"),
        F.when(~old | (known & (rank("b_confidence") > rank("a_confidence"))), F.col("b_confidence")).otherwise(F.col("a_confidence")).alias("confidence"), F.coalesce("b_epistemic_status", "a_epistemic_status").alias("epistemic_status"),
        F.round(F.when(old, F.least(F.lit(1.0), F.col("a_strength") + scoring.STEP * more)).otherwise(F.col("b_strength")), 6).alias("strength"), F.col("a_decay_floor").alias("_floor"), known.alias("_known"),
    )
    floor = F.greatest(stored_floor(F.col("_floor")), F.when(F.col("_known") & (F.col("seen") > 1), decay_floor(F.col("confidence"), F.col("epistemic_status"))))
    return out.withColumn("decay_floor", floor).drop("_floor", "_known")


def sources(observed: DataFrame) -> DataFrame:
    """dedupe_hash, actor, source, first_at: the distinct sources of each claim, in long form so that no row grows with them."""
    rows = observed.withColumn("dedupe_hash", claim_hash(F.col("subject"), F.col("predicate"), F.col("object")))
    return rows.filter("source is not null").groupBy("dedupe_hash", "actor", "source").agg(F.min("observed_at").alias("first_at"))


def triple(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(folded(F.col(c)).alias(f"n_{c}") for c in ("subject", "predicate", "object")))


def matching(new: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, candidate_id: for each new claim (claim_id, subject, predicate, object, actor) the latest live claim of the same folded triple and actor."""
    a = triple(new.select("claim_id", "subject", "predicate", "object", F.col("actor").alias("a_actor")))
    b = triple(live_claims(claims).select("candidate_id", "subject", "predicate", "object", "actor", "updated_at")).drop("subject", "predicate", "object")
    latest = b.groupBy("n_subject", "n_predicate", "n_object", "actor").agg(F.max("updated_at").alias("updated_at"))
    # Of equal times the least id: two plain aggregations instead of a window over a hot key.
    b = b.join(latest.withColumnsRenamed({c: f"l_{c}" for c in latest.columns}), (F.col("n_subject") == F.col("l_n_subject")) & (F.col("n_predicate") == F.col("l_n_predicate")) & (F.col("n_object") == F.col("l_n_object")) & F.col("actor").eqNullSafe(F.col("l_actor")) & (F.col("updated_at") == F.col("l_updated_at")))
    one = b.groupBy("n_subject", "n_predicate", "n_object", "actor").agg(F.min("candidate_id").alias("candidate_id"))
    one = one.withColumnsRenamed({c: f"b_{c}" for c in ("n_subject", "n_predicate", "n_object")})
    on = (F.col("n_subject") == F.col("b_n_subject")) & (F.col("n_predicate") == F.col("b_n_predicate")) & (F.col("n_object") == F.col("b_n_object")) & F.col("a_actor").eqNullSafe(F.col("actor"))
    return a.join(one, on).select("claim_id", "candidate_id")


def contradicting(new: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """claim_id, candidate_id of new claims and live ones of the same subject and predicate with another object, while both hold.

    A new claim holds from valid_from, else observed_at, else now, until valid_until; null ends are open. Only claims of
    its own actor count where it has one. Claims of one object, actor and interval are one group, and groups meet by
    subject, predicate and time, so what is joined follows the pairs that hold together and not the size of a subject.
    """
    micros = lambda time, open_end: F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(open_end))
    low, high = -(2**60), 2**60
    begin = F.coalesce("valid_from", "observed_at", now)
    a = triple(new).select("claim_id", "n_subject", "n_predicate", F.col("n_object").alias("object"), F.nullif("actor", F.lit("")).alias("actor"), micros(begin, high).alias("begin"), micros(F.col("valid_until"), high).alias("end"))
    b = triple(live_claims(claims)).select("candidate_id", "n_subject", "n_predicate", F.col("n_object").alias("object"), "actor", micros(F.col("valid_from"), low).alias("begin"), micros(F.col("valid_until"), high).alias("end"))
    key, rest = ["n_subject", "n_predicate"], ["object", "actor", "begin", "end"]
    kinds = lambda df: df.filter("n_subject is not null and n_predicate is not null and object is not null").select(*key, *rest).distinct()
    pairs = intervals.overlapping(kinds(a), kinds(b), key, "object").filter(F.col("a_actor").isNull() | (F.col("a_actor") == F.col("b_actor")))

    def members(pairs: DataFrame, df: DataFrame, side: str) -> DataFrame:
        named = df.withColumnsRenamed({c: f"_{c}" for c in (*key, *rest)})
        on = (F.col("n_subject") == F.col("_n_subject")) & (F.col("n_predicate") == F.col("_n_predicate"))
        for c in rest:
            on = on & F.col(f"{side}_{c}").eqNullSafe(F.col(f"_{c}"))
        return pairs.join(named, on).drop(*(f"_{c}" for c in (*key, *rest)))

    return members(members(pairs, a, "a"), b, "b").select("claim_id", "candidate_id")


def supersession(pairs: DataFrame) -> DataFrame:
    """For pairs of an old and a new claim, whether the new may supersede, and why not.

    It must be strictly newer, of a higher confidence, of the same actor, and neither an assumption nor inferred without
    a trace. An old claim of unknown time is the oldest, a new one is not newer. Columns read: old_/new_ of at,
    confidence, actor; new_status, new_trace.
    """
    rank = lambda c: scoring.confidence_rank(F.col(c))
    newer = F.col("new_at").isNotNull() & (F.col("old_at").isNull() | (F.col("new_at") > F.col("old_at")))
    reasons = F.array_compact(
        F.array(
            F.when(~F.col("old_actor").eqNullSafe(F.col("new_actor")), F.lit("actor")),
            F.when(~newer, F.lit("not_newer")),
            F.when(rank("new_confidence") <= rank("old_confidence"), F.lit("confidence")),
            F.when(F.col("new_status") == "assumption", F.lit("assumption")),
            F.when((F.col("new_status") == "inferred") & F.col("new_trace").isNull(), F.lit("untraced")),
        )
    )
    return pairs.withColumn("reasons", reasons).withColumn("allowed", F.size("reasons") == 0)


def _spans(new: DataFrame, claims: DataFrame, now: Column, a_columns: list, b_columns: list) -> tuple[DataFrame, DataFrame]:
    """New claims and live ones as contradicting() compares them: n_subject, n_predicate, n_object, begin, end and more columns; without those that lack a part."""
    micros = lambda time, open_end: F.coalesce(F.unix_micros(time.cast("timestamp")), F.lit(open_end))
    parts = ["n_subject", "n_predicate", "n_object"]
    low, high = -(2**60), 2**60
    end = micros(F.col("valid_until"), high).alias("end")
    a = triple(new).select(*parts, micros(F.coalesce("valid_from", "observed_at", now), high).alias("begin"), end, *a_columns)
    b = triple(live_claims(claims)).select(*parts, micros(F.col("valid_from"), low).alias("begin"), end, *b_columns)
    return a.na.drop(subset=parts), b.na.drop(subset=parts)


def contradicted(new: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """target, object: the objects of live claims that contradict some new claim (with a target) as contradicting() has it, each once.

    No pairs are made of claims. Of intervals that end together the longest stands for all, and of a target's claims that
    hold together two objects, as another object differs from one of them if it differs from any.
    """
    a, b = _spans(new, claims, now, ["target", F.nullif("actor", F.lit("")).alias("actor")], ["object", "actor"])
    key = ["n_subject", "n_predicate"]
    a = a.groupBy("target", *key, "n_object", "actor", "end").agg(F.min("begin").alias("begin"))
    a = a.groupBy("target", *key, "actor", "begin", "end").agg(F.min("n_object").alias("least"), F.max("n_object").alias("most"))
    b = b.groupBy(*key, "n_object", "object", "actor", "end").agg(F.min("begin").alias("begin")).withColumnsRenamed({c: f"b_{c}" for c in ("actor", "begin", "end")})
    other = (F.col("least") != F.col("n_object")) | (F.col("most") != F.col("n_object"))
    holds = (F.col("begin") < F.col("b_end")) & (F.col("b_begin") < F.col("end")) & (F.col("actor").isNull() | (F.col("actor") == F.col("b_actor")))
    return a.join(b, key).filter(other & holds).select("target", "object").distinct()


def superseding(new: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """old_id, new_id, at: the live claims that new ones (claim_id, at: a turn, and the columns of a claim) retire, one after the other by turn and id.

    The same as the allowed pairs of contradicting() and supersession() judged by in_order(), where a new claim must not
    have been retired before its turn. As only a higher confidence supersedes, claims of the highest one are never retired,
    and each lower one is settled once the higher ones are; a claim is retired by the first that may. So no pairs are kept,
    and of new claims of one subject, owner and time that hold together the first ones of two objects stand for all.
    """
    owner = F.coalesce(F.concat(F.lit("="), "actor"), F.lit("")).alias("owner")
    key, rank, since = ["n_subject", "n_predicate", "owner"], scoring.confidence_rank(F.col("confidence")).alias("rank"), temporal_key().alias("since")
    barred = (F.col("epistemic_status") == "assumption") | ((F.col("epistemic_status") == "inferred") & F.col("trace_id").isNull())
    may = new.filter(~F.coalesce(barred, F.lit(False)))
    a, b = _spans(may, claims, now, [owner, rank, since, F.struct("at", F.col("claim_id").alias("id")).alias("turn")], [owner, rank, since, F.col("candidate_id").alias("old_id")])
    a = cut(a.filter("since is not null"))
    b = cut(b.join(cut(a.select(*key).distinct()), key, "left_semi"))
    found = b.sparkSession.createDataFrame([], StructType([b.schema["old_id"], a.schema["turn"]]))
    for r in range(len(scoring.CONFIDENCE) - 1, 0, -1):
        gone = found.groupBy(F.col("old_id").alias("id")).agg(F.min("turn").alias("_gone"))
        free = a.filter(F.col("rank") == r).withColumn("id", F.col("turn.id")).join(gone, "id", "left").filter("_gone is null or _gone > turn")
        same = [*key, "begin", "end", "since"]
        first = free.groupBy(*same, "n_object").agg(F.min("turn").alias("turn")).withColumn("_place", F.row_number().over(Window.partitionBy(*same).orderBy("turn"))).filter("_place <= 2")
        first = first.select(*key, *(F.col(c).alias(f"a_{c}") for c in ("n_object", "begin", "end", "since")), "turn")
        holds = (F.col("a_begin") < F.col("end")) & (F.col("begin") < F.col("a_end")) & (F.col("a_n_object") != F.col("n_object")) & (F.col("since").isNull() | (F.col("a_since") > F.col("since")))
        found = cut(found.unionByName(b.filter(F.col("rank") < r).join(first, key).filter(holds).groupBy("old_id").agg(F.min("turn").alias("turn"))))
    return found.groupBy("old_id").agg(F.min("turn").alias("turn")).select("old_id", F.col("turn.id").alias("new_id"), F.col("turn.at").alias("at"))


def in_order(pairs: DataFrame) -> DataFrame:
    """pairs (place, old_id, new_id, allowed, needs_live) with `done`, each judged after the ones before it.

    An allowed pair is done if no earlier done one has retired its old claim, nor, where needs_live, its new one. `place`
    is any ordered column without ties. A pair is settled once nothing unsettled before it can touch its claims: the first
    unsettled one always is, so this ends, after as many rounds as the longest chain of pairs that hang on each other.
    """
    left = cut(pairs.filter("allowed").select("place", "old_id", "new_id", "needs_live"))
    retired = pairs.sparkSession.createDataFrame([], left.select("place", F.col("old_id").alias("id")).schema)
    while not left.isEmpty():
        next_of = left.groupBy(F.col("old_id").alias("id")).agg(F.min("place").alias("next"))
        old, new = (next_of.withColumnsRenamed({"id": f"{s}_id", "next": f"{s}_next"}) for s in ("old", "new"))
        near = left.join(old, "old_id").join(new, "new_id", "left")
        # The new claim may yet be retired by an unsettled pair before this one, which then must be settled first.
        free = ~F.col("needs_live") | F.col("new_next").isNull() | (F.col("new_next") >= F.col("place"))
        first = cut(near.filter((F.col("place") == F.col("old_next")) & free).select("place", F.col("old_id").alias("id")))
        before, retired = retired, cut(retired.unionByName(first))
        gone = first.withColumnsRenamed({"id": "old_id", "place": "_at"})
        rest = left.join(gone.drop("_at"), "old_id", "left_anti")
        ended = first.withColumnsRenamed({"id": "new_id", "place": "_at"})
        late = F.col("needs_live") & F.col("_at").isNotNull() & (F.col("_at") < F.col("place"))
        was, left = left, cut(rest.join(ended, "new_id", "left").filter(~late).select("place", "old_id", "new_id", "needs_live"))
        discard(was, first, before)
    return pairs.join(retired.withColumn("done", F.lit(True)).drop("id"), "place", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def supersede(claims: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of requests (place, old_id, new_id, actor): outcome superseded, self, not_live, old_missing or new_missing.

    With an actor, claims of others are missing. Requests are carried out one after the other by place, each on what the
    ones before have left: of several on one old claim the first possible one retires it.
    """
    known = claims.select(F.col("candidate_id").alias("_id"), F.col("status").alias("_status"), F.col("actor").alias("_owner"))
    side = lambda s: known.withColumnsRenamed({c: f"{c}_{s}" for c in known.columns})
    mine = lambda s: (F.col("old_id" if s == "old" else "new_id") == F.col(f"_id_{s}")) & (F.col("actor").isNull() | (F.col("actor") == "") | (F.col("actor") == F.col(f"_owner_{s}")))
    both = requests.join(side("old"), mine("old"), "left").join(side("new"), mine("new"), "left")
    outcome = (
        F.when(F.col("_id_old").isNull(), "old_missing").when(F.col("old_id") == F.col("new_id"), "self").when(~F.col("_status_old").isin(*LIVE), "not_live")
        .when(F.col("_id_new").isNull(), "new_missing").otherwise("superseded")
    )
    judged = cut(both.select("place", "old_id", "new_id", outcome.alias("outcome")))
    # The new claim need not be live, so a request hangs on the earlier ones on its old claim alone: the first one wins.
    first = judged.filter("outcome = 'superseded'").groupBy("old_id").agg(F.min("place").alias("first"))
    late = (F.col("first") < F.col("place")) & F.col("outcome").isin("superseded", "new_missing")
    return judged.join(first, "old_id", "left").select("place", "old_id", "new_id", F.when(late, "not_live").otherwise(F.col("outcome")).alias("outcome"))


def superseded(claims: DataFrame, done: DataFrame) -> DataFrame:
    """candidate_id, status, superseded_by, supersedes of claims after the superseded pairs (place, old_id, new_id); a claim that superseded several names the last."""
    pairs = done.filter("outcome = 'superseded'")
    by = pairs.select(F.col("old_id").alias("candidate_id"), F.col("new_id").alias("superseded_by"))
    of = pairs.groupBy(F.col("new_id").alias("candidate_id")).agg(F.max_by("old_id", "place").alias("supersedes"))
    joined = claims.select("candidate_id", "status").join(by, "candidate_id", "left").join(of, "candidate_id", "left")
    return joined.select("candidate_id", F.when(F.col("superseded_by").isNotNull(), "superseded").otherwise(F.col("status")).alias("status"), "superseded_by", "supersedes")


def transition(claims: DataFrame, wanted: DataFrame) -> DataFrame:
    """candidate_id, old_status, to_status, outcome (changed, invalid, missing) of wanted changes (candidate_id, to_status)."""
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, b in TRANSITIONS))
    joined = wanted.join(claims.select("candidate_id", F.col("status").alias("old_status")), "candidate_id", "left")
    fits = F.array_contains(allowed, F.concat_ws(">", "old_status", "to_status"))
    return joined.select("candidate_id", "old_status", "to_status", F.when(F.col("old_status").isNull(), "missing").when(fits, "changed").otherwise("invalid").alias("outcome"))


def disposable(source: Column, capture: bool) -> Column:
    """A source of tests: by a phrase, by an evaluation folder, or by a word of its last part; pages only in the folders of captures."""
    s = F.lower(source)
    phrase = F.lit(False)
    for p in DISPOSABLE_PHRASES:
        phrase = phrase | s.contains(p)
    folder = s.rlike("^(eval|evaluation)/") | s.contains("/eval/") | s.contains("/evaluation/")
    word = F.arrays_overlap(F.split(F.element_at(F.split(s, "/"), -1), "[^a-z0-9]+"), F.array(*(F.lit(t) for t in DISPOSABLE_TOKENS)))
    return phrase | folder | (word if capture else s.rlike("^(captures|inbox|notes)/") & word)


def cleanup(claims: DataFrame) -> DataFrame:
    """candidate_id, action (rejected, archived, scrubbed), kept_captures, kept_pages of live candidates with disposable sources.

    Candidates whose captures, or without captures whose pages, are all disposable leave the live ones; others lose these
    sources only.
    """
    left = lambda c, capture: F.filter(c, lambda s: ~disposable(s, capture))
    rows = live(claims).select("candidate_id", "status", *("source_capture_ids", "source_page_ids"), left("source_capture_ids", True).alias("kept_captures"), left("source_page_ids", False).alias("kept_pages"))
    some = (F.size("kept_captures") < F.size("source_capture_ids")) | (F.size("kept_pages") < F.size("source_page_ids"))
    captures = (F.size("source_capture_ids") > 0) & (F.size("kept_captures") == 0)
    pages = (F.size("source_capture_ids") == 0) & (F.size("source_page_ids") > 0) & (F.size("kept_pages") == 0)
    action = F.when(~(captures | pages), "scrubbed").when(F.col("status") == "candidate", "rejected").otherwise("archived")
    return rows.filter(some).select("candidate_id", action.alias("action"), "kept_captures", "kept_pages")


def forget(claims: DataFrame, now: Column, days: int, actor: str | None = None) -> DataFrame:
    """candidate_id of live claims that have been at the floor for so many days; pinned ones stay. None for 0 days."""
    rows = live(claims.filter("candidate_type = 'claim'")) if days > 0 else claims.filter("false")
    rows = rows.filter(F.col("actor") == actor) if actor else rows
    pinned = F.coalesce((F.col("epistemic_status") == "operator_declared") & (F.col("confidence") == "high"), F.lit(False))
    old = F.col("last_decayed_at") <= now - F.expr(f"INTERVAL {int(days)} DAYS")
    return rows.filter((F.col("strength") <= FLOOR) & (F.coalesce("decay_floor", F.lit(FLOOR)) <= FLOOR) & ~pinned & old).select("candidate_id")


def decay(claims: DataFrame, now: Column, actor: str | None = None) -> DataFrame:
    """candidate_id, days, strength, decay_floor, last_decayed_at of live claims after decay until now.

    The anchor is last_decayed_at, else created_at; whole days count. The floor is the largest of the usual one, the
    stored one and that of pinned claims. What was at its floor keeps its time of decay.
    """
    rows = live(claims.filter("candidate_type = 'claim'"))
    rows = rows.filter(F.col("actor") == actor) if actor else rows
    days = F.floor(scoring.age_days(now, F.coalesce("last_decayed_at", "created_at")))
    least = F.greatest(F.lit(FLOOR), stored_floor(F.col("decay_floor")), decay_floor(F.col("confidence"), F.col("epistemic_status")))
    kept = (F.col("strength") <= least) & F.col("last_decayed_at").isNotNull()
    return rows.select(
        "candidate_id", days.alias("days"), F.round(scoring.decayed(F.col("strength"), days, least), 6).alias("strength"), F.when(least > FLOOR, least).alias("decay_floor"),
        F.when(kept, F.col("last_decayed_at")).otherwise(now).alias("last_decayed_at"),
    )


def decay_summary(decayed: DataFrame) -> DataFrame:
    """n, least, most: how many claims decayed and between which strengths; 0 for none."""
    side = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 4)
    return decayed.agg(F.count("*").alias("n"), side(F.min("strength")).alias("least"), side(F.max("strength")).alias("most"))


def retried(deadletters: DataFrame, ids: DataFrame) -> DataFrame:
    """Dead letters after a retry of some: one more retry, and unresolved ones are retried."""
    marked = deadletters.join(ids.select("deadletter_id", F.lit(True).alias("_hit")).distinct(), "deadletter_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return marked.withColumn("retry_count", F.col("retry_count") + hit.cast("int")).withColumn("status", F.when(hit & (F.col("status") == "unresolved"), "retried").otherwise(F.col("status"))).drop("_hit")


def resolved(deadletters: DataFrame, ids: DataFrame) -> DataFrame:
    """Dead letters after some are resolved."""
    marked = deadletters.join(ids.select("deadletter_id", F.lit(True).alias("_hit")).distinct(), "deadletter_id", "left")
    return marked.withColumn("status", F.when(F.col("_hit"), "resolved").otherwise(F.col("status"))).drop("_hit")


def deadletter_queue(deadletters: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Oldest first."""
    rows = deadletters if status is None else deadletters.filter(F.col("status") == status)
    return rows.orderBy("created_at", "deadletter_id").limit(max(1, min(limit, 500)))


def processed(log: DataFrame) -> DataFrame:
    """capture_id of captures that were extracted."""
    return log.filter("success").select("capture_id").distinct()


def reset(claims: DataFrame, captures: DataFrame, delete: bool = False) -> DataFrame:
    """candidate_id, action, kept: what a new extraction of captures does to candidates made from them.

    Without delete, settled candidates of theirs become candidates again (reverted). With it, candidates of theirs alone
    go (deleted), and shared ones lose these sources (scrubbed, with the sources kept).
    """
    rows = claims if delete else claims.filter("status in ('active', 'rejected', 'superseded', 'archived')")
    pairs = rows.select("candidate_id", F.explode("source_capture_ids").alias("capture_id"))
    hit = pairs.join(captures.select("capture_id", F.lit(True).alias("hit")).distinct(), "capture_id", "left")
    by = hit.groupBy("candidate_id").agg(F.bool_or("hit").alias("some"), F.sort_array(F.collect_set(F.when(F.col("hit").isNull(), F.col("capture_id")))).alias("kept")).filter("some")
    action = F.when(F.lit(not delete), "reverted").when(F.size("kept") == 0, "deleted").otherwise("scrubbed")
    return by.select("candidate_id", action.alias("action"), "kept")


def traces(rows: DataFrame, actor: str | None = None, status: str | None = None, task: str | None = None, page: str | None = None, candidate: str | None = None, policy: str | None = None) -> DataFrame:
    """Traces by scalar fields, related ids and membership in policy_refs."""
    for column, value in (("actor", actor), ("status", status), ("task_id", task), ("page_id", page), ("candidate_id", candidate)):
        rows = rows.filter(F.col(column) == value) if value else rows
    return rows.filter(F.array_contains("policy_refs", policy)) if policy else rows


def patch_plans(rows: DataFrame, status: str | None = None, target: str | None = None, limit: int = 100) -> DataFrame:
    """Plans newest first."""
    for column, value in (("status", status), ("target_page_id", target)):
        rows = rows.filter(F.col(column) == value) if value else rows
    return rows.orderBy(F.desc("created_at"), "plan_id").limit(max(1, min(limit, 500)))


def batches(rows: DataFrame, limit: int = 100) -> DataFrame:
    """Batches newest first."""
    return rows.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(max(1, min(limit, 500)))


def batch_tokens(log: DataFrame) -> DataFrame:
    """batch_id, total_tokens: the sum over a batch's sources of the most tokens that one of its rows reports."""
    used = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
    by = log.groupBy("batch_id", "source_key").agg(F.max(used).alias("n"))
    return by.groupBy("batch_id").agg(F.sum("n").alias("total_tokens"))


def token_rollup(rows: DataFrame, recent: int = 10) -> DataFrame:
    """total, last, recent_average of batches (batch_id, created_at, total_tokens): batches without tokens don't count as recent."""
    some = rows.filter("total_tokens > 0").orderBy(F.desc("created_at"), F.desc("batch_id")).limit(max(1, min(recent, 100)))
    late = some.agg(F.max_by("total_tokens", F.struct("created_at", "batch_id")).alias("last"), F.round(F.avg("total_tokens"), 2).alias("recent_average"))
    total = rows.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total"))
    return total.join(F.broadcast(late)).select("total", F.coalesce("last", F.lit(0)).alias("last"), F.coalesce("recent_average", F.lit(0.0)).alias("recent_average"))  # one row each


def extraction_status(log: DataFrame, rows: DataFrame) -> DataFrame:
    """n_extracted, last_batch, last_at: one row."""
    last = rows.agg(F.max_by("batch_id", F.struct("created_at", "batch_id")).alias("last_batch"), F.max("created_at").alias("last_at"))
    return log.filter("success").agg(F.countDistinct("capture_id").alias("n_extracted")).join(F.broadcast(last))


def run_status(runs: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """field, value: the last run, plans by status, and how many runs are stuck for over an hour."""
    last = runs.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("value")).select(F.lit("last_run").alias("field"), "value")
    stuck = runs.agg(F.count_if((F.col("status") == "running") & (F.col("started_at") < now - F.expr("INTERVAL 1 HOUR"))).cast("string").alias("value")).select(F.lit("stuck_runs").alias("field"), "value")
    by = plans.groupBy("status").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("plans:"), "status").alias("field"), "value")
    return last.unionAll(stuck).unionAll(by)


def worker_status(captures: DataFrame, claims: DataFrame) -> DataFrame:
    """field, n: captures in all, as drafts and accepted, and candidates by status."""
    counts = captures.agg(F.count_if(F.col("status").isin("draft", "accepted")).alias("captures"), F.count_if(F.col("status") == "draft").alias("drafts"), F.count_if(F.col("status") == "accepted").alias("extracted"))
    named = counts.select(F.explode(F.create_map(*(x for c in counts.columns for x in (F.lit(c), F.col(c))))).alias("field", "n"))
    return named.unionAll(claims.groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("candidates:"), "status").alias("field"), "n"))


def versions(observed: DataFrame) -> DataFrame:
    """Sightings as a history: each holds from its time until the next one of the same subject and predicate."""
    order = Window.partitionBy("subject", "predicate").orderBy("observed_at", "event_id")
    return observed.select("event_id", "subject", "predicate", "object", F.col("observed_at").alias("valid_from"), F.lead("observed_at").over(order).alias("valid_until"))


def valid_at(claims: DataFrame, time: Column) -> DataFrame:
    """Claims whose interval [valid_from, valid_until) holds the time; a null end is open."""
    return claims.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= time)) & (F.col("valid_until").isNull() | (F.col("valid_until") > time)))


def temporal_key() -> Column:
    """When a claim began to hold: valid_from, else observed_at."""
    return F.coalesce("valid_from", "observed_at")


def recall(claims: DataFrame, now: Column, query: str | None = None, pool: int = 500, limit: int = 20, offset: int = 0, semantic: Column | None = None, **filters) -> DataFrame:
    """The best live claims for a query: candidate_id, score, its parts, age_days, contradicted_by, in order of place.

    The strongest `pool` claims that hold now are scored, three times as many (2,000 at most) with a query; then those
    without a common token, and without a semantic likeness, are left out. Of the claims of a subject and predicate with
    different objects the one that began last wins; those with another object fall just below it. The pool is of bounded
    size, so its windows are as well. semantic: a column of likenesses from 0 to 1 for the strongest 50 claims. filters:
    those of live_claims; an actor's recall takes in claims of no actor.
    """
    asked = bool(query and query.strip())
    first = live_claims(claims, valid_at=now, unattributed=True, **filters).orderBy(F.desc("strength"), F.desc("updated_at"), "candidate_id").limit(min(3 * pool, 2000) if query is not None else pool)
    age = scoring.age_days(now, F.coalesce("updated_at", "created_at"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    rows = first.withColumn("strength_part", clamp(F.col("strength"))).withColumn("recency", scoring.recency(age)).withColumn("salience", scoring.salience(F.coalesce("access_count", F.lit(0))))
    rows = rows.withColumn("age_days", F.round(age, 4)).withColumn("relevance", F.lit(1.0)).withColumn("likeness", F.lit(None).cast("double"))
    if asked:
        wanted = F.array_distinct(tokens(F.lit(query)))
        text = F.array_distinct(tokens(F.concat_ws(" ", "subject", "predicate", "object", "evidence")))
        rows = rows.withColumn("relevance", F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(wanted, text)) / F.size(wanted)))
        if semantic is not None:
            place = F.row_number().over(Window.orderBy(F.desc("strength"), F.desc("updated_at"), "candidate_id"))
            rows = rows.withColumn("likeness", F.when(place <= 50, clamp(semantic)))
        rows = rows.filter((F.col("relevance") > 0) | (F.coalesce("likeness", F.lit(0.0)) > 0))
    parts = {"strength": F.col("strength_part"), "recency": F.col("recency"), "salience": F.col("salience"), "relevance": F.col("relevance"), "semantic": F.coalesce("likeness", F.lit(0.0))}
    own = F.when(F.col("likeness").isNotNull(), scoring.recall_score(parts, scoring.recall_weights(asked, True))).otherwise(scoring.recall_score(parts, scoring.recall_weights(asked, False)))
    rows = triple(rows.withColumn("own", own).withColumn("began", temporal_key()))
    group = Window.partitionBy("n_subject", "n_predicate")
    ahead = F.row_number().over(group.orderBy(F.desc_nulls_last("began"), F.desc("own"), F.desc("strength"), "candidate_id"))
    rows = rows.withColumn("ahead", ahead)
    winner = lambda c: F.max(F.when(F.col("ahead") == 1, F.col(c))).over(group)
    lost = winner("n_object") != F.col("n_object")
    rows = rows.withColumn("contradicted_by", F.when(lost, winner("candidate_id"))).withColumn("score", F.round(F.when(lost, F.least("own", F.greatest(F.lit(0.0), winner("own") - 1e-6))).otherwise(F.col("own")), 6))
    order = [F.desc("score"), F.desc_nulls_last("began"), F.desc("strength"), F.asc("candidate_id")]
    rounded = [F.round(c, 6).alias(n) for c, n in (("strength_part", "strength_part"), ("recency", "recency"), ("salience", "salience"), ("relevance", "relevance"))]
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, 200))).select("candidate_id", "score", *rounded, "age_days", "contradicted_by")


def acknowledged(claims: DataFrame, accesses: DataFrame, actor: str | None = None) -> DataFrame:
    """candidate_id, access_count, last_access of claims after acknowledgements (candidate_id, call_id, at): one a claim and call.

    With an actor, only its claims and those of no actor count.
    """
    calls = accesses.select("candidate_id", "call_id", "at").groupBy("candidate_id", "call_id").agg(F.max("at").alias("at"))
    more = calls.groupBy("candidate_id").agg(F.count("*").alias("more"), F.max("at").alias("last_access"))
    rows = claims.filter("candidate_type = 'claim'")
    rows = rows.filter(same_actor(actor, True)) if actor else rows
    return rows.join(more, "candidate_id").select("candidate_id", (F.coalesce("access_count", F.lit(0)) + F.col("more")).alias("access_count"), "last_access")


def recall_hint(found: int, pending: int, elsewhere: int) -> str | None:
    """Why a recall found nothing: not yet consolidated, another actor's, or nothing at all; null if it found something."""
    if found:
        return None
    if pending:
        return f"{pending} captures wait for consolidation"
    return f"{elsewhere} claims of other actors match" if elsewhere else "nothing matches"


def probe(claims: DataFrame, captures: DataFrame, log: DataFrame, now: Column, query: str, actor: str) -> DataFrame:
    """found, pending, elsewhere, hint: an actor's recall with the counts that explain an empty one (of other actors 5 at most)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    drafts = captures.filter("status = 'draft'").join(processed(log), F.col("page_id") == F.col("capture_id"), "left_anti")
    one = count(recall(claims, now, query, actor=actor), "found").join(F.broadcast(count(drafts, "pending"))).join(F.broadcast(count(recall(claims, now, query, limit=5), "elsewhere")))  # rows of one count each
    hint = F.when(F.col("found") > 0, F.lit(None)).when(F.col("pending") > 0, F.lit("pending")).when(F.col("elsewhere") > 0, F.lit("elsewhere")).otherwise(F.lit("nothing"))
    return one.withColumn("hint", hint)


def auto_supersede(new: DataFrame, claims: DataFrame, now: Column) -> DataFrame:
    """old_id, new_id, reasons, allowed: what a sweep does with the live claims that new ones contradict.

    Each new claim stands for the live claim that matches it; see supersession for the gate.
    """
    mine = matching(new, claims).withColumnRenamed("candidate_id", "new_id")
    pairs = contradicting(new, claims, now).withColumnRenamed("candidate_id", "old_id").join(mine, "claim_id").filter("old_id <> new_id").select("old_id", "new_id").distinct()
    side = lambda s: claims.select(F.col("candidate_id").alias(f"{s}_id"), temporal_key().alias(f"{s}_at"), F.col("confidence").alias(f"{s}_confidence"), F.col("actor").alias(f"{s}_actor"), F.col("epistemic_status").alias(f"{s}_status"), F.col("trace_id").alias(f"{s}_trace"))
    gated = supersession(pairs.join(side("old"), "old_id").join(side("new"), "new_id"))
    return gated.select("old_id", "new_id", F.array_join("reasons", ",").alias("reasons"), "allowed")
