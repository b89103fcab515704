"""Promotion: captures become pages, daily notes are accepted, and repeated captures become procedure candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import slug
from tessera.operators import captures as capture_rules
from tessera.sources import markdown
from tessera.sources.storage import cut

PAGE = ("page_id", "title", "kind", "visibility", "status", "summary", "tags", "sources", "body")
#: Steps of a procedure whose captures name none, or one only.
NO_STEP = "Review the repeated capture evidence and perform the documented action"
LAST_STEP = "Verify the outcome and record any deviations"


def _filled(x: str) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def is_capture(kind: Column, page_id: Column) -> Column:
    return F.coalesce((kind == "capture") & page_id.rlike("^(inbox|notes)/"), F.lit(False))


def judge(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """seq, capture_id, target, content, outcome of requests (seq, capture_id, target, content) in the order of seq.

    The target is the request's or the one that the capture suggests. Outcomes: not_found, not_a_capture, no_target,
    invalid_target; exists, where a page or an earlier request's page has the target and no content is given; promoted.
    Captures are read as they were before the first request. A hot target needs no more than its least seq.
    """
    known = pages.select(F.col("page_id").alias("capture_id"), F.lit(True).alias("_found"), F.col("kind").alias("_kind"), _filled("suggested_target").alias("_aim"))
    rows = requests.join(known, "capture_id", "left").withColumn("target", F.coalesce(_filled("target"), "_aim"))
    bad = (
        F.when(F.col("_found").isNull(), "not_found").when(~is_capture(F.col("_kind"), F.col("capture_id")), "not_a_capture")
        .when(F.col("target").isNull(), "no_target").when(~markdown.is_page_id(F.col("target")), "invalid_target")
    )
    rows = rows.withColumn("_bad", bad)
    first = rows.filter("_bad is null").groupBy("target").agg(F.min("seq").alias("_first"))
    taken = pages.select(F.col("page_id").alias("target"), F.lit(True).alias("_taken"))
    late = F.col("_taken").isNotNull() | (F.col("seq") > F.col("_first"))
    outcome = F.coalesce("_bad", F.when(F.col("content").isNull() & late, "exists").otherwise("promoted"))
    return rows.join(first, "target", "left").join(taken, "target", "left").select("seq", "capture_id", "target", "content", outcome.alias("outcome"))


def promoted_text(page_id: Column, kind: Column, title: Column, tags: Column, body: Column) -> Column:
    """The Markdown of a page of this kind that a capture (its id, title, tags, body) becomes."""
    head = [
        F.lit("---"), F.concat(F.lit("title: "), markdown.plain_value(title)), F.concat(F.lit("kind: "), kind), F.lit("visibility: internal"), F.lit("status: active"), F.concat(F.lit("summary: Promoted from capture "), page_id),
        F.concat(F.lit("tags: ["), F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", "), F.lit("]")), F.lit("sources:"), F.concat(F.lit("  - "), page_id), F.lit("---"), F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+\z", ""),
    ]
    return F.concat(F.concat_ws("\n", *head), F.lit("\n"))


def promote(requests: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages after the requests, and the requests' outcomes as judge() gives them.

    A promoted capture is accepted and names its last target in promoted_to. The target's page is the Markdown of the last
    promoted request: its content, or one made from the capture's title, tags and text, whose source is the capture.
    pages: the columns of PAGE, suggested_target and promoted_to, one row a page_id; other columns stay, null in new pages.
    """
    outcomes = cut(judge(requests, pages))
    done = outcomes.filter("outcome = 'promoted'")
    last = done.groupBy(F.col("target").alias("page_id")).agg(F.max_by(F.struct("capture_id", "content"), "seq").alias("x")).select("page_id", "x.*")
    kind = F.coalesce(F.nullif(F.regexp_replace(F.split("page_id", "/")[0], "s+$", ""), F.lit("")), F.lit("page"))
    source = pages.select(F.col("page_id").alias("capture_id"), F.col("title").alias("_title"), F.col("tags").alias("_tags"), F.col("body").alias("_body"))
    made = promoted_text(F.col("capture_id"), kind, F.col("_title"), F.col("_tags"), F.col("_body"))
    new = last.join(source, "capture_id").select("page_id", F.coalesce("content", made).alias("content"), F.lit(None).cast("timestamp").alias("updated_at"))
    aims = done.groupBy(F.col("capture_id").alias("page_id")).agg(F.max_by("target", "seq").alias("_target"))
    moved = pages.join(aims, "page_id", "left").withColumn("status", F.when(F.col("_target").isNotNull(), "accepted").otherwise(F.col("status"))).withColumn("promoted_to", F.coalesce("_target", "promoted_to")).drop("_target")
    kept = moved.join(last.select("page_id"), "page_id", "left_anti")
    return kept.unionByName(markdown.pages(new).select(*PAGE), allowMissingColumns=True).select(*pages.columns), outcomes


def promote_notes(notes: DataFrame, days: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Notes (page_id, content) after the daily notes of some days (day) are promoted, and (day, page_id, outcome).

    Outcomes: promoted, whose header has that status and reviewed_at, all else as it was; no_header, unchanged; no_note.
    """
    wanted = days.select(F.col("day").cast("string").alias("day")).distinct().withColumn("page_id", F.concat(F.lit("dailies/"), "day"))
    headed = F.col("content").rlike(markdown.HEADER)
    outcome = F.when(F.col("content").isNull(), "no_note").when(headed, "promoted").otherwise("no_header")
    outcomes = wanted.join(notes.select("page_id", "content"), "page_id", "left").select("day", "page_id", outcome.alias("outcome"))
    rewritten = markdown.update_header(F.col("content"), F.create_map(F.lit("status"), F.lit("promoted"), F.lit("reviewed_at"), at.cast("string")))
    after = notes.join(wanted.select("page_id", F.lit(True).alias("_wanted")), "page_id", "left")
    return after.withColumn("content", F.when(F.col("_wanted") & headed, rewritten).otherwise(F.col("content"))).drop("_wanted").select(*notes.columns), outcomes


def group_steps(captures: DataFrame, members: DataFrame, most: int = 8) -> DataFrame:
    """group_id, place, step: the steps of groups (group_id, capture_id) of captures (capture_id, observation, updated_at).

    Captures are read newest first. The first `most` different steps are taken; of captures after that only the first step,
    where it is new. A group without steps has one that says so, a group with one step also a last one.
    """
    said = capture_rules.steps(captures, None).join(captures.select("capture_id", "updated_at"), "capture_id").join(members, "capture_id")
    when = F.struct("updated_at", "capture_id", (-F.col("place")).alias("back"))
    said = cut(said.select("group_id", "step", "place", when.alias("at")))
    newest = Window.partitionBy("group_id").orderBy(F.desc("at"))
    leading = said.groupBy("group_id", "step").agg(F.max("at").alias("at")).withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= most)
    full = leading.filter(F.col("k") == most).select("group_id", F.struct("at.updated_at", "at.capture_id").alias("_end"))
    later = said.filter("place = 1").join(full, "group_id").filter(F.struct("at.updated_at", "at.capture_id") < F.col("_end")).groupBy("group_id", "step").agg(F.max("at").alias("at"))
    both = leading.drop("k").unionByName(later.join(leading.select("group_id", "step"), ["group_id", "step"], "left_anti"))
    placed = both.withColumn("place", F.row_number().over(newest)).select("group_id", "place", "step")
    sizes = members.select("group_id").distinct().join(placed.groupBy("group_id").agg(F.count("*").alias("n")), "group_id", "left")
    few = sizes.filter("coalesce(n, 0) < 2").select("group_id", F.posexplode(F.when(F.col("n") == 1, F.array(F.lit(None), F.lit(LAST_STEP))).otherwise(F.array(F.lit(NO_STEP), F.lit(LAST_STEP)))).alias("place", "step")).filter("step is not null")
    return placed.unionByName(few.withColumn("place", F.col("place") + 1))


def propose(captures: DataFrame, procedures: DataFrame, page_ids: DataFrame, most: int = 3, least: float = 0.4, newest: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Procedure candidates from repeated captures (capture_id, title, observation, updated_at), as three tables.

    Candidates: page_id, title, trigger, n_sources, group_id; their steps: page_id, place, step; their sources: page_id,
    capture_id. procedures has the sources (page_id, capture_id) of the candidates that there are; a group that shares two
    or more with one of these is passed over. Of the others the `most` largest are proposed, under ids that page_ids
    (page_id) has not yet.
    """
    if newest is not None:
        captures = captures.orderBy(F.desc("updated_at"), F.desc("capture_id")).limit(newest)
    members = cut(capture_rules.repeat_members(captures, least))
    groups = capture_rules.named_groups(captures, members)
    chosen = cut(capture_rules.proposals(groups, members, procedures, most))
    base = chosen.withColumn("base", F.concat(F.lit("procedures/candidates/"), slug(F.col("title")))).withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), "key", "group_id")))
    stem, number = F.regexp_replace("page_id", r"-\d{1,9}$", ""), F.regexp_extract("page_id", r"-(\d{1,9})$", 1)
    like = page_ids.select("page_id", F.explode(F.array(F.struct(F.col("page_id").alias("base"), F.lit(1).alias("no")), F.struct(stem.alias("base"), F.when(number != "", number).cast("int").alias("no"))))).select("col.*").filter("no is not null")
    used = like.join(base.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("no").alias("used"))
    none = F.array().cast("array<int>")
    free = base.join(used, "base", "left").withColumn("used", F.coalesce("used", none)).withColumn("no", F.get(F.array_except(F.sequence(F.lit(1), F.size("used") + F.col("k")), F.col("used")), F.col("k") - 1))
    named = cut(free.select("group_id", F.when(F.col("no") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("no").cast("string"))).alias("page_id"), "title", F.concat(F.lit("When "), F.lower(F.substring_index("title", " ", 1)), F.lit(" occurs repeatedly")).alias("trigger"), F.col("n").alias("n_sources")))
    sources = members.join(named.select("group_id", "page_id"), "group_id").select("group_id", "page_id", "capture_id")
    steps = group_steps(captures, sources.select("group_id", "capture_id")).join(named.select("group_id", "page_id"), "group_id").select("page_id", "place", "step")
    return named, steps, sources.select("page_id", "capture_id")
