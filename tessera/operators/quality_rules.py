"""Data-quality rules over pages, links and claims: one row per finding, all rules in one union.

A finding is page_id, rule, severity, target, detail. Pages have page_id, title, kind, visibility, summary, sources,
confidence, epistemic_status, evidence, reviewed_at, stale_after, valid_until, trigger, schema_version, author,
validated_at, validated, steps and body; a text field counts as missing if it is null or blank.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import cut

ORDER = {"error": 0, "warning": 1, "info": 2}
#: What stands for an open conflict in a line, and folders whose pages need no sources.
MARKER = r"(?i)\b(CONTRADICTION|CONFLICT|DISPUTED)\s*:|TODO\s*:\s*verify"
LOOSE_FOLDERS = "^(inbox|notes)/"
RECOMMENDED = ("title", "kind", "visibility", "summary")
PROCEDURES = ("procedure", "procedure-candidate")
#: Rules whose finding a change of the header mends by itself.
FIXABLE = (
    "missing_frontmatter", "missing_title", "missing_kind", "missing_visibility", "missing_summary", "missing_sources", "stale_page", "procedure_missing_steps", "procedure_missing_trigger",
    "procedure-schema-version", "epistemic-label", "epistemic-unsourced",
)
#: What to do about a rule's findings.
ADVICE = {
    "missing_frontmatter": "add a header with title, kind, visibility and summary", "missing_sources": "list the sources", "broken_internal_link": "mend or remove the link", "orphan_page": "link to this page from another one",
    "duplicate_title": "rename one of the pages", "stale_page": "review the page and set a new date", "low_confidence": "verify the content", "contradiction_marker": "settle the conflict", "procedure_missing_steps": "list the steps",
    "procedure_missing_trigger": "say when to use it", "procedure_step_not_in_body": "describe the step", "procedure-schema-version": "state the version of the schema", "procedure-unvalidated": "validate it", "epistemic-label": "say how this is known",
    "epistemic-weak": "verify it or add evidence", "epistemic-unsourced": "add sources or evidence", "epistemic-claim": "review the claim or add a trace", **{f"missing_{f}": f"add the field {f}" for f in RECOMMENDED},
}
CATEGORIES = {
    "stale_pages": ("stale_page",), "missing_metadata": ("missing_frontmatter", "missing_title", "missing_kind", "missing_visibility", "missing_summary"), "contradictions": ("contradiction_marker",), "low_confidence": ("low_confidence",), "expired_facts": ("expired_fact",),
    "procedure_issues": ("procedure_missing_steps", "procedure_missing_trigger", "procedure_step_not_in_body"),
}


def blank(c: str | Column) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(column), F.lit("")) == ""


def iso_date(c: str) -> Column:
    """The date that a field begins with; null if it is none."""
    first = F.substring(F.trim(F.col(c).cast("string")), 1, 10)
    return F.when(first.rlike(r"^\d{4}-\d{2}-\d{2}$"), first.try_cast("date"))


def finding(rule: str, severity: str, when: Column, detail: Column | None = None, target: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    row = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (none if target is None else target).alias("target"), (none if detail is None else detail).alias("detail"))
    return F.when(when, row)


def found(pages: DataFrame, *findings: Column) -> DataFrame:
    """The findings that are not null, a row each."""
    return pages.select("page_id", F.explode(F.array_compact(F.array(*findings))).alias("x")).select("page_id", "x.rule", "x.severity", "x.target", "x.detail")


def header_findings(pages: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """Missing fields of the header; a page without any has one finding. Fields in `optional` may be missing."""
    empty = reduce(lambda a, b: a & b, (F.col(f).isNull() for f in RECOMMENDED)) & (F.size("sources") == 0)
    missing = [finding(f"missing_{f}", "warning", ~empty & blank(f)) for f in RECOMMENDED if f not in optional]
    unsourced = ~empty & (F.coalesce(F.size("sources"), F.lit(0)) <= 0) & ~F.col("page_id").rlike(LOOSE_FOLDERS)
    return found(pages, finding("missing_frontmatter", "warning", empty), *missing, finding("missing_sources", "warning", unsourced))


def freshness_findings(pages: DataFrame, today: Column) -> DataFrame:
    """Dates that are none, pages past their date, and facts past their validity."""
    day = today.cast("date")
    invalid = [finding(f"invalid_{c}", "warning", F.col(c).isNotNull() & iso_date(c).isNull(), F.col(c)) for c in ("reviewed_at", "stale_after", "valid_until")]
    stale = finding("stale_page", "warning", iso_date("stale_after") < day, iso_date("stale_after").cast("string"))
    return found(pages, *invalid, stale, finding("expired_fact", "warning", iso_date("valid_until") < day, iso_date("valid_until").cast("string")))


def confidence_findings(pages: DataFrame) -> DataFrame:
    return found(pages, finding("low_confidence", "info", F.lower(F.trim("confidence")).isin("low", "unknown"), F.col("confidence")))


def cleaned(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def marker_findings(pages: DataFrame, pattern: str = MARKER) -> DataFrame:
    """The first line of each body that holds a marker, to 240 characters."""
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), "\n"), cleaned)
    first = F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0))
    return found(pages.filter(F.col("body").rlike(r"(?i)CONTRADICTION|CONFLICT|DISPUTED|TODO") if pattern == MARKER else F.lit(True)).withColumn("_line", first), finding("contradiction_marker", "warning", F.col("_line").isNotNull(), F.substring("_line", 1, 240)))


def procedure_findings(pages: DataFrame) -> DataFrame:
    """What procedures lack; a step counts as described if its number is somewhere in the body."""
    rows = pages.filter(F.col("kind").isin(*PROCEDURES))
    no_steps = F.coalesce(F.size("steps"), F.lit(0)) <= 0
    lacks = lambda rule, c: finding(rule, "warning", blank(c))
    fixed = found(
        rows, finding("procedure_missing_steps", "error", no_steps), lacks("procedure_missing_trigger", "trigger"), lacks("procedure-schema-version", "schema_version"), lacks("procedure-missing-author", "author"),
        lacks("procedure-missing-validated-at", "validated_at"), finding("procedure-unvalidated", "warning", (F.col("kind") == "procedure") & ~F.coalesce("validated", F.lit(False))),
    )
    steps = rows.select("page_id", "body", F.posexplode("steps").alias("k", "step")).filter(~F.contains(F.coalesce("body", F.lit("")), (F.col("k") + 1).cast("string")))
    return fixed.unionByName(steps.select("page_id", F.lit("procedure_step_not_in_body").alias("rule"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("target"), F.col("step").alias("detail")))


def epistemic_findings(pages: DataFrame) -> DataFrame:
    """Decisions and captures without a status, and assumptions where they carry weight or stand alone."""
    kind, assumed = F.coalesce("kind", F.lit("page")), F.coalesce(F.col("epistemic_status") == "assumption", F.lit(False))
    alone = assumed & (F.coalesce(F.size("sources"), F.lit(0)) <= 0) & blank("evidence") & (kind != "capture")
    return found(
        pages, finding("epistemic-label", "warning", kind.isin("decision", "capture") & blank("epistemic_status")), finding("epistemic-weak", "warning", assumed & kind.isin("project", "service", "decision")), finding("epistemic-unsourced", "error", alone)
    )


def claim_findings(claims: DataFrame) -> DataFrame:
    """Claims that are assumptions, at their first page, or ?."""
    rows = claims.filter("candidate_type = 'claim' and epistemic_status = 'assumption'").withColumn("page_id", F.coalesce(F.get("source_page_ids", F.lit(0)), F.lit("?")))
    return found(rows, finding("epistemic-claim", "warning", F.lit(True), F.col("candidate_id")))


def duplicate_title_findings(pages: DataFrame) -> DataFrame:
    """Pages whose folded title others have as well; counts are joined back, so a common title is no group in one task."""
    keyed = pages.select("page_id", F.lower(cleaned(F.col("title"))).alias("key")).filter("key <> ''")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return found(keyed.join(shared, "key"), finding("duplicate_title", "warning", F.lit(True), F.col("key")))


def link_findings(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Broken links, and pages that no other page links to. links: source, target, exists."""
    broken = found(links.filter("not exists").select(F.col("source").alias("page_id"), F.col("target").alias("t")).distinct(), finding("broken_internal_link", "error", F.lit(True), target=F.col("t")))
    inbound = links.filter("exists and source <> target").select(F.col("target").alias("page_id")).distinct()
    return broken.unionByName(found(pages.select("page_id").join(inbound, "page_id", "left_anti"), finding("orphan_page", "info", F.lit(True))))


def lint(pages: DataFrame, links: DataFrame, today: Column, optional: tuple[str, ...] = ()) -> DataFrame:
    """All rules of pages and links."""
    parts = (header_findings(pages, optional), freshness_findings(pages, today), confidence_findings(pages), marker_findings(pages), procedure_findings(pages), epistemic_findings(pages), duplicate_title_findings(pages), link_findings(pages, links))
    return reduce(DataFrame.unionByName, parts)


def settle(findings: DataFrame, enabled: Mapping[str, bool] | None = None, severities: Mapping[str, str] | None = None, suppressed: DataFrame | None = None) -> DataFrame:
    """Findings after configuration: rules switched off go, severities are replaced, and suppressed (page_id, rule, reason) pairs are marked."""
    off = [r for r, on in (enabled or {}).items() if not on]
    rows = findings.filter(~F.col("rule").isin(off)) if off else findings
    for rule, severity in (severities or {}).items():
        rows = rows.withColumn("severity", F.when(F.col("rule") == rule, severity).otherwise(F.col("severity")))
    if suppressed is None:
        return rows.withColumn("suppressed", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    known = suppressed.groupBy("page_id", "rule").agg(F.min("reason").alias("reason"), F.lit(True).alias("suppressed"))
    return rows.join(known, ["page_id", "rule"], "left").withColumn("suppressed", F.coalesce("suppressed", F.lit(False)))


def ordered(findings: DataFrame, limit: int | None = None) -> DataFrame:
    """By severity, page, rule, target and detail; a report of the first ones with a limit."""
    place = F.coalesce(*(F.when(F.col("severity") == s, F.lit(k)) for s, k in ORDER.items()), F.lit(9))
    rows = findings.orderBy(place, "page_id", "rule", F.coalesce("target", F.lit("")), F.coalesce("detail", F.lit("")))
    return rows if limit is None else rows.limit(limit)


def advised(findings: DataFrame) -> DataFrame:
    """Findings with what to do about them, and whether a change of the header does it."""
    advice = F.coalesce(*(F.when(F.col("rule") == r, F.lit(a)) for r, a in ADVICE.items()))
    return findings.withColumn("advice", advice).withColumn("fixable", F.col("rule").isin(*FIXABLE))


def fixable(findings: DataFrame) -> DataFrame:
    """Advised findings that are fixable and not suppressed."""
    return advised(findings).filter("fixable and not suppressed")


def marker_review(lines: DataFrame, pattern: str = MARKER, around: int = 2) -> DataFrame:
    """page_id, line_no and the lines around every match.

    Only the lines around matches are shuffled into windows, joined by page and place.
    """
    hits = lines.filter(F.col("line").rlike(pattern)).select("page_id", "line_no")
    near = hits.select("page_id", "line_no", F.explode(F.sequence(F.col("line_no") - around, F.col("line_no") + around)).alias("n"))
    text = lines.select("page_id", F.col("line_no").alias("n"), "line")
    found_lines = near.join(text, ["page_id", "n"]).groupBy("page_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("x"))
    side = lambda keep: F.array_join(F.transform(F.filter("x", keep), lambda e: e["line"]), "\n")
    return found_lines.select("page_id", "line_no", side(lambda e: e["n"] < F.col("line_no")).alias("before"), side(lambda e: e["n"] == F.col("line_no")).alias("line"), side(lambda e: e["n"] > F.col("line_no")).alias("after"))


def first_markers(lines: DataFrame, pattern: str = MARKER) -> DataFrame:
    """page_id, rule, line_no of the first line of each page that matches."""
    hits = lines.filter(F.col("line").rlike(pattern)).groupBy("page_id").agg(F.min("line_no").alias("line_no"))
    return hits.select("page_id", F.lit("contradiction_marker").alias("rule"), F.col("line_no").cast("long").alias("line_no"))


def stale(pages: DataFrame, as_of: Column, column: str = "stale_after") -> DataFrame:
    """page_id, days_stale of pages whose date has passed, longest first."""
    days = F.datediff(as_of.cast("date"), iso_date(column))
    return pages.select("page_id", days.alias("days_stale")).filter("days_stale > 0").orderBy(F.desc("days_stale"), "page_id")


def review_queue(pages: DataFrame, as_of: Column) -> DataFrame:
    """page_id, state, days_stale: stale pages, and pages without any date outside the loose folders."""
    days = F.datediff(as_of.cast("date"), iso_date("stale_after"))
    state = F.when(days > 0, "stale").when(F.col("stale_after").isNull() & F.col("reviewed_at").isNull() & ~F.col("page_id").rlike(LOOSE_FOLDERS), "missing_metadata")
    return pages.select("page_id", state.alias("state"), F.when(days > 0, days).alias("days_stale")).filter("state is not null")


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that nothing links to."""
    return pages.select("page_id").join(links.select(F.col("target").alias("page_id")).distinct(), "page_id", "left_anti")


def orphan_suggestions(orphan: DataFrame, pages: DataFrame, most: int = 3, among: DataFrame | None = None) -> DataFrame:
    """For each orphan, the pages (of those in among, if given) that share most tags with it; of equally many, those of least page_id.

    Pages of equal tags are one set. The sets of orphans meet all sets by shared tag, so the pairs looked at grow with
    the different sets that hold a tag, not with its pages. Of each set the most + 1 least pages suffice: one of them
    may be the orphan.
    """
    tags = pages.select("page_id", F.explode("tags").alias("tag")).filter("tag is not null")
    sets = tags.groupBy("page_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    first = lambda *by: F.row_number().over(Window.partitionBy(by[0]).orderBy(*by[1:]))
    allowed = sets if among is None else sets.join(among, "page_id", "left_semi")
    least = allowed.withColumn("k", first("tags", "page_id")).filter(F.col("k") <= most + 1).select("tags", "page_id")
    mine = sets.join(orphan, "page_id", "left_semi").select(F.col("page_id").alias("orphan_id"), F.col("tags").alias("own"))
    a = mine.select("own").distinct().select("own", F.explode("own").alias("tag"))
    b = allowed.select("tags").distinct().select("tags", F.explode("tags").alias("tag"))
    shared = a.join(b, "tag").groupBy("own", "tags").agg(F.count("*").alias("n_shared"))
    order = (F.desc("n_shared"), "page_id")
    best = shared.join(least, "tags").withColumn("k", first("own", *order)).filter(F.col("k") <= most + 1)
    near = mine.join(best, "own").filter("orphan_id <> page_id").select("orphan_id", "page_id", "n_shared")
    return near.withColumn("place", first("orphan_id", *order)).filter(F.col("place") <= most)


def title_words(title: Column) -> Column:
    """Distinct words of four letters or digits and more, in lower case."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(title, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 4)))


def link_suggestions(orphan: DataFrame, pages: DataFrame, most: int = 3, among: DataFrame | None = None) -> DataFrame:
    """orphan_id, page_id, score, place: where (among these pages, if given) an orphan might be linked from.

    A page scores 10 and the number of shared tags if there are any, and the number of shared title words if there are
    two or more. Pages that share only tags come from orphan_suggestions, whose best ones are enough; those that share
    title words are met by pairs of words, so a single common word brings none together, and as classes of equal words and
    tags, so pages with one title count once.
    """
    words = cut(pages.select("page_id", title_words(F.col("title")).alias("words"), F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.isNotNull()))).alias("tags")).filter("size(words) > 1"))
    allowed = words if among is None else words.join(among, "page_id", "left_semi")
    pairs = F.flatten(F.transform("words", lambda w, i: F.transform(F.slice("words", i + 2, F.size("words")), lambda v: F.concat(w, F.lit(" "), v))))
    # Pages of equal title words and tags score alike, and the least ones come first: most + 1 of a class are enough.
    ranked = allowed.withColumn("k", F.row_number().over(Window.partitionBy("words", "tags").orderBy("page_id"))).filter(F.col("k") <= most + 1)
    own, other = (df.select(F.col("words").alias(f"{s}_words"), F.col("tags").alias(f"{s}_tags")).distinct() for df, s in ((words.join(orphan, "page_id", "left_semi"), "a"), (ranked, "b")))
    keyed = lambda df, s: df.select(f"{s}_words", f"{s}_tags", F.col(f"{s}_words").alias("words")).select(f"{s}_words", f"{s}_tags", F.explode(pairs).alias("pair"))
    met = keyed(own, "a").join(keyed(other, "b"), "pair").select("a_words", "a_tags", "b_words", "b_tags").distinct()
    n_tags, n_words = F.size(F.array_intersect("a_tags", "b_tags")), F.size(F.array_intersect("a_words", "b_words"))
    value = F.when(n_tags > 0, n_tags + 10).otherwise(0) + n_words
    # Of an orphan's class the best classes, most + 1 of them, hold its best pages.
    best = met.withColumn("value", value).withColumn("k", F.row_number().over(Window.partitionBy("a_words", "a_tags").orderBy(F.desc("value"), "b_words", "b_tags")))
    least = best.groupBy("a_words", "a_tags").agg(F.min(F.when(F.col("k") <= most + 1, F.col("value"))).alias("least"))
    best = best.join(least, ["a_words", "a_tags"]).filter(F.col("value") >= F.col("least")).select("a_words", "a_tags", "b_words", "b_tags", "value")
    page = best.join(ranked.select("page_id", F.col("words").alias("b_words"), F.col("tags").alias("b_tags")), ["b_words", "b_tags"])
    page = page.withColumn("k", F.row_number().over(Window.partitionBy("a_words", "a_tags").orderBy(F.desc("value"), "page_id"))).filter(F.col("k") <= most + 1).select("a_words", "a_tags", "page_id")
    mine = words.join(orphan, "page_id", "left_semi").select(F.col("page_id").alias("orphan_id"), F.col("words").alias("a_words"), F.col("tags").alias("a_tags"))
    close = mine.join(page, ["a_words", "a_tags"]).filter("orphan_id <> page_id").select("orphan_id", "page_id")
    near = close.unionByName(orphan_suggestions(orphan, pages, most, among).select("orphan_id", "page_id")).distinct()
    side = pages.select("page_id", F.array_distinct("tags").alias("tags"), title_words(F.col("title")).alias("words"))
    both = near.join(side.withColumnsRenamed({"page_id": "orphan_id", "tags": "o_tags", "words": "o_words"}), "orphan_id").join(side, "page_id")
    tags, shared = F.size(F.array_intersect("o_tags", "tags")), F.size(F.array_intersect("o_words", "words"))
    score = F.when(tags > 0, tags + 10).otherwise(0) + F.when(shared >= 2, shared).otherwise(0)
    place = F.row_number().over(Window.partitionBy("orphan_id").orderBy(F.desc("score"), "page_id"))
    return both.select("orphan_id", "page_id", score.alias("score")).filter("score > 0").withColumn("place", place).filter(F.col("place") <= most)


#: Fixed value: letters from common to rare, as ids hold them; others are rarer still.
COMMON_FIRST = "e/taoinsrhldc-0123456789umpgfbywvkxjqz"


def _letters(x: Column) -> Column:
    """The letters of an id, each with its how-manyeth occurrence, the rarest first: equal letters of two ids are a set's."""
    chars = F.array_sort(F.filter(F.split(x, ""), lambda c: c != ""))
    place = lambda c: F.nullif(F.call_function("instr", F.lit(COMMON_FIRST), c), F.lit(0))
    rows = F.transform(chars, lambda c, i: F.struct((F.array_position(chars, c).cast("int") - i - 2).alias("nth"), (-F.coalesce(place(c), F.lit(99))).alias("rare"), c.alias("c")))
    return F.transform(F.array_sort(rows), lambda r: F.concat(r["c"], F.lit("#"), r["nth"].cast("string")))


def like_ids(targets: DataFrame, pages: DataFrame, least: float) -> DataFrame:
    """target, page_id, ratio of all pairs whose ratio (matching blocks, Ratcliff and Obershelp) is at least `least`.

    The ratio is at most twice the letters in common over both lengths. So the rarest letters of either id hold one that
    both have (prefixes), and lengths differ by a factor at most: ids meet by (letter, length), pairs that the bound keeps
    are compared, once each. Empty ids are like none.
    """
    narrow, wide = least / (2 - least), (2 - least) / least

    def prefixed(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(name)).filter(F.col(name) != "").distinct().withColumn("set", _letters(F.col(name))).withColumn("n", F.size("set"))
        # Of n letters, least / 2 * (n + the shortest partner's) must be common: one is among the first of these.
        common = F.ceil(F.lit(least / 2) * (F.col("n") + F.ceil(F.col("n") * narrow - 1e-9)) - 1e-9)
        return rows.withColumn("prefix", F.slice("set", 1, F.greatest(F.lit(1), F.col("n") - common + 1).cast("int")))

    a = prefixed(targets, "target").withColumnsRenamed({"set": "a_set", "n": "a_n"})
    b = prefixed(pages, "page_id").withColumnsRenamed({"set": "b_set"})
    lengths = F.sequence(F.ceil(F.col("a_n") * narrow - 1e-9).cast("int"), F.floor(F.col("a_n") * wide + 1e-9).cast("int"))
    keyed = a.select("target", "a_n", F.explode("prefix").alias("letter"), lengths.alias("lengths")).withColumn("n", F.explode("lengths")).drop("lengths")
    met = keyed.join(b.select("page_id", "n", F.explode("prefix").alias("letter")), ["letter", "n"]).select("target", "page_id").distinct()
    both = met.join(a.select("target", "a_set", "a_n"), "target").join(b.select("page_id", "b_set", "n"), "page_id")
    near = both.filter(2 * F.size(F.array_intersect("a_set", "b_set")) >= least * (F.col("a_n") + F.col("n")) - 1e-9).select("target", "page_id")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import difflib

        match = difflib.SequenceMatcher()
        for frame in frames:
            ratios = []
            for target, rows in frame.groupby("target", sort=False)["page_id"]:
                match.set_seq2(target)
                for page in rows:
                    match.set_seq1(page)
                    ratios.append((target, page, match.ratio()))
            out = pd.DataFrame(ratios, columns=["target", "page_id", "ratio"])
            yield out[out["ratio"] >= least]

    return near.mapInPandas(compare, "target string, page_id string, ratio double")


CELL_TARGETS, CELL_PAGES = 16_384, 524_288  # ids that one task holds at most, about


def _nearest(left: pd.DataFrame, right: pd.DataFrame, most: int, least: float) -> pd.DataFrame:
    """target, page_id, ratio: close_ids() of one group of targets and one of page ids, both with their sorted letters."""
    import difflib
    import heapq
    from collections import Counter

    import numpy as np

    names = right["page_id"].to_numpy(object)
    order = np.argsort(names)[::-1]  # the greatest id first
    names = names[order]
    kind_of, kinds = pd.factorize(right["letters"].to_numpy(object)[order])
    held_by = np.argsort(kind_of, kind="stable")  # of each kind its ids' places, in order
    ends = np.cumsum(np.bincount(kind_of, minlength=len(kinds)))
    sizes, zero = np.array([len(k) for k in kinds], np.int64), np.zeros(len(kinds), np.int32)
    lists: dict[str, tuple[list[int], list[int]]] = {}
    for k, kind in enumerate(kinds):
        for letter, times in Counter(kind).items():
            where, counts = lists.setdefault(letter, ([], []))
            where.append(k)
            counts.append(times)
    held = {letter: (np.array(where), np.array(counts, np.int32)) for letter, (where, counts) in lists.items()}
    match, out = difflib.SequenceMatcher(), []
    for kind, alike in left.groupby("letters", sort=False)["target"] if len(kinds) else ():
        common = zero.copy()
        for letter, times in Counter(kind).items():
            if letter in held:
                common[held[letter][0]] += np.minimum(held[letter][1], times)
        bound = 2.0 * common / (sizes + len(kind))
        able = np.flatnonzero(bound >= least - 1e-9)
        able = able[np.argsort(-bound[able], kind="stable")]
        starts = np.flatnonzero(np.diff(bound[able], prepend=2.0))
        tiers: list[tuple[float, np.ndarray]] = []  # by falling bounds the places of ids, made as far as they are needed
        for target in alike:
            match.set_seq2(target)
            best: list[tuple[float, str]] = []
            for t in range(len(starts)):
                if t == len(tiers):
                    some = able[starts[t] : starts[t + 1] if t + 1 < len(starts) else None]
                    tiers.append((float(bound[some[0]]), np.sort(np.concatenate([held_by[(ends[k - 1] if k else 0) : ends[k]] for k in some.tolist()]))))
                top, places = tiers[t]
                if len(best) == most and top < best[0][0]:
                    break
                for k in places.tolist():
                    if len(best) == most and (top, names[k]) <= best[0]:
                        break
                    match.set_seq1(names[k])
                    found = (match.ratio(), names[k])
                    if found[0] >= least:
                        (heapq.heappushpop if len(best) == most else heapq.heappush)(best, found)
            out += [(target, page, ratio) for ratio, page in best]
    return pd.DataFrame(out, columns=["target", "page_id", "ratio"]).astype({"target": object, "page_id": object, "ratio": float})


def close_ids(targets: DataFrame, pages: DataFrame, most: int = 2, least: float = 0.4, cell: tuple[int, int] = (CELL_TARGETS, CELL_PAGES)) -> DataFrame:
    """target, page_id, ratio, place: the `most` page ids most like each broken target (column target), at `least` or more.

    The ratio (matching blocks, Ratcliff and Obershelp) is at most twice the letters in common over both lengths. A task
    holds a group of targets and one of page ids, dealt by their letters, and ids of equal letters share their bounds; for
    each target it compares ids from the highest bound down, of equal bounds the greater id first, until none left can be
    among its best. The best of all groups are merged. Of equal ratios the greater id comes first; empty ids are like none.
    """
    letters = lambda name: F.array_join(F.array_sort(F.split(F.col(name), "")), "").alias("letters")
    ids = lambda df, name: cut(df.select(F.col(name).cast("string").alias(name)).filter(F.col(name) != "").distinct().select(name, letters(name)))
    targets, pages = ids(targets, "target"), ids(pages, "page_id")
    n, columns = targets.count(), max(1, -(-pages.count() // cell[1]))
    spread = max(1, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")) // columns)
    rows = max(1, -(-n // cell[0]), min(-(-n // 64), spread))
    group = lambda k: F.pmod(F.xxhash64("letters", F.lit(23)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = targets.select(group(rows).alias("row"), every(columns).alias("column"), "target", "letters")
    b = pages.select(every(rows).alias("row"), group(columns).alias("column"), "page_id", "letters")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _nearest(left, right, most, least)

    found = a.groupBy("row", "column").cogroup(b.groupBy("row", "column")).applyInPandas(nearest, "target string, page_id string, ratio double")
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("ratio"), F.desc("page_id")))
    return cut(found).withColumn("place", place).filter(F.col("place") <= most).withColumn("ratio", F.round("ratio", 6))


def with_suggestions(findings: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """Findings with `suggestions`: of a broken link the page ids most like its target, of an orphan the pages to link it from; else none."""
    close = close_ids(findings.filter("rule = 'broken_internal_link'").select("target"), pages).select(F.lit("broken_internal_link").alias("_rule"), F.col("target").alias("_of"), "place", "page_id")
    inbound = links.filter("exists and source <> target").select(F.col("target").alias("page_id")).distinct()
    orphan = findings.filter("rule = 'orphan_page'").select("page_id").distinct()
    from_ = link_suggestions(orphan, pages, among=inbound)
    ranked = from_.withColumn("place", F.row_number().over(Window.partitionBy("orphan_id").orderBy(F.desc("score"), "page_id"))).select(F.lit("orphan_page").alias("_rule"), F.col("orphan_id").alias("_of"), "place", "page_id")
    lists = close.unionByName(ranked).groupBy("_rule", "_of").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "page_id"))), lambda x: x["page_id"]).alias("suggestions"))  # three at most
    of = F.when(F.col("rule") == "broken_internal_link", F.col("target")).when(F.col("rule") == "orphan_page", F.col("page_id"))
    joined = findings.withColumn("_key", of).join(lists, (F.col("rule") == F.col("_rule")) & (F.col("_key") == F.col("_of")), "left")
    return joined.withColumn("suggestions", F.coalesce("suggestions", F.array().cast("array<string>"))).drop("_key", "_rule", "_of")


def heartbeat(findings: DataFrame) -> DataFrame:
    """category, n, first_page: findings that are not suppressed by category of upkeep; the details are the findings themselves."""
    named = F.coalesce(*(F.when(F.col("rule").isin(*rules), F.lit(c)) for c, rules in CATEGORIES.items()))
    rows = findings.filter("not suppressed").withColumn("category", named).filter("category is not null")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def heartbeat_captures(findings: DataFrame, pages: DataFrame, done: DataFrame, self_task: str = "heartbeat-self-audit") -> DataFrame:
    """category, n of what is to be captured today: findings outside the upkeep's own pages, in categories not captured yet (done: category).

    Missing metadata is never captured.
    """
    own = pages.filter(F.col("source_task") == self_task).select("page_id")
    left = heartbeat(findings.join(own, "page_id", "left_anti")).filter("category <> 'missing_metadata'")
    return left.join(done.select("category").distinct(), "category", "left_anti").select("category", "n")


def missing_fields(pages: DataFrame, required: Mapping[str, list[str]]) -> DataFrame:
    """page_id, missing: the required header fields of its kind that a page lacks (header is a map)."""
    wanted = F.coalesce(*(F.when(F.col("kind") == k, F.array(*(F.lit(f) for f in fields))) for k, fields in required.items()), F.array().cast("array<string>"))
    have = F.map_keys(F.map_filter("header", lambda k, v: F.coalesce(F.trim(v), F.lit("")) != ""))
    return pages.select("page_id", F.array_except(wanted, have).alias("missing")).filter(F.size("missing") > 0)
