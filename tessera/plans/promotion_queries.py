"""Queries of promotions, notes, procedure candidates and digests with their captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import captures, promotion
from tessera.plans.registry import query
from tessera.plans.vault_queries import CAPTURE
from tessera.sources import model, storage

VAULT = model.cte("vault")

#: Every page asks to be promoted; some name a target of their own, a wrong one, or bring their text.
REQUEST = {
    "seq": "doc_id",
    "capture_id": "CASE WHEN doc_id % 50 = 0 THEN 'inbox/gone' || CAST(doc_id AS STRING) ELSE page_id END",
    "target": "CASE doc_id % 9 WHEN 0 THEN 'concepts/new' || CAST(CAST(floor(doc_id / 144) AS BIGINT) AS STRING) WHEN 1 THEN '../up' WHEN 2 THEN 'runbooks/new' || CAST(doc_id AS STRING) ELSE NULL END",
    "content": "CASE WHEN doc_id % 14 IN (4, 5) THEN '# By ' || source || chr(10) || 'in ' || lang ELSE NULL END",
}
REQUESTS = f"r AS (SELECT {', '.join(f'{e} AS {c}' for c, e in REQUEST.items())}, FROM (SELECT v.*, d.lang, d.source FROM vault v JOIN documents d USING (doc_id)))"
SEGMENTS = r"^[A-Za-z0-9_][\w.-]*(/[A-Za-z0-9_][\w.-]*)*$"
JUDGED = f"""{REQUESTS}, j AS (SELECT r.seq, r.capture_id, r.content, v.page_id, v.kind, coalesce(nullif(trim(r.target), ''), nullif(trim(v.suggested_target), '')) AS target FROM r LEFT JOIN vault v ON v.page_id = r.capture_id),
b AS (SELECT *, CASE WHEN page_id IS NULL THEN 'not_found' WHEN coalesce(kind, '') <> 'capture' OR NOT regexp_matches(capture_id, '^(inbox|notes)/') THEN 'not_a_capture' WHEN target IS NULL THEN 'no_target' WHEN NOT regexp_matches(target, '{SEGMENTS}') THEN 'invalid_target' END AS bad FROM j),
o AS (SELECT seq, capture_id, target, content, coalesce(bad, CASE WHEN content IS NULL AND (target IN (SELECT page_id FROM vault) OR row_number() OVER (PARTITION BY target, bad ORDER BY seq) > 1) THEN 'exists' ELSE 'promoted' END) AS outcome FROM b)"""


def asked(spark, sf_dir):
    pages = model.frame(spark, sf_dir, "vault")
    words = storage.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return pages.join(words, "doc_id").selectExpr(*(f"{e} AS `{c}`" for c, e in REQUEST.items())), pages


@query(f"WITH {VAULT}, {JUDGED} SELECT seq, capture_id, target, outcome FROM o")
def promotion_outcomes(spark, sf_dir):
    return promotion.judge(*asked(spark, sf_dir)).select("seq", "capture_id", "target", "outcome")


@query(rf"""WITH {VAULT}, {JUDGED}, n AS (SELECT target AS page_id, arg_max(capture_id, seq) AS capture_id, max(seq) AS last FROM o WHERE outcome = 'promoted' GROUP BY 1), m AS (SELECT n.page_id, n.capture_id, o.content FROM n JOIN o ON o.seq = n.last AND o.target = n.page_id),
a AS (SELECT capture_id AS page_id, arg_max(target, seq) AS target FROM o WHERE outcome = 'promoted' GROUP BY 1)
SELECT v.page_id, title, kind, visibility, CASE WHEN target IS NOT NULL THEN 'accepted' ELSE status END AS status, summary, array_to_string(tags, ',') AS tags, array_to_string(sources, ',') AS sources, md5(body) AS body, coalesce(target, promoted_to) AS promoted_to FROM vault v LEFT JOIN a USING (page_id) WHERE v.page_id NOT IN (SELECT page_id FROM m)
UNION ALL SELECT m.page_id, CASE WHEN content IS NOT NULL THEN regexp_extract(content, '^# ([^\n]*)', 1) ELSE coalesce(title, regexp_extract(body, '^# ([^\n]*)', 1)) END, regexp_replace(string_split(m.page_id, '/')[1], 's+$', ''), 'internal', CASE WHEN content IS NULL THEN 'active' END, CASE WHEN content IS NULL THEN 'Promoted from capture ' || m.capture_id END,
CASE WHEN content IS NULL THEN array_to_string(tags, ',') ELSE '' END, CASE WHEN content IS NULL THEN m.capture_id ELSE '' END, md5(CASE WHEN content IS NULL THEN regexp_replace(body, '\s+$', '') || chr(10) ELSE content END), NULL FROM m JOIN vault v ON v.page_id = m.capture_id""")
def promoted_pages(spark, sf_dir):
    after, _ = promotion.promote(*asked(spark, sf_dir))
    return after.select("page_id", "title", "kind", "visibility", "status", "summary", F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"), F.md5("body").alias("body"), "promoted_to")


NOTES = f"""n AS (SELECT observed_at AS day, count(*) AS n FROM vault WHERE observed_at IS NOT NULL GROUP BY 1), c AS (SELECT day, 'dailies/' || day AS page_id, CASE WHEN n % 4 = 0 THEN '' WHEN n % 3 = 0 THEN '---' || chr(10) || 'title: Notes' || chr(10) || 'status: draft' || chr(10) || '---' || chr(10) ELSE '---' || chr(10) || 'status: draft' || chr(10) || 'reviewed_at: null' || chr(10) || 'kind: daily' || chr(10) || '---' || chr(10) END AS head, '# ' || day || chr(10) || CAST(n AS VARCHAR) || ' pages' AS rest FROM n),
d AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)"""
REVIEWED = "replace(head, 'status: draft', 'status: promoted')"
MARKED = f"CASE WHEN contains(head, 'reviewed_at') THEN replace({REVIEWED}, 'reviewed_at: null', 'reviewed_at: {model.TODAY}') ELSE replace({REVIEWED}, 'promoted' || chr(10) || '---', 'promoted' || chr(10) || 'reviewed_at: {model.TODAY}' || chr(10) || '---') END"


def noted(spark, sf_dir):
    """A daily note of each day that pages were seen on, of several forms, and the days of events."""
    n = model.frame(spark, sf_dir, "vault").filter("observed_at is not null").groupBy(F.col("observed_at").alias("day")).agg(F.count("*").alias("n"))
    head = F.when(F.col("n") % 4 == 0, "").when(F.col("n") % 3 == 0, "---\ntitle: Notes\nstatus: draft\n---\n").otherwise("---\nstatus: draft\nreviewed_at: null\nkind: daily\n---\n")
    notes = n.select(F.concat(F.lit("dailies/"), "day").alias("page_id"), F.concat(head, F.lit("# "), "day", F.lit("\n"), F.col("n").cast("string"), F.lit(" pages")).alias("content"))
    return notes, storage.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()


@query(f"WITH {VAULT}, {NOTES} SELECT page_id, CASE WHEN day IN (SELECT day FROM d) AND head <> '' THEN {MARKED} ELSE head END || rest AS content FROM c")
def promoted_notes(spark, sf_dir):
    return promotion.promote_notes(*noted(spark, sf_dir), F.lit(model.TODAY))[0]


@query(f"WITH {VAULT}, {NOTES} SELECT d.day, 'dailies/' || d.day AS page_id, CASE WHEN c.day IS NULL THEN 'no_note' WHEN head = '' THEN 'no_header' ELSE 'promoted' END AS outcome FROM d LEFT JOIN c ON c.day = d.day")
def note_outcomes(spark, sf_dir):
    return promotion.promote_notes(*noted(spark, sf_dir), F.lit(model.TODAY))[1]


@query(f"WITH {VAULT}, d AS (SELECT coalesce(source_task, '(no task)') AS key, page_id AS capture_id FROM vault WHERE {CAPTURE}) SELECT key, count(*) OVER (PARTITION BY key) AS n, capture_id FROM d")
def digest_members(spark, sf_dir):
    rows = model.frame(spark, sf_dir, "vault").filter(promotion.is_capture(F.col("kind"), F.col("page_id"))).withColumnRenamed("page_id", "capture_id")
    return captures.digest_members(rows, F.col("source_task"), "(no task)")


def proposed(spark, sf_dir):
    pages = model.frame(spark, sf_dir, "vault")
    rows = pages.filter(promotion.is_capture(F.col("kind"), F.col("page_id"))).select(F.col("page_id").alias("capture_id"), F.coalesce("title", "page_id").alias("title"), F.col("body").alias("observation"), F.to_timestamp("observed_at").alias("updated_at"))
    return promotion.propose(rows, pages.filter("kind = 'procedure-candidate'").select("page_id", F.explode("sources").alias("capture_id")), pages.select("page_id"))


@query()
def procedure_candidates(spark, sf_dir):
    return proposed(spark, sf_dir)[0]


@query()
def procedure_candidate_steps(spark, sf_dir):
    return proposed(spark, sf_dir)[1]
