"""Queries over the driver's tables: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import captures, fusion, graph, lexical, pages, precedents, quality_rules, vectors
from tessera.plans import graph_sql
from tessera.plans.registry import ORACLES, query
from tessera.sources import adapters, storage
from tessera.streaming import claims as streams

QUERY = "the trash nicht"
MARKER = "worthless|disgusting|trash"


PAGES = "p AS (SELECT doc_id::VARCHAR AS page_id, string_split(text, chr(10))[1] AS title, lang AS kind, source AS lane, [lang, source] AS tags, substr(text, 1, 200) AS summary, text AS body, n_chars AS size FROM documents)"
LINES = "l AS (SELECT doc_id::VARCHAR AS page_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"
EDGES = """e AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'located_in' AS type FROM customer
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in' FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of' FROM nation),
b AS (SELECT source AS node, target AS other, type, 'out' AS direction FROM e UNION ALL SELECT target, source, type, 'in' FROM e)"""
LINKS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages), k AS (SELECT page_id, href, string_split(href, '/')[2] AS target FROM h),
sec AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS section FROM pages)"""
POSTS = """t AS (SELECT page_id, unnest(regexp_extract_all(lower(body), '[a-z0-9]{1,}')) AS token FROM p), post AS (SELECT page_id, token, count(*) AS tf FROM t GROUP BY ALL)"""


def _terms_score(fields_only: bool = False) -> str:
    parts = []
    for t in QUERY.split():
        parts += [f"CASE WHEN contains(lower({f}), '{t}') THEN {w} ELSE 0 END" for f, w in (("title", 12), ("page_id", 8), ("array_to_string(tags, ' ')", 6), ("summary", 5))]
        n = f"((length(body) - length(replace(lower(body), '{t}', ''))) // {len(t)})"
        parts.append(f"CASE WHEN {n} > 0 THEN 1 + least({n}, 5) ELSE 0 END")
    return " + ".join(parts)


@query(f"WITH {PAGES} SELECT page_id, kind, score::BIGINT AS score FROM (SELECT page_id, kind, {_terms_score()} AS score FROM p) WHERE score > 0 ORDER BY score DESC, page_id LIMIT 20")
def scan_search_topk(spark, sf_dir):
    return lexical.scan_search(adapters.pages(spark, sf_dir), QUERY)


@query(f"""WITH {PAGES}, u AS (SELECT 'kind' AS field, kind AS value, page_id FROM p UNION ALL SELECT 'lane', lane, page_id FROM p UNION ALL SELECT DISTINCT 'tag', unnest(tags), page_id FROM p)
SELECT field, value, count(*) AS n_pages FROM u WHERE value IS NOT NULL GROUP BY ALL""")
def page_catalog(spark, sf_dir):
    return pages.catalog(adapters.pages(spark, sf_dir))


@query(f"WITH {PAGES}, f AS (SELECT * FROM p WHERE kind = 'de') SELECT page_id, kind, size, (SELECT count(*) FROM f) AS total FROM f ORDER BY kind, page_id LIMIT 25 OFFSET 10")
def page_listing(spark, sf_dir):
    return pages.listing(pages.select_pages(adapters.pages(spark, sf_dir), kind="de").select("page_id", "kind", "size"), 25, 10)


@query(f"WITH {PAGES} SELECT page_id, kind, lane FROM p WHERE contains(lower(page_id), 'src1') OR contains(lower(title), 'src1') OR len(list_filter(tags, lambda x: contains(lower(x), 'src1'))) > 0 OR contains(lower(summary), 'src1')")
def page_filter(spark, sf_dir):
    return pages.select_pages(adapters.pages(spark, sf_dir), q="SRC1").select("page_id", "kind", "lane")


@query(f"""WITH {LINES}, m AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY line_no) AS match_no FROM l WHERE contains(lower(line), 'trash') OR contains(lower(line), 'nicht'))
SELECT page_id, match_no, line_no, substr(line, 1, 240) AS snippet FROM m WHERE match_no <= 3""")
def snippet_lines(spark, sf_dir):
    return lexical.snippet_lines(adapters.sections(spark, sf_dir), "trash nicht")


@query("SELECT source AS lane, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def lane_counts(spark, sf_dir):
    return pages.counts_by(adapters.pages(spark, sf_dir), "lane")


@query("SELECT role AS actor, count(*) AS n FROM conversations WHERE role IS NOT NULL GROUP BY 1")
def actor_counts(spark, sf_dir):
    return pages.counts_by(adapters.captures(spark, sf_dir), "actor")


@query(f"WITH {PAGES}, {POSTS} SELECT page_id, token, tf FROM post")
def chunk_postings(spark, sf_dir):
    return lexical.postings(adapters.pages(spark, sf_dir))


@query(f"WITH {PAGES}, {POSTS} SELECT token, count(*) AS df FROM post GROUP BY token")
def doc_freq(spark, sf_dir):
    return lexical.page_frequency(adapters.pages(spark, sf_dir))


@query(f"""WITH {PAGES}, {POSTS}, len AS (SELECT page_id, len(regexp_extract_all(lower(body), '[a-z0-9]{{1,}}')) AS dl FROM p), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
q AS (SELECT * FROM post WHERE token IN ('the', 'trash', 'nicht')), f AS (SELECT token, count(*) AS df FROM q GROUP BY 1)
SELECT page_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
FROM q JOIN f USING (token) JOIN len USING (page_id) CROSS JOIN s GROUP BY page_id ORDER BY score DESC, page_id LIMIT 20""")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(adapters.pages(spark, sf_dir), QUERY)


@query(f"""WITH {PAGES}, x AS (SELECT page_id, {_terms_score().replace('nicht', '@').replace('trash', '@')} AS ignored FROM p LIMIT 0),
s AS (SELECT page_id, title, tags, (CASE WHEN contains(lower(title), 'de') THEN 12 ELSE 0 END + CASE WHEN contains(lower(page_id), 'de') THEN 8 ELSE 0 END + CASE WHEN contains(lower(array_to_string(tags, ' ')), 'de') THEN 6 ELSE 0 END
+ CASE WHEN contains(lower(summary), 'de') THEN 5 ELSE 0 END + CASE WHEN contains(lower(body), 'de') THEN 1 + least((length(body) - length(replace(lower(body), 'de', ''))) // 2, 5) ELSE 0 END) AS base, summary, body FROM p)
SELECT page_id, (base + CASE WHEN lower(trim(title)) = 'de' THEN 8 WHEN starts_with(lower(trim(title)), 'de') THEN 4 ELSE 0 END + CASE WHEN list_contains(tags, 'de') THEN 3 ELSE 0 END)::BIGINT AS score,
concat_ws(',', CASE WHEN contains(lower(title), 'de') THEN 'title' END, CASE WHEN contains(lower(summary), 'de') THEN 'summary' END, CASE WHEN contains(lower(array_to_string(tags, ' ')), 'de') THEN 'tags' END, CASE WHEN contains(lower(body), 'de') THEN 'body' END) AS matched
FROM s WHERE base > 0 ORDER BY score DESC, page_id LIMIT 20""")
def exact_match_boost(spark, sf_dir):
    return lexical.boosted_search(adapters.pages(spark, sf_dir), "de")


@query(f"""WITH {PAGES}, t AS (SELECT page_id, regexp_extract_all(lower(body), '[a-z0-9]{{2,}}') AS ts FROM p), r AS (SELECT page_id, len(ts) AS n, unnest(ts) AS token FROM t),
tf AS (SELECT page_id, token, count(*) / n AS tf FROM r GROUP BY page_id, token, n), w AS (SELECT token, ln(((SELECT count(*) FROM p) + 1) / (count(*) + 1)) + 1 AS idf FROM tf WHERE token IN ('nicht', 'the', 'trash') GROUP BY token),
s AS (SELECT page_id, sum(tf * idf * idf / 3.0) AS dot, sqrt(sum(power(tf * coalesce(idf, 1.0), 2))) AS norm FROM tf LEFT JOIN w USING (token) GROUP BY page_id)
SELECT page_id, round(dot / (norm * (SELECT sqrt(sum(power(idf / 3.0, 2))) FROM w)), 6) AS score FROM s WHERE dot > 0 ORDER BY score DESC, page_id DESC LIMIT 10""")
def sparse_cosine_topk(spark, sf_dir):
    return vectors.sparse_cosine(adapters.pages(spark, sf_dir), QUERY)


PROBE = [round((-1) ** k * (k % 7) / 7, 4) for k in range(64)]


@query(f"SELECT vec_id, label, round(greatest(0, list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[])), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def dense_knn(spark, sf_dir):
    return vectors.dense_search(storage.table(spark, sf_dir, "embeddings"), PROBE)


@query("SELECT label, place::INTEGER AS place, round(avg(x), 6) AS mean, count(*) AS n FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) GROUP BY ALL")
def label_centroids(spark, sf_dir):
    return vectors.label_centroids(storage.table(spark, sf_dir, "embeddings"))


def _ranked(sql: str, name: str) -> str:
    return f"SELECT page_id, row_number() OVER (ORDER BY score DESC, page_id) AS {name} FROM ({sql})"


@query(f"""WITH a AS ({_ranked(ORACLES['bm25_topk'], 'lexical_rank')}), b AS ({_ranked(ORACLES['sparse_cosine_topk'], 'vector_rank')})
SELECT page_id, lexical_rank, vector_rank, round(coalesce(0.5 / (60 + lexical_rank), 0) + coalesce(0.3 / (60 + vector_rank), 0), 6) AS score FROM a FULL JOIN b USING (page_id) ORDER BY score DESC, page_id LIMIT 10""")
def rrf_fusion(spark, sf_dir):
    p = adapters.pages(spark, sf_dir)
    return fusion.reciprocal_rank_fusion(lexical.bm25(p, QUERY), vectors.sparse_cosine(p, QUERY))


RESULTS = """r AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
rel AS (SELECT DISTINCT lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1)"""


@query(f"""WITH {RESULTS}, f AS (SELECT query_id, count(*) AS n_found, count(rel.doc_id) AS n_hits, min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END) AS first FROM (SELECT * FROM r WHERE rank <= 20) r LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1),
w AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), m AS (SELECT query_id, n_hits / n_found AS p, n_hits / n AS c, first FROM w JOIN f USING (query_id))
SELECT query_id, round(p, 6) AS precision, round(c, 6) AS recall, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f1, round(coalesce(1 / first, 0), 6) AS reciprocal_rank FROM m""")
def precision_recall_at_k(spark, sf_dir):
    from pyspark.sql import Window

    d = storage.table(spark, sf_dir, "documents").withColumnRenamed("lang", "query_id")
    good = storage.table(spark, sf_dir, "labels").filter("quality = 1")
    order = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    results = d.select("query_id", "doc_id", F.row_number().over(order).alias("rank"))
    return fusion.measures(results, d.join(good, "doc_id", "left_semi").select("query_id", "doc_id").distinct(), 20)


@query("""WITH t AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::BIGINT AS k, ts FROM events), b AS (SELECT user_id, sum(k) AS total FROM t GROUP BY 1)
SELECT user_id, total, arg_max(k, (ts, event_id)) AS last, (SELECT round(avg(k), 6) FROM (SELECT k FROM t x WHERE x.user_id = b.user_id AND k > 0 ORDER BY ts DESC, event_id DESC LIMIT 10)) AS recent FROM b JOIN t USING (user_id) GROUP BY ALL""")
def token_rollup(spark, sf_dir):
    from pyspark.sql import Window

    t = storage.table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    recent = t.filter("k > 0").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).filter("place <= 10")
    totals = t.groupBy("user_id").agg(F.sum("k").alias("total"), F.max_by("k", F.struct("ts", "event_id")).alias("last"))
    return totals.join(recent.groupBy("user_id").agg(F.round(F.avg("k"), 6).alias("recent")), "user_id", "left")


@query(f"WITH {LINKS} SELECT DISTINCT page_id, target, target IN (SELECT section FROM sec) AS exists FROM k WHERE target IS NOT NULL")
def link_edges(spark, sf_dir):
    return graph.link_graph(adapters.hrefs(spark, sf_dir), adapters.page_sections(spark, sf_dir)).filter("target is not null")


@query(f"WITH {LINKS}, x AS (SELECT DISTINCT page_id, target FROM k) SELECT count(*) AS n_links, count(*) FILTER (target NOT IN (SELECT section FROM sec)) AS n_broken, count(DISTINCT page_id) AS n_pages FROM x")
def broken_links(spark, sf_dir):
    links = graph.link_graph(adapters.hrefs(spark, sf_dir), adapters.page_sections(spark, sf_dir))
    return links.agg(F.count("*").alias("n_links"), F.count_if(~F.col("exists")).alias("n_broken"), F.countDistinct("page_id").alias("n_pages"))


@query(f"WITH {LINKS} SELECT section AS page_id FROM sec WHERE section NOT IN (SELECT target FROM k WHERE target IS NOT NULL)")
def orphans(spark, sf_dir):
    return quality_rules.orphans(adapters.page_sections(spark, sf_dir).withColumnRenamed("section", "page_id"), adapters.hrefs(spark, sf_dir))


@query(f"WITH {EDGES} SELECT node, count(*) FILTER (direction = 'in') AS n_in, count(*) FILTER (direction = 'out') AS n_out FROM b GROUP BY node")
def degree_counts(spark, sf_dir):
    return graph.degrees(adapters.edges(spark, sf_dir))


@query(f"WITH {EDGES} SELECT other, type, direction FROM b WHERE node = 'n3' AND type = 'located_in' AND direction = 'in'")
def neighbors_filtered(spark, sf_dir):
    return graph.neighbours(adapters.edges(spark, sf_dir), "n3", ["located_in"], "in")


REACH = f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'r1' AS node, 0 AS hop UNION SELECT b.other, r.hop + 1 FROM r JOIN b ON b.node = r.node WHERE r.hop < 2), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY node)"""


@query(f"{REACH} SELECT node, hop FROM m")
def khop_reach(spark, sf_dir):
    return graph.reach(adapters.edges(spark, sf_dir), "r1", 2)


@query(f"{REACH} SELECT source, target, type FROM e WHERE source IN (SELECT node FROM m) AND target IN (SELECT node FROM m)")
def ego_subgraph(spark, sf_dir):
    return graph.ego(adapters.edges(spark, sf_dir), "r1", 2)


@query(f"WITH {EDGES}, n AS (SELECT DISTINCT node FROM b), k AS (SELECT node, count(DISTINCT other) AS k FROM b WHERE node <> other GROUP BY 1) SELECT node, round(coalesce(k, 0) / ((SELECT count(*) FROM n) - 1), 6) AS centrality FROM n LEFT JOIN k USING (node)")
def degree_centrality(spark, sf_dir):
    return graph.degree_centrality(adapters.edges(spark, sf_dir))


@query(f"WITH {EDGES}, t AS (SELECT node FROM b GROUP BY node ORDER BY count(*) DESC, node LIMIT 30) SELECT source, target, type FROM e WHERE source IN (SELECT node FROM t) AND target IN (SELECT node FROM t)")
def graph_truncate(spark, sf_dir):
    return graph.truncate(adapters.edges(spark, sf_dir), 30)


@query(f"WITH RECURSIVE {EDGES}, {graph_sql.COMMUNITIES} SELECT node, community FROM cm")
def graph_communities(spark, sf_dir):
    return graph.communities(adapters.edges(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, {graph_sql.COMMUNITIES}, {graph_sql.BETWEENNESS} SELECT node, betweenness FROM bt")
def graph_betweenness(spark, sf_dir):
    return graph.betweenness(adapters.edges(spark, sf_dir))


@query(f"""WITH {PAGES}, k AS (SELECT page_id, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title_key FROM p), g AS (SELECT title_key, count(*) AS n_pages FROM k WHERE title_key <> '' GROUP BY 1)
SELECT page_id, title_key, n_pages FROM k JOIN g USING (title_key) WHERE n_pages >= 2""")
def duplicate_titles(spark, sf_dir):
    return pages.duplicate_titles(adapters.pages(spark, sf_dir))


@query(f"WITH {LINES} SELECT page_id, 'contradiction_marker' AS rule, min(line_no)::BIGINT AS line_no FROM l WHERE regexp_matches(line, '{MARKER}') GROUP BY page_id")
def contradiction_lines(spark, sf_dir):
    return quality_rules.first_markers(adapters.sections(spark, sf_dir), MARKER)


@query(f"""WITH {LINES}, h AS (SELECT page_id, line_no FROM l WHERE regexp_matches(line, '{MARKER}'))
SELECT h.page_id, h.line_no, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (l.line_no < h.line_no), '') AS before, string_agg(l.line, '') FILTER (l.line_no = h.line_no) AS line, coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (l.line_no > h.line_no), '') AS after
FROM h JOIN l ON l.page_id = h.page_id AND l.line_no BETWEEN h.line_no - 2 AND h.line_no + 2 GROUP BY ALL""")
def contradiction_context(spark, sf_dir):
    return quality_rules.marker_review(adapters.sections(spark, sf_dir), MARKER)


@query("SELECT o_orderkey::VARCHAR AS page_id, date_diff('day', o_orderdate::DATE, DATE '1998-01-01')::INTEGER AS days_stale FROM orders WHERE o_orderdate::DATE < DATE '1998-01-01'")
def stale_queue(spark, sf_dir):
    o = storage.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("page_id"), F.col("o_orderdate").alias("stale_after"))
    return quality_rules.stale(o, F.lit("1998-01-01"))


@query("SELECT ts::DATE AS key, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1".replace("ts::DATE", "ts::DATE::VARCHAR"))
def digest_by_date(spark, sf_dir):
    e = storage.table(spark, sf_dir, "events").withColumnRenamed("event_id", "capture_id")
    return captures.digest(e, F.to_date("ts"), "(no date)")


@query("SELECT CASE WHEN event_type = 'view' THEN '(no task)' ELSE event_type END AS key, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1")
def digest_by_task(spark, sf_dir):
    e = storage.table(spark, sf_dir, "events").withColumnRenamed("event_id", "capture_id")
    return captures.digest(e, F.nullif(F.col("event_type"), F.lit("view")), "(no task)")


@query("SELECT ts::DATE AS day, count(*) AS n FROM events WHERE ts::DATE NOT IN (SELECT ts::DATE FROM events WHERE event_type = 'error' AND user_id % 10 = 0 AND value > 100) GROUP BY 1")
def pending_days_antijoin(spark, sf_dir):
    e = storage.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return captures.pending_days(e, e.filter("event_type = 'error' and user_id % 10 = 0 and value > 100"))


def _document_captures(spark, sf_dir):
    return storage.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("capture_id"), F.col("text").alias("observation"))


KEYWORDS = """k AS (SELECT doc_id AS capture_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents), w AS (SELECT capture_id, len(w) AS n, unnest(w) AS word FROM k),
j AS (SELECT a.capture_id AS a_id, b.capture_id AS b_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM w a JOIN w b ON a.word = b.word AND a.capture_id < b.capture_id GROUP BY 1, 2)"""


@query(f"WITH {KEYWORDS} SELECT a_id, b_id, round(j, 6) AS jaccard FROM j WHERE j >= 0.4")
def jaccard_pairs(spark, sf_dir):
    return captures.similar_pairs(_document_captures(spark, sf_dir))


@query(f"""WITH RECURSIVE {KEYWORDS}, e AS MATERIALIZED (SELECT a_id AS u, b_id AS v FROM j WHERE j >= 0.4 UNION ALL SELECT b_id, a_id FROM j WHERE j >= 0.4), c AS (SELECT u, u AS g FROM e UNION SELECT e.v, c.g FROM c JOIN e ON e.u = c.u)
SELECT u AS capture_id, min(g) AS group_id FROM c GROUP BY u""")
def repeated_captures(spark, sf_dir):
    return captures.repeated(_document_captures(spark, sf_dir))


@query("SELECT lower(word) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[a-z]{4,}')) AS word FROM documents) GROUP BY 1 ORDER BY n DESC, word LIMIT 5")
def title_words(spark, sf_dir):
    return captures.title_words(adapters.pages(spark, sf_dir))


@query("SELECT user_id AS page_id, count(DISTINCT event_id) AS n_captures, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS actors, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def provenance_union(spark, sf_dir):
    e = storage.table(spark, sf_dir, "events")
    found = precedents.provenance(e.select(F.col("user_id").alias("page_id"), F.col("event_id").alias("capture_id")), e.select(F.col("event_id").alias("capture_id"), F.col("event_type").alias("actor"), F.col("ts").alias("at")))
    return found.withColumn("actors", F.array_join("actors", ","))


@query("WITH n AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) SELECT * FROM n WHERE n > 1")
def rate_limit_log(spark, sf_dir):
    return streams.over_limit(storage.table(spark, sf_dir, "events"), most=1)


@query("""WITH a AS (SELECT doc_id, 1 AS scope FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id, max(quality) AS scope FROM labels GROUP BY 1)
SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'orphan' ELSE 'stale' END AS state FROM a FULL JOIN b USING (doc_id) WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.scope <> b.scope""")
def index_drift(spark, sf_dir):
    d = storage.table(spark, sf_dir, "documents").filter("doc_id % 7 <> 0").select("doc_id", F.lit(1).alias("scope"))
    return storage.drift(d, storage.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("scope")), "doc_id", ["scope"])
