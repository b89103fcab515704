"""Queries of retrieval: full text, chunks, vectors, fusion, expansion and prompt context."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import fusion, ledger, lexical, links, precedents, vectors
from tessera.plans import ledger_queries, vault_queries
from tessera.plans.registry import query
from tessera.sources import model, storage

VAULT = model.cte("vault")
TEXT = "src1 guide"
WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


FIELDS = ("page_id", "title", "summary", "array_to_string(tags, ' ')", "body", "array_to_string(sources, ' ')")
FIELD_WORDS = " UNION ALL ".join(f"SELECT page_id, {k} AS field, unnest({WORDS.format(f)}) AS word, generate_subscripts({WORDS.format(f)}, 1) AS pos FROM vault" for k, f in enumerate(FIELDS))
PART = "greatest(ln(((SELECT n FROM z) - (SELECT d{k} FROM z) + 0.5) / ((SELECT d{k} FROM z) + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * dl / (SELECT avgdl FROM z)))"
FTS = f"""fw AS (SELECT *, lead(word) OVER (PARTITION BY page_id, field ORDER BY pos) AS next FROM ({FIELD_WORDS})),
fs AS (SELECT page_id, count(*) AS dl, count(*) FILTER (word = 'src1' AND next = 'guide') AS f0, count(*) FILTER (starts_with(word, 'src1')) AS f1, count(*) FILTER (starts_with(word, 'guide')) AS f2 FROM fw GROUP BY 1),
fc AS MATERIALIZED (SELECT page_id, lane, coalesce(dl, 0) AS dl, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2 FROM vault LEFT JOIN fs USING (page_id)), z AS (SELECT count(*) AS n, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (f{k} > 0) AS d{k}' for k in range(3))} FROM fc),
fts AS (SELECT page_id, lane, round({' + '.join(PART.format(k=k) for k in range(3))}, 6) AS score FROM fc WHERE f0 + f1 + f2 > 0)"""


def vault(spark, sf_dir):
    return model.frame(spark, sf_dir, "vault")


@query(f"WITH {VAULT}, {FTS} SELECT page_id, score, round(score * 1e6)::BIGINT AS points FROM fts WHERE lane = 'ops' ORDER BY score DESC, page_id LIMIT 20")
def full_text_topk(spark, sf_dir):
    return lexical.full_text(vault(spark, sf_dir), TEXT, lane="ops")


FITS = "(contains(lower(x), 'guide') OR contains(lower(x), 'src1'))"


@query(f"""WITH {VAULT}, t AS (SELECT page_id, list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '') AS w FROM vault), h AS (SELECT page_id, w, list_filter(range(0, len(w)), lambda i: (contains(lower(w[i + 1]), 'guide') OR contains(lower(w[i + 1]), 'src1')))[1] AS k FROM t)
SELECT page_id, CASE WHEN k > 0 THEN '...' ELSE '' END || array_to_string(list_transform(w[k + 1:k + 32], lambda x: CASE WHEN {FITS} THEN '**' || x || '**' ELSE x END), ' ') || CASE WHEN len(w) > k + 32 THEN '...' ELSE '' END AS snippet FROM h WHERE k IS NOT NULL""")
def highlighted_snippets(spark, sf_dir):
    return lexical.highlights(vault(spark, sf_dir), TEXT)


BEST = f"""r AS (SELECT candidate_id, actor, lane, observed_at, created_at, unnest(list_distinct(list_concat(source_page_ids, source_capture_ids))) AS page_id, observed_at IS NOT NULL OR valid_from IS NOT NULL OR valid_until IS NOT NULL OR trim(coalesce(actor, '')) <> '' OR trim(coalesce(lane, '')) <> '' AS own FROM ledger),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY NOT own, CASE WHEN own THEN epoch_us(created_at) ELSE -epoch_us(created_at) END, candidate_id) AS k FROM r) WHERE k = 1)"""


@query(f"""WITH {VAULT}, {model.cte('ledger')}, {BEST} SELECT v.page_id, candidate_id, CASE WHEN candidate_id IS NOT NULL THEN b.actor ELSE v.actor END AS actor, CASE WHEN candidate_id IS NOT NULL THEN b.lane ELSE v.lane END AS lane,
CASE WHEN candidate_id IS NOT NULL THEN b.observed_at::DATE::VARCHAR ELSE v.observed_at END AS observed_at FROM vault v LEFT JOIN b USING (page_id)""")
def search_provenance(spark, sf_dir):
    claims = model.frame(spark, sf_dir, "ledger").withColumn("observed_at", F.to_date("observed_at").cast("string"))
    return precedents.search_provenance(vault(spark, sf_dir).select("page_id", "actor", "lane", "observed_at"), claims)


BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def chunk_sql(pages: str = "vault") -> str:
    """Common table expressions, for WITH RECURSIVE, whose last, `chunk`, has the chunks of a table of pages: sections are read one after the other."""
    return rf"""cs AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(coalesce(body, ''), '\n(#{{1,6}}\s)', chr(1) || chr(10) || '\1', 'g'), chr(1)), lambda x: trim(x, {BLANK})), lambda x: x <> '') AS parts FROM {pages}),
ct AS MATERIALIZED (SELECT page_id, array_to_string(parts, chr(10)) AS text, list_transform(parts, lambda x: length(x)) AS lens FROM cs WHERE len(parts) > 0),
cw AS MATERIALIZED (SELECT page_id, 0::BIGINT AS i, 0::BIGINT AS b, 0::BIGINT AS e, NULL::BIGINT AS cb, NULL::BIGINT AS ce FROM ct
UNION ALL SELECT page_id, i + 1, CASE WHEN over THEN greatest(b, e - 100) ELSE e - length(ltrim(substr(text, b + 1, e - b), {BLANK})) END, (coalesce(list_sum(lens[:i]), 0) + i + lens[i + 1])::BIGINT, CASE WHEN over THEN b END, CASE WHEN over THEN e END FROM (SELECT cw.*, text, lens, e > b AND e - b + lens[i + 1] > 500 AS over FROM cw JOIN ct USING (page_id) WHERE i < len(lens))),
cr AS (SELECT page_id, cb AS b, ce AS e FROM cw WHERE cb IS NOT NULL UNION ALL SELECT page_id, b, e FROM cw JOIN ct USING (page_id) WHERE i = len(lens)),
chunk AS MATERIALIZED (SELECT page_id || '#' || k::VARCHAR AS chunk_id, page_id, k AS chunk_index, content FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY e) - 1 AS k, trim(substr(text, b + 1, e - b), {BLANK}) AS content FROM cr JOIN ct USING (page_id)))"""


CHUNK_WORDS = "regexp_extract_all(lower(content), '[a-z0-9]{2,}')"


@query(f"WITH RECURSIVE {VAULT}, {chunk_sql()} SELECT * FROM chunk")
def page_chunks(spark, sf_dir):
    return vectors.chunks(vault(spark, sf_dir))


@query(f"WITH RECURSIVE {VAULT}, {chunk_sql()}, x AS MATERIALIZED (SELECT chunk_id, {CHUNK_WORDS} AS ts FROM chunk), t AS (SELECT chunk_id, unnest(ts) AS token, len(ts) AS size FROM x) SELECT chunk_id, token, count(*) AS n, round(count(*) / size, 9) AS tf FROM t GROUP BY chunk_id, token, size")
def chunk_term_frequencies(spark, sf_dir):
    return vectors.term_frequencies(vectors.chunks(vault(spark, sf_dir)))


@query(f"WITH RECURSIVE {VAULT}, {chunk_sql()} SELECT count(*) AS n_chunks, count(DISTINCT page_id) AS n_pages, count(*) FILTER (actor IS NOT NULL OR lane IS NOT NULL) AS n_scoped FROM chunk JOIN (SELECT page_id, actor, lane FROM vault) USING (page_id)")
def chunk_index_counts(spark, sf_dir):
    return vectors.index_counts(vectors.index(vault(spark, sf_dir)))


@query(f"WITH {VAULT} SELECT page_id, actor, lane FROM vault")
def chunk_page_scopes(spark, sf_dir):
    return vectors.page_scopes(vectors.index(vault(spark, sf_dir)))


@query(f"""WITH RECURSIVE {VAULT}, {chunk_sql()}, x AS MATERIALIZED (SELECT chunk_id, {CHUNK_WORDS} AS ts FROM chunk), r AS (SELECT chunk_id, len(ts) AS size, unnest(ts) AS token FROM x), tf AS MATERIALIZED (SELECT chunk_id, token, count(*) / size AS tf FROM r GROUP BY chunk_id, token, size),
w AS MATERIALIZED (SELECT token, ln(((SELECT count(*) FROM x) + 1) / (count(*) + 1)) + 1 AS idf FROM tf WHERE token IN ('service', 'uses', 'src1') GROUP BY token),
s AS (SELECT chunk_id, sum(tf * idf * idf / 3.0) AS dot, sqrt(sum(power(tf * coalesce(idf, 1.0), 2))) AS norm FROM tf LEFT JOIN w USING (token) GROUP BY chunk_id)
SELECT chunk_id, round(dot / (norm * (SELECT sqrt(sum(power(idf / 3.0, 2))) FROM w)), 6) AS score FROM s JOIN chunk USING (chunk_id) JOIN (SELECT page_id, actor, lane FROM vault) USING (page_id) WHERE dot > 0 AND actor = 'bob' AND lane = 'ops' ORDER BY score DESC, chunk_id DESC LIMIT 10""")
def chunk_search_scoped(spark, sf_dir):
    return vectors.sparse_cosine(vectors.index(vault(spark, sf_dir)), "service uses src1", key="chunk_id", text="content", lane="ops", actor="bob")


EDITED = "doc_id % 2 = 1 AND doc_id % 3 = 0"


@query(f"""WITH o AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(CASE WHEN {EDITED} THEN lang || ' is from ' || source ELSE text END), '[a-z0-9]+'))) AS token FROM documents) SELECT token, count(*) AS df FROM o GROUP BY 1""")
def doc_freq_incremental(spark, sf_dir):
    """Frequencies after the pages of odd numbers that 3 divides have got another text."""
    from tessera.sources import adapters

    pages = adapters.pages(spark, sf_dir)
    posts = lexical.postings(pages)
    edited = pages.filter("cast(page_id as long) % 2 = 1 and cast(page_id as long) % 3 = 0").withColumn("body", F.concat_ws(" is from ", "kind", "lane"))
    gone = posts.join(edited.select("page_id"), "page_id", "left_semi")
    return vectors.frequency_change(gone, lexical.postings(edited), lexical.document_frequency(posts))


@query(f"""WITH RECURSIVE {VAULT}, edited AS (SELECT page_id, CASE WHEN doc_id % 7 = 0 THEN body || chr(10) || '## Edited' || chr(10) || 'once more' ELSE body END AS body FROM vault WHERE page_id IS NOT NULL AND doc_id % 11 <> 2), {chunk_sql('edited')},
t AS (SELECT unnest(list_distinct({CHUNK_WORDS})) AS token FROM chunk) SELECT token, count(*) AS df FROM t GROUP BY 1""")
def chunks_maintained(spark, sf_dir):
    """Token frequencies of chunks after a seventh of the pages were edited, some are gone and some new."""
    v = vault(spark, sf_dir).select("page_id", "body", "doc_id").filter("page_id is not null")
    old = storage.cut(vectors.hashed_chunks(v.filter("doc_id % 11 <> 1")))
    counts = vectors.chunk_postings(old).groupBy("token").agg(F.count("*").alias("df"))
    now = v.filter("doc_id % 11 <> 2").withColumn("body", F.when(F.col("doc_id") % 7 == 0, F.concat("body", F.lit("\n## Edited\nonce more"))).otherwise(F.col("body")))
    return vectors.upkeep(old, counts, now)[1]


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, round(greatest(0, list_cosine_similarity(e, embedding::DOUBLE[])), 6) AS score FROM q, embeddings)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS place FROM s) WHERE place <= 10""")
def dense_knn_batch(spark, sf_dir):
    v = storage.table(spark, sf_dir, "embeddings")
    return vectors.knn(v, v.filter("vec_id % 20 = 0"))


PROBE = [round((k % 5) / 5 - 0.4, 4) for k in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]), 6) AS score FROM embeddings")
def vector_similarities(spark, sf_dir):
    return vectors.similarities(storage.table(spark, sf_dir, "embeddings"), PROBE)


@query("""WITH r AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rel AS (SELECT DISTINCT lang AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
f AS (SELECT query_id, count(*) AS n_found, count(rel.doc_id) AS n_hits, min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END) AS first FROM (SELECT * FROM r WHERE rank <= 20) r LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1),
w AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), m AS (SELECT query_id, n_hits / n_found AS p, n_hits / n AS c, first FROM w JOIN f USING (query_id)), x AS (SELECT round(p, 6) AS p, round(c, 6) AS c, round(CASE WHEN p + c > 0 THEN 2 * p * c / (p + c) ELSE 0 END, 6) AS f1, round(coalesce(1 / first, 0), 6) AS rr FROM m)
SELECT count(*) AS n_queries, round(avg(p), 6) AS mean_precision, round(avg(c), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(rr), 6) AS mean_reciprocal_rank FROM x""")
def mean_measures(spark, sf_dir):
    from tessera.plans import queries

    return fusion.means(queries.precision_recall_at_k(spark, sf_dir))


HITS = f"{FTS}, hits AS (SELECT page_id, score FROM fts ORDER BY score DESC, page_id LIMIT 20)"


TF = """st AS (SELECT page_id, regexp_extract_all(lower(body), '[a-z0-9]{2,}') AS ts FROM vault), sr AS (SELECT page_id, len(ts) AS n, unnest(ts) AS token FROM st),
sf AS (SELECT page_id, token, count(*) / n AS tf FROM sr GROUP BY page_id, token, n), sw AS (SELECT token, ln(((SELECT count(*) FROM vault) + 1) / (count(*) + 1)) + 1 AS idf FROM sf WHERE token IN ('src1', 'guide') GROUP BY token),
ss AS (SELECT page_id, sum(tf * idf * idf / 2.0) AS dot, sqrt(sum(power(tf * coalesce(idf, 1.0), 2))) AS norm FROM sf LEFT JOIN sw USING (token) GROUP BY page_id),
sparse AS (SELECT page_id, round(dot / (norm * (SELECT sqrt(sum(power(coalesce(idf, 1.0) / 2.0, 2))) FROM (VALUES ('src1'), ('guide')) t(token) LEFT JOIN sw USING (token))), 6) AS score FROM ss WHERE dot > 0 ORDER BY score DESC, page_id DESC LIMIT 30)"""
FUSED = f"""{FTS}, {TF}, lx AS (SELECT page_id, row_number() OVER (ORDER BY score DESC, page_id) AS a FROM (SELECT * FROM fts ORDER BY score DESC, page_id LIMIT 30)), vx AS (SELECT page_id, row_number() OVER (ORDER BY score DESC, page_id) AS b FROM sparse),
fused AS MATERIALIZED (SELECT page_id, a, b, round(coalesce(0.5 / (60 + a), 0) + coalesce(0.3 / (60 + b), 0), 6) AS score FROM lx FULL JOIN vx USING (page_id) ORDER BY score DESC, page_id LIMIT 30)"""


def fused(spark, sf_dir, limit=30):
    """Hits of the text and of the terms' weights, fused."""
    v = vault(spark, sf_dir)
    return storage.cut(lexical.full_text(v, TEXT, limit).select("page_id", "score")), storage.cut(vectors.sparse_cosine(v, TEXT, limit).select("page_id", "score"))


@query(f"""WITH {VAULT}, {vault_queries.WIKI}, {FUSED}, k AS (SELECT source, target FROM links WHERE exists), g AS (SELECT target AS page_id, sum(score * 0.1 * 0.2) AS gain FROM k JOIN fused ON source = page_id GROUP BY 1),
x AS (SELECT page_id, round(coalesce(score, 0) + coalesce(gain, 0), 6) AS score, concat_ws('+', CASE WHEN a IS NOT NULL THEN 'lexical' END, CASE WHEN b IS NOT NULL THEN 'vector' END, CASE WHEN page_id IN (SELECT page_id FROM g) THEN 'links' END) AS sources FROM fused FULL JOIN g USING (page_id))
SELECT x.page_id, x.score, x.sources, title, kind, visibility, substr(body, 1, 200) AS citation FROM x LEFT JOIN vault USING (page_id) ORDER BY x.score DESC, len(string_split(x.sources, '+')) DESC, x.page_id LIMIT 30""")
def hybrid_search(spark, sf_dir):
    v = vault(spark, sf_dir)
    found = fusion.hybrid(*fused(spark, sf_dir), links.page_links(v).filter("exists").select("source", "target"), 30)
    return fusion.cited(found, v.withColumn("snippet", F.lit(None).cast("string")))


def hits(spark, sf_dir):
    return storage.cut(lexical.full_text(vault(spark, sf_dir), TEXT, 20).select("page_id", "score"))


@query(f"""WITH {VAULT}, {vault_queries.WIKI}, {HITS}, g AS (SELECT target AS page_id, sum(score * 0.1 * 0.2) AS gain FROM links JOIN hits ON source = page_id WHERE exists GROUP BY 1) SELECT page_id, round(coalesce(score, 0) + coalesce(gain, 0), 6) AS score FROM hits FULL JOIN g USING (page_id)""")
def link_boosted(spark, sf_dir):
    return fusion.graph_boost(hits(spark, sf_dir), links.page_links(vault(spark, sf_dir)).filter("exists"))


TYPES = ["mentions", "supports", "source_of", "provenance"]
STEP = "score * CASE dir WHEN 'outgoing' THEN 0.85 ELSE 0.65 END"
ENTITY = f"coalesce(cn.type, 'page') IN {links.ENTITY_TYPES}"
EXPANDED = f"""{vault_queries.CONTEXT}, {FUSED}, hits AS (SELECT page_id, score FROM fused), adj AS (SELECT source AS node, target AS nbr, type, 'outgoing' AS dir FROM ce WHERE type IN ({', '.join(repr(t) for t in TYPES)}) UNION ALL SELECT target, source, type, 'incoming' FROM ce WHERE type IN ({', '.join(repr(t) for t in TYPES)})),
c1 AS (SELECT h.page_id AS hit, nbr AS node, {STEP} AS score, adj.type || ' -> ' || coalesce(cn.type, 'page') AS path, CASE WHEN {ENTITY} THEN [nbr] ELSE [] END AS entities, cn.type AS t, 1 AS hops FROM hits h JOIN adj ON adj.node = h.page_id LEFT JOIN cn ON cn.id = nbr),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, hit, path, entities) AS k FROM c1 WHERE node NOT IN (SELECT page_id FROM hits)) WHERE k = 1),
c2 AS (SELECT f1.hit, nbr AS node, {STEP.replace('score', 'f1.score', 1)} AS score, f1.path || ' -> ' || adj.type || ' -> ' || coalesce(cn.type, 'page') AS path, CASE WHEN {ENTITY} AND NOT list_contains(f1.entities, nbr) THEN list_append(f1.entities, nbr) ELSE f1.entities END AS entities, cn.type AS t, 2 AS hops FROM f1 JOIN adj ON adj.node = f1.node LEFT JOIN cn ON cn.id = nbr),
c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2), bp AS (SELECT node, string_agg(p, ' | ' ORDER BY k) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY hops, score DESC, p) AS k FROM (SELECT DISTINCT node, hops, score, hit || ': ' || path AS p FROM c)) WHERE k <= 3 GROUP BY 1), e AS (SELECT node, list_sort(list_distinct(flatten(list(entities)))) AS entities FROM c GROUP BY 1), g AS (SELECT node, max(score) AS best, count(*) AS n_paths, arg_min(path, (hops, -score, hit, path)) AS path, max(t) AS t FROM c GROUP BY 1),
x AS (SELECT coalesce(h.page_id, g.node) AS page_id, h.score AS base, best, n_paths, path, paths, entities, t FROM g JOIN e USING (node) JOIN bp USING (node) FULL JOIN hits h ON h.page_id = g.node)
SELECT page_id, round(coalesce(base, best) + coalesce(best, 0) * 0.2, 6) AS score, coalesce(n_paths, 0) AS n_paths, path, paths, coalesce(array_to_string(entities, ','), '') AS entities, concat_ws('; ', CASE WHEN base IS NOT NULL THEN 'direct text match' END, 'reachable via: ' || path) AS because
FROM x WHERE base IS NOT NULL OR t = 'page' ORDER BY round(coalesce(base, best) + coalesce(best, 0) * 0.2, 6) DESC, page_id LIMIT 15"""


def expanded(spark, sf_dir):
    tables = vault_queries.context_tables(spark, sf_dir)
    seeds = fusion.reciprocal_rank_fusion(*fused(spark, sf_dir), 30)  # twice the results
    return fusion.expand(storage.cut(seeds.select("page_id", "score")), links.context_edges(*tables), links.context_types(*tables), 2, TYPES, 15)


@query(EXPANDED)
def expanded_retrieval(spark, sf_dir):
    return expanded(spark, sf_dir)


@query(f"""WITH {model.cte('vault', 'ledger', 'traces')}, {HITS}, n AS (SELECT DISTINCT unnest(source_page_ids) AS page_id, CASE WHEN candidate_type = 'claim' THEN 'supports' ELSE 'contradicts' END AS relation, candidate_id AS ref_id FROM ledger WHERE status IN ('candidate', 'active') AND candidate_type IN ('claim', 'invalidation')
UNION ALL SELECT page_id, 'trace', trace_id FROM traces) SELECT DISTINCT page_id, relation, ref_id FROM n WHERE page_id IN (SELECT page_id FROM hits) UNION ALL SELECT page_id, 'decision', page_id FROM hits WHERE starts_with(page_id, 'decisions/')""")
def result_enrichment(spark, sf_dir):
    return fusion.enrichment(hits(spark, sf_dir), model.frame(spark, sf_dir, "ledger"), model.frame(spark, sf_dir, "traces"))


@query(f"WITH {VAULT}, {HITS} SELECT page_id, hits.score, title, kind FROM hits LEFT JOIN vault USING (page_id)")
def described_results(spark, sf_dir):
    return fusion.described(hits(spark, sf_dir), vault(spark, sf_dir))


def _compact(x: str, n: int) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE rtrim(substr({flat}, 1, {n - 3})) || '...' END"


RECALLED = ledger_queries.recall_sql("services log", 15)
CONTEXT = f"""WITH {model.cte('vault', 'ledger')}, {FTS}, h AS (SELECT page_id, score, row_number() OVER (ORDER BY score DESC, page_id) AS place FROM fts ORDER BY score DESC, page_id LIMIT 10), a AS (SELECT r.*, row_number() OVER () AS place FROM ({RECALLED}) r),
l AS (SELECT * FROM (VALUES (0, '## Memory Context', NULL), (1, 'Query: src1 guide', NULL), (2, '', NULL), (3, '### Claims', NULL), (1000000, '', NULL), (1000001, '### Pages', NULL)) t(n, line, ref)
UNION ALL SELECT a.place + 3, '- [claim:' || candidate_id || '] ' || {_compact("concat_ws(' ', subject, predicate, object)", 260)} || ' (score ' || printf('%.3f', a.score) || ')', 'claim:' || candidate_id FROM a JOIN ledger USING (candidate_id)
UNION ALL SELECT h.place + 1000001, '- [page:' || page_id || '] ' || {_compact('coalesce(title, page_id)', 260)} || ' (score ' || printf('%.3f', h.score) || ')', 'page:' || page_id FROM h JOIN vault USING (page_id)),
s AS (SELECT *, sum(length(line) + 1) OVER w AS upto, sum(len(regexp_extract_all(line, '\\S+'))) OVER w AS tokens FROM l WINDOW w AS (ORDER BY n)), t AS (SELECT *, max(CASE WHEN trim(line) <> '' THEN upto END) OVER (ORDER BY n) AS chars FROM s),
k AS (SELECT string_agg(line, chr(10) ORDER BY n) FILTER (chars <= 900 AND tokens <= 400) AS body, string_agg(ref, ',' ORDER BY n) FILTER (chars <= 900 AND tokens <= 400) AS refs, bool_or(chars > 900 OR tokens > 400) AS truncated FROM t),
f AS (SELECT *, regexp_replace(body, '\\s+$', '') || chr(10) AS short, body || chr(10) || chr(10) || '{fusion.FOOTER}' || chr(10) AS long FROM k), o AS (SELECT CASE WHEN truncated AND length(long) <= 900 AND len(regexp_extract_all(long, '\\S+')) <= 400 THEN long ELSE short END AS context, truncated, refs FROM f)
SELECT context, len(regexp_extract_all(context, '\\S+'))::INTEGER AS n_tokens, length(context)::INTEGER AS n_chars, truncated, refs FROM o"""


@query(CONTEXT)
def memory_context(spark, sf_dir):
    claims = model.frame(spark, sf_dir, "ledger")
    top = ledger.recall(claims, ledger_queries.now(), "services log", limit=15).select("candidate_id", "score", F.monotonically_increasing_id().alias("_k"))
    top = top.withColumn("place", F.row_number().over(Window.orderBy("_k"))).join(ledger.label(claims), "candidate_id")
    found = lexical.full_text(vault(spark, sf_dir), TEXT, 10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "page_id")))
    return fusion.bounded_context(fusion.context_lines(TEXT, top, fusion.described(found, vault(spark, sf_dir))), 400, 900)


POLICIES = [("protect:v1", "Protected pages", "guards decisions and runbooks"), ("review:v1", "Review of users", "errors are checked"), ("risk:v1", "Risk", "sorts by risk")]
POLICY_SQL = "pol(policy_id, name, description) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in POLICIES) + ")"
HAY = "lower(trim(regexp_replace(concat_ws(' ', {0}), '\\s+', ' ', 'g')))"
TRACE_HAY = HAY.format("trace_id, actor, reason_summary, outcome, array_to_string(policy_refs, ' '), task_id, page_id, candidate_id")
PAGE_HAY = HAY.format("page_id, title, summary, body")
PRECEDENTS = f"""{vault_queries.CONTEXT}, {POLICY_SQL}, u AS (
SELECT 'trace' AS type, 'trace:' || trace_id AS id, round(0.2 + CASE WHEN contains({TRACE_HAY}, 'src1') THEN 0.2 ELSE 0 END + 0.35 + 0.3, 6)::DOUBLE AS relevance, 0 AS b FROM traces WHERE contains({TRACE_HAY}, 'error') AND list_contains(policy_refs, 'review:v1')
UNION ALL SELECT 'policy', 'policy:' || policy_id, 0.6::DOUBLE, 1 FROM pol WHERE policy_id = 'review:v1' AND contains({HAY.format('policy_id, name, description')}, 'error')
UNION ALL SELECT CASE WHEN coalesce(kind, 'page') IN ('decision', 'capture') THEN kind ELSE 'page' END, page_id, round(0.1 + CASE kind WHEN 'decision' THEN 0.35 WHEN 'capture' THEN 0.1 ELSE 0 END + 0.15 + 0.25 + 0.2, 6)::DOUBLE, 2 FROM vault WHERE lane = 'ops' AND contains({PAGE_HAY}, 'notes') AND contains({PAGE_HAY}, 'src1')
UNION ALL SELECT node_type, id, 0.15::DOUBLE, 3 FROM (SELECT DISTINCT id, node_type FROM (SELECT x.id, cn.type AS node_type, x.type, x.direction FROM (SELECT CASE WHEN source = 'task:T3' THEN target ELSE source END AS id, type, CASE WHEN source = 'task:T3' THEN 'outgoing' ELSE 'incoming' END AS direction FROM ce WHERE source = 'task:T3' OR target = 'task:T3') x JOIN cn ON cn.id = x.id ORDER BY x.id, x.type, x.direction LIMIT 50)) WHERE node_type IN ('trace', 'decision', 'page', 'policy', 'capture')),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY b) AS k FROM u) WHERE k = 1) SELECT type, id, relevance, (SELECT count(*) FROM d) AS total FROM d ORDER BY relevance DESC, type, id LIMIT 40"""


@query(PRECEDENTS)
def precedent_search(spark, sf_dir):
    """Traces and policies about errors under a policy, pages of a lane about a source, and what lies around a task."""
    nodes, edges = vault_queries.context(spark, sf_dir)
    policies = spark.createDataFrame(POLICIES, "policy_id string, name string, description string")
    branches = [
        precedents.trace_precedents(model.frame(spark, sf_dir, "traces"), "Error", policy="review:v1", entity="src1"), precedents.policy_precedents(policies, "error", "review:v1"),
        precedents.page_precedents(vault(spark, sf_dir), "NOTES", "ops", entity="src1"), precedents.graph_precedents(edges, nodes, "task:T3"),
    ]
    return precedents.search(branches, 40)


NAMES = "SELECT id, unnest([id, type || ':' || id, regexp_replace(id, '^[a-z]+:', '')]) AS node FROM found"


@query(f"""{PRECEDENTS[: PRECEDENTS.rindex(' SELECT type, id, relevance')]}, found AS (SELECT type, id, relevance FROM d ORDER BY relevance DESC, type, id LIMIT 40), nm AS (SELECT DISTINCT * FROM ({NAMES})),
mv AS (SELECT DISTINCT source AS node, target AS other, type FROM ce),
b1 AS (SELECT other AS node, min([node || ' -' || type || '-> ' || other]) AS way FROM mv WHERE node = 'task:T3' AND other <> 'task:T3' GROUP BY 1),
b2 AS (SELECT mv.other AS node, min(list_append(way, mv.node || ' -' || mv.type || '-> ' || mv.other)) AS way FROM b1 JOIN mv ON mv.node = b1.node WHERE mv.other <> 'task:T3' AND mv.other NOT IN (SELECT node FROM b1) GROUP BY 1),
b3 AS (SELECT mv.other AS node, min(list_append(way, mv.node || ' -' || mv.type || '-> ' || mv.other)) AS way FROM b2 JOIN mv ON mv.node = b2.node WHERE mv.other <> 'task:T3' AND mv.other NOT IN (SELECT node FROM b1) AND mv.other NOT IN (SELECT node FROM b2) GROUP BY 1),
wy AS (SELECT id, arg_min(array_to_string(way, '; '), (len(way), array_to_string(way, '; '))) AS path FROM nm JOIN (SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) USING (node) GROUP BY 1)
SELECT type, id, relevance, path FROM found LEFT JOIN wy USING (id)""")
def precedent_paths(spark, sf_dir):
    nodes, edges = vault_queries.context(spark, sf_dir)
    return precedents.with_paths(precedent_search(spark, sf_dir).select("type", "id", "relevance"), edges, "task:T3")


@query()
def chunk_vectors_fused(spark, sf_dir):
    """For every 20th page, the pages whose chunks are most like its own first chunk, by vectors and by fusion with the text."""
    chunked = vectors.embedded(vectors.chunks(vault(spark, sf_dir).filter("page_id is not null")), vectors.hashed_counts, kind="float")
    rows = storage.cut(chunked.withColumn("vec_id", F.xxhash64("chunk_id")).select("vec_id", "page_id", "chunk_index", "embedding"))
    asked = rows.filter("chunk_index = 0").join(vault(spark, sf_dir).filter("doc_id % 20 = 0").select("page_id"), "page_id", "left_semi")
    near = vectors.knn(rows, asked, 10).join(rows.select("vec_id", "page_id"), "vec_id")
    names = asked.select(F.col("vec_id").alias("query_id"), F.col("page_id").alias("asked"))
    best = near.join(names, "query_id").filter("page_id <> asked").groupBy("asked", "page_id").agg(F.max("score").alias("score"))
    lexical_ = storage.cut(lexical.full_text(vault(spark, sf_dir), TEXT, 30).select("page_id"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "page_id")))
    both = ranked.join(F.broadcast(lexical_.withColumn("named", F.lit(True))), "page_id", "left")
    return both.select("asked", "page_id", "rank", F.round(0.3 / (60 + F.col("rank")) + F.when(F.col("named"), 0.5 / 60).otherwise(0.0), 6).alias("score"))
