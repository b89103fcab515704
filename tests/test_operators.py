"""Operators on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring
from tessera.functions import text
from tessera.operators import captures, fusion, graph, ledger, pages, policy, quality_rules, vectors
from tessera.sources import audit, markdown, storage
from tessera.streaming import claims as streams


def edges(spark, pairs):
    return spark.createDataFrame([(*p, "link") for p in pairs], "source string, target string, type string")


def test_degree_centrality_of_a_path(spark):
    got = {r[0]: r[1] for r in graph.degree_centrality(edges(spark, [("a", "b"), ("b", "c")])).select("node", "centrality").collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": 0.5}


def test_two_triangles_are_two_communities(spark):
    links = edges(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z")])
    assert graph.communities(links).select("community").distinct().count() == 2


def test_betweenness_of_a_path(spark):
    got = {r[0]: r[1] for r in graph.betweenness(edges(spark, [("a", "b"), ("b", "c")])).collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 0.0}


def test_reach_stops_at_the_hops(spark):
    got = graph.reach(edges(spark, [("a", "b"), ("b", "c"), ("c", "d")]), "a", 2)
    assert {r["node"] for r in got.collect()} >= {"b", "c"} and "d" not in {r["node"] for r in got.collect()}


def test_recency_halves_in_thirty_days(spark):
    assert spark.range(1).select(scoring.recency(F.lit(30.0))).first()[0] == pytest.approx(0.5)


def test_upsert_and_remove(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    merged = storage.upsert(old, new, "k")
    assert sorted(map(tuple, merged.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(r.k for r in storage.remove(merged, new.select("k"), "k").collect()) == [1]


def test_audit_log_round_trip(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = [("e1", "p1", "ann", dt.datetime(2024, 1, 1)), ("e2", "p2", "bob", dt.datetime(2024, 1, 2))]
    audit.append(spark.createDataFrame(rows, "event_id string, page_id string, actor string, ts timestamp"), folder)
    assert audit.scan(spark, folder).count() == 2


def test_markdown_pages(spark, tmp_path):
    (tmp_path / "one.md").write_text("---\ntitle: One\ntags: [a, b]\n---\nBody with [[two]].\n")
    (tmp_path / "two.md").write_text("no header\n")
    assert markdown.pages(markdown.scan(spark, str(tmp_path))).count() == 2


def test_fusion_prefers_what_both_lists_hold(spark):
    lexical = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "page_id string, score double")
    vector = spark.createDataFrame([("b", 0.9), ("c", 0.8)], "page_id string, score double")
    assert fusion.reciprocal_rank_fusion(lexical, vector).first()["page_id"] == "b"


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(source)
    streams.run_once(streams.reinforcement(streams.read_events(spark, source)), str(tmp_path / "out"), str(tmp_path / "check"), "complete")
    stream = spark.read.parquet(str(tmp_path / "out"))
    batch = streams.reinforcement(spark.read.parquet(source).withColumn("at", F.col("ts").cast("timestamp")))
    assert stream.count() == batch.count() > 0
    assert stream.select(sorted(stream.columns)).exceptAll(batch.select(sorted(stream.columns))).isEmpty()


SIGHTING = "sighting long, subject string, predicate string, object string, actor string, confidence string, epistemic_status string, observed_at timestamp, valid_from timestamp, valid_until timestamp"
CLAIM = "candidate_id string, subject string, predicate string, object string, strength double, status string, updated_at timestamp"
DAY = dt.datetime(2024, 1, 1)


def claims_table(spark, rows):
    """Live claims with nulls where nothing is given."""
    df = spark.createDataFrame(rows, CLAIM)
    empty = {"candidate_type": "'claim'", "actor": "null", "lane": "null", "evidence": "null", "confidence": "'low'", "epistemic_status": "null", "valid_from": "cast(null as timestamp)", "valid_until": "cast(null as timestamp)", "observed_at": "cast(null as timestamp)", "created_at": "updated_at", "access_count": "0L"}
    return df.selectExpr("*", *(f"{e} as {c}" for c, e in empty.items()))


def test_reinforcement_is_capped_and_by_actor(spark):
    rows = [(i, "S ", "p", "o", None if i % 3 else "ann", "high" if i == 5 else "low", "operator_declared" if i == 7 else None, DAY + dt.timedelta(days=i), None, None) for i in range(30)]
    got = {r["actor"]: r for r in ledger.reinforce(spark.createDataFrame(rows, SIGHTING)).collect()}
    assert (got[None]["strength"], got[None]["seen"], got[None]["confidence"], got[None]["decay_floor"]) == (1.0, 20, "high", 0.2)
    assert (got["ann"]["strength"], got["ann"]["seen"], got["ann"]["decay_floor"], got["ann"]["subject"]) == (0.95, 10, None, "s")


def test_recall_finds_a_weaker_claim_behind_many(spark):
    """A query widens the pool: a claim at 0.57 behind 700 at 0.58 is found."""
    rows = [(f"c{i}", f"s{i}", "is", "common", 0.58, "active", DAY) for i in range(700)] + [("needle", "haystack", "holds", "needle", 0.57, "active", DAY)]
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    claims = claims_table(spark, rows)
    assert [r["candidate_id"] for r in ledger.recall(claims, now, "needle").collect()] == ["needle"]
    assert ledger.recall(claims, now, "needle", pool=100).count() == 0 and ledger.recall(claims, now).count() == 20
    near = ledger.recall(claims, now, "nothing", semantic=F.when(F.col("candidate_id") == "c0", 0.9).otherwise(0.0))
    assert [r["candidate_id"] for r in near.collect()] == ["c0"]
    assert ledger.recall_hint(0, 2, 0) and ledger.recall_hint(1, 0, 0) is None


def test_decay_keeps_pinned_claims_at_their_floor(spark):
    rows = claims_table(spark, [("a", "s", "p", "o", 0.5, "active", DAY), ("b", "s", "p", "o", 0.21, "active", DAY), ("c", "s", "p", "o", 0.5, "archived", DAY)])
    rows = rows.selectExpr("* except (confidence, epistemic_status)", "'high' as confidence", "if(candidate_id = 'b', 'operator_declared', 'observed') as epistemic_status", "cast(null as double) as decay_floor", "cast(null as timestamp) as last_decayed_at")
    got = {r["candidate_id"]: r["strength"] for r in ledger.decay(rows, F.lit("2024-04-10 12:00:00").cast("timestamp")).collect()}
    assert got == {"a": pytest.approx(0.5 * 0.995**100, abs=1e-6), "b": 0.2}


def test_chunks_are_packed_with_overlap(spark):
    body = "intro\n# A\n" + "a" * 300 + "\n## B\n" + "b" * 300 + "\n# C\nend"
    got = [(r["chunk_id"], r["content"]) for r in vectors.chunks(spark.createDataFrame([("p", body), ("q", " "), ("r", None)], "page_id string, body string")).orderBy("chunk_index").collect()]
    first = "intro\n# A\n" + "a" * 300
    assert got == [("p#0", first), ("p#1", first[-100:] + "\n## B\n" + "b" * 300 + "\n# C\nend")]


def test_sparse_cosine_against_plain_python(spark):
    import math
    import re
    from collections import Counter

    texts = {f"d{k}": " ".join(["uses", "service", "src1", "x", "zz", "service"][(k * j) % 6] for j in range(1, 9 + k)) for k in range(30)}
    rows = [(i, t, "ops" if int(i[1:]) % 2 else None, "bob" if int(i[1:]) % 3 else "") for i, t in texts.items()]
    got = {r["k"]: r["score"] for r in vectors.sparse_cosine(spark.createDataFrame(rows, "k string, t string, lane string, actor string"), "Service uses service nope", 100, "k", "t", "ops", "bob").collect()}
    tf = {i: {w: n / len(ws) for w, n in Counter(ws).items()} for i, t in texts.items() if (ws := re.findall("[a-z0-9]{2,}", t.lower()))}
    q = {"service": 0.5, "uses": 0.25, "nope": 0.25}
    df = Counter(w for v in tf.values() for w in v)
    idf = {w: math.log((len(texts) + 1) / (df[w] + 1)) + 1 if df[w] else 1.0 for w in q}
    norm = lambda v: math.sqrt(sum((x * idf.get(w, 1.0)) ** 2 for w, x in v.items()))
    for i, _, lane, actor in rows:
        score = sum(q[w] * tf[i][w] * idf[w] ** 2 for w in q if w in tf[i]) / (norm(q) * norm(tf[i]))
        assert got.get(i, 0.0) == (pytest.approx(score, abs=2e-6) if (lane, actor) == ("ops", "bob") else 0.0)


def test_close_ids_are_those_of_the_library(spark, monkeypatch):
    import difflib

    ids = [f"{a}/{b}{k}" for a in ("services", "projects", "concepts") for b in ("api", "worker", "gateway") for k in range(4)]
    wanted = ["service/api", "projects/gatewy2", "zzz", "concept/workers1"]
    got = quality_rules.close_ids(spark.createDataFrame([(t,) for t in wanted], "target string"), spark.createDataFrame([(i,) for i in ids], "page_id string"))
    rows = sorted(got.collect(), key=lambda r: (r["target"], r["place"]))
    for t in wanted:
        assert [r["page_id"] for r in rows if r["target"] == t] == difflib.get_close_matches(t, ids, n=2, cutoff=0.4)


def test_betweenness_against_plain_python(spark):
    import itertools

    links = [(f"n{a}", f"n{b}") for a, b in ((0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5), (5, 6), (6, 4), (2, 7))]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def shortest(a, b):
        walks = [[a]]
        while walks and not any(w[-1] == b for w in walks):
            walks = [[*w, x] for w in walks for x in sorted(near[w[-1]]) if x not in w]
        return [w for w in walks if w[-1] == b]

    wanted = dict.fromkeys(near, 0.0)
    for a, b in itertools.combinations(sorted(near), 2):
        ways = shortest(a, b)
        for w in ways:
            for x in w[1:-1]:
                wanted[x] += 1 / len(ways)
    n = len(near)
    got = {r[0]: r[1] for r in graph.betweenness(edges(spark, links)).collect()}
    assert got == {k: pytest.approx(v * 2 / ((n - 1) * (n - 2)), abs=1e-6) for k, v in wanted.items()}
    both = graph.analytics(edges(spark, links)).collect()
    assert {r["node"] for r in both} == set(near) and len(graph.entry_points(edges(spark, links), 3).collect()) == 3


def test_paths_follow_the_edges(spark):
    links = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d")])
    assert {r["path"] for r in graph.paths(links, "a", "d", 3).collect()} == {"a>c>d", "a>b>c>d"} and graph.paths(links, "d", "a", 4).count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    link = lambda p, page: one(text.resolve_link(F.lit(p), F.lit(page)))
    assert [link(p, "a/b/c") for p in ("d.md", "./d", "../d", "/x/y/", "../../../d", "", "../..", "d//e")] == ["a/b/d", "a/b/d", "a/d", "x/y", None, None, None, "a/b/d/e"]
    body = "see [[One|a/one]] and [[b/two]]\n```\n[[kept]]\n```\n[[three]]"
    assert one(text.rewrite_wikilinks(F.lit(body))) == "see [One](/a/one) and [two](/b/two)\n```\n[[kept]]\n```\n[three](/three)"
    assert str(one(text.path_date(F.lit("inbox/2024-01-05/x"), F.lit("2023-01-01")))) == "2024-01-05" and str(one(text.path_date(F.lit("inbox/x"), F.lit("2023-01-02T10:00:00")))) == "2023-01-02" and one(text.path_date(F.lit("x"), F.lit("soon"))) is None
    assert one(text.link_targets(F.lit("[[Label|a/b]] [[a/c|Label]] [[Plain]] [[x]]"))) == ["a/b", "a/c", "Plain", "x"]
    assert one(text.is_url(F.lit("https://x"))) and not one(text.is_url(F.lit("src/x")))
    assert str(one(text.iso_time(F.lit(" 2024-01-05T10:00:00Z ")))) == "2024-01-05 10:00:00" and one(text.iso_time(F.lit("soon"))) is None
    assert one(text.compact_map(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("")))) == {"a": "x"}
    assert one(text.title_of(F.lit("\n  The first, line of ten words or more than that: yes\nnext"))) == "The first, line of ten words or more"
    assert one(text.payload_hash(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2")))) == one(text.payload_hash(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1"))))


def test_insert_into_section(spark):
    put = lambda content, block="New fact": spark.range(1).select(policy.insert_into_section(F.lit(content), F.lit("## Facts"), F.lit(block)).alias("x")).first()["x"]
    assert put("# T\n\n## Facts\n\nOld\n\n## End\nx\n") == "# T\n\n## Facts\n\nNew fact\n\nOld\n\n## End\nx\n"
    assert put("# T\n") == "# T\n\n## Facts\n\nNew fact\n" and put("## Facts\n\nnew  FACT\n") == "## Facts\n\nnew  FACT\n"


def test_repeated_captures_and_steps(spark):
    rows = [(k, f"Fix {k}", f"restart worker queue after timeout error {'alpha' if k < 3 else 'beta gamma delta epsilon zeta'}") for k in range(5)] + [(9, "Other", "entirely different matter here")]
    docs = spark.createDataFrame(rows, "capture_id long, title string, observation string")
    groups = captures.repeat_groups(docs).collect()
    assert [r["n"] for r in groups] == [5] and groups[0]["key"] == "error-queue-restart-timeout-worker"
    steps = captures.steps(spark.createDataFrame([(1, "x\n- Check logs.\n2. restart it"), (2, "# h\nplain line\nmore")], "capture_id long, observation string")).orderBy("capture_id", "place")
    assert [r["step"] for r in steps.collect()] == ["Check logs", "Review and apply: restart it", "Review and apply: plain line"]


def test_audit_is_compacted_without_loss_or_doubling(spark, tmp_path):
    log, old = str(tmp_path / "log"), str(tmp_path / "old")
    rows = [(f"e{k}", f"p{k % 2}", "ann" if k % 3 else "bob", DAY + dt.timedelta(days=k // 2)) for k in range(8)]
    audit.append(spark.createDataFrame(rows, "action string, page_id string, actor string, ts timestamp"), log)
    assert audit.compact(spark, log, old, "2024-01-03") == 2
    whole = audit.read_all(spark, log, old)
    assert sorted(r["action"] for r in whole.collect()) == [r[0] for r in rows] and audit.scan(spark, log).count() == 4
    assert [r["action"] for r in audit.history(whole, page_id="p0", since="2024-01-02").collect()] == ["e6", "e4", "e2"]
    streams.run_once(audit.follow(spark, log), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_audit_keeps_late_events_and_survives_a_crash(spark, tmp_path, monkeypatch):
    log, old = str(tmp_path / "log"), str(tmp_path / "old")
    add = lambda name, day: audit.append(spark.createDataFrame([(name, "p", "ann", DAY + dt.timedelta(days=day))], "action string, page_id string, actor string, ts timestamp"), log)
    names = lambda: sorted(r["action"] for r in audit.read_all(spark, log, old).collect())
    add("e1", 0), add("e2", 0), add("e3", 5)
    assert names() == ["e1", "e2", "e3"]
    assert audit.compact(spark, log, old, "2024-01-03") == 1 and names() == ["e1", "e2", "e3"]
    add("late", 0)
    assert names() == ["e1", "e2", "e3", "late"]
    real = audit._files

    class Crash:
        """A file system that dies when files are to be deleted."""

        def __init__(self, files):
            self.files = files

        def delete(self, *_):
            raise RuntimeError("crash")

        def __getattr__(self, name):
            return getattr(self.files, name)

    monkeypatch.setattr(audit, "_files", lambda *a: Crash(real(*a)))
    with pytest.raises(Exception, match="crash"):
        audit.compact(spark, log, old, "2024-01-03")
    monkeypatch.setattr(audit, "_files", real)
    assert names() == ["e1", "e2", "e3", "late"]  # in both folders, counted once
    assert audit.compact(spark, log, old, "2024-01-03") == 0 and names() == ["e1", "e2", "e3", "late"]
    assert [r["action"] for r in audit.scan(spark, log).collect()] == ["e3"]


def test_streams_of_buckets_windows_and_sessions(spark, tmp_path):
    """Each stream gives what its batch form gives on all but what its watermark still holds open."""
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").coalesce(1).write.parquet(source)
    batch = spark.read.parquet(source).withColumn("at", F.col("ts").cast("timestamp"))
    for k, f in enumerate((streams.daily_buckets, lambda e: streams.rate_windows(e, most=0), streams.sessions)):
        streams.run_once(f(streams.read_events(spark, source)), str(tmp_path / f"out{k}"), str(tmp_path / f"check{k}"))
        got, wanted = spark.read.parquet(str(tmp_path / f"out{k}")), f(batch)
        names = sorted(got.columns)
        assert got.count() > 0.8 * wanted.count() and got.select(names).exceptAll(wanted.select(names)).isEmpty()


def test_pages_and_captures(spark):
    rows = [("inbox/2024-01-05/a", "capture", "draft", None, None), ("inbox/b", "capture", "draft", "heartbeat-self-audit", None), ("notes/c", "capture", "draft", None, "ops"), ("notes/d", "capture", "accepted", None, None), ("x", "page", "draft", None, None)]
    table = spark.createDataFrame(rows, "page_id string, kind string, status string, source_task string, lane string")
    log = spark.createDataFrame([("notes/d", True)], "capture_id string, success boolean")
    assert [r["page_id"] for r in pages.unprocessed(table, log).collect()] == ["inbox/2024-01-05/a"]
    assert [r["page_id"] for r in pages.capture_list(table, "all", "notes").collect()] == ["notes/d", "notes/c"]
