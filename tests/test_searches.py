"""Fuzzy ids, the kNN grid, link suggestions and paths against plain forms."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, quality_rules, vectors


def test_like_ids_equal_the_nested_loop(spark):
    dice = random.Random(4)
    parts = ["services", "projects", "notes", "api", "gateway", "worker", "queue", "x1", "é", "2024", "-", "/"]
    ids = sorted({"".join(dice.choice(parts) for _ in range(dice.randrange(1, 5))) for _ in range(700)})
    targets = [i[: dice.randrange(1, len(i) + 1)] + dice.choice(["", "s", "zz", "1"]) for i in dice.sample(ids, 60)] + ["qqqq", ids[0]]
    a, b = spark.createDataFrame([(t,) for t in [*targets, ""]], "target string"), spark.createDataFrame([(i,) for i in ids], "page_id string")
    for least in (0.8, 0.4):
        got = {(r["target"], r["page_id"]): r["ratio"] for r in quality_rules.like_ids(a, b, least).collect()}
        wanted = {}
        for t in set(targets):
            match = difflib.SequenceMatcher()
            match.set_seq2(t)
            for i in ids:
                match.set_seq1(i)
                if match.ratio() >= least:
                    wanted[t, i] = match.ratio()
        assert got == wanted and len(wanted) > 50
    rows = quality_rules.close_ids(a, b).collect()
    for t in set(targets):
        assert [r["page_id"] for r in sorted(rows, key=lambda r: r["place"]) if r["target"] == t] == difflib.get_close_matches(t, ids, n=2, cutoff=0.4)


def test_findings_carry_suggestions(spark):
    pages = spark.createDataFrame([("services/api", "Alpha gateway guide", ["x"]), ("services/web", "Alpha gateway notes", ["x"]), ("notes/lost", "Alpha gateway lost", ["x"])], "page_id string, title string, tags array<string>")
    links = spark.createDataFrame([("services/web", "services/api", True), ("services/api", "services/web", True), ("services/api", "servces/web", False)], "source string, target string, exists boolean")
    rows = {(r["rule"], r["page_id"]): r["suggestions"] for r in quality_rules.with_suggestions(quality_rules.link_findings(pages, links), pages, links).collect()}
    assert rows == {("broken_internal_link", "services/api"): ["services/web", "services/api"], ("orphan_page", "notes/lost"): ["services/api", "services/web"]}


def test_link_suggestions_against_plain(spark):
    dice = random.Random(5)
    words, tags = ["alpha", "gamma", "delta", "guide", "notes", "a", "of"], ["t1", "t2", "t3", "t4"]
    pages = [(f"p{k:03}", " ".join(dice.choice(words) for _ in range(dice.randrange(6))), dice.sample(tags, dice.randrange(4))) for k in range(120)]
    orphan = [p[0] for p in pages if dice.random() < 0.3]
    table = spark.createDataFrame(pages, "page_id string, title string, tags array<string>")
    got = {}
    for r in quality_rules.link_suggestions(spark.createDataFrame([(o,) for o in orphan], "page_id string"), table).collect():
        got.setdefault(r["orphan_id"], set()).add((r["page_id"], r["score"]))
    own = {p: ({w for w in t.split() if len(w) >= 4}, set(g)) for p, t, g in pages}
    for o in orphan:
        scores = []
        for p in own:
            shared_tags, shared = len(own[o][1] & own[p][1]), len(own[o][0] & own[p][0])
            score = (10 + shared_tags if shared_tags else 0) + (shared if shared >= 2 else 0)
            if p != o and score:
                scores.append((-score, p))
        assert got.get(o, set()) == {(p, -s) for s, p in sorted(scores)[:3]}, o


@pytest.mark.parametrize("cell", [(7, 11), (1000, 1000)])
def test_knn_grid_against_brute_force(spark, cell):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(120, 8)), 3)
    x[5] = 0
    x[7] = x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["place"]): (r["vec_id"], r["score"]) for r in vectors.knn(table, table.filter("vec_id % 4 = 0"), 5, cell).collect()}
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1)
    for i in range(0, 120, 4):
        score = np.round(np.maximum(unit @ unit[i], 0), 6)
        order = np.lexsort((np.arange(120), -score))[:5]
        assert [got[i, p + 1] for p in range(5)] == [(int(o), pytest.approx(score[o], abs=2e-6)) for o in order]
    assert vectors.knn(table, table.filter("false")).count() == 0


def test_hashed_embeddings_find_like_texts(spark):
    texts = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma epsilon"), (3, "one two three four"), (4, None), (5, "")], "vec_id long, content string")
    rows = vectors.embedded(texts)
    best = {r["query_id"]: r["vec_id"] for r in vectors.knn(rows, rows.filter("vec_id <> 1"), 2).filter("vec_id <> query_id").filter("score > 0").orderBy("score").collect()}
    assert best == {2: 1}
    size = vectors.embedded(texts, lambda s: s.map(lambda t: [float(len(t))])).select("vec_id", F.col("embedding")[0].alias("n")).collect()
    assert {r["vec_id"]: r["n"] for r in size} == {1: 22.0, 2: 24.0, 3: 18.0, 4: 0.0, 5: 0.0}


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, t) for a, b, t in pairs], "source string, target string, type string")


@pytest.mark.parametrize("limit", [None, 4, 1000])
def test_paths_against_all_walks(spark, limit):
    dice = random.Random(6)
    pairs = sorted({(f"n{dice.randrange(14)}", f"n{dice.randrange(14)}", "link") for _ in range(45)})
    wanted = []

    def walk(path):
        if path[-1] == "n1":
            wanted.append((">".join(path), len(path) - 1))
        elif len(path) <= 5:
            for _, b, _ in (p for p in pairs if p[0] == path[-1]):
                if b not in path:
                    walk([*path, b])

    walk(["n0"])
    got = [tuple(r) for r in graph.paths(edges(spark, pairs), "n0", "n1", 5, limit=limit).select("path", "hops").collect()]
    order = sorted(wanted, key=lambda x: (x[1], x[0]))
    assert (sorted(got) == sorted(wanted)) if limit is None else got == order[:limit]
    assert len(wanted) > 10


def test_a_dense_graph_has_few_walks(spark, monkeypatch):
    """10,000 edges in six layers: 10^8 shortest paths, of which five are asked for; no level keeps more than five a node."""
    layer = lambda k, i: f"l{k}_{i:02}"
    pairs = [("s", layer(0, i), "x") for i in range(45)] + [(layer(4, i), "t", "x") for i in range(45)]
    pairs += [(layer(k, i), layer(k + 1, j), "x") for k in range(4) for i in range(45) for j in range(45)]
    sizes, real = [], graph.cut

    def counted(df):
        out = real(df)
        if "path" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = [r["path"] for r in graph.paths(edges(spark, pairs), "s", "t", 6, limit=5).collect()]
    assert got == [f"s>l0_00>l1_00>l2_00>l3_00>l4_0{i}>t" for i in range(5)] and max(sizes) <= 45 * 5


def test_first_paths_to_many_targets(spark):
    rows = edges(spark, [("a", "b", "x"), ("a", "c", "y"), ("b", "d", "x"), ("c", "d", "x"), ("d", "e", "x"), ("e", "f", "x"), ("b", "a", "x"), ("g", "a", "x")])
    got = {r["node"]: (r["hops"], [tuple(s) for s in r["steps"]]) for r in graph.first_paths(rows, "a", 3).collect()}
    assert got["d"] == (2, [("a", "x", "b"), ("b", "x", "d")]) and set(got) == {"b", "c", "d", "e"} and got["e"][0] == 3
    assert [r["node"] for r in graph.first_paths(rows, "a", 3, spark.createDataFrame([("d",), ("g",)], "node string")).collect()] == ["d"]


def communities_in_turn(pairs):
    """The same schedule as plain updates, one node after the other."""
    import hashlib

    near = {}
    for a, b in pairs:
        near.setdefault(a, set())
        near.setdefault(b, set())
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label, moves, turn = {n: n for n in near}, dict.fromkeys(near, 0), 0
    while True:
        wants = {}
        for n in near:
            if near[n]:
                seen = [label[m] for m in near[n]]
                best = min(seen, key=lambda x: (-seen.count(x), x))
                if best != label[n]:
                    wants[n] = best
        if not wants:
            break
        rank = {n: (hashlib.md5(f"{turn}:{n}".encode()).hexdigest() if turn >= graph.ID_TURNS else f"{moves[n]:09}", n) for n in wants}
        for n in [n for n in wants if all(rank[n] < rank[m] for m in near[n] if m in wants)]:
            label[n], moves[n] = wants[n], moves[n] + 1
        turn += 1
    return {n: min(m for m in label if label[m] == label[n]) for n in label}


def test_communities_settle_as_in_turn(spark, monkeypatch):
    monkeypatch.setattr(graph, "ID_TURNS", 6)
    swapping = [("n0", "n1"), ("n1", "n3"), ("n1", "n4"), ("n1", "n5"), ("n2", "n3"), ("n2", "n4"), ("n2", "n5")]
    triangles = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")]
    dice = random.Random(7)
    wild = [(f"n{dice.randrange(40)}", f"n{dice.randrange(40)}") for _ in range(60)]
    chain = [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)]
    for pairs in (chain, swapping, triangles, [*triangles, ("c", "bridge"), ("bridge", "d")], wild):
        got = {r["node"]: r["community"] for r in graph.communities(edges(spark, [(*p, "x") for p in pairs])).collect()}
        assert got == communities_in_turn(pairs)
    assert "bridge" in {r["node"] for r in graph.entry_points(edges(spark, [(*p, "x") for p in [*triangles, ("c", "bridge"), ("bridge", "d")]]), 3).collect()}
