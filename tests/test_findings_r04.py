"""What the findings of round 4 asked for."""

import datetime as dt
import difflib
import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import consolidation, graph, ledger, quality_rules
from tessera.plans import run_queries


def test_betweenness_of_a_larger_graph_takes_every_source(spark):
    dice = random.Random(4)
    links = {(f"n{k}", f"n{dice.randrange(k)}") for k in range(1, 120) for _ in range(2)} | {("x", "y"), ("z", "z"), ("n5", "n5")}
    near = {v: set() for e in links for v in e}
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    wanted = dict.fromkeys(near, 0.0)
    for start in near:  # as Brandes has it, one source after the other
        depth, ways, order, gain = {start: 0}, dict.fromkeys(near, 0.0) | {start: 1.0}, [start], dict.fromkeys(near, 0.0)
        for v in order:
            for w in near[v]:
                if w not in depth:
                    depth[w] = depth[v] + 1
                    order.append(w)
                ways[w] += ways[v] if depth[w] == depth[v] + 1 else 0
        for w in reversed(order[1:]):
            for v in near[w]:
                gain[v] += ways[v] / ways[w] * (1 + gain[w]) if depth[v] == depth[w] - 1 else 0
            wanted[w] += gain[w]
    n = len(near)
    edges = spark.createDataFrame([(a, b, "link") for a, b in sorted(links)], "source string, target string, type string")
    wanted = {k: pytest.approx(v / ((n - 1) * (n - 2)), abs=1e-6) for k, v in wanted.items()}
    assert {r["node"]: r["betweenness"] for r in graph.analytics(edges).collect()} == wanted
    assert {r["node"]: r["betweenness"] for r in graph.betweenness_exact(edges, 1).collect()} == wanted  # a source at a time
    assert graph.betweenness_exact(edges.filter("false")).count() == 0


def ledger_rows(spark, n):
    """Claims of two subjects with many ties of time, confidence and actor."""
    dice = random.Random(5)
    day = lambda: dice.choice([None, *(dt.datetime(2024, 1, d) for d in (1, 2, 2, 3, 9))])
    rows = [
        (f"c{k}", dice.choice(["claim"] * 9 + ["entity"]), dice.choice(["A b", "a  B", "q", None]), "uses", dice.choice(["x", "X", "y", "z", "w", None]), dice.choice(["low", "medium", "high", "unknown", None, "odd"]), dice.choice(["assumption", "inferred", "observed", None]),
         dice.choice(["ann", "bob", "", None]), dice.choice(["t", None]), dice.choice(["candidate", "active", "active", "rejected"]), day(), day(), day(), f"t{k % 7}", k % 50)
        for k in range(n)
    ]
    schema = "candidate_id string, candidate_type string, subject string, predicate string, object string, confidence string, epistemic_status string, actor string, trace_id string, status string, observed_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, target string, at long"
    return spark.createDataFrame(rows, schema).withColumn("claim_id", F.col("candidate_id")), F.lit(dt.datetime(2024, 1, 5)).cast("timestamp_ntz")


def test_claims_retired_are_those_of_all_pairs_in_order(spark):
    claims, now = ledger_rows(spark, 1800)
    new = claims.filter("substring(candidate_id, 2) % 3 = 0")
    pairs = ledger.contradicting(new, claims, now).withColumnsRenamed({"claim_id": "new_id", "candidate_id": "old_id"}).filter("old_id <> new_id").distinct()
    side = lambda s: claims.select(F.col("candidate_id").alias(f"{s}_id"), ledger.temporal_key().alias(f"{s}_at"), F.col("confidence").alias(f"{s}_confidence"), F.col("actor").alias(f"{s}_actor"), F.col("epistemic_status").alias(f"{s}_status"), F.col("trace_id").alias(f"{s}_trace"))
    gated = ledger.supersession(pairs.join(side("old"), "old_id").join(side("new"), "new_id")).join(new.select(F.col("candidate_id").alias("new_id"), "at"), "new_id")
    placed = gated.select(F.struct("at", F.col("new_id").alias("n"), F.col("old_id").alias("o")).alias("place"), "old_id", "new_id", "allowed", F.lit(True).alias("needs_live"))
    wanted = {(r["old_id"], r["new_id"]) for r in ledger.in_order(placed).filter("done").collect()}
    assert {(r["old_id"], r["new_id"]) for r in ledger.superseding(new, claims, now).collect()} == wanted and len({n for _, n in wanted}) > 5 and len(wanted) > 50
    assert {o for o, _ in wanted} & {r["candidate_id"] for r in new.collect()}  # new claims are retired too


def test_contradicted_objects_are_those_of_all_pairs(spark):
    claims, now = ledger_rows(spark, 400)
    new = claims.filter("substring(candidate_id, 2) % 9 = 0")
    pairs = ledger.contradicting(new, claims, now).join(claims.select("candidate_id", "object"), "candidate_id").join(claims.select("claim_id", "target"), "claim_id")
    got = ledger.contradicted(new, claims, now).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in pairs.select("target", "object").collect()} and len(got) == len(set(got)) > 10


def test_a_run_makes_no_pairs_of_claims(spark, monkeypatch):
    """A hundred copies of the claims of a subject: only whoever reads the sweep pays for its pairs."""
    monkeypatch.setattr(ledger, "contradicting", lambda *_: (_ for _ in ()).throw(AssertionError("pairs")))
    monkeypatch.setattr(consolidation, "sweep", lambda *_: None)
    assert run_queries.generation(spark, "/root/testdata/sf0.001").record.first()["captures_processed"] > 0


def test_ids_of_an_equal_bound_are_compared_from_the_greatest_down(monkeypatch):
    """Thousands of ids have the bound of the best ones; most are never compared."""
    calls, ratio = [], difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    pages = ["concepts/c" + "".join(p) for p in itertools.permutations("0123456", 7)] + [f"notes/n{k}" for k in range(500)] + ["\U0001f600/a", "a/\U0001f600"]
    targets = ["concepts/missing6", "concepts/missing0", "concepts/", "a/\U0001f600b"]
    table = lambda x, name: pd.DataFrame({name: x, "letters": ["".join(sorted(v)) for v in x]})
    found = quality_rules._nearest(table(targets, "target"), table(pages, "page_id"), 2, 0.4)
    assert len(calls) < 300  # of 22,168 pairs
    got = sorted(zip(found["target"], found["ratio"], found["page_id"]), reverse=True)
    for t in targets:
        ratios = sorted(((difflib.SequenceMatcher(None, p, t).ratio(), p) for p in pages), reverse=True)[:2]
        assert [x[1:] for x in got if x[0] == t] == [r for r in ratios if r[0] >= 0.4]


def test_letters_outside_the_basic_plane_are_whole(spark):
    got = quality_rules.close_ids(spark.createDataFrame([("a/\U0001f600b",)], "target string"), spark.createDataFrame([("a/\U0001f600",), ("\U0001f600/a",), ("zz",)], "page_id string"))
    wanted = sorted(((round(difflib.SequenceMatcher(None, p, "a/\U0001f600b").ratio(), 6), p) for p in ("a/\U0001f600", "\U0001f600/a")), reverse=True)
    assert [(r["ratio"], r["page_id"]) for r in got.orderBy("place").collect()] == [w for w in wanted if w[0] >= 0.4]
