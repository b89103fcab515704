"""Orphans get suggestions by tags however many pages hold them."""

from tessera.operators import quality_rules


def test_suggestions_by_tags_of_many_pages(spark):
    held = {k: ["all"] + [f"t{k % 7}"] * (k % 3 > 0) + ["rare"] * (k % 400 == 5) for k in range(1_200)}
    held[1_200], held[1_201] = [], ["alone"]
    pages = spark.createDataFrame(sorted(held.items()), "page_id long, tags array<string>")
    orphans = [0, 1, 5, 405, 1_199, 1_200, 1_201]
    got = {(r["orphan_id"], r["place"]): (r["page_id"], r["n_shared"]) for r in quality_rules.orphan_suggestions(spark.createDataFrame([(k,) for k in orphans], "page_id long"), pages).collect()}
    wanted = {}
    for o in orphans:
        counts = sorted((-len(set(held[o]) & set(t)), p) for p, t in held.items() if p != o and set(held[o]) & set(t))
        wanted |= {(o, k + 1): (p, -n) for k, (n, p) in enumerate(counts[:3])}
    assert got == wanted and (0, 3) in got
