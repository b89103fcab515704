"""Rendered and guarded patches."""

from pyspark.sql import functions as F

from tessera.operators import patches

BODY = "# A\n\n## Facts\n\n- uses Redis for queues\n```\n- uses Redis in code\n```\n\n## Other\n\n- uses Redis elsewhere\n"


def test_a_fact_is_replaced_in_its_section_only():
    assert patches.replaced_fact(BODY, "## Facts", "redis", "uses Kafka") == (BODY.replace("- uses Redis for queues", "- uses Kafka"), None)
    assert patches.replaced_fact(BODY, None, "Redis", "x") == (BODY, "ambiguous")
    assert patches.replaced_fact(BODY, "## Facts", "Mongo", "x") == (BODY, "not_found") == patches.replaced_fact(BODY, "## None", "Redis", "x")
    assert patches.replaced_fact("~~~\n```\nfact\n~~~\nfact", None, "fact", "new")[0] == "~~~\n```\nfact\n~~~\nnew"
    assert patches.replaced_fact("1. fact", None, "fact", "new")[0] == "1. new" and patches.replaced_fact("", None, "", "x") == ("", "not_found")


def test_patches_are_rendered_and_guarded(spark):
    pages = spark.createDataFrame([("a", BODY, "k"), ("b", "# B\n", "k"), ("c", "# C\n\n## Facts\n\nknown\n", "k"), ("d", "# D\n", "k"), ("e", None, "k")], "page_id string, body string, kind string")
    plans = spark.createDataFrame([
        ("a", "update_existing_fact", "uses Kafka", "Redis"), ("b", "mark_stale", None, None), ("c", "append_sourced_paragraph", "known", None), ("d", "update_existing_fact", "x", "y"), ("new/my-page", "create_stub_page", "a fact", None), ("other", "insert_new_fact", "b", None), ("b", "insert_new_fact", "two", None), ("e", "create_stub_page", "f", None),
    ], "page_id string, operation string, fact string, old_fact string")
    rendered = patches.render(plans, pages).cache()
    got = {(r["page_id"], r["operation"]): (r["status"], r["reason"], r["content"]) for r in rendered.collect()}
    assert got["a", "update_existing_fact"] == ("ready", None, BODY.replace("- uses Redis for queues", "- uses Kafka"))
    assert got["d", "update_existing_fact"] == ("needs_manual_review", "not_found", "# D\n") and got["c", "append_sourced_paragraph"][2] == "# C\n\n## Facts\n\nknown\n"
    assert got["new/my-page", "create_stub_page"][2] == "# My Page\n\n## Facts\n\na fact\n" and patches.STALE in got["b", "mark_stale"][2]
    after, outcome = patches.apply(pages.withColumn("body", F.when(F.col("page_id") == "c", "edited").otherwise(F.col("body"))), rendered)
    assert {r["page_id"]: r["outcome"] for r in outcome.collect()} == {"a": "applied", "b": "crowded", "c": "changed_since", "d": "review", "new/my-page": "created", "other": "created", "e": "exists"}
    bodies = {r["page_id"]: r["body"] for r in after.collect()}
    assert bodies["a"] == got["a", "update_existing_fact"][2] and bodies["b"] == "# B\n" and bodies["c"] == "edited" and set(bodies) == {"a", "b", "c", "d", "e", "new/my-page", "other"}
    assert patches.apply(pages, rendered.filter("false"))[1].count() == 0
