"""Promotion of captures and notes, and procedures from repeated captures, against plain Python."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tessera.operators import captures, promotion

PAGES = "page_id string, title string, kind string, visibility string, status string, summary string, tags array<string>, sources array<string>, body string, suggested_target string, promoted_to string, extra int"


def replay(requests, pages):
    """Requests one after the other, on a dictionary of pages."""
    before, after, out = dict(pages), {k: dict(v) for k, v in pages.items()}, []
    written = set()
    for seq, capture, target, content in sorted(requests, key=lambda r: r[0]):
        page = before.get(capture)
        target = (target or "").strip() or ((page or {}).get("suggested_target") or "").strip() or None
        if page is None:
            outcome = "not_found"
        elif page["kind"] != "capture" or not (capture or "").startswith(("inbox/", "notes/")):
            outcome = "not_a_capture"
        elif target is None:
            outcome = "no_target"
        elif not re.fullmatch(r"[A-Za-z0-9_][\w.-]*(/[A-Za-z0-9_][\w.-]*)*", target):
            outcome = "invalid_target"
        elif (target in before or target in written) and content is None:
            outcome = "exists"
        else:
            outcome = "promoted"
            written.add(target)
            if content is None:
                kind = target.split("/")[0].rstrip("s") or "page"
                after[target] = {"title": page["title"], "kind": kind, "status": "active", "sources": [capture], "tags": page["tags"], "body": page["body"].rstrip() + "\n", "promoted_to": None}
            else:
                after[target] = {"title": content.split("\n")[0][2:], "kind": target.split("/")[0].rstrip("s"), "status": None, "sources": [], "tags": [], "body": content, "promoted_to": None}
            if capture in after and capture not in written:
                after[capture] |= {"status": "accepted", "promoted_to": target}
        out.append((seq, target, outcome))
    return out, after


def test_promotions_equal_a_replay(spark):
    rnd = random.Random(5)
    pages = {}
    for k in range(60):
        page_id = rnd.choice(["inbox/i", "notes/n", "services/s", "projects/p"]) + str(k)
        kind = "capture" if page_id[0] in "in" and rnd.random() < 0.9 else "service"
        pages[page_id] = {"title": f"Title {k}", "kind": kind, "status": "draft", "sources": ["x"], "tags": ["a", "b"][: k % 3], "body": f"# T\n\ntext {k} \n\n", "suggested_target": rnd.choice([None, " ", f"services/s{rnd.randrange(60)}", f"runbooks/new{rnd.randrange(6)}"]), "promoted_to": None}
    names = [*pages, "inbox/none", None]
    requests = [(k, rnd.choice(names), rnd.choice([None, None, "", "../bad", "a b", f"projects/p{rnd.randrange(60)}", f"concepts/new{rnd.randrange(8)}"]), rnd.choice([None, None, None, f"# By hand {k}\n\nwords\n"])) for k in range(1_000)]
    table = spark.createDataFrame([(p, v["title"], v["kind"], "internal", v["status"], "s", v["tags"], v["sources"], v["body"], v["suggested_target"], None, 1) for p, v in pages.items()], PAGES)
    after, outcomes = promotion.promote(spark.createDataFrame(requests, "seq long, capture_id string, target string, content string").repartition(5), table)
    wanted, state = replay(requests, pages)
    assert [tuple(r) for r in outcomes.orderBy("seq").select("seq", "target", "outcome").collect()] == wanted
    assert {o for _, _, o in wanted} == {"not_found", "not_a_capture", "no_target", "invalid_target", "exists", "promoted"}
    got = {r["page_id"]: r for r in after.collect()}
    assert after.columns == table.columns and set(got) == set(state) and after.count() == len(got)
    for page_id, page in state.items():
        for c in ("title", "kind", "status", "sources", "tags", "body", "promoted_to"):
            assert got[page_id][c] == page[c], (page_id, c)
    assert all(got[p]["extra"] == 1 for p in pages if not any(t == p and o == "promoted" for _, t, o in wanted))
    assert promotion.promote(spark.createDataFrame([], "seq long, capture_id string, target string, content string"), table)[0].count() == len(pages)
    assert [r["outcome"] for r in promotion.judge(spark.createDataFrame([(1, "inbox/x", None, None)], "seq long, capture_id string, target string, content string"), table.filter("false")).collect()] == ["not_found"]


def test_titles_and_texts_of_any_kind_are_promoted_as_they_are(spark):
    odd = [("null", None), ("'quoted'", ""), ("a: b # c", "\n\nx"), (" spaced ", "---\nno: header\n---\n"), (None, "# From heading\n")]
    table = spark.createDataFrame([(f"inbox/{k}", t, "capture", None, None, None, None, None, b, f"runbooks/r{k}", None, 0) for k, (t, b) in enumerate(odd)], PAGES)
    after, _ = promotion.promote(table.select(F.monotonically_increasing_id().alias("seq"), F.col("page_id").alias("capture_id"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("content")), table)
    got = {r["page_id"]: (r["title"], r["body"]) for r in after.filter("kind = 'runbook'").collect()}
    assert [got[f"runbooks/r{k}"][1] for k in range(5)] == ["\n", "\n", "\n\nx\n", "---\nno: header\n---\n", "# From heading\n"]
    assert [got[f"runbooks/r{k}"][0] for k in (1, 2, 3, 4)] == ["'quoted'", "a: b # c", " spaced ", "From heading"]


def test_notes_are_promoted_once_and_keep_the_rest(spark):
    notes = [("dailies/2024-01-01", "---\ntitle: A\nstatus: draft\nsources:\n  - x\n---\nstatus: draft\n"), ("dailies/2024-01-02", "no header\nstatus: draft\n"), ("dailies/2024-01-03", "---\ntitle: C\nreviewed_at: old\n---\n"), ("dailies/2024-01-04", "---\ntitle: D\n---\n"), ("notes/2024-01-01", None)]
    table = spark.createDataFrame([(*n, 7) for n in notes], "page_id string, content string, more int")
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 1, 2, 3, 9)], "day date")
    after, outcomes = promotion.promote_notes(table, days, F.lit("2024-02-01"))
    assert {(r["day"], r["outcome"]) for r in outcomes.collect()} == {("2024-01-01", "promoted"), ("2024-01-02", "no_header"), ("2024-01-03", "promoted"), ("2024-01-09", "no_note")} and outcomes.count() == 4
    got = {r["page_id"]: r["content"] for r in after.collect()}
    assert got["dailies/2024-01-01"] == "---\ntitle: A\nstatus: promoted\nsources:\n  - x\nreviewed_at: 2024-02-01\n---\nstatus: draft\n"
    assert got["dailies/2024-01-03"] == "---\ntitle: C\nreviewed_at: 2024-02-01\nstatus: promoted\n---\n" and after.columns == table.columns
    assert {k: got[k] for k, _ in notes[1::2]} == dict(notes[1::2]) and got["notes/2024-01-01"] is None
    assert promotion.promote_notes(table.filter("false"), days.filter("false"), F.lit("x"))[1].count() == 0


def plain_steps(texts, most=8):
    """Steps of texts read one after the other."""
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        found = [m.group(1).strip() for x in lines if (m := re.match(r"\s*(?:[-*+]\s+|\d+[.)]\s+)(\S.*)$", x))] or [x.strip() for x in lines if x.strip() and x.lstrip()[0] not in "#>"][:1]
        for step in found:
            step = step.rstrip(".")
            step = step if re.match(r"(?i)(check|create|deploy|ensure|inspect|record|review|run|update|verify)\b", step) else f"Review and apply: {step}"
            if step not in out:
                out.append(step)
            if len(out) >= most:
                break
    out = out or [promotion.NO_STEP]
    return out if len(out) > 1 else [*out, promotion.LAST_STEP]


def test_steps_of_groups_equal_plain_reading(spark):
    rnd, rows, members = random.Random(9), [], []
    for k in range(120):
        lines = [rnd.choice(["- check a%d.", "* do b%d", "2) run c%d", "# head %d", "> said %d", "plain %d", ""]) for _ in range(rnd.randrange(6))]
        rows.append((f"inbox/{k:03}", "\n".join(x % rnd.randrange(9) if "%" in x else x for x in lines), dt.datetime(2024, 1, 1 + rnd.randrange(9))))
        members.append((f"inbox/{k:03}", ["a", "b", "c", "d"][min(3, k // 38)]))
    rows += [("inbox/e1", "", rows[0][2]), ("inbox/e2", None, rows[0][2]), ("inbox/f1", "- check it", rows[0][2]), ("inbox/f2", "- check it.", rows[0][2])]
    members += [("inbox/e1", "e"), ("inbox/e2", "e"), ("inbox/f1", "f"), ("inbox/f2", "f")]
    table = spark.createDataFrame(rows, "capture_id string, observation string, updated_at timestamp").repartition(4)
    got = {}
    for r in promotion.group_steps(table, spark.createDataFrame(members, "capture_id string, group_id string")).orderBy("group_id", "place").collect():
        got.setdefault(r["group_id"], []).append((r["place"], r["step"]))
    for g in "abcdef":
        texts = [t for c, t, _ in sorted(rows, key=lambda r: (r[2], r[0]), reverse=True) if (c, g) in members]
        assert got[g] == list(enumerate(plain_steps(texts), 1)), g


def test_procedures_are_proposed_from_groups_not_yet_taken(spark):
    words = ["restart worker queue after timeout error", "rotate database password vault secret", "renew certificate gateway domain proxy", "clean stale cache nodes evicted", "unique matter nobody repeats"]
    sizes, rows = [5, 4, 3, 2, 1], []
    for g, (text, n) in enumerate(zip(words, sizes)):
        rows += [(f"inbox/{g}-{k}", f"Fix {k}", f"- {text}\n- check {g}", dt.datetime(2024, 1, 1 + k)) for k in range(n)]
    table = spark.createDataFrame(rows, "capture_id string, title string, observation string, updated_at timestamp")
    taken = spark.createDataFrame([("procedures/candidates/x", "inbox/1-0"), ("procedures/candidates/x", "inbox/1-3"), ("procedures/candidates/y", "inbox/0-1"), ("procedures/candidates/z", "inbox/0-2")], "page_id string, capture_id string")
    wanted = "procedures/candidates/check-error-queue-restart-timeout-procedure"
    ids = spark.createDataFrame([(wanted,), (f"{wanted}-2",), (f"{wanted}-4",), ("other-2",)], "page_id string")
    named, steps, sources = promotion.propose(table, taken, ids)
    got = {r["page_id"]: (r["title"], r["trigger"], r["n_sources"]) for r in named.collect()}
    assert got == {
        f"{wanted}-3": ("Check Error Queue Restart Timeout Procedure", "When check occurs repeatedly", 5),
        "procedures/candidates/certificate-check-domain-gateway-proxy-procedure": ("Certificate Check Domain Gateway Proxy Procedure", "When certificate occurs repeatedly", 3),
        "procedures/candidates/cache-check-clean-evicted-nodes-procedure": ("Cache Check Clean Evicted Nodes Procedure", "When cache occurs repeatedly", 2),
    }
    assert sorted(r["capture_id"] for r in sources.filter(F.col("page_id") == f"{wanted}-3").collect()) == [f"inbox/0-{k}" for k in range(5)]
    assert [r["step"] for r in steps.filter(F.col("page_id") == f"{wanted}-3").orderBy("place").collect()] == ["Review and apply: restart worker queue after timeout error", "check 0"]
    assert promotion.propose(table.filter("false"), taken, ids)[0].count() == 0


def test_groups_without_a_common_word_are_named_by_their_first_words(spark):
    rows = [("a", "alpha bravo charlie delta"), ("b", "bravo charlie delta echos"), ("c", "charlie delta echos foxtrot"), ("d", "delta echos foxtrot golfs"), ("e", "echos foxtrot golfs hotel")]
    table = spark.createDataFrame([(c, "", t) for c, t in rows], "capture_id string, title string, observation string")
    assert [(r["n"], r["key"], r["title"]) for r in captures.repeat_groups(table).collect()] == [(5, "similar-captures", "Alpha Bravo Bravo Charlie Charlie Procedure")]
