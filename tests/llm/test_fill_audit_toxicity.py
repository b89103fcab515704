"""Fill-in-middle, the filter audit and toxicity against plain forms, on odd rows and on planted cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, filter_audit, toxicity
from tessera.llm.queries import QUERIES

ODD = [
    (1, "The same text, here.", "s"), (1, "The same text, here.", "s"), (1, "another text of id one", None), (2, None, "t"), (3, "", "s"), (4, " \n\t\n ", ""), (None, "a text without an id", "s"), (None, None, None),
    (5, "héé ß 😀 日本語 x\ny\n\nz " * 40, "t"), (6, "has <P> inside " * 9, "s"), (7, "ends with a start <" * 11 + "<S", "s"), (8, "x" * 700, "u"), (9, "The same text, here.", "t"), (10, "a <S" + "> b " * 30, "s"),
]


def unit_starts(text: str, units: str) -> list[int]:
    if units == "chars":
        return list(range(len(text)))
    if units == "words":
        return [m.start() for m in re.finditer(r"[^\x20\x09-\x0d]+", text)]
    return [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+", text)]


def plain_fim(doc_id, text, units):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    starts = unit_starts(text, units)
    n = len(starts)
    if not n or any(s in text for s in fill_middle.SENTINELS) or h[2] % 100 >= 90:
        return "plain", n, None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y = (0 if k == 0 else len(text) if k == n else starts[k] for k in (a, b))
    p, m, s = text[:x], text[x:y], text[y:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return form, n, a, b - a, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("units,chunk", [("chars", 64), ("words", 64), ("lines", 100), ("chars", 1 << 16)])
def test_fill_in_middle_against_plain(spark, units, chunk):
    dice = random.Random(5)
    rows = [(i, t) for i, t, _ in ODD] + [(100 + k, "".join(dice.choice("ab \n<>PSMé😀") for _ in range(dice.randrange(400)))) for k in range(60)]
    docs = spark.createDataFrame([(*r, "old", "clash") for r in rows], "doc_id long, text string, form string, body string")
    out = fill_middle.fill_in_middle(docs, units=units, chunk_bytes=chunk)
    got = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    mine = sorted((repr((r["doc_id"], r["text"])), r["body"], r["form"], r["n_units"], r["prefix_units"], r["middle_units"], r["output"]) for r in got)
    assert mine == sorted((repr((i, t)), "clash", *plain_fim(i, t, units)) for i, t in rows)
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.filter("false"), units=units, chunk_bytes=chunk).count() == 0


def test_functions_compose():
    """A text's function is that of its parts, wherever it is cut; lanes give what a plain run gives."""
    dice = random.Random(6)
    for units in ("chars", "words", "lines"):
        auto = fill_middle.automaton(units)
        text = "".join(dice.choice("ab \n<>PSMé") for _ in range(5000)).encode()
        whole = fill_middle.chunk_function(text, auto)
        cut = dice.randrange(len(text))
        parts = fill_middle.chunk_function(text[:cut], auto).then(fill_middle.chunk_function(text[cut:], auto))
        assert all((getattr(whole, f) == getattr(parts, f)).all() for f in ("step", "units", "hits"))
        state, plain = 0, []
        for b in text:
            plain.append(auto.emit[b, state])
            state = auto.step[b, state]
        assert fill_middle.emissions(np.frombuffer(text, np.uint8), auto).tolist() == plain
        assert whole.step[0, 0] == state and whole.units[0, 0] == sum(int(p) & 1 for p in plain)
    assert fill_middle.automaton("chars").states == 3


def test_sentinels_that_could_be_mistaken_are_refused():
    for bad in (("<P>", "<S>", ""), ("ab", "ba", "x"), ("<P>", "<P>", "<M>"), ("<P>", "x<P>y", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.check_sentinels(bad)


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return {"chars": len(text), "words": len(words), "distinct_words": len(set(words)), "capitals": len(re.findall("[A-Z]", text)), "symbols": len(re.findall(r"[#$%&*|]", text))}


@pytest.mark.parametrize("stretch,multiplier", [(1 << 18, filter_audit._MULTIPLIER), (64, filter_audit._MULTIPLIER), (64, 1), (1 << 18, 1)])
def test_buffer_scan_against_plain(stretch, multiplier):
    """Short stretches take long texts in parts; with a multiplier of 1 anagrams share a hash, and are told apart."""
    dice = random.Random(7)
    texts = [t for _, t, _ in ODD] + ["".join(dice.choice("ab cB\n#é😀|Z\x0b") for _ in range(dice.randrange(300))) for _ in range(80)] + ["ab ba ab abc cab " * 5, "y" * 500 + " " + "z" * 130]
    column = pa.array([None, *texts, None])[1:-1]
    found = filter_audit.column_statistics(column, filter_audit.Scanner(stretch=stretch, multiplier=multiplier))
    for k, t in enumerate(texts):
        assert {s: int(found[s][k]) for s in filter_audit.STATISTICS} == plain_statistics(t), t


def plain_audit(rows, labels):
    first, good, bad = {}, set(), set()
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, q, x in labels:
        good |= {i} if q == 1 and i is not None else set()
        bad |= {i} if x == 1 and i is not None else set()
    judged = []
    for i, t, source in rows:
        s = plain_statistics(t)
        fails = {"A": s["words"] < 200, "B": 100 * s["distinct_words"] < 50 * s["words"], "C": 100 * s["capitals"] > 2 * s["chars"], "D": s["symbols"] > 0, "E": i is not None and i > first[t or ""]}
        judged.append((source or "", {f for f in fails if fails[f]}, i in good, i in bad))
    out, removed_by = {}, {}
    for part in {p for p, *_ in judged}:
        for order in permutations("ABCDE"):
            left = [r[1:] for r in judged if r[0] == part]
            mine = list(left)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                kept = [r for r in left if f not in r[0]]
                failing = sum(f in r[0] for r in mine)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), sum(r[0] == {f} for r in mine), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
                left = kept
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_plain(spark):
    dice = random.Random(8)
    rows = [*ODD] + [(dice.randrange(40), dice.choice(["word " * 250, " ".join(f"w{k}" for k in range(240)), "A B C", "#", " ".join(f"v{k}" for k in range(300)) + " & Z"]), dice.choice("stu")) for _ in range(120)]
    labels = [(dice.choice([None, *range(40)]), dice.choice([0, 1, None]), dice.choice([0, 1, 2])) for _ in range(30)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, digest string, mask int, n int")
    known = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, text string")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in filter_audit.audit(docs, known).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs.filter("false"), known).count() == 0
    assert filter_audit.audit(docs, known.filter("false")).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            same = x == y or toxicity.LOOKALIKES.get(x) == y or x == "*"
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (not same)))
        row = new
    return row[-1]


def test_automaton_against_plain_distances():
    dice = random.Random(9)
    terms = ["idiot", "moron", "scum", "worthless", "disgusting", "abab", "ababab", "abababababa", "idiots"]
    automaton = toxicity.TermAutomaton(terms)
    words = set(terms)
    for _ in range(3000):
        w = list(dice.choice(terms))
        for _ in range(dice.randrange(4)):
            at = dice.randrange(len(w) + 1)
            w[at : at + dice.randrange(2)] = dice.choice(["", "a", "b", "i", "1", "0", "$", "*", "o", "xy"])
        words.add("".join(w))
    for w in words:
        wanted = [(k, distance(w, t)) for k, t in enumerate(terms) if distance(w, t) <= toxicity.edits_allowed(t)]
        exact = [f for f in wanted if terms[f[0]] == w]
        assert automaton.find(w) == (exact or sorted(wanted)), w
    assert automaton.find("1d*ot")[0] == (0, 0) and toxicity.misspellings(automaton, "idiooooot") == [(0, 1)]


def test_quotations_weigh_less():
    scorer = toxicity.Scorer(toxicity.Model({"idiot": (7.0, 4.0), "moron": (7.0, 4.0)}, curve=(-4.0, 3.0, 0.0, 0.0)))
    abuse, quoted = "You are an idiot and a m0ron, go away.", 'The court said that the word "idiot" was used, and “moron” as well.'
    assert scorer(abuse) > 0.5 > scorer(quoted) and scorer("a clean text") == scorer("") < 0.05
    pad = "good words here and there " * 10_000
    assert [(k, e) for k, e, _, _ in scorer.finds(pad + "idi0t " + pad + "an idiiot")] == [(0, 0), (0, 1)]
    assert toxicity.context('he said "you idiot"', 13, 18) == (1, 1, 1, 1)


def test_toxicity_is_learned_and_planted_texts_are_found(spark):
    dice = random.Random(10)
    clean = lambda n: " ".join("".join(dice.choice(["ba", "no", "ti", "re", "lu"]) for _ in range(dice.randrange(1, 4))) for _ in range(n))
    bad = ["gribnak", "foulwort", "wretchling"]
    texts = [(k, clean(60) + (" " + " ".join(dice.choice(bad) + " " + clean(9) for _ in range(3)) if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(i, t, "old", 9.0) for i, t, _ in texts], "doc_id long, text string, row string, score double")
    labels = spark.createDataFrame([(i, x) for i, _, x in texts] + [(None, 1), (3, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(bad) <= set(model.weights)
    planted = [(1, clean(40) + " gribnak gr1bnak foulwart " + clean(20)), (2, clean(80)), (3, ""), (4, None), (None, clean(30)), (5, "wr3tchlng foulwoort gribnac " + clean(30)), (6, clean(30_000) + " gribnak foulwort wretchling")]
    rows = spark.createDataFrame([(*r, "old", 9.0) for r in planted + planted[:2]], "doc_id long, text string, row string, score double")
    got = toxicity.score(rows, model).collect()
    assert len(got) == 9 and all(r["row"] == "old" and 0 <= r["score"] <= 1 for r in got)
    assert {r["doc_id"] for r in got if r["predicted"]} == {1, 5, 6}
    assert toxicity.score(rows.filter("false"), model).count() == 0
    assert toxicity.fit(docs.filter("false"), labels) == toxicity.fit(docs, labels.filter("toxic = 0")) == toxicity.Model({})
    assert {r["predicted"] for r in toxicity.score(rows, toxicity.Model({})).collect()} == {0}


def test_op13_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, folder).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    held = [(got[r["doc_id"]], r["toxic"]) for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == x for r, x in held) >= 0.9 * len(held)
