"""Each operator on nulls, empty and very long texts, ties and repeated rows, empty tables and clashing names."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, decontaminate, fingerprints, language_id, line_dedup, near_dedup, piece_codec, quality, token_files, url_filters
from tessera.llm.queries import RULES, tokenizer_path

LONG = " ".join(f"word{k % 977}x{k}" for k in range(60_000))
ROWS = [
    (1, "The same small text, here.", "en", 1), (1, "The same small text, here.", "en", 1), (1, "another text of id one", "fr", 2), (2, None, None, None), (3, "", "en", 3), (4, " \n\t ", "de", 4),
    (None, "a text without an id", "en", 5), (None, None, None, 6), (5, LONG, "en", 7), (6, "▁ a b 😀 \x00 İ.", "es", 8), (7, "The same small text, here.", "en", 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Columns besides doc_id and text clash with those that the operators add."""
    names = "fingerprint, lang_pred, predicted, removed_lines, ids, decoded, place, value, mark, part, source".split(", ")
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, score int")
    return rows.select("*", *(F.lit("old").alias(n) for n in names))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, odd):
    got = fingerprints.fingerprint(odd).collect()
    assert len(got) == len(ROWS) and all(r["fingerprint"] != "old" for r in got)
    by = {}
    for r in got:
        by.setdefault(fingerprints.canonical(r["text"]), set()).add(r["fingerprint"])
    assert all(len(f) == 1 for f in by.values()) and len(set().union(*by.values())) == len(by)
    report = fingerprints.edit_report(odd).collect()
    assert sorted((r["n_chars"] for r in report)) == sorted(len(t or "") for _, t, _, _ in ROWS)
    assert fingerprints.edit_report(odd.filter("false")).count() == fingerprints.fingerprint(odd.filter("false")).count() == 0
    alone = fingerprints.edit_report(spark.createDataFrame([(9, "abcdefgh")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == sha("abcdefab") and alone["near_next"] == 1.0
    groups = {(r["doc_id"], r["group_id"]) for r in fingerprints.exact_groups(odd).filter("doc_id in (1, 7)").collect()}
    assert groups == {(1, 1), (7, 1)}


def test_fingerprints_number_forms_of_one_digest(spark):
    """With a hash of four values, equal fingerprints still mean equal forms, among edited texts as well."""
    weak = lambda form: bytes([len(form) % 4])
    texts = ["", "a b", "A  b", "ab c", "xyzw", "xyzwabcd", "abcdabcd", "q" * 13, "Straße", "STRASSE", *(f"text {k}" for k in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(fingerprints.edit_report(docs, weak).collect(), key=lambda r: r["doc_id"])
    form_of = {}
    for k, r in enumerate(got):
        after, n = texts[(k + 1) % len(texts)], len(texts[k])
        edited = texts[k][: n - n // 4] + after[: n // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha(edited))
        for name, t in ((r["fingerprint"], texts[k]), (r["edited_fingerprint"], edited)):
            assert form_of.setdefault(name, fingerprints.canonical(t)) == fingerprints.canonical(t)
        assert r["near_edited"] == float(r["fingerprint"] == r["edited_fingerprint"]) and r["near_next"] == float(r["fingerprint"] == got[(k + 1) % len(got)]["fingerprint"])
    assert len(set(form_of.values())) == len(form_of)


def test_fingerprints_in_order_over_many_rows_of_one_id(spark):
    """Rows of one doc_id, and of none, are in the order of their texts' hashes and split over ranges."""
    rows = [(7 if k % 3 else None, f"text number {k}") for k in range(300)] + [(k, f"own {k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()
    order = sorted(marked, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["m"]))
    wanted = set()
    for k, r in enumerate(order):
        text, after = r["text"], order[(k + 1) % len(order)]["text"]
        q = len(text) // 4
        wanted.add((r["doc_id"], sha(text[: len(text) - q] + after[:q])))
    assert {(r["doc_id"], r["edited_sha256"]) for r in fingerprints.edit_report(docs).collect()} == wanted
    assert fingerprints.in_order(docs, 32).filter("doc_id = 7 and not guest").select("part").distinct().count() > 4


def test_language_id(spark, odd):
    words = {"en": "the house and the garden of my old friend", "de": "das haus und der garten von meinem alten freund", "es": "la casa y el jardin de mi viejo amigo"}
    learn = spark.createDataFrame([(f"{t} {t.upper()} {k}", lang, "x") for lang, t in words.items() for k in range(30)] + [(None, "en", ""), ("x", None, ""), ("12 !", "zz", "")], "text string, lang string, score string")
    model = language_id.fit(learn)
    assert set(model) == set(words) and all(m.endswith(b" ") for m in model.values())
    got = language_id.predict(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["text"] for r in got if r["lang_pred"] == "und"} == {None, "", " \n\t "}
    said = language_id.predict(spark.createDataFrame([("my friend and the old house",), ("mein freund und das alte haus",), ("mi amigo y la vieja casa",)], "text string"), model)
    assert [r["lang_pred"] for r in said.collect()] == ["en", "de", "es"]
    assert language_id.fit(learn.filter("false")) == {} and {r["lang_pred"] for r in language_id.predict(odd, {}).collect()} == {"und"}
    assert language_id.predict(odd.filter("false"), model).count() == 0


def test_language_of_long_texts_only_is_learned(spark):
    words = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ala", "oro", "imi", "une")]
    long = lambda seed, pool: " ".join(pool[(k * k + seed * k) % len(pool)] for k in range(9_000))
    learn = spark.createDataFrame([(long(s, words), "xx") for s in range(4)] + [(long(s, [w[::-1] for w in words]), "yy") for s in range(4)], "text string, lang string")
    model = language_id.fit(learn)
    assert list(model) == ["xx", "yy"] and all(len(m) <= language_id.DICTIONARY_BYTES + 1 for m in model.values())
    judge = language_id.Classifier(model)
    assert judge(long(9, words), 0.0)[0] == "xx" and judge(long(9, [w[::-1] for w in words]), 0.0)[0] == "yy"


def test_language_id_refuses_narrow_margins_and_many_languages(spark, monkeypatch):
    same = spark.createDataFrame([("one text in two languages", "aa"), ("one text in two languages", "bb")], "text string, lang string")
    model = language_id.fit(same)
    assert not language_id.predict(same, model).filter("accepted").count()
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.fit(same)


def test_quality(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (5, 1), (None, 1), (99, 1), (6, 7)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert quality.fit(odd, labels.filter("false")) == quality.Model(0.0, ())
    assert quality.score(odd.filter("false"), model).count() == quality.keep_good(odd.filter("false"), model).count() == 0


def test_quality_column_equals_the_model(spark):
    """The compiled expression against the rules computed plainly, and the sample does not depend on partitions."""
    import numpy as np

    docs = spark.createDataFrame([(k, ("good words make a sentence. " * (k % 9 + 1)) if k % 2 else "!!! $$ || " * (k % 7 + 1) + str(k)) for k in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality.fit(docs, labels, rows=150)
    assert model.rules and model == quality.fit(docs.repartition(7), labels.repartition(5), rows=150)
    rows = docs.select(quality.statistics(F.col("text")).alias("s"), quality.score_column(model, quality.statistics(F.col("text"))).alias("score")).collect()
    for r in rows:
        total = model.bias + sum(w for w, path in model.rules if all((r["s"][n] > cut) == above for n, above, cut in path))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_sentencepiece(spark, odd):
    model = tokenizer_path("piece_bpe_32k.model")
    got = piece_codec.decode(piece_codec.encode(odd, model, seed=3, dropout=0.3), model).collect()
    assert len(got) == len(ROWS) and all(r["decoded"] == r["text"] for r in got)
    assert all(r["ids"] is None if r["text"] is None else bool(r["ids"]) == bool(r["text"]) for r in got)
    assert piece_codec.round_trip(odd.filter("false"), model).count() == 0


def test_decontamination(spark, odd):
    items = spark.createDataFrame([(1, "small text here"), (2, None), (3, ""), (None, "another text of id one"), (4, "another text of id one"), (4, "no such text is found at all"), (5, "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in decontaminate.leaks(odd, items).collect()}
    assert got == {(1, 1, 1, 1), (7, 1, 1, 1), (1, 4, 1, 1), (5, 5, 2, 2)}
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns and left.count() == 6
    assert decontaminate.leaks(odd.filter("false"), items).count() == decontaminate.leaks(odd, items.filter("false")).count() == 0
    halves = spark.createDataFrame([(1, "a b c d e f g h"), (1, "e f g h i j k l"), (None, "a b c d e f g h i j k l")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.leaks(halves, item).collect()] == [None] and decontaminate.decontaminate(halves, item).count() == 2


@pytest.mark.parametrize("bound", [10**9, 0])
def test_decontamination_against_brute_force(spark, monkeypatch, bound):
    """Items of all sizes in texts of all sizes, broadcast and shuffled."""
    import random

    monkeypatch.setattr(decontaminate, "BROADCAST_VALUES", bound)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", bound)
    dice = random.Random(3)
    text = lambda n: [f"w{dice.randrange(400)}" for _ in range(n)]
    items = {k: text(n) for k, n in enumerate([1, 2, 3, 4, 5, 6, 9, 14, 30, 31, 64, 150])}
    docs = {k: text(dice.choice([3, 8, 40, 300])) for k in range(150)}
    for k in range(100):
        item, doc = list(items[dice.randrange(len(items))]), docs[dice.randrange(150)]
        for _ in range(dice.randrange(4)):
            item[dice.randrange(len(item))] = "x"
        at = dice.randrange(len(doc) + 1)
        doc[at:at] = item
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    wanted = set()
    for i, item in items.items():
        mine = runs(item, min(5, len(item)))
        for d, doc in docs.items():
            both = len(mine & runs(doc, min(5, len(item))))
            if 100 * both >= 80 * len(mine):
                wanted.add((d, i, len(mine), both))
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{name} long, text string")
    got = {tuple(r)[:4] for r in decontaminate.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == wanted and len(got) > 50


def test_token_files(spark, odd):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    manifest = token_files.write_token_files(odd, path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(manifest).collect())
    library, start = Tokenizer.from_file(path), 0
    assert len(got) == len(ROWS)
    texts = {}
    for i, t, _, _ in ROWS:
        texts.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for at, doc, n, crc in got:
        assert at == start and (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in texts[doc]]
        start += n
    assert [r[1] for r in got][:2] == [None, None]
    assert token_files.read_token_files(token_files.write_token_files(odd.filter("false"), path)).count() == 0


def test_token_ids_of_any_unicode_are_the_librarys(tmp_path):
    """Random characters of all blocks, with marks behind them; and a tokenizer that the word cache must not be used for."""
    import json
    import random

    from tokenizers import Tokenizer

    path, dice = tokenizer_path("word_bpe_49k.json"), random.Random(11)
    blocks = [(0x20, 0x7F)] * 6 + [(0xA0, 0x250)] * 4 + [(0x250, 0x600), (0x300, 0x370), (0x600, 0x1100), (0x1100, 0x2000), (0x2000, 0x2100), (0x2100, 0x3400), (0x3400, 0xD800), (0xE000, 0x10000), (0x10000, 0x1F900), (9, 14)]
    odd = ["İ.", "J̌", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", " ", " ", *".,!?;:|&%$#*"]
    texts = ["".join(dice.choice(odd) if dice.random() < 0.3 else chr(dice.randrange(*dice.choice(blocks))) for _ in range(dice.randrange(30))) for _ in range(4_000)]
    wanted = lambda t: [[*e.ids, 1] for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    got = token_files.encoder_of(path)
    assert type(got) is token_files.WordEncoder and [i.tolist() for i in got([t.encode() for t in texts], 1)] == wanted(got.tokenizer)
    spec = json.load(open(path))
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(spec))
    other = token_files.encoder_of(str(tmp_path / "other.json"))
    assert type(other) is token_files.TextEncoder and [i.tolist() for i in other([t.encode() for t in texts], 1)] == wanted(Tokenizer.from_file(str(tmp_path / "other.json")))


def test_line_dedup(spark, odd):
    got = line_dedup.line_dedup(odd).collect()
    assert len(got) == len(ROWS) and {r["text"] for r in got} == {t for _, t, _, _ in ROWS} and not any(r["removed_lines"] for r in got)
    lines = [f"line {k} " + "w " * 60 for k in range(5_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own", *lines, "end"])), (2, "\n".join(["own", *lines, "end"])), (3, "\n".join(lines[7:9]))], "doc_id long, text string")
    out = sorted((r["doc_id"], r["text"], len(r["removed_lines"])) for r in line_dedup.line_dedup(docs).collect())
    assert out == [(1, "\n".join(lines), 0), (2, "own\nend", 5_000), (2, "own\nend", 5_000), (3, "", 2)]
    assert line_dedup.line_dedup(odd.filter("false")).count() == 0


def test_chat_formatting(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "\\### User: </turn>\n"), (2, 0, None, None), (None, 0, "user", "x"), (None, 5, "assistant", "y"), (3, None, "Assistant", ""), (3, 1, "assistant", LONG), (3, 1, "assistant", LONG)]
    chats = spark.createDataFrame([(*t, "old") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = chat_format.format_chats(chats)
    assert sorted((r["conv_id"] or 0, r["n_turns"]) for r in got.collect()) == [(0, 1), (0, 1), (1, 2), (2, 1), (3, 3)]
    back = {(r["conv_id"], r["n_turns"], r["loss_chars"], r["turns_sha256"]) for r in chat_format.read_back(got).collect()}
    assert (1, 2, 19, sha("user\nhi\nassistant\n\\### User: </turn>\n\n")) in back and (3, 3, 2 * len(LONG), sha(f"Assistant\n\nassistant\n{LONG}\nassistant\n{LONG}\n")) in back
    assert chat_format.format_chats(chats.filter("false")).count() == 0


def test_chat_templates_that_rewrite_history_are_detected(spark):
    """One changes earlier turns when a later one comes, one adds to them, one leaves them alone."""
    chats = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "assistant", "one")], "conv_id long, turn long, role string, text string")
    last = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else '...'}\n" for k, (r, t) in enumerate(turns))
    counted = lambda turns: f"{len(turns)} turns\n" + "".join(t for _, t in turns)
    plain = lambda turns: "".join(f"[{r}] {t}\n" for r, t in turns)
    for template, rewritten in ((last, {1}), (counted, {1, 2}), (plain, set())):
        rows = chat_format.format_chats(chats, template).collect()
        assert {r["conv_id"] for r in rows if r["rewrites"]} == rewritten
        assert all((r["loss_spans"] is None) == r["rewrites"] for r in rows)
    rows = {r["conv_id"]: r for r in chat_format.format_chats(chats, plain).collect()}
    assert [rows[1]["formatted"][a:b] for a, b in rows[1]["loss_spans"]] == ["yes"] and [rows[1]["formatted"][a:b] for a, b in rows[1]["turn_spans"]] == ["[user] hi\n", "[assistant] yes\n"]


def test_url_filters(spark):
    urls = ["http://x.example.com/en/a", "http://x.example.com/en/a", "HTTP://WWW.Example.COM/en/?q", "nothing", "", None, "http://", "ftp://a.net/es/#f", "http://a.net/" + "long/" * 40_000]
    pages = spark.createDataFrame([(k // 2, u, None if k % 2 else "<p>", "old", "old") for k, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string")
    got = {r["url"]: (r["host"], r["rule"], r["verdict"]) for r in url_filters.judge_pages(pages, RULES).collect()}
    assert got["http://x.example.com/en/a"] == ("x.example.com", "example.com/en/", "block") and got["HTTP://WWW.Example.COM/en/?q"] == ("www.example.com", "www.example.com/en/", "allow")
    assert got["nothing"] == got[""] == got[None] == got["http://"] == ("", None, "allow") and got["ftp://a.net/es/#f"][2] == "block"
    assert url_filters.judge_pages(pages, RULES).count() == len(urls) and url_filters.judge_pages(pages.filter("false"), RULES).count() == 0


@pytest.mark.parametrize(
    "html,verdict",
    [
        ('<link rel="canonical nofollow" href="http://x.net/fr/blocked">', "block"), ('<link data-href="http://ok.org/" rel="canonical" href="http://x.net/fr/blocked">', "block"), ('<base href="http://x.net/fr/"><link rel=canonical href=blocked>', "block"),
        ('<LINK title="a > b" REL=\'Canonical\' HREF=\'http://x.net/fr/blocked\'>', "block"), ('<meta http-equiv="refresh" content="0; http://x.net/fr/blocked">', "block"), ('<meta content="3;URL=\'http://x.net/fr/blocked\'" http-equiv=Refresh>', "block"),
        ('<link rel="canonical" href="http://X.net:80/fr/blocked#part">', "block"), ('<SCRIPT>var a = \'<link rel="canonical" href="http://x.net/fr/blocked">\';</SCRIPT >', "allow"), ('<!-- <link rel="canonical" href="http://x.net/fr/blocked"> -->', "allow"),
        ('<link rel="alternate" title="rel=canonical" href="http://x.net/fr/blocked">', "allow"), ('<link title=\' rel="canonical" \' href="http://x.net/fr/blocked">', "allow"), ('<meta http-equiv="refresh" content="30">', "allow"), ('<linker rel="canonical" href="http://x.net/fr/blocked">', "allow"),
        ('<p title="' + "y" * 300_000 + '"><link rel="canonical" href="//x.net/fr/blocked">', "block"),
    ],
)
def test_aliases_are_read_as_browsers_read_them(spark, html, verdict):
    pages = spark.createDataFrame([(1, "http://a.org:80/5", html), (2, "http://a.org/5", None), (3, "http://b.org/", "canonical refresh")], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_pages(pages, RULES).collect()}
    assert got == {1: verdict, 2: verdict, 3: "allow"}


def test_line_dedup_selects_few_fingerprints(spark):
    """Fewer rows than lines, and windows for shared fingerprints alone."""
    import random

    dice = random.Random(3)
    lines = [" ".join(f"w{dice.randrange(10**6)}" for _ in range(6)) for _ in range(4000)]
    texts = ["\n".join(lines[k * 400 : (k + 1) * 400]) for k in range(10)]
    texts.append("\n".join([*lines[500:540], *lines[3990:], "x"]))
    docs = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, mark long, text string")
    prints = line_dedup._fingerprints(docs, 50).cache()
    assert prints.count() < len(lines) / 3
    shared = prints.groupBy("print").agg(F.sum("times").alias("n")).filter("n > 1").select("print")
    some = line_dedup._windows_of(prints, shared)
    assert 40 <= some.count() <= 300 and line_dedup._windows_of(prints, shared.filter("false")).count() == 0
    got = {r["doc_id"]: r["removed"] for r in line_dedup.repeated_runs(docs).collect()}
    assert got == {10: list(range(50))}


def test_near_dedup_judges_rows_by_their_texts(spark):
    a, b, c = ("alpha beta gamma delta " * 9 + x for x in ("one", "two " * 30, "one"))
    docs = spark.createDataFrame([(2, a, "x"), (5, a, "y"), (5, b, "z"), (7, b + " end", "u"), (9, "q w e r t y", "v"), (9, "q w e r t y", "w"), (4, None, "n"), (4, None, "m"), (None, c, "o"), (None, "own text here", "p"), (None, "own text here", "p")], "doc_id long, text string, tag string")
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.near_dedup(docs).collect()), key=repr)
    assert got == sorted([(2, a), (5, b), (9, "q w e r t y"), (4, None), (4, None), (None, "own text here")], key=repr)


def test_near_dedup(spark, odd):
    rows = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_components(odd).collect()]
    assert len(rows) == len(ROWS) and (7, 1, 1) in rows and (2, 0, 2) in rows and (None, 1, None) in rows and (5, 59_996, 5) in rows
    assert near_dedup.near_components(odd.filter("false")).count() == near_dedup.near_dedup(odd.filter("false")).count() == 0


@pytest.mark.parametrize("exact", [False, True])
def test_near_dedup_finds_all_links_at_the_threshold(spark, exact):
    """Pairs a little above and below the threshold, of short and long sets, with words that many texts hold."""
    import random

    dice, texts = random.Random(5), []
    common = [f"c{k}" for k in range(60)]
    for k in range(120):
        base = [f"w{k}v{i}" for i in range(dice.choice([6, 30, 90, 300]))]
        if k % 4 == 0:
            base = common + base[:60]
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(max(1, int(len(base) * dice.uniform(0.005, 0.035)))):
                other[dice.randrange(len(other))] = f"x{dice.random()}"
            texts.append(other)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                links += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs, exact=exact).collect()}
    assert got == {k: find(k) for k in range(len(texts))} and 100 < links


@pytest.mark.parametrize("number", range(5))
def test_pipeline_stages(spark, number, tmp_path):
    """A stage takes odd rows and empty tables, and returns the columns of documents (the last: its own)."""
    name, stage = corpus_pipeline.STAGES[number]
    docs = spark.createDataFrame([(i, t, lang, None, len(t or "")) for i, t, lang, _ in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a text without an id"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert number == 4 or tuple(out.columns) == corpus_pipeline.COLUMNS
    # Two labels, one good: every text scores 0.5. Of near dedup, the four texts without words stay, and one of each other text.
    assert out.count() == {0: 0, 1: 11, 2: 9, 3: 10, 4: 11}[number]
    assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_only_forms_of_repeated_digests_move(spark):
    docs = spark.createDataFrame([(k, f"Text {k % 90}") for k in range(100)], "doc_id long, text string")
    digests = spark.createDataFrame([(fingerprints.digest(fingerprints.canonical(f"Text {k % 90}")),) for k in range(100)], "digest binary")
    moved = [bytes(r["digest"]) for r in fingerprints._forms(docs, fingerprints.digest, "text", fingerprints._repeated(digests)).collect()]
    assert sorted(moved) == sorted(2 * [fingerprints.digest(f"text {k}") for k in range(10)])
