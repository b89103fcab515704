
import math
import random
from urllib.parse import urldefrag, urljoin, urlsplit

from tessera.llm import line_dedup, near_dedup, piece_codec, url_filters
from tessera.llm.queries import tokenizer_path


def all_repeated_lines(texts: dict[int, str], min_words: int = 50) -> dict[int, set[int]]:
    """Lines inside any run of min_words words that an earlier text, or an earlier place of the text, holds as well."""
    lines = {i: [tuple(x.lower().split()) for x in t.split("\n")] for i, t in texts.items()}
    gone = {i: set() for i in texts}
    for i, mine in lines.items():
        for j in (j for j in lines if j <= i):
            for a in range(len(mine)):
                for b in range(a if i == j else len(lines[j])):
                    n = 0
                    while a + n < len(mine) and b + n < len(lines[j]) and mine[a + n] == lines[j][b + n]:
                        n += 1
                    if sum(map(len, mine[a : a + n])) >= min_words:
                        gone[i] |= set(range(a, a + n))
    return gone


def test_op7_first_holder_of_a_part_hides_no_run(spark):
    """X alone, then X, Y in two texts; and texts of few lines in many orders, with blank lines and repeats within them."""
    dice, texts = random.Random(7), {}
    for k in range(40):
        x, y = (" ".join(f"{c}{k}w{i}" for i in range(30)) for c in "xy")
        texts |= {10 * k + 1: x, 10 * k + 2: f"a\n{x}\n{y}", 10 * k + 3: f"{x}\n{y}\nb", 10 * k + 4: f"{x}\n\nc\n{x}\n{y}\n"}
    pool = ["", *(" ".join(f"p{k}q{i}" for i in range(n)) for k, n in enumerate((1, 5, 12, 20, 24, 26, 30, 49, 50)))]
    texts |= {1000 + k: "\n".join(dice.choices(pool, k=dice.randint(1, 9))) for k in range(60)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: set(r["removed_lines"]) for r in line_dedup.line_dedup(docs).collect()}
    assert got == all_repeated_lines(texts)


def test_op4_every_occurrence_has_its_own_draws(monkeypatch):
    """A merge is dropped at the rate, a word has more than a few segmentations, and what is shared is what agendas of their own give."""
    codec = piece_codec.PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    assert codec.char[ord("a")] >= 0 and int(codec.char[ord(piece_codec.MARK)]) * codec.size + int(codec.char[ord("a")]) in codec.pairs
    texts = [" ".join(["a"] * 500)] * 20
    dropped = sum(len(ids) - 500 for ids in codec.encode(texts, seed=20, dropout=0.1))
    assert 0.08 * 10_000 < dropped < 0.12 * 10_000
    assert len({tuple(ids.tolist()) for ids in codec.encode(["information"] * 500, seed=20, dropout=0.1)}) > 8
    mixed = ["the information of the information, straße 日本語 😀 ▁ \x01 the end"] * 5 + ["x" * 300 + " the " + "x" * 300]
    shared = [codec.encode(mixed, seed=3, dropout=rate) for rate in (0.1, 0.5, 0.0)]
    monkeypatch.setattr(piece_codec, "LONG", 0)
    for rate, ids in zip((0.1, 0.5, 0.0), shared):
        alone = codec.encode(mixed, seed=3, dropout=rate)
        assert [i.tolist() for i in ids] == [i.tolist() for i in alone] and [codec.decode(i) for i in ids] == mixed


def test_op10_unlucky_union_sketch_keeps_the_pair(spark):
    """38 of 64 common values happen at the threshold in 1 of 8,000 pairs, 29 in less than 1 of a milliard."""
    def pair(common):
        a, b = list(range(64)), sorted([*range(common), *range(64, 128 - common)])
        return (a, b, 1000, 1000, [0] * 8, [0] * 8, common)

    kinds = "a_sketch array<long>, b_sketch array<long>, a_n long, b_n long, a_odd array<long>, b_odd array<long>, common int"
    kept = near_dedup._estimated(spark.createDataFrame([pair(k) for k in (20, 32, 38, 60)], kinds), 80, 64)
    assert {r["common"] for r in kept.select("common").collect()} == {32, 38, 60}
    low = near_dedup.least_common(80, 64)
    assert sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(low)) < 1e-9


def test_op9_verdicts_spread_over_every_form_of_link(spark):
    """Chains, relative targets, other case and fragments, a blocked alias that is no page, and an explicit allow."""
    links = [
        ("http://a.org/x/1.html", "next.html"), ("http://a.org/x/next.html", "../y/./z?p=1#top"), ("http://a.org/y/z?p=1", "HTTP://Bad.org/q"),
        ("http://b.org/d/e", "?p=2"), ("http://b.org/d/e?p=2", "//BAD.org/r"), ("http://c.org", "./x"), ("http://C.org/x#f", "/../bad"),
        ("http://c.org/bad", "http://bad.org"), ("http://ok.org/a", "http://bad.org/"), ("http://d.org/a", "b/.."), ("http://d.org/", "#x"),
        ("http://e.org/go?u=http://x", "?u=http://y"), ("http://e.org/go?u=http://y", "mailto:bad@bad.org"),
    ]
    tag = ('<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">')
    rules = [("bad.org", "", "block"), ("ok.org", "", "allow")]
    pages = spark.createDataFrame([(k, u, tag[k % 2] % t) for k, (u, t) in enumerate(links)], "page_id long, url string, html string")
    got = {r["url"]: r["verdict"] for r in url_filters.judge_pages(pages, rules).collect()}

    def key(u):
        p = urlsplit(urldefrag(u).url)
        return f"{p.scheme.lower()}://{p.netloc.lower()}{p.path or '/'}" + (f"?{p.query}" if p.query else "")

    groups = [{key(u), key(urljoin(u, t))} for u, t in links if not t.startswith("mailto:")]
    for _ in groups:
        groups = [set().union(*(h for h in groups if g & h)) for g in groups]
    bad = {n for g in groups for n in g if any(urlsplit(m).netloc == "bad.org" for m in g)}
    assert got == {u: "allow" if "ok.org" in u or key(u) not in bad else "block" for u, _ in links}
    assert sum(v == "block" for v in got.values()) == 8
