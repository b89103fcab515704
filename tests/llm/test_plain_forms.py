"""Segmentations, and languages by compression, against plain forms that share no code with the operators."""

import random
import re

import pytest

from tessera.llm import language_id, piece_codec
from tessera.llm.queries import tokenizer_path

ALL = 2**64 - 1
GOLD, K0, K1, K2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xCA5A826395121157, 0xA0761D6478BD642F
TEXTS = [
    "the quick brown foxes were jumping over unbelievably lazy dogs", "  two  blanks ", "Grüße aus München und Österreich", "日本語 text \u2581 mixed 🎉🎉 x", "a", " ", "tab\tand\nline   feeds\n\n",
    "internationalization " * 40, "x" * 450 + " " + "ab" * 130, "\x00 odd \U0010ffff end", "",
]


def mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


@pytest.fixture(scope="module")
def model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plain_ids(model, known: dict[str, int], text: str, key: int, seed: int, dropout: float) -> list[int]:
    """The best candidate that is not skipped is merged, again and again, in one word after the other."""
    if not text:
        return []
    single = lambda c: c != "\u2581" and ("\u2581" if c == " " else c) in known
    words: list[str] = []
    for c in " " + text:
        before = words[-1][-1] if words else ""
        if not words or (c == " " and before != " ") or not single(c) or not single(before):
            words.append("")
        words[-1] += c
    out: list[int] = []
    salt = mixed((seed + GOLD) & ALL)
    for place, word in enumerate(words):
        if not single(word[0]):
            out += [model.piece_to_id(f"<0x{b:02X}>") for b in word.encode("utf-8", "surrogatepass")]
            continue
        content = sum(mixed((((ord(c) << 32) | i) * GOLD + K1) & ALL) for i, c in enumerate(word)) & ALL
        drawn = mixed((content + mixed((mixed((key + salt) & ALL) + place * K0) & ALL)) & ALL)
        kept = lambda a, b, e: mixed(drawn ^ mixed((a * K0 + b * K1 + e * K2 + GOLD) & ALL)) >= int(dropout * 2**64)  # noqa: B023, E731
        parts = [(i, i + 1) for i in range(len(word))]
        piece = lambda a, e: known.get(word[a:e].replace(" ", "\u2581"))  # noqa: B023, E731
        while True:
            offers = [(-model.get_score(piece(a, e)), piece(a, e), k) for k, ((a, b), (_, e)) in enumerate(zip(parts, parts[1:])) if piece(a, e) is not None and kept(a, b, e)]
            if not offers:
                break
            k = min(offers)[2]
            parts[k : k + 2] = [(parts[k][0], parts[k + 1][1])]
        out += [piece(a, e) for a, e in parts]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.95])
@pytest.mark.parametrize("size", [5, 100_000])
def test_segmentations_equal_plain_merging(model, monkeypatch, dropout, size):
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    monkeypatch.setattr(piece_codec, "SLICE", size)
    codec = piece_codec.PieceCodec(tokenizer_path("piece_bpe_32k.model"))
    got = codec.encode(TEXTS, seed=11, dropout=dropout, keys=range(100, 100 + len(TEXTS)))
    for k, (text, ids) in enumerate(zip(TEXTS, got)):
        assert ids.tolist() == plain_ids(model, known, text, 100 + k, 11, dropout), text[:40]
        assert codec.decode(ids) == text


def test_parts_are_joined_by_blanks(monkeypatch):
    rnd = random.Random(3)
    for size in (1, 2, 7):
        monkeypatch.setattr(piece_codec, "SLICE", size)
        for _ in range(300):
            text = "".join(rnd.choice("ab  ") for _ in range(rnd.randrange(40)))
            parts = list(piece_codec._parts(text))
            assert " ".join(parts) == text and (text == "") == (parts == [])
            assert all(not p.endswith(" ") for p in parts[:-1])


def test_languages_equal_plain_compression(spark):
    import zstandard as z

    rnd = random.Random(4)
    words = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdei"), ("bb", "abfghi"), ("cc", "klmnoe"))}
    said = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    model = language_id.fit(spark.createDataFrame([(said(lang, 40), lang) for lang in words for _ in range(30)], "text string, lang string"))
    mixture = [f"{said('aa', k)}, {said('bb', 12 - k)}! 12 {said('cc', k % 3)}" for k in range(13)]
    texts = [said(lang, n).upper() for lang in words for n in (1, 3, 10, 200)] + mixture + ["123 !?", "", None, "zzz"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "n long, text string"), model, 0.02).orderBy("n").collect()
    settings = z.ZstdCompressionParameters.from_level(5, dict_size=96 << 10, write_content_size=False, write_checksum=False, write_dict_id=False)
    for text, row in zip(texts, got):
        folded = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
        if not folded:
            assert (row["lang_pred"], row["score"], row["accepted"]) == ("und", 0.0, False)
            continue
        sizes = []
        for place, (lang, content) in enumerate(model.items()):
            whole = z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=settings).compress(f" {folded} ".encode())
            sizes.append((len(whole), place, lang))
        (best, _, lang), (second, _, _) = sorted(sizes)[:2]
        assert row["lang_pred"] == lang and row["accepted"] == ((second - best) / second >= 0.02)
        assert row["score"] == pytest.approx(min(1.0, 0.5 + 5 * (second - best) / second))
    assert {r["accepted"] for r in got} == {True, False}
