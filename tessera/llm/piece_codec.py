"""SentencePiece encoding with seeded merge-dropout, and decoding without loss.

A merge-type (BPE) model joins neighbouring symbols into the piece of the best score until no candidate is left. Here
each candidate, known by its text's key, its word, the word's place in the text and its three bounds in the word, is
skipped if a keyed hash falls below the dropout rate. The hash depends on the candidate alone, so the agenda may pop
candidates in any order of discovery and the same seed always gives the same segmentation; every occurrence of a word
has draws of its own. With a rate of 0 the ids are those of the library, but for the word-boundary sign itself.

Words are what no piece crosses: a run of boundary signs with what follows it up to the next one, and each character
without a piece of its own, which becomes bytes. Agendas of all different words of a slice of texts are processed side
by side in arrays, without dropout first. An occurrence that skips none of the merges made there comes to the same
pieces, since what else it skips was never merged; every other occurrence has an agenda of its own. A word of over LONG
symbols has a heap of its own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import _GOLD, mix64, pieces

MARK = "▁"  # stands for a blank in pieces
LONG = 200
SLICE = 100_000  # code points encoded side by side
PART = 256 << 10  # bytes of text, or ids, taken from an Arrow batch at once

_K = [np.uint64(k) for k in (0xD6E8FEB86659FD93, 0xCA5A826395121157, 0xA0761D6478BD642F)]


_FIRST_BLANK = re.compile("(?<! ) ")


def _parts(text: str) -> Iterator[str]:
    """text in parts of about SLICE code points, to be joined by a blank: cut where a word begins with its first blank.

    An empty text has no parts: no text has no ids, not even the dummy prefix.
    """
    at = 0
    while cut := _FIRST_BLANK.search(text, at + SLICE):
        yield text[at : cut.start()]
        at = cut.end()
    if text:
        yield text[at:]


class PieceCodec:
    """A merge-type SentencePiece model with byte fallback, from its file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(size)]
        self.size = size
        self.bytes = np.array([next(i for i in range(size) if names[i] == f"<0x{b:02X}>") for b in range(256)], np.int64)
        ids = {p: i for i, p in enumerate(names) if plain[i]}
        self.text = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(names, plain)]
        for b, i in enumerate(self.bytes.tolist()):
            self.text[i] = bytes([b])
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {}
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = i
        self.pairs = pairs
        # The order of merges: better scores first; equal scores by id.
        order = sorted(ids.values(), key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(size, size, np.int64)
        self.rank[order] = np.arange(len(order))
        self.by_rank = np.array([*order, -1], np.int64)
        self.table_bits = max(4, int(4 * len(pairs)).bit_length())
        keys = np.array(list(pairs), np.int64)
        self.table_keys, self.table_ranks = np.full((1 << self.table_bits) + len(pairs) + 1, -1, np.int64), np.zeros((1 << self.table_bits) + len(pairs) + 1, np.int64)
        for at, key, piece in zip(self._place(keys).tolist(), pairs, pairs.values()):
            while self.table_keys[at] >= 0:
                at += 1
            self.table_keys[at], self.table_ranks[at] = key, self.rank[piece]

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _GOLD) >> np.uint64(64 - self.table_bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that a and b make, or `size` if there is none: probes a table with linear steps."""
        key = a.astype(np.int64) * self.size + b
        at = self._place(key)
        seen = self.table_keys[at]
        out = np.where(seen == key, self.table_ranks[at], self.size)
        left = np.flatnonzero((seen != key) & (seen >= 0))
        while len(left):
            at[left] += 1
            seen = self.table_keys[at[left]]
            hit = seen == key[left]
            out[left[hit]] = self.table_ranks[at[left[hit]]]
            left = left[~hit & (seen >= 0)]
        out[(a < 0) | (b < 0)] = self.size
        return out

    @staticmethod
    def _bounds(start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the candidate's bounds."""
        return mix64(start.astype(np.uint64) * _K[0] + middle.astype(np.uint64) * _K[1] + end.astype(np.uint64) * _K[2] + _GOLD)

    def _skipped(self, word: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: np.uint64) -> np.ndarray:
        """Whether the candidate's keyed hash falls below the limit."""
        return mix64(word ^ self._bounds(start, middle, end)) < limit

    def _long_word(self, symbols: list[int], key: int, limit: np.uint64) -> list[int]:
        """One word's agenda on a heap: same candidates, order and skips as side by side."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live, agenda, k = list(symbols), [], np.array([key], np.uint64)

        def offer(i: int) -> None:
            j = after[i]
            piece = self.pairs.get(live[i] * self.size + live[j]) if j < n and live[i] >= 0 and live[j] >= 0 else None
            if piece is not None and not (limit and self._skipped(k, np.array([i]), np.array([j]), np.array([after[j]]), limit)[0]):
                heapq.heappush(agenda, (int(self.rank[piece]), i, j, after[j], piece))

        for i in range(n - 1):
            offer(i)
        gone = [False] * n
        while agenda:
            _, i, j, e, piece = heapq.heappop(agenda)
            if gone[i] or j >= n or gone[j] or after[i] != j or after[j] != e:
                continue
            live[i], gone[j], after[i] = piece, True, e
            if e < n:
                before[e] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [live[i] for i in range(n) if not gone[i]]

    def _agendas(self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of many words end to end, how many each has, and word and hash of bounds of each merge that was made, by word."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        start = np.arange(len(symbols)) - begins[word]
        live, none = symbols.copy(), self.size
        done_word, done_start, done_piece, merged_word, merged_bounds = [], [], [], [], []

        def ends(j: np.ndarray) -> np.ndarray:
            """Where the symbols behind those at j end, in their words."""
            after = np.minimum(j + 2, len(live) - 1)
            return np.where((j + 2 < len(live)) & (word[after] == word[j]), start[after], lengths[word[j]])

        def ranked(at: np.ndarray) -> np.ndarray:
            """The ranks of the candidates that start at these places; none where there is no candidate or it is skipped."""
            out = np.full(len(at), none)
            pair = np.flatnonzero((at + 1 < len(live)) & (word[at] == word[np.minimum(at + 1, len(live) - 1)]))
            i = at[pair]
            found = self._ranks(live[i], live[i + 1])
            if limit:
                ok = np.flatnonzero(found < none)
                j = i[ok]
                found[ok[self._skipped(keys[word[j]], start[j], start[j + 1], ends(j), limit)]] = none
            out[pair] = found
            return out

        rank = ranked(np.arange(len(live)))
        while len(live):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(word))))
            settled = best == none
            if settled.any():
                done_word.append(word[settled])
                done_start.append(start[settled])
                done_piece.append(live[settled])
            hit = np.flatnonzero((rank == best) & ~settled)
            hit = hit[np.append(True, word[hit[1:]] != word[hit[:-1]])] if len(hit) else hit  # the leftmost of each word
            if not limit and len(hit):
                merged_word.append(word[hit])
                merged_bounds.append(self._bounds(start[hit], start[hit + 1], ends(hit)))
            live[hit] = self.by_rank[rank[hit]]
            keep = ~settled
            keep[hit + 1] = False
            moved = (np.cumsum(keep) - 1)[hit]
            live, word, start, rank = live[keep], word[keep], start[keep], rank[keep]
            # Only the merged symbols and those before them have new candidates.
            before = moved[(moved > 0)]
            before = before[word[before - 1] == word[before]] - 1
            at = np.concatenate((moved, before))
            rank[at] = ranked(at)
        words, starts, pieces = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (done_word, done_start, done_piece))
        order = np.lexsort((starts, words))
        merged = np.concatenate(merged_word) if merged_word else np.empty(0, np.int64)
        bounds = np.concatenate(merged_bounds) if merged_bounds else np.empty(0, np.uint64)
        by_word = np.argsort(merged, kind="stable")
        return pieces[order], np.bincount(words, minlength=len(lengths)), merged[by_word], bounds[by_word]

    def encode(self, texts: Sequence[str], seed: int = 0, dropout: float = 0.0, keys: Sequence[int] | None = None) -> list[np.ndarray]:
        """Each text's ids. keys (one integer a text, by default its place) key its draws, with the seed.

        Some SLICE code points are worked on at once, of long texts a part after the other; the memory that this takes
        grows with the longest word, not with the text.
        """
        keys = list(range(len(texts)) if keys is None else keys)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        places = [0] * len(texts)  # words of each text that are done
        held: list[tuple[int, str]] = []

        def flush() -> None:
            if held:
                which = [k for k, _ in held]
                made, words = self._slice([part for _, part in held], [keys[k] for k in which], [places[k] for k in which], seed, dropout)
                for k, ids, n in zip(which, made, words.tolist()):
                    out[k].append(ids)
                    places[k] += n
                held.clear()

        size = 0
        for k, text in enumerate(texts):
            for part in _parts(text):
                if held and (size > SLICE or held[-1][0] == k):
                    flush()
                    size = 0
                held.append((k, part))
                size += len(part) + 1
        flush()
        return [ids[0] if len(ids) == 1 else np.concatenate(ids) if ids else np.empty(0, np.int64) for ids in out]

    def _slice(self, texts: Sequence[str], keys: Sequence[int], places: Sequence[int], seed: int, dropout: float) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of texts, or parts, of which so many words were before, and how many words each has."""
        joined = " " + " ".join(texts)  # the blank in front of each text is the model's dummy prefix
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = points == 32
        symbol = self.char[np.where(blank, ord(MARK), points)]
        symbol[points == ord(MARK)] = -1  # a literal boundary sign must not come back as a blank: it becomes bytes
        raw = symbol < 0
        begin = np.zeros(len(points), bool)
        begin[1:] = (blank[1:] & ~blank[:-1]) | raw[1:] | raw[:-1]
        starts_of_text = np.concatenate(([0], ends[:-1]))
        begin[starts_of_text] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(np.append(starts, len(points)))
        text = np.searchsorted(ends, starts, side="right")
        place = np.arange(len(starts)) - np.searchsorted(starts, starts_of_text)[text] + np.array(places, np.int64)[text]
        salt = mix64(np.array([seed & (2**64 - 1)], np.uint64) + _GOLD)
        base = np.array([k & (2**64 - 1) for k in keys], np.uint64)
        inner = (np.arange(len(points)) - np.repeat(starts, lengths)).astype(np.uint64)
        content = np.add.reduceat(mix64((points.astype(np.uint64) << np.uint64(32) | inner) * _GOLD + _K[1]), starts)
        _, first, which = np.unique(content, return_index=True, return_inverse=True)
        # Equal hashes must be equal words: compare every word with the one that stands for it, symbol by symbol.
        same = lengths == lengths[first][which]
        shift = np.repeat(starts[first][which] - starts, np.where(same, lengths, 0))
        mine = np.flatnonzero(np.repeat(same, lengths))
        if not same.all() or (points[mine] != points[mine + shift]).any():
            first, which = np.arange(len(starts)), np.arange(len(starts))
        limit = np.uint64(min(2**64 - 1, int(dropout * 2**64)))
        drawn = mix64(content + mix64(mix64(base[text] + salt) + place.astype(np.uint64) * _K[0]))  # an occurrence's key

        def agendas(at: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            n = lengths[at]
            take = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
            return self._agendas(symbol[take], n, drawn[at], limit)

        fallback = raw[starts[first]]
        long = ~fallback & (lengths[first] > LONG)
        short = np.flatnonzero(~fallback & ~long)
        pieces, counts, merged, bounds = agendas(first[short], np.uint64(0))
        again = np.empty(0, np.int64)  # occurrences with agendas of their own
        if limit:
            merges = np.zeros(len(first), np.int64)
            merges[short] = np.bincount(merged, minlength=len(short))
            n = merges[which]
            word = np.repeat(np.arange(len(starts)), n)
            at = np.repeat((np.cumsum(merges) - merges)[which] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
            skips = np.zeros(len(starts), bool)
            skips[word[mix64(drawn[word] ^ bounds[at]) < limit]] = True
            again = np.flatnonzero(skips)
        begins = np.zeros(len(first), np.int64)
        sizes = np.zeros(len(first), np.int64)
        begins[short], sizes[short] = np.concatenate(([0], np.cumsum(counts)))[:-1], counts
        parts, total = [pieces], len(pieces)
        if len(again):
            pieces, counts = agendas(again, limit)[:2]
            which[again] = len(begins) + np.arange(len(again))
            begins, sizes = np.append(begins, total + np.cumsum(counts) - counts), np.append(sizes, counts)
            parts.append(pieces)
            total += len(pieces)
        for u in np.flatnonzero(fallback).tolist():
            made = self.bytes[list(chr(int(points[starts[first[u]]])).encode("utf-8", "surrogatepass"))]
            begins[u], sizes[u] = total, len(made)
            parts.append(made)
            total += len(made)
        heaps = np.flatnonzero(~raw[starts] & (lengths > LONG)) if limit else first[long]
        if len(heaps):
            if limit:
                which[heaps] = len(begins) + np.arange(len(heaps))
                begins, sizes = np.append(begins, np.zeros(len(heaps), np.int64)), np.append(sizes, np.zeros(len(heaps), np.int64))
            for o in heaps.tolist():
                made = np.array(self._long_word(symbol[starts[o] : starts[o] + lengths[o]].tolist(), int(drawn[o]), limit), np.int64)
                begins[which[o]], sizes[which[o]] = total, len(made)
                parts.append(made)
                total += len(made)
        pool = np.concatenate(parts)
        n = sizes[which]
        ids = pool[np.repeat(begins[which] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))]
        cuts = np.cumsum(np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64))
        return np.split(ids, cuts[:-1]), np.bincount(text, minlength=len(texts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that encode made: pieces and bytes joined, without the blank in front."""
        return b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _encoded(codec: PieceCodec, batches, seed: int, dropout: float):
    """The Arrow batches, in bounded parts, with ids in place of _key."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in pieces(whole, "text", PART)):
        texts, keys = batch.column("text").to_pylist(), batch.column("_key").to_pylist()
        made = codec.encode([t or "" for t in texts], seed, dropout, keys)
        ids = pa.array([None if t is None else i.astype(np.int32) for t, i in zip(texts, made)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["_key"]).columns, ids], [n for n in batch.schema.names if n != "_key"] + ["ids"])


def _decoded(codec: PieceCodec, batches):
    """The Arrow batches, in bounded parts, with decoded behind."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in pieces(whole, "ids", PART)):
        texts = [None if not i.is_valid else codec.decode(i.values.to_numpy()) for i in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which keys a text's draws."""
    return docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if "doc_id" in docs.columns else F.lit(0).cast("long"))


def _kinds(df: DataFrame) -> str:
    return "".join(f"`{n}` {t}, " for n, t in df.dtypes)


def encode(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """docs with a column ids (an older one is replaced): the ids of each whole text.

    A null text has null ids, an empty one none. doc_id, where there is one, keys a text's draws; a null doc_id counts
    as 0, so equal texts of equal doc_id are encoded alike. A very long text is encoded part by part, with the same ids.
    An empty table stays empty.
    """
    docs = docs.drop("ids", "_key")
    return _keyed(docs).mapInArrow(lambda batches: _encoded(PieceCodec(path), batches, seed, dropout), _kinds(docs) + "ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with a column decoded (an older one is replaced): the text of its ids; null for null ids."""
    encoded = encoded.drop("decoded")
    return encoded.mapInArrow(lambda batches: _decoded(PieceCodec(path), batches), _kinds(encoded) + "decoded string")


def round_trip(docs: DataFrame, path: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """decode(encode(docs)) in one pass, rows of any kind as there: each task has one Python worker, with one codec, instead of two."""
    docs = docs.drop("ids", "_key", "decoded")

    def run(batches):
        codec = PieceCodec(path)
        yield from _decoded(codec, _encoded(codec, batches, seed, dropout))

    return _keyed(docs).mapInArrow(run, _kinds(docs) + "ids array<int>, decoded string")
