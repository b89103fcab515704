"""Token-ID files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of many documents end to end, in blocks of BLOCK ids. A block stores its minimum, and the
differences to it packed in bit planes of a width that is a percentile of their bit lengths: of WIDTHS the one that makes the
block smallest. Differences that don't fit go to an exception list of positions and values. The footer holds the
starts of all blocks and the documents' ids and lengths, so any document can be read without the blocks before it.

    "TSPFOR1\\n" | blocks | starts u64[n_blocks + 1] | doc ids i64[n] | nulls u8[n] | lengths u32[n] | n_blocks u64 | n u64
    block: minimum u32 | count u16 | exceptions u16 | width u8 | planes | exception positions u16 | exception values u32
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import pieces, shared_dir

MAGIC = b"TSPFOR1\n"
BLOCK = 1 << 14
WIDTHS = (90, 95, 99, 100)  # percentiles of bit lengths
PART = 8 << 20  # bytes of text encoded at once: the more, the fewer words are met again
_HEAD = struct.Struct("<IHHB")


def encode_block(ids: np.ndarray) -> bytes:
    """One block of 1 to BLOCK unsigned 32-bit ids."""
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    bits = np.frexp(rest.astype(np.float64))[1]  # bit lengths
    upto = np.cumsum(np.bincount(bits, minlength=33))
    n, best = len(ids), None
    for p in WIDTHS:
        width = int(np.searchsorted(upto, -(-n * p // 100)))
        cost = width * ((n + 7) // 8) + 6 * (n - int(upto[width]))
        if best is None or cost < best[0]:
            best = (cost, width)
    width = best[1]
    out = np.flatnonzero(bits > width)
    kind = np.uint16 if width <= 16 else np.uint32
    planes = np.packbits((rest.astype(kind)[None, :] >> np.arange(width, dtype=kind)[:, None] & kind(1)).astype(np.uint8), axis=1)
    return _HEAD.pack(low, n, len(out), width) + planes.tobytes() + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    """The ids of one block."""
    low, n, over, width = _HEAD.unpack_from(data)
    row, at = (n + 7) // 8, _HEAD.size
    planes = np.unpackbits(np.frombuffer(data, np.uint8, width * row, at).reshape(width, row), axis=1, count=n)
    kind = np.uint16 if width <= 16 else np.uint32
    rest = np.zeros(n, kind)
    for k in range(width):
        rest |= planes[k].astype(kind) << kind(k)
    rest = rest.astype(np.uint32)
    at += width * row
    places = np.frombuffer(data, "<u2", over, at)
    rest[places] = np.frombuffer(data, "<u4", over, at + 2 * over)
    return rest + np.uint32(low)


class Writer:
    """Writes documents' ids to a binary stream, holding one block and the footer's numbers in memory."""

    def __init__(self, stream):
        self.stream, self.at, self.rest, self.held = stream, len(MAGIC), [], 0
        self.starts, self.docs, self.lengths, self.total = [], [], [], 0
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            held = np.concatenate(self.rest)
            cut = self.held - self.held % BLOCK
            for k in range(0, cut, BLOCK):
                self._block(held[k : k + BLOCK])
            self.rest, self.held = [held[cut:]], self.held - cut

    def _block(self, ids: np.ndarray) -> None:
        data = encode_block(ids)
        self.starts.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        self.starts.append(self.at)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        for part in (np.array(self.starts, "<u8"), docs, nulls, np.array(self.lengths, "<u4"), np.array([len(self.starts) - 1, len(docs)], "<u8")):
            self.stream.write(part.tobytes())


class Reader:
    """Reads a file of Writer; `documents` streams it, `document` fetches one by its number in the file."""

    def __init__(self, stream, size: int):
        self.stream = stream
        blocks, n = np.frombuffer(self._at(size - 16, 16), "<u8").tolist()
        footer = self._at(size - 16 - 8 * (blocks + 1) - 13 * n, 8 * (blocks + 1) + 13 * n)
        self.starts = np.frombuffer(footer, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        nulls = np.frombuffer(footer, np.uint8, n, at + 8 * n)
        self.docs = [None if z else i for i, z in zip(np.frombuffer(footer, "<i8", n, at).tolist(), nulls.tolist())]
        self.lengths = np.frombuffer(footer, "<u4", n, at + 9 * n).astype(np.int64)

    def _at(self, start: int, length: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(length)

    def _blocks(self, first: int, last: int) -> Iterator[np.ndarray]:
        for k in range(first, last):
            yield decode_block(self._at(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])))

    def document(self, number: int) -> np.ndarray:
        start = int(self.lengths[:number].sum())
        end = start + int(self.lengths[number])
        first, last = start // BLOCK, -(-end // BLOCK)
        if first >= last:
            return np.empty(0, np.uint32)
        return np.concatenate(list(self._blocks(first, last)))[start - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        blocks, held = self._blocks(0, len(self.starts) - 1), np.empty(0, np.uint32)
        for doc, n in zip(self.docs, self.lengths.tolist()):
            parts, have = [held], len(held)
            while have < n:
                parts.append(next(blocks))
                have += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]


_TAIL = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ɏ]([.,!?;:|&%$#*]+)$")
_MARKS = frozenset(bytes([c]) for c in b".,!?;:|&%$#*")

#: The parts of a tokenizer's description for which WordEncoder's cuts hold.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


def cuts_hold(description: dict) -> bool:
    """Whether a tokenizer (its JSON) folds case, never joins over white space, splits letters from marks and ends words by </w>.

    Special tokens must be of the kind <|...|>, whose text WordEncoder leaves as it is.
    """
    model, pre = description["model"], description["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers", [])
    return (
        description["normalizer"] == _NORMALIZER
        and len(steps) == 2
        and steps[0] == _SPLIT
        and steps[1]["type"] == "ByteLevel"
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and model["type"] == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not (model.get("dropout") or model.get("unk_token") or model.get("ignore_merges"))
        and all(t["content"].startswith("<|") and t["content"].endswith("|>") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in description["added_tokens"])
    )


def _plain_end(c: str) -> bool:
    """Whether a character is of letters or digits alone in small letters as well (İ becomes a letter and a mark)."""
    return c.isalnum() and c.lower().isalnum()


def _latin_letters(word: bytes) -> bool:
    """Whether a word is of Latin letters alone, in small letters as well."""
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return max(text) < "ɐ" and text.isalpha() and text.lower().isalpha()


class TextEncoder:
    """ids of whole texts under any tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def __call__(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """Each UTF-8 text's ids, with `end` behind them."""
        return [np.array([*e.ids, end], "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]


class WordEncoder(TextEncoder):
    """ids of texts under a tokenizer for which cuts_hold.

    Each different word is encoded once. Words are cut at blanks and line ends; what is cut off behind a letter or digit
    (full stops and the like) is a piece of its own in such tokenizers. Words are cached up to `most`; then those of
    the texts at hand stay, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 300_000):
        super().__init__(path)
        self.most = most
        self.ends = np.array([self.tokenizer.id_to_token(i).endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.words: dict[bytes, bytes] = {}

    def _encode(self, pieces: list[bytes]) -> None:
        """Learn pieces. Those of letters alone are encoded many at a time: each is one word to the tokenizer, whose last token says so."""
        plain, other = [], []
        for p in pieces:
            (plain if _latin_letters(p) else other).append(p)
        for k in range(0, len(plain), 1000):
            run = plain[k : k + 1000]
            ids = np.array(self.tokenizer.encode(b" ".join(run).decode(), add_special_tokens=False).ids, "<u4")
            data, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            self.words.update(zip(run, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        for k in range(0, len(other), 1000):
            run = other[k : k + 1000]
            for p, e in zip(run, self.tokenizer.encode_batch_fast([p.decode() for p in run], add_special_tokens=False)):
                self.words[p] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, new: set[bytes]) -> None:
        cut = []
        for w in new:
            if w[-1:] in _MARKS and (m := _TAIL.search(text := w.decode())) and _plain_end(text[m.start()]):
                cut.append((w, text[: m.start(1)].encode(), m[1].encode()))
        wanted = new.difference(w for w, _, _ in cut)
        for _, stem, tail in cut:
            wanted.add(stem)
            wanted.add(tail)
        words = self.words
        self._encode(list(wanted.difference(words)))
        words.update((w, words[stem] + words[tail]) for w, stem, tail in cut)

    def __call__(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """Each UTF-8 text's ids, with `end` behind them."""
        # A-Z can be folded beforehand, but not where that could make a special token, nor before a combining mark
        # (U+0300 to U+036F): j and a caron have a composed form, J and a caron have none.
        split = [(t if b"<|" in t or b"\xcc" in t or b"\xcd" in t else t.lower()).replace(b"\n", b" ").split(b" ") for t in texts]
        here = set().union(*split)
        if len(self.words) > self.most:  # the words that go on occurring stay
            self.words = {w: self.words[w] for w in here.intersection(self.words)}
        known = self.words
        new = here.difference(known)
        if new:
            self._learn(new)
        last = np.array([end], "<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, words)) + last, "<u4") for words in split]


_ENCODERS: dict[str, TextEncoder] = {}


def encoder_of(path: str) -> TextEncoder:
    """The Python worker's encoder for a tokenizer; its next tasks find the words that it knows."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            words = cuts_hold(json.load(f))
        _ENCODERS[path] = WordEncoder(path) if words else TextEncoder(path)
    return _ENCODERS[path]


def filesystem(uri: str):
    """The pyarrow filesystem and path of a shared folder's address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri) if ":" in uri else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer_path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order; returns the manifest part, path, n_docs, n_ids, base, in order.

    Every text is encoded without special tokens and `end` is appended; null counts as empty. A null doc_id comes first;
    rows that repeat a doc_id are in order of a hash of their text. One file per range of doc_id is written under
    `folder` (by default a new one in the shared folder): under another name first, then moved, so a task that is run
    again replaces a file by the same file. base is the number of ids in the files before. An empty table has no files.
    Texts are encoded whole, but under tokenizers for which cuts_hold, whose words are encoded once each. A text of any
    length is one row: its ids are held by one task, blocks and not files. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out = encoder = None
        for batch in batches:
            if not len(batch):
                continue
            if out is None:
                fs, path = filesystem(f"{folder}/part-{part:06d}.pfor")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                stream = fs.open_output_stream(f"{path}.{attempt}")
                out, encoder = Writer(stream), encoder_of(tokenizer_path)
            for part_of in pieces(batch, "text", PART):
                for i, x in zip(part_of.column("doc_id").to_pylist(), encoder(part_of.column("text").cast(pa.binary()).to_pylist(), end)):
                    out.add(i, x)
        if out is not None:
            out.close()
            stream.close()
            fs.move(f"{path}.{attempt}", path)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}.pfor"], "n_docs": [len(out.docs)], "n_ids": [out.total]})

    files = sorted(tuple(r) for r in rows.mapInArrow(run, "part long, path string, n_docs long, n_ids long").collect())
    bases = np.concatenate(([0], np.cumsum([f[3] for f in files], dtype=np.int64))).tolist()
    return spark.createDataFrame([(*f, b) for f, b in zip(files, bases)], "part long, path string, n_docs long, n_ids long, base long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files.

    Files are dealt out one by one and read as streams, a block at a time.
    """

    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, at in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as stream:
                    out = []
                    for doc, ids in Reader(stream, stream.size()).documents():
                        out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names)
                            out = []
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names)

    count = max(1, manifest.count())
    return manifest.select("path", "base").repartition(count).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
