"""Document fingerprints: a canonical exact digest.

A text's canonical form is NFKC-normalised and case-folded until stable, with every run of white space one blank and none at
the ends. Its fingerprint is the form's 128-bit xxh3 hash in hex. Forms are grouped by hash, and the bytes within a
group are compared: were two different forms to share a hash, all but the least would get a suffix -1, -2, ... in
order of their bytes, so equal fingerprints mean equal forms and the other way round.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, pieces, presence_size, present

CHECK_SEED = 0x5EED  # of the second hash


def canonical(text: str | None) -> str:
    """The canonical form; null gives the empty one."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(unicodedata.normalize("NFKC", folded.casefold()).split())


def digest(form: str) -> bytes:
    """128 bits of xxh3 over the form's UTF-8."""
    import xxhash

    return xxhash.xxh3_128_digest(form.encode())


def _place(digest: bytes, size: int) -> int:
    """The bit of a digest in a bitmap of so many."""
    import xxhash

    return xxhash.xxh3_64_intdigest(digest) % size


def _repeated(digests: DataFrame) -> tuple[int, np.ndarray] | None:
    """Size and bits (see present) of a bitmap of the digests that more than one row has; None if they are too many for one.

    A digest of one row needs no comparison, so its form need not move. The driver gets words of 62 bits, of which there
    are MOST_BITS / 62 at most.
    """
    several = materialise(digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "repeated-digests")
    size = presence_size(several.count())
    if size is None:
        return None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_place(d, size) for d in batch.column("digest").to_pylist()], pa.int64())], ["p"])

    words = several.mapInArrow(run, "p long").groupBy(F.floor(F.col("p") / 62).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 62 as int)))").alias("bits"))
    bits = np.zeros(size // 62 + 1, np.int64)
    for word, b in words.collect():
        bits[word] = b
    return size, bits


def _forms(docs: DataFrame, hashed: Callable[[str], bytes], text: str, among: tuple[int, np.ndarray] | None = None) -> DataFrame:
    """digest and packed: each text's form, compressed for the way; one encoder gives equal bytes for equal forms only.

    among: only forms whose digest may be in this bitmap (of _repeated).
    """
    known = docs.sparkSession.sparkContext.broadcast(among) if among else None

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in (part for whole in batches for part in pieces(whole, text)):
            forms = [canonical(t) for t in batch.column(text).to_pylist()]
            digests = [hashed(f) for f in forms]
            if known:
                size, bits = known.value
                kept = present(bits, np.array([_place(d, size) for d in digests], np.int64)).tolist()
                forms, digests = [f for f, k in zip(forms, kept) if k], [d for d, k in zip(digests, kept) if k]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([pack.compress(f.encode()) for f in forms], pa.binary())], ["digest", "packed"])

    return docs.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "digest binary, packed binary")


def _numbered(forms: DataFrame, shared: DataFrame) -> DataFrame:
    """digest, form, place: the different forms of the shared digests, numbered from 0 by their bytes."""

    def unpack(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdDecompressor()
        for batch in (part for whole in batches for part in pieces(whole, "packed")):
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([pack.decompress(p) for p in batch.column("packed").to_pylist()], pa.binary())], ["digest", "form"])

    several = forms.join(shared, "digest", "left_semi").distinct().mapInArrow(unpack, "digest binary, form binary")
    several = materialise(several, "shared-forms")
    before = several.select("digest", F.col("form").alias("other"))
    numbered = several.join(before, "digest").groupBy("digest", "form").agg(F.sum(F.expr("case when other < form then 1 else 0 end")).cast("long").alias("place"))
    return materialise(numbered, "collisions")


def _shared(forms: DataFrame) -> DataFrame:
    """The digests that more than one form has.

    Equal forms are merged before and after the shuffle, by their bytes, so a large group of copies moves as one row a
    task: the least and greatest bytes differ where a digest has more than one form.
    """
    ends = forms.groupBy("digest").agg(F.min("packed").alias("least"), F.max("packed").alias("most"))
    return materialise(ends.filter("least <> most").select("digest"), "shared-digests")


def collisions(docs: DataFrame, hashed: Callable[[str], bytes] = digest, text: str = "text") -> DataFrame:
    """digest, form, place: the canonical forms that share their digest with another one, numbered from 0 by their bytes."""
    forms = _forms(docs, hashed, text)
    shared = _shared(forms)
    if shared.isEmpty():
        return docs.sparkSession.createDataFrame([], "digest binary, form binary, place long")
    return _numbered(forms, shared)


def _named(rows: DataFrame, clashes: DataFrame, digest_col: str, form_col: str, out: str) -> DataFrame:
    """rows with digest_col as hex in `out`, and the suffix of its form where forms clash."""
    names = clashes.select(F.col("digest").alias("_digest"), F.col("form").alias("_form"), F.col("place").alias("_place"))
    joined = rows.join(names, (rows[digest_col] == F.col("_digest")) & (rows[form_col] == F.col("_form")), "left")
    suffix = F.when(F.col("_place") > 0, F.concat(F.lit("-"), F.col("_place").cast("string"))).otherwise(F.lit(""))
    return joined.withColumn(out, F.concat(F.lower(F.hex(digest_col)), suffix)).drop("_digest", "_form", "_place")


def fingerprint(docs: DataFrame, hashed: Callable[[str], bytes] = digest) -> DataFrame:
    """docs with a column fingerprint (an older one of that name is replaced).

    Null texts count as empty and share the empty form's fingerprint; an empty table stays empty.
    """

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole, "text")):
            forms = [canonical(t) for t in batch.column("text").to_pylist()]
            extra = [pa.array([hashed(f) for f in forms], pa.binary()), *([pa.array([f.encode() for f in forms], pa.binary())] if clash else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_hash", *(["_bytes"] if clash else [])])

    clashes = collisions(docs, hashed)
    clash = not clashes.isEmpty()
    docs = docs.drop("fingerprint", "_hash", "_bytes")
    kinds = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    rows = docs.mapInArrow(run, f"{kinds}, _hash binary" + (", _bytes binary" if clash else ""))
    if not clash:
        return rows.withColumn("fingerprint", F.lower(F.hex("_hash"))).drop("_hash")
    return _named(rows, clashes, "_hash", "_bytes", "fingerprint").drop("_hash", "_bytes")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id: the least doc_id whose text has the same canonical form, one row per row of docs."""
    marked = materialise(fingerprint(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "fingerprints")
    least = materialise(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id")), "groups")
    return marked.join(least, "fingerprint").select("doc_id", "fingerprint", "group_id")


LOWEST = -(2**63)  # stands for a null doc_id


class Ranges:
    """Ranges of rows in the order of two longs (low, mark): closed above by their cuts, the last one open.

    heads: the least row of each range that has rows; the head of a range is also the guest of the range before it, and
    the first range's that of the last.
    """

    def __init__(self, cuts: list[tuple[int, int]]):
        self.low, self.mark = (np.array([c[k] for c in cuts], np.int64) for k in (0, 1))
        self.guests: dict[tuple[int, int], int] = {}

    def __call__(self, low: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The range of each row."""
        first, last = np.searchsorted(self.low, low), np.searchsorted(self.low, low, side="right")
        for k in np.flatnonzero(first < last).tolist():  # a cut has this low: the marks decide
            first[k] += np.searchsorted(self.mark[first[k] : last[k]], mark[k])
        return first

    def heads(self, found: list[tuple[int, int, int]]) -> None:
        """Takes (range, low, mark) of the least row of each range."""
        found = sorted(found)
        self.guests = {(low, mark): found[k - 1][0] for k, (_, low, mark) in enumerate(found)}


def _ranges(keys: DataFrame, parts: int) -> Ranges:
    """About `parts` ranges of keys (low, mark) of like numbers of rows.

    The cuts come from the keys of least hash, about twenty a range; they say where a row is worked on, not what comes
    out. What the driver gets is a bounded number of keys a range.
    """
    share = min(1.0, 20 * parts / max(1, keys.count()))
    drawn = sorted(tuple(r) for r in keys.filter(F.xxhash64("low", "mark", F.lit(1)).bitwiseAND(F.lit(2**40 - 1)) <= int(share * (2**40 - 1))).distinct().collect())
    ranges = Ranges(sorted({drawn[k * len(drawn) // parts] for k in range(1, parts)}) if len(drawn) > 1 else [])
    shared = keys.sparkSession.sparkContext.broadcast(ranges)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            part = shared.value(*(batch.column(c).to_numpy() for c in ("low", "mark")))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *batch.columns], ["part", "low", "mark"])

    least = keys.mapInArrow(run, "part long, low long, mark long").groupBy("part").agg(F.min(F.struct("low", "mark")).alias("x"))
    ranges.heads([tuple(r) for r in least.select("part", "x.low", "x.mark").collect()])
    return ranges


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Rows of docs (doc_id, packed text) dealt out by ranges of doc_id, each range in order and followed by the next one's first row.

    The order is (doc_id, hash of the text), a null doc_id first; after the last row comes the first. Columns: doc_id,
    packed, part (the range), guest (true for the next range's row). Texts are shuffled once, compressed. Many rows of
    one doc_id, or of none, are dealt out by the hash of their text; rows that repeat both stay together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"), F.xxhash64(text).alias("mark"), text.alias("text"))
    ranges = docs.sparkSession.sparkContext.broadcast(_ranges(keyed.select("low", "mark"), parts))

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            low, mark = (batch.column(c).to_numpy() for c in ("low", "mark"))
            packed = [pack.compress(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows, at = np.arange(len(batch)), ranges.value(low, mark)
            extra = [(k, p) for k, p in enumerate(map(ranges.value.guests.get, zip(low.tolist(), mark.tolist()))) if p is not None]
            take = pa.array(np.concatenate([rows, [k for k, _ in extra]]).astype(np.int64))
            part = pa.array(np.concatenate([at, [p for _, p in extra]]).astype(np.int64))
            guest = pa.array(np.arange(len(take)) >= len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("low").take(take), batch.column("mark").take(take), pa.array(packed, pa.binary()).take(take), part, guest], ["doc_id", "low", "mark", "packed", "part", "guest"])

    dealt = keyed.mapInArrow(run, "doc_id long, low long, mark long, packed binary, part long, guest boolean")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "part").sortWithinPartitions("part", "guest", "low", "mark").select("doc_id", "packed", "part", "guest")


def _edited(rows: DataFrame, hashed: Callable[[str], bytes], with_forms: bool) -> DataFrame:
    """For the rows of in_order: lengths, the edited text's digest, both texts' fingerprint hashes and their likeness.

    check and edited_check are independent 128-bit hashes of the forms.
    """

    def pairs(batches) -> Iterator[tuple]:
        import zstandard

        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for batch in (part for whole in batches for part in pieces(whole, "packed")):
            for doc_id, packed, part, guest in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpack(packed).decode()
                row = (doc_id, text, canonical(text), part)
                if last and last[3] == part:
                    yield last, row
                last = None if guest else row

    def run(batches):
        import hashlib

        import pyarrow as pa
        import xxhash

        names = ["doc_id", "n_chars", "edited_sha256", "hash", "edited_hash", "check", "edited_check", "near_edited", "near_next", "form", "edited_form"]
        kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 4, pa.float64(), pa.float64(), pa.binary(), pa.binary()]
        width, out, held = 11 if with_forms else 9, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(width)], names[:width])

        for (doc_id, text, form, _), (_, after, after_form, _) in pairs(batches):
            n = len(text)
            edited = text[: n - n // 4] + after[: n // 4]
            edited_form = canonical(edited)
            a, b = form.encode(), edited_form.encode()
            row = (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), hashed(form), hashed(edited_form), xxhash.xxh3_128_digest(a, CHECK_SEED), xxhash.xxh3_128_digest(b, CHECK_SEED), float(form == edited_form), float(form == after_form))
            out.append(row + (a, b) if with_forms else row)
            held += len(a) + len(b) if with_forms else 0
            if len(out) >= 500 or held > 1 << 20:
                yield flush()
                out, held = [], 0
        yield flush()

    extra = ", form binary, edited_form binary" if with_forms else ""
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, hash binary, edited_hash binary, check binary, edited_check binary, near_edited double, near_next double" + extra)


def edit_report(docs: DataFrame, hashed: Callable[[str], bytes] = digest) -> DataFrame:
    """How the fingerprint reacts to an edit, and to another text, for every row of docs.

    The edited text has its last quarter of code points (rounded down) replaced by as many from the start of the next
    row's text, or by all of it. Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next (1 where the canonical forms are equal, else 0). Null texts count as empty; see in_order for ties. A
    table of one row is its own next; an empty one gives no rows; other columns are ignored. A text of any length is
    one row, which a task holds with its neighbour.

    Documents' forms are compared by their bytes, where a digest has more than one. Where an edited form shares a digest, a second hash of 128 bits tells
    whether forms differ; if any do, all forms of these digests are numbered by their bytes.
    """
    docs = docs.select("doc_id", "text")
    dealt = in_order(docs, 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = materialise(_edited(dealt, hashed, False), "edits")
    checks = rows.select(F.col("hash").alias("digest"), "check").unionAll(rows.select("edited_hash", "edited_check"))
    apart = checks.groupBy("digest").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least <> most").select("digest")
    shared = materialise(apart.unionAll(_shared(_forms(docs, hashed, "text", _repeated(rows.select(F.col("hash").alias("digest")))))).distinct(), "shared-digests")
    if shared.isEmpty():
        rows = rows.withColumn("fingerprint", F.lower(F.hex("hash"))).withColumn("edited_fingerprint", F.lower(F.hex("edited_hash")))
    else:
        rows = materialise(_edited(dealt, hashed, True), "edits-with-forms")
        edited = _forms(rows.select(F.col("edited_form").cast("string").alias("text")), hashed, "text")
        clashes = _numbered(_forms(docs, hashed, "text").unionAll(edited), shared)
        rows = _named(_named(rows, clashes, "hash", "form", "fingerprint"), clashes, "edited_hash", "edited_form", "edited_fingerprint")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
