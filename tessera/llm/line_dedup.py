"""Line dedup: later repeats of runs of lines are deleted, found by winnowing with one fingerprint a window.

A text is its lines (split at \\n), a line its hash after case and white space are folded. A window is the fewest lines
from a line on, or up to a line, that hold min_words words; its fingerprint is the least hash of its lines (Schleimer,
Wilkerson and Aiken, 2003). Neighbouring windows mostly share it, so a text selects one fingerprint for some two lines in
a window's length. Two places that hold a run of min_words words share the fingerprints of all windows in it for certain:
only fingerprints that stand at two places or more are gone on with.

The places of such a fingerprint are joined, and a match is extended both ways from it by the windows around it that it
is the least hash of: places match in a window if the window's lines have the same 128-bit hash, so that each context of
a fingerprint has its own first place (least doc_id, then mark, then line). Every run of min_words words or more is the
union of its windows, those that begin at its lines and the one that ends with it; so a run is repeated just if all of
its windows are, and the lines of all places of a window but the first are deleted, in other texts and in the same one.

A window's hash comes from prefix sums of its lines' hashes, so its cost does not depend on its length. Of N windows some
two that differ have equal hashes with a probability of about N * N / 2**129, were they ideal; the lines themselves are
not compared again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind, discard, materialise, mix64, pieces, presence_bits, presence_size, present

MIN_WORDS = 50
KEY, WINDOW = ["doc_id", "mark"], ["print", "key", "key2"]

_BASES = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)]  # odd: they have inverses
_INVERSES = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the least windows of min_words words that begin at, or end with, a line; each once."""
    n = len(words)
    upto = np.concatenate(([0], np.cumsum(words)))
    ends = np.searchsorted(upto, upto[:-1] + min_words)
    begin = np.flatnonzero(ends <= n)
    starts = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    finish = np.flatnonzero(starts >= 0)
    both = np.unique(np.concatenate((begin * (n + 1) + ends[begin], starts[finish] * (n + 1) + finish + 1)))
    return both // (n + 1), both % (n + 1)


def window_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each window, from the lines' 128-bit hashes (two columns)."""
    keys = []
    for half, base, inverse in zip(hashes.T, _BASES, _INVERSES):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(half), base))))
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(half), inverse))))
        sums = np.concatenate(([np.uint64(0)], np.cumsum(half * up[:-1])))
        keys.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)).view(np.int64))
    return keys


def window_minima(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The least of hashes[start:end] for each window: from minima over runs of powers of two, two of which cover it."""
    level = np.frexp((ends - starts).astype(np.float64))[1] - 1
    out, table = np.empty(len(starts), hashes.dtype), hashes
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[starts[at]], table[ends[at] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def occurrences(hashes: np.ndarray, wanted: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often wanted[i], a value of hashes, stands in hashes[starts[i]:ends[i]]."""
    values, kind = np.unique(hashes, return_inverse=True)
    n = len(hashes) + 1
    places = np.sort(kind * n + np.arange(len(hashes)))
    own = np.searchsorted(values, wanted) * n
    return np.searchsorted(places, own + ends) - np.searchsorted(places, own + starts)


def _fingerprints(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, mark, print, times, and the hashes and bounds of its windows: a row a selected fingerprint.

    One row is what neighbouring windows of the same least hash share; times is how often that stands among their lines.
    """
    names = ["doc_id", "mark", "print", "times", "key", "key2", "start", "end"]

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in (part for whole in batches for part in pieces(whole, "text")):
            rows, single, lists, sizes = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                folded = [line.lower().split() for line in text.split("\n")]
                starts, ends = windows(np.array([len(w) for w in folded], np.int64), min_words)
                if len(starts):
                    hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(" ".join(w)) for w in folded]), np.uint64).reshape(-1, 2)
                    least = window_minima(hashes[:, 0], starts, ends)
                    begins = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
                    ends_at = np.append(begins[1:], len(least)) - 1
                    prints = least[begins]
                    rows.append(np.full(len(begins), k))
                    single.append((prints.view(np.int64), occurrences(hashes[:, 0], prints, starts[begins], ends[ends_at])))
                    lists.append((*window_keys(hashes, starts, ends), starts, ends))
                    sizes.append(ends_at + 1 - begins)
            if rows:
                row, offsets = pa.array(np.concatenate(rows)), pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32))
                columns = [pa.array(np.concatenate(c)) for c in zip(*single)] + [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c))) for c in zip(*lists)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("mark").take(row), *columns], names)

    return docs.mapInArrow(run, "doc_id long, mark long, print long, times long, key array<long>, key2 array<long>, start array<long>, end array<long>")


def _windows_of(found: DataFrame, shared: DataFrame) -> DataFrame:
    """The windows of the fingerprints that are shared, a row a window.

    A bitmap of the shared ones passes nearly none of the others, which would do no harm: no window of theirs is met
    twice. Where there are too many for a bitmap, they are joined instead.
    """
    size = presence_size(shared.count())
    if size is None:
        chosen = found.join(shared, "print", "left_semi")
    else:
        bits = found.sparkSession.sparkContext.broadcast(presence_bits(shared, "print", size))
        place = F.pmod(F.xxhash64("print"), F.lit(size))

        def known(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array(present(bits.value, batch.column("place").to_numpy())))

        marked = found.select(*KEY, "print", "key", "key2", "start", "end", place.alias("place"))
        chosen = marked.mapInArrow(known, marked.schema)
    return chosen.select(*KEY, "print", F.explode(F.arrays_zip("key", "key2", "start", "end")).alias("w")).select(*KEY, "print", "w.*")


def _merged(spans: DataFrame) -> DataFrame:
    """doc_id, mark, removed: the sorted distinct lines of each text's windows (starts, ends)."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole, "starts", 100_000)):
            removed = []
            for starts, ends in zip(batch.column("starts"), batch.column("ends")):
                starts, ends = starts.values.to_numpy(), ends.values.to_numpy()
                n = int(ends.max()) + 1
                removed.append(np.flatnonzero(np.cumsum(np.bincount(starts, minlength=n) - np.bincount(ends, minlength=n)) > 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(removed, pa.list_(pa.int64()))], ["doc_id", "mark", "removed"])

    return spans.mapInArrow(run, "doc_id long, mark long, removed array<long>")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark and removed, the sorted distinct numbers (from 0) of the lines to delete; only texts that lose some.

    mark is a hash of the text: rows that repeat a doc_id with another text are texts of their own, in order of mark,
    and rows that repeat both are one text. Null texts and doc_ids take no part. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    prints = materialise(_fingerprints(rows.filter("doc_id is not null and text is not null"), min_words), "fingerprints")
    shared = materialise(prints.groupBy("print").agg(F.sum("times").alias("n")).filter("n > 1").select("print"), "shared-fingerprints")
    found = materialise(_windows_of(prints, shared), "windows")
    discard(prints, shared)
    first = found.groupBy(*WINDOW).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "start")).alias("first")).filter("n > 1")
    first = materialise(first.select(*WINDOW, F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), F.col("first.start").alias("first_start")), "first-places")
    later = found.join(first, WINDOW).filter("doc_id <> first_id or mark <> first_mark or start <> first_start")
    return _merged(later.groupBy(*KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")))


def _without(lines: Column, removed: Column) -> Column:
    """The lines whose numbers (from 0) are not among the sorted, distinct removed ones: what lies between them is copied in slices."""

    def kept(x: Column) -> Column:
        gap = lambda k: F.get(x["marks"], k) - F.get(x["marks"], k - 1) - 1
        gaps = F.filter(F.sequence(F.lit(1), F.size(x["marks"]) - 1), lambda k: gap(k) > 0)
        return F.flatten(F.transform(gaps, lambda k: F.slice(x["lines"], F.get(x["marks"], k - 1) + 2, gap(k))))

    marks = lambda x: F.concat(F.array(F.lit(-1)), x["removed"], F.array(F.size(x["lines"])))
    both = F.struct(lines.alias("lines"), removed.cast("array<int>").alias("removed"))
    return bind(both, lambda x: bind(F.struct(x["lines"].alias("lines"), marks(x).alias("marks")), kept))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later repeats gone from text, and the numbers of the deleted lines as column removed_lines.

    Every row stays: a text that repeats earlier ones wholly becomes empty. Null texts stay null, and rows without a
    doc_id stay as they are; of texts with fewer than min_words words nothing goes. Other columns are kept; of a clashing
    column removed_lines the old one is dropped. An empty table stays empty. A text of any length is one row, worked on
    in time proportional to its length.
    """
    runs = repeated_runs(docs, min_words)
    runs = materialise(runs.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), F.col("removed").alias("_removed")), "removed")
    # Sorted and merged at any size: a broadcast would depend on how much is deleted.
    joined = docs.drop("removed_lines").join(runs.hint("merge"), (docs["doc_id"].cast("long") == F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_mark")), "left")
    kept = F.array_join(_without(F.split("text", "\n"), F.col("_removed")), "\n")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(kept)
    return joined.withColumn("text", text).withColumn("removed_lines", F.coalesce("_removed", F.array().cast("array<bigint>"))).drop("_doc", "_mark", "_removed")
