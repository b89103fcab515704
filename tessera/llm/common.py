"""What the training-data operators share: table access, lineage cuts, vectorised text hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under sf_dir, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a folder of this machine serves a local master, whose executors are this process. On a cluster
    such a folder would lose data in silence, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-", dir=None)
        spark.conf.set("tessera.shared.dir", path)
    return path.rstrip("/")


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what materialise wrote for these tables. Only for tables that nothing still to be computed reads."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


BITS = 1 << 23  # of the smallest bitmap, 1 MB
MOST_BITS = 1 << 28  # of the largest, 32 MB


def presence_size(n: int) -> int | None:
    """The bits of a bitmap for n ids, eight an id at least; None if that is more than MOST_BITS."""
    bits = BITS
    while bits < 8 * n:
        bits *= 2
    return bits if bits <= MOST_BITS else None


def presence_bits(ids: DataFrame, column: str, size: int = BITS) -> np.ndarray:
    """A bitmap of `size` bits in which the places of all non-null ids are set, and place 0 for null.

    A pre-filter: an id whose place is clear is not among them; one whose place is set may be. The bits are gathered in
    words of 62, of which there are size / 62 at most.
    """
    place = F.coalesce(F.pmod(F.xxhash64(column), F.lit(size)), F.lit(0))
    words = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 62).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 62 as int)))").alias("bits"))
    out = np.zeros(size // 62 + 1, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out


def present(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places (see presence_bits) are set."""
    return (bits[places // 62] >> (places % 62)) & 1 == 1


def bind(value: Column, then) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.transform(F.array(value), then)[0]


_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of uint64."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


PIECE = 1 << 18


def word_hashes(buffer: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts at once, and each word's text number.

    A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. buffer holds the UTF-8 texts end to
    end; ends[i] is where text i ends. Every byte is mixed with its place in the word. Works through the buffer in
    pieces of about PIECE bytes, cut between words, so memory doesn't grow with the texts.
    """
    raw = np.frombuffer(buffer, np.uint8)
    hashes, texts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not _BLANK[raw[end]] and end not in ends[np.searchsorted(ends, end) :][:1]:
            end += 1
        piece = _LOWER[raw[at:end]]
        inside = ~_BLANK[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = ends[np.searchsorted(ends, at) : np.searchsorted(ends, end)] - at
        first[cut] = inside[cut]  # a word never spans two texts
        starts = np.flatnonzero(first)
        if len(starts):
            places = np.flatnonzero(inside)
            word = np.cumsum(first, dtype=np.int64)[places] - 1
            mixed = mix64(((places - starts[word]).astype(np.uint64) << np.uint64(8) | piece[places]) * _GOLD + _GOLD)
            hashes.append(mix64(np.add.reduceat(mixed, np.searchsorted(places, starts))))
            texts.append(np.searchsorted(ends, starts + at, side="right"))
        at = end
    return np.concatenate(hashes), np.concatenate(texts)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the sorted distinct 63-bit hashes of its shingles of `size` words; of all its words if it has fewer."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    words, text = word_hashes(b"".join(texts), ends)
    counts = np.bincount(text, minlength=len(texts)) if len(text) else np.zeros(len(texts), np.int64)
    begins = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = words.copy()
    for k in range(1, size):
        out[:-k] = mix64(out[:-k] * _GOLD + words[k:]) if k < len(words) else out[:-k]
    out >>= np.uint64(1)
    sets = []
    for b, n in zip(begins.tolist(), counts.tolist()):
        if n >= size:
            sets.append(np.unique(out[b : b + n - size + 1]))
        elif n:
            h = words[b : b + 1].copy()
            for k in range(1, n):
                h = mix64(h * _GOLD + words[b + k : b + k + 1])
            sets.append(mix64(h + np.uint64(n)) >> np.uint64(1))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def pieces(batch, column: str, limit: int = 1 << 20):
    """Consecutive parts of an Arrow batch, each of about `limit` bytes (of a list column: items) of a column, or one row.

    A batch may hold ten thousand long texts; what is made from them in Python is held for one part only.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    data = batch.column(column)
    sizes = pc.list_value_length(data) if pa.types.is_list(data.type) else pc.binary_length(data)
    upto = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + limit)))
        yield batch.slice(at, end - at)
        at = end


def arrow_texts(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null as empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
