"""Chunks, sparse and dense retrieval."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scoring import idf
from tessera.functions.text import tokens
from tessera.sources.storage import cut, small

if TYPE_CHECKING:
    import numpy as np


HEADINGS = r"(?=\n#{1,6}\s)"


def chunks(pages: DataFrame, size: int = 500, overlap: int = 100, section: str = HEADINGS) -> DataFrame:
    """chunk_id, page_id, chunk_index, content: sections packed up to `size`, each chunk beginning with the end of the one before.

    A section that is longer is one chunk. With a page's sections laid end to end, each chunk is a stretch of that text,
    so only the places where chunks begin and end are worked out, from the sections' lengths.
    """

    def stretches(text: str, parts: list[str]) -> Iterator[tuple[int, int]]:
        places = [0, *accumulate(len(p) + 1 for p in parts)]
        begin = end = 0
        for place, part in zip(places, parts):
            if end > begin and end - begin + len(part) > size:
                yield begin, end
                begin = max(begin, end - overlap) if overlap else place
            else:  # what an overlap begins with is blank no more once a section joins it
                begin = end - len(text[begin:end].lstrip())
            end = place + len(part)
        if parts:
            yield begin, end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(section)
        for batch in small(batches):
            rows: tuple[list, ...] = ([], [], [], [])
            for page, body in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [x for x in map(str.strip, split.split(body or "")) if x]
                text = "\n".join(parts)
                for k, (a, b) in enumerate(stretches(text, parts)):
                    for column, value in zip(rows, (f"{page}#{k}", page, k, text[a:b].strip())):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.string(), pa.int64(), pa.string()))], ["chunk_id", "page_id", "chunk_index", "content"])

    return pages.select(F.col("page_id").cast("string").alias("page_id"), "body").mapInArrow(run, "chunk_id string, page_id string, chunk_index long, content string")


def index(pages: DataFrame) -> DataFrame:
    """Chunks with the actor and lane of their pages, to search in."""
    return chunks(pages).join(pages.select("page_id", "actor", "lane"), "page_id")


def index_counts(chunked: DataFrame) -> DataFrame:
    """n_chunks, n_pages, n_scoped (with an actor or lane): one row."""
    return chunked.agg(F.count("*").alias("n_chunks"), F.countDistinct("page_id").alias("n_pages"), F.count_if(F.col("actor").isNotNull() | F.col("lane").isNotNull()).alias("n_scoped"))


def page_scopes(chunked: DataFrame) -> DataFrame:
    return chunked.groupBy("page_id").agg(F.max("actor").alias("actor"), F.max("lane").alias("lane"))


def frequency_change(old: DataFrame, new: DataFrame, frequencies: DataFrame) -> DataFrame:
    """token, df after postings (page_id, token) of some pages are replaced: old ones count down, new ones up, and tokens without a page go."""
    sign = lambda posts, n: posts.select("token", F.lit(n).alias("n"))
    rows = frequencies.select("token", F.col("df").alias("n")).unionAll(sign(old, -1)).unionAll(sign(new, 1))
    return rows.groupBy("token").agg(F.sum("n").alias("df")).filter("df > 0")


def chunk_postings(chunked: DataFrame) -> DataFrame:
    """chunk_id, page_id, token: the distinct tokens of each chunk."""
    return chunked.select("chunk_id", "page_id", F.explode(F.array_distinct(tokens(F.col("content"), 2))).alias("token"))


def upkeep(chunked: DataFrame, frequencies: DataFrame, pages: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, token frequencies (token, df: chunks that hold it) and the changes (page_id, change) after pages were edited.

    chunked: chunks() with `page_hash`, a hash of the text they were made from (see hashed_chunks); pages: all pages as
    they are now. Only pages that are new or whose hash differs are cut into chunks again; their old chunks and those of
    pages that are gone leave, and frequencies change by what left and came. Rows of unchanged pages are kept as they are.
    """
    now = pages.select("page_id", "body", _text_hash(F.col("body")).alias("page_hash")).filter("page_id is not null")
    before = chunked.select(F.col("page_id").alias("_id"), F.col("page_hash").alias("_hash")).distinct()
    both = now.select("page_id", "page_hash").join(before, F.col("page_id") == F.col("_id"), "full_outer")
    change = F.when(F.col("_id").isNull(), "new").when(F.col("page_id").isNull(), "gone").when(F.col("page_hash") != F.col("_hash"), "edited")
    changes = cut(both.select(F.coalesce("page_id", "_id").alias("page_id"), change.alias("change")).filter("change is not null"))
    left = chunked.join(changes, "page_id", "left_semi")
    came = cut(hashed_chunks(now.join(changes.filter("change <> 'gone'"), "page_id", "left_semi"), **how))
    counts = frequency_change(chunk_postings(left), chunk_postings(came), frequencies)
    return chunked.join(changes, "page_id", "left_anti").unionByName(came), counts, changes


def _text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hashed_chunks(pages: DataFrame, **how) -> DataFrame:
    """chunks() with `page_hash`. A page without any text has no chunk, and so counts as new each time."""
    return chunks(pages, **how).join(pages.select("page_id", _text_hash(F.col("body")).alias("page_hash")), "page_id").select("chunk_id", "page_id", "chunk_index", "content", "page_hash")


def term_frequencies(chunked: DataFrame) -> DataFrame:
    """chunk_id, token, n, tf: how often each token of two characters or more is in a chunk, and its share of all of them."""
    rows = chunked.select("chunk_id", tokens(F.col("content"), 2).alias("t")).select("chunk_id", F.size("t").alias("size"), F.explode("t").alias("token"))
    return rows.groupBy("chunk_id", "token", "size").agg(F.count("*").alias("n")).select("chunk_id", "token", "n", F.round(F.col("n") / F.col("size"), 9).alias("tf"))


def squares(x: Column) -> Column:
    """The sum of the squares of how often each value stands in an array."""

    def summed(t: Column) -> Column:
        begins = F.filter(F.transform(t, lambda x, i: F.when((i > 0) & (F.get(t, i - 1) == x), None).otherwise(i)), lambda i: i.isNotNull())
        runs = lambda b: F.transform(b, lambda at, k: F.coalesce(F.get(b, k + 1), F.size(t)) - at)
        return F.aggregate(F.transform(F.array(begins), runs)[0], F.lit(0).cast("long"), lambda s, n: s + n.cast("long") * n)

    return F.transform(F.array(F.array_sort(x)), summed)[0]


def sparse_cosine(pages: DataFrame, query: str, limit: int = 10, key: str = "page_id", text: str = "body", lane: str | None = None, actor: str | None = None) -> DataFrame:
    """key and TF-IDF cosine with the query of the best rows of a lane and actor. Tokens outside the query have idf 1 in a row's norm.

    One pass over the texts: a row's norm and the counts of the query's tokens come from the row itself, and only they are
    kept. Frequencies count all rows, whatever the scope.
    """
    found = re.findall("[a-z0-9]{2,}", query.lower())
    terms = sorted(set(found))
    scope = [c for c in ("lane", "actor") if c in pages.columns]

    def counts(t: Column) -> Column:
        return F.struct(F.size(t).alias("n"), squares(t).alias("squares"), F.array(*(F.size(F.filter(t, lambda x: x == q)) for q in terms)).alias("counts"))  # noqa: B023

    bound = F.transform(F.array(tokens(F.col(text), 2)), counts)[0]
    rows = cut(pages.select(key, *scope, bound.alias("c")).select(key, *scope, "c.*"))
    df = rows.agg(F.count("*").alias("n_rows"), *(F.count_if(F.get("counts", F.lit(k)) > 0).alias(f"df{k}") for k in range(len(terms))))  # one row
    share = [found.count(t) / len(found) for t in terms]
    weights = [F.when(F.col(f"df{k}") > 0, idf(F.col("n_rows"), F.col(f"df{k}"))).otherwise(F.lit(1.0)) for k in range(len(terms))]
    hits = rows.filter(F.exists("counts", lambda c: c > 0))
    for column, value in (("lane", lane), ("actor", actor)):
        hits = hits if value is None else hits.filter(F.col(column) == value)
    c = [F.get("counts", F.lit(k)) for k in range(len(terms))]
    tf = [x / F.col("n") for x in c]
    total = lambda parts: sum(parts, F.lit(0.0))
    dot_product = total(t * w * s * w for t, w, s in zip(tf, weights, share))
    norm = F.sqrt((F.col("squares") - total(x * x for x in c)) / (F.col("n") * F.col("n")) + total(t * w * t * w for t, w in zip(tf, weights)))
    query_norm = F.sqrt(total(w * s * w * s for w, s in zip(weights, share)))
    scored = hits.join(F.broadcast(df)).select(key, F.round(dot_product / (norm * query_norm), 6).alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), F.desc(key)).limit(limit)


CELL_QUERIES, CELL_VECTORS = 65_536, 32_768  # about as many are held by one task
BLOCK_QUERIES, BLOCK_VECTORS = 256, 8_192  # as many are scored at once in single precision


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, cell: tuple[int, int] = (CELL_QUERIES, CELL_VECTORS)) -> DataFrame:
    """query_id, vec_id, score, place: for each query (vec_id, embedding) the k vectors of the greatest cosine, clamped to 0; ties by vec_id.

    A grid: queries and vectors are dealt to groups of about the sizes of a cell by their ids' hashes, and one task holds a
    group of each. A vector is sent once for each group of queries and a query once for each group of vectors, none goes
    through the driver. A cell keeps the best k of a query, and the best of its cells are merged. Vectors of no length
    score 0; null ones are passed over.
    """
    kept = lambda df: df.filter("embedding is not null and vec_id is not null").select("vec_id", "embedding")
    queries, vectors = kept(queries), kept(vectors)
    rows, columns = (max(1, -(-df.count() // n)) for df, n in zip((queries, vectors), cell))
    group = lambda n: F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(group(rows).alias("row"), every(columns).alias("column"), F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    v = vectors.select(every(rows).alias("row"), group(columns).alias("column"), F.col("vec_id").alias("vec_id"), F.col("embedding").alias("embedding"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if left.num_rows and right.num_rows:
            asked, held = _matrix(left["query"]), _matrix(right["embedding"])
            out = nearest_rows(asked, left["query_id"].to_numpy(), held, right["vec_id"].to_numpy(), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out)))

    out = q.groupBy("row", "column").cogroup(v.groupBy("row", "column")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length, a row each."""
    import numpy as np

    parts = [c for c in column.chunks if len(c)]
    rows = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if len(c.flatten()) else np.empty((len(c), 0)) for c in parts]
    lengths = {n for c in parts for n in c.value_lengths().unique().to_pylist()}
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)[:5]}")
    return np.concatenate(rows)


def _units(x: np.ndarray) -> np.ndarray:
    import numpy as np

    x = x.astype(np.float64)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _equal_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first of equal rows, and for each row the number of its group."""
    import numpy as np

    seen: dict[bytes, int] = {}
    group = np.fromiter((seen.setdefault(row.tobytes(), len(seen)) for row in x), np.int64, len(x))
    return np.unique(group, return_index=True)[1], group


def nearest_rows(asked: np.ndarray, asked_ids: np.ndarray, held: np.ndarray, ids: np.ndarray, k: int, block: tuple[int, int] = (BLOCK_QUERIES, BLOCK_VECTORS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores, rounded to six digits, of the k best rows of held for each row of asked; ties by id.

    Equal rows are compared once, and stand for their k least ids. Scores in single precision rule out what can't be among
    the k best: they are wrong by no more than their width times 2**-24. What is left is scored in double precision; so
    is everything for a query whose k-th best score is about 0, as all that is clamped ties with it.
    """
    import numpy as np

    (first, own), (asked_first, asked_group) = _equal_rows(held), _equal_rows(asked)
    order = np.lexsort((ids, own))
    order = order[np.arange(len(order)) - np.searchsorted(own[order], own[order]) < k]
    least, copies = ids[order], np.bincount(own[order], minlength=len(first))
    start = np.cumsum(copies) - copies
    held, asked = held[first], asked[asked_first]

    def single(x: np.ndarray) -> np.ndarray:
        """Units in single precision; what is no number scores 0 here, and so is never chosen before what has a score."""
        out = np.empty(x.shape, np.float32)
        for at in range(0, len(x), 4096):
            part = _units(x[at : at + 4096])
            part[~np.isfinite(part).all(axis=1)] = 0
            out[at : at + 4096] = part
        return out

    low_held, low_asked = single(held), single(asked)
    margin = np.float32(2 * (held.shape[1] + 8) * 2.0**-24 + 2e-6)

    def settle(row: np.ndarray, column: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each row, with all ids of a column."""
        n = copies[column]
        member = np.repeat(start[column] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        row, score, name = np.repeat(row, n), np.repeat(np.round(score, 6), n), least[member]
        order = np.lexsort((name, -score, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
        return row[order], name[order], score[order]

    def plainly(rows: np.ndarray) -> None:
        step = max(1, (1 << 22) // len(held))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            units = _units(asked[part])
            score = np.concatenate([np.maximum(units @ _units(held[c : c + 4096]).T, 0) for c in range(0, len(held), 4096)], axis=1)
            last = score.shape[1] - min(k, score.shape[1])
            own_or_least = np.nan_to_num(score, nan=-1.0)
            row, column = np.nonzero(own_or_least >= np.partition(own_or_least, last, axis=1)[:, last : last + 1] - 2e-6)
            found.append(settle(part[row], column, score[row, column]))

    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for at in range(0, len(asked), block[0]):
        part, near, bound = low_asked[at : at + block[0]], [], None
        for c in range(0, len(held), block[1]):
            score = part @ low_held[c : c + block[1]].T
            if bound is None:
                last = max(0, score.shape[1] - k)
                bound = np.partition(score, last, axis=1)[:, last] - margin
                plain = (bound <= 0) | (score.shape[1] < k)
                bound[plain] = np.inf
            hit = np.flatnonzero(score >= bound[:, None])
            near.append((hit // score.shape[1], hit % score.shape[1] + c, score.ravel()[hit]))
        row, column, score = (np.concatenate(x) for x in zip(*near))
        order = np.lexsort((-score, row))
        row, column, score = row[order], column[order], score[order]
        begin = np.searchsorted(row, row)
        kept = score >= score[np.minimum(begin + k - 1, len(row) - 1)] - margin if len(row) else np.empty(0, bool)
        row, column = row[kept], column[kept]
        plain |= np.bincount(row, minlength=len(part)) > 4096
        chosen = ~plain[row]
        row, column = row[chosen], column[chosen]
        exact = [np.einsum("ij,ij->i", _units(asked[at + row[x : x + 4096]]), _units(held[column[x : x + 4096]])) for x in range(0, len(row), 4096)]
        found.append(settle(row + at, column, np.maximum(np.concatenate([np.empty(0), *exact]), 0)))
        plainly(at + np.flatnonzero(plain))
    row, name, score = (np.concatenate(x) for x in zip(*found))
    # Queries with equal vectors share the rows of one of them.
    order = np.argsort(row, kind="stable")
    row, name, score = row[order], name[order], score[order]
    n = np.bincount(row, minlength=len(asked))
    size, begin = n[asked_group], (np.cumsum(n) - n)[asked_group]
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.repeat(asked_ids, size), name[place], score[place]


HASHED = 256


def _term_counts(text: str | None, size: int) -> np.ndarray:
    import zlib

    import numpy as np

    words = re.findall(r"\w+", (text or "").lower())
    terms = [w.encode() for w in words]
    terms += [a + b" " + b for a, b in zip(terms, terms[1:])]
    h = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms))
    return np.bincount(h % size, np.where(h >> 31, 1.0, -1.0), size)


def hashed_embedding(texts: pd.Series, size: int = HASHED) -> pd.Series:
    """Signed feature hashing of a text's words and pairs of words: a vector that needs no model, of length 1 unless empty."""
    import numpy as np

    def one(text: str) -> list[float]:
        out = _term_counts(text, size)
        length = float(np.linalg.norm(out))
        return (out / length if length else out).tolist()

    return texts.map(one)


def hashed_counts(texts: pd.Series, size: int = HASHED) -> pd.Series:
    """hashed_embedding() before its division by the length: whole numbers, which single precision holds; of the same cosine."""
    return texts.map(lambda x: _term_counts(x, size).astype("float32"))


def embedded(chunks: DataFrame, embed: Callable[[pd.Series], pd.Series] = hashed_embedding, text: str = "content", kind: str = "double") -> DataFrame:
    """chunks with `embedding`: what embed makes of their texts, a batch at a time; null texts count as empty."""
    run = F.pandas_udf(lambda x: embed(x.fillna("")), f"array<{kind}>")
    return chunks.withColumn("embedding", run(F.col(text).cast("string")))


def similarities(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """vec_id and cosine with a query, from -1 to 1, of given vectors."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    return vectors.select("vec_id", F.round(dot(F.col("embedding"), q) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(norm)), 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_search(vectors: DataFrame, query: Sequence[float], limit: int = 10) -> DataFrame:
    """vec_id, label and cosine similarity, clamped to 0, of the nearest vectors to one query: an exact scan and top-k."""
    q = F.array(*(F.lit(float(x)) for x in query))
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    score = F.greatest(F.lit(0.0), dot(F.col("embedding"), q) / (F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(norm)))
    return vectors.select("vec_id", "label", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit)


def label_centroids(vectors: DataFrame) -> DataFrame:
    """label, place, mean: the mean vector of each label, in long form."""
    rows = vectors.select("label", F.posexplode("embedding").alias("place", "x"))
    return rows.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.count("*").alias("n"))
