"""Captures: digests, pending days, daily notes, repeated captures."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import compact, keywords, slug, title_of
from tessera.sources.storage import cut, small

#: Words that say nothing about a capture.
STOP_WORDS = (
    "this", "that", "with", "from", "have", "been", "were", "will", "would", "could", "should", "about", "which", "their", "there", "these", "those", "when", "where", "what", "while", "after", "before", "between",
)
STATUSES = ("draft", "review", "accepted", "rejected", "archived")


def build(captures: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """capture_id `inbox/<day>/<slug>` and title for observations (day, observation); equal ids get -2, -3, ... in order of text, then `order`."""
    base = F.concat_ws("/", F.lit("inbox"), F.col("day").cast("string"), slug(F.col("observation")))
    rows = captures.withColumn("base", base).withColumn("title", title_of(F.col("observation")))
    place = F.row_number().over(Window.partitionBy("base").orderBy("observation", *order))
    return rows.withColumn("place", place).withColumn("capture_id", F.when(F.col("place") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "place"))).drop("base", "place")


def digest(captures: DataFrame, key: Column, none: str) -> DataFrame:
    """key, n, first_id, last_id: captures counted by a key, with a name for no key; most first."""
    rows = captures.select(F.coalesce(key.cast("string"), F.lit(none)).alias("key"), "capture_id")
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("capture_id").alias("first_id"), F.max("capture_id").alias("last_id")).orderBy(F.desc("n"), "key")


def digest_members(captures: DataFrame, key: Column, none: str) -> DataFrame:
    """key, n, capture_id: digest() with its captures, one a row, so that a key may have any number of them."""
    rows = captures.select(F.coalesce(key.cast("string"), F.lit(none)).alias("key"), "capture_id")
    return rows.groupBy("key").agg(F.count("*").alias("n")).join(rows, "key").select("key", "n", "capture_id")


def pending_days(captures: DataFrame, notes: DataFrame) -> DataFrame:
    """day, n of the days with captures but without a daily note (a column `day`)."""
    return captures.filter("day is not null").groupBy("day").agg(F.count("*").alias("n")).join(notes.select("day").distinct(), "day", "left_anti")


def daily_facts(captures: DataFrame, chars: int = 500) -> DataFrame:
    """day, fact, n: the distinct facts of each day, from summary, excerpt or title, cut to chars."""
    fact = compact(F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.nullif(F.trim("observation"), F.lit("")), F.col("title")), chars)
    return captures.select("day", fact.alias("fact")).groupBy("day", "fact").agg(F.count("*").alias("n"))


def transition(captures: DataFrame, wanted: DataFrame) -> DataFrame:
    """captures with the wanted status by capture_id, where it is one of STATUSES."""
    known = wanted.filter(F.col("status").isin(*STATUSES)).groupBy("capture_id").agg(F.max("status").alias("_to"))
    return captures.join(known, "capture_id", "left").withColumn("status", F.coalesce("_to", "status")).drop("_to")


ODD = 4096  # bits of the smallest sketch that rules pairs out
TILE = (4096, 1 << 20)  # sets and values that are compared at once


def _bits(n: np.ndarray) -> np.ndarray:
    """The bits of the sketches of sets of n values: a power of two, eight a value and more, between ODD and 2**16."""
    bits = np.full(len(n), ODD, np.int64)
    while (few := (bits < 8 * n.astype(np.int64)) & (bits < 1 << 16)).any():
        bits[few] *= 2
    return bits


def _fold(odd: np.ndarray, bits: int) -> np.ndarray:
    """Sketches, a row each, in so many bits: the parities of larger groups of values."""
    return np.bitwise_xor.reduce(odd.reshape(len(odd), -1, bits // 64), axis=1)


def _keyword_sets(captures: DataFrame, stop: tuple[str, ...]) -> DataFrame:
    """capture_id and its keywords as sorted 64-bit hashes: key (a digest of 128 bits), n, values, and odd, the parities of groups of values."""
    words = captures.select("capture_id", F.transform(keywords(F.col("observation"), stop), lambda w: F.xxhash64(w)).alias("words")).filter(F.size("words") > 0)

    def run(batches):
        import pyarrow as pa

        for batch in small(batches, 1024):
            made = []
            for words in batch.column("words"):
                v = np.unique(words.values.to_numpy(zero_copy_only=False))
                bits = int(_bits(np.array([len(v)]))[0])
                odd = np.packbits((np.bincount(v & (bits - 1), minlength=bits) & 1).astype(np.uint8))
                made.append((hashlib.blake2b(v.tobytes(), digest_size=16).digest(), len(v), v.tobytes(), odd.tobytes()))
            columns = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("capture_id"), *columns], ["capture_id", "key", "n", "held", "odd"])

    return cut(words.mapInArrow(run, f"capture_id {dict(captures.dtypes)['capture_id']}, key binary, n int, held binary, odd binary"))


def _tiles(sets: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """tile, low, high, keys, sizes, held, odd: the different sets, packed by size into rows of at most `tile` sets and values (or one set)."""
    kinds = sets.groupBy("key").agg(F.first(F.struct("n", "held", "odd")).alias("x")).select("key", "x.*").sortWithinPartitions("n")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        rows, total, made = [], 0, TaskContext.get().partitionId() << 32
        names = ["tile", "low", "high", "keys", "sizes", "held", "odd"]

        def packed():
            sizes = np.array([r[1] for r in rows], np.int32)
            values = [made, int(sizes[0]), int(sizes[-1]), b"".join(r[0] for r in rows), sizes.tobytes(), b"".join(r[2] for r in rows), b"".join(r[3] for r in rows)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4))], names)

        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (len(rows) >= tile[0] or total + row[1] > tile[1]):
                    yield packed()
                    rows, total, made = [], 0, made + 1
                rows.append(row)
                total += row[1]
        if rows:
            yield packed()

    return cut(kinds.mapInArrow(run, "tile long, low int, high int, keys binary, sizes binary, held binary, odd binary"))


class _Tile:
    """The sets of one row of _tiles, in ascending order of size, so also of the bits of their sketches."""

    def __init__(self, keys: bytes, sizes: bytes, held: bytes, odd: bytes):
        self.keys, self.n, self.held = keys, np.frombuffer(sizes, np.int32), np.frombuffer(held, np.int64)
        self.ends = np.cumsum(self.n, dtype=np.int64)
        bits = _bits(self.n)
        raw, at = np.frombuffer(odd, np.uint64), 0
        parts: list[tuple[int, np.ndarray]] = []
        for width in np.unique(bits).tolist():
            many = int((bits == width).sum())
            parts.append((width, raw[at : at + many * width // 64].reshape(many, -1)))
            at += many * width // 64
        self.bits = bits
        #: By bits the sketches of the sets that have as many, which are the last ones; thin: of all sets, a column each.
        self.odd = {w: np.concatenate([_fold(o, w) for v, o in parts if v >= w]) for w, _ in parts}
        if ODD not in self.odd:
            self.odd[ODD] = np.concatenate([_fold(o, ODD) for _, o in parts])
        self.thin = {w: np.ascontiguousarray(_fold(self.odd[ODD], w).T) for w in (ODD // 8, ODD // 4, ODD // 2, ODD)}

    def values(self, k: int) -> np.ndarray:
        return self.held[self.ends[k] - self.n[k] : self.ends[k]]

    def wide(self, k: int, width: int) -> np.ndarray:
        """The sketch of a set in so many bits, of which it has as many."""
        own = self.odd[int(self.bits[k])]
        return _fold(own[len(own) - len(self.n) + k :][:1], width)[0]

    def common(self, k: int, other: _Tile, js: np.ndarray) -> np.ndarray:
        """How many values set k shares with each of some sets of another tile."""
        mine, counts = self.values(k), other.n[js].astype(np.int64)
        starts = np.cumsum(counts) - counts
        v = other.held[np.repeat(other.ends[js] - counts - starts, counts) + np.arange(counts.sum())]
        at = np.minimum(np.searchsorted(mine, v), len(mine) - 1)
        return np.add.reduceat((mine[at] == v).astype(np.int64), starts)

    def near(self, k: int, other: _Tile, begin: int, least: float, apart_from: np.ndarray | None) -> np.ndarray:
        """The sets of another tile, from `begin` on and where apart_from holds, that neither size nor sketches keep from being alike."""
        n = int(self.n[k])
        lo = max(begin, int(np.searchsorted(other.n, n * least - 1e-6)))
        hi = int(np.searchsorted(other.n, n / least + 1e-6, side="right"))
        if lo >= hi:
            return np.empty(0, np.int64)
        most = (1 - least) / (1 + least)
        thin = min(ODD, max(ODD // 8, 1 << int(4 * n - 1).bit_length()))
        odd = self.thin[thin][:, k, None]
        apart = np.bitwise_count(other.thin[thin][:, lo:hi] ^ odd).sum(axis=0, dtype=np.int32)
        js = lo + np.flatnonzero(apart <= (n + other.n[lo:hi]) * most + 1e-6)
        js = js if apart_from is None else js[apart_from[js]]
        for width in np.unique(np.minimum(other.bits[js], self.bits[k])).tolist():
            if width > thin:
                some = np.minimum(other.bits[js], self.bits[k]) == width
                whole, mine = js[some], self.wide(k, width)
                theirs = self._rows(other, whole, width)
                apart = np.bitwise_count(theirs ^ mine).sum(axis=1, dtype=np.int64)
                js = np.sort(np.concatenate([js[~some], whole[apart <= (n + other.n[whole]) * most + 1e-6]]))
        return js

    @staticmethod
    def _rows(other: _Tile, js: np.ndarray, width: int) -> np.ndarray:
        """Sketches of sets in so many bits, of which they have as many."""
        of = other.odd.get(width)
        if of is None:
            return np.stack([other.wide(int(j), width) for j in js])
        return of[js - (len(other.n) - len(of))]


def _like(tiles: DataFrame, least: float, forest: bool) -> DataFrame:
    """a_key, b_key, a_n, b_n, common of different sets that are at least so similar, each pair once.

    Every two tiles whose sizes allow it meet in one task. Sketches give a lower bound of how many values two sets differ
    in; what they leave is compared by its values there, so no candidates move. With `forest` a pair whose sets the task
    has found to be linked by others is left out.
    """
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartition(max(1, min(tiles.count(), math.isqrt(8 * n))), "tile")  # some 8 tasks a shuffle partition
    a, b = (dealt.select(*(F.col(c).alias(f"{s}_{c}") for c in tiles.columns)) for s in "ab")
    met = (F.col("a_tile") <= F.col("b_tile")) & (F.col("a_high") >= F.col("b_low") * least - 1e-6) & (F.col("b_high") >= F.col("a_low") * least - 1e-6)

    def run(batches):
        import pyarrow as pa

        known: tuple[int, _Tile] | None = None
        groups, begins = np.empty(0, np.int64), {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if known is None or known[0] != row["a_tile"]:
                    known = (row["a_tile"], _Tile(*(row[f"a_{c}"] for c in ("keys", "sizes", "held", "odd"))))
                one = known[1]
                same = row["a_tile"] == row["b_tile"]
                two = one if same else _Tile(*(row[f"b_{c}"] for c in ("keys", "sizes", "held", "odd")))
                for name, t in ((row["a_tile"], one), (row["b_tile"], two)):
                    if forest and name not in begins:
                        begins[name] = len(groups)
                        groups = np.concatenate([groups, len(groups) + np.arange(len(t.n))])
                found: list[tuple] = []
                for i in range(len(one.n)):
                    if forest:
                        mine, theirs = begins[row["a_tile"]] + i, begins[row["b_tile"]]
                    js = one.near(i, two, i + 1 if same else 0, least, groups[theirs : theirs + len(two.n)] != groups[mine] if forest else None)
                    if not len(js):
                        continue
                    shared = one.common(i, two, js)
                    good = shared / (int(one.n[i]) + two.n[js] - shared) >= least
                    js, shared = js[good], shared[good]
                    if forest and len(js):
                        others, first = np.unique(groups[theirs + js], return_index=True)
                        js, shared = js[first], shared[first]
                        groups[np.isin(groups, others)] = groups[mine]
                    found += [(one.keys[16 * i : 16 * i + 16], two.keys[16 * j : 16 * j + 16], int(one.n[i]), int(two.n[j]), c) for j, c in zip(js.tolist(), shared.tolist())]
                    if len(found) > 10000:
                        yield packed(pa, found)
                        found = []
                if found:
                    yield packed(pa, found)

    def packed(pa, found):
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], ["a_key", "b_key", "a_n", "b_n", "common"])

    return a.join(b.hint("shuffle_replicate_nl"), met).mapInArrow(run, "a_key binary, b_key binary, a_n int, b_n int, common long")


def similar_pairs(captures: DataFrame, least: float = 0.4, stop: tuple[str, ...] = (), tile: tuple[int, int] = TILE) -> DataFrame:
    """a_id, b_id, jaccard of captures whose keyword sets are at least so similar.

    Equal sets are compared once and stand for all their captures; their pairs are made at the end.
    """
    sets = _keyword_sets(captures, stop)
    alike = cut(_like(_tiles(sets, tile), least, False))
    ids = sets.select("key", "capture_id")
    a, b = (ids.select(F.col("key").alias(f"{s}_key"), F.col("capture_id").alias(f"{s}_id")) for s in "ab")
    jaccard = F.col("common") / (F.col("a_n") + F.col("b_n") - F.col("common"))
    different = alike.join(a, "a_key").join(b, "b_key").filter("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), F.round(jaccard, 6).alias("jaccard"))
    equal = a.join(b, (F.col("a_key") == F.col("b_key")) & (F.col("a_id") < F.col("b_id"))).select("a_id", "b_id", F.lit(1.0).alias("jaccard"))
    return different.unionAll(equal)


def _links(captures: DataFrame, least: float, stop: tuple[str, ...], tile: tuple[int, int] = TILE) -> DataFrame:
    """u, v: links of similar captures that join the same captures as all their pairs do."""
    sets = _keyword_sets(captures, stop)
    alike = cut(_like(_tiles(sets, tile), least, True))
    first = cut(sets.filter("capture_id is not null").groupBy("key").agg(F.min("capture_id").alias("first")))
    a, b = (first.select(F.col("key").alias(f"{s}_key"), F.col("first").alias(s)) for s in "uv")
    different = alike.select(F.col("a_key").alias("u_key"), F.col("b_key").alias("v_key")).join(a, "u_key").join(b, "v_key").select("u", "v")
    equal = sets.select("key", "capture_id").join(first, "key").select(F.col("first").alias("u"), F.col("capture_id").alias("v"))
    return different.unionAll(equal).filter("u <> v")


def repeated(captures: DataFrame, least: float = 0.4, rounds: int = 60, stop: tuple[str, ...] = ()) -> DataFrame:
    """capture_id, group_id: groups of captures linked by similarity, by the least id, through min-label joins.

    Labels jump over labels, so the rounds grow with the logarithm of a group's width; raises if `rounds` don't suffice.
    """
    pairs = cut(_links(captures, least, stop))
    steps = cut(pairs.unionAll(pairs.select("v", "u")))
    labels = cut(steps.select("u").distinct().withColumn("group_id", F.col("u")))
    for _ in range(rounds):
        near = steps.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("group_id").alias("least"))
        hooked = labels.join(near, "u").select("u", F.least("group_id", "least").alias("group_id"))
        jumped = cut(hooked.join(hooked.select(F.col("u").alias("group_id"), F.col("group_id").alias("root")), "group_id").select("u", F.least("group_id", "root").alias("group_id")))
        changed = jumped.join(labels.withColumnRenamed("group_id", "old"), "u").filter("group_id <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels.withColumnRenamed("u", "capture_id")
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def repeat_members(captures: DataFrame, least: float = 0.4) -> DataFrame:
    """capture_id, group_id of captures (capture_id, title, observation) with like keywords in title and text, stop words aside."""
    texts = captures.select("capture_id", F.concat_ws(" ", "title", "observation").alias("observation"))
    return repeated(texts, least, stop=STOP_WORDS)


def named_groups(captures: DataFrame, members: DataFrame) -> DataFrame:
    """group_id, n, key, title of groups (capture_id, group_id), largest first.

    key has the first five words that all captures of a group share, found by counting; similar-captures if there are none.
    Then the title has the first five of the sorted words of all its captures, each as often as captures have it.
    """
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    texts = captures.select("capture_id", F.concat_ws(" ", "title", "observation").alias("observation"))
    words = texts.join(members, "capture_id").select("group_id", F.explode(keywords(F.col("observation"), STOP_WORDS)).alias("word"))
    counted = words.groupBy("group_id", "word").agg(F.count("*").alias("k")).join(sizes, "group_id").withColumn("common", F.col("k") == F.col("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("group_id", "common").orderBy("word"))).filter("place <= 5")
    lists = first.groupBy("group_id", "n").agg(F.array_sort(F.collect_list(F.when(F.col("common"), F.col("word")))).alias("shared"), F.array_sort(F.collect_list(F.when(~F.col("common"), F.struct("word", "k")))).alias("other"))
    repeats = F.flatten(F.transform("other", lambda x: F.array_repeat(x["word"], F.least(x["k"], F.lit(5)).cast("int"))))
    named = F.when(F.size("shared") > 0, F.col("shared")).otherwise(F.slice(repeats, 1, 5))
    key = F.when(F.size("shared") > 0, F.array_join("shared", "-")).otherwise("similar-captures")
    return lists.select("group_id", "n", key.alias("key"), F.concat(F.initcap(F.array_join(named, " ")), F.lit(" Procedure")).alias("title")).orderBy(F.desc("n"), "key", "group_id")


def repeat_groups(captures: DataFrame, least: float = 0.4, newest: int | None = None) -> DataFrame:
    """group_id, n, key, title: groups of captures (capture_id, title, observation) with like keywords, largest first.

    newest: only so many captures, by updated_at and id.
    """
    if newest is not None:
        captures = captures.orderBy(F.desc("updated_at"), F.desc("capture_id")).limit(newest)
    return named_groups(captures, cut(repeat_members(captures, least)))


def proposals(groups: DataFrame, members: DataFrame, existing: DataFrame, most: int = 3) -> DataFrame:
    """The first groups (of repeat_groups) of which no procedure has two sources yet.

    members: group_id, capture_id; existing: page_id, capture_id of the sources of procedures.
    """
    taken = members.join(existing, "capture_id").groupBy("group_id", "page_id").agg(F.countDistinct("capture_id").alias("k")).filter("k >= 2").select("group_id").distinct()
    return groups.join(taken, "group_id", "left_anti").orderBy(F.desc("n"), "key", "group_id").limit(most)


def steps(captures: DataFrame, most: int | None = 8) -> DataFrame:
    """capture_id, place, step: the steps that bullets and numbered lines of a text name, or its first plain line."""
    lines = F.split(F.coalesce("observation", F.lit("")), "\n")
    bullets = F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*([-*+]\s+|\d+[.)]\s+)\S")), lambda x: F.trim(F.regexp_replace(x, r"^\s*([-*+]\s+|\d+[.)]\s+)", "")))
    plain = F.slice(F.transform(F.filter(lines, lambda x: (F.trim(x) != "") & ~F.ltrim(x).rlike("^[#>]")), lambda x: F.trim(x)), 1, 1)
    #: Verbs that a step begins with.
    verb = r"(?i)^(check|create|deploy|ensure|inspect|record|review|run|update|verify)\b"
    said = lambda x: F.when(x.rlike(verb), x).otherwise(F.concat(F.lit("Review and apply: "), x))
    found = F.array_distinct(F.transform(F.when(F.size(bullets) > 0, bullets).otherwise(plain), lambda x: F.substring(said(F.rtrim(x, F.lit("."))), 1, 300)))
    rows = captures.select("capture_id", F.posexplode(found if most is None else F.slice(found, 1, most)).alias("place", "step"))
    return rows.withColumn("place", F.col("place") + 1)


def excerpt(body: Column) -> Column:
    """The first line that is neither a heading nor a quote, without its bullet, to 500 characters."""
    lines = F.transform(F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[#>]")), lambda x: F.regexp_replace(x, r"^[-*+ ]+", ""))
    return F.substring(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), 1, 500)


def promoted(captures: DataFrame, pages: DataFrame) -> DataFrame:
    """capture_id, target, outcome of promoting captures to their suggested targets: promoted, no_target, exists."""
    known = pages.select(F.col("page_id").alias("target"), F.lit(True).alias("_known")).distinct()
    rows = captures.select(F.col("page_id").alias("capture_id"), F.nullif(F.trim("suggested_target"), F.lit("")).alias("target"))
    outcome = F.when(F.col("target").isNull(), "no_target").when(F.col("_known"), "exists").otherwise("promoted")
    return rows.join(known, "target", "left").select("capture_id", "target", outcome.alias("outcome"))


def promotions(pages: DataFrame) -> DataFrame:
    """direction, capture_id, page_id, title, status: captures with where they were promoted to, and pages with the captures that they name as sources."""
    captures = pages.filter("kind = 'capture'").filter(F.col("page_id").rlike("^(inbox|notes)/"))
    out = captures.filter("promoted_to is not null").select(F.lit("promoted").alias("direction"), F.col("page_id").alias("capture_id"), F.col("promoted_to").alias("page_id"), "title", "status")
    named = pages.select("page_id", F.explode("sources").alias("capture_id")).filter(F.col("capture_id").rlike("^(inbox|notes)/"))
    back = named.join(captures.select(F.col("page_id").alias("capture_id"), "title", "status"), "capture_id", "left")
    return out.unionByName(back.select(F.lit("source").alias("direction"), "capture_id", "page_id", "title", "status"))


def title_words(captures: DataFrame, most: int = 5) -> DataFrame:
    """The most frequent title words, ties in order of the word."""
    words = captures.select(F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)
