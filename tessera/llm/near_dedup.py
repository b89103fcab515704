"""MinHash near-dedup: bottom-k sketches from one hash function.

Each text becomes the set of its word shingles under one 63-bit hash; its sketch is the k least values. Texts with the
same set form a class, and the rest works on one row a class. Inverted lists of retained values generate overlapping
classes: short lists in full, long lists (a large group of near copies) as stars around their least member first, then,
for exactness, between whatever components are still apart. A union sketch estimates each pair's Jaccard similarity
and drops pairs so far below the threshold that one at it gets there with a probability below MISS; the full sets
decide about the others. Components of the confirmed links are
the groups. Before that, odd sketches (Mitzenmacher, Pagh and Pham, 2014) drop pairs for certain: each value of a set
flips one of ODD bits, so two sets differ in at least as many values as their bits do.

Values that many texts hold (passages that they share) are heavy. A text indexes the TAKEN least values that are not;
a pair at the threshold with at most HEAVY_SHARE of heavy values misses all of these lists with a probability below
1e-7. Texts with more heavy values are indexed by a prefix of their whole set in addition: of n values in any one
order, here heavy ones last, the first floor(n * (1 - t)) + 1 meet those of every partner for certain (t the threshold).
At a pair's first common value nothing before it is shared, so the values from its place on must suffice for the
threshold in both texts: where they don't, the value is not the pair's first, and the pair is left to that one. A long
list's leader is its member with the largest share of heavy values, which of a group of near copies is the least edited.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_texts, discard, materialise, pieces, presence_bits, presence_size, present, shingle_sets
from tessera.llm.components import components

SKETCH = 64  # values kept of each set
TAKEN = 24  # rarer values of a sketch that are indexed
HEAVY_SHARE = 0.5
NO_ID = -(2**63)  # stands for a null doc_id
MISS = 1e-9  # probability of dropping a pair at the threshold by its union sketch
ODD = 512  # bits of odd sketches
SHORT_LIST = 16  # lists up to this long are paired in full at once


def odd_sketch(values: np.ndarray) -> np.ndarray:
    """For each of ODD bits the parity of the number of values that fall on it, in longs."""
    return np.packbits((np.bincount((values & np.uint64(ODD - 1)).astype(np.int64), minlength=ODD) & 1).astype(np.uint8)).view(np.int64)


def shingle_rows(docs: DataFrame, shingle: int, sketch: int = SKETCH) -> DataFrame:
    """doc_id, mark (a hash of the text), n_shingles, set_key (128-bit hash of the whole set), the sketch and the odd sketch of each row's text."""

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole, "text")):
            sets = shingle_sets(arrow_texts(batch.column("text")), shingle)
            columns = _set_columns(batch, sets) + [pa.array([s[:sketch].view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("mark")], ["doc_id", "n_shingles", "set_key", "sketch", "odd", "mark"])

    marked = _texts(docs).withColumn("mark", F.xxhash64("text"))
    return marked.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch array<long>, odd array<long>, mark long")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _set_columns(batch, sets: list[np.ndarray]) -> list:
    """doc_id, n_shingles, set_key."""
    import pyarrow as pa
    import xxhash

    return [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]


def _close(percent: int):
    """Sizes alone allow the threshold."""
    return (F.col("a_n") * 100 >= percent * F.col("b_n")) & (F.col("b_n") * 100 >= percent * F.col("a_n"))


def _alike(percent: int):
    """The odd sketches differ in no more bits than sets at the threshold may differ in values."""
    bits = sum((F.bit_count(F.get("a_odd", F.lit(k)).bitwiseXOR(F.get("b_odd", F.lit(k)))) for k in range(ODD // 64)), F.lit(0))
    return bits * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)


def _suffice(percent: int):
    """What follows the value's place suffices for the threshold in both texts."""
    rest = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    return rest * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent


def least_common(percent: int, sketch: int) -> int:
    """Fewer of a union sketch's values than this are common to a pair at the threshold with a probability below MISS.

    By the binomial distribution; the values are drawn without replacement, which strays less.
    """
    t, below, k = percent / 100, 0.0, 0
    while k < sketch:
        below += math.comb(sketch, k) * t**k * (1 - t) ** (sketch - k)
        if below >= MISS:
            break
        k += 1
    return k


def _estimated(pairs: DataFrame, percent: int, sketch: int, exact: bool = False) -> DataFrame:
    """The pairs whose sizes, odd and union sketches don't rule the threshold out: exact where these hold both sets, else but for MISS.

    With exact, a union sketch that doesn't hold both sets rules nothing out.
    """
    low = 0 if exact else least_common(percent, sketch)
    return (
        pairs.withColumn("_union", F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, sketch))
        .withColumn("_both", F.size(F.array_intersect("_union", F.array_intersect("a_sketch", "b_sketch"))))
        .withColumn("_whole", (F.col("a_n") <= sketch) & (F.col("b_n") <= sketch) & (F.size(F.array_union("a_sketch", "b_sketch")) <= sketch))
        .filter(F.when(~(_close(percent) & _alike(percent)), False).when(F.col("_whole"), F.col("_both") * 100 >= percent * F.size("_union")).otherwise(F.col("_both") >= low))
    )


def _sides(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("set_key").alias(side), F.col("n_shingles").alias(f"{side}_n"), F.col("sketch").alias(f"{side}_sketch"), F.col("odd").alias(f"{side}_odd"), F.col("rep").alias(f"{side}_rep"))


def _likely(pairs: DataFrame, classes: DataFrame, percent: int, sketch: int, exact: bool) -> DataFrame:
    """a, b, a_rep, b_rep of the pairs (a, b) that the sketches don't rule out."""
    return _estimated(pairs.join(_sides(classes, "a"), "a").join(_sides(classes, "b"), "b"), percent, sketch, exact).select("a", "b", "a_rep", "b_rep")


def _whole_sets(chosen: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """set_key, rep, n_shingles and members, the whole set, of the chosen documents (column rep), and of a few others.

    Texts stay where they are: a bitmap of bounded size says which may be chosen. Joins on set_key and rep sort out the
    others. Where there are more chosen than such a bitmap can tell apart, the texts are joined with them by shuffle.
    """
    rep = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(rep.alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = presence_size(chosen.count())
    if size is None:
        bits = None
        rows = rows.join(chosen.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("place", F.lit(0).cast("long"))
    else:
        bits = chosen.sparkSession.sparkContext.broadcast(presence_bits(chosen.select("rep"), "rep", size))
        rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(size)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            may = batch if bits is None else batch.filter(pa.array(present(bits.value, batch.column("place").to_numpy(zero_copy_only=False))))
            for part in pieces(may, "text"):
                sets = shingle_sets(arrow_texts(part.column("text")), shingle)
                yield pa.RecordBatch.from_arrays([*_set_columns(part, sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["rep", "n_shingles", "set_key", "members"])

    return rows.mapInArrow(run, "rep long, n_shingles long, set_key binary, members array<long>")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of set keys, with their documents a_rep and b_rep, whose whole sets reach the threshold, as edges (u, v)."""
    chosen = pairs.select(F.explode(F.array("a_rep", "b_rep")).alias("rep"))
    sets = materialise(_whole_sets(chosen, docs, shingle), f"sets-{tag}")
    a, b = (sets.select(F.col("set_key").alias(s), F.col("rep").alias(f"{s}_rep"), F.col("members").alias(f"{s}_set")) for s in "ab")

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole, "a_set")):
            keep = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * 100 >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, ["a", "a_rep"]).join(b, ["b", "b_rep"]).select("a", "b", "a_set", "b_set").mapInArrow(run, "u binary, v binary")


def _heavy(rows: DataFrame, column: str, total: int) -> np.ndarray:
    """The values that occur more often than total / 2**18 and 32 times: 2**18 (2 MB) at most, however large the table."""
    counts = rows.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return np.sort(np.array([r[0] for r in counts.filter(F.col("n") > max(32, total >> 18)).select("value").collect()], np.int64))


def _frequent(batch_values: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    if not len(heavy):
        return np.zeros(len(batch_values), bool)
    return heavy[np.minimum(np.searchsorted(heavy, batch_values), len(heavy) - 1)] == batch_values


def _lists(column):
    """The values of an Arrow list column end to end, and the offsets of its rows."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)


def _rare_postings(classes: DataFrame, heavy) -> DataFrame:
    """value, set_key, n of the TAKEN least values of each sketch that are not heavy."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, offsets = _lists(batch.column("sketch"))
            rare = ~_frequent(values, heavy.value)
            row = np.repeat(np.arange(len(batch)), np.diff(offsets))
            upto = np.concatenate(([0], np.cumsum(rare)))
            take = rare & (upto[:-1] - upto[offsets[row]] < TAKEN)
            row = pa.array(row[take])
            yield pa.RecordBatch.from_arrays([pa.array(values[take]), batch.column("set_key").take(row), batch.column("n_shingles").take(row)], ["value", "set_key", "n"])

    return classes.select("set_key", "n_shingles", "sketch").mapInArrow(run, "value long, set_key binary, n long").withColumn("place", F.lit(0).cast("long")).withColumn("share", F.lit(0.0))


def _mostly_heavy(classes: DataFrame, heavy) -> DataFrame:
    """rep, set_key of the classes of which more than HEAVY_SHARE of the sketch is heavy."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values, offsets = _lists(batch.column("sketch"))
            upto = np.concatenate(([0], np.cumsum(_frequent(values, heavy.value))))
            share = (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
            yield batch.select(["set_key", "rep"]).filter(pa.array(share > HEAVY_SHARE))

    return classes.select("set_key", "rep", "sketch").mapInArrow(run, "set_key binary, rep long")


def _prefix_postings(sets: DataFrame, heavy, percent: int) -> DataFrame:
    """value, set_key, n, place, share of the values of each whole set that no partner can lack all of, heavy ones last.

    place is the value's number in this order, share the heavy part of the whole set.
    """

    def run(batches):
        import pyarrow as pa

        for batch in (part for whole in batches for part in pieces(whole, "members")):
            values, offsets = _lists(batch.column("members"))
            n = np.diff(offsets)
            row = np.repeat(np.arange(len(batch)), n)
            often = _frequent(values, heavy.value)
            order = np.lexsort((values, often, row))
            place = np.arange(len(values)) - offsets[row]
            taken = place < (n * (100 - percent) // 100 + 1)[row]
            share = np.bincount(row, weights=often, minlength=len(batch)) / np.maximum(n, 1)
            take, at = order[taken], row[taken]
            yield pa.RecordBatch.from_arrays([pa.array(values[take]), batch.column("set_key").take(pa.array(at)), batch.column("n_shingles").take(pa.array(at)), pa.array(place[taken]), pa.array(share[at])], ["value", "set_key", "n", "place", "share"])

    return sets.select("set_key", "n_shingles", "members").mapInArrow(run, "value long, set_key binary, n long, place long, share double")


def _postings(classes: DataFrame, docs: DataFrame, shingle: int, percent: int, exact: bool) -> DataFrame:
    """value, set_key, n, place, share: the inverted lists' rows; place is 0 for values of sketches, which are in no such order.

    With exact, all classes have the postings of their prefixes.
    """
    spark = classes.sparkSession.sparkContext
    total = classes.agg(F.sum(F.size("sketch"))).first()[0] or 0
    heavy = spark.broadcast(_heavy(classes, "sketch", total))
    rows = _rare_postings(classes, heavy)
    mostly = classes.select("set_key", "rep") if exact else materialise(_mostly_heavy(classes, heavy), "mostly-heavy")
    if mostly.isEmpty():
        return rows
    sets = materialise(_whole_sets(mostly, docs, shingle).join(mostly, ["set_key", "rep"]), "heavy-sets")
    size = sets.agg(F.sum("n_shingles")).first()[0] or 0
    return rows.unionAll(_prefix_postings(sets, spark.broadcast(_heavy(sets, "members", size)), percent))


def _across(hits: DataFrame, found: DataFrame, classes: DataFrame, percent: int, sketch: int, exact: bool) -> DataFrame | None:
    """Likely pairs within long lists whose members' components are still apart; None if there are no such lists."""
    long = hits.filter(F.col("size") > SHORT_LIST).join(found.withColumnRenamed("node", "set_key"), "set_key", "left")
    long = materialise(long.select("value", "set_key", "leader", "place", F.coalesce("root", "set_key").alias("root")), "long")
    apart = materialise(long.groupBy("value").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("value"), "apart")
    if apart.isEmpty():
        return None
    mains = materialise(long.filter("set_key = leader").select("value", F.col("root").alias("main")).join(apart, "value"), "mains")
    rows = materialise(long.join(mains, "value").join(classes.select("set_key", F.col("n_shingles").alias("n"), "odd"), "set_key"), "open")
    # Members outside the component of the list's leader meet all others; those inside don't meet each other.
    a, b = (rows.select("value", *(F.col(x).alias(y) for x, y in (("set_key", s), ("n", f"{s}_n"), ("place", f"{s}_place"), ("odd", f"{s}_odd"), ("root", f"{s}_root"), ("leader", f"{s}_leader"), ("main", f"{s}_main")))) for s in "ab")
    untried = (F.col("a_root") != F.col("b_root")) & (F.col("b") != F.col("b_leader")) & (F.col("a") != F.col("a_leader")) & _close(percent) & _suffice(percent)
    once = (F.col("a_root") != F.col("a_main")) & ((F.col("a") < F.col("b")) | (F.col("b_root") == F.col("b_main")))
    # Written before the sketches are joined, else their dear comparison would move into this join.
    pairs = materialise(a.join(b, (a["value"] == b["value"]) & untried & once & _alike(percent)).select("a", "b").distinct(), "pairs-across")
    return _likely(pairs, classes, percent, sketch, exact)


def near_components(docs: DataFrame, shingle: int = 5, percent: int = 80, sketch: int = SKETCH, exact: bool = False) -> DataFrame:
    """Groups of near duplicates: doc_id, n_shingles, component_id, one row per row of docs.

    Two texts are linked if their sets of shingles of `shingle` words have a Jaccard similarity of percent/100 or more;
    component_id is the least doc_id that links reach. Texts without words (null, empty, blank) are linked with nothing
    and are their own component. Equal texts are one node, whatever their number. A null doc_id takes part, but never
    becomes a component_id unless its group has no other; rows that repeat a doc_id are judged by their own texts. An
    empty table gives no rows. Needs columns doc_id and text and ignores others. A text of any length is one row: its
    set is made and compared in its task.

    A link is missed with a probability of about 1e-7 at the threshold, and less above it; with exact, none is (but for
    equal 63-bit hashes of different shingles), at the cost of the prefixes of all sets in the inverted lists.
    """
    return _grouped(docs, shingle, percent, sketch, exact).select("doc_id", "n_shingles", "component_id")


def _grouped(docs: DataFrame, shingle: int, percent: int, sketch: int, exact: bool) -> DataFrame:
    """near_components() with `mark`, a hash of the text, and `group`, which rows share just if links join their texts; null without words."""
    docs = docs.select("doc_id", "text")
    rows = materialise(shingle_rows(docs, shingle, sketch), "sketches")
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"))
    classes = materialise(classes.withColumn("rep", F.coalesce("doc_id", F.lit(NO_ID))), "classes")
    postings = _postings(classes, docs, shingle, percent, exact)
    near = F.col("place") * (100 + percent) <= F.col("n") * (100 - percent)
    leader = F.max(F.when(near, F.struct("share", "set_key")))["set_key"]
    lists = materialise(postings.groupBy("value").agg(F.count("*").alias("size"), leader.alias("leader")).filter("size > 1 and leader is not null"), "lists")
    hits = postings.join(lists, "value").groupBy("value", "set_key").agg(F.max("n").alias("n"), F.min("place").alias("place"), F.max("size").alias("size"), F.max("leader").alias("leader"))
    hits = materialise(hits, "hits")
    discard(lists)
    star = hits.filter((F.col("size") > SHORT_LIST) & (F.col("set_key") != F.col("leader"))).select(F.col("set_key").alias("a"), F.col("leader").alias("b"))
    short = hits.filter(F.col("size") <= SHORT_LIST)
    left, right = (short.select("value", F.col("set_key").alias(s), F.col("n").alias(f"{s}_n"), F.col("place").alias(f"{s}_place")) for s in "ab")
    pairs = left.join(right, (left["value"] == right["value"]) & (F.col("a") < F.col("b")) & _close(percent) & _suffice(percent)).select("a", "b")
    tried = materialise(star.unionAll(pairs).distinct(), "pairs")
    likely = materialise(_likely(tried, classes, percent, sketch, exact), "likely")
    discard(tried)
    links = materialise(_confirmed(likely, docs, shingle, percent, "first"), "links")
    discard(likely)
    found = materialise(components(links), "found")
    more = _across(hits, found, classes, percent, sketch, exact)
    if more is not None:
        more = materialise(more, "likely-across")
        if not more.isEmpty():
            links = links.unionAll(materialise(_confirmed(more, docs, shingle, percent, "across"), "links-across"))
            found = materialise(components(links), "found")
    members = materialise(classes.select("set_key", "doc_id").join(found.withColumnRenamed("node", "set_key"), "set_key"), "members")
    least = materialise(members.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    ids = materialise(members.join(least, "root").select("set_key", "component_id"), "ids")
    groups = found.withColumnRenamed("node", "set_key")
    named = materialise(classes.join(ids, "set_key", "left").join(groups, "set_key", "left").select("set_key", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "set_key").alias("group")), "named")
    out = rows.select("doc_id", "mark", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n_shingles") > 0, F.col("group")).alias("group"))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, then of the least hash of its text.

    Rows are judged by their own texts, also where they repeat a doc_id; of equal rows (doc_id and text) of a group one
    stays. Rows without a doc_id come after all others. Texts without words are near none, so all their rows stay. The
    columns of docs are kept as they are; an empty table stays empty. See near_components.
    """
    groups = materialise(_grouped(docs, shingle, percent, SKETCH, exact), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    first = groups.filter("group is not null").groupBy("group").agg(F.min(order).alias("x")).select("group", F.col("x.doc_id").alias("doc_id"), F.col("x.mark").alias("mark"))
    times = groups.filter("group is not null").groupBy("doc_id", "mark").agg(F.count("*").alias("n"))
    counted = first.join(times.withColumnsRenamed({"doc_id": "_i", "mark": "_m"}), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("mark") == F.col("_m")))
    wordless = groups.filter("group is null").select("doc_id", "mark").distinct()
    kept = materialise(counted.select("doc_id", "mark", "n").unionByName(wordless.withColumn("n", F.lit(1).cast("long"))), "kept")
    again = materialise(kept.filter("n > 1"), "kept-repeated")

    def among(some: DataFrame) -> DataFrame:
        keys = some.select(F.col("doc_id").alias("_kept"), F.col("mark").alias("_mark"))
        return docs.join(keys, docs["doc_id"].cast("long").eqNullSafe(F.col("_kept")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_mark")), "left_semi")

    out = among(kept.filter("n = 1"))
    if again.isEmpty():
        return out
    one = among(again).withColumn("_mark", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "_mark"]).drop("_mark")
    return out.unionByName(one)
