"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is contaminating a document if at least percent/100 of its distinct word shingles occur in it. Containment of a
short item in a long text can't be seen in a sketch of the long text, so the sketch is the item's: under one hash
function, the item's least values. A document that holds percent/100 of n shingles lacks floor(n * (100 - percent) /
100) at most, so it holds one of the item's floor(...) + 1 least values for certain: no leak is lost, whatever the
lengths. Items are partitioned by size, in powers of two, and documents by the greatest size that they can hold; a
partition of documents meets the sketches of the sizes that fit, which are copied to it, and no others. The texts'
shingles are compared word by word afterwards. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind, materialise

#: Sketches of up to this many values, copies included, and items of up to this many shingles are broadcast; others are
#: joined by shuffle. A value takes some 100 bytes in a hash table, a shingle of five words as many.
BROADCAST_VALUES = 300_000
BROADCAST_SHINGLES = 200_000

DOC, ITEM = ["doc_id", "mark"], ["item_id", "item_mark"]


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, width: Column | int, of) -> Column:
    """of(run) for the runs of `width` words; null if there are fewer words."""
    wide = width if isinstance(width, Column) else F.lit(width)
    return F.when(F.size(words) >= wide, F.transform(F.sequence(F.lit(1), F.size(words) - wide + 1), lambda i: of(F.slice(words, i, wide))))


def _string(run: Column) -> Column:
    return F.array_join(run, " ")


def _sets(words: Column, widths: list[int], of, kind: str) -> Column:
    """The distinct of(run) of the runs of all these widths."""
    none = F.array().cast(kind)
    return bind(words, lambda w: F.array_distinct(F.concat(*(F.coalesce(_runs(w, k, of), none) for k in widths))))  # else words would be split anew for every run


def item_sets(items: DataFrame, shingle: int) -> DataFrame:
    """item_id, item_mark, width, n_item, set, hashes of each item with words: its distinct shingles, as strings and as hashes.

    An item of fewer than `shingle` words is one shingle, of all its words.
    """
    rows = items.select("item_id", F.xxhash64("text").alias("item_mark"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.lit(shingle), F.size("words")))
    sets = rows.select(*ITEM, "width", *(F.array_distinct(_runs(F.col("words"), F.col("width"), of)).alias(name) for of, name in ((_string, "set"), (F.xxhash64, "hashes"))))
    return sets.withColumn("n_item", F.size("set"))


def item_sketches(sets: DataFrame, percent: int) -> DataFrame:
    """value, item_id, item_mark, size_class: each item's least hash values, as many as make one hit certain.

    size_class is the power of two at or below n_item; all items of a class need documents of at least percent/100 of it.
    """
    keep = F.slice(F.array_sort("hashes"), 1, F.floor(F.col("n_item") * (100 - percent) / 100).cast("int") + 1)
    return sets.select(*ITEM, F.floor(F.log2("n_item")).cast("int").alias("size_class"), F.explode(keep).alias("value"))


def _greatest_class(n: Column, classes: list[int], percent: int) -> Column:
    """The greatest of the size classes that a text of n shingles can hold; null if none."""
    return F.coalesce(*(F.when(n * 100 >= F.lit(percent * 2**c).cast("long"), F.lit(c)) for c in sorted(classes, reverse=True)))


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text: mark is a hash of the text, so rows that repeat a doc_id are judged by their own texts."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text")).filter("text is not null")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def _leaks(docs: DataFrame, items: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, mark, item_id, item_mark, n_item, n_shared of every text and item of which it holds percent/100 or more."""
    kinds = "doc_id long, mark long, item_id long, item_mark long, n_item int, n_shared long"
    wanted = materialise(item_sets(items.select("item_id", F.col("text").cast("string").alias("text")).filter("item_id is not null"), shingle), "items")
    of = wanted.agg(F.collect_set("width").alias("widths"), F.collect_set(F.floor(F.log2("n_item")).cast("int")).alias("classes"), F.sum("n_item").alias("shingles")).first()
    if not of["widths"]:
        return docs.sparkSession.createDataFrame([], kinds)
    widths, classes = sorted(of["widths"]), sorted(of["classes"])  # at most `shingle`, and one a power of two
    sketch = item_sketches(wanted, percent)
    fitting = F.filter(F.array(*(F.lit(c) for c in classes)), lambda c: c >= F.col("size_class"))
    sketch = materialise(sketch.select(*ITEM, "value", F.explode(fitting).alias("doc_class")), "item-sketch")
    small = F.broadcast if sketch.count() <= BROADCAST_VALUES else (lambda df: df)
    hashed = docs.select(*DOC, _sets(words_of(F.col("text")), widths, F.xxhash64, "array<bigint>").alias("set"))
    placed = hashed.withColumn("doc_class", _greatest_class(F.size("set"), classes, percent)).filter("doc_class is not null")
    values = placed.select(*DOC, "doc_class", F.explode("set").alias("value"))
    hits = materialise(values.join(small(sketch), ["doc_class", "value"]).select(*DOC, *ITEM).distinct(), "sketch-hits")
    small = F.broadcast if (of["shingles"] or 0) <= BROADCAST_SHINGLES else (lambda df: df)
    need = hits.join(small(wanted.select(*ITEM, "n_item", "set")), ITEM).select(*DOC, *ITEM, "n_item", F.explode("set").alias("shingle"))
    near = hits.select(*DOC).distinct()
    texts = docs.join(near, _same(docs, near, DOC), "left_semi").dropDuplicates(DOC)
    own = texts.select(*DOC, F.explode(_sets(words_of(F.col("text")), widths, _string, "array<string>")).alias("shingle"))
    own = own.select(*(F.col(c).alias(f"_{c}") for c in DOC), F.col("shingle").alias("_shingle"))
    met = need.join(own, need["doc_id"].eqNullSafe(own["_doc_id"]) & (need["mark"] == own["_mark"]) & (need["shingle"] == own["_shingle"]))
    shared = met.groupBy(*DOC, *ITEM, "n_item").agg(F.count("*").alias("n_shared"))
    return shared.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every item of which a document holds percent/100 or more.

    Words are lower-cased runs of letters and digits. An item of fewer than `shingle` words is found wherever its words
    stand in this order, one behind the other. Texts that are null or have no words match nothing; rows without a doc_id
    are judged as well, items without an item_id are not; rows that repeat a doc_id or item_id are judged by their own
    texts, and the largest containment is returned once. An empty table gives no rows. Other columns are ignored. A text
    of any length is one row, whose shingles are exploded in its task.
    """
    found = _leaks(_marked(docs), items, shingle, percent).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.n_item").cast("long").alias("n_item"), "x.n_shared", "x.containment")


def decontaminate(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with their columns, that hold no item; see leaks. Every row is judged by its own text."""
    found = _leaks(_marked(docs), items, shingle, percent).select(F.col("doc_id").alias("_leak"), F.col("mark").alias("_mark")).distinct()
    found = materialise(found, "leaked")
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col("_leak")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_mark")), "left_anti")
