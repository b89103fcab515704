"""Fill-in-middle: cut texts at units of a finite automaton, and put the middle last.

Units (code points, words or lines) and the sentinels inside a text are found by one small automaton over UTF-8 bytes.
Its run is parallel: a stretch of bytes is taken as a function from the state before it to the state after it, with the
units and sentinels met on the way from each state. Such functions compose associatively. Inside a task the stretches
are lanes of a NumPy buffer. A long text's chunks are scanned by tasks of their own; their functions are composed in a
tree of bounded groups, and each cut is looked up by going down the tree again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise, pieces

CHUNK_BYTES = 1 << 16  # a longer text is scanned in chunks of this size, by tasks of their own
FAN = 64  # functions composed in one step of the tree
MOST_BYTES = 1 << 31  # of one value in Spark
LANES = 2048
SENTINELS = ("<P>", "<S>", "<M>")
RESET, IDLE = 0xFF, 0xFE  # bytes that UTF-8 never has: between two texts, and padding
UNIT, HIT = 1, 2
OUTPUTS = ("form", "n_units", "prefix_units", "middle_units", "output")


@dataclass(frozen=True)
class Automaton:
    """step[byte, state] is the next state, emit[byte, state] has UNIT where a unit begins with the byte and HIT where a
    sentinel ends with it. State 0 is the start."""

    step: np.ndarray
    emit: np.ndarray

    @property
    def states(self) -> int:
        return self.step.shape[1]


def _unit_rule(units: str) -> tuple[int, callable]:
    """States and (state, byte) -> (state, begins a unit)."""
    blank = {0x20, *range(0x09, 0x0E)}
    rules = {
        "chars": (1, lambda s, b: (0, b & 0xC0 != 0x80)),
        "words": (2, lambda s, b: (0, False) if b in blank else (1, s == 0)),
        "lines": (2, lambda s, b: (0 if b == 0x0A else 1, s == 0)),
    }
    if units not in rules:
        raise ValueError(f"units are one of {sorted(rules)}")
    return rules[units]


def check_sentinels(sentinels: tuple[str, ...]) -> None:
    """Sentinels must be found again wherever they are put: none empty, none inside another, no end that begins one."""
    for a in sentinels:
        for b in sentinels:
            overlap = any(a.endswith(b[:k]) for k in range(1, len(b)) if k < len(a))
            if not a or overlap or (a in b and a != b) or sentinels.count(a) > 1:
                raise ValueError(f"sentinels {a!r} and {b!r} could be mistaken for each other")


@lru_cache(maxsize=16)
def automaton(units: str = "chars", sentinels: tuple[str, ...] = SENTINELS) -> Automaton:
    """The product of the units' rule and a matcher of the sentinels, with equal states merged."""
    check_sentinels(sentinels)
    words = [s.encode() for s in sentinels]
    heads = sorted({w[:k] for w in words for k in range(len(w))} | {b""}, key=lambda h: (len(h), h))
    count, rule = _unit_rule(units)
    pairs = [(u, h) for h in heads for u in range(count)]
    number = {p: k for k, p in enumerate(pairs)}
    step = np.zeros((256, len(pairs)), np.int64)
    emit = np.zeros((256, len(pairs)), np.uint8)
    for k, (u, h) in enumerate(pairs):
        for b in range(256):
            if b == RESET or b == IDLE:
                step[b, k] = 0 if b == RESET else k
                continue
            v, begins = rule(u, b)
            seen = h + bytes([b])
            tail = next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in heads)
            step[b, k] = number[v, tail]
            emit[b, k] = UNIT * begins | HIT * any(seen.endswith(w) for w in words)
    group = np.zeros(len(pairs), np.int64)
    while True:  # refine groups of states until equal ones go to equal ones
        signs = [(int(group[k]), emit[:, k].tobytes(), group[step[:, k]].tobytes()) for k in range(len(pairs))]
        order = {s: g for g, s in reversed(list(enumerate(dict.fromkeys(signs))))}
        finer = np.array([order[s] for s in signs])
        if (finer == group).all():
            break
        group = finer
    _, first = np.unique(group, return_index=True)
    step, emit = group[step[:, first]], emit[:, first]
    step[IDLE] = np.arange(len(first))
    return Automaton(step.astype(np.uint8), emit)


@dataclass(frozen=True)
class Functions:
    """One function a row: for each state before, the state after, and the units and sentinels met."""

    step: np.ndarray
    units: np.ndarray
    hits: np.ndarray

    def then(self, after: Functions) -> Functions:
        go = self.step.astype(np.int64)
        pick = lambda x: np.take_along_axis(x, go, axis=1)
        return Functions(pick(after.step), self.units + pick(after.units), self.hits + pick(after.hits))

    def rows(self, at) -> Functions:
        return Functions(self.step[at], self.units[at], self.hits[at])

    def total(self) -> Functions:
        """All rows composed into one, by pairs."""
        out = self
        while len(out.step) > 1:
            even = len(out.step) // 2 * 2
            paired = out.rows(slice(0, even, 2)).then(out.rows(slice(1, even, 2)))
            rest = out.rows(slice(even, None))
            out = Functions(*(np.concatenate(x) for x in ((paired.step, rest.step), (paired.units, rest.units), (paired.hits, rest.hits))))
        return out


def _lanes(data: np.ndarray) -> np.ndarray:
    """Bytes dealt to lanes: column k holds the k-th byte of each lane; the last lane is padded."""
    wide = min(LANES, max(1, len(data) // 64))
    deep = -(-max(1, len(data)) // wide)
    padded = np.full(wide * deep, IDLE, np.uint8)
    padded[: len(data)] = data
    return np.ascontiguousarray(padded.reshape(wide, deep).T)


def lane_functions(lanes: np.ndarray, auto: Automaton) -> Functions:
    """The function of each lane, all lanes a byte at a time."""
    s = auto.states
    step, emit = auto.step.ravel(), auto.emit.ravel()
    state = np.tile(np.arange(s, dtype=np.uint8), (lanes.shape[1], 1))
    units, hits = np.zeros(state.shape, np.int64), np.zeros(state.shape, np.int64)
    for column in lanes:
        at = column.astype(np.int32)[:, None] * s + state
        met = emit[at]
        units += met & UNIT
        hits += met >> 1
        state = step[at]
    return Functions(state, units, hits)


def entry_states(step: np.ndarray, start: int) -> np.ndarray:
    """The state before each lane, by a doubling scan of the compositions."""
    before = np.concatenate([np.arange(step.shape[1], dtype=step.dtype)[None], step[:-1]])
    k = 1
    while k < len(before):
        before[k:] = np.take_along_axis(before[k:], before[:-k].astype(np.int64), axis=1)
        k *= 2
    return before[:, start]


def emissions(data: np.ndarray, auto: Automaton, start: int = 0) -> np.ndarray:
    """What every byte emits, from a state: functions of lanes, their entry states, then one exact run of all lanes."""
    lanes = _lanes(data)
    state = entry_states(lane_functions(lanes, auto).step, start).astype(np.int32)
    out = np.empty(lanes.shape, np.uint8)
    step, emit, s = auto.step.ravel(), auto.emit.ravel(), auto.states
    for k, column in enumerate(lanes):
        at = column.astype(np.int32) * s + state
        out[k] = emit[at]
        state = step[at]
    return out.T.reshape(-1)[: len(data)]


def chunk_function(chunk: bytes, auto: Automaton) -> Functions:
    """One chunk's function, of one row."""
    return lane_functions(_lanes(np.frombuffer(chunk, np.uint8)), auto).total()


def _drawn(h: list[int], n: int) -> tuple[int, int]:
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return min(a, b), max(a, b)


def _form(n: int, held: bool, h: list[int], rate: int, spm: int) -> str:
    if n == 0 or held or h[2] % 100 >= rate:
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def _assembled(text: bytes, form: str, a: int, b: int, marks: list[bytes]) -> bytes:
    if form == "plain":
        return text
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    return b"".join([p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle])


def _out_batch(part, made: list[tuple]):
    import pyarrow as pa

    form, n, first, second, output = zip(*made) if made else ([], [], [], [], [])
    cols = [pa.array(form, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([part.column("row"), *cols], ["row", *OUTPUTS])


def _whole(batches: Iterator, units: str, sentinels: tuple[str, ...], rate: int, spm: int) -> Iterator:
    """Texts of one chunk at most: many are scanned at once, with a reset between them."""
    auto, marks = automaton(units, sentinels), [s.encode() for s in sentinels]
    for batch in batches:
        for part in pieces(batch, "body"):
            texts = part.column("body").to_pylist()
            ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))
            met = emissions(np.frombuffer(b"\xff".join(texts), np.uint8), auto)
            starts, found = np.flatnonzero(met & UNIT), np.flatnonzero(met & HIT)
            first = np.searchsorted(starts, begins)
            counts = np.searchsorted(starts, ends) - first
            held = np.searchsorted(found, ends) > np.searchsorted(found, begins)
            made = []
            for k, (text, h) in enumerate(zip(texts, part.column("draw").to_pylist())):
                n = int(counts[k])
                form = _form(n, bool(held[k]), h, rate, spm)
                if form == "plain":
                    made.append((form, n, None, None, text))
                    continue
                cut = _drawn(h, n)
                a, b = (int(starts[first[k] + c] - begins[k]) if c < n else len(text) for c in cut)
                a = a if cut[0] else 0
                b = b if cut[1] else 0
                made.append((form, n, cut[0], cut[1] - cut[0], _assembled(text, form, a, b, marks)))
            yield _out_batch(part, made)


def _chunks(batches: Iterator, size: int) -> Iterator:
    """(key, place, bytes) of every chunk of long texts, a few chunks at a time."""
    import pyarrow as pa

    for batch in batches:
        for key, body in zip(batch.column("key"), batch.column("body")):
            view = body.as_buffer()
            for at in range(0, view.size, size * 8):
                cut = [view.slice(k, min(size, view.size - k)).to_pybytes() for k in range(at, min(view.size, at + size * 8), size)]
                places = [at // size + k for k in range(len(cut))]
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(cut), pa.string()), pa.array(places, pa.int64()), pa.array(cut, pa.binary())], ["key", "place", "chunk"])


def _functions(batches: Iterator, units: str, sentinels: tuple[str, ...]) -> Iterator:
    """(key, place, step, units, hits) of chunks."""
    import pyarrow as pa

    auto = automaton(units, sentinels)
    for batch in batches:
        found = [chunk_function(c, auto) for c in batch.column("chunk").to_pylist()]
        cols = [pa.array([getattr(f, n)[0].tolist() for f in found], pa.list_(pa.int64())) for n in ("step", "units", "hits")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("place"), *cols], ["key", "place", "step", "units", "hits"])


def _at(array: Column, state: Column) -> Column:
    return F.element_at(array, (state + 1).cast("int"))


def _composed(level: DataFrame) -> DataFrame:
    """(key, place, step, units, hits, parts) of groups of FAN consecutive functions, with the functions themselves."""
    one = F.struct("place", "step", "units", "hits")
    groups = level.groupBy("key", F.expr(f"place div {FAN}").alias("place")).agg(F.sort_array(F.collect_list(one)).alias("parts"))

    def then(a: Column, b: Column) -> Column:
        go = lambda counts, more: F.zip_with(counts, a["step"], lambda c, s: c + _at(more, s))
        return F.struct(F.transform(a["step"], lambda s: _at(b["step"], s)).alias("step"), go(a["units"], b["units"]).alias("units"), go(a["hits"], b["hits"]).alias("hits"))

    first = F.col("parts")[0]
    whole = F.aggregate(F.slice("parts", 2, FAN), F.struct(first["step"].alias("step"), first["units"].alias("units"), first["hits"].alias("hits")), then)
    return groups.withColumn("f", whole).select("key", "place", F.col("f.step").alias("step"), F.col("f.units").alias("units"), F.col("f.hits").alias("hits"), "parts")


def _descended(wanted: DataFrame, groups: DataFrame) -> DataFrame:
    """wanted (key, which, k, place, state, before) one level further down: the part of the group in which unit k begins."""

    def step(acc: Column, part: Column) -> Column:
        after = acc["before"] + _at(part["units"], acc["state"])
        here = acc["place"].isNull() & (F.col("k") < after)
        stay = acc["place"].isNotNull() | here
        return F.struct(
            F.when(stay, acc["state"]).otherwise(_at(part["step"], acc["state"])).alias("state"),
            F.when(stay, acc["before"]).otherwise(after).alias("before"),
            F.when(here, part["place"]).otherwise(acc["place"]).alias("place"),
        )

    none = F.struct(F.col("state").alias("state"), F.col("before").alias("before"), F.lit(None).cast("long").alias("place"))
    found = wanted.join(groups.select("key", "place", "parts"), ["key", "place"]).withColumn("at", F.aggregate("parts", none, step))
    return found.select("key", "which", "k", F.col("at.place").alias("place"), F.col("at.state").alias("state"), F.col("at.before").alias("before"))


def _levels(chunk_bytes: int) -> int:
    most, levels = MOST_BYTES // chunk_bytes, 1
    while FAN**levels < most:
        levels += 1
    return levels


def _long_cuts(long: DataFrame, units: str, sentinels: tuple[str, ...], chunk_bytes: int) -> DataFrame:
    """(key, n, held, cuts) of long texts; a cut (which, k, place, state, before) says in which chunk unit k begins."""
    row = F.monotonically_increasing_id()  # spreads the chunks of repeated rows as well
    cut = long.select("key", "body").mapInArrow(lambda it: _chunks(it, chunk_bytes), "key string, place long, chunk binary")
    spread = cut.withColumn("spread", row).repartition("key", "place", "spread").select("key", "place", "chunk")
    scanned = spread.mapInArrow(lambda it: _functions(it, units, sentinels), "key string, place long, step array<long>, units array<long>, hits array<long>")
    once = scanned.groupBy("key", "place").agg(*(F.min(c).alias(c) for c in ("step", "units", "hits")))  # equal rows, equal functions
    levels = [_composed(materialise(once, "fim-functions"))]
    for _ in range(_levels(chunk_bytes) - 1):
        levels.append(_composed(levels[-1].select("key", "place", "step", "units", "hits")))
    top = levels[-1].select("key", F.col("units")[0].alias("n"), (F.col("hits")[0] > 0).alias("held"))
    draws = long.select("key", "draw").dropDuplicates(["key"])
    known = top.join(draws, "key")
    a, b = (F.expr(f"draw[{i}] % (n + 1)") for i in (0, 1))
    known = known.withColumn("ks", F.array(F.least(a, b), F.greatest(a, b)))
    wanted = known.select("key", F.posexplode("ks").alias("which", "k"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("state"), F.lit(0).cast("long").alias("before"), "n")
    inside = wanted.filter("k < n and k > 0").drop("n")  # the other two cuts are the text's ends
    for groups in reversed(levels):
        inside = _descended(inside, groups)
    cuts = inside.groupBy("key").agg(F.collect_list(F.struct("which", "place", "state", F.expr("k - before").alias("skip"))).alias("cuts"))
    return known.select("key", "n", "held", "ks").join(cuts, "key", "left")


def _cut_long(batches: Iterator, units: str, sentinels: tuple[str, ...], rate: int, spm: int, size: int) -> Iterator:
    """Long texts with their cuts known to the chunk: only these chunks are scanned again."""
    auto, marks = automaton(units, sentinels), [s.encode() for s in sentinels]
    for batch in batches:
        for i in range(len(batch)):
            part = batch.slice(i, 1)
            text, h, n, held, ks, cuts = (part.column(c)[0].as_py() for c in ("body", "draw", "n", "held", "ks", "cuts"))
            form = _form(n, held, h, rate, spm)
            at = [0 if k == 0 else len(text) for k in ks]
            for cut in cuts or []:
                begin = cut["place"] * size
                met = emissions(np.frombuffer(text[begin : begin + size], np.uint8), auto, cut["state"])
                at[cut["which"]] = begin + int(np.flatnonzero(met & UNIT)[cut["skip"]])
            plain = form == "plain"
            yield _out_batch(part, [(form, n, None if plain else ks[0], None if plain else ks[1] - ks[0], _assembled(text, form, at[0], at[1], marks))])


def fill_in_middle(docs: DataFrame, units: str = "chars", sentinels: tuple[str, ...] = SENTINELS, seed: int = 1, rate: int = 90, spm: int = 20, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs with form (plain, psm, spm), n_units, prefix_units, middle_units (null if plain) and output.

    A text of n units is cut before two units drawn from the sha256 of `seed:doc_id`, a cut at n being its end; what
    stands before the first unit belongs to the prefix, but to none at a cut of 0. `rate` percent of the texts are cut,
    `spm` percent of these with the suffix first. A text without units, or one that holds a sentinel, stays plain, so
    restore() always gives the text back. Null counts as empty. The draw of a row without doc_id is that of `seed:`; rows
    of one doc_id share their draw. Equal rows are kept, each with its output. Older columns of these names are replaced.
    Texts over chunk_bytes are scanned in chunks by many tasks; a row's output is one value and so made by one task.
    """
    auto = automaton(units, sentinels)
    assert auto.states < 256
    base = docs.drop(*OUTPUTS)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = base.select(F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("row"), body.alias("body"), draw.alias("draw"))
    schema = rows.select("row", F.lit("").alias("form"), *(F.lit(0).cast("long").alias(c) for c in OUTPUTS[1:4]), F.lit("").alias("output")).schema
    for field in schema.fields:
        field.nullable = True
    small = rows.filter(F.octet_length("body") <= chunk_bytes).mapInArrow(lambda it: _whole(it, units, sentinels, rate, spm), schema)
    key = F.concat_ws(":", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.sha2("body", 256))
    long = rows.filter(F.octet_length("body") > chunk_bytes).withColumn("key", key)
    spread = 8  # a row repeated without end is one key: its copies are dealt out to as many rows of the cuts
    cuts = _long_cuts(long, units, sentinels, chunk_bytes).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = long.withColumn("copy", F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int"))
    joined = dealt.join(cuts, ["key", "copy"]).select("row", "body", "draw", "n", "held", "ks", "cuts")
    large = joined.mapInArrow(lambda it: _cut_long(it, units, sentinels, rate, spm, chunk_bytes), schema)
    return small.unionByName(large).select("row.*", *OUTPUTS)


def restore(output: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text, from an output and its form alone: no sentinel occurs in a text that was cut."""
    p, s, m = sentinels
    middle = F.substring_index(output, m, -1)
    rest = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(rest, s, 1), p, -1), middle, F.substring_index(rest, s, -1))
    spm = F.concat(F.substring_index(rest, p, -1), middle, F.substring_index(F.substring_index(rest, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
