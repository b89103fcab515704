"""Toxicity: a learned lexicon, found through misspellings, weighed by what stands around each find.

Words that mark toxic documents are learned from labels and kept in a trie. A text's words run through the product of the
trie and Levenshtein automata for its terms, made deterministic as states are first met, so a misspelled term costs no more
than a right one. Each find is scored by its window: quotation marks and reporting words speak for a quotation, a second
person for abuse. A logistic curve over a document's finds gives its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialise, pieces

SAMPLE_ROWS = 20_000  # labelled documents that a model is fitted on at most
MOST_TERMS = 2_000
LEAST_PLACES = 3  # pairs of neighbours between which a term stands in toxic documents at least
THRESHOLD = 0.5
STRETCH = 1 << 16  # characters taken at once
AROUND, WINDOW = 300, 6  # characters looked at on each side of a find, and words of them
KNOWN_WORDS = 300_000  # harmless words, and states, that a worker remembers

# Signs written for letters, cue words of reports and of the second person, and what they weigh before any
# label is seen: (always, inside quotation marks, a report, a second person).
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}
REPORTS = frozenset("said says saying wrote writes quote quoted quotes quoting called calls calling word words term terms means meaning reported reports insult insults dit mot mots terme sagte schrieb wort wörter begriff zitat dijo escribió palabra palabras término cita".split())
PERSONS = frozenset("you your yours you're u ya du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes eres".split())
PRIOR = (3.0, -4.0, -2.0, 1.0)

_WORD = re.compile(r"[^\W_](?:[@$*|]*[^\W_])*")
_LETTERS = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1{2,}")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits, which may have signs written for letters inside."""
    return _WORD.findall(text.lower())


def stretches(text: str, size: int = STRETCH) -> Iterator[tuple[int, str]]:
    """(place, part) of a text, cut where no word goes on."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield at, text[at:end]
        at = end


def edits_allowed(term: str) -> int:
    """Errors in which a misspelling may differ: none in short terms, two in long ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class TermAutomaton:
    """The intersection of the trie of the terms with the Levenshtein automata that accept their misspellings.

    A state is the set of (trie node, errors so far) that the letters read may have led to, an entry being left out if the
    same node is there with fewer errors. States are made when they are first met and remembered by number. A sign written
    for a letter counts as it, `*` as any one letter, neither as an error.
    """

    def __init__(self, terms: list[str]):
        self.terms = list(terms)
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.errors: list[int] = [0]  # the most that any term below a node allows
        for k, term in enumerate(self.terms):
            node = 0
            allowed = edits_allowed(term)
            self.errors[0] = max(self.errors[0], allowed)
            for c in term:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append(None)
                    self.errors.append(0)
                node = self.child[node][c]
                self.errors[node] = max(self.errors[node], allowed)
            self.ends[node] = k
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self._number({})
        self.start = self._number(self._closed({0: 0}))

    def _number(self, best: dict[int, int]) -> int:
        state = frozenset(best.items())
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return self.numbers[state]

    def _closed(self, best: dict[int, int]) -> dict[int, int]:
        """With the nodes reached by leaving letters of a term out."""
        todo = list(best.items())
        while todo:
            node, e = todo.pop()
            if best[node] < e:
                continue
            for after in self.child[node].values():
                if e + 1 <= self.errors[after] and e + 1 < best.get(after, 99):
                    best[after] = e + 1
                    todo.append((after, e + 1))
        return best

    def _step(self, number: int, c: str) -> int:
        letters = {c, LOOKALIKES.get(c, c)}
        best: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.errors[node] and e < best.get(node, 99):
                best[node] = e

        for node, e in self.states[number]:
            reach(node, e + 1)  # a letter too many
            for label, after in self.child[node].items():
                reach(after, e if label in letters or c == "*" else e + 1)
        return self._number(self._closed(best))

    def find(self, word: str) -> list[tuple[int, int]]:
        """(term number, errors) of all terms that the word may stand for; an exact term alone if it is one."""
        number = self.start
        for c in word:
            after = self.steps[number].get(c)
            if after is None:
                if len(self.states) > KNOWN_WORDS:
                    self._forget()
                    return self.find(word)
                after = self.steps[number][c] = self._step(number, c)
            number = after
            if number == 0:
                return []
        found = [(self.ends[node], e) for node, e in self.states[number] if self.ends[node] is not None and e <= edits_allowed(self.terms[self.ends[node]])]
        exact = [f for f in found if f[1] == 0 and self.terms[f[0]] == word]
        return exact or sorted(found)


def misspellings(automaton: TermAutomaton, word: str) -> list[tuple[int, int]]:
    """find(), and find() of the word with runs of three letters or more taken as one letter, the latter as an error."""
    found = automaton.find(word)
    if not found and _RUN.search(word):
        found = [(k, max(1, e)) for k, e in automaton.find(_RUN.sub(r"\1", word))]
    return found


def context(text: str, begin: int, end: int) -> tuple[int, int, int, int]:
    """(1, inside quotation marks, a reporting word before, a second person near) of a find."""
    before, after = text[max(0, begin - AROUND) : begin].rpartition("\n")[2], text[end : end + AROUND].partition("\n")[0]
    quoted = before.count('"') % 2 == 1 and '"' in after
    for opening, closing in (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’")):
        quoted = quoted or (before.rfind(opening) > before.rfind(closing) and closing in after)
    near = words_of(before)[-WINDOW:]
    return 1, int(quoted), int(any(w in REPORTS for w in near)), int(any(w in PERSONS for w in near + words_of(after)[:WINDOW]))


@dataclass(frozen=True)
class Model:
    """weights[term] = (spelled right, misspelled); cues: what the four parts of a context weigh; curve: bias and weights
    of a document's statistics."""

    weights: dict[str, tuple[float, float]]
    cues: tuple[float, ...] = PRIOR
    curve: tuple[float, ...] = (-3.0, 0.0, 0.0, 0.0)


class Scorer:
    """Finds terms in texts under a model; remembers words that are no terms."""

    def __init__(self, model: Model):
        self.model = model
        self.terms = sorted(model.weights)
        self.automaton = TermAutomaton(self.terms)
        self.harmless: set[str] = set()
        self.found: dict[str, list[tuple[int, int]]] = {}

    def finds(self, text: str) -> Iterator[tuple[int, int, int, tuple]]:
        """(term number, errors, place, context) of every find in the whole text."""
        for at, part in stretches(text):
            low = part.lower()
            new = set(_WORD.findall(low)) - self.harmless
            if len(self.harmless) > KNOWN_WORDS:
                self.harmless.clear()
            hits = {}
            for word in new:
                found = self.found.get(word)
                if found is None:
                    found = misspellings(self.automaton, word)
                    if not found:
                        self.harmless.add(word)
                        continue
                    if len(self.found) > KNOWN_WORDS:
                        self.found.clear()
                    self.found[word] = found
                hits[word] = found
            if hits:
                whole = text if len(low) == len(part) else None
                for m in _WORD.finditer(low):
                    if m.group() in hits:
                        # Lower-casing may lengthen a text; its places are then those of the lower-cased part.
                        around = context(whole, at + m.start(), at + m.end()) if whole is not None else context(low, m.start(), m.end())
                        for k, e in hits[m.group()]:
                            yield k, e, at + m.start(), around

    def worth(self, term: int, errors: int, around: tuple) -> float:
        """What one find weighs: its term's weight, less if it looks like a quotation."""
        weight = self.model.weights[self.terms[term]][errors > 0]
        pull = sum(c * x for c, x in zip(self.model.cues, around))
        return weight / (1 + float(np.exp(-pull)))

    def statistics(self, text: str) -> tuple[float, float, float]:
        """Of a document: the sum of its terms' weightiest finds, the weightiest of all, the sum by the root of its length."""
        places: dict[int, tuple[float, int]] = {}
        for k, e, place, around in self.finds(text):
            w = self.worth(k, e, around)
            if w > places.get(place, (0.0, k))[0]:
                places[place] = (w, k)  # a misspelling of several terms is the weightiest of them
        best: dict[int, float] = {}
        for w, k in places.values():
            best[k] = max(best.get(k, 0.0), w)
        total, top = sum(sorted(best.values())), max(best.values(), default=0.0)
        return float(np.log1p(total)), float(np.log1p(top)), float(total / (10 + len(text) ** 0.5))

    def __call__(self, text: str) -> float:
        bias, *weights = self.model.curve
        x = bias + sum(w * s for w, s in zip(weights, self.statistics(text)))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Most likely weights under a normal prior of that mean and strength, by damped Newton steps."""
    w = prior.astype(float).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength + 1e-6)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> float:
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def _places(batches: Iterator) -> Iterator:
    """(word, left, right, toxic): the distinct words of every text with the words on both sides, a stretch at a time."""
    import pyarrow as pa

    names = ["word", "left", "right", "toxic"]
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
            for _, part in stretches(text.as_py() or ""):
                words = words_of(part)
                some = [x for x in set(zip(words, ["", *words], [*words[1:], ""])) if 3 <= len(x[0]) <= 40 and _LETTERS.search(x[0])]
                if some:
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in zip(*some)), pa.array([toxic] * len(some), pa.int32())], names)


def _finds_of_sample(batches: Iterator, model: Model) -> Iterator:
    """For each document and find kind: the document's number, its label, term, whether misspelled, context, times."""
    import pyarrow as pa

    scorer = Scorer(model)
    for batch in batches:
        rows = []
        for doc, text, toxic in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("toxic").to_pylist()):
            kinds = {(k, int(e > 0), around) for k, e, _, around in scorer.finds(text.as_py() or "")}
            rows += [(doc, toxic, k, e, sum(x << i for i, x in enumerate(around))) for k, e, around in kinds]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "toxic", "term", "wrong", "around"])


def _statistics_of_sample(batches: Iterator, model: Model) -> Iterator:
    import pyarrow as pa

    scorer = Scorer(model)
    for batch in batches:
        rows = [(scorer.statistics(t.as_py() or ""), y) for t, y in zip(batch.column("text"), batch.column("toxic").to_pylist())]
        columns = [[r[0][i] for r in rows] for i in range(3)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), pa.array([y for _, y in rows], pa.int32())], ["total", "top", "dense", "toxic"])


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit(2**53 - 1))
    # A share of the rows that is almost surely enough comes first, so that few rows are sorted.
    near = known.withColumn("draw", draw).filter(F.col("draw") <= int(min(1.0, (1.1 * rows + 1000) / max(1, total)) * (2**53 - 1)))
    sample = near.orderBy("draw", "doc_id").limit(rows).select("doc_id", "toxic")
    # At most `rows` rows of two numbers are broadcast; the texts stay where they are.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, terms: int = MOST_TERMS) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, toxic); labels other than 0 and 1 are passed over.

    At most `rows` labelled doc_ids are used, those of the least hash; of several labels of a doc_id the greatest holds,
    and all its rows count. Whole texts are read; null counts as empty. Words are counted by the pairs of neighbours that
    they stand between, so copies of a document count once, and near copies hardly more. A term is a word of 3 to 40
    characters with LEAST_PLACES such places in toxic documents or more whose likelihood ratio is above what chance gives
    among as many words; the `terms` of the greatest ratio are kept, in order of ratio and word. Misspelled terms get a
    weight of their own, pulled to 0.6 of the right form's where few are seen. Without both labels, every score is the same.
    """
    sample = materialise(_sample(docs, labels, rows), "toxic-sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        discard(sample)
        return Model({})
    places = sample.select("text", "toxic").mapInArrow(_places, "word string, left string, right string, toxic int")
    places = places.groupBy("word", F.xxhash64("left", "right").alias("place")).agg(F.max("toxic").alias("t"), F.max(1 - F.col("toxic")).alias("c"))
    counts = materialise(places.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "toxic-words")
    all_toxic, all_clean = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    share, n = F.lit(all_toxic / max(1, all_toxic + all_clean)), F.col("t") + F.col("c")
    ratio = 2 * (F.col("t") * F.log(F.col("t") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share)))).otherwise(0.0))
    judged = counts.filter((F.col("t") >= LEAST_PLACES) & (F.col("t") > n * share)).withColumn("ratio", ratio)
    least = 2 * float(np.log(max(judged.count(), 2)))
    taken = judged.filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "word").limit(terms).select("word", "t", "c").collect()
    right = {r["word"]: _odds(r["t"], r["c"], all_toxic, all_clean) for r in taken}
    right = {w: o for w, o in right.items() if o > 1}
    first = Model({w: (o, 0.6 * o) for w, o in right.items()})
    names = sorted(right)
    found = materialise(sample.mapInArrow(lambda it: _finds_of_sample(it, first), "doc_id long, toxic long, term long, wrong long, around long"), "toxic-finds")
    # At most two rows a term, and a row for each of 16 contexts.
    wrong = found.filter("wrong = 1").groupBy("term").agg(F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("t"), F.countDistinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("c")).collect()
    weights = dict(first.weights)
    for r in wrong:
        name = names[r["term"]]
        seen, before = r["t"] + r["c"], weights[name][1]
        odds = max(0.0, _odds(r["t"], r["c"], n_toxic, n_clean))
        weights[name] = (weights[name][0], min(before, (seen * odds + 2 * before) / (seen + 2)))
    strong = [k for k, w in enumerate(names) if right[w] >= 3]
    windows = found.filter(F.col("wrong") == 0).filter(F.col("term").isin(strong)).groupBy("around", "toxic").agg(F.count(F.lit(1)).alias("n")).collect() if strong else []
    cues = np.array(PRIOR)
    if windows:
        x = np.repeat([[r["around"] >> i & 1 for i in range(4)] for r in windows], [min(r["n"], 1000) for r in windows], axis=0).astype(float)
        y = np.repeat([float(r["toxic"]) for r in windows], [min(r["n"], 1000) for r in windows])
        # The first weight stays: it says what a find without any cue counts.
        cues = _logistic(x, y, np.array(PRIOR), np.array([1e9, 2.0, 2.0, 2.0]))
    weighed = Model(weights, tuple(map(float, cues)))
    stats = sample.select("text", "toxic").mapInArrow(lambda it: _statistics_of_sample(it, weighed), "total double, top double, dense double, toxic int").toPandas()
    discard(sample, counts, found)
    stats = stats.sort_values(list(stats.columns), kind="stable")
    x = np.column_stack([np.ones(len(stats)), stats[["total", "top", "dense"]].to_numpy(float)])
    curve = _logistic(x, stats["toxic"].to_numpy(float), np.zeros(4), np.array([0.0, 0.1, 0.1, 0.1]))
    return Model(weights, weighed.cues, tuple(map(float, curve)))


def _scored(batches: Iterator, model: Model) -> Iterator:
    import pyarrow as pa

    scorer = Scorer(model)
    for batch in batches:
        for part in pieces(batch, "text"):
            scores = [scorer(t.as_py() or "") for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(scores, pa.float64())], ["row", "score"])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold, else 0); older columns of these names are replaced.

    Whole texts are scored, a stretch at a time; null counts as empty, which has a score as well. Repeated rows are kept.
    An empty table stays empty.
    """
    base = docs.drop("score", "predicted")
    rows = base.select(F.struct(*(F.col(f"`{c}`") for c in base.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    out = rows.mapInArrow(lambda it: _scored(it, model), schema)
    return out.select("row.*", "score", verdict(F.col("score"), threshold).alias("predicted"))


def verdict(value: Column, threshold: float = THRESHOLD) -> Column:
    """1 if a score reaches the threshold, else 0."""
    return F.when(value >= threshold, 1).otherwise(0)
