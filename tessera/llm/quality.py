"""Quality classifier: a sparse ensemble of rules (Friedman and Popescu, 2008).

Statistics of a text are Spark columns. Small trees are boosted on a labelled sample of them; every path from a root to
a node is a conjunctive rule; a lasso logistic regression over the rules drives most weights to nothing. The rules that
stay are compiled into one Spark column expression, which scores whole texts without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bind

SAMPLE_ROWS = 20_000  # labelled rows that a model is fitted on at most
TREES, DEPTH, LEAF = 30, 3, 20
THRESHOLD = 0.7

Condition = tuple[str, bool, float]  # statistic, above?, cut
FEATURES = ("chars", "words", "mean_word", "distinct_words", "letters", "upper", "digits", "marks", "symbols", "bars", "shouts", "lines", "top_line", "short_words")


@dataclass(frozen=True)
class Model:
    """Score = logistic(bias + sum of the weights of the rules that hold)."""

    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def statistics(text: Column) -> Column:
    """A struct of FEATURES for a whole text; null counts as empty, and every statistic of an empty text is 0."""

    def of(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1))
        share = lambda pattern: (F.length(t) - _length_without(t, pattern)) / n
        words = F.filter(F.split(t, r"[ \n\t\r]+"), lambda w: w != "")
        lines = F.split(t, "\n")

        def rest(w: Column) -> Column:
            k = F.greatest(F.size(w), F.lit(1))
            return F.struct(
                F.log1p(F.length(t)).alias("chars"),
                F.log1p(F.size(w)).alias("words"),
                (F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / k).alias("mean_word"),
                (F.size(F.array_distinct(w)) / k).alias("distinct_words"),
                share(r"\p{L}+").alias("letters"),
                share(r"\p{Lu}+").alias("upper"),
                share(r"\p{N}+").alias("digits"),
                share(r"[.,;:?!]+").alias("marks"),
                share(r"[#$%&*+<=>@^_~{}\\]+").alias("symbols"),
                share(r"[|]+").alias("bars"),
                share(r"!+").alias("shouts"),
                F.log1p(F.size(lines)).alias("lines"),
                (F.array_max(F.transform(lines, lambda x: F.length(x))) / n).alias("top_line"),
                (F.size(F.filter(w, lambda x: F.length(x) <= 2)) / k).alias("short_words"),
            )

        return bind(words, rest)

    return bind(F.coalesce(text.cast("string"), F.lit("")), of)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: dict, out: np.ndarray) -> None:
    """Grow one regression tree on gradients g and curvatures h; collect the paths and add the leaf steps to out."""
    if path:
        rules.setdefault(path, None)
    best = (1e-6, None)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * LEAF:
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[:-1] < v[1:])
            at = at[(at + 1 >= LEAF) & (len(order) - at - 1 >= LEAF)]
            if len(at):
                gain = cg[at] ** 2 / (ch[at] + 1) + (total_g - cg[at]) ** 2 / (total_h - ch[at] + 1) - total_g**2 / (total_h + 1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, float((v[at[k]] + v[at[k] + 1]) / 2)))
    if best[1] is None:
        out[rows] += 0.3 * total_g / (total_h + 1)
        return
    f, cut = best[1]
    above = x[rows, f] > cut
    _tree(x, g, h, rows[above], depth - 1, (*path, (f, True, cut)), rules, out)
    _tree(x, g, h, rows[~above], depth - 1, (*path, (f, False, cut)), rules, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights under an L1 penalty, by accelerated proximal steps; the bias is not penalised."""
    n, m = z.shape
    design = np.hstack([np.ones((n, 1)), z])
    step = 4 * n / max(1e-9, float(np.linalg.norm(design, 2) ** 2))
    w = seen = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-design @ seen))
        new = seen - step * (design.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        seen, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, trees: int = TREES, depth: int = DEPTH, penalty: float = 0.002) -> Model:
    """The rule ensemble for statistics x and labels y of 0 and 1. Without both labels, only a bias."""
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return Model(float(np.log(mean / (1 - mean))), ())
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        _tree(x, y - p, p * (1 - p), np.arange(len(y)), depth, (), found, step)
        score += step
    paths = list(found)
    z = np.column_stack([np.all([(x[:, f] > cut) == above for f, above, cut in path], axis=0) for path in paths]).astype(float) if paths else np.zeros((len(y), 0))
    _, once = np.unique(z, axis=1, return_index=True)
    paths, z = [paths[k] for k in sorted(once)], z[:, sorted(once)]
    bias, weights = _lasso(z, y, penalty)
    keep = [(float(w), tuple((names[f], above, cut) for f, above, cut in path)) for w, path in zip(weights, paths) if w]
    return Model(bias, tuple(sorted(keep, key=lambda r: (-abs(r[0]), r[1]))))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, quality); labels other than 0 and 1 are passed over.

    At most `rows` labelled documents are used, those of the least hash of doc_id; of several labels of a doc_id the
    greatest holds, and of several texts the one of least statistics. Only the sample's statistics are computed and
    collected. Without labels, or documents for them, the model is a bias.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = known.count()
    draw = F.xxhash64("doc_id").bitwiseAND(F.lit(2**53 - 1))
    # A share of the rows that is almost surely enough comes first, so that few rows are sorted.
    near = known.withColumn("draw", draw).filter(F.col("draw") <= int(min(1.0, (1.1 * rows + 1000) / max(1, total)) * (2**53 - 1)))
    sample = near.orderBy("draw", "doc_id").limit(rows).select("doc_id", "quality")
    # The sample has at most `rows` rows of two numbers, so it is broadcast and the texts stay where they are.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    one = joined.select("doc_id", "quality", statistics(F.col("text")).alias("s")).groupBy("doc_id").agg(F.min(F.struct("s", "quality")).alias("x"))
    taken = one.select(*(F.col(f"x.s.{f}").cast("double").alias(f) for f in FEATURES), F.col("x.quality").alias("quality")).toPandas()
    taken = taken.sort_values(list(taken.columns), kind="stable")
    return fit_rules(taken[list(FEATURES)].to_numpy(float), taken["quality"].to_numpy(float))


def score_column(model: Model, stats: Column) -> Column:
    """The model as a Spark expression over a struct of statistics: a number from 0 to 1."""
    terms = []
    for weight, path in model.rules:
        holds = None
        for name, above, cut in path:
            this = (stats[name] > F.lit(cut)) if above else (stats[name] <= F.lit(cut))
            holds = this if holds is None else holds & this
        terms.append(F.when(holds, F.lit(weight)).otherwise(F.lit(0.0)))
    # One array keeps the sum flat, whatever the number of rules.
    total = F.aggregate(F.array(F.lit(model.bias), *terms), F.lit(0.0), lambda a, b: a + b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold, else 0); older columns of these names are replaced.

    Whole texts are scored; null counts as empty, which has a score as well. An empty table stays empty.
    """
    docs = docs.drop("score", "predicted")
    value = bind(statistics(F.col("text")), lambda s: score_column(model, s))
    return docs.withColumn("score", value).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with their own columns."""
    return docs.filter(bind(statistics(F.col("text")), lambda s: score_column(model, s)) >= threshold)
