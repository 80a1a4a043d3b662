"""Quality classifier: a sparse ensemble of conjunctive rules.

Shallow trees are grown on bagged labelled rows over statistics of the text; every path from a root to a node is a
conjunction of comparisons. A logistic model with a lasso penalty gives most of them no weight; the rest are compiled
into one Spark column expression, which scores the corpus inside the JVM.

Labels are learned from a bounded sample, MAX_ROWS labelled rows in the order of a hash of the id; statistics are
taken from every document. Nulls and empty texts: statistics of an empty text, so they get a score too. A null id
joins no label. Repeated rows get the same score; rows of `labels` with a null quality are left out, and an id that
several rows label gives a row each. With no labels, or with one class only, the score is that share, or 0.5. An empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_of_id, unused, written
from tessera.llm.textstats import FIELDS, with_counts

#: Labelled rows that are learned from at most.
MAX_ROWS = 20_000
TREES, DEPTH, CUTS = 24, 3, 24


def statistics(prefix: str = "") -> dict[str, Column]:
    """Features as column expressions over the counts; never null."""

    def col(name: str) -> Column:
        return F.col(prefix + name)

    words = F.greatest(col("n_words"), F.lit(1))
    letters = F.greatest(col("n_upper") + col("n_lower"), F.lit(1))
    lines = F.greatest(col("n_lines"), F.lit(1))
    by_word = ("word_chars", "n_symbols", "n_repeat_words", "n_distinct", "n_digits", "n_marks", "n_bars", "n_stops", "n_commas", "n_long_words", "n_one_char", "n_title")
    found = {f"{c}_a_word": col(c) / words for c in by_word}
    found |= {"upper_a_letter": col("n_upper") / letters, "dup_a_line": col("n_dup_lines") / lines, "words_a_line": col("n_words") / lines, "log_words": F.log(1.0 + col("n_words")), "letters_a_char": (col("n_upper") + col("n_lower")) / F.greatest(col("word_chars"), F.lit(1))}
    return {k: v.cast("double") for k, v in found.items()}


@dataclass(frozen=True)
class Test:
    """feature <= cut, or feature > cut."""

    feature: int
    cut: float
    above: bool

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] > self.cut) == self.above


Rule = tuple[Test, ...]


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, path: Rule = ()) -> list[Rule]:
    """The paths of a tree that splits for the lowest Gini impurity over a random half of the features."""
    if depth == 0 or len(y) < 20 or y.min() == y.max():
        return []
    best = (0.0, None)
    for f in rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS)))
        below = x[:, f][:, None] <= cuts
        n1, n = below.sum(axis=0), len(y)
        ok = (n1 >= 5) & (n - n1 >= 5)
        if not ok.any():
            continue
        p1 = (below * y[:, None]).sum(axis=0)
        gain = np.where(ok, p1**2 / np.maximum(n1, 1) + (y.sum() - p1) ** 2 / np.maximum(n - n1, 1), 0) - y.sum() ** 2 / n
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), (int(f), float(cuts[k])))
    if best[1] is None:
        return []
    found: list[Rule] = []
    for above in (False, True):
        here = (*path, Test(*best[1], above))
        m = here[-1].holds(x)
        found += [here, *grow(x[m], y[m], rng, depth - 1, here)]
    return found


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the intercept, by accelerated proximal steps."""
    n, d = z.shape
    step = 4 / (np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2 / n)
    w = v = np.zeros(d)
    b = c = 0.0
    t = 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-np.clip(c + z @ v, -500, 500))) - y
        new_b, new_w = c - step * r.mean(), v - step * (z.T @ r) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        c, v = new_b + (old - 1) / t * (new_b - b), new_w + (old - 1) / t * (new_w - w)
        b, w = new_b, new_w
    return float(b), w


@dataclass
class Ensemble:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def expression(self, columns: dict[str, Column]) -> Column:
        """The probability of label 1 as a column expression."""
        score = F.lit(self.bias)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for t in rule:
                c = columns[self.names[t.feature]]
                holds = holds & (c > t.cut if t.above else c <= t.cut)
            score = score + F.when(holds, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-score))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 1, penalty: float = 0.002) -> Ensemble:
    """Trees on bagged rows, their paths without repeats, and the lasso over them."""
    if len(y) == 0:
        return Ensemble(names, 0.0, [])
    if y.min() == y.max():
        return Ensemble(names, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    rng = np.random.default_rng(seed)
    rules: dict[bytes, Rule] = {}
    for _ in range(TREES):
        rows = rng.choice(len(y), min(len(y), 4000))
        for rule in grow(x[rows], y[rows], rng, DEPTH):
            held = np.logical_and.reduce([t.holds(x) for t in rule])
            if 5 <= held.sum() <= len(y) - 5:
                key = np.packbits(held).tobytes()
                if key not in rules or len(rule) < len(rules[key]):
                    rules[key] = rule
    given = list(rules.values())
    if not given:
        return Ensemble(names, math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), [])
    z = np.stack([np.logical_and.reduce([t.holds(x) for t in rule]) for rule in given], axis=1).astype(float)
    bias, w = lasso(z, y.astype(float), penalty)
    return Ensemble(names, bias, [(r, float(v)) for r, v in zip(given, w) if abs(v) > 1e-6])


def sample(labels: DataFrame, max_rows: int = MAX_ROWS, hold_out: bool = True) -> DataFrame:
    """doc_id and quality of max_rows labelled rows at most, by a hash of the id."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if hold_out:
        marked = marked.where(crc_of_id(F.col("doc_id")) % 3 != 1)
    n = marked.count()
    if n > max_rows:
        # thinned before it is ordered, so that tasks don't each give max_rows rows
        share = min(1.0, 1.05 * max_rows / n)
        marked = marked.where(F.xxhash64("doc_id") <= min(2**63 - 1, int(share * 2**64) - 2**63))
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)


def learned(counted: DataFrame, marked: DataFrame) -> Ensemble:
    """An ensemble from counts of documents and the labels of max_rows of them at most, whose ids are broadcast."""
    stats = statistics()
    names = list(stats)
    # of rows that share an id, the one with the least counts
    one = counted.join(F.broadcast(marked.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*FIELDS)).alias("least")).select("doc_id", "least.*")
    rows = one.join(marked, "doc_id").select("quality", *[v.alias(k) for k, v in stats.items()]).toPandas().sort_values(["quality", *names])
    return fit(rows[names].to_numpy(dtype=float), rows["quality"].to_numpy(dtype=int), names)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, hold_out: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. hold_out: don't learn from rows that are held out."""
    counted = written(with_counts(docs), "classifier-counts")
    model = learned(counted, written(sample(labels, max_rows, hold_out), "classifier-labels"))
    # the features stand in columns of their own, so that each is computed once
    wide = counted.select("doc_id", *[v.alias(k) for k, v in statistics().items()])
    out = wide.select("doc_id", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"), model.expression({k: F.col(k) for k in model.names}).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, hold_out: bool = True) -> DataFrame:
    """The documents that are predicted to have label 1, with all their columns; no text is shuffled."""
    # at most max_rows ids
    marked = written(sample(labels, max_rows, hold_out), "classifier-labels")
    own = docs.select("doc_id", "text").join(F.broadcast(marked.select("doc_id").distinct()), "doc_id")
    model = learned(written(with_counts(own), "classifier-counts"), marked)
    prefix = unused(docs, "stat_")
    return with_counts(docs, prefix).where(model.expression(statistics(prefix)) >= 0.5).select(*docs.columns)
