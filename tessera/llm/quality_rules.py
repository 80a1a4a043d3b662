"""Quality rules by weak supervision.

Each rule looks at counts over the whole text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the votes of the whole corpus estimates how often each rule is right; the posterior probability of the good
class decides, so no single rule rejects a document. Votes are counted by
pattern first: the driver sees at most 3**9 rows, whatever the size of the corpus. The posterior is
compiled into a column expression.

Nulls and empty texts have no words: every rule abstains and the posterior is the prior; such documents fail the
base filter. Ties: a posterior that equals the threshold keeps. A null id is kept as it is, repeated rows are judged each by itself, an empty table gives an empty
result, and columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.textstats import with_counts


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.col(whole)



def rules() -> dict[str, tuple[Column, Column, Column]]:
    """name: (votes bad where, else votes good where, applies where); null counts as false."""
    any_word, some = F.col("n_words") > 0, F.col("n_words") >= 20
    letters = F.col("n_upper") + F.col("n_lower")
    never = F.lit(False)
    return {
        "symbols": (_share("n_symbols") > 0.1, never, any_word),
        "marks": (_share("n_marks") > 0.3, never, any_word),
        "bars": (_share("n_bars") > 0.2, never, any_word),
        "case": (F.col("n_upper") > 0.4 * letters, never, letters > 0),
        "repeats": (_share("n_repeat_words") > 0.3, never, some),
        "lines": (_share("n_dup_lines", "n_lines") > 0.3, never, F.col("n_lines") >= 4),
        "variety": (_share("n_distinct") < 0.3, _share("n_distinct") > 0.5, some),
        "plain_words": (F.col("n_symbols") + F.col("n_marks") > 0.3 * F.col("n_words"), F.col("n_symbols") + F.col("n_marks") <= 0.05 * F.col("n_words"), any_word),
        "word_length": ((_share("word_chars") > 12) | (_share("word_chars") < 2), (_share("word_chars") > 3.5) & (_share("word_chars") < 6.5), any_word),
    }


def vote(bad: Column, good: Column, applies: Column) -> Column:
    said = F.when(bad, -1).when(good, 1).otherwise(0)
    return F.when(applies, said).otherwise(0).cast("int")


def fit_votes(patterns: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """EM for two hidden classes. patterns: (patterns, rules) of -1, 0, 1; weights: their counts.

    Estimates for each class how often a rule votes bad, abstains and votes good; a rule's accuracy in a class
    follows from that. Gives the log odds of good before any vote, and log P(vote | good) - log P(vote | bad) by rule
    and vote (-1, 0, 1). Most documents are good and most rules watch for one kind of junk, so accuracies that the
    large class alone decides would let every accused document go; pseudo-counts for half of the corpus therefore
    hold the rate of false accusations low. They say nothing of how often the rules find junk. EM starts from
    "accused by any rule".
    """
    n = weights.sum()
    one_hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # pattern, rule, vote
    neutral = np.einsum("p,prv->rv", weights, one_hot)
    neutral[:, 0] = 0.002 * neutral.sum(axis=1)
    pseudo = np.stack([neutral / neutral.sum(axis=1, keepdims=True) * 0.5 * n, np.full(neutral.shape, 1 + 0.01 * n / 3)])
    good = np.where((patterns < 0).any(axis=1), 0.1, 0.9)
    prior, odds = 0.0, np.zeros((patterns.shape[1], 3))
    for _ in range(rounds):
        of = np.stack([weights * good, weights * (1 - good)])  # class, pattern
        seen = np.einsum("cp,prv->crv", of, one_hot) + pseudo + 1e-9
        chance = seen / seen.sum(axis=2, keepdims=True)
        share = of.sum(axis=1) + 1
        prior, odds = math.log(share[0] / share[1]), np.log(chance[0]) - np.log(chance[1])
        now = 1 / (1 + np.exp(-np.clip(prior + np.einsum("prv,rv->p", one_hot, odds), -500, 500)))
        if np.abs(now - good).max() < 1e-9:
            break
        good = now
    return prior, odds


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts, votes and `quality_probability` of every document, with base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: not base_failed and
    a probability of `threshold` at least.
    """
    seen = written(with_counts(docs), "quality-counts")
    given = rules()
    votes = seen.withColumns({f"vote_{k}": vote(*v) for k, v in given.items()})
    names = [f"vote_{k}" for k in given]
    # at most 3**9 rows
    table = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).toPandas()
    prior, odds = fit_votes(table[names].to_numpy(dtype=int), table["n"].to_numpy(dtype=float)) if len(table) else (0.0, np.zeros((len(names), 3)))
    score = F.lit(float(prior))
    for name, (bad, none, good) in zip(names, odds):
        score = score + F.when(F.col(name) < 0, float(bad)).when(F.col(name) > 0, float(good)).otherwise(float(none))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = votes.withColumn("quality_probability", 1 / (1 + F.exp(-score))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def verdicts(docs: DataFrame) -> DataFrame:
    """The columns of the query: counts, base_failed, kept, and the posterior."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_probability")
