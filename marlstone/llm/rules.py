"""Quality rules as a learned decision list.

Labelled statistics are covered one rule after the other: a rule grows by the threshold condition of the
best information gain, is pruned on rows held out from growing, and then takes away the rows
it covers. The list becomes one ordered Spark conditional expression over columns computed in the JVM.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.quality import bad_words, draw, labelled
from marlstone.session import materialise, release, table

#: Bounds of the sample: labelled rows that rules are learned from, and of these the texts that the lexicon is
#: learned from, of each class at most.
ROWS_PER_CLASS, TEXTS_PER_CLASS = 20_000, 3000
#: Share of a word's class frequencies that are bad, to be in the lexicon.
LEXICON_PRECISION = 0.95
#: Precision on the held-out rows that a rule needs, and bad held-out rows that it covers at least.
MIN_PRECISION, MIN_COVER = 0.8, 2

STATS = ("n_words", "distinct", "word_length", "marks", "pipes", "upper", "flagged", "repeated_marks")
Condition = tuple[str, str, float]


def with_statistics(docs: DataFrame, words: list[str], *more: str) -> DataFrame:
    """doc_id, the columns ``more`` and the statistics of each text; a null text counts as empty, one of any length is taken whole."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        "doc_id",
        *more,
        F.length(text).alias("_n"),
        F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_w"),
        F.regexp_replace(text, r"[^!|#%&*$]+", " ").alias("_m"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("_u"),
    )
    base = base.withColumn("_d", F.array_distinct("_w"))
    n = F.greatest(F.size("_w"), F.lit(1))
    marks = F.length(F.replace("_m", F.lit(" "), F.lit("")))
    return base.select(
        "doc_id",
        *more,
        F.size("_w").cast("double").alias("n_words"),
        (F.size("_d") / n).alias("distinct"),
        (F.col("_n") / n).cast("double").alias("word_length"),
        (marks / n).alias("marks"),
        ((F.length("_m") - F.length(F.replace("_m", F.lit("|"), F.lit("")))) / n).alias("pipes"),
        (F.col("_u") / F.greatest("_n", F.lit(1))).alias("upper"),
        F.size(F.filter("_d", lambda w: w.isin(words))).cast("double").alias("flagged"),
        (F.size(F.split("_m", r"!!|##|%%|&&|\*\*|\$\$")) - 1).cast("double").alias("repeated_marks"),
    )


def covered(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    """Which rows a conjunction holds for."""
    out = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, STATS.index(name)]
        out &= v >= t if op == ">=" else v <= t
    return out


def _best(x: np.ndarray, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The gain and condition, over all cuts between two values of each statistic, of the best information gain."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best: tuple[float, Condition | None] = (1e-9, None)
    if not p0:
        return best
    for c, name in enumerate(STATS):
        order = np.argsort(x[:, c], kind="stable")
        v = x[order, c]
        last = np.flatnonzero(v[1:] != v[:-1])  # the last row of each value but the greatest
        if not len(last):
            continue
        low = np.cumsum(bad[order])[last]
        for op, p, size in ((">=", p0 - low, len(v) - 1 - last), ("<=", low, last + 1)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / size) - np.log2(p0 / (p0 + n0))), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = float(gain[k]), (name, op, float((v[last[k]] + v[last[k] + 1]) / 2))
    return best


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Conditions added while one gains information; each takes away rows, so this ends. Of equal gains the first
    statistic, then >=, then the least cut is taken."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while not bad[inside].all():
        _, condition = _best(x[inside], bad[inside])
        if condition is None:
            break
        rule.append(condition)
        inside &= covered(x, [condition])
    return rule


def _prune(rule: list[Condition], x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    def worth(k: int) -> float:
        hit = covered(x, rule[:k])
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: np.ndarray, bad: np.ndarray) -> list[list[Condition]]:
    """The ordered rules (each a conjunction) that name bad rows; the first one that fails on held-out rows ends the list."""
    order = np.random.default_rng(5).permutation(len(x))
    x, bad = x[order], bad[order]
    held = np.arange(len(x)) % 3 == 0
    rules: list[list[Condition]] = []
    alive = np.ones(len(x), bool)
    while (bad & alive & ~held).any():
        grow, test = alive & ~held, alive & held
        rule = _prune(_grow(x[grow], bad[grow]), x[test], bad[test])
        hit = covered(x, rule)
        p, n = (hit & test & bad).sum(), (hit & test & ~bad).sum()
        if not rule or p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """The verdict of a row of statistics: the number of the first rule that holds, from 1, or 0."""
    out = F.lit(0)
    for k, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for name, op, t in rule:
            test = test & (F.col(name) >= t if op == ">=" else F.col(name) <= t)
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[list[Condition]]]:
    """The lexicon and the rules; no rules without labels of both classes. The sample's texts are read once."""
    spark = docs.sparkSession
    marked = materialise(spark, labelled(labels), "labels")
    sample = draw(marked, docs, ROWS_PER_CLASS)
    words = bad_words(sample.where(F.col("place") <= TEXTS_PER_CLASS), LEXICON_PRECISION)
    rows = with_statistics(sample, words, "good").collect()  # bounded by ROWS_PER_CLASS
    release(sample)
    rows = sorted((r["doc_id"], r["good"], *(r[c] for c in STATS)) for r in rows)
    if len({r[1] for r in rows}) < 2:
        return [], []
    return words, learn(np.array([r[2:] for r in rows]), np.array([r[1] == 0 for r in rows]))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and statistics of the rows of ``docs`` that no rule names, verdict 0.

    Null texts count as empty; an empty text is judged by its statistics, one of any length by all of it. Null
    doc_ids and repeated rows are judged like any other; a statistic equal to a rule's cut meets its condition. Without
    labels of both classes there are no rules and all rows stay. An empty table gives an empty result; further
    columns are ignored.
    """
    words, rules = fit(docs, labels)
    return with_statistics(docs, words).withColumn("verdict", expression(rules)).where("verdict = 0")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the learned rules keep."""
    return kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
