"""Quality classifier: Bradley-Terry scores learned from preference pairs.

A document labelled good (quality 1, not toxic) is preferred to every other labelled document. The
score is linear in features: the presence of words that the labels are associated with, and
bins of text statistics. Its weights minimise the logistic loss of the feature differences of drawn
pairs. The threshold is a quantile of the scores of all labelled documents, at the share of
those labelled bad.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import is_small, materialise, release, table

#: Bounds of the sample: labelled documents that the weights are fitted on, of each class at most, and preference
#: pairs drawn from them. All else covers all rows.
SAMPLE_PER_CLASS = 3000
PAIRS = 40_000
MIN_DOCS = 5
#: Words enter the features if they are commoner in bad texts by so many standard errors, and that share of
#: their class frequencies is bad: words of ordinary prose would only measure a text's length.
MIN_Z, MIN_BAD = 4.0, 0.8
STEPS, L2, RATE = 300, 1e-4, 0.1
BINS = 8
#: Half the width, in ranks, of the gap around the quantile in whose middle the threshold lies.
RANK_GAP = 0.002

STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„’…"
MARKS = "!|#%&*$"
STATS = ("log_words", "distinct", "repeat", "upper", "word_len", *(f"mark_{i}" for i in range(len(MARKS))), "marks", "digits", "word_end_marks")


def words_and_stats(text: str | None) -> tuple[set[str], list[float]]:
    """Distinct lower-cased words without outer punctuation, and the statistics of a text (null as empty)."""
    text = text or ""
    tokens = text.split()
    n = len(tokens) or 1
    kinds = set(tokens)
    words = {t.strip(STRIP).lower() for t in kinds}
    words.discard("")
    marks = [text.count(c) / n for c in MARKS]
    repeat = sum(map(str.__eq__, tokens, tokens[1:])) / n
    upper = sum(map(str.isupper, tokens)) / n
    digits = sum(1 for t in kinds if any(c.isdigit() for c in t)) / (len(kinds) or 1)
    ends = sum(1 for t in kinds if len(t) > 2 and t[-1] in MARKS and t[-2] == t[-1]) / (len(kinds) or 1)
    return words, [math.log(n), len(kinds) / n, repeat, upper, len(text) / n, *marks, sum(marks), digits, ends]


class Scorer:
    """Word weights and weights of statistic bins; scores texts."""

    def __init__(self, words: dict[str, float], edges: list[np.ndarray], bins: list[np.ndarray]):
        self.words, self.edges, self.bins = words, edges, bins

    def scores(self, texts: list[str | None]) -> np.ndarray:
        stats = np.empty((len(texts), len(STATS)))
        out = np.zeros(len(texts))
        known = self.words
        keys = known.keys()
        for i, t in enumerate(texts):
            words, stats[i] = words_and_stats(t)
            out[i] = sum(known[w] for w in sorted(keys & words))
        for c, (edges, bins) in enumerate(zip(self.edges, self.bins)):
            out += bins[np.searchsorted(edges, stats[:, c], side="right")]
        return out


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, good): one row for each labelled document.

    A null quality or doc_id is no label, a null toxic is not toxic, and of several labels the worst counts.
    """
    y = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(y.cast("int")).alias("good"))


def draw(marked: DataFrame, docs: DataFrame, per_class: int) -> DataFrame:
    """doc_id, good, place, text of at most ``per_class`` documents of each class, those with the least hashes.

    place numbers a class's documents by hash, from 1. The texts are written once; rows without a text are none.
    """
    order = Window.partitionBy("good").orderBy(F.xxhash64("doc_id"), "doc_id")
    least = [marked.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for g in (0, 1)]
    ids = least[0].unionByName(least[1]).withColumn("place", F.row_number().over(order))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # bounded by the sample's size
    return materialise(docs.sparkSession, rows.where("text is not null").select("doc_id", "good", "place", "text"), "sample")


def bad_words(sample: DataFrame, least_share: float = MIN_BAD) -> list[str]:
    """The words of a sample whose document frequencies speak for the bad class, in order.

    They stand in ``MIN_DOCS`` texts at least, are commoner in bad ones by ``MIN_Z`` standard errors, and have
    ``least_share`` of their class frequencies there; all such words are taken.
    """
    n = {r["good"]: r["n"] for r in sample.groupBy("good").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(n.get(0, 0)), float(n.get(1, 0))
    if not n0 or not n1:
        return []

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for good, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kinds = list(words_and_stats(text)[0])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([good] * len(kinds), pa.int32())], names=["word", "good"])

    count = sample.select("good", "text").mapInArrow(W.lean(words), "word string, good int").groupBy("word").agg(F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("good"))
    p, q = F.col("bad") / n0, F.col("good") / n1
    m = (F.col("bad") + F.col("good")) / (n0 + n1)
    z = (p - q) / F.sqrt(F.greatest(m * (1 - m), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    chosen = count.where((F.col("bad") + F.col("good") >= MIN_DOCS) & (z >= MIN_Z) & (p >= least_share * (p + q)))
    return sorted(r["word"] for r in chosen.select("word").toLocalIterator())


def pair_loss(w: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> float:
    """Mean logistic loss of rows i preferred to rows j, with the penalty of the weights."""
    s = x @ w
    return float(np.mean(np.log1p(np.exp(-(s[i] - s[j])))) + L2 / 2 * (w @ w))


def drawn_pairs(y: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the good class, each with a row of the bad one."""
    rng = np.random.default_rng(7)
    return rng.choice(np.flatnonzero(y == 1), pairs), rng.choice(np.flatnonzero(y == 0), pairs)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = STEPS) -> np.ndarray:
    """Weights that minimise mean log(1 + exp(-(s_good - s_bad))) over drawn pairs, by Adam."""
    i, j = drawn_pairs(y, pairs)
    w = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        s = x @ w
        g = -1 / (1 + np.exp(np.clip(s[i] - s[j], -30, 30))) / pairs
        c = np.bincount(i, g, len(y)) - np.bincount(j, g, len(y))
        grad = c.astype(np.float32) @ x + L2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(sample: DataFrame) -> Scorer:
    """A scorer from a drawn sample; all scores are 0 if there are no pairs. Only features come to the driver."""
    names = bad_words(sample)
    shared = sample.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(names)})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for b in batches:
            found = [words_and_stats(t) for t in b.column(2).to_pylist()]
            hits = [sorted(number[w] for w in words if w in number) for words, _ in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], names=["doc_id", "good", "hits", "stats"])

    rows = sample.select("doc_id", "good", "text").mapInArrow(W.lean(features), "doc_id long, good int, hits array<int>, stats array<double>").collect()  # bounded by the sample's size
    rows.sort(key=lambda r: (r["doc_id"], r["good"], r["stats"], r["hits"]))
    y = np.array([r["good"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return Scorer({}, [], [])
    st = np.array([r["stats"] for r in rows])
    edges = [np.unique(np.quantile(st[:, c], np.linspace(0, 1, BINS + 1)[1:-1])) for c in range(st.shape[1])]
    width = [len(e) + 1 for e in edges]
    x = np.zeros((len(y), len(names) + sum(width)), np.float32)
    for r, row in enumerate(rows):
        x[r, row["hits"]] = 1
    at = len(names)
    for c, e in enumerate(edges):
        x[np.arange(len(y)), at + np.searchsorted(e, st[:, c], side="right")] = 1
        at += width[c]
    w = fit_pairs(x, y).astype(float)
    cuts = np.split(w[len(names) :], np.cumsum(width)[:-1])
    return Scorer(dict(zip(names, w[: len(names)].tolist())), edges, cuts)


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(W.lean(run), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, all_scores: bool = True) -> tuple[Scorer, float | None, DataFrame]:
    """The scorer, the threshold, and doc_id, score of the rows with a text that is not blank.

    The threshold is the score quantile, over all labelled documents that exist, at the share of bad
    ones; between the ranks just below and above it, the middle. None if there are no labels of both
    classes. Only scores are joined with labels, so no text is shuffled (a join of the labelled texts took 33 x the
    input in disk at 30 GB, this takes 0.02 x). Without ``all_scores`` only labelled rows need be scored:
    those are picked by a broadcast of the labelled ids where it is small.
    """
    spark = docs.sparkSession
    marked = materialise(spark, labelled(labels), "labels")
    sample = draw(marked, docs, per_class)
    scorer = fit(sample)
    filled = docs.select("doc_id", "text").where(F.col("text").rlike(r"\S"))
    ids = marked.select("doc_id")
    if not all_scores and is_small(ids):
        filled = filled.join(F.broadcast(ids), "doc_id", "left_semi")
    scored = materialise(spark, score_documents(filled, scorer), "scores")
    release(sample)
    if not any(map(np.any, scorer.bins)):
        return scorer, None, scored
    both = scored.join(marked, "doc_id")
    bad = both.agg(F.avg(1 - F.col("good"))).first()[0]
    at = [min(1.0, max(0.0, bad + d)) for d in (-RANK_GAP, RANK_GAP)]
    low, high = both.agg(F.percentile_approx("score", at, 20_000)).first()[0]
    return scorer, (low + high) / 2, scored


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is at least the threshold; columns of documents.

    Rows whose text is null or blank go: there is nothing to score. A null doc_id is scored like any
    other; repeated rows are kept or go together; a score that just reaches the threshold is kept; texts of any
    length are scored whole. Without labels of both classes all rows with a text stay; an empty table gives an
    empty one; further columns are dropped. Labelled rows are scored again here, which costs less than a join of
    texts with scores.
    """
    scorer, threshold, _ = train(docs, labels, all_scores=False)
    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    filled = base.where(F.col("text").rlike(r"\S"))
    if threshold is None:
        return filled
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.scores(b.column(1).to_pylist()) >= threshold))

    return filled.mapInArrow(W.lean(run), base.schema)


def scored_kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, threshold of the documents that the classifier keeps (see ``keep_good``).

    Without labels of both classes all scores are 0, the threshold null, and all rows with a text stay.
    """
    _, threshold, scored = train(docs, labels)
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.withColumn("threshold", F.lit(threshold).cast("double"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents that the classifier keeps."""
    return scored_kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
