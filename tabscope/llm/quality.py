"""Quality scores from pairwise preferences (Bradley-Terry).

A document's score is linear in what is measured of its text. Pairs of a document labelled
good and one labelled bad are drawn among the learning rows, and the weights minimise the
logistic loss of the score differences. The threshold between the classes is the quantile
of the scores at the share of bad documents, both over all labelled documents outside the
held-out fold.

At most ``per_class`` labelled documents of either class give the weights, the first in hash
order; everything else covers all rows. Null and empty texts get the score of a text with
nothing to measure. Repeated rows are scored alike. Contradicting or missing labels are not
learnt from; with labels of one class only every score is 0.5 and every document accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.words import per_text, repeat_lines, repeat_words, words_of

PER_CLASS = 4000
PAIRS_EACH = 8
#: So many distinct scores around the threshold are sorted on the driver.
NEAR = 10_000
FEATURES = ("symbols", "exclamations", "bars", "capitals", "digits", "repeated_words", "same_again", "repeated_lines",
            "distinct_words", "word_length", "long_words", "n_words")


def measures(texts: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    words = words_of(texts)
    n = np.maximum(words.counts, 1).astype(float)
    data = words.data
    size = np.maximum(np.diff(words.bounds) - 1, 1)
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    hashes = words.hashes()
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    order = np.lexsort((hashes, words.doc))
    new = np.ones(len(order), np.int64)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    texts_n = len(texts)
    lengths = words.stop - words.start

    def share(x, of):
        x = x / of
        return x / (x + 0.1)  # what matters is whether there are many, not how many

    def in_words(marks):
        return np.bincount(words.doc, weights=marks, minlength=texts_n)

    return np.column_stack([
        share(per_text(words, np.isin(data, np.frombuffer(b"#*$%&<>@^~=", np.uint8))), n),
        share(per_text(words, data == 33), n),
        share(per_text(words, data == 124), n),
        share(per_text(words, letters & (data < 97)), np.maximum(per_text(words, letters), 8)),
        share(per_text(words, (data >= 48) & (data <= 57)), size),
        share(repeat_words(words), n),
        share(in_words(again), n),
        share(np.array([repeat_lines(t) if isinstance(t, str) else 0 for t in texts]), n / 10),
        in_words(np.bincount(order, weights=new, minlength=len(order)) if len(order) else again) / n,
        np.log1p(in_words(lengths) / n),
        share(in_words(lengths > 40), n),
        np.log1p(words.counts),
    ])


def measured(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Adds ``_measures``, an array of doubles, and by default drops the text."""
    rest = docs.drop("_measures")
    gone = [] if keep_text else ["text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 500_000):
            yield frame.drop(columns=gone).assign(_measures=list(measures(frame["text"].tolist())))

    return rest.mapInPandas(run, common.schema_of(rest.drop(*gone), _measures="array<double>"))


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def linear(self, measures: Column) -> Column:
        slopes = self.weights / self.scale
        terms = [measures[i] * F.lit(float(w)) for i, w in enumerate(slopes)]
        return sum(terms, F.lit(float(-(self.mean * slopes).sum())))

    def score(self, measures: Column) -> Column:
        """0 to 1; 0.5 is the threshold."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(self.threshold)) - self.linear(measures)))


def fit_pairs(x: np.ndarray, good: np.ndarray, share_bad: float, pairs_each: int = PAIRS_EACH, ridge: float = 1e-3) -> Ranking:
    """Logistic loss on feature differences of (good, bad) pairs, by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = (x - mean) / scale
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    weights, threshold = np.zeros(x.shape[1]), 0.0
    if not len(winners) or not len(losers):
        return Ranking(mean, scale, weights, threshold)
    draw = np.random.Generator(np.random.PCG64(1))
    n = pairs_each * max(len(winners), len(losers))
    differences = z[winners[draw.permutation(n) % len(winners)]] - z[losers[draw.permutation(n) % len(losers)]]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(differences @ weights, -30, 30)))
        slope = differences.T @ (p - 1) / n + ridge * weights
        bend = (differences * (p * (1 - p))[:, None]).T @ differences / n + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    scores = z @ weights
    # Each class stands for its share of all labels, not of the sample.
    each = np.where(good == 1, (1 - share_bad) / len(winners), share_bad / len(losers))
    order = np.argsort(scores, kind="stable")
    below = np.searchsorted(np.cumsum(each[order]), share_bad - 1e-12)
    ahead = min(below + 1, len(order) - 1)
    return Ranking(mean, scale, weights, float((scores[order[below]] + scores[order[ahead]]) / 2))


def cut_at_share(scores: DataFrame, near: int = NEAR) -> float | None:
    """The cut that puts as many rows below as are bad: half way between the scores of rank
    n_bad and n_bad + 1, exactly. ``scores`` has ``_score`` and ``label``. The range around
    the two ranks is narrowed by sketches until it has at most ``near`` distinct scores."""
    n, bad = scores.agg(F.count("*"), F.sum(1 - F.col("label"))).first()
    if not n:
        return None
    ranks = [min(max(bad - 1, 0), n - 1), min(max(bad, 0), n - 1)]
    inside, before, size = scores, 0, n
    while True:
        head = inside.groupBy("_score").agg(F.count("*").alias("_n")).limit(near + 1).collect()
        if len(head) <= near:
            break
        at = [min(max((r - before + d * size / 1000) / size, 0.0), 1.0) for r, d in zip(ranks, (-1, 1))]
        low, high = inside.agg(F.percentile_approx("_score", F.array(*[F.lit(p) for p in at]), 10_000)).first()[0]
        below, within = inside.agg(F.sum((F.col("_score") < low).cast("long")),
                                   F.sum(F.col("_score").between(low, high).cast("long"))).first()
        if within == size or not before + below <= ranks[0] or not ranks[1] < before + below + within:
            raise ValueError("the range around the threshold cannot be narrowed")
        inside, before, size = inside.where(F.col("_score").between(low, high)), before + below, within
    found, ahead = [], before
    for r in sorted(head):
        found += [r["_score"] for rank in ranks if ahead <= rank < ahead + r["_n"]]
        ahead += r["_n"]
    return (found[0] + found[1]) / 2


def fit(measures_of: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ranking:
    """Learns from staged documents with ``doc_id`` and ``_measures``, outside the held-out
    fold: the weights from a sample, the threshold from all that are labelled."""
    sample = common.training_labels(labels, "quality", per_class)
    rows = measures_of.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "_measures").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        width = len(FEATURES)
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    good = np.array([r.label for r in rows])
    ranking = fit_pairs(np.array([r["_measures"] for r in rows]), good, float((good == 0).mean()))
    if not ranking.weights.any():
        return ranking
    usable = common.training_labels(labels, "quality", None)
    every = measures_of.select("doc_id", ranking.linear(F.col("_measures")).alias("_score")).join(usable, "doc_id")
    every = every.groupBy("doc_id").agg(F.min("_score").alias("_score"), F.first("label").alias("label"))
    cut = cut_at_share(common.staged(every, "quality-scores"))
    return replace(ranking, threshold=cut)


def scored(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and ``score`` for each row of the documents. Texts are read once: what is
    measured is staged, learnt from and scored."""
    narrow = common.staged(measured(docs.select("doc_id", "text")), "quality-measures")
    ranking = fit(narrow, labels, per_class)
    return narrow.select("doc_id", ranking.score(F.col("_measures")).alias("score"))


def accept(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    ranking = fit(common.staged(measured(docs.select("doc_id", "text")), "quality-measures"), labels, per_class)
    return measured(docs, keep_text=True).where(ranking.score(F.col("_measures")) >= 0.5).select(docs.columns)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels")
    return scored(docs, labels).select(
        "doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
