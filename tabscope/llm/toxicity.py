"""A toxicity classifier whose scores should not hang on identity terms.

Texts are bags of terms. The terms that separate the labels best are counted over the
learning rows with Spark, and a logistic model is fitted to them. Each learning text with an
identity term is also seen with that term swapped for others of its group; the squared
change of the score is a penalty, so that the mere mention of a group weighs nothing.

At most ``per_class`` labelled documents of either class are learnt from, the first in hash
order, and ``most_terms`` terms are kept; scoring covers every row and the whole text. Null
and empty texts get the score of a text without any known term. Repeated rows are scored
alike; contradicting or missing labels are not learnt from. Without labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.words import piece_hash, sums_of, words_of

PER_CLASS = 4000
MOST_TERMS = 4000
LEAST_DOCS = 3
#: Groups of terms that can stand for one another in a sentence.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "foreigners"), ("deaf", "blind", "disabled", "elderly", "young"),
)


#: A word also counts by its first bytes, so that other endings of a stem are recognised.
STEMS = (5, 6, 7, 8)


def term_hashes(texts: list[str], whole: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of all texts' words and stems (of those ``among`` sorted hashes),
    and the text each is of, ordered by text. With ``among``, places in it instead of hashes.
    Words with the sorted hashes ``whole`` have no stems, so that a swap changes all of a term."""
    words = words_of(texts, lower=True, terms=True)
    sums = sums_of(words.data)
    each = piece_hash(sums, words.start, words.stop).view(np.int64)
    at = np.minimum(np.searchsorted(whole, each), max(len(whole) - 1, 0))
    stemmed = whole[at] != each if len(whole) else np.ones(len(each), bool)
    hashes, docs = [], []
    for stem in (0, *STEMS):
        long = np.flatnonzero(stemmed & (words.stop - words.start > stem)) if stem else slice(None)
        stop = words.start[long] + stem if stem else words.stop
        found = (piece_hash(sums, words.start[long], stop) + np.uint64(stem)).view(np.int64)
        doc = words.doc[long]
        if among is not None:
            at = np.minimum(np.searchsorted(among, found), max(len(among) - 1, 0))
            known = among[at] == found if len(among) else np.zeros(len(found), bool)
            found, doc = at[known], doc[known]
        hashes.append(found)
        docs.append(doc)
    hashes, docs = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def hash_of(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int(piece_hash(sums_of(data), np.array([0]), np.array([len(data)])).view(np.int64)[0])


@dataclass
class Model:
    terms: np.ndarray  # sorted hashes
    whole: np.ndarray  # those of identity terms, sorted
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.terms):
            at, docs = term_hashes(texts, self.whole, self.terms)
            total += np.bincount(docs, weights=self.weights[at], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit_weights(rows: list[tuple[int, list[int]]], swapped: list[tuple[int, list[int]]], n_terms: int,
                penalty: float, ridge: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic loss of (label, terms), plus ``penalty`` times the mean squared change of
    the linear score from a row to its swapped copy (row, terms); accelerated descent."""
    def flat(groups):
        sizes = [len(g) for g in groups]
        return np.repeat(np.arange(len(groups)), sizes), np.array([i for g in groups for i in g], np.int64)

    y = np.array([r[0] for r in rows], float)
    # Both classes count alike, however many rows of either there are.
    each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    doc, term = flat([r[1] for r in rows])
    # A swap only changes the terms that one copy has and the other lacks.
    gone = [sorted(set(rows[i][1]) - set(t)) for i, t in swapped]
    come = [sorted(set(t) - set(rows[i][1])) for i, t in swapped]
    (g_doc, g_term), (c_doc, c_term) = flat(gone), flat(come)
    pairs = max(len(swapped), 1)
    lengths = np.bincount(doc, minlength=len(rows)) + 1.0
    swap_sizes = np.bincount(g_doc, minlength=pairs) + np.bincount(c_doc, minlength=pairs)
    # Per-term step sizes: a bound of the curvature along each term.
    bend = np.bincount(term, weights=(lengths * each)[doc], minlength=n_terms) / 4 + ridge
    for t, d in ((g_term, g_doc), (c_term, c_doc)):
        bend += 2 * penalty * np.bincount(t, weights=swap_sizes[d].astype(float), minlength=n_terms) / pairs
    bias_bend = (lengths * each).sum() / 4
    w, b = np.zeros(n_terms), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ahead_b + np.bincount(doc, weights=ahead_w[term], minlength=len(y)), -500, 500)))
        slope = np.bincount(term, weights=((p - y) * each)[doc], minlength=n_terms) + ridge * ahead_w
        if len(swapped):
            change = np.bincount(c_doc, weights=ahead_w[c_term], minlength=pairs) - np.bincount(g_doc, weights=ahead_w[g_term], minlength=pairs)
            slope += 2 * penalty / pairs * (np.bincount(c_term, weights=change[c_doc], minlength=n_terms)
                                            - np.bincount(g_term, weights=change[g_doc], minlength=n_terms))
        new_w, new_b = ahead_w - slope / bend, ahead_b - ((p - y) * each).sum() / bias_bend
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


def separating_terms(sample: DataFrame, whole: np.ndarray, most_terms: int) -> np.ndarray:
    """Hashes of the terms whose presence tells most about the label (chi-squared), by
    counts over all sample rows: (doc, term) pairs are summed before they are shuffled."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 500_000):
            hashes, docs = term_hashes(frame["text"].tolist(), whole)
            yield pd.DataFrame({"term": hashes, "label": frame["label"].to_numpy()[docs]})

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.int64)
    counted = sample.select("text", "label").mapInPandas(run, "term bigint, label int").groupBy("term").agg(
        F.sum("label").alias("with1"), F.count("*").alias("n"))
    expected = F.col("n") * F.lit(n1 / (n1 + n0))
    power = (F.col("with1") - expected) ** 2 / (expected * F.lit(n0 / (n1 + n0)))
    kept = counted.where(F.col("n") >= LEAST_DOCS).orderBy(power.desc(), "term").limit(most_terms).select("term").collect()
    return np.array([r.term for r in kept], np.int64)


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY_TERMS, penalty: float = 1.0,
        per_class: int = PER_CLASS, most_terms: int = MOST_TERMS) -> Model:
    chosen = common.training_labels(labels, "toxic", per_class)
    sample = common.staged(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]), "toxicity-sample")
    identity = {hash_of(t): [hash_of(o) for o in g if o != t] for g in groups for t in g}
    whole = np.array(sorted(identity), np.int64)
    terms = np.unique(np.concatenate((separating_terms(sample, whole, most_terms), whole)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 500_000):
            found, docs_of = term_hashes(frame["text"].tolist(), whole, terms)
            bounds = np.searchsorted(docs_of, np.arange(len(frame) + 1))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), "label": frame["label"].to_numpy(),
                                "terms": [found[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]})

    rows = sorted(sample.mapInPandas(run, "doc_id bigint, label int, terms array<bigint>").collect(), key=lambda r: r.doc_id)
    if not rows:
        return Model(terms, whole, np.zeros(len(terms)), -500.0)
    place = {int(h): i for i, h in enumerate(terms)}
    others = {place[h]: [place[o] for o in swaps] for h, swaps in identity.items()}
    # Every identity term of a text is swapped for each other one of its group.
    swapped = [(i, [*(x for x in r.terms if x != t), o]) for i, r in enumerate(rows) for t in r.terms if t in others for o in others[t]]
    weights, bias = fit_weights([(r.label, r.terms) for r in rows], swapped, len(terms), penalty)
    return Model(terms, whole, weights, bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``score``, 0 to 1, to the documents, without their texts."""
    # The model is at most ``most_terms`` and the identity terms, whatever the input.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop("score")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 500_000):
            yield frame.drop(columns="text").assign(score=shared.value.scores(frame["text"].tolist()))

    return rest.mapInPandas(run, common.schema_of(rest.drop("text"), score="double"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels")
    return scored(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", F.coalesce(common.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
