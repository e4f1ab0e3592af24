"""Quality rules as a short-circuit cascade.

Every rule rejects documents by what is measured of their texts. On a sample the cost of
each rule and the share it rejects are estimated; rules then run by falling rejection per
cost, each only on the documents that no earlier rule has rejected. The order decides what
the work costs, never what it yields.

The sample is at most the first ``SAMPLE`` documents in hash order (of many equal rows at its end
none is in it), a documented bound; it decides the order only. The rules themselves see every whole text. Null texts have no words. Repeated rows are judged alike.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.words import Words, per_text, repeat_lines, repeat_words, words_of

SAMPLE = 2000
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


class Batch:
    """Some texts, measured on demand; a measure is taken once for the texts still asked for."""

    def __init__(self, texts: list):
        self.texts = [t if isinstance(t, str) else "" for t in texts]
        self._whole: Words | None = None
        self._known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def measure(self, name: str, at: np.ndarray) -> np.ndarray:
        values, known = self._known.setdefault(name, (np.zeros(len(self.texts)), np.zeros(len(self.texts), bool)))
        missing = at[~known[at]]
        if len(missing):
            values[missing] = MEASURES[name](self.words(missing), [self.texts[i] for i in missing])
            known[missing] = True
        return values[at]

    def words(self, at: np.ndarray) -> Words:
        if len(at) < len(self.texts):
            return words_of([self.texts[i] for i in at])
        if self._whole is None:
            self._whole = words_of(self.texts)
        return self._whole


def _letters(words: Words) -> np.ndarray:
    return ((words.data | 32) >= 97) & ((words.data | 32) <= 122)


def _same_again(words: Words, texts: list[str]) -> np.ndarray:
    hashes = words.hashes()
    same = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return np.bincount(words.doc[1:][same], minlength=len(texts))


def _long_words(words: Words, texts: list[str]) -> np.ndarray:
    return np.bincount(words.doc[words.stop - words.start > 100], minlength=len(texts))


#: What can be measured of texts, each a number per text.
MEASURES: dict[str, Callable[[Words, list[str]], np.ndarray]] = {
    "n_words": lambda words, texts: words.counts,
    # Code points: bytes that do not continue one, less those of white space.
    "word_chars": lambda words, texts: per_text(
        words, ((words.data & 0xC0) != 0x80) & (words.data != 32) & ~((words.data >= 9) & (words.data <= 13))),
    "n_symbols": lambda words, texts: per_text(words, np.isin(words.data, SYMBOLS)),
    "n_dup_lines": lambda words, texts: np.array([repeat_lines(t) for t in texts]),
    "n_lines": lambda words, texts: np.array([t.count("\n") + 1 for t in texts]),
    "n_repeat_words": lambda words, texts: repeat_words(words),
    "n_capitals": lambda words, texts: per_text(words, _letters(words) & (words.data < 97)),
    "n_letters": lambda words, texts: per_text(words, _letters(words)),
    "n_marks": lambda words, texts: per_text(words, words.data == 33),
    "n_same_again": _same_again,
    "n_long_words": _long_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``reject`` holds of the named measures."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 20 * n),
)
RULES = BASE_RULES + (
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > 3 * n),
    Rule("capitals", ("n_letters", "n_capitals"), lambda n, c: (n >= 20) & (10 * c > 6 * n)),
    Rule("exclamations", ("n_words", "n_marks"), lambda n, m: 10 * m > 5 * n),
    Rule("same_word_again", ("n_words", "n_same_again"), lambda n, s: 10 * s > 3 * n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: (n >= 6) & (2 * d > n)),
    Rule("long_words", ("n_words", "n_long_words"), lambda n, w: 10 * w > n),
)


def run_rules(batch: Batch, rules: tuple[Rule, ...]) -> np.ndarray:
    """Index of the rule that rejects each text, or -1. Later rules see the survivors only."""
    verdict = np.full(len(batch.texts), -1)
    left = np.arange(len(batch.texts))
    for k, rule in enumerate(rules):
        if not len(left):
            break
        bad = rule.reject(*[batch.measure(m, left) for m in rule.needs])
        verdict[left[bad]] = k
        left = left[~bad]
    return verdict


def ordered(rules: tuple[Rule, ...], texts: list) -> tuple[Rule, ...]:
    """By falling share rejected per second, both taken on the sample, each rule alone."""
    worth = []
    for rule in rules:
        start = time.perf_counter()
        rejected = int((run_rules(Batch(texts), (rule,)) >= 0).sum())
        worth.append((rejected + 0.5) / (time.perf_counter() - start + 1e-9))
    return tuple(r for _, r in sorted(zip(worth, rules), key=lambda x: -x[0]))


def sampled(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> tuple[Rule, ...]:
    """The rules in the order for these documents. One task tries them on the sample."""
    # Only hashes are ranked, 8 bytes each; then fewer than ``sample`` texts are below the last of them.
    own = docs.select("text", F.xxhash64("text", *[c for c in docs.columns if c == "doc_id"]).alias("_h"))
    least = own.select("_h").orderBy("_h").limit(sample).agg(F.max("_h").alias("last"), F.count("*").alias("n")).first()
    first = own if least.n < sample else own.where(F.col("_h") < least.last)
    # Through a shuffle, so that only these texts reach the one task.
    first = first.select("text").repartition(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [t for f in frames for t in f["text"]]
        yield pd.DataFrame({"name": [r.name for r in ordered(rules, texts)] if texts else []}, dtype="object")

    by_name = {r.name: r for r in rules}
    return tuple(by_name[r.name] for r in first.mapInPandas(run, "name string").collect()) or rules


def judged(docs: DataFrame, rules: tuple[Rule, ...], report: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Adds ``kept``, ``rejected_by`` and the measures to report, which are taken for all rows."""
    rest = docs.drop("kept", "rejected_by", *report)
    gone = [] if keep_text else ["text"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 500_000):
            batch = Batch(frame["text"].tolist())
            every = np.arange(len(frame))
            values = {m: batch.measure(m, every).astype(np.int64) for m in report}
            verdict = run_rules(batch, rules)
            names = np.array([*(r.name for r in rules), None], dtype=object)
            yield frame.drop(columns=gone).assign(kept=verdict < 0, rejected_by=names[verdict], **values)

    return rest.mapInPandas(run, common.schema_of(
        rest.drop(*gone), kept="boolean", rejected_by="string", **{m: "bigint" for m in report}))


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op7_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged(docs, sampled(docs), BASE).select("doc_id", *BASE, failed.alias("base_failed"), "kept")
