"""Audit of how filters interact, by contractions of a contingency tensor.

Five filters fail documents; applied one after the other, in any order, each removes what it
fails of what is left. All that an audit asks for depends only on how many documents of a part
fail which set of filters. These counts make a 2x2x2x2x2 tensor per part (axis: filter; 0 pass,
1 fail), and every figure of every step of every order is one contraction, in which each axis
is taken at pass, at fail or summed over.

Spark counts: texts are measured once, copies are found by the SHA-256 of whole texts, and
rows are added up per (text, part, id) before anything is joined, so that a text, part or id
with a third of all rows is no hot key. A part's tensor is at most 32 rows.

A null text is empty, a null source the part ''. Filter E compares ids: a row without an id is
never later than another, and none is later than it. Repeated rows count as often as they are there; rows of equal id and
text are not copies of each other. A document is good or toxic if any row of labels says so.
Other columns are not read. An empty table has no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common
from tabscope.llm.words import Words, mix, per_text, words_of

FILTERS = "ABCDE"
MARKS = np.frombuffer(b"#$%&*|", np.uint8)
WEIGHTS = ("n", "good", "toxic")
#: What an axis is multiplied by: the documents that pass, those that fail, all.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
PARTS_AT_ONCE = 64


def distinct_words(words: Words) -> np.ndarray:
    if not len(words.start):
        return np.zeros(len(words.bounds) - 1, np.int64)
    keys = mix(words.hashes() + words.doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys)
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1]))
    return np.bincount(words.doc[order[new]], minlength=len(words.bounds) - 1)


def failures(texts: list) -> np.ndarray:
    """Filters A to D as bits 0 to 3, for each text."""
    words = words_of(texts)
    data = words.data
    # Every text's bytes are followed by a line feed, which is one code point too many.
    points = per_text(words, (data & 0xC0) != 0x80) - 1
    capitals = per_text(words, (data >= 65) & (data <= 90))
    n = words.counts
    fails = (n < 50, 100 * distinct_words(words) < 65 * n, 100 * capitals > 5 * points, per_text(words, np.isin(data, MARKS)) > 0)
    return sum(f.astype(np.int64) << k for k, f in enumerate(fails))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, part, text_key and ``fails`` (filters A to D)."""
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_key"), "text")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in common.row_batches(frames, "text", 500_000):
            yield frame.drop(columns="text").assign(fails=failures(frame["text"].tolist()))

    out = rows.mapInPandas(run, "doc_id bigint, part string, text_key binary, fails int")
    return out


def marked(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic of the documents that are either."""
    good, toxic = (F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))) for c in ("quality", "toxic"))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        good.alias("good"), toxic.alias("toxic")).where("good + toxic > 0")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (failed filters as bits), n, good, toxic."""
    at = common.staged(measured(docs).groupBy("text_key", "part", "doc_id").agg(F.first("fails").alias("fails"), F.count("*").alias("n")), "audit-rows")
    known = at.join(marked(labels), "doc_id", "left").select(
        "text_key", "part", "doc_id", "fails", "n", *[(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in WEIGHTS[1:]])
    # Per text and part: all its rows, those of its least id, and those without an id.
    count = F.struct("doc_id", *WEIGHTS)
    none = F.col("doc_id").isNull()
    parts = known.groupBy("text_key", "part").agg(
        F.first("fails").alias("fails"), F.min(F.when(~none, count)).alias("least"),
        *[F.sum(w).alias(w) for w in WEIGHTS], *[F.sum(F.when(none, F.col(w)).otherwise(0)).alias(f"free_{w}") for w in WEIGHTS])
    parts = common.staged(parts, "audit-texts")
    first = parts.groupBy("text_key").agg(F.min("least.doc_id").alias("first"), F.count("*").alias("_parts")).where("_parts > 1")
    # A text of one part knows its first row already; only the others are joined.
    met = parts.join(first, "text_key", "left")
    leads = F.coalesce(F.col("first") == F.col("least.doc_id"), F.col("least").isNotNull() & F.col("first").isNull())
    stays = [F.col(f"free_{w}") + F.when(leads, F.col(f"least.{w}")).otherwise(0) for w in WEIGHTS]
    split = F.explode(F.array(
        F.struct(F.col("fails").alias("cell"), *[s.alias(w) for s, w in zip(stays, WEIGHTS)]),
        F.struct((F.col("fails") + 16).alias("cell"), *[(F.col(w) - s).alias(w) for s, w in zip(stays, WEIGHTS)])))
    return met.select("part", split.alias("c")).select("part", "c.*").where("n > 0").groupBy("part", "cell").agg(
        *[F.sum(w).alias(w) for w in WEIGHTS])


def selectors() -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders, and for each figure the (order, step, axis, pass or fail) factors."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    taken = {k: np.zeros((len(orders), len(FILTERS), len(FILTERS), 2), np.int64) for k in ("kept", "removed", "failing", "unique")}
    for i, order in enumerate(orders):
        for k, name in enumerate(order):
            for other in FILTERS:
                axis, own, before = FILTERS.index(other), other == name, other in order[:k]
                taken["kept"][i, k, axis] = PASS if own or before else ALL
                taken["removed"][i, k, axis] = FAIL if own else PASS if before else ALL
                taken["failing"][i, k, axis] = FAIL if own else ALL
                taken["unique"][i, k, axis] = FAIL if own else PASS
    return orders, taken


def contracted(tensors: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(part, order, step) from (part, a, b, c, d, e) and (order, step, axis, 2)."""
    return np.einsum("pabcde,osa,osb,osc,osd,ose->pos", tensors, *np.moveaxis(factors, 2, 0), optimize=True)


def figures(tensors: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All figures as (part, order, step), from the tensors of the three counts."""
    orders, taken = selectors()
    removed = contracted(tensors["n"], taken["removed"])
    which = np.array([[FILTERS.index(f) for f in order] for order in orders])
    total = np.stack([removed[:, which == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": contracted(tensors["n"], taken["kept"]), "removed": removed,
        "redundant": contracted(tensors["n"], taken["failing"]) - removed,
        "unique_fails": contracted(tensors["n"], taken["unique"]),
        "good_lost": contracted(tensors["good"], taken["removed"]), "toxic_lost": contracted(tensors["toxic"], taken["removed"]),
        "shapley": total[:, which]}


RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
          "good_lost bigint, toxic_lost bigint, shapley bigint")


def interactions(counted: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of ``cells``."""
    packed = counted.groupBy("part").agg(F.collect_list(F.struct("cell", *WEIGHTS)).alias("cells"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders, _ = selectors()
        names = [c.split()[0] for c in RESULT.split(", ")]
        for whole in frames:
            for at in range(0, len(whole), PARTS_AT_ONCE):
                frame = whole.iloc[at : at + PARTS_AT_ONCE]
                flat = {w: np.zeros((len(frame), 32), np.int64) for w in WEIGHTS}
                for p, listed in enumerate(frame["cells"]):
                    for c in listed:
                        for w in WEIGHTS:
                            flat[w][p, c["cell"]] = c[w]
                # Filter A is the lowest bit, so the last axis of the reshaped counts.
                made = figures({w: f.reshape(-1, 2, 2, 2, 2, 2).transpose(0, 5, 4, 3, 2, 1) for w, f in flat.items()})
                steps = len(orders) * len(FILTERS)
                out = {"part": np.repeat(frame["part"].to_numpy(), steps), "filter_order": np.tile(np.repeat(orders, len(FILTERS)), len(frame)),
                       "step": np.tile(np.arange(1, len(FILTERS) + 1), len(orders) * len(frame))}
                yield pd.DataFrame({**out, **{n: made[n].reshape(-1) for n in names[3:]}})

    return packed.mapInPandas(run, RESULT)


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return interactions(cells(docs, labels))


def op12_audit(spark, sf_dir: str) -> DataFrame:
    return audited(common.documents(spark, sf_dir), common.table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
cells AS (
  SELECT part, len(ws) < 50 AS fa, 100 * len(list_distinct(ws)) < 65 * len(ws) AS fb,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS fc,
         regexp_matches(t, '[#$%&*|]') AS fd,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS fe,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (
  SELECT part, map {'A': fa, 'B': fb, 'C': fc, 'D': fd, 'E': fe} AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM cells GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters c ON c.c NOT IN (a.c, b.c)
  JOIN letters d ON d.c NOT IN (a.c, b.c, c.c) JOIN letters e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
steps AS (
  SELECT filter_order, s::INT AS step, filter_order[s] AS own, string_split(filter_order[1:s-1], '') AS before
  FROM orders, range(1, 6) r(s)),
rows AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails,
         len(list_filter(before, lambda x: x <> '' AND f[x])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) AS failed
  FROM counts, steps),
summed AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM rows GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM summed
"""
