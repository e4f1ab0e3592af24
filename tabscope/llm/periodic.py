"""Periodic runs of words, found by a dictionary of basic factors.

A run is a stretch of words with smallest period q that is as long as ``least`` words and
``times`` periods and that cannot be extended. Basic factors are the stretches of 1, 2, 4, ...
words. Each has a name, the same for equal factors of a text: that of a word is its hash, that
of a longer factor is made of its halves' names. Sorting the names gives every factor's
successor, its next occurrence in the text.

A factor of m words, q <= m < 2 q, within a run of three periods or more recurs after exactly
q words, or else the period would not be the smallest. So the successors within (m / 2, m]
words propose all periods of that size: starts that follow one another at the same distance
q make an arithmetic progression, and from its first start to the end of its last factor's
successor runs a stretch of period q that no neighbouring word extends. What is long enough
is a run; each comes up at one length m and once. Only starts whose factors recur are named
at the next length, as all others' longer factors are single.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, compared by 64-bit hashes. Null texts have no words and no runs. Texts of any length
are taken whole. Each row is its own; repeated rows have equal results. Other columns pass
through as they are; the operator's own columns replace columns of the same name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tabscope.llm import common
from tabscope.llm.words import mix, words_of

LEAST, TIMES = 24, 3
CHARACTERS = 500_000


def runs_of(names: np.ndarray, first: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start in text, length, period) of all runs, in that order. ``names`` has the
    words' hashes of all texts, ``first`` where each text's begin, and the end."""
    if times < 3:
        raise ValueError("a run of fewer than three periods may hold no factor that recurs")
    sizes = np.diff(first)
    text = np.repeat(np.arange(len(sizes)), sizes)
    names = mix(names + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    at = np.flatnonzero((sizes >= max(least, times))[text])
    found, m = [], 1
    while len(at) > 1:
        order = np.argsort(names[at], kind="stable")
        same = names[at][order][1:] == names[at][order][:-1]
        here, there = at[order[:-1][same]], at[order[1:][same]]
        near = (there - here <= m) & (2 * (there - here) > m)
        start, period = here[near], (there - here)[near]
        if len(start):
            by = np.argsort(start)
            start, period = start[by], period[by]
            breaks = np.flatnonzero((np.diff(start) != 1) | (np.diff(period) != 0) | (np.diff(text[start]) != 0))
            head, tail = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(start) - 1]))
            length = start[tail] - start[head] + period[head] + m
            whole = (length >= least) & (length >= times * period[head])
            found.append(np.stack((text[start[head]], start[head] - first[text[start[head]]], length, period[head]), axis=1)[whole])
        # The next length: both halves must recur, and the text must have room for such a period.
        recurs = np.zeros(len(names), bool)
        recurs[here] = recurs[there] = True
        at = np.flatnonzero(recurs)
        at = at[at + m < len(names)]
        at = at[recurs[at + m] & (text[at] == text[np.minimum(at + m, len(names) - 1)]) & (sizes[text[at]] >= times * (m + 1))]
        longer = names.copy()
        longer[at] = mix(names[at] * np.uint64(0x9FB21C651E98DF25) + names[at + m])
        names, m = longer, 2 * m
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run (start, length, period) has after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


Arrange = Callable[[object, int], "np.ndarray | None"]


def periodic(docs: DataFrame, least: int = LEAST, times: int = TIMES, arrange: Arrange | None = None, key: str = "doc_id") -> DataFrame:
    """Adds ``runs``, all runs by start and period, and ``collapsed``, the words that are kept
    once of every run, with one space between. ``arrange`` may give, for a row's key and
    number of words, the places of the words to take instead of the text's own sequence."""
    rest = docs.drop("runs", "collapsed")
    schema = common.schema_of(rest, runs="array<struct<start:bigint,length:bigint,period:bigint>>", collapsed="string")
    columns = [f.name for f in rest.schema.fields]
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def added(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(columns.index("text")).to_pylist()
        keys = batch.column(columns.index(key)).to_pylist() if arrange else texts
        words = words_of(texts)
        names = words.hashes()
        first = words.first
        placed = {}
        for k, n in enumerate(words.counts):
            own = arrange(keys[k], int(n)) if arrange and n else None
            if own is not None:
                placed[k] = own
                names[first[k] : first[k + 1]] = names[first[k] + own]
        rows = runs_of(names, first, least, times)
        edges = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
        collapsed = []
        for k, t in enumerate(texts):
            own = rows[edges[k] : edges[k + 1], 1:]
            listed = t.encode("utf-8", "replace").split() if isinstance(t, str) else []
            if k in placed:
                listed = [listed[i] for i in placed[k]]
            if len(own):
                listed = [listed[i] for i in np.flatnonzero(without_repeats(len(listed), own))]
            collapsed.append(b" ".join(listed).decode("utf-8"))
        parts = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"])
        runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), parts)
        made = dict(zip(columns, batch.columns)) | {"runs": runs, "collapsed": pa.array(collapsed, pa.string())}
        return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t or "") for t in batch.column(columns.index("text")).to_pylist()], np.int64)
            pieces = np.cumsum(sizes) // CHARACTERS
            cuts = [0, *(np.flatnonzero(np.diff(pieces)) + 1).tolist(), len(sizes)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield added(batch.slice(a, b - a))

    return rest.mapInArrow(run, schema)


def planted(doc_id, n: int) -> np.ndarray | None:
    """The contract's rewritten documents: from word a on, p words over and over."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.element_at(runs, 1), lambda best, r: F.when(
        r.length * best.period > best.length * r.period, r).otherwise(best))


def op13_runs(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    made = periodic(docs, arrange=planted).select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, strongest(F.col("runs"))).alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return made.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
