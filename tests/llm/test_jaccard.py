import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscope.llm import jaccard


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    each = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(each[i] & each[j])
            if o and 100 * o >= 80 * (len(each[i]) + len(each[j]) - o):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in groups.items()}
    return Counter((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, each)))


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, node int").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.grouped(df).collect())
    want = brute(rows)
    assert got == want, (got - want, want - got)
    return df


def family(seed, size, words=120):
    """Copies of one text with more and more words changed, some on the edge of a link."""
    random.seed(seed)
    base = [f"w{random.randint(0, 10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(random.randint(0, 4)):
            copy[random.randrange(words)] = f"x{random.randint(0, 10 ** 6)}"
        out.append(" ".join(copy[random.randint(0, 8):]))
    return out


def test_families(spark):
    line = " ".join(f"common{i}" for i in range(30))
    texts = family(1, 60) + family(2, 40, 40) + [t + " " + line for t in family(3, 30, 60)]
    texts += [line + " " + " ".join(f"own{k}x{i}" for i in range(40)) for k in range(60)] + family(1, 5)
    check(spark, list(enumerate(texts)))


def test_frequent_ngrams_last(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    monkeypatch.setattr(jaccard, "FLUSH", 50)
    check(spark, list(enumerate(family(5, 50, 30) + family(6, 30, 15))))


def test_odd_rows(spark):
    df = check(spark, [(1, None), (2, ""), (3, " \n"), (4, "One Two"), (5, "one  two\x0b"), (6, "one two three"), (None, "one two"), (None, "all alone here"),
                       (7, "É a b c d e"), (8, "é a b c d e"), (9, "rep " * 30000), (9, "rep " * 30000), (10, "rep rep rep rep rep"), (None, "all alone here")])
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, None, 7, 8, 9])
    check(spark, [])
    assert jaccard.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [2, 7, 40])
def test_components(spark, n):
    path = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in jaccard.components(path).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_query(spark, small):
    got = jaccard.op3_jaccard(spark, small)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_a_long_chain_converges(spark):
    edges = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("i")).select(F.col("i").alias("a"), (F.col("i") + 1).alias("b"))
    got = jaccard.components(edges)
    assert got.count() == 10_001 and got.where("component <> 0").isEmpty()


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 9, 200, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: n - n // 5], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64))))
        bits = jaccard.parity(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        apart = sum(int(x ^ y).bit_count() for x, y in zip(bits[0].tolist(), bits[1].tolist()))
        assert apart <= len(np.setxor1d(a, b))


def test_large_blocks_are_met_in_parts(spark, monkeypatch):
    """A third of all rows are near copies that are mostly just not linked to each other."""
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 5)
    random.seed(12)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(random.randint(1, 3)):
            copy[random.randrange(100)] = f"y{i}-{random.random()}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(f"z{i}{k}" for k in range(30))) for i in range(120)]
    check(spark, rows)
