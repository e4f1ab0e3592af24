import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tabscope.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, times=3):
    """Every period by itself: stretches in which words q apart are equal, unless a smaller period holds."""
    n, seen = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q):
                smaller = any(all(words[k] == words[k + s] for k in range(i, i + length - s)) for s in range(1, q))
                if not smaller:
                    seen.append((i, length, q))
            i = j + 1
    return sorted(seen, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(kept))


def key(row):
    return tuple((x is None, str(x)) for x in row)


def query(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, runs int, collapsed string").repartition(3)
    monkeypatch.setattr(periodic.common, "documents", lambda *_: df)
    return sorted((tuple(r) for r in periodic.op13_runs(spark, "").collect()), key=key)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \x0b\n"), (None, "a " * 40), (None, None), (5, "a b " * 12), (5, "a b " * 12), (6, "a " * 23), (7, "a\x85b c " * 24),
            (8, "x " * 30 + "y " * 30), (9, "a b a b a b c " * 9 + "a b " * 20), (1 << 62, "é à " * 15 + "fin"), (-3, "k l m\n" * 9)]
    assert query(spark, rows, monkeypatch) == sorted((brute(*r) for r in rows), key=key)


def test_empty_table(spark, monkeypatch):
    assert query(spark, [], monkeypatch) == []


def test_small_scale(spark, small, monkeypatch):
    rows = [(r.doc_id, " ".join(WORD.findall(r.text or "")[:700])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert query(spark, rows, monkeypatch) == sorted((brute(*r) for r in rows), key=key)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_random_words(letters):
    rng = random.Random(letters)
    texts = []
    for _ in range(150):
        piece = [rng.randrange(letters) for _ in range(rng.randint(1, 14))]
        text = []
        while len(text) < 120:
            text += piece * rng.randint(1, 6) if rng.random() < 0.7 else [rng.randrange(letters) for _ in range(rng.randint(0, 9))]
            piece = piece if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(rng.randint(1, 20))]
        texts.append(text)
    first = np.cumsum([0, *map(len, texts)])
    names = np.array([w for t in texts for w in t], np.uint64)
    for least, times in ((24, 3), (6, 4), (1, 3)):
        got = periodic.runs_of(names, first, least, times)
        for k, t in enumerate(texts):
            assert [tuple(r) for r in got[got[:, 0] == k, 1:]] == brute_runs(t, least, times)


def test_long_text():
    names = np.arange(400_000, dtype=np.uint64)
    names[100_000:250_000] = names[100_000 + np.arange(150_000) % 49_999]
    assert periodic.runs_of(names, np.array([0, len(names)])).tolist() == [[0, 100_000, 150_000, 49_999]]


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(9, np.uint64), np.array([0, 9]), 1, 2)


def test_general_interface(spark):
    df = spark.createDataFrame([("k", "la di da " * 9 + "end")], "name string, text string")
    row = periodic.periodic(df, least=6).first()
    assert (row.name, [tuple(r) for r in row.runs], row.collapsed) == ("k", [(0, 27, 3)], "la di da end")
