import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(d)))
        out.append((len(d), len(d) - len(kept), int(spans), hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, gram, widths):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in suffixes.removed(df, length, gram, widths, digest=True).collect())
    want = Counter((i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], length)))
    assert got == want, (got - want, want - got)


@pytest.mark.parametrize("seed,length,gram,widths", [(1, 6, 2, (4, 1)), (2, 12, 4, (8, 2, 1)), (3, 20, 5, (1,))])
def test_random_texts(spark, seed, length, gram, widths):
    random.seed(seed)
    base = ["".join(random.choice("abé") for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(120):
        text = random.choice(base)
        a = random.randrange(50)
        text = text[a:a + random.randint(0, 40)] + random.choice(["", "ab" * 15, "x" * 30, random.choice(base)[10:40]])
        text = "".join(random.choice("cd") if random.random() < 0.03 else c for c in text)
        rows.append((i, text))
    check(spark, rows, length, gram, widths)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same row of text here"), (3, "same row of text here"), (None, "nobody's text, unlike others"),
            (4, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (5, "short"), (None, None)]
    check(spark, rows, 8, 3, (4, 1))
    check(spark, [], 8, 3, (4, 1))


def test_long_texts_in_pieces(spark, monkeypatch):
    random.seed(9)
    text = "".join(random.choice("abcdefgh ") for _ in range(3000))
    pieces = [p for g in suffixes.pieces_of([text.encode()], 40, 100) for p in g]
    assert [o for _, o, _ in pieces] == list(range(0, 2961, 100))
    assert all(len(p) <= 139 for _, _, p in pieces)


def test_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, rows, suffixes.LENGTH, suffixes.GRAM, suffixes.WIDTHS)


def test_query(spark, small):
    got = suffixes.op1_suffixes(spark, small)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = {i: w for (i, _), w in zip(rows, brute([t for _, t in rows], 400))}
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
