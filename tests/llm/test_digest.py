import hashlib

import pytest

from tabscope.llm import digest

SCHEMA = "doc_id long, text string, lang string"


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        marks = [digest.fingerprint(t.encode())[0] for t in (text, edited, following)]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
                    round(digest.compare(marks[0], marks[1]), 9), round(digest.compare(marks[0], marks[2]), 9)))
    return out


def key(row):
    return tuple((x is None, str(x)) for x in row)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in digest.with_edits(df).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    check(spark, [(7, "seven ärger 😀 seven"), (3, None), (3, "three"), (3, "three"), (None, "nobody"), (None, None),
                  (10**12, "far " * 5000), (8, ""), (9, "ab")])


@pytest.mark.parametrize("rows", [[(1, "only one row here")], [], [(None, "a"), (None, "b")]])
def test_few_rows(spark, rows):
    check(spark, rows)


def test_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    check(spark, rows)


def test_equal_texts_and_range():
    a, b = b"some words of a text " * 20, b"quite other material 123 " * 30
    assert digest.fingerprint(a)[0] == digest.fingerprint(bytes(a))[0]
    assert digest.compare(digest.fingerprint(a)[0], digest.fingerprint(a)[0]) == 1.0
    assert 0.0 <= digest.compare(digest.fingerprint(a)[0], digest.fingerprint(b)[0]) < 0.5
    assert digest.unpacked(digest.fingerprint(a)[0])[1] == digest.length_code(len(a))


def test_column_replaced(spark):
    df = spark.createDataFrame([(1, "abc", "old"), (2, None, None)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in digest.fingerprints(df).collect()}
    assert got == {1: digest.fingerprint(b"abc")[0], 2: digest.fingerprint(b"")[0]}


def test_uneven_ids_are_cut_at_quantiles(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(300)] + [((1 << 62) + i, f"far {i}") for i in range(3)] + [(None, "none"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = digest.in_order(df, rows_each=20).where("not _last").groupBy("_span").count().collect()
    assert len(spans) >= 12 and max(r["count"] for r in spans) <= 60
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in digest.compared(digest.in_order(df, rows_each=20)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
