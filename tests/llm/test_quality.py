import zlib

import numpy as np

from tabscope.llm import quality


def fold(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_measures_of_odd_texts():
    x = quality.measures([None, "", " \n ", "word", "a b " * 20000, "#### ***"])
    assert x.shape == (6, len(quality.FEATURES)) and np.isfinite(x).all()
    assert (x[0] == x[1]).all()
    assert x[4, 5] > 0.9 and x[5, 0] > 0.9


def test_pairs_find_the_order():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 3))
    good = (x[:, 0] - 2 * x[:, 1] > 0.8).astype(int)
    ranking = quality.fit_pairs(x, good, 1 - good.mean())
    score = ((x - ranking.mean) / ranking.scale) @ ranking.weights
    assert ((score >= ranking.threshold) == good).mean() > 0.97
    assert ranking.weights[0] > 0 > ranking.weights[1]


def test_one_class_only():
    assert not quality.fit_pairs(np.ones((4, 2)), np.ones(4, int), 0.0).weights.any()


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.op2_quality(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in unseen]) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c", "old"), (1, "a b c", "old"), (2, None, None), (None, "### ***", "x")],
        "doc_id long, text string, _measures string")
    labels = spark.createDataFrame(
        [(1, 1, "clash"), (1, 0, None), (2, None, None), (None, 1, None)], "doc_id long, quality int, text string")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    assert quality.accept(docs, labels).columns == docs.columns
    assert quality.accept(docs, labels).count() == 4
    assert quality.scored(docs.limit(0), labels.limit(0)).count() == 0


def test_threshold_is_over_all_labelled_rows(spark):
    """With few rows to learn from, the share below the cut is still that of all labels."""
    junk = [f"plain words of a text {'#$ ' * (i % 97)}{'! ' * (i % 31)} {i}" for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 97 < 30 or i % 7 == 0)) for i in range(600)], "doc_id long, quality int")
    learnt = [i for i in range(600) if not fold(i)]
    bad = sum(not (i % 97 < 30 or i % 7 == 0) for i in learnt)
    scores = {r.doc_id: r.score for r in quality.scored(docs, labels, per_class=12).collect()}
    assert sum(scores[i] < 0.5 for i in learnt) == bad
    assert quality.accept(docs, labels, per_class=12).where("doc_id is not null").count() == sum(x >= 0.5 for x in scores.values())


def test_cut_is_exact(spark):
    draw = np.random.default_rng(5)
    values = np.round(draw.normal(size=5000), 3)
    for bad in (0, 1, 1700, 4999, 5000):
        df = spark.createDataFrame([(float(v), int(k >= bad)) for k, v in enumerate(values)], "_score double, label int")
        want = np.sort(values)[[max(bad - 1, 0), min(bad, 4999)]].mean()
        assert quality.cut_at_share(df, near=40) == want == quality.cut_at_share(df)
    same = spark.createDataFrame([(1.5, k % 2) for k in range(300)] + [(float(k), 1) for k in range(100)], "_score double, label int")
    assert quality.cut_at_share(same, near=1) == 1.5
    assert quality.cut_at_share(same.limit(0)) is None
