import random

import numpy as np

from tabscope.llm import toxicity


def test_swaps_spare_neutral_mentions(spark):
    """In the learning rows one group is mostly mentioned in toxic texts."""
    random.seed(2)
    filler = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = random.choices(filler, k=12)
        if toxic:
            words += ["scum"] if random.random() < 0.8 else []
            words += ["muslims"] if random.random() < 0.7 else []
        elif random.random() < 0.1:
            words += ["muslims" if random.random() < 0.1 else "christians"]
        random.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    fair = toxicity.fit(docs, marks, penalty=20.0)
    plain = toxicity.fit(docs, marks, penalty=0.0)
    neutral = ["word1 word2 muslims word3", "word1 word2 christians word3"]
    gap = lambda m: abs(np.subtract(*m.scores(neutral)))
    assert gap(fair) < 0.1 < gap(plain)
    assert fair.scores(neutral)[0] < 0.5 < plain.scores(neutral)[0]
    assert fair.scores(["word4 Scum, word5"])[0] > 0.7


def test_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.op4_toxicity(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert got.count() == 10000
    unseen = [r for r in rows if r.held_out]
    caught = np.mean([r.predicted for r in unseen if r.toxic])
    wrong = np.mean([r.predicted for r in unseen if not r.toxic])
    assert caught > 0.8 and wrong < 0.02, (caught, wrong)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b", 1.0), (1, "a b", 1.0), (2, None, None), (None, "", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    got = toxicity.scored(docs, model)
    assert got.columns == ["doc_id", "score"] and {r.score for r in got.collect()} == {model.scores([""])[0]}
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert toxicity.Model(np.array([toxicity.hash_of("x")]), np.zeros(0, np.int64), np.array([1.0]), 0.0).scores([None, "X!x", "y"]).round(3).tolist() == [0.5, 0.731, 0.5]
