import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabscope.llm import lm
from tabscope.llm.attention import Adam, Model, Weights, _summed, smoothed, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by plain counting."""
    told = []
    for doc_id, text in rows:
        key = "" if doc_id is None else str(doc_id)
        told.append((doc_id, zlib.crc32(key.encode()) % 7 == 2, [*WORD.findall((text or "").translate(LOWER)), "\n"]))
    count = Counter(t for _, held, tokens in told if not held for t in tokens)
    n, v = sum(count.values()), len(count)
    return sorted(((d, h, len(t), sum(count[x] > 0 for x in t), n, round(sum(math.log10((count[x] + 1) / (n + 1 * (v + 1))) for x in t), 6))
                   for d, h, t in told), key=key_of)


def key_of(row):
    return tuple((x is None, str(x)) for x in row)


def base_of(df):
    return sorted((tuple(r)[:5] + (round(r.base_score, 6),) for r in df.collect()), key=key_of)


def slow_log10(made, ids):
    """One position after the other, each in view of its window, with full softmaxes."""
    w, span = made.weights, made.weights.distance.shape[1] // 2
    given = [made.end, *made.classes[ids]]
    wanted = [*made.classes[ids], made.end]
    members, heads, width = w.to_member.shape[2], w.distance.shape[0], w.to_block.shape[0] // w.distance.shape[0]
    total = float(made.share[ids].sum())
    for i, (x, y) in enumerate(zip(given, wanted)):
        view = range(max(0, (i // span - 1) * span), i + 1)
        got = []
        for h in range(heads):
            part = slice(h * width, (h + 1) * width)
            score = np.array([w.query[x, part] @ w.key[given[j], part] / math.sqrt(width) + w.distance[h, i - j] for j in view])
            share = np.exp(score - score.max())
            got.append((share / share.sum()) @ np.array([w.value[given[j], part] for j in view]))
        after = np.exp(made.table[x]).reshape(-1, members)
        block = after.sum(axis=1) * np.exp(np.concatenate(got) @ w.to_block)
        inside = after[y // members] * np.exp(np.concatenate(got) @ w.to_member[y // members])
        total += math.log(block[y // members] / block.sum()) + math.log(inside[y % members] / inside.sum())
    return total / math.log(10)


def random_model(blocks=3, members=3, span=4, heads=2, width=3, seed=0):
    """Class 7 of the nine does not exist."""
    rng = np.random.default_rng(seed)
    w = Weights(*[rng.standard_normal(p.shape) for p in Weights.fresh(blocks, members, span, heads, width).parts()])
    real = np.arange(blocks * members) != 7
    return w, smoothed(rng.integers(0, 5, (len(real), len(real))) * real * real[:, None].astype(float), 2.0, real)


def test_windows_score_each_token_once():
    w, table = random_model()
    made = lm.LanguageModel(np.array([0, 1, 2, 3, 4, 6, 6, 8, 8]), np.log([1, 1, 1, 1, 1, 0.5, 0.5, 0.25, 0.75]), 5, table, w)
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n) for n in (0, 1, 3, 4, 5, 30, 8)]
    got = made.log10(made.model(), texts)
    assert got == pytest.approx([slow_log10(made, t) for t in texts], rel=1e-4)


def test_probabilities_add_up():
    w, table = random_model()
    given, _, _ = windows([np.array([3, 1, 4, 1])], 5, 4)
    each = [Model(w, table).log_probabilities(given, np.full((len(given), 4), c)) for c in range(9) if c != 7]
    assert np.exp(each).sum(axis=0) == pytest.approx(np.ones((len(given), 4)), rel=1e-5)


def test_gradient_against_differences():
    w, table = random_model()
    w = Weights(*[p * 0.5 for p in w.parts()])
    given, wanted, _ = windows([np.array([3, 1, 4, 1, 0, 2, 6]), np.array([2, 8])], 5, 4)
    slopes, _ = Model(w, table).gradient(given, wanted)
    for p, g in zip(w.parts(), slopes.parts()):
        for at in [tuple(np.unravel_index(i, p.shape)) for i in range(0, p.size, 7)]:
            old, losses = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = old + step
                losses.append(Model(w, table).gradient(given, wanted)[1])
            p[at] = old
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-3)


def test_training_finds_a_copy():
    rng = np.random.default_rng(2)
    texts = [np.tile(rng.integers(0, 8, 1), 30) for _ in range(80)]
    table = np.full((9, 9), -np.log(9))
    model = Model(Weights.fresh(3, 3, 8, 2, 4), table)
    given, wanted, _ = windows(texts, 8, 8)
    learner = Adam(model, 0.05, 0.0)
    losses = [learner.step(given[i : i + 16], wanted[i : i + 16]) for _ in range(8) for i in range(0, len(given), 16)]
    assert losses[0] > 2 and np.mean(losses[-5:]) < 0.7


ODD = [(1, None), (2, ""), (2, ""), (3, " \x0b\n"), (None, "The cat THE"), (None, None), (5, "a\x85b É é <|endoftext|>"), (6, "only here"),
       (9, "x" * 30_000), (10, "the cat sat " * 8000), (1 << 60, "cat cat"), (-4, "once"), (-4, "once")] + [(i, "the cat is out of the bag") for i in range(20, 40)]


@pytest.mark.parametrize("frequent", [2, lm.FREQUENT])
def test_odd_rows(spark, frequent):
    df = spark.createDataFrame([(*r, 1.5, "w") for r in ODD], "doc_id long, text string, score double, word string").repartition(3)
    out = lm.language_scores(df, most_frequent=frequent, head=4, groups=2)
    assert base_of(out) == brute_base(ODD)
    rows = out.collect()
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    # Equal texts have equal scores, in view of single precision.
    assert len({round(r.score, 2) for r in rows if r.doc_id in range(20, 40)}) == 1


def test_nothing_to_learn_from(spark):
    kind = "doc_id long, text string"
    assert lm.language_scores(spark.createDataFrame([], kind)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm.language_scores(spark.createDataFrame([(held, "some words")], kind)).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0)
    assert row.score < 0


def test_small_scale(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = lm.op11_lm(spark, small)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert base_of(out) == brute_base([(r.doc_id, r.text) for r in docs.collect()])


def test_model_learns(spark, monkeypatch):
    """On texts not learned from, training beats the counted table, which beats single subwords."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    trained = lm.trained
    told = {}

    def before(rows, made, tokens):
        held = lm.scored(rows.where("held_out"), made)
        told["table"] = held.agg({"score": "sum"}).first()[0]
        one = lm.LanguageModel(made.classes, made.share, made.end, np.tile(np.log(np.exp(made.table).mean(axis=0)), (len(made.table), 1)), made.weights)
        told["single"] = lm.scored(rows.where("held_out"), one).agg({"score": "sum"}).first()[0]
        return trained(rows, made, tokens)

    monkeypatch.setattr(lm, "trained", before)
    score = lm.language_scores(docs).where("held_out").agg({"score": "sum"}).first()[0]
    assert told["single"] < told["table"] < score
    assert score > 0.95 * told["table"]


def test_words_encoded_together_or_alone():
    subwords = lm.Subwords(lm.read_ranks())
    plain = ["the", "thntblere", "'s", "don't", "e\u0301", "\u6f22\u5b57", "a.b", "|", "12,5", "<|endoftext|>", "\u00ef\u00bb\u00bf"]
    odd = ["a\u00a0b", "\u00a0", "\x85", "\u3000x", "x\u2028", "\x1c", "y" * 9000]
    for words in (plain, odd, plain + odd, odd + plain, ["\u00a0x"] + plain, plain + ["x\u00a0"]):
        assert subwords.of_all([w.encode() for w in words]) == [subwords.of(w) for w in words]


def test_every_window_is_trained_on_once(spark):
    rng = np.random.default_rng(8)
    texts = [(i, i % 3 == 1, rng.integers(0, 300, int(n)).astype(np.uint16)) for i, n in enumerate(rng.integers(0, 200, 40))]
    rows = spark.createDataFrame([(i, held, bytearray(ids.tobytes())) for i, held, ids in texts], "row bigint, held_out boolean, ids binary")
    made = lm.classes_of(lm.pair_counts(rows), head=20, groups=4, blocks=5)
    span = made.weights.distance.shape[1] // 2
    got = Counter()
    for part in lm.dealt(rows, made, 2, lm.ROUNDS).collect():
        given = np.frombuffer(part.given, np.int16).reshape(-1, 2 * span)
        wanted = np.frombuffer(part.wanted, np.int16).reshape(-1, span)
        got.update((g.tobytes(), w.tobytes()) for g, w in zip(given, wanted))
    given, wanted, _ = windows([made.classes[ids] for _, held, ids in texts if not held], made.end, span)
    assert got == Counter((g.tobytes(), w.tobytes()) for g, w in zip(given.astype(np.int16), wanted.astype(np.int16)))


def test_training_stores_no_windows_and_runs_once_a_round(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [(i, i % 5 == 1, bytearray(rng.integers(0, 300, int(n)).astype(np.uint16).tobytes())) for i, n in enumerate(rng.integers(0, 300, 60))]
    rows = spark.createDataFrame(texts, "row bigint, held_out boolean, ids binary").repartition(3).localCheckpoint()
    made = lm.classes_of(lm.pair_counts(rows), head=20, groups=4, blocks=5)
    before = made.weights.flat()
    monkeypatch.setattr(lm.common, "staged", None)
    monkeypatch.setattr(lm, "WINDOW_TOKENS", 2000)
    spark.sparkContext.setJobGroup("training", "")
    after = lm.trained(rows, made, 7000).weights.flat()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("training")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == lm.ROUNDS
    assert np.isfinite(after).all() and not np.array_equal(before, after)


def test_members_against_single_softmaxes():
    """Each wanted class from a softmax over blocks and one in its block, done one by one."""
    w, table = random_model(blocks=4, members=3)[0], np.log(np.random.default_rng(1).dirichlet(np.ones(12), 12))
    model = Model(w, table)
    given, wanted, _ = windows([np.array([3, 1, 4, 1, 0, 2, 6, 11, 10]), np.array([2, 8])], 5, 4)
    flat, got = model.attended(given)[0], model.log_probabilities(given, wanted)
    for place, (x, y) in enumerate(zip(given[:, 4:].ravel(), wanted.ravel())):
        if y >= 0:
            after = np.exp(table[x]).reshape(4, 3)
            block = after.sum(axis=1) * np.exp(flat[place] @ w.to_block)
            inside = after[y // 3] * np.exp(flat[place] @ w.to_member[y // 3])
            assert got.ravel()[place] == pytest.approx(np.log(block[y // 3] / block.sum() * inside[y % 3] / inside.sum()), rel=1e-4)
        else:
            assert got.ravel()[place] == 0


def test_classes_start_no_workers_of_another_kind(spark, monkeypatch):
    """Classes go to Spark as Arrow tables: rows made by Python tasks leave a second set of workers in each executor."""
    rows = spark.createDataFrame([(1, 0, 7), (0, 1, 5), (lm.END, 1, 2), (1, lm.END, 2)], "before int, id int, n bigint").localCheckpoint()

    def refused(*_, **__):
        raise AssertionError("rows made by Python tasks")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    made = lm.classes_of(rows, head=4, groups=2, blocks=3)
    assert len({made.classes[0], made.classes[1], made.end}) == 3
    assert np.isfinite(made.table[np.ix_(made.classes[[0, 1]], made.classes[[0, 1]])]).all()


def test_vocabulary_is_freed_before_training_and_scoring(spark, monkeypatch):
    """Each task's function is run here, in a process that has encoded words before."""
    rng = np.random.default_rng(6)
    texts = [(i, False, bytearray(rng.integers(0, 50, 40).astype(np.uint16).tobytes())) for i in range(6)]
    rows = spark.createDataFrame(texts, "row bigint, held_out boolean, ids binary").localCheckpoint()
    frame = rows.toPandas()
    made = lm.classes_of(lm.pair_counts(rows), head=20, groups=4, blocks=5)
    held = []

    def here(df, run, *_, **__):
        lm.subwords_of(lm.read_ranks())
        list(run(iter([frame])))
        held.append(len(lm._subwords))
        raise InterruptedError

    monkeypatch.setattr(lm.TaskContext, "get", classmethod(lambda _: type("Task", (), {"partitionId": lambda _: 0})()))
    monkeypatch.setattr(type(rows), "mapInPandas", here)
    for work in (lambda: lm.trained(rows, made, 240), lambda: lm.scored(rows.withColumn("words", rows.row).withColumn("times", rows.row), made)):
        with pytest.raises(InterruptedError):
            work()
    assert held == [0, 0]


def test_sums_by_class():
    rng = np.random.default_rng(9)
    for n, most in ((1, 1), (8, 1), (300, 5), (300, 40)):
        classes = rng.integers(0, most, (n, 1))
        rows = np.vstack([rng.standard_normal((n, 6)), np.zeros((1, 6))])
        expected = np.zeros((41, 6))
        np.add.at(expected, classes.ravel(), rows[:-1])
        assert _summed(classes, rows, 41) == pytest.approx(expected, abs=1e-4)


def test_batches_of_other_sizes_in_turn():
    """A batch's gradient does not depend on the batch before."""
    w, table = random_model()
    given, wanted, _ = windows([np.array([3, 1, 4, 1, 0, 2, 6]), np.array([2, 8])], 5, 4)
    model = Model(w, table)
    model.gradient(given[:2], wanted[:2])
    model.gradient(given[::-1], wanted[::-1])
    again, alone = model.gradient(given, wanted)[0], Model(w, table).gradient(given, wanted)[0]
    assert np.array_equal(again.flat(), alone.flat())
