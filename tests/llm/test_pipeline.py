"""Each stage on what the one before kept, against a plainer way to the same rows."""

import hashlib
import math
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from test_jaccard import brute as groups_of  # noqa: E402
from test_pii import brute as spans_of  # noqa: E402

from tabscope.llm import mixing, quality  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage, and the input."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        out.append(docs)
    return out


def test_columns(kept):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == kept[0].columns for df in kept[:5])
    assert kept[5].columns == ["doc_id", "source", "slot", "place", "in_mix", "ids", "decoded_sha256"]


def test_rejects_go(spark, kept):
    scores = quality.scored(kept[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in scores.where("score >= 0.5").collect()}
    assert {r.doc_id for r in kept[1].collect()} == want


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    want = {component for (_, n, component) in groups_of(rows) if n} | {i for (i, n, _) in groups_of(rows) if not n}
    assert Counter(r.doc_id for r in kept[2].collect()) == Counter(want)


def test_personal_data_are_masked(kept):
    before = {r.doc_id: r.text for r in kept[2].collect()}
    after = {r.doc_id: r for r in kept[3].collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        spans = spans_of(text)
        assert after[i].n_chars == len(after[i].text)
        for start, _, end, kind in spans:
            assert text[start:end] not in after[i].text
        if not spans and after[i].text != text:
            assert "[" in after[i].text


def test_all_rows_are_mixed(kept):
    assert Counter(map(str, kept[3].collect())) == Counter(map(str, kept[4].collect()))


def test_ids(kept):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    got = kept[5].collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert {r.doc_id: r.ids for r in got} == {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_run(spark, kept):
    got = corpus_pipeline.run(spark, FOLDER)
    assert Counter(map(str, got.collect())) == Counter(map(str, kept[5].collect()))


def test_result_follows_the_mixture(spark, monkeypatch):
    """Every prefix of the rows has the composition that the schedule gives it, however files are packed for reading."""
    slots = {r.doc_id: r for r in mixing.mixed(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect()}
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[3:])
    confs = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = corpus_pipeline.run(spark, FOLDER).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    places = [(slots[r.doc_id].slot, slots[r.doc_id].place) for r in got]
    assert [(r.slot, r.place, r.in_mix) for r in got] == [(*p, slots[r.doc_id].in_mix) for p, r in zip(places, got)]
    assert len(places) == len(slots) and places == sorted(places)
    sizes = Counter(r.source for r in slots.values())
    weights = {s: math.ceil(n / mixing.BLOCK) ** mixing.FLATTEN for s, n in sizes.items()}
    total, done = sum(weights.values()), Counter()
    inside = [r for r in got if slots[r.doc_id].in_mix]
    assert len({r.source for r in inside}) > 1
    for i, r in enumerate(inside, 1):
        done[r.source] += 1
        assert all(abs(done[s] - i * w / total) <= 2 * mixing.BLOCK for s, w in weights.items())


def test_the_last_stage_takes_the_order_from_what_the_mixing_stage_wrote(spark, kept, tmp_path):
    """Rows written in another order get other places, so the mixture is not worked out anew."""
    rows = {r.doc_id: r for r in kept[4].collect()}
    kept[4].sort("doc_id").coalesce(1).write.parquet(str(tmp_path / "by_id"))
    got = corpus_pipeline.encode(spark, spark.read.parquet(str(tmp_path / "by_id")), FOLDER).sort("slot", "place").collect()
    assert len(got) == len(rows)
    for source in {r.source for r in rows.values()}:
        ids = [r.doc_id for r in got if r.source == source]
        assert ids == sorted(ids)
    assert [r.doc_id for r in got] != [r.doc_id for r in corpus_pipeline.encode(spark, kept[4], FOLDER).sort("slot", "place").collect()]
