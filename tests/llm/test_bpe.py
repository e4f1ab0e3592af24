import hashlib
import random

import pytest
from tokenizers import Tokenizer

from tabscope.llm import bpe

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def description():
    return bpe.read_vocabulary()


def test_against_library(library, description):
    known = bpe.Vocabulary(description)
    letters = " \n\t\x1c\x85'sdtrelabEé1٣　​漢😀½²"
    random.seed(5)
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(3000)]
    texts += [t[:4] + "<|endoftext|>" + t[4:] for t in texts[:200]] + ["a" * 5000, "ab" * 3000, "é漢" * 800]
    for text in texts:
        ids = [i for e in known.encode(text) for i in e[0]]
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert known.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_forgetting_words(library, description, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 3)
    known = bpe.Vocabulary(description)
    text = "one two three four five one two six seven"
    assert [i for e in known.encode(text) for i in e[0]] == library.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, library, description):
    rows = [(1, "Hello there", 9), (2, None, None), (3, ""), (None, "x " * 40000), (1, "Hello there", 9)]
    df = spark.createDataFrame([(*r, None)[:3] for r in rows], "doc_id long, text string, n_tokens long")
    got = bpe.digests(df, description).collect()
    assert len(got) == 5
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), description).count() == 0


def test_round_trip(spark, small, description):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    back = bpe.decode(bpe.encode(docs, description).drop("decoded"), description).collect()
    assert all(r.decoded == r.text for r in back)
    assert bpe.encode(docs, description, decoded=True).where("decoded <> text").count() == 0


def test_query(spark, small):
    got = bpe.op5_bpe(spark, small)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count()
