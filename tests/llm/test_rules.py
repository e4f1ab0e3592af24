import itertools
import random
import re
from collections import Counter

import numpy as np

from tabscope.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside),
            n < 10 or 100 * len(inside) > 20 * n)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = rules.judged(df, rules.sampled(df), rules.BASE).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute(t)[:5], True) if brute(t)[5] else (i, *brute(t)[:5]) for i, t in rows)
    have = Counter((r.doc_id, *[r[m] for m in rules.BASE], True) if brute(dict(rows)[r.doc_id])[5] and not r.kept
                   else (r.doc_id, *[r[m] for m in rules.BASE]) for r in got)
    assert want == have
    return {r.doc_id: r.kept for r in got}


def test_odd_rows(spark):
    good = "Alle meine Wörter sind hier ganz verschieden, und es gibt über zehn davon. 漢字"
    kept = check(spark, [(1, good), (1, good), (2, None), (3, ""), (4, "\x0b \n\r\n"), (None, "x"), (5, "a b c d e a b c d e f g"),
                         (6, "### " * 30), (7, "word " * 30000), (8, "A\nB\nA\n \n \nA b"), (9, "a\x85b c d\x1ce")])
    assert kept[1] and not kept[6] and not kept[7] and not kept[2]
    check(spark, [])


def test_random_texts(spark):
    random.seed(4)
    check(spark, [(i, "".join(random.choice("ab \n#é") for _ in range(random.randint(0, 90)))) for i in range(400)])


def test_order_changes_nothing(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = rules.run_rules(rules.Batch(texts), rules.RULES) >= 0
    for some in itertools.islice(itertools.permutations(rules.RULES), 0, 40000, 4001):
        assert ((rules.run_rules(rules.Batch(texts), some) >= 0) == want).all()


def test_cheap_rejecting_rule_first():
    texts = ["x " * 3000] * 50
    cheap = rules.Rule("cheap", ("n_words",), lambda n: n > 0)
    idle = rules.Rule("idle", ("n_words", "n_repeat_words", "n_same_again"), lambda n, a, b: n < 0)
    assert rules.ordered((idle, cheap), texts)[0] is cheap


def test_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = rules.op7_rules(spark, folder)
    assert got.columns == ["doc_id", *rules.BASE, "base_failed", "kept"]
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality]) > 0.99
    assert np.mean([r.kept for r in rows if not r.quality]) < 0.1
