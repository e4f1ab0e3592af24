import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np

from tabscope.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text):
    words = WORD.findall(text)
    return {f for f, bad in zip("ABCD", (
        len(words) < 50, 100 * len(set(words)) < 65 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 5 * len(text), re.search(r"[#$%&*|]", text))) if bad}


def brute(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    rows = defaultdict(list)
    for d, text, source in docs:
        bad = fails(text or "") | ({"E"} if d is not None and d > least[text or ""] else set())
        rows[source or ""].append((bad, d in good, d in toxic))
    out, total = [], Counter()
    for part, members in rows.items():
        for order in itertools.permutations("ABCDE"):
            left = members
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                total[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), sum(f in m[0] for m in members) - len(gone),
                            sum(m[0] == {f} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone), f])
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


def check(spark, docs, labels):
    table = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, source string, part string, n int").repartition(3)
    marks = spark.createDataFrame([(*r, "y") for r in labels], "doc_id long, quality int, toxic int, text string")
    got = audit.audited(table, marks)
    assert got.columns == [c.split()[0] for c in audit.RESULT.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, labels)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 900}" for i in range(300_000))
    docs = [(1, "a b", "s"), (1, "a b", "s"), (2, "a b", "t"), (None, "a b", "t"), (None, "a b", None), (3, None, ""), (4, "", None),
            (4, None, "s"), (5, long, "s"), (6, long, "s"), (7, "A#", "q"), (7, "é" * 30 + " A", "q"), (None, "only without id", "q"),
            (None, "only without id", "r"), (-5, "a b", "u"), (-5, "a b", "s"), (8, "\x0b\x85 \x1c", "s")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1), (4, 0, 0)]
    check(spark, docs, labels)


def test_empty_tables(spark):
    check(spark, [], [])
    check(spark, [(1, "a", "s")], [])


def test_random(spark):
    random.seed(9)
    words = ["alpha", "Beta", "GAMMA", "d|d", "e", "f", "$5"]
    texts = ["\n".join(random.choices(words[: random.randint(1, 7)], k=random.choice((3, 60, 80)))) for _ in range(25)]
    texts += [" ".join(f"u{random.random()}" for _ in range(60)) for _ in range(15)]
    docs = [(random.randint(0, 150), random.choice(texts), random.choice(("a", "b", None, "c"))) for _ in range(300)]
    labels = [(i, random.randint(0, 1), random.randint(0, 1)) for i in range(0, 150, 2)]
    check(spark, docs, labels)


def test_contraction_is_a_sum_over_cells():
    rng = np.random.default_rng(1)
    tensor = rng.integers(0, 9, (2, 2, 2, 2, 2, 2))
    orders, taken = audit.selectors()
    got = audit.contracted(tensor, taken["removed"])
    i, k = orders.index("CAEBD"), 2
    assert got[1, i, k] == tensor[1, 0, :, 0, :, 1].sum()
