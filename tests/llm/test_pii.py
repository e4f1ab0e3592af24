import hashlib
import random
import re

from tabscope.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, kind string, start int")
    judged = pii.judged_spans(df)
    got = judged.select("doc_id", "text", "_base").collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s["rank"], s.end, s.kind) for s in r["_base"]] == brute(r.text), repr(r.text)
    return judged


def test_odd_texts(spark):
    check(spark, [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c"), (None, "😀é x@y.z-1.com_q@r.st..@a.b c@d..e"), (4, "1.2.3.4.5.6.7.8 300.1.1.1 0255.0.0.01"),
                  (5, "4111 1111-1111 1111 4111--1111 411111111111111111111 5"), (6, "+1 (017) 555-7713-.( +12 +123456789012345678"),
                  (7, "a" * 60000), (8, "1 " * 30000), (9, "1" * 60000), (10, "a." * 20000 + "@"), (11, "x@" + "y." * 8000 + "z"), (12, "+" + "1 " * 20000)])


def test_random_texts(spark):
    random.seed(8)
    check(spark, [(i, "".join(random.choice("ab1.2@4+ -()9é😀") for _ in range(random.randint(0, 60)))) for i in range(2500)])


def test_em_finds_the_bad_labeler():
    random.seed(1)
    counts = {}
    for _ in range(4000):
        y = random.random() < 0.4
        v = [(1 if y else -1) if random.random() < q else (-1 if y else 1) for q in (0.95, 0.9, 0.9, 0.5, 0.5, 0.9)]
        p = ("number", tuple(v))
        counts[p] = counts.get(p, 0) + 1
    belief = pii.reliabilities(counts)
    assert belief[("number", (1, 1, 1, -1, -1, 1))] > 0.95 and belief[("number", (-1, -1, -1, 1, 1, -1))] < 0.05
    model = pii.train(counts, belief)
    assert model.value(("number", (1, 1, 1, -1, -1, 1))) > 0 > model.value(("number", (-1, -1, -1, 1, 1, -1)))
    assert pii.reliabilities({}) == {} and pii.train({}, {}).bias == 0.0


def test_more_spans_and_masking(spark):
    rows = [(i, f"call me at phone 555-123-{1000 + i} or mail a{i}@mail.org, signed James Miller", "en", 3) for i in range(40)]
    rows += [(100 + i, f"order {1000000 + i} of version {2000000 + i}x", "en", 3) for i in range(40)] + [(200, None, None, None), (201, "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    got = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert pii.masked(docs).columns == docs.columns
    assert "555-123" not in got[0].text and "@" not in got[0].text and "Miller" not in got[0].text
    assert got[0].n_chars == len(got[0].text)
    assert got[100].text == rows[40][1] and got[200].text is None and got[201].text == ""
    assert pii.masked(docs.limit(0)).count() == 0


def test_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = pii.op8_pii(spark, small).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        base = brute(texts[r.doc_id])
        said = [f"{k}:{a}:{b}" for a, _, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in base) for k in PLAIN]


def test_numbers_side_by_side(spark):
    """A run of several numbers fails as a whole; its parts are judged."""
    card = lambda i: next(c for k in range(10) if luhn(c := f"4{i:014d}{k}"))
    grouped = lambda c: " ".join(c[k:k + 4] for k in range(0, 16, 4))
    rows = [(i, f"card {card(7 * i)} and mail a{i}@mail.org, call 555-123-{1000 + i}", "en", 3) for i in range(40)]
    rows += [(100 + i, f"order {1000000 + i} of version {2000000 + i}x", "en", 3) for i in range(40)]
    a, b = card(123456789), card(987654321)
    rows += [(200, f"pay {a} {b} now", "en", 3), (201, f"pay {a}-{b} now", "en", 3), (202, f"pay {grouped(a)} {grouped(b)} now", "en", 3),
             (203, f"pay 77 {a} now", "en", 3), (204, f"pay {grouped(a)} 1234 now", "en", 3), (205, "9" * 40, "en", 3), (206, "call 555-123-4567 555-765-4321", "en", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    for i in (200, 201, 202):
        assert a not in got[i] and b not in got[i] and grouped(a) not in got[i] and grouped(b) not in got[i], got[i]
    assert a not in got[203] and grouped(a) not in got[204], (got[203], got[204])
    assert "4567" not in got[206] and "4321" not in got[206] and got[205] == "9" * 40
    more = {r.doc_id: r["_more"] for r in pii.judged_spans(docs.where("doc_id >= 200")).collect()}
    assert {s.value for s in more[200]} == {a, b} and {s.value for s in more[202]} >= {grouped(a), grouped(b)}
    assert [(s.start, s.end) for s in more[203] if s.value == a] == [(7, 23)] and not more[205]
    check(spark, [(r[0], r[1]) for r in rows])


def test_masking_leaves_no_text_in_clashing_columns(spark):
    rows = [(i, f"call 555-123-{1000 + i} or mail a{i}@mail.org", "mine", 7, "base", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, _runs int, _base string, _judged int")
    got = pii.masked(docs).collect()
    assert all((r["_text"], r["_runs"], r["_base"], r["_judged"]) == ("mine", 7, "base", 1) and "@" not in r.text for r in got)


def test_keys_are_found_by_shape_and_context(spark):
    rows = [(i, f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and mail a{i}@mail.org', "en", 3) for i in range(40)]
    rows += [(100 + i, f"see module_{i}_of_the_large_library_v{i} for more", "en", 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert all(got[i] == 'token = "[SECRET]" and mail [EMAIL]' for i in range(40))
    assert all(got[100 + i] == rows[40 + i][1] for i in range(40))


def test_many_numbers_in_one_text(spark):
    numbers = [f"{100_000_000 + 37 * i}" for i in range(5000)]
    docs = spark.createDataFrame([(1, ", ".join(numbers)), (2, "; ".join(f"a{i}@b.org" for i in range(1000)))], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.judged_spans(docs).collect()}
    assert [(s.start, s.end, s.value) for s in rows[1]["_more"]] == [(11 * i, 11 * i + 9, n) for i, n in enumerate(numbers)]
    assert len(rows[2]["_base"]) == 1000
    assert pii.masked(docs).where("doc_id = 2").first().text == "; ".join(["[EMAIL]"] * 1000)
