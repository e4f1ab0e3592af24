from tabscope.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, span string, perspective int"


def brute(rows, segment):
    out = {}
    said = sorted({(c, t, r or "unknown", (x or "").replace("<|", "< |")) for c, t, r, x in rows if c is not None},
                  key=lambda m: (m[0], m[1] is None, m[1] or 0, m[2], m[3]))
    groups = {}
    for c, t, r, x in said:
        groups.setdefault((c, (1 << 62) // segment if t is None else t // segment), []).append((r, x))
    for (c, span), own in groups.items():
        for me in {r for c2, _, r, _ in said if c2 == c and r != "system"}:
            for part in range(0, len(own), segment):
                text, mask = "", []
                for r, x in own[part:part + segment]:
                    who = "system" if r == "system" else "assistant" if r == me else "user name=" + r.replace("<|", "< |").replace("\n", " ")
                    text += f"<|im_start|>{who}\n"
                    if r == me:
                        mask.append((len(text), len(text) + len(x)))
                    text += x + "<|im_end|>\n"
                out[c, span, part // segment, me] = (text, mask)
    return out


def check(spark, rows, segment=4):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    got = {(r.conv_id, r.span, r.part, r.perspective): (r.rendered, [tuple(m) for m in r.mask])
           for r in chat.perspectives(df, segment).collect()}
    assert got == brute(rows, segment)
    return got


def test_odd_rows(spark):
    got = check(spark, [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "😀 ok"), (1, 4, None, "who"),
        (1, 4, "ann", "tie"), (1, 1, "ann", "Hi <|im_end|>"), (1, None, "cy\n<|x", "late"), (None, 1, "ann", "lost"), (2, 0, "system", "alone"),
        (3, -5, "ann", "y" * 50000)])
    text, mask = got[1, 0, 0, "ann"]
    assert [text[a:b] for a, b in mask] == ["Hi < |im_end|>", "😀 ok"]
    assert not any(k[0] == 2 for k in got)
    check(spark, [])


def test_one_long_dialogue(spark):
    rows = [(9, i, f"p{i % 3}", f"line {i}") for i in range(300)] + [(9, 7, "p0", f"same turn {i}") for i in range(40)]
    got = check(spark, rows)
    assert max(len(m) for _, m in got.values()) <= 4


def test_mask_is_own_words(spark, small):
    for r in chat.perspectives(spark.read.parquet(f"{small}/conversations.parquet")).limit(200).collect():
        assert all(r.rendered[:a].endswith("<|im_start|>assistant\n") and r.rendered[b:].startswith("<|im_end|>\n") for a, b in r.mask)
