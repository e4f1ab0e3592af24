"""Personal data found by weak supervision, in DataFrame expressions only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers; those spans
always stay. Candidates for more (digit groups that no pattern took, their parts, names, and keys) are judged by
labelers that vote for, against or not at all: shapes, checksums, gazetteers, context words
and surroundings. Expectation-maximisation over the counted vote patterns estimates how
reliable each labeler is, and a logistic span classifier is trained on the outcome; what it
accepts is added.

Votes are counted over all documents; only the table of distinct patterns, bounded by the
number of labelers and kinds, reaches the driver. Null and empty texts have no spans; offsets
are code points. Repeated rows are treated alike, other columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm import common

#: Fixed patterns. Possessive repeats and the look-behinds match the same spans as plain
#: repeats would, in time linear in the text and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Parts of a digit run: a group of 7 to 19 digits, or neighbouring groups in a known layout. Of a
#: layout only the first group is matched, so that overlapping ones are all found; all have the same length.
PARTS = (
    (r"(?<![0-9])[0-9]{7,19}(?![0-9])", None),
    (r"(?<![0-9])[0-9]{4}(?=(?:[\x20-][0-9]{4}){3}(?![0-9]))", 19),
    (r"(?<![0-9])[0-9]{3}(?=[\x20-][0-9]{3}[\x20-][0-9]{4}(?![0-9]))", 12),
    (r"(?<![0-9])[0-9]{3}(?=-[0-9]{2}-[0-9]{4}(?![0-9]))", 11),
)
BYTE_VALUE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FIRST_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth "
    "Barbara Susan Jessica Sarah Karen Anna Maria Jose Juan Carlos Luis Pedro Ana Carmen Laura Hans Peter Klaus "
    "Stefan Andreas Monika Sabine Ursula Jean Pierre Michel Marie Sophie Claire Ahmed Mohammed Fatima Wei Yuki").split()
NAME = rf"\b(?:{'|'.join(FIRST_NAMES)})\x20[A-Z][\p{{L}}'-]++"
#: Runs that may be keys or tokens: long, and of letters as well as digits.
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"
#: What such keys look like: hexadecimal digests, and well-known beginnings.
KEY_SHAPE = r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|rk|gh[pousr]|xox[abprs]|AKIA|ASIA|AIza|glpat|eyJ)[A-Za-z0-9_+/=-]{12,})$"
FOR_WORDS = r"(?i)\b(?:token|secret|password|passwd|api|key|credential|call|phone|tel|telephone|mobile|fax|contact|card|visa|mastercard|amex|credit|ssn|social|account|iban|name|mr|mrs|ms|dr|dear|signed|patient|customer|telefon|karte|konto|appelez|carte|compte|llame|tarjeta|cuenta)\b[^\n]{0,12}$"
AGAINST_WORDS = r"(?i)(?:\b(?:isbn|version|page|pages|section|chapter|figure|order|invoice|build|release|sha|hash|commit|line|no|nr)\b[^\n]{0,4}|[#$€£=/])$"
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)"
LABELERS = ("shape", "checksum", "gazetteer", "context_for", "context_against", "surroundings")


SPANS = "array<struct<start:int,end:int,value:string>>"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step, kind: str) -> Column:
    """The state after each value, starting from ``start``; states are of type ``kind``.

    An array grows by being copied, so states are gathered in chunks of about the square
    root of their number, which keeps the copying far below the square of it.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(state, v):
        return bound(step(state.now, v), lambda now: F.struct(now.alias("now"), F.concat(state.seen, F.array(now)).alias("seen")))

    def gathered(given):
        def chunk(state, k):
            part = F.aggregate(F.slice(given["values"], k * given.width + 1, given.width), F.struct(state.now.alias("now"), none.alias("seen")), one)
            return bound(part, lambda p: F.struct(p.now.alias("now"), F.concat(state.chunks, F.array(p.seen)).alias("chunks")))

        begun = F.struct(start.alias("now"), F.array().cast(f"array<array<{kind}>>").alias("chunks"))
        chunks = F.sequence(F.lit(0), F.floor((F.size(given["values"]) - 1) / given.width).cast("int"))
        return F.when(F.size(given["values"]) == 0, none).otherwise(F.flatten(F.aggregate(chunks, begun, chunk).chunks))

    sized = lambda v: F.struct(v.alias("values"), F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int").alias("width"))
    return bound(values, lambda v: bound(sized(v), gathered))


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches. Between matches lie the pieces of a
    split by the same pattern, so the running lengths of both give the places."""
    def placed(values):
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.length(v) + g)
        ends = running(sizes, F.lit(0), lambda at, n: at + n, "int")
        spans = F.zip_with(values, ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.when(F.size(values) == 0, F.array().cast(SPANS)).otherwise(spans)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a number of 12 to 19 digits passes the checksum; false for other lengths."""
    d = digits(value)

    def add(total, i):
        digit = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.when(F.length(d).between(12, 19), F.aggregate(
        F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s.start.alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else len(KINDS)).alias("rank"),
        s.end.alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))


def base_columns(docs: DataFrame) -> DataFrame:
    """Adds ``_text``, ``_base`` (all base spans in order) and ``_runs`` (digit groups)."""
    none = F.array().cast(SPANS)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.withColumn("_text", text)
    df = df.withColumn("_runs", F.filter(found(F.col("_text"), PATTERNS["card"]), lambda s: F.length(s["value"]) >= 7))
    df = df.withColumn("_email", F.when(F.contains("_text", F.lit("@")), found(F.col("_text"), PATTERNS["email"])).otherwise(none))
    df = df.withColumn("_phone", F.filter(
        F.when(F.contains("_text", F.lit("+")), found(F.col("_text"), PATTERNS["phone"])).otherwise(none),
        lambda s: F.length(digits(s["value"])).between(9, 15)))
    df = df.withColumn("_ip", F.filter(
        found(F.col("_text"), PATTERNS["ip"]), lambda s: F.regexp_like(s["value"], F.lit(rf"^{BYTE_VALUE}(?:\.{BYTE_VALUE}){{3}}$"))))
    base = F.concat(tagged(F.col("_email"), "email"), tagged(F.col("_ip"), "ip"),
                    tagged(F.filter("_runs", lambda s: luhn(s["value"])), "card"), tagged(F.col("_phone"), "phone"))
    return df.withColumn("_base", F.array_sort(base)).drop("_email", "_phone", "_ip")


def parts(runs: Column) -> Column:
    """Groups of digits, and neighbouring groups in a known layout, wherever they are in a run."""
    def inside(run, pattern, length):
        def placed(s):
            n = s.end - s.start if length is None else F.lit(length)
            return F.struct((run.start + s.start).alias("start"), (run.start + s.start + n).alias("end"),
                            F.substring(run["value"], s.start + 1, n).alias("value"))

        return F.transform(found(run["value"], pattern), placed)

    return F.flatten(F.transform(runs, lambda r: F.concat(*[inside(r, *p) for p in PARTS])))


def candidates(df: DataFrame) -> DataFrame:
    """Adds ``_more``: spans outside the base ones that might be personal data, and
    ``_judged``: base spans and those, each with its labelers' votes. Of a digit run that is
    no base span the whole is a candidate, if of 7 to 19 digits, and so are its parts."""
    taken = lambda s: F.exists("_base", lambda b: (b.start < s.end) & (s.start < b.end))
    is_ssn = lambda s: F.regexp_like(s["value"], F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    whole = F.filter("_runs", lambda s: F.length(digits(s["value"])).between(7, 19))
    df = df.withColumn("_any", F.array_sort(F.concat(whole, parts(F.col("_runs")))))
    # Equal spans are neighbours once sorted.
    new = lambda s, i: (i == 0) | (s != F.get("_any", i - 1))
    df = df.withColumn("_free", F.filter(F.filter("_any", new), lambda s: ~taken(s))).drop("_any")
    more = F.concat(
        tagged(F.filter("_free", is_ssn), "ssn"), tagged(F.filter("_free", lambda s: ~is_ssn(s)), "number"),
        tagged(F.filter(found(F.col("_text"), NAME), lambda s: ~taken(s)), "name"),
        tagged(F.filter(found(F.col("_text"), SECRET), lambda s: F.regexp_like(s["value"], F.lit("[0-9]")) & F.regexp_like(
            s["value"], F.lit("[A-Za-z]")) & ~taken(s)), "secret"))
    df = df.withColumn("_more", F.array_sort(more)).drop("_free")
    df = df.withColumn("_spans", F.concat("_base", "_more"))
    # Far into a text, its pieces are found at once, where a substring would be counted out.
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn("_pieces", F.when(F.size("_spans") > 0, pieces))
    beside = F.transform("_spans", lambda s: F.struct(s.alias("span"), *surroundings(F.col("_pieces"), s)))
    return df.withColumn("_judged", F.transform(beside, votes)).drop("_pieces", "_spans")


PIECE = 256


def surroundings(pieces: Column, s: Column) -> tuple[Column, Column]:
    """Up to 40 characters before a span, and the one after it."""
    piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
    k = F.floor(s.start / PIECE).cast("int")
    at = F.when(k > 0, s.start - (k - 1) * PIECE).otherwise(s.start)
    before = F.substring(F.concat(piece(k - 1), piece(k)), F.greatest(at - 39, F.lit(1)), F.least(at, F.lit(40)))
    after = F.substring(piece(F.floor(s.end / PIECE).cast("int")), s.end % PIECE + 1, F.lit(1))
    return before.alias("before"), after.alias("after")


def votes(beside: Column) -> Column:
    s, before, after = beside["span"], beside["before"], beside["after"]
    last = F.right(before, F.lit(1))
    value, kind, n = s["value"], s.kind, F.length(digits(s["value"]))
    shape = F.when(kind.isin("email", "ip", "phone", "ssn"), 1).when(
        kind == "secret", F.when(F.regexp_like(value, F.lit(KEY_SHAPE)), 1).otherwise(-1)).when(
        F.regexp_like(value, F.lit(r"^(?:[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{3}-[0-9]{3}-[0-9]{4})$")), 1).when(
        kind == "number", -1).otherwise(0)
    checksum = F.when(kind.isin("card", "number") & n.between(12, 19), F.when(luhn(value), 1).otherwise(-1)).otherwise(0)
    gazetteer = F.when(kind == "name", 1).when((kind == "card") | ((kind == "number") & n.between(12, 19)),
                                               F.when(F.regexp_like(digits(value), F.lit(CARD_STARTS)), 1).otherwise(-1)).otherwise(0)
    loose = F.regexp_like(last, F.lit(r"^[\p{L}_.]$")) | F.regexp_like(after, F.lit(r"^[\p{L}_]$"))
    return F.struct(
        s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), kind.alias("kind"),
        F.struct(*[v.cast("int").alias(name) for name, v in zip(LABELERS, (
            shape, checksum, gazetteer, F.when(F.regexp_like(before, F.lit(FOR_WORDS)), 1).otherwise(0),
            F.when(F.regexp_like(before, F.lit(AGAINST_WORDS)), -1).otherwise(0), F.when(loose, -1).otherwise(0)))]).alias("votes"))


Pattern = tuple[str, tuple[int, ...]]


def reliabilities(counts: dict[Pattern, int], rounds: int = 50) -> dict[Pattern, float]:
    """EM over vote patterns: the probability that a span with these votes is personal data.

    Each labeler has its own chances to vote -1, 0 or 1, given either truth; labelers are
    independent given the truth. The start is the share of positive votes.
    """
    belief = {p: (1 + sum(v > 0 for v in p[1])) / (2 + sum(v != 0 for v in p[1])) for p in counts}
    for _ in range(rounds):
        share = {1: 1.0, 0: 1.0}
        chances = {y: [{v: 1.0 for v in (-1, 0, 1)} for _ in LABELERS] for y in (0, 1)}
        for p, n in counts.items():
            for y, weight in ((1, n * belief[p]), (0, n * (1 - belief[p]))):
                share[y] += weight
                for table, v in zip(chances[y], p[1]):
                    table[v] += weight
        new = {}
        for p in counts:
            odds = math.log(share[1] / share[0])
            for k, v in enumerate(p[1]):
                odds += math.log(chances[1][k][v] / (share[1] + 2)) - math.log(chances[0][k][v] / (share[0] + 2))
            new[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        moved = max((abs(new[p] - belief[p]) for p in counts), default=0.0)
        belief = new
        if moved < 1e-6:
            break
    return belief


@dataclass
class SpanClassifier:
    """Logistic in the votes and the kind."""

    bias: float
    votes: list[dict[int, float]]
    kinds: dict[str, float]

    def linear(self, kind: Column, cast: Column) -> Column:
        total = F.lit(self.bias)
        for name, weight in sorted(self.kinds.items()):
            total = total + F.when(kind == name, F.lit(weight)).otherwise(F.lit(0.0))
        for name, table in zip(LABELERS, self.votes):
            for v, weight in sorted(table.items()):
                total = total + F.when(cast[name] == v, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def value(self, p: Pattern) -> float:
        return self.bias + self.kinds.get(p[0], 0.0) + sum(t.get(v, 0.0) for t, v in zip(self.votes, p[1]))


def train(counts: dict[Pattern, int], belief: dict[Pattern, float], steps: int = 300, ridge: float = 1e-3) -> SpanClassifier:
    """Logistic regression on the beliefs, weighted by how often a pattern occurs."""
    model = SpanClassifier(0.0, [{-1: 0.0, 1: 0.0} for _ in LABELERS], {p[0]: 0.0 for p in counts})
    total = sum(counts.values()) or 1
    rate = 4.0 / (2 + len(LABELERS))
    for _ in range(steps):
        bias, slopes, kinds = 0.0, [{-1: 0.0, 1: 0.0} for _ in LABELERS], dict.fromkeys(model.kinds, 0.0)
        for p, n in sorted(counts.items()):
            error = n / total * (1 / (1 + math.exp(-max(-50.0, min(50.0, model.value(p))))) - belief[p])
            bias += error
            kinds[p[0]] += error
            for table, v in zip(slopes, p[1]):
                if v:
                    table[v] += error
        model.bias -= rate * bias
        for kind, slope in kinds.items():
            model.kinds[kind] -= rate * (slope + ridge * model.kinds[kind])
        for table, slope in zip(model.votes, slopes):
            for v in table:
                table[v] -= rate * (slope[v] + ridge * table[v])
    return model


def pattern_counts(judged: DataFrame) -> dict[Pattern, int]:
    """How often each kind and set of votes occurs in all documents; at most 3 ** labelers a kind."""
    spans = judged.select(F.explode("_judged").alias("s")).groupBy("s.kind", "s.votes").count().collect()
    return {(r.kind, tuple(r.votes[name] for name in LABELERS)): r["count"] for r in spans}


def classifier(judged: DataFrame) -> SpanClassifier:
    counts = pattern_counts(judged)
    return train(counts, reliabilities(counts))


def accepted(model: SpanClassifier) -> Column:
    """All spans of a row, the base ones and those the classifier adds, in order. Of added
    spans within another added one only the longest stays."""
    more = F.transform(F.filter("_judged", lambda s: (s["rank"] == len(KINDS)) & (model.linear(s.kind, s.votes) >= 0)), _place)
    inner = lambda s: F.exists(more, lambda o: (o.start <= s.start) & (s.end <= o.end) & (o.end - o.start > s.end - s.start))
    return F.array_sort(F.concat(
        F.transform(F.filter("_judged", lambda s: s["rank"] < len(KINDS)), _place), F.filter(more, lambda s: ~inner(s))))


def _place(s: Column) -> Column:
    return F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.end.alias("end"), s.kind.alias("kind"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def judged_spans(docs: DataFrame) -> DataFrame:
    return candidates(base_columns(docs))


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets and ``n_chars`` recounted.

    The rows are packed while spans are found, so no column of theirs is in the way. Rows with
    spans are staged with them, which both the classifier and the cutting read; all others, most
    by far, are passed on as they are."""
    spanned = judged_spans(docs.select(F.struct("*").alias("_row"), "text"))
    any_span = F.size("_base") + F.size("_more") > 0
    judged = common.staged(spanned.where(any_span).select("_row", "_judged"), "pii-judged")
    model = classifier(judged)
    text = F.coalesce(F.col("_row.text"), F.lit(""))
    spans = accepted(model)
    # How far the spans before each one reach; one that begins within them is gone with them.
    reach = running(F.transform("_spans", lambda s: s.end), F.lit(0), lambda at, end: F.greatest(at, end), "int")
    before = F.concat(F.array(F.lit(0)), F.col("_reach"))
    pieces = F.zip_with(F.col("_spans"), F.slice(before, 1, F.size("_spans")), lambda s, at: F.when(s.start >= at, F.concat(
        F.substring(text, at + 1, s.start - at), F.lit("["), F.upper(s.kind), F.lit("]"))).otherwise(F.lit("")))
    cut = judged.withColumn("_spans", spans).withColumn("_reach", reach)
    rest = F.substring(text, F.element_at(before, -1) + 1, F.length(text))
    cut = cut.withColumn("_masked", F.when(F.size("_spans") == 0, F.col("_row.text")).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    out = {c: F.col("_row")[c] for c in docs.columns}
    out["text"] = F.col("_masked")
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.size("_spans") == 0, F.col("_row.n_chars")).otherwise(F.length("_masked").cast(docs.schema["n_chars"].dataType))
    changed = cut.select(*[c.alias(n) for n, c in out.items()])
    return spanned.where(~any_span).select("_row.*").unionByName(changed)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    judged = common.staged(judged_spans(docs).select("doc_id", "_judged"), "pii-candidates")
    base = F.filter("_judged", lambda s: s["rank"] < len(KINDS))
    count = lambda kind: F.size(F.filter("_judged", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return judged.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(accepted(classifier(judged))).alias("spans"))
