import datetime

import pytest
from helpers import rows_of, texts
from pyspark.sql import functions as F

from tabscope.functions import coerce
from tabscope.operators import profile as P


@pytest.mark.parametrize("text, number", [
    ("($500.00)", -500.0), ("$250.00", 250.0), ("($75.50)", -75.5), ("$900", 900.0), ("25%", 25.0), ("(5)%", -5.0),
    ("1,234,567.89", 1234567.89), ("1234,567", 1234567.0), ("12 500", 12500.0), ("1 234", 1234.0),
    ("5 kg", 5.0), ("3 hrs.", 3.0), ("100 USD", 100.0), ("+7", 7.0), ("-$1,200", -1200.0), ("−5", -5.0),
    ("1e5", 100000.0), (".5", 0.5), ("€ 1,000", 1000.0),
    ("12d", None), ("NaN", None), ("abc", None), ("12-5", None), ("1,23", None), ("(-5)", None), ("(5%)", None),
    ("2024-01-05", None), ("", None), ("$", None), ("USD 100", None), ("1 234,567", None),
])
def test_number(spark, text, number):
    got = texts(spark, text).select(coerce.to_number(coerce.trimmed(F.col("v")))).first()[0]
    assert got == number


def test_booleans_and_blanks(spark):
    df = texts(spark, "Yes", "OFF", " t ", "maybe", "a  b", "　x\x1f", "N/A")
    got = rows_of(df.select(coerce.to_boolean(F.col("v")), coerce.without_placeholders(coerce.squeezed(F.col("v")))))
    assert got == [(True, "Yes"), (False, "OFF"), (True, "t"), (None, "maybe"), (None, "a b"), (None, "x"), (None, None)]


def test_reader_tokens_are_literal():
    tokens = coerce.reader_null_tokens()
    assert {"N/A", "n/a", "Null", "NULL", "#DIV/0!", "Unknown", ""} <= set(tokens)
    assert "nAn" not in tokens and " NA" not in tokens


def parsed_dates(spark, values):
    df = texts(spark, *values)
    layouts, rows, sane = P.text_evidence(df, {"v": F.col("v")})["v"].layouts()
    return layouts, rows, [r[0] for r in df.select(coerce.to_datetime(F.col("v"), layouts)).collect()]


def test_mixed_dates_follow_the_layout_covering_the_rest(spark):
    rest = ["05/29/2024", "03/06/2024", "09/25/2024"]
    few, many = [f"2024-0{i}-15" for i in range(1, 9)], [f"2024-01-{i:02d}" for i in range(1, 15)]
    layouts, rows, got = parsed_dates(spark, many + rest)
    assert rows == 17 and None not in got and layouts == ["%Y-%m-%d", "%m/%d/%Y"]
    assert got[15] == datetime.datetime(2024, 3, 6)
    # Below 80 % there is no main layout, and month comes first.
    _, rows, got = parsed_dates(spark, few + rest)
    assert rows == 11 and got[9] == datetime.datetime(2024, 3, 6)


def test_pure_tie_goes_to_day_first(spark):
    layouts, _, got = parsed_dates(spark, ["03/06/2024", "04/07/2024"])
    assert layouts[0] == "%d/%m/%Y" and got[0] == datetime.datetime(2024, 6, 3)


def test_no_main_layout_accepts_any(spark):
    values = ["2024-01-05", "02/14/2024", "Jan 5, 2024", "5 Feb 2024", "2024/03/01", "2024-01-05T10:00:00.5"]
    _, rows, got = parsed_dates(spark, values)
    assert rows == 6 and got[1] == datetime.datetime(2024, 2, 14)
    assert got[5] == datetime.datetime(2024, 1, 5, 10, 0, 0, 500000)


def test_two_digit_years_pivot_at_69(spark):
    got = rows_of(texts(spark, "1/5/84", "1/5/24").select(coerce.parse_layout(F.col("v"), "%m/%d/%y")))
    assert got == [(datetime.datetime(1984, 1, 5),), (datetime.datetime(2024, 1, 5),)]


def test_digest_key_keeps_long_texts_apart(spark):
    long = "word " * 200
    df = texts(spark, long + "a", long + "b", long + "a", "short", "short ")
    e = P.text_evidence(df, {"v": F.col("v")})["v"]
    assert (e.count, e.unique, e.changed) == (5, 3, 1)
    assert e.mean_words == pytest.approx((201 * 3 + 2) / 5)


def test_quick_forms_equal_the_patterns(spark):
    blanks = [" ", "  ", "\t", "\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　"]
    values = ["", "a", "a b", "é b", *[f"{x}a{y}b{z}" for x in ["", *blanks] for y in blanks for z in ["", " ", " "]],
              "5 kg", "+5", "(1,234.5)", "$(1,200)", "-1,5%", "5%\n$", "1 234 kg", "−3", "12 345", "+1,000 km.", "x%", "\u0085", " 　 "]
    df = texts(spark, *values)
    v = F.col("v")
    plain = F.regexp_replace(coerce.trimmed(v), coerce._BLANK_RUN, " ")
    steps = F.translate(coerce.trimmed(v), coerce.CURRENCY_SYMBOLS, "")
    for pattern, by in (("%$", ""), (coerce._COMMA_GROUP, ""), (coerce._SPACE_GROUP, ""), (coerce._PARENTHESISED, "-$1"), (coerce._UNIT, "")):
        steps = F.regexp_replace(steps, pattern, by)
    steps = coerce.trimmed(F.regexp_replace(F.translate(steps, "−", "-"), r"^\+", ""))
    odd = df.where(~coerce.squeezed(v).eqNullSafe(plain) | ~coerce.quickly_trimmed(v).eqNullSafe(coerce.trimmed(v))
                   | (coerce.has_odd_blanks(v) != v.rlike(coerce._ODD_BLANKS)) | ~coerce.number_text(v).eqNullSafe(steps))
    assert rows_of(odd) == []


def test_parsing_stays_out_of_the_loop_over_rows(spark):
    from tabscope.operators import clean, profile

    df = texts(spark, "1", name="v")
    for c in (profile.parsed_column(F.col("v"), "numeric", {}), clean.normalized(df, "v"), coerce.layout_bits("v")):
        assert "transform(array(" in df.select(c)._jdf.queryExecution().optimizedPlan().toString()
