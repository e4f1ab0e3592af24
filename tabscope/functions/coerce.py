"""Text to typed values, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from .columns import apart
from ..vocabulary import (
    CLEANER_PLACEHOLDERS, COMPACT_DATE, CURRENCY_SYMBOLS, DATE_HINT, DATE_LAYOUTS,
    EMAIL_PATTERN, FALSE_TOKENS, READER_NULL_TOKENS, TRUE_TOKENS, UNIT_WORDS,
    UUID_PATTERN, YEAR_HINT,
)

# Every character the white-space class covers, for btrim.
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
           "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_ODD_BLANKS = f"  |[{_BLANKS.replace(' ', '')}]"
_BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
_SYMBOLS = f"[{CURRENCY_SYMBOLS}]"
_COMMA_GROUP = r"(?<=\d),(?=\d{3}(?:\D|$))"
_SPACE_GROUP = r"(?<=\d)[\s\p{IsWhite_Space}](?=\d{3}(?:\D|$))"
_PARENTHESISED = r"^\((.*)\)$"
_UNIT = rf"(?i)\s*(?:{UNIT_WORDS})\.?$"
_PLAIN_NUMBER = r"^-?\d+(?:\.\d+)?$"
_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# The usual decorated number: sign, symbol, comma groups, parentheses, percent.
_AMOUNT = r"\d{1,3}(?:,\d{3})*(?:\.\d+)?"
_TIDY_NUMBER = rf"^(?:(?:[-+]?{_SYMBOLS}?|{_SYMBOLS}[-+]){_AMOUNT}|\({_SYMBOLS}?{_AMOUNT}\))%?$"
# What any other decorated number looks like; the rest skips the clean-up chain.
# Inside it a minus only follows an exponent, which keeps dates out.
_MARKS = rf"\s\p{{IsWhite_Space}}.,()%eE{CURRENCY_SYMBOLS}"
_NUMBER_LIKE = (rf"^[{_MARKS}+\-−]*\d[\d{_MARKS}]*(?:[eE][-+−]\d+)?"
                rf"(?i:{UNIT_WORDS})?[{_MARKS}]*$")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def quickly_trimmed(c: Column) -> Column:
    """As ``trimmed``, of a column: a text between visible ASCII characters is so already."""
    visible = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(visible, c).otherwise(trimmed(c))


def has_odd_blanks(c: Column) -> Column:
    """Whether a text holds white space other than single blanks. Of ASCII texts substring
    tests tell, which are far cheaper than a pattern."""
    tests = [c.contains(b) for b in ("  ", *[b for b in _BLANKS if b.isascii() and b != " "])]
    return F.when(F.length(c) == F.octet_length(c), reduce(or_, tests)).otherwise(c.rlike(_ODD_BLANKS))


def squeezed(c: Column) -> Column:
    """Trimmed, with inner runs of white space collapsed to one blank."""
    return F.when(~has_odd_blanks(c), quickly_trimmed(c)).otherwise(F.regexp_replace(trimmed(c), _BLANK_RUN, " "))


def is_placeholder(c: Column) -> Column:
    return c.isin(*CLEANER_PLACEHOLDERS)


def without_placeholders(c: Column) -> Column:
    return F.when(~is_placeholder(c), c)


def reader_null_tokens() -> list[str]:
    """Every spelling of a missing value the reader recognises."""
    spellings = {
        form for token in READER_NULL_TOKENS
        for form in (token, token.upper(), token.title(), token.capitalize())
    }
    return sorted(spellings)


def reader_nulls(c: Column) -> Column:
    return F.when(~c.isin(*reader_null_tokens()), c)


# --- numbers ---------------------------------------------------------------


def has_currency(c: Column) -> Column:
    """Substring tests: on long text far cheaper than a pattern."""
    return reduce(or_, [c.contains(symbol) for symbol in CURRENCY_SYMBOLS])


def has_percent(c: Column) -> Column:
    return c.endswith("%")


def number_text(c: Column) -> Column:
    """Strip notation in a fixed order: symbol, %, groups, parentheses, unit, sign."""
    s = F.translate(trimmed(c), CURRENCY_SYMBOLS, "")
    s = _replaced(s, "%", "%$", "")
    s = _replaced(s, ",", _COMMA_GROUP, "")
    s = F.regexp_replace(s, _SPACE_GROUP, "")
    s = _replaced(s, "(", _PARENTHESISED, "-$1")
    s = F.regexp_replace(s, _UNIT, "")
    s = F.translate(s, "−", "-")
    return trimmed(_replaced(s, "+", r"^\+", ""))


def _replaced(c: Column, mark: str, pattern: str, by: str) -> Column:
    """A pattern replaced, tried only where the mark is that it cannot do without."""
    return apart(c, lambda s: F.when(s.contains(mark), F.regexp_replace(s, pattern, by)).otherwise(s))


def has_comma_groups(c: Column) -> Column:
    return c.contains(",") & c.rlike(_NUMBER_LIKE) & number_text_step(c, 2).rlike(_COMMA_GROUP)


def has_parentheses(c: Column) -> Column:
    return c.contains("(") & c.rlike(_NUMBER_LIKE) & number_text_step(c, 4).rlike(_PARENTHESISED)


def number_text_step(c: Column, step: int) -> Column:
    """The text as it stands before the given step of :func:`number_text`."""
    s = F.regexp_replace(F.translate(trimmed(c), CURRENCY_SYMBOLS, ""), "%$", "")
    if step > 2:
        s = F.regexp_replace(F.regexp_replace(s, _COMMA_GROUP, ""), _SPACE_GROUP, "")
    return s


def to_number(c: Column) -> Column:
    """Double or null. Only unusual notations go through the clean-up chain.

    A tidy number gives the same value by dropping its decoration in one step.
    The pattern on the chain guards the cast, which also takes ``12d`` or ``NaN``.
    """
    bare = F.concat(F.when(c.startswith("("), "-").otherwise(""), F.translate(c, CURRENCY_SYMBOLS + ",()%+", ""))
    exact = F.regexp_extract(number_text(c), _NUMBER, 0)
    return (
        F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))
        .when(c.rlike(_TIDY_NUMBER), bare.try_cast("double"))
        .when(c.rlike(_NUMBER_LIKE), exact.try_cast("double"))
    )


# --- booleans --------------------------------------------------------------


def to_boolean(c: Column) -> Column:
    token = F.lower(trimmed(c))
    return F.when(token.isin(*TRUE_TOKENS), True).when(token.isin(*FALSE_TOKENS), False)


# --- dates -----------------------------------------------------------------

ISO_LAYOUT = "ISO8601"
_ISO_SHAPE = (r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
              r"(?:Z|[+-]\d{2}:?\d{2})?)?$")
LAYOUT_NAMES = tuple(name for name, _, _ in DATE_LAYOUTS) + (ISO_LAYOUT,)


def parse_layout(c: Column, layout: str) -> Column:
    """Parse one layout; text of another shape never reaches the parser."""
    if layout == ISO_LAYOUT:
        return F.when(c.rlike(_ISO_SHAPE), c.try_cast("timestamp_ntz"))
    _, pattern, shape = next(row for row in DATE_LAYOUTS if row[0] == layout)
    parsed = F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
    if layout.endswith("%y"):
        # Two-digit years from 69 up belong to the previous century.
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("interval 100 years")).otherwise(parsed)
    return F.when(c.rlike(shape), parsed)


def to_datetime(c: Column, layouts: list[str]) -> Column:
    """First layout of the list that parses the value wins."""
    text = trimmed(c)
    return F.coalesce(*[parse_layout(text, layout) for layout in layouts])


def layout_bits(name: str) -> Column:
    """Bit i set when layout i parses the value of column ``name``.

    Written as SQL text: one expression instead of hundreds of Column calls.
    """
    tests = [
        f"""IF(_v RLIKE r'{shape}' AND try_to_timestamp(_v, "{pattern}") IS NOT NULL, {1 << i}L, 0L)"""
        for i, (_, pattern, shape) in enumerate(DATE_LAYOUTS)
    ]
    tests.append(f"IF(_v RLIKE r'{_ISO_SHAPE}' AND try_cast(_v AS timestamp_ntz) IS NOT NULL, "
                 f"{1 << (len(LAYOUT_NAMES) - 1)}L, 0L)")
    # Every layout is between 6 and 35 characters long and has a digit.
    # In a lambda, as in columns.apart.
    test = f"IF(length(_v) BETWEEN 6 AND 35 AND _v RLIKE '[0-9]', {' | '.join(tests)}, 0L)"
    return F.expr(f"transform(array({name}), _v -> {test})[0]")


# --- evidence --------------------------------------------------------------

# Four-digit years from 1900 to 2100 in any layout, or a two-digit year.
_SANE_YEAR = r"(?:^|\D)(?:19\d{2}|20\d{2}|2100)(?:\D|$)|^(?:19\d{2}|20\d{2}|2100)\d{4}$|/\d{2}$"

# Every yes/no fact gathered about a text value, in bit order above the layouts.
# Those of the first group can only hold for a value with a digit.
DIGIT_FACTS = {
    "number": lambda c: to_number(c).isNotNull(),
    "comma_groups": has_comma_groups,
    "parentheses": has_parentheses,
    "year_hint": lambda c: c.rlike(YEAR_HINT),
    "compact_date": lambda c: (F.length(c) == 8) & c.rlike(COMPACT_DATE),
    "sane_year": lambda c: (F.length(c) <= 35) & c.rlike(_SANE_YEAR),  # as long as a layout can be
    "uuid": lambda c: (F.length(c) == 36) & c.rlike(UUID_PATTERN),
}
OTHER_FACTS = {
    "percent": has_percent,
    "currency": has_currency,
    "true": lambda c: (F.length(c) <= 8) & F.lower(c).isin(*TRUE_TOKENS),
    "false": lambda c: (F.length(c) <= 8) & F.lower(c).isin(*FALSE_TOKENS),
    "date_hint": lambda c: c.rlike(DATE_HINT),
    "email": lambda c: c.contains("@") & c.rlike(EMAIL_PATTERN),
    "inner_blanks": has_odd_blanks,
    "placeholder": is_placeholder,  # none holds a blank, so squeezing cannot make one
}
FACT_BIT = {name: len(LAYOUT_NAMES) + i for i, name in enumerate([*DIGIT_FACTS, *OTHER_FACTS])}


def fact_bits(c: Column) -> Column:
    """All facts of a trimmed value as one bigint."""
    def union(facts) -> Column:
        mask = None
        for name, test in facts.items():
            bit = F.when(test(c), 1 << FACT_BIT[name]).otherwise(0).cast("bigint")
            mask = bit if mask is None else mask.bitwiseOR(bit)
        return mask

    digits = F.when(c.rlike("[0-9]"), union(DIGIT_FACTS)).otherwise(F.lit(0).cast("bigint"))
    return union(OTHER_FACTS).bitwiseOR(digits)
