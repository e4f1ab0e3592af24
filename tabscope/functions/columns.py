"""Column references, type tests and text labels."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..specs import SpecError


def ref(df: DataFrame, name: str) -> Column:
    """A column that must exist; dots and backticks in the name are literal."""
    if name not in df.columns:
        raise SpecError(f"no column named {name!r}")
    return quoted(name)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    ref(df, name)
    return df.schema[name].dataType


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.NumericType)


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.IntegralType)


def is_boolean(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.BooleanType)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), T.StringType)


def label(df: DataFrame, name: str) -> Column:
    """The value as display text; whole doubles print as ``1.0``, not ``1.0E7``."""
    col = ref(df, name)
    text = col.cast("string")
    if isinstance(dtype(df, name), T.FractionalType) and not isinstance(dtype(df, name), T.DecimalType):
        whole = (F.abs(col) < 1e15) & (col == F.floor(col))
        return F.when(whole, F.concat(col.cast("bigint").cast("string"), F.lit(".0"))).otherwise(text)
    return text


def finite(df: DataFrame, name: str) -> Column:
    """A numeric column with NaN and infinities treated as missing."""
    col = ref(df, name)
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)
    return col


def finite_frame(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only these columns, as doubles with NaN and infinities missing.

    A projection of its own: aggregates refer to a column many times, and each reference
    to the test itself, or to what the column is computed from, would be written out again.
    """
    return df.select(*[finite(df, n).cast("double").alias(n) for n in names])


def apart(c: Column, work) -> Column:
    """``work`` of a column, not compiled into the loop over the rows.

    Chains of patterns make that loop's code too large for the JVM, which then runs all of it
    uncompiled. In a lambda each part is evaluated by itself, and only where it is reached.
    """
    return F.transform(F.array(c), work)[0]
