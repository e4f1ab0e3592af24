"""From an untyped table to a typed, profiled one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.clean import CleaningReport, clean_table
from ..operators.profile import profile_table
from ..session import new_path
from ..specs import TableProfile


@dataclass
class Prepared:
    df: DataFrame
    profile: TableProfile
    report: CleaningReport


def cleaned(df: DataFrame, staged: bool = True) -> tuple[DataFrame, CleaningReport]:
    """The cleaned table and its report.

    ``staged`` writes the converted columns once below the shared folder, so
    that merging, de-duplication and reading do not parse the text again.
    """
    raw = profile_table(df, duplicates=False, detail=False)
    return clean_table(df, raw, stage=new_path(df.sparkSession, "typed") if staged else None)


def prepare(df: DataFrame, path: str | None = None) -> Prepared:
    """Cleans, writes the typed table once and profiles what was written.

    All later analyses scan the typed columns of that table; none of them
    parses text again, and a lost executor costs a re-read, not a re-clean.
    """
    spark = df.sparkSession
    typed, report = cleaned(df)
    path = path or new_path(spark, "clean")
    typed.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    return Prepared(stored, profile_table(stored, duplicates=False), report)
