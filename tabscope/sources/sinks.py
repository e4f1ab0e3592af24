"""Writing tables and reports below one output folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.bundle import Analysis

PREVIEW_ROWS = (1, 25, 200)


def write_table(df: DataFrame, path: str) -> str:
    """The typed table as Parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    """The cleaned table as CSV files with a header each; quotes are doubled, as the reader expects."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def write_results(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Result tables as JSON, one folder per table."""
    out = {}
    for name, table in tables.items():
        out[name] = f"{path.rstrip('/')}/{name}"
        table.write.mode("overwrite").json(out[name])
    return out


def preview(df: DataFrame, n: int = PREVIEW_ROWS[1]) -> DataFrame:
    low, _, high = PREVIEW_ROWS
    return df.limit(max(low, min(n, high)))


def preview_with_total(df: DataFrame, n: int = PREVIEW_ROWS[1]) -> tuple[DataFrame, int]:
    """The first rows and how many there are altogether."""
    return preview(df, n), df.count()


def report_tables(df: DataFrame, kpis: DataFrame, analysis: Analysis, dictionary: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a report: KPIs, segments, data dictionary and data."""
    top = analysis.segment_rows.where("side = 'top'")
    return {
        "kpis": kpis.select("name", "value", "formatted_value", "change_pct", "calculation"),
        "segments": top.select("dimension", "label", "value", "share_pct"),
        "data_dictionary": dictionary,
        "data": df,
    }
