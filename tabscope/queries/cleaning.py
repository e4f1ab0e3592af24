"""Parsing, normalising, profiling and cleaning of untyped columns.

The oracle of most of these is the typed column the messy text was made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import coerce
from ..operators import clean as C, profile as P
from ..plans import prepare
from ..vocabulary import UNKNOWN_LABEL
from .messy import SOURCE_SQL, messy_orders, rendered, source
from .registry import query, table

FROM_MESSY = f"WITH {SOURCE_SQL} "


def column(spark, sf, name: str, parsed) -> DataFrame:
    return messy_orders(spark, sf).select("order_id", parsed(F.col(name)).alias("value"))


def oracle(value: str) -> str:
    return FROM_MESSY + f"SELECT 'ORD-' || key AS order_id, {value} AS value FROM messy"


@query("parse_currency", oracle("CASE WHEN k <> 7 THEN round(o_totalprice, 2) END"))
def parse_currency(spark, sf):
    return column(spark, sf, "revenue", coerce.to_number)


@query("parse_paren_negative", oracle("round(c_acctbal, 2)"))
def parse_paren_negative(spark, sf):
    return column(spark, sf, "balance", coerce.to_number)


@query("parse_percent", oracle("CAST((key % 4) * 5 AS DOUBLE)"))
def parse_percent(spark, sf):
    return column(spark, sf, "discount_pct", coerce.to_number)


@query("parse_units", oracle("CAST(key % 50 AS DOUBLE)"))
def parse_units(spark, sf):
    return column(spark, sf, "weight", coerce.to_number)


@query("parse_boolean", oracle("o_orderstatus = 'F'"))
def parse_boolean(spark, sf):
    return column(spark, sf, "returned", coerce.to_boolean)


@query("parse_dates_mixed", oracle("o_orderdate::TIMESTAMP"))
def parse_dates_mixed(spark, sf):
    df = messy_orders(spark, sf)
    layouts, *_ = P.text_evidence(df, {"order_date": F.col("order_date")})["order_date"].layouts()
    return df.select("order_id", coerce.to_datetime(F.col("order_date"), layouts).alias("value"))


@query("normalize_whitespace", FROM_MESSY + """
    SELECT CASE k WHEN 2 THEN lower(c_mktsegment) ELSE c_mktsegment END AS value, count(*) AS n,
           count(*) FILTER (WHERE k = 4) AS changed FROM messy WHERE k <> 9 GROUP BY 1""")
def normalize_whitespace(spark, sf):
    raw = F.col("segment")
    tidy = coerce.squeezed(raw)
    rows = messy_orders(spark, sf).where(raw.isNotNull())
    return rows.groupBy(tidy.alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(raw != tidy).alias("changed"))


PLACEHOLDER_SQL = """CASE WHEN c_custkey % 7 = 1 THEN '-' WHEN c_custkey % 7 = 2 THEN ' N/A ' WHEN c_custkey % 7 = 3 THEN 'null'
    WHEN c_custkey % 7 = 4 THEN 'Null' ELSE c_mktsegment END"""


@query("normalize_empty", """
    SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 IN (1, 2, 3)) AS missing,
           count(*) FILTER (WHERE c_custkey % 7 = 4) AS kept_null_word FROM customer""")
def normalize_empty(spark, sf):
    raw = table(spark, sf, "customer").select(F.expr(PLACEHOLDER_SQL).alias("label"))
    clean = raw.select(C.normalized(raw, "label").alias("label"))
    return clean.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").isNull()).alias("missing"),
                     F.count_if(F.col("label") == "Null").alias("kept_null_word"))


@query("canonical_labels", FROM_MESSY + """
    SELECT lower(c_mktsegment) AS value, c_mktsegment AS canonical, count(*) AS n
    FROM messy WHERE k = 2 GROUP BY 1, 2""")
def canonical_labels(spark, sf):
    df = messy_orders(spark, sf)
    return C.spelling_variants(df.select(C.normalized(df, "segment").alias("segment")), ["segment"]).drop("position")


@query("merged_labels", FROM_MESSY + "SELECT c_mktsegment AS segment, count(*) AS n FROM messy WHERE k <> 9 GROUP BY 1")
def merged_labels(spark, sf):
    """The same merge through the shuffled, salted lookup used for large vocabularies."""
    df = messy_orders(spark, sf)
    labels = df.select(C.normalized(df, "segment").alias("segment"))
    variants = C.spelling_variants(labels, ["segment"])
    merged = C.apply_spellings(labels, "segment", variants, C.LOOKUP_ROWS + 1)
    return merged.where(F.col("segment").isNotNull()).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("fill_unknown", FROM_MESSY + """
    SELECT CASE WHEN k = 9 THEN 'Unknown' ELSE c_mktsegment END AS segment, count(*) AS n FROM messy GROUP BY 1""")
def fill_unknown(spark, sf):
    df = messy_orders(spark, sf)
    upper = df.select(F.upper(C.normalized(df, "segment")).alias("segment"))
    return upper.fillna(UNKNOWN_LABEL).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query("duplicate_count", """
    SELECT (SELECT count(*) FROM documents) AS n_rows,
           (SELECT count(*) FROM documents) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS n_duplicates""")
def duplicate_count(spark, sf):
    return P.duplicate_count(table(spark, sf, "documents").select("text", "lang"))


@query("dedupe_safe", FROM_MESSY + """
    SELECT count(*) AS n, count(DISTINCT key) AS orders, true AS removed FROM base""")
def dedupe_safe(spark, sf):
    df = messy_orders(spark, sf)
    counts = C.count_rows_and_missing(df)
    copies = counts["rows"] - counts["distinct_rows"]
    safe = C.safe_to_deduplicate(copies, counts["rows"], has_identifier=True)
    kept = df.dropDuplicates() if safe else df
    return kept.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("order_id").alias("orders"), F.lit(safe).alias("removed"))


@query("dedupe_kept", "SELECT count(*) AS n, false AS removed FROM events")
def dedupe_kept(spark, sf):
    """A narrow table without an identifier keeps its repeated observations."""
    df = table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day"))
    counts = C.count_rows_and_missing(df)
    safe = C.safe_to_deduplicate(counts["rows"] - counts["distinct_rows"], counts["rows"], has_identifier=False)
    kept = df.dropDuplicates() if safe else df
    return kept.agg(F.count(F.lit(1)).alias("n"), F.lit(safe).alias("removed"))


# --- evidence ----------------------------------------------------------------

MESSY_NUMBERS = ("revenue", "balance", "discount_pct", "weight", "segment")


@query("try_numeric_ratio", FROM_MESSY + """
    SELECT 'revenue' AS "column", count(*) FILTER (WHERE k <> 7) AS count, 1.0::DOUBLE AS number_share FROM messy
    UNION ALL SELECT 'balance', count(*), 1.0 FROM messy UNION ALL SELECT 'discount_pct', count(*), 1.0 FROM messy
    UNION ALL SELECT 'weight', count(*), 1.0 FROM messy
    UNION ALL SELECT 'segment', count(*) FILTER (WHERE k <> 9), 0.0 FROM messy""")
def try_numeric_ratio(spark, sf):
    found = P.text_evidence(messy_orders(spark, sf), {c: F.col(c) for c in MESSY_NUMBERS})
    return P.evidence_frame(spark, found, ["number"]).select("column", "count", "number_share")


@query("literal_evidence", """
    SELECT * FROM (VALUES ('revenue', 0.0::DOUBLE, 1.0::DOUBLE), ('balance', 0.0, 1.0), ('discount_pct', 1.0, 0.0),
                          ('weight', 0.0, 0.0), ('segment', 0.0, 0.0)) AS v("column", percent_share, currency_share)""")
def literal_evidence(spark, sf):
    found = P.text_evidence(messy_orders(spark, sf), {c: F.col(c) for c in MESSY_NUMBERS})
    return P.evidence_frame(spark, found, ["percent", "currency"]).select("column", "percent_share", "currency_share")


@query("date_gate", """
    SELECT * FROM (VALUES ('order_date', true), ('segment', false), ('revenue', false), ('order_id', false))
    AS v("column", looks_like_dates)""")
def date_gate(spark, sf):
    found = P.text_evidence(messy_orders(spark, sf), {c: F.col(c) for c in ("order_date", "segment", "revenue", "order_id")})
    return spark.createDataFrame([(n, e.looks_like_dates(n)) for n, e in found.items()], "column string, looks_like_dates boolean")


@query("pattern_evidence", """
    SELECT 'token' AS "column", count(*) AS count, count(*) AS "unique", 1.0::DOUBLE AS uuid_share, 0.0::DOUBLE AS email_share FROM customer
    UNION ALL SELECT 'contact', count(*), count(*), 0.0, 1.0 FROM customer""")
def pattern_evidence(spark, sf):
    key = F.col("c_custkey")
    hexed = F.lower(F.hex(key))
    df = table(spark, sf, "customer").select(
        F.concat(F.lpad(hexed, 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(hexed, 12, "0")).alias("token"),
        F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("contact"))
    found = P.text_evidence(df, {c: F.col(c) for c in df.columns})
    return P.evidence_frame(spark, found, ["uuid", "email"]).select("column", "count", "unique", "uuid_share", "email_share")


@query("text_evidence", r"""
    WITH t AS (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents WHERE text IS NOT NULL)
    SELECT 'text' AS "column", count(*) AS count, count(DISTINCT text) AS "unique", round(avg(length(text)), 3) AS mean_length,
           round(avg(len(regexp_split_to_array(text, '\s+'))), 3) AS mean_words FROM t WHERE text <> ''""")
def text_evidence(spark, sf):
    found = P.text_evidence(table(spark, sf, "documents"), {"text": F.col("text")})
    return P.evidence_frame(spark, found, []).select(
        "column", "count", "unique", F.round("mean_length", 3).alias("mean_length"), F.round("mean_words", 3).alias("mean_words"))


# --- profile -----------------------------------------------------------------


@query("numeric_summary", """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
    SELECT 'o_totalprice' AS "column", min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean,
           round(median(o_totalprice), 4) AS median, round(stddev(o_totalprice), 4) AS std,
           round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
           round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.95), 4) AS p95,
           round(skewness(o_totalprice), 4) AS skew, round(sum(o_totalprice), 2) AS sum, 0.0::DOUBLE AS zero_pct,
           0.0::DOUBLE AS negative_pct,
           count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS outlier_count
    FROM orders, q
    UNION ALL
    SELECT 'c_acctbal', min(c_acctbal), max(c_acctbal), round(avg(c_acctbal), 4), round(median(c_acctbal), 4),
           round(stddev(c_acctbal), 4), round(quantile_cont(c_acctbal, 0.05), 4), round(quantile_cont(c_acctbal, 0.25), 4),
           round(quantile_cont(c_acctbal, 0.75), 4), round(quantile_cont(c_acctbal, 0.95), 4), round(skewness(c_acctbal), 4),
           round(sum(c_acctbal), 2), round(100.0 * count(*) FILTER (WHERE c_acctbal = 0) / count(c_acctbal), 2),
           round(100.0 * count(*) FILTER (WHERE c_acctbal < 0) / count(c_acctbal), 2), 0 FROM customer""")
def numeric_summary(spark, sf):
    names = ("min", "max", "mean", "median", "std", "p05", "p25", "p75", "p95", "skew", "sum", "zero_pct", "negative_pct", "outlier_count")
    rows = []
    for name, column_name in (("orders", "o_totalprice"), ("customer", "c_acctbal")):
        stats = P.numeric_summary(table(spark, sf, name), {column_name: F.col(column_name)})[column_name]
        rows.append((column_name, *[stats[n] for n in names]))
    schema = "column string, " + ", ".join(f"`{n}` double" for n in names[:-1]) + ", outlier_count long"
    out = spark.createDataFrame(rows, schema)
    return out.select("column", "min", "max", *[F.round(n, 2 if n == "sum" else 4).alias(n) for n in names[2:-1]], "outlier_count")


PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("column_profile", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
           round(count(DISTINCT {c}) * 1.0 / count({c}), 4) AS cardinality_ratio, count(DISTINCT {c}) <= 1 AS is_constant,
           count(DISTINCT {c}) = count(*) AS is_unique_key FROM orders""" for c in PROFILED))
def column_profile(spark, sf):
    profile = P.profile_table(table(spark, sf, "orders").select(*PROFILED), duplicates=False)
    return P.profile_frame(spark, profile).select(
        "column", "count", "missing", "unique", "cardinality_ratio", "is_constant", "is_unique_key")


@query("datetime_summary", """
    SELECT 'o_orderdate' AS "column", min(o_orderdate) AS lo, max(o_orderdate) AS hi,
           date_diff('day', min(o_orderdate), max(o_orderdate)) AS range_days,
           count(DISTINCT o_orderdate::DATE) AS distinct_days, 'quarter' AS suggested_grain FROM orders
    UNION ALL SELECT 'ts', min(ts), max(ts), date_sub('day', min(ts), max(ts)), count(DISTINCT ts::DATE), 'day' FROM events""")
def datetime_summary(spark, sf):
    parts = []
    for name, column_name in (("orders", "o_orderdate"), ("events", "ts")):
        profile = P.profile_table(table(spark, sf, name).select(column_name), duplicates=False)
        parts.append(P.profile_frame(spark, profile).select(
            "column", F.col("datetime.min").alias("lo"), F.col("datetime.max").alias("hi"), "datetime.range_days",
            "datetime.distinct_days", "datetime.suggested_grain"))
    return parts[0].unionByName(parts[1])


@query("top_values", """
    WITH c AS (SELECT 'p_brand' AS name, p_brand AS value, count(*) AS n FROM part GROUP BY 2
               UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM c)
    SELECT name, rank, value, n, round(n * 100.0 / (SELECT count(*) FROM part), 2) AS pct FROM r WHERE rank <= 12""")
def top_values(spark, sf):
    return P.top_values(table(spark, sf, "part"), {c: F.col(c) for c in ("p_brand", "p_type")}).withColumn(
        "rank", F.col("rank").cast("bigint"))


# --- cleaning ----------------------------------------------------------------


def cleaned(spark, sf):
    return prepare.cleaned(messy_orders(spark, sf))


@query("clean_table", FROM_MESSY + """
    SELECT 'ORD-' || key AS order_id, o_orderdate::TIMESTAMP AS order_date,
           CASE WHEN k <> 7 THEN round(o_totalprice, 2) END AS revenue, round(c_acctbal, 2) AS balance,
           CAST((key % 4) * 5 AS DOUBLE) AS discount_pct, CAST(key % 50 AS DOUBLE) AS weight,
           CASE WHEN k = 9 THEN 'Unknown' ELSE c_mktsegment END AS segment, o_orderstatus = 'F' AS returned FROM base""")
def clean_table(spark, sf):
    return cleaned(spark, sf)[0]


@query("cleaning_audit", FROM_MESSY + """
    SELECT 'trim_whitespace' AS action, 'segment' AS "column", count(*) FILTER (WHERE k = 4) AS rows_affected FROM messy
    UNION ALL SELECT 'drop_column', 'empty', count(*) FROM messy
    UNION ALL SELECT 'parse_datetime', 'order_date', count(*) FROM messy
    UNION ALL SELECT 'strip_currency', 'revenue', count(*) FILTER (WHERE k <> 7) FROM messy
    UNION ALL SELECT 'strip_currency', 'balance', count(*) FROM messy
    UNION ALL SELECT 'parse_percent', 'discount_pct', count(*) FROM messy
    UNION ALL SELECT 'parse_numeric', 'weight', count(*) FROM messy
    UNION ALL SELECT 'cast_boolean', 'returned', count(*) FROM messy
    UNION ALL SELECT 'normalize_category', 'segment', count(*) FILTER (WHERE k = 2) FROM messy
    UNION ALL SELECT 'drop_duplicates', NULL, count(*) FILTER (WHERE key % 50 = 0) FROM base
    UNION ALL SELECT 'fill_missing', 'segment', count(*) FILTER (WHERE k = 9) FROM base""")
def cleaning_audit(spark, sf):
    return C.audit_frame(spark, cleaned(spark, sf)[1]).select("action", "column", "rows_affected")


@query("missing_summary", FROM_MESSY + """
    SELECT 'revenue' AS "column", count(*) FILTER (WHERE k = 7) AS missing,
           round(count(*) FILTER (WHERE k = 7) * 100.0 / count(*), 2) AS missing_pct FROM base
    UNION ALL SELECT 'segment', count(*) FILTER (WHERE k = 9), round(count(*) FILTER (WHERE k = 9) * 100.0 / count(*), 2) FROM base""")
def missing_summary(spark, sf):
    return C.missing_frame(spark, cleaned(spark, sf)[1]).drop("strategy")


@query("quality_scores", FROM_MESSY + """
    , c AS (SELECT (SELECT count(*) FROM messy) AS before, count(*) AS after, count(*) FILTER (WHERE k = 7) AS missing FROM base),
    s AS (SELECT *, 100.0 - missing * 100.0 / (after * 8) AS completeness, 100.0 - (before - after) * 100.0 / before AS uniqueness,
                 CAST(700.0 / 9 AS DOUBLE) AS consistency FROM c)
    SELECT before AS rows_before, after AS rows_after, before - after AS duplicates_removed, missing AS missing_after,
           round(completeness, 1) AS completeness, round(uniqueness, 1) AS uniqueness, round(consistency, 1) AS consistency,
           round(0.5 * completeness + 0.3 * uniqueness + 0.2 * consistency, 1) AS quality FROM s""")
def quality_scores(spark, sf):
    return C.score_frame(spark, cleaned(spark, sf)[1]).select(
        "rows_before", "rows_after", "duplicates_removed", "missing_after", "completeness", "uniqueness", "consistency", "quality")


@query("typical_decimals", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", coalesce((SELECT least(d, 6) FROM (
        SELECT length(regexp_extract(CAST({c} AS VARCHAR), '\\.([0-9]+)$', 1)) AS d, count(*) AS n FROM lineitem GROUP BY 1)
        WHERE d > 0 ORDER BY n DESC, d LIMIT 1), 0)::INT AS decimals"""
    for c in ("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")))
def typical_decimals(spark, sf):
    return P.typical_decimals(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))
