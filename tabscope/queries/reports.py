"""Roles, catalogues, KPIs, views, questions, insights and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import format_value, signed_percent
from ..operators import catalogue as G, insights as I, kpi as K, profile as P, views as V
from ..plans import bundle as B, questions as Q
from ..plans.prepare import prepare
from ..session import new_path
from ..sources import delimited, sinks
from ..specs import Filter, KpiSpec, QuestionSpec, ViewSpec
from .messy import SOURCE_SQL, messy_orders
from .registry import query, table
from .shapes import PERIODS, money


def orders_profile(spark, sf):
    df = table(spark, sf, "orders")
    return df, P.profile_table(df, duplicates=False)


def values(names: str, *rows: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({names})"


# --- roles and catalogues ----------------------------------------------------


@query("detect_types", values(
    '"column", inferred_type', "('c_custkey', 'numeric')", "('c_name', 'text')", "('c_nationkey', 'numeric')",
    "('c_acctbal', 'numeric')", "('c_mktsegment', 'categorical')", "('doc_id', 'numeric')", "('quality', 'boolean')",
    "('toxic', 'boolean')"))
def detect_types(spark, sf):
    parts = [P.profile_frame(spark, P.profile_table(table(spark, sf, n), duplicates=False)) for n in ("customer", "labels")]
    return parts[0].unionByName(parts[1]).select("column", "inferred_type")


@query("column_roles", values(
    '"column", inferred_type, role, confidence', "('o_orderkey', 'numeric', 'measure', 0.65::DOUBLE)",
    "('o_custkey', 'numeric', 'measure', 0.65)", "('o_orderstatus', 'categorical', 'dimension', 0.7)",
    "('o_totalprice', 'numeric', 'currency', 0.7)", "('o_orderdate', 'datetime', 'time', 0.98)",
    "('o_orderpriority', 'categorical', 'dimension', 0.7)"))
def column_roles(spark, sf):
    return G.column_roles(spark, orders_profile(spark, sf)[1])


@query("dataset_profile", """
    SELECT (SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns, 0::BIGINT AS n_duplicate_rows,
           'o_orderkey,o_custkey,o_totalprice' AS numeric_columns, 'o_orderstatus,o_orderpriority' AS categorical_columns,
           'o_orderdate' AS datetime_columns, '' AS boolean_columns, '' AS text_columns, '' AS identifier_columns,
           'o_orderkey,o_custkey,o_totalprice' AS measure_columns, 'o_orderstatus,o_orderpriority' AS dimension_columns,
           'o_orderdate' AS primary_date, 'o_totalprice' AS primary_measure, 'general' AS domain""")
def dataset_profile(spark, sf):
    return P.dataset_profile(spark, P.profile_table(table(spark, sf, "orders")))


@query("field_catalogue", """
    SELECT 'c_custkey' AS name, 'numeric' AS inferred_type, 'measure' AS semantic_role, true AS is_measure, false AS is_dimension,
           count(DISTINCT c_custkey) AS "unique", 'sum' AS suggested_aggregation FROM customer
    UNION ALL SELECT 'c_name', 'text', 'identifier', false, false, count(DISTINCT c_name), 'count' FROM customer
    UNION ALL SELECT 'c_nationkey', 'numeric', 'measure', true, false, count(DISTINCT c_nationkey), 'sum' FROM customer
    UNION ALL SELECT 'c_acctbal', 'numeric', 'measure', true, false, count(DISTINCT c_acctbal), 'sum' FROM customer
    UNION ALL SELECT 'c_mktsegment', 'categorical', 'dimension', false, true, count(DISTINCT c_mktsegment), 'count' FROM customer""")
def field_catalogue(spark, sf):
    profile = P.profile_table(table(spark, sf, "customer"), duplicates=False)
    return G.field_catalogue(spark, profile).select(
        "name", "inferred_type", "semantic_role", "is_measure", "is_dimension", "unique", "suggested_aggregation")


@query("data_dictionary", """
    WITH s AS (SELECT o_orderstatus AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1)
    SELECT 'o_orderstatus' AS "column", 'O Orderstatus' AS display_name, 'categorical' AS type, 'dimension' AS role, 0.0::DOUBLE AS missing_pct,
           (SELECT count(*) FROM s) AS unique_values, false AS is_measure, true AS is_dimension,
           (SELECT string_agg(v, ', ' ORDER BY r) FROM s WHERE r <= 3) AS example_values
    UNION ALL SELECT 'o_orderdate', 'O Orderdate', 'datetime', 'time', 0.0, (SELECT count(DISTINCT o_orderdate) FROM orders), false, false,
           (SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') || ', ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders)""")
def data_dictionary(spark, sf):
    profile = P.profile_table(table(spark, sf, "orders").select("o_orderstatus", "o_orderdate"), duplicates=False)
    return G.data_dictionary(spark, profile).drop("role_confidence", "role_evidence")


@query("semantic_model_columns", values(
    "name, data_type, semantic_role, data_category, format_string, summarize_by, is_key, is_hidden",
    "('doc_id', 'double', 'identifier', 'Uncategorized', NULL, 'none', true, true)",
    "('quality', 'boolean', 'flag', 'Uncategorized', NULL, 'none', false, false)",
    "('toxic', 'boolean', 'flag', 'Uncategorized', NULL, 'none', false, false)"))
def semantic_model_columns(spark, sf):
    profile = P.profile_table(table(spark, sf, "labels"), duplicates=False)
    return G.model_columns(spark, profile).drop("display_name", "missing_pct", "unique_values")


@query("semantic_model_measures")
def semantic_model_measures(spark, sf):
    return G.model_measures(spark, K.discover_kpis(orders_profile(spark, sf)[1]))


@query("semantic_model_visuals")
def semantic_model_visuals(spark, sf):
    return G.model_visuals(spark, V.recommend_views(orders_profile(spark, sf)[1]))


@query("measure_ranking", values(
    "rank, measure, aggregation, is_primary", "(1, 'o_totalprice', 'avg', true)", "(2, 'o_orderkey', 'sum', false)",
    "(3, 'o_custkey', 'sum', false)"))
def measure_ranking(spark, sf):
    return G.measure_ranking(spark, orders_profile(spark, sf)[1])


@query("dimension_ranking", values(
    "rank, dimension, score", "(1, 'o_orderstatus', 3.6::DOUBLE)", "(2, 'o_orderpriority', 3.6)"))
def dimension_ranking(spark, sf):
    return G.dimension_ranking(spark, orders_profile(spark, sf)[1])


@query("filter_options", """
    SELECT 'o_orderdate' AS "column", 'date_range' AS kind, 'between' AS operator, NULL AS option, min(o_orderdate) AS low,
           max(o_orderdate) AS high FROM orders
    UNION ALL SELECT DISTINCT 'o_orderstatus', 'multi_select', 'in', o_orderstatus, NULL, NULL FROM orders
    UNION ALL SELECT DISTINCT 'o_orderpriority', 'multi_select', 'in', o_orderpriority, NULL, NULL FROM orders""")
def filter_options(spark, sf):
    return G.filter_options(*orders_profile(spark, sf))


# --- KPIs --------------------------------------------------------------------

KPIS = [
    KpiSpec("record_count", "Total Orders", "count", 70, aggregation="count"),
    KpiSpec("total_revenue", "Total Revenue", "currency", 95, measure="o_totalprice", aggregation="sum"),
    KpiSpec("urgent_rate", "Urgent Rate", "percent", 60, flag="urgent", higher_is_better=False),
    KpiSpec("order_value", "Order Value", "currency", 58, numerator="o_totalprice"),
    KpiSpec("buyers", "Buyers", "count", 55, measure="o_custkey", aggregation="count_distinct"),
    KpiSpec("middle_order", "Middle Order", "currency", 50, measure="o_totalprice", aggregation="median"),
]


def flagged_orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")


@query("kpi_filtered", """
    WITH r AS (SELECT * FROM orders WHERE o_orderstatus = 'F')
    SELECT 'record_count' AS kpi_id, CAST(count(*) AS DOUBLE) AS value FROM r
    UNION ALL SELECT 'total_revenue', round(sum(o_totalprice), 2) FROM r
    UNION ALL SELECT 'urgent_rate', round(100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*), 2) FROM r
    UNION ALL SELECT 'order_value', round(sum(o_totalprice) / count(*), 2) FROM r
    UNION ALL SELECT 'buyers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM r
    UNION ALL SELECT 'middle_order', round(median(o_totalprice), 2) FROM r""")
def kpi_filtered(spark, sf):
    out = K.kpi_table(flagged_orders(spark, sf), KPIS, [Filter("o_orderstatus", "in", ["F"])])
    return money(out.select("kpi_id", "value"), "value")


@query("kpi_comparison", f"""WITH {PERIODS},
    w AS (SELECT max(period) FILTER (WHERE idx = n_periods - 1) AS now, max(period) FILTER (WHERE idx = n_periods - 2) AS was FROM points),
    c AS (SELECT o.* FROM orders o, w WHERE o_orderdate >= now AND o_orderdate < now + INTERVAL 1 MONTH),
    p AS (SELECT o.* FROM orders o, w WHERE o_orderdate >= was AND o_orderdate < now),
    k AS (SELECT 'record_count' AS kpi_id, true AS up, CAST((SELECT count(*) FROM c) AS DOUBLE) AS cur, CAST((SELECT count(*) FROM p) AS DOUBLE) AS prev
          UNION ALL SELECT 'total_revenue', true, (SELECT sum(o_totalprice) FROM c), (SELECT sum(o_totalprice) FROM p)
          UNION ALL SELECT 'urgent_rate', false, (SELECT 100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) FROM c),
                           (SELECT 100.0 * count(*) FILTER (WHERE o_orderpriority = '1-URGENT') / count(*) FROM p)
          UNION ALL SELECT 'order_value', true, (SELECT avg(o_totalprice) FROM c), (SELECT avg(o_totalprice) FROM p)
          UNION ALL SELECT 'buyers', true, (SELECT count(DISTINCT o_custkey) FROM c), (SELECT count(DISTINCT o_custkey) FROM p)
          UNION ALL SELECT 'middle_order', true, (SELECT median(o_totalprice) FROM c), (SELECT median(o_totalprice) FROM p))
    SELECT kpi_id, round(prev, 2) AS previous_value, round(cur - prev, 2) AS change, round((cur - prev) * 100 / abs(prev), 2) AS change_pct,
           CASE WHEN cur > prev THEN 'up' WHEN cur < prev THEN 'down' ELSE 'flat' END AS direction,
           CASE WHEN cur <> prev THEN (cur > prev) = up END AS is_favorable FROM k""")
def kpi_comparison(spark, sf):
    out = K.kpi_table(flagged_orders(spark, sf), KPIS, compare=("o_orderdate", "month"))
    return money(out.select("kpi_id", "previous_value", "change", "change_pct", "direction", "is_favorable"),
                 "previous_value", "change")


@query("kpi_table", f"""WITH {SOURCE_SQL}
    SELECT 'total_revenue' AS kpi_id, 'Total Revenue' AS name, 'currency' AS format,
           round(sum(CASE WHEN k <> 7 THEN round(o_totalprice, 2) END), 2) AS value FROM base
    UNION ALL SELECT 'return_rate', 'Return Rate', 'percent', round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 2) FROM base
    UNION ALL SELECT 'average_order_value', 'Average Order Value', 'currency',
           round(sum(CASE WHEN k <> 7 THEN round(o_totalprice, 2) END) / count(*), 2) FROM base
    UNION ALL SELECT 'record_count', 'Total Orders', 'count', CAST(count(*) AS DOUBLE) FROM base
    UNION ALL SELECT 'total_balance', 'Total Balance', 'currency', round(sum(round(c_acctbal, 2)), 2) FROM base
    UNION ALL SELECT 'total_weight', 'Total Weight', 'number', CAST(sum(key % 50) AS DOUBLE) FROM base""")
def kpi_table(spark, sf):
    ready = prepare(messy_orders(spark, sf))
    return money(K.kpi_table(ready.df, K.discover_kpis(ready.profile), limit=K.MAX_KPIS).select("kpi_id", "name", "format", "value"), "value")


@query("kpi_distinct_entities", """
    SELECT 'distinct_order_key' AS kpi_id, 'Unique Order Key' AS name, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS value FROM lineitem""")
def kpi_distinct_entities(spark, sf):
    df = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("order_key"), "l_returnflag").agg(
        F.sum("l_quantity").alias("quantity"))
    profile = P.profile_table(df, duplicates=False)
    specs = [s for s in K.discover_kpis(profile) if s.aggregation == "count_distinct"]
    return K.kpi_table(df, specs).select("kpi_id", "name", "value")


# Tables of four fields of business, all over the order lines, so that every rule has one it applies to.
RULE_TABLES = {
    "marketing": {"campaign": "concat('s', l_suppkey % 9)", "channel": "concat('m', l_linenumber)", "impressions": "l_partkey % 400 + 900.5", "clicks": "l_quantity + 7",
                  "conversions": "l_linenumber % 3 + 0.5", "spend": "l_extendedprice * 0.02", "revenue": "l_extendedprice"},
    "sales": {"product": "concat('m', l_linenumber)", "store": "concat('s', l_suppkey % 9)", "revenue": "l_extendedprice", "profit": "l_extendedprice * l_discount",
              "quantity": "l_quantity", "returned": "l_returnflag = 'R'"},
    "finance": {"account": "concat('m', l_linenumber)", "transaction": "concat('s', l_suppkey % 9)", "amount": "l_extendedprice", "tax": "l_extendedprice * l_tax"},
    "hr": {"department": "concat('m', l_linenumber)", "employee": "concat('s', l_suppkey % 9)", "salary": "l_extendedprice", "left_company": "l_returnflag = 'R'",
           "is_active": "l_linestatus = 'O'"},
}
KPI_RULES = {
    "profit_margin": ("sales", "100.0 * sum(l_extendedprice * l_discount) / sum(l_extendedprice)"),
    "average_order_value": ("sales", "sum(l_extendedprice) / count(*)"),
    "units_per_order": ("sales", "sum(l_quantity) / count(*)"),
    "return_rate": ("sales", "100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*)"),
    "conversion_rate": ("marketing", "100.0 * sum(l_linenumber % 3 + 0.5) / sum(l_quantity + 7)"),
    "click_through_rate": ("marketing", "100.0 * sum(l_quantity + 7) / sum(l_partkey % 400 + 900.5)"),
    "cost_per_click": ("marketing", "sum(l_extendedprice * 0.02) / sum(l_quantity + 7)"),
    "cost_per_acquisition": ("marketing", "sum(l_extendedprice * 0.02) / sum(l_linenumber % 3 + 0.5)"),
    "return_on_ad_spend": ("marketing", "sum(l_extendedprice) / sum(l_extendedprice * 0.02)"),
    "effective_tax_rate": ("finance", "100.0 * sum(l_extendedprice * l_tax) / sum(l_extendedprice)"),
    "attrition_rate": ("hr", "100.0 * count(*) FILTER (WHERE l_returnflag = 'R') / count(*)"),
    "active_rate": ("hr", "100.0 * count(*) FILTER (WHERE l_linestatus = 'O') / count(*)"),
}


def rule_kpi(kpi_id: str, field: str):
    def run(spark, sf):
        df = table(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, e in RULE_TABLES[field].items()])
        profile = P.profile_table(df, duplicates=False)
        found = [k for k in K.discover_kpis(profile) if k.id == kpi_id]
        return K.kpi_table(df, found).select("kpi_id", F.round("value", 4).alias("value"))
    return run


for _id, (_field, _value) in KPI_RULES.items():
    query(f"kpi_rule_{_id}", f"SELECT '{_id}' AS kpi_id, round({_value}, 4) AS value FROM lineitem")(rule_kpi(_id, _field))


@query("kpi_custom", """
    SELECT 'price_per_unit' AS kpi_id, round(sum(l_extendedprice) / sum(l_quantity), 2) AS value, 'user' AS source FROM lineitem
    UNION ALL SELECT 'largest_line', max(l_extendedprice), 'user' FROM lineitem
    UNION ALL SELECT 'broken', NULL, 'rejected'""")
def kpi_custom(spark, sf):
    df = table(spark, sf, "lineitem")
    profile = P.profile_table(df, duplicates=False)
    proposals = [
        KpiSpec("", "Price per Unit", numerator="l_extendedprice", denominator="l_quantity"),
        KpiSpec("", "Largest Line", measure="l_extendedprice", aggregation="max"),
        KpiSpec("", "Broken", measure="no_such_column"),
    ]
    specs, rejected = K.merge_proposals([], proposals, profile)
    accepted = money(K.kpi_table(df, specs).select("kpi_id", "value"), "value").withColumn("source", F.lit("user"))
    refused = spark.createDataFrame([(k, None, "rejected") for k, _ in rejected], "kpi_id string, value double, source string")
    return accepted.unionByName(refused)


@query("format_values", """
    SELECT r_regionkey AS r_regionkey, CASE r_regionkey WHEN 0 THEN '$0' WHEN 1 THEN '$1.2K' WHEN 2 THEN '$2.5K' WHEN 3 THEN '$3.7K' ELSE '$4.9K' END AS currency,
           CASE r_regionkey WHEN 0 THEN '0.0%' WHEN 1 THEN '1.5%' WHEN 2 THEN '3.0%' WHEN 3 THEN '4.5%' ELSE '6.0%' END AS percent,
           CASE r_regionkey WHEN 0 THEN '0 days' WHEN 1 THEN '200 days' WHEN 2 THEN '1.1 yrs' WHEN 3 THEN '1.6 yrs' ELSE '2.2 yrs' END AS days,
           CASE r_regionkey WHEN 0 THEN '0' WHEN 1 THEN '1M' WHEN 2 THEN '2M' WHEN 3 THEN '3M' ELSE '4M' END AS number,
           CASE r_regionkey WHEN 0 THEN '-1.0%' WHEN 1 THEN '0.0%' ELSE '+' || CAST(r_regionkey - 1 AS VARCHAR) || '.0%' END AS moved
    FROM region""")
def format_values(spark, sf):
    key = F.col("r_regionkey").cast("double")
    return table(spark, sf, "region").select(
        "r_regionkey", format_value(key * 1234, "currency").alias("currency"), format_value(key * 1.5, "percent").alias("percent"),
        format_value(key * 200, "duration_days").alias("days"), format_value(key * 1e6, "number").alias("number"),
        signed_percent(key - 1).alias("moved"))


# --- views and questions -----------------------------------------------------


@query("view_validation", values(
    "view_id, ok", "('good_bar', true)", "('same_bar', false)", "('pie_of_averages', false)", "('text_measure', false)",
    "('trend', true)", "('trend_without_date', false)", "('histogram', true)", "('bad_column', false)"))
def view_validation(spark, sf):
    _, profile = orders_profile(spark, sf)
    views = [
        ViewSpec("good_bar", "bar", x="o_orderpriority", y="o_totalprice"),
        ViewSpec("same_bar", "bar", x="o_orderpriority", y="o_totalprice"),
        ViewSpec("pie_of_averages", "pie", x="o_orderpriority", y="o_totalprice", aggregation="avg"),
        ViewSpec("text_measure", "bar", x="o_orderpriority", y="o_orderstatus"),
        ViewSpec("trend", "line", x="o_orderdate", y="o_totalprice"),
        ViewSpec("trend_without_date", "line", x="o_orderpriority", y="o_totalprice"),
        ViewSpec("histogram", "histogram", x="o_totalprice", aggregation="count"),
        ViewSpec("bad_column", "bar", x="nowhere", y="o_totalprice"),
    ]
    return V.validation_frame(spark, V.check_views(views, profile)[1]).select("view_id", "ok")


@query("allowed_view_types", values(
    "x, y, type", *[f"('o_orderpriority', 'o_totalprice', '{t}')" for t in ("bar", "horizontal_bar", "pie", "donut", "histogram", "table")],
    *[f"('o_orderdate', 'o_totalprice', '{t}')" for t in ("line", "area", "histogram", "table")]))
def allowed_view_types(spark, sf):
    _, profile = orders_profile(spark, sf)
    rows = [(x, "o_totalprice", t) for x in ("o_orderpriority", "o_orderdate") for t in V.allowed_types(profile, x, "o_totalprice")]
    return spark.createDataFrame(rows, "x string, y string, type string")


@query("auto_views")
def auto_views(spark, sf):
    df, profile = orders_profile(spark, sf)
    parts = [V.execute_view(df, v).agg(F.lit(v.id).alias("view_id"), F.lit(v.type).alias("type"), F.count(F.lit(1)).alias("n_rows"))
             for v in V.recommend_views(profile)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("view_at_other_grain", """
    SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS period, strftime(date_trunc('year', o_orderdate), '%Y') AS x,
           round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""")
def view_at_other_grain(spark, sf):
    view = ViewSpec("trend", "line", x="o_orderdate", y="o_totalprice", time_grain="month").at_grain("year")
    return money(V.execute_view(table(spark, sf, "orders"), view), "value")


@query("plan_rank", """
    SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS value, count(*) AS row_count FROM orders
    WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY avg(o_totalprice), label LIMIT 3""")
def plan_rank(spark, sf):
    df, profile = orders_profile(spark, sf)
    q = QuestionSpec("rank", "o_totalprice", "avg", "o_orderpriority", limit=3, sort="value_asc",
                     filter_column="o_orderstatus", filter_value="F")
    return money(Q.answer(df, profile, q), "value", places=4)


@query("plan_trend", """
    WITH p AS (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    e AS (SELECT arg_min(value, period) AS f, arg_max(value, period) AS l FROM p)
    SELECT round(f, 2) AS first_value, round(l, 2) AS last_value, round((l - f) * 100 / abs(f), 2) AS change_pct,
           (SELECT period FROM p ORDER BY value DESC, period LIMIT 1) AS peak_period FROM e""")
def plan_trend(spark, sf):
    df, profile = orders_profile(spark, sf)
    rows = Q.answer(df, profile, QuestionSpec("trend", "o_totalprice", "sum"))
    return money(Q.trend_answer(rows), "first_value", "last_value")


@query("plan_distribution", """
    SELECT 'Minimum' AS statistic, min(o_totalprice) AS value FROM orders
    UNION ALL SELECT '25th percentile', round(quantile_cont(o_totalprice, 0.25), 4) FROM orders
    UNION ALL SELECT 'Median', round(median(o_totalprice), 4) FROM orders
    UNION ALL SELECT 'Mean', round(avg(o_totalprice), 4) FROM orders
    UNION ALL SELECT '75th percentile', round(quantile_cont(o_totalprice, 0.75), 4) FROM orders
    UNION ALL SELECT 'Maximum', max(o_totalprice) FROM orders""")
def plan_distribution(spark, sf):
    df, profile = orders_profile(spark, sf)
    return money(Q.answer(df, profile, QuestionSpec("distribution", "o_totalprice")), "value", places=4)


@query("plan_aggregate", "SELECT round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority = '5-LOW'")
def plan_aggregate(spark, sf):
    df, profile = orders_profile(spark, sf)
    q = QuestionSpec("aggregate", "o_totalprice", "sum", filter_column="o_orderpriority", filter_value="5-LOW")
    return money(Q.answer(df, profile, q), "value")


# --- analysis and insights ---------------------------------------------------


def analysis_of(spark, sf, limits, headlines, shown):
    ready = prepare(messy_orders(spark, sf))
    df, profile = ready.df, ready.profile
    analysis = B.analyze(df, profile, limits)
    specs = K.discover_kpis(profile, headlines)
    kpis = B.frozen(K.kpi_table(df, specs, compare=(profile.primary_date, profile.grain()), limit=shown))
    return profile, analysis, kpis, ready.report


def full_analysis(spark, sf):
    """Every figure, for claims to be checked against."""
    return analysis_of(spark, sf, B.EVERYTHING, None, None)


def summary_analysis(spark, sf):
    """The figures that a summary shows."""
    return analysis_of(spark, sf, B.Limits(), K.HEADLINES, K.MAX_KPIS)


@query("analysis_bundle", """
    WITH src AS (SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS period, avg(o_totalprice) AS a, sum(o_orderkey)::DOUBLE AS b,
                        sum(o_custkey)::DOUBLE AS c, count(*) AS row_count FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
    num AS (SELECT *, row_number() OVER (ORDER BY period DESC) AS e, count(*) OVER () AS n FROM src),
    typ AS (SELECT median(row_count) AS t FROM num WHERE e > 1),
    pts AS (SELECT num.*, row_number() OVER (ORDER BY period) AS i, strftime(period, '%Y') || ' Q' || quarter(period) AS label
            FROM num, typ WHERE NOT (e = 1 AND n > 3 AND t > 0 AND row_count < 0.6 * t)),
    long AS (SELECT 'o_totalprice' AS subject, i, label, a AS v FROM pts UNION ALL SELECT 'o_orderkey', i, label, b FROM pts
             UNION ALL SELECT 'o_custkey', i, label, c FROM pts),
    tr AS (SELECT subject, count(*) AS n, arg_min(v, i) AS f, arg_max(v, i) AS l, max(v) AS b, min(v) AS w FROM long GROUP BY 1),
    med AS (SELECT *, median(v) OVER (PARTITION BY subject ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS x FROM (
            SELECT subject, i, label, round(v, 4) AS v FROM long)),
    z AS (SELECT *, (v - x) / stddev(v - x) OVER (PARTITION BY subject) AS z FROM med),
    odd AS (SELECT * FROM z WHERE abs(z) >= 2.5 ORDER BY abs(z) DESC LIMIT 8),
    val AS (SELECT 'o_orderstatus' AS subject, o_orderstatus AS label, avg(o_totalprice) AS v FROM orders GROUP BY 2
            UNION ALL SELECT 'o_orderpriority', o_orderpriority, avg(o_totalprice) FROM orders GROUP BY 2),
    rk AS (SELECT *, count(*) OVER w AS n, sum(v) OVER w AS total, row_number() OVER (PARTITION BY subject ORDER BY v, label) AS i,
                  row_number() OVER (PARTITION BY subject ORDER BY v DESC, label) AS r FROM val WINDOW w AS (PARTITION BY subject)),
    sg AS (SELECT subject, max(n) AS n, max(total) AS total, sum((2 * i - n - 1) * v) / (max(n) * sum(v)) AS gini,
                  sum(CASE WHEN r <= 3 THEN round(v * 100 / total, 2) END) AS three, max(v) AS lead FROM rk GROUP BY 1),
    ds AS (SELECT 'o_orderkey' AS subject, skewness(o_orderkey) AS s, kurtosis(o_orderkey) AS k FROM orders
           UNION ALL SELECT 'o_custkey', skewness(o_custkey), kurtosis(o_custkey) FROM orders
           UNION ALL SELECT 'o_totalprice', skewness(o_totalprice), kurtosis(o_totalprice) FROM orders)
    SELECT 'trend' AS analysis, subject, 'n_periods' AS figure, n::DOUBLE AS value FROM tr
    UNION ALL SELECT 'trend', subject, 'first_value', round(f, 2) FROM tr UNION ALL SELECT 'trend', subject, 'last_value', round(l, 2) FROM tr
    UNION ALL SELECT 'trend', subject, 'best_value', round(b, 2) FROM tr UNION ALL SELECT 'trend', subject, 'worst_value', round(w, 2) FROM tr
    UNION ALL SELECT 'trend', subject, 'change_pct', round((l - f) * 100 / abs(f), 2) FROM tr
    UNION ALL SELECT 'anomaly', subject || ' ' || label, 'value', round(v, 2) FROM odd
    UNION ALL SELECT 'anomaly', subject || ' ' || label, 'expected', round(x, 2) FROM odd
    UNION ALL SELECT 'anomaly', subject || ' ' || label, 'z_score', round(z, 2) FROM odd
    UNION ALL SELECT 'segment', subject, 'n_categories', n FROM sg UNION ALL SELECT 'segment', subject, 'total', round(total, 2) FROM sg
    UNION ALL SELECT 'segment', subject, 'gini', round(gini, 4) FROM sg WHERE n > 2
    UNION ALL SELECT 'segment', subject, 'concentration_pct', round(three, 2) FROM sg
    UNION ALL SELECT 'segment', subject, 'leader_value', round(lead, 2) FROM sg
    UNION ALL SELECT 'distribution', subject, 'skew', round(s, 3) FROM ds UNION ALL SELECT 'distribution', subject, 'kurtosis', round(k, 3) FROM ds""")
def analysis_bundle(spark, sf):
    facts = B.bundle_facts(B.analyze(*orders_profile(spark, sf)))
    places = F.when(F.col("figure").isin("skew", "kurtosis"), 3).when(F.col("figure") == "gini", 4).otherwise(2)
    # Halves as in SQL: the figures have four digits already.
    return facts.withColumn("value", F.when(places == 3, F.round("value", 3)).when(places == 4, F.round("value", 4)).otherwise(F.round("value", 2)))


@query("insights")
def insights(spark, sf):
    return I.insights(*summary_analysis(spark, sf))


@query("evidence_index")
def evidence_index(spark, sf):
    return I.evidence_index(*full_analysis(spark, sf))


@query("evidence_lookup", """
    SELECT o_orderkey AS claim_id, o_orderkey % 3 <> 2 AS accepted,
           CASE o_orderkey % 3 WHEN 0 THEN 'Total Revenue' WHEN 1 THEN 'Return Rate' END AS metric FROM orders""")
def evidence_lookup(spark, sf):
    """Every order makes a claim; a third of them cites a figure nobody computed."""
    key = F.col("o_orderkey")
    claims = table(spark, sf, "orders").select(
        key.alias("claim_id"), F.lit("A claim").alias("title"),
        F.concat(F.lit("The figures of the table as a whole support order "), key.cast("string")).alias("body"),
        F.when(key % 3 == 0, F.array(F.lit("`total  REVENUE`"))).when(key % 3 == 1, F.array(F.lit("return r")))
        .otherwise(F.array(F.lit("margin of error"))).alias("refs"))
    evidence = B.stored(I.evidence_index(*full_analysis(spark, sf)), "evidence")
    out = I.resolve_claims(claims, evidence)
    return out.select("claim_id", "accepted", F.get("evidence", F.lit(0)).alias("metric"))


@query("dataset_summary")
def dataset_summary(spark, sf):
    profile, analysis, kpis, _ = summary_analysis(spark, sf)
    return I.dataset_summary(profile, kpis, analysis)


# --- file sources ------------------------------------------------------------


def written_lines(df: DataFrame, label: str, header: str, line) -> str:
    """Writes one raw text line per row below the shared folder, with a header line per file."""
    path = new_path(df.sparkSession, label)
    rows = df.select(line.alias(header))
    rows.write.option("header", True).option("sep", "\x01").option("quote", "\x00").option("emptyValue", "").csv(path)
    return path


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
CUSTOMER_SQL = "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment FROM customer"


def parts(df: DataFrame):
    return [F.lpad(F.col("c_custkey").cast("string"), 8, "0"), F.col("c_name"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment")]


@query("ingest_csv_strings", CUSTOMER_SQL)
def ingest_csv_strings(spark, sf):
    df = table(spark, sf, "customer")
    path = written_lines(df, "strings", "id;name;nation;segment", F.concat_ws(";", *parts(df)))
    return delimited.read_delimited(spark, path).df


@query("ingest_null_tokens", """
    SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN NULL
           WHEN c_custkey % 5 = 3 THEN 'nAn' ELSE c_mktsegment END AS segment FROM customer""")
def ingest_null_tokens(spark, sf):
    df = table(spark, sf, "customer")
    k = F.col("c_custkey") % 5
    token = F.when(k == 0, "N/A").when(k == 1, "Missing").when(k == 2, "#DIV/0!").when(k == 3, "nAn").otherwise(F.col("c_mktsegment"))
    path = written_lines(df, "tokens", "id|segment", F.concat_ws("|", parts(df)[0], token))
    return delimited.read_delimited(spark, path).df


@query("ingest_header_repair", """
    SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS "row id", c_name AS name, CAST(c_nationkey AS VARCHAR) AS name_1,
           c_mktsegment AS column_4 FROM customer""")
def ingest_header_repair(spark, sf):
    df = table(spark, sf, "customer")
    path = written_lines(df, "header", " row   id ,name,name,", F.concat_ws(",", *parts(df)))
    return delimited.read_delimited(spark, path).df


@query("ingest_ragged", """
    SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_name AS name,
           CASE WHEN c_custkey % 4 <> 1 THEN CAST(c_nationkey AS VARCHAR) END AS nation,
           CASE WHEN c_custkey % 4 <> 1 THEN c_mktsegment END AS segment FROM customer""")
def ingest_ragged(spark, sf):
    df = table(spark, sf, "customer")
    k, p = F.col("c_custkey") % 4, parts(df)
    line = F.when(k == 1, F.concat_ws(",", *p[:2])).when(k == 2, F.concat_ws(",", *p, F.lit("surplus"), F.lit("x"))).otherwise(F.concat_ws(",", *p))
    return delimited.read_delimited(spark, written_lines(df, "ragged", "id,name,nation,segment", line)).df


@query("ingest_ragged_count", "SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 4 IN (1, 2)) AS ragged FROM customer")
def ingest_ragged_count(spark, sf):
    df = table(spark, sf, "customer")
    k, p = F.col("c_custkey") % 4, parts(df)
    line = F.when(k == 1, F.concat_ws(",", *p[:2])).when(k == 2, F.concat_ws(",", *p, F.lit("surplus"))).otherwise(F.concat_ws(",", *p))
    parsed = delimited.read_delimited(spark, written_lines(df, "ragged", "id,name,nation,segment", line))
    return parsed.ragged.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_ragged").alias("ragged"))


@query("ingest_drop_empty_rows", CUSTOMER_SQL + " WHERE c_custkey % 6 <> 0")
def ingest_drop_empty_rows(spark, sf):
    df = table(spark, sf, "customer")
    line = F.when(F.col("c_custkey") % 6 == 0, F.lit("\t-\t\tNA")).otherwise(F.concat_ws("\t", *parts(df)))
    return delimited.read_delimited(spark, written_lines(df, "empty", "id\tname\tnation\tsegment", line)).df


@query("typed_round_trip", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def typed_round_trip(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return sinks.read_table(spark, sinks.write_table(df, new_path(spark, "typed")))


@query("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return delimited.read_delimited(spark, sinks.write_csv(df, new_path(spark, "csv"))).df


@query("csv_round_trip_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS text_md5, length(text) AS n FROM documents")
def csv_round_trip_documents(spark, sf):
    """Whole texts, with all their line breaks, quotes and delimiters."""
    df = table(spark, sf, "documents").select("doc_id", "text")
    back = delimited.read_delimited(spark, sinks.write_csv(df, new_path(spark, "csv"))).df
    return back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("n"))


@query("csv_round_trip_conversations", """
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role,
           md5(text || ', "said" by;' || chr(10) || '"' || role || '"' || chr(9) || '|') AS text_md5 FROM conversations""")
def csv_round_trip_conversations(spark, sf):
    df = table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", F.lit(', "said" by;\n"'), "role", F.lit('"\t|')).alias("text"))
    back = delimited.read_delimited(spark, sinks.write_csv(df, new_path(spark, "csv"))).df
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("preview_total", "SELECT count(*) AS total, least(count(*), 25) AS shown FROM orders")
def preview_total(spark, sf):
    shown, total = sinks.preview_with_total(table(spark, sf, "orders"))
    return shown.agg(F.lit(total).cast("bigint").alias("total"), F.count(F.lit(1)).alias("shown"))


@query("kpi_sources", """
    SELECT 'buyers' AS kpi_id, 'o_custkey' AS source_columns, 'rules' AS source
    UNION ALL SELECT 'middle_order', 'o_totalprice', 'rules' UNION ALL SELECT 'order_value', 'o_totalprice', 'rules'
    UNION ALL SELECT 'record_count', '', 'rules' UNION ALL SELECT 'total_revenue', 'o_totalprice', 'rules'
    UNION ALL SELECT DISTINCT 'urgent_rate', 'urgent', 'rules' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def kpi_sources(spark, sf):
    out = K.kpi_table(flagged_orders(spark, sf), KPIS)
    return out.select("kpi_id", F.array_join("source_columns", ",").alias("source_columns"), "source")


@query("report_tables")
def report_tables(spark, sf):
    df, profile = orders_profile(spark, sf)
    analysis = B.analyze(df, profile)
    kpis = K.kpi_table(df, K.discover_kpis(profile), limit=K.MAX_KPIS)
    sheets = sinks.report_tables(df, kpis, analysis, G.data_dictionary(spark, profile))
    counts = [t.agg(F.lit(n).alias("sheet"), F.count(F.lit(1)).alias("n_rows")) for n, t in sheets.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
