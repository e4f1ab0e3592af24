import pytest
from helpers import rows_of, texts
from pyspark.sql import functions as F

from tabscope.operators import clean as C, profile as P, roles
from tabscope.plans.prepare import cleaned


def test_sales_table(prepared):
    df, profile, report = prepared.df, prepared.profile, prepared.report
    assert report.rows_before == 16 and report.rows_after == 14 == df.count() and report.duplicates_removed == 2
    assert df.agg(F.sum("revenue")).first()[0] == pytest.approx(7712.25)
    assert df.where("returned").count() == 4
    assert {r[0] for r in df.select("region").distinct().collect()} == {"Alps", "Coast", "Lakes", "Heath", "Unknown"}
    roles_by_name = {c.name: c.role for c in profile.columns}
    assert roles_by_name == {"order_id": "identifier", "order_date": "time", "region": "geo", "product": "dimension",
                             "revenue": "currency", "discount_pct": "percentage", "quantity": "quantity", "returned": "flag"}
    assert profile.primary_date == "order_date" and profile.primary_measure == "revenue" and profile.domain in ("sales", "ecommerce")
    assert df.where("order_id = 'B-103'").first()["order_date"].month == 4
    assert dict(df.dtypes)["order_date"] == "timestamp_ntz"


def test_audit_names_every_change(prepared):
    done = {(a[1], a[2]): a[3] for a in prepared.report.actions}
    assert done["trim_whitespace", "region"] == 1 and done["normalize_empty", "revenue"] == 1
    assert done["strip_currency", "revenue"] == 15 and done["parse_percent", "discount_pct"] == 16
    assert done["normalize_category", "region"] == 1 and done["drop_duplicates", None] == 2
    assert done["fill_missing", "region"] == 1
    assert [m[0] for m in prepared.report.missing] == ["region", "revenue"]


def test_lazy_and_staged_cleaning_agree(sales, prepared):
    lazy, report = cleaned(sales, staged=False)
    assert sorted(map(str, rows_of(lazy))) == sorted(map(str, rows_of(prepared.df)))
    assert report.actions == prepared.report.actions


def test_repeats_without_identifier_are_kept(spark):
    rows = [(c, s) for i in range(100) for c, s in (("A", "x"), ("B", "y"), ("A", "y"), ("C", "x"))]
    df, report = cleaned(spark.createDataFrame(rows, "country string, status string"))
    assert df.count() == 400 and report.duplicates_removed == 0 and any("kept" in w for w in report.warnings)


def test_mostly_missing_column_is_dropped(spark):
    df = spark.createDataFrame([(f"r{i}", "x" if i == 0 else None) for i in range(20)], "name string, rare string")
    out, report = cleaned(df)
    assert out.columns == ["name"] and report.dropped == ["rare"]


def test_numbers_are_never_imputed(spark):
    df = spark.createDataFrame([(f"id-{i}", None if i < 2 else f"{i}.5") for i in range(30)], "id string, revenue string")
    out, report = cleaned(df)
    assert out.where("revenue is null").count() == 2 and report.missing_after == 2


def test_spellings_merge_the_same_way_on_both_paths(spark):
    df = texts(spark, *["North", "north", "NORTH", "South", "south", "south"] * 5, "East", name="area")
    variants = C.spelling_variants(df, ["area"])
    assert rows_of(variants.select("value", "canonical").orderBy("value")) == [("North", "NORTH"), ("South", "south"), ("north", "NORTH")]
    small = C.apply_spellings(df, "area", variants, 3).groupBy("area").count()
    large = C.apply_spellings(df, "area", variants, C.LOOKUP_ROWS + 1).groupBy("area").count()
    assert sorted(rows_of(small)) == sorted(rows_of(large)) == [("East", 1), ("NORTH", 15), ("south", 15)]


def test_row_digest_separates_look_alikes(spark):
    df = spark.createDataFrame([("a", None, 0.0), ("a", "null", 0.0), ("a", "", -0.0), ("a", "", 0.0), (None, "a", 0.0)],
                               "x string, y string, z double")
    assert P.duplicate_count(df).first()["n_duplicates"] == 1
    counts = C.count_rows_and_missing(df)
    assert (counts["rows"], counts["distinct_rows"], counts["all1"], counts["dis0"]) == (5, 4, 1, 1)


# --- types and roles ---------------------------------------------------------


def types(df):
    return {c.name: c.inferred_type for c in P.profile_table(df, duplicates=False).columns}


def test_types(spark):
    rows = [(str(i % 2), f"2024010{i % 9 + 1}", f"{i}", "9" * 3 if i % 2 else "abc", f"note number {i} that is rather long, yes", None, f"19{i:06d}")
            for i in range(80)]
    df = spark.createDataFrame(rows, "bit string, stamp string, n string, half string, memo string, gone string, code string")
    assert types(df) == {"bit": "boolean", "stamp": "datetime", "n": "numeric", "half": "categorical", "memo": "text",
                         "gone": "empty", "code": "numeric"}


def test_typed_input(spark):
    df = spark.range(50).select(
        (F.col("id") % 2).alias("flagged"), (F.lit(20240101) + F.col("id") % 28).alias("day"), F.col("id").alias("n"),
        F.lit(None).cast("double").alias("void"), (F.col("id") > 10).alias("big"))
    got = types(df)
    assert got["flagged"] == "boolean" and got["day"] == "datetime" and got["n"] == "numeric" and got["big"] == "boolean"


def test_rating_is_no_percentage(spark):
    df = spark.range(200).select((F.col("id") % 5 + 1).cast("string").alias("satisfaction"),
                                 (F.col("id") * 1.1).cast("string").alias("conversions"), (F.col("id") / 300).cast("string").alias("churn_rate"))
    got = {c.name: c.role for c in P.profile_table(df, duplicates=False).columns}
    assert got == {"satisfaction": "dimension", "conversions": "quantity", "churn_rate": "percentage"}


def test_names():
    assert roles.match("total_orders", {"orders"})[0] == 2.0
    assert roles.match("conversions", {"conversion"})[0] == 1.0
    assert roles.match("unit_price", {"price", "unit_price"})[0] == pytest.approx(2.1)
    assert roles.guess_domain(["employee_id", "department", "salary"])[0] == "hr"
    assert roles.guess_domain(["foo", "salary"])[0] == "general"


def test_profile_reads_cells_once(spark, sales):
    """All statistics follow from one counted table, which one shuffle makes."""
    cells = sales.select("order_id", F.col("quantity").cast("double").alias("position"), F.lit("x").alias("text"))
    plan = P.counted_texts(cells, "position")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    counted = P.frequencies(sales)
    assert {r["position"]: r["n"] for r in counted.where("position = -1").collect()} == {-1: sales.count()}


def test_counted_statistics_equal_direct_ones(spark):
    df = spark.range(900).select(
        F.col("id"), (F.col("id") % 37 - 9).cast("double").alias("d"), (F.col("id") % 5).cast("decimal(9,2)").alias("m"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("$"), F.col("id") * F.col("id") % 101)).alias("t"),
        F.when(F.col("id") % 11 == 0, float("nan")).otherwise(F.sqrt("id")).alias("r"), (F.col("id") % 2).cast("int").alias("flag"),
        F.repeat(F.concat(F.col("id").cast("string"), F.lit("x")), 150).alias("long"))
    profile = P.profile_table(df)
    direct = {"id": F.col("id"), "d": F.col("d"), "m": F.col("m"), "t": F.expr("cast(substring(t, 2) as double)"),
              "r": F.when(~F.isnan("r"), F.col("r"))}
    for name, column in direct.items():
        got, want = profile.get(name).numeric, P.numeric_summary(df, {name: column})[name]
        assert profile.get(name).inferred_type == "numeric"
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-9), (name, k)
        assert profile.get(name).unique == df.select(column).distinct().where(column.isNotNull() if name in df.columns else F.lit(True)).na.drop().count()
    assert profile.get("flag").inferred_type == "boolean" and profile.get("flag").top_values == [("0", 450, 50.0), ("1", 450, 50.0)]
    # Long texts are counted by digest and shown as they are.
    assert profile.get("long").unique == 900 and profile.get("long").sample_values[0] == "0x" * 150
