import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from tabscope.functions.text import compact_number, format_value, humanize, period_label
from tabscope.operators import aggregate as A, catalogue as G, insights as I, kpi as K, segments as SG, timeseries as TS, views as V
from tabscope.plans import bundle as B, questions as Q
from tabscope.sources import delimited, sinks
from tabscope.specs import Filter, KpiSpec, QuestionSpec, SpecError, ViewSpec


@pytest.fixture(scope="module")
def story(prepared):
    analysis = B.analyze(prepared.df, prepared.profile)
    kpis = B.frozen(K.kpi_table(prepared.df, K.discover_kpis(prepared.profile), compare=("order_date", "month"), limit=K.MAX_KPIS))
    return analysis, kpis


def test_kpis(story):
    got = {r["kpi_id"]: r for r in story[1].collect()}
    assert got["total_revenue"]["value"] == pytest.approx(7712.25) and got["total_revenue"]["formatted_value"] == "$7.7K"
    assert got["return_rate"]["value"] == pytest.approx(28.5714) and got["return_rate"]["is_favorable"] is True
    assert got["record_count"]["direction"] == "up" and got["record_count"]["change_pct"] == 50.0
    assert got["total_revenue"]["period_label"] == "vs previous month (by order_date)"
    assert len(got) == 6


def test_previous_window_swallows_a_gap(spark):
    days = [("2024-01-10", 1.0), ("2024-02-10", 2.0), ("2024-04-10", 4.0), ("2024-04-11", 4.0)]
    df = spark.createDataFrame(days, "d string, v double").withColumn("d", F.col("d").cast("timestamp_ntz"))
    row = K.kpi_table(df, [KpiSpec("t", "T", measure="v")], compare=("d", "month")).first()
    assert (row["previous_value"], row["change"]) == (2.0, 6.0)


def test_no_comparison_under_filters(prepared):
    row = K.kpi_table(prepared.df, [KpiSpec("t", "T", measure="revenue")], [Filter("region", "in", ["Alps"])],
                      compare=("order_date", "month")).first()
    assert row["value"] == pytest.approx(1683.0) and row["change"] is None


def test_margin_and_proposals(spark, prepared):
    df = spark.range(40).select((100 + 4.0 * F.col("id")).alias("revenue"), (25 + 1.0 * F.col("id")).alias("profit"))
    row = K.kpi_table(df, [KpiSpec("m", "M", "percent", numerator="profit", denominator="revenue", multiply=100.0)]).first()
    assert row["value"] == pytest.approx(25.0)
    known = [KpiSpec("total_revenue", "Total Revenue", "currency", 95, measure="revenue")]
    merged, rejected = K.merge_proposals(known, [
        KpiSpec("", "Revenue per Unit", numerator="revenue", denominator="quantity"),
        KpiSpec("", "Ghost", measure="missing"), KpiSpec("", "Total revenue", priority=99, measure="quantity")], prepared.profile)
    assert {s.id for s in merged} == {"total_revenue", "revenue_per_unit"} and rejected == [("ghost", "not a measure: missing")]
    assert next(s for s in merged if s.id == "total_revenue").measure == "revenue"


def test_view_rules(prepared):
    p = prepared.profile
    for bad in ({"type": "line", "x": "order_date"}, {"type": "heatmap", "columns": ["revenue"]}, {"type": "scatter", "x": "revenue"},
                {"type": "bar", "x": "region", "aggregation": "count_distinct"}, {"type": "cake"}):
        with pytest.raises(SpecError):
            V.view_from_dict(bad, p)
    assert V.check_view(ViewSpec("a", "bar", x="order_id", y="revenue"), p) == (False, "order_id identifies rows")
    assert V.check_view(ViewSpec("a", "pie", x="region", y="revenue", aggregation="avg"), p)[0] is False
    assert V.check_view(ViewSpec("a", "bar", x="region", aggregation="count"), p)[0] is True
    assert V.allowed_types(p, "order_date", "revenue") == ["line", "area", "histogram", "table"]
    merged, notes = V.merge_views(V.recommend_views(p), [{"type": "bar", "x": "product", "y": "quantity"}, {"type": "bar", "x": "nope"}], p)
    assert {n[1] for n in notes} == {True, False} and len(merged) <= V.MAX_PRIMARY + V.MAX_SECONDARY


def test_every_recommended_view_returns_rows(prepared):
    views = V.recommend_views(prepared.profile)
    assert [v.type for v in views] == ["line", "bar", "donut", "line", "bar", "histogram", "heatmap", "table"]
    for v in views:
        assert V.execute_view(prepared.df, v).count() > 0, v.id


def test_questions(prepared):
    df, p = prepared.df, prepared.profile
    assert Q.answer(df, p, QuestionSpec("rank", "revenue", "sum", "region", limit=1)).first()["label"] == "Lakes"
    assert Q.answer(df, p, QuestionSpec("aggregate", "product", "sum")).first()[0] == 14
    assert Q.checked(QuestionSpec("rank", "revenue"), p).intent == "aggregate"
    assert Q.checked(QuestionSpec("trend", "revenue", limit=900), p).date == "order_date"
    assert Q.answer(df, p, QuestionSpec("distribution", "revenue")).count() == 6
    trend = Q.trend_answer(Q.answer(df, p, QuestionSpec("trend", "revenue", "sum", grain="month"))).first()
    assert trend["change_pct"] == pytest.approx(-74.78)


def test_insights_and_claims(spark, prepared, story):
    analysis, kpis = story
    found = {r["insight_id"]: r for r in I.insights(prepared.profile, analysis, kpis, prepared.report).collect()}
    assert {"headline_trend", "segment_region", "data_quality", "recommendation"} <= set(found)
    assert found["segment_region"]["severity"] == "warning"
    evidence = B.frozen(I.evidence_index(prepared.profile, analysis, kpis, prepared.report))
    long = "Revenue is carried by few regions, as the figures of the table show."
    claims = spark.createDataFrame(
        [(1, "t", long, ["`Total  Revenue`"]), (2, "t", long, ["invented metric"]), (3, "t", "short", ["Total Revenue"]),
         (4, "t", long, ["return rat"]), (5, "t", long, ["top 3"])], "claim_id int, title string, body string, refs array<string>")
    got = {r["claim_id"]: (r["accepted"], r["evidence"]) for r in I.resolve_claims(claims, evidence).collect()}
    assert got[1] == (True, ["Total Revenue"]) and got[2] == (False, []) and got[3][0] is False
    assert got[4] == (True, ["Return Rate"]) and got[5] == (False, [])
    # Every finding rests on figures that the index has.
    figures = {r["metric"] for r in evidence.collect()}
    found = I.insights(prepared.profile, analysis, kpis, prepared.report).collect()
    assert found and all(r["evidence"] and set(r["evidence"]) <= figures for r in found), [(r["insight_id"], r["evidence"]) for r in found]
    assert I.dataset_summary(prepared.profile, kpis, analysis).first()[0].startswith("14 rows, 8 columns, 2023-03-02 to 2023-09-09")


def test_catalogue(spark, prepared):
    options = G.filter_options(prepared.df, prepared.profile)
    assert options.where("kind = 'date_range'").count() == 1 and options.where("column = 'region'").count() == 5
    words = {r["column"]: r["example_values"] for r in G.data_dictionary(spark, prepared.profile).collect()}
    assert words["product"] == "Cabin, Tent, Loft"
    assert G.model_measures(spark, K.discover_kpis(prepared.profile)).where("expression = 'SUM(revenue)'").count() == 1


def test_formats(spark):
    df = spark.createDataFrame([(0.5,), (150.0,), (1234.0,), (-2500000.0,), (7e12,), (None,)], "v double")
    assert [r[0] for r in df.select(compact_number(F.col("v"))).collect()] == ["0.50", "150", "1.2K", "-2.5M", "7T", None]
    assert [r[0] for r in df.select(format_value(F.col("v"), "decimal")).collect()][-1] == "—"
    assert humanize("total_revenue_usd") == "Total Revenue USD" and humanize("SKU") == "SKU"
    day = spark.sql("select timestamp_ntz'2024-05-06' t")
    labels = [day.select(period_label(F.col("t"), g, s)).first()[0] for g, s in
              (("year", "analysis"), ("quarter", "analysis"), ("month", "analysis"), ("week", "analysis"), ("month", "view"), ("day", "view"))]
    assert labels == ["2024", "2024 Q2", "2024-05", "2024-05-06", "May 2024", "06 May 2024"]


# --- files -------------------------------------------------------------------


def read(spark, tmp_path, data):
    path = tmp_path / "in.csv"
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return delimited.read_delimited(spark, str(path))


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, d):
    p = read(spark, tmp_path, f"id{d}name\n007{d}a\n008{d}b\n")
    assert p.delimiter == d and sorted(rows_of(p.df)) == [("007", "a"), ("008", "b")]


def test_encodings_quotes_and_header(spark, tmp_path):
    assert read(spark, tmp_path, b"\xef\xbb\xbfid,name\n1,a\n").columns == ["id", "name"]
    p = read(spark, tmp_path, "id,name\n1,café – €5\n".encode("cp1252"))
    assert p.encoding == "windows-1252" and rows_of(p.df) == [("1", "café – €5")]
    p = read(spark, tmp_path, 'id,,id,Unnamed: 3\n1,"a ""b"", c",x,y\n')
    assert p.columns == ["id", "column_2", "id_1", "column_4"] and len(p.notes) == 3
    assert rows_of(p.df) == [("1", 'a "b", c', "x", "y")]


def test_ragged_blank_and_empty_lines(spark, tmp_path):
    p = read(spark, tmp_path, "a,b,c\n1,2,3\n4,5\n\n6,7,8,9\n-,NA,\n")
    assert rows_of(p.df.orderBy("a")) == [("1", "2", "3"), ("4", "5", None), ("6", "7", "8")]
    assert p.ragged.where("is_ragged").count() == 2
    with pytest.raises(SpecError):
        read(spark, tmp_path, "\n\n")


def test_line_breaks_inside_quotes(spark, tmp_path):
    p = read(spark, tmp_path, 'n,t\n1,"two\nlines, ""so"""\n2,"x"\n\n3,"a\n\n\nb"\n')
    assert rows_of(p.df.orderBy("n")) == [("1", 'two\nlines, "so"'), ("2", "x"), ("3", "a\n\n\nb")]


def test_records_across_blocks(spark, tmp_path):
    """Blocks of a few bytes cut lines, quotes and records everywhere."""
    import csv
    import random
    random.seed(3)
    rows = [(str(i), "".join(random.choice('ab,"\n;') for _ in range(random.randint(1, 25))) + "z") for i in range(200)]
    with open(tmp_path / "in.csv", "w", newline="") as f:
        writer = csv.writer(f, lineterminator="\n")
        writer.writerows([("i", "t"), *rows])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    try:
        p = delimited.read_delimited(spark, str(tmp_path / "in.csv"))
        assert delimited.file_lines(spark, str(tmp_path / "in.csv")).rdd.getNumPartitions() > 20
        assert sorted(rows_of(p.df)) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_over_many_blocks_are_put_together_once(spark, tmp_path):
    """Records that fill several blocks, in two files; after one pass over the lines, results come from whole records."""
    import csv
    import random
    random.seed(5)
    rows = [(str(i), "".join(random.choice('ab,"\n\n;') for _ in range(random.choice([5, 40, 900]))) + "z") for i in range(80)]
    folder = tmp_path / "two"
    folder.mkdir()
    for name, part in (("1.csv", rows[:50]), ("2.csv", rows[50:])):
        with open(folder / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows([("i", "t"), *part])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    try:
        p = delimited.read_delimited(spark, str(folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(rows_of(p.df)) == sorted(rows)
    assert p.df.inputFiles() and not any(f.endswith(".csv") for f in p.df.inputFiles())


def test_encoding_is_judged_by_all_lines(spark, tmp_path):
    p = read(spark, tmp_path, b"a,b\n" + b"x,2\n" * 3000 + "3,ü–\n".encode("cp1252"))
    assert p.encoding == "windows-1252" and p.df.where("a = '3'").first()["b"] == "ü–"
    assert read(spark, tmp_path, b"a,b\n1,\x81\n").encoding == "ISO-8859-1"


def test_headers_are_unique(spark, tmp_path):
    assert read(spark, tmp_path, "a,a,a_1\n1,2,3\n").columns == ["a", "a_2", "a_1"]
    p = read(spark, tmp_path, "A,a\n1,2\n")
    assert p.columns == ["A", "a_1"] and rows_of(p.df) == [("1", "2")]


def test_files_that_cannot_be_read(spark, tmp_path):
    for data in ("a,b\n", "a,b\n\n", "a,b\n-,NA\n", ""):
        with pytest.raises(SpecError):
            read(spark, tmp_path, data)
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "1.csv").write_text("x,y\n1,2\n")
    (folder / "2.csv").write_text("y,x\n1,2\n")
    with pytest.raises(SpecError):
        delimited.read_delimited(spark, str(folder))


def test_notes(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b,c\n1,2,\n3,4,,5\n6,7,\n")
    p = delimited.read_delimited(spark, str(path), max_rows=2)
    assert "only the first 2 rows were read" in p.notes
    assert {"1 line(s) had more or fewer values than the header", "column c has no values"} <= set(p.noticed())


def test_sinks(spark, tmp_path, prepared, story):
    analysis, kpis = story
    sheets = sinks.report_tables(prepared.df, kpis, analysis, G.data_dictionary(spark, prepared.profile))
    paths = sinks.write_results(sheets, str(tmp_path / "out"))
    assert spark.read.json(paths["kpis"]).count() == 6 and spark.read.json(paths["data"]).count() == 14
    csv = delimited.read_delimited(spark, sinks.write_csv(prepared.df, str(tmp_path / "csv")))
    assert csv.df.count() == 14 and sinks.preview(prepared.df, 500).count() == 14
    shown, total = sinks.preview_with_total(prepared.df, 5)
    assert (shown.count(), total) == (5, 14)


# --- nothing is cut unasked ----------------------------------------------------


def test_many_periods_categories_and_kpis(spark):
    days = spark.range(6000).select(F.expr("timestamp_ntz'1990-01-01' + make_dt_interval(int(id))").alias("d"), F.lit(1.0).alias("v"))
    assert TS.time_series(days, "d", "v", "sum", "day").count() == 6000
    assert K.comparison_window(days, "d", "day")[1].year == 2006
    wide = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("k"), F.lit(1.0).alias("v"))
    row = SG.segment_summary(SG.dimension_values(wide, ["k"], "v", "sum")).first()
    assert (row["n_categories"], row["total"]) == (3000, 3000.0)
    assert A.by_dimension(wide, "k", "v", "sum", limit=None).count() == 3000
    specs = [KpiSpec(f"k{i}", f"K{i}", measure="v") for i in range(9)]
    assert K.kpi_table(wide, specs).count() == 9


def test_buckets_do_not_hang_on_the_time_zone(spark):
    df = spark.sql("select timestamp_ntz'2018-11-04 10:00:00' d")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {g: TS.time_series(df, "d", grain=g).select(F.col("period").cast("string")).first()[0] for g in ("day", "week", "month", "quarter", "year")}
            assert got == {"day": "2018-11-04 00:00:00", "week": "2018-10-29 00:00:00", "month": "2018-11-01 00:00:00",
                           "quarter": "2018-10-01 00:00:00", "year": "2018-01-01 00:00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_infinity_is_missing(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("inf"),), (float("nan"),), (float("-inf"),)], "v double")
    rows = A.histogram(df, "v", 3).collect()
    assert [r["count"] for r in rows] == [3, 3, 4] and rows[-1]["bin_end"] == 9.0
    for in_task in (10, 1000):
        assert A.scalar(df, "v", "median", in_task=in_task).first()[0] == 4.5


def test_scatter_does_not_hang_on_the_partitioning(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    one, other = (rows_of(A.scatter(df.repartition(n), "x", "y", limit=50)) for n in (2, 7))
    assert one == other
