import random

import pytest
from pyspark.sql import functions as F

from tabscope.operators import insights as I, kpi as K
from tabscope.operators.clean import CleaningReport
from tabscope.operators.profile import profile_table
from tabscope.plans import bundle as B
from tabscope.queries import QUERIES


def brute(key, figures):
    if key in figures:
        return figures[key]
    near = [m for k, m in figures.items() if key and (key in k or k in key)]
    return near[0] if len(near) == 1 else None


def test_labels_against_plain_search(spark):
    rng = random.Random(7)
    words = ["revenue", "a", "top", "3", "share", "it", "rate", "of", "x", "best month for", "é", "outliers"]
    figures = {}
    while len(figures) < 400:
        key = " ".join(rng.choices(words, k=rng.randint(1, 4)))
        figures[key] = key.title()
    keys = set(list(figures)[::7])
    for k in list(figures):
        a = rng.randrange(len(k))
        keys.add(k[a : a + rng.randint(1, 12)])
        keys.add(k + rng.choice([" gross", "s", " 2024"]))
    keys |= {"", " ", "nothing like it", "q"}
    evidence = spark.createDataFrame([(k, m) for k, m in figures.items()], "key string, metric string")
    got = {r["key"]: r["metric"] for r in I.resolve_labels(spark.createDataFrame([(k,) for k in keys] * 3, "key string"), evidence).collect()}
    assert got == {k: m for k in keys if (m := brute(k, figures)) is not None}
    assert len(got) > 50


def test_claims_stay_whole(spark):
    evidence = spark.createDataFrame([("total revenue", "Total Revenue"), ("return rate", "Return Rate")], "key string, metric string")
    long = "x" * 60
    rows = [(1, "t", long, ["return rate", None, "Total  `Revenue`", "return rate"], "trend", None), (1, "t", long, ["total revenue"], None, "warning"),
            (2, "t", long, [], None, None), (3, "t", long, None, None, None), (4, None, long, ["return rate"], None, None), (5, "t", None, ["return rate"], None, None)]
    claims = spark.createDataFrame(rows, "claim_id int, title string, body string, refs array<string>, category string, severity string")
    got = sorted(((r["claim_id"], r["accepted"], tuple(r["evidence"]), r["category"], r["severity"]) for r in I.resolve_claims(claims, evidence).collect()), key=str)
    assert got == [
        (1, True, ("Return Rate", "Total Revenue"), "trend", "neutral"), (1, True, ("Total Revenue",), "summary", "warning"),
        (2, False, (), "summary", "neutral"), (3, False, (), "summary", "neutral"), (4, False, ("Return Rate",), "summary", "neutral"),
        (5, False, ("Return Rate",), "summary", "neutral")]
    assert I.resolve_claims(claims.drop("category", "severity").limit(0), evidence).count() == 0


def test_figures_beyond_the_summary_are_evidence(spark):
    """True claims about the seventh dimension, the fifth measure and the sixth gap."""
    k = F.col("id")
    df = spark.range(4000).select(
        *[F.concat(F.lit("v"), (k * (i + 3)) % (i + 3 + 1)).alias(f"region_{c}") for i, c in enumerate("abcdefgh")],
        *[((k * (i + 7)) % 101 + k / 100).alias(f"amount_{c}") for i, c in enumerate("abcde")],
        F.timestamp_seconds(k * 86400 + 1_600_000_000).cast("timestamp_ntz").alias("order_date"))
    profile = profile_table(df, duplicates=False)
    report = CleaningReport(4000, 14, 0, missing=[(f"gap_{i}", 10, 0.25, "left missing") for i in range(9)])
    kpis = K.kpi_table(df, K.discover_kpis(profile))
    part = {r["metric"] for r in I.evidence_index(profile, B.analyze(df, profile), kpis, report, gaps=5).collect()}
    full = {r["metric"] for r in I.evidence_index(profile, B.analyze(df, profile, B.EVERYTHING), kpis, report).collect()}
    assert part < full
    assert sum(m.startswith("Top Region") for m in part) == 5 < sum(m.startswith("Top Region") for m in full)
    assert sum(m.endswith("change over period") for m in part) == 3 < sum(m.endswith("change over period") for m in full)
    assert sum(m.endswith("missing values") for m in full) == 9


@pytest.fixture(scope="module")
def spiky(spark, tmp_path_factory):
    """Forty months of orders; six of them, apart from each other, have far larger orders."""
    folder = str(tmp_path_factory.mktemp("spiky"))
    k = F.col("id")
    spark.range(40).select(
        k.alias("c_custkey"), (100 + k * 7 % 31).cast("double").alias("c_acctbal"),
        F.element_at(F.array(*map(F.lit, ["RAIL", "ROAD", "WATER"])), (k % 3 + 1).cast("int")).alias("c_mktsegment"),
    ).write.parquet(f"{folder}/customer.parquet")
    month, price = F.floor(k / 40), 1000 + k * 13 % 17 + F.floor(k / 40) % 3
    spark.range(1600).select(
        k.alias("o_orderkey"), (k * 11 % 40).alias("o_custkey"), F.when(k % 3 == 0, "F").otherwise("O").alias("o_orderstatus"),
        F.when(month % 6 == 4, price * 20).otherwise(price).cast("double").alias("o_totalprice"),
        F.add_months(F.lit("2020-01-01").cast("date"), month.cast("int")).cast("timestamp_ntz").alias("o_orderdate"),
    ).write.parquet(f"{folder}/orders.parquet")
    return folder


def whole_index(metrics):
    spikes = {m for m in metrics if m.startswith("Revenue in ")}
    assert spikes == {f"Revenue in {y}-{m}" for y in (2020, 2021, 2022) for m in ("05", "11")}, spikes
    for column in ("Revenue", "Balance", "Weight", "Discount Pct"):
        assert {f"{column} change over period", f"Best month for {column}", f"Worst month for {column}"} <= metrics
    assert {"Total Orders", "Total Revenue", "Total Balance", "Total Weight", "Average Discount Pct", "Average Order Value", "Return Rate"} <= metrics


def test_index_query_has_every_figure(spark, spiky):
    """The fourth measure, the seventh KPI and the sixth odd month of a measure are evidence."""
    whole_index({r["metric"] for r in QUERIES["evidence_index"](spark, spiky).collect()})


def test_lookup_query_searches_every_figure(spark, spiky, monkeypatch):
    seen, resolve = [], I.resolve_claims
    monkeypatch.setattr(I, "resolve_claims", lambda claims, evidence: seen.append(evidence) or resolve(claims, evidence))
    got = {(r["claim_id"] % 3, r["accepted"], r["metric"]) for r in QUERIES["evidence_lookup"](spark, spiky).collect()}
    assert got == {(0, True, "Total Revenue"), (1, True, "Return Rate"), (2, False, None)}
    whole_index({r["metric"] for r in seen[0].collect()})
    claims = spark.createDataFrame([(1, "t", "The rebates of this shop are about the same in all years.", ["Average Discount Pct"]),
                                    (2, "t", "Orders of November 2022 were far larger than those around.", ["`revenue  in 2022-11`"])],
                                   "claim_id int, title string, body string, refs array<string>")
    assert all(r["accepted"] for r in resolve(claims, seen[0]).collect())
