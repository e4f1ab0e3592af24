import math
from collections import Counter

from pyspark.sql import functions as F

from tabscope.llm import mixing

SCHEMA = "doc_id long, source string, text string, slot int, _n int"


def check_plan(plan, units, period):
    """Every block within its window, every source within one block of its share at every slot."""
    rows = sorted(plan, key=lambda r: r["_slot"])
    assert [r["_slot"] for r in rows] == list(range(period))
    done = Counter()
    for t, r in enumerate(rows):
        who = r["_who"]
        assert r["_index"] == done[who]
        assert math.floor(done[who] * period / units[who]) <= t < math.ceil((done[who] + 1) * period / units[who])
        done[who] += 1
    assert done == units
    # A source's share drifts most just before and after one of its blocks.
    ran = {}
    for t, r in enumerate(rows):
        k = ran.get(r["_who"], 0)
        assert abs(k - t * units[r["_who"]] / period) < 1 and abs(k + 1 - (t + 1) * units[r["_who"]] / period) < 1
        ran[r["_who"]] = k + 1


def test_deviation_stays_below_one_block(spark):
    units = {0: 1, 1: 500, 2: 300, 3: 187, 4: 36}
    weights = spark.createDataFrame(list(units.items()), "_who int, _units int")
    check_plan(mixing.schedule(weights, 1024).collect(), units, 1024)


def test_five_thousand_sources(spark):
    sizes = spark.range(5000).select(F.col("id").cast("string").alias("_source"), F.lit(False).alias("_null"),
                                     F.when(F.col("id") == 0, 5000.0).otherwise(F.col("id") % 13 + 1.0).alias("_raw"))
    period = mixing.period_for(5000)
    weights = mixing.target_weights(sizes, period)
    units = {r["_who"]: r["_units"] for r in weights.collect()}
    assert sum(units.values()) == period and min(units.values()) >= 1
    whole = sizes.agg(F.sum("_raw")).first()[0]
    # Weights stay true to within a sixteenth and a rounding.
    assert abs(units[0] / period - 5000 / whole) < 0.07 * 5000 / whole
    check_plan(mixing.schedule(weights.select("_who", "_units"), period).collect(), units, period)


def test_given_weights(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 2 > 0, "b").alias("source"),
                                   F.col("id").cast("string").alias("text"))
    weights = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 1.0), ("z", 9.0), ("q", None)], "source string, weight double")
    got = mixing.mixed(docs, weights).collect()
    assert len(got) == 900 and all((r.slot is None) == (r.source is None) for r in got)
    mix = Counter(r.source for r in got if r.in_mix)
    assert mix["b"] == 150 and abs(mix["a"] - 50) <= 8 and mix[None] == 0


def test_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "a", "t", "mine", 5, "k", 9, 7)], "doc_id long, source string, text string, _source string, _null int, _key string, _range int, slot int")
    row = mixing.mixed(df).first()
    assert (row["_source"], row["_null"], row["_key"], row["_range"], row["slot"]) == ("mine", 5, "k", 9, 0)


def test_rows_stay_whole(spark):
    rows = [(i, "big", f"text {i}", 1, 2) for i in range(700)] + [(i, "small", None, 1, 2) for i in range(900, 960)]
    rows += [(None, None, "lost", 1, 2), (5, "", "", None, None)] + [(7, "same", "same", 0, 0)] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mixed(df)
    assert set(got.columns) == {*df.columns, "place", "in_mix"}
    have = got.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in have) == Counter(r[:3] for r in rows)
    assert max(Counter((r.slot, r.place) for r in have).values()) == 1
    by_slot = {}
    for r in have:
        by_slot.setdefault(r.slot, set()).add(r.source)
    assert all(len(s) == 1 for s in by_slot.values())
    inside = {r.slot for r in have if r.in_mix}
    assert inside == set(range(len(inside)))
    ordered = mixing.in_mixed_order(df)
    assert ordered.columns == df.columns and ordered.count() == len(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([(1, "only", "x", 0, 0)], SCHEMA)
    assert mixing.mixed(df.limit(0)).count() == 0
    assert [(r.slot, r.place, r.in_mix) for r in mixing.mixed(df).collect()] == [(0, 0, True)]


def test_more_sources_than_slots(spark):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("x").alias("text"))
    assert mixing.mixed(df, period=32).count() == 40
