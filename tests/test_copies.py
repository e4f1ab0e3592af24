from collections import Counter

from pyspark.sql import functions as F

from tabscope.functions import bloom
from tabscope.operators import clean as C


def test_bitmaps_miss_no_key(spark):
    keys = spark.range(0, 6000, 3).select(F.xxhash64("id").alias("h"))
    bits = bloom.bits_for(2000)
    assert bits == 32768 and bloom.bits_for(0) == 32768 and bloom.bits_for(3000) == 65536 and bloom.bits_for(1 << 40) == bloom.MOST_BITS
    rows = spark.range(6000).withColumn("h", F.xxhash64("id"))
    got = bloom.with_may_hold(rows, bloom.bitmaps(keys, F.col("h"), bits), F.col("h"), bits, "may").collect()
    assert len(got) == 6000 and all(r["may"] for r in got if r["id"] % 3 == 0)
    assert sum(r["may"] for r in got if r["id"] % 3) < 500


def test_one_of_each_row_stays(spark):
    rows = [(i % 50, None if i % 4 else "x", float("nan") if i % 25 == 1 else i % 50 / 3, None) for i in range(90)]
    rows += [(None, "x", 0.0, "y"), (None, "x", -0.0, "y"), (None, "y", 0.0, "x"), (None, None, None, None), (None, None, None, None)] + [(7, "hot", 1.0, "h")] * 200
    df = spark.createDataFrame(rows, "a int, b string, c double, d string").repartition(4)
    counted = C.counted_rows(df)
    left = C.without_copies(df, counted)
    text = lambda d: Counter(str(tuple(0.0 if v == 0 else v for v in r)) for r in d.collect())
    assert text(left) == text(df.dropDuplicates())
    assert C.count_rows_and_missing(df, counted)["distinct_rows"] == df.distinct().count()
    assert C.without_copies(df.limit(0), C.counted_rows(df.limit(0))).count() == 0


def test_unique_rows_are_not_shuffled(spark):
    """The branch of rows without copies has no exchange but that of the broadcast."""
    df = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    df = df.union(df.where("id % 100 = 0"))
    plan = C.without_copies(df, C.counted_rows(df))._jdf.queryExecution().executedPlan().toString()
    # The first part of the union, up to the aggregate that drops copies.
    alone = plan[: plan.index("HashAggregate") if "HashAggregate" in plan else plan.index("Aggregate")]
    assert "hashpartitioning(id" not in alone and "BroadcastHashJoin" in alone and "Union" in alone
