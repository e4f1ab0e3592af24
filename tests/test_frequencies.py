"""The counted cells that profiles are read from."""

import datetime
import re

from pyspark.sql import functions as F

from tabscope.functions import coerce
from tabscope.operators import profile as P

SCHEMA = "label string, price double, units long, day timestamp_ntz"


def test_counting_neither_spells_out_numbers_nor_compiles_the_facts_of_long_texts(spark):
    counted = P.counted_cells(spark.createDataFrame([("a", 1.5, 1, None)], SCHEMA))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"cast\((number|whole|stamp)#\d+ as string\)", plan)
    # The patterns stand inside a lambda, which is not compiled into the loop over cells.
    assert re.search(r"THEN transform\(array\(", plan)


def test_cells_are_counted_by_trimmed_text_and_typed_value(spark):
    day, long = datetime.datetime(2024, 1, 2), "word, " * 60
    rows = [("a", 1.5, 1, day), (" a", 1.5, None, None), ("a ", -0.0, 1, day), ("\ta b", 0.0, 2, None), ("", float("nan"), 2, None),
            (None, float("inf"), None, None), (long, None, None, None), ("é", None, None, None), ("　", None, None, None)]
    counted = P.counted_cells(spark.createDataFrame(rows, SCHEMA))
    texts = {r["key"]: (r["n"], r["changed"]) for r in counted.where("position = 0").collect()}
    digest = next(k for k in texts if k.startswith("sha256:"))
    assert texts == {"a": (3, 2), "a b": (1, 1), "": (2, 1), "é": (1, 0), digest: (1, 1)}
    typed = {(r["position"], r["number"] if r["position"] == 1 else r["whole"] if r["position"] == 2 else r["stamp"]): r["n"]
             for r in counted.where("position > 0").collect()}
    assert typed == {(1, 1.5): 2, (1, 0.0): 2, (2, 1): 2, (2, 2): 2, (3, day): 2}
    assert counted.where("position = -1").first()["n"] == len(rows)


def test_long_texts_have_the_facts_of_short_ones(spark):
    long = "12,5% of $3 " * 30
    counted = P.counted_cells(spark.createDataFrame([(long, None, None, None)], SCHEMA)).where("position = 0").first()
    told = spark.createDataFrame([(long.strip(),)], "v string").select(
        coerce.fact_bits(F.col("v")).alias("mask"), P.word_count(F.col("v")).alias("words")).first()
    assert (counted["mask"], counted["words"], counted["length"]) == (told["mask"], told["words"], len(long.strip()))
