"""An untyped order table: typed columns rendered the way exports render them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import table

# The typed source the renderings below have to be read back to.
SOURCE_SQL = """
base AS (
  SELECT o_orderkey AS key, o_orderkey % 10 AS k, o_orderdate, o_totalprice, o_orderstatus,
         c_acctbal, c_mktsegment
  FROM orders JOIN customer ON o_custkey = c_custkey
),
messy AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE key % 50 = 0)
"""


def source(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 10).alias("k"), "o_orderdate", "o_totalprice",
        "o_orderstatus", "c_acctbal", "c_mktsegment")


def money(c: Column) -> Column:
    text = F.concat(F.lit("$"), F.format_number(F.abs(c), 2))
    return F.when(c < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def rendered(base: DataFrame) -> DataFrame:
    """Every column as text, with mixed layouts, symbols, units, blanks and cases."""
    k, key, segment = F.col("k"), F.col("key"), F.col("c_mktsegment")
    return base.select(
        F.concat(F.lit("ORD-"), key.cast("string")).alias("order_id"),
        F.when(k == 3, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("order_date"),
        F.when(k != 7, money(F.col("o_totalprice"))).alias("revenue"),
        money(F.col("c_acctbal")).alias("balance"),
        F.concat(((key % 4) * 5).cast("string"), F.lit("%")).alias("discount_pct"),
        F.concat((key % 50).cast("string"), F.lit(" kg")).alias("weight"),
        F.when(k == 1, F.upper(segment)).when(k == 2, F.lower(segment))
        .when(k == 4, F.concat(F.lit("  "), segment, F.lit(" "))).when(k != 9, segment).alias("segment"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("returned"),
        F.lit(None).cast("string").alias("empty"),
    )


def messy_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered orders with every fiftieth order exported twice."""
    base = source(spark, folder)
    copies = F.when(F.col("key") % 50 == 0, F.lit(2)).otherwise(F.lit(1))
    repeated = base.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    return rendered(repeated)
