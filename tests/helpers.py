"""What several test modules use."""

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def texts(spark, *values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")
