"""Paths and helpers that test modules import by name."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def one_col(spark, values, name="x", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")
