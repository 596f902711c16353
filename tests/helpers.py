"""Small frames, and intervals as plain tuples."""

import pandas as pd
from pyspark.sql import types as T

S = 10**9


def samples(spark, times, values=None, unit=0):
    rows = [(unit, round(t * S), None if values is None else values[i]) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("t_ns", T.LongType()), T.StructField("v", T.DoubleType())]))


def iset(spark, pairs, **meta):
    rows = [(i, round(a * S), round(b * S), *(m[i] for m in meta.values())) for i, (a, b) in enumerate(pairs)]
    schema = "epoch_id int, start_ns long, end_ns long" + "".join(f", {k} string" for k in meta)
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return [(r.start_ns / S, r.end_ns / S) for r in df.orderBy("start_ns").collect()]


def frame(df, *order) -> pd.DataFrame:
    return df.orderBy(*order).toPandas()
