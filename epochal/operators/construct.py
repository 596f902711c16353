"""Series, frames, tensors, groups and interval sets from plain arrays or columns, with the rules of their making.

Times are numbers of a unit and become whole nanoseconds, rounded half to even; pairs of time and value stay together when times
are put in order. A support restricts what is made; without one it is from the first to the last time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import unit_ns
from .intervals import normalize, union_all
from .joins import restrict


def _ns(t: Iterable[float], unit: str) -> list[int]:
    return np.rint(np.asarray(list(t), dtype=float) * unit_ns(unit)).astype(np.int64).tolist()


def _kept(rows: DataFrame, support: DataFrame | None) -> DataFrame:
    return restrict(rows, support) if support is not None else rows


def ts(spark: SparkSession, t: Iterable[float], time_units: str = "s", support: DataFrame | None = None) -> DataFrame:
    """Events: t_ns."""
    return _kept(spark.createDataFrame([(x,) for x in _ns(t, time_units)], "t_ns long"), support)


def tsd(spark: SparkSession, t: Iterable[float], d: Iterable[float], time_units: str = "s", support: DataFrame | None = None) -> DataFrame:
    """A signal: t_ns and v; missing values are null."""
    t, d = _ns(t, time_units), [None if v is None or v != v else float(v) for v in d]
    if len(t) != len(d):
        raise ValueError("times and values differ in number")
    return _kept(spark.createDataFrame(list(zip(t, d)), "t_ns long, v double"), support)


def tsd_frame(spark: SparkSession, t: Iterable[float], d: Sequence, columns: Sequence | None = None, time_units: str = "s", support: DataFrame | None = None) -> DataFrame:
    """A frame in long form: t_ns, col and v. One column may come without its second axis; labels that are too few or many are
    replaced by numbers."""
    x = np.asarray(d, dtype=float)
    x = x.reshape(len(x), -1)
    t = _ns(t, time_units)
    if len(t) != len(x):
        raise ValueError("times and values differ in number")
    names = [str(c) for c in columns] if columns is not None and len(columns) == x.shape[1] else [str(k) for k in range(x.shape[1])]
    rows = [(a, c, None if v != v else v) for a, row in zip(t, x.tolist()) for c, v in zip(names, row)]
    return _kept(spark.createDataFrame(rows, "t_ns long, col string, v double"), support)


def tsd_tensor(spark: SparkSession, t: Iterable[float], d: Sequence, time_units: str = "s", support: DataFrame | None = None) -> DataFrame:
    """A tensor in long form: t_ns, an axis i, j, … for each but the first, and v. It needs three axes or more."""
    x = np.asarray(d, dtype=float)
    if x.ndim < 3:
        raise ValueError("a tensor has three axes or more, time among them")
    t = _ns(t, time_units)
    if len(t) != len(x):
        raise ValueError("times and values differ in number")
    axes = [chr(ord("i") + k) for k in range(x.ndim - 1)]
    rows = [(t[at[0]], *at[1:], None if v != v else float(v)) for at, v in np.ndenumerate(x)]
    return _kept(spark.createDataFrame(rows, "t_ns long, " + ", ".join(f"{a} int" for a in axes) + ", v double"), support)


def interval_set(spark: SparkSession, start: Iterable[float], end: Iterable[float], time_units: str = "s", metadata: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Valid intervals: epoch_id, start_ns, end_ns and metadata, which is kept only where nothing had to be merged, dropped or moved."""
    s, e = _ns(np.atleast_1d(start), time_units), _ns(np.atleast_1d(end), time_units)
    if len(s) != len(e):
        raise ValueError("starts and ends differ in number")
    rows = spark.createDataFrame(list(zip(s, e)), "start_ns long, end_ns long")
    ordered = all(a < b for a, b in zip(s, s[1:])) and all(a < b for a, b in zip(e, e[1:]))
    if metadata and ordered and all(a < b for a, b in zip(s, e)) and all(b <= a for a, b in zip(s[1:], e)):
        if any(len(v) != len(s) for v in metadata.values()):
            raise ValueError("metadata needs a value for each interval")
        made = [(k, a, b if k + 1 == len(s) or b < s[k + 1] else b - 1000, *v) for k, (a, b, *v) in enumerate(zip(s, e, *metadata.values()))]
        return spark.createDataFrame(made, ["epoch_id", "start_ns", "end_ns", *metadata]).withColumn("epoch_id", F.col("epoch_id").cast("int"))
    return normalize(rows, strict=ordered)


def ts_group(spark: SparkSession, data: Mapping | Sequence, time_units: str = "s", support: DataFrame | None = None, metadata: Mapping[str, Mapping] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A group of trains from unit to times: samples (unit, t_ns), units (unit, rate, metadata) and the support.

    Keys must be whole numbers that differ. Without a support it is the union of the units' own.
    """
    items = list(data.items() if isinstance(data, Mapping) else enumerate(data))
    keys = [float(k) for k, _ in items]
    if any(k != int(k) for k in keys) or len(set(keys)) < len(keys):
        raise ValueError("units need whole numbers that differ")
    rows = [(int(float(k)), x) for k, t in items for x in _ns(t, time_units)]
    samples = spark.createDataFrame(rows, "unit int, t_ns long")
    if support is None:
        spans = [spark.createDataFrame([(min(t), max(t))], "start_ns long, end_ns long") for _, raw in items if len(t := _ns(raw, time_units)) and min(t) < max(t)]
        if not spans:
            raise RuntimeError("the units have no support together")
        support = union_all(spans)
    else:
        samples = restrict(samples, support)
    seconds = support.agg(F.sum(F.col("end_ns") - F.col("start_ns"))).first()[0] / 1e9
    counts = samples.groupBy("unit").agg(F.count("*").alias("n"))
    units = spark.createDataFrame([(int(k), *[(metadata or {})[m].get(int(k)) for m in metadata or {}]) for k in sorted(keys)], ["unit", *(metadata or {})])
    units = units.withColumn("unit", F.col("unit").cast("int")).join(counts, "unit", "left").withColumn("rate", F.coalesce("n", F.lit(0)) / F.lit(seconds)).drop("n")
    return samples, units.select("unit", "rate", *(metadata or {})), support
