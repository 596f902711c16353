"""Groups of units: their metadata, choosing among them, merging, sampling, and functions applied to each."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import union_all

COMPARISONS = (">", "<", ">=", "<=")


def getby_threshold(samples: DataFrame, units: DataFrame, key: str, threshold: float, op: str = ">") -> DataFrame:
    """Samples of the units whose metadata passes a threshold."""
    if op not in COMPARISONS:
        raise RuntimeError(f"operation {op!r} is none of {', '.join(COMPARISONS)}")
    return samples.join(units.where(f"{key} {op} {threshold!r}").select("unit"), "unit", "left_semi")


def getby_intervals(units: DataFrame, key: str, edges: list[float]) -> DataFrame:
    """unit, slice and center: the half-open bin of each unit's metadata; units outside all bins drop."""
    array = F.array(*[F.lit(float(e)) for e in edges])
    rows = units.where((F.col(key) >= edges[0]) & (F.col(key) < edges[-1])).withColumn("slice", F.size(F.filter(array, lambda e: e <= F.col(key))) - 1)
    return rows.select("unit", F.col("slice").cast("int").alias("slice"), ((F.get(array, "slice") + F.get(array, F.col("slice") + 1)) / 2).alias("center"))


def getby_category(units: DataFrame, key: str) -> DataFrame:
    """The units of each value of a metadata column."""
    return groupby(units, [key])


def groupby(units: DataFrame, by: list[str]) -> DataFrame:
    """Values of the columns and the units that have them, in order."""
    return units.groupBy(*by).agg(F.array_sort(F.collect_list("unit")).alias("units"))


def groupby_apply(samples: DataFrame, units: DataFrame, by: list[str], func: Callable, schema: str) -> DataFrame:
    """A Python function over the samples of each group of units: pandas frame in, pandas frame out.

    Prefer ``groupBy().agg()`` where built-in functions can say it: a group here is held by one task.
    """
    return samples.join(units.select("unit", *by), "unit").groupBy(*by).applyInPandas(func, schema)


def with_info(units: DataFrame, info: DataFrame, key: str = "unit") -> DataFrame:
    """Units (or columns, or epochs) with further metadata by ``key``; names that exist already are refused."""
    clash = (set(info.columns) & set(units.columns)) - {key}
    if clash:
        raise ValueError(f"metadata {sorted(clash)} exists already")
    return units.join(info, key, "left")


def set_info(units: DataFrame, key: str = "unit", **columns: object) -> DataFrame:
    """Units with metadata set anew: an expression, a plain value for all, or a dict from key to value. ``rate`` stays as it is."""
    if {"rate", key} & set(columns):
        raise ValueError(f"{key} and rate cannot be set")
    for name, v in columns.items():
        if isinstance(v, dict):
            rows = units.sparkSession.createDataFrame(list(v.items()), [key, name]).withColumn(key, F.col(key).cast(units.schema[key].dataType))
            units = units.drop(name).join(rows, key, "left")
        else:
            units = units.withColumn(name, v if isinstance(v, Column) else F.lit(v))
    return units


def get_info(units: DataFrame, names: str | list[str], key: str = "unit") -> DataFrame:
    """The key and the metadata asked for, in order of the key."""
    return units.select(key, *([names] if isinstance(names, str) else names)).orderBy(key)


def drop_info(units: DataFrame, names: list[str]) -> DataFrame:
    if {"rate", "unit"} & set(names):
        raise ValueError("unit and rate cannot be dropped")
    return units.drop(*names)


def restrict_info(units: DataFrame, names: list[str]) -> DataFrame:
    """The units with these metadata columns alone, besides unit and rate."""
    return units.select(*dict.fromkeys(["unit", *[c for c in ("rate",) if c in units.columns], *names]))


def merge_groups(groups: list[DataFrame], reset_index: bool = False, supports: list[DataFrame] | None = None, reset_time_support: bool = False, ignore_metadata: bool = False) -> DataFrame:
    """Samples of several groups as one. Units must differ, or are numbered anew in the order of groups and units.

    ``supports`` are the groups' epochs, which must be the same unless ``reset_time_support`` is given (then use their
    ``merged_support``). Columns beside unit and t_ns must be the same unless ``ignore_metadata`` is given, which drops them.
    """
    if supports and not reset_time_support and any(not _same_epochs(supports[0], e) for e in supports[1:]):
        raise ValueError("groups differ in their support; pass reset_time_support to unite it")
    if ignore_metadata:
        groups = [g.select("unit", "t_ns") for g in groups]
    elif any(set(g.columns) != set(groups[0].columns) for g in groups[1:]):
        raise ValueError("groups differ in their columns; pass ignore_metadata to drop them")
    if reset_index:
        tagged = [g.withColumn("_g", F.lit(i)) for i, g in enumerate(groups)]
        rows = reduce(DataFrame.unionByName, tagged)
        keys = rows.select("_g", "unit").distinct().withColumn("_u", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_g", "unit")) - 1).cast("int"))
        return rows.join(keys, ["_g", "unit"]).drop("unit", "_g").withColumnRenamed("_u", "unit").select(*groups[0].columns)
    seen = reduce(DataFrame.unionByName, [g.select("unit").distinct() for g in groups]).groupBy("unit").count().where("count > 1")
    if not seen.isEmpty():
        raise ValueError("groups share units; pass reset_index to number them anew")
    return reduce(DataFrame.unionByName, groups)


def merged_support(supports: list[DataFrame]) -> DataFrame:
    """The epochs of a merged group: the union of all."""
    return union_all(supports)


def _same_epochs(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("start_ns", "end_ns"), b.select("start_ns", "end_ns")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def subsample(samples: DataFrame, fraction: float, seed: int = 0) -> DataFrame:
    """Exactly ``round(n * fraction)``, half to even, of each unit's samples without replacement."""
    order = F.xxhash64(F.lit(seed), "unit", *[c for c in samples.columns if c != "unit"])
    w = Window.partitionBy("unit")
    rows = samples.withColumns({"_r": F.row_number().over(w.orderBy(order, "t_ns")), "_n": F.count("*").over(w)})
    return rows.where(F.col("_r") <= F.bround(F.col("_n") * F.lit(float(fraction)), 0)).drop("_r", "_n")


def to_tsd(samples: DataFrame, units: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """One series of all units: t_ns and v, the unit or one of its metadata columns."""
    if units is None or key is None:
        return samples.select("t_ns", F.col("unit").cast("double").alias("v"))
    return samples.join(units.select("unit", key), "unit").select("t_ns", F.col(key).cast("double").alias("v"))


def to_tsgroup(signal: DataFrame, value: str = "v") -> DataFrame:
    """A group whose units are the whole parts of a signal's values."""
    return signal.select(F.col(value).cast("int").alias("unit"), "t_ns")
