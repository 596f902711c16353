"""Surrogate events: shifted, shuffled, jittered or drawn anew, the same for the same seed.

Random numbers come from a hash of the seed and the row's key, so they do not depend on how rows are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import restrict


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone: the first 13 digits of their MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _told_apart(samples: DataFrame) -> DataFrame:
    """``_k`` counts equal times of a unit, so that each draws for itself."""
    return samples.withColumn("_k", F.row_number().over(Window.partitionBy("unit", "t_ns").orderBy(F.lit(0))))


def shift_timestamps(samples: DataFrame, epochs: DataFrame, min_shift_ns: int = 0, max_shift_ns: int | None = None, mode: str = "drop", seed: int = 0) -> DataFrame:
    """Each unit moved by one random time. ``drop``: what leaves the epochs vanishes. ``wrap``: it comes in at the other end."""
    if mode not in ("drop", "wrap"):
        raise ValueError(f"mode {mode!r} is none of drop, wrap")
    span = epochs.agg(F.min("start_ns").alias("_s"), F.max("end_ns").alias("_e"))
    rows = samples.crossJoin(F.broadcast(span))  # one row
    most = F.lit(max_shift_ns) if max_shift_ns is not None else F.col("_e") - F.col("_s")
    rows = rows.withColumn("t_ns", F.col("t_ns") + F.lit(min_shift_ns) + F.floor(uniform(seed, "unit") * (most - min_shift_ns)))
    if mode == "wrap":
        rows = rows.withColumn("t_ns", F.col("_s") + F.pmod(F.col("t_ns") - F.col("_s"), F.col("_e") - F.col("_s")))
    return restrict(rows.drop("_s", "_e"), epochs)


def shuffle_intervals(samples: DataFrame, seed: int = 0) -> DataFrame:
    """Each unit with the steps between its samples in another order; its first time stays."""
    w = Window.partitionBy("unit")
    steps = samples.select("unit", "t_ns", F.row_number().over(w.orderBy("t_ns")).alias("_r"), (F.col("t_ns") - F.lag("t_ns").over(w.orderBy("t_ns"))).alias("_d"), F.min("t_ns").over(w).alias("_t0"))
    rows = steps.withColumn("_k", F.when(F.col("_d").isNull(), -1.0).otherwise(uniform(seed, "unit", "_r")))
    t = F.col("_t0") + F.sum(F.coalesce("_d", F.lit(0))).over(w.orderBy("_k", "_r").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("unit", t.alias("t_ns"))


def jitter_timestamps(samples: DataFrame, max_jitter_ns: int, epochs: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Each sample moved by up to the jitter either way; with ``epochs``, what leaves them vanishes."""
    rows = _told_apart(samples)
    rows = rows.withColumn("t_ns", F.col("t_ns") + F.floor((2 * uniform(seed, "unit", "t_ns", "_k") - 1) * max_jitter_ns).cast("bigint")).drop("_k")
    return restrict(rows, epochs) if epochs is not None else rows


def resample_timestamps(samples: DataFrame, start_ns: int, end_ns: int, seed: int = 0) -> DataFrame:
    """As many times per unit as it has, drawn anew between two times."""
    drawn = F.lit(start_ns) + F.floor(uniform(seed, "unit", "t_ns", "_k") * (end_ns - start_ns))
    return _told_apart(samples).select("unit", drawn.cast("bigint").alias("t_ns"))
