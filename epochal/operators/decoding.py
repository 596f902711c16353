"""Decoding: which bin of the features best explains the counts of all units at each time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(counts: DataFrame, curves: DataFrame, bins: list[str]) -> DataFrame:
    """Counts (epoch_id, bin, unit, n) with the curve values of their unit at every bin of the features."""
    c = curves.select("unit", *bins, F.col("value").alias("_f"))
    c = F.broadcast(c) if c.count() <= 1_000_000 else c  # units times feature bins
    return counts.join(c, "unit")


def _best(rows: DataFrame, bins: list[str], score: str) -> DataFrame:
    order = F.struct(F.col(score), *[(-F.col(b)).alias(f"_m{i}") for i, b in enumerate(bins)])
    return rows.groupBy("epoch_id", "bin").agg(F.max_by(F.struct(*bins), order).alias("_b")).select("epoch_id", "bin", "_b.*")


def posterior(counts: DataFrame, curves: DataFrame, bin_ns: int, bins: list[str] | None = None, uniform_prior: bool = True, time_keys: list[str] | None = None) -> DataFrame:
    """epoch_id, bin, feature bins and p, for independent Poisson units.

    The log likelihood is the sum over units of n log(f + 1e-12) minus the bin's length times f; units without a value at a bin
    are left out there. Chances of a time sum to one.
    """
    bins = bins or ["bin_0"]
    seconds = bin_ns / 1e9
    log_l = F.sum(F.col("n") * F.ln(F.col("_f") + 1e-12) - F.lit(seconds) * F.col("_f"))
    rows = _joined(counts, curves, bins).groupBy("epoch_id", "bin", *bins).agg(log_l.alias("_l"))
    if not uniform_prior:
        o = curves.groupBy(*bins).agg(F.max("occupancy").alias("_o"))
        total = o.agg(F.sum("_o").alias("_all"))
        o = o.crossJoin(F.broadcast(total)).select(*bins, F.ln(F.try_divide("_o", "_all")).alias("_prior"))  # one row
        rows = rows.join(o, bins).withColumn("_l", F.col("_l") + F.col("_prior"))
    w = Window.partitionBy("epoch_id", "bin")
    rows = rows.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(w)))
    return rows.select("epoch_id", "bin", *bins, (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def decode_bayes(counts: DataFrame, curves: DataFrame, bin_ns: int, bins: list[str] | None = None, uniform_prior: bool = True) -> DataFrame:
    """epoch_id, bin and the feature bins of greatest chance; of equals the first."""
    bins = bins or ["bin_0"]
    return _best(posterior(counts, curves, bin_ns, bins, uniform_prior), bins, "p")


def _distance(metric: str) -> Column:
    n, f = F.col("n").cast("double"), F.col("_f")
    table = {
        "euclidean": F.sqrt(F.sum((n - f) * (n - f))),
        "sqeuclidean": F.sum((n - f) * (n - f)),
        "cityblock": F.sum(F.abs(n - f)),
        "chebyshev": F.max(F.abs(n - f)),
        "cosine": 1 - F.try_divide(F.sum(n * f), F.sqrt(F.sum(n * n)) * F.sqrt(F.sum(f * f))),
        "correlation": 1 - F.corr(n, f),
        "canberra": F.sum(F.coalesce(F.try_divide(F.abs(n - f), F.abs(n) + F.abs(f)), F.lit(0.0))),
        "braycurtis": F.try_divide(F.sum(F.abs(n - f)), F.sum(F.abs(n + f))),
    }
    if metric not in table:
        raise ValueError(f"metric {metric!r} is none of {', '.join(table)}")
    return table[metric]


def decode_template(counts: DataFrame, curves: DataFrame, bins: list[str] | None = None, metric: str = "correlation") -> DataFrame:
    """epoch_id, bin and the feature bins whose curve values are nearest to the counts; of equals the first."""
    bins = bins or ["bin_0"]
    rows = _joined(counts, curves, bins).groupBy("epoch_id", "bin", *bins).agg(_distance(metric).alias("_d"))
    return _best(rows.where("_d is not null and not isnan(_d)").withColumn("_s", -F.round("_d", 9)), bins, "_s")


def sliding_counts(counts: DataFrame, size: int) -> DataFrame:
    """Counts summed over ``size`` bins around each, inside the epoch."""
    w = Window.partitionBy("unit", "epoch_id").orderBy("bin").rowsBetween(-((size - 1) // 2), size // 2)
    return counts.withColumn("n", F.sum("n").over(w))
