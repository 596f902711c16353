"""Trials of different length brought to one length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import tag
from .series import trial_count, trial_tensor


def build_tensor(samples: DataFrame, epochs: DataFrame, bin_ns: int | None = None, by: list[str] | None = None, value: str = "v", align: str = "start", padding: float | None = None) -> DataFrame:
    """Counts per bin where a bin size is given, else the values themselves; one padded array per trial."""
    return trial_count(samples, epochs, bin_ns, by, align, padding) if bin_ns is not None else trial_tensor(samples, epochs, value, align, padding)


def warp_counts(samples: DataFrame, epochs: DataFrame, num_bins: int, by: list[str]) -> DataFrame:
    """by, epoch_id, bin and n: events in ``num_bins`` equal bins of each epoch, the last one closed; zeros are kept."""
    rows = tag(samples, epochs, keep=("epoch_id", "start_ns", "end_ns"))
    place = F.least(F.expr(f"((t_ns - start_ns) * {num_bins}) div (end_ns - start_ns)"), F.lit(num_bins - 1))
    counts = rows.groupBy(*by, "epoch_id", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = epochs.select("epoch_id").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(num_bins - 1)))).crossJoin(samples.select(*by).distinct())
    return grid.join(counts, [*by, "epoch_id", "bin"], "left").select(*by, "epoch_id", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def warp_signal(samples: DataFrame, epochs: DataFrame, num_bins: int, value: str = "v") -> DataFrame:
    """epoch_id, bin and v: means of equal bins where an epoch has more samples than bins, linear interpolation by position where
    it has fewer, the samples themselves where as many, null where none."""
    w = Window.partitionBy("epoch_id")
    rows = tag(samples.select("t_ns", value), epochs, keep=("epoch_id", "start_ns", "end_ns"))
    rows = rows.withColumns({"_r": F.row_number().over(w.orderBy("t_ns")) - 1, "_n": F.count("*").over(w)})
    many = rows.where(f"_n > {num_bins}").withColumn("bin", F.least(F.expr(f"((t_ns - start_ns) * {num_bins}) div (end_ns - start_ns)"), F.lit(num_bins - 1)).cast("int"))
    many = many.groupBy("epoch_id", "bin").agg(F.avg(value).alias("v"))
    few = rows.where(f"_n <= {num_bins}").withColumn("_next", F.lead(value).over(w.orderBy("t_ns")))
    grid = few.groupBy("epoch_id").agg(F.max("_n").alias("_n")).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(num_bins - 1))))
    grid = grid.withColumn("_x", F.col("bin") * (F.col("_n") - 1) / F.lit(float(max(num_bins - 1, 1)))).withColumn("_r", F.floor("_x").cast("int"))
    filled = grid.join(few.select("epoch_id", "_r", value, "_next"), ["epoch_id", "_r"])
    filled = filled.select("epoch_id", "bin", (F.col(value) + F.coalesce((F.col("_next") - F.col(value)) * (F.col("_x") - F.col("_r")), F.lit(0.0))).alias("v"))
    whole = epochs.select("epoch_id").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(num_bins - 1))))
    return whole.join(many.unionByName(filled), ["epoch_id", "bin"], "left")
