"""Sessions of the neuroscope family: XML header, .clu/.res spike files, .evt event files."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.time import SECOND


def read_header(path: str) -> dict:
    """Rates, channel count and groups of an XML header."""
    root = ET.parse(path).getroot()

    def number(where: str, kind=float):
        found = root.find(where)
        return kind(found.text) if found is not None and found.text else None

    groups = [[int(c.text) for c in g.iter("channel")] for g in root.findall("./anatomicalDescription/channelGroups/group")]
    return {"n_channels": number("./acquisitionSystem/nChannels", int), "fs_dat": number("./acquisitionSystem/samplingRate"), "fs_eeg": number("./fieldPotentials/lfpSamplingRate"), "n_bits": number("./acquisitionSystem/nBits", int), "groups": dict(enumerate(groups))}


def _numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Lines of a text file with their place. Files are split by bytes, so places come from per-partition counts, not one task."""
    lines = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    counts = lines.groupBy("_p").agg(F.count("*").alias("_n"))
    start = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = lines.join(F.broadcast(start), "_p")  # a row per input partition
    return rows.select((F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias("place"), F.trim("value").cast("bigint").alias(name))


def read_spikes(spark: SparkSession, base: str, shank: int, fs: float) -> DataFrame:
    """unit and t_ns of one shank: clusters 0 and 1 drop, and units count from 0 in order of cluster."""
    cluster = _numbered_lines(spark, f"{base}.clu.{shank}", "cluster").where("place > 0").withColumn("place", F.col("place") - 1)
    spikes = cluster.join(_numbered_lines(spark, f"{base}.res.{shank}", "sample"), "place").where("cluster > 1")
    keys = spikes.select("cluster").distinct().withColumn("unit", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("int"))
    return spikes.join(F.broadcast(keys), "cluster").select("unit", F.bround(F.col("sample") * F.lit(SECOND / fs), 0).cast("bigint").alias("t_ns"))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """An .evt file, whose lines are starts and ends in turn in milliseconds, as epochs."""
    times = [float(x.split()[0]) for x in Path(path).read_text().splitlines() if x.strip()]  # a few lines by hand of a person
    return spark.createDataFrame([(i, round(a * 1e6), round(b * 1e6)) for i, (a, b) in enumerate(zip(times[::2], times[1::2]))], "epoch_id int, start_ns long, end_ns long")


def write_intervals(epochs: DataFrame, path: str, name: str = "epoch") -> None:
    rows = epochs.orderBy("start_ns").collect()
    Path(path).write_text("".join(f"{r.start_ns / 1e6} {name} start 1\n{r.end_ns / 1e6} {name} end 1\n" for r in rows))


def read_binary(spark: SparkSession, path: str, header: dict, channel: int | None = None, frequency: float | None = None) -> DataFrame:
    from .arrays import register

    register(spark)
    reader = spark.read.format("binary_recording").option("n_channels", header["n_channels"]).option("frequency", frequency or header["fs_dat"]).option("dtype", f"int{header.get('n_bits') or 16}")
    return (reader.option("channel", channel) if channel is not None else reader).load(path)


def mean_waveforms(spikes: DataFrame, recording: DataFrame, fs: float, before: int, after: int) -> DataFrame:
    """unit, channel, lag (samples), mean and std of the recording around each spike."""
    from ..operators.joins import band_join

    step = SECOND / fs
    rows = band_join(spikes.select("unit", "t_ns"), recording, round(before * step), round((after - 1) * step))
    rows = rows.withColumn("lag", F.bround((F.col("t_ns_y") - F.col("t_ns")) / F.lit(step), 0).cast("int"))
    return rows.groupBy("unit", F.col("channel_y").alias("channel"), "lag").agg(F.avg("v_y").alias("mean"), F.stddev_pop("v_y").alias("std"))
