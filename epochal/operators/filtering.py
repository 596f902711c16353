"""Filters, spectra and wavelets of regularly sampled signals, within each group of ``by`` (series and epoch).

Finite kernels are window expressions, or run over blocks where they are long; recursive filters run over blocks with margins.
Fourier transforms are a numeric kernel over a group's array, one group per task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signal import butter_sections, chebyshev_sections, forward_backward, hamming_kernel, morlet_bank, sinc_filter
from .intervals import drop_long, drop_short, merge_close
from .joins import tag
from .series import convolve, threshold_support


#: Samples that a recursive filter takes at a time, besides a margin.
BLOCK = 1 << 18


def _recursive(samples: DataFrame, by: list[str], value: str, sections: np.ndarray) -> DataFrame:
    """``value`` filtered in both directions, group by group.

    A recording is cut into blocks, each with a margin on both sides in which what lies beyond has faded below rounding (e to the
    power of minus 40 of its size), so no task holds a whole recording. The ends of a group are those of its first and last block.
    """
    slowest = max(np.abs(np.roots([1.0, a1, a2])).max() for _, _, _, _, a1, a2 in sections)
    margin = int(np.ceil(40 / -np.log(slowest)))
    size = max(BLOCK, 4 * margin)
    rows = samples.withColumn(value, F.col(value).cast("double")).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("t_ns")) - 1)
    spread = rows.withColumn("_block", F.explode(F.sequence(F.expr(f"greatest(_r - {margin}, 0) div {size}"), F.expr(f"(_r + {margin}) div {size}"))))
    schema = rows.drop("_r").schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_r", kind="stable")
        x = frame[value].to_numpy(dtype=float)
        if np.isnan(x).any():
            raise ValueError("the signal has missing values; fill or drop them first")
        own = (frame["_r"] // size == frame["_block"]).to_numpy()
        if own.any():
            frame[value] = forward_backward(sections, x)
        return frame.loc[own, [f.name for f in schema]]

    return spread.groupBy(*by, "_block").applyInPandas(run, schema)


def apply_filter(samples: DataFrame, kind: str, cutoff, fs: float, by: list[str], mode: str = "butter", order: int = 4, transition: float = 0.02, value: str = "v") -> DataFrame:
    """lowpass, highpass, bandpass or bandstop. ``sinc`` is a convolution in Spark; ``butter`` runs in both directions."""
    if mode == "sinc":
        return convolve(samples, sinc_filter(kind, cutoff, fs, transition).tolist(), by, value, "both", value)
    if mode != "butter":
        raise ValueError(f"mode {mode!r} is none of butter, sinc")
    return _recursive(samples, by, value, butter_sections(kind, cutoff, fs, order))


def decimate(samples: DataFrame, down: int, by: list[str], value: str = "v", order: int = 8, filter_type: str = "iir") -> DataFrame:
    """Every ``down``-th sample of each group after a low-pass without delay: a Chebyshev filter of 0.05 dB ripple at 0.8 of the
    new half rate (``iir``), run in both directions, or ``order + 1`` points of a sinc under a Hamming window (``fir``)."""
    if filter_type not in ("iir", "fir"):
        raise ValueError(f"filter type {filter_type!r} is none of iir, fir")
    if not isinstance(down, int) or down < 1 or not isinstance(order, int) or order < 1:
        raise ValueError("down and order must be whole and positive")
    if filter_type == "fir":
        rows = convolve(samples, hamming_kernel(order + 1, 1 / down).tolist(), by, value, "both", value)
    else:
        rows = _recursive(samples, by, value, chebyshev_sections(order, 0.05, 0.8 / down))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("t_ns")) - 1).where(f"_r % {down} = 0").drop("_r")


def detect_oscillatory_events(samples: DataFrame, epochs: DataFrame, band: tuple[float, float], fs: float, thresholds: tuple[float, float], durations_ns: tuple[int, int], min_gap_ns: int, window: int = 51, value: str = "v") -> DataFrame:
    """Epochs in which the power of a band stands out, with power (dB), amplitude and peak_ns of each."""
    x = apply_filter(tag(samples, epochs), "bandpass", band, fs, ["epoch_id"], value=value)
    power = x.withColumns({"_raw": F.col(value), value: F.col(value) * F.col(value)})
    box = [1.0 / window] * window
    smooth = convolve(convolve(power, box, ["epoch_id"], value), box, ["epoch_id"], value)
    stats = smooth.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = smooth.crossJoin(F.broadcast(stats)).withColumn("_z", F.try_divide(F.col(value) - F.col("_m"), "_s"))  # one row
    found = threshold_support(z.select("epoch_id", "t_ns", "_z").where(f"_z < {thresholds[1]!r}"), thresholds[0], "above", "_z", ["epoch_id"])
    found = merge_close(drop_long(drop_short(found.drop("epoch_id"), durations_ns[0]), durations_ns[1]), min_gap_ns)
    inside = tag(z.select("t_ns", "_raw", F.col(value).alias("_p")), found)
    stats = inside.groupBy("epoch_id").agg((10 * F.log10(F.avg(F.col("_raw") * F.col("_raw")))).alias("power"), F.max(F.sqrt("_p")).alias("amplitude"), F.max_by("t_ns", F.struct("_p", (-F.col("t_ns")).alias("_t"))).alias("peak_ns"))
    return found.join(stats, "epoch_id", "left")


def fft(samples: DataFrame, fs: float, by: list[str], value: str = "v", full_range: bool = False, norm: bool = False) -> DataFrame:
    """by, k, freq, re and im of each group's Fourier transform, by frequency; those below zero only with ``full_range``."""
    fields = [samples.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("k", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("freq", "re", "im")]])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("t_ns", kind="stable")[value].to_numpy(dtype=float)
        f, y = np.fft.fftfreq(len(x), 1 / fs), np.fft.fft(x) / (len(x) if norm else 1)
        order = np.argsort(f)
        keep = order if full_range else order[f[order] >= 0]
        out = pd.DataFrame({"k": np.arange(len(keep), dtype=np.int32), "freq": f[keep], "re": y.real[keep], "im": y.imag[keep]})
        for name, v in zip(by, key):
            out.insert(0, name, v)
        return out[[x.name for x in schema]]

    return samples.select(*by, "t_ns", F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(run, schema)


def power_spectral_density(samples: DataFrame, fs: float, by: list[str], value: str = "v", full_range: bool = False) -> DataFrame:
    """by, k, freq and psd: squared modulus over rate and length, doubled between the ends when one-sided."""
    n = samples.where(f"{value} is not null").groupBy(*by).agg(F.count("*").alias("_n"))
    rows = fft(samples, fs, by, value, full_range).join(n, by)
    base = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.col("_n") * fs)
    double = F.lit(False) if full_range else (F.col("freq") > 0) & (F.col("freq") < fs / 2 - 1e-6 * min(1.0, fs))
    return rows.select(*by, "k", "freq", F.when(double, 2 * base).otherwise(base).alias("psd"))


def mean_power_spectral_density(samples: DataFrame, epochs: DataFrame, fs: float, size: int, overlap: float = 0.25, value: str = "v") -> DataFrame:
    """k, freq and psd averaged over windows of ``size`` samples under a Hamming window, which overlap and stay in their epoch."""
    step = max(1, int(size * (1 - overlap)))
    w = Window.partitionBy("epoch_id").orderBy("t_ns")
    rows = tag(samples.select("t_ns", value), epochs).withColumns({"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy("epoch_id"))})
    first = F.greatest(F.lit(0), F.expr(f"(_r - {size} + {step}) div {step}"))
    rows = rows.withColumn("_w", F.explode(F.sequence(F.when(F.col("_r") < size, 0).otherwise(first).cast("int"), F.expr(f"cast(_r div {step} as int)"))))
    rows = rows.where(f"_w * {step} + {size} <= _n and _r - _w * {step} < {size}").withColumn("_p", F.col("_r") - F.col("_w") * step)
    hamming = 0.54 - 0.46 * F.cos(2 * np.pi * F.col("_p") / (size - 1))
    rows = rows.withColumn(value, F.col(value) * hamming)
    return power_spectral_density(rows.select("epoch_id", "_w", "t_ns", value), fs, ["epoch_id", "_w"], value).groupBy("k", "freq").agg(F.avg("psd").alias("psd"))


def wavelet_transform(samples: DataFrame, freqs: list[float], fs: float, by: list[str], value: str = "v", norm: str | None = "l1", gaussian_width: float = 1.5, window_length: float = 1.0) -> DataFrame:
    """by, t_ns, freq, re and im: each group convolved with a Morlet wavelet of each frequency."""
    out = None
    for f, kernel in morlet_bank(freqs, fs, gaussian_width, window_length).items():
        scale = {"l1": fs / f, "l2": fs / f**0.5, None: 1.0}[norm]
        rows = convolve(samples, (kernel.real / scale).tolist(), by, value, out="re")
        rows = convolve(rows, (kernel.imag / scale).tolist(), by, value, out="im").select(*by, "t_ns", F.lit(float(f)).alias("freq"), "re", "im")
        out = rows if out is None else out.unionByName(rows)
    return out
