"""Correlograms: how often one train of events fires at each lag of another, as a rate per bin.

Pairs are not listed where they are many. How many events of a unit lie before each border of a bin, seen from a reference, is
looked up in the sorted times of a bucket, so the work grows with events, units and bins, and not with pairs. Bins are half-open
and centred on zero lag.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import in_buckets
from .joins import tag
from .series import time_diff

#: Events of a bucket, about, where the window leaves room; and pairs that are listed at a time.
BUCKET_EVENTS, LISTED = 20_000, 1 << 22


def lag_bins(window_ns: int, bin_ns: int) -> int:
    """Number of bins, odd, that cover the window on both sides."""
    n = 2 * window_ns // bin_ns
    return n + 1 - n % 2


def _counts(reference: DataFrame, events: DataFrame, bin_ns: int, window_ns: int, which: str, reverse: bool = False) -> DataFrame:
    """unit (of the reference), unit2, bin and n_pairs, above 0, of references and events (unit, t_ns) within the window.

    ``which`` units are paired: the ``same``, those ``before`` unit2, or ``all``. References lie in one bucket of time, events in
    all that they reach.
    """
    n = lag_bins(window_ns, bin_ns)
    # a lag l lies in bin k if 2 k bin - n bin <= 2 l < 2 (k + 1) bin - n bin
    edges = np.array([-((n - 2 * k) * bin_ns // 2) for k in range(n + 1)], dtype=np.int64)
    x, y = (d.where("unit is not null").select("unit", "t_ns") for d in (reference, events))
    half = (n * bin_ns + 1) // 2
    seen = y.agg(F.count("*").alias("n"), (F.max("t_ns") - F.min("t_ns")).alias("span")).first()
    width = max(1, 2 * half, (seen.span or 0) * BUCKET_EVENTS // max(1, seen.n))
    x = x.select(F.col("unit").alias("_u"), F.col("t_ns").alias("_t"), F.floor(F.col("t_ns") / F.lit(float(width))).alias("_bucket"))
    y = in_buckets(y.withColumns({"_lo": F.col("t_ns") - half, "_hi": F.col("t_ns") + half}), "_lo", "_hi", width).drop("_lo", "_hi")
    schema = T.StructType([T.StructField("unit", x.schema["_u"].dataType), T.StructField("unit2", y.schema["unit"].dataType), T.StructField("bin", T.IntegerType()), T.StructField("n_pairs", T.LongType())])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pair_counts(a.rename(columns={"_u": "unit", "_t": "t_ns"}), b, edges, which, reverse)

    found = x.groupBy("_bucket").cogroup(y.groupBy("_bucket")).applyInPandas(run, schema)
    return found.groupBy("unit", "unit2", "bin").agg(F.sum("n_pairs").alias("n_pairs"))


def pair_counts(a: pd.DataFrame, b: pd.DataFrame, edges: np.ndarray, which: str, reverse: bool = False, listed: bool | None = None) -> pd.DataFrame:
    """The counts of one bucket. ``listed`` says whether pairs are listed; by default, where they are fewer than look-ups."""
    if which == "all":
        (names_a, ca), (names_b, cb) = np.unique(a["unit"], return_inverse=True), np.unique(b["unit"], return_inverse=True)
    else:
        names_a = names_b = np.unique(np.concatenate([a["unit"], b["unit"]]))
        ca, cb = np.searchsorted(names_a, a["unit"].to_numpy()), np.searchsorted(names_a, b["unit"].to_numpy())
    x, y = a["t_ns"].to_numpy(), b["t_ns"].to_numpy()
    if not len(x) or not len(y):
        return pd.DataFrame({"unit": a["unit"][:0], "unit2": b["unit"][:0], "bin": np.array([], np.int32), "n_pairs": np.array([], np.int64)})
    o, p = np.lexsort((x, ca)), np.lexsort((y, cb))
    x, ca, y, cb = x[o], ca[o], y[p], cb[p]
    # lags are those of y from x, or of x from y; then borders are turned round and belong to the earlier side
    steps, side = (-edges[::-1], "right") if reverse else (edges, "left")
    fields: list[tuple[np.ndarray, ...]] = []
    first_x, first_y = np.searchsorted(ca, np.arange(len(names_a) + 1)), np.searchsorted(cb, np.arange(len(names_b) + 1))
    if which == "same":
        low = min(x.min() + steps[0], y.min())
        span = int(max(x.max() + steps[-1], y.max()) - low) + 2
        if span * len(names_a) < 1 << 62:  # all units in one order, each in a stretch of its own
            fields.append(_looked_up(x - low + ca * span, ca, y - low + cb * span, steps, side, None))
        else:
            fields.extend(_looked_up(x[i:j], ca[i:j], y[k:m], steps, side, None) for i, j, k, m in zip(first_x, first_x[1:], first_y, first_y[1:]) if i < j and k < m)
    else:
        until = first_x[:-1] if which == "before" else np.full(len(names_b), len(x))
        times = np.sort(y)
        lo, hi = np.searchsorted(times, x + steps[0], side), np.searchsorted(times, x + steps[-1], side)
        if listed if listed is not None else 2 * int((hi - lo).sum()) < len(steps) * int(until.sum()):
            fields.extend(_listed(x, ca, times, cb[np.argsort(y, kind="stable")], lo, hi, steps, side, which, len(names_b)))
        else:
            fields.extend(_looked_up(x[:end], ca[:end], y[first_y[v] : first_y[v + 1]], steps, side, v) for v, end in enumerate(until) if end and first_y[v] < first_y[v + 1])
    u, v, k, n = (np.concatenate(f) if fields else np.array([], np.int64) for f in (zip(*fields) if fields else [()] * 4))
    k = len(steps) - 2 - k if reverse else k
    return pd.DataFrame({"unit": names_a[u], "unit2": names_b[v], "bin": k.astype(np.int32), "n_pairs": n})


def _looked_up(x: np.ndarray, cx: np.ndarray, y: np.ndarray, steps: np.ndarray, side: str, v: int | None) -> tuple[np.ndarray, ...]:
    """Codes of both units, bin and count for sorted times ``y`` of unit ``v``, or of the unit of each ``x``."""
    first = np.flatnonzero(np.r_[True, cx[1:] != cx[:-1]])
    before = np.array([np.add.reduceat(np.searchsorted(y, x + e, side), first) for e in steps])
    n = np.diff(before, axis=0)
    k, i = np.nonzero(n)
    u = cx[first][i]
    return u, u if v is None else np.full(len(u), v), k, n[k, i]


def _listed(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray, lo: np.ndarray, hi: np.ndarray, steps: np.ndarray, side: str, which: str, n_y: int):
    """The same from pairs, a bounded number of them at a time; ``y`` is in order of time."""
    m = len(steps) - 1
    ends = np.cumsum(hi - lo)
    keys, counts = np.array([], np.int64), np.array([], np.int64)
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + LISTED, "right")))
        each = hi[i:j] - lo[i:j]
        place = np.arange(each.sum()) + np.repeat(lo[i:j] - (np.cumsum(each) - each), each)
        u, v = np.repeat(cx[i:j], each), cy[place]
        k = np.searchsorted(steps, y[place] - np.repeat(x[i:j], each), "right" if side == "left" else "left") - 1
        key = (u.astype(np.int64) * n_y + v) * m + k
        new, n = np.unique(key[u < v] if which == "before" else key, return_counts=True)
        keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, np.concatenate([counts, n]))
        counts, i = total, j
    yield keys // m // n_y, keys // m % n_y, keys % m, counts


def _grid(keys: DataFrame, bin_ns: int, window_ns: int) -> DataFrame:
    n = lag_bins(window_ns, bin_ns)
    return keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("lag_ns", F.expr(f"(cast(2 * bin + 1 - {n} as bigint) * {bin_ns}L) div 2"))


def _rates(samples: DataFrame, epochs: DataFrame) -> DataFrame:
    """unit, size and rate of the units inside the epochs."""
    total = epochs.agg((F.sum(F.col("end_ns") - F.col("start_ns")) / 1e9).alias("_s"))
    return samples.groupBy("unit").agg(F.count("*").alias("size")).crossJoin(F.broadcast(total)).selectExpr("unit", "size", "size / _s as rate")  # one row


def autocorrelogram(group: DataFrame, epochs: DataFrame, bin_ns: int, window_ns: int, norm: bool = True) -> DataFrame:
    """unit, bin, lag_ns and value of every unit (unit, t_ns) against itself; the bin of lag 0 is 0."""
    x = tag(group, epochs).select("unit", "t_ns")
    units = _rates(x, epochs)
    n = lag_bins(window_ns, bin_ns)
    counts = _counts(x, x, bin_ns, window_ns, "same").drop("unit2")
    rows = _grid(units, bin_ns, window_ns).join(counts, ["unit", "bin"], "left")
    value = F.coalesce("n_pairs", F.lit(0)) / (F.col("size") * (bin_ns / 1e9))
    value = value / F.col("rate") if norm else value
    return rows.select("unit", "bin", "lag_ns", F.when(F.col("bin") == n // 2, 0.0).otherwise(value).alias("value"))


def crosscorrelogram(group: DataFrame, epochs: DataFrame, bin_ns: int, window_ns: int, norm: bool = True, reverse: bool = False, other: DataFrame | None = None) -> DataFrame:
    """unit, unit2, bin, lag_ns and value for pairs unit < unit2 of a group, or all pairs of two groups.

    The first unit is the reference, with ``reverse`` the second; ``norm`` divides by the rate of the one that is counted.
    """
    x = tag(group, epochs).select("unit", "t_ns")
    y = x if other is None else tag(other, epochs).select("unit", "t_ns")
    a, b = _rates(x, epochs), _rates(y, epochs).withColumnsRenamed({"unit": "unit2", "size": "size2", "rate": "rate2"})
    pairs = a.join(b, F.col("unit") < F.col("unit2")) if other is None else a.crossJoin(b)  # the result's own keys, one row per unit
    counts = _counts(x, y, bin_ns, window_ns, "before" if other is None else "all", reverse)
    rows = _grid(pairs, bin_ns, window_ns).join(counts, ["unit", "unit2", "bin"], "left")
    size, speed = ("size2", "rate") if reverse else ("size", "rate2")
    value = F.coalesce("n_pairs", F.lit(0)) / (F.col(size) * (bin_ns / 1e9))
    return rows.select("unit", "unit2", "bin", "lag_ns", (value / F.col(speed) if norm else value).alias("value"))


def eventcorrelogram(group: DataFrame, events: DataFrame, epochs: DataFrame, bin_ns: int, window_ns: int, norm: bool = True) -> DataFrame:
    """unit, bin, lag_ns and value of every unit around the events (t_ns)."""
    x, e = tag(group, epochs).select("unit", "t_ns"), tag(events.select("t_ns"), epochs).select("t_ns")
    units = _rates(x, epochs)
    size = e.agg(F.count("*").alias("n_events"))
    counts = _counts(e.withColumn("unit", F.lit(0)), x, bin_ns, window_ns, "all").select(F.col("unit2").alias("unit"), "bin", "n_pairs")
    rows = _grid(units, bin_ns, window_ns).join(counts, ["unit", "bin"], "left").crossJoin(F.broadcast(size))  # one row
    value = F.coalesce("n_pairs", F.lit(0)) / (F.col("n_events") * (bin_ns / 1e9))
    return rows.select("unit", "bin", "lag_ns", (value / F.col("rate") if norm else value).alias("value"))


def isi_distribution(group: DataFrame, epochs: DataFrame, edges_ns: list[int]) -> DataFrame:
    """unit, bin and n: how many steps between neighbours of a unit and epoch lie in each bin; the last bin is closed."""
    d = time_diff(tag(group, epochs), ["unit", "epoch_id"])
    array = F.array(*[F.lit(int(e)) for e in edges_ns])
    last = len(edges_ns) - 2
    place = F.when(F.col("dt_ns") == edges_ns[-1], last).otherwise(F.size(F.filter(array, lambda e: e <= F.col("dt_ns"))) - 1)
    counts = d.where(F.col("dt_ns").between(edges_ns[0], edges_ns[-1])).groupBy("unit", place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = group.select("unit").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return grid.join(counts, ["unit", "bin"], "left").select("unit", "bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
