"""Choosing samples, units, columns and intervals by place, key, mask or label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Places = int | slice | Sequence[int]


def _placed(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return rows.withColumns({"_r": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})


def _inside(places: Places) -> Column:
    r, n = F.col("_r"), F.col("_n")

    def at(k: int) -> Column:
        return F.lit(k) if k >= 0 else n + k

    if isinstance(places, slice):
        step = places.step or 1
        if step < 1:
            raise ValueError("time runs forwards: the step of a slice must be positive")
        start = F.greatest(at(places.start or 0), F.lit(0))
        ends = r < at(places.stop) if places.stop is not None else F.lit(True)
        return (r >= start) & ends & ((r - start) % step == 0)
    wanted = [places] if isinstance(places, int) else list(places)
    return r.isin([k for k in wanted if k >= 0]) | (r - n).isin([k for k in wanted if k < 0])


def by_place(samples: DataFrame, places: Places, by: list[str] | None = None, order: str = "t_ns") -> DataFrame:
    """Samples (or intervals, ordered by start_ns) of each key by place from 0, from the end where negative, in order of time."""
    return _placed(samples, by or [], order).where(_inside(places)).drop("_r", "_n")


def by_mask(samples: DataFrame, mask: Column | str) -> DataFrame:
    """Samples for which a condition holds."""
    return samples.where(mask)


def units(samples: DataFrame, keys: int | Sequence[int]) -> DataFrame:
    """The samples of some units; keys that are not there are refused."""
    wanted = [keys] if isinstance(keys, int) else list(keys)
    seen = {r.unit for r in samples.where(F.col("unit").isin(wanted)).select("unit").distinct().collect()}  # as many as asked for
    if missing := set(wanted) - seen:
        raise KeyError(f"no unit {sorted(missing)}")
    return samples.where(F.col("unit").isin(wanted))


def columns(frame: DataFrame, labels: str | Sequence[str]) -> DataFrame:
    """Columns of a frame in long form by label. One label gives a signal (t_ns, v)."""
    if isinstance(labels, str):
        return frame.where(F.col("col") == labels).drop("col")
    return frame.where(F.col("col").isin(list(labels)))


def intervals(epochs: DataFrame, places: Places) -> DataFrame:
    """Intervals by place, counted anew, with their metadata."""
    from .intervals import numbered

    return numbered(by_place(epochs, places, order="start_ns"))


def info(units_or_epochs: DataFrame, name: str) -> DataFrame:
    """The key and one column of metadata."""
    key = next(k for k in ("unit", "col", "epoch_id") if k in units_or_epochs.columns)
    return units_or_epochs.select(key, name)
