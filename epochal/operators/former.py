"""Former names of tuning and decoding functions, for one or two features. Each warns and calls what took its place."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from .decoding import decode_bayes
from .tuning import Edges, mutual_information, tuning_curves, tuning_curves_continuous


def _deprecated(old: str, new: str) -> None:
    warnings.warn(f"{old} is deprecated; use {new}", DeprecationWarning, stacklevel=3)


def _features(edges: Edges, n: int) -> Edges:
    if len(edges) != n:
        raise ValueError(f"this needs {n} feature{'s' if n > 1 else ''}")
    return edges


def compute_1d_tuning_curves(group: DataFrame, feature: DataFrame, epochs: DataFrame, edges: Edges, fs: float) -> DataFrame:
    _deprecated("compute_1d_tuning_curves", "tuning_curves")
    return tuning_curves(group, feature, epochs, _features(edges, 1), fs)


def compute_2d_tuning_curves(group: DataFrame, features: DataFrame, epochs: DataFrame, edges: Edges, fs: float) -> DataFrame:
    _deprecated("compute_2d_tuning_curves", "tuning_curves")
    return tuning_curves(group, features, epochs, _features(edges, 2), fs)


def compute_1d_tuning_curves_continuous(signal: DataFrame, feature: DataFrame, epochs: DataFrame, edges: Edges, value: str = "v", by: list[str] | None = None) -> DataFrame:
    _deprecated("compute_1d_tuning_curves_continuous", "tuning_curves_continuous")
    return tuning_curves_continuous(signal, feature, epochs, _features(edges, 1), value, by)


def compute_2d_tuning_curves_continuous(signal: DataFrame, features: DataFrame, epochs: DataFrame, edges: Edges, value: str = "v", by: list[str] | None = None) -> DataFrame:
    _deprecated("compute_2d_tuning_curves_continuous", "tuning_curves_continuous")
    return tuning_curves_continuous(signal, features, epochs, _features(edges, 2), value, by)


def compute_1d_mutual_info(curves: DataFrame) -> DataFrame:
    _deprecated("compute_1d_mutual_info", "mutual_information")
    return mutual_information(curves)


def compute_2d_mutual_info(curves: DataFrame) -> DataFrame:
    _deprecated("compute_2d_mutual_info", "mutual_information")
    return mutual_information(curves)


def decode_1d(counts: DataFrame, curves: DataFrame, bin_ns: int, uniform_prior: bool = True) -> DataFrame:
    _deprecated("decode_1d", "decode_bayes")
    return decode_bayes(counts, curves, bin_ns, ["bin_0"], uniform_prior)


def decode_2d(counts: DataFrame, curves: DataFrame, bin_ns: int, uniform_prior: bool = True) -> DataFrame:
    _deprecated("decode_2d", "decode_bayes")
    return decode_bayes(counts, curves, bin_ns, ["bin_0", "bin_1"], uniform_prior)
