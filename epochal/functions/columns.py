"""Elementwise, cumulative and reducing functions on the values of a signal, as Spark expressions.

Missing values are null: functions outside their domain give null where arrays would hold a not-a-number or an infinity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNARY = {
    "abs": F.abs, "negative": lambda c: -c, "sign": F.signum, "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "cbrt": F.cbrt, "square": lambda c: c * c,
    "exp": F.exp, "exp2": lambda c: F.pow(F.lit(2.0), c), "expm1": F.expm1, "log": lambda c: F.when(c > 0, F.ln(c)), "log2": lambda c: F.when(c > 0, F.log2(c)),
    "log10": lambda c: F.when(c > 0, F.log10(c)), "log1p": lambda c: F.when(c > -1, F.log1p(c)), "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsinh": F.asinh, "arccosh": F.acosh, "arctanh": F.atanh,
    "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "trunc": lambda c: F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c)), "isnan": F.isnan, "deg2rad": F.radians, "rad2deg": F.degrees,
    "isfinite": lambda c: ~F.isnan(c) & (F.abs(c) != float("inf")), "isinf": lambda c: F.abs(c) == float("inf"),
}
BINARY = {
    "add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": F.try_divide, "floor_divide": lambda a, b: F.floor(F.try_divide(a, b)),
    "mod": lambda a, b: F.when(b != 0, a - b * F.floor(a / b)), "fmod": lambda a, b: F.when(b != 0, a % b), "power": F.pow, "maximum": F.greatest, "minimum": F.least,
    "hypot": F.hypot, "arctan2": F.atan2, "greater": lambda a, b: a > b, "less": lambda a, b: a < b, "greater_equal": lambda a, b: a >= b, "less_equal": lambda a, b: a <= b,
    "equal": lambda a, b: a == b, "not_equal": lambda a, b: a != b,
    "logical_and": lambda a, b: (a != 0) & (b != 0), "logical_or": lambda a, b: (a != 0) | (b != 0), "logical_xor": lambda a, b: (a != 0) != (b != 0),
    "fmax": F.greatest, "fmin": F.least, "copysign": lambda a, b: F.abs(a) * F.when(b < 0, -1.0).otherwise(1.0), "heaviside": lambda a, b: F.when(a < 0, 0.0).when(a > 0, 1.0).otherwise(b),
    "remainder": lambda a, b: F.when(b != 0, a - b * F.floor(a / b)), "true_divide": F.try_divide, "float_power": F.pow,
}
REDUCE = {
    "sum": F.sum, "mean": F.avg, "std": F.stddev_pop, "var": F.var_pop, "min": F.min, "max": F.max, "prod": F.product, "median": F.median, "count": F.count,
    "ptp": lambda c: F.max(c) - F.min(c), "any": lambda c: F.max(c != 0), "all": lambda c: F.min(c != 0), "count_nonzero": lambda c: F.count_if(c != 0),
}
# aggregates pass over nulls, so the forms that pass over missing values are the same
REDUCE |= {f"nan{n}": REDUCE[n] for n in ("sum", "mean", "std", "var", "min", "max", "prod", "median")}
#: Names that would take values out of the order of time; they are refused.
BLOCKED = ("sort", "lexsort", "sort_complex", "partition", "argpartition", "take", "take_along_axis", "extract", "compress", "choose", "select", "delete", "fft")


def unary(name: str, column: Column | str) -> Column:
    return _known(UNARY, name)(F.col(column) if isinstance(column, str) else column)


def binary(name: str, column: Column | str, other: Column | float) -> Column:
    return _known(BINARY, name)(F.col(column) if isinstance(column, str) else column, other if isinstance(other, Column) else F.lit(other))


def reduce(name: str, column: Column | str) -> Column:
    return _known(REDUCE, name)(F.col(column) if isinstance(column, str) else column)


def percentile(column: str, q: float) -> Column:
    """Interpolating percentile, ``q`` from 0 to 100."""
    return F.percentile(column, F.lit(q / 100.0))


def quantile(column: str, q: float) -> Column:
    """Interpolating quantile, ``q`` from 0 to 1."""
    return F.percentile(column, F.lit(float(q)))


def average(column: str, weights: str | None = None) -> Column:
    """Mean, or the mean weighted by another column; null where the weights sum to zero."""
    if weights is None:
        return F.avg(column)
    held = F.col(column).isNotNull()
    return F.try_divide(F.sum(F.col(column) * F.col(weights)), F.sum(F.when(held, F.col(weights))))


def where(condition: Column | str, a: Column | float, b: Column | float) -> Column:
    """``a`` where the condition holds, ``b`` elsewhere."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return F.when(c, a if isinstance(a, Column) else F.lit(a)).otherwise(b if isinstance(b, Column) else F.lit(b))


def digitize(column: str, edges: list[float], right: bool = False) -> Column:
    """How many of the ascending edges a value has reached; with ``right`` an edge belongs to the bin below it."""
    array = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(array, lambda e: e < F.col(column) if right else e <= F.col(column)))


def matmul(columns: list[str], matrix: list[list[float]]) -> list[Column]:
    """A row of columns times a matrix (a row per column): one expression for each column of the product."""
    if any(len(row) != len(matrix[0]) for row in matrix) or len(matrix) != len(columns):
        raise ValueError("the matrix needs a row for each column, all as long")
    return [sum((F.col(c) * F.lit(float(row[k])) for c, row in zip(columns, matrix)), F.lit(0.0)) for k in range(len(matrix[0]))]


def dot(columns: list[str], vector: list[float]) -> Column:
    """A row of columns times a vector."""
    return matmul(columns, [[x] for x in vector])[0]


def cov(columns: list[str], ddof: int = 1) -> dict[tuple[str, str], Column]:
    """Covariance of each pair of columns, as aggregates."""
    how = F.covar_samp if ddof else F.covar_pop
    return {(a, b): how(a, b) for i, a in enumerate(columns) for b in columns[i:]}


def corrcoef(columns: list[str]) -> dict[tuple[str, str], Column]:
    """Correlation of each pair of columns, as aggregates."""
    return {(a, b): F.corr(a, b) for i, a in enumerate(columns) for b in columns[i:]}


def _known(table: dict, name: str):
    if name in BLOCKED:
        raise TypeError(f"{name} does not keep the order of time")
    if name not in table:
        raise ValueError(f"unknown function {name}")
    return table[name]


def clip(column: str, low: float, high: float) -> Column:
    return F.least(F.greatest(F.col(column), F.lit(low)), F.lit(high))


def cumulative(samples: DataFrame, name: str, by: list[str], value: str = "v") -> DataFrame:
    """Running sum, minimum, maximum or product along time, as ``acc``."""
    w = Window.partitionBy(*by).orderBy("t_ns").rowsBetween(Window.unboundedPreceding, 0)
    how = {"cumsum": F.sum, "cummax": F.max, "cummin": F.min, "cumprod": F.product}[name.removeprefix("nan")]
    return samples.withColumn("acc", how(value).over(w))


def diff(samples: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """Step from the sample before, as ``dv``; the first of each group drops."""
    w = Window.partitionBy(*by).orderBy("t_ns")
    return samples.withColumn("dv", F.col(value) - F.lag(value).over(w)).where("dv is not null")


def unwrap(samples: DataFrame, by: list[str], value: str = "v", period: float = 2 * math.pi, keep_half: bool = True) -> DataFrame:
    """Steps of more than half a period are taken the short way round, as ``acc``.

    A step of exactly half a period keeps its sign, or else goes down.
    """
    w = Window.partitionBy(*by).orderBy("t_ns")
    step = F.col(value) - F.lag(value).over(w)
    rows = samples.withColumn("_d", step)
    turns = F.floor((F.col("_d") + period / 2) / period)
    if keep_half:
        turns = F.when((F.col("_d") > 0) & (F.col("_d") - period * turns == -period / 2), turns - 1).otherwise(turns)
    back = F.when(F.abs("_d") < period / 2, 0.0).otherwise(-period * turns)
    rows = rows.withColumn("_c", F.coalesce(back, F.lit(0.0)))
    return rows.withColumn("acc", F.col(value) + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_d", "_c")


def gradient(samples: DataFrame, by: list[str], value: str = "v", spacing: float = 1.0) -> DataFrame:
    """Change per sample along time, as ``dv``: central inside, one-sided at both ends; null for a lone sample."""
    w = Window.partitionBy(*by).orderBy("t_ns")
    before, after, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return samples.withColumn("dv", F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * spacing)).when(after.isNotNull(), (after - v) / spacing).when(before.isNotNull(), (v - before) / spacing))


def correlate(samples: DataFrame, kernel: list[float], by: list[str], value: str = "v") -> DataFrame:
    """Sliding product with a kernel that is not turned, as long as the signal and centred."""
    from ..operators.series import convolve

    k = len(kernel)
    turned = [float(a) for a in kernel[::-1]]
    # the centre of a turned kernel of even length lies one place earlier
    return convolve(samples, turned if k % 2 else [*turned, 0.0], by, value) if k % 2 else convolve(samples, [0.0, *turned], by, value)


def argwhere(samples: DataFrame, condition: str, by: list[str]) -> DataFrame:
    """by, i and t_ns: the places, counted from 0, and times at which a condition holds."""
    rows = samples.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("t_ns")).cast("long") - 1)
    return rows.where(condition).select(*by, "i", "t_ns")


def argbest(samples: DataFrame, by: list[str], value: str = "v", largest: bool = True) -> DataFrame:
    """Time and value of the extreme sample of each group; of equals the first."""
    key = F.struct(F.col(value) if largest else -F.col(value), -F.col("t_ns"))
    return samples.where(f"{value} is not null").groupBy(*by).agg(F.max_by(F.struct("t_ns", value), key).alias("_b")).select(*by, "_b.*")


def histogram(samples: DataFrame, edges: list[float], by: list[str] | None = None, value: str = "v") -> DataFrame:
    """bin and n on given edges; the last bin is closed, and values outside all bins drop."""
    from ..operators.tuning import feature_bin

    by = by or []
    rows = samples.withColumn("bin", feature_bin(value, edges)).where("bin is not null")
    return rows.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """Signals one after the other; each must begin after the one before ends."""
    from functools import reduce as fold

    spans = [p.agg(F.min("t_ns").alias("a"), F.max("t_ns").alias("b")).first() for p in parts]
    spans = [s for s in spans if s.a is not None]
    if any(s.b >= t.a for s, t in zip(spans, spans[1:])):
        raise RuntimeError("times must increase from one signal to the next")
    return fold(DataFrame.unionByName, parts)


def stack(parts: list[DataFrame], label: str = "i") -> DataFrame:
    """Signals on the same times side by side: t_ns, ``label`` (which part) and v. The same rows serve ``column_stack``, ``hstack``
    and ``dstack``, whose axes are columns of labels here. Parts that differ in their times are refused."""
    from functools import reduce as fold

    times = [p.agg(F.count("*").alias("n"), F.sum(F.xxhash64("t_ns").cast("decimal(38,0)")).alias("h")).first() for p in parts]
    if len(set(times)) > 1:
        raise ValueError("signals that are stacked need the same times")
    return fold(DataFrame.unionByName, [p.withColumn(label, F.lit(k)) for k, p in enumerate(parts)])


def split(samples: DataFrame, n: int, by: list[str]) -> DataFrame:
    """``piece``: the samples of each group in ``n`` runs of equal length, longer ones first."""
    return samples.withColumn("piece", F.ntile(n).over(Window.partitionBy(*by).orderBy("t_ns")) - 1)


def wide(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A frame in long form (t_ns, col, v) with a column for each label."""
    return frame.groupBy("t_ns").pivot("col", columns).agg(F.first("v"))


def long(frame: DataFrame, columns: list[str]) -> DataFrame:
    """A wide frame in long form (t_ns, col, v)."""
    return frame.unpivot("t_ns", columns, "col", "v")
