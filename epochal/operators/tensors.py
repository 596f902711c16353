"""Tensor series: a value for each time and cell, in long form (t_ns, a column for each axis, v).

Axes beside time are whole numbers from 0, named by ``dims``. So a tensor is a group of signals keyed by its cells: all operators
on samples (restrict, count, bin_average, convolve, value_from and so on) take the axes as ``by``, and moving, turning or joining axes
is arithmetic on these columns, without a shuffle.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("i", "j")


def from_arrays(rows: DataFrame, dims: list[str] = list(DIMS), value: str = "v") -> DataFrame:
    """A tensor series from rows (t_ns, v) whose values are arrays of arrays, as deep as there are axes."""
    for d in dims:
        rows = rows.select(*[c for c in rows.columns if c != value], F.posexplode(value).alias(d, "_next")).withColumnRenamed("_next", value)
    return rows


def to_arrays(tensor: DataFrame, dims: list[str] = list(DIMS), value: str = "v", keys: list[str] | None = None) -> DataFrame:
    """Rows (keys, t_ns, v) with nested arrays; cells come in order of their places, and all of a time must be there."""
    keys = keys or []
    rows = tensor.select(*keys, "t_ns", *dims, F.col(value).alias("_v"))
    for k in range(len(dims) - 1, -1, -1):
        rest = dims[:k]
        rows = rows.groupBy(*keys, "t_ns", *rest).agg(F.transform(F.array_sort(F.collect_list(F.struct(dims[k], "_v"))), lambda x: x["_v"]).alias("_v"))
    return rows.withColumnRenamed("_v", value)


def shape(tensor: DataFrame, dims: list[str] = list(DIMS)) -> tuple[int, ...]:
    """The number of times and the length of each axis."""
    found = tensor.agg(F.count_distinct("t_ns"), *[F.max(d) for d in dims]).first()
    return (found[0], *[(n if n is not None else -1) + 1 for n in found[1:]])


def _flat(dims: list[str], sizes: list[int]) -> Column:
    at = F.lit(0)
    for d, n in zip(dims, sizes, strict=True):
        at = at * n + F.col(d)
    return at


def reshape(tensor: DataFrame, dims: list[str], sizes: list[int], new_dims: list[str], new_sizes: list[int]) -> DataFrame:
    """Cells in the same order under other axes; one new size can be -1."""
    total = prod(sizes)
    if new_sizes.count(-1) == 1:
        new_sizes = [total // -prod(new_sizes) if n == -1 else n for n in new_sizes]
    if prod(new_sizes) != total:
        raise ValueError(f"{sizes} cells cannot become {new_sizes}")
    rows = tensor.withColumn("_at", _flat(dims, sizes)).drop(*dims)
    left = total
    for d, n in zip(new_dims, new_sizes, strict=True):
        left //= n
        rows = rows.withColumn(d, (F.floor(F.col("_at") / left) % n).cast("int"))
    return rows.drop("_at")


def ravel(tensor: DataFrame, dims: list[str], sizes: list[int], name: str = "col") -> DataFrame:
    """All axes beside time as one: a frame in long form."""
    return reshape(tensor, dims, sizes, [name], [-1])


def squeeze(tensor: DataFrame, dims: list[str], sizes: list[int]) -> tuple[DataFrame, list[str]]:
    """Without the axes of length one; the tensor and the axes that are left."""
    kept = [d for d, n in zip(dims, sizes, strict=True) if n != 1]
    return tensor.drop(*[d for d in dims if d not in kept]), kept


def expand_dims(tensor: DataFrame, name: str) -> DataFrame:
    """A further axis of length one."""
    return tensor.withColumn(name, F.lit(0))


def transpose(dims: list[str], order: list[int] | None = None) -> list[str]:
    """The axes in another order, reversed without one. Rows stay as they are: only what reads the axes in order sees it."""
    return [dims[k] for k in (order if order is not None else range(len(dims) - 1, -1, -1))]


def moveaxis(dims: list[str], source: int, target: int) -> list[str]:
    """One axis in another place, the others in their order."""
    rest = [d for k, d in enumerate(dims) if k != source % len(dims)]
    rest.insert(target % len(dims), dims[source])
    return rest


def swapaxes(dims: list[str], a: int, b: int) -> list[str]:
    out = list(dims)
    out[a], out[b] = out[b], out[a]
    return out


def flip(tensor: DataFrame, dim: str, size: int) -> DataFrame:
    """One axis read backwards. The axis of time cannot be: times would not ascend."""
    if dim == "t_ns":
        raise TypeError("the order of time cannot be turned")
    return tensor.withColumn(dim, F.lit(size - 1) - F.col(dim))


def roll(tensor: DataFrame, dim: str, size: int, shift: int) -> DataFrame:
    """One axis turned on by some places."""
    return tensor.withColumn(dim, F.pmod(F.col(dim) + shift, F.lit(size)))


def rot90(tensor: DataFrame, dims: tuple[str, str], sizes: tuple[int, int], turns: int = 1) -> DataFrame:
    """The plane of two axes turned by quarters."""
    a, b = dims
    (n, m), at = sizes, (F.col(a), F.col(b))
    places = {0: at, 1: (F.lit(m - 1) - at[1], at[0]), 2: (F.lit(n - 1) - at[0], F.lit(m - 1) - at[1]), 3: (at[1], F.lit(n - 1) - at[0])}[turns % 4]
    return tensor.withColumns({a: places[0], b: places[1]})


def select(tensor: DataFrame, **places: int | slice | list[int]) -> DataFrame:
    """Cells by place: a number takes one and drops the axis; a list or a slice keeps several, counted anew from 0."""
    for dim, at in places.items():
        if isinstance(at, int):
            tensor = tensor.where(F.col(dim) == at).drop(dim)
        elif isinstance(at, slice):
            start, step = at.start or 0, at.step or 1
            inside = (F.col(dim) >= start) & ((F.col(dim) - start) % step == 0) & (F.lit(True) if at.stop is None else F.col(dim) < at.stop)
            tensor = tensor.where(inside).withColumn(dim, ((F.col(dim) - start) / step).cast("int"))
        else:
            order = F.array(*[F.lit(x) for x in at])
            tensor = tensor.where(F.col(dim).isin(at)).withColumn(dim, (F.array_position(order, F.col(dim)) - 1).cast("int"))
    return tensor


def reduce_axis(tensor: DataFrame, dims: list[str], over: list[str], how: str, value: str = "v") -> DataFrame:
    """A reducing function over some axes, the others and time kept."""
    from ..functions.columns import reduce

    return tensor.groupBy("t_ns", *[d for d in dims if d not in over]).agg(reduce(how, value).alias(value))


def einsum(a: DataFrame, b: DataFrame, on: list[str], keep_a: list[str], keep_b: list[str], value: str = "v") -> DataFrame:
    """Products of the cells of two tensors that agree in the axes ``on``, summed over those of them that are not kept.

    With ``t_ns`` in ``on`` and ``keep_a`` this is done for each time; without it, ``b`` is a plain table of weights.
    """
    y = b.select(*on, *[c for c in keep_b if c not in on], F.col(value).alias("_w"))
    kept = [*keep_a, *[c for c in keep_b if c not in keep_a]]
    return a.join(y, on).groupBy(*kept).agg(F.sum(F.col(value) * F.col("_w")).alias(value))
