"""Tensor series and array functions against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions import columns
from epochal.operators import filtering, groups, intervals, joins, randomize, series, tensors

from .helpers import S, frame, iset, pairs, samples


def made(spark, x):
    rows = [(round(t * S), x[t].tolist()) for t in range(len(x))]
    return tensors.from_arrays(spark.createDataFrame(rows, "t_ns long, v array<array<double>>"))


def back(df, dims=("i", "j")):
    return np.array([r.v for r in tensors.to_arrays(df, list(dims)).orderBy("t_ns").collect()])


def test_tensor_axes(spark):
    x = np.arange(24.0).reshape(4, 2, 3)
    t = made(spark, x)
    assert tensors.shape(t) == (4, 2, 3) and np.array_equal(back(t), x)
    assert np.array_equal(back(tensors.reshape(t, ["i", "j"], [2, 3], ["a", "b"], [3, -1]), "ab"), x.reshape(4, 3, 2))
    assert np.array_equal(back(tensors.ravel(t, ["i", "j"], [2, 3]), ["col"]), x.reshape(4, -1))
    assert np.array_equal(back(t, tensors.transpose(["i", "j"])), x.transpose(0, 2, 1))
    assert tensors.moveaxis(["a", "b", "c"], 0, -1) == ["b", "c", "a"] and tensors.swapaxes(["a", "b", "c"], 0, 2) == ["c", "b", "a"]
    assert np.array_equal(back(tensors.flip(t, "j", 3)), x[:, :, ::-1]) and np.array_equal(back(tensors.roll(t, "j", 3, 1)), np.roll(x, 1, 2))
    for k in range(4):
        assert np.array_equal(back(tensors.rot90(t, ("i", "j"), (2, 3), k)), np.rot90(x, k, (1, 2)))
    assert np.array_equal(back(tensors.select(t, i=1), ["j"]), x[:, 1]) and np.array_equal(back(tensors.select(t, j=slice(0, None, 2))), x[:, :, ::2])
    assert np.array_equal(back(tensors.select(t, j=[2, 0])), x[:, :, [2, 0]])
    one, left = tensors.squeeze(tensors.expand_dims(t, "k"), ["i", "j", "k"], [2, 3, 1])
    assert left == ["i", "j"] and np.array_equal(back(one), x)
    assert np.allclose(back(tensors.reduce_axis(t, ["i", "j"], ["i"], "mean"), ["j"]), x.mean(1))
    w = spark.createDataFrame([(j, k, float(j - k)) for j in range(3) for k in range(2)], "j int, k int, v double")
    assert np.allclose(back(tensors.einsum(t, w, ["j"], ["t_ns", "i"], ["k"]), "ik"), np.einsum("tij,jk->tik", x, np.array([[j - k for k in range(2)] for j in range(3)])))
    with pytest.raises(TypeError):
        tensors.flip(t, "t_ns", 4)
    with pytest.raises(ValueError):
        tensors.reshape(t, ["i", "j"], [2, 3], ["a"], [5])


def test_series_operators_take_axes(spark):
    x = np.random.default_rng(1).normal(size=(20, 2, 3))
    t = made(spark, x)
    e = iset(spark, [(2, 5), (9, 14.5)])
    kept = back(joins.restrict(t, e))
    assert np.array_equal(kept, x[[2, 3, 4, 5, 9, 10, 11, 12, 13, 14]])
    means = frame(series.bin_average(t, iset(spark, [(0, 19)]), 4 * S, by=["i", "j"]), "bin", "i", "j")
    assert np.allclose(means.v.to_numpy().reshape(-1, 2, 3)[0], x[:4].mean(0))
    smooth = back(series.convolve(t, [0.25, 0.5, 0.25], ["i", "j"]))
    assert np.allclose(smooth[:, 1, 2], np.convolve(x[:, 1, 2], [0.25, 0.5, 0.25], "same"))


def signal(spark, v):
    return samples(spark, range(len(v)), [float(a) for a in v])


def test_array_functions(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=30)
    x = signal(spark, v)
    assert np.allclose(frame(columns.gradient(x, ["unit"]), "t_ns").dv, np.gradient(v))
    angle = np.cumsum(rng.normal(scale=2, size=40))
    wrapped = (angle + np.pi) % (2 * np.pi) - np.pi
    assert np.allclose(frame(columns.unwrap(signal(spark, wrapped), ["unit"]), "t_ns").acc, np.unwrap(wrapped))
    edge = [0, math.pi, 0, -math.pi, math.pi]
    assert np.allclose(frame(columns.unwrap(signal(spark, edge), ["unit"]), "t_ns").acc, np.unwrap(edge))
    for k in ([1.0, 2.0, 4.0], [1.0, 2.0, 4.0, 8.0]):
        assert np.allclose(frame(columns.correlate(x, k, ["unit"]), "t_ns").v, np.correlate(v, k, "same"))
    assert [r.i for r in columns.argwhere(x, "v > 0.5", ["unit"]).orderBy("i").collect()] == np.flatnonzero(v > 0.5).tolist()
    edges = [-1.0, 0.0, 1.0]
    got = frame(x.select("t_ns", columns.digitize("v", edges).alias("a"), columns.digitize("v", edges, True).alias("b"), columns.where("v > 0", F.col("v"), 0.0).alias("c")), "t_ns")
    assert got.a.tolist() == np.digitize(v, edges).tolist() and got.b.tolist() == np.digitize(v, edges, True).tolist() and np.array_equal(got.c, np.where(v > 0, v, 0))
    y = x.withColumns({"w": F.abs("v") + 1, "u": F.col("v") * F.col("v")})
    r = y.agg(columns.average("v", "w").alias("a"), columns.quantile("v", 0.3).alias("q"), columns.reduce("nansum", "v").alias("s"), columns.cov(["v", "u"])["v", "u"].alias("c"), columns.corrcoef(["v", "u"])["v", "u"].alias("r")).first()
    assert np.allclose([r.a, r.q, r.s, r.c, r.r], [np.average(v, weights=abs(v) + 1), np.quantile(v, 0.3), v.sum(), np.cov(v, v * v)[0, 1], np.corrcoef(v, v * v)[0, 1]])
    m = [[1.0, 2.0], [3.0, 4.0]]
    got = frame(y.select("t_ns", *[c.alias(f"p{k}") for k, c in enumerate(columns.matmul(["v", "u"], m))], columns.dot(["v", "u"], [2.0, -1.0]).alias("d")), "t_ns")
    both = np.column_stack([v, v * v])
    assert np.allclose(got[["p0", "p1"]], both @ m) and np.allclose(got.d, both @ [2.0, -1.0])
    logic = frame(x.select("t_ns", columns.binary("logical_and", "v", 0).alias("a"), columns.binary("logical_or", "v", 0).alias("b")), "t_ns")
    assert not logic.a.any() and logic.b.all()


def test_stack(spark):
    a, b = signal(spark, [1, 2]), signal(spark, [3, 4])
    assert sorted((r.t_ns // S, r.i, r.v) for r in columns.stack([a, b]).collect()) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]
    with pytest.raises(ValueError):
        columns.stack([a, signal(spark, [1, 2, 3])])


def test_slices(spark):
    x = samples(spark, [1, 2, 3, 4], [1.0, 2.0, 3.0, 4.0])

    def got(*args, **kw):
        return [r.t_ns / S for r in series.get_slice(x, *args, **kw).orderBy("t_ns").collect()]

    at = lambda t: round(t * S)
    assert got(at(2.4), mode="before_t") == [2] and got(at(2.4), mode="after_t") == [3] and got(at(2.4), mode="closest_t") == [2]
    assert got(at(0.5), mode="before_t") == [] and got(at(4.5), mode="after_t") == []
    assert got(at(1.5), at(3.2), mode="before_t") == [1, 2] and got(at(1.5), at(3.2), mode="after_t") == [2, 3]
    assert got(at(0), at(3.2), mode="before_t") == [1, 2] and got(at(1.5), at(9), mode="after_t") == [2, 3, 4] and got(at(0), at(0.5), mode="before_t") == []
    assert got(at(1.4), at(3.6), mode="closest_t") == [1, 2, 3] and got(at(2), at(3)) == [2, 3]
    with pytest.raises(ValueError):
        got(at(2), n_points=3)
    with pytest.raises(ValueError):
        got(at(2), mode="other")


def test_fill_and_assign(spark):
    x = samples(spark, [1, 2]).drop("v")
    assert [r.v for r in series.fillna(x, 3).collect()] == [3.0, 3.0]
    with pytest.raises(TypeError):
        series.fillna(x, "a")
    assert [r.v for r in series.assign(signal(spark, [1, 5]), "v > 2", 0.0).orderBy("t_ns").collect()] == [1.0, 0.0]


def test_long_kernels_go_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 50)
    rng = np.random.default_rng(3)
    v = rng.normal(size=333)
    for k in (65, 90, 200):
        a = rng.normal(size=k)
        full = np.convolve(v, a)
        x = signal(spark, v)
        assert np.allclose(frame(series.convolve(x, a.tolist(), ["unit"]), "t_ns").v, full[(k - 1) // 2 :][:333])
        assert np.allclose(frame(series.convolve(x, a.tolist(), ["unit"], trim="left", out="w"), "t_ns").w, full[k - 1 :][:333].tolist() + [0.0] * max(0, 333 - len(full[k - 1 :])))
        assert np.allclose(frame(series.convolve(x, a.tolist(), ["unit"], trim="right"), "t_ns").v, full[:333])


def test_decimate_kernels(spark):
    v = np.sin(np.arange(400) / 9)
    got = frame(filtering.decimate(signal(spark, v), 4, ["unit"]), "t_ns")
    assert len(got) == 100 and np.allclose(got.v[10:90] / 10 ** (-0.05 / 20) ** 2, v[::4][10:90], atol=2e-2)
    assert np.allclose(frame(filtering.decimate(signal(spark, np.ones(60)), 4, ["unit"], filter_type="fir"), "t_ns").v[3:12], 1)
    with pytest.raises(ValueError):
        filtering.decimate(signal(spark, v), 4, ["unit"], filter_type="other")


def test_recursive_filters_over_blocks(spark, monkeypatch):
    from epochal.functions.signal import butter_sections, forward_backward

    monkeypatch.setattr(filtering, "BLOCK", 100)
    v = np.random.default_rng(4).normal(size=1500)
    for kind, cutoff in (("lowpass", 20.0), ("bandpass", (10.0, 30.0)), ("highpass", 30.0), ("bandstop", (20.0, 30.0))):
        got = frame(filtering.apply_filter(signal(spark, v), kind, cutoff, 100.0, ["unit"]), "t_ns")
        assert np.allclose(got.v, forward_backward(butter_sections(kind, cutoff, 100.0), v), rtol=0, atol=1e-12)


def test_surrogates_with_ties(spark):
    x = samples(spark, [5] * 5)
    for got in (randomize.jitter_timestamps(x, S), randomize.resample_timestamps(x, 0, 100 * S)):
        assert len({r.t_ns for r in got.collect()}) == 5
    assert randomize.jitter_timestamps(x, S).select("t_ns").agg(F.min("t_ns") >= 4 * S, F.max("t_ns") <= 6 * S).first() == (True, True)


def test_groups_and_epochs(spark):
    a, b = samples(spark, [1, 2], unit=0).select("unit", "t_ns"), samples(spark, [3], [7.0], unit=1)
    with pytest.raises(ValueError):
        groups.merge_groups([a, b])
    assert groups.merge_groups([a, b], ignore_metadata=True).count() == 3
    e, f = iset(spark, [(0, 2)]), iset(spark, [(1, 4)])
    with pytest.raises(ValueError):
        groups.merge_groups([a, a.withColumn("unit", F.lit(9))], supports=[e, f])
    assert groups.merge_groups([a, a.withColumn("unit", F.lit(9))], supports=[e, f], reset_time_support=True).count() == 4
    assert pairs(groups.merged_support([e, f])) == [(0, 4)]
    units = spark.createDataFrame([(0, 1.0), (1, 2.0)], "unit int, rate double")
    more = groups.set_info(units, label={0: "x", 1: "y"}, depth=3)
    assert [tuple(r) for r in groups.get_info(more, ["label", "depth"]).collect()] == [(0, "x", 3), (1, "y", 3)]
    with pytest.raises(ValueError):
        groups.set_info(units, rate=1)
    s = iset(spark, [(0, 2), (3, 5)], label=["a", "b"])
    assert [(r.t_ns // S, r.label) for r in intervals.starts(s).orderBy("t_ns").collect()] == [(0, "a"), (3, "b")]
    assert [r.t_ns // S for r in intervals.ends(s).orderBy("t_ns").collect()] == [2, 5]
    assert pairs(intervals.apply_edges(s, lambda t: t * 2)) == [(0, 4), (6, 10)]
    cut = intervals.set_diff(iset(spark, [(0, 10), (20, 30)], label=["a", "b"]), iset(spark, [(4, 22)]))
    assert [(r.start_ns // S, r.end_ns // S, r.label) for r in cut.orderBy("start_ns").collect()] == [(0, 4, "a"), (22, 30, "b")]
    per = intervals.split(iset(spark, [(0, 5), (10, 15)]).withColumn("unit", F.col("epoch_id")), 2 * S, ["unit"])
    assert sorted((r.unit, r.epoch_id) for r in per.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
