"""Making series, groups and intervals, choosing from them, and options."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.functions.options import Options
from epochal.operators import construct, former, joins, selecting, series, tuning

from .helpers import S, frame, iset, pairs, samples


def test_series(spark):
    e = iset(spark, [(1, 2.5)])
    assert [r.t_ns for r in construct.ts(spark, [3, 1, 2], support=e).orderBy("t_ns").collect()] == [S, 2 * S]
    assert [r.t_ns for r in construct.ts(spark, [1.0005], "ms").collect()] == [1_000_500]
    got = construct.tsd(spark, [2, 1], [5.0, float("nan")]).orderBy("t_ns").collect()
    assert [(r.t_ns, r.v) for r in got] == [(S, None), (2 * S, 5.0)]
    f = construct.tsd_frame(spark, [0, 1], [[1, 2], [3, 4]], ["a", "b"])
    assert sorted(map(tuple, f.collect())) == [(0, "a", 1.0), (0, "b", 2.0), (S, "a", 3.0), (S, "b", 4.0)]
    assert {r.col for r in construct.tsd_frame(spark, [0, 1], [1, 2], ["a", "b"]).collect()} == {"0"}
    t = construct.tsd_tensor(spark, [0, 1], np.arange(8).reshape(2, 2, 2))
    assert t.columns == ["t_ns", "i", "j", "v"] and t.where("t_ns > 0 and i = 1 and j = 0").first().v == 6.0
    for bad in (lambda: construct.tsd_tensor(spark, [0], [[1]]), lambda: construct.tsd(spark, [0], [1, 2]), lambda: construct.ts(spark, [0], "h")):
        with pytest.raises(ValueError):
            bad()


def test_interval_sets(spark):
    assert pairs(construct.interval_set(spark, 0, 5)) == [(0, 5)]
    got = construct.interval_set(spark, [0, 5, 10], [5, 7, 12], metadata={"label": ["a", "b", "c"]})
    assert [(r.start_ns, r.end_ns, r.label) for r in got.orderBy("start_ns").collect()] == [(0, 5 * S - 1000, "a"), (5 * S, 7 * S, "b"), (10 * S, 12 * S, "c")]
    merged = construct.interval_set(spark, [0, 3], [5, 7], metadata={"label": ["a", "b"]})
    assert pairs(merged) == [(0, 7)] and "label" not in merged.columns
    with pytest.raises(ValueError):
        construct.interval_set(spark, [0], [1], metadata={"label": ["a", "b"]})


def test_groups(spark):
    x, units, support = construct.ts_group(spark, {1: [0, 1, 2], 0: [1, 4], 2: []}, metadata={"area": {0: "p", 1: "q"}})
    assert x.count() == 5 and pairs(support) == [(0, 4)]
    assert [(r.unit, r.rate, r.area) for r in units.orderBy("unit").collect()] == [(0, 0.5, "p"), (1, 0.75, "q"), (2, 0.0, None)]
    x, units, _ = construct.ts_group(spark, [[0, 1], [5]], support=iset(spark, [(0, 2)]))
    assert x.count() == 2 and [r.rate for r in units.orderBy("unit").collect()] == [1.0, 0.0]
    for bad in ({0.5: [1]}, {"0": [1], 0: [2]}):
        with pytest.raises(ValueError):
            construct.ts_group(spark, bad)
    with pytest.raises(RuntimeError):
        construct.ts_group(spark, {0: [1]})


def test_selecting(spark):
    x = samples(spark, range(10), [float(k) for k in range(10)]).unionByName(samples(spark, [3, 4], [7.0, 8.0], unit=5))

    def got(places):
        return [r.t_ns // S for r in selecting.by_place(x.where("unit = 0"), places).orderBy("t_ns").collect()]

    t = list(range(10))
    assert got(3) == [3] and got(-1) == [9] and got([1, -2]) == [1, 8]
    for s in (slice(2, 5), slice(None, None, 3), slice(-4, None), slice(1, -1, 2), slice(-100, 3)):
        assert got(s) == t[s]
    assert selecting.by_place(x, 0, ["unit"]).count() == 2 and selecting.by_mask(x, "v > 7").count() == 3
    assert selecting.units(x, 5).count() == 2 and selecting.units(x, [0, 5]).count() == 12
    with pytest.raises(KeyError):
        selecting.units(x, [0, 9])
    with pytest.raises(ValueError):
        got(slice(None, None, -1))
    f = construct.tsd_frame(spark, [0, 1], [[1, 2], [3, 4]], ["a", "b"])
    assert selecting.columns(f, "b").columns == ["t_ns", "v"] and selecting.columns(f, ["a"]).count() == 2
    e = iset(spark, [(0, 1), (2, 3), (4, 5)], label=["a", "b", "c"])
    assert [(r.epoch_id, r.label) for r in selecting.intervals(e, [0, 2]).orderBy("epoch_id").collect()] == [(0, "a"), (1, "c")]
    assert selecting.info(e, "label").columns == ["epoch_id", "label"]


def test_options(spark):
    o = Options(spark)
    assert o.time_index_precision == 9 and o.backend == "spark" and not o.get("suppress_conversion_warnings")
    o.set("suppress_conversion_warnings", True)
    assert Options(spark).get("suppress_conversion_warnings")
    o.restore_defaults()
    assert not o.get("suppress_conversion_warnings")
    with pytest.raises(ValueError):
        o.set("other", True)
    with pytest.raises(AttributeError):
        o.time_index_precision = 3


def test_regular_steps_and_groups_of_values(spark):
    assert series.is_regular(samples(spark, [0, 1, 2]), ["unit"]) and not series.is_regular(samples(spark, [0, 1, 2.5]), ["unit"])
    group = samples(spark, [1, 2], unit=0).unionByName(samples(spark, [2.6], unit=1)).select("unit", "t_ns")
    target = samples(spark, [1.1, 2.4], [5.0, 6.0]).select(F.lit(0).alias("epoch_id"), "t_ns", "v")
    got = frame(joins.asof(group.withColumn("epoch_id", F.lit(0)), target, "closest", ["epoch_id"]), "unit", "t_ns")
    assert got.matched.tolist() == [5.0, 6.0, 6.0]


def test_former_names(spark):
    e = iset(spark, [(0, 10)])
    group = samples(spark, [1, 2, 6], unit=0).unionByName(samples(spark, [3, 7], unit=1)).select("unit", "t_ns")
    feature = samples(spark, range(10), [k % 4 for k in map(float, range(10))]).select("t_ns", F.col("v").alias("x"), (F.col("v") + 0).alias("y"))
    edges = {"x": [0.0, 2.0, 4.0]}
    with pytest.warns(DeprecationWarning):
        old = former.compute_1d_tuning_curves(group, feature, e, edges, 1.0)
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, tuning.tuning_curves(group, feature, e, edges, 1.0).collect()))
    with pytest.warns(DeprecationWarning):
        assert former.compute_2d_tuning_curves(group, feature, e, {**edges, "y": [0.0, 4.0]}, 1.0).count() == 4
    with pytest.warns(DeprecationWarning):
        assert former.compute_1d_mutual_info(old).count() == 2
    counts = spark.createDataFrame([(0, 0, 0, 3), (0, 0, 1, 0)], "epoch_id int, bin long, unit int, n long")
    with pytest.warns(DeprecationWarning):
        assert former.decode_1d(counts, old, S).count() == 1
    with pytest.raises(ValueError), pytest.warns(DeprecationWarning):
        former.compute_2d_tuning_curves(group, feature, e, edges, 1.0)
