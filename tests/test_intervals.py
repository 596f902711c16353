"""Interval sets: known values, and random sets against a sweep on a grid."""

import random

import pytest
from pyspark.sql import functions as F

from epochal.operators import intervals as iv

from .helpers import S, iset, pairs, samples


def test_known_values(spark):
    a, b = iset(spark, [(0, 10), (30, 70)]), iset(spark, [(40, 100)])
    assert pairs(iv.intersect(a, b)) == [(40, 70)]
    assert pairs(iv.union(a, b)) == [(0, 10), (30, 100)]
    assert pairs(iv.set_diff(a, b)) == [(0, 10), (30, 40)] and pairs(iv.set_diff(b, a)) == [(70, 100)]
    c = iset(spark, [(0, 5), (10, 15), (16, 20), (25, 40)])
    assert pairs(iv.drop_short(c, 5 * S)) == [(25, 40)] and pairs(iv.drop_long(c, 5 * S)) == [(16, 20)]
    assert pairs(iv.merge_close(iset(spark, [(0, 5), (10, 15), (16, 20)]), 4 * S)) == [(0, 5), (10, 20)]
    touch = iset(spark, [(0, 10), (10, 15), (15, 20)])
    assert pairs(iv.normalize(touch)) == [(0, 10 - 1e-6), (10, 15 - 1e-6), (15, 20)]
    assert pairs(iv.union_all([iset(spark, [(0, 10)]), iset(spark, [(10, 20)])])) == [(0, 20)]
    assert pairs(iv.normalize(iset(spark, [(5, 5), (9, 8), (1, 3), (2, 6)]))) == [(1, 6)]
    assert pairs(iv.normalize(iset(spark, [(10, 3), (2, 12)]), strict=False)) == [(2, 3), (10, 12)]
    assert pairs(iv.split(iset(spark, [(0, 10), (20, 22)]), 3 * S)) == [(0, 3 - 1e-6), (3, 6 - 1e-6), (6, 9 - 1e-6)]
    assert iv.tot_length(c).first()[0] == 29 * S and pairs(iv.time_span(c)) == [(0, 40)]
    assert [r.t_ns for r in iv.centers(iset(spark, [(0, 10)]), 0.2).collect()] == [2 * S]
    with pytest.raises(RuntimeError):
        iv.centers(c, 1)


def test_drops_number_each_group(spark):
    both = iset(spark, [(0, 5), (10, 40), (50, 90)], k=["1"] * 3).union(iset(spark, [(0, 20), (30, 32), (40, 70)], k=["2"] * 3))
    rows = lambda df: sorted((r.k, r.epoch_id, r.start_ns // S) for r in df.collect())
    assert rows(iv.drop_short(both, 10 * S, ["k"])) == [("1", 0, 10), ("1", 1, 50), ("2", 0, 0), ("2", 1, 40)]
    assert rows(iv.drop_long(both, 35 * S, ["k"])) == [("1", 0, 0), ("1", 1, 10), ("2", 0, 0), ("2", 1, 30), ("2", 2, 40)]


def test_support(spark):
    x = samples(spark, [0, 10, 21, 22])
    assert pairs(iv.find_support(x, 10 * S)) == [(0, 10 + 1e-6), (21, 22 + 1e-6)]


def test_metadata(spark):
    a, b = iset(spark, [(0, 10), (20, 30)], x=["p", "q"], k=["1", "2"]), iset(spark, [(5, 25)], y=["r"], k=["3"])
    both = iv.intersect(a, b)
    assert both.columns == ["epoch_id", "start_ns", "end_ns", "x", "y"]
    assert [(r.x, r.y) for r in both.orderBy("start_ns").collect()] == [("p", "r"), ("q", "r")]
    assert [r.x for r in iv.set_diff(a, b).orderBy("start_ns").collect()] == ["p", "q"]


@pytest.mark.parametrize("seed", range(3))
def test_random_sets_on_a_grid(spark, seed):
    rng = random.Random(seed)

    def some():
        cuts = sorted(rng.sample(range(0, 400), 40))
        return [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]

    a, b = some(), some()

    def cells(sets):
        return {c for s, e in sets for c in range(s, e)}

    def back(df):
        return {c for s, e in pairs(df) for c in range(round(s), round(e + 1e-3))}

    x, y = iset(spark, a), iset(spark, b)
    assert back(iv.intersect(x, y)) == cells(a) & cells(b)
    assert back(iv.union(x, y)) == cells(a) | cells(b) == back(iv.union_all([x, y]))
    assert back(iv.set_diff(x, y)) == cells(a) - cells(b)


def test_empty(spark):
    e, a = iset(spark, []), iset(spark, [(0, 1)])
    assert pairs(iv.union(a, e)) == pairs(iv.set_diff(a, e)) == [(0, 1)] and pairs(iv.intersect(a, e)) == pairs(iv.set_diff(e, a)) == []


def test_lengths_by_key(spark):
    df = iset(spark, [(0, 1), (2, 5)]).unionByName(iset(spark, [(7, 9)])).withColumn("unit", F.when(F.col("start_ns") >= 7 * S, 1).otherwise(0))
    assert sorted(map(tuple, iv.tot_length(df, ["unit"]).collect())) == [(0, 4 * S), (1, 2 * S)]
    assert sorted(map(tuple, iv.time_span(df, ["unit"]).collect())) == [(0, 0, 5 * S), (1, 7 * S, 9 * S)]
    assert iv.tot_length(df).first().tot_ns == 6 * S


def test_total_length_beyond_a_bigint(spark):
    wide = spark.range(3).selectExpr("cast(id % 2 as int) as unit", "0L as start_ns", "4611686018427387904L as end_ns")
    assert iv.tot_length(wide).first().tot_ns == 3 << 62
    assert sorted((r.unit, int(r.tot_ns)) for r in iv.tot_length(wide, ["unit"]).collect()) == [(0, 2 << 62), (1, 1 << 62)]
    assert iv.tot_length(wide.where("unit = 1")).dtypes == iv.tot_length(wide.where("unit > 1")).dtypes == [("tot_ns", "bigint")]
    assert iv.tot_length(wide.where("unit > 1")).first().tot_ns is None
