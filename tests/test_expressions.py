"""Rounding, clock and place expressions against hand-computed values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldcast.functions import (clock_hour, haversine_km, hour_bucket, in_box, logit_bucket,
                                 round_half_up_int, snap, span_hours, week_of)
from fieldcast.functions import splines
from fieldcast.functions.splines import bspline, inner_probabilities
from fieldcast.operators.ranks import value_bucket


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_half_even(spark):
    got = values(spark, [(6.5,), (7.5,), (8.5,), (23.75,)], "h double", hour_bucket(F.col("h")))
    assert [g[0] for g in got] == [6, 8, 8, 24]
    got = values(spark, [(0.125,), (0.375,), (40.44,)], "x double", snap(F.col("x"), 0.25))
    assert [g[0] for g in got] == [0.0, 0.5, 40.5]


def test_points_round_up_at_half(spark):
    got = values(spark, [(-2.5,), (2.5,), (-2.51,)], "x double", round_half_up_int(F.col("x")))
    assert [g[0] for g in got] == [-2, 3, -3]


@pytest.mark.parametrize("text,hour", [("08:15", 8.25), ("8:15", 8.25), ("23:59", 23 + 59 / 60),
                                       ("24:00", None), ("8:60", None), ("", None), (None, None),
                                       ("08:15:00", None), ("noon", None)])
def test_clock(spark, text, hour):
    (got,), = values(spark, [(text,)], "t string", clock_hour(F.col("t")))
    assert got == hour


@pytest.mark.parametrize("hour,dur,hours", [(8.0, 1.0, [8, 9]), (6 + 40 / 60, 0.5, [6, 7, 8]),
                                            (23.5, 1.0, [23, 24, 25]), (8.3, 0.7, [8, 9])])
def test_training_span_has_both_ends(spark, hour, dur, hours):
    lo, hi = span_hours(F.col("d").cast("date"), F.col("h"), F.col("dur"))
    (a, b), = values(spark, [("1970-01-01", hour, dur)], "d string, h double, dur double", lo, hi)
    assert list(range(a, b + 1)) == hours


def test_week(spark):
    got = values(spark, [("2024-01-06",), ("2024-01-07",), ("2024-12-31",), ("2023-12-31",)],
                 "d string", week_of(F.col("d").cast("date")))
    assert [g[0] for g in got] == [0, 1, 52, 52]


def test_box_edges_count(spark):
    got = values(spark, [(40.19, -80.34), (40.68, -79.69), (40.681, -80.0), (40.4, -80.35)],
                 "a double, b double", in_box(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, True, False, False]


def test_distance(spark):
    (d,), = values(spark, [(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double",
                   haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert d == pytest.approx(math.pi * 6371.0088)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=200))
def test_buckets_never_decrease(spark, xs):
    xs = sorted(xs)
    got = values(spark, [(x, x * 100 - 50) for x in xs], "p double, v double", "p", "v",
                 logit_bucket(F.col("p")), value_bucket(F.col("v")))
    got.sort()
    assert [g[2] for g in got] == sorted(g[2] for g in got)
    assert [g[3] for g in got] == sorted(g[3] for g in got)


def brute_basis(x, knots, k=3):
    """Recursion in plain numpy; the upper end belongs to the last function."""
    x = np.asarray(x, float)
    last = max(i for i in range(len(knots) - 1) if knots[i] < knots[i + 1])
    b = [np.where((x >= knots[i]) & ((x < knots[i + 1]) | ((i == last) & (x == knots[i + 1]))), 1.0, 0)
         if knots[i] < knots[i + 1] else np.zeros_like(x) for i in range(len(knots) - 1)]
    for d in range(1, k + 1):
        n = []
        for i in range(len(b) - 1):
            v = np.zeros_like(x)
            if knots[i + d] > knots[i]:
                v = v + (x - knots[i]) / (knots[i + d] - knots[i]) * b[i]
            if knots[i + d + 1] > knots[i + 1]:
                v = v + (knots[i + d + 1] - x) / (knots[i + d + 1] - knots[i + 1]) * b[i + 1]
            n.append(v)
        b = n
    return np.stack(b, 1)


@pytest.mark.parametrize("inner", [[], [11.0]])
def test_spline_basis(spark, inner):
    xs = [5.0, 6.2, 9.9, 11.0, 15.5, 20.0]
    got = np.array(values(spark, [(x,) for x in xs], "x double",
                          *bspline(F.col("x"), 5.0, 20.0, inner)))
    full = brute_basis(xs, [5.0] * 4 + inner + [20.0] * 4)
    assert got.shape[1] == 3 + len(inner)
    np.testing.assert_allclose(got, full[:, 1:], atol=1e-12)
    np.testing.assert_allclose(full.sum(1), 1.0)
    # a cubic on one piece is the Bernstein basis
    if not inner:
        t = (np.array(xs) - 5) / 15
        np.testing.assert_allclose(got[:, 0], 3 * t * (1 - t) ** 2, atol=1e-12)


def test_knot_places():
    assert inner_probabilities(3) == [] and inner_probabilities(4) == [0.5]
    with pytest.raises(ValueError):
        inner_probabilities(2)


@pytest.mark.parametrize("knots", [[1.0] * 4 + [29.0] * 4, [5.0] * 4 + [9.3] + [20.0] * 4,
                                   [0.0] * 4 + [1.0, 1.0, 2.0] + [4.0] * 4])
def test_published_basis_equals_the_recursion(spark, knots):
    x = np.linspace(knots[0], knots[-1], 31)
    want = brute_basis(x, knots)
    points = spark.createDataFrame([(i, "v", float(v)) for i, v in enumerate(x)], "i int, variable string, x double")
    outside = spark.createDataFrame([(99, "v", knots[-1] + 7)], "i int, variable string, x double")
    got = splines.basis_values(points.unionByName(outside), splines.basis_table(spark, {"v": knots})).collect()
    table = np.zeros((100, want.shape[1]))
    for r in got:
        table[r["i"], int(r["term"][2:])] += r["value"]
    assert np.abs(table[:len(x), 1:] - want[:, 1:]).max() < 1e-12
    assert np.abs(table[99, 1:] - want[-1, 1:]).max() < 1e-12
