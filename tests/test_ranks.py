"""Counting kernels against all pairs."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrand.functions import ranks
from lodestrand.operators import rankstats, resample

VALUES = st.lists(st.tuples(st.integers(0, 12), st.integers(-4, 4)), min_size=1, max_size=40)


def all_slopes(t, v):
    return np.sort([(v[j] - v[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[i] < t[j]])


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_kendall_and_slopes_equal_all_pairs(rows):
    t, v = (np.array(c, float) for c in zip(*rows, strict=True))
    v = v + np.where(v > 2, 0.37, 0.0)
    s, tied_t, tied_v = ranks.kendall_sum(t, v)
    n = len(t)
    assert s == sum(np.sign(v[j] - v[i]) for i in range(n) for j in range(n) if t[i] < t[j])
    assert tied_t == sum(t[i] == t[j] for i in range(n) for j in range(i)) and tied_v == sum(v[i] == v[j] for i in range(n) for j in range(i))
    slopes = all_slopes(t, v)
    if len(slopes):
        places = sorted({0, len(slopes) // 3, len(slopes) // 2, len(slopes) - 1})
        assert ranks.ranked_slopes(t, v, places) == pytest.approx(slopes[places], abs=1e-12)


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_leave_one_out_equals_a_loop(rows):
    x, y = (np.array(c, float) for c in zip(*rows, strict=True))
    want = np.full(len(x), np.nan)
    for i in range(len(x)):
        a, b = (ranks.midranks(np.delete(c, i)) for c in (x, y))
        if len(a) > 1 and a.std() > 0 and b.std() > 0:
            want[i] = ((a - a.mean()) * (b - b.mean())).mean() / a.std() / b.std()
    got = ranks.leave_one_out_rho(x, y)
    assert np.isnan(got).tolist() == np.isnan(want).tolist() and got[~np.isnan(got)] == pytest.approx(want[~np.isnan(want)], abs=1e-9)


def test_slopes_of_longer_series():
    """Counting and interpolation, not listing: thousands of rows, equal slopes, a constant series."""
    rng = np.random.default_rng(1)
    t, v = np.arange(3000.0), rng.normal(size=3000).cumsum().round(2)
    i, j = np.triu_indices(3000, 1)
    slopes = np.sort((v[j] - v[i]) / (t[j] - t[i]))
    places = [0, 1000, len(slopes) // 2, len(slopes) - 5]
    assert ranks.ranked_slopes(t, v, places) == slopes[places].tolist()
    assert ranks.ranked_slopes(t, np.zeros(3000), [len(slopes) // 2]) == [0.0]
    assert ranks.ranked_slopes(t, 2 * t + 1, [len(slopes) // 2]) == [2.0]


def test_one_series_of_a_million_rows(spark):
    df = spark.range(1_000_000).selectExpr("'a' AS g", "id AS t", "CASE WHEN id % 1000 <> 5 THEN pmod(id * id * 7 + id, 100003) / 100 + id / 50000 END AS v")
    began = time.time()
    row = rankstats.kendall(df, "t", "v", ["g"]).first()
    assert time.time() - began < 120
    frame = df.where("v IS NOT NULL").toPandas()
    assert row.n == 999_000 and row.n0 == row.n * (row.n - 1) // 2
    take = np.random.default_rng(2).integers(0, row.n, (2, 400_000)).astype(int)
    a, b = take.min(axis=0), take.max(axis=0)
    values = frame.sort_values("t").v.to_numpy()
    assert row.tau == pytest.approx(np.sign(values[b] - values[a]).mean(), abs=0.01)


def test_null_values_do_not_count(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, 2.0), ("a", 4, 4.0), ("b", 1, 5.0)], "g string, t int, v double")
    got = {r.g: tuple(r)[1:] for r in rankstats.kendall(df, "t", "v", ["g"]).collect()}
    assert got == {"a": (3, 3, 3, 0, 1.0), "b": (1, 0, 0, 0, None)}
    lines = {r.g: (r.n, r.slope) for r in rankstats.theil_sen(df, "t", "v", ["g"]).collect()}
    assert lines == {"a": (3, 1.0), "b": (1, None)}
    whole = rankstats.kendall(df, "t", "v", []).first()
    assert whole.n == 4


def test_replicates_by_tasks_equal_replicates_by_joins(spark, monkeypatch):
    """The same draws whether the series go to the tasks or stay; ties, a constant series, blocks."""
    rng = np.random.default_rng(4)
    rows = [(g, i, float(rng.integers(0, 9)) if g != "c" else 1.0, float(rng.normal())) for g, n in (("a", 31), ("b", 12), ("c", 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y double")

    def results():
        out = [resample.bootstrap_rho(df, "x", "y", ["g"], ["t"], 60, 3, block=b) for b in (1, 4)]
        out += [resample.permutation_p(df, "x", "y", ["g"], ["t"], 60, 5), resample.bootstrap_errors(df, "y", ["g"], ["t"], 40, 7).groupBy("g").agg(F.sum("mae").alias("mae"), F.max("rmse").alias("rmse"))]
        return [sorted(str([x if x is None or isinstance(x, str) else round(x, 9) for x in r]) for r in o.collect()) for o in out]

    local = results()
    monkeypatch.setattr(resample, "MAX_ROWS", 10)
    assert results() == local


def test_published_counts_of_replicates(spark):
    """A hundred thousand permutations and ten thousand samples: p and interval near theory."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=29)
    df = spark.createDataFrame([("a", i, float(v), float(w)) for i, (v, w) in enumerate(zip(x, 0.4 * x + rng.normal(size=29), strict=True))], "g string, t int, x double, y double")
    row = resample.permutation_p(df, "x", "y", ["g"], ["t"], 100_000, 1).first()
    want = rankstats.spearman(df, "x", "y", ["g"], p=True).first()
    assert row.rho == pytest.approx(want.rho) and row.p == pytest.approx(want.p, rel=0.1, abs=0.003)
    ci = resample.bootstrap_rho(df, "x", "y", ["g"], ["t"], 10_000, 2).first()
    assert ci.reps == 10_000 and (ci.high - ci.low) / 3.92 == pytest.approx((1 - want.rho**2) / 27**0.5, rel=0.3)


def test_quantiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (4, 1, 2)] + [("b", 7.0), ("b", None), ("c", None)], "g string, v double")
    got = {r.g: (r.n, r.low, r.mid) for r in rankstats.quantiles(df, "v", ["g"], {"low": 0.025, "mid": 0.5}).collect()}
    assert got == {"a": (3, pytest.approx(1.05), 2.0), "b": (1, 7.0, 7.0)}
