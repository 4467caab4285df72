"""Rank statistics, robust trends and multiple-testing corrections."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import correlation, finite, fresh, ratio, spearman_p
from ..functions.ranks import kendall_sum, leave_one_out_rho, theil_sen_line


def midrank(value: str, by: list[str]) -> Column:
    """Rank with the mean of ties."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / F.lit(2.0)


def spearman(df: DataFrame, x: str, y: str, by: list[str], p: bool = False) -> DataFrame:
    """Rank correlation of the finite pairs of each group: n, rho (and p)."""
    ranked = df.where(finite(F.col(x)) & finite(F.col(y))).select(*by, midrank(x, by).alias("__x"), midrank(y, by).alias("__y"))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("__x", "__y").alias("rho"))
    return out.withColumn("p", spearman_p(F.col("rho"), F.col("n"))) if p else out


def quantiles(df: DataFrame, value: str, by: list[str], at: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles (name -> share) of the finite values of each group, and their number ``n``.

    Values are sorted with spill and the neighbours of each place are picked, so no group's values are held in memory.
    """
    own = Window.partitionBy(*by)
    v, r, n = (fresh(by, c) for c in ("__v", "__r", "__n"))
    rows = df.where(finite(F.col(value))).select(*by, F.col(value).cast("double").alias(v))
    ranked = rows.select("*", (F.row_number().over(own.orderBy(v)) - 1).alias(r), F.count("*").over(own).alias(n))
    cells = [F.max(n).alias("n")]
    for name, q in at.items():
        place = (F.col(n) - 1) * F.lit(float(q))
        low, high = (F.max(F.when(F.col(r) == f(place), F.col(v))) for f in (F.floor, F.ceil))
        cells.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(*by).agg(*cells)


def benjamini_hochberg(df: DataFrame, p: str, family: list[str], ties: list[str], out: str = "q") -> DataFrame:
    """Step-up adjusted p-values within a family (a family is sorted in one task: a row per test).

    A test without a p-value (null or NaN) is none: it does not count, and its q is null.
    """
    tested = finite(F.col(p))
    own, r, s = Window.partitionBy(*family), fresh(df.columns, "__r"), fresh(df.columns, "__s")
    scaled = df.withColumn(r, F.row_number().over(own.orderBy(tested.desc(), p, *ties))).withColumn(s, F.when(tested, F.col(p) * F.count_if(tested).over(own) / F.col(r)))
    least = F.min(s).over(own.orderBy(r).rowsBetween(0, Window.unboundedFollowing))
    return scaled.withColumn(out, F.when(tested, F.least(least, F.lit(1.0)))).drop(r, s)


def holm(df: DataFrame, p: str, family: list[str], ties: list[str], level: float = 0.05, out: str = "holm") -> DataFrame:
    """Step-down adjusted p-values within a family, and whether they are below the level.

    A test without a p-value (null or NaN) does not count; its adjusted value and ``passed`` are null.
    """
    tested = finite(F.col(p))
    own, r, s = Window.partitionBy(*family), fresh(df.columns, "__r"), fresh(df.columns, "__s")
    scaled = df.withColumn(r, F.row_number().over(own.orderBy(tested.desc(), p, *ties))).withColumn(s, F.when(tested, F.col(p) * (F.count_if(tested).over(own) - F.col(r) + 1)))
    most = F.max(s).over(own.orderBy(r).rowsBetween(Window.unboundedPreceding, 0))
    return scaled.withColumn(out, F.when(tested, F.least(most, F.lit(1.0)))).withColumn("passed", F.col(out) < level).drop(r, s)


def by_series(df: DataFrame, by: list[str], columns: list[str], out: str, run) -> DataFrame:
    """``run`` on the columns (as double arrays) of each series: one task holds a series, and only these columns of it.

    ``run`` returns a list of tuples in the order of ``out``.  Rows with a value that is not finite are left out.
    """
    names = [f"__c{i}" for i in range(len(columns))]
    good = reduce(lambda a, b: a & b, [finite(F.col(c)) for c in columns])
    rows = df.where(good).select(*by, *[F.col(c).cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]
    fields = [f.name for f in StructType.fromDDL(out).fields]

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = run(*[frame[n].to_numpy() for n in names])
        return pd.DataFrame([(*key, *r) for r in found], columns=[*by, *fields])

    return rows.groupBy(*by).applyInPandas(each, ", ".join([*kinds, out]))


def kendall(df: DataFrame, t: str, v: str, by: list[str]) -> DataFrame:
    """Kendall's S and tau-b of a series against time: n, s, n0 (pairs of different times), ties (pairs of equal values), tau.

    Pairs are counted by merges (n log n), never made; ``ranges.kendall`` counts a series that is too long for one task.
    Rows without a finite time and value do not count; tau is null where all times, or all values, are equal.
    """

    def run(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        return [kendall_row(len(t), *kendall_sum(t, v))]

    return by_series(df, by, [t, v], KENDALL, run)


KENDALL = "n long, s long, n0 long, ties long, tau double"


def kendall_row(n: int, s: int, tied_t: int, tied_v: int) -> tuple:
    every = n * (n - 1) // 2
    scale = math.sqrt((every - tied_t) * (every - tied_v))
    return n, s, every - tied_t, tied_v, s / scale if scale else None


def mahonian_p(n: int, s: int) -> float:
    """Exact two-sided p-value of Kendall's S without ties: counts of permutations by inversions."""
    counts = [1]
    for k in range(2, n + 1):
        new = [0] * (len(counts) + k - 1)
        for i, c in enumerate(counts):
            for j in range(k):
                new[i + j] += c
        counts = new
    most = n * (n - 1) // 2
    inversions = (most - abs(s)) // 2
    return min(1.0, 2 * sum(counts[: inversions + 1]) / math.factorial(n))


def kendall_p(n: int, s: int, tie_sizes: list[int]) -> float:
    """Two-sided p-value: exact up to 33 values without ties, else normal with tie-corrected variance."""
    if not tie_sizes and n <= 33:
        return mahonian_p(n, s)
    variance = (n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in tie_sizes)) / 18
    return math.erfc(abs(s) / math.sqrt(2 * variance)) if variance > 0 else 1.0


def theil_sen(df: DataFrame, t: str, v: str, by: list[str], z: float = 1.959964) -> DataFrame:
    """Median pairwise slope and its rank confidence limits: n, slope, low, high.

    The order statistics are found by counting (``functions.ranks.ranked_slopes``), so no pair of a series is made.
    """

    def run(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        return [(len(t), *map(none, theil_sen_line(t, v, z)))]

    return by_series(df, by, [t, v], "n long, slope double, low double, high double", run)


def none(x: float) -> float | None:
    return None if x != x else float(x)


def trend(df: DataFrame, t: str, v: str, by: list[str], ends: int = 5) -> DataFrame:
    """The trend of each series: n, first and last t, tau, p, slope and its limits, intercept, means of the first and last
    ``ends`` values and their change in per cent; one shuffle by series."""

    def run(t: np.ndarray, v: np.ndarray) -> list[tuple]:
        order = np.argsort(t, kind="stable")
        t, v = t[order], v[order]
        n, s, _, _, tau = kendall_row(len(t), *kendall_sum(t, v))
        sizes = np.unique(v, return_counts=True)[1]
        p = kendall_p(n, s, [int(k) for k in sizes if k > 1]) if tau is not None else None
        slope, low, high = theil_sen_line(t, v, 1.959964)
        head, tail = float(v[:ends].mean()), float(v[-ends:].mean())
        change = 100 * (tail / head - 1) if head else None
        return [(n, t[0], t[-1], tau, p, *map(none, (slope, low, high, float(np.median(v - slope * t)))), head, tail, change)]

    out = by_series(df, by, [t, v], "n long, first double, last double, tau double, p double, slope double, low double, high double, intercept double, first_mean double, last_mean double, change_pct double", run)
    return out.withColumns({c: F.col(c).cast(df.schema[t].dataType) for c in ("first", "last")})


def leave_one_out(df: DataFrame, x: str, y: str, by: list[str], key: str) -> DataFrame:
    """Rank correlation without each row in turn: by, omitted (its key), rho.

    Sums of midranks are updated in closed form, n log n for a series.  A key names one row of its series; rows without
    finite values take no part.
    """
    place = fresh(df.columns, "__place")
    named = df.where(finite(F.col(x)) & finite(F.col(y))).withColumn(place, F.row_number().over(Window.partitionBy(*by).orderBy(key)))

    def run(place: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple]:
        return [(int(p), none(r)) for p, r in zip(place, leave_one_out_rho(x, y), strict=True)]

    rhos = by_series(named, by, [place, x, y], f"`{place}` int, rho double", run)
    return named.select(*by, place, F.col(key).alias("omitted")).join(rhos, [*by, place]).select(*by, "omitted", "rho")


def leave_one_out_summary(df: DataFrame, x: str, y: str, by: list[str], key: str) -> DataFrame:
    """by, n_full, rho, and over the omissions: least and greatest rho, and how many change its sign."""
    full = spearman(df, x, y, by).withColumnRenamed("n", "n_full")
    each = leave_one_out(df, x, y, by, key).withColumnRenamed("rho", "rho_without").join(full, by)
    changed = F.count_if(F.signum("rho_without") != F.signum("rho"))
    return each.groupBy(*by, "n_full", "rho").agg(F.min("rho_without").alias("rho_min"), F.max("rho_without").alias("rho_max"), changed.alias("sign_changes"))


def temporal_sensitivity(df: DataFrame, x: str, y: str, t: str, by: list[str], trigger: float = 0.3) -> DataFrame:
    """What a trend in time does to a rank correlation: n, rho, rho_detrended, lag-1 correlations of the ranks and of their
    residuals, direction, change of magnitude in per cent, and, where a residual lag-1 reaches ``trigger``, the
    share of circular shifts that are as extreme (else null)."""
    from .timeseries import circular_shifts

    rows = df.where(finite(F.col(x)) & finite(F.col(y))).select(*by, F.col(t).cast("double").alias("t"), midrank(x, by).alias("rx"), midrank(y, by).alias("ry"))
    flat = detrended(rows, ["rx", "ry"], "t", by)
    before = Window.partitionBy(*by).orderBy("t")
    columns = ["rx", "ry", "rx_r", "ry_r"]
    lagged = flat.select("*", *[F.lag(c).over(before).alias(f"{c}_b") for c in columns])
    lag1 = [correlation(F.when(F.col(f"{c}_b").isNotNull(), F.col(c)), F.col(f"{c}_b")).alias(f"lag1_{c}") for c in columns]
    cells = lagged.groupBy(*by).agg(F.count("*").alias("n"), correlation("rx", "ry").alias("rho"), correlation("rx_r", "ry_r").alias("rho_detrended"), *lag1)
    triggered = (F.abs("lag1_rx_r") >= trigger) | (F.abs("lag1_ry_r") >= trigger)
    shifts = circular_shifts(flat, "rx_r", "ry_r", by, ["t"]).join(cells.select(*by, "rho_detrended"), by)
    extreme = shifts.groupBy(*by).agg((F.count_if(F.abs("r") >= F.abs("rho_detrended") - 1e-11) / F.count("*")).alias("p_shift"))
    direction = F.when(F.signum("rho") == F.signum("rho_detrended"), "retained").otherwise("reversed")
    change = 100 * ratio(F.abs("rho_detrended") - F.abs("rho"), F.abs("rho"))
    out = cells.join(extreme, by).withColumns({"triggered": triggered, "direction": direction, "magnitude_change_pct": change})
    return out.withColumn("p_shift", F.when(F.col("triggered"), F.col("p_shift")))


def detrended(df: DataFrame, columns: list[str], t: str, by: list[str]) -> DataFrame:
    """Residuals of each column after a straight line in t (``<column>_r``)."""
    own = Window.partitionBy(*by)
    slopes = [(c, ratio(F.covar_pop(t, c).over(own), F.var_pop(t).over(own)), F.avg(c).over(own)) for c in columns]
    centre = F.avg(t).over(own)
    return df.select("*", *[(F.col(c) - m - s * (F.col(t) - centre)).alias(f"{c}_r") for c, s, m in slopes])
