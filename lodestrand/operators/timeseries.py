"""Operators over ordered series; every one takes the columns that tell the series apart.

A window runs within a series, so series are spread over tasks by their key.  A single series must be
ordered as a whole, which is the definition of these operators; Spark sorts it with spill.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fresh


def _own(series: list[str], order: list[str]):
    return Window.partitionBy(*series).orderBy(*order)


def spine(df: DataFrame, date: str, out: str = "d") -> DataFrame:
    """Every day from the first to the last."""
    ends = df.agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(out))


def trailing_mean(value: str, width: int, series: list[str], order: list[str], full: bool = False) -> Column:
    """Mean of the last ``width`` rows; at the head over the rows seen, or null if ``full``."""
    own = _own(series, order)
    mean = F.avg(value).over(own.rowsBetween(1 - width, 0))
    return F.when(F.row_number().over(own) >= width, mean) if full else mean


def expanding_mean(value: str, series: list[str], order: list[str]) -> Column:
    """Mean of all earlier rows."""
    return F.avg(value).over(_own(series, order).rowsBetween(Window.unboundedPreceding, -1))


def previous(value: str, series: list[str], order: list[str], back: int = 1) -> Column:
    return F.lag(value, back).over(_own(series, order))


def first_maximum(df: DataFrame, value: str, series: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest value of each series, the first one of ties."""
    r = fresh(df.columns, "__r")
    rank = F.row_number().over(Window.partitionBy(*series).orderBy(F.col(value).desc_nulls_last(), *order))
    return df.withColumn(r, rank).where(F.col(r) == 1).drop(r)


def longest_run(df: DataFrame, test: Column, series: list[str], order: list[str]) -> DataFrame:
    """Length of the longest run of rows that pass, 0 if none does."""
    own = _own(series, order)
    marked = df.select(*series, *order, F.coalesce(test, F.lit(False)).alias("__t")).withColumn("__n", F.row_number().over(own))
    again = Window.partitionBy(*series, "__t").orderBy(*order)
    runs = marked.withColumn("__g", F.col("__n") - F.row_number().over(again)).groupBy(*series, "__t", "__g").count()
    return runs.groupBy(*series).agg(F.coalesce(F.max(F.when(F.col("__t"), F.col("count"))), F.lit(0)).cast("long").alias("longest"))


def fill_short_gaps(df: DataFrame, value: str, position: str, series: list[str], most: int = 3, strict: bool = False) -> DataFrame:
    """Linear interpolation of inner gaps of at most ``most`` rows (``filled``, ``was_filled``).

    ``position`` is a whole number that grows by one from row to row.  Edges and longer gaps stay
    null, or raise if ``strict``.
    """
    own = _own(series, [position])
    before, after = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(position))
    at = [F.last(value, True).over(before), F.last(known, True).over(before), F.first(value, True).over(after), F.first(known, True).over(after)]
    names = [fresh(df.columns, f"__{n}") for n in ("v0", "p0", "v1", "p1")]
    out = df.select("*", *[c.alias(n) for c, n in zip(at, names, strict=True)])
    v0, p0, v1, p1 = map(F.col, names)
    line = v0 + (v1 - v0) * (F.col(position) - p0) / (p1 - p0)
    short = F.col(value).isNull() & (p1 - p0 - 1 <= most)
    filled = F.coalesce(F.col(value), F.when(short, line))
    if strict:
        filled = F.coalesce(filled, F.raise_error(F.lit("a gap is left")).cast("double"))
    return out.select(*df.columns, filled.alias("filled"), F.coalesce(short, F.lit(False)).alias("was_filled"))


def durbin_watson(df: DataFrame, residual: str, series: list[str], order: list[str]) -> DataFrame:
    """Sum of squared first differences over the sum of squares."""
    step = F.col(residual) - F.lag(residual).over(_own(series, order))
    return df.withColumn("__d", step).groupBy(*series).agg((F.sum(F.col("__d") ** 2) / F.sum(F.col(residual) ** 2)).alias("durbin_watson"))


def circular_shifts(df: DataFrame, x: str, y: str, series: list[str], order: list[str]) -> DataFrame:
    """Correlation of x with y shifted round by every offset 0..n-1: series, shift, r.

    All offsets of a series come from a few Fourier transforms (n log n), so no pair of rows is made.  A row without one of
    the values keeps its place and takes no part in the offsets that need it.
    """
    place = fresh(df.columns, "__place")
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in series)
    rows = df.select(*series, F.row_number().over(_own(series, order)).alias(place), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))

    def each(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(place)
        r = shifted_correlations(frame["__x"].to_numpy(float), frame["__y"].to_numpy(float))
        out = {c: [v] * len(r) for c, v in zip(series, key, strict=True)}
        return pd.DataFrame({**out, "shift": np.arange(len(r)), "r": r})

    found = rows.groupBy(*series).applyInPandas(each, kinds + "shift long, r double")
    return found.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def shifted_correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of x[i] with y[i - shift] (round) for every shift, over the pairs of finite values."""

    def centred(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = np.isfinite(v)
        level = v[good].mean() if good.any() else 0.0
        return np.where(good, v - level, 0.0), good.astype(float)

    (x, has_x), (y, has_y) = centred(x), centred(y)

    def over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), len(a))

    n, sx, sy = np.rint(over(has_x, has_y)), over(x, has_y), over(has_x, y)
    sxx, syy, sxy = over(x * x, has_y), over(has_x, y * y), over(x, y)
    both = has_x * has_y == 1  # no shift: exactly, since tests compare with it
    if both.any():
        n[0], sx[0], sy[0], sxx[0], syy[0], sxy[0] = both.sum(), x[both].sum(), y[both].sum(), (x[both] ** 2).sum(), (y[both] ** 2).sum(), (x[both] * y[both]).sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        flat = (vx <= 1e-12 * (x * x).sum()) | (vy <= 1e-12 * (y * y).sum())
        return np.where(flat, np.nan, (sxy - sx * sy / n) / np.sqrt(vx * vy))


def exposure(rows: DataFrame, value: str, by: list[str], date: str, threshold: int, width: int = 7) -> DataFrame:
    """Each group's days, mean, greatest value and its first day, greatest full ``width``-day mean, days at or above the
    threshold and the longest run of them: one partitioning by group and one aggregate after its windows.

    ``value`` is in whole thousandths; means are exact to a tenth of one and given in units.
    """
    own = _own(by, [date])
    passed = F.col(value) >= threshold
    marked = rows.select(*by, date, F.col(value).alias("v"), passed.alias("t"), F.row_number().over(own).alias("k"), F.sum(value).over(own.rowsBetween(1 - width, 0)).alias("sum"))
    again = F.row_number().over(Window.partitionBy(*by, "t").orderBy(date))
    runs = marked.withColumn("run", F.col("k") - again)
    length = F.when(F.col("t"), F.count("*").over(Window.partitionBy(*by, "t", "run")))

    def units(total: Column, n: Column) -> Column:
        return F.floor((total * 20 + n) / (n * 2)).cast("double") / 10000.0

    cells = [
        F.count("*").alias("days"),
        units(F.sum("v"), F.count("*")).alias("mean"),
        (F.max("v") / 1000.0).alias("high"),
        F.min(F.struct((-F.col("v")).alias("v"), F.col(date).alias("d")))["d"].alias("high_day"),
        units(F.max(F.when(F.col("k") >= width, F.col("sum"))), F.lit(width)).alias(f"high{width}"),
        F.count_if("t").alias(f"n{threshold // 1000}"),
        F.coalesce(F.max("length"), F.lit(0)).cast("long").alias("longest"),
    ]
    return runs.withColumn("length", length).groupBy(*by).agg(*cells)
