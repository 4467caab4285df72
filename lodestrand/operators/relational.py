"""Joins and reshaping of panels: lags, spans, windows of the year, one-to-one and missing keys.

Columns that an operator needs for itself get names that no column of the caller has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fresh


def lag_join(panel: DataFrame, series: DataFrame, key: str, lag: Column, values: list[str], strict: bool = False) -> DataFrame:
    """Attach the series' values at ``key - lag``; unmatched rows get nulls, or raise if ``strict``."""
    taken = panel.columns + series.columns
    k, at, hit = fresh(taken, "__k"), fresh(taken, "__at"), fresh(taken, "__hit")
    right = series.select(F.col(key).alias(k), *values, F.lit(True).alias(hit))
    out = panel.withColumn(at, F.col(key) - lag).join(right, F.col(at) == F.col(k), "left")
    if strict:
        error = F.raise_error(F.concat(F.lit("no row at "), F.col(at).cast("string"))).cast("boolean")
        out = out.where(F.coalesce(F.col(hit), error))
    return out.drop(k, at, hit)


def span_mean(panel: DataFrame, series: DataFrame, key: str, low: Column, high: Column, value: str, out: str, ids: list[str]) -> DataFrame:
    """Mean of the series over the whole-number span low..high of each row; null if it is empty.

    The span becomes an equi-join on its members, so both sides shuffle by key and no nested loop
    is needed; it costs a narrow row per member of a span.
    """
    at, v = fresh(ids, "__at"), fresh(ids, "__v")
    spans = panel.select(*ids, F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))).alias(at))
    right = series.select(F.col(key).alias(at), F.col(value).alias(v))
    means = spans.join(right, at).groupBy(*ids).agg(F.avg(v).alias(out))
    return panel.join(means, ids, "left")


def window_members(daily: DataFrame, windows: DataFrame, at: Column) -> DataFrame:
    """Days within windows of the year (start_md..end_md as month * 100 + day, no wrap); a day may be in several.

    A window becomes its month-days (366 at most), so the join is an equi-join for any number of windows.
    """
    md = fresh(daily.columns + windows.columns, "__md")
    days = F.filter(F.sequence(F.col("start_md").cast("long"), F.col("end_md").cast("long")), lambda d: (d % 100).between(1, 31))
    listed = windows.where("start_md <= end_md").withColumn(md, F.explode(days))
    return daily.withColumn(md, at.cast("long")).join(listed, md).drop(md)


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a key that repeats raises when they are read."""
    n = fresh(df.columns, "__n")
    error = F.raise_error(F.lit(f"keys {keys} repeat")).cast("boolean")
    return df.withColumn(n, F.count("*").over(Window.partitionBy(*keys))).where(F.when(F.col(n) == 1, F.lit(True)).otherwise(error)).drop(n)


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], flag: str = "matched", suffix: str = "_right") -> DataFrame:
    """Left join that raises, when it is read, if either side repeats a key; ``flag`` says whether the right side matched.

    Columns of the right side that the left has too get the suffix.
    """
    hit = fresh(left.columns + right.columns, "__hit")
    both = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    out = once(left, keys).join(once(right, keys).withColumnsRenamed(both).withColumn(hit, F.lit(True)), keys, "left")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(hit)


def onto_spine(spine: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """The spine with every sparse source's columns (prefixed by its name), null where it has no row."""
    out = spine
    for name, df in sources.items():
        out = out.join(once(df, [key]).withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c != key}), key, "left")
    return out


def missing_keys(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(have, keys, "left_anti")


def set_relation(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: distinct rows of a, of b, of both; whether they are equal, and whether a is within b."""
    side = fresh(a.columns, "__side")
    tagged = a.distinct().withColumn(side, F.lit(1)).unionByName(b.distinct().withColumn(side, F.lit(2)))
    n = tagged.groupBy(*a.columns).agg(F.sum(side).alias(side)).select(F.col(side).alias("s")).agg(F.count_if(F.col("s") != 2).alias("n_a"), F.count_if(F.col("s") != 1).alias("n_b"), F.count_if(F.col("s") == 3).alias("n_both"))
    return n.select("*", ((F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both"))).alias("equal"), (F.col("n_a") == F.col("n_both")).alias("subset"))


def in_order(df: DataFrame, column: str, values: list[str], out: str = "place") -> DataFrame:
    """Rows of the declared values, with the place of each (from 1), to sort by."""
    return df.withColumn(out, F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("long")).where(F.col(out) > 0)


def category_sums(df: DataFrame, by: list[str], category: str, values: dict[str, str], measure: str) -> DataFrame:
    """A sum column (0 if none) per listed category."""
    sums = [F.coalesce(F.sum(F.when(F.col(category) == v, F.col(measure))), F.lit(0.0)).alias(name) for v, name in values.items()]
    return df.groupBy(*by).agg(*sums)


def wide(df: DataFrame, key: str, on: str, values: list[str], value: str) -> DataFrame:
    """Long to wide over declared values (one pass, no discovery job)."""
    return df.groupBy(key).pivot(on, values).agg(F.first(value))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, missing values and their percentage for each column, in one aggregate."""
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counted.unpivot("rows", columns, "column", "missing")
    return long.select("column", "rows", "missing", (F.col("missing") * 100.0 / F.col("rows")).alias("pct"))
