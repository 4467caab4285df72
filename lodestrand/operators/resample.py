"""Resampling with hashed indices: the same draws on any number of partitions.

A table of series with up to ``MAX_ROWS`` rows goes to every task, and tasks share out the *numbers* of the replicates:
nothing but statistics is shuffled, whatever their count.  A larger table stays where it is and its replicates are
made by joins (replicates x length rows, spread by series and replicate).  Both give the same values.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, finite, hashed_index, hashed_indices, hashed_normal, hashed_normals
from ..functions.ranks import dense, midranks
from .rankstats import midrank, quantiles

#: Rows that every task may hold (a few numbers each).
MAX_ROWS = 1_000_000
#: Drawn values that a task holds at once.
CELLS = 1_000_000


def replicated(df: DataFrame, by: list[str], order: list[str], columns: list[str], reps: int, out: str, run: Callable) -> DataFrame | None:
    """``run(arrays, first, last)`` for every series and range of replicate numbers: by and ``out`` (None: too many rows).

    ``arrays`` are the columns of one series in order, as doubles; ``run`` returns columns in the order of ``out``.
    """
    spark = df.sparkSession
    local = df.select(*by, *order, *[F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)]).limit(MAX_ROWS + 1).toPandas()
    if len(local) > MAX_ROWS:
        return None
    local = local.sort_values([*by, *order], kind="stable")
    parts = [(k if isinstance(k, tuple) else (k,), g) for k, g in local.groupby(by, sort=False, dropna=False)] if by else [((), local)]
    series = [(key, [g[f"__c{i}"].to_numpy() for i in range(len(columns))]) for key, g in parts if len(g)]
    tasks = []
    for i, (_, arrays) in enumerate(series):
        each = max(1, CELLS // len(arrays[0]))
        tasks += [(i, at, min(at + each, reps)) for at in range(0, reps, each)]
    shared = spark.sparkContext.broadcast(series)

    def work(frames):
        for frame in frames:
            for i, first, last in zip(frame["i"], frame["first"], frame["last"], strict=True):
                key, arrays = shared.value[i]
                found = run(arrays, int(first), int(last))
                yield pd.DataFrame({**{n: [v] * len(found[0]) for n, v in zip(by, key, strict=True)}, **dict(zip(names, found, strict=True))})

    names = [c.split()[0] for c in out.split(", ")]
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return spark.createDataFrame(tasks, "i int, first long, last long").mapInPandas(work, kinds + out)


def drawn_places(n: int, first: int, last: int, seed: int, block: int = 1) -> np.ndarray:
    """Places of the drawn rows: a line per replicate (moving blocks of ``block`` rows)."""
    pos = np.arange(n)
    at = hashed_indices(np.arange(first, last)[:, None], pos // block, seed, max(n - block + 1, 1)) + pos % block
    return np.minimum(at, n - 1)


def drawn_midranks(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Midranks within each line of drawn rows, by counting: no line is sorted."""
    place = dense(x)
    k = place.max() + 1
    own = place[at] + np.arange(len(at))[:, None] * k
    counts = np.bincount(own.ravel(), minlength=len(at) * k).reshape(len(at), k)
    return (np.cumsum(counts, axis=1) - (counts - 1) / 2).ravel()[own]


def line_correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of each line of a with that of b (NaN without variance)."""
    a, b = a - a.mean(axis=-1, keepdims=True), b - b.mean(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return (a * b).sum(axis=-1) / np.sqrt((a * a).sum(axis=-1) * (b * b).sum(axis=-1))


def positioned(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their position in the series (``pos``) and its length (``n``), in the place of columns of those names."""
    own = Window.partitionBy(*by).orderBy(*order)
    return df.select(*[c for c in df.columns if c not in ("pos", "n")], (F.row_number().over(own) - 1).cast("long").alias("pos"), F.count("*").over(Window.partitionBy(*by)).alias("n"))


def drawn(df: DataFrame, by: list[str], order: list[str], reps: int, seed: int, block: int = 1) -> DataFrame:
    """``reps`` bootstrap samples of every series (moving blocks of ``block`` rows), with column rep."""
    rows = positioned(df, by, order)
    slots = rows.select(*by, "pos", "n").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    which, step = (F.col("pos") / block).cast("long"), F.pmod("pos", F.lit(block))
    starts = F.greatest(F.col("n") - block + 1, F.lit(1))
    at = hashed_index(F.col("rep"), which, seed, starts) + step
    return slots.select(*by, "rep", at.cast("long").alias("pos")).join(rows, [*by, "pos"])


def interval(df: DataFrame, value: str, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Exact percentile limits of finite replicates: by, reps, low, high."""
    return quantiles(df, value, by, {"low": low, "high": high}).withColumnRenamed("n", "reps")


def bootstrap_rho(df: DataFrame, x: str, y: str, by: list[str], order: list[str], reps: int, seed: int, block: int = 1) -> DataFrame:
    """Percentile interval of the rank correlation over paired (block) bootstrap samples."""

    df = df.where(finite(F.col(x)) & finite(F.col(y)))

    def run(arrays: list[np.ndarray], first: int, last: int) -> list[np.ndarray]:
        at = drawn_places(len(arrays[0]), first, last, seed, block)
        return [np.arange(first, last), line_correlations(*[drawn_midranks(a, at) for a in arrays])]

    rhos = replicated(df, by, order, [x, y], reps, "rep long, rho double", run)
    if rhos is None:
        sample, each = drawn(df, by, order, reps, seed, block), [*by, "rep"]
        ranked = sample.select(*each, midrank(x, each).alias("__x"), midrank(y, each).alias("__y"))
        rhos = ranked.groupBy(*each).agg(correlation("__x", "__y").alias("rho"))
    return interval(rhos, "rho", by)


def bootstrap_errors(df: DataFrame, error: str, by: list[str], order: list[str], reps: int, seed: int) -> DataFrame:
    """Mean absolute and root mean square error of every bootstrap sample: by, rep, mae, rmse."""

    df = df.where(finite(F.col(error)))

    def run(arrays: list[np.ndarray], first: int, last: int) -> list[np.ndarray]:
        e = arrays[0][drawn_places(len(arrays[0]), first, last, seed)]
        return [np.arange(first, last), np.abs(e).mean(axis=1), np.sqrt((e * e).mean(axis=1))]

    found = replicated(df, by, order, [error], reps, "rep long, mae double, rmse double", run)
    if found is None:
        sample = drawn(df, by, order, reps, seed)
        found = sample.groupBy(*by, "rep").agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(F.col(error) * F.col(error))).alias("rmse"))
    return found


def permutation_p(df: DataFrame, x: str, y: str, by: list[str], order: list[str], reps: int, seed: int) -> DataFrame:
    """Two-sided permutation p-value of the rank correlation: by, rho, extreme, p = (1 + extreme) / (1 + reps)."""

    df = df.where(finite(F.col(x)) & finite(F.col(y)))

    def run(arrays: list[np.ndarray], first: int, last: int) -> list[np.ndarray]:
        rx, ry = map(midranks, arrays)
        observed = line_correlations(rx, ry)
        keys = hashed_indices(np.arange(first, last)[:, None], np.arange(len(rx)), seed, 2147483647)
        rhos = line_correlations(rx[np.argsort(keys, axis=1, kind="stable")], ry)
        return [np.array([observed]), np.array([int((np.abs(rhos) >= abs(observed) - 1e-12).sum())])]

    parts = replicated(df, by, order, [x, y], reps, "rho double, extreme long", run)
    out = shuffled_p(df, x, y, by, order, reps, seed) if parts is None else parts.groupBy(*by).agg(F.max("rho").alias("rho"), F.sum("extreme").alias("extreme"))
    return out.withColumn("p", F.when(F.col("rho").isNotNull(), (F.col("extreme") + 1) / F.lit(float(reps + 1))))


def shuffled_p(df: DataFrame, x: str, y: str, by: list[str], order: list[str], reps: int, seed: int) -> DataFrame:
    """The observed rank correlation and the permutations that are as extreme, by joins."""
    ranked = positioned(df.select(*by, *order, midrank(x, by).alias("__x"), midrank(y, by).alias("__y")), by, order)
    observed = ranked.groupBy(*by).agg(correlation("__x", "__y").alias("observed"))
    shuffled = ranked.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(reps - 1).cast("long"))))
    key = hashed_index(F.col("rep"), F.col("pos"), seed, F.lit(2147483647))
    place = (F.row_number().over(Window.partitionBy(*by, "rep").orderBy(key, "pos")) - 1).cast("long")
    moved = shuffled.select(*by, "rep", "__x", place.alias("pos")).join(ranked.select(*by, "pos", "__y"), [*by, "pos"])
    rhos = moved.groupBy(*by, "rep").agg(correlation("__x", "__y").alias("rho"))
    extreme = F.count_if(F.abs("rho") >= F.abs("observed") - 1e-12)
    return rhos.join(observed, by).groupBy(*by).agg(F.max("observed").alias("rho"), extreme.alias("extreme"))


def scenario_paths(trends: DataFrame, models: DataFrame, errors: DataFrame, by: list[str], years: int, draws: int, offsets: dict[str, float], noise: float, seed: int) -> DataFrame:
    """Monte Carlo projections of a log-linear model: by, scenario, step and the quantiles q05, q50, q95.

    ``trends``: by, feature, last, slope, sd (of the detrended feature), mean, scale, coef.  A path of a feature is
    last + slope * step + offset * sd + N(0, noise * sd).  ``models``: by, intercept.  The response is
    expm1(intercept + sum of coef * (path - mean) / scale) plus one of the model's own ``errors`` (by, pos
    from 0, e; drawn anew for each path and step), floored at 0.  Draws are hashed, so any cluster gives
    the same; a path costs a row per step and scenario, and only quantiles are kept.
    """
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.lit(i).alias("number"), F.lit(float(v)).alias("shift")) for i, (k, v) in enumerate(offsets.items())])).alias("s")
    numbered = trends.withColumn("f", F.row_number().over(Window.partitionBy(*by).orderBy("feature")) - 1)
    parts = F.sort_array(F.collect_list(F.struct("f", "last", "slope", "sd", "mean", "scale", "coef"))).alias("parts")  # an entry per feature
    sized = models.join(numbered.groupBy(*by).agg(parts), by).join(errors.groupBy(*by).agg(F.count("*").alias("n_errors")), by)
    grid = sized.select("*", table).select(*by, "intercept", "parts", "n_errors", "s.scenario", "s.number", "s.shift")
    grid = grid.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(years))))
    most = errors.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    if most > MAX_ROWS:
        return _joined_paths(grid, errors, by, draws, noise, seed)
    listed = errors.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "e"))).alias("l")).select(*by, F.col("l.e").alias("errors"))
    kinds = "".join(f"`{c}` {grid.schema[c].dataType.simpleString()}, " for c in [*by, "scenario", "step"])

    def work(frames):
        reps = np.arange(draws)
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                level = np.full(draws, r["intercept"])
                for q in r["parts"]:
                    place = r["step"] + 100 * q["f"] + 10_000 * r["number"]
                    path = q["last"] + q["slope"] * r["step"] + r["shift"] * q["sd"] + hashed_normals(reps, np.int64(place), seed) * noise * q["sd"]
                    level += q["coef"] * (path - q["mean"]) / q["scale"]
                at = hashed_indices(reps, np.int64(r["step"] + 10_000 * r["number"]), seed + 1, len(r["errors"]))
                value = np.maximum(np.expm1(level) + np.asarray(r["errors"], float)[at], 0.0)
                out.append((*[r[c] for c in [*by, "scenario", "step"]], *map(float, np.quantile(value, [0.05, 0.5, 0.95]))))
            yield pd.DataFrame(out, columns=[*by, "scenario", "step", "q05", "q50", "q95"])

    return grid.join(listed, by).repartition(*by, "scenario", "step").mapInPandas(work, kinds + "q05 double, q50 double, q95 double")


def _joined_paths(grid: DataFrame, errors: DataFrame, by: list[str], draws: int, noise: float, seed: int) -> DataFrame:
    """The same for more errors than a task may hold: a row per path, joined with its error."""
    grid = grid.repartition(*by, "scenario", "step").withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))

    def part(p: Column) -> Column:
        place = F.col("step") + 100 * p["f"] + 10_000 * F.col("number")
        path = p["last"] + p["slope"] * F.col("step") + F.col("shift") * p["sd"] + hashed_normal(F.col("rep"), place, seed) * noise * p["sd"]
        return p["coef"] * (path - p["mean"]) / p["scale"]

    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + part(p))
    at = hashed_index(F.col("rep"), F.col("step") + 10_000 * F.col("number"), seed + 1, F.col("n_errors"))
    levels = grid.select(*by, "scenario", "step", (F.col("intercept") + total).alias("level"), at.alias("pos"))
    full = levels.join(errors.select(*by, "pos", "e"), [*by, "pos"])
    paths = full.withColumn("value", F.greatest(F.expm1("level") + F.col("e"), F.lit(0.0)))
    return paths.groupBy(*by, "scenario", "step").agg(*[F.percentile("value", F.lit(q)).alias(n) for n, q in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))])  # as many values as draws
