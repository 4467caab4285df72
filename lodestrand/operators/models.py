"""Ridge models from shared sums of products: held-out predictions, rolling model tables, influence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_checked, ratio
from .linear import _kinds, checked_ridge, gram, keys_of, shapiro_wilk, unpack_gram, vif
from .timeseries import durbin_watson


def _scored(coef, features: list[str]):
    return coef[0] + sum((F.col(c) * coef[i + 1] for i, c in enumerate(features)), F.lit(0.0))


def held_out(df: DataFrame, features: list[str], target: str, group: str, alphas: list[float], by: list[str] | None = None) -> DataFrame:
    """Every row with the prediction (``held_out``) of the ridge fit to all other groups, for each alpha: columns, alpha, held_out.

    ``by`` tells models apart.  A fold's sums are the model's less the group's own: the data are read once for
    the sums and once for the predictions.  Rows without a feature or target are left out; a fold that cannot be
    fitted raises.
    """
    by = by or []
    rows, size = df.dropna(subset=[*features, target]), len(features) + 2
    own = gram(rows, features, target, [*by, group])
    total = own.groupBy(*by).agg(F.array(*[F.sum(F.col("gram")[i]) for i in range(size * (size + 1) // 2)]).alias("__total"))
    paired = own.join(total, by) if by else own.join(F.broadcast(total))  # one row

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, cells, every in zip(keys_of(frame, [*by, group]), frame["gram"], frame["__total"], strict=True):
                g = unpack_gram(np.asarray(every) - np.asarray(cells), size)
                out += [(*key, float(a), checked_ridge(g, a).tolist()) for a in alphas]
            yield pd.DataFrame(out, columns=[*by, group, "alpha", "__coef"])

    fits = paired.mapInPandas(solve, _kinds(df, [*by, group]) + "alpha double, __coef array<double>")
    return rows.join(fits, [*by, group]).select(*df.columns, "alpha", _scored(F.col("__coef"), features).alias("held_out"))


def chosen_alpha(held: DataFrame, target: str, by: list[str]) -> DataFrame:
    """The alpha of the least held-out root mean square error of each model, the larger of ties: by, alpha, rmse."""
    scored = held.groupBy(*by, "alpha").agg(F.sqrt(F.avg((F.col("held_out") - F.col(target)) ** 2)).alias("rmse"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("rmse", F.desc("alpha")))  # a row per alpha
    return scored.withColumn("__r", place).where("__r = 1").drop("__r")


def ridge_path(df: DataFrame, features: list[str], target: str, by: list[str], alphas: list[float]) -> DataFrame:
    """The fit to all rows of each model and alpha: by, alpha, coef (intercept, raw slopes)."""
    size = len(features) + 2

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(*key, float(a), checked_ridge(unpack_gram(np.asarray(cells), size), a).tolist()) for key, cells in zip(keys_of(frame, by), frame["gram"], strict=True) for a in alphas]
            yield pd.DataFrame(out, columns=[*by, "alpha", "coef"])

    return gram(df, features, target, by).mapInPandas(solve, _kinds(df, by) + "alpha double, coef array<double>")


def banded_predictions(df: DataFrame, features: list[str], target: str, group: str, alphas: list[float], by: list[str]) -> DataFrame:
    """Rows with the model's own prediction (``raw``) and the limits ``lo``, ``hi`` of its held-out errors (95 %).

    Alpha is the best one held out; the errors of that alpha, of rows that the fit had not seen, make the band.
    """
    from .rankstats import quantiles

    held = held_out(df, features, target, group, alphas, by)
    best = chosen_alpha(held, target, by).drop("rmse")
    errors = held.join(best, [*by, "alpha"]).withColumn("__e", F.col(target) - F.col("held_out"))
    band = quantiles(errors, "__e", by, {"lo": 0.025, "hi": 0.975}).drop("n")
    fits = ridge_path(df, features, target, by, alphas).join(best, [*by, "alpha"]).join(band, by)
    return df.join(fits, by).select(*df.columns, "alpha", _scored(F.col("coef"), features).alias("raw"), "lo", "hi")


def ridge_many(g: np.ndarray, alpha: float) -> np.ndarray:
    """``ridge_from_gram`` of a stack of matrices: a line of (intercept, raw slopes) each."""
    n, p = g[:, 0, 0], g.shape[1] - 2
    mean, top = g[:, 0, 1:-1] / n[:, None], g[:, 0, -1] / n
    cov = g[:, 1:-1, 1:-1] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    scale = np.sqrt(np.maximum(np.einsum("rii->ri", cov) / n[:, None], 0))
    scale[scale == 0] = 1
    xy = (g[:, 1:-1, -1] - (n * top)[:, None] * mean) / scale
    beta = np.einsum("rij,rj->ri", np.linalg.pinv(cov / (scale[:, :, None] * scale[:, None, :]) + alpha * np.eye(p)), xy) / scale
    return np.column_stack([top - (mean * beta).sum(axis=1), beta])


def model_table(df: DataFrame, models: dict[str, tuple[list[str], list[float]]], target: str, by: list[str], order: str, least: int = 12, inner: int = 6, default: float = 10.0) -> DataFrame:
    """Rolling-origin predictions of many log1p ridge models and two baselines: by, order, model, train, alpha, actual, predicted.

    ``models``: name -> (features, alphas).  All models share one window pass: the sums of products of all features
    over the rows before a row hold each model's sums.  Several alphas are chosen between by the last ``inner`` rows'
    own predictions (the least mean error, the smaller alpha of ties; ``default`` with fewer than 9 rows).  The
    baselines are ``expanding_mean`` and ``previous``.
    """
    features = sorted({c for names, _ in models.values() for c in names})
    size, types = len(features) + 2, dict(df.dtypes)
    own = Window.partitionBy(*by).orderBy(order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.dropna(subset=[*features, target]).select(*by, order, *[F.col(c).cast("double").alias(c) for c in (*features, target)])
    term = [F.lit(1.0), *map(F.col, features), log_checked(F.col(target), True)]
    sums = F.array(*[F.sum(term[i] * term[j]).over(before) for i in range(size) for j in range(i, size)])
    seen = rows.select(*by, order, F.col(target).alias("actual"), F.array(*features).alias("x"), sums.alias("gram"), F.avg(target).over(before).alias("mean"), F.lag(target).over(own).alias("last"))
    places = {name: [features.index(c) for c in names] for name, (names, _) in models.items()}

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            g = np.stack([unpack_gram(np.asarray(c), size) for c in frame["gram"]])
            x, keys, parts = np.stack(frame["x"]), frame[[*by, order]].assign(train=g[:, 0, 0].astype(int), actual=frame["actual"]), []
            for name, (_, alphas) in models.items():
                at = np.array([0, *[i + 1 for i in places[name]], size - 1])
                for a in alphas:
                    coef = ridge_many(g[:, at[:, None], at], a)
                    value = coef[:, 0] + (coef[:, 1:] * x[:, places[name]]).sum(axis=1)
                    parts.append(keys.assign(model=name, alpha=float(a), predicted=np.maximum(np.expm1(value), 0.0)))
            parts += [keys.assign(model=name, alpha=np.nan, predicted=frame[c]) for name, c in (("expanding_mean", "mean"), ("previous", "last"))]
            yield pd.concat(parts)[[*by, order, "model", "train", "alpha", "actual", "predicted"]]

    tests = seen.where(F.col("gram")[0] >= inner).mapInPandas(solve, _kinds(df, by) + f"`{order}` {types[order]}, model string, train long, alpha double, actual double, predicted double")
    tests = tests.withColumn("alpha", F.when(~F.isnan("alpha"), F.col("alpha")))
    recent = Window.partitionBy(*by, "model", "alpha").orderBy(order).rowsBetween(-inner, -1)
    scored = tests.withColumn("score", F.avg(F.abs(F.col("predicted") - F.col("actual"))).over(recent)).where(F.col("train") >= least)
    several = [name for name, (_, alphas) in models.items() if len(alphas) > 1]
    few = F.col("model").isin(several) & (F.col("train") < 9)
    best = F.row_number().over(Window.partitionBy(*by, order, "model").orderBy("score", "alpha"))
    return scored.where(~few | (F.col("alpha") == default)).withColumn("r", best).where("r = 1").drop("r", "score")


def ridge_influence(df: DataFrame, features: list[str], target: str, by: list[str], order: str, alpha: float, log1p: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Diagnostics, summary and refits of a ridge fit of each group on features in population standard deviations.

    Diagnostics: by, order, observed, fitted, residual, leverage (from the regularised inverse), cook.  Summary: by, n,
    durbin_watson, shapiro_w, shapiro_p (of the residuals), max_cook, max_cook_at (first of ties), max_vif.  Refits: by, term,
    omitted, full_coef, refit_coef (per standard deviation of the rows used), change, sign_changed; the row of the
    greatest Cook's distance is taken out of the sums of products, so the data are not read again.
    """
    p, size = len(features), len(features) + 2
    y = log_checked(F.col(target).cast("double"), True) if log1p else F.col(target).cast("double")
    rows = df.dropna(subset=[*features, target, order]).select(*by, order, y.alias("observed"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    xs = [f"x{i}" for i in range(p)]
    sums = gram(rows, xs, "observed", by)

    def standard(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Means, deviations, regularised inverse and coefficients per deviation."""
        raw, n = checked_ridge(g, alpha), g[0, 0]
        mean = g[0, 1:-1] / n
        cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
        scale = np.sqrt(np.diag(cov) / n)
        return mean, scale, np.linalg.inv(cov / np.outer(scale, scale) + alpha * np.eye(p)), raw[1:] * scale

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = []
            for cells in frame["gram"]:
                g = unpack_gram(np.asarray(cells), size)
                mean, scale, inverse, beta = standard(g)
                fits.append((int(g[0, 0]), g[0, -1] / g[0, 0], mean.tolist(), scale.tolist(), inverse.ravel().tolist(), beta.tolist()))
            yield frame[[*by, "gram"]].assign(**{k: [f[i] for f in fits] for i, k in enumerate(("n", "level", "mean", "scale", "inverse", "beta"))})

    fitted = sums.mapInPandas(solve, _kinds(df, by) + "gram array<double>, n long, level double, mean array<double>, scale array<double>, inverse array<double>, beta array<double>")
    z = [(F.col(c) - F.col("mean")[i]) / F.col("scale")[i] for i, c in enumerate(xs)]
    value = F.col("level") + sum((F.col("beta")[i] * z[i] for i in range(p)), F.lit(0.0))
    lever = 1 / F.col("n") + sum((F.col("inverse")[i * p + j] * z[i] * z[j] for i in range(p) for j in range(p)), F.lit(0.0))
    own = Window.partitionBy(*by)
    full = rows.join(fitted.drop("gram"), by).withColumn("fitted", value).withColumn("leverage", F.least(F.greatest(lever, F.lit(0.0)), F.lit(0.999999)))
    full = full.withColumn("residual", F.col("observed") - F.col("fitted"))
    square = F.col("residual") * F.col("residual")
    mse = F.sum(square).over(own) / F.greatest(F.col("n") - p - 1, F.lit(1))
    full = full.withColumn("cook", ratio(square * F.col("leverage"), (p + 1) * mse * (1 - F.col("leverage")) ** 2))
    diagnostics = full.select(*by, order, "observed", "fitted", "residual", "leverage", "cook")

    top = F.min(F.struct((-F.col("cook")).alias("c"), F.col(order).alias("at"), F.array("observed", *xs).alias("row"))).alias("top")
    tops = full.groupBy(*by).agg(F.max("n").alias("n"), top)
    shapiro = shapiro_wilk(diagnostics, "residual", by).select(*by, F.col("w").alias("shapiro_w"), F.col("p").alias("shapiro_p"))
    inflation = vif(rows, xs, by).groupBy(*by).agg(F.max("vif").alias("max_vif"))
    cells = tops.select(*by, "n", (-F.col("top.c")).alias("max_cook"), F.col("top.at").alias("max_cook_at"))
    summary = cells.join(durbin_watson(diagnostics, "residual", by, [order]), by).join(shapiro, by).join(inflation, by)

    def refit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, cells, row, beta in zip(keys_of(frame, [*by, "omitted"]), frame["gram"], frame["row"], frame["beta"], strict=True):
                line = np.r_[1.0, row[1:], row[0]]
                again = standard(unpack_gram(np.asarray(cells), size) - np.outer(line, line))[3]
                out += [(*key, c, float(a), float(b)) for c, a, b in zip(features, beta, again, strict=True)]
            yield pd.DataFrame(out, columns=[*by, "omitted", "term", "full_coef", "refit_coef"])

    kind = f"omitted {dict(df.dtypes)[order]}, term string, full_coef double, refit_coef double"
    refits = fitted.join(tops.select(*by, F.col("top.at").alias("omitted"), F.col("top.row").alias("row")), by).mapInPandas(refit, _kinds(df, by) + kind)
    refits = refits.withColumn("change", F.abs(F.col("refit_coef") - F.col("full_coef"))).withColumn("sign_changed", F.signum("refit_coef") != F.signum("full_coef"))
    return diagnostics, summary, refits
