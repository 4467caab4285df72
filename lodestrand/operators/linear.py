"""Linear models from Gram sums: one aggregate over the data, small solves after it."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import fresh, log_checked, ratio, t_quantile, t_two_sided


def gram(df: DataFrame, features: list[str], target: str, by: list[str]) -> DataFrame:
    """Per group: n, sums, and sums of products of the features and the target, as one array."""
    names = ["1", *features, target]
    term = {"1": F.lit(1.0), **{c: F.col(c).cast("double") for c in (*features, target)}}
    cells = [F.sum(term[a] * term[b]) for i, a in enumerate(names) for b in names[i:]]
    return df.dropna(subset=[*features, target]).groupBy(*by).agg(F.array(*cells).alias("gram"))


def unpack_gram(cells: np.ndarray, size: int) -> np.ndarray:
    """The symmetric matrix of (1, features, target) products."""
    out = np.zeros((size, size))
    out[np.triu_indices(size)] = cells
    return out + np.triu(out, 1).T


def ridge_from_gram(g: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, slopes on the raw scale); features standardized by population deviation."""
    n, p = g[0, 0], len(g) - 2
    mean = g[0, 1:-1] / n
    cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov) / n, 0))
    scale[scale == 0] = 1
    target_mean = g[0, -1] / n
    xy = (g[1:-1, -1] - n * mean * target_mean) / scale
    beta = np.linalg.pinv(cov / np.outer(scale, scale) + alpha * np.eye(p)) @ xy / scale
    return np.r_[target_mean - mean @ beta, beta]


def checked_ridge(g: np.ndarray, alpha: float) -> np.ndarray:
    """(intercept, raw slopes) of a Gram matrix; too few rows, a constant feature or a singular system raise."""
    n, p = g[0, 0], len(g) - 2
    if n <= p:
        raise ValueError(f"{int(n)} rows are too few for {p} features")
    mean = g[0, 1:-1] / n
    cov = g[1:-1, 1:-1] / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0))
    if (spread <= 1e-12 * np.maximum(1, np.abs(mean))).any():
        raise ValueError("a feature is constant")
    if p and np.linalg.cond(cov / np.outer(spread, spread) + alpha / n * np.eye(p)) > 1e12:
        raise ValueError("the regression matrix is singular")
    return ridge_from_gram(g, alpha)


def ridge(df: DataFrame, features: list[str], target: str, by: list[str], alpha: float) -> DataFrame:
    """Ridge coefficients of each group: by, term, coef (alpha 0: least squares)."""
    size, terms = len(features) + 2, ["intercept", *features]
    sums = gram(df, features, target, by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name != "gram")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = [ridge_from_gram(unpack_gram(np.asarray(c), size), alpha) for c in frame["gram"]]
            out = frame[by].loc[frame.index.repeat(len(terms))].reset_index(drop=True)
            yield out.assign(term=terms * len(frame), coef=np.concatenate(fits) if fits else np.zeros(0))

    return sums.mapInPandas(solve, f"{kinds + ', ' if by else ''}term string, coef double")


def coefficient_table(df: DataFrame, features: list[str], target: str, by: list[str], alpha: float) -> DataFrame:
    """Ridge coefficients per population standard deviation: by, term, coef, multiplicative (its exp), mean, sd, vif."""
    stats = [F.struct(F.lit(c).alias("term"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")) for c in features]
    sized = df.dropna(subset=[*features, target]).groupBy(*by).agg(F.array(*stats).alias("s")).select(*by, F.inline("s"))
    key = [*by, "term"]
    fits = ridge(df, features, target, by, alpha).where("term <> 'intercept'").join(sized, key).withColumn("coef", F.col("coef") * F.col("sd"))
    return fits.join(vif(df.dropna(subset=[*features, target]), features, by), key).select(*key, "coef", F.exp("coef").alias("multiplicative"), "mean", "sd", "vif")


def leave_group_out_ridge(df: DataFrame, features: list[str], target: str, group: str, alphas: list[float]) -> DataFrame:
    """Held-out errors of ridge fits without each group in turn: alpha, rmse, mae, r2, best.

    A fold's Gram matrix is the total less the group's own, so the data are read once for the sums
    and once for the predictions; coefficients (groups x alphas) join back by group.  A fold that cannot be
    fitted (too few rows, a constant feature, a singular system) raises.
    """
    size = len(features) + 2
    own = gram(df, features, target, [group])
    total = own.agg(F.array(*[F.sum(F.col("gram")[i]) for i in range(size * (size + 1) // 2)]).alias("total"))
    paired = own.join(F.broadcast(total))  # one row
    kind = dict(df.dtypes)[group]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, cells, all_cells in zip(frame[group], frame["gram"], frame["total"], strict=True):
                g = unpack_gram(np.asarray(all_cells) - np.asarray(cells), size)
                rows += [(key, a, list(checked_ridge(g, a))) for a in alphas]
            yield pd.DataFrame(rows, columns=[group, "alpha", "coef"])

    fits = paired.mapInPandas(solve, f"`{group}` {kind}, alpha double, coef array<double>")
    predicted = F.col("coef")[0] + sum((F.col(c) * F.col("coef")[i + 1] for i, c in enumerate(features)), F.lit(0.0))
    errors = df.dropna(subset=[*features, target]).join(fits, group).select("alpha", (predicted - F.col(target)).alias("e"), F.col(target).alias("y"))
    scored = errors.groupBy("alpha").agg(F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"), (1 - ratio(F.sum(F.col("e") ** 2), F.var_pop("y") * F.count("*"))).alias("r2"))
    best = F.row_number().over(Window.orderBy("rmse", F.desc("alpha"))) == 1  # a row per alpha
    return scored.withColumn("best", best)


def simple_ols(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rows with their fit on one predictor: slope, intercept, fitted, residual, leverage, cook (windows only)."""
    own = Window.partitionBy(*by)
    n, mx, my = F.count("*").over(own), F.avg(x).over(own), F.avg(y).over(own)
    sxx = F.var_pop(x).over(own) * n
    slope = ratio(F.covar_pop(x, y).over(own) * n, sxx)
    new = ("n", "mean_x", "sxx", "slope", "intercept", "residual", "leverage", "cook")
    out = df.select(*[c for c in df.columns if c not in new], n.alias("n"), mx.alias("mean_x"), sxx.alias("sxx"), slope.alias("slope"), (my - slope * mx).alias("intercept"))
    fitted = F.col("intercept") + F.col("slope") * F.col(x)
    out = out.withColumn("residual", F.col(y) - fitted).withColumn("leverage", 1 / F.col("n") + ratio((F.col(x) - F.col("mean_x")) ** 2, F.col("sxx")))
    mse = F.sum(F.col("residual") ** 2).over(own) / F.when(F.col("n") > 2, F.col("n") - 2)
    return out.withColumn("cook", ratio(F.col("residual") ** 2 * F.col("leverage"), 2 * mse * (1 - F.col("leverage")) ** 2))


def hc3(fitted: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Slope and its HC3 robust standard error, from rows of ``simple_ols``."""
    meat = ratio((F.col(x) - F.col("mean_x")) ** 2 * F.col("residual") ** 2, (1 - F.col("leverage")) ** 2)
    return fitted.groupBy(*by).agg(F.max("n").alias("n"), F.max("slope").alias("slope"), (F.sqrt(F.sum(meat)) / F.max("sxx")).alias("hc3_se"))


def rolling_ols(df: DataFrame, x: str, y: str, by: list[str], order: list[str], least: int = 12) -> DataFrame:
    """Rolling-origin predictions: each row from a line fitted to all earlier rows of its series.

    Window sums of x, y, xx and xy before the row replace the refits.
    """
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(F.col(x) * F.col(x)), "sxy": F.sum(F.col(x) * F.col(y))}
    n, sx, sy, sxx, sxy = (F.col(fresh(df.columns, f"__{k}")) for k in sums)
    seen = df.select("*", *[c.over(before).alias(fresh(df.columns, f"__{k}")) for k, c in sums.items()]).where(n >= least)
    slope = ratio(n * sxy - sx * sy, n * sxx - sx * sx)
    return seen.select(*df.columns, ((sy - slope * sx) / n + slope * F.col(x)).alias("predicted"))


def _kinds(df: DataFrame, columns: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in columns)


def keys_of(frame: pd.DataFrame, by: list[str]) -> list[tuple]:
    """The key of each row; an empty one without key columns."""
    return list(zip(*[frame[c] for c in by], strict=True)) if by else [()] * len(frame)


def checked_gram(g: np.ndarray) -> np.ndarray:
    """A Gram matrix that a fit can use: more rows than terms, no constant feature, not singular; else it raises."""
    n, size = g[0, 0], len(g) - 1
    if n <= size:
        raise ValueError(f"{int(n)} rows are too few for {size} terms")
    cov = g[1:-1, 1:-1] / n - np.outer(g[0, 1:-1], g[0, 1:-1]) / n**2
    spread = np.diag(cov)
    if len(spread) and (spread <= 1e-12 * np.maximum(1, (g[0, 1:-1] / n) ** 2)).any():
        raise ValueError("a feature is constant")
    if len(spread) and np.linalg.cond(cov / np.sqrt(np.outer(spread, spread))) > 1e12:
        raise ValueError("the features are linearly dependent")
    return g


def predict(df: DataFrame, coefficients: DataFrame, features: list[str], by: list[str], out: str = "predicted") -> DataFrame:
    """Rows with the prediction of their group's coefficients (by, term, coef; a term per feature and the intercept)."""
    wide = coefficients.groupBy(*by).pivot("term", ["intercept", *features]).agg(F.first("coef")).select(*by, *[F.col(f"`{c}`").alias(f"__{c}") for c in ("intercept", *features)])
    joined = df.join(wide, by) if by else df.join(F.broadcast(wide))  # one row without groups
    value = F.col("__intercept") + sum((F.col(c) * F.col(f"__{c}") for c in features), F.lit(0.0))
    return joined.select(*df.columns, value.alias(out))


def ols(df: DataFrame, predictors: list[str], target: str, by: list[str], order: str, log1p: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Least squares with HC3 errors for each group, on predictors in sample standard deviations.

    Coefficients: by, n, term, coef, se, ci_low, ci_high, p (t with n - k degrees), mean, sd, percent_effect (with
    ``log1p``).  Diagnostics: by, order, observed, fitted, residual, leverage, cook, studentized (externally), flag
    (cook > 4 / n).  Summary: by, n, adjusted_r2, max_cook and its ``order`` (the first of ties), flags.
    Constant or dependent predictors and groups of n <= k + 1 rows raise.  Means, spreads, Gram and
    sandwich sums are Spark aggregates; Python solves one small system a group.
    """
    k = len(predictors) + 1
    own = Window.partitionBy(*by)
    y = log_checked(F.col(target).cast("double"), True) if log1p else F.col(target).cast("double")
    rows = df.dropna(subset=[*predictors, target, order]).select(*by, order, y.alias("observed"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(predictors)])
    cells = [c for i in range(k - 1) for c in (F.avg(f"x{i}").over(own).alias(f"m{i}"), F.stddev_samp(f"x{i}").over(own).alias(f"s{i}"))]
    error = F.raise_error(F.lit("a predictor is constant")).cast("double")
    spread = [F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(error) for i in range(k - 1)]
    rows = rows.select("*", *cells).select("*", *[((F.col(f"x{i}") - F.col(f"m{i}")) / s).alias(f"z{i}") for i, s in enumerate(spread)])
    zs = [f"z{i}" for i in range(k - 1)]
    sums = gram(rows, zs, "observed", by)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = []
            for cells in frame["gram"]:
                g = checked_gram(unpack_gram(np.asarray(cells), k + 1))
                if g[0, 0] <= k + 1:
                    raise ValueError(f"{int(g[0, 0])} rows are too few for {k} terms")
                inverse = np.linalg.inv(g[:-1, :-1])
                fits.append((int(g[0, 0]), (inverse @ g[:-1, -1]).tolist(), inverse.ravel().tolist()))
            yield frame[by].assign(**{n: [f[i] for f in fits] for i, n in enumerate(("n", "beta", "inverse"))})

    fitted = sums.mapInPandas(solve, _kinds(df, by) + "n long, beta array<double>, inverse array<double>")
    z = [F.lit(1.0), *map(F.col, zs)]
    value = sum((F.col("beta")[i] * z[i] for i in range(k)), F.lit(0.0))
    lever = sum((F.col("inverse")[i * k + j] * z[i] * z[j] for i in range(k) for j in range(k)), F.lit(0.0))
    full = rows.join(fitted, by).withColumn("fitted", value).withColumn("leverage", F.least(lever, F.lit(0.999999)))
    full = full.withColumn("residual", F.col("observed") - F.col("fitted")).withColumn("mse", F.sum(F.col("residual") * F.col("residual")).over(own) / (F.col("n") - k))
    square, rest = F.col("residual") * F.col("residual"), 1 - F.col("leverage")
    without = (F.col("mse") * (F.col("n") - k) - square / rest) / (F.col("n") - k - 1)
    cook = ratio(square * F.col("leverage"), k * F.col("mse") * rest * rest)
    full = full.withColumn("cook", cook).withColumn("studentized", ratio(F.col("residual"), F.sqrt(F.greatest(without * rest, F.lit(0.0))))).withColumn("flag", F.col("cook") > 4 / F.col("n"))
    diagnostics = full.select(*by, order, "observed", "fitted", "residual", "leverage", "cook", "studentized", "flag")

    weight = square / (rest * rest)
    meat = F.array(*[F.sum(z[i] * z[j] * weight) for i in range(k) for j in range(k)])
    spreads = [F.array(*[F.max(f"{c}{i}") for i in range(k - 1)]).cast("array<double>") for c in ("m", "s")]
    robust = full.groupBy(*by).agg(F.max("n").alias("n"), F.first("beta").alias("beta"), F.first("inverse").alias("inverse"), meat.alias("meat"), spreads[0].alias("mean"), spreads[1].alias("sd"))
    terms = ["const", *predictors]

    def sandwich(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for at, r in frame.iterrows():
                inverse, middle = (np.asarray(r[c]).reshape(k, k) for c in ("inverse", "meat"))
                beta, se, df_ = np.asarray(r["beta"]), np.sqrt(np.diag(inverse @ middle @ inverse)), float(r["n"] - k)
                reach = t_quantile(np.array([df_]))[0] * se
                p = t_two_sided(np.divide(beta, se, out=np.full(k, np.inf), where=se > 0), np.full(k, df_))
                mean, sd = [None, *r["mean"]], [None, *r["sd"]]
                rows += [(*frame.loc[at, by], r["n"], terms[i], beta[i], se[i], beta[i] - reach[i], beta[i] + reach[i], p[i], mean[i], sd[i]) for i in range(k)]
            yield pd.DataFrame(rows, columns=[*by, "n", "term", "coef", "se", "ci_low", "ci_high", "p", "mean", "sd"])

    coefficients = robust.mapInPandas(sandwich, _kinds(df, by) + "n long, term string, coef double, se double, ci_low double, ci_high double, p double, mean double, sd double")
    effect = F.when(F.lit(log1p) & (F.col("term") != "const"), F.expm1("coef") * 100)
    coefficients = coefficients.withColumn("percent_effect", effect)
    top = F.min(F.struct((-F.col("cook")).alias("c"), F.col(order).alias("at")))
    r2 = 1 - ratio(F.sum(square) / (F.max("n") - k), F.var_samp("observed"))
    summary = full.groupBy(*by).agg(F.max("n").alias("n"), r2.alias("adjusted_r2"), F.max("cook").alias("max_cook"), top["at"].alias("max_cook_at"), F.count_if("flag").alias("flags"))
    return coefficients, diagnostics, summary


def influence_refit(df: DataFrame, predictors: list[str], target: str, by: list[str], order: str, log1p: bool = False) -> DataFrame:
    """Each slope with and without the row of the greatest Cook's distance: by, term, omitted, full, refit (each with limits),
    change, sign_changed."""
    full, _, summary = ols(df, predictors, target, by, order, log1p)
    omitted = summary.select(*by, F.col("max_cook_at").alias(order))
    reduced, _, _ = ols(df.join(omitted, [*by, order], "left_anti"), predictors, target, by, order, log1p)
    limits = [("coef", "coef"), ("ci_low", "low"), ("ci_high", "high"), ("n", "n")]
    sides = [t.select(*by, "term", *[F.col(a).alias(f"{name}_{b}") for a, b in limits]) for name, t in (("full", full), ("refit", reduced))]
    both = sides[0].join(sides[1], [*by, "term"]).where("term <> 'const'").join(omitted.withColumnRenamed(order, "omitted"), by)
    return both.withColumn("change", F.abs(F.col("refit_coef") - F.col("full_coef"))).withColumn("sign_changed", F.signum("refit_coef") != F.signum("full_coef"))


def vif_two(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Variance inflation of two predictors: 1 / (1 - r^2)."""
    from ..functions.columns import correlation

    return df.groupBy(*by).agg(correlation(a, b).alias("r")).withColumn("vif", ratio(F.lit(1.0), 1 - F.col("r") ** 2))


def vif(df: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """Variance inflation of any number of predictors, from the correlation matrix: by, term, vif."""
    size = len(features) + 2
    sums = gram(df.withColumn("__t", F.lit(0.0)), features, "__t", by)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name != "gram")

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, cells in zip(frame.index, frame["gram"], strict=True):
                g = unpack_gram(np.asarray(cells), size)
                cov = g[1:-1, 1:-1] / g[0, 0] - np.outer(g[0, 1:-1], g[0, 1:-1]) / g[0, 0] ** 2
                sd = np.sqrt(np.diag(cov))
                rows += [(*frame.loc[i, by], f, v) for f, v in zip(features, np.diag(np.linalg.pinv(cov / np.outer(sd, sd))), strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "term", "vif"])

    return sums.mapInPandas(solve, f"{kinds + ', ' if by else ''}term string, vif double")


def _normal_scores(pdf_n: pd.Series, pdf_i: pd.Series) -> pd.Series:
    normal = NormalDist()
    return pd.Series([normal.inv_cdf((i - 0.375) / (n + 0.25)) for n, i in zip(pdf_n, pdf_i, strict=True)], dtype=float)


normal_score = F.pandas_udf(_normal_scores, DoubleType())

#: Coefficients of Royston's published approximation, the highest power first.
ENDS = ([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157], [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981])
SMALL = ([-0.0006714, 0.025054, -0.39978, 0.544], [-0.0020322, 0.062767, -0.77857, 1.3822])
LARGE = ([0.0038915, -0.083751, -0.31082, -1.5861], [0.0030302, -0.082676, -0.4803])


def shapiro_weights(n: int) -> np.ndarray:
    """The weights of the ordered values, by the same approximation (for tests)."""
    normal = NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        return np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    norm, u = float(m @ m), 1 / math.sqrt(n)
    ends = [np.polyval([*c, m[-1 - i] / math.sqrt(norm)], u) for i, c in enumerate(ENDS[: 2 if n > 5 else 1])]
    inner = math.sqrt((norm - 2 * sum(m[-1 - i] ** 2 for i in range(len(ends)))) / (1 - 2 * sum(e**2 for e in ends)))
    weights = m / inner
    for i, e in enumerate(ends):
        weights[-1 - i], weights[i] = e, -e
    return weights


def shapiro_p(n: int, w: float) -> float | None:
    """The p-value of W for 3 to 5000 values; none for other numbers."""
    if not 3 <= n <= 5000 or w is None or w != w:
        return None
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(min(w, 1.0))) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    if n <= 11:
        y = -math.log(0.459 * n - 2.273 - math.log(1 - w))
        mu, sigma = np.polyval(SMALL[0], n), math.exp(np.polyval(SMALL[1], n))
    else:
        y = math.log(1 - w)
        mu, sigma = np.polyval(LARGE[0], math.log(n)), math.exp(np.polyval(LARGE[1], math.log(n)))
    return math.erfc((y - mu) / sigma / math.sqrt(2)) / 2


def _shapiro_probability(n: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([shapiro_p(int(a), b) for a, b in zip(n, w, strict=True)], dtype=float)


shapiro_probability = F.pandas_udf(_shapiro_probability, DoubleType())


def shapiro_wilk(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """W and p of each group's values; null for fewer than 3 or all equal ones, and p for more than 5000.

    Values are ranked, and their weights depend on rank and number alone, so W is one aggregate over a sort
    that spills; no group is gathered.
    """
    own = Window.partitionBy(*by)
    ranked = df.dropna(subset=[value]).select(*by, F.col(value).cast("double").alias("v"), F.row_number().over(own.orderBy(value)).alias("i"), F.count("*").over(own).alias("n"))
    scored = ranked.withColumn("m", normal_score("n", "i"))
    place = F.least("i", F.col("n") + 1 - F.col("i"))  # 1 at both ends
    norm = F.sum(F.col("m") * F.col("m")).over(own)
    u = 1 / F.sqrt("n")

    def end(i: int, top) -> Column:
        out = F.lit(0.0)
        for c in ENDS[i]:
            out = out * u + c
        return out * u + top / F.sqrt("norm")

    tops = scored.select("*", norm.alias("norm"), *[F.max(F.when(F.col("n") + 1 - F.col("i") == k, F.col("m"))).over(own).alias(f"top{k}") for k in (1, 2)])
    ended = tops.withColumn("e1", end(0, F.col("top1"))).withColumn("e2", F.when(F.col("n") > 5, end(1, F.col("top2"))).otherwise(0.0))
    used = F.col("top1") * F.col("top1") + F.when(F.col("n") > 5, F.col("top2") * F.col("top2")).otherwise(0.0)
    inner = F.sqrt((F.col("norm") - 2 * used) / (1 - 2 * (F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2"))))
    sign = F.when(F.col("i") * 2 <= F.col("n"), -1.0).otherwise(1.0)
    weight = F.when(F.col("n") == 3, F.when(F.col("i") == 2, 0.0).otherwise(sign * math.sqrt(0.5)))
    weight = weight.when(place == 1, sign * F.col("e1")).when((place == 2) & (F.col("n") > 5), sign * F.col("e2")).otherwise(F.col("m") / inner)
    weighed = ended.withColumn("a", F.when(F.col("n") >= 3, weight))
    total = F.sum(F.col("a") * F.col("v"))
    square = F.var_pop("v") * F.count("*")
    w = F.when(square > 0, F.least(total * total / square, F.lit(1.0)))
    return weighed.groupBy(*by).agg(F.max("n").alias("n"), F.when(F.max("n") >= 3, w).alias("w")).select(*by, "w", shapiro_probability("n", "w").alias("p"))


def rolling_ridge(df: DataFrame, features: list[str], target: str, by: list[str], order: str, alphas: list[float], least: int = 6) -> DataFrame:
    """Rolling-origin predictions of log1p ridge fits: by, order, train (rows before), actual, alpha, predicted (a count, 0 at least).

    A row's training sums are window sums over the rows before it; Python solves one small system a row and alpha.
    """
    types = dict(df.dtypes)
    size = len(features) + 2
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.dropna(subset=[*features, target]).select(*by, order, *[F.col(c).cast("double").alias(c) for c in (*features, target)])
    term = [F.lit(1.0), *map(F.col, features), log_checked(F.col(target), True)]
    sums = [F.sum(term[i] * term[j]).over(before) for i in range(size) for j in range(i, size)]
    seen = rows.select(*by, order, F.col(target).alias("actual"), F.array(*features).alias("x"), F.array(*sums).alias("gram")).where(F.col("gram")[0] >= least)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys, out = frame[[*by, order]], []
            for cells, x in zip(frame["gram"], frame["x"], strict=True):
                g = unpack_gram(np.asarray(cells), size)
                out += [(int(g[0, 0]), a, max(0.0, math.expm1(float(np.r_[1.0, x] @ ridge_from_gram(g, a))))) for a in alphas]
            again = keys.loc[keys.index.repeat(len(alphas))].reset_index(drop=True)
            actual = frame["actual"].repeat(len(alphas)).to_numpy()
            yield again.assign(train=[o[0] for o in out], actual=actual, alpha=[o[1] for o in out], predicted=[o[2] for o in out])

    return seen.mapInPandas(solve, _kinds(df, by) + f"`{order}` {types[order]}, train long, actual double, alpha double, predicted double")


def nested_ridge(df: DataFrame, features: list[str], target: str, by: list[str], order: str, alphas: list[float], least: int = 12, default: float = 10.0) -> DataFrame:
    """Rolling-origin ridge whose alpha an inner time-ordered split chooses: by, order, actual, predicted, alpha.

    The inner split of a row tests the last six rows before it (each fitted to the rows before itself, six at
    least) and takes the least mean error, the smaller alpha of ties; fewer than nine rows take ``default``.  An inner
    test is the rolling prediction of that row, so all are computed once and averaged by a window.
    """
    tests = rolling_ridge(df, features, target, by, order, sorted({*alphas, default}))
    error = F.abs(F.col("predicted") - F.col("actual"))
    recent = Window.partitionBy(*by, "alpha").orderBy(order).rowsBetween(-6, -1)
    scored = tests.withColumn("score", F.avg(error).over(recent)).where(F.col("train") >= least)
    allowed = F.col("alpha").isin(*map(float, alphas)) & (F.col("train") >= 9) | (F.col("alpha") == default) & (F.col("train") < 9)
    best = F.row_number().over(Window.partitionBy(*by, order).orderBy("score", "alpha"))
    return scored.where(allowed).withColumn("r", best).where("r = 1").select(*by, order, "actual", "predicted", "alpha")
