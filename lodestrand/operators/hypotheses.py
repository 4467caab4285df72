"""Families of directed hypotheses: associations with resampling, correction, and the checks their status needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear, rankstats, resample


def without_most_influential(df: DataFrame, x: str, y: str, by: list[str], order: str, log1p: bool = True) -> DataFrame:
    """Rank correlation without the row of the greatest Cook's distance of the fit: by, omitted, rho_without."""
    top = linear.ols(df, [x], y, by, order, log1p)[2].select(*by, F.col("max_cook_at").alias("omitted"))
    rest = df.join(top, by).where(F.col(order) != F.col("omitted"))
    return rankstats.spearman(rest, x, y, by).select(*by, F.col("rho").alias("rho_without")).join(top, by)


def hypothesis_status(df: DataFrame, x: str, y: str, by: list[str], order: str, expected: int, alternative: str, permutations: int, samples: int, seed: int, level: float = 0.05) -> DataFrame:
    """One hypothesis a group, all groups one family: rho, its interval, Holm's p, slope, checks and status.

    ``status`` is ``supported`` if rho has the ``expected`` sign, its Holm-adjusted permutation p is below ``level``, and
    the correlation keeps its sign with the ``alternative`` predictor and without the most influential row; else
    ``not supported``.  ``mechanism_status`` asks for the sign and the p alone.  A group without a correlation has neither.
    """
    tested = rankstats.holm(resample.permutation_p(df, x, y, by, [order], permutations, seed), "p", [], by, level).drop("extreme")
    interval = resample.bootstrap_rho(df, x, y, by, [order], samples, seed + 1).select(*by, "low", "high")
    slope = linear.ols(df, [x], y, by, order, log1p=True)[0].where(F.col("term") == x).select(*by, "n", F.col("coef").alias("beta"), F.col("ci_low").alias("beta_low"), F.col("ci_high").alias("beta_high"))
    other = rankstats.spearman(df, alternative, y, by).select(*by, F.col("rho").alias("rho_alternative"))
    out = tested.join(interval, by).join(slope, by).join(other, by).join(without_most_influential(df, x, y, by, order), by)
    matched = F.signum("rho") == expected
    formal = matched & F.col("passed")
    kept = (F.signum("rho_alternative") == F.signum("rho")) & (F.signum("rho_without") == F.signum("rho"))

    def named(ok):
        return F.when(F.col("rho").isNotNull(), F.when(ok, "supported").otherwise("not supported"))

    return out.withColumns({"matched": matched, "status": named(formal & kept), "mechanism_status": named(formal)})
