"""Column functions with the conventions of the library: half-even rounding, null-safe statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def months(date: Column) -> Column:
    """A running month number (12 * year + month)."""
    return (F.year(date).cast("long") * 12 + F.month(date)).cast("long")


def water_year(date: Column) -> Column:
    """The year in which the October-to-September water year ends."""
    return (F.year(date) + F.when(F.month(date) >= 10, 1).otherwise(0)).cast("long")


def month_day(date: Column) -> Column:
    return (F.month(date) * 100 + F.dayofmonth(date)).cast("long")


def harmonics(date: Column, terms: int = 2) -> list[Column]:
    """Sine and cosine of the day of the year, for 1 to ``terms`` cycles: sin1, cos1, ..."""
    angle = (F.dayofyear(date) - 1) * (2 * math.pi / 365.2425)
    return [f(angle * k).alias(f"{n}{k}") for k in range(1, terms + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has it (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def finite(x: Column) -> Column:
    """Whether a number is there and is neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf"))


def same_text(x: Column, text: str) -> Column:
    """Equality that disregards case and outer blanks."""
    return F.lower(F.trim(x)) == text.strip().lower()


def holds_text(x: Column, text: str) -> Column:
    """Whether a text is contained, in any case."""
    return F.contains(F.lower(x), F.lit(text.lower()))


def checked_range(x: Column, low: float, high: float, what: str) -> Column:
    """x; a value outside low..high raises, null stays null."""
    error = F.raise_error(F.concat(F.lit(f"{what} out of range: "), x.cast("string"))).cast("double")
    return F.when(x.isNull() | x.between(low, high), x.cast("double")).otherwise(error)


def recode(x: Column, labels: dict) -> Column:
    """A label for each listed value; null for others."""
    return F.create_map(*[F.lit(v) for pair in labels.items() for v in pair])[x]


def number_text(x: Column, pattern: str = "%.10g", missing: str = "NA") -> Column:
    """A number by a pattern; a text for null and NaN."""
    return F.when(finite(x), F.format_string(pattern, x.cast("double"))).otherwise(F.lit(missing))


def or_null(x: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(x), x)


def percent_effect(beta: Column) -> Column:
    """The change of a response in per cent that a coefficient on its logarithm means."""
    return F.expm1(beta) * 100


def detrended_sd(residual: str) -> Column:
    """An aggregate: the sample standard deviation of detrended residuals."""
    return F.stddev_samp(residual)


def singleton(x: Column) -> Column:
    """An aggregate: the only row's value, null for none or several."""
    return F.when(F.count("*") == 1, F.min(x))


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x within physical bounds; null stays null."""
    out = x if low is None else F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))
    return out if high is None else F.when(out.isNotNull(), F.least(out, F.lit(float(high))))


def sentinel_to_null(x: Column, *sentinels: float, below: float | None = None) -> Column:
    """Null for listed sentinels, and for values of ``below`` or less."""
    bad = x.isin(*map(float, sentinels)) if sentinels else F.lit(False)
    return F.when(~(bad if below is None else bad | (x <= below)), x)


def close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 0.0) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as an aggregate; null (not an error) where a side has no variance."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def log_checked(x: Column, plus_one: bool = False) -> Column:
    """ln(x) or ln(1 + x); values outside the domain raise."""
    bad = (x < 0) if plus_one else (x <= 0)
    error = F.raise_error(F.lit("logarithm of a value outside its domain")).cast("double")
    return F.when(bad, error).otherwise(F.log1p(x) if plus_one else F.log(x))


def strict_boolean(x: Column) -> Column:
    """'true' or 'false' (any case, trimmed); anything else raises, null stays null."""
    t = F.lower(F.trim(x))
    error = F.raise_error(F.concat(F.lit("not a boolean: "), x)).cast("boolean")
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(t.isin("true", "false"), t == "true").otherwise(error)


def optional_number(x: Column) -> Column:
    """A number, or null for blanks; junk raises (plain cast)."""
    return F.when(F.trim(x) != "", F.trim(x).cast("double"))


def _log_beta(a: np.ndarray, b: float) -> np.ndarray:
    gamma = np.vectorize(math.lgamma, otypes=[float])
    return gamma(a) + math.lgamma(b) - gamma(a + b)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided tail probability of Student's t.

    I_x(a, 1/2) with x = df / (df + t^2) and a = df / 2, integrated by Gauss-Legendre after the
    substitution x = sin^2, which leaves a smooth integrand: P = 2 / B * int_0^phi sin^(2a-1).
    """
    t, df = np.abs(np.asarray(t, float)), np.asarray(df, float)
    phi = np.arctan2(np.sqrt(df), t)
    nodes, weights = np.polynomial.legendre.leggauss(80)
    s = np.sin(phi[..., None] * (nodes + 1) / 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        power = np.where(s > 0, np.exp((df[..., None] - 1) * np.log(np.where(s > 0, s, 1))), np.where(df[..., None] == 1, 1.0, 0.0))
    return np.clip(2 * phi / 2 * (power @ weights) / np.exp(_log_beta(df / 2, 0.5)), 0, 1)


@pandas_udf(DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of Student's t (null for null or fewer than one degree of freedom)."""
    good = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index, dtype=float)
    if good.any():
        out[good] = t_two_sided(t[good].to_numpy(float), df[good].to_numpy(float))
    return out.where(good, None)


def t_quantile(df: np.ndarray, tail: float = 0.05) -> np.ndarray:
    """The t whose two tails hold ``tail``, by bisection."""
    df = np.asarray(df, float)
    low, high = np.zeros_like(df), np.full_like(df, 1e3)
    for _ in range(80):
        mid = (low + high) / 2
        over = t_two_sided(mid, df) > tail
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    return (low + high) / 2


def spearman_p(rho: Column, n: Column) -> Column:
    """Asymptotic two-sided p-value of a rank correlation (n - 2 degrees of freedom)."""
    t = rho * F.sqrt(ratio((n - 2).cast("double"), F.greatest(1 - rho * rho, F.lit(1e-300))))
    return t_probability(t.cast("double"), (n - 2).cast("double"))


def hashed_index(rep: Column, pos: Column, seed: int, n: Column) -> Column:
    """A partition-independent pseudo-random index in 0..n-1.

    Two rounds of a square and a shift: one square alone leaves a quadratic in the position, of which replicates
    share the order of their values.
    """
    m = F.lit(2147483647).cast("long")
    x = F.pmod(rep.cast("long") * 7919 + pos.cast("long") * 104729 + F.lit(seed).cast("long"), m)
    for factor, shift in ((48271, 15), (69621, 13)):
        y = F.pmod(F.pmod(x * x, m) * factor + x, m)
        x = y.bitwiseXOR(F.shiftright(y, shift))
    return F.pmod(x, n.cast("long"))


def hashed_indices(rep: np.ndarray, pos: np.ndarray, seed: int, n: int) -> np.ndarray:
    """``hashed_index`` of arrays (that broadcast against each other)."""
    m = 2147483647
    x = (rep.astype(np.int64) * 7919 + pos.astype(np.int64) * 104729 + seed) % m
    for factor, shift in ((48271, 15), (69621, 13)):
        y = (x * x % m * factor + x) % m
        x = y ^ (y >> shift)
    return x % n


def hashed_normal(rep: Column, pos: Column, seed: int) -> Column:
    """A standard normal draw that depends on its arguments alone (Box-Muller on two squared congruences)."""
    m = 2147483647

    def uniform(a: int, b: int, c: int, extra: int) -> Column:
        w = F.pmod(rep.cast("long") * a + pos.cast("long") * b + F.lit(seed + extra).cast("long"), F.lit(m))
        return (F.pmod(F.pmod(w * w, F.lit(m)) * c + w, F.lit(m)) + 1) / F.lit(float(m + 1))

    u, v = uniform(7919, 104729, 48271, 0), uniform(15485863, 32452843, 69621, 12345)
    return F.sqrt(-2 * F.log(u)) * F.cos(v * (2 * math.pi))


def hashed_normals(rep: np.ndarray, pos: np.ndarray, seed: int) -> np.ndarray:
    """``hashed_normal`` of arrays (that broadcast against each other)."""
    m = 2147483647

    def uniform(a: int, b: int, c: int, extra: int) -> np.ndarray:
        w = (np.asarray(rep, np.int64) * a + np.asarray(pos, np.int64) * b + seed + extra) % m
        return ((w * w % m * c + w) % m + 1) / float(m + 1)

    u, v = uniform(7919, 104729, 48271, 0), uniform(15485863, 32452843, 69621, 12345)
    return np.sqrt(-2 * np.log(u)) * np.cos(v * (2 * math.pi))


def number_range(spark: SparkSession, n: int, name: str, partitions: int | None = None, start: int = 0) -> DataFrame:
    """``n`` whole numbers from ``start`` (years, say)."""
    return spark.range(start, start + n, 1, partitions).withColumnRenamed("id", name)
