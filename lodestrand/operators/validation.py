"""Forecast metrics, gates, prediction intervals, domain audits and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, fresh, ratio
from .rankstats import quantiles


def metrics(df: DataFrame, actual: str, predicted: str, by: list[str]) -> DataFrame:
    """n, mae, rmse, bias and r2 of each group."""
    e = F.col(predicted) - F.col(actual)
    rows = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (1 - ratio(F.sum(e * e), F.var_pop(actual) * F.count("*"))).alias("r2"))


def baseline_gate(scored: DataFrame, by: list[str], model: str, baselines: list[str]) -> DataFrame:
    """Whether each candidate beats its group's best baseline on both mae and rmse."""
    is_base = F.col(model).isin(*baselines)
    own = Window.partitionBy(*by)
    best = [F.min(F.when(is_base, F.col(m))).over(own).alias(f"best_{m}") for m in ("mae", "rmse")]
    return scored.select("*", *best).where(~is_base).withColumn("beats", (F.col("mae") < F.col("best_mae")) & (F.col("rmse") < F.col("best_rmse")))


def empirical_intervals(df: DataFrame, actual: str, predicted: str, by: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Rows with an interval from the quantiles of their group's errors (floored at 0) and ``covered``."""
    e, lo, hi = (fresh(df.columns, n) for n in ("__e", "__lo", "__hi"))
    limits = quantiles(df.withColumn(e, F.col(actual) - F.col(predicted)), e, by, {lo: low, hi: high}).drop("n")
    out = df.join(limits, by)
    lower, upper = F.greatest(F.col(predicted) + F.col(lo), F.lit(0.0)), F.col(predicted) + F.col(hi)
    return out.select(*df.columns, lower.alias("lower"), upper.alias("upper")).withColumn("covered", F.col(actual).between(F.col("lower"), F.col("upper")))


def domain_audit(rows: DataFrame, calibration: DataFrame, features: list[str], ids: list[str]) -> DataFrame:
    """Rows outside the calibration's box: ids, outside (names, ;), n_outside, distance, severity.

    The distance is the largest excess over a side, as a share of the side's span.
    """
    side = {(n, c): fresh(rows.columns, f"__{n}_{c}") for n in ("lo", "hi") for c in features}
    box = calibration.agg(*[f(c).alias(side[n, c]) for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    excess = []
    for c in features:
        lo, hi, v = F.col(side["lo", c]), F.col(side["hi", c]), F.col(c)
        far = F.greatest(lo - v, v - hi)
        excess.append(F.struct(F.lit(c).alias("feature"), F.when(far > 0, F.when(hi > lo, far / (hi - lo)).otherwise(F.lit(float("inf")))).alias("far")))
    out = rows.join(F.broadcast(box)).select(*ids, F.filter(F.array(*excess), lambda x: x["far"].isNotNull()).alias("out"))  # one row of limits
    out = out.where(F.size("out") > 0).select(*ids, F.array_join(F.col("out.feature"), ";").alias("outside"), F.size("out").cast("long").alias("n_outside"), F.array_max(F.col("out.far")).alias("distance"))
    return out.withColumn("severity", severity(F.col("distance")))


def severity(distance: Column) -> Column:
    return F.when(distance <= 0.05, "minor").when(distance <= 0.20, "moderate").otherwise("large")


def support(direction_ok: Column, significant: Column, *signs_agree: Column) -> Column:
    """The status of a hypothesis: direction, adjusted significance, and signs under other checks."""
    agree = F.lit(True)
    for s in signs_agree:
        agree = agree & s
    return F.when(direction_ok & significant & agree, "supported").when(direction_ok & significant, "fragile").when(direction_ok, "direction only").otherwise("not supported")


def leave_group_out_mean(df: DataFrame, value: str, group: str, cell: str) -> DataFrame:
    """Rows with ``climatology``: the mean of the cell without the row's own group; of all other groups where the cell has no other."""
    totals = df.groupBy(group, cell).agg(F.sum(value).alias("s"), F.count(value).alias("n"))  # a row per group and cell
    cells, groups = Window.partitionBy(cell), Window.partitionBy(group)
    everything = totals.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    near = ratio(F.sum("s").over(cells) - F.col("s"), (F.sum("n").over(cells) - F.col("n")).cast("double"))
    far = ratio(F.col("all_s") - F.sum("s").over(groups), (F.col("all_n") - F.sum("n").over(groups)).cast("double"))
    table = totals.join(F.broadcast(everything)).select(group, cell, F.coalesce(near, far).alias("climatology"))  # one row
    return df.join(table, [group, cell])


def improvement(model: str, baseline: str) -> Column:
    """How much lower a model's error is than a baseline's, in per cent of the latter."""
    return 100 * ratio(F.col(baseline) - F.col(model), F.col(baseline))


def banded(df: DataFrame, predicted: Column, low: Column, high: Column, floor: float, ceiling: float) -> DataFrame:
    """Rows with a prediction within physical bounds, whether that changed it, and a band (errors low..high) within them."""
    kept = clamp(predicted, floor, ceiling)
    return df.select("*", kept.alias("predicted"), (F.abs(predicted - kept) > 1e-12).alias("clipped"), clamp(kept + low, floor, ceiling).alias("lower"), clamp(kept + high, floor, ceiling).alias("upper"))


#: The counters of an audit: by each key, and by keys crossed.
AUDIT_SETS = (("season",), ("month",), ("year",), ("severity",), ("window",), ("feature",), ("season", "year"), ("season", "severity"), ("season", "feature"), ("window", "severity"), ("window", "year"), ("feature", "severity"), ("month", "severity"))


def audit_counters(days: DataFrame, windows: DataFrame, sets: tuple[tuple[str, ...], ...] = AUDIT_SETS, months: tuple[int, int] = (6, 10)) -> DataFrame:
    """Counts of audited days by every key and cross of keys, in one aggregate over grouping sets: kind, key, n, of, pct.

    ``days`` has every day of the calendar: d, outside (names, ;, null if inside) and severity (null if inside).
    A day counts once in its month, year, season and severity, and once in each feature outside and each of the declared
    ``windows`` (window_id, start_md, end_md) it lies in.  ``of`` are the calendar days of the same keys; a set with
    feature or severity, which only audited days have, is set against the days of its other keys.
    """
    from ..functions.columns import month_day
    from .relational import window_members

    season = F.month("d").between(*months)
    base = days.select(
        "d", F.year("d").cast("string").alias("year"), F.date_format("d", "MM-MMM").alias("month"), F.when(season, "season").otherwise("rest").alias("season"),
        "severity", F.split("outside", ";").alias("names"), F.col("outside").isNotNull().cast("long").alias("out"),
    )
    member = window_members(base, windows, month_day(F.col("d"))).select(*base.columns, F.col("window_id").alias("window"))
    rows = base.withColumn("window", F.lit(None).cast("string")).unionByName(member)
    # A day stands for itself (no feature) and for each feature: the first counts where no feature is asked for.
    long = rows.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("names", F.array().cast("array<string>")))).alias("feature"))
    keys = ["feature", "month", "season", "severity", "window", "year"]
    marked = long.select(*keys, "out", F.col("feature").isNull().alias("itself"), F.col("window").isNull().alias("whole"))
    one = F.when(F.col("itself"), 1).otherwise(0)
    sums = {f"{w}_{k}": F.sum(F.when(F.col("whole") == (w == "day"), v).otherwise(0)).alias(f"{w}_{k}") for w in ("day", "window") for k, v in (("n", one * F.col("out")), ("of", one), ("f", 1 - one))}
    counted = marked.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("id"), *sums.values())
    number = {s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s) for s in sets}

    def of_set(value) -> Column:
        return F.coalesce(*[F.when(F.col("id") == number[s], value(s)) for s in sets])

    n = of_set(lambda s: F.col(("window" if "window" in s else "day") + ("_f" if "feature" in s else "_n")))
    # Days of the same calendar keys: over all severities and features of the set, the days without them included.
    of = F.sum(of_set(lambda s: F.col("window_of" if "window" in s else "day_of"))).over(Window.partitionBy("id", "month", "season", "window", "year"))
    named = of_set(lambda s: reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in s]))
    out = counted.select(of_set(lambda s: F.lit("+".join(s))).alias("kind"), of_set(lambda s: F.concat_ws(" ", *s)).alias("key"), n.alias("n"), of.alias("of"), named.alias("named"))
    return out.where("named AND n > 0").select("kind", "key", "n", "of", (100 * F.col("n") / F.col("of")).alias("pct"))


def audit_summary(audit: DataFrame, calendar: DataFrame, year: str, features: str = "outside") -> DataFrame:
    """Counts of audited rows by feature, severity and year, with the share of the calendar's rows: kind, key, n, pct.

    ``calendar`` has a row for every audited unit; a year's share is of its own rows, others are of all.
    """
    by_feature = audit.select(F.explode(F.split(features, ";")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).withColumn("kind", F.lit("feature"))
    by_severity = audit.groupBy(F.col("severity").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("severity"))
    every = calendar.agg(F.count("*").alias("of"))
    overall = by_feature.unionByName(by_severity).join(F.broadcast(every))  # one row
    own = calendar.groupBy(F.col(year).cast("string").alias("key")).agg(F.count("*").alias("of"))
    by_year = audit.groupBy(F.col(year).cast("string").alias("key")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("year")).join(own, "key")
    return overall.unionByName(by_year).select("kind", "key", "n", (100 * F.col("n") / F.col("of")).alias("pct"))
