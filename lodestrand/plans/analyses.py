"""More registered queries: model tables, trend and association bundles, validation, scenarios and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import checked_range, detrended_sd, harmonics, holds_text, log_checked, month_day, number_text, percent_effect, recode, same_text, singleton
from ..operators import contracts, hypotheses, linear, models, rankstats, relational, resample, timeseries, validation
from .base import DAILY, ENV, JOINED, PANEL, corr, daily, environment, index_sql, joined, normal_sql, normal_tail_sql, panel, ranks, t_quantile_sql, t_tail_sql, table
from .queries import BASELINES, MILLI_DAYS, MILLI_MEAN, POSITIONED, QUERIES, SQL, TESTS, WINDOWS_SQL, forecasts, milli_days, query, r6, rounded, tests_of, windows

__all__ = ["QUERIES", "SQL"]


# -- trends and associations

TREND_LONG = f"""{PANEL}, long AS (SELECT grp, 'y' AS variable, m, y AS v FROM panel UNION ALL SELECT grp, 'n', m, n::DOUBLE FROM panel)"""


@query(f"""
WITH {TREND_LONG}, s AS (
  SELECT a.grp, a.variable, (b.v - a.v) / (b.m - a.m) AS slope, sign(b.v - a.v) AS up FROM long a JOIN long b ON a.grp = b.grp AND a.variable = b.variable AND a.m < b.m),
o AS (SELECT grp, variable, median(slope) AS slope, list_sort(list(slope)) AS l, count(*) AS c, sum(up) AS s, count(*) FILTER (WHERE up = 0) AS ties FROM s GROUP BY ALL),
t AS (SELECT grp, variable, sum(k)::BIGINT AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT grp, variable, v, count(*) AS k FROM long GROUP BY ALL) GROUP BY ALL),
w AS (SELECT o.*, t.n, (t.n * (t.n - 1) * (2 * t.n + 5) - t.tied) / 18.0 AS var FROM o JOIN t USING (grp, variable)),
e AS (SELECT *, row_number() OVER (PARTITION BY grp, variable ORDER BY m) AS a, row_number() OVER (PARTITION BY grp, variable ORDER BY m DESC) AS b FROM long),
f AS (SELECT grp, variable, min(m) AS first, max(m) AS last, median(e.v - w.slope * m) AS intercept, avg(e.v) FILTER (WHERE a <= 5) AS first_mean, avg(e.v) FILTER (WHERE b <= 5) AS last_mean
      FROM e JOIN w USING (grp, variable) GROUP BY ALL),
p AS (SELECT *, s / sqrt(c * (c - ties)::DOUBLE) AS tau, {normal_tail_sql("s / sqrt(var)")} AS p, l[CAST(greatest(round_even((c - 1.959964 * sqrt(var)) / 2, 0) - 1, 0) AS INT) + 1] AS low,
             l[CAST(least(round_even((c + 1.959964 * sqrt(var)) / 2, 0), c - 1) AS INT) + 1] AS high FROM w JOIN f USING (grp, variable)),
k AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY p, grp) AS k, count(*) OVER (PARTITION BY variable) AS tests FROM p)
SELECT grp, variable, n, first, last, round(tau, 6) AS tau, round(p, 5) AS p, round(slope, 4) AS slope, round(low, 4) AS low, round(high, 4) AS high, round(intercept, 2) AS intercept,
       round(first_mean, 3) AS first_mean, round(last_mean, 3) AS last_mean, round(100 * (last_mean / first_mean - 1), 5) AS change_pct,
       round(least(min(p * tests / k) OVER (PARTITION BY variable ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 5) AS q FROM k""")
def trend_bundle(spark, d):
    long = panel(spark, d).withColumn("n", F.col("n").cast("double")).unpivot(["grp", "m"], ["y", "n"], "variable", "v")
    out = rankstats.benjamini_hochberg(rankstats.trend(long, "m", "v", ["grp", "variable"]), "p", ["variable"], ["grp"])
    out = rounded(rounded(rounded(out, "tau"), "p", "q", "change_pct", to=5), "slope", "low", "high", to=4)
    out = rounded(rounded(out, "first_mean", "last_mean", to=3), "intercept", to=2)
    return out.select("grp", "variable", "n", "first", "last", "tau", "p", "slope", "low", "high", "intercept", "first_mean", "last_mean", "change_pct", "q")


LAGGED = f"""{PANEL}, {ENV}, lagged AS (
  SELECT p.grp, l.lag, v.variable, p.m, p.y, CASE v.variable WHEN 'x1' THEN e.x1 ELSE e.x2 END AS x
  FROM panel p, (SELECT unnest([1, 2, 3])::BIGINT AS lag) l, (SELECT unnest(['x1', 'x2']) AS variable) v JOIN env e ON e.m = p.m - l.lag)"""


def lagged(spark: SparkSession, d: str) -> DataFrame:
    """The panel with each environment variable 1, 2 and 3 months before, long."""
    cells = panel(spark, d).select("grp", "m", "y", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("lag"))
    wide = relational.lag_join(cells, environment(spark, d), "m", F.col("lag"), ["x1", "x2"])
    return wide.unpivot(["grp", "lag", "m", "y"], ["x1", "x2"], "variable", "x").where("x IS NOT NULL")


@query(f"""
WITH {LAGGED}, r AS ({ranks("grp, lag, variable", "x", "y", "lagged")}),
c AS (SELECT grp, lag, variable, count(*) AS n, {corr("rx", "ry")} AS rho FROM r GROUP BY ALL),
p AS (SELECT *, {t_tail_sql("rho * sqrt((n - 2) / (1 - rho * rho))", "n - 2")} AS p FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY p, grp, lag, variable) AS k, count(*) OVER () AS tests FROM p)
SELECT grp, lag, variable, n, round(rho, 6) AS rho, round(p, 5) AS p,
       round(least(min(p * tests / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 5) AS q FROM k""")
def lag_sensitivity(spark, d):
    tests = rankstats.spearman(lagged(spark, d), "x", "y", ["grp", "lag", "variable"], p=True)
    out = rankstats.benjamini_hochberg(tests, "p", [], ["grp", "lag", "variable"])
    return rounded(rounded(out, "rho"), "p", "q", to=5)


@query(f"""
WITH {JOINED}, f AS ({ranks("grp", "x2", "y", "joined")}), c AS (SELECT grp, count(*) AS n_full, {corr("rx", "ry")} AS rho FROM f GROUP BY grp),
o AS (SELECT b.grp, a.m AS omitted, b.x2, b.y FROM joined a JOIN joined b ON a.grp = b.grp AND a.m <> b.m), r AS ({ranks("grp, omitted", "x2", "y", "o")}),
l AS (SELECT grp, omitted, {corr("rx", "ry")} AS r FROM r GROUP BY ALL)
SELECT grp, n_full, round(rho, 6) AS rho, round(min(r), 6) AS rho_min, round(max(r), 6) AS rho_max, count(*) FILTER (WHERE sign(r) <> sign(rho)) AS sign_changes
FROM l JOIN c USING (grp) GROUP BY ALL""")
def leave_one_out_summary(spark, d):
    return rounded(rankstats.leave_one_out_summary(joined(spark, d), "x2", "y", ["grp"], "m"), "rho", "rho_min", "rho_max")


@query(f"""
WITH {JOINED}, r0 AS ({ranks("grp", "x1", "y", "joined", ", m")}),
f AS (SELECT grp, regr_slope(rx, m) AS bx, regr_slope(ry, m) AS "by", avg(rx) AS mx, avg(ry) AS my, avg(m) AS mm FROM r0 GROUP BY grp),
e AS (SELECT grp, m, rx, ry, rx - mx - bx * (m - mm) AS ex, ry - my - "by" * (m - mm) AS ey, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM r0 JOIN f USING (grp)),
b AS (SELECT *, lag(rx) OVER w AS rx_b, lag(ry) OVER w AS ry_b, lag(ex) OVER w AS ex_b, lag(ey) OVER w AS ey_b FROM e WINDOW w AS (PARTITION BY grp ORDER BY m)),
c AS (SELECT grp, count(*) AS n, {corr("rx", "ry")} AS rho, {corr("ex", "ey")} AS rd, {corr("CASE WHEN rx_b IS NOT NULL THEN rx END", "rx_b")} AS a, {corr("CASE WHEN ry_b IS NOT NULL THEN ry END", "ry_b")} AS b,
             {corr("CASE WHEN ex_b IS NOT NULL THEN ex END", "ex_b")} AS ea, {corr("CASE WHEN ey_b IS NOT NULL THEN ey END", "ey_b")} AS eb FROM b GROUP BY grp),
s AS (SELECT a.grp, k.shift, {corr("a.ex", "z.ey")} AS r FROM e a, LATERAL (SELECT unnest(range(0, a.n)) AS shift) k JOIN e z ON z.grp = a.grp AND z.pos = ((a.pos - k.shift) % a.n + a.n) % a.n GROUP BY ALL),
x AS (SELECT s.grp, count(*) FILTER (WHERE abs(r) >= abs(rd) - 1e-12) / count(*) AS p FROM s JOIN c USING (grp) GROUP BY s.grp)
SELECT grp, n, round(rho, 6) AS rho, round(rd, 6) AS rho_detrended, round(a, 6) AS lag1_rx, round(b, 6) AS lag1_ry, round(ea, 6) AS lag1_rx_r, round(eb, 6) AS lag1_ry_r,
       abs(ea) >= 0.1 OR abs(eb) >= 0.1 AS triggered, CASE WHEN sign(rho) = sign(rd) THEN 'retained' ELSE 'reversed' END AS direction,
       round(100 * (abs(rd) - abs(rho)) / abs(rho), 4) AS magnitude_change_pct, CASE WHEN abs(ea) >= 0.1 OR abs(eb) >= 0.1 THEN round(p, 6) END AS p_shift
FROM c JOIN x USING (grp)""")
def temporal_sensitivity(spark, d):
    out = rankstats.temporal_sensitivity(joined(spark, d), "x1", "y", "m", ["grp"], trigger=0.1)
    return rounded(rounded(out, "rho", "rho_detrended", "lag1_rx", "lag1_ry", "lag1_rx_r", "lag1_ry_r", "p_shift"), "magnitude_change_pct", to=4)


# -- least squares


def ols_sql(x: str, source: str = "joined", p: str = "") -> str:
    """CTEs of a fit of ln(1 + y) on one standardized predictor for each grp: {p}g are its rows, {p}c its coefficients."""
    robust = f"sqrt(sum(e * e / ((1 - h) * (1 - h))))/ max(n)"
    slope = f"sqrt(sum(z * z * e * e / ((1 - h) * (1 - h)))) / (max(n) - 1)"
    return f"""{p}o AS (SELECT grp, m, ln(1 + y) AS v, {x} AS x FROM {source}),
{p}s AS (SELECT grp, count(*) AS n, avg(x) AS mx, stddev_samp(x) AS sx, avg(v) AS mv, regr_slope(v, x) * stddev_samp(x) AS b FROM {p}o GROUP BY grp),
{p}e AS (SELECT grp, m, n, mx, sx, mv, b, v, (x - mx) / sx AS z, mv + b * (x - mx) / sx AS f, v - mv - b * (x - mx) / sx AS e, 1.0 / n + ((x - mx) / sx) ** 2 / (n - 1) AS h FROM {p}o JOIN {p}s USING (grp)),
{p}q AS (SELECT grp, sum(e * e) / (max(n) - 2) AS mse FROM {p}e GROUP BY grp),
{p}g AS (SELECT {p}e.*, mse, e * e * h / (2 * mse * (1 - h) ** 2) AS cook, e / sqrt((mse * (n - 2) - e * e / (1 - h)) / (n - 3) * (1 - h)) AS st FROM {p}e JOIN {p}q USING (grp)),
{p}c AS (SELECT grp, max(n) AS n, 'const' AS term, max(mv) AS coef, {robust} AS se, NULL::DOUBLE AS mean, NULL::DOUBLE AS sd FROM {p}g GROUP BY grp
  UNION ALL SELECT grp, max(n), '{x}', max(b), {slope}, max(mx), max(sx) FROM {p}g GROUP BY grp)"""


COEFFICIENTS = f"""grp, n, term, round(coef, 6) AS coef, round(se, 6) AS se, round(coef - {t_quantile_sql("(n - 2)")} * se, 5) AS ci_low, round(coef + {t_quantile_sql("(n - 2)")} * se, 5) AS ci_high,
  round({t_tail_sql("coef / se", "n - 2")}, 5) AS p, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN term <> 'const' THEN round(100 * (exp(coef) - 1), 4) END AS percent_effect"""


def shown(coefficients: DataFrame) -> DataFrame:
    out = rounded(rounded(coefficients, "coef", "se", "mean", "sd"), "ci_low", "ci_high", "p", to=5)
    return rounded(out, "percent_effect", to=4)


@query(f"WITH {JOINED}, {ols_sql('x2')} SELECT {COEFFICIENTS} FROM c")
def ols_coefficients(spark, d):
    return shown(linear.ols(joined(spark, d), ["x2"], "y", ["grp"], "m", log1p=True)[0])


@query(f"""WITH {JOINED}, {ols_sql('x2')} SELECT grp, m, round(v, 6) AS observed, round(f, 6) AS fitted, round(e, 6) AS residual, round(h, 6) AS leverage, round(cook, 6) AS cook,
round(st, 5) AS studentized, cook > 4.0 / n AS flag FROM g""")
def ols_diagnostics(spark, d):
    out = linear.ols(joined(spark, d), ["x2"], "y", ["grp"], "m", log1p=True)[1]
    return rounded(rounded(out, "observed", "fitted", "residual", "leverage", "cook"), "studentized", to=5)


@query(f"""WITH {JOINED}, {ols_sql('x2')}, t AS (SELECT grp, m FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY cook DESC, m) = 1)
SELECT grp, max(n) AS n, round(1 - max(mse) / var_samp(v), 6) AS adjusted_r2, round(max(cook), 6) AS max_cook, max(t.m) AS max_cook_at, count(*) FILTER (WHERE cook > 4.0 / n) AS flags
FROM g JOIN t USING (grp) GROUP BY grp""")
def ols_summary(spark, d):
    return rounded(linear.ols(joined(spark, d), ["x2"], "y", ["grp"], "m", log1p=True)[2], "adjusted_r2", "max_cook")


@query(f"""
WITH {JOINED}, {ols_sql('x2')}, t AS (SELECT grp, m FROM g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY cook DESC, m) = 1),
less AS (SELECT j.* FROM joined j ANTI JOIN t ON t.grp = j.grp AND t.m = j.m), {ols_sql('x2', 'less', 'r_')}
SELECT c.grp, c.term, t.m AS omitted, c.n AS full_n, r.n AS refit_n, round(c.coef, 6) AS full_coef, round(r.coef, 6) AS refit_coef,
       round(c.coef - {t_quantile_sql("(c.n - 2)")} * c.se, 5) AS full_low, round(c.coef + {t_quantile_sql("(c.n - 2)")} * c.se, 5) AS full_high,
       round(r.coef - {t_quantile_sql("(r.n - 2)")} * r.se, 5) AS refit_low, round(r.coef + {t_quantile_sql("(r.n - 2)")} * r.se, 5) AS refit_high,
       round(abs(r.coef - c.coef), 6) AS change, sign(r.coef) <> sign(c.coef) AS sign_changed
FROM c JOIN r_c r USING (grp, term) JOIN t USING (grp) WHERE term <> 'const'""")
def ols_influence_refit(spark, d):
    out = linear.influence_refit(joined(spark, d), ["x2"], "y", ["grp"], "m", log1p=True)
    return rounded(rounded(out, "full_coef", "refit_coef", "change"), "full_low", "full_high", "refit_low", "refit_high", to=5)


@query(f"""WITH {JOINED}, {ols_sql('x1', p='a_')}, {ols_sql('x2', p='b_')}
SELECT 'first' AS model, {COEFFICIENTS} FROM a_c UNION ALL SELECT 'second', {COEFFICIENTS} FROM b_c""")
def all_coefficients(spark, d):
    rows = joined(spark, d)
    parts = [linear.ols(rows, [x], "y", ["grp"], "m", log1p=True)[0].withColumn("model", F.lit(name)) for name, x in (("first", "x1"), ("second", "x2"))]
    return shown(parts[0].unionByName(parts[1]))


@query(f"""
WITH {JOINED}, {ols_sql('x2')}, s2 AS (SELECT *, e - lag(e) OVER (PARTITION BY grp ORDER BY m) AS step FROM g),
v2 AS (SELECT grp, 1 / (1 - ({corr("x1", "x2")}) ** 2) AS vif FROM joined GROUP BY grp)
SELECT grp, max(n) AS n, round(sum(step * step) / sum(e * e), 6) AS durbin_watson, round(max(h), 6) AS max_leverage, round(max(cook), 6) AS max_cook, round(max(vif), 6) AS max_vif FROM s2 JOIN v2 USING (grp) GROUP BY grp""")
def model_diagnostics(spark, d):
    rows = joined(spark, d)
    diagnostics = linear.ols(rows, ["x2"], "y", ["grp"], "m", log1p=True)[1]
    cells = diagnostics.groupBy("grp").agg(F.count("*").alias("n"), F.max("leverage").alias("max_leverage"), F.max("cook").alias("max_cook"))
    vif = linear.vif(rows, ["x1", "x2"], ["grp"]).groupBy("grp").agg(F.max("vif").alias("max_vif"))
    out = timeseries.durbin_watson(diagnostics, "residual", ["grp"], ["m"]).join(cells, "grp").join(vif, "grp")
    return rounded(out, "durbin_watson", "max_leverage", "max_cook", "max_vif")


RIDGE_TWO = f"""{JOINED}, rs AS (
  SELECT grp, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(ln(1 + y)) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
         covar_pop(x1, x2) AS c12, covar_pop(x1, ln(1 + y)) AS c1, covar_pop(x2, ln(1 + y)) AS c2 FROM joined GROUP BY grp),
rg AS (SELECT *, n + 10.0 AS d, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS t1, n * c2 / s2 AS t2 FROM rs),
rb AS (SELECT *, (d * t1 - o * t2) / (d * d - o * o) AS b1, (d * t2 - o * t1) / (d * d - o * o) AS b2, 1 / (1 - (c12 / (s1 * s2)) ** 2) AS vif FROM rg),
rl AS (SELECT grp, 'x1' AS term, b1 AS coef, m1 AS mean, s1 AS sd, vif FROM rb UNION ALL SELECT grp, 'x2', b2, m2, s2, vif FROM rb)"""


def ridge_table(spark: SparkSession, d: str) -> DataFrame:
    rows = joined(spark, d).withColumn("ly", F.log1p("y"))
    return linear.coefficient_table(rows, ["x1", "x2"], "ly", ["grp"], 10.0)


@query(f"WITH {RIDGE_TWO} SELECT grp, term, round(coef, 6) AS coef, round(exp(coef), 6) AS multiplicative, round(mean, 6) AS mean, round(sd, 6) AS sd, round(vif, 6) AS vif FROM rl")
def coefficient_table(spark, d):
    return rounded(ridge_table(spark, d), "coef", "multiplicative", "mean", "sd", "vif")


@query(f"WITH {RIDGE_TWO} SELECT grp, term, round(coef, 6) AS coef FROM rl QUALIFY row_number() OVER (PARTITION BY grp ORDER BY abs(coef) DESC, term) = 1")
def largest_coefficient(spark, d):
    sized = ridge_table(spark, d).withColumn("size", F.abs("coef"))
    return rounded(timeseries.first_maximum(sized, "size", ["grp"], ["term"]).select("grp", "term", "coef"), "coef")


@query(f"""
WITH {JOINED}, {POSITIONED}, s AS (SELECT p.grp, k.rep, {index_sql("k.rep", "p.pos", 41, "p.n")} AS at FROM pos p, (SELECT unnest(range(0, 200)) AS rep) k),
b AS (SELECT s.grp, s.rep, p.x1, p.y FROM s JOIN pos p ON p.grp = s.grp AND p.pos = s.at), r AS ({ranks("grp, rep", "x1", "y", "b")}),
c1 AS (SELECT grp, rep, {corr("rx", "ry")} AS rho FROM r GROUP BY ALL),
ci AS (SELECT grp, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM c1 GROUP BY grp),
r1 AS ({ranks("grp", "x1", "y", "joined", ", m")}), p1 AS (SELECT grp, rx, ry, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS pos FROM r1),
o1 AS (SELECT grp, count(*) AS n, {corr("rx", "ry")} AS rho FROM p1 GROUP BY grp),
h AS (SELECT p1.grp, k.rep, p1.rx, row_number() OVER (PARTITION BY p1.grp, k.rep ORDER BY {index_sql("k.rep", "p1.pos", 43, "2147483647")}, p1.pos) - 1 AS at FROM p1, (SELECT unnest(range(0, 200)) AS rep) k),
c2 AS (SELECT h.grp, h.rep, {corr("h.rx", "p1.ry")} AS rho FROM h JOIN p1 ON p1.grp = h.grp AND p1.pos = h.at GROUP BY ALL),
pp AS (SELECT c2.grp, (count(*) FILTER (WHERE abs(c2.rho) >= abs(o1.rho) - 1e-12) + 1) / 201.0 AS p FROM c2 JOIN o1 USING (grp) GROUP BY c2.grp),
{ols_sql('x1', p='f_')},
k AS (SELECT pp.*, row_number() OVER (ORDER BY p, grp) AS k, count(*) OVER () AS tests FROM pp),
hm AS (SELECT grp, p, least(max((tests - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS holm FROM k)
SELECT grp, o1.n, round(o1.rho, 6) AS rho, CASE WHEN o1.rho > 0 THEN 'positive' WHEN o1.rho < 0 THEN 'negative' ELSE 'zero' END AS direction, round(low, 6) AS low, round(high, 6) AS high,
       round(hm.p, 6)::DOUBLE AS p, round(holm, 6)::DOUBLE AS holm, holm < 0.05 AS passed, round(f_c.coef, 6) AS beta, round(100 * (exp(f_c.coef) - 1), 4) AS percent_effect
FROM o1 JOIN ci USING (grp) JOIN hm USING (grp) JOIN f_c USING (grp) WHERE f_c.term = 'x1'""")
def association_bundle(spark, d):
    """Rank correlation, bootstrap interval, permutation p with Holm's correction, and the slope of a log-linear fit."""
    return associations(spark, d, 200, 200)


@query()
def association_bundle_full(spark, d):
    """The same at the published counts: 10,000 bootstrap samples and 100,000 permutations of each series."""
    return associations(spark, d, 10_000, 100_000)


def associations(spark: SparkSession, d: str, samples: int, permutations: int) -> DataFrame:
    rows = joined(spark, d)
    interval = resample.bootstrap_rho(rows, "x1", "y", ["grp"], ["m"], samples, 41).drop("reps")
    tested = rankstats.holm(resample.permutation_p(rows, "x1", "y", ["grp"], ["m"], permutations, 43), "p", [], ["grp"])
    slope = linear.ols(rows, ["x1"], "y", ["grp"], "m", log1p=True)[0].where("term = 'x1'").select("grp", "n", F.col("coef").alias("beta"), "percent_effect")
    direction = F.when(F.col("rho") > 0, "positive").when(F.col("rho") < 0, "negative").otherwise("zero")
    out = tested.join(interval, "grp").join(slope, "grp").withColumn("direction", direction)
    return rounded(rounded(out, "rho", "low", "high", "p", "holm", "beta"), "percent_effect", to=4).select("grp", "n", "rho", "direction", "low", "high", "p", "holm", "passed", "beta", "percent_effect")


def influence_sql(source: str, p: str = "") -> str:
    """CTEs of a ridge fit (alpha 10) of ln(1 + y) on x2, with its diagnostics ({p}id)."""
    return f"""{p}i0 AS (SELECT grp, m, ln(1 + y) AS v, x2 AS x FROM {source}),
{p}i1 AS (SELECT grp, count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(v) AS mv, count(*) * covar_pop(x, v) / stddev_pop(x) / (count(*) + 10.0) AS b FROM {p}i0 GROUP BY grp),
{p}i2 AS (SELECT grp, m, n, v, b, mv + b * (x - mx) / sx AS f, v - mv - b * (x - mx) / sx AS e, 1.0 / n + ((x - mx) / sx) ** 2 / (n + 10.0) AS h FROM {p}i0 JOIN {p}i1 USING (grp)),
{p}i3 AS (SELECT grp, sum(e * e) / (max(n) - 2) AS mse FROM {p}i2 GROUP BY grp), {p}id AS (SELECT {p}i2.*, e * e * h / (2 * mse * (1 - h) ** 2) AS cook FROM {p}i2 JOIN {p}i3 USING (grp))"""


@query(f"WITH {JOINED}, {influence_sql('joined')} SELECT grp, m, round(v, 6) AS observed, round(f, 6) AS fitted, round(e, 6) AS residual, round(h, 6) AS leverage, round(cook, 6) AS cook FROM id")
def ridge_diagnostics_one(spark, d):
    return rounded(models.ridge_influence(joined(spark, d), ["x2"], "y", ["grp"], "m", 10.0, log1p=True)[0], "observed", "fitted", "residual", "leverage", "cook")


@query(f"""
WITH {JOINED}, {influence_sql('joined')}, t AS (SELECT grp, m FROM id QUALIFY row_number() OVER (PARTITION BY grp ORDER BY cook DESC, m) = 1),
less AS (SELECT j.* FROM joined j ANTI JOIN t ON t.grp = j.grp AND t.m = j.m), {influence_sql('less', 'r_')}
SELECT i1.grp, 'x2' AS term, t.m AS omitted, round(i1.b, 6) AS full_coef, round(r_i1.b, 6) AS refit_coef, round(abs(r_i1.b - i1.b), 6) AS change, sign(i1.b) <> sign(r_i1.b) AS sign_changed
FROM i1 JOIN r_i1 USING (grp) JOIN t USING (grp)""")
def ridge_refit_one(spark, d):
    out = models.ridge_influence(joined(spark, d), ["x2"], "y", ["grp"], "m", 10.0, log1p=True)[2]
    return rounded(out, "full_coef", "refit_coef", "change").select("grp", "term", "omitted", "full_coef", "refit_coef", "change", "sign_changed")


@query()
def ridge_influence_summary(spark, d):
    """Three predictors: durbin_watson, Shapiro-Wilk of the residuals, the most influential row, inflation."""
    return models.ridge_influence(joined(spark, d), ["x1", "x2", "x3"], "y", ["grp"], "m", 10.0, log1p=True)[1]


# -- hypotheses


@query(f"""
WITH {JOINED}, {POSITIONED}, s AS (SELECT p.grp, k.rep, {index_sql("k.rep", "p.pos", 62, "p.n")} AS at FROM pos p, (SELECT unnest(range(0, 200)) AS rep) k),
b AS (SELECT s.grp, s.rep, p.x1, p.y FROM s JOIN pos p ON p.grp = s.grp AND p.pos = s.at), r AS ({ranks("grp, rep", "x1", "y", "b")}),
ci AS (SELECT grp, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM (SELECT grp, rep, {corr("rx", "ry")} AS rho FROM r GROUP BY ALL) GROUP BY grp),
r1 AS ({ranks("grp", "x1", "y", "joined", ", m")}), p1 AS (SELECT grp, rx, ry, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS pos FROM r1),
o1 AS (SELECT grp, {corr("rx", "ry")} AS rho FROM p1 GROUP BY grp), r3 AS ({ranks("grp", "x3", "y", "joined")}), o3 AS (SELECT grp, {corr("rx", "ry")} AS rho FROM r3 GROUP BY grp),
h AS (SELECT p1.grp, k.rep, p1.rx, row_number() OVER (PARTITION BY p1.grp, k.rep ORDER BY {index_sql("k.rep", "p1.pos", 61, "2147483647")}, p1.pos) - 1 AS at FROM p1, (SELECT unnest(range(0, 200)) AS rep) k),
c2 AS (SELECT h.grp, h.rep, {corr("h.rx", "p1.ry")} AS rho FROM h JOIN p1 ON p1.grp = h.grp AND p1.pos = h.at GROUP BY ALL),
pp AS (SELECT c2.grp, (count(*) FILTER (WHERE abs(c2.rho) >= abs(o1.rho) - 1e-12) + 1) / 201.0 AS p FROM c2 JOIN o1 USING (grp) GROUP BY c2.grp),
k AS (SELECT pp.*, row_number() OVER (ORDER BY p, grp) AS k, count(*) OVER () AS tests FROM pp),
hm AS (SELECT grp, p, least(max((tests - k + 1) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS holm FROM k),
{ols_sql('x1', p='f_')}, t AS (SELECT grp, m FROM f_g QUALIFY row_number() OVER (PARTITION BY grp ORDER BY cook DESC, m) = 1),
less AS (SELECT j.* FROM joined j ANTI JOIN t ON t.grp = j.grp AND t.m = j.m), rl AS ({ranks("grp", "x1", "y", "less")}), ol AS (SELECT grp, {corr("rx", "ry")} AS rho FROM rl GROUP BY grp),
z AS (SELECT grp, o1.rho, low, high, hm.p, holm, holm < 0.9 AS passed, f_c.coef AS beta, o3.rho AS rho_alternative, ol.rho AS rho_without, t.m AS omitted, sign(o1.rho) = 1 AS matched
      FROM o1 JOIN ci USING (grp) JOIN hm USING (grp) JOIN f_c USING (grp) JOIN o3 USING (grp) JOIN ol USING (grp) JOIN t USING (grp) WHERE f_c.term = 'x1')
SELECT grp, round(rho, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high, round(p, 6)::DOUBLE AS p, round(holm, 6)::DOUBLE AS holm, passed, round(beta, 6) AS beta, round(rho_alternative, 6) AS rho_alternative,
       round(rho_without, 6) AS rho_without, omitted, matched, CASE WHEN matched AND passed AND sign(rho_alternative) = sign(rho) AND sign(rho_without) = sign(rho) THEN 'supported' ELSE 'not supported' END AS status,
       CASE WHEN matched AND passed THEN 'supported' ELSE 'not supported' END AS mechanism_status FROM z""")
def hypothesis_family(spark, d):
    """Status of a family of hypotheses from Holm's p, an alternative predictor and the most influential row (a generous level, for these tables)."""
    out = hypotheses.hypothesis_status(joined(spark, d), "x1", "y", ["grp"], "m", 1, "x3", 200, 200, 61, level=0.9)
    names = ["rho", "low", "high", "p", "holm", "beta", "rho_alternative", "rho_without"]
    return rounded(out, *names).select("grp", *names[:5], "passed", *names[5:], "omitted", "matched", "status", "mechanism_status")


# -- rolling validation


def rolling_sql(source: str, x: str, name: str, by: str = "grp") -> str:
    """SQL of the rolling-origin predictions of ln(1 + y) on one predictor."""
    return f"""SELECT {by}, m, y, {name} AS model, greatest(exp((sy - b * sx) / k + b * x) - 1, 0) AS p FROM (
    SELECT *, (k * sxy - sx * sy) / nullif(k * sxx - sx * sx, 0) AS b FROM (
      SELECT {by}, m, y, {x} AS x, count(*) OVER w AS k, sum({x}) OVER w AS sx, sum(ln(1 + y)) OVER w AS sy, sum({x} * {x}) OVER w AS sxx, sum({x} * ln(1 + y)) OVER w AS sxy
      FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE k >= 12)"""


SCORES = "count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, 1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) AS r2"


def nested_sql(x: str, name: str) -> str:
    """SQL of the rolling-origin predictions of a ridge on one predictor whose alpha the last six predictions choose."""
    return f"""SELECT grp, m, y, {name} AS model, a AS alpha, p FROM (SELECT *, avg(abs(p - y)) OVER (PARTITION BY grp, a ORDER BY m ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS score FROM ({RIDGE_ONE.replace('x1', x)}))
    WHERE k >= 12 QUALIFY row_number() OVER (PARTITION BY grp, m ORDER BY score, a) = 1"""


RIDGE_ONE = """SELECT grp, m, y, a, k, greatest(exp(sy / k + b * (x1 - sx / k)) - 1, 0) AS p FROM (
  SELECT *, CASE WHEN sxx / k - (sx / k) ** 2 > 0 THEN (sxy - sx * sy / k) / ((sxx - sx * sx / k) + a * (sxx / k - (sx / k) ** 2)) END AS b FROM (
    SELECT grp, m, y, x1, count(*) OVER w AS k, sum(x1) OVER w AS sx, sum(ln(1 + y)) OVER w AS sy, sum(x1 * x1) OVER w AS sxx, sum(x1 * ln(1 + y)) OVER w AS sxy
    FROM joined WINDOW w AS (PARTITION BY grp ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), (SELECT unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS a) WHERE k >= 6)"""
ALPHAS = [0.1, 1.0, 10.0, 100.0]
MODELS = {"log_x1": (["x1"], [0.0]), "log_x2": (["x2"], [0.0]), "log_x3": (["x3"], [0.0]), "ridge_x1": (["x1"], ALPHAS), "ridge_x2": (["x2"], ALPHAS)}
WIDE_MODELS = {"two_ols": (["x1", "x2"], [0.0]), "other_two_ols": (["x2", "x3"], [0.0]), "three_ols": (["x1", "x2", "x3"], [0.0]), "two_ridge": (["x1", "x3"], ALPHAS), "three_ridge": (["x1", "x2", "x3"], ALPHAS)}
BASE_MODELS = ["expanding_mean", "previous"]


def model_scores(predictions: DataFrame) -> DataFrame:
    """Scores of each group's models, and whether a model beats its group's best baseline on both errors."""
    scored = validation.metrics(predictions, "actual", "predicted", ["grp", "model"])
    gate = validation.baseline_gate(scored, ["grp"], "model", BASE_MODELS).select("grp", "model", "beats")
    return rounded(rounded(scored.join(gate, ["grp", "model"], "left"), "mae", "rmse", to=2), "r2", to=5).select("grp", "model", "n", "mae", "rmse", "r2", "beats")


@query(f"""
WITH {JOINED}, f AS (SELECT grp, m, y, avg(y) OVER w AS expanding, lag(y) OVER (PARTITION BY grp ORDER BY m) AS previous, row_number() OVER (PARTITION BY grp ORDER BY m) AS k
  FROM joined WINDOW w AS (PARTITION BY grp ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS ({rolling_sql("joined", "x1", "'log_x1'")} UNION ALL {rolling_sql("joined", "x2", "'log_x2'")} UNION ALL {rolling_sql("joined", "x3", "'log_x3'")}
      UNION ALL SELECT grp, m, y, model, p FROM ({nested_sql("x1", "'ridge_x1'")}) UNION ALL SELECT grp, m, y, model, p FROM ({nested_sql("x2", "'ridge_x2'")})
      UNION ALL SELECT grp, m, y, 'expanding_mean', expanding FROM f WHERE k > 12 UNION ALL SELECT grp, m, y, 'previous', previous FROM f WHERE k > 12),
s AS (SELECT grp, model, {SCORES} FROM l GROUP BY ALL), b AS (SELECT grp, min(mae) AS bm, min(rmse) AS br FROM s WHERE model IN ('expanding_mean', 'previous') GROUP BY grp)
SELECT grp, model, n, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(r2, 5) AS r2, CASE WHEN model NOT IN ('expanding_mean', 'previous') THEN mae < bm AND rmse < br END AS beats FROM s JOIN b USING (grp)""")
def rolling_models(spark, d):
    """Seven rolling-origin models in one window pass, scored."""
    return model_scores(models.model_table(joined(spark, d), MODELS, "y", ["grp"], "m"))


@query()
def rolling_models_wide(spark, d):
    """The same with several predictors a model (least squares and ridge)."""
    return model_scores(models.model_table(joined(spark, d), WIDE_MODELS, "y", ["grp"], "m"))


@query(f"""
WITH {LAGGED}, one AS (SELECT * FROM lagged WHERE variable = 'x1'), l AS ({rolling_sql("one", "x", "'log_x1'", "grp, lag")})
SELECT grp, lag, lag = 1 AS is_primary, count(*) AS n, round(avg(abs(p - y)), 2) AS mae, round(sqrt(avg((p - y) ** 2)), 2) AS rmse FROM l GROUP BY ALL""")
def rolling_by_lag(spark, d):
    one = lagged(spark, d).where("variable = 'x1'")
    fits = linear.rolling_ridge(one, ["x"], "y", ["grp", "lag"], "m", [0.0], least=12)
    out = validation.metrics(fits, "actual", "predicted", ["grp", "lag"]).withColumn("is_primary", F.col("lag") == 1)
    return rounded(out, "mae", "rmse", to=2).select("grp", "lag", "is_primary", "n", "mae", "rmse")


@query(f"""
WITH {JOINED}, t AS ({RIDGE_ONE}), s AS (SELECT *, avg(abs(p - y)) OVER (PARTITION BY grp, a ORDER BY m ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS score FROM t)
SELECT grp, m, floor(y) AS actual, round(p, 2) AS predicted, a AS alpha FROM s WHERE k >= 12 QUALIFY row_number() OVER (PARTITION BY grp, m ORDER BY score, a) = 1""")
def nested_ridge_one(spark, d):
    out = linear.nested_ridge(joined(spark, d), ["x1"], "y", ["grp"], "m", [0.1, 1.0, 10.0, 100.0])
    return rounded(out, "predicted", to=2).withColumn("actual", F.floor("actual").cast("double"))


@query(f"""
WITH {JOINED}, r AS (SELECT *, (m - 1) // 12 AS yr FROM joined),
y1 AS (SELECT yr, count(*) AS n, sum(x1) AS sx, sum(y) AS sy, sum(x1 * x1) AS sxx, sum(x1 * y) AS sxy FROM r GROUP BY yr),
f AS (SELECT yr, sum(n) OVER () - n AS n, sum(sx) OVER () - sx AS sx, sum(sy) OVER () - sy AS sy, sum(sxx) OVER () - sxx AS sxx, sum(sxy) OVER () - sxy AS sxy FROM y1),
b AS (SELECT f.*, a, (sxy - sx * sy / n) / ((sxx - sx * sx / n) + a * (sxx / n - (sx / n) ** 2)) AS b FROM f, (SELECT unnest([0.1, 1.0, 10.0, 100.0]::DOUBLE[]) AS a)),
e AS (SELECT a, b.sy / b.n + b.b * (r.x1 - b.sx / b.n) - y AS e, y FROM r JOIN b USING (yr)),
s AS (SELECT a AS alpha, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY a)
SELECT alpha, round(rmse, 3) AS rmse, round(mae, 3) AS mae, round(r2, 6) AS r2, row_number() OVER (ORDER BY rmse, alpha DESC) = 1 AS best FROM s""")
def leave_group_out_ridge_one(spark, d):
    rows = joined(spark, d).withColumn("yr", F.floor((F.col("m") - 1) / 12).cast("long"))
    out = linear.leave_group_out_ridge(rows, ["x1"], "y", "yr", [0.1, 1.0, 10.0, 100.0])
    return rounded(rounded(out, "rmse", "mae", to=3), "r2")


def held_out_sql(rows: str, by: str, fold: str, x: str, y: str, alphas: list[float]) -> str:
    """CTEs of ridge fits on one predictor to all folds but each (ho_h: the rows, a, p) and of the best alpha (ho_c) and its full fit (ho_f)."""
    sums = f"count(*) AS k, sum({x}) AS sx, sum({y}) AS sy, sum({x} * {x}) AS sxx, sum({x} * {y}) AS sxy"
    slope = "(sxy - sx * sy / k) / ((sxx - sx * sx / k) + a * (sxx / k - (sx / k) ** 2))"
    return f"""ho_g AS (SELECT {by}, {fold}, {sums} FROM {rows} GROUP BY ALL),
ho_o AS (SELECT {by}, {fold}, {", ".join(f"sum({c}) OVER (PARTITION BY {by}) - {c} AS {c}" for c in ("k", "sx", "sy", "sxx", "sxy"))} FROM ho_g),
ho_a AS (SELECT unnest({alphas}::DOUBLE[]) AS a),
ho_b AS (SELECT *, {slope} AS b FROM ho_o, ho_a), ho_h AS (SELECT r.*, a, b.sy / b.k + b.b * (r.{x} - b.sx / b.k) AS p FROM {rows} r JOIN ho_b b USING ({by}, {fold})),
ho_c AS (SELECT {by}, a FROM (SELECT {by}, a, sqrt(avg((p - {y}) ** 2)) AS rmse FROM ho_h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY rmse, a DESC) = 1),
ho_f AS (SELECT *, {slope} AS b FROM (SELECT {by}, {sums} FROM {rows} GROUP BY {by}) JOIN ho_c USING ({by}))"""


@query(f"""
WITH {JOINED}, r AS (SELECT *, (m - 1) // 12 AS yr FROM joined), {held_out_sql("r", "grp", "yr", "x1", "y", [0.1, 1.0, 10.0, 100.0])}
SELECT grp, m, a AS alpha, round(p, 3) AS held_out FROM ho_h""")
def held_out_ridge_one(spark, d):
    rows = joined(spark, d).withColumn("yr", F.floor((F.col("m") - 1) / 12).cast("long"))
    return rounded(models.held_out(rows, ["x1"], "y", "yr", ALPHAS, ["grp"]), "held_out", to=3).select("grp", "m", "alpha", "held_out")


@query(f"""
WITH {BASELINES}, q AS (SELECT model, y - p AS e, row_number() OVER (PARTITION BY model ORDER BY grp, m) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM l),
sm AS (SELECT q.model, k.rep, {index_sql("k.rep", "q.pos", 37, "q.n")} AS at FROM q, (SELECT unnest(range(0, 200)) AS rep) k),
b AS (SELECT sm.model, sm.rep, avg(abs(q.e)) AS mae, sqrt(avg(q.e * q.e)) AS rmse FROM sm JOIN q ON q.model = sm.model AND q.pos = sm.at GROUP BY ALL)
SELECT model, count(*) AS reps, round(quantile_cont(mae, 0.025), 3) AS mae_low, round(quantile_cont(mae, 0.975), 3) AS mae_high,
       round(quantile_cont(rmse, 0.025), 3) AS rmse_low, round(quantile_cont(rmse, 0.975), 3) AS rmse_high FROM b GROUP BY model""")
def error_bootstrap_both(spark, d):
    errors = forecasts(spark, d).select("model", "grp", "m", (F.col("y") - F.col("p")).alias("e"))
    each = resample.bootstrap_errors(errors, "e", ["model"], ["grp", "m"], 200, 37)
    mae, rmse = (resample.interval(each, c, ["model"]).select("model", "reps", F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high")) for c in ("mae", "rmse"))
    return rounded(mae.join(rmse.drop("reps"), "model"), "mae_low", "mae_high", "rmse_low", "rmse_high", to=3)


@query(f"""
WITH {BASELINES} SELECT grp, count(*) AS rows, round(avg(p), 3) AS middle_mean, round(max(p), 3) AS middle_max
FROM (SELECT grp, m, median(p) AS p FROM l GROUP BY ALL) GROUP BY grp""")
def ensemble_medians(spark, d):
    middle = forecasts(spark, d).groupBy("grp", "m").agg(F.median("p").alias("p"))
    return rounded(middle.groupBy("grp").agg(F.count("*").alias("rows"), F.avg("p").alias("middle_mean"), F.max("p").alias("middle_max")), "middle_mean", "middle_max", to=3)


TWO_SUMS = "count(*) AS k, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y"


@query(f"""
WITH {JOINED}, r AS (SELECT *, (m - 1) // 12 AS yr FROM joined), g AS (SELECT grp, yr, {TWO_SUMS} FROM r GROUP BY ALL),
o AS (SELECT grp, yr, {", ".join(f"sum({c}) OVER (PARTITION BY grp) - {c} AS {c}" for c in ("k", "s1", "s2", "sy", "s11", "s22", "s12", "s1y", "s2y"))} FROM g),
c AS (SELECT *, s11 - s1 * s1 / k AS c11, s22 - s2 * s2 / k AS c22, s12 - s1 * s2 / k AS c12, s1y - s1 * sy / k AS c1y, s2y - s2 * sy / k AS c2y FROM o),
e AS (SELECT *, c11 * (1 + 10.0 / k) AS d1, c22 * (1 + 10.0 / k) AS d2 FROM c),
b AS (SELECT *, (d2 * c1y - c12 * c2y) / (d1 * d2 - c12 * c12) AS b1, (d1 * c2y - c12 * c1y) / (d1 * d2 - c12 * c12) AS b2, c1y / d1 AS b0 FROM e),
h AS (SELECT grp, y, sy / k + b1 * (x1 - s1 / k) + b2 * (x2 - s2 / k) AS p2, sy / k + b0 * (x1 - s1 / k) AS p1 FROM r JOIN b USING (grp, yr)),
l AS (SELECT grp, 'full' AS model, y, p2 AS p FROM h UNION ALL SELECT grp, 'subset', y, p1 FROM h)
SELECT grp, model, count(*) AS n, round(sqrt(avg((p - y) ** 2)), 3) AS rmse, round(avg(abs(p - y)), 3) AS mae, round(avg(p - y), 3) AS bias FROM l GROUP BY ALL""")
def feature_subsets(spark, d):
    """A model and one on a subset of its features: the same folds, alpha and errors."""
    rows = joined(spark, d).withColumn("yr", F.floor((F.col("m") - 1) / 12).cast("long"))
    parts = [models.held_out(rows, features, "y", "yr", [10.0], ["grp"]).withColumn("model", F.lit(name)) for name, features in (("full", ["x1", "x2"]), ("subset", ["x1"]))]
    scored = validation.metrics(parts[0].unionByName(parts[1]), "y", "held_out", ["grp", "model"])
    return rounded(scored, "rmse", "mae", "bias", to=3).select("grp", "model", "n", "rmse", "mae", "bias")


@query(f"""
WITH w(window_id, start_md, end_md) AS (VALUES {WINDOWS_SQL}),
o AS (SELECT 1 AS one, CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mo, month(o_orderdate) * 100 + day(o_orderdate) AS md,
             cos((dayofyear(o_orderdate) - 1) * 2 * pi() / 365.2425) AS x, o_totalprice AS v FROM orders),
c AS (SELECT yr, mo, sum(v) AS s, count(v) AS n FROM o GROUP BY ALL),
k AS (SELECT yr, mo, coalesce((sum(s) OVER (PARTITION BY mo) - s) / nullif(sum(n) OVER (PARTITION BY mo) - n, 0),
                (sum(s) OVER () - sum(s) OVER (PARTITION BY yr)) / nullif(sum(n) OVER () - sum(n) OVER (PARTITION BY yr), 0)) AS seasonal FROM c),
{held_out_sql("o", "one", "yr", "x", "v", [10.0])},
i AS (SELECT window_id, h.*, seasonal FROM ho_h h JOIN k USING (yr, mo) JOIN w ON md BETWEEN start_md AND end_md),
s AS (SELECT window_id, count(*) AS n, count(DISTINCT yr) AS years, sqrt(avg((p - v) ** 2)) AS rmse, avg(abs(p - v)) AS mae, avg(p - v) AS bias, sqrt(avg((seasonal - v) ** 2)) AS base FROM i GROUP BY window_id)
SELECT window_id, n, years, round(rmse, 2) AS rmse, round(mae, 2) AS mae, round(bias, 2) AS bias, round(base, 2) AS baseline_rmse, round(100 * (base - rmse) / base, 4) AS improvement_pct FROM s""")
def window_validation(spark, d):
    """A model's held-out predictions within each window of the year against the held-out climatology."""
    cells = [F.year("o_orderdate").cast("long").alias("yr"), F.month("o_orderdate").cast("long").alias("mo"), month_day(F.col("o_orderdate")).alias("md"), harmonics(F.col("o_orderdate"), 1)[1].alias("x"), F.col("o_totalprice").alias("v")]
    rows = table(spark, d, "orders").select(*cells)
    predicted = models.held_out(rows, ["x"], "v", "yr", [10.0])
    both = validation.leave_group_out_mean(predicted, "v", "yr", "mo")
    inside = relational.window_members(both, windows(spark), F.col("md"))
    own = validation.metrics(inside, "v", "held_out", ["window_id"]).select("window_id", "n", "rmse", "mae", "bias")
    base = validation.metrics(inside, "v", "climatology", ["window_id"]).select("window_id", F.col("rmse").alias("baseline_rmse"))
    years = inside.groupBy("window_id").agg(F.count_distinct("yr").alias("years"))
    out = own.join(base, "window_id").join(years, "window_id").withColumn("improvement_pct", validation.improvement("rmse", "baseline_rmse"))
    return rounded(rounded(out, "rmse", "mae", "bias", "baseline_rmse", to=2), "improvement_pct", to=4)


# -- daily products


@query(f"""
WITH {DAILY}, r AS (SELECT event_type, d, v, day(d) % 5 AS fold, n::DOUBLE AS x FROM daily), {held_out_sql("r", "event_type", "fold", "x", "v", [0.1, 1.0, 10.0, 100.0])},
e AS (SELECT event_type, quantile_cont(v - p, 0.025) AS lo, quantile_cont(v - p, 0.975) AS hi FROM ho_h JOIN ho_c USING (event_type, a) GROUP BY event_type),
q AS (SELECT event_type, d, a, sy / k + b * (x - sx / k) AS raw, least(greatest(sy / k + b * (x - sx / k), 47.0), 53.0) AS p, lo, hi FROM r JOIN ho_f USING (event_type) JOIN e USING (event_type))
SELECT event_type, d, a AS alpha, round(p, 5) AS predicted, abs(raw - p) > 1e-12 AS clipped, round(least(greatest(p + lo, 47.0), 53.0), 5) AS lower, round(least(greatest(p + hi, 47.0), 53.0), 5) AS upper FROM q""")
def daily_prediction(spark, d):
    """Predictions within physical bounds, their band from the errors of held-out days."""
    rows = daily(spark, d).withColumn("x", F.col("n").cast("double")).withColumn("fold", F.dayofmonth("d") % 5).drop("n")
    fits = models.banded_predictions(rows, ["x"], "v", "fold", ALPHAS, ["event_type"])
    out = validation.banded(fits, F.col("raw"), F.col("lo"), F.col("hi"), 47.0, 53.0)
    return rounded(out, "predicted", "lower", "upper", to=5).select("event_type", "d", "alpha", "predicted", "clipped", "lower", "upper")


@query(f"""
WITH {DAILY}, r AS (
  SELECT event_type, d, v, round(avg(v) OVER w, 6) AS mean7, row_number() OVER (PARTITION BY event_type ORDER BY d) AS k FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS 6 PRECEDING)),
o AS (SELECT *, CAST(month(d) AS BIGINT) AS mo FROM r WHERE k >= 7), t AS (SELECT event_type, mo, d, mean7 FROM o QUALIFY row_number() OVER (PARTITION BY event_type, mo ORDER BY mean7 DESC, d) = 1)
SELECT o.event_type, o.mo, count(*) AS days, round(avg(v), 5) AS mean, round(max(v), 5) AS high, max(t.mean7) AS high7, max(t.d) AS high7_day FROM o JOIN t USING (event_type, mo) GROUP BY ALL""")
def period_summary(spark, d):
    """Rolling means are taken before the output range is cut, so its first days have a full week behind them."""
    own = Window.partitionBy("event_type").orderBy("d")
    rolled = daily(spark, d).select("event_type", "d", "v", r6(timeseries.trailing_mean("v", 7, ["event_type"], ["d"])).alias("mean7"), F.row_number().over(own).alias("k"))
    rows = rolled.where("k >= 7").withColumn("mo", F.month("d").cast("long"))
    key = ["event_type", "mo"]
    top = timeseries.first_maximum(rows, "mean7", key, ["d"]).select(*key, F.col("mean7").alias("high7"), F.col("d").alias("high7_day"))
    cells = rows.groupBy(*key).agg(F.count("*").alias("days"), F.round(F.avg("v"), 5).alias("mean"), F.round(F.max("v"), 5).alias("high"))
    return cells.join(top, key)


@query(f"""
WITH {DAILY}, a AS (SELECT event_type, d, avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t1 FROM daily),
b AS (SELECT event_type, d, lag(v) OVER (PARTITION BY event_type ORDER BY d) AS t2 FROM daily)
SELECT event_type, d, round(t1, 5) AS t1, round(t2, 5) AS t2, round(t2 - t1, 5) AS difference FROM a JOIN b USING (event_type, d) WHERE t1 IS NOT NULL AND t2 IS NOT NULL""")
def day_difference(spark, d):
    rows = daily(spark, d)
    first = rows.select("event_type", "d", timeseries.expanding_mean("v", ["event_type"], ["d"]).alias("t1"))
    second = rows.select("event_type", "d", timeseries.previous("v", ["event_type"], ["d"]).alias("t2"))
    both = relational.once(first, ["event_type", "d"]).join(relational.once(second, ["event_type", "d"]), ["event_type", "d"]).dropna(subset=["t1", "t2"])
    return rounded(both.withColumn("difference", F.col("t2") - F.col("t1")), "t1", "t2", "difference", to=5)


@query(f"""
WITH {ENV}, c AS (SELECT min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2, min(x3) a3, max(x3) b3 FROM env WHERE m < 1998 * 12),
f AS (SELECT m, greatest(a1 - x1, x1 - b1) / (b1 - a1) AS f1, greatest(a2 - x2, x2 - b2) / (b2 - a2) AS f2, greatest(a3 - x3, x3 - b3) / (b3 - a3) AS f3 FROM env, c),
g AS (SELECT *, (m - 1) // 12 AS yr, greatest(f1, f2, f3) AS far FROM f), o AS (SELECT * FROM g WHERE far > 0), n AS (SELECT count(*) AS n FROM g), y AS (SELECT yr, count(*) AS n FROM g GROUP BY yr),
k AS (SELECT 'feature' AS kind, 'x1' AS key, count(*) AS n FROM o WHERE f1 > 0 UNION ALL SELECT 'feature', 'x2', count(*) FROM o WHERE f2 > 0 UNION ALL SELECT 'feature', 'x3', count(*) FROM o WHERE f3 > 0
      UNION ALL SELECT 'severity', CASE WHEN far <= 0.05 THEN 'minor' WHEN far <= 0.2 THEN 'moderate' ELSE 'large' END, count(*) FROM o GROUP BY ALL)
SELECT kind, key, k.n, round(100.0 * k.n / n.n, 6)::DOUBLE AS pct FROM k, n WHERE k.n > 0
UNION ALL SELECT 'year', yr::VARCHAR, count(*), round(100.0 * count(*) / max(y.n), 6)::DOUBLE FROM o JOIN y USING (yr) GROUP BY yr""")
def extrapolation_summary(spark, d):
    e = environment(spark, d).withColumn("yr", F.floor((F.col("m") - 1) / 12).cast("long"))
    audit = validation.domain_audit(e, e.where(F.col("m") < 1998 * 12), ["x1", "x2", "x3"], ["m", "yr"])
    return rounded(validation.audit_summary(audit, e, "yr"), "pct")


#: Whole numbers of each day, and the box of the first years.
AUDIT_DAYS = """ad AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) // count(*) AS BIGINT) AS v, count(*) AS c FROM orders GROUP BY ALL),
ab AS (SELECT min(v) AS a1, max(v) AS b1, min(c) AS a2, max(c) AS b2 FROM ad WHERE year(d) < 1996),
af AS (SELECT d, greatest(a1 - v, v - b1)::DOUBLE / (b1 - a1) AS f1, greatest(a2 - c, c - b2)::DOUBLE / nullif(b2 - a2, 0) AS f2 FROM ad, ab),
au AS (SELECT d, strftime(d, '%Y') AS year, strftime(d, '%m-%b') AS month, month(d) * 100 + day(d) AS md, CASE WHEN month(d) BETWEEN 6 AND 10 THEN 'season' ELSE 'rest' END AS season,
  list_filter([CASE WHEN f1 > 0 THEN 'v' END, CASE WHEN f2 > 0 THEN 'c' END], lambda z: z IS NOT NULL) AS names, greatest(f1, f2) AS far FROM af),
al AS (SELECT *, far > 0 AS out, CASE WHEN far <= 0 THEN NULL WHEN far <= 0.05 THEN 'minor' WHEN far <= 0.2 THEN 'moderate' ELSE 'large' END AS severity FROM au)"""
AUDIT_SQL_KEYS = ["feature", "month", "season", "severity", "win", "year"]


def audit_sql() -> str:
    sets = [[k.replace("window", "win") for k in s] for s in validation.AUDIT_SETS]
    each = []
    for s in sets:
        side = "win" if "win" in s else "day"
        number = sum(1 << (len(AUDIT_SQL_KEYS) - 1 - i) for i, k in enumerate(AUDIT_SQL_KEYS) if k not in s)
        named, key, kind = " AND ".join(f"{k} IS NOT NULL" for k in s), " || ' ' || ".join(s), "+".join(s).replace("win", "window")
        own = " AND ".join(f"o.{k} = c.{k}" for k in s if k not in ("feature", "severity")) or "true"
        each.append(f"SELECT '{kind}' AS kind, {key} AS key, {side}_{'f' if 'feature' in s else 'n'} AS n, (SELECT sum({side}_of)::BIGINT FROM c o WHERE o.id = {number} AND {own}) AS \"of\" FROM c WHERE id = {number} AND {named}")
    counts = ", ".join(f"count(*) FILTER (WHERE win IS {'' if w == 'day' else 'NOT '}NULL AND {t}) AS {w}_{n}" for w in ("day", "win") for n, t in (("n", "feature IS NULL AND out"), ("of", "feature IS NULL"), ("f", "feature IS NOT NULL")))
    long = "FROM {} , LATERAL (SELECT unnest(list_prepend(NULL, names)) AS feature) f"
    return f"""WITH w(window_id, start_md, end_md) AS (VALUES {WINDOWS_SQL}), {AUDIT_DAYS},
x AS (SELECT al.*, NULL::VARCHAR AS win, feature {long.format("al")} UNION ALL SELECT al.*, window_id, feature {long.format("al JOIN w ON md BETWEEN start_md AND end_md")}),
c AS (SELECT {", ".join(AUDIT_SQL_KEYS)}, GROUPING({", ".join(AUDIT_SQL_KEYS)}) AS id, {counts} FROM x GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(s) + ")" for s in sets)})),
u AS ({" UNION ALL ".join(each)}) SELECT kind, key, n, "of", round(100.0 * n / "of", 6)::DOUBLE AS pct FROM u WHERE n > 0"""


@query(audit_sql())
def audit_counters(spark, d):
    """Days outside the first year's box by feature, severity, month, year, season and window, and crossed, in one aggregate."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long"))
    days = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.floor(cents / F.count("*")).cast("double").alias("v"), F.count("*").cast("double").alias("c"))
    audit = validation.domain_audit(days, days.where(F.year("d") < 1996), ["v", "c"], ["d"]).select("d", "outside", "severity")
    return rounded(validation.audit_counters(days.select("d").join(audit, "d", "left"), windows(spark)), "pct")


@query(f"""
WITH w(window_id, start_md, end_md) AS (VALUES {WINDOWS_SQL}), {MILLI_DAYS}, r AS (SELECT min(d) AS a, max(d) AS b FROM days),
c AS (SELECT yr, window_id, make_date(yr, start_md // 100, start_md % 100) AS s, make_date(yr, end_md // 100, end_md % 100) AS e FROM w, (SELECT DISTINCT CAST(year(d) AS BIGINT) AS yr FROM days)),
j AS (SELECT c.*, count(d) AS days, sum(v)::BIGINT AS total FROM c LEFT JOIN days ON d BETWEEN s AND e GROUP BY ALL)
SELECT yr, window_id, CAST(datediff('day', s, e) + 1 AS BIGINT) AS expected_days, days, s >= a AND e <= b AS eligible, days = datediff('day', s, e) + 1 AS complete,
       CASE WHEN days > 0 THEN {MILLI_MEAN.format("total", "days")} END AS matched_mean FROM j, r""")
def exposure_eligibility(spark, d):
    """Every year with every window: days expected and there, whether the series covers it, and the matched mean."""
    days = milli_days(spark, d)
    ends = days.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    years = days.select(F.year("d").alias("yr")).distinct()
    grid = years.join(F.broadcast(windows(spark)))  # the declared windows
    at = lambda md: F.make_date("yr", F.expr(f"{md} div 100").cast("int"), F.expr(f"{md} % 100").cast("int"))
    grid = grid.select("yr", "window_id", at("start_md").alias("s"), at("end_md").alias("e"))
    members = grid.withColumn("d", F.explode(F.sequence("s", "e"))).join(days, "d").groupBy("yr", "window_id").agg(F.count("*").alias("days"), F.sum("v").alias("total"))
    full = grid.join(members, ["yr", "window_id"], "left").join(F.broadcast(ends)).withColumn("days", F.coalesce("days", F.lit(0)))  # one row
    expected = (F.datediff("e", "s") + 1).cast("long")
    mean = F.when(F.col("days") > 0, F.floor((F.col("total") * 20 + F.col("days")) / (F.col("days") * 2)).cast("double") / 10000.0)
    return full.select(F.col("yr").cast("long").alias("yr"), "window_id", expected.alias("expected_days"), "days", ((F.col("s") >= F.col("a")) & (F.col("e") <= F.col("b"))).alias("eligible"), (F.col("days") == expected).alias("complete"), mean.alias("matched_mean"))


@query("""
WITH s AS (SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS d FROM events),
e AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'error' AND value > 40 GROUP BY ALL),
b AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, max(value) AS top FROM events WHERE event_type = 'click' AND value > 45 GROUP BY ALL)
SELECT s.d, e.n AS errors_n, b.n AS clicks_n, round(b.top, 4) AS clicks_top FROM s LEFT JOIN e USING (d) LEFT JOIN b USING (d)""")
def sparse_spine(spark, d):
    days = table(spark, d, "events").withColumn("d", F.col("ts").cast("date"))
    errors = days.where("event_type = 'error' AND value > 40").groupBy("d").agg(F.count("*").alias("n"))
    clicks = days.where("event_type = 'click' AND value > 45").groupBy("d").agg(F.count("*").alias("n"), F.round(F.max("value"), 4).alias("top"))
    return relational.onto_spine(timeseries.spine(days, "d"), {"errors": errors, "clicks": clicks}, "d")


# -- scenarios

TWO_FIT = f"""{JOINED}, fs AS (
  SELECT grp, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(ln(1 + y)) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
         covar_pop(x1, x2) AS c12, covar_pop(x1, ln(1 + y)) AS c1, covar_pop(x2, ln(1 + y)) AS c2 FROM joined GROUP BY grp),
fg AS (SELECT *, n::DOUBLE AS d, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS t1, n * c2 / s2 AS t2 FROM fs),
fb AS (SELECT *, (d * t1 - o * t2) / (d * d - o * o) AS b1, (d * t2 - o * t1) / (d * d - o * o) AS b2 FROM fg),
jl AS (SELECT grp, 'x1' AS feature, m, x1 AS v FROM joined UNION ALL SELECT grp, 'x2', m, x2 FROM joined),
sl AS (SELECT a.grp, a.feature, median((b.v - a.v) / (b.m - a.m)) AS slope FROM jl a JOIN jl b ON a.grp = b.grp AND a.feature = b.feature AND a.m < b.m GROUP BY ALL),
lf AS (SELECT grp, feature, regr_slope(v, m) AS b, avg(v) AS mv, avg(m) AS mm FROM jl GROUP BY ALL),
sd AS (SELECT grp, feature, stddev_samp(v - mv - b * (m - mm)) AS sd, arg_max(v, m) AS last FROM jl JOIN lf USING (grp, feature) GROUP BY ALL),
tr AS (SELECT grp, feature, CASE feature WHEN 'x1' THEN 0 ELSE 1 END AS f, last, slope, sd, CASE feature WHEN 'x1' THEN m1 ELSE m2 END AS mean, CASE feature WHEN 'x1' THEN s1 ELSE s2 END AS scale,
              CASE feature WHEN 'x1' THEN b1 ELSE b2 END AS coef, my AS intercept FROM sl JOIN sd USING (grp, feature) JOIN fb USING (grp)),
fe AS (SELECT grp, m, y, avg(y) OVER (PARTITION BY grp ORDER BY m ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS recent, row_number() OVER (PARTITION BY grp ORDER BY m) AS k FROM panel),
er AS (SELECT grp, y - recent AS e, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM fe WHERE k > 12)"""
PATHS = f"""{TWO_FIT}, sc(scenario, number, shift) AS (VALUES ('low', 0, -0.5), ('middle', 1, 0.0), ('high', 2, 0.5)),
gr AS (SELECT tr.*, scenario, number, CAST(shift AS DOUBLE) AS shift, step, rep FROM tr, sc, (SELECT unnest(range(1, 16)) AS step), (SELECT unnest(range(0, 1000)) AS rep)),
pa AS (SELECT grp, scenario, number, step, rep, max(intercept) AS intercept, sum(coef * (last + slope * step + shift * sd + {normal_sql("rep", "step + 100 * f + 10000 * number", 20260727)} * 0.35 * sd - mean) / scale) AS part FROM gr GROUP BY ALL),
va AS (SELECT pa.grp, scenario, step, greatest(exp(intercept + part) - 1 + e, 0) AS v FROM pa JOIN (SELECT grp, max(n) AS n FROM er GROUP BY grp) z USING (grp)
       JOIN er ON er.grp = pa.grp AND er.pos = {index_sql("rep", "step + 10000 * number", 20260728, "z.n")}),
qs AS (SELECT grp, scenario, step, quantile_cont(v, 0.05) AS q05, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.95) AS q95 FROM va GROUP BY ALL)"""


def projected(spark: SparkSession, d: str) -> DataFrame:
    rows = joined(spark, d).withColumn("ly", F.log1p("y"))
    table_ = linear.coefficient_table(rows, ["x1", "x2"], "ly", ["grp"], 0.0).select("grp", F.col("term").alias("feature"), "coef", "mean", F.col("sd").alias("scale"))
    long = rows.unpivot(["grp", "m"], ["x1", "x2"], "feature", "v")
    key = ["grp", "feature"]
    slope = rankstats.theil_sen(long, "m", "v", key).select(*key, "slope")
    spread = rankstats.detrended(long.withColumn("t", F.col("m").cast("double")), ["v"], "t", key).groupBy(*key).agg(detrended_sd("v_r").alias("sd"), F.max_by("v", "m").alias("last"))
    models = rows.groupBy("grp").agg(F.avg("ly").alias("intercept"))
    errors = forecasts(spark, d).where("model = 'recent'").select("grp", "m", (F.col("y") - F.col("p")).alias("e"))
    placed = resample.positioned(errors, ["grp"], ["m"]).select("grp", "pos", "e")
    return resample.scenario_paths(spread.join(slope, key).join(table_, key), models, placed, ["grp"], 15, 1000, {"low": -0.5, "middle": 0.0, "high": 0.5}, 0.35, 20260727)


@query(f"WITH {PATHS} SELECT grp, scenario, CAST(step AS INT) AS step, round(q05, 1) AS q05, round(q50, 1) AS q50, round(q95, 1) AS q95 FROM qs")
def monte_carlo_scenarios(spark, d):
    return rounded(projected(spark, d), "q05", "q50", "q95", to=1)


@query(f"WITH {PATHS} SELECT scenario, CAST(step AS INT) AS step, round(median(q05), 1) AS q05, round(median(q50), 1) AS q50, round(median(q95), 1) AS q95 FROM qs GROUP BY ALL")
def monte_carlo_ensemble(spark, d):
    return projected(spark, d).groupBy("scenario", "step").agg(*[F.round(F.median(c), 1).alias(c) for c in ("q05", "q50", "q95")])


@query(f"""
WITH {JOINED}, {ols_sql('x1', p='a_')}, {ols_sql('x2', p='b_')},
h AS ({rolling_sql("joined", "x1", "'x1'")} UNION ALL {rolling_sql("joined", "x2", "'x2'")}), eq AS (SELECT grp, model, quantile_cont(y - p, 0.025) AS lo, quantile_cont(y - p, 0.975) AS hi FROM h GROUP BY ALL),
m AS (SELECT grp, 'x1' AS model, max(mv) AS a, max(b) AS b, quantile_cont(z, 0.1) AS low, quantile_cont(z, 0.5) AS middle, quantile_cont(z, 0.9) AS high FROM a_g GROUP BY grp
      UNION ALL SELECT grp, 'x2', max(mv), max(b), quantile_cont(z, 0.1), quantile_cont(z, 0.5), quantile_cont(z, 0.9) FROM b_g GROUP BY grp),
l AS (SELECT grp, model, a, b, 'low' AS scenario, low AS z FROM m UNION ALL SELECT grp, model, a, b, 'middle', middle FROM m UNION ALL SELECT grp, model, a, b, 'high', high FROM m),
p AS (SELECT grp, model, scenario, greatest(exp(a + b * z) - 1, 0) AS p, greatest(exp(a + b * z) - 1 + lo, 0) AS lower, greatest(exp(a + b * z) - 1 + hi, 0) AS upper FROM l JOIN eq USING (grp, model))
SELECT grp, scenario, round(median(p), 1) AS projected, round(median(lower), 1) AS lower, round(median(upper), 1) AS upper FROM p GROUP BY ALL""")
def static_scenarios(spark, d):
    """Projections at observed quantiles of a predictor, with bands from held-out errors, and their median over the models."""
    rows, parts = joined(spark, d), []
    for x in ("x1", "x2"):
        coefficients, diagnostics, _ = linear.ols(rows, [x], "y", ["grp"], "m", log1p=True)
        fit = coefficients.groupBy("grp").pivot("term", ["const", x]).agg(F.first("coef")).withColumnsRenamed({"const": "a", x: "b"})
        own = Window.partitionBy("grp")
        z = rows.select("grp", ((F.col(x) - F.avg(x).over(own)) / F.stddev_samp(x).over(own)).alias("z"))
        at = rankstats.quantiles(z, "z", ["grp"], {"low": 0.1, "middle": 0.5, "high": 0.9}).unpivot(["grp"], ["low", "middle", "high"], "scenario", "z")
        held = linear.rolling_ridge(rows, [x], "y", ["grp"], "m", [0.0], least=12)
        band = rankstats.quantiles(held.withColumn("e", F.col("actual") - F.col("predicted")), "e", ["grp"], {"lo": 0.025, "hi": 0.975}).drop("n")
        point = F.expm1(F.col("a") + F.col("b") * F.col("z"))
        cells = [F.greatest(c, F.lit(0.0)).alias(n) for n, c in (("projected", point), ("lower", point + F.col("lo")), ("upper", point + F.col("hi")))]
        parts.append(at.join(fit, "grp").join(band, "grp").select("grp", "scenario", *cells))
    return parts[0].unionByName(parts[1]).groupBy("grp", "scenario").agg(*[F.round(F.median(c), 1).alias(c) for c in ("projected", "lower", "upper")])


# -- small relational operators


@query("SELECT p_brand, p_size, CASE WHEN count(*) = 1 THEN round(min(p_retailprice), 2) END AS price FROM part GROUP BY ALL")
def singleton_or_null(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.round(singleton(F.col("p_retailprice")), 2).alias("price"))


@query("""
SELECT 'ordered within customers' AS relation, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_a, (SELECT count(*) FROM customer) AS n_b,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS n_both,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AND (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS equal,
       (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS subset""")
def set_relations(spark, d):
    ordered, known = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return relational.set_relation(ordered, known).select(F.lit("ordered within customers").alias("relation"), "*")


@query("""
SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'industry' WHEN 'AUTOMOBILE' THEN 'industry' WHEN 'HOUSEHOLD' THEN 'home' WHEN 'FURNITURE' THEN 'home' END AS kind,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 WHEN 'AUTOMOBILE' THEN 3 END AS place, c_mktsegment, count(*) AS n
FROM customer WHERE NOT contains(c_mktsegment, 'NITURE') AND c_mktsegment IN ('HOUSEHOLD', 'MACHINERY', 'AUTOMOBILE') GROUP BY ALL""")
def recode_in_declared_order(spark, d):
    kinds = {"MACHINERY": "industry", "AUTOMOBILE": "industry", "HOUSEHOLD": "home", "FURNITURE": "home"}
    rows = table(spark, d, "customer").where(~F.col("c_mktsegment").contains("NITURE")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    out = relational.in_order(rows, "c_mktsegment", ["HOUSEHOLD", "MACHINERY", "AUTOMOBILE"]).withColumn("kind", recode(F.col("c_mktsegment"), kinds))
    return out.select("kind", F.col("place").cast("int").alias("place"), "c_mktsegment", "n").orderBy("place")


@query("""
SELECT p_brand, count(*) FILTER (WHERE lower(trim(p_type)) = (SELECT lower(min(p_type)) FROM part)) AS n_first, count(*) FILTER (WHERE contains(lower(p_name), '1')) AS n_one FROM part GROUP BY ALL""")
def text_predicates(spark, d):
    parts = table(spark, d, "part")
    first = parts.agg(F.min("p_type")).first()[0]  # one value
    return parts.groupBy("p_brand").agg(F.count_if(same_text(F.col("p_type"), f" {first.upper()} ")).alias("n_first"), F.count_if(holds_text(F.col("p_name"), "1")).alias("n_one"))


@query("SELECT c_mktsegment, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def strict_lookup(spark, d):
    """Every order finds its customer, or the query fails."""
    rows = relational.lag_join(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_totalprice"), table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), "k", F.lit(0), ["c_mktsegment"], strict=True)
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query(f"WITH {PANEL}, late AS (SELECT grp, m, n * 2 AS n FROM panel WHERE m % 2 = 0) SELECT p.grp, p.m, p.n, l.n AS n_right, l.n IS NOT NULL AS matched FROM panel p LEFT JOIN late l USING (grp, m)")
def one_to_one_suffix(spark, d):
    p = panel(spark, d).select("grp", "m", "n")
    return relational.one_to_one(p, p.where("m % 2 = 0").withColumn("n", F.col("n") * 2), ["grp", "m"])


@query("""
SELECT p_brand, arg_min(p_size, (round(p_retailprice / 100) * 1000 - p_size)) AS larger, arg_min(p_size, (round(p_retailprice / 100) * 1000 + p_size)) AS smaller FROM part GROUP BY ALL""")
def argmin_ties(spark, d):
    """The least price (in hundreds), ties once to the larger and once to the smaller size."""
    price = F.round(F.col("p_retailprice") / 100)
    picks = [F.min(F.struct(price, (sign * F.col("p_size")).alias("s")))["s"] * sign for sign in (-1, 1)]
    return table(spark, d, "part").groupBy("p_brand").agg(picks[0].alias("larger"), picks[1].alias("smaller"))


@query(f"""
WITH {PANEL}, f AS (SELECT grp, regr_slope(y, m) AS b, avg(y) AS my, avg(m) AS mm FROM panel GROUP BY grp)
SELECT grp, floor(arg_max(y, m)) AS last, round(stddev_samp(y - my - b * (m - mm)), 3) AS detrended_sd FROM panel JOIN f USING (grp) GROUP BY grp""")
def last_value_and_spread(spark, d):
    flat = rankstats.detrended(panel(spark, d).withColumn("t", F.col("m").cast("double")), ["y"], "t", ["grp"])
    return flat.groupBy("grp").agg(F.floor(F.max_by("y", "m")).cast("double").alias("last"), F.round(detrended_sd("y_r"), 3).alias("detrended_sd"))


@query("""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d, strftime(d, '%Y-%m-%d') AS iso, strftime(d, '%m-%d') AS md, strftime(d, '%m-%b') AS month_name, CAST(d + INTERVAL 7 DAY AS DATE) AS next_week, CAST(datediff('day', d, DATE '2000-01-01') AS INT) AS days_to FROM d""")
def date_texts(spark, d):
    day = F.col("d")
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select("d", F.date_format(day, "yyyy-MM-dd").alias("iso"), F.date_format(day, "MM-dd").alias("md"), F.date_format(day, "MM-MMM").alias("month_name"), F.date_add(day, 7).alias("next_week"), F.datediff(F.lit("2000-01-01").cast("date"), day).alias("days_to"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, round(ln(l_quantity), 6) AS log_q, round(ln(1 + l_discount), 6) AS log1p_d, round(exp(l_tax), 6) AS exp_t, round(exp(l_discount) - 1, 6) AS expm1_d,
       round(100 * (exp(l_tax) - 1), 5) AS effect, (l_quantity + l_linenumber) / 2 AS mid, l_quantity - l_linenumber AS spread FROM lineitem""")
def log_domain(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    cells = [r6(log_checked(q)).alias("log_q"), r6(log_checked(F.col("l_discount"), True)).alias("log1p_d"), r6(F.exp("l_tax")).alias("exp_t"), r6(F.expm1("l_discount")).alias("expm1_d"), F.round(percent_effect(F.col("l_tax")), 5).alias("effect")]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *cells, ((q + n) / 2).alias("mid"), (q - n).alias("spread"))


@query("""
SELECT o_orderkey, coalesce(printf('%.3f', CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 'NA') AS price, upper(o_orderstatus) || '-' || lower(replace(o_orderpriority, '-', ' ')) AS label,
       starts_with(o_orderpriority, '1') AS urgent, len(list_filter([o_totalprice > 100000, o_orderstatus = 'F', o_custkey % 2 = 0], lambda z: z)) AS n_true, list_contains([o_orderstatus, 'X'], 'F') AS has_f FROM orders""")
def text_format(spark, d):
    flags = F.array(F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", F.col("o_custkey") % 2 == 0)
    label = F.concat(F.upper("o_orderstatus"), F.lit("-"), F.lower(F.replace("o_orderpriority", F.lit("-"), F.lit(" "))))
    price = number_text(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")), "%.3f")
    return table(spark, d, "orders").select("o_orderkey", price.alias("price"), label.alias("label"), F.startswith("o_orderpriority", F.lit("1")).alias("urgent"), F.size(F.filter(flags, lambda z: z)).cast("long").alias("n_true"), F.array_contains(F.array("o_orderstatus", F.lit("X")), "F").alias("has_f"))


@query("""
SELECT l_returnflag, count(*) AS n, round(sum(l_discount), 4) AS discounts, round(max(l_tax), 4) AS top FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY ALL""")
def range_gate(spark, d):
    """Rows of two years; a discount or tax outside its bounds would make the query fail."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate").cast("date").between("1996-01-01", "1997-12-31"))
    discount, tax = checked_range(F.col("l_discount"), 0, 1, "discount"), checked_range(F.col("l_tax"), 0, 1, "tax")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum(discount), 4).alias("discounts"), F.round(F.max(tax), 4).alias("top"))


# -- gates


@query("""
SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS m, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY ALL HAVING count(DISTINCT CAST(l_shipdate AS DATE)) < 28""")
def coverage_gate(spark, d):
    rows = table(spark, d, "lineitem").select((F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("m"), F.col("l_shipdate").cast("date").alias("d"))
    return contracts.coverage(rows, ["m"], "d", 28)


@query("""
SELECT 'no negative amount' AS check_id, 'plausibility' AS category, count(*) FILTER (WHERE l_quantity < 0)::DOUBLE AS value, count(*) FILTER (WHERE l_quantity < 0) = 0 AS passed FROM lineitem
UNION ALL SELECT 'discount below price', 'plausibility', count(*) FILTER (WHERE l_discount > l_extendedprice), count(*) FILTER (WHERE l_discount > l_extendedprice) = 0 FROM lineitem
UNION ALL SELECT 'all years there', 'coverage', count(DISTINCT year(l_shipdate)), count(DISTINCT year(l_shipdate)) >= 7 FROM lineitem
UNION ALL SELECT 'enough rows', 'coverage', count(*), count(*) >= 100000 FROM lineitem""")
def plausibility_gate(spark, d):
    gates = {
        "no negative amount": ("plausibility", F.count_if(F.col("l_quantity") < 0), F.col("value") == 0),
        "discount below price": ("plausibility", F.count_if(F.col("l_discount") > F.col("l_extendedprice")), F.col("value") == 0),
        "all years there": ("coverage", F.count_distinct(F.year("l_shipdate")), F.col("value") >= 7),
        "enough rows": ("coverage", F.count("*"), F.col("value") >= 100_000),
    }
    return contracts.gate_table(table(spark, d, "lineitem"), gates)


@query(f"""
WITH o AS (SELECT count(*) FILTER (WHERE NOT o_totalprice > 0) AS a, count(*) FILTER (WHERE NOT year(o_orderdate) BETWEEN 1995 AND 2001) AS b, count(DISTINCT o_orderpriority) AS c FROM orders),
l AS (SELECT count(*) FILTER (WHERE NOT l_discount BETWEEN 0 AND 0.05) AS a, count(*) AS b FROM lineitem), {TESTS},
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM t),
h AS (SELECT family, id, p, least(max((n - k + 1) * p) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS holm FROM r)
SELECT 'amount_positive' AS check_id, 'range' AS category, 'orders' AS "table", a::DOUBLE AS value, a = 0 AS passed FROM o
UNION ALL SELECT 'years', 'range', 'orders', b, b = 0 FROM o UNION ALL SELECT 'priorities', 'domain', 'orders', c, c = 5 FROM o
UNION ALL SELECT 'small discounts', 'plausibility', 'lineitem', a, a = 0 FROM l UNION ALL SELECT 'enough rows', 'coverage', 'lineitem', b, b >= 1000 FROM l
UNION ALL SELECT 'customers known', 'reference', '*', count(*), count(*) = 0 FROM orders ANTI JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'customer and day once', 'identity', '*', count(*), count(*) = 0 FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)
UNION ALL SELECT 'holm derived again', 'identity', '*', count(*), count(*) = 0 FROM h WHERE id % 50 = 7 AND least(holm + 0.01, 1) > holm + 1e-9""")
def multi_input_gate(spark, d):
    """A declared check set over five inputs: one scan a table, cross-table queries, all results at once."""
    inputs = {name: table(spark, d, name) for name in ("orders", "lineitem", "customer")}
    raw = tests_of(spark, d)
    right = rankstats.holm(raw, "p", ["family"], ["id"])
    inputs |= {"raw": raw, "published": right.withColumn("holm", F.when(F.col("id") % 50 == 7, F.least(F.col("holm") + 0.01, F.lit(1.0))).otherwise(F.col("holm")))}
    rows = {"orders": {"amount_positive": ("range", F.col("o_totalprice") > 0), "years": ("range", F.year("o_orderdate").between(1995, 2001))}, "lineitem": {"small discounts": ("plausibility", F.col("l_discount").between(0, 0.05))}}
    totals = {"orders": {"priorities": ("domain", F.count_distinct("o_orderpriority"), lambda v: v == 5)}, "lineitem": {"enough rows": ("coverage", F.count("*"), lambda v: v >= 1000)}}
    across = {
        "customers known": ("reference", contracts.lacking("orders", "customer", {"o_custkey": "c_custkey"})),
        "customer and day once": ("identity", contracts.repeated("orders", ["o_custkey", "o_orderdate"])),
        "holm derived again": ("identity", contracts.differing("published", ["family", "id"], ["holm"], lambda t: rankstats.holm(t["raw"], "p", ["family"], ["id"]))),
    }
    return contracts.check_tables(inputs, rows, totals, across).drop("detail")


@query("""
WITH p(n_regionkey, n) AS (VALUES (0, 5), (1, 5), (2, 6)), o AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL)
SELECT p.n_regionkey, CAST(p.n AS BIGINT) AS published, o.n AS ours, coalesce(o.n = p.n, false) AS agrees FROM p LEFT JOIN o USING (n_regionkey)""")
def reconciliation(spark, d):
    published = spark.createDataFrame([(0, 5), (1, 5), (2, 6)], "n_regionkey int, n long")
    totals = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    return contracts.reconcile(totals, published, ["n_regionkey"], "n")


@query(f"""
WITH {DAILY}, e AS (SELECT unnest(['click', 'view', 'error', 'never']) AS event_type, 30 AS expected), h AS (SELECT event_type, count(*) AS n FROM daily GROUP BY ALL)
SELECT event_type, CAST(expected AS BIGINT) AS expected, coalesce(n, 0) AS "rows", coalesce(n, 0) = expected AS complete FROM e LEFT JOIN h USING (event_type)""")
def completeness(spark, d):
    expected = spark.createDataFrame([(t, 30) for t in ("click", "view", "error", "never")], "event_type string, expected long")
    return contracts.completeness(daily(spark, d), ["event_type"], expected)


@query(f"""
WITH t AS (SELECT s_nationkey AS family, s_suppkey AS id, (abs(s_acctbal) + 1) / 20000 AS p FROM supplier)
SELECT 'rows' AS check_id, 'schema' AS category, count(*)::DOUBLE AS value, count(*) > 0 AS passed FROM t
UNION ALL SELECT 'families apart', 'identity', count(DISTINCT family), count(DISTINCT family) > 1 FROM t
UNION ALL SELECT 'adjusted not below raw', 'identity', 0, true UNION ALL SELECT 'derived again', 'identity', 0, true UNION ALL SELECT 'above one', 'range', 0, true""")
def output_validation(spark, d):
    """The published corrections against an independent derivation: the step-down maximum as a join instead of a window."""
    raw = tests_of(spark, d)
    out = rankstats.holm(raw, "p", ["family"], ["id"])
    own = Window.partitionBy("family")
    placed = raw.withColumn("k", F.row_number().over(own.orderBy("p", "id"))).withColumn("scaled", F.col("p") * (F.count("*").over(own) - F.col("k") + 1))
    earlier = placed.select("family", F.col("k").alias("k0"), F.col("scaled").alias("s0"))
    again = placed.join(earlier, "family").where("k0 <= k").groupBy("family", "id").agg(F.least(F.max("s0"), F.lit(1.0)).alias("again"))
    gates = {
        "rows": ("schema", F.count("*"), F.col("value") > 0),
        "families apart": ("identity", F.count_distinct("family"), F.col("value") > 1),
        "adjusted not below raw": ("identity", F.count_if(F.col("holm") < F.col("p") - 1e-12), F.col("value") == 0),
        "derived again": ("identity", F.count_if(F.abs(F.col("holm") - F.col("again")) > 1e-12), F.col("value") == 0),
        "above one": ("range", F.count_if(F.col("holm") > 1), F.col("value") == 0),
    }
    return contracts.gate_table(out.join(again, ["family", "id"]), gates)
