"""The registered queries: each applies operators of the library to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import close, correlation, harmonics, month_day, ratio, water_year
from ..operators import contracts, linear, ranges, rankstats, relational, resample, timeseries, validation
from .base import DAILY, ENV, JOINED, PANEL, corr, daily, environment, index_sql, joined, panel, ranks, t_tail_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


# -- grouped aggregates and projections


@query("""
SELECT CAST(year(l_shipdate) + CASE WHEN month(l_shipdate) >= 10 THEN 1 ELSE 0 END AS BIGINT) AS wy, l_returnflag,
       round_even(avg(l_quantity), 3) AS mean_qty, round_even(min(l_extendedprice), 3) AS min_price,
       count(*) AS n, count(nullif(l_discount, 0)) AS n_discounted
FROM lineitem GROUP BY ALL""")
def water_year_summary(spark, d):
    cells = [F.bround(F.avg("l_quantity"), 3).alias("mean_qty"), F.bround(F.min("l_extendedprice"), 3).alias("min_price"), F.count("*").alias("n"), F.count(F.nullif(F.col("l_discount"), F.lit(0.0))).alias("n_discounted")]
    return table(spark, d, "lineitem").groupBy(water_year(F.col("l_shipdate")).alias("wy"), "l_returnflag").agg(*cells)


@query("""
SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS yr,
       round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) AS total_f,
       round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 0), 2) AS total_o,
       round(coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 0), 2) AS total_p
FROM orders GROUP BY ALL""")
def conditional_origin_pivot(spark, d):
    rows = table(spark, d, "orders").withColumn("yr", F.year("o_orderdate").cast("long"))
    names = {s: f"total_{s.lower()}" for s in "FOP"}
    return rounded(relational.category_sums(rows, ["o_orderpriority", "yr"], "o_orderstatus", names, "o_totalprice"), *names.values(), to=2)


@query("""
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 3) AS mean, round(median(c_acctbal), 3) AS median,
       round(min(c_acctbal), 3) AS low, round(max(c_acctbal), 3) AS high
FROM customer GROUP BY ALL""")
def panel_summary(spark, d):
    rows, cells = table(spark, d, "customer"), {"mean": F.avg, "low": F.min, "high": F.max}
    out = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), *[f("c_acctbal").alias(k) for k, f in cells.items()])
    middle = rankstats.quantiles(rows, "c_acctbal", ["c_mktsegment"], {"median": 0.5}).drop("n")
    return rounded(out.join(middle, "c_mktsegment"), *cells, "median", to=3)


@query("""
SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.025), 6) AS q025, round(quantile_cont(c_acctbal, 0.25), 6) AS q25,
       round(quantile_cont(c_acctbal, 0.975), 6) AS q975
FROM customer GROUP BY ALL""")
def quantile_type7(spark, d):
    cells = {"q025": 0.025, "q25": 0.25, "q975": 0.975}
    return rounded(rankstats.quantiles(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], cells).drop("n"), *cells)


@query("""
WITH t AS (SELECT nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem),
u AS (SELECT count(*) AS n, count(*) - count(l_discount) AS a, count(*) - count(l_tax) AS b, count(*) - count(l_returnflag) AS c FROM t)
SELECT 'l_discount' AS "column", n AS "rows", a AS missing, round(a * 100.0 / n, 6)::DOUBLE AS pct FROM u
UNION ALL SELECT 'l_tax', n, b, round(b * 100.0 / n, 6)::DOUBLE FROM u
UNION ALL SELECT 'l_returnflag', n, c, round(c * 100.0 / n, 6)::DOUBLE FROM u""")
def missingness(spark, d):
    blank = {"l_discount": F.lit(0.0), "l_tax": F.lit(0.0), "l_returnflag": F.lit("N")}
    rows = table(spark, d, "lineitem").select(*[F.nullif(F.col(c), v).alias(c) for c, v in blank.items()])
    return relational.missingness(rows, list(blank)).withColumn("pct", r6(F.col("pct").cast("double")))


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark, d):
    return contracts.duplicate_keys(table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("d")), ["o_custkey", "d"])


@query("""
SELECT p_brand, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types,
       upper(sha256(string_agg(DISTINCT p_type, ';' ORDER BY p_type))) AS digest
FROM part GROUP BY ALL""")
def sorted_set_and_sha(spark, d):
    joined_set = F.array_join(F.sort_array(F.collect_set("p_type")), ";")  # a part has one of a few types
    return table(spark, d, "part").groupBy("p_brand").agg(joined_set.alias("types")).withColumn("digest", F.upper(F.sha2("types", 256)))


@query("""
SELECT event_type, count(*) FILTER (WHERE value >= 10) AS n10, count(*) FILTER (WHERE value >= 20) AS n20,
       count(*) FILTER (WHERE value >= 40) AS n40, round(100.0 * count(*) FILTER (WHERE value >= 10) / count(*), 6)::DOUBLE AS pct10
FROM events GROUP BY ALL""")
def threshold_counts(spark, d):
    counts = [F.count_if(F.col("value") >= t).alias(f"n{t}") for t in (10, 20, 40)]
    out = table(spark, d, "events").groupBy("event_type").agg(*counts, F.count("*").alias("n"))
    return out.withColumn("pct10", r6(F.lit(100.0) * F.col("n10") / F.col("n"))).drop("n")


@query("""
SELECT 'order' AS kind, o_orderkey AS id, round(o_totalprice, 2) AS amount, CAST(NULL AS VARCHAR) AS flag FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT 'item', l_orderkey, round(l_extendedprice, 2), l_returnflag FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'N'""")
def union_long(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 2).alias("amount"))
    items = table(spark, d, "lineitem").where("l_linestatus = 'O' AND l_returnflag <> 'N'").select(F.lit("item").alias("kind"), F.col("l_orderkey").alias("id"), F.round("l_extendedprice", 2).alias("amount"), F.col("l_returnflag").alias("flag"))
    return orders.unionByName(items, allowMissingColumns=True)


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("""
SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean_k
FROM events GROUP BY ALL""")
def json_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("d"), "event_type").agg(F.count("*").alias("n"), r6(F.avg(k)).alias("mean_k"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_tax * 12.5, 1) AS t1, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def half_even_round(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround(F.col("l_tax") * 12.5, 1).alias("t1"), F.bround(F.col("l_quantity") / 2, 0).alias("half"))


@query(f"""
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), a AS (SELECT d, (dayofyear(d) - 1) * 2 * pi() / 365.2425 AS a FROM days)
SELECT d, round(sin(a), 6) AS sin1, round(cos(a), 6) AS cos1, round(sin(2 * a), 6) AS sin2, round(cos(2 * a), 6) AS cos2 FROM a""")
def harmonics_of_year(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return rounded(days.select("d", *harmonics(F.col("d"))), "sin1", "cos1", "sin2", "cos2")


@query("""
SELECT c_mktsegment, c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer
QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal) DESC, c_custkey) <= 5""")
def top_k_per_group(spark, d):
    own = Window.partitionBy("c_mktsegment").orderBy(F.abs("c_acctbal").desc(), "c_custkey")
    rows = table(spark, d, "customer").withColumn("r", F.row_number().over(own)).where("r <= 5")
    return rows.select("c_mktsegment", "c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query(f"""
WITH {PANEL}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY m) AS a, row_number() OVER (PARTITION BY grp ORDER BY m DESC) AS b FROM panel)
SELECT grp, round(avg(y) FILTER (WHERE a <= 5), 4) AS first5, round(avg(y) FILTER (WHERE b <= 5), 4) AS last5,
       round(100 * (avg(y) FILTER (WHERE b <= 5) / avg(y) FILTER (WHERE a <= 5) - 1), 6) AS change_pct
FROM o GROUP BY grp""")
def first_last_k_mean(spark, d):
    own = Window.partitionBy("grp")
    rows = panel(spark, d).select("grp", "y", F.row_number().over(own.orderBy("m")).alias("a"), F.row_number().over(own.orderBy(F.desc("m"))).alias("b"))
    ends = rows.groupBy("grp").agg(F.avg(F.when(F.col("a") <= 5, F.col("y"))).alias("f"), F.avg(F.when(F.col("b") <= 5, F.col("y"))).alias("l"))
    return ends.select("grp", F.round("f", 4).alias("first5"), F.round("l", 4).alias("last5"), r6(100 * (ratio(F.col("l"), F.col("f")) - 1)).alias("change_pct"))


# -- joins


@query(f"""
WITH {PANEL}, {ENV}
SELECT p.grp, p.m, p.y, e.x1, e.x2 FROM panel p LEFT JOIN env e ON e.m = p.m - CAST(left(p.grp, 1) AS BIGINT)""")
def lag_join(spark, d):
    lag = F.substring("grp", 1, 1).cast("long")
    return relational.lag_join(panel(spark, d), environment(spark, d), "m", lag, ["x1", "x2"]).select("grp", "m", "y", "x1", "x2")


@query(f"""
WITH {PANEL}, {ENV}
SELECT p.grp, p.m, round(avg(e.x1), 5) AS mean_x1 FROM panel p LEFT JOIN env e ON e.m > p.m - 6 AND e.m < p.m GROUP BY p.grp, p.m""")
def range_join_mean(spark, d):
    out = relational.span_mean(panel(spark, d).select("grp", "m"), environment(spark, d), "m", F.col("m") - 5, F.col("m") - 1, "x1", "mean_x1", ["grp", "m"])
    return rounded(out, "mean_x1", to=5)


WINDOWS = [("spring", 301, 531), ("early", 415, 715), ("autumn", 901, 1130), ("new year", 101, 110)]
WINDOWS_SQL = ", ".join(f"('{n}', {a}, {b})" for n, a, b in WINDOWS)


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "window_id string, start_md long, end_md long")


@query(f"""
WITH w(window_id, start_md, end_md) AS (VALUES {WINDOWS_SQL})
SELECT window_id, CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN w ON month(o_orderdate) * 100 + day(o_orderdate) BETWEEN start_md AND end_md GROUP BY ALL""")
def theta_window_membership(spark, d):
    rows = relational.window_members(table(spark, d, "orders").select("o_orderdate", "o_totalprice"), windows(spark), month_day(F.col("o_orderdate")))
    return rows.groupBy("window_id", F.year("o_orderdate").cast("long").alias("yr")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""
WITH {PANEL}, late AS (SELECT grp, m, n AS n_late FROM panel WHERE m % 2 = 0)
SELECT p.grp, p.m, p.n, l.n_late, l.n_late IS NOT NULL AS matched FROM panel p LEFT JOIN late l USING (grp, m)""")
def one_to_one_left_join(spark, d):
    p = panel(spark, d)
    late = p.where("m % 2 = 0").select("grp", "m", F.col("n").alias("n_late"))
    return relational.one_to_one(p.select("grp", "m", "n"), late, ["grp", "m"])


@query("""
WITH s AS (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS d FROM events)
SELECT CAST(d AS DATE) AS d FROM s WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events WHERE event_type = 'error' AND value > 40)""")
def anti_missing_dates(spark, d):
    days = table(spark, d, "events").withColumn("d", F.col("ts").cast("date"))
    return relational.missing_keys(timeseries.spine(days, "d"), days.where("event_type = 'error' AND value > 40").select("d"), ["d"])


@query("""
WITH s AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT d FROM s WHERE d IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)""")
def semi_observed_dates(spark, d):
    days = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    seen = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_shipdate").cast("date").alias("d"))
    return days.join(seen, "d", "left_semi")


@query(f"""
WITH {PANEL}, g AS (SELECT DISTINCT grp FROM panel), s AS (SELECT unnest(generate_series(min(m), max(m))) AS m FROM panel)
SELECT g.grp, s.m, coalesce(p.n, 0) AS n, p.y FROM g CROSS JOIN s LEFT JOIN panel p ON p.grp = g.grp AND p.m = s.m""")
def cross_spine(spark, d):
    p = panel(spark, d)
    ends = p.agg(F.min("m").alias("a"), F.max("m").alias("b"))
    full = p.select("grp").distinct().join(F.broadcast(ends)).select("grp", F.explode(F.sequence("a", "b")).alias("m"))  # ends is one row
    return full.join(p, ["grp", "m"], "left").select("grp", "m", F.coalesce("n", F.lit(0)).alias("n"), "y")


# -- windows over series


@query(f"WITH {DAILY} SELECT event_type, d, round(avg(v) OVER (PARTITION BY event_type ORDER BY d ROWS 6 PRECEDING), 5) AS mean7 FROM daily")
def trailing_mean(spark, d):
    mean = timeseries.trailing_mean("v", 7, ["event_type"], ["d"])
    return daily(spark, d).select("event_type", "d", F.round(mean, 5).alias("mean7"))


@query(f"""
WITH {DAILY}, f AS (
  SELECT event_type, d, round(avg(v) OVER w, 5) AS mean7, row_number() OVER (PARTITION BY event_type ORDER BY d) AS k FROM daily
  WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS 6 PRECEDING))
SELECT event_type, d, mean7 FROM f WHERE k >= 7 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean7 DESC, d) = 1""")
def full_frame_7day_max(spark, d):
    mean = F.round(timeseries.trailing_mean("v", 7, ["event_type"], ["d"], full=True), 5)
    rows = daily(spark, d).select("event_type", "d", mean.alias("mean7")).where("mean7 IS NOT NULL")
    return timeseries.first_maximum(rows, "mean7", ["event_type"], ["d"])


@query(f"""
WITH {DAILY} SELECT event_type, d, n FROM daily QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, d) = 1""")
def argmax_first_tie(spark, d):
    return timeseries.first_maximum(daily(spark, d).select("event_type", "d", "n"), "n", ["event_type"], ["d"])


@query(f"""
WITH {DAILY}, t AS (
  SELECT event_type, d, v >= 25 AS ok, row_number() OVER (PARTITION BY event_type ORDER BY d) AS k FROM daily),
g AS (SELECT *, k - row_number() OVER (PARTITION BY event_type, ok ORDER BY d) AS run FROM t),
c AS (SELECT event_type, ok, run, count(*) AS n FROM g GROUP BY ALL)
SELECT event_type, coalesce(max(n) FILTER (WHERE ok), 0) AS longest FROM c GROUP BY event_type""")
def longest_spell(spark, d):
    return timeseries.longest_run(daily(spark, d), F.col("v") >= 25, ["event_type"], ["d"])


@query(f"""
WITH {DAILY}, g AS (
  SELECT event_type, CAST(datediff('day', DATE '2024-01-01', d) AS BIGINT) AS p,
         CASE WHEN day(d) IN (4, 5, 11, 17, 18, 19, 20) THEN NULL ELSE v END AS v FROM daily),
b AS (
  SELECT *, last_value(v IGNORE NULLS) OVER a AS v0, last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p0,
         first_value(v IGNORE NULLS) OVER z AS v1, first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER z AS p1
  FROM g WINDOW a AS (PARTITION BY event_type ORDER BY p ROWS UNBOUNDED PRECEDING),
                z AS (PARTITION BY event_type ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_type, p, v, coalesce(v IS NULL AND p1 - p0 - 1 <= 3, false) AS was_filled,
       round(coalesce(v, CASE WHEN p1 - p0 - 1 <= 3 THEN v0 + (v1 - v0) * (p - p0) / (p1 - p0) END), 7) AS filled FROM b""")
def gap_fill(spark, d):
    gone = F.dayofmonth("d").isin(4, 5, 11, 17, 18, 19, 20)
    rows = daily(spark, d).select("event_type", F.datediff("d", F.lit("2024-01-01").cast("date")).cast("long").alias("p"), F.when(~gone, F.col("v")).alias("v"))
    return rounded(timeseries.fill_short_gaps(rows, "v", "p", ["event_type"]), "filled", to=7)


@query(f"""
WITH {PANEL}, e AS (SELECT grp, m, y, y - avg(y) OVER (PARTITION BY grp) AS e FROM panel),
s AS (SELECT *, e - lag(e) OVER (PARTITION BY grp ORDER BY m) AS step, lag(e) OVER (PARTITION BY grp ORDER BY m) AS b FROM e)
SELECT grp, round(sum(step * step) / sum(e * e), 6) AS durbin_watson,
       round({corr("CASE WHEN b IS NOT NULL THEN e END", "b")}, 6) AS lag1 FROM s GROUP BY grp""")
def durbin_watson(spark, d):
    rows = panel(spark, d).withColumn("e", F.col("y") - F.avg("y").over(Window.partitionBy("grp")))
    lagged = rows.withColumn("b", timeseries.previous("e", ["grp"], ["m"])).where("b IS NOT NULL")
    lag1 = lagged.groupBy("grp").agg(r6(correlation("e", "b")).alias("lag1"))
    return rounded(timeseries.durbin_watson(rows, "e", ["grp"], ["m"]), "durbin_watson").join(lag1, "grp")


#: Blocks of a week and a half, so that the tables' series of a month are several blocks.
SHORT = 10


@query(SQL["trailing_mean"])
def ranged_trailing_mean(spark, d):
    """The same with each series over several tasks."""
    out = ranges.trailing_mean(daily(spark, d), "v", 7, ["event_type"], ["d"], "mean7", block=SHORT)
    return rounded(out, "mean7", to=5).select("event_type", "d", "mean7")


@query(SQL["longest_spell"])
def ranged_longest_spell(spark, d):
    return ranges.longest_run(daily(spark, d), F.col("v") >= 25, ["event_type"], ["d"], block=SHORT)


@query(SQL["gap_fill"])
def ranged_gap_fill(spark, d):
    gone = F.dayofmonth("d").isin(4, 5, 11, 17, 18, 19, 20)
    rows = daily(spark, d).select("event_type", F.datediff("d", F.lit("2024-01-01").cast("date")).cast("long").alias("p"), F.when(~gone, F.col("v")).alias("v"))
    return rounded(ranges.fill_short_gaps(rows, "v", "p", ["event_type"], block=SHORT), "filled", to=7)


@query(f"""
WITH {DAILY}, r AS (
  SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY d) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n, v, CAST(n AS DOUBLE) AS c FROM daily),
s AS (SELECT a.event_type, k.shift, a.v, b.c FROM r a, LATERAL (SELECT unnest(range(0, a.n)) AS shift) k JOIN r b ON b.event_type = a.event_type AND b.pos = ((a.pos - k.shift) % a.n + a.n) % a.n)
SELECT event_type, shift, round({corr("v", "c")}, 6) AS r FROM s GROUP BY ALL""")
def circular_shift(spark, d):
    rows = daily(spark, d).withColumn("c", F.col("n").cast("double"))
    return rounded(timeseries.circular_shifts(rows, "v", "c", ["event_type"], ["d"]), "r")


# -- rank statistics


@query(f"""
WITH {JOINED}, r AS ({ranks("grp", "x1", "y", "joined")})
SELECT grp, count(*) AS n, round({corr("rx", "ry")}, 6) AS rho FROM r GROUP BY grp""")
def midrank_spearman(spark, d):
    return rounded(rankstats.spearman(joined(spark, d), "x1", "y", ["grp"]), "rho")


def indicators(spark: SparkSession, d: str) -> DataFrame:
    return joined(spark, d).unpivot(["grp", "m", "y"], ["x1", "x2", "x3"], "indicator", "x")


@query(f"""
WITH {JOINED}, long AS (
  SELECT grp, m, y, 'x1' AS indicator, x1 AS x FROM joined UNION ALL SELECT grp, m, y, 'x2', x2 FROM joined UNION ALL SELECT grp, m, y, 'x3', x3 FROM joined),
r AS ({ranks("grp, indicator", "x", "y", "long")}), c AS (SELECT grp, indicator, count(*) AS n, {corr("rx", "ry")} AS rho FROM r GROUP BY ALL),
p AS (SELECT *, {t_tail_sql("rho * sqrt((n - 2) / (1 - rho * rho))", "n - 2")} AS p FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY p, grp, indicator) AS k, count(*) OVER () AS tests FROM p),
q AS (SELECT *, least(min(p * tests / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM k)
SELECT grp, indicator, n, round(rho, 6) AS rho, round(p, 5) AS p, round(q, 5) AS q, q <= 0.05 AS flagged FROM q""")
def ranked_indicators(spark, d):
    """The flagship: which indicator is rank-associated with the response, per group, after FDR."""
    tests = rankstats.spearman(indicators(spark, d), "x", "y", ["grp", "indicator"], p=True)
    out = rankstats.benjamini_hochberg(tests, "p", [], ["grp", "indicator"])
    flagged = out.withColumn("flagged", F.col("q") <= 0.05).orderBy("p", "grp", "indicator")
    return rounded(rounded(flagged, "rho"), "p", "q", to=5)


@query(f"""
WITH {JOINED}, long AS (
  SELECT grp, m, y, 'x1' AS indicator, x1 AS x FROM joined UNION ALL SELECT grp, m, y, 'x2', x2 FROM joined UNION ALL SELECT grp, m, y, 'x3', x3 FROM joined),
r AS ({ranks("grp, indicator", "x", "y", "long")}), c AS (SELECT grp, indicator, round({corr("rx", "ry")}, 6) AS rho FROM r GROUP BY ALL)
SELECT indicator, max(rho) FILTER (WHERE grp = '1-URGENT') AS urgent, max(rho) FILTER (WHERE grp = '5-LOW') AS low FROM c GROUP BY indicator""")
def pivot_corr(spark, d):
    rhos = rounded(rankstats.spearman(indicators(spark, d), "x", "y", ["grp", "indicator"]), "rho")
    return relational.wide(rhos, "indicator", "grp", ["1-URGENT", "5-LOW"], "rho").withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


TESTS = "t AS (SELECT s_nationkey AS family, s_suppkey AS id, (abs(s_acctbal) + 1) / 20000 AS p FROM supplier)"


def tests_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("family"), F.col("s_suppkey").alias("id"), ((F.abs("s_acctbal") + 1) / 20000).alias("p"))


@query(f"""
WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM t)
SELECT family, id, round(least(min(p * n / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 8) AS q FROM r""")
def bh_adjust(spark, d):
    return rounded(rankstats.benjamini_hochberg(tests_of(spark, d), "p", ["family"], ["id"]), "q", to=8).select("family", "id", "q")


@query(f"""
WITH {TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM t),
h AS (SELECT family, id, least(max((n - k + 1) * p) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS holm FROM r)
SELECT family, id, round(holm, 8) AS holm, holm < 0.05 AS passed FROM h""")
def holm_adjust(spark, d):
    return rounded(rankstats.holm(tests_of(spark, d), "p", ["family"], ["id"]), "holm", to=8).select("family", "id", "holm", "passed")


@query(f"""
WITH {PANEL}, k AS (
  SELECT a.grp, CAST(sum(sign(b.n - a.n)) AS BIGINT) AS s, count(*) AS n0, count(*) FILTER (WHERE a.n = b.n) AS ties
  FROM panel a JOIN panel b ON a.grp = b.grp AND a.m < b.m GROUP BY a.grp)
SELECT grp, s, n0, ties, round(s / sqrt(n0 * (n0 - ties)::DOUBLE), 6) AS tau FROM k""")
def kendall_tau(spark, d):
    return rounded(rankstats.kendall(panel(spark, d), "m", "n", ["grp"]), "tau").select("grp", "s", "n0", "ties", "tau")


@query(f"""
WITH {PANEL}, p AS (SELECT grp, m // 3 AS t, CASE WHEN m % 7 <> 0 THEN floor(y / 5000) END AS v FROM panel), f AS (SELECT * FROM p WHERE v IS NOT NULL),
k AS (SELECT a.grp, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, count(*) AS n0 FROM f a JOIN f b ON a.grp = b.grp AND a.t < b.t GROUP BY a.grp),
c AS (SELECT grp, sum(k)::BIGINT AS n, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS ties FROM (SELECT grp, v, count(*) AS k FROM f GROUP BY ALL) GROUP BY grp)
SELECT grp, n, s, n0, ties, round(s / sqrt(n0::DOUBLE * (n * (n - 1) // 2 - ties)), 6) AS tau FROM k JOIN c USING (grp)""")
def kendall_ties(spark, d):
    """Quarters with several values, equal values and missing ones: tau-b with both ties."""
    p = panel(spark, d).select("grp", F.floor(F.col("m") / 3).alias("t"), F.when(F.col("m") % 7 != 0, F.floor(F.col("y") / 5000)).alias("v"))
    return rounded(rankstats.kendall(p, "t", "v", ["grp"]), "tau")


@query(SQL["kendall_ties"])
def ranged_kendall(spark, d):
    """The same with each series over several tasks."""
    p = panel(spark, d).select("grp", F.floor(F.col("m") / 3).alias("t"), F.when(F.col("m") % 7 != 0, F.floor(F.col("y") / 5000)).alias("v"))
    return rounded(ranges.kendall(p, "t", "v", ["grp"], block=SHORT), "tau")


@query(f"""
WITH {TESTS}, c AS (SELECT family, id, CASE WHEN id % 3 <> 0 THEN p END AS p FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS k, count(*) OVER (PARTITION BY family) AS n FROM c WHERE p IS NOT NULL),
a AS (SELECT family, id, least(min(p * n / k) OVER (PARTITION BY family ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q,
             least(max((n - k + 1) * p) OVER (PARTITION BY family ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS holm FROM r)
SELECT c.family, c.id, round(q, 8) AS q, round(holm, 8) AS holm, holm < 0.05 AS passed FROM c LEFT JOIN a USING (family, id)""")
def corrections_with_nulls(spark, d):
    """Tests without a p-value do not count and stay without an adjusted one."""
    tests = tests_of(spark, d).withColumn("p", F.when(F.col("id") % 3 != 0, F.col("p")))
    both = rankstats.holm(rankstats.benjamini_hochberg(tests, "p", ["family"], ["id"]), "p", ["family"], ["id"])
    return rounded(both, "q", "holm", to=8).select("family", "id", "q", "holm", "passed")


@query(f"""
WITH {PANEL}, s AS (SELECT a.grp, (b.y - a.y) / (b.m - a.m) AS slope FROM panel a JOIN panel b ON a.grp = b.grp AND a.m < b.m),
o AS (SELECT grp, median(slope) AS slope, list_sort(list(slope)) AS l, count(*) AS c FROM s GROUP BY grp),
t AS (SELECT grp, sum(k) AS n, sum(k * (k - 1) * (2 * k + 5)) AS tied FROM (SELECT grp, y, count(*) AS k FROM panel GROUP BY ALL) GROUP BY grp),
z AS (SELECT o.*, CAST(t.n AS BIGINT) AS n, 1.959964 * sqrt((t.n * (t.n - 1) * (2 * t.n + 5) - t.tied) / 18.0) AS w FROM o JOIN t USING (grp))
SELECT grp, n, round(slope, 5) AS slope, round(l[CAST(greatest(round_even((c - w) / 2, 0) - 1, 0) AS INT) + 1], 5) AS low,
       round(l[CAST(least(round_even((c + w) / 2, 0), c - 1) AS INT) + 1], 5) AS high FROM z""")
def theil_sen(spark, d):
    return rounded(rankstats.theil_sen(panel(spark, d), "m", "y", ["grp"]), "slope", "low", "high", to=5)


@query(f"""
WITH {JOINED}, o AS (SELECT b.grp, a.m AS omitted, b.x2, b.y FROM joined a JOIN joined b ON a.grp = b.grp AND a.m <> b.m),
r AS ({ranks("grp, omitted", "x2", "y", "o")})
SELECT grp, omitted, round({corr("rx", "ry")}, 6) AS rho FROM r GROUP BY ALL""")
def leave_one_out_rho(spark, d):
    return rounded(rankstats.leave_one_out(joined(spark, d), "x2", "y", ["grp"], "m"), "rho")


@query(f"""
WITH {JOINED}, r0 AS ({ranks("grp", "x1", "y", "joined", ", m")}),
f AS (SELECT grp, regr_slope(rx, m) AS bx, regr_slope(ry, m) AS "by", avg(rx) AS mx, avg(ry) AS my, avg(m) AS mm FROM r0 GROUP BY grp),
e AS (SELECT grp, m, rx - mx - bx * (m - mm) AS ex, ry - my - "by" * (m - mm) AS ey FROM r0 JOIN f USING (grp))
SELECT grp, round({corr("ex", "ey")}, 6) AS partial_rho FROM e GROUP BY grp""")
def detrended_partial_corr(spark, d):
    ranked = joined(spark, d).select("grp", F.col("m").cast("double").alias("m"), rankstats.midrank("x1", ["grp"]).alias("rx"), rankstats.midrank("y", ["grp"]).alias("ry"))
    flat = rankstats.detrended(ranked, ["rx", "ry"], "m", ["grp"])
    return flat.groupBy("grp").agg(r6(correlation("rx_r", "ry_r")).alias("partial_rho"))


# -- linear models


@query(f"""
WITH {JOINED}, f AS (
  SELECT grp, count(*) AS n, regr_slope(y, x2) AS b, regr_intercept(y, x2) AS a, avg(x2) AS mx, var_pop(x2) * count(*) AS sxx FROM joined GROUP BY grp),
e AS (SELECT grp, f.n, b, sxx, x2 - mx AS dx, y - a - b * x2 AS e, 1.0 / f.n + (x2 - mx) * (x2 - mx) / sxx AS h FROM joined JOIN f USING (grp))
SELECT grp, max(n) AS n, round(max(b), 3) AS slope, round(sqrt(sum(dx * dx * e * e / ((1 - h) * (1 - h)))) / max(sxx), 3) AS hc3_se FROM e GROUP BY grp""")
def hc3_one_predictor(spark, d):
    return rounded(linear.hc3(linear.simple_ols(joined(spark, d), "x2", "y", ["grp"]), "x2", ["grp"]), "slope", "hc3_se", to=3)


@query(f"""
WITH {JOINED}, f AS (
  SELECT grp, count(*) AS n, regr_slope(y, x2) AS b, regr_intercept(y, x2) AS a, avg(x2) AS mx, var_pop(x2) * count(*) AS sxx FROM joined GROUP BY grp),
e AS (SELECT grp, m, f.n, y - a - b * x2 AS e, 1.0 / f.n + (x2 - mx) * (x2 - mx) / sxx AS h FROM joined JOIN f USING (grp)),
s AS (SELECT grp, sum(e * e) / (max(n) - 2) AS mse FROM e GROUP BY grp)
SELECT grp, m, round(h, 6) AS leverage, round(e * e * h / (2 * mse * (1 - h) * (1 - h)), 6) AS cook
FROM e JOIN s USING (grp) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY e * e * h / (2 * mse * (1 - h) * (1 - h)) DESC, m) = 1""")
def most_influential(spark, d):
    fits = linear.simple_ols(joined(spark, d), "x2", "y", ["grp"]).select("grp", "m", "leverage", "cook")
    return rounded(timeseries.first_maximum(fits, "cook", ["grp"], ["m"]), "leverage", "cook")


@query(f"WITH {JOINED} SELECT grp, round({corr('x1', 'x3')}, 6) AS r, round(1 / (1 - ({corr('x1', 'x3')}) ** 2), 6) AS vif FROM joined GROUP BY grp")
def vif_two(spark, d):
    return rounded(linear.vif_two(joined(spark, d), "x1", "x3", ["grp"]), "r", "vif")


@query(f"""
WITH {JOINED}, s AS (
  SELECT grp, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2,
         covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM joined GROUP BY grp),
g AS (SELECT *, n + 10.0 AS d, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS t1, n * c2 / s2 AS t2 FROM s),
b AS (SELECT *, (d * t1 - o * t2) / (d * d - o * o) / s1 AS b1, (d * t2 - o * t1) / (d * d - o * o) / s2 AS b2 FROM g)
SELECT grp, 'intercept' AS term, round(my - b1 * m1 - b2 * m2, 2) AS coef FROM b
UNION ALL SELECT grp, 'x1', round(b1, 2) FROM b UNION ALL SELECT grp, 'x2', round(b2, 2) FROM b""")
def ridge_gram(spark, d):
    return rounded(linear.ridge(joined(spark, d), ["x1", "x2"], "y", ["grp"], 10.0), "coef", to=2)


@query(f"""
WITH {JOINED}, s AS (
  SELECT grp, m, y, x1, count(*) OVER w AS k, sum(x1) OVER w AS sx, sum(y) OVER w AS sy, sum(x1 * x1) OVER w AS sxx, sum(x1 * y) OVER w AS sxy
  FROM joined WINDOW w AS (PARTITION BY grp ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, (k * sxy - sx * sy) / nullif(k * sxx - sx * sx, 0) AS b FROM s WHERE k >= 12),
q AS (SELECT grp, y, (sy - b * sx) / k + b * x1 AS predicted FROM p)
SELECT grp, count(*) AS n, round(avg(abs(predicted - y)), 2) AS mae, round(sqrt(avg((predicted - y) ** 2)), 2) AS rmse FROM q GROUP BY grp""")
def rolling_origin_ols(spark, d):
    predicted = linear.rolling_ols(joined(spark, d), "x1", "y", ["grp"], ["m"])
    return rounded(validation.metrics(predicted, "y", "predicted", ["grp"]), "mae", "rmse", to=2).select("grp", "n", "mae", "rmse")


BASELINES = f"""{PANEL}, f AS (
  SELECT grp, m, y, avg(y) OVER w AS expanding, lag(y) OVER (PARTITION BY grp ORDER BY m) AS previous, avg(y) OVER t AS recent,
         row_number() OVER (PARTITION BY grp ORDER BY m) AS k
  FROM panel WINDOW w AS (PARTITION BY grp ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    t AS (PARTITION BY grp ORDER BY m ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
l AS (SELECT grp, m, 'expanding' AS model, y, expanding AS p FROM f WHERE k > 12
      UNION ALL SELECT grp, m, 'previous', y, previous FROM f WHERE k > 12 UNION ALL SELECT grp, m, 'recent', y, recent FROM f WHERE k > 12),
s AS (SELECT grp, model, count(*) AS n, avg(abs(p - y)) AS mae, sqrt(avg((p - y) ** 2)) AS rmse, avg(p - y) AS bias,
             1 - sum((p - y) ** 2) / (var_pop(y) * count(*)) AS r2 FROM l GROUP BY ALL)"""


def forecasts(spark: SparkSession, d: str) -> DataFrame:
    """Expanding-mean, last-value and six-month-mean forecasts from the thirteenth month on, long."""
    own = Window.partitionBy("grp").orderBy("m")
    wide = panel(spark, d).select(
        "grp", "m", "y", timeseries.expanding_mean("y", ["grp"], ["m"]).alias("expanding"), timeseries.previous("y", ["grp"], ["m"]).alias("previous"),
        F.avg("y").over(own.rowsBetween(-6, -1)).alias("recent"), F.row_number().over(own).alias("k"),
    )
    return wide.where("k > 12").unpivot(["grp", "m", "y"], ["expanding", "previous", "recent"], "model", "p")


@query(f"WITH {BASELINES} SELECT grp, model, n, round(mae, 3) AS mae, round(rmse, 3) AS rmse, round(bias, 3) AS bias, round(r2, 6) AS r2 FROM s")
def metrics_by_model(spark, d):
    return rounded(rounded(validation.metrics(forecasts(spark, d), "y", "p", ["grp", "model"]), "r2"), "mae", "rmse", "bias", to=3)


@query(f"""
WITH {BASELINES}, b AS (SELECT grp, min(mae) AS bm, min(rmse) AS br FROM s WHERE model <> 'recent' GROUP BY grp)
SELECT grp, model, round(mae, 3) AS mae, round(bm, 3) AS best_mae, mae < bm AND rmse < br AS beats FROM s JOIN b USING (grp) WHERE model = 'recent'""")
def baseline_gate(spark, d):
    scored = validation.metrics(forecasts(spark, d), "y", "p", ["grp", "model"])
    out = validation.baseline_gate(scored, ["grp"], "model", ["expanding", "previous"])
    return rounded(out, "mae", "best_mae", to=3).select("grp", "model", "mae", "best_mae", "beats")


@query(f"""
WITH {BASELINES}, q AS (SELECT model, quantile_cont(y - p, 0.025) AS lo, quantile_cont(y - p, 0.975) AS hi FROM l GROUP BY model)
SELECT model, count(*) AS n, round(avg(CASE WHEN y BETWEEN greatest(p + lo, 0) AND p + hi THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM l JOIN q USING (model) GROUP BY model""")
def empirical_interval_coverage(spark, d):
    out = validation.empirical_intervals(forecasts(spark, d), "y", "p", ["model"])
    return out.groupBy("model").agg(F.count("*").alias("n"), r6(F.avg(F.col("covered").cast("double"))).alias("coverage"))


@query(f"""
WITH o AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mo, o_totalprice AS v FROM orders),
c AS (SELECT yr, mo, sum(v) AS s, count(v) AS n FROM o GROUP BY ALL),
k AS (SELECT yr, mo, s AS own_s, n AS own_n,
        coalesce((sum(s) OVER (PARTITION BY mo) - s) / nullif(sum(n) OVER (PARTITION BY mo) - n, 0),
                 (sum(s) OVER () - sum(s) OVER (PARTITION BY yr)) / nullif(sum(n) OVER () - sum(n) OVER (PARTITION BY yr), 0)) AS climatology FROM c)
SELECT o.yr, count(*) AS n, round(sqrt(avg((climatology - v) ** 2)), 2) AS rmse, round(avg(abs(climatology - v)), 2) AS mae
FROM o JOIN k USING (yr, mo) GROUP BY o.yr""")
def leave_group_out_climatology(spark, d):
    rows = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("yr"), F.month("o_orderdate").cast("long").alias("mo"), F.col("o_totalprice").alias("v"))
    out = validation.leave_group_out_mean(rows, "v", "yr", "mo")
    return rounded(validation.metrics(out, "v", "climatology", ["yr"]), "rmse", "mae", to=2).select("yr", "n", "rmse", "mae")


@query()
def leave_group_out_ridge(spark, d):
    rows = joined(spark, d).withColumn("yr", F.floor((F.col("m") - 1) / 12).cast("long"))
    return linear.leave_group_out_ridge(rows, ["x1", "x2", "x3"], "y", "yr", [0.1, 1.0, 10.0, 100.0, 1000.0])


@query()
def nested_ridge(spark, d):
    return linear.nested_ridge(joined(spark, d), ["x1", "x2", "x3"], "y", ["grp"], "m", [0.1, 1.0, 10.0, 100.0])


@query()
def shapiro_wilk(spark, d):
    return linear.shapiro_wilk(panel(spark, d), "y", ["grp"])


# -- domain audit, exposure, scenarios, classification, contracts


@query(f"""
WITH {ENV}, c AS (SELECT min(x1) a1, max(x1) b1, min(x2) a2, max(x2) b2, min(x3) a3, max(x3) b3 FROM env WHERE m < 1998 * 12),
f AS (SELECT m, greatest(a1 - x1, x1 - b1) / (b1 - a1) AS f1, greatest(a2 - x2, x2 - b2) / (b2 - a2) AS f2, greatest(a3 - x3, x3 - b3) / (b3 - a3) AS f3 FROM env, c),
g AS (SELECT m, list_filter(list_value(CASE WHEN f1 > 0 THEN 'x1' END, CASE WHEN f2 > 0 THEN 'x2' END, CASE WHEN f3 > 0 THEN 'x3' END), lambda z: z IS NOT NULL) AS l,
             greatest(f1, f2, f3) AS far FROM f)
SELECT m, array_to_string(l, ';') AS outside, CAST(len(l) AS BIGINT) AS n_outside, round(far, 6) AS distance,
       CASE WHEN far <= 0.05 THEN 'minor' WHEN far <= 0.2 THEN 'moderate' ELSE 'large' END AS severity FROM g WHERE far > 0""")
def extrapolation_audit(spark, d):
    e = environment(spark, d)
    return rounded(validation.domain_audit(e, e.where(F.col("m") < 1998 * 12), ["x1", "x2", "x3"], ["m"]), "distance")


#: Daily means in whole thousandths, so that window means are exact for any order of summation.
MILLI_DAYS = "days AS (SELECT CAST(o_orderdate AS DATE) AS d, CAST(round(round_even(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / count(*) / 100000.0, 3) * 1000) AS BIGINT) AS v FROM orders GROUP BY ALL)"


def milli_days(spark: SparkSession, d: str) -> DataFrame:
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / F.count("*") / 100000.0
    return table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.round(F.bround(cents, 3) * 1000).cast("long").alias("v"))


MILLI_MEAN = "CAST((({0}) * 20 + ({1})) // (({1}) * 2) AS DOUBLE) / 10000.0"


@query(f"""
WITH w(window_id, start_md, end_md) AS (VALUES {WINDOWS_SQL}), {MILLI_DAYS},
i AS (SELECT window_id, CAST(year(d) AS BIGINT) AS yr, d, v FROM days JOIN w ON month(d) * 100 + day(d) BETWEEN start_md AND end_md),
r AS (SELECT *, sum(v) OVER (PARTITION BY window_id, yr ORDER BY d ROWS 6 PRECEDING) AS v7, row_number() OVER (PARTITION BY window_id, yr ORDER BY d) AS k,
             row_number() OVER (PARTITION BY window_id, yr ORDER BY v DESC, d) AS best FROM i),
g AS (SELECT *, k - row_number() OVER (PARTITION BY window_id, yr, v >= 200000 ORDER BY d) AS run FROM r),
s AS (SELECT window_id, yr, max(c) AS spell FROM (SELECT window_id, yr, run, count(*) AS c FROM g WHERE v >= 200000 GROUP BY ALL) GROUP BY ALL)
SELECT g.window_id, g.yr, count(*) AS days, {MILLI_MEAN.format("sum(v)::BIGINT", "count(*)")} AS mean, max(v) / 1000.0 AS high, max(d) FILTER (WHERE best = 1) AS high_day,
       {MILLI_MEAN.format("(max(v7) FILTER (WHERE k >= 7))::BIGINT", "7")} AS high7, count(*) FILTER (WHERE v >= 200000) AS n200, coalesce(max(s.spell), 0) AS longest
FROM g LEFT JOIN s USING (window_id, yr) GROUP BY ALL""")
def exposure_table(spark, d):
    rows = relational.window_members(milli_days(spark, d), windows(spark), month_day(F.col("d"))).select("window_id", F.year("d").cast("long").alias("yr"), "d", "v")
    return timeseries.exposure(rows, "v", ["window_id", "yr"], "d", 200_000)


@query(f"""
WITH {JOINED}, f AS (SELECT grp, regr_slope(y, x2) AS b, regr_intercept(y, x2) AS a FROM joined GROUP BY grp),
q AS (SELECT grp, 'low' AS scenario, quantile_cont(x2, 0.1) AS x FROM joined GROUP BY grp
      UNION ALL SELECT grp, 'middle', quantile_cont(x2, 0.5) FROM joined GROUP BY grp UNION ALL SELECT grp, 'high', quantile_cont(x2, 0.9) FROM joined GROUP BY grp),
e AS (SELECT grp, quantile_cont(y - a - b * x2, 0.025) AS lo, quantile_cont(y - a - b * x2, 0.975) AS hi FROM joined JOIN f USING (grp) GROUP BY grp)
SELECT grp, scenario, CAST(yr AS BIGINT) AS yr, round(greatest(a + b * x, 0), 2) AS projected, round(greatest(a + b * x + lo, 0), 2) AS lower, round(greatest(a + b * x + hi, 0), 2) AS upper
FROM f JOIN q USING (grp) JOIN e USING (grp), (SELECT unnest(range(2026, 2041)) AS yr)""")
def scenario_quantiles(spark, d):
    fits = linear.simple_ols(joined(spark, d), "x2", "y", ["grp"])
    cells = rankstats.quantiles(fits, "x2", ["grp"], {"low": 0.1, "middle": 0.5, "high": 0.9}).drop("n")
    band = rankstats.quantiles(fits, "residual", ["grp"], {"lo": 0.025, "hi": 0.975}).drop("n")
    each = fits.groupBy("grp").agg(F.max("slope").alias("b"), F.max("intercept").alias("a")).join(cells, "grp").join(band, "grp")
    long = each.unpivot(["grp", "a", "b", "lo", "hi"], ["low", "middle", "high"], "scenario", "x").withColumn("yr", F.explode(F.sequence(F.lit(2026).cast("long"), F.lit(2040).cast("long"))))
    at = F.col("a") + F.col("b") * F.col("x")
    floor = lambda c: F.round(F.greatest(c, F.lit(0.0)), 2)
    return long.select("grp", "scenario", "yr", floor(at).alias("projected"), floor(at + F.col("lo")).alias("lower"), floor(at + F.col("hi")).alias("upper"))


@query(f"""
WITH {JOINED}, a AS ({ranks("grp", "x1", "y", "joined")}), b AS ({ranks("grp", "x3", "y", "joined")}),
ra AS (SELECT grp, {corr("rx", "ry")} AS r1 FROM a GROUP BY grp), rb AS (SELECT grp, {corr("rx", "ry")} AS r3 FROM b GROUP BY grp)
SELECT grp, round(r1, 6) AS r1, round(r3, 6) AS r3,
       CASE WHEN r1 > 0 AND abs(r1) > 0.1 AND sign(r1) = sign(r3) THEN 'supported' WHEN r1 > 0 AND abs(r1) > 0.1 THEN 'fragile'
            WHEN r1 > 0 THEN 'direction only' ELSE 'not supported' END AS status
FROM ra JOIN rb USING (grp)""")
def support_classification(spark, d):
    rows = joined(spark, d)
    both = rankstats.spearman(rows, "x1", "y", ["grp"]).select("grp", F.col("rho").alias("r1")).join(rankstats.spearman(rows, "x3", "y", ["grp"]).select("grp", F.col("rho").alias("r3")), "grp")
    status = validation.support(F.col("r1") > 0, F.abs("r1") > 0.1, F.signum("r1") == F.signum("r3"))
    return both.select("grp", r6("r1").alias("r1"), r6("r3").alias("r3"), status.alias("status"))


@query("""
SELECT 'amount_positive' AS check_id, 'range' AS category, count(*) AS "rows", count(*) FILTER (WHERE NOT o_totalprice > 0) AS failures, count(*) FILTER (WHERE NOT o_totalprice > 0) = 0 AS passed FROM orders
UNION ALL SELECT 'known_status', 'domain', count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) = 0 FROM orders
UNION ALL SELECT 'year_range', 'range', count(*), count(*) FILTER (WHERE year(o_orderdate) NOT BETWEEN 1995 AND 2001), count(*) FILTER (WHERE year(o_orderdate) NOT BETWEEN 1995 AND 2001) = 0 FROM orders
UNION ALL SELECT 'cents', 'identity', count(*), count(*) FILTER (WHERE abs(o_totalprice * 100 - round(o_totalprice * 100)) > 1e-6 + 1e-9 * abs(round(o_totalprice * 100))), count(*) FILTER (WHERE abs(o_totalprice * 100 - round(o_totalprice * 100)) > 1e-6 + 1e-9 * abs(round(o_totalprice * 100))) = 0 FROM orders""")
def quality_gate(spark, d):
    cents = F.col("o_totalprice") * 100
    checks = {
        "amount_positive": ("range", F.col("o_totalprice") > 0),
        "known_status": ("domain", F.col("o_orderstatus").isin("F", "O")),
        "year_range": ("range", F.year("o_orderdate").between(1995, 2001)),
        "cents": ("identity", close(cents, F.round(cents), 1e-9, 1e-6)),
    }
    return contracts.run_checks(table(spark, d, "orders"), checks)


# -- resampling


POSITIONED = """pos AS (SELECT grp, m, x1, y, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM joined)"""


@query(f"""
WITH {JOINED}, {POSITIONED}, s AS (SELECT p.grp, k.rep, {index_sql("k.rep", "p.pos", 11, "p.n")} AS at FROM pos p, (SELECT unnest(range(0, 200)) AS rep) k),
b AS (SELECT s.grp, s.rep, p.x1, p.y FROM s JOIN pos p ON p.grp = s.grp AND p.pos = s.at), r AS ({ranks("grp, rep", "x1", "y", "b")}),
c AS (SELECT grp, rep, {corr("rx", "ry")} AS rho FROM r GROUP BY ALL)
SELECT grp, count(rho) AS reps, round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high FROM c GROUP BY grp""")
def hash_bootstrap_ci(spark, d):
    return rounded(resample.bootstrap_rho(joined(spark, d), "x1", "y", ["grp"], ["m"], 200, 11), "low", "high")


@query(f"""
WITH {JOINED}, {POSITIONED}, s AS (SELECT p.grp, k.rep, {index_sql("k.rep", "p.pos // 3", 23, "greatest(p.n - 2, 1)")} + p.pos % 3 AS at FROM pos p, (SELECT unnest(range(0, 200)) AS rep) k),
b AS (SELECT s.grp, s.rep, p.x1, p.y FROM s JOIN pos p ON p.grp = s.grp AND p.pos = s.at), r AS ({ranks("grp, rep", "x1", "y", "b")}),
c AS (SELECT grp, rep, {corr("rx", "ry")} AS rho FROM r GROUP BY ALL)
SELECT grp, count(rho) AS reps, round(quantile_cont(rho, 0.025), 6) AS low, round(quantile_cont(rho, 0.975), 6) AS high FROM c GROUP BY grp""")
def block_bootstrap_ci(spark, d):
    return rounded(resample.bootstrap_rho(joined(spark, d), "x1", "y", ["grp"], ["m"], 200, 23, block=3), "low", "high")


@query(f"""
WITH {JOINED}, r AS ({ranks("grp", "x1", "y", "joined", ", m")}),
p AS (SELECT grp, rx, ry, row_number() OVER (PARTITION BY grp ORDER BY m) - 1 AS pos FROM r),
o AS (SELECT grp, {corr("rx", "ry")} AS observed FROM p GROUP BY grp),
h AS (SELECT p.grp, k.rep, p.rx, row_number() OVER (PARTITION BY p.grp, k.rep ORDER BY {index_sql("k.rep", "p.pos", 5, "2147483647")}, p.pos) - 1 AS at FROM p, (SELECT unnest(range(0, 200)) AS rep) k),
c AS (SELECT h.grp, h.rep, {corr("h.rx", "p.ry")} AS rho FROM h JOIN p ON p.grp = h.grp AND p.pos = h.at GROUP BY ALL)
SELECT c.grp, round(max(observed), 6) AS rho, count(*) FILTER (WHERE abs(c.rho) >= abs(observed) - 1e-12) AS extreme,
       round((count(*) FILTER (WHERE abs(c.rho) >= abs(observed) - 1e-12) + 1) / 201.0, 6)::DOUBLE AS p FROM c JOIN o USING (grp) GROUP BY c.grp""")
def hash_permutation_p(spark, d):
    return rounded(resample.permutation_p(joined(spark, d), "x1", "y", ["grp"], ["m"], 200, 5), "rho", "p")


@query(f"""
WITH {BASELINES}, p AS (SELECT model, y - p AS e, row_number() OVER (PARTITION BY model ORDER BY grp, m) - 1 AS pos, count(*) OVER (PARTITION BY model) AS n FROM l),
sm AS (SELECT p.model, k.rep, {index_sql("k.rep", "p.pos", 31, "p.n")} AS at FROM p, (SELECT unnest(range(0, 200)) AS rep) k),
b AS (SELECT sm.model, sm.rep, avg(abs(p.e)) AS mae FROM sm JOIN p ON p.model = sm.model AND p.pos = sm.at GROUP BY ALL)
SELECT model, count(*) AS reps, round(quantile_cont(mae, 0.025), 3) AS low, round(quantile_cont(mae, 0.975), 3) AS high FROM b GROUP BY model""")
def error_bootstrap_ci(spark, d):
    errors = forecasts(spark, d).select("model", "grp", "m", (F.col("y") - F.col("p")).alias("e"))
    maes = resample.bootstrap_errors(errors, "e", ["model"], ["grp", "m"], 200, 31)
    return rounded(resample.interval(maes, "mae", ["model"]), "low", "high", to=3)
