"""The base frames of the registered queries, from the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import months


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cent_mean(value: str):
    """Mean of an amount in whole cents, summed as integers: exact, and the same for any partitioning."""
    return F.sum(F.round(F.col(value) * 100).cast("long")).cast("double") / F.count(value) / 100.0


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly response by order priority: grp, m, y, n."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("grp"), months(F.col("o_orderdate")).alias("m")).agg(cent_mean("o_totalprice").alias("y"), F.count("*").alias("n"))


def environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly environment from the line items: m, x1, x2, x3."""
    items = table(spark, sf_dir, "lineitem")
    cells = {"x1": "l_quantity", "x2": "l_discount", "x3": "l_extendedprice"}
    return items.groupBy(months(F.col("l_shipdate")).alias("m")).agg(*[cent_mean(c).alias(n) for n, c in cells.items()])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series of the events: event_type, d, v, n."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(cent_mean("value").alias("v"), F.count("*").alias("n"))


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the environment of the month before."""
    e = environment(spark, sf_dir).withColumn("m", F.col("m") + 1)
    return panel(spark, sf_dir).join(e, "m")


def cent_mean_sql(value: str) -> str:
    return f"CAST(sum(CAST(round({value} * 100) AS BIGINT)) AS DOUBLE) / count({value}) / 100.0"


PANEL = f"""panel AS (
  SELECT o_orderpriority AS grp, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m,
         {cent_mean_sql('o_totalprice')} AS y, count(*) AS n
  FROM orders GROUP BY ALL)"""
ENV = f"""env AS (
  SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS m, {cent_mean_sql('l_quantity')} AS x1,
         {cent_mean_sql('l_discount')} AS x2, {cent_mean_sql('l_extendedprice')} AS x3
  FROM lineitem GROUP BY ALL)"""
DAILY = f"""daily AS (
  SELECT event_type, CAST(ts AS DATE) AS d, {cent_mean_sql('value')} AS v, count(*) AS n FROM events GROUP BY ALL)"""
JOINED = f"""{PANEL}, {ENV}, joined AS (
  SELECT p.*, e.x1, e.x2, e.x3 FROM panel p JOIN env e ON e.m = p.m - 1)"""


def ranks(by: str, x: str, y: str, source: str, extra: str = "") -> str:
    """SQL of midranks rx and ry within groups."""
    part = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"SELECT {by}{extra}, {part(x)} AS rx, {part(y)} AS ry FROM {source}"


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def simpson_sql(f: str, high: str, steps: int = 600) -> str:
    """SQL of the integral of f (an expression in u) from 0 to ``high``."""
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({high}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {f.replace('#', f'(({high}) * k / {steps}.0)')})))"


def t_tail_sql(t: str, df: str) -> str:
    """SQL of Student's two-sided tail probability for whole degrees of freedom."""
    f = f"pow(sin(#), ({df}) - 1)"
    return f"({simpson_sql(f, f'atan2(sqrt(({df})::DOUBLE), abs({t}))')} / {simpson_sql(f, 'pi() / 2')})"


def normal_tail_sql(z: str) -> str:
    """SQL of a normal value's two-sided tail probability."""
    return f"(1 - sqrt(2 / pi()) * {simpson_sql('exp(-# * # / 2)', f'least(abs({z}), 12.0)')})"


def t_quantile_sql(df: str, z: float = 1.959963984540054) -> str:
    """SQL of the t with 5 % in both tails, by the expansion around the normal quantile (for dozens of degrees of freedom)."""
    powers = [z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join(f"{c!r} / pow({df}, {i})" for i, c in enumerate(powers)) + ")"


def uniform_sql(rep: str, pos: str, seed: int, a: int, b: int, c: int, extra: int) -> str:
    w = f"((({rep}) * {a} + ({pos}) * {b} + {seed + extra}) % 2147483647)"
    return f"((((({w} * {w}) % 2147483647) * {c} + {w}) % 2147483647 + 1) / 2147483648.0)"


def normal_sql(rep: str, pos: str, seed: int) -> str:
    """SQL of functions.columns.hashed_normal."""
    u, v = uniform_sql(rep, pos, seed, 7919, 104729, 48271, 0), uniform_sql(rep, pos, seed, 15485863, 32452843, 69621, 12345)
    return f"(sqrt(-2 * ln({u})) * cos({v} * 2 * pi()))"


def index_sql(rep: str, pos: str, seed: int, n: str) -> str:
    """SQL of functions.columns.hashed_index."""
    x = f"((({rep})::BIGINT * 7919 + ({pos}) * 104729 + {seed}) % 2147483647)"
    for factor, shift in ((48271, 15), (69621, 13)):
        y = f"((({x} * {x}) % 2147483647 * {factor} + {x}) % 2147483647)"
        x = f"xor({y}, {y} >> {shift})"
    return f"{x} % ({n})"
