"""Long series over several tasks give the rows of one task."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import ranges, rankstats, timeseries


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    data = [(g, i, None if rng.random() < 0.35 else float(rng.randrange(9)), "x") for g, n in (("a", 97), ("b", 20), (None, 31), ("c", 1)) for i in range(n)]
    data += [("d", i, None if 5 < i < 45 else float(i), "x") for i in range(60)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, i long, v double, more string")


def same(a, b):
    assert a.columns == b.columns
    cells = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert cells(a) == cells(b)


@pytest.mark.parametrize("block", [1, 4, 10, 1000])
def test_blocks_change_nothing(rows, block):
    for width, full in ((7, False), (3, True)):
        same(ranges.trailing_mean(rows, "v", width, ["g"], ["i"], "m", full, block), rows.withColumn("m", timeseries.trailing_mean("v", width, ["g"], ["i"], full)))
    same(ranges.expanding_mean(rows, "v", ["g"], ["i"], "m", block), rows.withColumn("m", timeseries.expanding_mean("v", ["g"], ["i"])))
    same(ranges.longest_run(rows, F.col("v") >= 3, ["g"], ["i"], block), timeseries.longest_run(rows, F.col("v") >= 3, ["g"], ["i"]))
    same(ranges.longest_run(rows, F.col("v").isNull(), ["g"], ["i"], block), timeseries.longest_run(rows, F.col("v").isNull(), ["g"], ["i"]))
    same(ranges.fill_short_gaps(rows, "v", "i", ["g"], 2, block=block), timeseries.fill_short_gaps(rows, "v", "i", ["g"], 2))


@pytest.mark.parametrize("block", [3, 25])
def test_kendall_of_long_series(rows, block):
    ties = rows.withColumn("t", F.expr("i div 2"))
    same(ranges.kendall(ties, "t", "v", ["g"], block), rankstats.kendall(ties, "t", "v", ["g"]))
    same(ranges.kendall(rows, "i", "v", [], block), rankstats.kendall(rows, "i", "v", []))


def test_tasks_scale_with_the_series(spark):
    """One series of 100,000 rows in blocks of 5,000: no task sees more than a few blocks of it."""
    df = spark.range(100_000).select(F.lit("a").alias("g"), "id", (F.col("id") % 1000 / 10).alias("v"))
    out = ranges.trailing_mean(df, "v", 7, ["g"], ["id"], "m", block=5000)
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 60_000
    assert out.where("id = 50003").first().m == pytest.approx(sum((50003 - k) % 1000 / 10 for k in range(7)) / 7)
    placed = ranges.numbered(df, ["g"], ["id"], 5000)
    assert placed.where("__place <> id OR __n <> 100000").isEmpty()
