"""Operators over ordered series of any length: one series is many tasks.

Rows are sorted over ranges and numbered (``numbered``), a series is cut into blocks of consecutive places, and blocks
exchange what the operator needs across their edges: a few edge rows, partial sums, the last known value, or counts.  All
give the same rows as their namesakes in ``timeseries`` and ``rankstats``, which keep a series in one task.  Columns
that start with two underscores are theirs.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.ranks import dense, inversions
from .linear import keys_of
from .rankstats import KENDALL, kendall_row

#: Rows of a series that one task takes.
BLOCK = 1_000_000
#: Blocks of one series whose pairs are counted on a grid.
GRID = 1000


def staged(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder (``spark.checkpoint.dir``; one of our own only in local mode) and read that."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoints-")
        sc.setCheckpointDir(folder)
    path = f"{folder}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which null equals null (a join on equality for Spark); the right side's keys go."""
    renamed = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def numbered(df: DataFrame, by: list[str], order: list[str], each: int = BLOCK) -> DataFrame:
    """Rows with their place in their series (``__place``, from 0) and its length (``__n``).

    A range counts its rows of each series, and places go on from range to range: the only sum over a series is
    over a row per range.  The sorted rows are written once, so every use sees the same places.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // each))
    keys = [*by, *order]
    ordered = staged(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("__seq", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("__part", F.shiftright("__seq", 33))
    own = Window.partitionBy(*by)
    spans = ordered.groupBy(*by, "__part").agg(F.min("__seq").alias("__low"), F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*by, "__part", (before - F.col("__low")).alias("__shift"), F.sum("__rows").over(own).alias("__n"))
    return null_safe(ordered, spans, [*by, "__part"]).select(*df.columns, (F.col("__seq") + F.col("__shift")).alias("__place"), "__n")


def _block(size: int) -> Column:
    return F.expr(f"`__place` div {size}").alias("__block")


def trailing_mean(df: DataFrame, value: str, width: int, by: list[str], order: list[str], out: str, full: bool = False, block: int = BLOCK) -> DataFrame:
    """Rows with the mean of the last ``width`` rows (at the head of those seen, or null if ``full``).

    A block gets the last ``width`` - 1 rows of the one before it.
    """
    size = max(block, width)
    rows = numbered(df, by, order, size).withColumn("__own", _block(size))
    edge = F.pmod("__place", F.lit(size)) > size - width
    sent = rows.withColumn("__block", F.explode(F.when(edge, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))))
    mean = F.avg(value).over(Window.partitionBy(*by, "__block").orderBy("__place").rowsBetween(1 - width, 0))
    shown = F.when(F.col("__place") >= width - 1, F.col("__mean")) if full else F.col("__mean")
    return sent.withColumn("__mean", mean).where("__block = __own").select(*df.columns, shown.alias(out))


def expanding_mean(df: DataFrame, value: str, by: list[str], order: list[str], out: str, block: int = BLOCK) -> DataFrame:
    """Rows with the mean of all earlier rows: blocks' sums are added up, rows go on from their block's."""
    rows = numbered(df, by, order, block).withColumn("__block", _block(block))
    sums = rows.groupBy(*by, "__block").agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*by, "__block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("__s", "__c")])
    inner = Window.partitionBy(*by, "__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    full = null_safe(rows, carried, [*by, "__block"])
    total, count = F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("__s0"), F.count(value).over(inner) + F.col("__c0")
    return full.select(*df.columns, F.try_divide(total.cast("double"), count).alias(out))


def longest_run(df: DataFrame, test: Column, by: list[str], order: list[str], block: int = BLOCK) -> DataFrame:
    """Length of the longest run of rows that pass, 0 if none does: runs within blocks, and chains of runs that touch edges."""
    rows = numbered(df, by, order, block).select(*by, "__place", _block(block), F.coalesce(test, F.lit(False)).alias("__t"))
    own, same = (Window.partitionBy(*by, "__block", *extra).orderBy("__place") for extra in ([], ["__t"]))
    runs = rows.withColumn("__run", F.row_number().over(own) - F.row_number().over(same)).where("__t")
    runs = runs.groupBy(*by, "__block", "__run").agg(F.min("__place").alias("__first"), F.max("__place").alias("__last"))
    edge = (F.pmod("__first", F.lit(block)) == 0) | (F.pmod("__last", F.lit(block)) == block - 1)
    # At most two runs of a block touch its edges: they are chained over a row or two per block.
    chained = runs.where(edge).withColumn("__new", F.when(F.col("__first") == F.lag("__last").over(Window.partitionBy(*by).orderBy("__first")) + 1, 0).otherwise(1))
    chained = chained.withColumn("__chain", F.sum("__new").over(Window.partitionBy(*by).orderBy("__first")))
    lengths = chained.groupBy(*by, "__chain").agg((F.max("__last") - F.min("__first") + 1).alias("__length")).select(*by, "__length")
    inner = runs.where(~edge).select(*by, (F.col("__last") - F.col("__first") + 1).alias("__length"))
    none = rows.select(*by).distinct().withColumn("__length", F.lit(0).cast("long"))
    return inner.unionByName(lengths).unionByName(none).groupBy(*by).agg(F.max("__length").cast("long").alias("longest"))


def fill_short_gaps(df: DataFrame, value: str, position: str, by: list[str], most: int = 3, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Linear interpolation of inner gaps of at most ``most`` rows (``filled``, ``was_filled``); what is left stays null, or raises if ``strict``.

    Blocks hand their last and first known value on, over any number of blocks without one.
    """
    rows = numbered(df, by, [position], block).withColumn("__block", _block(block)).withColumn("__known", F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("p"), F.col(value).cast("double").alias("v"))))
    ends = rows.groupBy(*by, "__block").agg(F.max_by("__known", F.when(F.col("__known").isNotNull(), F.col("__place"))).alias("__high"), F.min_by("__known", F.when(F.col("__known").isNotNull(), F.col("__place"))).alias("__lower"))
    chain = Window.partitionBy(*by).orderBy("__block")
    carried = ends.select(*by, "__block", F.last("__high", True).over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"), F.first("__lower", True).over(chain.rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    own = Window.partitionBy(*by, "__block").orderBy("__place")
    full = null_safe(rows, carried, [*by, "__block"])
    before = F.coalesce(F.last("__known", True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__earlier"))
    after = F.coalesce(F.first("__known", True).over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("__later"))
    out = full.select(*df.columns, before.alias("__a"), after.alias("__b"))
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * (F.col(position) - F.col("__a.p")) / (F.col("__b.p") - F.col("__a.p"))
    short = F.col(value).isNull() & (F.col("__b.p") - F.col("__a.p") - 1 <= most)
    filled = F.coalesce(F.col(value), F.when(short, line))
    if strict:
        filled = F.coalesce(filled, F.raise_error(F.lit("a gap is left")).cast("double"))
    return out.select(*df.columns, filled.alias("filled"), F.coalesce(short, F.lit(False)).alias("was_filled"))


def kendall(df: DataFrame, t: str, v: str, by: list[str], block: int = BLOCK) -> DataFrame:
    """``rankstats.kendall`` for series of any length: n, s, n0, ties, tau.

    Rows get their places in the order of time and in the order of values; S is what the inversions between the two
    orders leave.  Inversions are counted within blocks of time, within blocks of value, and between both on the grid of
    the blocks' counts (``GRID`` x ``GRID`` cells a series at most).
    """
    rows = df.where(finite(F.col(t)) & finite(F.col(v))).select(*by, F.col(t).cast("double").alias("__t"), F.col(v).cast("double").alias("__v"))
    timed = numbered(rows, by, ["__t", "__v"], block).withColumnRenamed("__place", "__q").drop("__n")
    both = numbered(timed, by, ["__v", "__q"], block).withColumnRenamed("__place", "__p")
    size = F.greatest(F.lit(block).cast("long"), F.ceil(F.col("__n") / GRID).cast("long"))
    cells = staged(both.select(*by, "__q", "__p", "__n", F.floor(F.col("__q") / size).alias("__bq"), F.floor(F.col("__p") / size).alias("__bp")))
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)

    def in_time(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__q")
        return pd.DataFrame([(*key[:-1], inversions(dense(frame["__p"].to_numpy())))], columns=[*by, "d"])

    def in_value(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__q")
        every = inversions(dense(frame["__p"].to_numpy()))
        same = sum(inversions(dense(g["__p"].to_numpy())) for _, g in frame.groupby("__bq"))
        return pd.DataFrame([(*key[:-1], every - same)], columns=[*by, "d"])

    parts = cells.groupBy(*by, "__bq").applyInPandas(in_time, kinds + "d long").unionByName(cells.groupBy(*by, "__bp").applyInPandas(in_value, kinds + "d long"))
    counts = cells.groupBy(*by, "__bq", "__bp").agg(F.count("*").alias("__h"))
    sides = cells.groupBy(*by).agg(F.max("__n").alias("__n"), F.max("__bq").alias("__top"))
    grid = sides.select(*by, "__top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__top"))).alias("__bq")).withColumn("__bp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__top"))))
    dense_grid = null_safe(grid.drop("__top"), counts, [*by, "__bq", "__bp"], "left").withColumn("__h", F.coalesce("__h", F.lit(0)))
    earlier = F.coalesce(F.sum("__h").over(Window.partitionBy(*by, "__bp").orderBy("__bq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    higher = F.coalesce(F.sum("__f").over(Window.partitionBy(*by, "__bq").orderBy(F.desc("__bp")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    across = dense_grid.withColumn("__f", earlier).withColumn("__g", higher).groupBy(*by).agg(F.sum(F.col("__h") * F.col("__g")).alias("d"))
    falling = parts.unionByName(across).groupBy(*by).agg(F.sum("d").alias("__d"))

    def tied(columns: list[str], name: str) -> DataFrame:
        return rows.groupBy(*by, *columns).agg(F.count("*").alias("__k")).groupBy(*by).agg(F.sum(F.expr("`__k` * (`__k` - 1) div 2")).alias(name))

    out = sides.drop("__top")
    for table in (falling, tied(["__t"], "__tt"), tied(["__v"], "__tv"), tied(["__t", "__v"], "__tb")):
        out = null_safe(out, table, by) if by else out.crossJoin(table)  # one row each

    def finish(frames):
        for frame in frames:
            found = []
            for key, n, d, tt, tv, tb in zip(keys_of(frame, by), frame["__n"], frame["__d"], frame["__tt"], frame["__tv"], frame["__tb"], strict=True):
                n, d, tt, tv, tb = map(int, (n, d, tt, tv, tb))
                found.append((*key, *kendall_row(n, n * (n - 1) // 2 - tt - tv + tb - 2 * d, tt, tv)))
            yield pd.DataFrame(found, columns=[*by, *[c.split()[0] for c in KENDALL.split(", ")]]).astype({c: np.int64 for c in ("n", "s", "n0", "ties")})

    return out.mapInPandas(finish, kinds + KENDALL)
