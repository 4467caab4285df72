"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_checkpoints(spark: SparkSession) -> str:
    """The checkpoint folder: the cluster's ``spark.checkpoint.dir``; one of our own only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write to a table of its own in the shared folder and read that.

    For loops: a checkpoint hands the constraints of its plan on, and those of round upon round make planning
    slower and slower; a table hands on nothing.
    """
    path = f"{shared_checkpoints(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column of ``taken`` has it (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def named(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


#: A key with no more rows than this is never treated as hot.
HOT_ROWS = 1000


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame | None:
    """The keys of ``counts`` (keys, n) with over a thousandth of ``total`` rows: 999 at most; None without any."""
    if total <= HOT_ROWS:
        return None
    found = counts.where(F.col("n") > max(HOT_ROWS, total // 1000)).select(*keys)
    rows = found.collect()
    return counts.sparkSession.createDataFrame(rows, found.schema) if rows else None


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Inner or left join with a table that has each key once.

    The rows of ``hot`` keys (see ``hot_keys``; at most 999, so the broadcast is bounded) stay where they are; the
    others shuffle.  ``left`` is read twice when there are hot keys.
    """
    if hot is None:
        return left.join(right, keys, how)
    few = F.broadcast(hot)
    warm = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    return warm.unionByName(left.join(few, keys, "left_anti").join(right, keys, how))


def ranges_for(spark: SparkSession, rows: int, each: int = 250_000) -> int:
    """Partitions of at most about ``each`` small rows, no fewer than a shuffle has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def placed(rows: DataFrame, key: str, order: list[str], ranges: int) -> DataFrame:
    """Rows with their place within their key (``at``, from 0, in ``order``, nulls first) and the key's rows (``n``).

    Rows are sorted over ranges, so a key with any share of them is numbered by many tasks: a range counts its rows of
    each key, and a key's places go on from range to range (a row per key and range is all that is summed).
    ``rows`` must be a stored table, of which ``order`` tells all rows apart, and have no other column at, n or __seq.
    """
    ordered = rows.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order)
    ordered = stored(ordered.withColumn("__seq", F.monotonically_increasing_id()))
    part = F.shiftright("__seq", 33).alias("__part")
    spans = ordered.groupBy(key, part).agg(F.min("__seq").alias("__low"), F.count("*").alias("__rows"))
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum("__rows").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(key, "__part", (before - F.col("__low")).alias("__shift"), F.sum("__rows").over(own).alias("n"))
    found = ordered.withColumn("__part", part).join(spans, [key, "__part"])
    return found.select(*rows.columns, (F.col("__seq") + F.col("__shift")).alias("at"), "n")


def placed_in_order(rows: DataFrame, key: str, order: list[str], ranges: int) -> DataFrame:
    """As ``placed``, without ``n``, for wide rows: they shuffle once, into their ranges, where a key's rows are counted as they pass.

    Only a range's first key can go on from earlier ranges, so what is joined has a row per range at most.  ``rows`` may
    be a scan with narrow steps; ``key`` is a string and never null.
    """
    at = rows.columns.index(key)

    def count(batches):
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(at).to_numpy(zero_copy_only=False)
            starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1]
            sizes = np.diff(np.r_[starts, len(keys)])
            place = np.arange(len(keys)) - np.repeat(starts, sizes)
            if keys[0] == last:
                place[: sizes[0]] += n
            last, n = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place, pa.int64())], [*b.schema.names, "__place"])

    dealt = rows.repartitionByRange(ranges, key, *order).sortWithinPartitions(key, *order).withColumn("__part", F.spark_partition_id())
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    ordered = stored(dealt.mapInArrow(count, kinds + ", __place long"))
    own = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = ordered.groupBy(key, "__part").agg(F.count("*").alias("__rows"))
    heads = spans.select(F.col(key).alias("__head"), "__part", F.sum("__rows").over(own).alias("__before")).where("__before > 0")
    found = ordered.join(F.broadcast(heads), "__part", "left")  # a row per range
    ahead = F.when(F.col(key) == F.col("__head"), F.col("__before")).otherwise(0)
    return found.select(*rows.columns, (F.col("__place") + ahead).alias("at"))


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text, bit by bit."""
    bits = ", ".join(["-1"] * 8)
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, {bits}]))"
    turn = "CASE WHEN o >= 0 THEN xor(a, o) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, o: {turn}), 4294967295)"


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII strings take the faster built-in."""
    plain = F.length(column) == F.octet_length(column)
    return F.when(plain, F.lower(column)).otherwise(F.translate(column, UPPER, UPPER.lower()))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding to str."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


#: Texts pass through a Python worker in slices of up to about so many bytes; a longer one by itself.
SLICE_BYTES = 1_000_000


def by_bytes(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of one column, so that neither a worker nor Spark, which takes back
    what is made of each slice, holds a whole batch of texts; no slice is empty."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // most)) + 1
    for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
        if a < b:
            yield batch.slice(a, b - a)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
