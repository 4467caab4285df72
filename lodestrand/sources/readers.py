"""Readers of raw snapshots: typed CSV, preamble CSV, commented and headed text tables, nested JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import sentinel_to_null
from ..operators.contracts import not_empty, require_columns


BOM = "\ufeff"


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of a CSV file, without a byte order mark."""
    first = spark.read.text(path).limit(1).collect()  # one line
    if not first:
        raise ValueError(f"{path} is empty")
    parts = spark.range(1).select(F.from_csv(F.lit(first[0].value.lstrip(BOM)), F.lit(", ".join(f"c{i} string" for i in range(first[0].value.count(",") + 1)))).alias("r")).first().r
    return [str(c).strip().strip(BOM).strip('"') for c in parts if c is not None]


def csv_table(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, where: Column | None = None, filled: bool = False, last_of: list[str] | None = None) -> DataFrame:
    """Header CSV with a fixed schema, its columns found by the names in the file's header.

    A byte order mark is tolerated and extra columns are left out; a required column (all of the
    schema, if none are named) that the header lacks raises, as do malformed rows.  In a folder, every file's own
    header must be the first one's: each task checks the files it reads, and one with other columns or
    another order raises.  ``where`` chooses rows (one station, say); with ``filled``, no row left raises.
    ``last_of`` are keys of which the last row stays, in the order of file names and of lines.
    """
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(schema).fields}
    names = header_of(spark, path)
    missing = [c for c in (required or list(kinds)) if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    given = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)
    cells = [F.col(f"`{n}`") if n in names else F.lit(None).cast(k).alias(n) for n, k in kinds.items()]
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("__line")
    df = spark.read.csv(path, schema=given, header=True, mode="FAILFAST", enforceSchema=False)
    df = df.select(*cells, *([line] if last_of else []))
    df = df if where is None else df.where(where)
    if last_of:
        df = df.groupBy(*last_of).agg(F.max_by(F.struct(*[n for n in kinds if n not in last_of]), "__line").alias("__row")).select(*last_of, "__row.*").select(*kinds)
    return not_empty(df, path) if filled else df


def csv_inferred(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """Header CSV whose types are inferred (a second pass over the file), with its required columns checked."""
    return require_columns(spark.read.csv(path, header=True, inferSchema=True), required or [])


def preamble_csv(spark: SparkSession, path: str, first: str, schema: str) -> DataFrame:
    """CSV after a preamble: the rows behind the header line, which is the first one to start with ``first``.

    The header's place comes from the lines' positions in the file (a snapshot is one file of one split);
    a file without one raises, as do rows that do not fit the schema.  Blank values are null.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
    start = lines.where(F.startswith(F.ltrim(F.translate("value", BOM, "")), F.lit(first))).agg(F.min("at").alias("header"))
    if start.first().header is None:
        raise ValueError(f"no header that starts with {first!r} in {path}")
    rows = lines.join(F.broadcast(start)).where((F.col("at") > F.col("header")) & (F.trim("value") != ""))  # one row
    return rows.select(F.from_csv("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def text_table(spark: SparkSession, path: str, names: dict[str, str], header: str | None = None) -> DataFrame:
    """Columns separated by blanks; # comments, blank lines and a header line (by its first word) go."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*#") & (F.trim("value") != "")).select(parts.alias("p"))
    if header:
        rows = rows.where(F.col("p")[0] != header)
    return rows.select(*[F.col("p")[i].cast(t).alias(n) for i, (n, t) in enumerate(names.items())])


SERIES_SCHEMA = (
    "value struct<timeSeries: array<struct<variable: struct<variableCode: array<struct<value: string>>>, "
    "values: array<struct<value: array<struct<value: string, qualifiers: array<string>, dateTime: string>>>>>>>"
)


def nested_series(spark: SparkSession, path: str, code: str, missing: float = -999000.0) -> DataFrame:
    """Daily values of the first series whose variable code contains ``code``: date, value, qualifiers."""
    docs = spark.read.schema(SERIES_SCHEMA).json(path, multiLine=True)
    chosen = F.filter("value.timeSeries", lambda s: F.exists(s["variable"]["variableCode"], lambda c: F.contains(c["value"], F.lit(code))))
    points = docs.select(F.explode(F.get(F.get(chosen, 0)["values"], 0)["value"]).alias("v"))
    value = F.col("v.value").cast("double")
    out = points.select(F.to_date(F.substring("v.dateTime", 1, 10)).alias("date"), sentinel_to_null(value, below=missing).alias("value"), F.array_join("v.qualifiers", ";").alias("qualifiers"))
    return out.where("value IS NOT NULL")


def sentinel_csv(spark: SparkSession, path: str, key: str = "Date", sentinel: float = -9999.0) -> DataFrame:
    """A key and one value: the first column of another name, in which the sentinel is null."""
    names = header_of(spark, path)
    value = next((n for n in names if n != key), None)
    if key not in names or value is None:
        raise ValueError(f"{path} needs {key} and a value column")
    df = csv_table(spark, path, f"`{key}` date, `{value}` double")
    return df.select(key, sentinel_to_null(F.col(f"`{value}`"), sentinel).alias("value"))


def json_document(spark: SparkSession, path: str) -> dict:
    """One JSON document, such as a gate or a manifest."""
    lines = spark.read.text(path, wholetext=True).collect()  # one small file
    if len(lines) != 1:
        raise ValueError(f"{path} is not one document")
    return json.loads(lines[0].value.lstrip(BOM))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Upper-case SHA-256 of every file below a path (a file is one row)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.upper(F.sha2("content", 256)).alias("sha256"))
