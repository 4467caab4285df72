"""Sinks: CSV and JSON files that appear whole, and packages of tables that are complete when they exist.

Everything is written to a staging folder beside the target and renamed, through Hadoop's file systems.
"""

from __future__ import annotations

import json
import platform
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import CrossChecks, RowChecks, TotalChecks, check_tables
from .readers import BOM, file_digests, json_document


def formatted(df: DataFrame, pattern: str = "%.10g", missing: str | None = None) -> DataFrame:
    """Doubles as text of a fixed pattern (``missing`` for null and NaN), for CSV that compares byte by byte."""
    kinds = dict(df.dtypes)

    def text(c: str):
        shown = F.when(F.col(c).isNotNull() & ~F.isnan(c), F.format_string(pattern, c))
        return (shown if missing is None else shown.otherwise(F.lit(missing))).alias(c)

    return df.select(*[text(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def _move(spark: SparkSession, source: str, target: str) -> None:
    old, files = _path(spark, source)
    new, _ = _path(spark, target)
    if files.exists(new):
        raise FileExistsError(target)
    if new.getParent() is not None:
        files.mkdirs(new.getParent())
    if not files.rename(old, new):
        raise OSError(f"cannot rename {source} to {target}")


def _drop(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def _staged(spark: SparkSession, target: str, write) -> None:
    """Write to a folder beside the target, then rename; nothing is left behind if writing fails."""
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        write(staging)
        _move(spark, staging, target)
    except BaseException:
        _drop(spark, staging)
        raise


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, all quoted; it appears whole or not at all."""
    _staged(df.sparkSession, path, lambda staging: df.write.csv(staging, header=True, quoteAll=True))


def write_csv_file(df: DataFrame, path: str, bom: bool = True) -> None:
    """One quoted CSV file with a byte order mark and LF line ends, for small result tables."""
    spark = df.sparkSession
    rows = df.select(F.to_csv(F.struct(*df.columns), {"quoteAll": "true"}).alias("value"))
    head = (BOM if bom else "") + ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    whole = spark.createDataFrame([(head,)], "value string").coalesce(1).unionAll(rows.coalesce(1))
    write_text_file(whole.coalesce(1), path)


def write_text_file(lines: DataFrame, path: str) -> None:
    """The one column of a small table as one text file."""
    spark, folder = lines.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    try:
        lines.coalesce(1).write.text(folder, lineSep="\n")
        parent, files = _path(spark, folder)
        part = next(f.getPath().toString() for f in files.listStatus(parent) if f.getPath().getName().startswith("part-"))
        _move(spark, part, path)
    finally:
        _drop(spark, folder)


def write_json(spark: SparkSession, document: dict, path: str) -> None:
    """One JSON file, indented, with sorted keys."""
    write_text_file(spark.createDataFrame([(json.dumps(document, indent=2, sort_keys=True),)], "value string"), path)


def keep_manifest(spark: SparkSession, sources: dict[str, dict], path: str, fixed: tuple[str, ...] = ("sha256", "url")) -> dict:
    """An immutable manifest of sources: created if there is none, else its ``fixed`` entries must be the same.

    Sources that the file has besides are left out of the comparison; one that it lacks, or has otherwise, raises.
    """
    if not exists(spark, path):
        write_json(spark, {"sources": sources}, path)
        return {"sources": sources}
    kept = json_document(spark, path)
    for name, details in sources.items():
        for entry in fixed:
            if kept.get("sources", {}).get(name, {}).get(entry) != details.get(entry):
                raise ValueError(f"{entry} of {name} differs from the immutable manifest")
    return kept


def _listed(spark: SparkSession, folder: str, name: str) -> dict[str, str]:
    """SHA-256 of every part of a table of a package."""
    parts = file_digests(spark, f"{folder}/{name}/*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("file"), "sha256")
    return {r.file: r.sha256 for r in parts.collect()}  # a row per file


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, notes: dict | None = None, seeds: dict | None = None) -> dict:
    """Write every table as Parquet and a manifest into a new package.

    The manifest has the rows, columns and the SHA-256 of every part of each table, the versions that made them, the
    ``seeds`` and ``notes``.  The package is staged beside the target and renamed at the end, the manifest written
    last: a failure leaves nothing, and a reader never sees half of it.
    """
    versions = {"spark": spark.version, "python": platform.python_version(), "numpy": np.__version__, "pandas": pd.__version__, "pyarrow": pa.__version__}
    manifest: dict = {"tables": {}, "versions": versions, "seeds": seeds or {}, "notes": notes or {}}

    def write(staging: str) -> None:
        for name, df in sorted(tables.items()):
            df.write.parquet(f"{staging}/{name}")
            written = spark.read.parquet(f"{staging}/{name}")
            manifest["tables"][name] = {"rows": written.count(), "columns": written.columns, "files": _listed(spark, staging, name)}
        write_json(spark, manifest, f"{staging}/MANIFEST.json")

    _staged(spark, folder, write)
    return manifest


def validate_package(spark: SparkSession, folder: str, rows: RowChecks | None = None, totals: TotalChecks | None = None, across: CrossChecks | None = None) -> DataFrame:
    """Every check of a published package, from its files alone: check_id, category, table, value, passed, detail.

    Each part must have the manifest's SHA-256, none may be missing or besides; a table must have its rows and columns;
    then the declared checks (``contracts.check_tables``) run on the tables whose parts are as published: one with other
    bytes is not read, and checks that need it fail with that as their detail.
    """
    manifest = read_manifest(spark, folder)
    found, tables = [], {}
    for name, told in sorted(manifest["tables"].items()):
        have = _listed(spark, folder, name) if exists(spark, f"{folder}/{name}") else {}
        wrong = sorted(f"{f} {'is missing' if f not in have else 'is not listed' if f not in told['files'] else 'has other bytes'}" for f in {*have, *told["files"]} if have.get(f) != told["files"].get(f))
        found.append(("parts as published", "digest", name, float(len(wrong)), not wrong, "; ".join(wrong) or None))
        if not wrong:
            tables[name] = spark.read.parquet(f"{folder}/{name}")
            n = tables[name].count()
            found.append(("rows as published", "schema", name, float(n), n == told["rows"], None))
            found.append(("columns as published", "schema", name, float(len(tables[name].columns)), tables[name].columns == told["columns"], None))

    class Held(dict):
        def __missing__(self, name):
            raise KeyError(name)

    held, runnable = Held(tables), {}
    for i, (category, bad) in (across or {}).items():
        try:
            bad(held)
            runnable[i] = (category, bad)
        except KeyError as missing:
            found.append((i, category, "*", None, False, f"{missing.args[0]} is not as published"))
    own = [{t: c for t, c in (checks or {}).items() if t in tables} for checks in (rows, totals)]
    for t in sorted({*(rows or {}), *(totals or {})} - set(tables)):
        found += [(i, c[0], t, None, False, "the table is not as published") for checks in (rows, totals) for i, c in (checks or {}).get(t, {}).items()]
    out = spark.createDataFrame(found, "check_id string, category string, table string, value double, passed boolean, detail string")
    return out.unionByName(check_tables(tables, *own, runnable)) if any(own) or runnable else out


def read_manifest(spark: SparkSession, folder: str) -> dict:
    return json_document(spark, f"{folder}/MANIFEST.json")
