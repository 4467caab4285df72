"""A Spark data source over a folder of dated snapshots: CSV files of one site each, listed in a sealed manifest.

``spark.read.format("snapshots").schema(...).option("path", folder).load()`` reads one file in one task.  Filters on the
site choose files outright; filters on the date choose files by the days they span, and Spark applies them to the rows
that are left (``spark.sql.python.filterPushdown.enabled`` has to be true for both).  A file is used only if its
bytes have the SHA-256 of the manifest, its header every column asked for, its rows the manifest's number and site.
Reading is tried again after a failure of the store, with growing pauses.  Nothing is fetched from a network.
"""

from __future__ import annotations

import datetime
import hashlib
import io
import time
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .readers import file_digests, json_document
from .sinks import exists, write_json

MANIFEST = "SNAPSHOTS.json"
ATTEMPTS = 3


def seal_snapshots(spark: SparkSession, folder: str, schema: str, site: str, date: str) -> dict:
    """The manifest of a folder's CSV files (site, first and last day, rows, SHA-256), written once.

    A manifest that is there already is immutable: a listed file that is gone or has other bytes raises, and so does one
    that is not listed.  A file with several sites, or none, raises.
    """
    files = f"{folder.rstrip('/')}/*.csv"
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    rows = spark.read.csv(files, schema=schema, header=True, mode="FAILFAST", enforceSchema=False).select(F.col("_metadata.file_name").alias("file"), site, date)
    spans = rows.groupBy("file").agg(F.min(site).alias("site"), F.max(site).alias("other"), F.min(date).alias("first"), F.max(date).alias("last"), F.count("*").alias("rows"))
    found = {r.file: r for r in spans.join(file_digests(spark, files).select(name, "sha256"), "file").collect()}  # a row per file
    mixed = sorted(f for f, r in found.items() if r.site is None or r.site != r.other)
    if mixed:
        raise ValueError(f"not of one site: {', '.join(mixed)}")
    listed = {f: {"site": str(r.site), "first": str(r["first"]), "last": str(r["last"]), "rows": r.rows, "sha256": r.sha256} for f, r in found.items()}
    path = f"{folder.rstrip('/')}/{MANIFEST}"
    if not exists(spark, path):
        write_json(spark, {"site": site, "date": date, "files": listed}, path)
    kept = json_document(spark, path)
    changed = sorted(f for f in {*kept["files"], *listed} if kept["files"].get(f, {}).get("sha256") != listed.get(f, {}).get("sha256"))
    if changed:
        raise ValueError(f"not as in the immutable manifest: {', '.join(changed)}")
    return kept


class SnapshotFile(InputPartition):
    def __init__(self, file: str, details: dict):
        self.file, self.details = file, details


class SnapshotReader(DataSourceReader):
    def __init__(self, schema: StructType, folder: str):
        self.schema, self.folder = schema, folder.rstrip("/")
        self.manifest = _document(f"{self.folder}/{MANIFEST}")
        self.sites: set[str] | None = None
        self.first, self.last = datetime.date.min, datetime.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        site, date = (self.manifest["site"],), (self.manifest["date"],)
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == site:
                wanted = {str(v) for v in (f.value if isinstance(f, In) else [f.value])}
                self.sites = wanted if self.sites is None else self.sites & wanted
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == date and isinstance(f.value, datetime.date):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        def wanted(d: dict) -> bool:
            return (self.sites is None or d["site"] in self.sites) and d["first"] <= self.last.isoformat() and d["last"] >= self.first.isoformat()

        return [SnapshotFile(f, d) for f, d in sorted(self.manifest["files"].items()) if wanted(d)]

    def read(self, partition: SnapshotFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        payload = _bytes(f"{self.folder}/{partition.file}")
        yield from validated(payload, partition.file, partition.details, self.schema, self.manifest["site"]).to_batches()


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        raise ValueError("snapshots are read with a schema")

    def reader(self, schema: StructType) -> SnapshotReader:
        return SnapshotReader(schema, self.options["path"])


def validated(payload: bytes, file: str, details: dict, schema: StructType, site: str) -> pa.Table:
    """The table of a snapshot's bytes; bytes, header, rows or site other than the manifest's raise."""
    if hashlib.sha256(payload).hexdigest().upper() != details["sha256"]:
        raise ValueError(f"{file} is not the file of the manifest")
    kinds = to_arrow_schema(schema)
    options = pacsv.ConvertOptions(column_types={**{f.name: f.type for f in kinds}, site: pa.string()}, strings_can_be_null=True)
    table = pacsv.read_csv(io.BytesIO(payload.removeprefix(b"\xef\xbb\xbf")), convert_options=options)
    missing = [c for c in (*kinds.names, site) if c not in table.column_names]
    if missing:
        raise ValueError(f"{file} lacks {', '.join(missing)}")
    if len(table) != details["rows"] or not pc.all(pc.equal(table[site], details["site"])).as_py():
        raise ValueError(f"{file} has other rows than the manifest says")
    return table.select(kinds.names).cast(kinds)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _bytes(path: str) -> bytes:
    for attempt in range(ATTEMPTS):
        try:
            store, name = _open(path)
            with store.open_input_stream(name) as stream:
                return stream.read()
        except FileNotFoundError:
            raise
        except OSError:
            if attempt + 1 == ATTEMPTS:
                raise
            time.sleep(2**attempt)
    raise OSError(path)


def _document(path: str) -> dict:
    import json

    return json.loads(_bytes(path).decode("utf-8-sig"))


def snapshots(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a sealed folder of snapshots, with filters pushed to its files."""
    spark.dataSource.register(SnapshotSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("snapshots").schema(schema).option("path", folder).load()
