"""Line deduplication with two Bloom filters.

1. Every partition marks the keys of its lines in a once-seen filter and, on a second document, in
   a twice-seen filter.  The filters travel as small slices (16-bit positions); a slice's merge
   sets a twice bit that any partition set, or that two partitions have in their once filters.
2. Only lines whose key is in the merged twice filter are suspected; their keys, counted within
   the partition, shuffle for exact confirmation (documents per key, first document).
3. Documents lose the lines of confirmed keys (all, or all but the first occurrence).

The filter is sized from a count of lines, up to ``max_bits`` (2 ** 29: 64 MB); past it, more lines are
suspected and confirmed exactly, so results never depend on it.  Confirmed keys are broadcast while
their count and bytes are within bounds; past them the lines of suspected keys join the confirmed
ones by shuffle, keys with many rows apart.

Defined cases: a document is a row, so repeated rows count each; a null or empty text is one empty
line; a null id is a document too (it comes last when the first occurrence is chosen; rows that
share the first id each keep the line's first place); texts of any length are read whole; an empty
table gives no rows.  Extra columns stay as they are; the results are the last three columns, ``__lines``,
``__dropped`` and ``__kept``, with underscores behind them where such columns are there.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, cut, fresh, hot_keys, join_unique, read

STRIP = b" \t\n\x0b\x0c\r"
SLICE_BITS = 1 << 16
HASHES = 4
NO_ID = 2**63 - 1
SPLIT = b"\n"


def line_keys(text: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = (text or b"").split(SPLIT)
    return lines, [x.strip(STRIP).lower() for x in lines]


def _usable(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars)


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions for each 64-bit hash (double hashing)."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return ((low + steps * high) & np.uint64(bits - 1)).T


class Marker:
    """Once- and twice-seen filters of one partition, as sorted bit positions."""

    def __init__(self, bits: int, min_chars: int):
        self.bits, self.min_chars = bits, min_chars
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, texts: Iterable[bytes | None]) -> None:
        for text in texts:
            keys = {k for k in line_keys(text)[1] if _usable(k, self.min_chars)}
            if not keys:
                continue
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
            at = _positions(hashes, self.bits)
            seen = ((self.once[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            for flt, chosen in ((self.twice, at[seen]), (self.once, at)):
                flat = chosen.ravel()
                np.bitwise_or.at(flt, flat >> 3, np.left_shift(1, flat & 7).astype(np.uint8))

    def slices(self) -> Iterator[tuple[int, bool, bytes]]:
        for name, flt in ((False, self.once), (True, self.twice)):
            parts = flt.reshape(-1, SLICE_BITS // 8)
            for number in np.flatnonzero(parts.any(axis=1)):
                yield int(number), name, _pack(np.flatnonzero(np.unpackbits(parts[number], bitorder="little")))


def _pack(at: np.ndarray) -> bytes:
    """Sorted positions of a slice: 16-bit numbers, or a bitmap (8192 bytes) where that is shorter."""
    if len(at) < SLICE_BITS // 16:
        return at.astype("<u2").tobytes()
    flags = np.zeros(SLICE_BITS, bool)
    flags[at] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _unpack(part: bytes) -> np.ndarray:
    if len(part) < SLICE_BITS // 8:
        return np.frombuffer(part, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(part, np.uint8), bitorder="little"))


def merge_slices(once: list[bytes], twice: list[bytes]) -> tuple[bytes, bytes]:
    """Merge one slice's filters: a bit that two once filters share becomes a twice bit."""
    count, more = np.zeros(SLICE_BITS, np.int32), np.zeros(SLICE_BITS, bool)
    for part in once:
        count[_unpack(part)] += 1
    for part in twice:
        more[_unpack(part)] = True
    return _pack(np.flatnonzero(count)), _pack(np.flatnonzero(more | (count >= 2)))


def _merge_batches(batches):
    for batch in batches:
        got = [merge_slices(o, t) for o, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[k] for g in got], pa.binary()) for k in (0, 1)]], ["slice", "once", "twice"])


def twice_filter(docs: DataFrame, text: str, min_chars: int, max_bits: int) -> np.ndarray:
    """The global twice-seen filter (a bitmap of at most ``max_bits`` bits)."""
    t = F.col(text)
    breaks = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    n = docs.select(breaks.alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)) + F.count("*")).first()[0]
    bits = int(min(max_bits, max(SLICE_BITS, 1 << int(np.ceil(np.log2(max(1, n) * 12))))))

    def mark(batches):
        marker = Marker(bits, min_chars)
        for batch in batches:
            for part in by_bytes(batch, 0):
                marker.add(as_bytes(part.column(0)))
        rows: dict[int, list[bytes]] = {}
        for part, twice, at in marker.slices():
            rows.setdefault(part, [b"", b""])[twice] = at
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *[pa.array([r[k] for r in rows.values()], pa.binary()) for k in (0, 1)]], ["slice", "once", "twice"])

    kind = "slice int, once binary, twice binary"
    both = [F.collect_list(c).alias(c) for c in ("once", "twice")]
    marks = docs.select(text).mapInArrow(mark, kind).withColumn("some", F.expr("spark_partition_id() div 512"))
    # Two levels, so that no task gathers more than some hundreds of parts of a slice.
    level = marks.groupBy("slice", "some").agg(*both).drop("some").mapInArrow(_merge_batches, kind)
    merged = level.groupBy("slice").agg(*both).mapInArrow(_merge_batches, kind).select("slice", "twice")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():  # max_bits / 8 bytes at most
        at = _unpack(bytes(row.twice)).astype(np.int64)
        np.bitwise_or.at(out, row.slice * (SLICE_BITS // 8) + (at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
    return out


def suspected(bitmap: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Which keys the twice filter holds."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    at = _positions(hashes, len(bitmap) * 8)
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def repeated_keys(docs: DataFrame, doc_id: str, text: str, bitmap: np.ndarray, min_docs: int, min_chars: int) -> DataFrame:
    """Exact confirmation of suspected keys: key, documents, first document."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def emit(batches):
        count: Counter = Counter()
        first: dict[bytes, int] = {}

        def flush():
            keys = list(count)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([count[k] for k in keys], pa.int64()), pa.array([first[k] for k in keys], pa.int64())], ["key", "n", "first"])
            count.clear()
            first.clear()
            return out

        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                keys = list({k for k in line_keys(raw)[1] if _usable(k, min_chars)})
                if keys:
                    i = NO_ID if i is None else i
                    for j in np.flatnonzero(suspected(shared.value, keys)):
                        k = keys[j]
                        count[k] += 1
                        first[k] = min(i, first.get(k, NO_ID))
                if len(count) > 200_000:
                    yield flush()
        yield flush()

    partial = docs.select(F.col(doc_id).cast("long"), text).mapInArrow(emit, "key binary, n long, first long")
    exact = partial.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return exact.where(F.col("n") >= min_docs)


def _kept(text: bytes | None, doc_id: int | None, gone: dict[bytes, int], keep_first: bool) -> tuple[int, int, bytes]:
    """Lines, dropped lines, and the text that stays."""
    lines, keys = line_keys(text)
    if not any(k in gone for k in keys):
        return len(lines), 0, text or b""
    stay, used, me = [], set(), NO_ID if doc_id is None else doc_id
    for line, key in zip(lines, keys, strict=True):
        if key in gone:
            if not keep_first or gone[key] != me or key in used:
                continue
            used.add(key)
        stay.append(line)
    return len(lines), len(lines) - len(stay), SPLIT.join(stay)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, max_bits: int = 1 << 29, max_keys: int = 200_000, max_key_bytes: int = 32 << 20) -> DataFrame:
    """All rows of ``docs`` with three more columns: its lines, those dropped, and the text that stays."""
    spark = docs.sparkSession
    bitmap = twice_filter(docs, text, min_chars, max_bits)
    gone = cut(repeated_keys(docs, doc_id, text, bitmap, min_docs, min_chars))
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("b")).first()
    if size.n <= max_keys and size.b <= max_key_bytes:
        table = {bytes(r.key): r.first_doc for r in gone.withColumnRenamed("first", "first_doc").toLocalIterator()}
        shared = spark.sparkContext.broadcast(table)

        at = 1 + docs.columns.index(text)

        def drop(batches):
            return without_lines(shared.value, batches, at, keep_first)
    else:
        return _dedup_by_join(docs, doc_id, text, bitmap, gone, min_chars, keep_first)
    return _with_kept(docs, doc_id, drop)


def without_lines(gone: dict[bytes, int], batches, at: int, keep_first: bool):
    """Batches (id, *every column) without the id, and behind them the lines, those dropped and what stays of the texts in column ``at``."""
    for batch in batches:
        for part in by_bytes(batch, at):
            ids, texts = part.column(0).to_pylist(), as_bytes(part.column(at))
            yield _append(part.columns[1:], [_kept(t, i, gone, keep_first) for i, t in zip(ids, texts, strict=True)])


def _append(columns: list[pa.Array], got: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    new = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, *new], [f"c{i}" for i in range(len(columns) + 3)])


def _with_kept(docs: DataFrame, doc_id: str, fn) -> DataFrame:
    """Run ``fn`` over (id, *every column) and put the columns' names and types back."""
    names = docs.columns
    given = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    schema = ", ".join([f"c{i} {k}" for i, k in enumerate([*kinds, "long", "long", "string"])])
    fed = given.select(F.col(f"c{names.index(doc_id)}").cast("long").alias("i"), *given.columns)
    return fed.mapInArrow(fn, schema).toDF(*names, *[fresh(names, n) for n in ("__lines", "__dropped", "__kept")])


def _dedup_by_join(docs: DataFrame, doc_id: str, text: str, bitmap: np.ndarray, gone: DataFrame, min_chars: int, keep_first: bool) -> DataFrame:
    """The same for any number of confirmed keys: suspected lines meet them in a shuffle join."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    numbered = cut(docs.toDF(*plain).withColumn("row", F.monotonically_increasing_id()))

    def lines(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            out: list[tuple[int, bytes]] = []
            for row, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                keys = list({k for k in line_keys(raw)[1] if _usable(k, min_chars)})
                out += [(row, keys[j]) for j in np.flatnonzero(suspected(shared.value, keys))] if keys else []
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["row", "key"])

    rows = cut(numbered.select("row", plain[names.index(text)]).mapInArrow(lines, "row long, key binary"))
    common = hot_keys(gone.select("key", "n"), ["key"], rows.count())
    hits = join_unique(rows, gone.select("key", "first"), ["key"], common)
    per_doc = hits.groupBy("row").agg(F.collect_list(F.struct("key", "first")).alias("gone"))  # one document's own lines

    def drop(batches):
        for batch in (part for whole in batches for part in by_bytes(whole, 1)):
            got = []
            for i, t, pairs in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                got.append(_kept(t, i, {p["key"]: p["first"] for p in pairs or []}, keep_first))
            yield _append(batch.columns[3:], got)

    joined = numbered.join(per_doc, "row", "left")
    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["long", "long", "string"]
    fed = joined.select(F.col(plain[names.index(doc_id)]).cast("long").alias("i"), F.col(plain[names.index(text)]).alias("t"), "gone", *plain)
    out = fed.mapInArrow(drop, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return out.toDF(*names, *[fresh(names, n) for n in ("__lines", "__dropped", "__kept")])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose key is in 10 documents or more go, in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], min_docs: int = 10) -> list[tuple[int, int, int, str]]:
    """What op10 returns for small tables, for tests."""
    seen: Counter = Counter()
    for _, t in rows:
        seen.update(set(line_keys((t or "").encode())[1]))
    gone = {k: 0 for k, n in seen.items() if k and n >= min_docs}
    got = [(i, *_kept((t or "").encode(), i, gone, False)) for i, t in rows]
    return [(i, n, d, hashlib.sha256(k).hexdigest()) for i, n, d, k in got]


OP10_SQL = """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT d.rid, u.pos, u.line,
         translate(regexp_replace(regexp_replace(u.line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS pos) u
), gone AS (
  SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10
), per AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE g.key IS NOT NULL) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g USING (key) GROUP BY rid
)
SELECT d.doc_id, p.n_lines, p.n_dropped, sha256(p.kept) AS kept_sha256
FROM d JOIN per p USING (rid)
"""
