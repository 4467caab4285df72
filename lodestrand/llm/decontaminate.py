"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Windows of ``width`` consecutive words of the benchmark items are the patterns (an item of fewer
words is one pattern).  Patterns of one length share two tables: a shift table that says, for a
block of words, how far the search may advance when the block ends at the current word, and a
table from the words at a pattern's end to the patterns that end so, which are then compared word
for word.  A document is scanned once for each pattern length (one, for items of ``width`` words
or more).

The items are a query set.  Their texts are dealt by a hash into blocks of about ``block_words`` words (a long
item's windows into several), and only one block at a time comes through the driver, is broadcast and is
freed after its pass over the documents.  With one block, as a rule, that is one narrow pass; with
more, each pass keeps only the hits, which are then put back to their documents.  No document is
shuffled by its words.

Defined cases: null or empty texts have no words, hit nothing and are not contaminated; items
without words or with a null id take no part; repeated items count once; repeated document rows
are judged alike; texts and items of any length are read whole; without items or documents there are
no hits or no rows.  Extra columns stay as they are; the results are the last three columns, ``__words``,
``__hits`` and ``__items``, with underscores behind them where such columns are there.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, cut, fresh, read

#: Word bytes are 0-9, a-z (A-Z lower-cased) and all non-ASCII bytes; the rest separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BLOCK = 3


def words(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return text.translate(WORD_BYTES).split() if text else []


class WuManber:
    """Search tables for patterns of one length, each a tuple of words with the items that hold it."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], frozenset]):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.ends: dict[tuple[bytes, ...], list] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(length - end, self.shift.get(key, self.far))
            self.ends.setdefault(pattern[length - self.block :], []).append((pattern, items))

    def search(self, text: list[bytes], hit: bytearray, found: set) -> None:
        """Mark the words of every occurrence in ``hit``; add the items to ``found``."""
        length, block, far, shift = self.length, self.block, self.far, self.shift
        at, n = length, len(text)
        while at <= n:
            key = tuple(text[at - block : at])
            move = shift.get(key, far)
            if move:
                at += move
                continue
            window = tuple(text[at - length : at])
            for pattern, items in self.ends.get(key, ()):
                if pattern == window:
                    hit[at - length : at] = b"\x01" * length
                    found |= items
            at += 1


def windows(item_words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    if len(item_words) <= width:
        return [tuple(item_words)] if item_words else []
    return [tuple(item_words[i : i + width]) for i in range(len(item_words) - width + 1)]


RUNS = "array<struct<start:int,end:int>>"


def item_slices(items: DataFrame, item_id: str, text: str, width: int, most: int) -> DataFrame:
    """(i, part, t, n): the words of every item once, in slices of ``most`` windows that overlap by ``width`` - 1 words."""

    def cut_up(batches):
        for batch in batches:
            out = []
            for i, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                own = words(raw)
                for part, k in enumerate(range(0, max(1, len(own) - width + 1), most) if own else ()):
                    some = own[k : k + most + width - 1]
                    out.append((i, part, b" ".join(some), len(some)))
            kinds = (pa.string(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], ["i", "part", "t", "n"])

    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    return rows.mapInArrow(cut_up, "i string, part int, t binary, n long")


def patterns_of(rows: list, width: int) -> dict:
    """length -> pattern -> ids of its items."""
    out: dict[int, dict[tuple, set]] = {}
    for row in rows:
        for window in windows(bytes(row.t).split(), width):
            out.setdefault(len(window), {}).setdefault(window, set()).add(row.i)
    return {n: {p: frozenset(i) for p, i in own.items()} for n, own in out.items()}


def _mark(tables: list[WuManber], text: bytes | None) -> tuple[int, list[dict], list[str]]:
    """The number of words, runs of hit words, and the items found.  The words of one text are held at a time."""
    own = words(text)
    hit, got = bytearray(len(own)), set()
    for table in tables:
        table.search(own, hit, got)
    return len(own), _runs(hit) if got else [], sorted(got)


def _runs(hit: bytearray) -> list[dict]:
    return [{"start": m.start(), "end": m.end()} for m in re.finditer(b"\x01+", hit)]


RUN_LIST, ID_LIST = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())


def marked(tables: list[WuManber], batches, at: int, names: list[str]):
    """Batches with the words, runs and items of the texts in column ``at`` behind their columns."""
    for batch in batches:
        for part in by_bytes(batch, at):
            got = [_mark(tables, raw) for raw in as_bytes(part.column(at))]
            new = [pa.array([g[i] for g in got], kind) for i, kind in enumerate((pa.int64(), RUN_LIST, ID_LIST))]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_words: int = 250_000) -> DataFrame:
    """All rows of ``docs`` with three more columns: the number of words, the runs of hit words (start, end)
    and the ids, as strings, of items with a window in the text."""
    names, sc = docs.columns, docs.sparkSession.sparkContext
    slices = cut(item_slices(items, item_id, item_text, width, max(1, block_words // 8)))
    blocks = max(1, -(-(slices.agg(F.sum("n")).first()[0] or 0) // block_words))
    block = F.pmod(F.xxhash64("i", "part"), F.lit(blocks))
    plain = [f"c{i}" for i in range(len(names) + 3)]
    kinds = [f.dataType.simpleString() for f in docs.schema.fields] + ["long", RUNS, "array<string>"]
    schema = ", ".join(f"{p} {k}" for p, k in zip(plain, kinds, strict=True))
    at, ends = names.index(text), (fresh(names, "__words"), fresh(names, "__hits"), fresh(names, "__items"))

    def whole(shared):
        def scan(batches):
            return marked([WuManber(n, p) for n, p in shared.value.items()], batches, at, plain)

        return scan

    if blocks == 1:
        shared = sc.broadcast(patterns_of(slices.collect(), width))  # block_words words at most
        return docs.toDF(*plain[:-3]).mapInArrow(whole(shared), schema).toDF(*names, *ends)

    def some(shared):
        def scan(batches):
            tables = [WuManber(n, p) for n, p in shared.value.items()]
            for batch in marked(tables, batches, 1, ["row", "t", "n", "runs", "ids"]):
                yield batch.filter(pc.greater(pc.list_value_length(batch.column("ids")), 0)).select(["row", "runs", "ids"])

        return scan

    numbered = cut(docs.toDF(*plain[:-3]).withColumn("row", F.monotonically_increasing_id()))
    found = []
    for b in range(blocks):
        shared = sc.broadcast(patterns_of(slices.where(block == b).collect(), width))  # about block_words words
        found.append(cut(numbered.select("row", plain[at]).mapInArrow(some(shared), f"row long, runs {RUNS}, ids array<string>")))
        shared.destroy()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    # A document has one row per block at most.
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))

    def finish(batches):
        for batch in (part for whole_batch in batches for part in by_bytes(whole_batch, at)):
            count, runs = [], []
            for raw, own in zip(as_bytes(batch.column(at)), batch.column(len(names)).to_pylist(), strict=True):
                hit = bytearray(len(words(raw)))
                for r in own or ():
                    hit[r["start"] : r["end"]] = b"\x01" * (r["end"] - r["start"])
                count.append(len(hit))
                runs.append(_runs(hit))
            ids = pa.array([i or [] for i in batch.column(len(names) + 1).to_pylist()], ID_LIST)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(count, pa.int64()), pa.array(runs, RUN_LIST), ids], plain)

    return numbered.join(hits, "row", "left").select(*plain[:-3], "runs", "ids").mapInArrow(finish, schema).toDF(*names, *ends)


def hit_words(column: str = "__hits"):
    """Number of hit words."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item against every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, read(spark, sf_dir, "benchmark"))
    hit = hit_words()
    return out.select("doc_id", F.col("__words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def brute_force(docs: list[tuple], items: list[tuple], width: int = 10) -> list[tuple]:
    """What op3 returns for small tables, for tests."""
    pats = [(str(i), w) for i, t in items if i is not None for w in windows(words((t or "").encode()), width)]
    out = []
    for d, t in docs:
        own = words((t or "").encode())
        hit, ids = set(), set()
        for i, w in pats:
            for k in range(len(own) - len(w) + 1):
                if tuple(own[k : k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    ids.add(i)
        out.append((d, len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


OP3_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), items AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), pats AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[p : p + least(len(ws), 10) - 1], ' ') AS pat
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p) WHERE len(ws) > 0
), lens AS (
  SELECT DISTINCT n FROM pats
), wins AS (
  SELECT rid, n, p, array_to_string(ws[p : p + n - 1], ' ') AS pat
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(ws) - n + 2)) AS p)
), occ AS (
  SELECT w.rid, w.p, w.n, t.item_id FROM wins w JOIN pats t ON t.n = w.n AND t.pat = w.pat
), hits AS (
  SELECT rid, count(DISTINCT k) AS n_hit
  FROM (SELECT DISTINCT rid, p, n FROM occ), LATERAL (SELECT unnest(range(p, p + n)) AS k) GROUP BY rid
), ids AS (
  SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS joined
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.joined, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h USING (rid) LEFT JOIN ids i USING (rid)
"""
