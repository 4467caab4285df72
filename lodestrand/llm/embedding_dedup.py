"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact cosines.

1. Equal vectors form a class (128 bits of hash shuffle, combined before they do), so copies of any share of the rows
   are one point with a weight.
2. On a bounded sample of the classes, iterative quantisation learns rotations of the centred main components: each
   turns a vector into bits (above or below the sample's median, so they are balanced) such that the rotated
   sample is as near to its bits as it can be.  Several rotations from different starts give as many bits as the
   tables need.
3. The code is cut into ``tables`` substrings of ``width`` bits, two to the power of which is 16 times the number of
   classes.  Vectors that share a substring share a bucket of that table, so two codes that differ in fewer bits
   than there are tables always meet.  The number of tables is measured on the sample: pairs made at exactly the
   threshold have to meet with a probability of ``TARGET``.
4. Only buckets with several members go on.  Their vectors come to them, and a task compares them by one matrix
   product of original vectors in double precision.  A pair is counted in the first of the tables in which it
   meets, so no pair is ever a row: a vector leaves with the number of its links there and the smallest member it is
   connected with.  A bucket with more than ``block`` members is split into blocks, and each pair of blocks is a group.
5. Sums give the links, connected components (``near_dedup.components``) the groups.

The sample (``SAMPLE`` vectors, less for long ones) only fits the rotations; every row is indexed.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing (no
links, its own component, kept); vectors of different lengths are not compared; repeated rows and rows that share an
id are vectors of their own, copies of each other if they are equal; a null id takes its component's smallest id, and
is kept where there is none; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_keys, join_unique, read, stored
from .near_dedup import components

SAMPLE, SAMPLE_BYTES = 10_000, 64 << 20
BITS = 64
ROUNDS = 30
TARGET = 0.997
MAX_TABLES = 128


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantiser(v: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A rotation that brings ``v`` near to signs, and the medians of the rotated ``v``."""
    c = v.shape[1]
    turn = np.linalg.qr(rng.standard_normal((c, c)))[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (left @ right).T
    return turn, np.median(v @ turn, axis=0)


class Index:
    """Rotations and tables for vectors of one length; ``keys`` gives a vector's bucket in each table."""

    def __init__(self, sample: np.ndarray, rows: int, cosine: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        whole = unit(sample)
        # Half of the sample fits the rotations, the other half measures the tables.
        x, probes = (whole[::2], whole[1::2]) if len(whole) >= 200 else (whole, whole)
        self.mean = x.mean(axis=0)
        values, axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean))
        held = [i for i in np.argsort(-values)[:BITS] if values[i] > 1e-12 * max(values[-1], 1e-300)] or [int(np.argmax(values))]
        self.axes = axes[:, held]
        self.projections: list[np.ndarray] = []
        self.levels: list[np.ndarray] = []
        v = (x - self.mean) @ self.axes
        near = self.at_threshold(probes, cosine, rng)
        width = max(4, math.ceil(math.log2(max(rows, 2))) + 4)
        while True:
            self.width, self.tables, missed = width, 0, np.ones(len(probes), bool)
            while self.tables < MAX_TABLES and missed.mean() > 1 - TARGET:
                while len(self.projections) * len(held) < (self.tables + 1) * width:
                    turn, level = quantiser(v, rng)
                    self.projections.append(self.axes @ turn)
                    self.levels.append(level)
                self.tables += 1
                missed &= self.keys(probes, self.tables - 1)[:, 0] != self.keys(near, self.tables - 1)[:, 0]
            if missed.mean() <= 1 - TARGET or width <= 4:
                break
            width -= 2
        used = -(-self.tables * width // len(held))
        self.projections, self.levels = self.projections[:used], self.levels[:used]

    @staticmethod
    def at_threshold(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
        """For each vector one at exactly the threshold, in a direction of the sample's own or any other."""
        way = np.where(rng.random((len(x), 1)) < 0.5, x[rng.permutation(len(x))], rng.standard_normal(x.shape))
        way = way - (way * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((way * way).sum(axis=1, keepdims=True))
        return cosine * x + math.sqrt(1 - cosine * cosine) * np.divide(way, size, out=np.zeros_like(way), where=size > 1e-9)

    def keys(self, x: np.ndarray, only: int | None = None) -> np.ndarray:
        """Bucket numbers of unit vectors: a column per table (of ``only`` one)."""
        tables = range(self.tables) if only is None else [only]
        each, weights = self.axes.shape[1], 1 << np.arange(self.width, dtype=np.int64)
        bits: dict[int, np.ndarray] = {}
        out = np.empty((len(x), len(tables)), np.int64)
        for k, t in enumerate(tables):
            own = np.empty((len(x), self.width), bool)
            for j in range(self.width):
                r, b = divmod(t * self.width + j, each)
                if r not in bits:
                    bits[r] = (x - self.mean) @ self.projections[r] >= self.levels[r]
                own[:, j] = bits[r][:, b]
            out[:, k] = own @ weights
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of one length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(float)


def joined(links: np.ndarray) -> np.ndarray:
    """For each member of a group (symmetric links) the first member it is connected with."""
    label = np.arange(len(links))
    while True:
        near = np.minimum(label, np.where(links, label, len(label)).min(axis=1))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def linked(x: np.ndarray, keys: np.ndarray, own: np.ndarray, crossing: bool, cosine: float) -> np.ndarray:
    """Which pairs of groups (groups, members, ...) reach the cosine, meet in no earlier table and, if ``crossing``, lie in different blocks."""
    links = x @ x.transpose(0, 2, 1) >= cosine
    links &= ~np.eye(x.shape[1], dtype=bool)
    if crossing:
        links &= own[:, :, None] != own[:, None, :]
    g, i, j = np.nonzero(links)
    for at in range(0, len(g), 1 << 16):
        part = slice(at, at + (1 << 16))
        links[g[part], i[part], j[part]] = (keys[g[part], i[part]] != keys[g[part], j[part]]).all(axis=1)
    return links


def compare(batches, cosine: float, dims: int):
    """Groups of bucket members (rows in order of t, key, p, q) to c, links (weighted), root."""

    def results(rows: pa.Table):
        heads = [rows.column(n).to_numpy() for n in ("t", "key", "p", "q")]
        cuts = np.flatnonzero(np.any([h[1:] != h[:-1] for h in heads], axis=0)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(rows)]
        x = unit(matrix(rows.column("v").combine_chunks(), dims))
        keys = matrix_of_keys(rows.column("keys").combine_chunks())
        c, n, own = (rows.column(k).to_numpy() for k in ("c", "n", "own"))
        t, crossing = heads[0][starts], heads[2][starts] != heads[3][starts]
        size = ends - starts
        for shape in {(int(m), int(k), bool(z)) for m, k, z in zip(size, t, crossing, strict=True) if m > 1}:
            chosen = starts[(size == shape[0]) & (t == shape[1]) & (crossing == shape[2])]
            for at in range(0, len(chosen), step := max(1, 200_000 // shape[0] ** 2)):
                place = chosen[at : at + step, None] + np.arange(shape[0])
                links = linked(x[place], keys[place][:, :, : shape[1]], own[place], shape[2], cosine)
                for g in np.flatnonzero(links.any(axis=(1, 2))):
                    ids, some = c[place[g]], links[g].any(axis=1)
                    order = np.argsort(ids, kind="stable")
                    root = np.empty(len(ids), np.int64)
                    root[order] = ids[order][joined(links[g][np.ix_(order, order)])]
                    yield ids[some], (links[g] @ n[place[g]])[some], root[some]

    def batch(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)) for k in zip(*found, strict=True)], ["c", "links", "root"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        rows = pa.Table.from_batches(held)
        last = [rows.column(k)[len(rows) - 1].as_py() for k in ("t", "key", "p", "q")] if len(rows) else []
        if len(rows) == 0 or [rows.column(k)[0].as_py() for k in ("t", "key", "p", "q")] == last:
            continue
        same = np.all([rows.column(k).to_numpy() == v for k, v in zip(("t", "key", "p", "q"), last, strict=True)], axis=0)
        first = int(np.argmax(same))
        found = list(results(rows.slice(0, first)))
        held = rows.slice(first).to_batches()
        if found:
            yield batch(found)
    if sum(len(b) for b in held):
        found = list(results(pa.Table.from_batches(held)))
        if found:
            yield batch(found)


def matrix_of_keys(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def links_of(classes: DataFrame, dims: int, rows: int, cosine: float, block: int) -> DataFrame:
    """Links between the classes (c, n, v) of one length: c, links, root, in parts that add up."""
    spark = classes.sparkSession
    most = min(SAMPLE, max(100, SAMPLE_BYTES // (8 * dims)))
    part = F.pmod(F.xxhash64("v", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * most / rows))
    sample = classes.where(part).select("v").limit(most).toArrow()["v"].combine_chunks()  # bounded
    index = Index(matrix(sample, dims), rows, cosine) if len(sample) > 1 else Index(matrix(classes.select("v").limit(most).toArrow()["v"].combine_chunks(), dims), rows, cosine)
    shared = spark.sparkContext.broadcast(index)

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                own = b.slice(at, 4096)
                keys = shared.value.keys(unit(matrix(own.column(1), dims)))
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], ["c", "keys"])

    coded = stored(classes.select("c", "v").mapInArrow(encode, "c long, keys array<long>"))
    members = coded.select("c", F.posexplode("keys").alias("t", "key"))
    counts = stored(members.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    split = counts.select("t", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    met = join_unique(members, split, ["t", "key"], hot_keys(counts, ["t", "key"], total))
    routed = met.select("c", "t", "key", F.pmod(F.xxhash64("c"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    group = ["t", "key", "p", "q"]
    routed = routed.select("c", "t", "key", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    full = routed.join(classes.join(coded, "c"), "c").select(*group, "own", "c", "n", "keys", "v")
    dealt = full.repartition(*group).sortWithinPartitions(*group)
    return stored(dealt.mapInArrow(lambda batches: compare(batches, cosine, dims), "c long, links long, root long"))


def near_vectors(table: DataFrame, vec_id: str, vector: str, cosine: float = 0.95, block: int = 1000) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    v = F.col(vector)
    if table.schema[vector].dataType.elementType.simpleString() != "float":
        v = v.cast("array<double>")
    good = F.coalesce(F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    hashes = [F.when(F.col("good"), F.xxhash64("v", F.lit(s))).alias(f"h{s}") for s in (0, 1)]
    # Numbered once: the numbers depend on how the scan is split.
    rows = stored(table.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), good.alias("good")).select("row", "vec_id", *hashes, F.when(F.col("good"), F.col("v")).alias("v")))
    named = rows.where("h0 IS NOT NULL").groupBy("h0", "h1").agg(F.min("row").alias("c"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
    classes = stored(named.join(rows.select(F.col("row").alias("c"), "v"), "c"))
    sizes = classes.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("rows")).where("rows > 1").collect()  # a row per length
    found = table.sparkSession.createDataFrame([], "c long, links long, root long")
    for s in sizes:
        found = found.unionByName(links_of(classes.where(F.size("v") == s.dims).select("c", "n", "v"), s.dims, s.rows, cosine, block))
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    groups = components(found.where("c <> root").select(F.col("c").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("c"), "component")
    marked = stored(classes.select("c", "h0", "h1", "n", "low").join(links, "c", "left").join(groups, "c", "left").withColumn("component", F.coalesce("component", "c")))
    members = marked.groupBy("component").agg(F.count("*").alias("n"), F.min("low").alias("component_id"))
    named = stored(members)
    whole = join_unique(marked, named.select("component", "component_id"), ["component"], hot_keys(named, ["component"], marked.count()))
    own = whole.select("h0", "h1", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    some = rows.where("h0 IS NOT NULL").select("vec_id", "h0", "h1")
    linked_rows = join_unique(some, own, ["h0", "h1"], hot_keys(marked, ["h0", "h1"], rows.count())).select("vec_id", "n_links", "component_id")
    bare = rows.where("h0 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked_rows.unionByName(bare).withColumn("kept", kept)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def brute_force(rows: list[tuple], cosine: float = 0.95) -> list[tuple]:
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) rows in their order, for tests."""
    good = [v is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(v) for _, v in rows]
    units = [unit(np.array([v], float))[0] if g else None for (_, v), g in zip(rows, good, strict=True)]
    near = [[j for j in range(len(rows)) if j != i and good[i] and good[j] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(len(rows))]
    out, label = [], {}
    for i in range(len(rows)):
        if i not in label:
            group, todo = {i}, [i]
            while todo:
                new = [j for j in near[todo.pop()] if j not in group]
                group.update(new)
                todo += new
            ids = [rows[j][0] for j in group if rows[j][0] is not None]
            label |= dict.fromkeys(group, min(ids) if ids else None)
        out.append((rows[i][0], len(near[i]), label[i], label[i] is None or rows[i][0] == label[i]))
    return out
