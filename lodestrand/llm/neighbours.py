"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Index.  Random hyperplanes through the centre deal the points into small leaves (several times);
neighbours within a leaf start the graph.  A round of NN-descent takes of every node the nearest
neighbours not tried yet (new) and some tried before (old), with as many reverse ones, and compares
each new one with all the others: neighbours of neighbours meet, and no pair meets twice.  Nodes
without a new neighbour drop out before any vector moves.  The ``k`` nearest found stay, and rounds go
on until few edges are new.  The graph is built on centred vectors of 16-bit floats (their spread
is scaled to about one first, so offsets and magnitudes cost no precision); scores never come from
those.  Every point is indexed.

Copies.  Equal vectors form a class, one node of the graph and one query, so a vector that a third
of all rows share is no hot group.  A class gives a result its smallest ids, as many as the ranks
can hold.

Search.  A query's own graph neighbours open its pool.  A round expands the nearest unexpanded
entries of the pool along the graph (``k`` links and at most 2 ``k`` reverse ones a node), scores what
is new on the original vectors in double precision, and keeps the ``pool`` nearest; it ends when
nothing within the pool is unexpanded.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths have no distance, so each length is searched by
itself; repeated rows count once; an id with several vectors is as near as the nearest of them, and
its own rows are no candidates of it; ties go to the smaller id; an empty table gives no rows.
Columns other than the id and the vector are not read, so their names cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_unique, read, stored

LEAF = 256
EDGES = "src long, dst long, d float, new boolean"
RESULT = "query_id long, rank int, vec_id long, score double"


def points(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the rows that take part, each once, as doubles."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.where(F.exists("v", lambda x: x != 0)).distinct()


def classes(pts: DataFrame, size: int) -> DataFrame:
    """(id, v, node, first): the ``size`` smallest ids of every distinct vector, and a number for the vector.

    The limit on row_number is applied before the shuffle too, so a frequent vector sends ``size`` rows a task.
    """
    own = Window.partitionBy("v")
    few = pts.withColumn("at", F.monotonically_increasing_id()).withColumn("r", F.row_number().over(own.orderBy("id"))).where(F.col("r") <= size)
    return few.select("id", "v", F.min("at").over(own).alias("node"), (F.col("r") == 1).alias("first"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two double arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _nearest(src: np.ndarray, dst: np.ndarray, d: np.ndarray, k: int) -> pa.RecordBatch:
    """The k nearest distinct dst of every src, as new edges."""
    order = np.lexsort((dst, d, src))
    src, dst, d = src[order], dst[order], d[order]
    pair = np.ones(len(src), bool)
    pair[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])  # equal pairs have equal distances
    src, dst, d = src[pair], dst[pair], d[pair]
    start = np.flatnonzero(np.r_[True, src[1:] != src[:-1]]) if len(src) else np.zeros(0, int)
    rank = np.arange(len(src)) - np.repeat(start, np.diff(np.r_[start, len(src)]))
    keep = rank < k
    return pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep]), pa.array(d[keep], pa.float32()), pa.array(np.ones(int(keep.sum()), bool))], ["src", "dst", "d", "new"])


def _local_joins(k: int):
    """Compare the new members of every group with all others; keep pairs that beat the members' worst."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                members = batch.column(0).slice(at, 512)
                out = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.float32),)]
                ends = members.offsets.to_numpy()
                flat = members.values
                ids = flat.field("id").to_numpy(zero_copy_only=False)
                worst = flat.field("worst").to_numpy(zero_copy_only=False)
                new = flat.field("new").to_numpy(zero_copy_only=False)
                vecs = flat.field("vec")
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    if j - i < 2:
                        continue
                    x = np.frombuffer(b"".join(vecs.slice(i, j - i).to_pylist()), np.float16).reshape(j - i, -1).astype(np.float32)
                    sq = np.einsum("ij,ij->i", x, x)
                    d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
                    np.fill_diagonal(d, np.inf)
                    a, b = np.nonzero((d < worst[i:j, None]) & (new[i:j, None] | new[None, i:j]))
                    out.append((ids[i:j][a], ids[i:j][b], d[a, b]))
                yield _nearest(*map(np.concatenate, zip(*out, strict=True)), k)

    return run


def _keep_nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every src; an edge that was old stays old."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    best = edges.repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d"), F.bool_and("new").alias("new"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def packed_vectors(pts: DataFrame) -> DataFrame:
    """(id, vec): vectors less the medians, over their typical spread, as 16-bit floats in bytes."""
    cells = pts.select(F.posexplode("v").alias("at", "x")).groupBy("at")
    stats = cells.agg(F.percentile_approx("x", [0.25, 0.5, 0.75]).alias("q"), F.max(F.abs("x")).alias("most")).orderBy("at").collect()  # a row per dimension
    centre = np.array([r.q[1] for r in stats])
    spread = float(np.median([r.q[2] / 2 - r.q[0] / 2 for r in stats])) if stats else 0.0
    scale = spread if spread > 0 else max([r.most for r in stats], default=1.0) or 1.0

    def pack(batches):
        for batch in batches:
            rows = batch.column(1)
            flat = rows.values.to_numpy(zero_copy_only=False)[rows.offsets[0].as_py() : rows.offsets[-1].as_py()] if len(rows) else np.zeros(0)
            x = np.clip(flat.reshape(len(rows), -1) / scale - centre / scale, -6e4, 6e4).astype(np.float16) if len(rows) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "vec"])

    return pts.mapInArrow(pack, "id long, vec binary")


def leaves(packed: DataFrame, n: int, dim: int, tables: int) -> DataFrame:
    """Members of the leaves of ``tables`` random divisions: members array<struct<id, worst, new, vec>>."""
    n_bits = max(0, math.ceil(math.log2(max(1, n / (LEAF / 2)))))
    planes = np.random.default_rng(7).standard_normal((tables, dim, n_bits)).astype(np.float32)

    def deal(batches):
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            x = np.frombuffer(b"".join(vecs.to_pylist()), np.float16).reshape(len(ids), dim).astype(np.float32)
            for t in range(tables):
                cell = ((x @ planes[t]) > 0) @ (1 << np.arange(n_bits, dtype=np.int64)) if n_bits else np.zeros(len(ids), np.int64)
                yield pa.RecordBatch.from_arrays([ids, vecs, pa.array(np.full(len(ids), t, np.int32)), pa.array(cell.astype(np.int64))], ["id", "vec", "t", "cell"])

    dealt = packed.mapInArrow(deal, "id long, vec binary, t int, cell long")
    sizes = cut(dealt.groupBy("t", "cell").agg(F.count("*").alias("n")))
    placed = join_unique(dealt, sizes, ["t", "cell"], hot_keys(sizes, ["t", "cell"], n * tables))
    sub = F.pmod(F.xxhash64("id", "t"), F.ceil(F.col("n") / LEAF)).alias("sub")
    member = F.struct("id", F.lit(float("inf")).cast("float").alias("worst"), F.lit(True).alias("new"), "vec")
    return placed.groupBy("t", "cell", sub).agg(F.collect_list(member).alias("members")).select("members")


def neighbour_graph(pts: DataFrame, k: int = 20, tables: int = 6, rounds: int = 12, sample: int = 20, settled: float = 0.005) -> DataFrame:
    """NN-descent: (src, dst, d) with the k nearest found of every point; d is a squared distance, scaled.

    A round takes ``sample`` new and ``sample`` old neighbours of a node, and as many reverse ones; rounds end
    when the share of new edges is at most ``settled``, or after ``rounds``.
    """
    first = pts.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    packed = stored(packed_vectors(pts))
    graph = stored(_keep_nearest(leaves(packed, first.n, first.dim or 0, tables).mapInArrow(_local_joins(k), EDGES), k))
    own = F.row_number().over(Window.partitionBy("src", "new").orderBy("d", "dst"))
    reverse = F.row_number().over(Window.partitionBy("v", "new").orderBy(F.xxhash64("u", "v")))
    for _ in range(rounds):
        if graph.where("new").count() <= settled * first.n * k:
            break
        ranked = graph.withColumn("r", own)
        picked = ranked.where(F.col("r") <= sample)
        back = picked.select(F.col("dst").alias("v"), F.col("src").alias("u"), "new").withColumn("r", reverse).where(F.col("r") <= sample).drop("r")
        near = picked.select(F.col("src").alias("v"), F.col("dst").alias("u"), "new").unionByName(back)
        near = near.repartition("v").groupBy("v", "u").agg(F.max("new").alias("new"))
        near = near.withColumn("any", F.max("new").over(Window.partitionBy("v"))).where("any").drop("any")
        full = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.max("d")).alias("worst"))
        nodes = packed.join(full, F.col("id") == F.col("src"), "left").select(F.col("id").alias("u"), F.coalesce("worst", F.lit(float("inf"))).cast("float").alias("worst"), "vec")
        hubs = hot_keys(graph.groupBy(F.col("dst").alias("u")).agg(F.count("*").alias("n")), ["u"], first.n * k)
        member = F.struct(F.col("u").alias("id"), "worst", "new", "vec")
        groups = join_unique(near, nodes, ["u"], hubs).groupBy("v").agg(F.collect_list(member).alias("members"))  # at most 4 * sample members
        found = groups.select("members").mapInArrow(_local_joins(k), EDGES)
        tried = ranked.select("src", "dst", "d", (F.col("new") & (F.col("r") > sample)).alias("new"))
        graph = stored(_keep_nearest(tried.unionByName(found), k))
    return graph.select("src", "dst", "d")


def search(pts: DataFrame, graph: DataFrame, queries: DataFrame, top: int, pool: int = 512, expand: int = 256, max_rounds: int = 40) -> DataFrame:
    """Greedy graph search for ``queries`` (ids of points): query_id, rank, vec_id, score."""
    k = F.row_number().over(Window.partitionBy("src").orderBy("d", "dst"))
    degree = (graph.groupBy("src").count().agg(F.max("count")).first()[0] or 1) * 2
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "d").withColumn("r", k).where(F.col("r") <= degree)
    links = stored(graph.select("src", "dst").union(back.select("src", "dst")).repartition("src").distinct())
    asked = stored(queries.select(F.col("id").alias("q")).join(pts, F.col("q") == F.col("id")).select("q", F.col("v").alias("qv")))
    by_near = Window.partitionBy("q").orderBy("d", "node")
    frontier = asked.select("q", F.col("q").alias("node"))
    kept = asked.select("q", F.col("q").alias("node"), F.lit(None).cast("double").alias("d"), F.lit(True).alias("open")).limit(0)
    for _ in range(max_rounds):
        reached = frontier.join(links, F.col("node") == F.col("src")).select("q", F.col("dst").alias("node")).where("q <> node")
        reached = reached.distinct().join(kept.select("q", "node"), ["q", "node"], "left_anti")
        scored = reached.join(pts, F.col("node") == F.col("id")).join(asked, "q").select("q", "node", distance(F.col("v"), F.col("qv")).alias("d"), F.lit(True).alias("open"))
        pooled = kept.union(scored).withColumn("r", F.row_number().over(by_near)).where(F.col("r") <= pool)
        turn = F.row_number().over(Window.partitionBy("q").orderBy(F.col("open").desc(), "d", "node"))
        state = stored(pooled.withColumn("now", F.col("open") & (turn <= expand)).drop("r"))
        frontier = state.where("now").select("q", "node")
        kept = state.select("q", "node", "d", (F.col("open") & ~F.col("now")).alias("open"))
        if frontier.isEmpty():
            break
    return kept.withColumn("rank", F.row_number().over(by_near)).where(F.col("rank") <= top).select(F.col("q").alias("query_id"), "rank", F.col("node").alias("vec_id"), F.col("d").alias("score"))


def _candidates(pts: DataFrame, queries: DataFrame, top: int, spare: int) -> DataFrame:
    """(query_id, vec_id, score) among vectors of one length; ``spare`` more than ``top``, for the query's own rows."""
    members = cut(classes(pts, top + spare))
    nodes = members.where("first").select(F.col("node").alias("id"), "v")
    same = cut(queries.groupBy("v").agg(F.count("*").alias("n")))
    asked = cut(join_unique(queries, nodes.select("v", F.col("id").alias("node")), ["v"], hot_keys(same, ["v"], queries.count())).select(F.col("id").alias("query_id"), "node"))
    started = asked.select(F.col("node").alias("id")).distinct()
    others = search(nodes, neighbour_graph(nodes), started, top).select(F.col("query_id").alias("node"), F.col("vec_id").alias("found"), "score")
    own = started.select(F.col("id").alias("node"), F.col("id").alias("found"), F.lit(0.0).alias("score"))
    ids = members.select(F.col("node").alias("found"), F.col("id").alias("vec_id"))
    near = F.row_number().over(Window.partitionBy("node").orderBy("score", "vec_id"))
    best = others.unionByName(own).join(ids, "found").withColumn("r", near).where(F.col("r") <= top + spare)
    lists = cut(best.groupBy("node").agg(F.collect_list(F.struct("vec_id", "score")).alias("list")))
    counts = asked.groupBy("node").agg(F.count("*").alias("n"))
    named = join_unique(asked, lists, ["node"], hot_keys(counts, ["node"], asked.count()))
    return named.select("query_id", F.inline("list")).where("vec_id <> query_id")


def nearest(pts: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """The ``top`` nearest of ``queries`` (rows of ``pts``): query_id, rank, vec_id, score."""
    lengths = [r.n for r in pts.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]  # spaces, one as a rule
    spare = pts.groupBy("id").count().agg(F.max("count")).first()[0]
    found = [_candidates(pts.where(F.size("v") == n), queries.where(F.size("v") == n), top, spare) for n in lengths]
    if not found:
        return pts.sparkSession.createDataFrame([], RESULT)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    by_near = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", by_near)
    return best.where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, among all others."""
    pts = cut(points(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return nearest(pts, pts.where("id % 100 = 0"), top=10)


def brute_force(rows: list[tuple[int, list[float]]], top: int = 10) -> dict[int, list[tuple[int, float]]]:
    """Exact neighbours of the queries, for tests of recall."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:top]
        out[int(ids[q])] = [(int(ids[i]), float(d[i])) for i in order]
    return out
