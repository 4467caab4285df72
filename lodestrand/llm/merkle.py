"""A Merkle manifest of a table: a hash tree per key, one over their roots, and an inclusion proof of every row.

1. A row's leaf digest and its place in its key come from one pass over the table and one sort of small rows
   (``placed``), so a key of any share of the rows is spread over many tasks.
2. ``combineByKey`` brings the leaves of a block (``HEIGHT`` levels of a tree) together as partial parents.  A
   parent knows from the tree's size how many children it will have; with the last of them its digest is there, and it
   becomes a child of its own parent at once, on the map side where it can.  What a block leaves is its root:
   these frontiers shuffle again, as leaves of the next round, until every tree has one node.
3. Proofs go back down: a block's resolved nodes are the links from each child to its siblings, and a block
   hands its own path on to the blocks below.  A row's proof is the path within its block, then the block's.

The digest of a node is the SHA-256 of its children's digests, as lower-case hexadecimal text, one after the other.

Defined cases: a null value of a column is ``-``; any key (null too) has its tree; rows of a key go by id (null
first), then leaf digest, so equal rows stand side by side and may change places without any other digest changing;
a tree of one row is that row's digest; an empty table has no rows and no root.  Texts are hashed whole.  Columns that
are not named are neither read nor hashed, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_sql, placed, ranges_for, read, stored

#: Levels that one round resolves, for two children a node: blocks of 1024 leaves.
HEIGHT = 10
PATH = "array<struct<before:binary,after:binary>>"


def node_digest(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


class Block:
    """The partial parents of one block of a tree of ``n`` leaves.

    ``nodes`` are the digests that are known, by level and place; ``waiting`` the children of parents that are not
    complete.
    """

    def __init__(self, n: int, arity: int, height: int):
        self.sizes = [n]
        while len(self.sizes) <= height and self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // arity))
        self.arity = arity
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.waiting: dict[tuple[int, int], dict[int, bytes]] = {}
        self.rows: list[tuple] = []  # (place, what the leaf carries)

    def add(self, level: int, at: int, digest: bytes) -> None:
        """A child arrives; parents that it completes follow it."""
        while True:
            self.nodes[level, at] = digest
            if level + 1 == len(self.sizes):
                return
            parent = at // self.arity
            due = min(self.arity, self.sizes[level] - parent * self.arity)
            got = self.waiting.setdefault((level + 1, parent), {})
            got[at] = digest
            if len(got) < due:
                return
            del self.waiting[level + 1, parent]
            digest = node_digest([got[i] for i in sorted(got)])
            level, at = level + 1, parent

    def joined(self, other: Block) -> Block:
        """Both parts of a block: the other's resolved nodes, and its waiting children as arrivals."""
        self.rows += other.rows
        self.nodes |= other.nodes
        for (level, _), got in other.waiting.items():
            for at, digest in got.items():
                self.add(level - 1, at, digest)
        return self

    def root(self) -> bytes:
        if self.waiting:
            raise ValueError("a block lacks children")
        return next(d for (level, _), d in self.nodes.items() if level + 1 == len(self.sizes))


def siblings(nodes: dict[tuple[int, int], bytes], levels: int, at: int, arity: int) -> list[tuple[bytes, bytes]]:
    """The digests before and after a leaf and its ancestors in their runs, level by level."""
    path = []
    for level in range(levels):
        low = at // arity * arity
        run = [nodes.get((level, i), b"") for i in range(low, low + arity)]
        path.append((b"".join(run[: at - low]), b"".join(run[at - low + 1 :])))
        at //= arity
    return path


def _spread(key: tuple) -> int:
    return zlib.crc32(f"{key[1]}:{key[0]}".encode())


def grow(leaves: DataFrame, arity: int, height: int, ranges: int) -> list[DataFrame]:
    """The rounds of trees: tables of blocks (tree, block, n, levels, root, nodes, rows), the leaves' blocks first.

    ``leaves``: tree, at, n, digest, and ``row``, a struct that a leaf carries along.
    """
    spark, each, rounds = leaves.sparkSession, arity**height, []

    def keyed(r) -> tuple:
        return (r["tree"], r["at"] // each), (r["n"], r["at"], bytes(r["digest"]), r["row"])

    def with_leaf(block: Block, leaf: tuple) -> Block:
        _, at, digest, row = leaf
        block.rows.append((at, row))
        block.add(0, at, digest)
        return block

    def first(leaf: tuple) -> Block:
        return with_leaf(Block(leaf[0], arity, height), leaf)

    def emitted(item) -> tuple:
        (tree, number), b = item
        return tree, number, b.sizes[0], len(b.sizes) - 1, b.root(), [(level, at, d) for (level, at), d in b.nodes.items()], b.rows

    while True:
        row = leaves.schema["row"].dataType.simpleString()
        schema = f"tree string, block long, n long, levels int, root binary, nodes array<struct<level:int,at:long,digest:binary>>, rows array<struct<at:long,row:{row}>>"
        blocks = leaves.select("tree", "at", "n", "digest", "row").rdd.map(keyed).combineByKey(first, with_leaf, Block.joined, ranges, _spread)
        rounds.append(stored(spark.createDataFrame(blocks.map(emitted), schema, verifySchema=False)))
        unresolved = rounds[-1].where(F.col("n") > each)
        if unresolved.isEmpty():
            return rounds
        left = F.ceil(F.col("n") / each).cast("long").alias("n")
        leaves = unresolved.select("tree", F.col("block").alias("at"), left, F.col("root").alias("digest"), F.struct(F.lit(0).alias("none")).alias("row"))


def proofs(rounds: list[DataFrame], outer: DataFrame, arity: int, height: int) -> DataFrame:
    """Every leaf of the trees with its path up: tree, at, digest, row, path, and the columns of ``outer``.

    ``outer`` has a row per tree: tree, ``path`` (what follows above its root), and more columns.
    """
    each, given = arity**height, None
    more = [c for c in outer.columns if c not in ("tree", "path")]
    kinds = "".join(f", {c} {outer.schema[c].dataType.simpleString()}" for c in more)

    def descend(r) -> Iterator[tuple]:
        nodes = {(level, at): bytes(d) for level, at, d in r["nodes"]}
        above, rest = [tuple(p) for p in r["path"]], [r[c] for c in more]
        for at, row in r["rows"]:
            yield r["tree"], at, nodes[0, at], row, siblings(nodes, r["levels"], at, arity) + above, *rest

    for blocks in reversed(rounds):
        here = blocks.where(F.col("n") <= each).join(outer, "tree")
        if given is not None:
            here = here.unionByName(blocks.where(F.col("n") > each).join(given, ["tree", "block"]))
        schema = f"tree string, at long, digest binary, row {blocks.schema['rows'].dataType.elementType['row'].dataType.simpleString()}, path {PATH}{kinds}"
        down = blocks.sparkSession.createDataFrame(here.rdd.flatMap(descend), schema, verifySchema=False)
        given = down.select("tree", F.col("at").alias("block"), "path", *more) if blocks is rounds[0] else stored(down.select("tree", F.col("at").alias("block"), "path", *more))
    return down


def leaf_digest(columns: list[Column]) -> Column:
    """The digest of a row: every value behind its UTF-8 length and a colon, ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def manifest(table: DataFrame, columns: list[str], key: str, doc_id: str, also: dict[str, Column] | None = None, arity: int = 2, height: int = HEIGHT) -> DataFrame:
    """Every row's leaf and proof: doc_id, leaf, subroot (of its key's tree), root (binary), path, and the columns ``also``.

    ``path`` is the proof: from the leaf up, the digests (one after the other) that stand before and after it, or its
    ancestor, in a run of siblings; both are empty where the run has one node.
    """
    tree = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("+"), F.col(key).cast("string")))
    carried = F.struct(F.col(doc_id).cast("long").alias("doc_id"), *[c.alias(n) for n, c in (also or {}).items()])
    leaves = stored(table.select(tree.alias("tree"), leaf_digest([F.col(c) for c in columns]).alias("digest"), carried.alias("row"), F.monotonically_increasing_id().alias("tie")))
    ranges = ranges_for(table.sparkSession, leaves.count())
    trees = grow(placed(leaves, "tree", ["row.doc_id", "digest", "tie"], ranges), arity, height, ranges)
    roots = stored(_union([t.where(F.col("n") <= arity**height).select("tree", "root") for t in trees]))
    named = roots.select(F.lit("").alias("tree"), F.col("root").alias("digest"), F.struct(F.col("tree").alias("key")).alias("row"))
    few = ranges_for(table.sparkSession, roots.count())
    top = grow(placed(stored(named), "tree", ["row.key"], few), arity, height, few)
    crown = _union([t.where(F.col("n") <= arity**height).select("tree", F.col("root").alias("top"), F.array().cast(PATH).alias("path")) for t in top])
    outer = proofs(top, crown, arity, height).select(F.col("row.key").alias("tree"), "path", F.col("digest").alias("subroot"), F.col("top").alias("root"))
    return proofs(trees, stored(outer.withColumnRenamed("root", "whole")), arity, height).select("row.doc_id", F.col("digest").alias("leaf"), "subroot", F.col("whole").alias("root"), "path", *[f"row.{n}" for n in also or {}])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def as_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, path: Column) -> Column:
    """The root (hexadecimal) that a leaf and a proof lead to."""
    return F.aggregate(path, as_text(leaf), lambda a, p: F.sha2(F.concat(as_text(p["before"]), a, as_text(p["after"])), 256))


def proof_digest(path: Column) -> Column:
    """One digest (hexadecimal) of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(as_text(p["before"]), as_text(p["after"]))), ""), 256)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by language; where 7 divides crc32(doc_id), the proof is checked against a leaf with another n_chars."""
    docs = read(spark, sf_dir, "documents")
    other = leaf_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = manifest(docs, COLUMNS, "lang", "doc_id", {"tampered": F.when(chosen, other)})
    root, again = as_text(F.col("root")), folded(F.coalesce("tampered", "leaf"), F.col("path"))
    cells = {"leaf": as_text(F.col("leaf")), "subroot": as_text(F.col("subroot")), "root": root, "proof_sha256": proof_digest(F.col("path")), "folded_root": again}
    return out.select("doc_id", *[c.alias(n) for n, c in cells.items()]).withColumn("verified", F.col("folded_root") == F.col("root"))


def _value_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _leaf_sql(plus: str = "") -> str:
    return "sha256(" + " || ".join(_value_sql(f"({c}{plus})" if c == "n_chars" else c) for c in COLUMNS) + ")"


OP11_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql(' + 1')} END AS tampered FROM documents),
leaves AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (
  SELECT 0 AS level, lang, pos, leaf AS digest, n FROM leaves
  UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY level, lang, pos // 2),
subroots AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 1) // 2 FROM over WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT f.id, v.level AS k, coalesce(CASE WHEN (f.pos >> v.level) % 2 = 1 THEN 'L' ELSE 'R' END || s.digest, 'N') AS step
  FROM leaves f JOIN (SELECT DISTINCT level, lang FROM up WHERE n > 1) v ON v.lang IS NOT DISTINCT FROM f.lang
  LEFT JOIN up s ON s.level = v.level AND s.lang IS NOT DISTINCT FROM f.lang AND s.pos = xor(f.pos >> v.level, 1::BIGINT)
  UNION ALL SELECT f.id, 1000 + v.level, coalesce(CASE WHEN (r.pos >> v.level) % 2 = 1 THEN 'L' ELSE 'R' END || s.digest, 'N')
  FROM leaves f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang CROSS JOIN (SELECT DISTINCT level FROM over WHERE n > 1) v
  LEFT JOIN over s ON s.level = v.level AND s.pos = xor(r.pos >> v.level, 1::BIGINT)),
paths AS (SELECT id, list(step ORDER BY k) AS steps, string_agg(substr(step, 2), '' ORDER BY k) AS siblings FROM steps GROUP BY id),
o AS (
  SELECT f.doc_id, f.leaf, r.subroot, (SELECT digest FROM over WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce(list_prepend(coalesce(f.tampered, f.leaf), coalesce(steps, [])),
           lambda a, s: CASE s[1] WHEN 'L' THEN sha256(substr(s, 2) || a) WHEN 'R' THEN sha256(a || substr(s, 2)) ELSE sha256(a) END) AS folded_root
  FROM leaves f JOIN subroots r ON r.lang IS NOT DISTINCT FROM f.lang LEFT JOIN paths p USING (id))
SELECT *, folded_root = root AS verified FROM o"""


def brute_force(rows: list[tuple], arity: int = 2) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof digest, folded root) of (doc_id, source, lang, n_chars, text) rows, for tests."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(row, more=0):
        doc_id, source, lang, n, text = row
        values = [doc_id, source, lang, None if n is None else n + more, text]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        """Root, and each node's (before, after) pairs."""
        paths, own, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for p, path in enumerate(paths):
                low = own[p] // arity * arity
                path.append(("".join(level[low : own[p]]), "".join(level[own[p] + 1 : low + arity])))
                own[p] //= arity
            level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        return level[0], paths

    keys = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in keys}
    grown = {k: tree([leaf(r) for r in own[k]]) for k in keys}
    root, tops = tree([grown[k][0] for k in keys]) if keys else (None, [])
    out = []
    for k, top in zip(keys, tops, strict=True):
        for r, path in zip(own[k], grown[k][1], strict=True):
            at = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            for before, after in path + top:
                at = sha(before + at + after)
            out.append((r[0], leaf(r), grown[k][0], root, sha("".join(b + a for b, a in path + top)), at))
    return out
