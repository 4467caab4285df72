"""Near-duplicate detection with fast similarity sketching, banding and exact verification.

1. One narrow pass turns a text into its set of word shingles (64-bit hashes), and the set into a
   sketch of ``t`` bins by rounds of hashed bin placement: in round i < t every element draws a bin
   and a value, and the least value of the earliest round stays; in round t + j all elements
   compete for bin j.  Rounds end when every bin is filled, so no bin stays empty and each
   coordinate agrees between two sets with probability equal to their Jaccard similarity, with
   concentration as strong as for independent draws.
2. Equal word sequences form a class, represented by its smallest id (only a digest shuffles).  A
   class is dealt by a salt into parts of its own smallest ids, so copies of a third of all rows
   never meet in one task; only the parts' ids take part in what follows.
3. Bands of ``rows`` coordinates give bucket keys.  A bucket links its members to its smallest id
   (no pairs within a bucket), and the links' connected components are candidate clusters: two
   representatives that share a bucket are in the same cluster.
4. Texts of the representatives in clusters go to their clusters.  A task compares members that
   share a bucket on their full sets, most alike first, and skips pairs already connected.  A
   cluster of more than ``block`` members or ``block_bytes`` of text is split into blocks and each pair of
   blocks is a group, so that no task holds more than about two blocks of either measure.
5. Verified links give the components; class members take their part's.

Joins on a bucket or a component treat keys with many rows apart (``join_unique``).

The number of bands is the smallest for which a pair at the threshold is missed with a probability
of at most ``MISS``.

Defined cases: words are parted by ASCII blanks alone, so other blanks are words; a text without
words (null, empty, blank) has an empty set and is linked with nothing; fewer words than a shingle
form one shingle; repeated rows and ids share a component; a row with a null id has a null component
and is kept; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, hot_keys, join_unique, read, stored

BAND_ROWS = 5
MISS = 1e-5
MAX_WORDS = 400_000
GOLDEN = 0x9E3779B97F4A7C15


def bands(percent: int) -> int:
    """Bands needed at a threshold of ``percent`` per cent."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer of x xor-ed with a salt's own bits."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((salt + 1) * GOLDEN & (1 << 64) - 1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered (the table is emptied at ``MAX_WORDS``)."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words (of all, if there are fewer)."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(size, n)
    out = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix(out + hashes[k : n - size + 1 + k], k)
    return np.unique(out)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: t filled bins (64-bit values)."""
    none = np.uint64((1 << 64) - 1)
    bins = np.full(t, none, np.uint64)
    empty = t
    for i in range(2 * t):
        h = mix(elements, i)
        fresh = np.full(t, none, np.uint64)
        if i < t:
            np.minimum.at(fresh, (h % np.uint64(t)).astype(np.int64), h >> np.uint64(16))
        else:
            fresh[i - t] = h.min() >> np.uint64(16)
        # A round's values come after all values of earlier rounds, so they fill empty bins only.
        put = (bins == none) & (fresh != none)
        bins[put] = fresh[put] ^ np.uint64(i << 48)
        empty -= int(put.sum())
        if not empty:
            break
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    grid = bins.reshape(-1, BAND_ROWS)
    out = np.arange(len(grid), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BAND_ROWS):
            out = mix(out + grid[:, k], k)
    return out.view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, n_bands: int) -> DataFrame:
    """Per row: id, number of shingles, bytes of text, digest of the word sequence, bucket keys."""
    names = ["doc_id", "n", "bytes", "digest", "keys"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def sign(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                for raw in as_bytes(part.column(1)):
                    own = (raw or b"").lower().split()
                    if not own:
                        out.append((0, 0, None, None))
                        continue
                    got = shingles(known.of(own), shingle)
                    out.append((len(got), len(raw), xxhash.xxh3_128_digest(b" ".join(own)), band_keys(sketch(got, n_bands * BAND_ROWS))))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], names)

    fed = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return fed.mapInArrow(sign, "doc_id long, n long, bytes long, digest binary, keys array<long>")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a link table: (id, component), component the smallest id.

    Every round a node takes the least label of its neighbours and of the node its own label names: both
    are lookups in one table, so a round is one join and one minimum.  A hub's links or a large
    component's members make a hot key of that join's long side, which adaptive execution splits over tasks
    (the labels have each key once); the minimum is combined before its shuffle.
    """
    # Written once before it is mirrored: links may come out otherwise when they are computed again.
    one = stored(links.select(F.col(a).alias("k"), F.col(b).alias("x")).distinct())
    both = one.unionByName(one.select(F.col("x").alias("k"), F.col("k").alias("x")))
    labels = stored(both.groupBy("x").agg(F.least(F.col("x"), F.min("k")).alias("l")))
    asked = both.withColumn("was", F.lit(None).cast("long"))
    while True:
        lookups = asked.unionByName(labels.select(F.col("l").alias("k"), "x", F.col("l").alias("was")))
        found = lookups.join(labels.select(F.col("x").alias("k"), "l"), "k")
        labels = stored(found.groupBy("x").agg(F.min("l").alias("l"), F.max("was").alias("was")))
        if labels.where("was <> l").isEmpty():
            return labels.select(F.col("x").alias("id"), F.col("l").alias("component"))
        labels = labels.drop("was")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b| for sorted distinct arrays."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def verified_links(ids: np.ndarray, texts: list[bytes], crossing: np.ndarray | None, shingle: int, percent: int, known: WordHashes) -> list[tuple[int, int]]:
    """Links that connect the members as all verified links would.

    ``crossing``: block numbers; then only pairs from different blocks are compared.
    """
    n_bands = bands(percent)
    sets = [shingles(known.of(t.lower().split()), shingle) for t in texts]
    sketches = np.array([sketch(s, n_bands * BAND_ROWS) for s in sets])
    keys = np.array([band_keys(s) for s in sketches])
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    lo, hi, score = [], [], []
    for i in range(len(ids) - 1):
        later = np.arange(i + 1, len(ids)) if crossing is None else i + 1 + np.flatnonzero(crossing[i + 1 :] != crossing[i])
        later = later[(keys[later] == keys[i]).any(axis=1)]
        if len(later):
            lo.append(np.full(len(later), i, np.int32))
            hi.append(later.astype(np.int32))
            score.append((sketches[later] == sketches[i]).sum(axis=1).astype(np.int16))
    if not lo:
        return []
    lo, hi, score = map(np.concatenate, (lo, hi, score))
    links = []
    for at in np.argsort(-score, kind="stable"):
        i, j = int(lo[at]), int(hi[at])
        if find(i) != find(j) and alike(sets[i], sets[j], percent):
            root[find(j)] = find(i)
            links.append((int(ids[i]), int(ids[j])))
    return links


#: Members of clusters that a broadcast may carry to the texts (each a few numbers); more go by shuffle.
MAX_BROADCAST_ROWS = 300_000


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, block: int = 3000, block_bytes: int = 24 << 20) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    signed = cut(signatures(docs, doc_id, text, shingle, bands(percent)))
    rows = signed.count()
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(max(8, rows // 100_000)))
    linked = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    parts = cut(linked.groupBy("digest", salt.alias("salt")).agg(F.min("doc_id").alias("low"), F.first("keys").alias("keys"), F.max("bytes").alias("bytes")))
    classes = parts.groupBy("digest").agg(F.min("low").alias("rep"), F.min_by("keys", "low").alias("keys"), F.max("bytes").alias("bytes"))
    classes = cut(classes.select("digest", "rep", "keys", "bytes"))
    owners = parts.select("digest", "low").join(classes.select("digest", "rep"), "digest").where("low <> rep").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    members = linked.select("doc_id", "n", "digest", salt.alias("salt")).join(parts.select("digest", "salt", "low"), ["digest", "salt"]).select("doc_id", "n", "low")
    # An id may have rows with different texts: it then ties its classes together.
    several = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where("n > 1")
    repeated = not several.isEmpty()
    if repeated:
        own = cut(members.join(several.where("d0 <> d1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "low").distinct())
        least = cut(own.groupBy("doc_id").agg(F.min("low").alias("a"), F.count("*").alias("n")))
        tied = join_unique(own, least.select("doc_id", "a"), ["doc_id"], hot_keys(least, ["doc_id"], own.count())).where("a <> low")
        owners = owners.unionByName(tied.select("a", F.col("low").alias("b")))

    buckets = classes.select("rep", F.explode("keys").alias("bucket"))
    least = cut(buckets.groupBy("bucket").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1"))
    common = hot_keys(least, ["bucket"], least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    stars = join_unique(buckets, least.select("bucket", "a"), ["bucket"], common).where("rep > a").select("a", F.col("rep").alias("b")).distinct()
    clusters = components(stars)
    # A representative of several classes stands for each of their texts.
    sized = clusters.join(classes.groupBy(F.col("rep").alias("id")).agg(F.sum("bytes").alias("bytes")), "id")
    sizes = cut(sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")))
    # Blocks of a large cluster; a member goes to the group of its block with each other block.
    n_blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes), F.lit(1)).cast("int")
    split = sizes.select("component", n_blocks.alias("blocks"))
    held = join_unique(clusters, split, ["component"], hot_keys(sizes, ["component"], clusters.count()))
    held = held.select("id", "component", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    routed = cut(held.select("id", "own", F.col("component").alias("c"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")))

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    chosen = texts.join(F.broadcast(routed) if routed.count() <= MAX_BROADCAST_ROWS else routed, "id")
    if repeated:
        chosen = chosen.dropDuplicates()

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        raw = [t.encode() for t in frame["text"]]
        some = np.array([bool(t.split()) for t in raw], bool)
        frame, raw = frame[some], [t for t, s in zip(raw, some, strict=True) if s]
        order = np.argsort(frame["id"].to_numpy(), kind="stable")
        frame, raw = frame.iloc[order], [raw[i] for i in order]
        crossing = None if frame["p"].iloc[:1].eq(frame["q"].iloc[:1]).all() else frame["own"].to_numpy()
        links = verified_links(frame["id"].to_numpy(), raw, crossing, shingle, percent, WordHashes())
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    found = chosen.groupBy("c", "p", "q").applyInPandas(verify, "a long, b long")
    comps = components(found.where("a <> b").unionByName(owners))
    labelled = members.join(comps.withColumnRenamed("id", "low"), "low", "left").select("doc_id", "n", F.coalesce("component", "low").alias("component_id"))
    bare = signed.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n")
    if repeated:
        # Rows without words share the component of their id's other rows.
        ids = cut(bare.select("doc_id").distinct())
        known = labelled.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        counts = bare.groupBy("doc_id").agg(F.count("*").alias("n"))
        bare = join_unique(bare, known, ["doc_id"], hot_keys(counts, ["doc_id"], bare.count()), "left")
    else:
        bare = bare.withColumn("component_id", F.col("doc_id"))
    out = labelled.unionByName(bare.withColumn("component_id", F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85 on five words."""
    return near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def brute_force(rows: list[tuple[int, str | None]], shingle: int = 5, percent: int = 85) -> list[tuple]:
    """What near_duplicates returns for small tables, for tests."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, (a, _) in enumerate(rows):
            for j, (b, _) in enumerate(rows):
                if (a == b and i != j) or (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])):
                    low = min(label[a], label[b])
                    if label[a] != low or label[b] != low:
                        label[a] = label[b] = low
                        changed = True
    return [(i, len(s), label[i], label[i] == i) for (i, _), s in zip(rows, sets, strict=True)]
