"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join.

Listed keys are rules (host suffix and path prefix, with a verdict) and whole canonical URLs
(blocked).  Every URL expands to the few keys that could list it: for each shape that a rule has
(labels of its host, characters of its path) the host's last labels and the path's beginning, and its
canonical form.  A Bloom block of 64 bits, fetched by one hash, discards nearly all of them, and the rest
meet the list in a hash join on the key itself, which removes the filter's false positives.  The blocks
travel packed, by broadcast, while they take at most ``MAX_FILTER_BYTES`` (33 million keys); a longer list's
filter is joined by shuffle.  DataFrame functions only.

The list is counted, and results are written to the checkpoint folder, while the plan is built: the
sizes decide between broadcast and shuffle, where keys and URLs with many rows go apart.

Defined cases: a null url, or one without ``://``, has an empty host and path, and no entry fits
it.  Repeated rows are judged alike, each row once.  Of entries listed twice the weightier counts, of
equal ones ``block``.  An empty list allows everything; an empty table gives no rows; urls of any length
and hosts of any number of labels are judged whole.  Columns other than the id and the url are not
read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, hot_keys, join_unique, read

BITS_PER_KEY = 16
#: Blocks of 64 bits in a packed row of the filter.
CHUNK = 1024
MAX_FILTER_BYTES = 64 << 20
#: Tables of more rows than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_ROWS = 300_000
#: As much for the bytes of their texts.
MAX_BROADCAST_BYTES = 64 << 20

#: The rules of the registered query (verdict, host and path prefix).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: The listed URLs of the registered query are every page below LISTED_PAGES of these hosts and sections.
LISTED_HOSTS = ["casino-win.example.com", "casino-win.example.net", "casino-win.example.org", "blog.casino-win.example.com", "blog.casino-win.example.net", "blog.casino-win.example.org"]
LISTED_SECTIONS = ["en", "de", "fr", "es"]
LISTED_PAGES = 10_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def canonical(host: Column, path: Column) -> Column:
    """Canonical URL: host without a leading www. or m., path without trailing slashes and then .html."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(F.regexp_replace(path, "/+$", ""), r"\.html$", ""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as listed entries."""
    rows = [(v, r, f"r:{r}", len(r)) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, rule string, key string, weight int")


def listed_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """A table of URLs to block as listed entries (a key may repeat); weaker than any rule, and without a rule name."""
    host, path = url_parts(F.col(url))
    key = F.concat(F.lit("u:"), canonical(host, path)).alias("key")
    entry = urls.where(host != "").select(key)
    none = F.lit(None).cast("string").alias("rule")
    return entry.select(F.lit("block").alias("verdict"), none, "key", F.lit(-1).alias("weight"))


def _mask(key: Column) -> Column:
    """Four bits of a 64-bit block."""
    h = F.xxhash64(key, F.lit(17))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 13, 26, 39)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bloom_filter(entries: DataFrame, n_blocks: int) -> DataFrame:
    """The filter in packed rows: chunk, and the bits of its CHUNK blocks in order.

    Every block gets a row without bits, so a chunk's blocks are all there and a sort brings them into their places.
    """
    every = entries.sparkSession.range(-(-n_blocks // CHUNK) * CHUNK).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("bits"))
    keyed = entries.select(_block(F.col("key"), n_blocks).alias("block"), _mask(F.col("key")).alias("bits"))
    blocks = keyed.unionByName(every).groupBy("block").agg(F.bit_or("bits").alias("bits"))
    held = blocks.groupBy(F.expr(f"block div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("block", "bits"))).alias("own"))  # CHUNK entries
    return held.select("chunk", F.col("own.bits").alias("bits"))


def _could_list(shapes: list, host: Column, path: Column) -> Column:
    """The keys that could list a URL."""
    rules = [F.concat(F.lit("r:"), F.substring_index(host, ".", -s["labels"]), F.substring(path, 1, s["chars"])) for s in shapes]
    return F.array_distinct(F.array(*rules, F.concat(F.lit("u:"), canonical(host, path))))


def filter_urls(pages: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every row of ``pages``: id, host, path, rule, verdict.

    The longest fitting rule decides; else a listed canonical URL is blocked; else it is allowed.
    """
    order = F.max(F.struct("weight", "verdict", "rule")).alias("best")
    listed = cut(entries.groupBy("key").agg(order).select("key", "best.weight", "best.rule", "best.verdict"))
    rule_host = F.regexp_extract("rule", "^[^/]*", 0)
    shape = F.struct(F.size(F.split(rule_host, r"\.")).alias("labels"), (F.length("rule") - F.length(rule_host)).alias("chars"))
    size = F.octet_length("key") + F.coalesce(F.octet_length("rule"), F.lit(0))
    counted = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.collect_set(F.when(F.col("rule").isNotNull(), shape)).alias("shapes")).first()  # a shape per form of rule
    n_blocks = max(1, counted["n"] * BITS_PER_KEY // 64)

    def sized(df: DataFrame, small: bool) -> DataFrame:
        return F.broadcast(df) if small else df

    host, path = url_parts(F.col(url_col))
    judged = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    tried = judged.where("host <> ''").select("host", "path", F.explode(_could_list(sorted(counted["shapes"]), F.col("host"), F.col("path"))).alias("key"))
    block = _block(F.col("key"), n_blocks)
    tried = tried.withColumn("block", block).withColumn("chunk", F.expr(f"block div {CHUNK}"))
    mask = _mask(F.col("key"))
    bits = F.element_at("bits", (F.pmod("block", F.lit(CHUNK)) + 1).cast("int"))
    met = tried.join(sized(bloom_filter(listed, n_blocks), n_blocks * 8 <= MAX_FILTER_BYTES), "chunk")
    possible = met.where(bits.bitwiseAND(mask) == mask).select("host", "path", "key")
    if counted["n"] <= MAX_BROADCAST_ROWS and counted["bytes"] <= MAX_BROADCAST_BYTES:
        exact = possible.join(F.broadcast(listed), "key")
    else:
        once = cut(possible.distinct())
        exact = join_unique(once, listed, ["key"], hot_keys(once.groupBy("key").agg(F.count("*").alias("n")), ["key"], once.count()))
    found = cut(exact.groupBy("host", "path").agg(F.max(F.struct("weight", "rule", "verdict")).alias("best")))
    fits = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path")), F.lit(0)).alias("bytes")).first()
    if fits["n"] <= MAX_BROADCAST_ROWS and fits["bytes"] <= MAX_BROADCAST_BYTES:
        out = judged.join(F.broadcast(found), ["host", "path"], "left")
    else:
        urls = judged.groupBy("host", "path").agg(F.count("*").alias("n"))
        out = join_unique(judged, found, ["host", "path"], hot_keys(urls, ["host", "path"], judged.count()), "left")
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def listed_pages(spark: SparkSession) -> DataFrame:
    """The listed URLs of the registered query, made by rule; most are the URL of no page."""
    numbers = spark.range(LISTED_PAGES * len(LISTED_HOSTS) * len(LISTED_SECTIONS))
    host = F.element_at(F.array(*map(F.lit, LISTED_HOSTS)), (F.pmod("id", F.lit(len(LISTED_HOSTS))) + 1).cast("int"))
    section = F.element_at(F.array(*map(F.lit, LISTED_SECTIONS)), (F.pmod(F.expr(f"id div {len(LISTED_HOSTS)}"), F.lit(len(LISTED_SECTIONS))) + 1).cast("int"))
    page = F.expr(f"id div {len(LISTED_HOSTS) * len(LISTED_SECTIONS)}").cast("string")
    return numbers.select(F.concat(F.lit("https://"), host, F.lit("/"), section, F.lit("/"), page).alias("url"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all ``pages`` by the rules and the list of 240,000 canonical URLs."""
    entries = rule_table(spark, RULES).unionByName(listed_urls(listed_pages(spark)))
    return filter_urls(read(spark, sf_dir, "pages"), entries)


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), judged AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), keyed AS (
  SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(regexp_replace(path, '/+$', ''), '[.]html$', '') AS canon,
         row_number() OVER () AS rid
  FROM judged
), feed AS (
  SELECT s || 'casino-win.example.' || t || '/' || l || '/' || n AS canon
  FROM (SELECT unnest(['', 'blog.']) AS s), (SELECT unnest(['com', 'net', 'org']) AS t),
       (SELECT unnest(['en', 'de', 'fr', 'es']) AS l), (SELECT unnest(range(0, 10000)) AS n)
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT k.rid, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY k.rid ORDER BY length(r.rhost || r.rpath) DESC, r.rhost || r.rpath DESC) AS n
  FROM keyed k JOIN rules r
    ON (k.host = r.rhost OR ends_with(k.host, '.' || r.rhost)) AND starts_with(k.path, r.rpath)
)
SELECT k.page_id, k.host, k.path, f.rule,
       coalesce(f.verdict, CASE WHEN k.canon IN (SELECT canon FROM feed) THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fits f ON f.rid = k.rid AND f.n = 1
"""
