r"""Conversation structure repair: faults by windows, cheapest edits by a fold of Spark SQL's higher-order functions.

A conversation is legal if its role initials are ``(s?(ua)+)?``.  An automaton of four states reads them (start, after
a system turn, after a user turn, after an assistant turn; start and the last one accept), and ``aggregate()`` carries
for each state the cheapest (cost, audit) that leads there: ``least`` over structs takes the lower cost, then the
ASCII-least audit.  Edits: Keep costs 0, Rerole to user or assistant 2, Delete 3 (required for blank and repeated turns),
Insert an empty user or assistant turn 2; a truncated turn that stays adds 1.  State and letter give the role, so an
audit tells the repaired conversation.

A conversation may hold any share of all rows: turns get their places by a sort over ranges (``placed_in_order``) and are folded
in chunks of ``CHUNK`` turns.  A chunk after the first is folded from each of the four states, and chunks, then
groups of ``GROUP`` of them, compose like matrices of (cost, audit) until one is left.  Repeats are found by windows
over a turn's digest within a chunk, then over the chunks' first ones.  The audit is one value of a conversation's row.
Repaired turns stream in order through one task for each conversation, one turn in memory.

Defined cases: a null role or text is one space; rows go by turn (null first), then role and text; a null id is one
conversation; repeated rows are turns of their own; roles with another initial cannot be kept; a conversation without
rows has no edits; an empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_sql, placed_in_order, ranges_for, read, stored

BLANKS = " \t\n\x0b\x0c\r"
CHUNK = 1024
GROUP = 32
#: More than any cost that edits can reach.
UNREACHED = 1 << 50
STATES = ("start", "system", "user", "assistant")
WAY = "struct<" + ",".join(f"{s}:struct<cost:bigint,audit:string>" for s in STATES) + ">"


def flagged(rows: DataFrame, ranges: int) -> DataFrame:
    """Turns in their places: key, conv_id, turn, role, text, tie, at.

    ``rows`` (conv_id, turn, role, text) must be a scan or a stored table, narrowly transformed.
    """
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    blank = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    turns = rows.select(key.alias("key"), "conv_id", "turn", *blank, F.monotonically_increasing_id().alias("tie"))
    return placed_in_order(turns, "key", ["turn", "role", "text", "tie"], ranges)


def faults(turns: DataFrame) -> DataFrame:
    """Each turn without its text: key, conv_id, at, chunk, turn, initial, fault (blank, duplicate, truncated or null)."""
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said")
    small = turns.select("key", "conv_id", "at", F.expr(f"`at` div {CHUNK}").alias("chunk"), "turn", F.substring("role", 1, 1).alias("initial"), said, last.alias("last"))
    within = small.withColumn("again", F.row_number().over(Window.partitionBy("key", "said", "chunk").orderBy("at")) > 1)
    first = within.where("NOT again").withColumn("again", F.row_number().over(Window.partitionBy("key", "said").orderBy("at")) > 1)
    whole = first.unionByName(within.where("again"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    return whole.select("key", "conv_id", "at", "chunk", "turn", "initial", fault.alias("fault"))


def _edit(way: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((way["cost"] + cost).cast("long").alias("cost"), F.concat(way["audit"], F.lit(letter)).alias("audit"))


def _ways(*ways: Column) -> Column:
    return F.struct(*[w.alias(s) for s, w in zip(STATES, ways, strict=True)]).cast(WAY)


def inserted_user(w: Column) -> Column:
    return _ways(w["start"], w["system"], F.least(w["user"], *[_edit(w[s], 2, "I") for s in ("start", "system", "assistant")]), w["assistant"])


def inserted_assistant(w: Column) -> Column:
    return _ways(w["start"], w["system"], w["user"], F.least(w["assistant"], _edit(w["user"], 2, "I")))


def taken(w: Column, turn: Column) -> Column:
    """The ways after a turn: deleted, kept where its role fits, or given another role."""
    stays = turn["fault"].isNull() | (turn["fault"] == "truncated")
    more = F.when(turn["fault"] == "truncated", 1).otherwise(0)

    def kept(initial: str, way: Column) -> Column:
        return F.when(stays & (turn["initial"] == initial), _edit(way, more, "K"))

    def reroled(way: Column) -> Column:
        return F.when(stays, _edit(way, more + 2, "R"))

    gone = [_edit(w[s], 3, "D") for s in STATES]
    to_user = [w[s] for s in ("start", "system", "assistant")]
    return _ways(
        gone[0],
        F.least(gone[1], kept("s", w["start"])),
        F.least(gone[2], *[kept("u", s) for s in to_user], *[reroled(s) for s in to_user]),
        F.least(gone[3], kept("a", w["user"]), reroled(w["user"])),
    )


def started(state: Column) -> Column:
    """The ways before any turn, from a state."""
    return _ways(*[F.struct(F.when(state == s, 0).otherwise(UNREACHED).cast("long").alias("cost"), F.lit("").alias("audit")) for s in STATES])


def walked(turns: Column, state: Column) -> Column:
    """The ways through an array of turns (initial, fault): a turn is three steps, so that no step repeats another's work."""
    steps = F.flatten(F.transform(turns, lambda t: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: F.struct(k.alias("k"), t["initial"].alias("initial"), t["fault"].alias("fault")))))
    return F.aggregate(steps, started(state), lambda w, t: F.when(t["k"] == 0, inserted_user(w)).when(t["k"] == 1, inserted_assistant(w)).otherwise(taken(w, t)))


def composed(parts: Column, state: Column) -> Column:
    """The ways through an array of parts, each with its ways from every state it can be entered in."""

    def step(w: Column, part: Column) -> Column:
        def through(i: int, s: str, to: str) -> Column:
            way = F.get(part["ways"], F.lit(i))
            return F.when(way.isNotNull(), F.struct((w[s]["cost"] + way[to]["cost"]).alias("cost"), F.concat(w[s]["audit"], way[to]["audit"]).alias("audit")))

        return _ways(*[F.least(*[through(i, s, to) for i, s in enumerate(STATES)]) for to in STATES])

    return F.aggregate(parts, started(state), step)


def _from_all(fold, parts: Column) -> Column:
    """Ways from the start alone for a conversation's first part, from every state for others."""
    entered = F.when(F.col("chunk") == 0, F.array(F.lit(STATES[0]))).otherwise(F.array(*map(F.lit, STATES)))
    return F.transform(entered, lambda state: fold(parts, state))


def repairs(marked: DataFrame) -> DataFrame:
    """One row per conversation of ``faults``: key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    turn = F.struct("at", "turn", "initial", "fault")
    chunks = marked.groupBy("key", "chunk").agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.min("conv_id").alias("conv_id"), F.size(F.collect_set("turn")).cast("long").alias("days"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    pair = F.transform(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: F.concat(F.get(F.col("turns"), i - 1)["initial"], F.get(F.col("turns"), i)["initial"]))
    bad = F.when(F.size("turns") < 2, 0).otherwise(F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au"))))
    first, last = F.get("turns", F.lit(0)), F.element_at("turns", -1)
    ends = [first["initial"].alias("i0"), last["initial"].alias("i1"), F.array_min("turns.turn").alias("t0"), F.array_max("turns.turn").alias("t1")]
    parts = stored(chunks.select("key", "chunk", "conv_id", "days", "blank", "duplicate", "truncated", bad.cast("long").alias("illegal"), *ends, _from_all(walked, F.col("turns")).alias("ways")))
    group = F.expr(f"chunk div {GROUP}")
    own = Window.partitionBy("key", group).orderBy("chunk")
    while not parts.where("chunk > 0").isEmpty():
        # Neighbouring parts of a group share a turn number, or make an illegal pair, where they meet.
        before = {c: F.lag(c).over(own) for c in ("i1", "t1")}
        met = parts.withColumn("same", (F.col("t0") == before["t1"]).cast("long")).withColumn("clash", (~F.concat(before["i1"], "i0").isin("su", "ua", "au")).cast("long"))
        grouped = met.withColumn("part", F.col("chunk")).withColumn("chunk", group).groupBy("key", "chunk").agg(
            F.sort_array(F.collect_list(F.struct("part", "ways"))).alias("parts"), F.min("conv_id").alias("conv_id"), (F.sum("days") - F.coalesce(F.sum("same"), F.lit(0))).alias("days"),
            *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], (F.sum("illegal") + F.coalesce(F.sum("clash"), F.lit(0))).alias("illegal"),
            F.min_by("i0", "part").alias("i0"), F.max_by("i1", "part").alias("i1"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        )
        parts = stored(grouped.select("key", "chunk", "conv_id", "days", "blank", "duplicate", "truncated", "illegal", "i0", "i1", "t0", "t1", _from_all(composed, F.col("parts")).alias("ways")))
    closed = parts.withColumn("w", inserted_user(F.get("ways", F.lit(0)))).withColumn("w", inserted_assistant(F.col("w")))
    best = F.least("w.start", "w.assistant")
    gaps = F.coalesce(F.col("t1") - F.col("t0") + 1 - F.col("days"), F.lit(0)).cast("long")
    return closed.select("key", "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


def applied(events: Iterable[tuple]) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) turns of a conversation from its events in order: (edits, None, None), then (None, role, text)."""
    before, due = "", ""
    for edits, role, text in events:
        if edits is None:
            letter = due
            if letter == "D":
                continue
            if letter == "R":
                role = "assistant" if before == "u" else "user"
            before = role[:1]
            yield role, text
            continue
        for letter in edits:
            if letter == "I":
                new = "assistant" if before == "u" else "user"
                before = new[:1]
                yield new, ""
            due = letter


def _events(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """Edits (``I*`` and a letter for each turn, ``I*`` at the end) and turns of each conversation, together and in order."""
    each = repaired.select("key", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]"), F.lit(0))).alias("at", "edits"))
    end = repaired.select("key", F.lit(1 << 60).alias("at"), F.regexp_extract("audit", r"I*\z", 0).alias("edits")).where("edits <> ''")
    edits = each.select("key", F.col("at").cast("long"), "edits").unionByName(end).select("key", "at", "edits", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = turns.select("key", "at", F.lit(None).cast("string").alias("edits"), "role", "text")
    return edits.unionByName(rows).repartition("key").sortWithinPartitions("key", "at", F.col("edits").isNull()).select("key", "edits", "role", "text")


def _conversations(batches) -> Iterator[tuple[str, Iterator[tuple[str, str]]]]:
    rows = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for key, own in groupby(rows, key=lambda r: r[0]):
        yield key, applied(r[1:] for r in own)


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations: key, place (from 0), role, text."""

    def run(batches):
        names = ["key", "place", "role", "text"]
        for key, own in _conversations(batches):
            part, size = [], 0
            for place, (role, text) in enumerate(own):
                part.append((key, place, role, text))
                size += len(text)
                if len(part) == 1000 or size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names)
                    part, size = [], 0
            if part:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names)

    return _events(turns, repaired).mapInArrow(run, "key string, place long, role string, text string")


def repaired_digests(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """Per conversation: key, SHA-256 of its repaired ``role:text`` lines (joined by line ends), read turn by turn."""

    def run(batches):
        out: list[tuple[str, str]] = []
        for key, own in _conversations(batches):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(own):
                digest.update(f"{chr(10) if place else ''}{role}:{text}".encode())
            out.append((key, digest.hexdigest()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "repaired_sha256"])

    return _events(turns, repaired).mapInArrow(run, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, without stops, repeated or said by a user."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    which = F.crc32(F.concat(texts[0], F.lit(":"), texts[1]).cast("binary")) % 20
    text = F.when(which == 1, "").when(which == 2, F.regexp_replace(texts[3], "[.!?]", "")).otherwise(texts[3])
    role = F.when(which == 4, "user").otherwise(texts[2])
    copies = F.explode(F.when(which == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.where(which != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The placed turns of conversations (conv_id, turn, role, text), and one row of repairs for each conversation."""
    ranges = ranges_for(rows.sparkSession, rows.count(), 100_000)
    turns = flagged(rows, ranges)
    return turns, stored(repairs(faults(turns)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule, and what repairs each of them."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turns, found = repair(damaged(rows))
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    every = rows.select(key.alias("key"), "conv_id").distinct()
    out = every.join(found.drop("conv_id").join(repaired_digests(turns, found), "key", "left"), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _add(way: str, cost: str, letter: str) -> str:
    return f"(printf('%08d', {way}[1:8]::BIGINT + {cost}) || substr({way}, 9) || '{letter}')"


_MORE = "(CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END)"
_STAYS = "(fault IS NULL OR fault = 'truncated')"
_CLOSED = f"(SELECT *, least(w3, {_add('c2', '2', 'I')}) AS c3 FROM (SELECT *, least(w2, {_add('w0', '2', 'I')}, {_add('w1', '2', 'I')}, {_add('w3', '2', 'I')}) AS c2 FROM walk))"

#: Ways are texts here: the cost in eight digits, then the audit.
OP13_SQL = rf"""
WITH RECURSIVE d0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k FROM conversations),
d1 AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d0 WHERE k <> 0),
r0 AS (
  SELECT *, substr(role, 1, 1) AS i, row_number() OVER w - 1 AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM d1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
r AS (
  SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS i0,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM r0),
c AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, '00000000' AS w0, '50000000' AS w1, '50000000' AS w2, '50000000' AS w3 FROM c
  UNION ALL SELECT z.conv_id, z.pos + 1, {_add('w0', '3', 'D')},
    least({_add('w1', '3', 'D')}, CASE WHEN {_STAYS} AND i = 's' THEN {_add('w0', _MORE, 'K')} END),
    least({_add('c2', '3', 'D')}, CASE WHEN {_STAYS} AND i = 'u' THEN least({_add('w0', _MORE, 'K')}, {_add('w1', _MORE, 'K')}, {_add('c3', _MORE, 'K')}) END,
      CASE WHEN {_STAYS} THEN least({_add('w0', _MORE + ' + 2', 'R')}, {_add('w1', _MORE + ' + 2', 'R')}, {_add('c3', _MORE + ' + 2', 'R')}) END),
    least({_add('c3', '3', 'D')}, CASE WHEN {_STAYS} AND i = 'a' THEN {_add('c2', _MORE, 'K')} END, CASE WHEN {_STAYS} THEN {_add('c2', _MORE + ' + 2', 'R')} END)
  FROM {_CLOSED} z JOIN r ON r.conv_id IS NOT DISTINCT FROM z.conv_id AND r.pos = z.pos),
best AS (
  SELECT conv_id, least(w0, c3) AS w FROM {_CLOSED.replace('FROM walk', 'FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1')}),
a AS (SELECT conv_id, w[1:8]::BIGINT AS cost, substr(w, 9) AS audit FROM best),
told AS (
  SELECT conv_id, audit, 1 AS k, 0::BIGINT AS pos, '' AS before, '' AS said FROM a
  UNION ALL SELECT conv_id, audit, k + 1, pos, CASE WHEN line IS NULL THEN before ELSE line[1] END, said || coalesce(CASE WHEN said = '' THEN '' ELSE chr(10) END || line, '')
  FROM (SELECT t.conv_id, t.audit, t.k, t.before, t.said, t.pos + CASE WHEN audit[k] = 'I' THEN 0 ELSE 1 END AS pos,
          CASE audit[k] WHEN 'I' THEN CASE WHEN before = 'u' THEN 'assistant' ELSE 'user' END || ':' WHEN 'K' THEN r.role || ':' || r.text
               WHEN 'R' THEN CASE WHEN before = 'u' THEN 'assistant' ELSE 'user' END || ':' || r.text END AS line
        FROM told t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.pos = t.pos WHERE t.k <= length(t.audit))),
s AS (SELECT conv_id, sha256(said) AS repaired_sha256 FROM told WHERE k = length(audit) + 1),
g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, repaired_sha256
FROM c JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id"""


def brute_force(rows: list[tuple]) -> dict:
    """conv_id to (gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (conv_id, turn, role, text) rows, for tests.

    All ways are searched, cheapest first, one edit at a time.
    """
    import heapq

    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        fault, seen = [], set()
        for _, role, text in own:
            bare = text.rstrip(BLANKS)
            fault.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        heap, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, said = heapq.heappop(heap)
            if i == len(own) and state in ("", "a"):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            for role in ("user", "assistant"):
                if role[0] in after[state]:
                    heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*said, f"{role}:")))
            if i < len(own):
                heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, said))
                if fault[i] in (None, "truncated"):
                    more = int(fault[i] == "truncated")
                    if initials[i] in after[state]:
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials[i], (*said, f"{own[i][1]}:{own[i][2]}")))
                    for role in ("user", "assistant"):
                        if role[0] in after[state]:
                            heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, role[0], (*said, f"{role}:{own[i][2]}")))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *[fault.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out
