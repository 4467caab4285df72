"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenized and cut into pieces in one narrow pass; only the pieces' ids and lengths
shuffle.  Pieces are dealt at random (by a hash) into groups of about ``group_size`` and each group
is packed by itself: full pieces fill a sequence, the others are placed best-fit (longest first, into
the fullest sequence with room) and then improved: among all underfull sequences a move, a one-for-one
or a two-for-one exchange is made when it raises the sum of squared fills, until no exchange helps or
the group has no more sequences than its tokens need; sequences that become empty go.  What the groups
leave (sequences less than ``LOOSE`` full) is dealt into groups again, whole sequences together, and
the local search goes on among those, level by level, until one group holds all that is left, or after
the first level that did not halve the number of groups.  Groups are counted from the pieces, which are written
once, so a document of any number of pieces is dealt over groups like others.  No task grows with the input.

Tokenizing: the tokenizer drops white space and never joins text across it, so texts are split at white
space and each distinct word is encoded once for each task (the tables of known words are emptied when
they have passed ``MAX_CHUNKS``).  Splitting, finding the distinct chunks and putting their ids in place
are Arrow calls on slices of about ``SLICE_BYTES``; Python sees distinct words only.

Defined cases: a null or empty text is the end token alone; a null id is kept; repeated rows are packed
each for itself; texts of any length are cut whole; equal lengths go by row and piece, where rows are
numbered by the scan (so a table that is split otherwise may be packed otherwise, and as well); an
empty table packs to no rows.  Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import functools
import os
import re
import string
import zlib
from bisect import bisect_left, insort
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, cut, read, stored

MAX_CHUNKS = 600_000
#: Texts are tokenized together up to about so many bytes; a longer one by itself.
SLICE_BYTES = 8_000_000
#: Marks that stand behind words; an apostrophe is none, for it starts contractions.
MARKS = string.punctuation.replace("'", "")
BEFORE_MARKS = f"(?s)^.*[^{re.escape(MARKS)}]"


@functools.lru_cache(maxsize=1)
def load(path: str):
    """The tokenizer of a file, read once in a Python worker; what is learned with it belongs to a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_letters() -> dict[int, str]:
    """The letter by which the tokenizer's byte level writes each byte of UTF-8, from the library itself."""
    from tokenizers import pre_tokenizers

    # All characters of up to two bytes, and one for each first byte of longer ones.
    text = "".join(map(chr, [*range(1, 0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)]))
    [(letters, _)] = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)
    return {k: v for k, v in zip(text.encode(), letters, strict=True) if k != ord(" ")}


def lowered(word: str) -> str | None:
    """A word of letters as the tokenizer lower-cases it; None if it has others, or the tokenizer would make others of them."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    # Python lower-cases a capital sigma by its place in a word, the tokenizer does not.
    low = word.replace("Σ", "σ").lower()
    return low if word.isalpha() and low.isalpha() and is_normalized("NFC", word) else None


class Known:
    """Strings in the order in which they were learned, the empty one first, and the ids of each."""

    def __init__(self):
        self.texts, self.ids = pa.array([""], pa.large_string()), pa.array([[]], pa.large_list(pa.uint32()))

    def numbers(self, texts: pa.Array, learn) -> np.ndarray:
        """The place of each of distinct texts.  ``learn`` gives the ids of new ones, or None, which is place -1."""
        found = pc.fill_null(pc.index_in(texts, value_set=self.texts), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(found < 0)
        for i in range(0, len(new), 65536):
            part = new[i : i + 65536]
            got = learn(texts.take(pa.array(part)).to_numpy(zero_copy_only=False).tolist())
            part = part[[ids is not None for ids in got]]
            got = [ids for ids in got if ids is not None]
            found[part] = len(self.texts) + np.arange(len(part))
            ends = np.cumsum([0, *map(len, got)])
            flat = np.fromiter(chain.from_iterable(got), "<u4", ends[-1])
            self.texts = pa.concat_arrays([self.texts, texts.take(pa.array(part))])
            self.ids = pa.concat_arrays([self.ids, pa.LargeListArray.from_arrays(ends, flat)])
        return found


class ChunkTokenizer:
    """Ids of whole texts, from a table of words.

    Most chunks are letters with some marks behind them.  Letters and marks are always split apart, so
    such a chunk's ids are those of both parts, and a word of letters, once it is lower-cased and written by
    its bytes, goes straight to the tokenizer's model.  Other chunks, and runs of marks, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.words, self.whole = Known(), Known()

    def _learn_words(self, words: list[str]) -> list[list[int] | None]:
        low = list(map(lowered, words))
        tokenize = self.tokenizer.model.tokenize
        written = iter(" ".join(filter(None, low)).encode().decode("latin-1").translate(byte_letters()).split(" "))
        return [w and [token.id for token in tokenize(next(written))] for w in low]

    def _learn_whole(self, chunks: list[str]) -> list[list[int]]:
        return [got.ids for got in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """For each distinct chunk two places: of its word and of the marks behind it, or of nothing and of the whole chunk."""
        # Letters A-Z in lower case are the same word; what has other characters than letters is encoded as it is.
        forms = pc.ascii_lower(pc.ascii_rtrim(chunks, MARKS)).dictionary_encode()
        word = self.words.numbers(forms.dictionary, self._learn_words)[forms.indices.to_numpy()]
        rest = pc.if_else(pa.array(word >= 0), pc.replace_substring_regex(chunks, BEFORE_MARKS, ""), chunks).dictionary_encode()
        other = self.whole.numbers(rest.dictionary, self._learn_whole)[rest.indices.to_numpy()]
        return np.stack([np.maximum(word, 0), other + len(self.words.texts)], axis=1)

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Token ids of each text, without special tokens."""
        if len(self.words.texts) + len(self.whole.texts) > MAX_CHUNKS:
            self.words, self.whole = Known(), Known()
        column = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        split = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        chunks = split.flatten().dictionary_encode()
        numbers = self._numbers(chunks.dictionary)[chunks.indices.to_numpy()].ravel()
        placed = pa.concat_arrays([self.words.ids, self.whole.ids]).take(pa.array(numbers))
        at = split.offsets.to_numpy()
        ends = placed.offsets.to_numpy()[2 * (at - at[0])]
        ids = placed.flatten().to_numpy()
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: int):
    """A batch in slices of about ``SLICE_BYTES`` of one column; no slice is empty."""
    return by_bytes(batch, column, SLICE_BYTES)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, doc_id: str, text: str, length: int, tokenizer: str, end_id: int) -> DataFrame:
    """One row per piece: row number, doc_id, piece, start, length, ids_crc32."""
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4")

    def cut_up(batches):
        encoder = ChunkTokenizer(tokenizer_path(tokenizer))
        for batch in batches:
            for part in slices(batch, 2):
                rows = []
                for row, doc, ids in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), encoder.encode(part.column(2)), strict=True):
                    ids = np.concatenate([ids, end])
                    rows += [(row, doc, k, s, len(p := ids[s : s + length]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), length))]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    fed = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return fed.mapInArrow(cut_up, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Item numbers of each bin: longest item first, into the fullest bin with room for it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in order:
        at = bisect_left(room, (lengths[i], -1))
        left, b = room.pop(at) if at < len(room) else (size, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if left > lengths[i]:
            insort(room, (left - lengths[i], b))
    return bins


class _OpenBins:
    """The underfull bins, with what each can give: its items, and the sums of two of them.

    ``lengths`` and ``bin_of`` list the items; ``pairs`` has (sum, item, item, bin) of each bin, one row per
    distinct sum.  ``stamp`` is when a bin last changed, ``seen`` when it was last tried as a giver.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.size = size
        self.items = np.array([i for b in bins for i in b], np.int64)
        self.lengths = np.array(lengths, np.int64)[self.items]
        at = np.cumsum([0, *map(len, bins)])
        self.bins = [list(range(a, b)) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.bin_of = np.repeat(np.arange(len(bins)), np.diff(at))
        self.fill = np.array([self.lengths[a:b].sum() for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
        self.pairs = np.concatenate([np.empty((4, 0), np.int64), *map(self._pairs, range(len(bins)))], axis=1)
        self.clock = 1
        self.stamp, self.seen = np.ones(len(bins), np.int64), np.zeros(len(bins), np.int64)

    def _pairs(self, b: int) -> np.ndarray:
        own = np.array(self.bins[b], np.int64)
        i, j = np.triu_indices(len(own), 1)
        sums, first = np.unique(self.lengths[own[i]] + self.lengths[own[j]], return_index=True)
        return np.stack([sums, own[i[first]], own[j[first]], np.full(len(sums), b)])

    def _best(self, given: np.ndarray, taken: np.ndarray, takers: np.ndarray, giver: int) -> tuple[int, int, int]:
        """The greatest raise of the squared fill, and the places in ``given`` and ``taken`` that make it."""
        if not len(given) or not len(taken):
            return 0, 0, 0
        fill = self.fill[takers]
        gain = given[:, None] - taken
        raised = np.where((gain > 0) & (gain <= self.size - fill), gain * (gain + (fill - self.fill[giver])), 0)
        at = int(raised.argmax())
        y, x = divmod(at, len(taken))
        return int(raised[y, x]), y, x

    def improve(self, giver: int) -> bool:
        """Make the best exchange in which ``giver`` gives to any other bin, if one helps."""
        since, self.seen[giver] = self.seen[giver], self.clock
        if not self.bins[giver]:
            return False
        # Without a change of its own, only bins that changed after the last try can offer anything new.
        fresh = self.fill < self.size
        fresh[giver] = False
        if self.stamp[giver] <= since:
            fresh &= self.stamp > since
        takers = np.flatnonzero(fresh & (self.fill > 0))
        if not len(takers):
            return False
        own = np.array(self.bins[giver], np.int64)
        _, first = np.unique(self.lengths[own], return_index=True)
        own = own[first]
        two = self._pairs(giver)
        single = np.flatnonzero(fresh[self.bin_of])
        double = self.pairs[:, fresh[self.pairs[3]]]
        ones, homes = self.lengths[single], self.bin_of[single]
        tried = [
            self._best(self.lengths[own], np.zeros(len(takers), np.int64), takers, giver),
            self._best(self.lengths[own], ones, homes, giver),
            self._best(two[0], ones, homes, giver),
            self._best(self.lengths[own], double[0], double[3], giver),
        ]
        kind = max(range(4), key=lambda k: tried[k][0])
        raised, y, x = tried[kind]
        if not raised:
            return False
        gives = two[1:3, y].tolist() if kind == 2 else [int(own[y])]
        takes, taker = ([], takers[x]) if kind == 0 else (double[1:3, x].tolist(), double[3, x]) if kind == 3 else ([int(single[x])], homes[x])
        self._swap(giver, int(taker), gives, takes)
        return True

    def _swap(self, giver: int, taker: int, gives: list[int], takes: list[int]) -> None:
        for out, into, moved in ((giver, taker, gives), (taker, giver, takes)):
            for i in moved:
                self.bins[out].remove(i)
                self.bins[into].append(i)
                self.bin_of[i] = into
                self.fill[out] -= self.lengths[i]
                self.fill[into] += self.lengths[i]
        self.clock += 1
        self.stamp[[giver, taker]] = self.clock
        others = (self.pairs[3] != giver) & (self.pairs[3] != taker)
        self.pairs = np.concatenate([self.pairs[:, others], self._pairs(giver), self._pairs(taker)], axis=1)


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Exchange items between underfull bins until no exchange raises the sum of squared fills.

    Every underfull bin gives to every other, the emptiest first, and passes go on until a full one
    changes nothing.  They end before only when even a perfect packing could not save a bin.  A full
    bin takes part in no exchange that raises the squares.
    """
    sums = [sum(lengths[i] for i in b) for b in bins]
    done = [b for b, s in zip(bins, sums, strict=True) if s == size]
    open_ = [b for b, s in zip(bins, sums, strict=True) if s < size]
    least = -(-sum(s for s in sums if s < size) // size)
    if len(open_) <= least:
        return done + open_
    state = _OpenBins(open_, lengths, size)
    left, changed = len(open_), True
    while changed and left > least:
        changed = False
        for giver in np.argsort(state.fill, kind="stable").tolist():
            while left > least and state.improve(giver):
                changed = True
                left -= not state.bins[giver]
    return done + [state.items[b].tolist() for b in state.bins if b]


#: Sequences filled less than this share are offered to the next level.
LOOSE = 0.95
PLACED = ["row", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]
SCHEMA = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def pack_group(frame: pd.DataFrame, size: int, first_id: int) -> pd.DataFrame:
    """Sequences, offsets and fills for the pieces of one group: of its sequences if it has some, else best-fit ones."""
    frame = frame.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
    lengths = frame["length"].tolist()
    if "sequence_id" in frame:
        bins = [own.tolist() for own in frame.groupby("sequence_id", sort=True).indices.values()]
    else:
        bins = best_fit(lengths, size)
    sequence, offset, fill = (np.zeros(len(frame), np.int64) for _ in range(3))
    for number, items in enumerate(local_search(bins, lengths, size)):
        at = 0
        for i in items:
            sequence[i], offset[i] = number, at
            at += lengths[i]
        fill[items] = at
    return frame.assign(sequence_id=first_id + sequence, offset=offset, fill=fill)[PLACED]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 2048, tokenizer: str = "word_bpe_49k.json", end_id: int = 0, group_size: int = 4000) -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens; one row per piece."""

    def placed(dealt: DataFrame, level: int) -> DataFrame:
        def place(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pack_group(frame.drop(columns="part"), length, (level << 56) + (int(key[0]) << 32))

        return cut(dealt.groupBy("part").applyInPandas(place, SCHEMA))

    cuts = stored(pieces(docs, doc_id, text, length, tokenizer, end_id))
    groups = max(1, -(-cuts.count() // group_size))
    dealt = cuts.withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)))
    done, loose = [], placed(dealt, 0)
    for level in range(1, 64):
        if groups == 1:
            break
        done.append(loose.where(F.col("fill") >= LOOSE * length))
        rest = loose.where(F.col("fill") < LOOSE * length)
        before, groups = groups, max(1, -(-rest.count() // group_size))
        loose = placed(rest.drop("offset", "fill").withColumn("part", F.pmod(F.xxhash64("sequence_id"), F.lit(groups))), level)
        if groups * 2 > before:
            break
    out = loose
    for part in done:
        out = out.unionByName(part)
    return out.drop("row", "fill")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in sequences of 2048 tokens."""
    return pack(read(spark, sf_dir, "documents"))


def fewest_bins(lengths: list[int], size: int) -> int:
    """The least number of bins, by trying all placements, for tests with few items."""
    order, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i: int, fills: list[int]) -> None:
        if len(fills) >= best[0]:
            return
        if i == len(order):
            best[0] = len(fills)
            return
        for b in range(len(fills)):
            if fills[b] + order[i] <= size and fills[b] not in fills[:b]:
                fills[b] += order[i]
                put(i + 1, fills)
                fills[b] -= order[i]
        put(i + 1, [*fills, order[i]])

    put(0, [])
    return best[0]
