"""Packing documents into token sequences, shortest pack first over the length histogram.

1. Each document is encoded, the end id is put after it, and what exceeds a sequence is cut into full
   pieces and a rest. A piece gets its rank among the pieces of its length in its partition; the pieces
   are written as a table in the shared folder, which fixes these ranks.
2. The histogram of lengths (as many rows as a sequence has tokens, whatever the corpus) goes to the
   driver. There lengths are placed longest first, each into the shortest open pack; equal packs are one
   pattern with a count, so the work follows the number of lengths and not that of documents. As many
   empty packs as the tokens fill are open from the start; more are opened when nothing fits.
3. Ranks become global by adding, for each length, the counts of the partitions before: a window over
   the small table of counts. (length, rank) then falls in one slot of one pattern, which gives the
   sequence and the offset in it.

Nulls count as empty texts, which have the end id alone; repeated rows are packed as often as they occur; rows
with a null key are packed too; an empty table gives an empty table. A text of any length is encoded whole and cut at capacity. Other columns
of the table are not looked at, so their names may clash.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import documents, loaded, slices, whole_text, written
from packetloom.llm.wordbpe import WordBpe, spread

END_ID = 2
CAPACITY = 4096
#: Words of more bytes take the pair occurrence index.
LONG = 64
NONE = np.uint64(2**64 - 1)
EMPTY = NONE
LOW = np.uint64(2**32 - 1)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Ids(WordBpe):
    """The ids that the tokenizers library gives, for all distinct words of a batch in rounds of numpy steps: in each, every word merges its first pair of least rank.

    Nothing is kept from batch to batch. Words of over `LONG` bytes, which would need many rounds, take the pair occurrence index.
    """

    def __init__(self, path: str):
        super().__init__(path)
        keys = np.array([a << 32 | b for a, b in self.ranks], "u8")
        values = np.array([r << 32 | new for r, new in self.ranks.values()], "u8")
        # a hash table with free places next to taken ones: (key, rank and merged symbol)
        self.shift = np.uint64(64 - 19)
        self.keys, self.values = np.full((1 << 19) + 64, EMPTY), np.zeros((1 << 19) + 64, "u8")
        place = ((keys * FACTOR) >> self.shift).astype("i8")
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            at = place[left] + self.probes
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] == EMPTY]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            left = np.delete(left, first)
            self.probes += 1
        self.first = np.array(self.inner, "i8")
        self.final = np.array(self.last, "i8")

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and merged symbol of each pair, NONE where it is no pair."""
        key = a.astype("u8") << np.uint64(32) | b.astype("u8")
        place = ((key * FACTOR) >> self.shift).astype("i8")
        held = self.keys[place]
        out = np.where(held == key, self.values[place], NONE)
        open_ = np.flatnonzero((held != key) & (held != EMPTY))
        for k in range(1, self.probes):
            if not len(open_):
                break
            at = place[open_] + k
            held = self.keys[at]
            hit = held == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (held != EMPTY)]
        return out

    def merged(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(edges) < 2:
            return np.empty(0, "<u4"), np.empty(0, "i8")
        words = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype("i4")), pa.py_buffer(raw)]).dictionary_encode()
        _, offsets, data = words.dictionary.buffers()
        at = np.frombuffer(offsets, "i4")[: len(words.dictionary) + 1].astype("i8")
        ids, size = self.by_rounds(np.frombuffer(data, "u1")[: at[-1]], at)
        which = words.indices.to_numpy()
        return spread(ids, np.concatenate(([0], np.cumsum(size))), which)[0], size[which]

    def by_rounds(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, one after another, and how many each has."""
        n = len(at) - 1
        size = np.diff(at)
        total = np.zeros(n, "i8")
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, how many ids each has, ids
        long = np.flatnonzero(size > LONG)
        if len(long):
            found = self.merge([raw[at[k] : at[k + 1]].tobytes() for k in long])
            done.append((long, np.array([len(x) for x in found]), np.array([i for x in found for i in x], "i8")))
        word = np.flatnonzero(size <= LONG)
        symbols = spread(self.first[raw], at, word)[0]
        count = size[word]
        ends = np.cumsum(count)
        symbols[ends - 1] = self.final[raw[at[word + 1] - 1]]
        rank = np.full(len(symbols), NONE)
        rank[:-1] = self.ranked(symbols[:-1], symbols[1:])
        rank[ends - 1] = NONE
        while len(word):
            least = np.minimum.reduceat(rank, ends - count)
            open_ = least != NONE
            if not open_.all():
                lasts = np.repeat(open_, count)
                done.append((word[~open_], count[~open_], symbols[~lasts]))
                word, count, least, symbols, rank = word[open_], count[open_], least[open_], symbols[lasts], rank[lasts]
                if not len(word):
                    break
                ends = np.cumsum(count)
            hit = np.flatnonzero(rank == np.repeat(least, count))
            of = np.searchsorted(ends, hit, side="right")
            hit = hit[np.concatenate(([True], of[1:] != of[:-1]))]  # the first of each word
            symbols[hit] = (least & LOW).astype("i8")
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, rank = symbols[keep], rank[keep]
            hit = hit - np.arange(len(hit))
            count = count - 1
            ends = np.cumsum(count)
            starts = ends - count
            right = hit < ends - 1
            rank[hit] = NONE
            rank[hit[right]] = self.ranked(symbols[hit[right]], symbols[hit[right] + 1])
            left = hit[hit > starts]
            rank[left - 1] = self.ranked(symbols[left - 1], symbols[left])
        for words, counts, _ in done:
            total[words] = counts
        offsets = np.concatenate(([0], np.cumsum(total)))
        out = np.empty(offsets[-1], "<u4")
        for words, counts, ids in done:
            ends = np.cumsum(counts)
            out[np.repeat(offsets[words] - ends + counts, counts) + np.arange(len(ids))] = ids
        return out, total


def shortest_pack_first(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences have each. counts: pieces by length, from 1 to capacity."""
    total = sum(n * length for length, n in counts.items())
    heap: list[tuple[int, int, tuple[int, ...], int]] = []  # used, a number that breaks ties, lengths, count
    made = 0

    def put(used: int, lengths: tuple[int, ...], count: int) -> None:
        nonlocal made
        if count:
            heapq.heappush(heap, (used, made, lengths, count))
            made += 1

    full = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    put(0, (), -(-(total - capacity * counts.get(capacity, 0)) // capacity))
    for length in sorted(counts, reverse=True):
        n = counts[length]
        if length == capacity:
            continue
        while n:
            if not heap or heap[0][0] + length > capacity:  # the shortest has no room, so none has
                put(0, (), -(-n // (capacity // length)))
            used, _, lengths, count = heapq.heappop(heap)
            taken = min(n, count)
            put(used, lengths, count - taken)
            put(used + length, (*lengths, length), taken)
            n -= taken
    return full + [(lengths, count) for _, _, lengths, count in sorted(heap) if lengths]


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, sequences, offset), sorted: the ranks of a length that a place in a pattern takes."""
    out, taken, sequence = [], {}, 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            rank = taken.get(length, 0)
            out.append((length, rank, sequence, count, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return np.array(sorted(out), "i8").reshape(-1, 5)


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens) of each piece, and its partition and rank there among equal lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen, part = loaded(("ids", path), lambda: Ids(path)), np.zeros(capacity + 1, "i8"), TaskContext.get().partitionId()
        end = END_ID.to_bytes(4, "little")
        for b in slices(batches):
            rows = []
            keys = b.column(0).to_pylist()
            for k, ids in zip(keys, v.encode_all(b.column(1).to_pylist())):
                raw = ids.tobytes() + end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, part, int(seen[length])))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["key", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])

    rows = df.select(df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    return rows.mapInArrow(run, "key long, start long, length long, ids_crc32 long, doc_tokens long, part long, rank long")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of `df`'s rows."""
    table = written(pieces(df, path, capacity, key, text), "pieces")
    by_part = table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = slots(shortest_pack_first(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = table.join(first, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    wide = np.int64(1) << 46

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = places[:, 0] * wide + places[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype("i8") for c in ("length", "rank"))
            at = places[np.searchsorted(starts, length * wide + rank, side="right") - 1]
            out = [b.column(b.schema.get_field_index(c)) for c in ("key", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(at[:, 2] + rank - at[:, 1]), pa.array(at[:, 4])], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = ranked.select("key", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return out.mapInArrow(run, "key long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("key", key)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
