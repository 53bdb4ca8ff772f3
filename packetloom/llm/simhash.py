"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are cut into as many blocks as `radius` has room for at one differing bit each (radius 4: four blocks of 16
bits). If two fingerprints differ in 4 bits, some block differs in 1 at most, so that it suffices to find, for each
block, the pairs whose block values lie within the block radius 1, and to compare these in full. For each block a
vantage-point tree partitions the space of block values by Hamming distance: a node has a vantage point, the values
nearer than the median distance go inside, the others outside. A value has one home leaf; a query descends into
every branch that the triangle bound does not exclude, that is into both where it lies near the boundary. The trees
do not depend on the data, so every executor builds the same ones.

As Spark jobs: the branches at some level of a tree are the shards of one shuffle. Distinct fingerprints go to their
home shard once and, as queries, to each shard that their ball overlaps. Shards that hold many rows are divided into cells
by hash: index rows over the columns and queries over the rows of a grid, so no task gets a whole hot shard. A shard
goes down the rest of the tree, compares its rows leaf by leaf and returns a spanning forest of the links it
finds, never all pairs. Components of the forests are found
in Spark by repeated minimum labels with pointer jumping; links and labels stay tables in the shared folder.

Exact copies share a fingerprint and meet in one aggregation with map-side combination. Null texts count as empty; texts
without words have fingerprint zero and link like any other; rows with null keys get a fingerprint and
a component, whose id is null only if no row there has a key; repeated rows are kept; an empty table gives an
empty table. Texts of any length are hashed whole. Other columns of the table are not looked at, so their names may clash.

Why trees over block values and not over whole fingerprints: distances between 64-bit fingerprints gather at 32 with a deviation of 4, which is the radius too, so
that about three of four queries go into both branches of a node; at level L that is 1.74 ** L shards for each. A tree over values of 16 bits with radius 1 has
two branches for about two of five.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.common import documents, whole_text, written
from packetloom.operators.joins import lookup

SEED = 42
WORDS = 4
RADIUS = 4
BITS = 64
#: Leaves of each tree, as a power of two.
DEPTH = 12
#: Fingerprints at home in a shard, on the average; shards are the branches at a level of the tree that follows from their number.
SHARD_ROWS = 30_000
MIN_LEVEL = 2
#: Fingerprints at home in one cell of a shard; a cell takes eight times as many queries.
CELL_ROWS = 60_000


def shingle_hashes(text: str, words: int = WORDS) -> list[int]:
    """XXH64 of each run of so many words (all of them, if they are fewer); bytes.lower() and split() are ASCII only, as is asked for."""
    found = text.encode().lower().split()
    if not found:
        return []
    line = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in found)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[words:])]


def fingerprints_of(texts: list[str], words: int = WORDS) -> np.ndarray:
    """A fingerprint of each text as unsigned 64-bit integers."""
    return fingerprints_of_hashes((shingle_hashes(t, words) for t in texts), len(texts))


def fingerprints_of_hashes(found: Iterable[Sequence[int]], n: int) -> np.ndarray:
    """The same of n texts' shingle hashes."""
    out = np.zeros(n, "u8")
    waiting: list[tuple[int, Sequence[int]]] = []
    size = 0

    def close() -> None:
        if not waiting:
            return
        hashes = np.concatenate([np.asarray(hs, "<u8") for _, hs in waiting])
        counts = np.array([len(hs) for _, hs in waiting])
        bits = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0, dtype="i4")
        packed = np.packbits(sums * 2 > counts[:, None], axis=1, bitorder="little")
        out[[i for i, _ in waiting]] = np.ascontiguousarray(packed).view("<u8")[:, 0]
        waiting.clear()

    for i, hashes in enumerate(found):
        if len(hashes):
            waiting.append((i, hashes))
            size += len(hashes)
        if size > 200_000:
            close()
            size = 0
    close()
    return out


def fingerprints(df: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1).to_pylist(), words).view("i8"))], ["key", "fp"])

    rows = df.select(df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    return rows.mapInArrow(run, "key long, fp long").withColumnRenamed("key", key)


@lru_cache(maxsize=8)
def vantage_tree(bits: int, radius: int, depth: int, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each block value of so many bits its home leaf, and the branches at `level` that its ball overlaps (as CSR: starts, branches)."""
    space = np.arange(1 << bits, dtype="u4")
    rng = np.random.default_rng(bits * 1000 + radius)
    home = np.zeros(1 << bits, "i4")
    asked: list[tuple[np.ndarray, int]] = []

    def grow(inside: np.ndarray, queries: np.ndarray, leaf: int, at: int) -> None:
        """inside: the values of this branch; queries: those whose ball may reach it."""
        if at == level:
            asked.append((queries, leaf))
        if at == depth or len(inside) < 2:
            home[inside] = leaf << (depth - at)
            if at < level:
                asked.append((queries, leaf << (level - at)))
            return
        vantage = inside[rng.integers(len(inside))]
        own, far = np.bitwise_count(inside ^ vantage), np.bitwise_count(queries ^ vantage)
        median = int(np.sort(own)[(len(own) - 1) // 2])
        if (own > median).sum() * 4 < len(own) and median:  # whole distances: take the more even of the two cuts
            median = median - 1 if abs((own <= median - 1).sum() - len(own) / 2) < abs((own <= median).sum() - len(own) / 2) else median
        # d(q, x) <= radius and d(x, vantage) <= median give d(q, vantage) <= median + radius; likewise outside
        grow(inside[own <= median], queries[far <= median + radius], 2 * leaf, at + 1)
        grow(inside[own > median], queries[far > median - radius], 2 * leaf + 1, at + 1)

    grow(space, space, 0, 0)
    values = np.concatenate([q for q, _ in asked])
    leaves = np.concatenate([np.full(len(q), leaf, "i4") for q, leaf in asked])
    order = np.argsort(values, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(values, minlength=1 << bits))))
    return home, starts, leaves[order]


def blocks(radius: int) -> tuple[int, int]:
    """How many blocks fingerprints are cut into, and the radius in one of them."""
    n = 4 if radius < 8 else 3 if radius < 12 else 2
    return n, radius // n


def block_of(fp: np.ndarray, k: int, n: int) -> tuple[np.ndarray, int]:
    lo, hi = BITS * k // n, BITS * (k + 1) // n
    return ((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype("u4"), hi - lo


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) between n nodes join two trees, taken in order."""
    root = list(range(n))
    kept = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept[k] = True
    return kept


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) at `radius` bits or fewer, whose components are those of all such links."""
    n, near = blocks(radius)

    count = prints.count()
    level = min(DEPTH, max(MIN_LEVEL, int(np.ceil(np.log2(max(1, count / SHARD_ROWS))))))

    def placed(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, whether a query, fingerprint): one home for each block, and each shard that the ball overlaps."""
        for lo in range(0, len(fp), 20_000):
            part = fp[lo : lo + 20_000]
            for k in range(n):
                value, bits = block_of(part, k, n)
                home, starts, shards = vantage_tree(bits, near, DEPTH, level)
                size = starts[value + 1] - starts[value]
                at = np.repeat(starts[value] - np.cumsum(size) + size, size) + np.arange(size.sum())
                shard = np.concatenate((home[value] >> (DEPTH - level), shards[at])) + (k << level)
                yield shard.astype("i4"), np.arange(len(shard)) >= len(part), np.concatenate((part, np.repeat(part, size)))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, n << level), "i8")
        for b in batches:
            for shard, query, _ in placed(b.column(0).to_numpy(zero_copy_only=False).view("u8")):
                for side in (0, 1):
                    sums[side] += np.bincount(shard[query == side], minlength=n << level)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n << level, dtype="i4")), pa.array(sums[0]), pa.array(sums[1])], ["shard", "own", "asked"])

    sizes = prints.select("fp").mapInArrow(sized, "shard int, own long, asked long").groupBy("shard").agg(F.sum("own").alias("own"), F.sum("asked").alias("asked"))
    columns, lines = np.ones(n << level, "i8"), np.ones(n << level, "i8")
    for r in sizes.collect():  # a row for each shard
        columns[r["shard"]], lines[r["shard"]] = max(1, -(-r["own"] // CELL_ROWS)), max(1, -(-r["asked"] // (8 * CELL_ROWS)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, query, fp in placed(b.column(0).to_numpy(zero_copy_only=False).view("u8")):
                mixed = (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own, asked = columns[shard], lines[shard]
                copies = np.where(query, own, asked)
                i = np.repeat(np.arange(len(shard)), copies)
                turn = np.arange(len(i)) - np.repeat(np.cumsum(copies) - copies, copies)
                fixed = (mixed[i] % np.where(query, asked, own)[i].astype("u8")).astype("i8")
                column, line = np.where(query[i], turn, fixed), np.where(query[i], fixed, turn)
                yield pa.RecordBatch.from_arrays([pa.array(shard[i]), pa.array((line * own[i] + column).astype("i4")), pa.array(query[i]), pa.array(fp[i].view("i8"))], ["shard", "cell", "query", "fp"])

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        shard, query, fp = int(group["shard"].iloc[0]), group["query"].to_numpy(), group["fp"].to_numpy().view("u8")
        value, bits = block_of(fp, shard >> level, n)
        home, starts, leaves = vantage_tree(bits, near, DEPTH, DEPTH)
        size = np.where(query, starts[value + 1] - starts[value], 0)
        at = np.repeat(starts[value] - np.cumsum(size) + size, size) + np.arange(size.sum())
        leaf, of = leaves[at], np.repeat(np.arange(len(fp)), size)
        here = leaf >> (DEPTH - level) == shard & ((1 << level) - 1)
        leaf = np.concatenate((home[value[~query]], leaf[here]))
        fp, query = np.concatenate((fp[~query], fp[of[here]])), np.arange(len(leaf)) >= len(fp) - query.sum()
        order = np.argsort(leaf, kind="stable")
        leaf, query, fp = leaf[order], query[order], fp[order]
        cuts = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1], [True])))
        left, right = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            own, asked = fp[lo:hi][~query[lo:hi]], fp[lo:hi][query[lo:hi]]
            if not len(own):
                continue
            step = max(1, 4_000_000 // len(own))
            for k in range(0, len(asked), step):
                q = asked[k : k + step]
                i, j = np.nonzero(np.bitwise_count(q[:, None] ^ own[None, :]) <= radius)
                up = q[i] < own[j]
                if up.any():
                    x, y = q[i][up], own[j][up]
                    if len(x) > 4 * (len(own) + len(q)):  # dense: what a tree needs at once
                        nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
                        kept = forest(at[: len(x)], at[len(x) :], len(nodes))
                        x, y = x[kept], y[kept]
                    left.append(x)
                    right.append(y)
        if not left:
            return pd.DataFrame({"a": np.empty(0, "i8"), "b": np.empty(0, "i8")})
        x, y = np.concatenate(left), np.concatenate(right)
        nodes, at = np.unique(np.concatenate((x, y)), return_inverse=True)
        kept = forest(at[: len(x)], at[len(x) :], len(nodes))
        return pd.DataFrame({"a": x[kept].view("i8"), "b": y[kept].view("i8")})

    cells = prints.select("fp").mapInArrow(dealt, "shard int, cell int, query boolean, fp long")
    return written(cells.groupBy("shard", "cell").applyInPandas(compared, "a long, b long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of `edges` (a, b): the smallest node that it is linked to, directly or not.

    Each round takes every node's least label among its neighbours' and its own, then the label of that label; it ends when
    no label changes, after about the logarithm of the longest path.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
    labels = written(labels, "labels")
    while True:
        seen = lookup(both, labels.withColumnRenamed("node", "b"), ["b"], "inner").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        nearer = written(labels.join(seen, "node", "left").select("node", F.least("root", "seen").alias("to"), F.col("root").alias("was")), "nearer")
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("over"))
        # the root of a label may be hooked to something smaller by any of its nodes
        hooks = nearer.groupBy(F.col("was").alias("to")).agg(F.min("to").alias("hook"))
        # many nodes may share a label: one component may have nearly all
        after = lookup(nearer, jump.join(hooks, "to", "left"), ["to"])
        after = written(after.select("node", F.least("to", "over", "hook").alias("root"), "was"), "labels")
        changed = after.filter("root <> was").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


def near_duplicates(df: DataFrame, words: int = WORDS, radius: int = RADIUS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of each row: its fingerprint, and the smallest key that it is linked to."""
    rows = written(fingerprints(df, words, key, text), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(lookup(written(rooted, "rooted"), least, ["root"], "inner").select("fp", "component_id"), "classes")
    return lookup(rows, classes, ["fp"]).select(key, "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
