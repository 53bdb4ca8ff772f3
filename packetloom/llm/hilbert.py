"""Approximate nearest neighbours by shifted space-filling curves.

Distinct vectors are projected onto `dims` random orthogonal directions, once for each curve, shifted, scaled to a grid and ordered along
a Hilbert curve. Spark sorts the vectors of all curves by (curve, key) into ranges. On each curve a query looks at the `window` keys before
and after its own; rows at a range's ends are copied to the border with the next range, where windows go on. What
the windows hold is merged over all curves and reranked by inner products in double precision of the original vectors.

Inside windows vectors are stood for by one byte a
component and a bound of the error; whatever may be among the nearest by these bounds is kept, ties too, so that only the windows make the
search approximate. Equal vectors are one vector with its smallest ids, of which only as many are needed as a result has rows and one more;
each row is still found.

How many curves and keys a recall needs depends on the data. The defaults are for the worst case, vectors without structure (directions alike in all
dimensions, as in the test tables). There a window catches neighbours in proportion to about (window / N) ** 0.65. So that recall doesn't fall with
size, windows grow as the square root of N (512 keys at least) and curves with (N / window) ** 0.65: what is shuffled grows as N ** 1.33, and the pairs that are scored as N ** 1.83,
not as N squared. Where vectors lie in clusters, `curves` and `window` can be set to small fixed numbers, and work is N log N.

Vectors that are null, zero or hold null or non-finite components take no part, neither do those whose dimension differs from
that of most vectors (of equally many the smaller), nor rows with a null id. Repeated rows are one. An id with several vectors asks with all of
them and is found once, by its nearest one; a list may be shorter where such ids are in it. Of equal scores the smaller id is nearer. An empty
table gives an empty table. Other columns are not looked at, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import written
from packetloom.operators.joins import lookup


@dataclass(frozen=True)
class Curves:
    #: Keys that a query looks at on either side of its own, on each curve, and curves; None: as many as vectors without structure need for a recall over 0.9.
    window: int | None = None
    curves: int | None = None
    dims: int = 8
    bits: int = 6
    seed: int = 7
    #: Rows that a range takes, roughly, in windows.
    range_windows: int = 16

    def sizes(self, vectors: int) -> tuple[int, int]:
        """The window and the number of curves."""
        window = self.window or max(512, int(4 * np.sqrt(vectors)))
        return window, self.curves or max(4, int(np.ceil(1.7 * (vectors / window) ** 0.65)))


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of each row of grid coordinates (rows, dims), each below 2**bits.

    Each level of the curve, from the coarsest, exchanges or mirrors the lower bits of the axes as the cell's orientation asks
    (J. Skilling, Programming the Hilbert curve, 2004); a Gray code of the result, bits of all axes interleaved, is the place.
    """
    x = [grid[:, i].astype("i8") for i in range(grid.shape[1])]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            mirrored = (x[i] >> level) & 1 == 1
            swap = np.where(mirrored, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(mirrored, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def unit_and_scale(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and the largest component of each vector; safe for very large and very small ones."""
    most = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / most
    return unit / np.linalg.norm(unit, axis=1, keepdims=True), most[:, 0]


def orderings(unit: np.ndarray, c: Curves, curves: int) -> Iterator[np.ndarray]:
    """The keys of directions on each curve."""
    d = unit.shape[1]
    for k in range(curves):
        rng = np.random.default_rng((c.seed, k))
        axes = np.linalg.qr(rng.standard_normal((d, min(d, c.dims))))[0]
        # components of a unit vector along an axis scatter by 1/sqrt(d); eight such steps are the grid, the shift is below one
        place = (unit @ axes * np.sqrt(d) + 4 + rng.uniform(-0.5, 0.5, axes.shape[1])) / 8
        yield hilbert_keys(np.floor(np.clip(place, 0, 1 - 1e-9) * (1 << c.bits)), c.bits)


def sketches(vectors: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A byte for each component, the scale of these, and a bound of the length of what they leave out, rounding in single precision included."""
    scale = most / 127
    codes = np.rint(vectors / scale[:, None]).astype("i1")
    left = vectors / most[:, None] - codes / 127.0
    bound = np.linalg.norm(left, axis=1) + 2e-5 * np.linalg.norm(vectors / most[:, None], axis=1)
    return codes, scale, bound * most


def matrix(column: pa.Array, kind: str = "f8") -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), kind)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


#: Rows of a curve in order: `v` is null where it is no query's.
KEYED = "curve int, place long, rep long, codes binary, scale double, bound double, v {kind}"
#: A query's candidates on a curve as lists (q is not null), and rows at the ends of ranges (edge is not null).
FOUND = "q long, found array<long>, score array<float>, error array<float>"
SEEN = f"{FOUND}, edge int, later boolean, {KEYED}"
LISTS = pa.schema([("q", pa.int64()), ("found", pa.list_(pa.int64())), ("score", pa.list_(pa.float32())), ("error", pa.list_(pa.float32()))])


#: Lists of candidates that are merged in one group.
LISTS_A_GROUP = 10_000


def listed(q: np.ndarray, counts: np.ndarray, *values: np.ndarray) -> pa.Table:
    offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype("i4"))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, f.type.value_type)) for v, f in zip(values, list(LISTS)[1:])]
    return pa.Table.from_arrays([pa.array(q, pa.int64()), *lists], schema=LISTS)


def scan(rows: pa.Table, window: int, k: int, skip: np.ndarray | None = None) -> pa.Table:
    """Candidates of the queries in `rows`, which are in order on one curve: what may be among the k + 1 nearest of the window. Queries of `skip` aren't asked."""
    rows = rows.combine_chunks()
    n, rep = len(rows), rows["rep"].to_numpy()
    asked = rows["v"].is_valid().to_numpy()
    asked = np.flatnonzero(asked if skip is None else asked & ~skip)
    out = [LISTS.empty_table()]
    if not len(asked):
        return out[0]
    codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), "i1").reshape(n, -1).astype("f4")
    scale, bound = rows["scale"].to_numpy(), rows["bound"].to_numpy()
    vectors = matrix(rows["v"].combine_chunks().take(pa.array(asked)))
    largest = np.abs(vectors).max(axis=1)
    length = np.linalg.norm(vectors / largest[:, None], axis=1) * largest
    lo = 0
    while lo < len(asked):
        hi = min(int(np.searchsorted(asked, asked[lo] + 2 * window, side="right")), lo + 256)
        q = asked[lo:hi]
        a, b = max(0, q[0] - window), min(n, q[-1] + window + 1)
        score = ((vectors[lo:hi] / largest[lo:hi, None]).astype("f4") @ codes[a:b].T) * (largest[lo:hi, None] * scale[a:b])
        error = length[lo:hi, None] * bound[a:b]
        near = np.abs(np.arange(a, b) - q[:, None]) <= window
        if b - a > k + 1:
            least = np.where(near, score - error, -np.inf)
            near &= ~(score + error < np.partition(least, b - a - k - 1, axis=1)[:, b - a - k - 1, None])
        i, j = np.nonzero(near)
        out.append(listed(rep[q], near.sum(axis=1), rep[a + j], score[i, j].astype("f4"), error[i, j].astype("f4")))
        lo = hi
    return pa.concat_tables(out)


def nearest(df: DataFrame, is_query: Column, k: int = 20, c: Curves = Curves(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of each row of `df` where is_query holds, of all rows but those with its id."""
    rows = df.select(df[key].cast("long").alias("id"), df[vector].alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.filter(F.size("v") == F.lit(size["size"] if size else 0))
    # a vector's smallest ids; the limit within a window runs before its shuffle, too, so a vector with many rows is no hot key
    members = rows.select("id", "v").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    asked = rows.filter("q").select("v").distinct().withColumn("q", F.lit(True))
    distinct = members.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).join(asked, "v", "left")
    # numbers that the table keeps: no two vectors share one
    distinct = written(distinct.select(F.monotonically_increasing_id().alias("rep"), "ids", "v", F.coalesce("q", F.lit(False)).alias("q")), "vectors")
    count = distinct.count()
    window, curves = c.sizes(count)
    kind = df.schema[vector].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            v = matrix(b.column(1))
            unit, most = unit_and_scale(v)
            codes, scale, bound = sketches(v, most)
            width = codes.shape[1]
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(b), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            query = pc.if_else(b.column(2), b.column(1), None)
            for curve, keys in enumerate(orderings(unit, c, curves)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), curve, "i4")), pa.array(keys), b.column(0), codes, pa.array(scale), pa.array(bound), query], ["curve", "place", "rep", "codes", "scale", "bound", "v"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Candidates of the queries inside a range, and the rows at its ends, where queries see the next range too: a query is asked in one place."""
        held = [b for b in batches if len(b)]
        if not held:
            return
        part, table = TaskContext.get().partitionId(), pa.Table.from_batches(held).combine_chunks()
        names = table.schema.names
        curve = table["curve"].to_numpy()
        cuts = [0, *(np.flatnonzero(curve[1:] != curve[:-1]) + 1).tolist(), len(curve)]
        at, n = np.arange(len(table)), len(table)
        head, tail = (at < window) & (at < cuts[1]), (at >= n - window) & (at >= cuts[-2])
        for lo, hi in zip(cuts, cuts[1:]):
            found = scan(table.slice(lo, hi - lo), window, k, (head | tail)[lo:hi])
            empty = [pa.nulls(len(found), t) for t in (pa.int32(), pa.bool_(), *table.schema.types)]
            yield from pa.table([*found.columns, *empty], names=[*found.column_names, "edge", "later", *names]).to_batches()
        ends = (part, False, max(cuts[-2], n - 2 * window), n, tail & ~head), (part - 1, True, 0, min(cuts[1], 2 * window), head)
        for edge, later, lo, hi, own in ends:
            end, m = table.slice(lo, hi - lo), hi - lo
            end = end.set_column(names.index("v"), "v", pc.if_else(pa.array(own[lo:hi]), end["v"], None))
            none = [pa.nulls(m, t) for t in LISTS.types]
            yield from pa.table([*none, pa.array(np.full(m, edge, "i4")), pa.array(np.full(m, later)), *end.columns], names=["q", "found", "score", "error", "edge", "later", *names]).to_batches()

    def across(group: pa.Table) -> pa.Table:
        """Candidates of the queries at a border: in the last rows of a range and the first of the next."""
        group = group.sort_by([("later", "ascending"), ("place", "ascending"), ("rep", "ascending")])
        return pa.concat_tables([scan(group.filter(pc.equal(group["curve"], x)), window, k) for x in group["curve"].unique()])

    ranges = max(1, -(-count * curves // (c.range_windows * window)))
    order = ["curve", "place", "rep"]
    placed = distinct.select("rep", "v", "q").mapInArrow(keyed, KEYED.format(kind=kind)).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    held = written(placed.mapInArrow(windows, SEEN.format(kind=kind)), "windows")
    edges = held.filter("edge is not null").select("edge", "later", *order, "codes", "scale", "bound", "v").groupBy("edge").applyInArrow(across, FOUND)

    def merged(group: pa.Table) -> pa.Table:
        """The candidates of some queries without those that lie surely behind k + 1 others; a vector found in several windows counts once."""
        group = group.combine_chunks()
        lists = group["found"].combine_chunks()
        q = np.repeat(group["q"].to_numpy(), lists.value_lengths().to_numpy())
        rep, score, error = (group[c].combine_chunks().flatten().to_numpy() for c in ("found", "score", "error"))
        order = np.lexsort((rep, q))
        q, rep, score, error = q[order], rep[order], score[order].astype("f8"), error[order].astype("f8")
        once = np.concatenate(([True], (q[1:] != q[:-1]) | (rep[1:] != rep[:-1])))
        q, rep, score, error = q[once], rep[once], score[once], error[once]
        order = np.lexsort((error - score, q))
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        size = np.diff(np.concatenate((starts, [len(q)])))
        # the (k + 1)-th lower bound of each query
        bar = np.where(size > k, (score - error)[order][np.minimum(starts + k, len(q) - 1)], -np.inf)
        kept = ~(score + error < np.repeat(bar, size))
        return pa.table([pa.array(q[kept]), pa.array(rep[kept])], names=["q", "rep"])

    bins = max(1, -(-distinct.filter("q").count() * curves // LISTS_A_GROUP))
    found = held.filter("q is not null").select("q", "found", "score", "error").union(edges).withColumn("bin", F.pmod(F.xxhash64("q"), F.lit(bins)))
    found = found.groupBy("bin").applyInArrow(merged, "q long, rep long")
    vectors = distinct.select("rep", "ids", F.transform("v", lambda x: x.cast("double")).alias("v"))
    pairs = found.join(vectors, "rep").join(vectors.select(F.col("rep").alias("q"), F.col("v").alias("u")), "q")
    score = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    by_id = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    lists = pairs.select("q", score.alias("score"), F.explode("ids").alias("id")).groupBy("q", "id").agg(F.max("score").alias("score"))
    # the query's own id may be among the first
    lists = lists.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1).select("q", "id", "score")
    # each query row takes its vector's list without itself
    queries = rows.filter("q").select(F.col("id").alias("query_id"), "v").join(distinct.filter("q").select(F.col("rep").alias("q"), "v"), "v").select("query_id", "q").distinct()
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    out = lookup(written(queries, "queries"), written(lists, "lists"), ["q"], "inner").filter("id <> query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    out = out.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").alias(key), "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(df, F.col("vec_id") % 20 == 0)
