"""Hard negatives by an orthogonal PCA rotation: partial products, bounds of what they leave out, and integer products of what remains.

Components become whole numbers, floor(scale * x), and a row's score is its inner product with the anchor, exactly. For each anchor the best rows of its label are its positives; for each anchor and
positive the best rows of other labels whose score lies within a window around the positive's, as fractions of it, are returned.

A rotation keeps inner products. The one whose axes are the principal components of all rows (eigenvectors of the sum of their outer products, a matrix of dimension squared that Spark sums up) puts
most of a product into its leading components. So a task scores a block of anchors against a block of rows in steps of more and more leading components: what is left out is at most the product of both residual
lengths, and rounding at most a small part of the product of both lengths. A pair whose upper bound lies behind enough lower bounds, or whose bounds lie outside of the windows, is discarded; what survives
all steps gets its integer product, so results are exact whatever the rotation.

As Spark jobs: anchors meet the rows of their own label (positives), and then all rows (negatives), in a grid of cells: blocks of anchors by blocks of rows, dealt by hash. A label with many rows has many
blocks; small cells share a group. A cell returns a few rows for each of its anchors, and windows over these, limited before their shuffle, choose the best. Anchors against all rows is work that
grows with their product; that is what is asked for.

Rows with a null label, vector or id take no part, nor do those with a null or non-finite component, with another dimension than most (of equally many the smaller), or with components so large that a product needn't fit
into 64 bits (a length of 2**27 or more after scaling), nor empty vectors. Rows that agree in id, label and vector are one row; an anchor's other rows are those with other ids. Ties go to the smaller id, then to the
smaller label. An id with several vectors is several anchors; each result has the least `anchor_row`, a number that tells them apart. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import written
from packetloom.llm.hilbert import matrix


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 3
    #: The window: least and most of a positive's score, in hundredths.
    least: int = 50
    most: int = 95
    scale: int = 256
    #: Components of the anchors and of the rows that a cell holds at most, and pairs that a task scores at once.
    anchor_numbers: int = 1 << 19
    row_numbers: int = 1 << 22
    pairs: int = 1_000_000


#: Parts of the dimensions that are multiplied before each look at the bounds.
STEPS = (0.125, 0.25, 0.5)
#: Rounding of rotated products, as a part of the product of both lengths: far above what doubles of some thousand dimensions need.
SLACK = 1e-9
#: Lengths from here on are out.
LONGEST = float(1 << 27)
#: A table is cut into so many blocks of rows at least, so that small ones occupy several tasks.
LEAST_BLOCKS = 16


def whole(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): rows that take part, with whole components."""
    rows = df.select(df[key].cast("long").alias("id"), label.cast("long").alias("label"), df[vector].alias("x")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("x")))
    big = F.transform("x", lambda c: F.floor(F.lit(float(scale)) * F.greatest(F.least(c.cast("double"), F.lit(1e18 / scale)), F.lit(-1e18 / scale))))
    length = F.sqrt(F.aggregate(big, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    rows = rows.select("id", "label", big.alias("v")).filter(length < LONGEST)
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("v") == F.lit(size["size"] if size else 0)).distinct()


def finite(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def rotation(rows: DataFrame) -> np.ndarray:
    """The principal axes of all rows (column v), as columns, those with most of the rows' squares first."""

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                v = matrix(b.column(0))
                total = v.T @ v if total is None else total + v.T @ v
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    found = rows.select("v").mapInArrow(squares, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # dimension squared
    n = int(found["i"].max()) + 1 if len(found) else 0
    total = np.zeros((n, n))
    total[found["i"], found["j"]] = found["s"]
    return np.linalg.eigh((total + total.T) / 2)[1][:, ::-1]


def steps(d: int) -> list[int]:
    return [*sorted({max(1, int(d * s)) for s in STEPS} - {d}), d] if d else []


class Bounds:
    """Bounds of the products of some anchors and a block of rows, closer with each step. Both are whole vectors, rotated once."""

    def __init__(self, axes: np.ndarray, rows: np.ndarray):
        self.axes, self.rows = axes, rows.astype("f8") @ axes
        self.length = np.linalg.norm(self.rows, axis=1)
        # what is left from each step on
        self.left = {k: np.sqrt(np.maximum((self.rows[:, k:] ** 2).sum(axis=1), 0)) for k in steps(axes.shape[1])}

    def closer(self, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each step the partial products, and how far they may be off. The arrays are changed by the next step; send() takes which pairs still matter, so that no more than their rows are multiplied."""
        a = anchors.astype("f8") @ self.axes
        slack = SLACK * (np.linalg.norm(a, axis=1)[:, None] * self.length) + 1e-6
        score = np.zeros((len(a), len(self.rows)))
        at, some = 0, np.arange(len(self.rows))
        for k in steps(self.axes.shape[1]):
            score[:, some] += a[:, at:k] @ self.rows[some, at:k].T
            off = np.linalg.norm(a[:, k:], axis=1)[:, None] * self.left[k] + slack
            matters = yield score, off
            some, at = np.flatnonzero(matters.any(axis=0)), k


def kept_pairs(bounds: Bounds, anchors: np.ndarray, asked) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of the pairs that survive all steps. asked(lower, upper) says which pairs still matter; pairs that mattered once no more are out for good."""
    walk = bounds.closer(anchors)
    alive = np.ones((len(anchors), len(bounds.rows)), bool)
    score, off = next(walk)
    while True:
        alive &= asked(np.where(alive, score - off, -np.inf), np.where(alive, score + off, -np.inf))
        try:
            score, off = walk.send(alive)
        except StopIteration:
            return np.nonzero(alive)


def nth_largest(lower: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest value of each row, as a column; -inf where there are fewer."""
    if lower.shape[1] <= n:
        return np.sort(lower, axis=1)[:, :1] if lower.shape[1] == n else np.full((len(lower), 1), -np.inf)
    return np.partition(lower, -n, axis=1)[:, -n, None]


def firsts(groups: list[np.ndarray], score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the n first of each group: by score, the highest first, then by id."""
    order = np.lexsort((ids, -score, *groups))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([g[order][1:] != g[order][:-1] for g in groups], axis=0)
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[rank < n]


def dealt(anchors: DataFrame, rows: DataFrame, m: Mining, d: int, by_label: bool) -> DataFrame:
    """Both sides by cells: group, cell, anchor_row (null for rows), id, label, v, more.

    by_label: a cell holds one label's blocks only. Labels of more than a block, of which there are fewer than blocks, have their own number of blocks.
    """
    n, a = rows.count(), anchors.count()
    down = max(1, min(m.row_numbers // d, -(-n // LEAST_BLOCKS)))
    across = max(1, m.anchor_numbers // d)
    if by_label:
        sizes = rows.groupBy("label").agg(F.count("*").alias("n")).join(anchors.groupBy("label").agg(F.count("*").alias("a")), "label", "left")
        sizes = sizes.select("label", F.ceil(F.col("n") / down).cast("int").alias("down"), F.ceil(F.coalesce("a", F.lit(0)) / across).cast("int").alias("across"))
        big = F.broadcast(written(sizes.filter("down > 1 or across > 1"), "labels"))  # fewer than one for each full block
        one = lambda c: F.coalesce(c, F.lit(1))
        sides = [x.join(big, "label", "left").withColumns({"down": one("down"), "across": one("across")}) for x in (anchors, rows)]
        own = F.col("label")
    else:
        sides = [x.withColumns({"down": F.lit(max(1, -(-n // down))), "across": F.lit(max(1, -(-a // across)))}) for x in (anchors, rows)]
        own = F.lit(0).cast("long")
    mixed = lambda c, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col("across" if seed else "down").cast("long"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
    left = sides[0].select(own.alias("own"), mixed("anchor_row", 1).alias("i"), every("down").alias("j"), "anchor_row", "id", "label", "v", "more")
    right = sides[1].select(own.alias("own"), mixed("id", 0).alias("j"), every("across").alias("i"), F.lit(None).cast("long").alias("anchor_row"), "id", "label", "v", F.lit(None).cast("array<long>").alias("more"))
    both = left.unionByName(right).select(F.struct("own", "i", "j").alias("cell"), "anchor_row", "id", "label", "v", "more")
    # cells of one label by themselves may be tiny: several make a group
    key = F.xxhash64("cell")
    return both.withColumn("group", F.pmod(key, F.lit(2 * max(1, -(-n // down)))) if by_label else key)


def scored(cells: DataFrame, axes: np.ndarray, m: Mining, mine) -> DataFrame:
    """(anchor_row, positive_id, positive_score, id, label, score): what `mine` finds in each cell. mine(bounds, anchors, rows): arrays of anchor, row, and of the positive's id and score."""

    def run(group: pa.Table) -> pa.Table:
        names = ["anchor_row", "positive_id", "positive_score", "id", "label", "score"]
        out = []
        group = group.combine_chunks()
        own, i, j = (pc.struct_field(group["cell"].combine_chunks(), k).to_numpy() for k in range(3))
        order = np.lexsort((j, i, own))
        cuts = np.flatnonzero(np.concatenate(([True], (np.diff(own[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0), [True])))
        asks = group["anchor_row"].is_valid().to_numpy()
        for lo, hi in zip(cuts, cuts[1:]):
            here = order[lo:hi]
            some, others = here[asks[here]], here[~asks[here]]
            if not len(some) or not len(others):
                continue
            rows, anchors = group.take(pa.array(others)), group.take(pa.array(some))
            v, ids, labels = matrix(rows["v"].combine_chunks(), "i8"), rows["id"].to_numpy(), rows["label"].to_numpy()
            bounds = Bounds(axes, v)
            step = max(1, m.pairs // len(v))
            for k in range(0, len(some), step):
                part = anchors.slice(k, step).combine_chunks()
                a = matrix(part["v"].combine_chunks(), "i8")
                who, what, positive, positive_score = mine(bounds, part, a, v, ids, labels)
                score = np.einsum("ij,ij->i", a[who], v[what])
                out.append(pa.table([part["anchor_row"].to_numpy()[who], positive, positive_score, ids[what], labels[what], score], names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 6, names=names)

    return cells.groupBy("group").applyInArrow(run, "anchor_row long, positive_id long, positive_score long, id long, label long, score long")


def hard_negatives(df: DataFrame, is_anchor: Column, m: Mining = Mining(), key: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_row, anchor_id, positive_id, rank, negative_id, positive_score, negative_score). is_anchor and label are columns of `df`; label: the column of that name, if not given."""
    asked = df.select(df[key].cast("long").alias("id")).where(F.coalesce(is_anchor, F.lit(False))).distinct()
    rows = written(whole(df, key, vector, df["label"] if label is None else label, m.scale), "vectors")
    axes = rotation(rows)
    d = max(1, len(axes))
    anchors = rows.join(asked, "id", "left_semi").select(F.monotonically_increasing_id().alias("anchor_row"), "id", "label", "v", F.lit(None).cast("array<long>").alias("more"))
    anchors = written(anchors, "anchors")

    def nearest(bounds: Bounds, part: pa.Table, a: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """The best of the same label."""
        other = part["id"].to_numpy()[:, None] != ids
        who, what = kept_pairs(bounds, a, lambda lower, upper: other & (upper >= nth_largest(np.where(other, lower, -np.inf), m.positives)))
        at = firsts([who], np.einsum("ij,ij->i", a[who], v[what]), ids[what], m.positives)
        nothing = np.zeros(len(at), "i8")
        return who[at], what[at], nothing, nothing

    def harder(bounds: Bounds, part: pa.Table, a: np.ndarray, v: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        """The best of other labels in each positive's window."""
        other = part["label"].to_numpy()[:, None] != labels
        known = part["more"].combine_chunks()
        size = known.value_lengths().to_numpy() // 2
        more = np.full((len(a), 2 * size.max() if len(size) else 0), 0)
        more[np.arange(more.shape[1]) < 2 * size[:, None]] = known.flatten().to_numpy()
        positive, positive_score = more[:, ::2], more[:, 1::2]
        lo, hi = -(-m.least * positive_score // 100), m.most * positive_score // 100  # whole scores

        def asks(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
            out = np.zeros(lower.shape, bool)
            for p in range(lo.shape[1]):
                least, most = lo[:, p, None], hi[:, p, None]
                sure = nth_largest(np.where(other & (lower >= least) & (upper <= most), lower, -np.inf), m.negatives)
                out |= (p < size)[:, None] & (upper >= np.maximum(least, sure)) & (lower <= most)
            return out & other

        who, what = kept_pairs(bounds, a, asks)
        score = np.einsum("ij,ij->i", a[who], v[what])
        found = [np.flatnonzero((p < size[who]) & (lo[who, p] <= score) & (score <= hi[who, p])) for p in range(lo.shape[1])]
        at = np.concatenate(found) if found else np.empty(0, "i8")
        p = np.repeat(np.arange(len(found)), [len(f) for f in found])
        first = firsts([who[at], p], score[at], ids[what[at]], m.negatives)
        at, p = at[first], p[first]
        return who[at], what[at], positive[who[at], p], positive_score[who[at], p]

    def best(found: DataFrame, by: list[str], n: int) -> DataFrame:
        own = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "label")
        return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= n)

    same = best(scored(dealt(anchors, rows, m, d, True), axes, m, nearest), ["anchor_row"], m.positives)
    lists = same.groupBy("anchor_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.array(x["id"], x["score"]))).alias("more"))
    asking = written(anchors.drop("more").join(lists, "anchor_row"), "asking")  # as many numbers as two for each positive
    found = best(scored(dealt(asking, rows, m, d, False), axes, m, harder), ["anchor_row", "positive_id", "positive_score"], m.negatives)
    names = asking.select("anchor_row", F.col("id").alias("anchor_id"))
    return found.join(names, "anchor_row").select("anchor_row", "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(df["vec_id"] % 7 == 0, (df["label"] + 1) % 10).otherwise(df["label"])
    return hard_negatives(df, df["vec_id"] % 50 == 0, label=moved).drop("anchor_row")


OP12_SQL = """with e as (select distinct vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, [floor(256 * cast(x as double)) for x in embedding] as v
 from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
d as (select len(v) as size from e group by 1 order by count(*) desc, 1 limit 1), r as (select * from e where len(v) = (select size from d)),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id as id, b.label, cast(list_dot_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where own = label qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
n as (select p.anchor_id, positive_id, positive_score, id as negative_id, score as negative_score, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank
 from p join s on s.anchor_id = p.anchor_id and own <> label and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3"""
