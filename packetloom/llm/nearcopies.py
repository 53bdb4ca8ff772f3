"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such links join.

Candidates come from SimHash first: fingerprints of the five-word shingles, linked within RADIUS bits by the vantage-point trees of `simhash`; a component of these links is one bucket.
That doesn't find all: at 0.8 a SimHash of 64 bits differs in 10 bits on the average, and a radius that takes in nearly all of
these pairs takes in unrelated texts too. So MinHash adds the rest: `BANDS` bands of `ROWS` minima each; a pair at similarity s shares a band with
probability 1 - (1 - s**4)**24, which leaves out three of a million pairs at 0.8 exactly and fewer above. Candidates are compared by
their whole shingle sets, so nothing below 0.8 is linked.

As Spark jobs: texts of equal words are one class. A bucket is the classes with an equal band; buckets of the same classes are
one bucket (most pairs share several bands). Buckets with many shingles are divided into parts by hash, every two of which meet in
one cell. A cell compares a class only with those that it isn't linked to yet, so a large group of near copies
costs a pass over it and not all pairs. Components are those of `simhash.components`.

Words are what Unicode white space separates, lower-cased. A text of fewer than five words is one shingle; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm import simhash
from packetloom.llm.common import slices, whole_text, written
from packetloom.operators.joins import lookup

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
#: The most bits that four blocks of a fingerprint find with one bit each.
RADIUS = 7
SEED = 11
#: Shingles of one part of a bucket, and of the cells that a task takes at once.
PART_SHINGLES = 2_000_000

_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), "u8")
MASKS, FACTORS = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def shingles(line: str) -> np.ndarray:
    """The distinct shingles of a text in plain form, ascending."""
    return np.unique(np.array(simhash.shingle_hashes(line, WORDS), "u8"))


def bands_of(found: np.ndarray) -> list[int]:
    """A hash of each band's minima."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for lo in range(0, len(found), 1024):
        least = np.minimum(least, ((found[None, lo : lo + 1024] ^ MASKS) * FACTORS).min(axis=1))
    raw = least.astype("<u8").tobytes()
    step = 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[i : i + step], i) for i in range(0, len(raw), step)]


def row_hash(df: DataFrame) -> Column:
    """The same for rows that agree in all columns."""
    return F.xxhash64(*[df[c] for c in df.columns], *[df[c].isNull() for c in df.columns])


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of shingles."""
    size = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    mark = np.zeros(flat.max() + 1, bool)
    root = np.arange(len(sets))
    out = []
    for i in range(len(sets)):
        # what came before has been compared with i
        rest = i + 1 + np.flatnonzero(root[i + 1 :] != root[i])
        rest = rest[np.minimum(size[rest], size[i]) >= SIMILARITY * np.maximum(size[rest], size[i]) - 1e-9]
        if not len(rest):
            continue
        own = flat[starts[i] : starts[i] + size[i]]
        mark[own] = True
        n = size[rest]
        begin = np.cumsum(n) - n
        common = np.add.reduceat(mark[flat[np.repeat(starts[rest] - begin, n) + np.arange(n.sum())]], begin, dtype="i8")
        mark[own] = False
        for j in rest[common >= SIMILARITY * (size[i] + n - common) - 1e-9]:
            if root[i] != root[j]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def fingerprint_places(rows: DataFrame) -> DataFrame:
    """(print, n, band, value) for rows of (print, n, fp): the component of each text's fingerprint by links of RADIUS bits or fewer, as a band of its own."""
    own = written(rows.filter("n > 0").select("print", "n", "fp").distinct(), "own")
    near = simhash.components(simhash.links(written(own.select("fp").distinct(), "prints"), RADIUS)).withColumnRenamed("node", "fp")
    return written(lookup(own, near, ["fp"]).select("print", "n", F.lit(-1).alias("band"), F.coalesce("root", "fp").alias("value")), "near")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, print, root) of each row: its `row_hash`, a hash of its words, and the component of that."""
    unsigned = lambda xs: np.array(xs, "u8").view("i8")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lines = [plain(t) for t in b.column(2).to_pylist()]
            hashes = [np.array(simhash.shingle_hashes(x, WORDS), "u8") for x in lines]
            fps = simhash.fingerprints_of_hashes(hashes, len(hashes)).view("i8")
            sets = [np.unique(h) for h in hashes]
            prints = unsigned([xxhash.xxh64_intdigest(x.encode(), SEED) for x in lines])
            bands = [unsigned(bands_of(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array(bands, pa.list_(pa.int64()))], ["row", "key", "print", "n", "fp", "bands"])

    texts = df.select(row_hash(df).alias("row"), df[key].cast("long").alias("key"), whole_text(df, text).alias("text"))
    rows = written(texts.mapInArrow(signed, "row long, key long, print long, n long, fp long, bands array<long>"), "signatures")
    places = rows.select("print", "n", "bands").distinct().select("print", "n", F.posexplode("bands").alias("band", "value")).union(fingerprint_places(rows))
    members = [F.count("*").alias("classes"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("print")).alias("x"), F.bit_xor(F.xxhash64("print", F.lit(1))).alias("y")]
    buckets = places.groupBy("band", "value").agg(*members).filter("classes > 1")
    buckets = buckets.groupBy("classes", "n", "x", "y").agg(F.min(F.struct("band", "value")).alias("at"))
    buckets = written(buckets.select("at.band", "at.value", F.ceil(F.col("n") / PART_SHINGLES).cast("int").alias("parts"), F.col("n").alias("all")), "buckets")
    bins = max(1, -(-(buckets.agg(F.sum(F.col("all") * F.col("parts"))).first()[0] or 0) // PART_SHINGLES))

    own = F.pmod("print", F.col("parts").cast("long"))
    cells = places.join(buckets, ["band", "value"]).select("band", "value", "print", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "print")
    cells = written(cells.select(F.xxhash64("band", "value", "i", "j").alias("cell"), "print"), "cells")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(plain(t)).view("i8") for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["print", "shingles"])

    asked = rows.join(cells.select("print").distinct(), "print", "left_semi").groupBy("print").agg(F.min("row").alias("row"))
    sets = texts.join(asked, "row").select("print", "text").dropDuplicates(["print"]).mapInArrow(shingled, "print long, shingles array<long>")

    def compared(group: pa.Table) -> pa.Table:
        group = group.sort_by([("cell", "ascending"), ("print", "ascending")]).combine_chunks()
        cell, prints = group["cell"].to_numpy(), group["print"].to_numpy()
        column = group["shingles"].combine_chunks()
        values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        left, right = [], []
        for lo, hi in zip(cuts, cuts[1:]):
            for i, j in linked([values[offsets[k] : offsets[k + 1]] for k in range(lo, hi)]):
                left.append(prints[lo + i])
                right.append(prints[lo + j])
        return pa.table([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = cells.join(sets, "print").withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(bins)))
    links = written(dealt.groupBy("bin").applyInArrow(compared, "a long, b long").distinct(), "links")
    found = simhash.components(links).withColumnRenamed("node", "print")
    return lookup(rows.select("row", "key", "print"), found, ["print"]).select("row", "key", "print", F.coalesce("root", "print").alias("root"))
