"""Document fingerprints: MinHash of one permutation, with optimal densification and packed low-order bits.

A text's five-word shingles are hashed once. The top bits of a hash choose a bin, and a bin keeps its smallest hash. A bin without any takes the value of another, by probes that depend on the
bin alone and not on the text (A. Shrivastava, Optimal densification for fast and accurate minwise hashing, 2017), so that two texts that agree where they have shingles agree in the bins that they
lack. `ROUNDS` probes are random; a bin that is still empty then, as in short texts, takes the bin that holds something and is first in an order of its own. A fingerprint is the low
bits of all bins, packed. Two texts' fingerprints agree in a bin with probability s + (1 - s) / 2**bits at similarity s (Jaccard, of shingle sets); `likeness` takes that bias back.

All of it is column expressions: a text's bins are made by sorting its hashes together with the largest value of each bin, which marks an empty bin, and keeping what is first in each. Nothing but
the text's own row is needed, so there is no shuffle, and copies of a text, however many, cost no more than other rows.

Words are what white space separates, lower-cased; a text of fewer than five words is one shingle. A text without words (null, empty) has the empty fingerprint, which is like itself (1) and no other
(0). Texts of any length are taken whole: what a text needs is its words and a hash for each. Repeated rows and rows with null keys are kept; an empty table gives an empty table; no other columns are looked at.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.common import documents, whole_text, written

WORDS = 5
#: Bins, and bits of each that are kept: 256 bytes a text; the likeness has a standard error of 0.031 at most.
BINS, BITS = 256, 8
#: Random probes of an empty bin.
ROUNDS = 10
SEED = 17
#: A prime above any number of bins, for probes.
PRIME = 2_147_483_647


def probes(bins: int, rounds: int = ROUNDS) -> list[list[int]]:
    """For each round the bin that each bin looks at: (factor * i + summand) mod PRIME mod bins, with factors and summands drawn once."""
    rng = random.Random(SEED)
    drawn = [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(rounds)]
    return [[(a * i + b) % PRIME % bins for i in range(bins)] for a, b in drawn]


def with_shingles(df: DataFrame, text: str, name: str, words: int = WORDS) -> DataFrame:
    """`df` with the hashes of a text column's shingles, repeats included: XXH64 over the words, each seeded by the hash of those before it."""
    found = F.filter(F.split(F.lower(F.col(text)), r"\s+"), lambda w: w != "")
    rows = df.withColumn("_words", found)
    few = F.transform(F.when(F.size("_words") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), lambda _: F.aggregate("_words", F.lit(42).cast("long"), chained))
    w = F.col("_words")
    all_ = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words))))
    return rows.withColumn(name, F.when(F.size(w) >= words, all_).otherwise(few)).drop("_words")


def chained(seed: Column, word: Column) -> Column:
    return F.xxhash64(seed, word)


def with_fingerprint(df: DataFrame, hashes: str, name: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """`df` with a column `name` in place of the hashes: the packed low bits of its bins as an array of longs, empty without hashes. bins: a power of two; bits divide 64."""
    shift = 64 - (bins.bit_length() - 1)
    none = (1 << shift) - 1  # the largest value of a bin: nothing in it
    bin_of = lambda x: F.shiftrightunsigned(x, shift)
    empty = lambda x: x.bitwiseAND(F.lit(none)) == F.lit(none)
    marks = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.shiftleft(i.cast("long"), shift).bitwiseOR(F.lit(none)))
    rows = df.withColumn("_sorted", F.sort_array(F.concat(F.col(hashes), marks))).withColumn("_any", F.size(hashes) > 0)
    s = F.col("_sorted")
    firsts = F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    # signed order puts the upper half of the bins first
    rows = rows.withColumn("_bins", firsts)
    rows = rows.withColumn("_bins", F.concat(F.slice("_bins", bins // 2 + 1, bins // 2), F.slice("_bins", 1, bins // 2))).drop("_sorted")
    # both are named several times below, so the optimizer leaves them as columns and doesn't compute them for each bin
    rows = rows.withColumn("_full", F.filter("_bins", lambda x: ~empty(x)))
    held, full = F.col("_bins"), F.col("_full")

    def filled(x: Column, i: Column) -> Column:
        """The bin's own value, or that of the first bin of its probes that has one."""
        out = F.when(~empty(x), x)
        for table in tables:
            y = F.get(held, F.get(table, i))
            out = out.when(~empty(y), y)
        # a hash of both bins, whose low bits are the other bin's number
        least = F.array_min(F.transform(full, lambda y: F.xxhash64(i, bin_of(y)).bitwiseAND(F.lit(-bins)).bitwiseOR(bin_of(y))))
        least = F.get(held, least.bitwiseAND(F.lit(bins - 1)).cast("int"))
        return out.when(F.size(full) > 0, least).otherwise(x)

    tables = [F.lit(t) for t in probes(bins)]
    rows = rows.withColumn("_dense", F.transform(held, filled))
    per = 64 // bits
    d = F.col("_dense")
    low = lambda j: F.get(d, j).bitwiseAND(F.lit((1 << bits) - 1))
    packed = F.transform(F.sequence(F.lit(0), F.lit(bins // per - 1)), lambda i: sum_bits([F.shiftleft(low(i * per + k), bits * k) for k in range(per)]))
    rows = rows.withColumn(name, F.when(F.col("_any"), packed).otherwise(F.array().cast("array<long>")))
    return rows.drop("_any", "_full", "_dense", "_bins", hashes)


def sum_bits(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The estimated similarity of two fingerprints, from 0 to 1: the share of equal bins without that by chance. Two empty ones are alike."""

    def unequal(x: Column) -> Column:
        """How many of a long's fields aren't zero."""
        width = 1
        while width < bits:
            x = x.bitwiseOR(F.shiftrightunsigned(x, width))
            width *= 2
        return F.bit_count(x.bitwiseAND(F.lit(sum(1 << k for k in range(0, 63, bits)))))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-bits
    found = F.greatest(((F.lit(1.0) - apart / F.lit(float(bins))) - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(found)


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """`df` with the packed fingerprint of each row's text."""
    rows = df.withColumn("_text", whole_text(df, text))
    return with_fingerprint(with_shingles(rows, "_text", "_hashes", words), "_hashes", name, bins, bits).drop("_text")


def shown(fingerprint: Column) -> Column:
    """As hexadecimal digits."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


KEY = ("known", "id", "x", "y")


def followers(rows: DataFrame) -> DataFrame:
    """Each distinct KEY of `rows` with the next one in order (`next`, after the last the first), its `copies`, and n_chars of its text.

    Only keys are sorted, by Spark's range partitioning; each range takes its last row's follower from a table with a row for each range.
    """
    keys = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"))
    ranges = written(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "ranges")
    own = F.struct(*KEY)
    first = ranges.groupBy("part").agg(F.min(own).alias("first"))
    around = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy(F.lit(0))))
    after = first.select("part", around.alias("after"))  # a row for each range
    within = F.lead(own).over(Window.partitionBy("part").orderBy(*KEY))
    out = ranges.withColumn("next", within).join(F.broadcast(after), "part")
    return out.select(*KEY, "copies", "n_chars", F.coalesce("next", "after").alias("next"))


def edited(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each document with its edited text, whose last half is the beginning of the next document's, by ascending key: key, n_chars, edited_text, fingerprint, edited_fingerprint, next_fingerprint.

    Null keys come first; documents of one key in order of their hashes; of rows that agree in key and text all but one are followed by their like.
    """
    base = df.select(df[key].cast("long").alias("id"), whole_text(df, text).alias("text"))
    base = base.select(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), F.xxhash64("text").alias("x"), F.xxhash64(F.lit(1), "text").alias("y"), "text", F.length("text").cast("long").alias("n_chars"))
    links = written(followers(base.drop("text")), "followers")
    # copies of a row become one before the shuffle; the sorted rows of both joins are the same, so this is shuffled once
    printed = with_fingerprint(with_shingles(base, "text", "_hashes", words), "_hashes", "fingerprint", bins, bits)
    once = printed.groupBy(*KEY).agg(F.min("text").alias("text"), F.min("fingerprint").alias("fingerprint"))
    asks = links.select(*(F.col(f"next.{c}").alias(c) for c in KEY), *(F.col(c).alias(f"own_{c}") for c in KEY), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    nexts = asks.join(once, list(KEY)).select(*(F.col(f"own_{c}").alias(c) for c in KEY), F.col("fingerprint").alias("next_fingerprint"), F.left("text", F.col("half")).alias("head"))
    rows = once.join(links.select(*KEY, "copies", "n_chars"), list(KEY)).join(nexts, list(KEY))
    # the last of equal rows is followed by another text, those before it by their like
    both = F.array(*(F.struct(h.alias("head"), f.alias("next_fingerprint"), n.alias("times")) for h, f, n in ((F.col("head"), F.col("next_fingerprint"), F.lit(1).cast("long")), (F.left("text", F.floor(F.col("n_chars") / 2).cast("int")), F.col("fingerprint"), F.col("copies") - 1))))
    rows = rows.select("known", "id", "text", "n_chars", "fingerprint", F.explode(F.filter(both, lambda x: x["times"] > 0)).alias("f"))
    kept = F.left("text", (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int"))
    rows = rows.select(F.when(F.col("known"), F.col("id")).alias(key), "n_chars", "fingerprint", F.concat(kept, "f.head").alias("edited_text"), "f.next_fingerprint", "f.times")
    rows = with_fingerprint(with_shingles(rows, "edited_text", "_hashes", words), "_hashes", "edited_fingerprint", bins, bits)
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        shown(F.col("fingerprint")).alias("fingerprint"),
        shown(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
