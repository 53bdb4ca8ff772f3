"""A flow table of bounded size, exactly: which records the least recently seen flow lost, and when.

A table that holds `most` records and drops the one that was seen longest ago for a new one holds, at any time, the flows that were seen last. So a record is lost after a packet if and only if packets of
`most` other flows come before the next one of its own, and before its idle time is over. That is a count of distinct flows in an interval of the whole stream, for each packet with a long enough interval.

It is taken without bringing the stream into one task. Packets get their places by running sums. In an interval (i, e) there are as many flows as places j whose flow's packet before j lies at i or earlier
(`before`). Places are cut into ranges. What of the interval lies in the range of i, or in that of e, is counted there, for all its intervals at once, by halving the values bit by bit (a wavelet matrix); for the ranges between both,
counts by range of j and of `before` are summed up, and what begins in the range of i itself is counted there by the range in which its flow comes next.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.flows import IDLE_US, KEY, MAX_FLOWS, normalized
from packetloom.operators.ordered import running_sums
from packetloom.session import written

#: Places of a range.
RANGE = 1 << 20
#: What `operators.flows.flows` needs of packets.
COLUMNS = ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "ts_us", "seq", "payload_len", "tcp_flags", "dns_query")


def count_at_most(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of values[lo:hi] are at most `bound`, for many intervals and bounds at once."""
    order = np.sort(values)
    rank, below = np.searchsorted(order, values), np.searchsorted(order, bound, side="right")
    lo, hi = lo.astype("i8"), np.maximum(hi, lo).astype("i8")
    out = np.where(below >= len(values), hi - lo, 0)
    rest = below < len(values)
    # ranks below `below` are counted bit by bit: where its bit is set, all whose bit isn't are smaller
    for bit in range(max(1, len(values)).bit_length() - 1, -1, -1):
        one = (rank >> bit) & 1
        zeros = np.concatenate(([0], np.cumsum(1 - one)))
        high = (below >> bit) & 1 == 1
        out += np.where(rest & high, zeros[hi] - zeros[lo], 0)
        lo, hi = np.where(high, zeros[-1] + lo - zeros[lo], zeros[lo]), np.where(high, zeros[-1] + hi - zeros[hi], zeros[hi])
        rank = np.concatenate((rank[one == 0], rank[one == 1]))
    return out


def placed(packets: DataFrame, range_rows: int) -> DataFrame:
    """Packets with place `at` (from 1, by time and seq), its range `r`, `before` (place of the flow's packet before, or 0), `next` and `next_us` (of the one after, or null)."""
    rows = packets.withColumn("dns_query", F.col("dns_query") if "dns_query" in packets.columns else F.lit(None).cast("string")).select(*COLUMNS)
    rows = running_sums(normalized(rows).select(*COLUMNS, *(c for c in KEY if c not in COLUMNS)), [F.col("ts_us"), F.col("seq")], {"at": F.lit(1)})
    rows = rows.withColumn("r", F.floor(F.col("at") / range_rows))
    within = Window.partitionBy("r", *KEY).orderBy("at")
    # between ranges: a row for each flow in each
    ends = rows.groupBy("r", *KEY).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("ts_us").alias("first_us"))
    across = Window.partitionBy(*KEY).orderBy("r")
    ends = ends.select("r", *KEY, F.lag("last").over(across).alias("earlier"), F.lead("first").over(across).alias("later"), F.lead("first_us").over(across).alias("later_us"))
    rows = rows.withColumns({"before": F.lag("at").over(within), "next": F.lead("at").over(within), "next_us": F.lead("ts_us").over(within)})
    rows = rows.join(ends, ["r", *KEY])
    rows = rows.withColumns({"before": F.coalesce("before", "earlier", F.lit(0)), "next": F.coalesce("next", "later"), "next_us": F.coalesce("next_us", "later_us")})
    return rows.select(*COLUMNS, "at", "r", "before", "next", "next_us")


def counted(rows: DataFrame, asked: DataFrame, range_rows: int) -> DataFrame:
    """(at, flows): how many flows have packets between each place `at` and its `until`, both left out; `asked` are rows (at, until) with no packet of the flow of `at` between them. rows: at, r, before, next."""
    split = F.floor(F.col("until") / range_rows)
    asked = written(asked.select("at", "until", F.floor(F.col("at") / range_rows).alias("a"), split.alias("b")), "asked")
    none = F.lit(None).cast("long")
    points = rows.select("r", F.lit(0).alias("kind"), "at", F.col("before").alias("x"), F.coalesce(F.floor(F.col("next") / range_rows), F.lit(-1)).alias("y"))
    begins = asked.select(F.col("a").alias("r"), F.lit(1).alias("kind"), "at", F.col("until").alias("x"), F.col("b").alias("y"))
    stops = asked.filter("a < b").select(F.col("b").alias("r"), F.lit(2).alias("kind"), "at", F.col("until").alias("x"), none.alias("y"))

    def local(group: pa.Table) -> pa.Table:
        """What of each interval lies in this range."""
        kind, at, x, y = (group[c].to_numpy() for c in ("kind", "at", "x", "y"))
        order = np.argsort(at[kind == 0])
        before, later = x[kind == 0][order], y[kind == 0][order].astype("i8")
        first, n = (int(at[kind == 0].min()), len(order)) if len(order) else (0, 0)
        i, until, b = at[kind == 1], x[kind == 1], y[kind == 1].astype("i8")
        here = count_at_most(before, i - first + 1, np.minimum(until - first, n), i)
        # begun here at i or before, and next seen in one of the ranges between
        r = int(group["r"][0].as_py())
        zero = np.zeros(len(i), "i8")
        through = np.where(b > r + 1, count_at_most(later, zero, i - first + 1, b - 1) - count_at_most(later, zero, i - first + 1, np.full(len(i), r)), 0)
        j, stop = at[kind == 2], x[kind == 2]
        there = count_at_most(before, np.zeros(len(j), "i8"), np.minimum(stop - first, n), j)
        return pa.table([np.concatenate((i, j)), np.concatenate((here + through, there))], names=["at", "flows"])

    parts = points.union(begins).union(stops).groupBy("r").applyInArrow(local, "at long, flows long")
    # ranges between both ends: places whose flow was last seen before the first of them
    widest = asked.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    if widest > 1:
        pairs = rows.groupBy(F.col("r").alias("c"), F.when(F.col("before") > 0, F.floor(F.col("before") / range_rows)).otherwise(-1).alias("d")).agg(F.count("*").alias("n"))
        least = F.greatest(F.col("d") + 1, F.col("c") - (widest - 1), F.lit(0))
        spans = pairs.filter((F.col("d") < F.col("c") - 1) & (F.col("c") > 0)).withColumn("a", F.explode(F.sequence(least, F.col("c") - 1)))
        sums = spans.groupBy("a", "c").agg(F.sum("n").alias("n"))
        sums = sums.select("a", (F.col("c") + 1).alias("b"), F.sum("n").over(Window.partitionBy("a").orderBy("c")).alias("n"))  # fewer rows than ranges that an interval spans
        # a range in which no such place lies has no row: the last one before it counts
        wide = asked.filter("b > a + 1").select("a", F.col("b").alias("b"), "at")
        both = wide.select("a", "b", none.alias("n")).distinct().union(sums)
        upto = both.groupBy("a", "b").agg(F.max("n").alias("n"))
        upto = upto.select("a", "b", F.coalesce(F.last("n", True).over(Window.partitionBy("a").orderBy("b")), F.lit(0)).alias("flows"))
        parts = parts.union(wide.join(upto, ["a", "b"]).select("at", "flows"))
    return parts.groupBy("at").agg(F.sum("flows").alias("flows"))


def with_evictions(packets: DataFrame, idle_us: int = IDLE_US, most: int = MAX_FLOWS, as_of_us: int | None = None, range_rows: int = RANGE) -> DataFrame:
    """Packets (COLUMNS, those without a time or an address left out) with `cut`, whether the flow's record had been lost to others before (not by its idle time), and `ends`: why the record ends behind the packet,
    CapacityEviction or IdleTimeout, null where it doesn't, or is still held as of then (the last packet's time, if not given)."""
    rows = written(placed(packets, range_rows), "placed")
    stays = F.coalesce(F.col("next_us") - F.col("ts_us") <= idle_us, F.lit(False))
    # where the idle time is over before the flow's next packet: the place behind the last packet in it
    probes = rows.filter(~stays).select((F.col("ts_us") + idle_us).alias("ts_us"), F.lit(1).alias("late"), F.lit(0).alias("one"), "at")
    times = rows.select("ts_us", F.lit(0).alias("late"), F.lit(1).alias("one"), "at")
    over = running_sums(times.union(probes), [F.col("ts_us"), F.col("late")], {"upto": F.col("one")}).filter("late = 1").select("at", (F.col("upto") + 1).alias("until"))
    intervals = rows.filter(stays).select("at", F.col("next").alias("until")).union(over).filter(F.col("until") - F.col("at") > most)
    lost = counted(rows, intervals, range_rows).filter(F.col("flows") >= most).select("at", F.lit(True).alias("lost"))
    lost = written(rows.select("at", "next").join(lost, "at"), "lost")
    latest = F.lit(as_of_us) if as_of_us is not None else F.lit(rows.agg(F.max("ts_us")).first()[0])
    idle = F.when(F.col("next_us").isNotNull(), ~stays).otherwise(latest - F.col("ts_us") > idle_us)
    rows = rows.join(lost.select("at", "lost"), "at", "left").join(lost.filter("next is not null").select(F.col("next").alias("at"), F.lit(True).alias("_cut")), "at", "left")
    return rows.select(*COLUMNS, F.coalesce("_cut", F.lit(False)).alias("cut"), F.when(F.col("lost"), "CapacityEviction").when(idle, "IdleTimeout").alias("ends"))
