"""Flows: packets of both directions of a 5-tuple, split into sessions at idle gaps, with bounded samples.

Packets have src_ip, dst_ip (of any type that has an order), src_port, dst_port, proto, ts_us (microseconds), seq (breaks ties), payload_len, tcp_flags
and, if there are any, dns_query. Rows without a time or an address take no part; null ports, protocols and flags count as 0, null lengths too.

Order within a flow is taken in time slices, so that no flow, however many packets it has, is one task: gaps are found within a
slice, and runs of packets (a row each) give the gaps between slices. What one task sorts is a flow's packets of one slice; slices may be
of any length (`slice_us`), the result is the same, so where a burst is too much for a task they are made shorter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from packetloom.functions import features as f
from packetloom.functions.net import protocol_name

KEY = ("a_ip", "b_ip", "a_port", "b_port", "proto")
SESSION = (*KEY, "session")
IDLE_US = 120_000_000
#: Sizes and inter-arrival times that count, and names.
SAMPLES, NAMES = 128, 16
#: A slice is so many idle timeouts long.
SLICE_IDLES = 8
MAX_FLOWS = 100_000


def normalized(packets: DataFrame) -> DataFrame:
    """Packets with their flow's KEY and `forward`. The smaller address is a; with equal addresses the two directions are two flows."""
    rows = packets.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("ts_us").isNotNull())
    fwd = F.col("src_ip") <= F.col("dst_ip")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    pick = lambda a, b: F.when(fwd, a).otherwise(b)
    return rows.withColumns(
        {
            "a_ip": pick(F.col("src_ip"), F.col("dst_ip")),
            "b_ip": pick(F.col("dst_ip"), F.col("src_ip")),
            "a_port": pick(zero("src_port"), zero("dst_port")),
            "b_port": pick(zero("dst_port"), zero("src_port")),
            "proto": zero("proto"),
            "forward": fwd,
            "tcp_flags": zero("tcp_flags"),
            "size": zero("payload_len").bitwiseAND(65535),
            "dns_query": F.col("dns_query") if "dns_query" in packets.columns else F.lit(None).cast("string"),
        }
    )


def sessions(packets: DataFrame, idle_us: int = IDLE_US, slice_us: int | None = None) -> DataFrame:
    """`normalized` packets with `session` (from 0 in each flow) and `iat_us`, null for the first of a session. A gap over `idle_us` splits."""
    slice_us = slice_us or SLICE_IDLES * idle_us
    rows = normalized(packets).withColumn("slice", F.floor(F.col("ts_us") / slice_us))
    within = Window.partitionBy(*KEY, "slice").orderBy("ts_us", "seq")
    gap = F.col("ts_us") - F.lag("ts_us").over(within)
    rows = rows.withColumn("gap", gap).withColumn("cut", (F.col("gap") > idle_us).cast("int"))
    rows = rows.withColumn("splits", F.sum(F.coalesce("cut", F.lit(0))).over(within))
    ends = rows.groupBy(*KEY, "slice").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.max("splits").alias("inner"))
    across = Window.partitionBy(*KEY).orderBy("slice")
    ends = ends.withColumn("before", F.lag("last").over(across))
    ends = ends.withColumn("parted", F.coalesce((F.col("first") - F.col("before") > idle_us).cast("long"), F.lit(0)))
    ends = ends.withColumn("offset", F.sum(F.col("parted") + F.col("inner")).over(across) - F.col("inner"))
    out = rows.join(ends.select(*KEY, "slice", "before", "offset"), [*KEY, "slice"])
    gap = F.coalesce("gap", F.col("ts_us") - F.col("before"))
    out = out.withColumns({"session": F.col("offset") + F.col("splits"), "iat_us": F.when(gap <= idle_us, gap)})
    return out.drop("slice", "gap", "cut", "splits", "before", "offset")


def pieces(packets: DataFrame, idle_us: int, slice_us: int) -> DataFrame:
    """A row for each run of a flow's packets within a slice that nothing splits: its counts, its first gaps and sizes, its first names. One shuffle of the packets, and one pass over each sorted partition.

    Packets may have `cut`, which splits before a packet, and `ends`, why a record ends behind one. A run that goes on in another Arrow batch is a row in each; `piece` is their order.
    """
    known = [F.col(c) if c in packets.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("cut", "boolean"), ("ends", "string"))]
    rows = normalized(packets).withColumn("slice", F.floor(F.col("ts_us") / slice_us))
    rows = rows.select(*KEY, "slice", F.xxhash64(*KEY, "slice").alias("group"), F.col("ts_us").cast("long").alias("ts_us"), F.col("seq").alias("seq"), "forward", F.col("size").cast("int").alias("size"), F.col("tcp_flags").cast("int").alias("tcp_flags"), F.col("dns_query").cast("string").alias("dns_query"), *known)
    rows = rows.repartition(*KEY, "slice").sortWithinPartitions(*KEY, "slice", "ts_us", "seq").drop("seq")
    keys = [f for f in rows.schema.fields if f.name in (*KEY, "slice")]
    numbers = ("piece", "first_us", "last_us", "fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes", "tcp_flags", "names")
    kinds = StructType([*keys, *(StructField(c, IntegerType() if c == "tcp_flags" else LongType()) for c in numbers), StructField("cut", BooleanType()), StructField("ends", StringType()), StructField("samples", ArrayType(SAMPLE)), StructField("queries", ArrayType(NAME))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for b in batches:
            n = len(b)
            if not n:
                continue
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            whole = lambda c: column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            ts, group, forward, size, flags = (whole(c) for c in ("ts_us", "group", "forward", "size", "tcp_flags"))
            cut = pc.fill_null(column("cut"), False).to_numpy(zero_copy_only=False)
            gap = np.diff(ts, prepend=ts[:1])
            new = np.concatenate(([True], group[1:] != group[:-1])) | (gap > idle_us) | cut
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, n))
            rank = np.arange(n) - np.repeat(at, count)
            sums = lambda x: np.add.reduceat(x.astype("i8"), at)  # noqa: B023, E731
            forward = forward.astype(bool)
            named = column("dns_query").is_valid().to_numpy(zero_copy_only=False)
            nth = np.cumsum(named) - np.repeat(np.cumsum(named)[at] - named[at], count)
            some, words = rank <= SAMPLES, named & (nth <= NAMES)
            last = at + count - 1
            samples = pa.StructArray.from_arrays([pa.array((rank[some] + 1).astype("i4")), pa.array(gap[some], mask=rank[some] == 0), pa.array(size[some].astype("i4"))], ["rn", "gap", "size"])
            queries = pa.StructArray.from_arrays([pa.array(nth[words].astype("i8")), column("dns_query").filter(pa.array(words))], ["nth", "dns_query"])
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sums(x))).astype("i4")), v) for x, v in ((some, samples), (words, queries))]
            values = [done + np.arange(len(at)), ts[at], ts[last], sums(forward), sums(~forward), sums(np.where(forward, size, 0)), sums(np.where(forward, 0, size)), np.bitwise_or.reduceat(flags, at).astype("i4"), sums(named)]
            done += len(at)
            yield pa.RecordBatch.from_arrays([*(column(f.name).take(pa.array(at)) for f in keys), *map(pa.array, values), pa.array(cut[at]), column("ends").take(pa.array(last)), *lists], names=kinds.names)

    return rows.mapInArrow(run, kinds)


SAMPLE = StructType().add("rn", IntegerType()).add("gap", LongType()).add("size", IntegerType())
NAME = StructType().add("nth", LongType()).add("dns_query", StringType())


def flows(packets: DataFrame, idle_us: int = IDLE_US, slice_us: int | None = None) -> DataFrame:
    """A row for each session: first and last time, packets and bytes by direction, the union of flags; n_iat, iat_mean, iat_std (milliseconds, population) and size_var of its
    first SAMPLES gaps and sizes; dns_queries, its first NAMES names in order (empty array without any). Runs are joined to sessions; packets are read and shuffled once.

    With the columns of `eviction.with_evictions`, records that were lost are split too, and `close_reason` says why each ends, null where it doesn't."""
    across = Window.partitionBy(*KEY).orderBy("slice", "piece")
    runs = pieces(packets, idle_us, slice_us or SLICE_IDLES * idle_us).withColumn("before", F.col("first_us") - F.lag("last_us").over(across))
    runs = runs.withColumn("session", F.sum(F.when((F.col("before") > idle_us) | F.col("cut"), 1).otherwise(0)).over(across))
    earlier = Window.partitionBy(*SESSION).orderBy("slice", "piece").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"had": F.coalesce(F.sum(F.col("fwd_packets") + F.col("rev_packets")).over(earlier), F.lit(0)), "had_names": F.coalesce(F.sum("names").over(earlier), F.lit(0))})
    # only the first runs of a session have samples and names that count, so these lists are bounded
    place = lambda x, limit, had: F.when(F.col(had) < limit, F.struct("slice", "piece", F.col("had"), "before", F.col(x).alias("x")))
    out = runs.groupBy(*SESSION).agg(
        *(f("first_us").alias("first_us") if f is F.min else f("last_us").alias("last_us") for f in (F.min, F.max)),
        *(F.sum(c).alias(c) for c in ("fwd_packets", "rev_packets", "fwd_bytes", "rev_bytes")),
        F.bit_or("tcp_flags").alias("tcp_flags"),
        F.max("ends").alias("close_reason"),
        F.array_sort(F.collect_list(place("samples", SAMPLES + 1, "had"))).alias("_samples"),
        F.array_sort(F.collect_list(place("queries", NAMES, "had_names"))).alias("_queries"),
    )
    # a run's first packet has the gap to the run before, if that is of its session
    gaps = F.flatten(F.transform("_samples", lambda r: F.transform(r["x"], lambda x: F.when(x["rn"] > 1, x["gap"]).when(r["had"] > 0, r["before"]))))
    sizes = F.flatten(F.transform("_samples", lambda r: r["x"]["size"]))
    names = F.flatten(F.transform("_queries", lambda r: r["x"]["dns_query"]))
    out = out.withColumns({"_gaps": F.slice(gaps, 2, SAMPLES), "_sizes": F.slice(sizes, 1, SAMPLES), "dns_queries": F.slice(names, 1, NAMES)})
    mean = F.coalesce(total("_gaps") / F.nullif(F.size("_gaps"), F.lit(0)) / 1000.0, F.lit(0.0))
    out = out.withColumns({"n_iat": F.size("_gaps").cast("long"), "iat_mean": mean, "iat_std": F.sqrt(spread("_gaps", 1000.0)), "size_var": spread("_sizes")})
    return out.drop("_samples", "_queries", "_gaps", "_sizes", *([] if "ends" in packets.columns else ["close_reason"]))


def total(values: str) -> Column:
    """The sum of a list of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def spread(values: str, unit: float = 1.0) -> Column:
    """The population variance of a list, in units of `unit`, by a running mean; 0 of an empty one."""

    def add(a: Column, x: Column) -> Column:
        n, x = a["n"] + 1, x / unit
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (x - mean) * (x - a["mean"])).alias("squares"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, none, add, lambda a: F.when(a["n"] > 0, a["squares"] / a["n"]).otherwise(0.0))


def with_features(found: DataFrame) -> DataFrame:
    """`flows` with the columns of FEATURES, `ml_features` (ARRAY<FLOAT>, in their order) and `ml_score`."""
    c = F.col
    packets, total = c("fwd_packets") + c("rev_packets"), c("fwd_bytes") + c("rev_bytes")
    named = {
        "conn_rate": f.conn_rate(packets, c("last_us") - c("first_us")),
        "dns_entropy": f.byte_entropy(F.array_join("dns_queries", "")),
        "beaconing_score": f.beaconing(c("n_iat"), c("iat_mean"), c("iat_std")),
        "traffic_asymmetry": f.asymmetry(c("fwd_bytes"), c("rev_bytes")),
        "bytes_ratio": f.bytes_ratio(total, packets),
        "packet_size_var": c("size_var"),
        "tcp_flag_anomaly": f.flag_anomaly(c("tcp_flags")),
    }
    out = found.withColumns(named | {k: F.lit(v) for k, v in f.CONSTANT.items()})
    out = out.withColumn("ml_features", F.array(*(c(k).cast("float") for k in f.FEATURES)))
    return out.withColumn("ml_score", f.ml_score({k: c(k) for k in f.WEIGHTS}))


def details(found: DataFrame, as_of_us: int) -> DataFrame:
    """What is shown of each flow; durations last until `as_of_us`. Sort by ml_score, descending, for the usual order."""
    rows = with_features(found)
    duration = (F.lit(as_of_us) - F.col("first_us")) / 1e6
    return rows.withColumns({"protocol": protocol_name(F.col("proto")), "duration_secs": duration})


def summary(shown: DataFrame) -> DataFrame:
    """One row: total_flows, tcp_flows, udp_flows, anomalous, avg_duration of `details`."""
    return shown.agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if(F.col("protocol") == "TCP").alias("tcp_flows"),
        F.count_if(F.col("protocol") == "UDP").alias("udp_flows"),
        F.count_if(F.col("ml_score") > f.ANOMALOUS).alias("anomalous"),
        F.coalesce(F.avg("duration_secs"), F.lit(0.0)).alias("avg_duration"),
    )


def lookup(found: DataFrame, src_ip, dst_ip, src_port: int, dst_port: int, proto: int) -> DataFrame:
    """The sessions of one flow, by either of its directions. Addresses are literals of the packets' type."""
    one = found.sparkSession.range(1).select(F.lit(src_ip).alias("src_ip"), F.lit(dst_ip).alias("dst_ip"), F.lit(src_port).alias("src_port"), F.lit(dst_port).alias("dst_port"), F.lit(proto).alias("proto"))
    wanted = normalized(one.withColumns({"ts_us": F.lit(0), "tcp_flags": F.lit(0), "payload_len": F.lit(0)})).select(*KEY).first()
    return found.filter(reduce(lambda a, b: a & b, [F.col(c) == F.lit(wanted[c]) for c in KEY]))


def latest(found: DataFrame) -> DataFrame:
    """Each flow's last session: the record that a table of live flows would hold."""
    newest = F.max("session").over(Window.partitionBy(*KEY))
    return found.withColumn("_newest", newest).filter("session = _newest").drop("_newest")


def active(found: DataFrame, as_of_us: int, idle_us: int = IDLE_US) -> DataFrame:
    """Live flows: latest sessions whose last packet is no older than the timeout."""
    return latest(found).filter(F.lit(as_of_us) - F.col("last_us") <= idle_us)


def snapshot(found: DataFrame, as_of_us: int, idle_us: int = IDLE_US, most: int = MAX_FLOWS) -> DataFrame:
    """The table of live flows when it holds `most` records and the least recently seen goes first: the `most` latest."""
    return active(found, as_of_us, idle_us).orderBy(F.desc("last_us"), *KEY).limit(most)


def closed(found: DataFrame, as_of_us: int, idle_us: int = IDLE_US, most: int = MAX_FLOWS) -> DataFrame:
    """Sessions that are no longer in the table as of then, with close_reason: IdleTimeout, or CapacityEviction for live ones that had to go."""
    held = snapshot(found, as_of_us, idle_us, most).select(*SESSION, F.lit(True).alias("_held"))
    newest = F.col("session") == F.max("session").over(Window.partitionBy(*KEY))
    rows = found.withColumn("_live", newest & (F.lit(as_of_us) - F.col("last_us") <= idle_us)).join(held, list(SESSION), "left").filter("_held is null")
    return rows.withColumn("close_reason", F.when(F.col("_live"), "CapacityEviction").otherwise("IdleTimeout")).drop("_live", "_held")


def oldest(found: DataFrame) -> DataFrame:
    """The row of the flow that was seen longest ago."""
    return found.orderBy("last_us", *SESSION).limit(1)
