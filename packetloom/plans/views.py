"""What a sensor answers, as functions of its tables: packets, flows, rules, captures, metrics, state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.operators import captures as c
from packetloom.operators import dissect as d
from packetloom.operators import events as e
from packetloom.operators import flows as fl
from packetloom.operators import rules as r
from packetloom.operators.ordered import newest, numbered_newest


def as_of(packets: DataFrame) -> int:
    """The time of the last packet, in microseconds; 0 without any."""
    return packets.agg(F.max("ts_us")).first()[0] or 0


def packet_records(packets: DataFrame, start_us: int = 0) -> DataFrame:
    """Dissected packets (with ts_us, length) as they are listed; verdict and rule are pass and empty where they weren't judged."""
    col = F.col
    fields = {k: col(k) for k in ("src_port", "dst_port", "tcp_flags", "tcp_seq", "tcp_ack", "tcp_window", "payload_len", "icmp_type", "icmp_code", "ip_proto")}
    judged = "verdict" in packets.columns
    return packets.filter("not malformed").select(
        *(x for x in ("event_id", "seq", "ts_us") if x in packets.columns),
        ((col("ts_us") - start_us) / 1e6).alias("time_secs"),
        F.coalesce(net.ip_string(col("src_ip")), F.lit(net.MISSING)).alias("src_ip"),
        F.coalesce(net.ip_string(col("dst_ip")), F.lit(net.MISSING)).alias("dst_ip"),
        "src_port",
        "dst_port",
        F.upper("protocol").alias("protocol"),
        "length",
        net.packet_info(col("protocol"), fields, col("length")).alias("info"),
        net.tcp_flag_string(col("tcp_flags")).alias("tcp_flags"),
        col("ip_ttl").alias("ttl"),
        net.mac_string(col("src_mac")).alias("src_mac"),
        net.mac_string(col("dst_mac")).alias("dst_mac"),
        "vlan_id",
        net.ethertype_string(col("ethertype")).alias("ethertype"),
        "ip_proto",
        "payload_len",
        "tcp_seq",
        "tcp_ack",
        "tcp_window",
        (F.initcap("verdict") if judged else F.lit("Pass")).alias("ips_verdict"),
        (F.coalesce("rule_id", F.lit("")) if judged else F.lit("")).alias("ips_rule"),
    )


def recent_packets(records: DataFrame, n: int = c.MOST_PACKETS, order: Sequence[str] = ("ts_us", "seq")) -> DataFrame:
    """The last packets with their numbers."""
    return numbered_newest(records, n, order)


def flow_details(packets: DataFrame, idle_us: int = fl.IDLE_US, slice_us: int | None = None, at: int | None = None) -> DataFrame:
    """All sessions with features and score, duration until the last packet of all."""
    return fl.details(fl.flows(packets, idle_us, slice_us), as_of(packets) if at is None else at)


def ips_events(judged: DataFrame, n: int = c.MOST_EVENTS, order: Sequence[str] = ("ts_us", "seq")) -> DataFrame:
    """The last matches, oldest first."""
    return newest(c.alerts(judged), n, order)


def alert_counts(judged: DataFrame) -> DataFrame:
    """(severity, n) of all matches."""
    return c.alerts(judged).groupBy(F.col("rule_severity").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def metrics_text(counts: DataFrame, alerts: DataFrame, interface: str, active_flows: int) -> DataFrame:
    """(line): counters of packets by protocol, of alerts by severity, and the gauges."""
    one = counts.sparkSession.range(1)
    lines = [
        e.counter_lines(counts, e.PACKETS_METRIC, {"interface": F.lit(interface), "protocol": F.col("protocol")}, F.col("n")),
        e.counter_lines(alerts, e.ALERTS_METRIC, {"severity": F.col("severity")}, F.col("n")),
        *(one.select(e.gauge_line(g, F.lit(active_flows if g == e.GAUGES[0] else 0)).alias("line")) for g in e.GAUGES),
    ]
    return e.union_of(*lines)


def sensor_state(judged: DataFrame, found: DataFrame, at: int, idle_us: int = fl.IDLE_US) -> DataFrame:
    """One row: packets in all, live flows, and what the rules did."""
    live = fl.active(found, at, idle_us).count()
    return r.stats(judged).withColumns({"packets_total": F.col("inspected"), "active_flows": F.lit(live).cast("long")})


def dissected(frames: DataFrame, on: dict[str, bool] | None = None) -> DataFrame:
    """Frames with their fields, those whose dissector is off left out; length beside them."""
    return d.enabled(d.dissect(frames.withColumn("length", F.length("data"))), on)


def judged_frames(frames: DataFrame, rules: Sequence[r.Rule] = r.DEFAULT_RULES, inline: bool = True) -> DataFrame:
    """The whole line from frames to verdicts: dissect, leave out what is off, judge what has addresses; all else passes."""
    rows = dissected(frames).withColumn("proto", F.col("ip_proto"))
    has: Column = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    out = r.match_compiled(rows, rules, inline)
    for name in ("rule_ordinal", "rule_id", "rule_severity", "rule_description"):
        out = out.withColumn(name, F.when(has, F.col(name)))
    return out.withColumn("verdict", F.when(has, F.col("verdict")).otherwise("pass"))
