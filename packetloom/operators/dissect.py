"""Frames to typed columns: Ethernet, 802.1Q, IPv4, IPv6, TCP, UDP, ICMP, and the protocol tag.

Header fields come from one vectorised pass over a batch's bytes (`functions.frames`); tags, switches and counts are column expressions.

A frame that is null or too short is malformed: its columns are null, and `malformed` is true. Where the
IP header is cut off the protocol is empty and addresses are null. Fields that a packet doesn't have are 0, so ports are never null
in frames that aren't malformed. Repeated rows and an empty table need no care.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.binary import first_of
from packetloom.functions.frames import TCP, UDP, frame_headers
from packetloom.operators.protocols import is_http

# The ports that tag a protocol.
TCP_PORTS = (("tls", (443, 8443)), ("http", (80, 8080, 8000, 9090, 3000, 3128, 8888)), ("dns", (53,)))
UDP_PORTS = (("dns", (53, 5353)), ("ntp", (123,)), ("dhcp", (67, 68)), ("quic", (443,)))

#: Which switch governs a tag; tags that aren't listed always pass.
SWITCHES = {"tcp": "tcp", "tcp_truncated": "tcp", "udp": "udp", "quic": "udp", "icmp": "icmp", "dns": "dns", "http": "http", "tls": "tls", "ntp": "ntp", "dhcp": "dhcp", "modbus": "modbus", "dnp3": "dnp3", "bacnet": "bacnet", "enip": "ethernet_ip"}
#: Switches that are off unless asked for.
OFF = ("modbus", "dnp3", "bacnet", "ethernet_ip")

FIELDS = (
    "malformed", "dst_mac", "src_mac", "ethertype", "vlan_id", "src_ip", "dst_ip", "ip_proto", "ip_ttl", "ip_total_len", "src_port", "dst_port",
    "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "icmp_type", "icmp_code", "payload_offset", "payload_len", "protocol",
)


def tagged(src: Column, dst: Column, ports: tuple, otherwise: Column) -> Column:
    return first_of(*((src.isin(*p) | dst.isin(*p), name) for name, p in ports), otherwise=otherwise)


def dissect(frames: DataFrame, data: str = "data") -> DataFrame:
    """`frames` with FIELDS beside its columns; columns of these names are replaced."""
    kept = [F.col(f"`{c}`") for c in frames.columns if c not in FIELDS]
    rows = frames.select(*kept, F.col(f"`{data}`").alias("_d")).withColumn("_h", frame_headers("_d")).select(*kept, "_d", "_h.*")
    kind, proto, s, t = F.col("transport"), F.col("ip_proto"), F.col("src_port"), F.col("dst_port")
    text = F.when((F.col("payload_len") > 4) & (kind == "tcp"), is_http(F.col("_d"), F.col("payload_offset")))
    tag = first_of((proto == TCP, tagged(s, t, TCP_PORTS, F.when(text, "http").otherwise(kind))), (proto == UDP, tagged(s, t, UDP_PORTS, kind)), otherwise=kind)
    return rows.withColumn("protocol", tag).select(*kept, *FIELDS)


def enabled(packets: DataFrame, on: dict[str, bool] | None = None) -> DataFrame:
    """Packets whose dissector is switched on. `on` overrides the defaults."""
    on = dict(on or {})
    off = [tag for tag, switch in SWITCHES.items() if not on.get(switch, switch not in OFF)]
    return packets.filter(~F.coalesce(F.col("protocol").isin(*off), F.lit(False))) if off else packets


def packet_counts(packets: DataFrame, on: dict[str, bool] | None = None) -> DataFrame:
    """(protocol, n): packets of each tag whose dissector is on; malformed frames count as `malformed`."""
    # malformed frames have no tag, so no switch leaves them out
    tag = F.when(F.col("malformed"), "malformed").otherwise(F.col("protocol"))
    return enabled(packets, on).groupBy(tag.alias("protocol")).agg(F.count(F.lit(1)).alias("n"))


def with_addresses(packets: DataFrame) -> DataFrame:
    """Packets that have both addresses: what flows and rules look at. All others pass."""
    return packets.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
