"""Text forms of addresses, flags, ports and packets, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.binary import first_of, u8

ARROW = "→"
MISSING = "—"

# The names of TCP flag bits in the order in which they are listed.
FLAG_NAMES = ((0x02, "SYN"), (0x10, "ACK"), (0x01, "FIN"), (0x04, "RST"), (0x08, "PSH"), (0x20, "URG"), (0x40, "ECE"), (0x80, "CWR"))
# Names of protocol numbers.
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}


def tcp_flag_string(flags: Column) -> Column:
    """Names of the set bits joined by commas; `none` without any."""
    named = F.concat_ws(", ", *(F.when(flags.bitwiseAND(bit) != 0, name) for bit, name in FLAG_NAMES))
    return F.when(flags.isNotNull(), F.coalesce(F.nullif(named, F.lit("")), F.lit("none")))


def mac_string(mac: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.hex(mac)), F.lit(".."), F.lit(0)), ":")


def ethertype_string(ethertype: Column) -> Column:
    return F.format_string("0x%04X", ethertype)


def ipv4_of_long(ip: Column) -> Column:
    """The dotted form of an address held as a bigint."""
    return F.when(ip.isNotNull(), F.concat_ws(".", *(F.shiftright(ip, n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0))))


def bound(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), where value is computed once however often it occurs."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def shortened(groups: Column) -> Column:
    """Eight groups joined by colons, with the first of the longest runs of two zero groups or more as `::`."""
    runs = [f"0(?::0){{{k - 1}}}" for k in range(8, 1, -1)]
    return first_of(*((groups.rlike(f"(?:^|:){run}(?:$|:)"), F.regexp_replace(groups, f"^(.*?)(?:^|:){run}(?:$|:)(.*)$", "$1::$2")) for run in runs), otherwise=groups)


def ipv6_string(addr: Column) -> Column:
    """The canonical form of 16 bytes: lower case, zeros shortened, mapped IPv4 dotted."""
    groups = F.regexp_replace(F.regexp_replace(F.lower(F.hex(addr)), "(....)(?!$)", "$1:"), "(^|:)0{1,3}", "$1")
    mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *(u8(addr, i).cast("string") for i in range(12, 16))))
    return F.when(F.hex(addr).startswith("0" * 20 + "FFFF"), mapped).otherwise(bound(groups, shortened))


def ip_string(ip: Column) -> Column:
    """The text of an address held as STRUCT<len INT, addr BINARY>; null stays null."""

    def text(x: Column) -> Column:
        addr = x["addr"]
        v4 = F.concat_ws(".", *(u8(addr, i).cast("string") for i in range(4)))
        return first_of((x["len"] == 4, v4), (x["len"] == 16, ipv6_string(addr)))

    return bound(ip, text)


def ip_struct(text: str | None) -> Column:
    """A literal STRUCT<len, addr> of an address in text form."""
    import ipaddress

    kind = "struct<len:int,addr:binary>"
    if text is None:
        return F.lit(None).cast(kind)
    raw = ipaddress.ip_address(text).packed
    return F.struct(F.lit(len(raw)).alias("len"), F.lit(raw).alias("addr")).cast(kind)


def protocol_name(proto: Column) -> Column:
    return first_of(*((proto == n, name) for n, name in PROTOCOL_NAMES.items()), otherwise="OTHER")


def five_tuple(src: Column, src_port: Column, dst: Column, dst_port: Column, protocol: Column) -> Column:
    return F.concat(src, F.lit(":"), src_port.cast("string"), F.lit(" -> "), dst, F.lit(":"), dst_port.cast("string"), F.lit("/"), F.upper(protocol))


def packet_info(protocol: Column, c: dict[str, Column], length: Column) -> Column:
    """One line about a packet. c: the columns src_port, dst_port, tcp_flags, tcp_seq, tcp_ack, tcp_window, payload_len, icmp_type, icmp_code, ip_proto."""
    text = lambda *parts: reduce(lambda a, b: F.concat(a, b), [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    ends = text(c["src_port"], f" {ARROW} ", c["dst_port"])
    size = text(" Len=", c["payload_len"])
    flags = text(" [", tcp_flag_string(c["tcp_flags"]), "]")
    numbers = text(" Seq=", c["tcp_seq"], " Ack=", c["tcp_ack"], " Win=", c["tcp_window"])
    named = text(F.upper(protocol), " ")
    return first_of(
        (protocol.isin("tcp", "tcp_truncated"), F.concat(ends, flags, numbers, size)),
        (protocol == "udp", F.concat(ends, size)),
        (protocol.isin("http", "tls"), F.concat(named, ends, flags, size)),
        (protocol.isin("dns", "ntp", "dhcp", "quic"), F.concat(named, ends, size)),
        (protocol == "icmp", text("ICMP type=", c["icmp_type"], " code=", c["icmp_code"])),
        otherwise=text("Proto=", c["ip_proto"], " Len=", length),
    )
