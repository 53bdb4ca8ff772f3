"""Header fields of Ethernet frames, a batch at a time.

Where the next header starts depends on bytes of the one before, three levels deep. As column expressions that nests so deeply that pushed-down filters
outgrow code generation; here every field is one lookup in the batch's bytes for all its frames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

# EtherTypes, protocol numbers, least sizes of headers.
VLAN, IPV4, IPV6 = 0x8100, 0x0800, 0x86DD
ICMP, TCP, UDP, ICMPV6 = 1, 6, 17, 58

ADDRESS = StructType().add("len", IntegerType()).add("addr", BinaryType())
NUMBERS = ("ip_proto", "ip_ttl", "ip_total_len", "src_port", "dst_port", "tcp_flags", "tcp_window", "icmp_type", "icmp_code", "payload_offset", "payload_len")
HEADERS = StructType(
    [
        StructField("malformed", BooleanType()),
        StructField("dst_mac", BinaryType()),
        StructField("src_mac", BinaryType()),
        StructField("ethertype", IntegerType()),
        StructField("vlan_id", IntegerType()),
        StructField("src_ip", ADDRESS),
        StructField("dst_ip", ADDRESS),
        StructField("tcp_seq", LongType()),
        StructField("tcp_ack", LongType()),
        *(StructField(c, IntegerType()) for c in NUMBERS),
        StructField("transport", StringType()),
    ]
)
TRANSPORTS = np.array(["", "other", "tcp", "tcp_truncated", "udp", "udp_truncated", "icmp", "icmpv6", "icmp_truncated", "ip_other"])


class Bytes:
    """The bytes of a binary column; reads beyond a row's end give what lies there, so that conditions have to mask them."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, "i8")[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, "i8")
        self.start = at[:-1]
        self.length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, at[1:] - at[:-1])
        self.data = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(1, "u1")

    def number(self, at: np.ndarray | int, size: int, rows: np.ndarray | None = None) -> np.ndarray:
        """A number of so many bytes of each row, or of each of `rows`, which may repeat."""
        start = (self.start if rows is None else self.start[rows]) + at
        out = np.zeros(len(start), "i8")
        for k in range(size):
            out = out << 8 | self.data[np.minimum(start + k, len(self.data) - 1)]
        return out

    def parts(self, at: np.ndarray | int, size: np.ndarray) -> pa.Array:
        """So many bytes of each row; null where none."""
        ends = np.cumsum(size)
        place = np.repeat(self.start + at - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        valid = np.packbits(size > 0, bitorder="little")
        offsets = np.concatenate(([0], ends)).astype("i4")
        return pa.Array.from_buffers(pa.binary(), len(size), [pa.py_buffer(valid.tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.data[place].tobytes())])


def header_fields(column: pa.Array) -> pa.Array:
    b = Bytes(column)
    n = b.length
    outer = b.number(12, 2)
    vlan = (n >= 14) & (outer == VLAN)
    bad = (n < 14) | (vlan & (n < 18))
    ok = ~bad
    l3 = np.where(vlan, 18, 14)
    kind = np.where(vlan, b.number(16, 2), outer)
    ihl = (b.number(l3, 1) & 15) * 4
    v4 = ok & (kind == IPV4) & (n >= l3 + 20) & (ihl >= 20) & (n >= l3 + ihl)
    v6 = ok & (kind == IPV6) & (n >= l3 + 40)
    pick = lambda a, c, size: np.where(v4, b.number(l3 + a, size), np.where(v6, b.number(l3 + c, size), 0))
    proto = pick(9, 6, 1)
    l4 = np.where(v4, l3 + ihl, l3 + 40)
    ip = v4 | v6
    left = n - l4
    is_tcp, is_udp, is_icmp = ip & (proto == TCP), ip & (proto == UDP), ip & ((proto == ICMP) | (proto == ICMPV6))
    tcp, udp, icmp = is_tcp & (left >= 20), is_udp & (left >= 8), is_icmp & (left >= 4)
    other = ip & ~is_tcp & ~is_udp & ~is_icmp
    named = [tcp, is_tcp, udp, is_udp, icmp & (proto == ICMPV6), icmp, is_icmp, other, ok & ((kind == IPV4) | (kind == IPV6)), ok]
    transport = TRANSPORTS[np.select(named, [2, 3, 4, 5, 7, 6, 8, 9, 0, 1], 0)]
    head = np.select([tcp, udp, icmp], [np.maximum(20, (b.number(l4 + 12, 1) >> 4) * 4), np.full(len(n), 8), np.minimum(8, left)], 0)
    has_payload = tcp | udp | icmp | other
    rest = np.where(has_payload, np.maximum(left - head, 0), 0)
    rest = np.where(udp, np.minimum(np.maximum(b.number(l4 + 4, 2) - 8, 0), rest), rest)
    on = lambda mask, at, size: np.where(mask, b.number(l4 + at, size), 0)
    numbers = {
        "ip_proto": proto, "ip_ttl": pick(8, 7, 1), "ip_total_len": pick(2, 4, 2), "src_port": on(tcp | udp, 0, 2), "dst_port": on(tcp | udp, 2, 2), "tcp_flags": on(tcp, 13, 1), "tcp_window": on(tcp, 14, 2),
        "icmp_type": on(icmp, 0, 1), "icmp_code": on(icmp, 1, 1), "payload_offset": np.where(has_payload, l4 + head, 0), "payload_len": rest,
    }
    width = np.where(v4, 4, np.where(v6, 16, 0))

    def address(four: int, six: int) -> pa.Array:
        fields = [pa.array(width, pa.int32()), b.parts(l3 + np.where(v4, four, six), width)]
        return pa.StructArray.from_arrays(fields, ["len", "addr"], mask=pa.array(width == 0))

    six = np.where(bad, 0, 6)
    whole = lambda x, kind=pa.int32(), mask=bad: pa.array(x, kind, mask=mask)
    arrays = [pa.array(bad), b.parts(0, six), b.parts(6, six), whole(kind), whole(b.number(14, 2) & 0x0FFF, mask=bad | ~vlan), address(12, 8), address(16, 24), whole(on(tcp, 4, 4), pa.int64()), whole(on(tcp, 8, 4), pa.int64())]
    arrays += [whole(numbers[c]) for c in NUMBERS] + [pa.array(transport, pa.string(), mask=bad)]
    return pa.StructArray.from_arrays(arrays, HEADERS.names)


def _frame_headers(column: pa.Array) -> pa.Array:
    """HEADERS of each frame."""
    return header_fields(column)


#: Not deterministic as far as the optimizer knows: filters on its fields would run it a second time below.
frame_headers = F.arrow_udf(_frame_headers, HEADERS).asNondeterministic()
