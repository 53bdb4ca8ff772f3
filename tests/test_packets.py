"""Literal frames, payloads and messages."""

import pytest
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.operators import protocols as pr
from packetloom.operators import telemetry as t
from packetloom.operators.dissect import dissect, enabled, packet_counts

MACS = "00112233445566778899AABB"
TCP_SYN = MACS + "0800" + "4500002800000000" + "4006" + "0000" + "C0A80164" + "0A000001" + "C000" + "0050" + "00000001" + "00000000" + "50" + "02" + "FFFF" + "0000" + "0000"
UDP = "0035" + "1000" + "0008" + "0000"


def one(spark, hexed, made):
    rows = spark.createDataFrame([(bytes.fromhex(hexed) if hexed is not None else None,)], "data binary")
    return made(rows).first()


def packet(spark, hexed):
    return one(spark, hexed, lambda df: dissect(df).withColumns({"src": net.ip_string(F.col("src_ip")), "dst": net.ip_string(F.col("dst_ip"))}))


def parsed(spark, hexed, function):
    return one(spark, hexed, lambda df: df.select(function(F.col("data")).alias("i")))["i"]


def test_tcp_syn(spark):
    p = packet(spark, TCP_SYN)
    assert (p.src, p.dst, p.src_port, p.dst_port, p.tcp_seq, p.tcp_ack, p.tcp_flags, p.tcp_window, p.protocol) == ("192.168.1.100", "10.0.0.1", 49152, 80, 1, 0, 2, 65535, "http")
    assert (p.ip_ttl, p.ip_total_len, p.payload_offset, p.payload_len, p.vlan_id, p.malformed) == (64, 40, 54, 0, None, False)


def test_vlan_dns(spark):
    p = packet(spark, MACS + "8100" + "0064" + "0800" + "4500001C00000000" + "4011" + "0000" + "0A0A0A01" + "0A0A0A02" + UDP)
    assert (p.vlan_id, p.ethertype, p.protocol, p.src_port, p.dst_port, p.payload_len) == (100, 0x0800, "dns", 53, 4096, 0)


@pytest.mark.parametrize("frame", [None, "", "0000000000", MACS + "8100" + "0064"])
def test_malformed(spark, frame):
    p = packet(spark, frame)
    assert p.malformed and p.protocol is None and p.src_ip is None and p.src_port is None


@pytest.mark.parametrize(
    ("frame", "tag"),
    [
        (MACS + "0806" + "00" * 28, "other"),
        (MACS + "0800" + "45" + "00" * 10, ""),
        (MACS + "0800" + "43" + "00" * 19, ""),
        (MACS + "0800" + "4500001800000000" + "4006" + "0000" + "0A000001" * 2 + "00" * 4, "tcp_truncated"),
        (MACS + "0800" + "4500001800000000" + "4011" + "0000" + "0A000001" * 2 + "00" * 4, "udp_truncated"),
        (MACS + "0800" + "4500001800000000" + "4001" + "0000" + "0A000001" * 2 + "00" * 2, "icmp_truncated"),
        (MACS + "0800" + "4500001800000000" + "4032" + "0000" + "0A000001" * 2 + "00" * 2, "ip_other"),
        (MACS + "86DD" + "60000000" + "0008" + "3A40" + "20010DB8" + "00" * 12 + "00" * 15 + "01" + "8000" + "00" * 6, "icmpv6"),
    ],
)
def test_tags(spark, frame, tag):
    assert packet(spark, frame).protocol == tag


def test_ip_options_and_http_on_other_ports(spark):
    p = packet(spark, MACS + "0800" + "46000000" + "00000000" + "4006" + "0000" + "0A0000010A000002" + "00000000" + "1F401F41" + "00000001" + "00000002" + "6018" + "FFFF" + "00000000" + "00000000" + b"GET /a HTTP/1.1\r\n".hex())
    assert (p.payload_offset, p.payload_len, p.protocol) == (14 + 24 + 24, 17, "http")


@pytest.mark.parametrize(
    "text", ["::", "::1", "1::", "2001:db8::1", "2001:db8:0:1:1:1:1:1", "2001:0:0:1::1", "1:0:0:2:3:0:0:4", "fe80::1:0:0:1", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:0", "10.0.0.1", "255.255.255.255"]
)
def test_addresses(spark, text):
    import ipaddress

    assert spark.range(1).select(net.ip_string(net.ip_struct(text)).alias("x")).first()[0] == str(ipaddress.ip_address(text))


def test_switches_and_counts(spark):
    rows = dissect(spark.createDataFrame([(bytes.fromhex(TCP_SYN),), (b"",), (bytes.fromhex(TCP_SYN),)], "data binary"))
    assert {tuple(r) for r in packet_counts(rows).collect()} == {("http", 2), ("malformed", 1)}
    assert enabled(rows.filter("not malformed"), {"http": False}).count() == 0


def test_http(spark):
    i = parsed(spark, b"GET /api/v1/status HTTP/1.1\r\nAccept: x\r\nHost: example.org \r\n\r\nHost: late".hex(), pr.http_info)
    assert tuple(i) == ("GET", "/api/v1/status", "HTTP/1.1", 0, "example.org")
    assert tuple(parsed(spark, b"HTTP/1.1 200 OK\r\n\r\nHost: body".hex(), pr.http_info)) == ("", "", "HTTP/1.1", 200, "")
    assert tuple(parsed(spark, b"HTTP/1.1xxxx".hex(), pr.http_info)) == ("", "", "", 0, "")
    for bad in (b"short a b", b"only two-words", b"one two three \xff\xfe", b"\nGET / HTTP/1.1"):
        assert parsed(spark, bad.hex(), pr.http_info) is None


def name(*labels):
    return b"".join(bytes([len(x)]) + x for x in labels)


HEAD = bytes.fromhex("ABCD01000001000000000000")


@pytest.mark.parametrize(
    ("question", "expected"),
    [
        (name(b"example", b"com") + b"\0\0\1\0\1", ("example.com", 1)),
        (b"\xc0\x0e" + name(b"ab") + b"\0\0\5", ("ab", 0x0261)),
        (b"\xc0\x0c\0\1", ("", 1)),
        (name(b"a") + b"\xc0\x0c\0\1", ("a.a", 0xC00C)),
        (name(*[b"a"] * 10) + b"\0\0\1", (".".join("a" * 10), 1)),
        (name(*[b"a"] * 11) + b"\0\0\1", ("", 0)),
        (name(b"\xff") + b"\0\0\1", ("<invalid>", 1)),
        (b"\x09ab", ("", 0)),
    ],
)
def test_dns(spark, question, expected):
    i = parsed(spark, (HEAD + question).hex(), pr.dns_info)
    assert (i.transaction_id, i.is_response, i.question_count) == (0xABCD, False, 1)
    assert (i.query_name, i.query_type) == expected


def test_tls(spark):
    host = b"example.org"
    n = len(host)
    u = lambda x, k: x.to_bytes(k, "big")
    hello = bytes.fromhex("160301") + u(56 + n, 2) + b"\1" + u(52 + n, 3) + bytes.fromhex("0303") + bytes(32) + bytes.fromhex("000002002F0100") + u(9 + n, 2) + bytes(2) + u(5 + n, 2) + u(3 + n, 2) + b"\0" + u(n, 2) + host
    assert tuple(parsed(spark, hello.hex(), pr.tls_info)) == (22, 3, 1, 1, "example.org")
    assert parsed(spark, hello[:50].hex(), pr.tls_info) is None
    assert tuple(parsed(spark, "160303000502010203", pr.tls_info)) == (22, 3, 3, 2, "")
    for bad in ("17030300050102030405", "1603", None):
        assert parsed(spark, bad, pr.tls_info) is None


def test_industrial(spark):
    assert tuple(parsed(spark, "0001000000060103" + "0000000A", pr.modbus_info)) == (1, 1, 3, False, 0, False)
    assert parsed(spark, "000200000006011000000002", pr.modbus_info).is_write
    i = parsed(spark, "000100000003018302", pr.modbus_info)
    assert (i.function_code, i.is_exception, i.exception_code) == (3, True, 2)
    assert parsed(spark, "0001000100060103", pr.modbus_info) is None
    i = parsed(spark, "056408C0" + "01000300" + "0000C001000000", pr.dnp3_info)
    assert (i.destination, i.source, i.function_code, i.is_control) == (1, 3, 1, False)
    assert parsed(spark, "056408C0" + "01000300" + "0000C003000000", pr.dnp3_info).is_control
    assert parsed(spark, "056408C0" + "01000300" + "0000C0", pr.dnp3_info).function_code == 0
    assert parsed(spark, "FFFF08C0010003000000", pr.dnp3_info) is None
    assert tuple(parsed(spark, "810A000C01040005010C", pr.bacnet_info)) == (0x81, 0x0A, 12, 1, True, 12, False)
    assert parsed(spark, "810A001401280001AA", pr.bacnet_info).is_confirmed and parsed(spark, "810A0014012800F1AA", pr.bacnet_info).is_confirmed is False
    assert parsed(spark, "810A000C01280001" + "01AA" + "000101BB" + "FF" + "0005010F", pr.bacnet_info).is_write
    assert tuple(parsed(spark, "810A0004", pr.bacnet_info)) == (0x81, 0x0A, 4, None, False, None, False)
    for bad in ("820A0004", "810A"):
        assert parsed(spark, bad, pr.bacnet_info) is None


def test_netflow(spark):
    record = "C0A80101" + "0A000001" + "00" * 8 + "00000064" + "0000C350" + "00" * 8 + "3039" + "0050" + "00" + "12" + "06" + "00" * 9
    rows = [("a", bytes.fromhex("00050002" + "00" * 20 + record)), ("b", bytes(10)), ("c", bytes.fromhex("00090001" + "00" * 20 + record)), ("d", None), ("e", bytes.fromhex("00050000" + "00" * 20))]
    found = t.netflow_v5(spark.createDataFrame(rows, "k string, data binary")).collect()
    assert [tuple(r) for r in found] == [("a", 0, 0xC0A80101, 0x0A000001, 100, 50000, 0, 0, 12345, 80, 0x12, 6)]


@pytest.mark.parametrize(
    ("message", "expected"),
    [
        ("<165>1 2026-03-24T00:00:00Z myhost myapp - - - Test message", (165, 20, 5, "2026-03-24T00:00:00Z", "myhost", "myapp - - - Test message")),
        ("<13>Mar 24 00:00:00 router sshd[1234]: Failed password", (13, 1, 5, "24", "00:00:00", "router sshd[1234]: Failed password")),
        ("Just a raw message", (13, 1, 5, "", "", "Just a raw message")),
        ("<2049>a b", (2049, 0, 1, "b", "", "a b")),
        ("<70000>a", None), ("<x>a", None), ("<13 a", None), ("  ", None), (None, None),
    ],
)
def test_syslog(spark, message, expected):
    row = spark.createDataFrame([(message,)], "m string").select(t.syslog_info(F.col("m")).alias("i")).first()["i"]
    assert (None if row is None else tuple(row)) == expected


def test_snmp(spark):
    i = parsed(spark, "300B0201010406" + b"public".hex(), t.snmp_info)
    assert (i.version, i.community, i.trap_oid, i.varbinds) == (1, "public", "", [])
    assert parsed(spark, "300B0201010402FFFE" + "0000", t.snmp_info).community == "???"
    for bad in ("310B0201010406" + b"public".hex(), "30", "3085" + "00" * 10, "300B0201010409" + b"public".hex()):
        assert parsed(spark, bad, t.snmp_info) is None
    assert t.ber_length(bytes([5]), 0) == (5, 1) and t.ber_length(bytes([0x82, 1, 0]), 0) == (256, 3) and t.ber_length(bytes([0x80]), 0) is None


def test_texts(spark):
    row = spark.range(1).select(*(net.tcp_flag_string(F.lit(x)).alias(f"f{x}") for x in (0, 0x12, 0xFF)), net.mac_string(F.lit(bytes.fromhex("00AAFF010203"))).alias("mac"), net.ethertype_string(F.lit(0x800)).alias("e")).first()
    assert tuple(row) == ("none", "SYN, ACK", "SYN, ACK, FIN, RST, PSH, URG, ECE, CWR", "00:aa:ff:01:02:03", "0x0800")
