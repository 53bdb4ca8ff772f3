"""Packets, frames and messages derived from the tables `events` and `pages`, for queries over data that has no packets.

The expressions are SQL text that Spark and DuckDB read alike, so both see the same rows. Ids are arithmetic. Times need a session in UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOST = "user_id % 30"
SWAPPED = "event_id % 3 = 0"
SERVICE = "case user_id % 5 when 0 then 53 when 1 then 80 when 2 then 443 when 3 then 502 else 20000 end"
CLIENT = f"(1024 + ({HOST}) % 7)"
SRC, DST = f"(167772160 + ({HOST}) + 1)", f"(3232235776 + ({HOST}) % 4 + 1)"

PACKETS = {
    "seq": "event_id",
    "src_ip": f"case when {SWAPPED} then {DST} else {SRC} end",
    "dst_ip": f"case when {SWAPPED} then {SRC} else {DST} end",
    "src_port": f"cast(case when {SWAPPED} then {SERVICE} else {CLIENT} end as int)",
    "dst_port": f"cast(case when {SWAPPED} then {CLIENT} else {SERVICE} end as int)",
    "proto": "case when user_id % 5 = 0 then 17 else 6 end",
    "payload_len": "cast(floor(value) as int)",
    "tcp_flags": "case when user_id % 5 = 0 then 0 else case event_id % 11 when 0 then 41 when 1 then 0 when 2 then 2 else 24 end end",
    "modbus_fc": "case when user_id % 5 = 3 then cast(event_id % 17 as int) end",
    "dnp3_fc": "case when user_id % 5 = 4 then cast(event_id % 16 as int) end",
    "dns_query": "case when user_id % 5 = 0 then concat(event_type, cast(event_id % 7 as string), '.example.com') end",
}


def _u(x: str, digits: int) -> str:
    return f"lpad(hex({x}), {digits}, '0')"


_SRC4, _DST4 = f"concat('0A', {_u('user_id % 200 + 1', 6)})", f"concat('C0A801', {_u('event_id % 16 + 1', 2)})"
_TCP_PORT = "case (event_id // 7) % 5 when 0 then 8443 when 1 then 80 when 2 then 443 when 3 then 502 else 20000 end"
_UDP_PORT = "case (event_id // 7) % 5 when 0 then 53 when 1 then 123 when 2 then 67 when 3 then 443 else 9999 end"
_FLAGS = "case event_id % 11 when 0 then 41 when 1 then 0 when 2 then 2 else 24 end"
_MACS = "'000000000001020000000002'"
_UDP = f"{_u('2048 + user_id % 7', 4)}, {_u(_UDP_PORT, 4)}, {_u('8 + length(event_type)', 4)}, '0000', hex(event_type)"


def _ipv4(proto: str, size: str) -> str:
    return f"'4500', {_u(f'20 + {size}', 4)}, '0000000040', '{proto}', '0000', {_SRC4}, {_DST4}"


#: A frame as hex digits; by event_id % 7: TCP, VLAN with UDP, IPv6 with UDP, ICMP, cut TCP, not IP, too short.
FRAME = f"""case event_id % 7
when 0 then concat({_MACS}, '0800', {_ipv4('06', '20 + length(event_type)')}, {_u('1024 + user_id % 7', 4)}, {_u(_TCP_PORT, 4)}, {_u('event_id', 8)}, '00000002', '50', {_u(_FLAGS, 2)}, 'FFFF00000000', hex(event_type))
when 1 then concat({_MACS}, '8100', {_u('event_id % 4096', 4)}, '0800', {_ipv4('11', '8 + length(event_type)')}, {_UDP})
when 2 then concat({_MACS}, '86DD', '60000000', {_u('8 + length(event_type)', 4)}, '1140', '20010DB8000000000000', {_u('user_id', 4)}, '00000001', 'FE80', repeat('0', 24), {_u('event_id % 65536', 4)}, {_UDP})
when 3 then concat({_MACS}, '0800', {_ipv4('01', '8')}, {_u('event_id % 12', 2)}, {_u('user_id % 4', 2)}, '000000000000')
when 4 then concat({_MACS}, '0800', {_ipv4('06', '8')}, '0400005000000001')
when 5 then concat({_MACS}, '0806', '0001080006040001')
else '00112233445566' end"""

SYSLOG = "concat('<', cast(event_id % 192 as string), '>1 t', cast(event_id as string), ' host', cast(user_id as string), ' app - - - ', event_type)"
URL_HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"
HTTP = f"concat('GET /', cast(page_id as string), ' HTTP/1.1', chr(13), chr(10), 'Host: ', {URL_HOST}, chr(13), chr(10), chr(13), chr(10))"
MODBUS = f"concat({_u('event_id % 65536', 4)}, '00000006', {_u('user_id % 256', 2)}, {_u('case event_id % 7 when 0 then 1 when 1 then 3 when 2 then 5 when 3 then 6 when 4 then 15 when 5 then 16 else 131 end', 2)}, '02000001')"
DNP3 = f"concat('056408C0', {_u('event_id % 256', 2)}, '00', {_u('user_id % 256', 2)}, '00', '0000', 'C0', {_u('event_id % 16', 2)})"
#: NPDU control with both, one or no route, then the APDU.
BACNET = f"concat('810A', {_u('event_id % 65536', 4)}, '01', case event_id % 4 when 0 then '04' when 1 then '20000101AA' when 2 then '08000101AA' else '28000101AA000101BB' end, case when event_id % 4 in (1, 3) then 'FF' else '' end, {_u('event_id % 3 * 16', 2)}, '0501', {_u('event_id % 20', 2)})"
NETFLOW = f"concat('0005', {_u('event_id % 3 + 1', 4)}, repeat('00', 20), repeat(concat('C0A80101', {_u('user_id', 8)}, repeat('00', 8), {_u('event_id % 1000', 8)}, {_u('event_id', 8)}, '0000000A', '00000014', {_u('event_id % 65536', 4)}, '0050', '00', '12', '06', repeat('00', 9)), cast(event_id % 3 + 1 - event_id % 2 as int)))"
SNMP = "concat('30', '1F', '0201', '01', '04', lpad(hex(length(event_type)), 2, '0'), hex(event_type), 'A700')"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def spark_sql(x: str) -> str:
    return x.replace(" // ", " div ")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 packets of 30 hosts, in both directions; addresses are bigints."""
    return as_packets(events(spark, sf_dir))


def packet_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`packets` as a stream of files. A pattern, since a stream's path may not be one file."""
    return as_packets(spark.readStream.schema(events(spark, sf_dir).schema).parquet(f"{sf_dir}/event[s].parquet"))


def as_packets(rows: DataFrame) -> DataFrame:
    return rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), *(F.expr(spark_sql(x)).alias(c) for c, x in PACKETS.items()))


def of_events(spark: SparkSession, sf_dir: str, x: str, name: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.expr(spark_sql(x)).alias(name))


def of_pages(spark: SparkSession, sf_dir: str, x: str, name: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", F.expr(spark_sql(x)).alias(name))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts_us and data: Ethernet frames of seven kinds."""
    return events(spark, sf_dir).select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.unhex(F.expr(spark_sql(FRAME))).alias("data"))


def hello(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and data: a TLS ClientHello that names the page's host."""
    host = pages(spark, sf_dir).select("page_id", F.expr(URL_HOST).alias("host"))
    n = F.length("host")
    wide = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    parts = [F.lit("160301"), wide(56 + n, 4), F.lit("01"), wide(52 + n, 6), F.lit("0303" + "00" * 32 + "00" + "0002002F" + "0100"), wide(9 + n, 4), F.lit("0000"), wide(5 + n, 4), wide(3 + n, 4), F.lit("00"), wide(n, 4), F.hex("host")]
    return host.select("page_id", F.unhex(F.concat(*parts)).alias("data"))


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and data: a DNS query for the page's host."""
    host = pages(spark, sf_dir).select("page_id", F.expr(URL_HOST).alias("host"))
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lpad(F.hex(F.length(x)), 2, "0"), F.hex(x)))
    return host.select("page_id", F.unhex(F.concat(F.lpad(F.hex(F.col("page_id") % 65536), 4, "0"), F.lit("01000001000000000000"), F.array_join(labels, ""), F.lit("0000010001"))).alias("data"))
