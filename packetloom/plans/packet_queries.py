"""Queries about frames and messages: dissection, protocols, telemetry, histories, events, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.operators import captures as c
from packetloom.operators import dissect as d
from packetloom.operators import events as e
from packetloom.operators import flows as fl
from packetloom.operators import protocols as pr
from packetloom.operators import telemetry as t
from packetloom.plans import fixtures as fx
from packetloom.plans import views
from packetloom.plans.flow_queries import FLOWS, IDLE, LAST, LIVE
from packetloom.plans.queries import P, of_events, of_pages, query, u
from packetloom.plans.rule_queries import JUDGED, STATS, V4, judged
from packetloom.session import scratch
from packetloom.sources.pcap import capture_stats as stats_of
from packetloom.sources.pcap import read_pcap, write_pcap

PACKET_QUERIES: list = []
Q = PACKET_QUERIES

_FLAG_WORDS = "concat_ws(', ', " + ", ".join(f"case when tcp_flags & {bit} <> 0 then '{name}' end" for bit, name in net.FLAG_NAMES) + ")"
_MAC = "array_to_string([lower(substr(h, {0} + 2 * i, 2)) for i in range(6)], ':')"
_V6 = f"case when {u('l3 + 18', 2)} = 0 then '2001:db8::1' else '2001:db8::' || lower(hex({u('l3 + 18', 2)})) || ':0:1' end"
_V6D = f"case when {u('l3 + 38', 2)} = 0 then 'fe80::' else 'fe80::' || lower(hex({u('l3 + 38', 2)})) end"


def _v(four: str, six: str) -> str:
    return f"case v when 4 then {four} when 6 then {six} when 0 then 0 end"


def _on(kinds: str, x: str) -> str:
    return f"case when kind in ({kinds}) then {x} when not malformed then 0 end"


FR = f"fr as (select event_id, epoch_us(ts) as ts_us, {fx.FRAME} as h from events)"
DISSECTED = f"""{FR}, f1 as (select *, length(h) // 2 as n, {u(12, 2)} as et0 from fr),
f2 as (select *, n < 14 or (et0 = 33024 and n < 18) as malformed, case when et0 = 33024 then 18 else 14 end as l3 from f1),
f3 as (select *, case when malformed then null when l3 = 18 then {u(16, 2)} else et0 end as ethertype, case when l3 = 18 and not malformed then {u(14, 2)} & 4095 end as vlan_id, ({u('l3', 1)} & 15) * 4 as ihl from f2),
f4 as (select *, case when malformed then null when ethertype = 2048 and n >= l3 + 20 and ihl >= 20 and n >= l3 + ihl then 4 when ethertype = 34525 and n >= l3 + 40 then 6 else 0 end as v from f3),
f5 as (select *, {_v(u('l3 + 9', 1), u('l3 + 6', 1))} as ip_proto, {_v(u('l3 + 8', 1), u('l3 + 7', 1))} as ip_ttl, {_v(u('l3 + 2', 2), u('l3 + 4', 2))} as ip_total_len, {_v('l3 + ihl', 'l3 + 40')} as l4,
 case v when 4 then {V4.format('(' + u('l3 + 12', 4) + ')')} when 6 then {_V6} end as src_ip, case v when 4 then {V4.format('(' + u('l3 + 16', 4) + ')')} when 6 then {_V6D} end as dst_ip from f4),
f6 as (select *, case when malformed then null when v = 0 and ethertype in (2048, 34525) then '' when v = 0 then 'other' when ip_proto = 6 then case when n >= l4 + 20 then 'tcp' else 'tcp_truncated' end
 when ip_proto = 17 then case when n >= l4 + 8 then 'udp' else 'udp_truncated' end when ip_proto in (1, 58) then case when n < l4 + 4 then 'icmp_truncated' when ip_proto = 58 then 'icmpv6' else 'icmp' end else 'ip_other' end as kind from f5),
f7 as (select *, {_on("'tcp', 'udp'", u('l4', 2))} as src_port, {_on("'tcp', 'udp'", u('l4 + 2', 2))} as dst_port, {_on("'tcp'", u('l4 + 4', 4))} as tcp_seq, {_on("'tcp'", u('l4 + 8', 4))} as tcp_ack,
 {_on("'tcp'", u('l4 + 13', 1))} as tcp_flags, {_on("'tcp'", u('l4 + 14', 2))} as tcp_window, {_on("'icmp', 'icmpv6'", u('l4', 1))} as icmp_type, {_on("'icmp', 'icmpv6'", u('l4 + 1', 1))} as icmp_code,
 case kind when 'tcp' then greatest(20, ({u('l4 + 12', 1)} >> 4) * 4) when 'udp' then 8 when 'icmp' then least(8, n - l4) when 'ip_other' then 0 end as head from f6),
f8 as (select *, case when head is not null then l4 + head when not malformed then 0 end as payload_offset, case when kind = 'udp' then least(greatest({u('l4 + 4', 2)} - 8, 0), greatest(n - l4 - head, 0)) when head is not null then greatest(n - l4 - head, 0) when not malformed then 0 end as payload_len,
 case when ip_proto = 6 and (src_port in (443, 8443) or dst_port in (443, 8443)) then 'tls' when ip_proto = 6 and dst_port = 80 then 'http' when ip_proto = 17 and dst_port = 53 then 'dns' when ip_proto = 17 and dst_port = 123 then 'ntp'
 when ip_proto = 17 and dst_port = 67 then 'dhcp' when ip_proto = 17 and dst_port = 443 then 'quic' else kind end as protocol from f7)"""
_ENDS = "src_port || ' → ' || dst_port"
INFO = f"""case when protocol in ('tcp', 'tcp_truncated') then {_ENDS} || ' [' || flag_words || '] Seq=' || tcp_seq || ' Ack=' || tcp_ack || ' Win=' || tcp_window || ' Len=' || payload_len
 when protocol = 'udp' then {_ENDS} || ' Len=' || payload_len when protocol in ('http', 'tls') then upper(protocol) || ' ' || {_ENDS} || ' [' || flag_words || '] Len=' || payload_len
 when protocol in ('dns', 'ntp', 'dhcp', 'quic') then upper(protocol) || ' ' || {_ENDS} || ' Len=' || payload_len when protocol = 'icmp' then 'ICMP type=' || icmp_type || ' code=' || icmp_code
 else 'Proto=' || ip_proto || ' Len=' || n end"""
SHOWN = f"{DISSECTED}, f9 as (select *, case when tcp_flags = 0 then 'none' else {_FLAG_WORDS} end as flag_words from f8), f10 as (select *, {INFO} as info from f9 where not malformed)"


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.dissect(fx.frames(spark, sf_dir).withColumn("length", F.length("data")))


@query(Q, "dissect_eth_vlan", "l:event_id b:malformed l:ethertype vlan_id s:src_mac dst_mac", f"{DISSECTED}, result as (select *, case when not malformed then {_MAC.format(13)} end as src_mac, case when not malformed then {_MAC.format(1)} end as dst_mac from f8)")
@query(Q, "mac_format", "l:event_id s:src_mac dst_mac", f"{DISSECTED}, result as (select *, case when not malformed then {_MAC.format(13)} end as src_mac, case when not malformed then {_MAC.format(1)} end as dst_mac from f8)")
def dissect_eth_vlan(spark, sf_dir):
    return seen(spark, sf_dir).withColumns({x: net.mac_string(F.col(x)) for x in ("src_mac", "dst_mac")})


for _name, _filter, _sql, _columns in (
    ("dissect_ipv4", "src_ip.len = 4", "v = 4", "l:event_id s:src_ip dst_ip l:ip_proto ip_ttl ip_total_len"),
    ("dissect_ipv6", "src_ip.len = 16", "v = 6", "l:event_id s:src_ip dst_ip l:ip_proto ip_ttl ip_total_len"),
    ("dissect_tcp", "ip_proto = 6", "ip_proto = 6", "l:event_id src_port dst_port tcp_seq tcp_ack tcp_flags tcp_window payload_offset payload_len"),
    ("dissect_udp", "ip_proto = 17", "ip_proto = 17", "l:event_id src_port dst_port payload_offset payload_len"),
    ("dissect_icmp", "ip_proto = 1", "ip_proto = 1", "l:event_id icmp_type icmp_code payload_offset payload_len"),
    ("l7_tag", "true", "true", "l:event_id s:protocol"),
):

    @query(Q, _name, _columns, f"{DISSECTED}, result as (select * from f8 where {_sql})")
    def _dissected(spark, sf_dir, keep=_filter):
        return seen(spark, sf_dir).filter(keep).withColumns({x: net.ip_string(F.col(x)) for x in ("src_ip", "dst_ip")})


@query(Q, "dissector_toggle", "l:event_id s:protocol", f"{DISSECTED}, result as (select * from f8 where not malformed and protocol not in ('udp', 'quic', 'dns', 'tls'))")
def dissector_toggle(spark, sf_dir):
    return d.enabled(seen(spark, sf_dir).filter("not malformed"), {"udp": False, "dns": False, "tls": False})


@query(Q, "tcp_flag_string", "l:event_id s:flag_words", f"{SHOWN}, result as (select * from f9 where not malformed)")
def tcp_flag_string(spark, sf_dir):
    return seen(spark, sf_dir).filter("not malformed").withColumn("flag_words", net.tcp_flag_string(F.col("tcp_flags")))


@query(Q, "packet_info", "l:event_id s:protocol info ethertype", f"{SHOWN}, result as (select event_id, upper(protocol) as protocol, info, '0x' || lpad(hex(ethertype), 4, '0') as ethertype from f10)")
def packet_info(spark, sf_dir):
    return views.packet_records(seen(spark, sf_dir))


@query(
    Q,
    "recent_packets_500",
    "l:no event_id s:src_ip dst_ip protocol info",
    f"""{SHOWN}, result as (select event_id, row_number() over (order by ts_us, event_id) as no, coalesce(src_ip, '—') as src_ip, coalesce(dst_ip, '—') as dst_ip, upper(protocol) as protocol, info from f10
 order by ts_us desc, event_id desc limit {c.MOST_PACKETS})""",
)
def recent_packets_500(spark, sf_dir):
    return views.recent_packets(views.packet_records(seen(spark, sf_dir)), order=("ts_us", "event_id"))


COUNTS = "pc as (select case when malformed then 'malformed' else protocol end as protocol, count(*) as n from f8 group by 1)"


@query(Q, "packet_counts", "s:protocol l:n", f"{DISSECTED}, {COUNTS}, result as (select * from pc)")
def packet_counts(spark, sf_dir):
    return d.packet_counts(seen(spark, sf_dir))


FRAME_HITS = """fh as (select *, case when v is null or v = 0 then null when dst_port = 0 and tcp_flags & 2 = 2 then 'GE-NET-001' when tcp_flags & 41 = 41 then 'GE-NET-002' when ip_proto = 6 and tcp_flags & 255 = 0 then 'GE-NET-003' end as rule_id from f8 where not malformed)"""


@query(Q, "frame_verdicts", "l:event_id s:rule_id verdict", f"{DISSECTED}, {FRAME_HITS}, result as (select *, case when rule_id is null then 'pass' when rule_id = 'GE-NET-003' then 'alert' else 'drop' end as verdict from fh)")
def frame_verdicts(spark, sf_dir):
    return views.judged_frames(fx.frames(spark, sf_dir)).filter("not malformed")


@query(Q, "pcap_round_trip", "l:ts_us cap_len orig_len s:hex", f"{FR}, result as (select ts_us, length(h) // 2 as cap_len, length(h) // 2 as orig_len, h as hex from fr)")
def pcap_round_trip(spark, sf_dir):
    """Frames as files, read in ranges that are smaller than these."""
    path = scratch(spark, "pcap")
    write_pcap(fx.frames(spark, sf_dir), path)
    return read_pcap(spark, path, rangeBytes=100_000).withColumn("hex", F.hex("data"))


@query(Q, "capture_stats", "l:received dropped dropped_bytes truncated", f"{FR}, result as (select count(*) as received, 0 as dropped, 0 as dropped_bytes, count(*) filter (where length(h) // 2 > 60) as truncated from fr)")
def capture_stats(spark, sf_dir):
    """What reading the frames says when they were captured with a length of 60 bytes at most."""
    path = scratch(spark, "pcap")
    frames = fx.frames(spark, sf_dir)
    write_pcap(frames.select("ts_us", F.length("data").alias("orig_len"), F.substring("data", 1, 60).alias("data")), path)
    return stats_of(read_pcap(spark, path))


# Protocols and telemetry


@query(Q, "http_parse", "l:page_id s:method uri version l:status_code s:host", f"{of_pages(fx.URL_HOST, 'host')}, result as (select page_id, 'GET' as method, '/' || page_id as uri, 'HTTP/1.1' as version, 0 as status_code, host from m)")
def http_parse(spark, sf_dir):
    return fx.of_pages(spark, sf_dir, fx.HTTP, "m").select("page_id", pr.http_info(F.encode("m", "UTF-8")).alias("i")).select("page_id", "i.*")


_ID, _LINE = "cast(page_id as string)", "chr(13), chr(10)"
#: By page_id % 4: a request with a header in lower case, a response, a line with more words and bare line ends, no HTTP.
HTTP_KINDS = f"""case page_id % 4 when 0 then concat('POST /p', {_ID}, ' HTTP/1.0', {_LINE}, 'host: h', {_ID}, '  ', {_LINE}, {_LINE}) when 1 then concat('HTTP/1.1 ', cast(200 + page_id % 300 as string), ' Some Text', {_LINE}, 'Host: x', {_LINE}, {_LINE})
 when 2 then concat('PUT /a b c', chr(10), 'X: y', chr(10), 'Host: late', chr(10), chr(10), 'Host: no') else 'nothing here' end"""


@query(
    Q,
    "http_kinds",
    "l:page_id s:method uri version l:status_code s:host",
    """result as (select page_id, case page_id % 4 when 0 then 'POST' when 1 then '' when 2 then 'PUT' end as method, case page_id % 4 when 0 then '/p' || page_id when 1 then '' when 2 then '/a' end as uri,
 case page_id % 4 when 0 then 'HTTP/1.0' when 1 then 'HTTP/1.1' when 2 then 'b c' end as version, case page_id % 4 when 1 then 200 + page_id % 300 when 3 then null else 0 end as status_code, case page_id % 4 when 0 then 'h' || page_id when 1 then 'x' when 2 then 'late' end as host from pages)""",
)
def http_kinds(spark, sf_dir):
    return fx.of_pages(spark, sf_dir, HTTP_KINDS, "m").select("page_id", pr.http_info(F.encode("m", "UTF-8")).alias("i")).select("page_id", "i.*")


#: Names by pointer: the question points to a name at the end, which points to itself where page_id % 3 = 0.
DNS_POINTERS = "concat(lpad(hex(page_id % 65536), 4, '0'), '81800001', lpad(hex(page_id % 7), 4, '0'), '00000000', '03777777', 'C014', lpad(hex(page_id % 30), 4, '0'), '0001', case when page_id % 3 = 0 then 'C014' else '076578616D706C6503636F6D00' end)"


@query(
    Q,
    "dns_pointers",
    "l:page_id transaction_id b:is_response l:question_count answer_count",
    "result as (select page_id, page_id % 65536 as transaction_id, true as is_response, 1 as question_count, page_id % 7 as answer_count from pages)",
)
def dns_pointers(spark, sf_dir):
    """Responses whose question's name is compressed; some of the pointers go in circles."""
    return fx.of_pages(spark, sf_dir, DNS_POINTERS, "h").select("page_id", pr.dns_info(F.unhex("h")).alias("i")).select("page_id", "i.*")


@query(Q, "dns_parse", "l:page_id transaction_id b:is_response l:question_count answer_count s:query_name l:query_type", f"{of_pages(fx.URL_HOST, 'host')}, result as (select page_id, page_id % 65536 as transaction_id, false as is_response, 1 as question_count, 0 as answer_count, host as query_name, 1 as query_type from m)")
def dns_parse(spark, sf_dir):
    return fx.dns(spark, sf_dir).select("page_id", pr.dns_info(F.col("data")).alias("i")).select("page_id", "i.*")


@query(Q, "tls_sni", "l:page_id content_type major minor handshake_type s:sni", f"{of_pages(fx.URL_HOST, 'host')}, result as (select page_id, 22 as content_type, 3 as major, 1 as minor, 1 as handshake_type, host as sni from m)")
def tls_sni(spark, sf_dir):
    return fx.hello(spark, sf_dir).select("page_id", pr.tls_info(F.col("data")).alias("i")).select("page_id", "i.*")


def bytes_of(spark: SparkSession, sf_dir: str, x: str) -> DataFrame:
    return fx.of_events(spark, sf_dir, x, "h").select("event_id", F.unhex("h").alias("data"))


@query(
    Q,
    "modbus_parse",
    "l:event_id transaction_id unit_id function_code b:is_exception l:exception_code b:is_write",
    f"""{of_events(fx.MODBUS, 'h')}, result as (select event_id, {u(0, 2)} as transaction_id, {u(6, 1)} as unit_id, {u(7, 1)} & 127 as function_code, {u(7, 1)} >= 128 as is_exception, case when {u(7, 1)} >= 128 then {u(8, 1)} else 0 end as exception_code,
 {u(7, 1)} & 127 in (5, 6, 15, 16) as is_write from m)""".replace(f"{u(7, 1)} & 127 in", f"({u(7, 1)} & 127) in"),
)
def modbus_parse(spark, sf_dir):
    return bytes_of(spark, sf_dir, fx.MODBUS).select("event_id", pr.modbus_info(F.col("data")).alias("i")).select("event_id", "i.*")


@query(Q, "dnp3_parse", "l:event_id length control destination source function_code b:is_control", f"""{of_events(fx.DNP3, 'h')}, result as (select event_id, {u(2, 1)} as length, {u(3, 1)} as control, {u(4, 1)} + 256 * {u(5, 1)} as destination, {u(6, 1)} + 256 * {u(7, 1)} as source, {u(11, 1)} as function_code, {u(11, 1)} in (2, 3, 4, 5, 6, 13, 14) as is_control from m)""")
def dnp3_parse(spark, sf_dir):
    return bytes_of(spark, sf_dir, fx.DNP3).select("event_id", pr.dnp3_info(F.col("data")).alias("i")).select("event_id", "i.*")


@query(
    Q,
    "bacnet_parse",
    "l:event_id bvlc_type bvlc_function bvlc_length npdu_version b:is_confirmed l:service_choice b:is_write",
    f"""{of_events(fx.BACNET, 'h')}, result as (select event_id, 129 as bvlc_type, 10 as bvlc_function, event_id % 65536 as bvlc_length, 1 as npdu_version, event_id % 3 = 0 as is_confirmed,
 case when event_id % 3 = 0 then event_id % 20 end as service_choice, event_id % 3 = 0 and event_id % 20 = 15 as is_write from m)""",
)
def bacnet_parse(spark, sf_dir):
    return bytes_of(spark, sf_dir, fx.BACNET).select("event_id", pr.bacnet_info(F.col("data")).alias("i")).select("event_id", "i.*")


@query(
    Q,
    "netflow_v5",
    "l:event_id record src_ip dst_ip packets bytes first_switched last_switched src_port dst_port tcp_flags protocol",
    f"""m as (select event_id, user_id, unnest(range(event_id % 3 + 1 - event_id % 2)) as record from events),
result as (select event_id, record, 3232235777 as src_ip, user_id as dst_ip, event_id % 1000 as packets, event_id as bytes, 10 as first_switched, 20 as last_switched, event_id % 65536 as src_port, 80 as dst_port, 18 as tcp_flags, 6 as protocol from m)""",
)
def netflow_v5(spark, sf_dir):
    return t.netflow_v5(bytes_of(spark, sf_dir, fx.NETFLOW))


@query(
    Q,
    "syslog_parse",
    "l:event_id priority facility severity s:hostname app_name message",
    f"""{of_events(fx.SYSLOG, 'm')}, w as (select event_id, string_split(substr(m, strpos(m, '>') + 1), ' ') as p, cast(regexp_extract(m, '^<([0-9]+)>', 1) as bigint) as priority from m),
result as (select event_id, priority, (priority >> 3) & 255 as facility, priority & 7 as severity, p[2] as hostname, p[3] as app_name, array_to_string(p[4:], ' ') as message from w)""",
)
def syslog_parse(spark, sf_dir):
    return fx.of_events(spark, sf_dir, fx.SYSLOG, "m").select("event_id", t.syslog_info(F.col("m")).alias("i")).select("event_id", "i.*")


@query(Q, "snmp_envelope", "l:event_id version s:community", "result as (select event_id, 1 as version, event_type as community from events)")
def snmp_envelope(spark, sf_dir):
    return bytes_of(spark, sf_dir, fx.SNMP).select("event_id", t.snmp_info(F.col("data")).alias("i")).select("event_id", "i.*")


SNMP_VERSIONS = fx.SNMP.replace("'0201', '01'", "'0201', lpad(hex(event_id % 4), 2, '0')")


@query(Q, "snmp_versions", "l:event_id version s:community", "result as (select event_id, event_id % 4 as version, event_type as community from events)")
def snmp_versions(spark, sf_dir):
    return bytes_of(spark, sf_dir, SNMP_VERSIONS).select("event_id", t.snmp_info(F.col("data")).alias("i")).select("event_id", "i.*")


# Histories and events

RING_BYTES = 100_000


@query(Q, "byte_ring_suffix", "l:seq payload_len", f"{P}, k as (select *, sum(payload_len + 16) over (order by seq desc) as held from p), result as (select * from k where held <= {RING_BYTES} or held = payload_len + 16)")
def byte_ring_suffix(spark, sf_dir):
    return c.ring(fx.packets(spark, sf_dir), RING_BYTES, length="payload_len")


@query(Q, "dlq_admission", "l:seq b:admitted", f"{P}, k as (select *, coalesce(sum(payload_len) over (order by seq rows between unbounded preceding and 1 preceding), 0) as before from p), result as (select seq, before < 0.8 * 500000 as admitted from k)")
def dlq_admission(spark, sf_dir):
    return c.dead_letters(fx.packets(spark, sf_dir), 500_000, F.col("payload_len"))


SPOOL = "k as (select *, 'event ' || seq as payload from p), w as (select *, length(payload) as bytes from k), x as (select *, sum(bytes) over (order by seq) as spool_bytes, row_number() over (order by seq) - 1 as no from w)"


@query(
    Q,
    "dlq_spool",
    "l:seq s:file_name payload l:bytes spool_bytes",
    f"""{P}, {SPOOL}, result as (select seq, strftime(make_timestamp(ts_us), '%Y%m%d%H%M%S') || '_' || lpad(lower(to_hex(no)), 16, '0') || '.ges' as file_name, payload, bytes, spool_bytes from x where spool_bytes - bytes < 0.8 * 20000)""",
)
def dlq_spool(spark, sf_dir):
    """Rejected events as the spool names and counts them, until it is shut."""
    p = fx.packets(spark, sf_dir)
    return c.spooled(p, 20_000, F.concat(F.lit("event "), F.col("seq").cast("string")), F.timestamp_micros("ts_us"))


_REQUEST = "concat('GET /api?id=', cast(page_id as string), '&lang=', substr(url, 9, 3), '&id=again&flag HTTP/1.1', chr(13), chr(10), 'Host: x', chr(13), chr(10))"


@query(Q, "request_params", "l:page_id s:path id lang flag", "result as (select page_id, '/api?id=' || page_id || '&lang=' || substr(url, 9, 3) || '&id=again&flag' as path, cast(page_id as varchar) as id, substr(url, 9, 3) as lang, null as flag from pages)")
def request_params(spark, sf_dir):
    m = F.col("m")
    return fx.of_pages(spark, sf_dir, _REQUEST, "m").select("page_id", e.request_path(m).alias("path"), *(e.query_param(m, k).alias(k) for k in ("id", "lang", "flag")))


TENANT = "tenant-1"
JSON = f"""'{{"@timestamp":"' || strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') || '","tenant.id":"{TENANT}","event.kind":"event","event.category":["network"],"network.protocol":"' || case proto when 17 then 'udp' else 'tcp' end || '","source.ip":"' || {V4.format('src_ip')}
 || '","source.port":' || src_port || ',"destination.ip":"' || {V4.format('dst_ip')} || '","destination.port":' || dst_port || ',"ge.trust_score":100.0,"ge.risk_score":0.0,"ge.raw":"","merkle_hash":"","ml_features":null}}'"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes_of(fx.packets(spark, sf_dir))


def envelopes_of(p: DataFrame) -> DataFrame:
    at = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return e.as_json(e.envelope(p, TENANT, at, F.lower(net.protocol_name(F.col("proto"))), net.ipv4_of_long(F.col("src_ip")), net.ipv4_of_long(F.col("dst_ip"))))


@query(Q, "event_envelope", "s:key value", f"{P}, result as (select {V4.format('src_ip')} as key, {JSON} as value from p)")
def event_envelope(spark, sf_dir):
    return envelopes(spark, sf_dir)


@query(
    Q,
    "event_parse",
    "s:sent_at tenant protocol source_ip l:source_port s:destination_ip l:destination_port d:trust",
    f"""{P}, result as (select strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.%fZ') as sent_at, '{TENANT}' as tenant, case proto when 17 then 'udp' else 'tcp' end as protocol, {V4.format('src_ip')} as source_ip, src_port as source_port,
 {V4.format('dst_ip')} as destination_ip, dst_port as destination_port, 100.0 as trust from p)""",
)
def event_parse(spark, sf_dir):
    """Events that were written as JSON, as columns again."""
    x = e.from_json(envelopes(spark, sf_dir))
    names = {"sent_at": "@timestamp", "tenant": "tenant.id", "protocol": "network.protocol", "source_ip": "source.ip", "source_port": "source.port", "destination_ip": "destination.ip", "destination_port": "destination.port", "trust": "ge.trust_score"}
    return x.select(*(F.col(f"`{v}`").alias(k) for k, v in names.items()))


@query(Q, "delivery_stats", "l:delivered errors bytes_sent", f"{P}, j as (select {JSON} as value from p), result as (select count(*) as delivered, 0 as errors, sum(strlen(value)) as bytes_sent from j)")
def delivery_stats(spark, sf_dir):
    return e.delivery_stats(envelopes(spark, sf_dir))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.packets(spark, sf_dir)
    live = fl.active(fl.flows(rows, IDLE), views.as_of(rows), IDLE).count()
    return views.metrics_text(d.packet_counts(seen(spark, sf_dir)), views.alert_counts(judged(spark, sf_dir)), "eth0", live)


_ALERTS = "ac as (select rule_severity as severity, count(*) as n from j where rule_id is not null group by all)"
_LINES = """ln as (select 'ge_packets_total{interface="eth0",protocol="' || protocol || '"} ' || n as line from pc union all select 'ge_alerts_total{severity="' || severity || '"} ' || n from ac
 union all select 'ge_active_flows ' || (select count(*) from live) union all select unnest(['ge_kafka_lag 0', 'ge_ram_usage_bytes 0', 'ge_dlq_size_bytes 0']))"""
_ALL = f"{FLOWS}, {LAST}, {LIVE}, {JUDGED[len(P) + 2:]}, {DISSECTED}, {COUNTS}, {_ALERTS}"


@query(Q, "metrics_text", "s:line", f"{_ALL}, {_LINES}, result as (select * from ln)")
def metrics_text(spark, sf_dir):
    return metrics(spark, sf_dir)


@query(Q, "prom_text_sum", "l:total", f"{DISSECTED}, {COUNTS}, result as (select sum(n) as total from pc)")
def prom_text_sum(spark, sf_dir):
    return e.prometheus_total(metrics(spark, sf_dir), e.PACKETS_METRIC)


@query(Q, "sensor_state", "l:packets_total active_flows inspected passed dropped alerted matched", f"{FLOWS}, {LAST}, {LIVE}, {JUDGED[len(P) + 2:]}, st as (select {STATS} from j), result as (select *, inspected as packets_total, (select count(*) from live) as active_flows from st)")
def sensor_state(spark, sf_dir):
    rows = fx.packets(spark, sf_dir)
    return views.sensor_state(judged(spark, sf_dir), fl.flows(rows, IDLE), views.as_of(rows), IDLE)


@query(
    Q,
    "input_union",
    "s:input l:n",
    "result as (select 'netflow' as input, sum(event_id % 3 + 1 - event_id % 2) as n from events union all select 'syslog', count(*) from events union all select 'snmp', count(*) from events)",
)
def input_union(spark, sf_dir):
    """All inputs as one table, counted by input."""
    parts = [netflow_v5(spark, sf_dir).withColumn("input", F.lit("netflow")), syslog_parse(spark, sf_dir).withColumn("input", F.lit("syslog")), snmp_envelope(spark, sf_dir).drop("varbinds").withColumn("input", F.lit("snmp"))]
    return e.union_of(*parts).groupBy("input").agg(F.count(F.lit(1)).alias("n"))
