"""Queries about rules: matches, statistics, listings, alerts and the captures that they trigger."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.operators import captures as c
from packetloom.operators import rules as r
from packetloom.operators.ordered import running_sums
from packetloom.plans import fixtures, views
from packetloom.plans.queries import P, query
from packetloom.session import scratch
from packetloom.sources.pcap import read_pcap

RULE_QUERIES: list = []
IP = "bigint"

#: The default rules and some of our own: a disabled one, one by address that passes, one whose id is there already.
RULES = (
    *r.DEFAULT_RULES,
    replace(r.DEFAULT_RULES[0], id="OWN-OFF", enabled=False, dst_port=443, flags_mask=None, flags_value=None),
    r.Rule("OWN-PASS", "Quiet host", "info", "pass", src_ip=167772161, dst_port=53, protocol=17),
    r.Rule("GE-OT-002", "Same id again", "low", "alert", src_port=20000, flags_mask=0x18, flags_value=0x18),
)

HIT = """case when dst_port = 0 and tcp_flags & 2 = 2 then 0 when tcp_flags & 41 = 41 then 1 when proto = 6 and tcp_flags & 255 = 0 then 2
 when dst_port = 502 and modbus_fc in (5, 6, 15, 16) then 3 when dst_port = 20000 and dnp3_fc in (3, 4, 5, 6, 13, 14) then 4
 when src_ip = 167772161 and dst_port = 53 and proto = 17 then 6 when src_port = 20000 and tcp_flags & 24 = 24 then 7 end"""
R = """rr(ordinal, id, severity, action, enabled, summary) as (values (0, 'GE-NET-001', 'high', 'drop', true, 'dst_port=0, tcp_flags(0x02)=0x02'), (1, 'GE-NET-002', 'high', 'drop', true, 'tcp_flags(0x29)=0x29'),
 (2, 'GE-NET-003', 'medium', 'alert', true, 'proto=6, tcp_flags(0xff)=0x00'), (3, 'GE-OT-001', 'critical', 'drop', true, 'dst_port=502, modbus_fc=[5, 6, 15, 16]'),
 (4, 'GE-OT-002', 'critical', 'drop', true, 'dst_port=20000, dnp3_fc=[3, 4, 5, 6, 13, 14]'), (5, 'OWN-OFF', 'high', 'drop', false, 'dst_port=443'),
 (6, 'OWN-PASS', 'info', 'pass', true, 'src_ip=10.0.0.1, dst_port=53, proto=17'), (7, 'GE-OT-002', 'low', 'alert', true, 'src_port=20000, tcp_flags(0x18)=0x18'))"""
JUDGED = f"{P}, {R}, h as (select *, {HIT} as ordinal from p), j as (select h.*, rr.id as rule_id, rr.severity as rule_severity, coalesce(rr.action, 'pass') as verdict from h left join rr using (ordinal))"
V4 = "concat_ws('.', ({0} >> 24) & 255, ({0} >> 16) & 255, ({0} >> 8) & 255, {0} & 255)"
#: The bytes of the ring whose packets a capture holds.
RING = 20_000
RINGED = f"""{JUDGED}, sm as (select *, row_number() over (order by ts_us, seq) as pos, payload_len + 16 as sz, sum(payload_len + 16) over (order by ts_us, seq) as upto from j),
al as (select *, row_number() over (order by ts_us, seq) as no from sm where rule_id is not null), kept as (select * from al order by no desc limit 500),
rg as (select k.*, least(b.pos, k.pos) as first_pos from kept k asof join (select pos, upto - sz as held from sm) b on k.upto - {RING} <= b.held),
cr as (select rg.*, rg.pos - first_pos + 1 as ring_packets, rg.upto - (b.upto - b.sz) as ring_bytes, b.seq as first_seq from rg join sm b on b.pos = rg.first_pos)"""
CAPTURED = f"""{RINGED},
cap as (select no, 'ALT-' || lpad(cast(no as varchar), cast(greatest(4, length(cast(no as varchar))) as int), '0') as capture_id, 'alert' as trigger_type, {V4.format('src_ip')} || ':' || src_port || ' -> ' || {V4.format('dst_ip')} || ':' || dst_port || '/' || case proto when 17 then 'UDP' else 'TCP' end as five_tuple,
 ring_bytes + 24 as size_bytes, ring_packets, first_pos, first_seq, seq as last_seq, pos, ts_us // 1000000 as timestamp, rule_id, 'indexed' as status from cr)"""


def judged(spark: SparkSession, sf_dir: str, inline: bool = True) -> DataFrame:
    return r.match_compiled(fixtures.packets(spark, sf_dir), RULES, inline)


def table(spark: SparkSession) -> DataFrame:
    return r.table(spark, RULES, IP)


def ringed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All packets with their places, and the matched ones with what the ring held."""
    return c.rings(judged(spark, sf_dir), F.col("rule_id").isNotNull(), RING, length="payload_len")


def captures_of(held: DataFrame) -> DataFrame:
    rows = held.withColumns({"src": net.ipv4_of_long(F.col("src_ip")), "dst": net.ipv4_of_long(F.col("dst_ip")), "protocol": F.lower(net.protocol_name(F.col("proto")))})
    return c.capture_records(rows, size=F.col("ring_bytes") + c.FILE_HEADER)


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures_of(ringed(spark, sf_dir)[1])


MATCH = "l:seq rule_ordinal s:rule_id rule_severity verdict"
MATCHED = f"{JUDGED}, result as (select *, ordinal as rule_ordinal from j)"


@query(RULE_QUERIES, "rule_match_compiled", MATCH, MATCHED)
def rule_match_compiled(spark, sf_dir):
    return judged(spark, sf_dir)


@query(RULE_QUERIES, "rule_match_theta", MATCH, MATCHED)
def rule_match_theta(spark, sf_dir):
    return r.match_joined(fixtures.packets(spark, sf_dir), table(spark))


@query(RULE_QUERIES, "rule_tap_mode", "l:seq s:rule_id verdict", f"{JUDGED}, result as (select seq, rule_id, case verdict when 'drop' then 'alert' else verdict end as verdict from j)")
def rule_tap_mode(spark, sf_dir):
    return judged(spark, sf_dir, inline=False)


STATS = "count(*) as inspected, count(*) filter (where rule_id is null or verdict = 'pass') as passed, count(*) filter (where verdict = 'drop') as dropped, count(*) filter (where verdict = 'alert') as alerted, count(rule_id) as matched"


@query(RULE_QUERIES, "ips_stats", "l:inspected passed dropped alerted matched", f"{JUDGED}, result as (select {STATS} from j)")
def ips_stats(spark, sf_dir):
    return r.stats(judged(spark, sf_dir))


HITS = "hh as (select rule_id as id, count(*) as hits from j where rule_id is not null group by all)"


@query(RULE_QUERIES, "rule_hits", "l:ordinal s:id l:hits", f"{JUDGED}, {HITS}, result as (select ordinal, id, coalesce(hits, 0) as hits from rr left join hh using (id))")
def rule_hits(spark, sf_dir):
    return r.hits(judged(spark, sf_dir), table(spark))


@query(RULE_QUERIES, "rule_total_hits", "l:total_rule_hits", f"{JUDGED}, {HITS}, result as (select coalesce(sum(hits), 0) as total_rule_hits from rr left join hh using (id))")
def rule_total_hits(spark, sf_dir):
    return r.hits(judged(spark, sf_dir), table(spark)).agg(F.sum("hits").alias("total_rule_hits"))


# Rules out of events: each thirteenth is a request to add or delete one of a few ids, so that ids are repeated

LOGGED = "event_id % 13 = 5"
LOG = {
    "seq": "event_id",
    "op": "case when event_id % 3 = 0 then 'delete' else 'add' end",
    "id": "concat('R', cast(user_id % 12 as string))",
    "description": "concat('Rule of event ', cast(event_id as string))",
    "severity": "case event_id % 4 when 0 then 'low' when 1 then 'medium' when 2 then 'high' else 'critical' end",
    "action": "case event_id % 5 when 0 then 'pass' when 1 then 'alert' else 'drop' end",
    "enabled": "event_id % 11 <> 0",
    "src_ip": f"case when user_id % 4 = 2 then {fixtures.SRC} end",
    "dst_ip": "cast(null as bigint)",
    "src_port": "cast(null as int)",
    "dst_port": f"cast(case when user_id % 4 in (0, 3) then {fixtures.SERVICE} end as int)",
    "protocol": "case when user_id % 4 = 1 then 17 end",
    "flags_mask": "case when user_id % 4 = 3 then 41 end",
    "flags_value": "case when user_id % 4 = 3 then case when event_id % 2 = 0 then 8 else 0 end end",
    "modbus_codes": "case when user_id % 4 = 0 and user_id % 5 = 3 then cast(event_id % 17 as int) end",
}
LG = "lg as (select epoch_us(ts) as ts_us, " + ", ".join(f"{x} as {k}" for k, x in LOG.items()) + f" from events where {LOGGED})"
RQ = f"{LG}, rq as (select *, op <> coalesce(lag(op) over (partition by id order by ts_us, seq), 'delete') as accepted from lg)"
VS = f"""{RQ}, ad as (select *, ts_us as valid_from_us, lead(ts_us) over (partition by id order by ts_us, seq) as valid_to_us from rq where accepted),
vs as (select *, row_number() over (order by ts_us, seq) - 1 as ordinal from ad where op = 'add')"""
FITS = """(r.src_ip is null or r.src_ip = p.src_ip) and (r.dst_port is null or r.dst_port = p.dst_port) and (r.protocol is null or r.protocol = p.proto)
 and (r.flags_value is null or p.tcp_flags & r.flags_mask = r.flags_value) and (r.modbus_codes is null or r.modbus_codes = p.modbus_fc)"""
TJ = f"""{P}, {VS}, th as (select p.seq, min(r.ordinal) as ordinal from p join vs r on r.enabled and r.valid_from_us <= p.ts_us and (r.valid_to_us is null or p.ts_us < r.valid_to_us) and {FITS} group by p.seq),
tj as (select p.seq, th.ordinal as rule_ordinal, vs.id as rule_id, coalesce(vs.action, 'pass') as verdict from p left join th using (seq) left join vs on vs.ordinal = th.ordinal)"""
#: All that was ever asked to be added, ids repeated, as a list of rules.
LS = f"{LG}, ls as (select *, row_number() over (order by ts_us, seq) - 1 as ordinal from lg where op = 'add')"
STATES = """case when not enabled then 'disabled' when action = 'drop' then '{}' when action = 'alert' then 'alert_only' else 'pass' end"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.events(spark, sf_dir).filter(LOGGED)
    rows = rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), *(F.expr(fixtures.spark_sql(x)).alias(k) for k, x in LOG.items()))
    codes = F.when(F.col("modbus_codes").isNotNull(), F.array("modbus_codes")).otherwise(F.array().cast("array<int>"))
    return rows.withColumns({"modbus_fcs": codes, "dnp3_fcs": F.array().cast("array<int>")}).drop("modbus_codes")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of all requests to add one, in order, ids repeated."""
    rows = running_sums(log(spark, sf_dir).filter("op = 'add'"), [F.col("ts_us"), F.col("seq")], {"ordinal": F.lit(1)})
    return rows.withColumn("ordinal", (F.col("ordinal") - 1).cast("int")).drop("op", "ts_us", "seq")


@query(RULE_QUERIES, "rule_status", "l:ordinal s:id tap inline", f"{LS}, result as (select ordinal, id, {STATES.format('tap_only')} as tap, {STATES.format('blocking')} as inline from ls)")
def rule_status(spark, sf_dir):
    a, e = F.col("action"), F.col("enabled")
    return asked(spark, sf_dir).withColumns({"tap": r.status(a, e, False), "inline": r.status(a, e, True)})


_SRC = f"case when src_ip is not null then 'src_ip=' || {V4.format('src_ip')} end"


@query(
    RULE_QUERIES,
    "rule_summary",
    "l:ordinal s:id match_summary",
    f"""{LS}, result as (select ordinal, id, coalesce(nullif(concat_ws(', ', {_SRC}, 'dst_port=' || dst_port, 'proto=' || protocol, 'tcp_flags(0x' || lower(lpad(hex(flags_mask), 2, '0')) || ')=0x' || lower(lpad(hex(flags_value), 2, '0')),
 'modbus_fc=[' || modbus_codes || ']'), ''), 'any') as match_summary from ls)""",
)
def rule_summary(spark, sf_dir):
    return asked(spark, sf_dir).withColumn("match_summary", r.match_summary(net.ipv4_of_long))


@query(
    RULE_QUERIES,
    "ips_rules",
    "l:ordinal s:id action b:enabled l:hits s:match_summary status",
    f"""{JUDGED}, {HITS}, result as (select ordinal, id, action, enabled, coalesce(hits, 0) as hits, summary as match_summary,
 case when not enabled then 'disabled' when action = 'drop' then 'blocking' when action = 'alert' then 'alert_only' else 'pass' end as status from rr left join hh using (id))""",
)
def ips_rules(spark, sf_dir):
    return r.listing(judged(spark, sf_dir), table(spark), True, net.ipv4_of_long)


@query(
    RULE_QUERIES,
    "rule_delete",
    "l:seq rule_ordinal s:rule_id",
    f"""{P}, {LS}, dl as (select p.seq, min(r.ordinal) as ordinal from p join ls r on r.enabled and r.id <> 'R3' and {FITS} group by p.seq),
result as (select p.seq, dl.ordinal as rule_ordinal, ls.id as rule_id from p left join dl using (seq) left join ls on ls.ordinal = dl.ordinal)""",
)
def rule_delete(spark, sf_dir):
    """What packets match once all rules of an id are gone."""
    return r.match_joined(fixtures.packets(spark, sf_dir), r.without(asked(spark, sf_dir), "R3"))


@query(RULE_QUERIES, "rule_lookup", "l:ordinal s:id severity description", f"{LS}, result as (select * from ls where id = 'R5' order by ordinal limit 1)")
def rule_lookup(spark, sf_dir):
    return r.by_id(asked(spark, sf_dir), "R5")


@query(RULE_QUERIES, "rule_dedup", "l:ordinal s:id", f"{LS}, result as (select id, min(ordinal) as ordinal from ls group by all)")
def rule_dedup(spark, sf_dir):
    return r.distinct_ids(asked(spark, sf_dir))


_ANSWER = "case when not accepted then 'rule ' || chr(39) || id || chr(39) || case op when 'add' then ' already exists' else ' not found' end end"


@query(RULE_QUERIES, "rule_requests", "l:seq s:op id b:accepted s:answer", f"{RQ}, result as (select *, {_ANSWER} as answer from rq)")
def rule_requests(spark, sf_dir):
    """What each request to add or delete a rule is answered."""
    return r.requests(log(spark, sf_dir))


@query(RULE_QUERIES, "rule_versions", "l:ordinal s:id action b:enabled l:valid_from_us valid_to_us", f"{VS}, result as (select * from vs)")
def rule_versions(spark, sf_dir):
    return r.versions(log(spark, sf_dir))


@query(RULE_QUERIES, "rule_match_versions", "l:seq rule_ordinal s:rule_id verdict", f"{TJ}, result as (select * from tj)")
def rule_match_versions(spark, sf_dir):
    """Each packet judged by the rules that hold at its time."""
    return r.match_joined(fixtures.packets(spark, sf_dir), r.versions(log(spark, sf_dir)))


@query(
    RULE_QUERIES,
    "rule_version_hits",
    "l:ordinal s:id l:hits",
    f"{TJ}, result as (select vs.ordinal, vs.id, count(tj.seq) as hits from vs left join tj on tj.rule_ordinal = vs.ordinal where vs.valid_to_us is null or vs.valid_to_us > (select max(ts_us) from p) group by all)",
)
def rule_version_hits(spark, sf_dir):
    """Hits of the rules that hold at the end: those of deleted ones are gone, those added again count anew."""
    found, packets = r.versions(log(spark, sf_dir)), fixtures.packets(spark, sf_dir)
    return r.version_hits(packets, found, views.as_of(packets))


@query(RULE_QUERIES, "ips_events_last300", "l:seq ts_us s:rule_id rule_severity verdict", f"{JUDGED}, result as (select * from j where rule_id is not null order by ts_us desc, seq desc limit {c.MOST_EVENTS})")
def ips_events_last300(spark, sf_dir):
    return views.ips_events(judged(spark, sf_dir))


@query(RULE_QUERIES, "alert_counts", "s:severity l:n", f"{JUDGED}, result as (select rule_severity as severity, count(*) as n from j where rule_id is not null group by all)")
def alert_counts(spark, sf_dir):
    return views.alert_counts(judged(spark, sf_dir))


@query(RULE_QUERIES, "capture_records", "l:no s:capture_id trigger_type five_tuple l:size_bytes timestamp s:rule_id status", f"{CAPTURED}, result as (select * from cap)")
def capture_records(spark, sf_dir):
    return captured(spark, sf_dir)


@query(RULE_QUERIES, "capture_rings", "l:no s:capture_id l:ring_packets size_bytes first_seq last_seq", f"{CAPTURED}, result as (select * from cap)")
def capture_rings(spark, sf_dir):
    """For each capture how many packets the ring held at its alert, and which were the first and the last."""
    packets, held = ringed(spark, sf_dir)
    found = captures_of(held)
    ends = packets.select("at", "seq")
    found = found.join(ends.select("at", F.col("seq").alias("last_seq")), "at")
    return found.join(ends.select(F.col("at").alias("ring_first"), F.col("seq").alias("first_seq")), "ring_first")


@query(
    RULE_QUERIES,
    "capture_files",
    "l:ts_us orig_len n",
    f"{CAPTURED}, result as (select sm.ts_us, sm.payload_len as orig_len, count(*) as n from cap join sm on sm.pos between first_pos and cap.pos group by sm.seq, sm.ts_us, sm.payload_len)",
)
def capture_files(spark, sf_dir):
    """The packets of all captures' files, read back, with how many files hold each."""
    packets, held = ringed(spark, sf_dir)
    found = captures_of(held)
    path = scratch(spark, "rings")
    data = F.unhex(F.concat(F.lpad(F.hex("seq"), 16, "0"), F.repeat(F.lit("00"), F.col("payload_len"))))
    c.write_rings(packets.withColumns({"data": data, "orig_len": F.col("payload_len")}), found, path, F.col("file_name"))
    return read_pcap(spark, path).groupBy("ts_us", "orig_len", F.substring("data", 1, 8).alias("of")).agg(F.count(F.lit(1)).alias("n"))


@query(RULE_QUERIES, "capture_filter", "s:capture_id five_tuple rule_id", f"{CAPTURED}, result as (select * from cap where contains(lower(concat_ws('|', capture_id, five_tuple, rule_id, trigger_type)), 'ot-00'))")
def capture_filter(spark, sf_dir):
    return c.capture_filter(captured(spark, sf_dir), "oT-00")


@query(
    RULE_QUERIES,
    "capture_storage",
    "l:stored_captures total_size_bytes today_captures alert_triggered manual_captures d:ring_buffer_used_pct",
    f"""{CAPTURED}, result as (select count(*) as stored_captures, coalesce(sum(size_bytes), 0) as total_size_bytes, count(*) filter (where (select max(ts_us) // 1000000 from p) - timestamp <= 86400) as today_captures,
 count(*) filter (where trigger_type = 'alert') as alert_triggered, count(*) filter (where trigger_type = 'manual') as manual_captures, 1e6 / (512 * 1024 * 1024) * 100 as ring_buffer_used_pct from cap)""",
)
def capture_storage(spark, sf_dir):
    return c.capture_storage(captured(spark, sf_dir), views.as_of(fixtures.packets(spark, sf_dir)) // 1_000_000, 1_000_000)


ASKED = ("ALT-0700", "ALT-9999", "ALT-0650", "ALT-0700", "ALT-0001")


@query(
    RULE_QUERIES,
    "capture_bulk",
    "l:selected total_size_bytes s:files",
    f"""{CAPTURED}, ids as (select unnest([{", ".join(f"'{x}'" for x in ASKED)}]) as capture_id, unnest(range({len(ASKED)})) as pos),
result as (select count(*) as selected, coalesce(sum(size_bytes), 0) as total_size_bytes, coalesce(string_agg(capture_id || '.pcap', ',' order by ids.pos), '') as files from ids join cap using (capture_id))""",
)
def capture_bulk(spark, sf_dir):
    return c.capture_bulk(captured(spark, sf_dir), ASKED)


@query(RULE_QUERIES, "capture_reconstruct", "s:capture_id summary l:estimated_packets", f"{CAPTURED}, result as (select capture_id, 'Reconstructed session for ' || five_tuple || ' (' || trigger_type || ')' as summary, size_bytes // 128 as estimated_packets from cap)")
def capture_reconstruct(spark, sf_dir):
    return c.capture_reconstruct(captured(spark, sf_dir))
