"""Queries about flows: keys, sessions, aggregates, samples, features, scores, the table of live flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import net
from packetloom.functions.features import ANOMALOUS, CONSTANT, FEATURES
from packetloom.operators import eviction
from packetloom.operators import flows as fl
from packetloom.plans import fixtures, views
from packetloom.plans.queries import P, query

FLOW_QUERIES: list = []
HOUR = 3_600_000_000
#: The test events are sparse: their idle timeout is six hours.
IDLE = 6 * HOUR
MOST = 10

KEY = ", ".join(fl.KEY)
SESSION = ", ".join(fl.SESSION)
SESSION_COLUMNS = f"l:{' '.join(fl.SESSION)}"

KEYED = f"""{P}, k as (select *, least(src_ip, dst_ip) as a_ip, greatest(src_ip, dst_ip) as b_ip, case when src_ip <= dst_ip then src_port else dst_port end as a_port,
 case when src_ip <= dst_ip then dst_port else src_port end as b_port, src_ip <= dst_ip as forward, payload_len % 65536 as size from p)"""
SPLIT = f"""{KEYED}, g as (select *, ts_us - lag(ts_us) over (partition by {KEY} order by ts_us, seq) as gap from k),
s as (select *, sum(case when gap > {IDLE} then 1 else 0 end) over (partition by {KEY} order by ts_us, seq) as session, case when gap <= {IDLE} then gap end as iat_us from g),
r as (select *, row_number() over (partition by {SESSION} order by ts_us, seq) as rn from s)"""
FLOWS = f"""{SPLIT}, q as (select *, row_number() over (partition by {SESSION} order by ts_us, seq) as dn from s where dns_query is not null),
n as (select {SESSION}, string_agg(dns_query, '' order by dn) as joined, string_agg(dns_query, ',' order by dn) as dns_names from q where dn <= {fl.NAMES} group by all),
a as (select {SESSION}, min(ts_us) as first_us, max(ts_us) as last_us, count(*) filter (where forward) as fwd_packets, count(*) filter (where not forward) as rev_packets,
 coalesce(sum(size) filter (where forward), 0) as fwd_bytes, coalesce(sum(size) filter (where not forward), 0) as rev_bytes, bit_or(tcp_flags) as tcp_flags,
 count(iat_us) filter (where rn between 2 and {fl.SAMPLES + 1}) as n_iat, coalesce(avg(iat_us) filter (where rn between 2 and {fl.SAMPLES + 1}) / 1000.0, 0) as iat_mean,
 coalesce(stddev_pop(iat_us / 1000.0) filter (where rn between 2 and {fl.SAMPLES + 1}), 0) as iat_std, coalesce(var_pop(size) filter (where rn <= {fl.SAMPLES}), 0) as size_var from r group by all),
f as (select a.*, coalesce(joined, '') as joined, coalesce(dns_names, '') as dns_names, fwd_packets + rev_packets as packets, fwd_bytes + rev_bytes as bytes from a left join n using ({SESSION}))"""
ENTROPY = f"""ch as (select {SESSION}, unnest(string_split(joined, '')) as c from f where joined <> ''), cn as (select {SESSION}, c, count(*) as n from ch group by all),
en as (select {SESSION}, 0 - sum(n / t * log2(n / t)) as dns_entropy from (select *, sum(n) over (partition by {SESSION}) as t from cn) group by all)"""
FEATURED = f"""{FLOWS}, {ENTROPY}, v as (select f.*, packets / greatest((last_us - first_us) / 1e6, 0.001) as conn_rate, coalesce(dns_entropy, 0) as dns_entropy,
 case when n_iat >= 2 and iat_mean >= 0.001 then greatest(0, 1 - least(iat_std / iat_mean, 1)) else 0 end as beaconing_score,
 case when bytes > 0 then abs(fwd_bytes - rev_bytes) / bytes else 0 end as traffic_asymmetry, bytes / packets as bytes_ratio, size_var as packet_size_var,
 least((case when tcp_flags & 3 = 3 then 0.5 else 0 end) + (case when tcp_flags & 41 = 41 then 0.5 else 0 end) + (case when tcp_flags = 0 then 0.3 else 0 end), 1) as tcp_flag_anomaly,
 {', '.join(f'{x} as {k}' for k, x in CONSTANT.items())} from f left join en using ({SESSION})),
w as (select *, least(1, 0.25 * beaconing_score + 0.15 * least(dns_entropy, 5) / 5 + 0.15 * traffic_asymmetry + 0.25 * tcp_flag_anomaly + 0.10 * off_hours_pct + 0.10 * least(conn_rate, 1000) / 1000) as ml_score from v)"""
DETAILED = f"""{FEATURED}, d as (select *, concat_ws('.', (a_ip >> 24) & 255, (a_ip >> 16) & 255, (a_ip >> 8) & 255, a_ip & 255) as src_ip, concat_ws('.', (b_ip >> 24) & 255, (b_ip >> 16) & 255, (b_ip >> 8) & 255, b_ip & 255) as dst_ip,
 a_port as src_port, b_port as dst_port, case proto when 6 then 'TCP' when 17 then 'UDP' when 1 then 'ICMP' else 'OTHER' end as protocol, ((select max(ts_us) from p) - first_us) / 1e6 as duration_secs from w)"""
LAST = f"last as (select * from f qualify row_number() over (partition by {KEY} order by session desc) = 1)"
LIVE = f"live as (select * from last where (select max(ts_us) from p) - last_us <= {IDLE})"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.flows(fixtures.packets(spark, sf_dir), IDLE)


@query(FLOW_QUERIES, "flow_key_normalize", "l:seq a_ip b_ip a_port b_port proto b:forward", f"{KEYED}, result as (select * from k)")
def flow_key_normalize(spark, sf_dir):
    return fl.normalized(fixtures.packets(spark, sf_dir))


@query(FLOW_QUERIES, "flow_sessions", "l:seq session", f"{SPLIT}, result as (select * from s)")
@query(FLOW_QUERIES, "flow_iat", "l:seq iat_us", f"{SPLIT}, result as (select * from s)")
def flow_sessions(spark, sf_dir):
    return fl.sessions(fixtures.packets(spark, sf_dir), IDLE)


@query(FLOW_QUERIES, "flow_aggregate", f"{SESSION_COLUMNS} first_us last_us fwd_packets rev_packets fwd_bytes rev_bytes tcp_flags", f"{FLOWS}, result as (select * from f)")
def flow_aggregate(spark, sf_dir):
    return found(spark, sf_dir)


@query(FLOW_QUERIES, "flow_first_n_samples", f"{SESSION_COLUMNS} n_iat d:iat_mean iat_std size_var", f"{FLOWS}, result as (select * from f)")
def flow_first_n_samples(spark, sf_dir):
    return found(spark, sf_dir)


@query(FLOW_QUERIES, "flow_dns_names", f"{SESSION_COLUMNS} s:dns_names", f"{FLOWS}, result as (select * from f where dns_names <> '')")
def flow_dns_names(spark, sf_dir):
    return found(spark, sf_dir).filter(F.size("dns_queries") > 0).withColumn("dns_names", F.array_join("dns_queries", ","))


@query(FLOW_QUERIES, "flow_active", f"{SESSION_COLUMNS} last_us", f"{FLOWS}, {LAST}, {LIVE}, result as (select * from live)")
def flow_active(spark, sf_dir):
    return fl.active(found(spark, sf_dir), views.as_of(fixtures.packets(spark, sf_dir)), IDLE)


@query(FLOW_QUERIES, "flow_lru_snapshot", f"{SESSION_COLUMNS} last_us", f"{FLOWS}, {LAST}, {LIVE}, result as (select * from live order by last_us desc, {KEY} limit {MOST})")
def flow_lru_snapshot(spark, sf_dir):
    return fl.snapshot(found(spark, sf_dir), views.as_of(fixtures.packets(spark, sf_dir)), IDLE, MOST)


@query(
    FLOW_QUERIES,
    "flow_closed",
    f"{SESSION_COLUMNS} last_us s:close_reason",
    f"""{FLOWS}, {LAST}, {LIVE}, held as (select * from live order by last_us desc, {KEY} limit {MOST}), l as (select {SESSION}, 1 as is_live from live),
result as (select f.*, case when is_live is null then 'IdleTimeout' else 'CapacityEviction' end as close_reason from f left join l using ({SESSION}) anti join held using ({SESSION}))""",
)
def flow_closed(spark, sf_dir):
    return fl.closed(found(spark, sf_dir), views.as_of(fixtures.packets(spark, sf_dir)), IDLE, MOST)


#: Records of a table that is full for most of the time.
FEW = 12
SEEN = f"""{KEYED}, o as (select *, row_number() over (order by ts_us, seq) as pos from k),
x as (select *, lag(pos) over w as before, lead(pos) over w as later, lead(ts_us) over w as later_us from o window w as (partition by {KEY} order by pos)),
lt as (select ts_us as t, max(pos) as upto from o group by 1), u as (select x.*, case when later_us - ts_us <= {IDLE} then later else upto + 1 end as until from x asof join lt on lt.t <= x.ts_us + {IDLE}),
ev as (select u.pos, count(*) as n from u join x on x.pos > u.pos and x.pos < u.until and coalesce(x.before, 0) <= u.pos where u.until - u.pos > {FEW} group by 1),
y as (select u.*, coalesce(n, 0) >= {FEW} as lost, case when coalesce(n, 0) >= {FEW} then 'CapacityEviction' when coalesce(later_us, (select max(ts_us) from o)) - ts_us > {IDLE} then 'IdleTimeout' end as ends from u left join ev using (pos)),
z as (select *, coalesce(lag(lost or later_us - ts_us > {IDLE}) over (partition by {KEY} order by pos), false) as cut from y),
zs as (select *, sum(cast(cut as int)) over (partition by {KEY} order by pos) as session from z)"""


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with what a full table of FEW records loses. Small ranges, so that intervals span several."""
    return eviction.with_evictions(fixtures.packets(spark, sf_dir), IDLE, FEW, range_rows=40)


@query(FLOW_QUERIES, "flow_lru_cuts", "l:seq b:cut s:ends", f"{SEEN}, result as (select seq, lost_before as cut, ends from (select *, coalesce(lag(lost) over (partition by {KEY} order by pos), false) as lost_before from z))")
def flow_lru_cuts(spark, sf_dir):
    """Before which packets the flow's record had been lost to others, and why records end."""
    return exact(spark, sf_dir)


@query(
    FLOW_QUERIES,
    "flow_lru_exact",
    f"{SESSION_COLUMNS} first_us last_us fwd_packets rev_packets fwd_bytes rev_bytes d:iat_mean s:close_reason",
    f"""{SEEN}, rs as (select *, row_number() over (partition by {SESSION} order by pos) as rn, ts_us - lag(ts_us) over (partition by {SESSION} order by pos) as iat from zs),
result as (select {SESSION}, min(ts_us) as first_us, max(ts_us) as last_us, count(*) filter (where forward) as fwd_packets, count(*) filter (where not forward) as rev_packets, coalesce(sum(size) filter (where forward), 0) as fwd_bytes,
 coalesce(sum(size) filter (where not forward), 0) as rev_bytes, coalesce(avg(iat) filter (where rn between 2 and {fl.SAMPLES + 1}) / 1000.0, 0) as iat_mean, max(ends) as close_reason from rs group by all)""",
)
def flow_lru_exact(spark, sf_dir):
    """All records of a table that loses the least recently seen flow when it is full, with samples of their own and why each was closed."""
    return fl.flows(exact(spark, sf_dir), IDLE)


WANTED = (3232235777, 167772161, 53, 1024, 17)


@query(FLOW_QUERIES, "flow_lookup", f"{SESSION_COLUMNS} fwd_packets rev_packets last_us", f"{FLOWS}, result as (select * from f where a_ip = {WANTED[1]} and b_ip = {WANTED[0]} and a_port = {WANTED[3]} and b_port = {WANTED[2]} and proto = {WANTED[4]})")
def flow_lookup(spark, sf_dir):
    """The sessions of one flow, asked for by its reverse direction."""
    return fl.lookup(found(spark, sf_dir), *WANTED)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.with_features(found(spark, sf_dir))


for _name, _column in {
    "feat_conn_rate": "conn_rate", "feat_dns_entropy": "dns_entropy", "feat_beaconing": "beaconing_score", "feat_asymmetry": "traffic_asymmetry",
    "feat_iat_mean": "iat_mean", "feat_bytes_ratio": "bytes_ratio", "feat_size_var": "packet_size_var", "feat_flag_anomaly": "tcp_flag_anomaly", "ml_score": "ml_score",
}.items():
    query(FLOW_QUERIES, _name, f"{SESSION_COLUMNS} d:{_column}", f"{FEATURED}, result as (select * from w)")(featured)

query(FLOW_QUERIES, "feat_vector", f"{SESSION_COLUMNS} d:{' '.join(FEATURES)}", f"{FEATURED}, result as (select * from w)")(featured)

SHOWN = "s:src_ip dst_ip l:src_port dst_port s:protocol l:fwd_packets rev_packets fwd_bytes rev_bytes d:duration_secs bytes_ratio dns_entropy beaconing_score conn_rate off_hours_pct ml_score"


def detailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.flow_details(fixtures.packets(spark, sf_dir), IDLE)
    return rows.withColumns({"src_ip": net.ipv4_of_long(F.col("a_ip")), "dst_ip": net.ipv4_of_long(F.col("b_ip")), "src_port": F.col("a_port"), "dst_port": F.col("b_port")})


@query(FLOW_QUERIES, "flow_details", SHOWN, f"{DETAILED}, result as (select * from d)")
def flow_details(spark, sf_dir):
    return detailed(spark, sf_dir).orderBy(F.desc("ml_score"), *fl.SESSION)


@query(
    FLOW_QUERIES,
    "flow_summary",
    "l:total_flows tcp_flows udp_flows anomalous d:avg_duration",
    f"""{DETAILED}, result as (select count(*) as total_flows, count(*) filter (where proto = 6) as tcp_flows, count(*) filter (where proto = 17) as udp_flows,
 count(*) filter (where ml_score > 0.5) as anomalous, coalesce(avg(duration_secs), 0) as avg_duration from d)""",
)
def flow_summary(spark, sf_dir):
    return fl.summary(detailed(spark, sf_dir))


@query(FLOW_QUERIES, "anomalous_flows", SHOWN, f"{DETAILED}, result as (select * from d where ml_score > 0.5)")
def anomalous_flows(spark, sf_dir):
    return detailed(spark, sf_dir).filter(F.col("ml_score") > ANOMALOUS)


@query(FLOW_QUERIES, "oldest_flow", f"{SESSION_COLUMNS} last_us", f"{FLOWS}, result as (select * from f order by last_us, {SESSION} limit 1)")
def oldest_flow(spark, sf_dir):
    return fl.oldest(found(spark, sf_dir))


# Beyond the vector: what it leaves constant because it needs more than one flow.


@query(
    FLOW_QUERIES,
    "ext_host_profile",
    "l:src_ip unique_dst d:port_entropy protocol_entropy off_hours_pct",
    f"""{P}, hp as (select src_ip, dst_port, proto, count(*) as n from p group by all), t as (select src_ip, count(*) as t from p group by all),
pe as (select src_ip, 0 - sum(x / t * log2(x / t)) as port_entropy from (select src_ip, dst_port, sum(n) as x from hp group by all) join t using (src_ip) group by all),
qe as (select src_ip, 0 - sum(x / t * log2(x / t)) as protocol_entropy from (select src_ip, proto, sum(n) as x from hp group by all) join t using (src_ip) group by all),
b as (select src_ip, count(distinct dst_ip) as unique_dst, 100.0 * count(*) filter (where (ts_us // 3600000000) % 24 not between 8 and 17) / count(*) as off_hours_pct from p group by all),
result as (select * from b join pe using (src_ip) join qe using (src_ip))""",
)
def ext_host_profile(spark, sf_dir):
    """For each source: its destinations, the entropy of its ports and protocols, the share of packets outside 8 to 18 o'clock."""
    p = fixtures.packets(spark, sf_dir)
    hour = F.floor(F.col("ts_us") / HOUR) % 24
    base = p.groupBy("src_ip").agg(F.count_distinct("dst_ip").alias("unique_dst"), F.count(F.lit(1)).alias("t"), (100.0 * F.count_if(~hour.between(8, 17)) / F.count(F.lit(1))).alias("off_hours_pct"))
    for column, name in (("dst_port", "port_entropy"), ("proto", "protocol_entropy")):
        share = F.col("n") / F.col("t")
        counts = p.groupBy("src_ip", column).agg(F.count(F.lit(1)).alias("n"))
        parts = counts.join(base.select("src_ip", "t"), "src_ip").groupBy("src_ip").agg((0 - F.sum(share * F.log2(share))).alias(name))
        base = base.join(parts, "src_ip")
    return base
