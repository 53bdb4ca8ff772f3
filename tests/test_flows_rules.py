"""Flows, features, rules, captures, events, settings, files and streams."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from packetloom.functions.net import ipv4_of_long
from packetloom.operators import captures as c
from packetloom.operators import events as e
from packetloom.operators import flows as fl
from packetloom.operators import rules as r
from packetloom.operators.ordered import running_sum
from packetloom.sources import settings
from packetloom.sources.pcap import file_header, read_pcap, stream_pcap, write_pcap
from packetloom.streaming import flows as sf

COLUMNS = "seq long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, payload_len int, tcp_flags int, dns_query string"
A, B = 0xC0A80101, 0x0A000001


def packets(spark, rows):
    return spark.createDataFrame([(k, *row, *[None] * (9 - len(row))) for k, row in enumerate(rows)], COLUMNS)


def test_two_directions_are_one_flow(spark):
    f = fl.flows(packets(spark, [(0, A, B, 12345, 80, 6, 1500, 2), (1000, B, A, 80, 12345, 6, 1200, 0x12)])).collect()
    assert [(x.a_ip, x.fwd_packets, x.fwd_bytes, x.rev_packets, x.rev_bytes, x.tcp_flags) for x in f] == [(B, 1, 1200, 1, 1500, 0x12)]


def test_edges(spark):
    rows = [(0, A, A, 1, 2, 6, 70000, 0), (0, A, A, 2, 1, 6, 1, 0), (0, None, B, 1, 2, 6, 1, 0), (None, A, B, 1, 2, 6, 1, 0), (0, A, B, None, None, None, None, None)]
    f = {(x.a_port, x.b_port, x.proto): x.fwd_bytes for x in fl.flows(packets(spark, rows)).collect()}
    assert f == {(1, 2, 6): 70000 % 65536, (2, 1, 6): 1, (0, 0, 0): 0}
    assert fl.flows(packets(spark, [])).count() == 0
    assert fl.summary(fl.details(fl.flows(packets(spark, [])), 0)).first().total_flows == 0


def test_gap_of_exactly_the_timeout_stays(spark):
    t = fl.IDLE_US
    rows = [(x, A, B, 1, 2, 6, 1, 0) for x in (0, t, 2 * t + 1)]
    assert sorted(x.session for x in fl.sessions(packets(spark, rows)).collect()) == [0, 0, 1]


def test_slices_do_not_matter(spark):
    g = random.Random(3)
    rows = [(g.randrange(4000), g.choice((A, B)), g.choice((A, B)), 1, 2, 6, g.randrange(99), g.randrange(64), g.choice((None, "a", "b"))) for _ in range(700)]
    wide, narrow = (sorted(map(tuple, fl.flows(packets(spark, rows), 20, s).collect())) for s in (10**9, 7))
    assert len(wide) > 20 and [repr(x) for x in wide] == [repr(x) for x in narrow]


def test_features(spark):
    row = {"fwd_packets": 100, "rev_packets": 50, "fwd_bytes": 150000, "rev_bytes": 50000, "first_us": 0, "last_us": 10_000_000, "tcp_flags": 0x12, "n_iat": 20, "iat_mean": 10.0, "iat_std": 0.0, "size_var": 1.0, "dns_queries": ["example.com"]}
    f = fl.with_features(spark.createDataFrame([row])).first()
    assert (f.conn_rate, f.traffic_asymmetry, f.iat_mean, round(f.bytes_ratio, 2), f.tcp_flag_anomaly, f.beaconing_score) == (15.0, 0.5, 10.0, 1333.33, 0.0, 1.0)
    assert f.dns_entropy == pytest.approx(3.0958, abs=1e-4) and len(f.ml_features) == 14
    assert f.ml_score == pytest.approx(0.25 + 0.15 * 3.0958 / 5 + 0.075 + 0.0015, abs=1e-4)
    xmas = spark.createDataFrame([row | {"tcp_flags": 0x2B, "iat_mean": 100.0, "iat_std": 150.0}])
    assert (fl.with_features(xmas).first().tcp_flag_anomaly, fl.with_features(xmas).first().beaconing_score) == (1.0, 0.0)


def test_table_of_live_flows(spark):
    f = fl.flows(packets(spark, [(k * 1000, A + k, B, 1, 2, 6, 1, 0) for k in range(4)]))
    assert fl.snapshot(f, 3000, most=3).count() == 3
    assert {(x.b_ip, x.close_reason) for x in fl.closed(f, 3000, most=3).collect()} == {(A, "CapacityEviction")}
    assert fl.active(f, fl.IDLE_US + 1500).count() == 2 and fl.oldest(f).first().b_ip == A


@pytest.mark.parametrize(("port", "flags", "modbus", "dnp3", "rule", "inline", "tap"), [
    (9, 0x29, None, None, "GE-NET-002", "drop", "alert"), (80, 0x12, None, None, None, "pass", "pass"), (502, 0x18, 16, None, "GE-OT-001", "drop", "alert"),
    (20000, 0x18, None, 3, "GE-OT-002", "drop", "alert"), (0, 2, None, None, "GE-NET-001", "drop", "alert"), (9, 0, None, None, "GE-NET-003", "alert", "alert"),
])
def test_rules(spark, port, flags, modbus, dnp3, rule, inline, tap):
    p = packets(spark, [(0, A, B, 1, port, 6, 1, flags)]).withColumns({"modbus_fc": F.lit(modbus).cast("int"), "dnp3_fc": F.lit(dnp3).cast("int")})
    for on, wanted in ((True, inline), (False, tap)):
        compiled, joined = r.match_compiled(p, inline=on).first(), r.match_joined(p, r.table(spark, r.DEFAULT_RULES, "bigint"), inline=on).first()
        assert (compiled.rule_id, compiled.verdict) == (joined.rule_id, joined.verdict) == (rule, wanted)


def test_both_forms_agree(spark):
    g = random.Random(5)
    maybe = lambda *x: g.choice((None, None, *x))
    rules = [r.Rule(f"R{k}", "x", "low", g.choice(r.VERDICTS), g.random() < 0.9, maybe(A, B), maybe(A, B), maybe(1, 2), maybe(1, 2), maybe(6, 17), maybe(3, 1), maybe(0, 1), g.choice(((), (1, 2))), g.choice(((), (3,)))) for k in range(60)]
    rows = [(0, g.choice((A, B)), g.choice((A, B)), g.choice((1, 2)), g.choice((1, 2)), g.choice((6, 17)), 1, g.randrange(4)) for _ in range(300)]
    p = packets(spark, rows).withColumns({"modbus_fc": (F.col("seq") % 4).cast("int"), "dnp3_fc": F.when(F.col("seq") % 2 == 0, 3)})
    for some in (rules, [*rules[:5], r.Rule("ANY", "x", "low", "alert"), *rules[5:]], []):
        a, b = (sorted((x.seq, x.rule_id or "", x.verdict) for x in m.collect()) for m in (r.match_compiled(p, some), r.match_joined(p, r.table(spark, some, "bigint"))))
        assert a == b


def test_rule_requests():
    rule = r.Rule(" new ", " d ", " HIGH ", " Drop ", src_ip=" ")
    added = r.added(r.DEFAULT_RULES, rule)[-1]
    assert (added.id, added.severity, added.action, added.src_ip) == ("new", "high", "drop", None)
    for bad in (r.Rule("", "d", "x", "drop"), r.Rule("i", " ", "x", "drop"), r.Rule("i", "d", "x", "block"), r.Rule("i", "d", "x", "drop", src_ip="1.2.3"), r.DEFAULT_RULES[0]):
        with pytest.raises(ValueError):
            r.added(r.DEFAULT_RULES, bad)


def test_running_sum_in_ranges(spark):
    rows = [(g * 7 % 50, g, g % 5) for g in range(300)]
    df = spark.createDataFrame(rows, "o int, tie int, v int")
    for down in (False, True):
        found = sorted(tuple(x) for x in running_sum(df, "o", F.col("v"), "s", ["tie"], down, range_rows=40).collect())
        total, expected = 0, []
        for row in sorted(rows, reverse=down):
            total += row[2]
            expected.append((*row, total))
        assert found == sorted(expected)


def test_ring_and_dead_letters(spark):
    rows = spark.range(20).select(F.col("id").alias("seq"), F.lit(50).alias("length"))
    assert [x.seq for x in c.ring(rows, 500).orderBy("seq").collect()] == list(range(13, 20))
    assert [x.seq for x in c.ring(rows, 10).collect()] == [19]
    spool = spark.range(2).select(F.col("id").alias("seq"), F.lit(60).alias("n"))
    assert [x.admitted for x in c.dead_letters(spool, 100, F.col("n"), threshold=0.5).orderBy("seq").collect()] == [True, False]
    assert c.triggered("Always") and not c.triggered("off")


def test_envelope(spark):
    p = packets(spark, [(0, A, None, 12345, 80, 6, 1, 0)])
    row = e.as_json(e.envelope(p, "t", F.lit("2026-01-01T00:00:00Z"), F.lit("tcp"), ipv4_of_long(F.col("src_ip")), ipv4_of_long(F.col("dst_ip")))).first()
    found = json.loads(row.value)
    assert (row.key, found["source.ip"], found["destination.ip"], found["source.port"], found["ge.trust_score"], found["ge.risk_score"], found["ml_features"]) == ("192.168.1.1", "192.168.1.1", "", 12345, 100.0, 0.0, None)
    assert len(found) == 14
    lines = spark.createDataFrame([("m{a=\"b\"} 5",), ("m_more 3",), ("other 9",), ("m x",)], "line string")
    assert e.prometheus_total(lines, "m").first().total == 8


def test_settings():
    least = {"sensor": {"name": "s"}, "capture": {"interface": "eth0"}, "output": {"kafka": {"brokers": ["k:1"]}}}
    s = settings.checked(least)
    assert (s.capture.snap_len, s.pcap.ring_buffer_mb, s.dissectors.modbus, s.ips.mode, s.inputs.syslog) == (65535, 512, False, "tap", None)
    assert settings.checked(least | {"inputs": {"syslog": {"port": 1514}}}).inputs.syslog.port == 1514
    for bad in ({"sensor": {"name": ""}}, {"capture": {"interface": "eth0", "snap_len": 10}}, {"capture": {"interface": ""}}, {"output": {"kafka": {"brokers": []}}}, {"sensor": {}}):
        with pytest.raises(ValueError):
            settings.checked(least | bad)


def test_pcap_files(spark, tmp_path):
    rows = spark.createDataFrame([(k * 1_000_001, bytes([k]) * 100, 200 if k else None) for k in range(5)], "ts_us long, data binary, orig_len long").coalesce(1)
    path = f"file://{tmp_path}/p"
    write_pcap(rows, path)
    (file,) = (tmp_path / "p").glob("*.pcap")
    assert file.stat().st_size == 604 and file.read_bytes()[:4] == bytes.fromhex("D4C3B2A1")
    found = sorted((x.ts_us, x.cap_len, x.orig_len, bytes(x.data)) for x in read_pcap(spark, path).collect())
    assert found == [(k * 1_000_001, 100, 200 if k else 100, bytes([k]) * 100) for k in range(5)]
    (tmp_path / "p" / "cut.pcap").write_bytes(file_header() + bytes(10))
    (tmp_path / "p" / "no.pcap").write_bytes(b"x" * 50)
    assert read_pcap(spark, path).count() == 5
    query = stream_pcap(spark, path).writeStream.format("memory").queryName("frames").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("frames").count() == 5


def streamed(spark, tmp_path, made, name, rows):
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    schema = COLUMNS.replace("ts_us long", "ts timestamp")
    for k, part in enumerate(rows):
        stamped = [(i, start + datetime.timedelta(seconds=s), *x) for i, (s, *x) in enumerate(part)]
        spark.createDataFrame(stamped, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        query = made(stream).writeStream.format("memory" if k < 0 else "parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


PARTS = [[(0, A, B, 1, 2, 6, 10, 2, None), (60, B, A, 2, 1, 6, 20, 16, "q")], [(500, A, B, 1, 2, 6, 30, 1, None)], [(5000, A + 1, B, 1, 2, 6, 5, 1, None)], [(9000, A + 2, B, 1, 2, 6, 5, 1, None)]]


def test_streamed_sessions(spark, tmp_path):
    found = sorted((x.b_ip, x.fwd_packets, x.rev_packets, x.fwd_bytes, x.rev_bytes, x.tcp_flags) for x in streamed(spark, tmp_path, sf.session_flows, "s", PARTS))
    assert found[:2] == [(A, 0, 1, 0, 30, 1), (A, 1, 1, 20, 10, 18)]


def test_tracked_flows(spark, tmp_path):
    found = streamed(spark, tmp_path, lambda p: sf.tracked_flows(p, ipv4_of_long), "t", PARTS)
    first = min(found, key=lambda x: (x.b_ip, x.first_us))
    assert (first.b_ip, first.fwd_packets, first.rev_packets, first.iats, first.sizes, first.dns_queries, first.close_reason) == ("192.168.1.1", 1, 1, [60_000_000], [10, 20], ["q"], "IdleTimeout")
    assert [x.sizes for x in sorted(found, key=lambda x: (x.b_ip, x.first_us))][1] == [30]
