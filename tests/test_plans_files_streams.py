"""The shapes of plans; files that are damaged or larger than a range; datagrams, dynamic rules and tracked flows as streams; the shared folder."""

import socket
import struct
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom import registry, session
from packetloom.operators import captures as c
from packetloom.operators import events as e
from packetloom.operators import flows as fl
from packetloom.operators import rules as r
from packetloom.operators.ordered import running_sum
from packetloom.sources import datagrams
from packetloom.sources.pcap import capture_stats, file_header, read_pcap, record, stream_pcap
from packetloom.streaming import flows as sf

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flow_details_is_one_pass(spark):
    text = plan(registry.QUERIES["flow_details"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange ") <= 4


def test_frames_are_dissected_once(spark):
    for name in ("frame_verdicts", "packet_info", "dissect_tcp"):
        assert plan(registry.QUERIES[name](spark, SF)).count("ArrowEvalPython") == 1, name


def test_rules_meet_packets_in_one_scan(spark):
    text = plan(registry.QUERIES["rule_match_theta"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("SortMergeJoin") == 0


def test_large_rule_tables_are_joined_without_broadcast(spark, monkeypatch):
    packets = spark.range(200).select(F.col("id").alias("seq"), (F.col("id") % 5).alias("src_ip"), (F.col("id") % 7).alias("dst_ip"), *(F.lit(1).alias(x) for x in ("src_port", "dst_port", "proto")), (F.col("id") % 64).cast("int").alias("tcp_flags"))
    some = [r.Rule(f"r{k}", "d", "low", "drop", src_ip=k % 6, dst_ip=k % 8) for k in range(30)] + [r.Rule("all", "d", "low", "alert")]
    rows = lambda: sorted((x.seq, x.rule_id, x.verdict) for x in r.match_joined(packets, r.table(spark, some, "bigint")).collect())
    found = rows()
    monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
    assert rows() == found == sorted((x.seq, x.rule_id, x.verdict) for x in r.match_compiled(packets, some).collect())


def test_flows_do_not_depend_on_slices(spark):
    rows = [(k, (k * k * 37) % 5000 * 1_000_000, k % 3, 9, 1, 2, 6, k % 50, k % 32, f"n{k}" if k % 5 == 0 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "seq long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, payload_len int, tcp_flags int, dns_query string")
    found = [sorted(tuple(x) for x in fl.flows(df, 20_000_000, s).select(*fl.SESSION, "first_us", "last_us", "fwd_packets", "rev_bytes", "n_iat", F.round("iat_mean", 6), F.round("iat_std", 6), F.round("size_var", 6), "dns_queries").collect()) for s in (None, 7_000_000, 1 << 50)]
    assert found[0] == found[1] == found[2] and sum(x[7] for x in found[0]) > 100


def test_running_sum_of_nulls_and_equal_orders(spark):
    df = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("o"), (F.col("id") % 4).alias("v"))
    for down in (False, True):
        rows = running_sum(df, "o", F.col("v"), "s", descending=down, range_rows=50).collect()
        order = sorted(rows, key=lambda x: (x.o is not None, x.o or 0), reverse=down)
        for key in {x.o for x in rows}:
            before = sum(x.v for x in order[: [x.o for x in order].index(key)])
            own = sorted((x.s, x.v) for x in rows if x.o == key)
            assert own[-1][0] == before + sum(v for _, v in own) and own[0][0] >= before
    assert running_sum(df.limit(0), "o", F.col("v"), "s").count() == 0


def test_pcap_ranges_and_damage(spark, tmp_path):
    whole = [record(1_700_000_000_000_000 + k * 1000, bytes([k % 251]) * (40 + k % 90)) for k in range(3000)]
    (tmp_path / "a.pcap").write_bytes(file_header() + b"".join(whole))
    path = f"file://{tmp_path}"
    for size in ("1000", "7777", "100000000"):
        found = sorted(x.ts_us for x in read_pcap(spark, path, rangeBytes=size).select("ts_us").collect())
        assert found == [1_700_000_000_000_000 + k * 1000 for k in range(3000)], size
    whole[1500] = struct.pack("<IIII", 1_700_000_001, 5, 0xFFFFFFF0, 9) + b"garbage"
    (tmp_path / "a.pcap").write_bytes(file_header() + b"".join(whole))
    for size in ("5000", "100000000"):
        stats = capture_stats(read_pcap(spark, path, rangeBytes=size)).first()
        assert (stats.received, stats.dropped, stats.dropped_bytes, stats.truncated) == (2999, 1, 23, 0), size
    query = stream_pcap(spark, path, range_bytes=5000).writeStream.format("memory").queryName("ranges").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("ranges").filter("error is null").count() == 2999


class Handle:
    """What the tracker needs of a state handle."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):
        return self

    exists = lambda self: self.value is not None
    get = lambda self: self.value
    listTimers = lambda self: list(self.timers)
    deleteTimer = lambda self, t: self.timers.remove(t)
    registerTimer = lambda self, t: self.timers.append(t)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_tracker_takes_chunks_in_order_of_time():
    part = lambda rows: pd.DataFrame(rows, columns=["ts_us", "seq", "forward", "size", "tcp_flags", "dns_query"])
    tracker = sf.FlowTracker(100)
    tracker.init(Handle())
    (out,) = tracker.handleInputRows((*"abcde",), iter([part([(50, 3, True, 7, 1, None), (20, 2, False, 5, 2, "b")]), part([(0, 1, True, 1, 4, "a"), (400, 4, True, 9, 8, None)])]), None)
    assert len(out) == 1 and tuple(out.iloc[0])[5:] == (0, 50, 2, 1, 8, 5, 7, [20, 30], [1, 5, 7], ["a", "b"], "IdleTimeout")
    assert tracker.handle.value[:3] == (400, 400, 1)
    (out,) = tracker.handleInputRows((*"abcde",), iter([part([(450, 5, False, 2, 16, None)])]), None)
    assert len(out) == 0 and tracker.handle.value == (400, 450, 1, 1, 9, 2, 24, [50], [9, 2], [])
    (out,) = tracker.handleInputRows((*"abcde",), iter([part([(900, 6, False, 2, 16, None)])]), None)
    assert len(out) == 1 and tracker.handle.value[:2] == (900, 900) and len(tracker.handle.timers) == 1


def test_datagrams_arrive(spark):
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    rows = datagrams.syslog_events(datagrams.datagrams(spark, "syslog", "127.0.0.1", port))
    query = rows.writeStream.format("memory").queryName("syslog_in").start()
    try:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
            for _ in range(120):
                out.sendto(b"<13>1 t host app - - - hello", ("127.0.0.1", port))
                time.sleep(0.5)
                if spark.table("syslog_in").count():
                    break
        assert {(x.priority, x.message) for x in spark.table("syslog_in").select("priority", "message").collect()} == {(13, "app - - - hello")}
    finally:
        query.stop()


@pytest.mark.parametrize(("kind", "made"), [("netflow", datagrams.netflow_events), ("snmp", datagrams.snmp_events)])
def test_other_datagrams_as_tables(spark, kind, made):
    head = struct.pack(">HHIIIIBBH", 5, 1, 0, 0, 0, 0, 0, 0, 0)
    data = {"netflow": head + bytes(48), "snmp": bytes.fromhex("300B0201010406") + b"public"}[kind]
    df = spark.createDataFrame([(bytearray(data), "1.2.3.4:5", 0), (bytearray(b"x"), "1.2.3.4:5", 0)], datagrams.SCHEMA)
    assert made(df).count() == 1


def test_rules_may_change_between_batches(spark, tmp_path):
    rules, seen = [r.table(spark, [r.Rule("one", "d", "low", "drop", dst_port=80)], "bigint"), r.table(spark, [r.Rule("two", "d", "low", "alert", dst_port=80)], "bigint")], []
    schema = "seq long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, tcp_flags int"
    for k in range(2):
        spark.createDataFrame([(k, 1, 2, 3, 80, 6, 0), (k + 10, 1, 2, 3, 81, 6, 0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        writer = sf.alerts_by_table(stream, lambda k=k: rules[k], lambda df, n: seen.extend((x.seq, x.rule_id, x.verdict) for x in df.collect()))
        writer.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(0, "one", "drop"), (1, "two", "alert")]


def test_spool(spark, tmp_path):
    df = spark.range(10).select(F.col("id").alias("seq"), F.lit("x" * 60).alias("event"))
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    taken = c.spooled(df, 400, F.col("event"), at, threshold=0.5)
    assert [(x.file_name, x.bytes, x.spool_bytes) for x in taken.orderBy("seq").collect()] == [(f"20231114221320_{k:016x}.ges", 60, 60 * (k + 1)) for k in range(4)]
    c.write_spool(taken, f"{tmp_path}/spool")
    size, number = c.spool_state(spark, f"{tmp_path}/spool")
    assert (size, number) == (240, 4) and c.spooled(df, 400, F.col("event"), at, threshold=0.5, already=size, first_no=number).count() == 0


def test_requests(spark):
    asked = {"GET /a?x=1&y=2&x=3 HTTP/1.1\r\nHost: h": ("/a?x=1&y=2&x=3", "1"), "GET /a?xx=1&x= HTTP/1.1": ("/a?xx=1&x=", ""), "GET /a?x HTTP/1.1": ("/a?x", None), "GET": (None, None), "": (None, None), "A\nB /c?x=1": (None, None), "GET /a?b=1?x=2": ("/a?b=1?x=2", None)}
    df = spark.createDataFrame([(k,) for k in asked], "m string")
    assert {x.m: (x.p, x.v) for x in df.select("m", e.request_path(F.col("m")).alias("p"), e.query_param(F.col("m"), "x").alias("v")).collect()} == asked


def test_shared_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
    Session.conf.get = staticmethod(lambda name, default=None: "file:///shared/")
    assert session.shared_dir(Session()) == "file:///shared" and session.scratch(Session(), "x").startswith("file:///shared/packetloom/app/x-")
    kept = session.written(spark.range(3), "kept")
    assert kept.count() == 3


def test_lookup_by_either_direction(spark):
    rows = [(0, 0, 5, 3, 10, 20, 6, 1, 0, None), (1, 5, 3, 5, 20, 10, 6, 1, 0, None), (2, 5, 3, 6, 20, 10, 6, 1, 0, None)]
    found = fl.flows(spark.createDataFrame(rows, "seq long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, payload_len int, tcp_flags int, dns_query string"))
    for ends in ((5, 3, 10, 20), (3, 5, 20, 10)):
        assert [(x.a_ip, x.fwd_packets, x.rev_packets) for x in fl.lookup(found, *ends, 6).collect()] == [(3, 1, 1)]
