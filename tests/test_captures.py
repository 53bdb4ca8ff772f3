"""Capture files: ranges against a parser from the beginning, whatever packets hold, damage too; files that grow; rings of alerts."""

import io
import random
import struct

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.operators import captures
from packetloom.sources import pcap
from packetloom.sources.datagrams import packets_from
from packetloom.sources.pcap import Capture, capture_stats, file_header, read_pcap, record, stream_pcap, write_pcap
from packetloom.streaming import flows as sf

SECS = 1_700_000_000


def at(k, step=1):
    return (SECS + k * step) * 1_000_000


def made(kind, n=1500):
    rng = random.Random(kind)
    fill = lambda k: bytes([k % 251]) * (40 + k % 90)
    inner = file_header() + b"".join(record(at(k), bytes(rng.randrange(200))) for k in range(300))
    return {
        "null time first": lambda: [record(at(k) if k else None, fill(k)) for k in range(n)],
        "null times": lambda: [record(None, fill(k)) for k in range(n)],
        "empty": lambda: [record(at(k), fill(k) if k % 5 else b"") for k in range(n)],
        "null and empty": lambda: [record(at(k), fill(k)) if k % 5 else record(None, None) for k in range(n)],
        "length under size": lambda: [record(at(k), fill(k), None if k % 6 else 3) for k in range(n)],
        "700 days": lambda: [record(at(k, 40_000), fill(k)) for k in range(n)],
        "zeros": lambda: [record(at(k), bytes(rng.randrange(900))) for k in range(n // 5)],
        "capture in a capture": lambda: [record(at(k), inner[k * 400 : k * 400 + 400] or b"x") for k in range(100)],
        "random bytes": lambda: [record(at(k), rng.randbytes(rng.randrange(200))) for k in range(n)],
        "large records": lambda: [record(at(k), rng.randbytes(30_000 if k % 50 == 7 else 60)) for k in range(n // 5)],
    }[kind](), rng


KINDS = ["null time first", "null times", "empty", "null and empty", "length under size", "700 days", "zeros", "capture in a capture", "random bytes", "large records"]


def in_ranges(data, step, part):
    """What ranges of so many bytes return, whose maps are of `part` bytes."""
    rows, out = [], []
    for begin in range(0, len(data), step):
        end = min(len(data), begin + step)
        for k in range(begin, end, part):
            x = Capture(io.BytesIO(data), len(data)).exits(k, min(end, k + part))
            rows.append({"path": "a", "size": len(data), "begin": begin, "end": end, "part": k, "next": min(k + part, end), "runs": x.runs, "run_exits": x.run_exits, "own": x.own, "own_exits": x.own_exits})
    kinds = pcap.MAPPED.append(pa.field("next", pa.int64()))
    for b in pcap.started(iter([pa.RecordBatch.from_pylist(rows[:7], kinds), pa.RecordBatch.from_pylist(rows[7:], kinds)])):
        for r in b.to_pylist():
            out += Capture(io.BytesIO(data), len(data)).records(r["start"], r["begin"], r["end"])
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_ranges_are_as_from_the_beginning(kind):
    rows, rng = made(kind)
    for damage in (0, 1, 5):
        data = bytearray(file_header() + b"".join(rows))
        for _ in range(damage):
            k = rng.randrange(24, len(data) - 200)
            data[k : k + rng.choice([4, 16, 100])] = rng.choice([rng.randbytes(16), b"\xff" * 16, bytes(40)])
        data = bytes(data[: len(data) - (rng.randrange(60) if damage == 5 else 0)])
        whole = list(Capture(io.BytesIO(data), len(data)).records(24, 24, len(data)))
        if not damage:
            assert len(whole) == len(rows) and not any(r[4] for r in whole)
        assert sum(r[2] + (16 if r[4] is None else 0) for r in whole) > len(data) - 24 - 16  # nothing is passed over without a word but a cut header
        for step, part in ((1000, 1000), (7777, 1000), (1 << 26, 4096), (50_000, 1 << 23)):
            assert in_ranges(data, step, part) == whole, (damage, step, part)


@pytest.mark.parametrize("order", "<>")
def test_big_endian_nanoseconds(order):
    head = struct.pack(order + "IHHiIII", pcap.MAGIC_NS, 2, 4, 0, 0, 65535, 1)
    data = head + b"".join(struct.pack(order + "IIII", SECS + k, 999_999_000, 20, 20) + bytes([k]) * 20 for k in range(200))
    found = in_ranges(data, 500, 100)
    assert found == list(Capture(io.BytesIO(data), len(data)).records(24, 24, len(data))) and [r[0] for r in found] == [at(k) + 999_999 for k in range(200)]


def test_maps_of_short_ranges_read_little():
    """Headers far beyond a range are looked up together: a range of a large file costs no read of a block for each."""

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            found = super().read(n)
            Counted.taken += len(found)
            return found

    rng = random.Random(9)
    data = file_header() + b"".join(record(at(k), b"".join(rng.randrange(1 << 22).to_bytes(4, "little") for _ in range(20))) for k in range(100_000))
    capture = Capture(Counted(data), len(data))
    alone = capture.exits(1_000_000, 1_050_000)
    assert Counted.taken < 10 * len(data) and len(alone.own) > 100
    shared = capture.exits(1_000_000, 1_050_000, capture.run_lengths(900_000, 1_200_000)[100_000:150_000])
    assert all(getattr(alone, c).tolist() == getattr(shared, c).tolist() for c in ("runs", "run_exits", "own", "own_exits"))
    lengths = capture.run_lengths(1_000_000, 1_001_000)
    assert lengths.tolist() == [capture.run(1_000_000 + k) for k in range(1000)] and lengths.max() == pcap.RUN


def test_ranges_in_spark(spark, tmp_path):
    """A null time, null data and a length of 0 come back as they were stored, from ranges smaller than a file and larger."""
    rows = [(None if k % 7 == 0 else at(k), None if k % 5 == 0 else bytes([k % 251]) * (k % 90), None if k % 3 else k % 2) for k in range(2000)]
    path = f"file://{tmp_path}/p"
    write_pcap(spark.createDataFrame(rows, "ts_us long, data binary, orig_len long").coalesce(2), path)
    (tmp_path / "p" / "no.pcap").write_bytes(b"x" * 5000)
    want = sorted((t or 0, d or b"", len(d or b"") if n is None else n) for t, d, n in rows)
    for size in (1000, 30_000, 1 << 26):
        frames = read_pcap(spark, path, rangeBytes=size, map_bytes=700)
        assert sorted((x.ts_us, bytes(x.data), x.orig_len) for x in frames.collect()) == want, size
        stats = capture_stats(frames).first()
        assert (stats.received, stats.dropped) == (2000, 0)


def test_files_that_grow(spark, tmp_path):
    """Each record once, though files are cut within a record between triggers, and the query is started anew each time."""
    (tmp_path / "in").mkdir()
    whole = {name: file_header() + b"".join(record(at(k), name.encode() + bytes(k % 70)) for k in range(400)) for name in ("a", "b")}
    whole["b"] = whole["b"][:9000] + b"\xff" * 40 + whole["b"][9040:]
    rng, seen = random.Random(5), 0
    for share in (0.0, 0.2, 0.203, 0.7, 1.0):
        for name, data in whole.items():
            to = len(data) if share == 1 else int(len(data) * share) + (rng.randrange(40) if share else 10)
            with open(tmp_path / "in" / f"{name}.pcap", "wb") as f:
                f.write(data[:to])
        stream = stream_pcap(spark, f"file://{tmp_path}/in", range_bytes=3000)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/out").count()
        assert rows >= seen
        seen = rows
    want = [r for data in whole.values() for r in Capture(io.BytesIO(data), len(data)).records(24, 24, len(data))]
    found = [(x.ts_us, x.orig_len, x.cap_len, None if x.data is None else bytes(x.data), x.error) for x in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr) and 790 < len(want) < 802


def test_a_stream_takes_so_many_bytes_a_trigger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(file_header() + b"".join(record(at(k), bytes(84)) for k in range(500)))
    reader = pcap.PcapStreamReader({"path": f"file://{tmp_path}/in", "bytesPerTrigger": "10000", "rangeBytes": "2500"})
    offset, places = reader.initialOffset(), []
    for _ in range(6):
        to = reader.latestOffset()
        parts = reader.partitions(offset, to)
        assert [(p.begin, p.end) for p in parts] == [(p.begin, p.end) for p in pcap.PcapStreamReader({"path": f"file://{tmp_path}/in", "rangeBytes": "2500"}).partitions(offset, to)]
        places += [(p.begin, p.end) for p in parts]
        reader.commit(to)
        offset = to
    assert places[0][0] == 24 and places[-1][1] == 50_024 and all(a[1] == b[0] for a, b in zip(places, places[1:])) and len(places) == 20


@pytest.mark.parametrize("most", [30, 200, 3000])
def test_rings_as_kept_packet_by_packet(spark, tmp_path, most):
    """Null sizes, packets larger than the ring, ties in time, and the files of all captures."""
    rng = random.Random(most)
    rows = [(k, rng.randrange(300), None if k % 13 == 0 else rng.choice([0, 1, 20, 60, 400]), rng.random() < 0.2) for k in range(500)]
    df = spark.createDataFrame(rows, "seq long, ts_us long, length int, hit boolean").repartition(4)
    packets, held = captures.rings(df, F.col("hit"), most)
    ring, want = [], {}
    for seq, ts, n, hit in sorted(rows, key=lambda r: (r[1], r[0])):
        size = (n or 0) + 16
        while ring and sum(x[1] for x in ring) + size > most:
            ring.pop(0)
        ring.append((seq, size, ts))
        if hit:
            want[seq] = (len(ring), sum(x[1] for x in ring), [x[0] for x in ring])
    assert {x.seq: (x.ring_packets, x.ring_bytes) for x in held.collect()} == {k: v[:2] for k, v in want.items()}
    data = F.unhex(F.lpad(F.hex("seq"), 16, "0"))
    captures.write_rings(packets.withColumn("data", data), held, f"file://{tmp_path}/rings", F.concat(F.lit("c"), F.col("seq").cast("string"), F.lit(".pcap")))
    found = {f.name: [int.from_bytes(r[3], "big") for r in Capture(open(f, "rb"), f.stat().st_size).records(24, 24, f.stat().st_size)] for f in (tmp_path / "rings").glob("*.pcap")}
    assert found == {f"c{k}.pcap": v[2] for k, v in want.items()}


def test_packets_by_mode(spark, tmp_path):
    write_pcap(spark.createDataFrame([(5, b"abc")], "ts_us long, data binary"), f"file://{tmp_path}/p")
    frames = packets_from(spark, "pcap", f"file://{tmp_path}/p")
    frames.write.parquet(f"{tmp_path}/t")
    for rows in (frames, packets_from(spark, "parquet", f"{tmp_path}/t")):
        assert [(x.ts_us, x.orig_len, bytes(x.data)) for x in rows.collect()] == [(5, 3, b"abc")]
    with pytest.raises(ValueError, match="live"):
        packets_from(spark, "af_packet", "eth0")


def test_runs_of_a_flow_in_chunks():
    """The same runs, whatever chunks a batch comes in."""
    rng = random.Random(4)
    rows = [(rng.randrange(40_000) if k % 3 else rng.randrange(900), k, rng.random() < 0.5, rng.randrange(90), rng.randrange(64), rng.choice([None, "a", "b"])) for k in range(900)]
    part = lambda x: pd.DataFrame(x, columns=["ts_us", "seq", "forward", "size", "tcp_flags", "dns_query"])
    whole = sf.runs_of(part(rows), 100)
    for n in (1, 7, 300):
        runs = []
        for k in range(0, len(rows), n):
            runs = sf.joined(runs + sf.runs_of(part(rows[k : k + n]), 100), 100)
        assert runs == whole and 20 < len(runs) < 500 and max(sum(r.packets) for r in runs) > sf.SAMPLES
