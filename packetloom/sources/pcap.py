"""PCAP files as a Spark data source, to read and to write, in batch and as a stream of files that arrive or still grow.

A record's place is known only from the record before it. `read_pcap` cuts files into byte ranges nevertheless: each range finds, for every place in it where a record could begin, where the chain of headers from there leaves the range
(`Capture.exits`). These maps are small, since nearly all chains run into the same one; following them from the file's first record on, a row for each range, gives each range its true start, whatever packets hold.
So the rows are those of a parser that reads the file from its beginning, which is also what the plain source does: there each file is a partition, read in blocks.

A header that can't be right (the part of its second, or a size over LARGEST_RECORD) is a damaged place. It leaves a row of its own, with `error`, no data, and the bytes that were passed over as cap_len. Reading goes on at the next run of
RUN headers that are plausible and whose times lie near each other; only there, after damage, records without any non-zero field, and those before such a run, may be passed over. So is a record that ends behind the file's end,
and the last one if it is cut; a cut header ends a file, and a file of another kind has no rows. Both byte orders, and microseconds or nanoseconds, are understood.

The stream source's offset is, for each file, the byte up to which its records are whole. The driver walks the headers that were added to find it; tasks read ranges of whole records, so that each record
comes once, also after a restart (after which the driver walks over a file's headers anew).

Writing: each task writes one file of its rows in the order in which they come, or one for each `file_name`; files get their names in the driver's commit.

Rows: ts_us, orig_len, cap_len, data, error. On writing null data is an empty packet, a null time is 0 and a null length the packet's own.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from packetloom.session import written

# The file format.
MAGIC_US, MAGIC_NS = 0xA1B2C3D4, 0xA1B23C4D
VERSION = (2, 4)
SNAPLEN, ETHERNET = 65535, 1
SCHEMA = "ts_us long, orig_len long, cap_len long, data binary, error string"
BATCH_BYTES = 4 << 20
#: A record header that says more is damaged.
LARGEST_RECORD = 1 << 26
RANGE_BYTES = 64 << 20
#: Partitions that small files make, roughly.
SMALL_PARTS = 64
#: Tasks that ranges are dealt to.
MOST_TASKS = 20_000
#: Bytes of a range whose chains are followed at once.
MAP_BYTES = 8 << 20
#: Bytes that are read at once.
BLOCK = 1 << 22
#: Headers that are farther from each other than this are read one by one.
FAR = 1 << 16
#: After damage: plausible headers in a row that make a place the start of a record, and how far the times of two of them may lie from each other.
RUN, NEAR_SECS = 5, 400 * 86_400
#: A place that isn't known yet: the first run of plausible headers from here on.
SEARCH = -1


def file_header(snaplen: int = SNAPLEN) -> bytes:
    return struct.pack("<IHHiIII", MAGIC_US, *VERSION, 0, 0, snaplen, ETHERNET)


def record(ts_us: int | None, data: bytes | None, orig_len: int | None = None) -> bytes:
    data = data or b""
    return struct.pack("<IIII", (ts_us or 0) // 1_000_000, (ts_us or 0) % 1_000_000, len(data), len(data) if orig_len is None else orig_len) + data


def records_of(b: pa.RecordBatch, snaplen: int) -> np.ndarray:
    """The bytes of `record` for all rows of ts_us, data and, if there, orig_len; data is cut to `snaplen`."""
    column = lambda c: b.column(b.schema.get_field_index(c))
    data = pc.fill_null(column("data").cast(pa.large_binary()), b"")
    whole = pc.binary_length(data).to_numpy(zero_copy_only=False).astype("i8")
    size = np.minimum(whole, snaplen)
    orig = pc.coalesce(column("orig_len").cast(pa.int64()), pa.array(whole)).to_numpy(zero_copy_only=False) if "orig_len" in b.schema.names else whole
    ts = pc.fill_null(column("ts_us").cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    numbers = np.stack([ts // 1_000_000, ts % 1_000_000, size, orig], axis=1)
    if numbers.size and (numbers.min() < 0 or numbers.max() >= 1 << 32):
        raise ValueError("times and lengths of a PCAP record are unsigned numbers of 32 bits")
    begin = np.cumsum(16 + size) - 16 - size
    out = np.empty(int((16 + size).sum()), "u1")
    out[begin[:, None] + np.arange(16)] = numbers.astype("<u4").view("u1").reshape(-1, 16)
    starts = np.frombuffer(data.buffers()[1], "<i8")[data.offset : data.offset + len(data)]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    if len(within):
        out[np.repeat(begin + 16, size) + within] = np.frombuffer(data.buffers()[2], "u1")[np.repeat(starts, size) + within]
    return out


@dataclass
class Exits:
    """Where chains of headers leave a range of bytes, by where they enter it (SEARCH: nowhere, they end in damage). Places in `own` have exits of their own; any other leaves where the next one in `runs` after it does."""

    runs: np.ndarray
    run_exits: np.ndarray
    own: np.ndarray
    own_exits: np.ndarray

    def of(self, at: int) -> int:
        k = bisect_left(self.own, at)
        return int(self.own_exits[k]) if k < len(self.own) and self.own[k] == at else self.after(at)

    def after(self, at: int) -> int:
        """Of the first run that begins after this place."""
        k = bisect_right(self.runs, at)
        return int(self.run_exits[k]) if k < len(self.runs) else SEARCH


class Capture:
    """An open PCAP file of known size. `order` is None if it is no PCAP file. whole: nothing will be added behind that size."""

    def __init__(self, f: BinaryIO, size: int, whole: bool = True):
        self.f, self.size, self.whole, self.at, self.block, self.step = f, size, whole, 0, b"", BLOCK
        f.seek(0)
        head = f.read(min(24, size))
        self.order = next((o for o in "<>" if len(head) == 24 and struct.unpack(o + "I", head[:4])[0] in (MAGIC_US, MAGIC_NS)), None)
        if self.order:
            self.unit = 1 if struct.unpack(self.order + "I", head[:4])[0] == MAGIC_US else 1000

    def bytes(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if not self.at <= at <= at + n <= self.at + len(self.block):
            self.f.seek(at)
            self.at, self.block = at, self.f.read(max(n, self.step))
        return self.block[at - self.at : at - self.at + n]

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        """Seconds, their part, captured and original length; None at the end."""
        raw = self.bytes(at, 16)
        return struct.unpack(self.order + "IIII", raw) if len(raw) == 16 else None

    def sound(self, h: tuple[int, int, int, int]) -> bool:
        return h[1] < 1_000_000 * self.unit and h[2] <= LARGEST_RECORD

    def run(self, at: int, secs: int | None = None) -> int:
        """How many plausible headers, RUN at most, follow each other from here on; the file's end makes up for those that are missing. secs: the time of the header before."""
        for k in range(RUN):
            h = self.header(at)
            if h is None:
                return RUN if self.whole and self.size - 16 < at <= self.size and (k or secs is not None) else k
            if not self.sound(h) or h[3] > LARGEST_RECORD or not any(h) or (secs is not None and abs(h[0] - secs) > NEAR_SECS):
                return k
            secs, at = h[0], at + 16 + h[2]
        return RUN

    def headers(self, at: np.ndarray) -> np.ndarray:
        """The four numbers of the headers at these places, a row each. Neighbouring places are read together, each block once."""
        order = np.argsort(at, kind="stable")
        places = at[order]
        raw = np.empty((len(at), 16), "u1")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(places) > FAR) + 1, [len(places)])).tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            while lo < hi:
                first = int(places[lo])
                upto = min(hi, int(np.searchsorted(places, first + BLOCK - 16, side="right")))
                self.f.seek(first)
                block = np.frombuffer(self.f.read(int(places[upto - 1]) - first + 16), "u1")
                raw[order[lo:upto]] = block[(places[lo:upto] - first)[:, None] + np.arange(16)]
                lo = upto
        return raw.view(self.order + "u4").astype("i8")

    def runs_at(self, at: np.ndarray, secs: np.ndarray) -> np.ndarray:
        """`run` at each of these places, after headers of these times."""
        count, live = np.zeros(len(at), "i1"), np.arange(len(at))
        for _ in range(RUN):
            if self.whole:
                count[live[(at > self.size - 16) & (at <= self.size)]] = RUN
            there = at <= self.size - 16
            live, at, secs = live[there], at[there], secs[there]
            h = self.headers(at)
            ok = (h[:, 1] < 1_000_000 * self.unit) & (h[:, 2] <= LARGEST_RECORD) & (h[:, 3] <= LARGEST_RECORD) & h.any(axis=1) & (np.abs(h[:, 0] - secs) <= NEAR_SECS)
            live, h = live[ok], h[ok]
            count[live] += 1
            at, secs = at[ok] + 16 + h[:, 2], h[:, 0]
        return count

    def run_lengths(self, begin: int, end: int) -> np.ndarray:
        """`run` at each place of this range of bytes where a whole header fits."""
        n = max(0, min(end, self.size - 15) - begin)
        out = np.zeros(n, "i1")
        if not n:
            return out
        secs, part, size, orig = self.fields(begin, n)
        place = np.flatnonzero((part < 1_000_000 * self.unit) & (size <= LARGEST_RECORD) & (orig <= LARGEST_RECORD) & (secs | part | size | orig > 0))
        if not len(place):
            return out
        secs, to = secs[place].astype("i8"), place + 16 + size[place].astype("i8")
        del part, size, orig
        inside = to < n
        at = np.minimum(np.searchsorted(place, to), len(place) - 1)
        near = inside & (place[at] == to) & (np.abs(secs[at] - secs) <= NEAR_SECS)
        beyond = np.zeros(len(place), "i1")
        far = np.flatnonzero(~inside)
        beyond[far] = self.runs_at(begin + to[far], secs[far])
        length = np.ones(len(place), "i1")
        for _ in range(RUN - 1):
            length = (1 + np.minimum(RUN - 1, np.where(near, length[at], beyond))).astype("i1")
        out[place] = length
        return out

    def fields(self, begin: int, n: int) -> tuple[np.ndarray, ...]:
        """The four numbers of a header at each of n places."""
        raw = np.frombuffer(self.bytes(begin, n + 15), "u1").astype("u4")
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        word = sum(raw[k : len(raw) - 3 + k] << np.uint32(s) for k, s in enumerate(shifts))
        return tuple(word[k : k + n] for k in (0, 4, 8, 12))

    def next_start(self, at: int, stop: int | None = None) -> int | None:
        """The first place from `at` on, before `stop`, where a run of headers begins."""
        stop = self.size - 15 if stop is None else min(stop, self.size - 15)
        while at < stop:
            n = min(BLOCK, stop - at)
            secs, part, size, orig = self.fields(at, n)
            for k in np.flatnonzero((part < 1_000_000 * self.unit) & (size <= LARGEST_RECORD) & (orig <= LARGEST_RECORD) & (secs | part | size | orig > 0)).tolist():
                if self.run(at + k) == RUN:
                    return at + k
            at += n
        return None

    def exits(self, begin: int, end: int, lengths: np.ndarray | None = None) -> Exits:
        """Where the chains from all places of this range leave it. lengths: its `run_lengths`, if known."""
        n = max(0, min(end, self.size - 15) - begin)
        lengths = self.run_lengths(begin, end) if lengths is None else lengths
        part, size = (x.astype("i8") for x in self.fields(begin, n)[1:3]) if n else [np.empty(0, "i8")] * 2
        place = np.flatnonzero((part < 1_000_000 * self.unit) & (size <= np.minimum(LARGEST_RECORD, self.size - begin - 16 - np.arange(n))))
        to = place + 16 + size[place]
        del part, size
        at = np.searchsorted(place, to)
        inside = to < n
        goes = inside & (place[np.minimum(at, len(place) - 1)] == to) if len(place) else inside
        at = np.where(goes, at, 0)
        runs = np.flatnonzero(lengths[place] >= RUN)
        # each place goes on to another, or ends: outside, or in damage
        after = np.searchsorted(place[runs], to, side="right")
        found = ~goes & inside & (after < len(runs))
        index = np.arange(len(place))
        jump = np.where(goes, at, index)
        jump[found] = runs[after[found]]
        exits = np.where(inside, SEARCH, begin + to)
        while not np.array_equal(further := jump[jump], jump):
            jump = further
        exits = exits[jump]
        starts, of_runs = place[runs], exits[runs]
        last = np.flatnonzero(np.append(of_runs[1:] != of_runs[:-1], True)) if len(runs) else np.empty(0, "i8")  # of runs in a row that leave at one place the last is enough
        after = np.searchsorted(starts[last], place, side="right")
        usual = np.append(of_runs[last], SEARCH)[after]
        own = exits != usual
        return Exits(begin + starts[last], of_runs[last], begin + place[own], exits[own])

    def steps(self, at: int, end: int) -> Iterator[tuple[int, tuple[int, int, int, int] | None, int]]:
        """(place, header, next place) of the records that begin from `at` on and before `end`; the header is None at a damaged place. A record that ends behind the file's end is damaged too, or cut if
        nothing sound follows; a file that isn't whole ends before it, and before damage that nothing sound follows yet."""
        while at < end and (h := self.header(at)):
            to = at + 16 + h[2]
            if self.sound(h) and to <= self.size:
                yield at, h, to
            elif self.sound(h) and not self.whole:
                return
            else:
                found = self.next_start(at + 1)
                if found is None and not self.whole:
                    return
                to = found or self.size
                yield at, None, to
            at = to

    def records(self, start: int, begin: int, end: int) -> Iterator[tuple[int | None, int | None, int, bytes | None, str | None]]:
        """Rows of the records that begin in this range of bytes; `start` is the place of the first of them, or SEARCH."""
        if not self.order:
            return
        if start == SEARCH:
            found = self.next_start(begin, end)
            start = end if found is None else found
        for at, h, to in self.steps(start, end):
            if h is None:
                yield None, None, to - at, None, f"damaged record at byte {at}"
            else:
                yield h[0] * 1_000_000 + h[1] // self.unit, h[3], h[2], self.bytes(at + 16, h[2]), None


@dataclass
class File(InputPartition):
    """A range of bytes of a file of this size, and where its first record is."""

    path: str
    size: int = 0
    begin: int = 0
    end: int = 0
    start: int = 24
    whole: bool = True


def batches(store: pafs.FileSystem, part: File) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(part.path) as f:
        rows, size = [], 0
        capture = Capture(f, part.size, part.whole)
        capture.step = min(BLOCK, max(FAR, part.end - part.start))
        for r in capture.records(part.start, part.begin, part.end):
            rows.append(r)
            size += len(r[3] or b"")
            if size >= BATCH_BYTES or len(rows) >= 10_000:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


def listed(path: str) -> list[tuple[str, int]]:
    """Path and size of each file at or below `path`, hidden ones left out."""
    store, root = pafs.FileSystem.from_uri(path)
    here = store.get_file_info(root)
    found = [here] if here.is_file else store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True))
    return sorted((i.path, i.size) for i in found if i.is_file and not posixpath.basename(i.path).startswith(("_", ".")))


@dataclass
class Written(WriterCommitMessage):
    """Temporary and final names of files."""

    names: list[tuple[str, str]]


@dataclass
class Files(InputPartition):
    files: list[File]


class PcapReader(DataSourceReader):
    """A partition has whole files, several small ones or a larger one."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Files]:
        found = listed(self.path)
        most = min(RANGE_BYTES, max(1 << 20, sum(size for _, size in found) // SMALL_PARTS))
        out, held = [], 0
        for path, size in found:
            if not out or held + size > most:
                out.append(Files([]))
                held = 0
            out[-1].files.append(File(path, size, 24, size))
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = pafs.FileSystem.from_uri(self.path)[0]
        for part in partition.files:
            yield from batches(store, part)


class PcapStreamReader(DataSourceStreamReader):
    """What was added to files, as whole records. An offset is the byte up to which each file was read."""

    def __init__(self, options: dict):
        self.path, self.range_bytes = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.most = int(options["bytesPerTrigger"]) if "bytesPerTrigger" in options else None
        self.read_to: dict[str, int] = {}
        #: For each file the places where its ranges of whole records end.
        self.cuts: dict[str, list[int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def walk(self, path: str, begin: int, size: int, most: int | None = None) -> list[int]:
        """Ends of ranges of whole records from `begin` on, each of about range_bytes; with `most`, no more than about so many bytes."""
        cuts, at = [], begin
        with pafs.FileSystem.from_uri(self.path)[0].open_input_file(path) as f:
            capture = Capture(f, size, False)
            if capture.order:
                for at, _, to in capture.steps(begin, size if most is None else min(size, begin + most)):
                    at = to
                    if to - (cuts[-1] if cuts else begin) >= self.range_bytes:
                        cuts.append(to)
        return [*cuts, at] if at > (cuts[-1] if cuts else begin) else cuts

    def latestOffset(self) -> dict:
        left = self.most
        for path, size in listed(self.path):
            begin = self.read_to.get(path, 24)
            if size > begin and (left is None or left > 0):
                cuts = self.walk(path, begin, size, left)
                self.cuts.setdefault(path, []).extend(cuts)
                if cuts:
                    self.read_to[path] = cuts[-1]
                    left = None if left is None else left - (cuts[-1] - begin)
        return dict(self.read_to)

    def partitions(self, start: dict, end: dict) -> list[File]:
        out = []
        for path, to in end.items():
            begin = start.get(path, 24)
            if to > begin:
                known = self.cuts.get(path, [])
                # planned by a reader before this one: the same places, found again
                cuts = [c for c in known if begin < c <= to] if to in known and (begin in known or begin == 24) else self.walk(path, begin, to)
                self.read_to[path] = max(to, self.read_to.get(path, 24))
                out += [File(path, to, a, b, a, False) for a, b in zip([begin, *cuts], cuts)]
        return out

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        yield from batches(pafs.FileSystem.from_uri(self.path)[0], partition)

    def commit(self, end: dict) -> None:
        for path, to in end.items():
            self.cuts[path] = [c for c in self.cuts.get(path, []) if c >= to]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["ts_us", "orig_len", "cap_len", "data", "error"])


class PcapWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.names
        self.snaplen = int(options.get("snapLen", SNAPLEN))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        named = "file_name" in self.names
        store, root = pafs.FileSystem.from_uri(self.path)
        out, name, files = None, None, []
        for b in iterator:
            names = b.column(b.schema.get_field_index("file_name")).to_pylist() if named else [None] * len(b)
            at = 0
            for wanted, rows in groupby(names):
                n = sum(1 for _ in rows)
                if out is None or (named and wanted != name):
                    if out is not None:
                        out.close()
                    unique = f"{self.job}-{uuid.uuid4().hex}.pcap"
                    name = wanted if named else unique
                    files.append((f"_{unique}", name))
                    store.create_dir(root)
                    out = store.open_output_stream(posixpath.join(root, f"_{unique}"), buffer_size=1 << 20)
                    out.write(file_header(self.snaplen))
                out.write(records_of(b.slice(at, n), self.snaplen))
                at += n
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for held, name in (n for m in messages if m for n in m.names):
            store.move(posixpath.join(root, held), posixpath.join(root, name))
        self.abort([])  # what attempts have left that were not counted

    def abort(self, messages: list) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for i in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if posixpath.basename(i.path).startswith(f"_{self.job}-"):
                store.delete_file(i.path)


class PcapSource(DataSource):
    """format("pcap"); options path, and rangeBytes and bytesPerTrigger of streams."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader(self.options)

    def streamReader(self, schema: StructType) -> PcapStreamReader:
        return PcapStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> PcapWriter:
        return PcapWriter(self.options, schema)


def mapped(rows: DataFrame, path: str, map_bytes: int) -> DataFrame:
    """(path, size, begin, end, part, runs, run_exits, own, own_exits): the `Exits` of each piece of each range, in rows of ranges (path, size, begin, end), which should come in order."""

    def maps(capture: Capture, ranges: list[dict]) -> Iterator[pa.RecordBatch]:
        """Of ranges that follow each other, several short ones or one of any length; headers beyond them are looked up for all short ones at once."""
        begin, end = ranges[0]["begin"], ranges[-1]["end"]
        lengths = capture.run_lengths(begin, end) if end - begin <= map_bytes else None
        for r in ranges:
            for at in range(r["begin"], r["end"], map_bytes):
                to = min(r["end"], at + map_bytes)
                x = capture.exits(at, to, None if lengths is None else lengths[at - begin : to - begin])
                lists = (pa.array([v], pa.list_(pa.int64())) for v in (x.runs, x.run_exits, x.own, x.own_exits))
                yield pa.RecordBatch.from_arrays([*(pa.array([v]) for v in (r["path"], r["size"], r["begin"], r["end"], at)), *lists], schema=MAPPED)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = pafs.FileSystem.from_uri(path)[0]
        for name, of_file in groupby((r for b in parts for r in b.to_pylist()), key=lambda r: r["path"]):
            with store.open_input_file(name) as f:
                held: list[dict] = []
                capture = None
                for r in of_file:
                    capture = capture or Capture(f, r["size"])
                    if held and (r["begin"] != held[-1]["end"] or r["end"] - held[0]["begin"] > map_bytes):
                        yield from maps(capture, held)
                        held = []
                    if capture.order:
                        held.append(r)
                if held:
                    yield from maps(capture, held)

    return rows.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.name == 'path' else 'array<long>' if pa.types.is_list(f.type) else 'long'}" for f in MAPPED))


MAPPED = pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("size", "begin", "end", "part")), *((c, pa.list_(pa.int64())) for c in ("runs", "run_exits", "own", "own_exits"))])
STARTED = "path string, size long, begin long, end long, start long"


def started(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of files, each file's maps in order, with the place of their first record, if a record begins there or may."""
    path, at = None, 24
    for b in parts:
        out = []
        plain = b.select(["path", "size", "begin", "end", "part", "next"]).to_pylist()
        lists = [b.column(b.schema.get_field_index(c)) for c in ("runs", "run_exits", "own", "own_exits")]
        for k, r in enumerate(plain):
            if r["path"] != path:
                path, at = r["path"], 24
            if r["part"] == r["begin"] and (at == SEARCH or at < r["end"]):
                out.append({c: r[c] for c in ("path", "size", "begin", "end")} | {"start": at})
            if at == SEARCH or at < min(r["end"], r["next"]):
                x = Exits(*(c[k].values.to_numpy(zero_copy_only=False) for c in lists))
                at = x.after(r["part"] - 1) if at == SEARCH else x.of(at)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("size", "begin", "end", "start"))]))


def read_pcap(spark: SparkSession, path: str, rangeBytes: int | str = RANGE_BYTES, map_bytes: int = MAP_BYTES) -> DataFrame:
    """The packets of the files at or below `path`. Files larger than `rangeBytes` are read in ranges of so many bytes, whose starts are found first, by a pass over the files."""
    spark.dataSource.register(PcapSource)
    step, files = int(rangeBytes), listed(path)
    if all(size <= step for _, size in files):
        return spark.read.format("pcap").option("path", path).load()
    rows = [(p, size, at, min(size, at + step)) for p, size in files for at in range(0, size, step)]
    tasks = min(len(rows), MOST_TASKS, max(2 * spark.sparkContext.defaultParallelism, sum(size for _, size in files) // MAP_BYTES))  # short ranges share tasks
    ranges = spark.createDataFrame(rows, "path string, size long, begin long, end long").repartitionByRange(tasks, "path", "begin").sortWithinPartitions("path", "begin")
    maps = written(mapped(ranges, path, map_bytes).withColumn("next", F.least(F.col("part") + map_bytes, F.col("end"))), "exits")
    starts = maps.repartition("path").sortWithinPartitions("path", "part").mapInArrow(started, STARTED)
    starts = written(starts, "starts").repartitionByRange(tasks, "path", "begin")

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = pafs.FileSystem.from_uri(path)[0]
        for b in parts:
            for r in b.to_pylist():
                yield from batches(store, File(**r))

    return starts.mapInArrow(read, SCHEMA)


def capture_stats(frames: DataFrame) -> DataFrame:
    """One row about what was read: received records, dropped (damaged places), bytes passed over there, and records that were captured in part."""
    bad = F.col("error").isNotNull()
    return frames.agg(
        F.count_if(~bad).alias("received"),
        F.count_if(bad).alias("dropped"),
        F.coalesce(F.sum(F.when(bad, F.col("cap_len"))), F.lit(0)).alias("dropped_bytes"),
        F.count_if(~bad & (F.col("orig_len") > F.col("cap_len"))).alias("truncated"),
    )


def write_pcap(packets: DataFrame, path: str) -> None:
    """ts_us and data (and orig_len, if there) as PCAP files, one for each partition that has rows. With file_name, one for each name: rows of a name have to be in one partition, and together."""
    packets.sparkSession.dataSource.register(PcapSource)
    columns = [c for c in ("ts_us", "orig_len", "data", "file_name") if c in packets.columns]
    packets.select(*columns).write.format("pcap").mode("append").option("path", path).save()


def stream_pcap(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, bytes_per_trigger: int | None = None) -> DataFrame:
    """Packets of PCAP files below `path` as files arrive and as they grow. A task reads whole records of about `range_bytes`; a trigger takes what there is, or about `bytes_per_trigger`."""
    spark.dataSource.register(PcapSource)
    most = {} if bytes_per_trigger is None else {"bytesPerTrigger": str(bytes_per_trigger)}
    return spark.readStream.format("pcap").option("path", path).option("rangeBytes", str(range_bytes)).options(**most).load()
