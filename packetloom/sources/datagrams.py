"""UDP datagrams as a stream, for syslog, NetFlow and SNMP inputs, and the names of the sources that take packets.

One task listens; what arrives is drained in batches, each row a datagram with its sender. UDP has no replay, so this is for tests and edges; on a
cluster land datagrams in files or Kafka and read these as streams.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from packetloom.operators.telemetry import netflow_v5, snmp_info, syslog_info
from packetloom.sources.pcap import read_pcap

SCHEMA = "data binary, sender string, received_us long"
#: The largest datagram of each kind, and usual ports.
LARGEST = {"syslog": 8192, "netflow": 65535, "snmp": 65535}
PORTS = {"syslog": 1514, "netflow": 2055, "snmp": 162}


class UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.host, self.port = options.get("host", "0.0.0.0"), int(options.get("port", 0))
        self.largest = int(options.get("largest", 65535))
        self.most, self.wait = int(options.get("maxDatagrams", 10_000)), float(options.get("waitSeconds", 0.2))
        self.socket: socket.socket | None = None
        self.rows: list[tuple] = []
        self.first = 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind((self.host, self.port))
        self.socket.settimeout(self.wait)
        found = []
        try:
            while len(found) < self.most:
                data, (host, port) = self.socket.recvfrom(self.largest)
                found.append((data, f"{host}:{port}", time.time_ns() // 1000))
        except TimeoutError:
            pass
        self.rows += found
        return iter(found), {"n": start["n"] + len(found)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.rows[start["n"] - self.first : end["n"] - self.first])

    def commit(self, end: dict) -> None:
        self.rows = self.rows[end["n"] - self.first :]
        self.first = end["n"]


class UdpSource(DataSource):
    """format("udp"); options host, port, largest, maxDatagrams, waitSeconds."""

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> UdpReader:
        return UdpReader(self.options)


def datagrams(spark: SparkSession, kind: str, host: str = "0.0.0.0", port: int | None = None) -> DataFrame:
    """A stream of raw datagrams of one kind."""
    spark.dataSource.register(UdpSource)
    options = {"host": host, "port": str(port or PORTS[kind]), "largest": str(LARGEST[kind])}
    return spark.readStream.format("udp").options(**options).load()


def syslog_events(rows: DataFrame, data: str = "data") -> DataFrame:
    """Fields of syslog datagrams; what isn't UTF-8 or has no message is left out."""
    text: Column = F.try_validate_utf8(F.col(data).cast("string"))
    return rows.withColumn("_s", syslog_info(text)).filter("_s is not null").select(*[c for c in rows.columns if c != data], "_s.*")


def netflow_events(rows: DataFrame, data: str = "data") -> DataFrame:
    return netflow_v5(rows, data)


def snmp_events(rows: DataFrame, data: str = "data", sender: str = "sender") -> DataFrame:
    """Fields of SNMP datagrams; the sender is the agent."""
    return rows.withColumn("_s", snmp_info(F.col(data))).filter("_s is not null").select(*[c for c in rows.columns if c != data], "_s.*", F.col(sender).alias("agent_addr"))


def packets_from(spark: SparkSession, mode: str, path: str) -> DataFrame:
    """Frames by the name of a capture mode: `pcap` files or a `parquet` table with ts_us, orig_len, cap_len, data. Live interfaces are outside of Spark."""
    if mode == "pcap":
        return read_pcap(spark, path)
    if mode == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"capture mode {mode!r} needs a live interface: write PCAP files and read them with mode 'pcap'")
