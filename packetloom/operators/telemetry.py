"""Records of other inputs: NetFlow v5 datagrams, syslog messages, SNMP traps.

Null and broken inputs give no record (NetFlow) or a null struct (syslog, SNMP); rows are kept otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from packetloom.functions import walks
from packetloom.functions.binary import u8
from packetloom.functions.frames import Bytes

# Sizes and offsets of a NetFlow v5 datagram.
HEADER, RECORD = 24, 48
NETFLOW_FIELDS = {"src_ip": (0, 4), "dst_ip": (4, 4), "packets": (16, 4), "bytes": (20, 4), "first_switched": (24, 4), "last_switched": (28, 4), "src_port": (32, 2), "dst_port": (34, 2), "tcp_flags": (37, 1), "protocol": (38, 1)}
#: What messages without a priority have.
DEFAULT_PRIORITY = 13


def netflow_v5(datagrams: DataFrame, data: str = "data") -> DataFrame:
    """A row for each whole record of each version 5 datagram, with `record` (from 0) and the fields; addresses are bigints. Columns other than `data` are kept. All records of a batch are read at once."""
    kept = [f for f in datagrams.schema.fields if f.name != data and f.name != "record" and f.name not in NETFLOW_FIELDS]
    kinds = [*kept, StructField("record", IntegerType()), *(StructField(c, LongType() if size == 4 else IntegerType()) for c, (_, size) in NETFLOW_FIELDS.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = Bytes(b.column(len(kept)))
            n = np.where((d.length >= HEADER) & (d.number(0, 2) == 5), np.minimum(d.number(2, 2), (d.length - HEADER) // RECORD), 0)
            row = np.repeat(np.arange(len(b)), n)
            record = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            fields = [d.number(HEADER + record * RECORD + k, size, row).astype("i8" if size == 4 else "i4") for k, size in NETFLOW_FIELDS.values()]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(row)) for k in range(len(kept))), pa.array(record.astype("i4")), *map(pa.array, fields)], [f.name for f in kinds])

    rows = datagrams.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{data}`"))
    return rows.mapInArrow(run, StructType(kinds))


def syslog_info(message: Column) -> Column:
    """STRUCT<priority, facility, severity, hostname, app_name, message>; null for blank messages and broken priorities.

    Of what follows the priority the second word is the host, the third the application and all from the fourth on the message (everything, if
    there are fewer words). In messages of the newer format the second word is the time, and so the host.
    """
    raw = F.regexp_replace(message, r"(?U)^\s+|\s+$", "")
    number = F.regexp_extract(raw, r"^<\+?0*([0-9]{1,9})>", 1)
    given = F.when(number.try_cast("int") <= 65535, number.try_cast("int"))
    after = F.regexp_replace(raw, r"^<[^>]*>", "")
    words = F.split(after, " ", 4)
    plain = ~raw.startswith("<")
    priority = F.when(plain, DEFAULT_PRIORITY).otherwise(given)
    word = lambda i: F.when(plain, "").otherwise(F.coalesce(F.get(words, F.lit(i)), F.lit("")))
    found = F.struct(
        priority.alias("priority"),
        F.shiftright(priority, 3).bitwiseAND(255).alias("facility"),
        priority.bitwiseAND(7).alias("severity"),
        word(1).alias("hostname"),
        word(2).alias("app_name"),
        F.when(plain, raw).otherwise(F.coalesce(F.get(words, F.lit(3)), after)).alias("message"),
    )
    return F.when((F.length(raw) > 0) & priority.isNotNull(), found)


def ber_length(data: bytes, at: int) -> tuple[int, int] | None:
    """A BER length and the place behind it, or None."""
    size, place, ok = walks.ber_lengths(Bytes(pa.array([data], pa.binary())), np.array([at]))
    return (int(size[0]), int(place[0])) if ok[0] else None


@F.arrow_udf(StructType().add("version", IntegerType()).add("community", BinaryType()))
def trap_envelopes(data: pa.Array) -> pa.Array:
    return walks.trap_envelopes(data)


def snmp_info(data: Column) -> Column:
    """STRUCT<version, community, trap_oid, varbinds> of an SNMP v1 or v2c message. Objects aren't decoded: the last two are always empty."""
    found = trap_envelopes(F.when((F.length(data) >= 10) & (u8(data, 0) == 0x30), data))
    empty = F.lit(None).cast("array<struct<oid:string,value:string>>")
    return F.when(found.isNotNull(), F.struct(found["version"].alias("version"), F.coalesce(F.try_validate_utf8(found["community"].cast("string")), F.lit("???")).alias("community"), F.lit("").alias("trap_oid"), F.coalesce(empty, F.array().cast("array<struct<oid:string,value:string>>")).alias("varbinds")))
