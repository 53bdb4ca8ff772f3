"""Application protocols out of payloads: each gives a nullable struct; null means that it isn't that protocol.

HTTP, Modbus, DNP3 and BACnet are column expressions. DNS names and TLS extensions are walks of unknown length and
run in Arrow functions, for all payloads of a batch at once. Null payloads, and offsets beyond the end, give null.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from packetloom.functions import walks
from packetloom.functions.binary import Place, rest, u8, u16, u16le
from packetloom.functions.net import bound

# Function codes that write or control, and BACnet's service number of a write.
MODBUS_WRITES = (5, 6, 15, 16)
DNP3_CONTROLS = (2, 3, 4, 5, 6, 13, 14)
BACNET_WRITE = 15


def http_text(data: Column, at: Place) -> Column:
    payload = rest(data, at)
    return F.when(F.length(payload) >= 10, F.try_validate_utf8(payload.cast("string")))


def is_http(data: Column, at: Place = 0) -> Column:
    """Whether `http_info` gives something: the start of a response, or a first line of three words."""
    text = http_text(data, at)
    return F.coalesce(text.rlike(r"^(?:HTTP/|[^\n ]* [^\n ]* )"), F.lit(False))


def http_info(data: Column, at: Place = 0) -> Column:
    """STRUCT<method, uri, version, status_code, host> of a request or response line and the Host header.

    The whole payload has to be UTF-8. Methods aren't checked: any first line of three words is a request.
    """
    return F.when(is_http(data, at), bound(http_text(data, at), _http_fields))


def _http_fields(text: Column) -> Column:
    words = F.split(F.regexp_extract(text, r"^([^\n]*?)(?:\r?\n|\z)", 1), " ", 3)
    lines = F.split(text, r"\r?\n")
    return bound(F.struct(words.alias("words"), F.slice(lines, F.lit(2), F.size(lines)).alias("headers")), _http_struct)


def _http_struct(x: Column) -> Column:
    words, headers = x["words"], x["headers"]
    blank = F.array_position(headers, "").cast("int")
    headers = F.when(blank > 0, F.slice(headers, F.lit(1), blank - 1)).otherwise(headers)
    host = F.substring(F.coalesce(F.get(F.filter(headers, lambda h: h.startswith("Host: ") | h.startswith("host: ")), F.lit(0)), F.lit("")), 7, 1 << 30)
    word = lambda i: F.coalesce(F.get(words, F.lit(i)), F.lit(""))
    response, two = word(0).startswith("HTTP/"), F.size(words) >= 2
    number = F.regexp_extract(word(1), r"^\+?0*([0-9]{1,9})$", 1).try_cast("int")
    return F.struct(
        F.when(response, "").otherwise(word(0)).alias("method"),
        F.when(response, "").otherwise(word(1)).alias("uri"),
        F.when(response, F.when(two, word(0)).otherwise("")).otherwise(word(2)).alias("version"),
        F.when(response & two & (number <= 65535), number).otherwise(0).alias("status_code"),
        F.regexp_replace(host, r"(?U)^\s+|\s+$", "").alias("host"),
    )


def modbus_info(data: Column, at: Place = 0) -> Column:
    """STRUCT<transaction_id, unit_id, function_code, is_exception, exception_code, is_write> of a Modbus/TCP frame."""
    p = rest(data, at)
    code = u8(p, 7)
    plain, bad = code.bitwiseAND(0x7F), code.bitwiseAND(0x80) != 0
    found = F.struct(
        u16(p, 0).alias("transaction_id"),
        u8(p, 6).alias("unit_id"),
        plain.alias("function_code"),
        bad.alias("is_exception"),
        F.when(bad, F.coalesce(u8(p, 8), F.lit(0))).otherwise(0).alias("exception_code"),
        plain.isin(*MODBUS_WRITES).alias("is_write"),
    )
    return F.when((F.length(p) >= 8) & (u16(p, 2) == 0), found)


def dnp3_info(data: Column, at: Place = 0) -> Column:
    """STRUCT<length, control, destination, source, function_code, is_control> of a DNP3 link frame; without a 12th byte the function is 0."""
    p = rest(data, at)
    code = F.coalesce(u8(p, 11), F.lit(0))
    found = F.struct(u8(p, 2).alias("length"), u8(p, 3).alias("control"), u16le(p, 4).alias("destination"), u16le(p, 6).alias("source"), code.alias("function_code"), code.isin(*DNP3_CONTROLS).alias("is_control"))
    return F.when((F.length(p) >= 10) & (u16(p, 0) == 0x0564), found)


def bacnet_info(data: Column, at: Place = 0) -> Column:
    """STRUCT<bvlc_type, bvlc_function, bvlc_length, npdu_version, is_confirmed, service_choice, is_write> of a BACnet/IP frame."""

    def found(p: Column) -> Column:
        n, control = F.length(p), F.coalesce(u8(p, 5), F.lit(0))
        to, by = control.bitwiseAND(0x20) != 0, control.bitwiseAND(0x08) != 0
        skip = lambda on: lambda k: F.when(on & (n > k + 3), k + 3 + u8(p, k + 2)).otherwise(k)

        def fields(k: Column) -> Column:
            confirmed = F.coalesce((n > 6) & (F.shiftright(u8(p, k), 4) == 0), F.lit(False))
            service = F.when(confirmed, u8(p, k + 3))
            return F.struct(
                u8(p, 0).alias("bvlc_type"),
                u8(p, 1).alias("bvlc_function"),
                u16(p, 2).alias("bvlc_length"),
                u8(p, 4).alias("npdu_version"),
                confirmed.alias("is_confirmed"),
                service.alias("service_choice"),
                F.coalesce(service == BACNET_WRITE, F.lit(False)).alias("is_write"),
            )

        routed = bound(bound(F.lit(6), skip(to)), skip(by))
        return F.when((n >= 4) & (u8(p, 0) == 0x81), bound(routed + to.cast("int"), fields))

    return bound(rest(data, at), found)


def utf8(raw: Column, otherwise: str) -> Column:
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.lit(otherwise))


@F.arrow_udf(StructType().add("labels", ArrayType(BinaryType())).add("dot", BooleanType()).add("type", IntegerType()))
def dns_questions(payloads: pa.Array) -> pa.Array:
    return walks.dns_names(payloads)


def dns_info(data: Column, at: Place = 0) -> Column:
    """STRUCT<transaction_id, is_response, question_count, answer_count, query_name, query_type>; names that are broken are empty."""
    p = rest(data, at)
    asked = dns_questions(F.when((F.length(p) >= 12) & (u16(p, 4) > 0), p))
    name = F.concat(F.array_join(F.transform(asked["labels"], lambda x: utf8(x, "<invalid>")), "."), F.when(asked["dot"], ".").otherwise(""))
    found = F.struct(
        u16(p, 0).alias("transaction_id"),
        (u16(p, 2).bitwiseAND(0x8000) != 0).alias("is_response"),
        u16(p, 4).alias("question_count"),
        u16(p, 6).alias("answer_count"),
        F.coalesce(name, F.lit("")).alias("query_name"),
        F.coalesce(asked["type"], F.lit(0)).alias("query_type"),
    )
    return F.when(F.length(p) >= 12, found)


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in ("content_type", "major", "minor", "handshake_type")]).add("sni", BinaryType()))
def client_hellos(payloads: pa.Array) -> pa.Array:
    return walks.client_hellos(payloads)


def tls_info(data: Column, at: Place = 0) -> Column:
    """STRUCT<content_type, major, minor, handshake_type, sni>. Only handshake records go to Python."""
    p = rest(data, at)
    found = client_hellos(F.when((F.length(p) >= 9) & (u8(p, 0) == 22), p))
    return F.when(found.isNotNull(), found.withField("sni", utf8(found["sni"], "")))
