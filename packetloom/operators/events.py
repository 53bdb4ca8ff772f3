"""Events as they are sent: the JSON envelope, the Kafka projection, delivery counts, metrics text, the union of inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the envelope's fields, the topic and the metrics.
TOPIC = "ge.raw.logs"
TRUST, RISK = 100.0, 0.0
PACKETS_METRIC, ALERTS_METRIC = "ge_packets_total", "ge_alerts_total"
GAUGES = ("ge_active_flows", "ge_kafka_lag", "ge_ram_usage_bytes", "ge_dlq_size_bytes")


def envelope(packets: DataFrame, tenant: str, timestamp: Column, protocol: Column, src: Column, dst: Column, features: Column | None = None) -> DataFrame:
    """One event for each packet: a column for each field, names with dots. Missing addresses are empty texts, missing features null."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return packets.select(
        timestamp.alias("@timestamp"),
        F.lit(tenant).alias("tenant.id"),
        F.lit("event").alias("event.kind"),
        F.array(F.lit("network")).alias("event.category"),
        protocol.alias("network.protocol"),
        F.coalesce(src, F.lit("")).alias("source.ip"),
        zero("src_port").alias("source.port"),
        F.coalesce(dst, F.lit("")).alias("destination.ip"),
        zero("dst_port").alias("destination.port"),
        F.lit(TRUST).cast("float").alias("ge.trust_score"),
        F.lit(RISK).cast("float").alias("ge.risk_score"),
        F.lit("").alias("ge.raw"),
        F.lit("").alias("merkle_hash"),
        (F.lit(None) if features is None else features).cast("array<float>").alias("ml_features"),
    )


def as_json(events: DataFrame) -> DataFrame:
    """(key, value): the source address and the event as JSON with its nulls, as a Kafka sink takes them."""
    value = F.to_json(F.struct(*(F.col(f"`{c}`") for c in events.columns)), {"ignoreNullFields": "false"})
    return events.select(F.col("`source.ip`").alias("key"), value.alias("value"))


#: The fields of an envelope, for reading it back.
FIELDS = (
    "`@timestamp` string, `tenant.id` string, `event.kind` string, `event.category` array<string>, `network.protocol` string, `source.ip` string, `source.port` int, `destination.ip` string, "
    "`destination.port` int, `ge.trust_score` float, `ge.risk_score` float, `ge.raw` string, merkle_hash string, ml_features array<float>"
)


def from_json(sent: DataFrame, value: str = "value") -> DataFrame:
    """The events of (value) rows as columns again; all null where the text is no event."""
    return sent.select(F.from_json(value, FIELDS).alias("_e")).select("_e.*")


def request_path(request: Column) -> Column:
    """The second word of the first line of a request; null if there is none."""
    return F.nullif(F.regexp_extract(request, r"^[^\S\n]*\S+[^\S\n]+(\S+)", 1), F.lit(""))


def query_param(request: Column, key: str) -> Column:
    """The value of the first `key=` in the query string of a request's path; null if there is none."""
    pairs = F.split(F.get(F.split(request_path(request), r"\?"), F.lit(1)), "&")
    return F.substr(F.get(F.filter(pairs, lambda x: x.startswith(f"{key}=")), F.lit(0)), F.lit(len(key) + 2))


def write_kafka(events: DataFrame, brokers: list[str], topic: str = TOPIC) -> None:
    """Sends the events; needs Spark's Kafka connector on the class path."""
    out = as_json(events).write.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("topic", topic)
    out.option("kafka.acks", "all").option("kafka.batch.size", 65536).option("kafka.linger.ms", 5).save()


def delivery_counts() -> dict[str, Column]:
    """Aggregates of (value) rows that are sent; a null value is an event that could not be written."""
    return {"delivered": F.count("value"), "errors": F.count_if(F.col("value").isNull()), "bytes_sent": F.coalesce(F.sum(F.octet_length("value")), F.lit(0))}


def delivery_stats(sent: DataFrame) -> DataFrame:
    """One row of `delivery_counts`."""
    return sent.agg(*(c.alias(k) for k, c in delivery_counts().items()))


def counter_lines(counts: DataFrame, metric: str, labels: dict[str, Column], n: Column) -> DataFrame:
    """(line): one line of metrics text for each row."""
    named = [F.concat(F.lit(f'{k}="'), v, F.lit('"')) for k, v in sorted(labels.items())]
    return counts.select(F.concat(F.lit(f"{metric}{{"), F.concat_ws(",", *named), F.lit("} "), n.cast("string")).alias("line"))


def gauge_line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name} "), value.cast("string"))


def prometheus_total(lines: DataFrame, metric: str) -> DataFrame:
    """One row, total: the sum of whole numbers at the ends of lines that start with `metric`."""
    words = F.split(F.trim(F.col("line")), r"\s+")
    value = F.element_at(words, -1).try_cast("long")
    return lines.filter(F.col("line").startswith(metric)).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def union_of(*inputs: DataFrame) -> DataFrame:
    """Events of several inputs as one table; columns that an input lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)
