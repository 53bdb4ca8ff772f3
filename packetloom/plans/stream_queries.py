"""Queries that run a stream to its end: files in, a table in the shared folder out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import captures as c
from packetloom.operators import rules as r
from packetloom.operators.events import delivery_counts
from packetloom.operators.flows import KEY as KEYS
from packetloom.operators.flows import spread, total
from packetloom.plans import fixtures
from packetloom.plans.flow_queries import FLOWS, IDLE
from packetloom.plans.packet_queries import JSON, SPOOL, envelopes_of
from packetloom.plans.queries import P, query
from packetloom.plans.rule_queries import JUDGED, RULES, STATS
from packetloom.session import scratch
from packetloom.streaming import flows as sf
from packetloom.streaming.counters import Counters, observed

STREAM_QUERIES: list = []
SECONDS = IDLE // 1_000_000


def drained(stream: DataFrame, out: str | None = None, log: str | None = None) -> DataFrame:
    """What the stream appends until its files are read, written once."""
    spark = stream.sparkSession
    out, log = out or scratch(spark, "stream"), log or scratch(spark, "stream-log")
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def in_two_parts(spark: SparkSession, sf_dir: str, order: str, run: Callable[[DataFrame], None]) -> None:
    """Runs a stream of the packets, with ts, to its end for the first half of them by `order`, and again when the rest has come. run: starts the stream and waits for it."""
    path = scratch(spark, "packets")
    rows = fixtures.packets(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us"))
    half = rows.agg(((F.min(order) + F.max(order)) / 2).cast("long").alias("half")).first()[0] or 0
    for part in (rows.filter(F.col(order) <= half), rows.filter(F.col(order) > half)):
        part.write.mode("append").parquet(path)
        run(spark.readStream.schema(rows.schema).parquet(path))


@query(STREAM_QUERIES, "stream_alerts", "l:seq s:rule_id verdict", f"{JUDGED}, result as (select * from j where rule_id is not null)")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sf.alerts(fixtures.packet_stream(spark, sf_dir), RULES).select("seq", "rule_id", "verdict"))


@query(
    STREAM_QUERIES,
    "stream_sessions",
    f"l:{' '.join(KEYS)} first_us last_us fwd_packets rev_packets fwd_bytes rev_bytes tcp_flags",
    f"{FLOWS}, result as (select * from f where (last_us + {IDLE}) // 1000 <= (select max(ts_us) from p) // 1000)",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark, which the last packet sets, has passed."""
    rows = fixtures.packet_stream(spark, sf_dir).withColumn("ts", F.timestamp_micros("ts_us"))
    return drained(sf.session_flows(rows, f"{SECONDS} seconds", "0 seconds"))


#: Flows whose idle time was over before the last packet, as an event-time timer sees it, in milliseconds.
OVER = f"(last_us + {IDLE}) // 1000 + 1 <= (select max(ts_us) from p) // 1000"


@query(
    STREAM_QUERIES,
    "stream_closed",
    f"l:{' '.join(KEYS)} first_us last_us fwd_packets rev_packets fwd_bytes rev_bytes tcp_flags n_iat d:iat_mean iat_std size_var s:dns_names close_reason",
    f"{FLOWS}, result as (select *, 'IdleTimeout' as close_reason from f where {OVER})",
)
def stream_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that a stream with keyed state closes, with samples, though it is stopped in the middle and started again."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, log = scratch(spark, "stream"), scratch(spark, "stream-log")
        found = []
        in_two_parts(spark, sf_dir, "ts_us", lambda packets: found.append(drained(sf.tracked_flows(packets, lambda ip: ip.cast("string"), IDLE, "0 seconds"), out, log)))
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    mean = F.coalesce(total("iats") / F.nullif(F.size("iats"), F.lit(0)) / 1000.0, F.lit(0.0))
    return found[-1].withColumns({"n_iat": F.size("iats"), "iat_mean": mean, "iat_std": F.sqrt(spread("iats", 1000.0)), "size_var": spread("sizes"), "dns_names": F.array_join("dns_queries", ",")})


SPOOL_BYTES = 100_000


@query(
    STREAM_QUERIES,
    "stream_spool",
    "l:seq s:file_name payload l:bytes spool_bytes",
    f"""{P}, {SPOOL}, result as (select seq, strftime(make_timestamp(ts_us), '%Y%m%d%H%M%S') || '_' || lpad(lower(to_hex(no)), 16, '0') || '.ges' as file_name, payload, bytes, spool_bytes from x where spool_bytes - bytes < 0.8 * {SPOOL_BYTES})""",
)
def stream_spool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters of a stream that is stopped and started again, with each batch run twice: numbers and sizes go on, and nothing is there twice."""
    path, log = scratch(spark, "spool"), scratch(spark, "spool-log")
    take = c.spool_batches(path, SPOOL_BYTES, F.concat(F.lit("event "), F.col("seq").cast("string")), F.timestamp_micros("ts_us"))

    def twice(batch: DataFrame, n: int) -> None:
        take(batch, n)
        take(batch, n)

    in_two_parts(spark, sf_dir, "seq", lambda rows: rows.writeStream.foreachBatch(twice).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination())
    return c.spool_of(spark, path)


@query(
    STREAM_QUERIES,
    "stream_counters",
    "s:observation name l:value",
    f"""{JUDGED}, e as (select {JSON} as value from p), st as (select {STATS} from j), result as (select 'rules' as observation, name, value from (unpivot st on inspected, passed, dropped, alerted, matched into name name value value)
 union all select 'delivery', unnest(['delivered', 'errors', 'bytes_sent']), unnest([count(*), 0, sum(strlen(value))]) from e)""",
)
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules did, and what was sent, as a stream's batches report it, over a restart."""
    counters, log = Counters(), scratch(spark, "counters-log")
    spark.streams.addListener(counters)

    def run(packets: DataFrame) -> None:
        judged = observed(r.match_compiled(packets, RULES), "rules", r.stats_of())
        sent = observed(envelopes_of(judged), "delivery", delivery_counts())
        counters.wait(sent.writeStream.format("noop").option("checkpointLocation", log).trigger(availableNow=True).start())

    try:
        in_two_parts(spark, sf_dir, "seq", run)
        return counters.totals(spark)
    finally:
        spark.streams.removeListener(counters)
