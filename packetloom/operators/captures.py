"""Packet captures: the ring of raw packets, alert-triggered captures, their storage and its reports, dead letters.

All are functions of tables; `as_of` stands where a running sensor would take the present time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.net import five_tuple
from packetloom.operators.ordered import newest, numbered_newest, running_sum, running_sums
from packetloom.session import exists, written
from packetloom.sources.pcap import write_pcap

# Bytes of file and record headers, limits, and the forms of names.
FILE_HEADER, RECORD_HEADER = 24, 16
MOST_CAPTURES, MOST_EVENTS, MOST_PACKETS = 500, 300, 500
CAPTURE_ID = "ALT-%04d"
DAY_SECS = 86_400
BYTES_PER_PACKET = 128
TRIGGERS = ("alert", "always")
SPOOL_TIME = "yyyyMMddHHmmss"


def ring(packets: DataFrame, max_bytes: int, order: str = "seq", length: str = "length") -> DataFrame:
    """The newest packets whose bytes, record headers included, fit into `max_bytes`; the newest alone if it is larger. Null lengths count as 0."""
    size = F.coalesce(F.col(length), F.lit(0)).cast("long") + RECORD_HEADER
    rows = running_sum(packets, order, size, "_held", descending=True)
    return rows.filter((F.col("_held") <= max_bytes) | (F.col("_held") == size)).drop("_held")


def rings(packets: DataFrame, hit: Column, max_bytes: int, order: Sequence[str] = ("ts_us", "seq"), length: str = "length") -> tuple[DataFrame, DataFrame]:
    """What the ring holds at each packet where `hit` holds, that packet included: the newest packets up to there whose bytes fit, or it alone.

    Returns all packets with `at`, their place in this order, and a row for each hit: its columns, `at`, ring_first (the place of the ring's first packet), ring_packets, and ring_bytes with record headers.

    The first packet is the one before which the sum of bytes is as much as the hit's less max_bytes. Sums and these bounds are put into one order, by Spark's ranges, and the number of sums before a bound is the place that it asks for.
    """
    size = F.coalesce(F.col(length), F.lit(0)).cast("long") + RECORD_HEADER
    rows = running_sums(packets.withColumns({"_hit": F.coalesce(hit, F.lit(False)), "_size": size}), [F.col(c) for c in order], {"at": F.lit(1), "_upto": F.col("_size")})
    sums = rows.select((F.col("_upto") - F.col("_size")).alias("v"), F.lit(1).alias("kind"), "at")
    bounds = rows.filter("_hit").select((F.col("_upto") - max_bytes).alias("v"), F.lit(0).alias("kind"), "at")
    found = running_sums(sums.union(bounds), [F.col("v"), F.col("kind")], {"below": F.col("kind")}).filter("kind = 0")
    found = found.select("at", F.least(F.col("below") + 1, F.col("at")).alias("ring_first"))
    firsts = rows.select(F.col("at").alias("ring_first"), (F.col("_upto") - F.col("_size")).alias("_before"))
    held = rows.filter("_hit").join(found, "at").join(firsts, "ring_first")
    held = held.withColumns({"ring_packets": F.col("at") - F.col("ring_first") + 1, "ring_bytes": F.col("_upto") - F.col("_before")})
    return rows.drop("_hit", "_size", "_upto"), held.drop("_hit", "_size", "_upto", "_before")


def write_rings(packets: DataFrame, held: DataFrame, path: str, name: Column) -> None:
    """A PCAP file for each row of `held`, both as `rings` returns them; packets need ts_us and data. name: the file's, a column of `held`. So few rings as captures are kept (MOST_CAPTURES) are broadcast."""
    files = held.select(name.alias("file_name"), "ring_first", F.col("at").alias("ring_last")).limit(MOST_CAPTURES)
    rows = packets.join(F.broadcast(files), F.col("at").between(F.col("ring_first"), F.col("ring_last")))
    write_pcap(rows.repartition("file_name").sortWithinPartitions("file_name", "at"), path)


def alerts(judged: DataFrame) -> DataFrame:
    """Packets that a rule matched."""
    return judged.filter(F.col("rule_id").isNotNull())


def triggered(trigger: str) -> bool:
    """Whether matches are captured under this trigger mode."""
    return trigger.lower() in TRIGGERS


def capture_records(judged: DataFrame, trigger: str = "alert", kind: str = "alert", first_no: int = 1, size: Column | None = None) -> DataFrame:
    """The latest captures, oldest first: one for each matched packet, numbered in order over all of them. Needs src, dst (texts), ports, protocol, ts_us, seq.

    `size` is the size of the file; if not given, header and matched packet alone. What the ring holds at a match is `rings`, whose rows are matched packets too (ring_bytes + FILE_HEADER).
    """
    hit = alerts(judged) if triggered(trigger) else judged.limit(0)
    last = numbered_newest(hit, MOST_CAPTURES, ("ts_us", "seq"), "_no")
    no = F.col("_no") + (first_no - 1)
    size = F.coalesce(F.col("payload_len"), F.lit(0)) + RECORD_HEADER + FILE_HEADER if size is None else size
    return last.select(
        F.format_string(CAPTURE_ID, no).alias("capture_id"),
        F.lit(kind).alias("trigger_type"),
        five_tuple(F.col("src"), F.col("src_port"), F.col("dst"), F.col("dst_port"), F.col("protocol")).alias("five_tuple"),
        size.cast("long").alias("size_bytes"),
        F.floor(F.col("ts_us") / 1_000_000).alias("timestamp"),
        F.lit("indexed").alias("status"),
        F.concat(F.format_string(CAPTURE_ID, no), F.lit(".pcap")).alias("file_name"),
        "rule_id",
        no.cast("long").alias("no"),
        *(c for c in ("ring_first", "ring_packets", "at") if c in judged.columns),
    )


def kept_captures(captures: DataFrame, most: int = MOST_CAPTURES) -> DataFrame:
    return newest(captures, most, ["no"])


def capture_filter(captures: DataFrame, needle: str | None) -> DataFrame:
    """Captures with the needle in id, 5-tuple, rule or trigger, whatever the case of ASCII letters; all if it is blank."""
    if not needle:
        return captures
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.lit(False)
    for c in ("capture_id", "five_tuple", "rule_id", "trigger_type"):
        hit = hit | F.coalesce(low(F.col(c)).contains(low(F.lit(needle))), F.lit(False))
    return captures.filter(hit)


def capture_storage(captures: DataFrame, as_of_secs: int, ring_bytes: int = 0, ring_mb: int = 512) -> DataFrame:
    """One row about the stored captures and the ring."""
    kind = F.lower("trigger_type")
    age = F.greatest(F.lit(as_of_secs) - F.col("timestamp"), F.lit(0))
    used = 100.0 * ring_bytes / (ring_mb * 1024 * 1024) if ring_mb else 0.0
    return captures.agg(
        F.count(F.lit(1)).alias("stored_captures"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.count_if(age <= DAY_SECS).alias("today_captures"),
        F.count_if(kind == "alert").alias("alert_triggered"),
        F.count_if(kind == "manual").alias("manual_captures"),
        F.lit(used).alias("ring_buffer_used_pct"),
    )


def capture_bulk(captures: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row: how many of the asked captures there are (repeated ones as often), their bytes, and their files in the order asked for."""
    asked = captures.sparkSession.createDataFrame([(k, x) for k, x in enumerate(ids)], "pos int, capture_id string")
    first = captures.groupBy("capture_id").agg(F.min_by(F.struct("size_bytes", "file_name"), "no").alias("c"))
    return asked.join(first, "capture_id").agg(
        F.count(F.lit(1)).alias("selected"),
        F.coalesce(F.sum("c.size_bytes"), F.lit(0)).alias("total_size_bytes"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c.file_name"))), lambda x: x["file_name"]), ",").alias("files"),
    )


def capture_reconstruct(captures: DataFrame, capture_id: str | None = None) -> DataFrame:
    """What a session rebuilt from a capture would say; of one capture or all."""
    rows = captures if capture_id is None else captures.filter(F.col("capture_id") == capture_id)
    said = F.concat(F.lit("Reconstructed session for "), F.col("five_tuple"), F.lit(" ("), F.col("trigger_type"), F.lit(")"))
    return rows.select("capture_id", said.alias("summary"), "five_tuple", F.floor(F.col("size_bytes") / BYTES_PER_PACKET).alias("estimated_packets"))


def dead_letters(events: DataFrame, max_bytes: int, size: Column, order: str = "seq", threshold: float = 0.8, already: int = 0) -> DataFrame:
    """Events with `admitted`: whether the spool takes them. Once the admitted bytes reach the threshold it is shut, and stays so."""
    rows = running_sum(events, order, size, "_upto")
    return rows.withColumn("admitted", F.col("_upto") - size + already < max_bytes * threshold).drop("_upto")


def spooled(events: DataFrame, max_bytes: int, payload: Column, at: Column, order: str = "seq", threshold: float = 0.8, already: int = 0, first_no: int = 0) -> DataFrame:
    """The events that the spool takes, with file_name (their time `at` and number), payload, bytes and spool_bytes, the size of the spool with each."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    rows = events.withColumns({"payload": payload, "_at": at}).withColumn("bytes", size)
    rows = running_sums(rows, [F.col(order)], {"spool_bytes": F.col("bytes"), "_no": F.lit(1)})
    # what is taken comes before all that isn't, so the sums over all events are its own
    rows = rows.filter(F.col("spool_bytes") - F.col("bytes") + already < max_bytes * threshold)
    name = F.concat(F.date_format("_at", SPOOL_TIME), F.lit("_"), F.lpad(F.lower(F.hex(F.col("_no") - 1 + first_no)), 16, "0"), F.lit(".ges"))
    return rows.withColumns({"file_name": name, "spool_bytes": F.col("spool_bytes") + already}).drop("_no", "_at")


def write_spool(taken: DataFrame, path: str) -> None:
    """Appends `spooled` events to the spool's table, partitioned by the hour of their names. A row stands for what would be a file. For batch jobs; a stream takes `spool_batches`."""
    hour = F.substring("file_name", 1, 10)
    taken.select("file_name", "payload", "bytes", hour.alias("hour")).write.mode("append").partitionBy("hour").parquet(path)


def spool_state(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, next number) of a spool's table: what `spooled` takes as `already` and `first_no`."""
    rows = spark.read.schema("file_name string, bytes long").parquet(path)
    number = F.conv(F.substring("file_name", 16, 16), 16, 10).cast("long")
    return tuple(rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max(number) + 1, F.lit(0))).first())


#: What a batch leaves the spool with.
STATE = "bytes long, next_no long, taken long, refused long"


def spool_batches(path: str, max_bytes: int, payload: Column, at: Column, order: str = "seq", threshold: float = 0.8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what the spool takes of each batch, once, however often a batch is run.

    A batch's id names its events (`path`/events/batch=id) and the state that it leaves (`path`/state/batch=id), which is written last. A batch with a state is done; one without takes up the state of the batch before it and
    replaces the events that an attempt may have left. `spool_of` reads only events of batches that have a state.
    """

    def take(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        states = spool_states(spark, path)
        if not states.filter(F.col("batch") == n).isEmpty():
            return
        before = states.filter(F.col("batch") < n).orderBy(F.desc("batch")).first()
        already, number = (before["bytes"], before["next_no"]) if before else (0, 0)
        batch = written(batch, "spooling")  # read more than once, and a stream's batch may not be the same again
        taken = spooled(batch, max_bytes, payload, at, order, threshold, already, number)
        taken.select(order, "file_name", "payload", "bytes", "spool_bytes").write.mode("overwrite").parquet(f"{path}/events/batch={n}")
        own = spark.read.schema("bytes long").parquet(f"{path}/events/batch={n}").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("taken"))
        state = own.select((F.col("bytes") + already).alias("bytes"), (F.col("taken") + number).alias("next_no"), "taken", (F.lit(batch.count()) - F.col("taken")).alias("refused"))
        state.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={n}")

    return take


def spool_states(spark: SparkSession, path: str) -> DataFrame:
    """The state that each batch has left: STATE and batch."""
    if not exists(spark, f"{path}/state"):
        return spark.createDataFrame([], f"{STATE}, batch long")
    return spark.read.schema(f"{STATE}, batch long").parquet(f"{path}/state")


def spool_of(spark: SparkSession, path: str) -> DataFrame:
    """The events that a stream has spooled, with their batch."""
    done = spool_states(spark, path).select("batch")
    return spark.read.option("basePath", f"{path}/events").parquet(f"{path}/events/batch=*").withColumn("batch", F.col("batch").cast("long")).join(done, "batch", "left_semi")
