"""Flows and alerts of unbounded packet streams.

`session_flows` is Spark's own session window, with partial aggregation and state that a watermark bounds. `tracked_flows` keeps a record for each flow, with
the bounded samples that features need, and emits it with a close reason when an event-time timer says that it was idle.

Streams have ts TIMESTAMP beside the columns that `operators.flows` takes. Rows without a time or an address take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from packetloom.operators import rules as r
from packetloom.operators.flows import IDLE_US, KEY, NAMES, SAMPLES, normalized


def keyed(packets: DataFrame, delay: str) -> DataFrame:
    rows = normalized(packets.withColumn("ts_us", F.unix_micros("ts")))
    return rows.withWatermark("ts", delay)


def session_flows(packets: DataFrame, idle: str = "120 seconds", delay: str = "30 seconds") -> DataFrame:
    """A row for each session once the watermark has passed its end: counts by direction and the union of flags."""
    fwd, size = F.col("forward"), F.col("size")
    rows = keyed(packets, delay).groupBy(F.session_window("ts", idle), *KEY).agg(
        F.min("ts_us").alias("first_us"),
        F.max("ts_us").alias("last_us"),
        F.count_if(fwd).alias("fwd_packets"),
        F.count_if(~fwd).alias("rev_packets"),
        F.sum(F.when(fwd, size).otherwise(0)).alias("fwd_bytes"),
        F.sum(F.when(fwd, 0).otherwise(size)).alias("rev_bytes"),
        F.bit_or("tcp_flags").alias("tcp_flags"),
    )
    return rows.drop("session_window")


RECORD = "first_us long, last_us long, fwd_packets long, rev_packets long, fwd_bytes long, rev_bytes long, tcp_flags int, iats array<long>, sizes array<int>, dns_queries array<string>"
CLOSED = f"a_ip string, b_ip string, a_port int, b_port int, proto int, {RECORD}, close_reason string"


@dataclass
class Run:
    """Packets of a flow that no idle gap parts: counts, and of the first ones what samples need, as (time, seq, value)."""

    first: int
    last: int
    packets: list[int]
    sizes: list[int]
    flags: int
    head: list[tuple[int, int, int]]
    names: list[tuple[int, int, str]]

    def joined(self, other: Run) -> Run:
        add = lambda a, b: [x + y for x, y in zip(a, b)]
        return Run(
            min(self.first, other.first),
            max(self.last, other.last),
            add(self.packets, other.packets),
            add(self.sizes, other.sizes),
            self.flags | other.flags,
            sorted(self.head + other.head)[: SAMPLES + 1],
            sorted(self.names + other.names)[:NAMES],
        )


def runs_of(part: pd.DataFrame, idle_us: int) -> list[Run]:
    """The runs of some packets of a flow, in any order."""
    part = part.sort_values(["ts_us", "seq"], kind="stable")
    ts, seq, forward, size, flags = (part[c].to_numpy() for c in ("ts_us", "seq", "forward", "size", "tcp_flags"))
    cuts = [0, *(np.flatnonzero(np.diff(ts) > idle_us) + 1).tolist(), len(ts)]
    out = []
    for lo, hi in zip(cuts, cuts[1:]):
        fwd, own = forward[lo:hi].astype(bool), size[lo:hi].astype("i8")
        end = min(hi, lo + SAMPLES + 1)
        named = part.iloc[lo:hi][["ts_us", "seq", "dns_query"]].dropna(subset="dns_query").iloc[:NAMES]
        sides = (fwd, ~fwd)
        out.append(
            Run(
                int(ts[lo]),
                int(ts[hi - 1]),
                [int(x.sum()) for x in sides],
                [int(own[x].sum()) for x in sides],
                int(np.bitwise_or.reduce(flags[lo:hi].astype("i8"))),
                list(zip(ts[lo:end].tolist(), seq[lo:end].tolist(), size[lo:end].tolist())),
                [(int(t), int(k), str(x)) for t, k, x in named.itertuples(index=False)],
            )
        )
    return out


def joined(runs: list[Run], idle_us: int) -> list[Run]:
    """Runs of which no two are within the idle time of each other, in order."""
    out: list[Run] = []
    for run in sorted(runs, key=lambda r: (r.first, r.last)):
        if out and run.first - out[-1].last <= idle_us:
            out[-1] = out[-1].joined(run)
        else:
            out.append(run)
    return out


class FlowTracker(StatefulProcessor):
    """One flow: its open record in a value state, and a timer at the end of its idle time.

    Packets of a batch are taken in order of time. They come in chunks, of which only the runs are held: counts, and the first samples of each.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = []
        state = list(self.record.get()) if self.record.exists() else None
        runs: list[Run] = []
        for part in rows:
            if len(part):
                runs = joined(runs + runs_of(part, self.idle_us), self.idle_us)
        for run in runs:
            if state is not None and run.first - state[1] > self.idle_us:
                done.append((*key, *state, "IdleTimeout"))
                state = None
            times = [t for t, _, _ in run.head]
            gaps = np.diff([*([state[1]] if state else []), *times])
            state = state or [run.first, run.first, 0, 0, 0, 0, 0, [], [], []]
            state[0], state[1] = min(state[0], run.first), max(state[1], run.last)
            for k in (0, 1):
                state[2 + k] += run.packets[k]
                state[4 + k] += run.sizes[k]
            state[6] |= run.flags
            state[7] = [*state[7], *np.maximum(gaps, 0)[: SAMPLES - len(state[7])].tolist()]
            state[8] = [*state[8], *[x for _, _, x in run.head][: SAMPLES - len(state[8])]]
            state[9] = [*state[9], *[x for _, _, x in run.names][: NAMES - len(state[9])]]
        if state is not None:
            self.record.update(tuple(state))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int(state[1] + self.idle_us) // 1000 + 1)
        yield self.frame(done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done = []
        if self.record.exists():
            done.append((*key, *self.record.get(), "IdleTimeout"))
            self.record.clear()
        yield self.frame(done)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in CLOSED.split(", ")]
        return pd.DataFrame(rows, columns=names)

    def close(self) -> None:
        pass


def tracked_flows(packets: DataFrame, ip_text: Callable[[Column], Column], idle_us: int = IDLE_US, delay: str = "30 seconds") -> DataFrame:
    """Closed flows with their samples. ip_text: how addresses are written. The state store has to be RocksDB."""
    rows = keyed(packets, delay).withColumns({"a_ip": ip_text(F.col("a_ip")), "b_ip": ip_text(F.col("b_ip")), "dns_query": F.col("dns_query").cast("string")})
    rows = rows.select(*(F.col(c).cast("int").alias(c) if c not in ("a_ip", "b_ip") else F.col(c) for c in KEY), "ts", "ts_us", "seq", "forward", "size", "tcp_flags", "dns_query")
    return rows.groupBy(*KEY).transformWithStateInPandas(FlowTracker(idle_us), CLOSED, "Append", "EventTime")


def alerts(packets: DataFrame, rules=r.DEFAULT_RULES, inline: bool = True) -> DataFrame:
    """Packets of a stream that a rule matches, with the rule and the verdict."""
    return r.match_compiled(packets, rules, inline).filter("rule_id is not null")


def alerts_by_table(packets: DataFrame, load_rules: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], inline: bool = True) -> DataStreamWriter:
    """A writer that reads the rules anew for each batch, so that they can change while it runs."""
    return packets.writeStream.foreachBatch(lambda batch, n: sink(r.match_joined(batch, load_rules(), inline=inline).filter("rule_id is not null"), n))


