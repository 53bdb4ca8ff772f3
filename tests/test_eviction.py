"""The table of bounded size against one that is kept packet by packet."""

import random
from collections import OrderedDict

import numpy as np
import pytest

from packetloom.operators import flows as fl
from packetloom.operators.eviction import count_at_most, with_evictions

SCHEMA = "seq long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, payload_len int, tcp_flags int, dns_query string"


def kept_packet_by_packet(rows, idle, most):
    """For each packet whether its flow's record had been lost to others, and why the record ends behind it."""
    table, cut, ends = OrderedDict(), {}, {}
    order = sorted(rows, key=lambda r: (r[1], r[0]))

    def expire(now):
        for key in [k for k, (_, ts) in table.items() if now - ts > idle]:
            ends[table.pop(key)[0]] = "IdleTimeout"

    seen = {}
    for r in order:
        expire(r[1])
        key = r[2:4]
        cut[r[0]] = key not in table and ends.get(seen.get(key)) == "CapacityEviction"
        if key not in table and len(table) >= most:
            ends[table.popitem(last=False)[1][0]] = "CapacityEviction"
        table[key] = (r[0], r[1])
        table.move_to_end(key)
        seen[key] = r[0]
    return cut, ends


@pytest.mark.parametrize(("most", "size"), [(1, 7), (5, 20), (8, 6), (12, 1000)])
def test_as_kept_packet_by_packet(spark, most, size):
    rng = random.Random(most)
    ts = 0
    rows = []
    for k in range(400):
        ts += rng.choice([0, 1, 5, 5, 5, 60])
        # a flow with a third of all packets, and some that are seldom seen
        flow = 1 if rng.random() < 0.34 else int(rng.paretovariate(0.6)) % 40 + 2
        rows.append((k, ts, flow, 10_000, 1, 2, 6, k % 90, 0, None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {x.seq: (x.cut, x.ends) for x in with_evictions(df, 200, most, range_rows=size).collect()}
    cut, ends = kept_packet_by_packet(rows, 200, most)
    assert found == {k: (cut[k], ends.get(k)) for k in cut} and "CapacityEviction" in ends.values()
    flows = fl.flows(with_evictions(df, 200, most, range_rows=size), 200, slice_us=300).collect()
    assert sorted(x.close_reason or "" for x in flows) == sorted([*ends.values(), *[""] * (len(flows) - len(ends))])


def test_few_rows(spark):
    for rows in ([], [(0, None, 1, 2, 1, 2, 6, 1, 0, None)], [(0, 5, 1, 2, 1, 2, 6, None, 0, None)], [(0, 5, 1, 2, 1, 2, 6, 1, 0, "a"), (0, 5, 1, 2, 1, 2, 6, 1, 0, "a")]):
        found = with_evictions(spark.createDataFrame(rows, SCHEMA), 10, 1).collect()
        assert [(x.cut, x.ends) for x in found] == [(False, None)] * sum(r[1] is not None for r in rows)


def test_count_at_most():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 200):
        values = rng.integers(0, 30, n)
        lo, hi, bound = rng.integers(0, n + 1, 300), rng.integers(0, n + 1, 300), rng.integers(-2, 33, 300)
        assert count_at_most(values, lo, hi, bound).tolist() == [int((values[a:b] <= x).sum()) for a, b, x in zip(lo, hi, bound)]
