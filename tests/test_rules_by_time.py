"""Rules that are added and deleted over time, against packets judged one by one; large tables of rules."""

import random

import duckdb
import pytest

from packetloom import registry
from packetloom.operators import joins
from packetloom.operators import rules as r

PACKETS = "seq long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, proto int, tcp_flags int, modbus_fc int"
LOG = "seq long, ts_us long, op string, " + r.SCHEMA.format(ip="long").replace("ordinal int, ", "")


def made(rng):
    log = []
    for k in range(120):
        kind = rng.randrange(5)
        rule = (rng.choice("abcdefgh"), "d", "low", rng.choice(["drop", "alert", "pass"]), rng.random() < 0.9, 1 if kind == 1 else None, None, None, rng.randrange(4) if kind in (0, 2) else None, 6 if kind == 3 else None, 3 if kind == 2 else None, rng.randrange(4) if kind == 2 else None, [1, 2, 2] if kind == 4 else [], [])
        log.append((k, rng.randrange(0, 500), "delete" if rng.random() < 0.4 else "add", *rule))
    packets = [(k, rng.randrange(0, 500), rng.choice([1, 2, 3]), 5, 7, rng.choice([0, 1, 2, 3, None]), rng.choice([6, 17, None]), rng.choice([0, 1, 2, 3, None]), rng.choice([None, None, None, 1, 2, 3])) for k in range(400)]
    return log, packets


def one_by_one(log, packets):
    """(seq of the request that made the hit, or None) for each packet, and what each request was answered."""
    held, accepted, steps = [], {}, sorted(log, key=lambda x: (x[1], x[0]))
    found, k = {}, 0
    for p in sorted(packets, key=lambda x: (x[1], x[0])):
        while k < len(steps) and steps[k][1] <= p[1]:
            x = steps[k]
            there = any(h[3] == x[3] for h in held)
            accepted[x[0]] = there == (x[2] == "delete")
            if x[2] == "delete":
                held = [h for h in held if h[3] != x[3]]
            elif not there:
                held.append(x)
            k += 1
        _, _, src, _, _, port, proto, flags, code = p
        fits = lambda h: h[7] and (h[8] is None or h[8] == src) and (h[11] is None or h[11] == port) and (h[12] is None or h[12] == proto) and (h[13] is None or (flags is not None and flags & h[13] == h[14])) and (not h[15] or code in h[15])  # noqa: B023, E731
        found[p[0]] = next((h[0] for h in held if fits(h)), None)
    return found, accepted


@pytest.mark.parametrize("large", [False, True])
def test_rules_by_time(spark, monkeypatch, large):
    if large:  # no table is small, every value is hot
        monkeypatch.setattr(r, "MOST_LOCAL", 0)
        monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_ROWS", 5)
    log, packets = made(random.Random(4))
    want, accepted = one_by_one(log, packets)
    requests, rules = spark.createDataFrame(log, LOG), r.versions(spark.createDataFrame(log, LOG))
    assert {x.seq: x.accepted for x in r.requests(requests).collect() if x.seq in accepted} == accepted
    made_by = {x.ordinal: (x.valid_from_us, x.id) for x in rules.collect()}
    judged = {x.seq: made_by.get(x.rule_ordinal) for x in r.match_joined(spark.createDataFrame(packets, PACKETS), rules).collect()}
    of = {x[0]: (x[1], x[3]) for x in log}
    assert judged == {k: of.get(v) for k, v in want.items()} and sum(v is not None for v in want.values()) > 100


@pytest.mark.parametrize("large", [False, True])
def test_many_rules_by_time_meet_few_of_them(spark, monkeypatch, large):
    """Rules of one value that follow closely in a burst, and some that hold long: a packet is joined with the stretches of its slice, and not with all rules of its value."""
    if large:
        monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_ROWS", 5)
    rng, log, seq = random.Random(8), [], 0
    for k in range(300):
        burst = k % 3 > 0
        start = -100 + 1_000_000 * (k % 3) + (k if burst else 40_000 * k)
        kind = k % 4
        name = rng.choice("abcdefgh") + str(kind)
        rule = (name, "d", "low", "drop", k % 11 > 0, None, None, None, 1 if kind in (0, 1) else None, None, 3 if kind == 1 else None, 1 if kind == 1 else None, [1, 2] if kind == 2 else [], [])
        log += [(seq, start, "add", *rule), (seq + 1, start + rng.choice([0, 1, 5, 300, 3_000_000]), "delete", *rule)]
        seq += 2
    packets = [(k, rng.choice([rng.randrange(-200, 12_000_000), 1_000_000 + rng.randrange(-120, 300), 2_000_000 + rng.randrange(-120, 300)]), 1, 5, 7, rng.choice([1, 1, 2, None]), 6, rng.choice([0, 1, 3, None]), rng.choice([None, 1, 2, 3])) for k in range(600)]
    want, _ = one_by_one(log, packets)
    rules = r.versions(spark.createDataFrame(log, LOG))
    monkeypatch.setattr(r, "MOST_LISTED", 0)
    monkeypatch.setattr(r, "_local_tables", None)  # lists of all rules of a value are not made
    monkeypatch.setattr(r, "_joined_tables", None)
    of = {x[0]: (x[1], x[3]) for x in log}
    made_by = {x.ordinal: (x.valid_from_us, x.id) for x in rules.collect()}
    judged = {x.seq: made_by.get(x.rule_ordinal) for x in r.match_joined(spark.createDataFrame([*packets], PACKETS), rules).collect()}
    assert judged == {k: of.get(v) for k, v in want.items()} and sum(v is not None for v in want.values()) > 200


@pytest.mark.parametrize("large", [False, True])
def test_joined_as_compiled(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(r, "MOST_LOCAL", 0)
        monkeypatch.setattr(r, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(joins, "HOT_ROWS", 5)
    _, packets = made(random.Random(5))
    rules = [r.Rule("codes", "d", "low", "drop", dst_port=1, modbus_fcs=(1, 3)), r.Rule("port", "d", "low", "alert", dst_port=1), r.Rule("all", "d", "low", "pass", enabled=False), r.Rule("flags", "d", "low", "drop", flags_mask=2, flags_value=2, protocol=6), r.Rule("ip", "d", "low", "drop", src_ip=3)]
    df = spark.createDataFrame(packets, PACKETS)
    both = [sorted((x.seq, x.rule_id, x.verdict) for x in rows.collect()) for rows in (r.match_compiled(df, rules), r.match_joined(df, r.table(spark, rules, "bigint")))]
    assert both[0] == both[1] and len({x[1] for x in both[0]}) == 5


def test_hits_of_many_versions(spark, monkeypatch):
    """Hits of the rules that hold at the end, found by slices of time as by lists."""
    log, packets = made(random.Random(6))
    rules = r.versions(spark.createDataFrame(log, LOG))
    df = spark.createDataFrame(packets, PACKETS)
    monkeypatch.setattr(r, "MOST_LISTED", 0)
    monkeypatch.setattr(r, "_local_tables", None)
    found = r.hits_of_versions(r.match_joined(df, rules), r.held_at(rules, 499))
    want, _ = one_by_one(log, packets)
    of = {x[0]: (x[1], x[3]) for x in log}
    made_by = {x.ordinal: (x.valid_from_us, x.id) for x in rules.collect()}
    assert (rows := found.collect()) and all(x.hits == sum(of.get(v) == made_by[x.ordinal] for v in want.values()) for x in rows) and sum(x.hits for x in rows) > 0


@pytest.mark.parametrize("listed", [False, True])
def test_hits_of_versions_at_times(spark, monkeypatch, listed):
    """Only packets since the first of the asked versions began are judged: the same hits as of all packets, also of versions that began early, are disabled, or compete with ones that have ended since."""
    if not listed:
        monkeypatch.setattr(r, "MOST_LISTED", 0)
    log, packets = made(random.Random(7))
    want, _ = one_by_one(log, packets)
    rules, df = r.versions(spark.createDataFrame(log, LOG)), spark.createDataFrame([*packets, (400, None, 1, 5, 7, 1, 6, 1, 1)], PACKETS)
    of, made_by = {x[0]: (x[1], x[3]) for x in log}, {x.ordinal: (x.valid_from_us, x.id) for x in rules.collect()}
    total = 0
    for at in (-1, 60, 250, 499):
        found = {x.ordinal: x.hits for x in r.version_hits(df, rules, at).collect()}
        assert found == {x.ordinal: sum(of.get(v) == made_by[x.ordinal] for v in want.values()) for x in r.held_at(rules, at).collect()}
        total += sum(found.values())
    assert total > 100


def test_version_hits_start_few_jobs_and_write_no_packets(spark, monkeypatch):
    """Five combinations of criteria: slices are made for all of them at once, not by jobs for each; packets aren't written to be met by what else rules have."""
    monkeypatch.setattr(r, "MOST_LISTED", 0)
    monkeypatch.setattr(r, "ROW_BYTES", r.BROADCAST_BYTES)
    tables, write = [], r.written
    monkeypatch.setattr(r, "written", lambda df, name: tables.append(name) or write(df, name))
    sf_dir, query = "/root/testdata/sf0.001", registry.QUERIES["rule_version_hits"]
    spark.sparkContext.setJobGroup("version hits", "")
    try:
        found = sorted(map(tuple, query(spark, sf_dir).collect()))
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("version hits"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    db = duckdb.connect()
    db.sql(f"create view events as select * from '{sf_dir}/events.parquet'")
    assert found == sorted(db.sql(query.sql).fetchall()) and found
    assert "rows" not in tables and jobs < 60
