"""Ordered detection rules: the first enabled rule that matches gives the verdict.

A rule's criteria are nullable; null fits everything. Two forms give the same results: `match_compiled` turns a short list into one chain of
conditions inside code generation; `match_joined` takes a table of rules of any length as equi-joins, one for each
combination of criteria that occurs.

Packets have src_ip, dst_ip, src_port, dst_port, proto, tcp_flags and, if there are any, modbus_fc and dnp3_fc. A criterion never fits a null.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.binary import first_of
from packetloom.functions.net import ip_string, ip_struct
from packetloom.operators.joins import lookup
from packetloom.operators.ordered import running_sums
from packetloom.session import written

VERDICTS = ("pass", "drop", "alert")
#: Rules that `match_compiled` takes; longer lists are for `match_joined`.
MOST_COMPILED = 200
#: Tables of rules up to this size are broadcast.
BROADCAST_BYTES = 4 << 20
#: Rules that the driver takes to make these tables itself.
MOST_LOCAL = 10_000
EQUAL = {"src_ip": "src_ip", "dst_ip": "dst_ip", "src_port": "src_port", "dst_port": "dst_port", "protocol": "proto"}
LISTS = {"modbus_fcs": "modbus_fc", "dnp3_fcs": "dnp3_fc"}

SCHEMA = (
    "ordinal int, id string, description string, severity string, action string, enabled boolean, src_ip {ip}, dst_ip {ip}, src_port int, dst_port int, "
    "protocol int, flags_mask int, flags_value int, modbus_fcs array<int>, dnp3_fcs array<int>"
)
IP_STRUCT = "struct<len:int,addr:binary>"


@dataclass(frozen=True)
class Rule:
    id: str
    description: str
    severity: str
    action: str
    enabled: bool = True
    src_ip: str | int | None = None
    dst_ip: str | int | None = None
    src_port: int | None = None
    dst_port: int | None = None
    protocol: int | None = None
    flags_mask: int | None = None
    flags_value: int | None = None
    modbus_fcs: tuple[int, ...] = ()
    dnp3_fcs: tuple[int, ...] = ()

    def checked(self) -> Rule:
        """The rule with trimmed and lower-cased fields, as a request would be taken; ValueError for what isn't allowed."""
        out = replace(self, id=self.id.strip(), description=self.description.strip(), severity=self.severity.strip().lower(), action=self.action.strip().lower())
        if not out.id:
            raise ValueError("rule id must not be empty")
        if not out.description:
            raise ValueError("rule description must not be empty")
        if out.action not in VERDICTS:
            raise ValueError("action must be one of: drop, alert, pass")
        for name in ("src_ip", "dst_ip"):
            ip = getattr(out, name)
            if isinstance(ip, str):
                if not ip.strip():
                    out = replace(out, **{name: None})
                else:
                    try:
                        out = replace(out, **{name: str(ipaddress.ip_address(ip.strip()))})
                    except ValueError:
                        raise ValueError(f"invalid {name} address") from None
        return out


# The rules that are there from the start.
DEFAULT_RULES = (
    Rule("GE-NET-001", "SYN scan on port 0 (reconnaissance)", "high", "drop", dst_port=0, flags_mask=0x02, flags_value=0x02),
    Rule("GE-NET-002", "XMAS tree scan detected", "high", "drop", flags_mask=0x29, flags_value=0x29),
    Rule("GE-NET-003", "NULL scan detected (no TCP flags)", "medium", "alert", protocol=6, flags_mask=0xFF, flags_value=0x00),
    Rule("GE-OT-001", "Unauthorized Modbus write operation", "critical", "drop", dst_port=502, modbus_fcs=(5, 6, 15, 16)),
    Rule("GE-OT-002", "Unauthorized DNP3 control command", "critical", "drop", dst_port=20000, dnp3_fcs=(3, 4, 5, 6, 13, 14)),
)


def table(spark: SparkSession, rules: Sequence[Rule], ip: str = IP_STRUCT) -> DataFrame:
    """Rules as a table, in order. ip: the type of addresses, that of the packets."""
    kinds = SCHEMA.format(ip="string" if ip == IP_STRUCT else ip)
    rows = [(k, r.id, r.description, r.severity, r.action, r.enabled, r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol, r.flags_mask, r.flags_value, list(r.modbus_fcs), list(r.dnp3_fcs)) for k, r in enumerate(rules)]
    if ip != IP_STRUCT:
        return spark.createDataFrame(rows, kinds)
    packed = lambda x: None if x is None else (len(p := ipaddress.ip_address(x).packed), p)
    return spark.createDataFrame([(*r[:6], packed(r[6]), packed(r[7]), *r[8:]) for r in rows], SCHEMA.format(ip=IP_STRUCT))


def added(rules: Sequence[Rule], rule: Rule) -> tuple[Rule, ...]:
    """The list with a checked rule at its end; its id has to be new."""
    rule = rule.checked()
    if any(r.id == rule.id for r in rules):
        raise ValueError(f"rule '{rule.id}' already exists")
    return (*rules, rule)


def without(rules: DataFrame, rule_id: str) -> DataFrame:
    """The table without any rule of this id."""
    return rules.filter(F.col("id") != rule_id)


def by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    """The first rule of this id, if there is one."""
    return distinct_ids(rules.filter(F.col("id") == rule_id))


def distinct_ids(rules: DataFrame) -> DataFrame:
    """The first rule of each id."""
    first = rules.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    return rules.join(first, ["id", "ordinal"]).select(rules.columns)


def condition(rule: Rule, columns: Sequence[str]) -> Column:
    parts = []
    for name, field in EQUAL.items():
        wanted = getattr(rule, name)
        if wanted is not None:
            parts.append(F.col(field) == (ip_struct(wanted) if isinstance(wanted, str) else F.lit(wanted)))
    if rule.flags_mask is not None and rule.flags_value is not None:
        parts.append(F.col("tcp_flags").bitwiseAND(rule.flags_mask) == rule.flags_value)
    for name, field in LISTS.items():
        if codes := getattr(rule, name):
            parts.append(F.col(field).isin(*codes) if field in columns else F.lit(False))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def verdict(action: Column, inline: bool, default: str = "pass") -> Column:
    """The action that is taken: without inline mode a drop is an alert only; the default where no rule matched."""
    taken = action if inline else F.when(action == "drop", "alert").otherwise(action)
    return F.coalesce(taken, F.lit(default))


def match_compiled(packets: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, inline: bool = True, default: str = "pass") -> DataFrame:
    """`packets` with rule_ordinal, rule_id, rule_severity, rule_description (null without a match) and verdict."""
    if len(rules) > MOST_COMPILED:
        raise ValueError(f"over {MOST_COMPILED} rules: use match_joined")
    live = [(k, r) for k, r in enumerate(rules) if r.enabled]
    kind = "struct<ordinal:int,id:string,severity:string,description:string,action:string>"
    hit = F.lit(None).cast(kind)
    if live:
        value = lambda k, r: F.struct(F.lit(k), F.lit(r.id), F.lit(r.severity), F.lit(r.description), F.lit(r.action)).cast(kind)
        hit = first_of(*((condition(r, packets.columns), value(k, r)) for k, r in live))
    rows = packets.withColumn("_hit", hit)
    return _shown(rows, {"ordinal": F.col("_hit.ordinal"), "id": F.col("_hit.id"), "severity": F.col("_hit.severity"), "description": F.col("_hit.description"), "action": F.col("_hit.action")}, inline, default)


def _shown(rows: DataFrame, hit: dict[str, Column], inline: bool, default: str) -> DataFrame:
    out = rows.withColumns({"rule_ordinal": hit["ordinal"], "rule_id": hit["id"], "rule_severity": hit["severity"], "rule_description": hit["description"], "verdict": verdict(hit["action"], inline, default)})
    return out.drop("_hit")


#: What a hit is made of.
HIT = {"ordinal": "int", "id": "string", "severity": "string", "description": "string", "action": "string"}
HIT_TYPE = f"struct<{','.join(f'{c}:{t}' for c, t in HIT.items())}>"
#: Up to so many rules with times are looked through for each packet; of more, those of a packet's time are looked up.
MOST_LISTED = 500
#: Stretches of time of one combination of values that a slice of time holds at most, and is meant to hold.
SLICE_MOST, SLICE_MEANT = 16, 4
#: The end of what holds without end; what rows of rules and of tables of slices take.
FOREVER, ROW_BYTES, PLACE_BYTES = (1 << 63) - 1, 160, 64
#: Columns of rules that hold from one time to before another (null: without end).
VALID = {"valid_from_us": "bigint", "valid_to_us": "bigint"}


def match_joined(packets: DataFrame, rules: DataFrame, key: str = "seq", inline: bool = True, default: str = "pass") -> DataFrame:
    """As `match_compiled`, for a table of rules of any length. With the columns of VALID (as of `versions`) a packet is judged by the rules that hold at its ts_us.

    Rules with the same criteria set (which fields, which flag mask, which code lists) are one table with a row for each combination of values: the first
    rule that has them, or all of its rules with their times. More than MOST_LISTED rules with times go by `_sliced`. Packets are read once and meet each such table in a left join; the first of what was found is the hit. Tables of up to MOST_LOCAL rules and `BROADCAST_BYTES` are
    made by the driver and broadcast. Larger ones are joined: packets without a value for a criterion don't take part, and values that many packets have are looked up without a shuffle of these.
    Rules without criteria are a table of one row. Packets need no unique key; `key` is not used.
    """
    timed = "valid_from_us" in rules.columns
    live = _live(rules, VALID if timed else ())
    if timed:
        live = written(live, "rules")
        sliced = _sliced(packets, live)
        if sliced is not None:
            table = live.select(F.col("ordinal").cast("int").alias("_first"), F.struct(*(F.col(c).cast(t).alias(c) for c, t in HIT.items())).alias("_hit"))
            sliced = _met(sliced, table, ["_first"], live.count() * ROW_BYTES <= BROADCAST_BYTES, None).drop("_first")
            return _shown(sliced, {c: F.col(f"_hit.{c}") for c in HIT}, inline, default)
    rows = _listed(packets, live, timed)
    return _shown(rows, {c: F.col(f"_hit.{c}") for c in HIT}, inline, default)


def _live(rules: DataFrame, times: Iterable[str]) -> DataFrame:
    return rules.filter("enabled").select(*HIT, *EQUAL, "flags_mask", "flags_value", *LISTS, *times)


def _listed(packets: DataFrame, live: DataFrame, timed: bool) -> DataFrame:
    """`packets` with `_hit`, by tables that have the first rule of each combination of values, or all its rules with their times."""
    few = live.limit(MOST_LOCAL + 1).collect()
    local = len(few) <= MOST_LOCAL and sum(len(str(x)) for x in few) <= BROADCAST_BYTES
    tables = _local_tables(live, few, timed) if local else _joined_tables(live, timed)
    rows, hits = packets, []
    for k, (s, table, small) in enumerate(tables):
        left = _fields(s, packets.columns)
        names = [f"_{k}_{i}" for i in range(len(left))]
        table = table.select(*(F.col(f"_{i}").alias(n) for i, n in enumerate(names)), F.col("_rule").alias(f"_hit{k}"))
        if small:
            fits = reduce(lambda a, b: a & b, [c == F.col(n) for c, n in zip(left, names)], F.lit(True))
            rows = rows.join(F.broadcast(table), fits, "left").drop(*names)
        else:
            wide = rows.withColumns(dict(zip(names, left)))
            whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names], F.lit(True))
            missing = wide.filter(~whole).withColumn(f"_hit{k}", F.lit(None).cast(table.schema[f"_hit{k}"].dataType))
            rows = lookup(wide.filter(whole), table, names).unionByName(missing).drop(*names)
        hit = F.col(f"_hit{k}")
        if timed:
            now = F.filter(hit, lambda x: (x["valid_from_us"] <= F.col("ts_us")) & (x["valid_to_us"].isNull() | (F.col("ts_us") < x["valid_to_us"])))
            hit = F.array_min(F.transform(now, lambda x: F.struct(*(x[c].alias(c) for c in HIT))))
        hits.append(hit)
    none = F.lit(None).cast(HIT_TYPE)
    return rows.withColumn("_hit", F.least(*hits, none) if hits else none).drop(*(f"_hit{k}" for k in range(len(tables))))


def _local_tables(live: DataFrame, few: list[Row], timed: bool) -> list[tuple[dict, DataFrame, bool]]:
    """For each criteria set its table of combinations, made from rules that the driver has."""
    kinds = dict(live.dtypes)
    found: dict[tuple, dict[tuple, list]] = {}
    for r in sorted(few, key=lambda r: r["ordinal"]):
        mask = r["flags_mask"] if r["flags_value"] is not None else None
        s = (*(r[c] is not None for c in EQUAL), mask, *(bool(r[c]) for c in LISTS))
        plain = [r[c] for c in EQUAL if r[c] is not None] + ([r["flags_value"]] if mask is not None else [])
        plain = [tuple(map(_hashable, x)) if isinstance(x, Row) else x for x in plain]
        for codes in product(*(dict.fromkeys(r[c]) for c in LISTS if r[c])):
            found.setdefault(s, {}).setdefault((*plain, *codes), []).append(tuple(r[c] for c in (*HIT, *(VALID if timed else ()))))
    out = []
    for s, combos in found.items():
        named = dict(zip((*EQUAL, "mask", *LISTS), s))
        types = [kinds[c] for c in EQUAL if named[c]] + (["int"] if named["mask"] is not None else []) + ["int" for c in LISTS if named[c]]
        rule = f"array<struct<{','.join(f'{c}:{t}' for c, t in (HIT | VALID).items())}>>" if timed else HIT_TYPE
        rows = [(*combo, hits if timed else hits[0]) for combo, hits in combos.items()]
        schema = ", ".join([*(f"_{i} {t}" for i, t in enumerate(types)), f"_rule {rule}"])
        out.append((named, live.sparkSession.createDataFrame(rows, schema), True))
    return out


def _hashable(x):
    return bytes(x) if isinstance(x, bytearray) else x


def _joined_tables(live: DataFrame, timed: bool) -> list[tuple[dict, DataFrame, bool]]:
    """The same, as Spark jobs."""
    rule = F.struct(*(F.col(c).cast(t).alias(c) for c, t in (HIT | (VALID if timed else {})).items()))
    width = F.octet_length(F.concat_ws("", "id", "severity", "description", "action")) + 128
    out = []
    for s, same, right in _by_shape(live):
        size = same.agg(F.sum(width)).first()[0]
        names = [f"_{i}" for i in range(len(right))]
        of_values = F.array_sort(F.collect_list("_r")) if timed else F.min("_r")
        table = same.select(*(c.alias(n) for c, n in zip(right, names)), rule.alias("_r")).groupBy(*names).agg(of_values.alias("_rule"))
        out.append((s, table, not right or size <= BROADCAST_BYTES))
    return out


def _by_shape(live: DataFrame) -> Iterator[tuple[dict, DataFrame, list[Column]]]:
    """For each combination of criteria its rules, a row for each combination of codes, and what fields are compared with."""
    shaped = _shaped(live)
    for s in [r["shape"].asDict() for r in shaped.select("shape").distinct().collect()]:  # a row for each combination of criteria, not for each rule
        same = shaped.filter(_has(s))
        right = [F.col(name) for name in EQUAL if s[name]] + ([F.col("flags_value")] if s["mask"] is not None else [])
        for name in LISTS:
            if s[name]:
                right.append(F.col(f"_{name}"))
                same = same.withColumn(f"_{name}", F.explode(F.array_distinct(name)))
        yield s, same, right


def _shaped(live: DataFrame) -> DataFrame:
    mask = F.when(F.col("flags_value").isNotNull(), F.col("flags_mask"))
    return live.withColumn("shape", F.struct(*(F.col(c).isNotNull().alias(c) for c in EQUAL), mask.alias("mask"), *((F.size(c) > 0).alias(c) for c in LISTS)))


def _has(s: dict) -> Column:
    return reduce(lambda a, b: a & b, [F.col("shape")[c].eqNullSafe(F.lit(v)) for c, v in s.items()])


def _fields(s: dict, columns: Sequence[str]) -> list[Column]:
    """What of a packet is compared, for this combination of criteria."""
    left = [F.col(field) for name, field in EQUAL.items() if s[name]]
    left += [F.col("tcp_flags").bitwiseAND(s["mask"])] if s["mask"] is not None else []
    return left + [F.col(field) if field in columns else F.lit(None).cast("int") for name, field in LISTS.items() if s[name]]


def _sliced(packets: DataFrame, live: DataFrame) -> DataFrame | None:
    """`packets` with `_first`, the ordinal of the hit, where rules with times are many; None where they are few, where an ordinal is repeated, or where of two rules of the same values the one that begins later has the smaller ordinal.

    With ordinals in the order in which rules begin to hold, a rule is the first of its values in one stretch of time: from where all before it have ended, until it ends. These stretches don't overlap. For each combination of values
    time is cut into slices of equal length, several times as many as it has stretches over SLICE_MEANT; where stretches lie so closely that a slice has over SLICE_MOST, slices are cut again. So a packet meets a bounded number
    of stretches, however many rules there are: its combination gives the length of slices, its slice the stretches. Tables of slices and stretches are made for all combinations of criteria at once.
    """
    live = live.filter("valid_from_us is not null")
    n, different = live.agg(F.count(F.lit(1)), F.count_distinct("ordinal")).first()
    if n <= MOST_LISTED or different < n:
        return None
    shaped = _shaped(live)
    for name in LISTS:
        shaped = shaped.withColumn(f"_{name}", F.explode_outer(F.array_distinct(name)))
    of_shape = [*EQUAL, "mask", *LISTS]
    values = [f"_v{i}" for i in range(len(of_shape))]
    right = [*map(F.col, EQUAL), F.when(F.col("shape.mask").isNotNull(), F.col("flags_value")), *(F.col(f"_{name}") for name in LISTS)]
    own = Window.partitionBy("shape", *values).orderBy("_ordinal")
    begun = own.rowsBetween(Window.unboundedPreceding, -1)
    end = F.coalesce("valid_to_us", F.lit(FOREVER))
    times = shaped.select("shape", *(c.alias(v) for c, v in zip(right, values)), F.col("valid_from_us").alias("_from"), end.alias("_to"), F.col("ordinal").alias("_ordinal"))
    times = times.withColumns({"_late": F.coalesce(F.lag("_from").over(own) > F.col("_from"), F.lit(False)), "_from": F.greatest("_from", F.max("_to").over(begun))})
    times = written(times.filter("_from < _to or _late"), "stretches")
    if not times.filter("_late").isEmpty():
        return None
    levels = [(table, {r["shape"]: r["count"] for r in table.groupBy("shape").count().collect()}) for table in _slices(times.drop("_late"), ["shape", *values])]
    rows, hits = packets, []
    for k, shape in enumerate(levels[0][1]):
        s = shape.asDict()
        wanted = [v for v, c in zip(values, of_shape) if (s[c] is not None if c == "mask" else s[c])]
        names = [f"_{k}_{i}" for i in range(len(wanted))]
        rows = rows.withColumns(dict(zip(names, _fields(s, packets.columns))))
        for level, (table, counts) in enumerate(levels):
            last = level == len(levels) - 1
            slices = [f"_s{i}" for i in range(level)]
            keys = [*names, *(f"_{k}{x}" for x in slices)]
            found = ["_from", "_to", F.col("_ordinal").alias(f"_hit{k}")] if last else ["_lo", "_width", "_last"]
            table = table.filter(_has(s)).select(*(F.col(x).alias(y) for x, y in zip([*wanted, *slices], keys)), *found)
            small = not keys or counts[shape] * PLACE_BYTES <= BROADCAST_BYTES
            here = (F.col("_from") <= F.col("ts_us")) & (F.col("ts_us") < F.col("_to")) if last else None
            rows = _met(rows, table, keys, small, here)
            if not last:
                rows = rows.withColumn(f"_{k}_s{level}", F.expr("least((ts_us - _lo) div _width, _last)")).drop("_lo", "_width", "_last")
        rows = rows.drop("_from", "_to", *keys)
        hits.append(F.col(f"_hit{k}"))
    none = F.lit(None).cast("int")
    return rows.withColumn("_first", F.least(*hits, none) if hits else none).drop(*(f"_hit{k}" for k in range(len(hits))))


def _slices(times: DataFrame, keys: list[str]) -> Iterator[DataFrame]:
    """Tables by which stretches are found: for each combination of values, and slice of the level before, where its slices begin, how long they are and which is the last; at the end the stretches themselves, by slices of all levels."""
    level = 0
    while True:
        own = Window.partitionBy(*keys)
        sized = times.withColumns({"_n": F.count(F.lit(1)).over(own), "_lo": F.min("_from").over(own), "_hi": F.max("_from").over(own)})
        width = F.when(F.col("_n") > SLICE_MOST, F.greatest(F.lit(1), F.expr(f"(_hi - _lo + 1) * {SLICE_MEANT} div _n"))).otherwise(F.col("_hi") - F.col("_lo") + 1)
        sized = sized.withColumn("_width", width).withColumn("_last", F.expr("(_hi - _lo) div _width"))
        place = lambda x: F.expr(f"(least({x}, _hi) - _lo) div _width")
        placed = sized.withColumn(f"_s{level}", F.explode(F.sequence(place("_from"), place("_to - 1"))))
        # a stretch that began in an earlier slice begins here with the slice
        placed = written(placed.withColumn("_from", F.greatest("_from", F.col("_lo") + F.col(f"_s{level}") * F.col("_width"))), "placed")
        yield written(placed.select(*keys, "_lo", "_width", "_last").distinct(), "slices")
        times = placed.drop("_n", "_lo", "_hi", "_width", "_last")
        keys, level = [*keys, f"_s{level}"], level + 1
        if times.groupBy(*keys).count().filter(F.col("count") > SLICE_MOST).isEmpty():
            yield times
            return


def _met(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, here: Column | None) -> DataFrame:
    """`rows` left joined with `table` by keys, which may be null in rows, and by the condition `here`."""
    if small:
        other = [f"_of{n}" for n in keys]
        fits = reduce(lambda a, b: a & b, [F.col(n) == F.col(o) for n, o in zip(keys, other)], F.lit(True) if here is None else here)
        return rows.join(F.broadcast(table.withColumnsRenamed(dict(zip(keys, other)))), fits, "left").drop(*other)
    rows = written(rows, "rows")
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in keys])
    added = [f for f in table.schema.fields if f.name not in keys]
    missing = rows.filter(~whole).withColumns({f.name: F.lit(None).cast(f.dataType) for f in added})
    return lookup(rows.filter(whole), table, keys, where=here).unionByName(missing)


def requests(log: DataFrame) -> DataFrame:
    """A log of requests (seq, ts_us, op: add or delete, id, and what else rules have), in order of time and seq, with `accepted` and `answer`: an id can be added while it isn't there, and deleted while it is."""
    own = Window.partitionBy("id").orderBy("ts_us", "seq")
    before = F.coalesce(F.lag("op").over(own), F.lit("delete"))
    said = F.when(F.col("op") == "add", F.concat(F.lit("rule '"), "id", F.lit("' already exists"))).otherwise(F.concat(F.lit("rule '"), "id", F.lit("' not found")))
    rows = log.withColumn("accepted", F.col("op") != before)
    return rows.withColumn("answer", F.when(~F.col("accepted"), said))


def versions(log: DataFrame) -> DataFrame:
    """The rules that a log of `requests` makes, with the times from which and before which they hold; ordinal is their order, which is that in which they were added."""
    taken = requests(log).filter("accepted")
    until = F.lead("ts_us").over(Window.partitionBy("id").orderBy("ts_us", "seq"))  # what follows an accepted addition is an accepted deletion
    rows = taken.withColumns({"valid_from_us": F.col("ts_us"), "valid_to_us": until}).filter("op = 'add'")
    rows = running_sums(rows, [F.col("ts_us"), F.col("seq")], {"ordinal": F.lit(1)})
    return rows.withColumn("ordinal", (F.col("ordinal") - 1).cast("int")).drop("op", "seq", "ts_us", "accepted", "answer")


def held_at(rules: DataFrame, at_us: int) -> DataFrame:
    """The versions that hold at this time."""
    return rules.filter((F.col("valid_from_us") <= at_us) & (F.col("valid_to_us").isNull() | (F.col("valid_to_us") > at_us)))


def hits_of_versions(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """(ordinal, id, hits) of each version; hits go with their rule, so one that was added again counts anew."""
    counted = judged.filter(F.col("rule_ordinal").isNotNull()).groupBy(F.col("rule_ordinal").alias("ordinal")).agg(F.count(F.lit(1)).alias("hits"))
    return rules.select("ordinal", "id").join(counted, "ordinal", "left").select("ordinal", "id", F.coalesce("hits", F.lit(0)).alias("hits"))


def version_hits(packets: DataFrame, rules: DataFrame, at_us: int) -> DataFrame:
    """`hits_of_versions` of all packets for those of `versions` that hold at this time.

    A version is hit from when it begins only: packets before the first of these began, and rules that had ended by then, make no hit of theirs. Only ordinals are looked up, not what else rules have.
    """
    rules = written(rules, "versions")
    held = held_at(rules, at_us)
    since = held.filter("enabled").agg(F.min("valid_from_us")).first()[0]
    if since is None:
        return held.select("ordinal", "id", F.lit(0).cast("long").alias("hits"))
    packets, live = packets.filter(F.col("ts_us") >= since), _live(rules, VALID).filter(F.col("valid_to_us").isNull() | (F.col("valid_to_us") > since))
    sliced = _sliced(packets, live)
    first = _listed(packets, live, True).select(F.col("_hit.ordinal").alias("rule_ordinal")) if sliced is None else sliced.select(F.col("_first").alias("rule_ordinal"))
    return hits_of_versions(first, held)


def stats_of() -> dict[str, Column]:
    """Aggregates of judged packets. Packets without a match count as passed, whatever the default."""
    hit, v = F.col("rule_id").isNotNull(), F.col("verdict")
    return {
        "inspected": F.count(F.lit(1)),
        "passed": F.count_if(~hit | (v == "pass")),
        "dropped": F.count_if(hit & (v == "drop")),
        "alerted": F.count_if(hit & (v == "alert")),
        "matched": F.count_if(hit),
    }


def stats(judged: DataFrame) -> DataFrame:
    """One row of `stats_of`."""
    return judged.agg(*(c.alias(k) for k, c in stats_of().items()))


def hits(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """(id, hits) of each rule of the table, 0 for those without. Hits count by id."""
    counted = judged.filter(F.col("rule_id").isNotNull()).groupBy(F.col("rule_id").alias("id")).agg(F.count(F.lit(1)).alias("hits"))
    return rules.select("ordinal", "id").join(counted, "id", "left").select("ordinal", "id", F.coalesce("hits", F.lit(0)).alias("hits"))


def status(action: Column, enabled: Column, inline: bool) -> Column:
    return first_of((~enabled, "disabled"), (action == "drop", "blocking" if inline else "tap_only"), (action == "alert", "alert_only"), otherwise="pass")


def match_summary(ip_text=ip_string) -> Column:
    """The criteria of a row of the table in words; `any` without. ip_text: how addresses are written."""
    c = F.col
    wide = lambda x: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(x)), 2, "0"))
    codes = lambda x: F.concat(F.lit("["), F.array_join(x.cast("array<string>"), ", "), F.lit("]"))
    said = lambda name, x: F.concat(F.lit(f"{name}="), x)
    parts = [said("src_ip", ip_text(c("src_ip"))), said("dst_ip", ip_text(c("dst_ip")))]
    parts += [said("src_port", c("src_port").cast("string")), said("dst_port", c("dst_port").cast("string")), said("proto", c("protocol").cast("string"))]
    parts.append(F.concat(F.lit("tcp_flags("), wide(c("flags_mask")), F.lit(")="), wide(c("flags_value"))))
    parts += [F.when(F.size(name) > 0, said(field, codes(c(name)))) for name, field in LISTS.items()]
    return F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("any"))


def listing(judged: DataFrame, rules: DataFrame, inline: bool = True, ip_text=ip_string) -> DataFrame:
    """The rules as they are shown: with hits, summary and status."""
    counted = hits(judged, rules).select("ordinal", "hits")
    shown = rules.withColumns({"match_summary": match_summary(ip_text), "status": status(F.col("action"), F.col("enabled"), inline)})
    return shown.join(counted, "ordinal").select("ordinal", "id", "description", "severity", "action", "enabled", "hits", "match_summary", "status")
