"""Behavioural features of flows, as column expressions over aggregates.

All are computed in doubles. Null aggregates (no samples) give the value of an empty list, which is 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the feature vector.
FEATURES = (
    "conn_rate", "unique_dst", "dns_entropy", "beaconing_score", "traffic_asymmetry", "off_hours_pct", "iat_mean", "bytes_ratio",
    "protocol_entropy", "port_entropy", "packet_size_var", "tcp_flag_anomaly", "payload_entropy", "geo_distance",
)
#: Features that need other flows or more than packets hold: constants here.
CONSTANT = {"unique_dst": 1.0, "off_hours_pct": 0.0, "protocol_entropy": 0.0, "port_entropy": 0.0, "payload_entropy": 0.0, "geo_distance": 0.0}
# Weights of the anomaly score.
WEIGHTS = {"beaconing_score": 0.25, "dns_entropy": 0.15, "traffic_asymmetry": 0.15, "tcp_flag_anomaly": 0.25, "off_hours_pct": 0.10, "conn_rate": 0.10}
ANOMALOUS = 0.5

FIN, SYN, PSH, URG = 0x01, 0x02, 0x08, 0x20


def conn_rate(packets: Column, duration_us: Column) -> Column:
    """Packets a second; durations count as a millisecond at least."""
    return packets / F.greatest(duration_us / 1e6, F.lit(0.001))


def asymmetry(forward: Column, reverse: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(forward - reverse), forward + reverse), F.lit(0.0))


def bytes_ratio(total_bytes: Column, packets: Column) -> Column:
    return F.coalesce(F.try_divide(total_bytes, packets), F.lit(0.0))


def beaconing(n: Column, mean_ms: Column, stddev_ms: Column) -> Column:
    """How regular inter-arrival times are: 1 less their coefficient of variation, never below 0; 0 for fewer than two or without spacing."""
    return F.when((n >= 2) & (mean_ms >= 0.001), F.greatest(F.lit(0.0), 1 - F.least(stddev_ms / mean_ms, F.lit(1.0)))).otherwise(0.0)


def flag_anomaly(flags: Column) -> Column:
    """Of all flags that a flow has shown: SYN with FIN, FIN with PSH and URG, none at all. Flows without TCP have none."""
    both = lambda mask: flags.bitwiseAND(mask) == mask
    parts = F.when(both(SYN | FIN), 0.5).otherwise(0.0) + F.when(both(FIN | PSH | URG), 0.5).otherwise(0.0) + F.when(flags == 0, 0.3).otherwise(0.0)
    return F.least(parts, F.lit(1.0))


def byte_entropy(text: Column) -> Column:
    """Shannon entropy, in bits, of a string's UTF-8 bytes; 0 for null and empty ones."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    total = F.size(pairs)
    share = lambda b: F.size(F.filter(pairs, lambda x: x == b)) / total
    parts = F.transform(F.array_distinct(pairs), lambda b: -share(b) * F.log2(share(b)))
    return F.coalesce(F.when(F.length(text) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)), F.lit(0.0))


def ml_score(f: dict[str, Column]) -> Column:
    """The weighted sum of features scaled to 1, at most 1."""
    scaled = dict(f) | {"dns_entropy": F.least(f["dns_entropy"], F.lit(5.0)) / 5, "conn_rate": F.least(f["conn_rate"], F.lit(1000.0)) / 1000}
    total = sum((scaled[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.least(total, F.lit(1.0))
