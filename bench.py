"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from packetloom import registry
from packetloom.session import session

HEADLINE = ("flow_details", "flow_summary", "feat_vector", "rule_match_compiled", "rule_match_theta", "ips_stats", "frame_verdicts", "packet_info", "recent_packets_500", "netflow_v5", "syslog_parse", "byte_ring_suffix", "event_envelope", "metrics_text")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["ips_stats"](spark, sf_dir).collect()  # warm
    times = {}
    for name in HEADLINE:
        start = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
