"""The queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from packetloom.plans.flow_queries import FLOW_QUERIES
from packetloom.plans.packet_queries import PACKET_QUERIES
from packetloom.plans.queries import Query
from packetloom.plans.rule_queries import RULE_QUERIES
from packetloom.plans.stream_queries import STREAM_QUERIES

ALL: list[Query] = [*FLOW_QUERIES, *RULE_QUERIES, *PACKET_QUERIES, *STREAM_QUERIES]
QUERIES: dict = {q.name: q for q in ALL}
SQL: dict[str, str] = {q.name: q.sql for q in ALL if q.sql}
FLAGSHIP = "flow_details"
